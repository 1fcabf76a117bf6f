"""Multi-tenant, incremental table export as Spark plans."""

from tablesync.dataset import Dataset, Stream
from tablesync.progress import Progress
from tablesync.sinks import get_destination, get_destination_by_vendor, register_sink
from tablesync.sources import get_source, get_source_by_vendor, register_source
from tablesync.spec import Bookkeeping, Mode, ModelSpec, StreamSpec, SyncContext

__all__ = [
    "Bookkeeping",
    "Dataset",
    "Mode",
    "ModelSpec",
    "Progress",
    "Stream",
    "StreamSpec",
    "SyncContext",
    "get_destination",
    "get_destination_by_vendor",
    "get_source",
    "get_source_by_vendor",
    "register_sink",
    "register_source",
]
