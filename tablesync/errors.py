"""Exceptions raised while planning or running a sync."""


class SyncError(Exception):
    """Base of every error raised by this package."""


class StreamError(SyncError):
    """A stream specification cannot be applied."""


class StreamMissingField(StreamError):
    """A declared key, cursor, filter or dropped column is not in the stream."""


class SourceError(SyncError):
    """Base of source errors."""


class SourceConnectionFailed(SourceError):
    """The source could not be reached."""


class SourceStreamDoesNotExist(SourceError):
    """A requested table does not exist in the source."""


class SourceStreamInvalidSchema(SourceError):
    """A source table lacks a column the stream specification names."""


class DestinationError(SyncError):
    """Base of destination errors."""


class DestinationConnectionFailed(DestinationError):
    """The destination could not be reached."""


class DestinationStreamInvalidSchema(DestinationError):
    """An existing target does not have the schema of the stream."""


class IntegrityCheckFailed(SyncError):
    """The rows loaded for a batch differ from the rows staged."""


class DuplicateKeys(SyncError):
    """The stage holds a primary key twice and the policy forbids it."""


class RunGapDetected(SyncError):
    """The last successful run lies before the window of this run."""
