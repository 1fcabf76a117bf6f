"""Declarative description of what a sync copies and how it is labelled."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta, timezone
from typing import Any, ClassVar

from tablesync.errors import StreamError

FULL_REFRESH = "FULL_REFRESH"
INCREMENTAL = "INCREMENTAL"

WEEKLY = "WEEKLY"
DAILY = "DAILY"
SIXHOURLY = "SIXHOURLY"
HOURLY = "HOURLY"

# How far a scheduled window looks back (period + overlap).
LOOKBACK = {
    WEEKLY: timedelta(days=7, hours=12),
    DAILY: timedelta(days=1, hours=3),
    SIXHOURLY: timedelta(hours=6, minutes=30),
    HOURLY: timedelta(hours=1, minutes=15),
}

# Distance between run time and slot that counts as drift.
DRIFT = {
    WEEKLY: timedelta(hours=3),
    DAILY: timedelta(hours=3),
    SIXHOURLY: timedelta(hours=1),
    HOURLY: timedelta(minutes=15),
}


def as_utc(value: datetime | str) -> datetime:
    """Aware UTC datetime; naive input is taken as UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if value.tzinfo is None:
        return value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc)


@dataclass(frozen=True)
class Mode:
    """Replication mode: a full refresh, or the half-open window ``[start, end)``."""

    FULL_REFRESH: ClassVar[str] = FULL_REFRESH
    INCREMENTAL: ClassVar[str] = INCREMENTAL
    WEEKLY: ClassVar[str] = WEEKLY
    DAILY: ClassVar[str] = DAILY
    SIXHOURLY: ClassVar[str] = SIXHOURLY
    HOURLY: ClassVar[str] = HOURLY

    type: str = FULL_REFRESH
    period: str = DAILY
    start: datetime | None = None
    end: datetime | None = None

    def __post_init__(self):
        for name in ("start", "end"):
            value = getattr(self, name)
            if value is not None:
                object.__setattr__(self, name, as_utc(value))
        if self.type not in (FULL_REFRESH, INCREMENTAL):
            raise ValueError(f"unknown replication type: {self.type}")
        if self.type == INCREMENTAL and (self.start is None or self.end is None):
            raise ValueError("an incremental mode needs a start and an end")

    @property
    def incremental(self) -> bool:
        return self.type == INCREMENTAL

    @classmethod
    def full(cls) -> Mode:
        return cls(FULL_REFRESH)

    @classmethod
    def window(cls, start, end, period: str = DAILY) -> Mode:
        return cls(INCREMENTAL, period, as_utc(start), as_utc(end))

    @classmethod
    def from_config(cls, config: Mapping[str, Any]) -> Mode:
        keys = ("type", "period", "start", "end")
        return cls(**{k: config[k] for k in keys if config.get(k) is not None})

    @classmethod
    def coerce(cls, value: Mode | Mapping[str, Any] | None) -> Mode:
        if value is None:
            return cls.full()
        return value if isinstance(value, Mode) else cls.from_config(value)

    @staticmethod
    def delta(period: str) -> timedelta:
        return LOOKBACK[period]

    def to_dict(self) -> dict[str, Any]:
        return {
            "type": self.type,
            "period": self.period,
            "start": self.start.isoformat() if self.start else None,
            "end": self.end.isoformat() if self.end else None,
        }

    def __str__(self) -> str:
        return json.dumps(self.to_dict())


@dataclass(frozen=True)
class StreamSpec:
    """One table of a sync: where it lives, its key, cursor, tenant filter and columns.

    ``primary_field`` may name one column or several. ``query`` replaces the table
    by a SQL text; ``include_columns`` narrows the read (key, cursor and filter
    columns are always read).
    """

    name: str
    schema_name: str = ""
    primary_field: str | Sequence[str] | None = None
    cursor_field: str | None = None
    filters: Mapping[str, Any] = field(default_factory=dict)
    drop_fields: Sequence[str] = ()
    include_columns: Sequence[str] = ()
    query: str | None = None
    namespace: str = "default"

    @property
    def keys(self) -> list[str]:
        if self.primary_field is None:
            return []
        if isinstance(self.primary_field, str):
            return [self.primary_field]
        return list(self.primary_field)

    @property
    def qualified_name(self) -> str:
        return f"{self.schema_name}.{self.name}" if self.schema_name else self.name

    @property
    def folder(self) -> str:
        return f"{self.schema_name}__{self.name}" if self.schema_name else self.name

    def require_keys(self) -> list[str]:
        if not self.keys:
            raise StreamError(f"stream {self.qualified_name} needs a primary field to be upserted")
        return self.keys

    def retarget(self, schema_name: str | None = None, name: str | None = None) -> StreamSpec:
        """The same stream under another target schema or name."""
        return replace(self, schema_name=schema_name or self.schema_name, name=name or self.name)

    @classmethod
    def from_config(cls, config: Mapping[str, Any], namespace: str = "default") -> StreamSpec:
        return cls(
            name=config["table"],
            schema_name=config.get("schema") or "",
            primary_field=config.get("primary_field"),
            cursor_field=config.get("cursor_field"),
            filters=dict(config.get("filters") or {}),
            drop_fields=tuple(config.get("drop_fields") or ()),
            include_columns=tuple(config.get("include_columns") or ()),
            query=config.get("query"),
            namespace=namespace,
        )


@dataclass(frozen=True)
class ModelSpec:
    """A vendor table offered to recipients: the tenant column decides who gets which row."""

    model_id: str
    source_id: str
    schema_name: str
    table_name: str
    primary_key_column: str
    tenant_id_column: str
    last_modified_at_column: str | None = None
    include_columns: Sequence[str] = ()

    def stream_for(self, tenant_id: Any, namespace: str = "default") -> StreamSpec:
        return StreamSpec(
            name=self.table_name,
            schema_name=self.schema_name,
            primary_field=self.primary_key_column,
            cursor_field=self.last_modified_at_column,
            filters={self.tenant_id_column: tenant_id},
            drop_fields=(self.tenant_id_column,),
            include_columns=tuple(self.include_columns),
            namespace=namespace,
        )


@dataclass(frozen=True)
class SyncContext:
    """Labels shared by every row of one run; all are literals fixed on the driver.

    ``timestamp_type`` is the type of the sync-time column: ``timestamp`` (an
    instant) or ``timestamp_ntz`` (the UTC wall clock).
    """

    synced_at: datetime
    batch_id: str
    prefix: str = "sync__"
    timestamp_type: str = "timestamp"

    @classmethod
    def at(cls, synced_at: datetime | str | None = None, batch_id: str | None = None, **kw) -> SyncContext:
        moment = as_utc(synced_at) if synced_at is not None else datetime.now(timezone.utc)
        millis = (moment - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1)
        return cls(moment, batch_id or str(millis), **kw)

    def column(self, name: str) -> str:
        return f"{self.prefix}{name}"


@dataclass(frozen=True)
class Bookkeeping:
    """Which label columns a run appends. The order batch id, checksum, version, sync time is fixed."""

    batch_id: bool = False
    checksum: bool | str = False
    version: str | None = None
    last_sync: bool = False

    @classmethod
    def from_config(cls, config: Mapping[str, Any] | None) -> Bookkeeping:
        config = config or {}
        return cls(
            batch_id=bool(config.get("batch_id")),
            checksum=config.get("checksum") or False,
            version=config.get("version") or None,
            last_sync=bool(config.get("last_sync")),
        )


#: What a transfer adds unless told otherwise.
TRANSFER_BOOKKEEPING = Bookkeeping(batch_id=True, last_sync=True)
