"""Modes, stream specifications, context labels."""

from datetime import datetime, timedelta, timezone

import pytest

from tablesync.errors import StreamError
from tablesync.spec import Bookkeeping, Mode, ModelSpec, StreamSpec, SyncContext


def test_mode_from_config_reads_iso_and_normalises_to_utc():
    mode = Mode.from_config({"type": "INCREMENTAL", "period": "HOURLY", "start": "2025-01-01T01:00:00+01:00", "end": "2025-01-02"})
    assert mode.start == datetime(2025, 1, 1, tzinfo=timezone.utc)
    assert mode.to_dict()["end"] == "2025-01-02T00:00:00+00:00"
    assert Mode.from_config(mode.to_dict()) == mode


def test_mode_defaults_to_full_refresh():
    assert Mode.coerce(None) == Mode.full()
    assert not Mode.coerce({}).incremental


def test_mode_rejects_open_windows_and_unknown_types():
    with pytest.raises(ValueError):
        Mode("INCREMENTAL", start=datetime(2025, 1, 1))
    with pytest.raises(ValueError):
        Mode("SOMETIMES")


@pytest.mark.parametrize(
    ("period", "delta"),
    [
        ("WEEKLY", timedelta(days=7, hours=12)),
        ("DAILY", timedelta(days=1, hours=3)),
        ("SIXHOURLY", timedelta(hours=6, minutes=30)),
        ("HOURLY", timedelta(hours=1, minutes=15)),
    ],
)
def test_mode_delta(period, delta):
    assert Mode.delta(period) == delta


def test_p9_batch_id_is_epoch_millis():
    assert SyncContext.at("2025-01-10T00:00:00Z").batch_id == "1736467200000"
    assert SyncContext.at("2025-01-10T00:00:00.999999Z").batch_id == "1736467200999"


def test_stream_spec_from_config():
    spec = StreamSpec.from_config(
        {"schema": "s", "table": "t", "primary_field": "id", "filters": {"a": 1}, "drop_fields": ["a"], "query": "select 1"}
    )
    assert (spec.qualified_name, spec.folder, spec.keys, spec.query) == ("s.t", "s__t", ["id"], "select 1")


def test_p18_retarget_is_transitive():
    spec = StreamSpec("a", "x").retarget("y", "b").retarget("z", "c")
    assert spec.qualified_name == "z.c"


def test_q21_upsert_needs_a_key():
    with pytest.raises(StreamError):
        StreamSpec("t").require_keys()


def test_model_becomes_tenant_filtered_stream():
    model = ModelSpec("m", "s", "public", "leads", "id", "customer_id", "last_modified")
    spec = model.stream_for("Customer1")
    assert dict(spec.filters) == {"customer_id": "Customer1"}
    assert tuple(spec.drop_fields) == ("customer_id",)
    assert spec.cursor_field == "last_modified"


def test_bookkeeping_from_config():
    assert Bookkeeping.from_config({"batch_id": True, "version": "2"}) == Bookkeeping(batch_id=True, version="2")
    assert Bookkeeping.from_config(None) == Bookkeeping()
