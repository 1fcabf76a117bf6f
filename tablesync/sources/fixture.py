"""The fixed rows used by connector self-tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablesync.sources.base import Source, inspect_schemas
from tablesync.spec import StreamSpec

STREAM = StreamSpec("transfer_test", "fixture", "id", "updated_at")

# Number of rows per tenant and day of January 2025 (1st to 5th).
ROWS_PER_DAY = {
    "Customer1": (7, 7, 7, 6, 2),
    "Customer2": (10, 8, 8, 4, 2),
    "Customer3": (11, 7, 7, 4, 10),
}

SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("score", T.LongType()),
        T.StructField("total", T.DoubleType()),
        T.StructField("open_date", T.DateType()),
        T.StructField("prefs", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]
)


def fixture_rows() -> list[tuple]:
    """100 rows built by rule, with the tenant and day counts of :data:`ROWS_PER_DAY`."""
    slots = [
        (tenant, dt.datetime(2025, 1, day, tzinfo=dt.timezone.utc))
        for tenant, counts in ROWS_PER_DAY.items()
        for day, n in enumerate(counts, start=1)
        for _ in range(n)
    ]
    created = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
    return [
        (
            str(i), created, updated, tenant, f"name {i}", f"user{i}@example.com", i % 10 + 1, round(i * 12.37, 2),
            dt.date(2024, 1, 1) + dt.timedelta(days=3 * i),
            f'{{"theme": "{"dark" if i % 2 else "light"}", "notifications": {"true" if i % 3 else "false"}}}',
            f"note {i}",
        )
        for i, (tenant, updated) in enumerate(slots, start=1)
    ]


class FixtureSource(Source):
    """Serves :func:`fixture_rows` under any configured stream; without one, the whole fixture."""

    default_namespace = "memory"

    @property
    def specs(self) -> list[StreamSpec]:
        return super().specs or [STREAM]

    def table(self, spec: StreamSpec) -> DataFrame:
        return self.spark.createDataFrame(fixture_rows(), SCHEMA)

    def inspect(self) -> DataFrame:
        return inspect_schemas(self.spark, [(STREAM.schema_name, STREAM.name, SCHEMA)])
