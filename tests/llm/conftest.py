from __future__ import annotations

import glob
import os

import duckdb
import pytest

#: Names that operators use inside; documents may have such columns too.
CLASHES = ["size", "row", "row_key", "key", "fp", "taken", "score", "h", "line", "hits", "gone_lines"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
EXTRA = tuple(f"own {c}" for c in CLASHES)
LONG = "alpha beta gamma delta " * 30_000 + "\n" + "x" * 200_000

ODD = [
    (1, None, "en", "a", 0),
    (2, "", None, None, 0),
    (3, LONG, "en", "a", len(LONG)),
    (4, "the same short text stands here twice", "en", "b", 37),
    (4, "the same short text stands here twice", "en", "b", 37),
    (None, "a text without an id, but with words", "en", "b", 36),
    (5, " \n\t \n", "en", None, 5),
    (6, "*** 123 !!!", None, "c", 11),
    (7, "the same short text stands here twice", "de", "c", 37),
]


@pytest.fixture
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    return spark.createDataFrame([(*r, *EXTRA) for r in ODD], SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def table(spark, small):
    return lambda name: spark.read.parquet(f"{small}/{name}.parquet")


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return con


@pytest.fixture
def over(spark):
    """The SQL of a query over a given table instead of the given file."""

    def run(sql, **tables):
        con = duckdb.connect()
        for name, df in tables.items():
            con.register(f"{name}_arrow", df.toArrow())
            con.execute(f"create table {name} as select * from {name}_arrow")
        return con.execute(sql).fetchdf()

    return run
