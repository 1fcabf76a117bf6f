"""What several operators share: reading tables, column names that cannot clash, broadcasts behind a count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word as most contracts define it: a run without ASCII white space (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"

#: Letters, digits and everything beyond ASCII; upper case is included, so texts need no lower-casing first.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts that a Python worker holds at once.
BATCH_ROWS = 1_000


def map_texts(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` in batches of at most :data:`BATCH_ROWS` rows, since texts are long; sets the session's limit."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(df: DataFrame) -> Column:
    """A document row's identity for joins back to its table: its id, and a hash of its text; repeated rows share one."""
    text = F.hex(F.xxhash64(F.col("text"), F.col("text").isNull()))
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text)


def only(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` with (``left_semi``) or without (``left_anti``) a row key in ``keys`` (one column, ``key``)."""
    (name,) = unused(docs, "row_key")
    kept = docs.withColumn(name, row_key(docs)).join(keys.withColumnRenamed("key", name), name, how)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
