"""SimHash near-duplicates by multi-index hashing (operator 3).

A document's fingerprint has a bit for every bit that over half of its shingles' hashes set. Two
fingerprints link at a distance of two bits or fewer, and components of links are groups.

Multi-index hashing: a fingerprint is cut into two segments of 32 bits, and a table holds every
fingerprint under (segment number, segment value). Of two fingerprints within two bits, either the
first segments are within one bit or the second ones are equal. So each fingerprint looks up the ball
of radius one around its first segment (33 values) and the one value of its second segment, and
every match is verified on the complete distance. The links are all pairs within two bits, of which a
fingerprint has at most 2,080.

Copies edited in few places share segment values in large numbers. The members of a value are counted
first; in one with more than ``BUSY`` the other segment is looked up too, by a value within one bit of it on
either side (two segments two bits apart have such a value in common). That is exact as well, and no
entry has more than 33 members, whatever the size of a group.

Scale: texts go once through an Arrow batch function that returns 8 bytes per document; links are
sought among distinct fingerprints, so exact copies cost nothing; 34 short entries of each are
shuffled once. Components are contracted by joins. Nothing is collected.

Defined cases: null or blank text: fingerprint zero, linked like any other; fewer than three words:
one shingle of all of them; null ids: such a document links, but gives no component id; repeated
rows: each is returned; empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.functions.sizing import broadcast_if_small
from tablesync.llm.common import map_texts, row_key, unused
from tablesync.llm.components import components
from tablesync.workspace import written

SHINGLE = 3
SEED = 42

#: Bits of a segment, and what to flip in one for the values of its ball (radius one, itself included).
SEGMENT = 32
BALL = [0, *(1 << i for i in range(SEGMENT))]

#: Distinct fingerprints under one segment value, above which the other segment is looked up too.
BUSY = 64

#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text; bit ``i`` is set if over half of the shingle hashes have it."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = [b" ".join(p) for p in zip(*(words[i:] for i in range(shingle)), strict=False)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts))
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        found = np.fromiter((simhash(t.as_py() or b"") for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(found)], ["doc_id", "row", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``row`` (the row key) and ``fp`` (the fingerprint's 64 bits) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row"), "text")
    return map_texts(rows, _hashed, "doc_id long, row string, fp long")


def _flips() -> Column:
    return F.explode(F.array(*[F.lit(x).cast("long") for x in BALL]))


def entries(distinct: DataFrame) -> DataFrame:
    """The tables: ``segment`` (0 or 1), ``value``, the ``other`` segment's value, and ``fp``."""
    high, low = F.shiftrightunsigned("fp", SEGMENT), F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1))
    both = distinct.select("fp", high.alias("high"), low.alias("low"))
    sides = F.array(F.struct(F.lit(0).alias("segment"), F.col("high").alias("value"), F.col("low").alias("other")),
                    F.struct(F.lit(1).alias("segment"), F.col("low").alias("value"), F.col("high").alias("other")))
    return both.select("fp", F.explode(sides).alias("e")).select("e.*", "fp")


def links(distinct: DataFrame) -> DataFrame:
    """All pairs ``a`` < ``b`` of the distinct ``fp`` that differ in two bits or fewer."""
    table = entries(distinct)
    busy = written(table.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUSY), "simhash-busy")
    busy = broadcast_if_small(busy.select("segment", "value"))
    first = table.where("segment = 0").select("segment", "value", "other", "fp", _flips().alias("flip"))
    first = first.withColumn("value", F.col("value").bitwiseXOR(F.col("flip")))
    asked = first.union(table.where("segment = 1").withColumn("flip", F.lit(0).cast("long")))
    at = ["segment", "value"]

    def match(asking: DataFrame, held: DataFrame, on: list[str]) -> DataFrame:
        pairs = asking.withColumnRenamed("fp", "a").join(held.withColumnRenamed("fp", "b"), on)
        return pairs.where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b")

    plain = match(asked.join(busy, at, "left_anti").select(*at, "fp"), table.select(*at, "fp"), at)
    if busy.isEmpty():
        return plain
    held = table.join(busy, at, "left_semi").select(*at, "other", "fp", _flips().alias("own"))
    held = held.select(*at, F.col("other").bitwiseXOR(F.col("own")).alias("other"), "fp")
    asked = asked.join(busy, at, "left_semi")
    near = asked.where("flip = 0").select(*at, "other", "fp", _flips().alias("own"))  # equal segments leave two bits to the others
    near = near.select(*at, F.col("other").bitwiseXOR(F.col("own")).alias("other"), "fp")
    asked = near.union(asked.where("flip != 0").select(*at, "other", "fp"))  # else there is one bit left
    return plain.union(match(asked, held, [*at, "other"]).distinct())


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``row``, ``fp`` and ``component_id`` (the smallest id in its component) of every document."""
    prints = written(fingerprints(docs), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(links(distinct)).toDF("fp", "root")
    known = distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(least, "root").select("fp", "component_id", "root")
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hexadecimal digits), ``component_id``."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id (null ids last)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    chosen = groups(docs).groupBy("root").agg(first.alias("first")).select("first.row")
    (key,) = unused(docs, "row_key")
    kept = docs.withColumn(key, row_key(docs)).join(chosen.withColumnRenamed("row", key), key, "left_semi")
    return kept.dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])
