"""Document fingerprints: SimHash of weighted terms, and permuted block tables (operator 6).

Terms are pairs of neighbouring words, a term's weight is one plus the binary logarithm of its count,
in whole sixteenths, and each bit of a term's 128-bit hash votes its weight up or down. A fingerprint has
the bits whose votes end above zero; sums of whole weights are exact in any order, so on any machine. Likeness is the share of equal bits.

To find all fingerprints within ``radius`` bits, fingerprints are cut into ``radius + 1`` blocks, of
which one must be equal; each of as many permuted tables leads with another block, is joined on it,
and whole distances are verified. Where a block leads more than ``BUSY`` fingerprints (a large group of
near copies), the remaining bits are cut into as many blocks again, of which one must be equal too, so
a table of two blocks is joined there. No pair is lost by it.

Editing: each text's last third is replaced by the start of the next document's, in descending order
of ids. Texts are sorted by id ranges, once, and each task reads its range in order; only the first
and last text of a range wait, and are paired in a second, small job. So no order runs through one
task, and a text is shuffled once.

Defined cases: null text: as empty; no word: fingerprint zero; a single word: that word is the only
term; null ids come last, repeated ids in order of their texts' hashes; a single document is its own
next; empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.functions.sizing import broadcast_if_small
from tablesync.llm.common import map_texts
from tablesync.workspace import written

BITS, RADIUS = 128, 3

#: Distinct fingerprints that a block may lead before the remaining bits are cut, too.
BUSY = 64

#: Documents of a range, on average; ranges at most; terms whose votes are counted at once.
RANGE_ROWS, MAX_RANGES, CHUNK = 4_000, 100_000, 1 << 14

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * by
    x = (x ^ (x >> np.uint64(27))) * _A
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str) -> tuple[int, int]:
    """The fingerprint of a text as two signed 64-bit integers."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0, 0
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    terms = hashes[:-1] * _B + hashes[1:] if len(words) > 1 else hashes
    terms, counts = np.unique(terms, return_counts=True)
    weights = np.rint(16 * (1 + np.log2(counts))).astype(np.float32)  # a chunk's sum is below 2^24, hence exact
    votes = np.zeros(BITS, np.float64)
    for at in range(0, len(terms), CHUNK):
        part = terms[at : at + CHUNK]
        both = np.stack((_mix(part, _A), _mix(part, _B)), axis=1)
        bits = np.unpackbits(both.view(np.uint8), axis=1, bitorder="little")
        some = weights[at : at + CHUNK]
        votes += 2.0 * (some @ bits.astype(np.float32)) - some.sum()
    high, low = np.packbits(votes > 0, bitorder="little").view(np.int64)
    return int(high), int(low)


def likeness(a: tuple[int, int], b: tuple[int, int]) -> float:
    apart = sum(((x ^ y) & ((1 << 64) - 1)).bit_count() for x, y in zip(a, b, strict=True))
    return 1 - apart / BITS


def edited(text: str, following: str) -> str:
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_DONE = ["doc_id", "n_chars", "edited_sha256", "high", "low", "edited_high", "edited_low", "near_edited", "near_next"]
_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, high long, low long, edited_high long, edited_low long, near_edited double, near_next double"
)


def _pair(doc_id, text: str, own: tuple[int, int], following: str, its: tuple[int, int]) -> tuple:
    new = edited(text, following)
    prints = own if new == text else fingerprint(new)
    digest = hashlib.sha256(new.encode("utf-8", "replace")).hexdigest()
    return (doc_id, len(text), digest, *own, *prints, likeness(own, prints), likeness(own, its))


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays(columns, names)


_TYPES = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.float64(), pa.float64()]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair each text of a range with the next; the first and the last come out with their texts."""
    place = TaskContext.get().partitionId()
    names, types = [*_DONE, "place", "first", "last"], [*_TYPES, pa.int64(), pa.string(), pa.string()]
    before = None
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            own = fingerprint(text)
            if before is None:
                out.append((*[None] * 9, place, text, None))
            else:
                out.append((*_pair(*before, text, own), place, None, None))
            before = (doc_id, text, own)
        if out:
            yield _table(out, names, types)
    if before is not None:
        yield _table([(before[0], *[None] * 8, place, None, before[1])], names, types)


def _at_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "last", "first")), strict=True)
        out = [_pair(i, text, fingerprint(text), nxt, fingerprint(nxt)) for i, text, nxt in rows]
        if out:
            yield _table(out, _DONE, _TYPES)


def paired(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint and its edited text's, as pairs of integers, with likenesses."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = min(MAX_RANGES, max(1, math.ceil(rows.count() / RANGE_ROWS)))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    found = map_texts(ordered.select("doc_id", "text"), _in_order, f"{_SCHEMA}, place long, first string, last string")
    found = written(found, "fingerprints")
    places = sorted(r.place for r in found.where("last is not null").select("place").collect())  # one per range
    following = [(a, b) for a, b in zip(places, places[1:] + places[:1], strict=True)]
    steps = spark.createDataFrame(following, "place long, after long")
    first = found.where("first is not null").select(F.col("place").alias("after"), "first")
    ends = found.where("last is not null").select("doc_id", "last", "place").join(steps, "place").join(first, "after")
    rest = map_texts(ends.select("doc_id", "last", "first"), _at_ends, _SCHEMA)
    return found.where("edited_sha256 is not null").select(*_DONE).union(rest)


def _bits(high: str, low: str) -> Column:
    return F.concat(*[F.lpad(F.bin(c), 64, "0") for c in (high, low)])


def _blocks(high: str, low: str, radius: int) -> Column:
    """The leading block of each permuted table: ``radius + 1`` runs of bits that make up the fingerprint."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    blocks = [F.conv(F.substring(_bits(high, low), a + 1, b - a), 2, 36) for a, b in zip(cuts, cuts[1:], strict=False)]
    return F.array(*blocks)


def _second_blocks(high: str, low: str, radius: int) -> Column:
    """Within the table ``permutation``: ``radius + 1`` runs of the bits that its leading block leaves."""
    text, pieces = _bits(high, low), radius + 1
    cut = [F.floor(BITS * (F.col("permutation") + i) / pieces).cast("int") for i in (0, 1)]
    rest = F.concat(F.substr(text, F.lit(1), cut[0]), F.substr(text, cut[1] + 1, F.lit(BITS)))
    cuts = [F.floor(F.length(rest) * i / pieces).cast("int") for i in range(pieces + 1)]
    return F.array(*[F.conv(F.substr(rest, a + 1, b - a), 2, 36) for a, b in zip(cuts, cuts[1:], strict=False)])


def within(queries: DataFrame, table: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs of fingerprints at most ``radius`` bits apart, once each.

    ``queries`` and ``table`` have distinct ``high``, ``low`` and any other columns with other names;
    all are returned, the table's fingerprint as ``its_high`` and ``its_low``.
    """
    at, then = ["permutation", "block"], ["second", "second_block"]
    left = queries.select("*", F.posexplode(_blocks("high", "low", radius)).alias(*at))
    right = table.withColumnsRenamed({"high": "its_high", "low": "its_low"})
    right = right.select("*", F.posexplode(_blocks("its_high", "its_low", radius)).alias(*at))
    busy = written(right.groupBy(at).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUSY).select(at), "fingerprint-busy")
    pairs = left.join(right, at)
    if not busy.isEmpty():
        busy = broadcast_if_small(busy)
        pairs = left.join(busy, at, "left_anti").join(right, at)
        asked = left.join(busy, at, "left_semi").select("*", F.posexplode(_second_blocks("high", "low", radius)).alias(*then))
        held = right.join(busy, at, "left_semi").select("*", F.posexplode(_second_blocks("its_high", "its_low", radius)).alias(*then))
        pairs = pairs.unionByName(asked.join(held, at + then).drop(*then))
    apart = F.bit_count(F.col("high").bitwiseXOR(F.col("its_high"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("its_low")))
    return pairs.where(apart <= radius).drop(*at).distinct()


def fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document; ``n_near_edited``: documents whose fingerprint is within ``radius`` of the edited text's."""
    rows = written(paired(docs), "paired")
    known = rows.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"))
    asked = rows.select(F.col("edited_high").alias("high"), F.col("edited_low").alias("low")).distinct()
    near = within(asked, known, radius).groupBy("high", "low").agg(F.sum("n").alias("n_near_edited"))
    out = rows.join(near.toDF("edited_high", "edited_low", "n_near_edited"), ["edited_high", "edited_low"], "left")

    def digits(high: str, low: str) -> Column:
        return F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (high, low)]))

    return out.select(
        "doc_id", "n_chars", "edited_sha256",
        digits("high", "low").alias("fingerprint"), digits("edited_high", "edited_low").alias("edited_fingerprint"),
        "near_edited", "near_next", F.coalesce("n_near_edited", F.lit(0)).cast("long").alias("n_near_edited"),
    )
