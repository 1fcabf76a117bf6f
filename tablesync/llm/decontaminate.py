"""Benchmark decontamination by greedy string tiling (operator 5).

Seeds are runs of five words, hashed by a Karp-Rabin rolling sum over 64-bit word hashes. Seeds that a
document shares with a benchmark item are joined; runs of seeds on one diagonal are the maximal
common passages. Tiling takes the longest passage whose words are still free on both sides, marks its
words, and goes on with what is left, until no five free words match. Tiles may stand in any order, so
reordered passages count. A document is contaminated by an item if its tiles cover at least 80 % of
the item's words. Karp-Rabin runs with a falling length: hashes of many seeds in a row find the long
passages, these are marked, and half as many seeds are looked for among the words that are left.

Scale: benchmark seeds first fill a bitmap of at most 2 MB, which goes to all tasks; only document
positions that pass it leave their task (a hash, key and position, never text), and the
exact join by seed follows. The benchmark side is broadcast only if a count allows it. A document and
an item meet as two lists of positions, one of each, never as pairs of positions: what they hold grows
with the sum of their words. Pairs of positions are looked at in bounded pieces, of which only the ends of passages stay.
A document whose seeds cannot reach the coverage, wherever they stand, is not tiled.

Defined cases: words are runs of letters, digits and non-ASCII characters, without regard to the
case of A-Z; null or empty text matches nothing; an item of fewer than five words is one seed, found
where all of it stands in a row; repeated rows (same id and text) give one result; of equally long passages the one
earliest in the item, then in the document, is taken; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.functions.sizing import broadcast_if_small
from tablesync.llm.common import map_texts, only, row_key
from tablesync.workspace import written

#: Words of a seed (of shorter items: all), which is also the shortest tile; the share of an item that makes a document go.
SEED_WORDS, COVERAGE = 5, 0.8

#: Pairs of positions that are looked at in one piece.
PIECE = 1 << 20

#: Bits of the bitmap for each seed, and bits at most; beyond, it lets more through and stays exact.
BITS_PER_SEED, MAX_BITS = 64, 1 << 24

_BASE = 0x9E3779B97F4A7C15
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_PLAIN).split()


def seeds(tokens: list[bytes], size: int = SEED_WORDS) -> np.ndarray:
    """The rolling hash of every run of ``size`` words."""
    if len(tokens) < size:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    count = len(tokens) - size + 1
    out = np.zeros(count, np.uint64)
    for i in range(size):
        out = out * np.uint64(_BASE) + hashes[i : i + count]
    return _mixed(out)


def _mixed(sums: np.ndarray) -> np.ndarray:
    """Low bits of a sum modulo 2**64 depend on low bits only; afterwards on others too."""
    return (sums ^ (sums >> np.uint64(29))) * np.uint64(_BASE)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, key, text in zip(*(batch.column(c).to_pylist() for c in ("item_id", "item", "text")), strict=True):
            tokens = words(text.encode("utf-8") if text else None)
            size = min(SEED_WORDS, len(tokens))
            if not size:
                continue
            found = seeds(tokens, size).view(np.int64)
            n = len(found)
            columns = [pa.array([item] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array([len(tokens)] * n, pa.int32())]
            columns += [pa.array([size] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), pa.array(found)]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "item", "n_words", "size", "ipos", "seed"])


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """``item_id``, ``item`` (key of id and text), ``n_words``, ``size`` (words of a seed), ``ipos`` and ``seed`` of every seed of every item."""
    key = F.xxhash64(F.col("item_id").cast("string"), F.col("item_id").isNull(), F.col("text"))
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), key.alias("item"), "text")
    return map_texts(items.distinct(), _item_seeds, "item_id long, item long, n_words int, size int, ipos int, seed long")


def bitmap(found: DataFrame) -> np.ndarray:
    """A bitmap of all seeds, as 64-bit words: at most 2 MB, filled by an aggregate."""
    n = found.count()
    bits = 1 << max(16, min(MAX_BITS, n * BITS_PER_SEED).bit_length())
    bits = min(bits, MAX_BITS)
    at = F.col("seed").bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    cells = found.groupBy(F.floor(at / 64).cast("int").alias("cell")).agg(F.bit_or(bit).alias("mask"))
    filled = np.zeros(bits // 64, np.int64)
    for cell, mask in cells.collect():  # at most 2**18 rows
        filled[cell] = mask
    return filled.view(np.uint64)


def _passing(bits: np.ndarray, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = np.uint64(len(bits) * 64 - 1)
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            out: list[list] = [[], [], [], [], []]
            for i, text in enumerate(batch.column("text").cast(pa.binary())):
                tokens = words(text.as_py())
                for size in sizes:
                    found = seeds(tokens, size)
                    at = found & limit
                    hit = np.flatnonzero((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))
                    if len(hit):
                        out[0] += [ids[i]] * len(hit)
                        out[1] += [keys[i]] * len(hit)
                        out[2].append(np.full(len(hit), size, np.int32))
                        out[3].append(hit.astype(np.int32))
                        out[4].append(found[hit].view(np.int64))
            if out[0]:
                columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), *[pa.array(np.concatenate(x)) for x in out[2:]]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "size", "dpos", "seed"])

    return run


def _in_a_row(hashes: np.ndarray, count: int) -> np.ndarray:
    """The hash of every ``count`` (a power of two) seeds in a row."""
    span, base = 1, _BASE
    while span < count:
        hashes = _mixed(hashes[:-span] * np.uint64(base) + hashes[span:])
        span, base = span * 2, base * base % (1 << 64)
    return hashes


class _Side:
    """One side of a pair: positions in ascending order, their seeds, and the words that tiles have taken."""

    def __init__(self, at: np.ndarray, found: np.ndarray, size: int):
        self.at, self.seeds, self.size = at.astype(np.int64), found.view(np.uint64), size
        self.used = np.zeros(int(self.at[-1]) + size, bool)

    def refresh(self) -> None:
        """Which seeds have no taken word."""
        taken = np.concatenate(([0], np.cumsum(self.used)))
        self.free = taken[self.at + self.size] == taken[self.at]

    def windows(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Where ``count`` free seeds stand in a row, and their hash."""
        last = len(self.at) - count + 1
        missing = np.concatenate(([0], np.cumsum(~self.free)))
        fits = (self.at[count - 1 :] - self.at[:last] == count - 1) & (missing[count:] == missing[:last])
        where = np.flatnonzero(fits)
        return where, _in_a_row(self.seeds, count)[where]


def _goes_on(d: _Side, i: _Side, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """Do the free seeds at ``x`` and ``y`` have equal free neighbours, one ``step`` away?"""
    nx, ny = x + step, y + step
    inside = (nx >= 0) & (ny >= 0) & (nx < len(d.at)) & (ny < len(i.at))
    nx, ny = np.where(inside, nx, 0), np.where(inside, ny, 0)
    beside = (d.at[nx] - d.at[x] == step) & (i.at[ny] - i.at[y] == step)
    return inside & beside & d.free[nx] & i.free[ny] & (d.seeds[nx] == i.seeds[ny])


def _passages(d: _Side, i: _Side, count: int) -> list[tuple[int, int, int]]:
    """Maximal free passages of at least ``count`` seeds: ``(-words, item position, document position)``."""
    (x, hx), (y, hy) = d.windows(count), i.windows(count)
    order = np.argsort(hy, kind="stable")
    y, hy = y[order], hy[order]
    low = np.searchsorted(hy, hx)
    n = np.searchsorted(hy, hx, "right") - low
    x, low, n = x[n > 0], low[n > 0], n[n > 0]
    begins, ends, done = [], [], np.cumsum(n)
    at = 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PIECE, "right")))
        some = n[at:to]
        within = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        a, b = np.repeat(x[at:to], some), y[np.repeat(low[at:to], some) + within]
        for found, side, edge in ((begins, -1, 0), (ends, 1, count - 1)):
            stops = ~_goes_on(d, i, a + edge, b + edge, side)
            found.append((d.at[a[stops] + edge], i.at[b[stops] + edge]))
        at = to
    if not begins:
        return []

    def along(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        dpos, ipos = (np.concatenate(c) for c in zip(*found, strict=True))
        by = np.lexsort((dpos, dpos - ipos))
        return dpos[by], ipos[by]

    (first, item), (last, _) = along(begins), along(ends)  # the n-th begin on a diagonal has the n-th end
    return list(zip((first - last - d.size).tolist(), item.tolist(), first.tolist(), strict=True))


def tile(dpos: np.ndarray, dseeds: np.ndarray, iseeds: np.ndarray, size: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Tiles ``(length, item position, document position)``.

    ``dpos`` and ``dseeds``: ascending positions in the document and their seeds; ``iseeds``: all seeds of the item.
    """
    d, i = _Side(dpos, dseeds, size), _Side(np.arange(len(iseeds)), iseeds, size)
    tiles, count = [], 1 << (min(len(d.at), len(i.at)).bit_length() - 1)
    while count:
        d.refresh()
        i.refresh()
        heap = _passages(d, i, count)
        heapq.heapify(heap)
        while heap:
            length, at_i, at_d = heapq.heappop(heap)
            taken = i.used[at_i : at_i - length] | d.used[at_d : at_d - length]
            if not taken.any():
                i.used[at_i : at_i - length] = d.used[at_d : at_d - length] = True
                tiles.append((-length, at_i, at_d))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
            for start, end in edges.reshape(-1, 2).tolist():  # what is left free competes again by its length
                if end - start >= count + size - 1:  # shorter ones are found again by a smaller count
                    heapq.heappush(heap, (start - end, at_i + start, at_d + start))
        count //= 2
    return tiles


def reachable(dseeds: np.ndarray, iseeds: np.ndarray, size: int) -> int:
    """Words of the item that lie in a seed of the document: no tiles cover more."""
    at = np.flatnonzero(np.isin(iseeds, dseeds))
    return int(np.minimum(np.diff(at), size).sum()) + size if len(at) else 0


def _tiled(coverage: float):
    names = ["doc_id", "row", "item_id", "n_words", "n_tiles", "matched"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, own = batch.column("hits"), batch.column("own")
            sizes, lengths = batch.column("size").to_pylist(), batch.column("n_words").to_pylist()
            which, tiles, matched = [], [], []
            for x in range(len(batch)):
                dpos, dseeds = (hits[x].values.field(c).to_numpy() for c in ("dpos", "seed"))
                iseeds = own[x].values.to_numpy()
                if reachable(dseeds, iseeds, sizes[x]) / lengths[x] < coverage:
                    continue
                order = np.argsort(dpos)
                found = tile(dpos[order], dseeds[order], iseeds, sizes[x])
                words_in = sum(t[0] for t in found)
                if words_in / lengths[x] >= coverage:
                    which.append(x)
                    tiles.append(len(found))
                    matched.append(words_in)
            kept = batch.select(names[:4]).take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(tiles, pa.int32()), pa.array(matched, pa.int32())], names)

    return run


def tiled(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Documents and the items they cover: ``doc_id``, ``row``, ``item_id``, ``n_words`` (of the item), ``n_tiles``, ``matched``."""
    known = written(item_seeds(benchmark), "item-seeds")
    sizes = sorted(r.size for r in known.select(F.col("size").alias("size")).distinct().collect())  # five at most
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row"), "text")
    passing = map_texts(rows, _passing(bitmap(known), sizes), "doc_id long, row string, size int, dpos int, seed long")
    hits = passing.join(broadcast_if_small(known.select("item", "size", "seed").distinct()), ["size", "seed"])
    pairs = hits.groupBy("row", "item").agg(F.first("doc_id").alias("doc_id"), F.collect_set(F.struct("dpos", "seed")).alias("hits"))
    items = known.groupBy("item", "item_id", "n_words", "size").agg(F.array_sort(F.collect_list(F.struct("ipos", "seed"))).alias("own"))
    items = items.withColumn("own", F.col("own.seed"))
    pairs = pairs.join(broadcast_if_small(items), "item").select("doc_id", "row", "item_id", "n_words", "size", "hits", "own")
    return map_texts(pairs, _tiled(coverage), "doc_id long, row string, item_id long, n_words int, n_tiles int, matched int")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Documents and the items they hold: ``doc_id``, ``item_id``, ``n_words``, ``n_tiles``, ``matched``, ``coverage``."""
    found = tiled(docs, benchmark, coverage).withColumn("coverage", F.col("matched") / F.col("n_words"))
    return found.select("doc_id", "item_id", "n_words", "n_tiles", "matched", "coverage")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the contaminated ones."""
    found = tiled(docs, benchmark, coverage)
    return only(docs, written(found.select(F.col("row").alias("key")).distinct(), "contaminated"), "left_anti")
