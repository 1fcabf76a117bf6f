"""Approximate nearest neighbours with robust-pruned directed graphs (operator 13).

Vectors are dealt to shards by a hash. Each shard links its distinct vectors to a directed graph: a
node searches the graph greedily from the shard's centre, what the search has seen is proposed as
neighbours, and relaxed distance pruning keeps a proposal only if no nearer kept neighbour is closer
to it by a factor (``ALPHA``), which leaves diverse edges. Links are entered in both directions, and
lists that grow too long are pruned again. A query searches every shard with a beam: of the nodes
found so far the nearest unvisited ones are expanded, until the beam holds visited ones alone.

Nearness is the inner product. For the graph's distances every vector gets one more component,
``sqrt(max - |x|^2)``, which makes the largest inner product the smallest distance. What the beams
return is scored anew in double precision on the original vectors.

Scale: equal vectors are one node that carries its 21 smallest ids (more cannot be among 20 nearest;
a window that keeps 21 rows per task before it shuffles finds them), so thousands of copies neither
fill the graph nor the lists. A shard has ``64 * sqrt(nodes)`` nodes, at most 131,072: that balances
the shards that a query visits against their size, and bounds a task's memory. Graphs are written
once; queries are the stated set of every 20th id and visit each shard in blocks of 16,384 distinct
vectors, so no task holds all queries or all rows and nothing is broadcast. A task that is lost is
repeated from the written graphs. Random choices come from fixed seeds; a graph depends on its rows only.

Recall against brute force, on sf0.1 and check tables, is stated in the README; a test asks for 0.9.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components, and rows
without id, take no part, neither as queries nor as candidates; vectors of different lengths never
meet (each length has shards of its own); rows of equal id and vector are one; rows of equal id and
different vectors are different rows, which may find each other and are answered each; equal scores
rank by id; fewer than 20 candidates: all that are found; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesync.workspace import written

#: Neighbours of a query; the ids divisible by this are queries.
NEAREST, EVERY = 20, 20

#: Edges of a node after pruning, and before it is pruned again; the factor of relaxed pruning.
DEGREE, FULL, ALPHA = 32, 48, 1.2

#: Nodes that a greedy search of the construction, and the beam of a query, holds; nodes that a step expands.
BUILD_BEAM, QUERY_BEAM, STEP = 64, 128, 4

#: Nodes that enter the graph at once; nodes per square root of all of them in a shard, and at most.
INSERTED, SHARD_ROOT, SHARD_MOST = 512, 64, 131_072

#: Distinct query vectors of a block; queries that walk the graph side by side.
QUERY_BLOCK, ABREAST = 16_384, 256

#: Distances between proposals that pruning holds at once.
PAIRS = 1 << 22

_FAR = np.float32(np.inf)


def beam(data: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``width`` nearest nodes that a beam search finds, nearest first, and their squared distances.

    ``edges`` has a row per node, padded with -1; unused places of the result are -1 at infinity.
    """
    n, m = len(data), len(queries)
    norms, own = np.einsum("ij,ij->i", data, data), np.einsum("ij,ij->i", queries, queries)
    width = min(width, n)
    row = np.arange(m)[:, None]
    seen = np.zeros((m, n + 1), bool)  # the last column is for the padding

    def distance(nodes: np.ndarray) -> np.ndarray:
        cross = np.einsum("mkd,md->mk", data[nodes], queries, optimize=False)
        return norms[nodes] - 2 * cross + own[:, None]

    nodes = np.full((m, width), -1, np.int64)
    far = np.full((m, width), _FAR, np.float32)
    begin = np.broadcast_to(starts[:width], (m, min(width, len(starts))))
    nodes[:, : begin.shape[1]], far[:, : begin.shape[1]] = begin, distance(begin)
    seen[row, begin] = True
    order = np.argsort(far, axis=1, kind="stable")
    nodes, far = np.take_along_axis(nodes, order, 1), np.take_along_axis(far, order, 1)
    done = nodes < 0
    while not done.all():
        rank = np.where(done, width, np.arange(width))
        step = min(STEP, width)
        pick = np.argpartition(rank, step - 1, axis=1)[:, :step]
        open_ = ~np.take_along_axis(done, pick, 1)
        done[row, pick] = True
        fresh = edges[np.where(open_, np.take_along_axis(nodes, pick, 1), 0)]
        fresh = np.where(open_[:, :, None], fresh, -1).reshape(m, -1)
        fresh = np.where(seen[row, fresh], -1, fresh)
        fresh.sort(axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
        seen[row, fresh] = True
        seen[:, -1] = False
        used = (fresh >= 0).sum(axis=1).max(initial=0)
        if not used:
            continue
        fresh.sort(axis=1)
        fresh = fresh[:, -used:]
        away = np.where(fresh >= 0, distance(fresh), _FAR)
        nodes, far = np.concatenate((nodes, fresh), 1), np.concatenate((far, away), 1)
        done = np.concatenate((done, fresh < 0), 1)
        best = np.argpartition(far, width - 1, axis=1)[:, :width]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(far, best, 1), axis=1, kind="stable"), 1)
        nodes, far, done = (np.take_along_axis(x, best, 1) for x in (nodes, far, done))
    return nodes, far


def prune(data: np.ndarray, own: np.ndarray, proposed: np.ndarray, alpha: float = ALPHA, degree: int = DEGREE) -> np.ndarray:
    """Diverse neighbours of the nodes ``own`` among their ``proposed`` rows (-1: none), nearest first, padded with -1."""
    m, k = proposed.shape
    if m > 1 and m * k * k > PAIRS:
        rows = max(1, PAIRS // (k * k))
        return np.concatenate([prune(data, own[at : at + rows], proposed[at : at + rows], alpha, degree) for at in range(0, m, rows)])
    ordered = np.sort(proposed, axis=1)
    ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
    ordered[ordered == own[:, None]] = -1
    points = data[ordered]
    norms = np.einsum("mkd,mkd->mk", points, points)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(points, points.transpose(0, 2, 1))
    here = data[own]
    away = norms - 2 * np.einsum("mkd,md->mk", points, here) + np.einsum("md,md->m", here, here)[:, None]
    away = np.where(ordered >= 0, away, _FAR)
    out, row = np.full((m, degree), -1, np.int64), np.arange(m)
    left = away.copy()
    for at in range(degree):
        next_ = left.argmin(axis=1)
        found = left[row, next_] < _FAR
        if not found.any():
            break
        out[found, at] = ordered[row, next_][found]
        closer = between[row, next_] * (alpha * alpha) <= away  # the distances are squared
        left[closer] = _FAR
        left[row, next_] = _FAR
    return out


def _enter(data: np.ndarray, edges: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
    """Adds the edges ``source`` to ``target`` and prunes the lists that are then full."""
    order = np.lexsort((target, source))
    source, target = source[order], target[order]
    nodes, begin, count = np.unique(source, return_index=True, return_counts=True)
    held = (edges[nodes] >= 0).sum(axis=1)
    fits = held + count <= FULL
    place = held.repeat(count) + np.arange(len(source)) - begin.repeat(count)
    ok = fits.repeat(count)
    edges[source[ok], place[ok]] = target[ok]
    for at in range(0, len(over := np.flatnonzero(~fits)), INSERTED):
        part = over[at : at + INSERTED]
        wide = int((held + count)[part].max())
        proposed = np.full((len(part), wide), -1, np.int64)
        proposed[:, :FULL] = edges[nodes[part]][:, :wide]
        for i, x in enumerate(part):
            proposed[i, held[x] : held[x] + count[x]] = target[begin[x] : begin[x] + count[x]]
        edges[nodes[part]] = -1
        edges[nodes[part], :DEGREE] = prune(data, nodes[part], proposed)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """The vectors with the component that makes the largest inner product the smallest distance."""
    squared = np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)
    extra = np.sqrt(np.maximum(0, squared.max(initial=0) - squared))
    return np.concatenate((vectors, extra[:, None]), axis=1).astype(np.float32)


def graph(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a row per node, padded with -1) and the nodes where searches start."""
    n = len(data)
    edges = np.full((n, FULL), -1, np.int64)
    centre = int(np.argmin(np.einsum("ij,ij->i", data - data.mean(axis=0), data - data.mean(axis=0))))
    starts = np.unique(np.concatenate(([centre], np.random.default_rng(n).permutation(n)[:STEP])))
    order = np.concatenate((starts, np.setdiff1d(np.random.default_rng(n + 1).permutation(n), starts, assume_unique=True)))
    entered = 0
    while entered < n:
        batch = order[entered : entered + max(STEP, min(INSERTED, entered // 2))]
        among = beam(data, edges, starts, data[batch], BUILD_BEAM)[0] if entered else np.empty((len(batch), 0), np.int64)
        if entered < 2 * INSERTED:  # early nodes enter together: they may also be each other's neighbours
            among = np.concatenate((among, np.broadcast_to(batch, (len(batch), len(batch)))), axis=1)
        chosen = prune(data, batch, among)
        edges[batch, :DEGREE] = chosen
        edges[batch, DEGREE:] = -1
        at, place = np.nonzero(chosen >= 0)
        _enter(data, edges, chosen[at, place], batch[at])
        entered += len(batch)
    return edges, starts


def _matrix(column: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), -1)


def _built(table: pa.Table) -> pa.Table:
    table = table.sort_by("node").combine_chunks()
    edges, starts = graph(lifted(_matrix(table.column("vec"))))
    flat = edges.astype(np.int32).ravel()
    ends = pa.array(np.arange(0, len(flat) + 1, FULL, dtype=np.int32))
    first = np.zeros(len(table), bool)
    first[starts] = True
    columns = [table.column("shard"), table.column("node"), pa.array(np.arange(len(table), dtype=np.int32)), pa.array(first)]
    return pa.table([*columns, table.column("vec"), table.column("ids"), pa.ListArray.from_arrays(ends, pa.array(flat))], ["shard", "node", "at", "start", "vec", "ids", "edges"])


_GRAPH = "shard string, node string, at int, start boolean, vec array<double>, ids array<long>, edges array<int>"
_FOUND = "node string, vec_id long, score double, twin boolean"


def _searched(index: pa.Table, asked: pa.Table) -> pa.Table:
    names = ["node", "vec_id", "score", "twin"]
    types = [pa.string(), pa.int64(), pa.float64(), pa.bool_()]
    if not len(index) or not len(asked):
        return pa.table([pa.array([], t) for t in types], names)
    index = index.sort_by("at")
    vectors, queries = _matrix(index.column("vec")), _matrix(asked.column("vec"))
    data, edges = lifted(vectors), _matrix(index.column("edges"), np.int64)
    starts = np.flatnonzero(index.column("start").to_numpy())
    flat = np.concatenate((queries, np.zeros((len(queries), 1))), axis=1).astype(np.float32)
    ids, names_of, askers = (index.column("ids").to_pylist(), index.column("node").to_pylist(), asked.column("node").to_pylist())
    owners, found, scores, twins = [], [], [], []
    for at in range(0, len(queries), ABREAST):
        nodes, _ = beam(data, edges, starts, flat[at : at + ABREAST], QUERY_BEAM)
        for i, near in enumerate(nodes, at):
            near = near[near >= 0]
            score = np.einsum("ij,j->i", vectors[near], queries[i])
            order = np.argsort(-score, kind="stable")
            own, own_scores, own_twins = [], [], []
            for x in order:  # a node's ids tie; nodes beyond the last score that fits cannot enter
                if len(own) > NEAREST and score[x] < own_scores[-1]:
                    break
                own += ids[near[x]]
                own_scores += [score[x]] * len(ids[near[x]])
                own_twins += [names_of[near[x]] == askers[i]] * len(ids[near[x]])
            best = np.lexsort((np.array(own, np.int64), -np.array(own_scores)))[: NEAREST + 1]
            owners += [i] * len(best)
            found += [own[b] for b in best]
            scores += [own_scores[b] for b in best]
            twins += [own_twins[b] for b in best]
    node = asked.column("node").combine_chunks().take(pa.array(owners, pa.int64()))
    return pa.table([node, pa.array(found, pa.int64()), pa.array(scores, pa.float64()), pa.array(twins, pa.bool_())], names)


def usable(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``vec`` (doubles) and ``node`` (a key of the vector) of all rows that take part, each once."""
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))

    def unfit(x):
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    rows = rows.where(~F.exists("vec", unfit)).where(F.exists("vec", lambda x: x != 0))
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    node = F.concat_ws("-", F.size("vec").cast("string"), F.hex(F.xxhash64("vec")), F.hex(F.xxhash64("vec", F.lit(1))))
    return rows.withColumn("node", node).distinct()


def graphs(rows: DataFrame) -> DataFrame:
    """The shards' graphs: a row per distinct vector with its ``shard``, place, smallest ids and edges."""
    place = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    least = rows.withColumn("place", place).where(F.col("place") <= NEAREST + 1)
    nodes = written(least.groupBy("node").agg(F.any_value("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    count = nodes.count()
    shards = max(1, math.ceil(count / min(SHARD_MOST, SHARD_ROOT * math.sqrt(max(1, count)))))
    shard = F.concat_ws("-", F.size("vec").cast("string"), F.pmod(F.xxhash64("node"), F.lit(shards)).cast("string"))
    dealt = nodes.withColumn("shard", shard).select("shard", "node", "vec", "ids")
    return written(dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(_built, _GRAPH), "graphs")


def nearest(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", every: int = EVERY) -> DataFrame:
    """The nearest rows of every row whose id is divisible by ``every``: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``."""
    rows = written(usable(embeddings, vec_id, vector), "usable-vectors")
    index = graphs(rows)
    asking = written(rows.where(F.col("vec_id") % every == 0).select("vec_id", "node"), "queries")
    asked = rows.join(asking.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.any_value("vec").alias("vec"))
    asked = written(asked, "query-vectors")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(blocks)).cast("int"))
    shards = index.select(F.col("shard").alias("shard")).distinct().withColumn("size", F.split("shard", "-")[0])
    visits = asked.withColumn("size", F.size("vec").cast("string")).join(shards, "size").select("shard", "block", "node", "vec")
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = copies.groupBy("shard", "block").cogroup(visits.groupBy("shard", "block")).applyInArrow(_searched, _FOUND)
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "vec_id"))
    best = written(found.withColumn("place", place).where(F.col("place") <= NEAREST + 1).drop("place"), "found")
    lists = best.groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "twin"))).alias("near"))
    answers = asking.withColumnRenamed("vec_id", "query_id").join(lists, "node")
    others = F.slice(F.filter("near", lambda x: ~x["twin"] | (x["vec_id"] != F.col("query_id"))), 1, NEAREST)
    answers = answers.select("query_id", F.posexplode(others).alias("place", "x"))
    return answers.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
