"""Ranked lexical search with document FP-trees (operator 11).

Every benchmark item ranks all documents by an integer score of BM25's form: a sum over the item's
terms of ``w * ((10**9 * tf) div (1000 * tf + 8 * m))``, where ``m`` grows with the document's length.

A document is restricted to the terms that items use and its terms are put in order of frequency
(document frequency descending, then by term), so documents share leading terms: as paths of a
trie they form an FP-tree. Single-child steps are merged, and neighbouring small subtrees under one
node make one leaf. Every node keeps the largest tf of each term and the smallest ``m`` below it;
the score is monotone in both, so they bound every score in the subtree. Each item searches the tree
depth first, the most promising child first, and leaves out subtrees whose bound is under its tenth
best score so far. At leaves, documents are scored exactly.

Scale: one pass over the texts writes the restricted vectors (a bitmap of at most 2 MB tells which
terms to keep; terms that pass by chance are dropped exactly later), and aggregates give ``N``, ``L``
and document frequencies. Trees are built of at most 4,096 documents at a time, in the task that
reads the vectors, so nothing is shuffled but ten documents per item and task. The items are a
stated query set: they visit all documents in blocks of a bounded number of terms. Identical
vectors end in one leaf, whatever their number; a lost task is repeated from the written vectors.

Defined cases: null or term-free text: no document of the ranking, and not counted in ``N``; null
ids rank last among equal scores; repeated rows are documents of their own; benchmark rows of equal
id and text are one item, items of equal id and different text rank on their own; an item without
terms, or with terms that no document has, gives no rows; empty tables give no rows; other columns
are ignored. A term that stands in every document may weigh 0 and then adds nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesync.functions.sizing import broadcast_if_small
from tablesync.llm.common import map_texts
from tablesync.llm.decontaminate import bitmap, words
from tablesync.workspace import written

#: Documents of an item's answer.
TOP = 10

#: Documents of a tree at most, documents of a leaf that is not split further, terms of a block of items (about).
TREE_DOCS, LEAF_DOCS, BLOCK_TERMS = 4_096, 16, 8_192

#: The id that stands for null inside a task; nulls rank last among equal scores.
_NO_ID = np.iinfo(np.int64).max


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for item, key, text in zip(*(batch.column(c).to_pylist() for c in ("item_id", "item", "text")), strict=True):
            found = Counter(words(text.encode("utf-8")))
            rows += [(item, key, t.decode("utf-8"), n, xxhash.xxh3_64_intdigest(t)) for t, n in found.items()]
        item, key, term, n, seed = zip(*rows, strict=True) if rows else ((),) * 5
        columns = [pa.array(item, pa.int64()), pa.array(key, pa.int64()), pa.array(term, pa.string()), pa.array(n, pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(seed, np.uint64).view(np.int64))], ["item_id", "item", "term", "qtf", "seed"])


def item_terms(benchmark: DataFrame) -> DataFrame:
    """``item_id``, ``item`` (key of id and text), ``term``, ``qtf`` (repeats) and ``seed`` (hash) of every term of every item."""
    key = F.xxhash64(F.col("item_id").cast("string"), F.col("item_id").isNull(), F.col("text"))
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), key.alias("item"), "text")
    return map_texts(items.distinct(), _item_terms, "item_id long, item long, term string, qtf long, seed long")


def _vectors(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = len(bits) * 64 - 1
        known = bits.tolist()
        for batch in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for text in batch.column("text").cast(pa.binary()):
                counts = Counter(words(text.as_py()))
                sizes.append(counts.total())
                for term, tf in counts.items():
                    at = xxhash.xxh3_64_intdigest(term) & mask
                    if known[at >> 6] >> (at & 63) & 1:
                        terms.append(term)
                        tfs.append(tf)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return run


def vectors(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id``, ``n`` (terms with repeats), ``terms`` and ``tfs`` (those that items may use) of every document with a term."""
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n long, terms array<string>, tfs array<int>"
    return map_texts(rows, _vectors(bitmap(terms.select("seed").distinct())), schema).where("n > 0")


class Tree:
    """The FP-tree of some documents: nodes are ranges of the documents in path order.

    ``first`` and ``last`` bound a node's children, which have consecutive numbers; a leaf has none.
    """

    def __init__(self, ids: np.ndarray, tfs: np.ndarray, starts: np.ndarray, m: np.ndarray, doc: np.ndarray, n_terms: int):
        """Document ``i`` has the ascending term numbers ``ids[starts[i]:starts[i + 1]]`` with their ``tfs``."""
        raw, n = ids.astype(">u4").tobytes(), len(m)
        order = sorted(range(n), key=lambda i: raw[4 * starts[i] : 4 * starts[i + 1]])
        sizes = np.diff(starts)[order]
        take = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in order]) if n else np.zeros(0, np.int64)
        self.ids, self.tfs, self.m, self.doc = ids[take], tfs[take].astype(np.int64), m[order], doc[order]
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.owner = np.repeat(np.arange(n), sizes)
        shared = np.zeros(n, np.int64)  # leading terms that a document shares with the one before it
        for i in range(1, n):
            a, b = self.ids[self.starts[i - 1] : self.starts[i]], self.ids[self.starts[i] : self.starts[i + 1]]
            k = min(len(a), len(b))
            differ = a[:k] != b[:k]
            shared[i] = differ.argmax() if differ.any() else k
        self._split(shared, sizes)
        self._bound(n_terms)

    def _split(self, shared: np.ndarray, sizes: np.ndarray) -> None:
        self.lo, self.hi, self.first, self.last = [0], [len(self.m)], [0], [0]
        at = 0
        while at < len(self.lo):
            lo, hi = self.lo[at], self.hi[at]
            if hi - lo > LEAF_DOCS:
                within = shared[lo + 1 : hi]
                depth = within.min()
                if depth < sizes[lo:hi].max():  # else all paths are equal
                    cuts = np.concatenate(([lo], lo + 1 + np.flatnonzero(within == depth), [hi]))
                    self.first[at] = len(self.lo)
                    begin = cuts[0]
                    for here, end in zip(cuts[:-1], cuts[1:], strict=True):
                        if end - begin > LEAF_DOCS and here > begin:
                            self._node(begin, here)
                            begin = here
                    self._node(begin, hi)
                    self.last[at] = len(self.lo)
            at += 1

    def _node(self, lo: int, hi: int) -> None:
        self.lo.append(int(lo))
        self.hi.append(int(hi))
        self.first.append(0)
        self.last.append(0)

    def _bound(self, n_terms: int) -> None:
        self.most = np.zeros((len(self.lo), n_terms), np.int32)
        self.least = np.zeros(len(self.lo), np.int64)
        for at in reversed(range(len(self.lo))):  # children have higher numbers
            if self.last[at]:
                self.most[at] = self.most[self.first[at] : self.last[at]].max(axis=0)
                self.least[at] = self.least[self.first[at] : self.last[at]].min()
            else:
                part = slice(self.starts[self.lo[at]], self.starts[self.hi[at]])
                np.maximum.at(self.most[at], self.ids[part], self.tfs[part])
                self.least[at] = self.m[self.lo[at] : self.hi[at]].min()


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a weight is multiplied by; never falls with ``tf``, never rises with ``m``."""
    return 1_000_000_000 * tf.astype(np.int64) // (1_000 * tf.astype(np.int64) + 8 * m)


class Answer:
    """The best documents that an item has met so far."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        self.terms, self.weights = terms, weights
        self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def bar(self) -> int:
        """The least score that can still enter."""
        return int(self.score[-1]) if len(self.score) == TOP else 1

    def take(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate((self.score, score)), np.concatenate((self.doc, doc))
        best = np.lexsort((doc, -score))[:TOP]
        self.score, self.doc = score[best], doc[best]

    def search(self, tree: Tree, place: np.ndarray) -> int:
        """Depth-first branch and bound; ``place`` is a scratch array of -1 per term. Returns the leaves it visited."""
        place[self.terms] = np.arange(len(self.terms))
        stack, leaves = [(0, self._bounds(tree, 0, 1)[0])], 0
        while stack:
            node, bound = stack.pop()
            if bound < self.bar:
                continue
            first, last = tree.first[node], tree.last[node]
            if last:
                bounds = self._bounds(tree, first, last)
                for child in np.argsort(bounds):  # the highest bound is popped first
                    if bounds[child] >= self.bar:
                        stack.append((first + int(child), bounds[child]))
                continue
            leaves += 1
            lo, hi = tree.lo[node], tree.hi[node]
            part = slice(tree.starts[lo], tree.starts[hi])
            spot = place[tree.ids[part]]
            hit = np.flatnonzero(spot >= 0)
            owner = tree.owner[part][hit]
            score = np.zeros(hi - lo, np.int64)
            np.add.at(score, owner - lo, self.weights[spot[hit]] * gain(tree.tfs[part][hit], tree.m[owner]))
            enter = np.flatnonzero(score >= self.bar)
            if len(enter):
                self.take(score[enter], tree.doc[lo + enter])
        place[self.terms] = -1
        return leaves

    def _bounds(self, tree: Tree, first: int, last: int) -> np.ndarray:
        most, least = tree.most[first:last, self.terms], tree.least[first:last, None]
        return (self.weights * gain(most, least)).sum(axis=1)


def _trees(batches: Iterator[pa.RecordBatch], vocabulary: pa.Array, n_docs: int, n_terms: int) -> Iterator[Tree]:
    held: list[pa.Table] = []

    def tree() -> Iterator[Tree]:
        table = pa.concat_tables(held).combine_chunks()
        held.clear()
        terms, tfs = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
        doc = np.repeat(np.arange(len(table)), pc.list_value_length(terms).to_numpy())
        number = pc.fill_null(pc.index_in(terms.flatten(), value_set=vocabulary), -1).to_numpy()
        keep = np.flatnonzero(number >= 0)
        keep = keep[np.lexsort((number[keep], doc[keep]))]
        used, sizes = np.unique(doc[keep], return_counts=True)
        if len(used):
            n = table.column("n").to_numpy()[used]
            m = np.array([25 + 75 * int(x) * n_docs // n_terms for x in n], np.int64)  # products may pass 64 bits
            ids = pc.fill_null(table.column("doc_id"), _NO_ID).to_numpy()[used]
            starts = np.concatenate(([0], np.cumsum(sizes)))
            yield Tree(number[keep], tfs.flatten().to_numpy()[keep], starts, m, ids, len(vocabulary))

    for batch in batches:
        for at in range(0, len(batch), TREE_DOCS):
            part = pa.Table.from_batches([batch.slice(at, TREE_DOCS)])
            if held and sum(map(len, held)) + len(part) > TREE_DOCS:
                yield from tree()
            held.append(part)
    if held:
        yield from tree()


def _searching(items: list[tuple], terms: list[str], n_docs: int, n_terms: int):
    """``items``: id, key, term numbers and weights (repeats counted) of a block; ``terms``: its terms in order of frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = [Answer(np.array(t, np.int64), np.array(w, np.int64)) for _, _, t, w in items]
        place = np.full(len(terms), -1, np.int64)
        for tree in _trees(batches, pa.array(terms, pa.string()), n_docs, n_terms):
            for answer in answers:
                answer.search(tree, place)
        for (item_id, key, _, _), answer in zip(items, answers, strict=True):
            if n := len(answer.doc):
                doc = pa.array(answer.doc, mask=answer.doc == _NO_ID)
                columns = [pa.array([item_id] * n, pa.int64()), pa.array([key] * n, pa.int64()), doc, pa.array(answer.score)]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "item", "doc_id", "score"])

    return run


_FOUND = "item_id long, item long, doc_id long, score long"


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The best documents of every item: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``."""
    spark = docs.sparkSession
    asked = written(item_terms(benchmark), "item-terms")
    found = written(vectors(docs, asked), "term-vectors")
    n_docs, n_terms = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    held = held.join(broadcast_if_small(asked.select("term").distinct()), "term", "left_semi")
    blocks = max(1, math.ceil(asked.count() / BLOCK_TERMS))
    weighed = asked.join(held, "term").withColumn("block", F.pmod("item", F.lit(blocks)))
    weighed = written(weighed.select("block", "item_id", "item", "term", "qtf", "df"), "item-weights")
    parts = []
    for block in range(blocks):
        rows = weighed.where(F.col("block") == block).collect()  # about BLOCK_TERMS rows
        order = {t: i for i, (_, t) in enumerate(sorted({(-r.df, r.term) for r in rows}))}
        items: dict[int, tuple] = {}
        for r in rows:
            weight = r.qtf * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
            _, _, terms, weights = items.setdefault(r.item, (r.item_id, r.item, [], []))
            terms.append(order[r.term])
            weights.append(weight)
        if items:
            parts.append(map_texts(found, _searching(list(items.values()), list(order), n_docs, n_terms), _FOUND))
    best = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], _FOUND)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", place.cast("int")).where(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score")


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS t FROM documents),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(t) AS term FROM doc) GROUP BY ALL),
size AS (SELECT r, doc_id, sum(tf) AS n FROM tf GROUP BY ALL),
total AS (SELECT count(*) AS nd, sum(n) AS l FROM size),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT k, item_id, term, count(*) AS q FROM
            (SELECT row_number() OVER () AS k, item_id, unnest({_WORDS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
weight AS (SELECT a.*, CAST(floor(1000 * ln((2 * nd + 2) / CAST(2 * df + 1 AS DOUBLE))) AS HUGEINT) AS w FROM asked a JOIN df USING (term), total),
scored AS (SELECT k, item_id, t.doc_id, t.r,
             CAST(sum(q * w * ((1000000000 * CAST(tf AS HUGEINT)) // (1000 * tf + 8 * (25 + (75 * n * nd) // l)))) AS BIGINT) AS score
           FROM weight JOIN tf t USING (term) JOIN size s ON s.r = t.r, total GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= {TOP}
"""
