"""Language identification by rank-order profiles (operator 7).

A language's profile is the list of its 400 most frequent character n-grams (one to three letters,
words padded by a space) over all learning documents. A document is compared by its own most
frequent n-grams: for each, the distance between the two ranks counts, or 400 if the profile lacks
it. The language of least total distance wins.

Scale: learning counts n-grams per task and adds them up per language and n-gram, so no task sees
more than sums; the profiles (400 rows per language) go to all tasks with the function. Prediction
is one pass without a shuffle. Whole texts are counted, in pieces that end between words, so no
n-gram is lost or made up where a long text is cut.

Defined cases: null text or text without a letter: ``und``, score 0; no learning document: all are
``und``; null id: not held out and not learned from; null language: not learned from; ties between
n-grams go by code point, between languages by name; empty table: no rows; repeated rows are all
returned (and learned from); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesync.llm.common import map_texts, row_key, unused
from tablesync.workspace import written

#: N-grams in a profile, the longest n-gram, bits of a code point in a packed n-gram.
PROFILE, ORDER, BITS = 400, 3, 21

#: Of four folds by ``crc32(id) mod 4``, this one is held out.
FOLDS, HELD = 4, 2

UNKNOWN = "und"

#: Code points that are counted at once (more only where one word is longer); n-grams (of 8 bytes) that wait to be added up.
PIECE, WAITING = 1 << 20, 1 << 21


#: Which code points of the first plane are letters; filled where it is first used.
_FIRST: list[np.ndarray] = []


def is_letter(points: np.ndarray) -> np.ndarray:
    if not _FIRST:
        _FIRST.append(np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16))
    found = _FIRST[0][points & 0xFFFF]
    for at in np.flatnonzero(points >> 16):
        found[at] = chr(points[at]).isalpha()
    return found


def pieces(text: str) -> Iterator[str]:
    """The text in lower case, cut between words only."""
    text, at = text.lower(), 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end > at and text[end - 1].isalpha():
            end -= 1
        if end == at:  # one word fills the piece
            end = at + PIECE
            while end < len(text) and text[end].isalpha():
                end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def grams(text: str) -> np.ndarray:
    """All n-grams of a text in lower case, packed into integers, in no order; empty without a letter."""
    points = np.frombuffer((text + " ").encode("utf-32-le", "replace"), np.uint32)
    letter = is_letter(points)
    if not letter.any():
        return np.empty(0, np.int64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # one space after each word
    run = np.concatenate(([32], np.where(letter, points, 32)[kept])).astype(np.int64)
    two = (run[:-1] << BITS) | run[1:]
    inner = run[1:-1] != 32
    three = ((two[:-1] << BITS) | run[2:])[inner]
    return np.concatenate((run[run != 32], two, three))


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in ascending order, and how often each occurs."""
    parts = [np.unique(grams(piece), return_counts=True) for piece in pieces(text)]
    return parts[0] if len(parts) == 1 else _added(parts)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[str, list[np.ndarray]] = {}
    held = 0

    def flush() -> None:
        for lang, lists in waiting.items():
            new = np.unique(np.concatenate(lists), return_counts=True)
            sums[lang] = _added([sums[lang], new]) if lang in sums else new
        waiting.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for piece in pieces(text.as_py()):
                found = grams(piece)
                waiting.setdefault(lang, []).append(found)
                held += len(found)
                if held > WAITING:
                    flush()
                    held = 0
    flush()
    for lang, (keys, n) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])


def held_out(name: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def profiles(docs: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``rank`` (from 0): the profile of each language, from all learning documents."""
    learn = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = map_texts(learn.select("lang", "text"), _by_language, "lang string, gram long, n long")
    sums = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return sums.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < PROFILE).drop("n")


class Profiles:
    """All profiles as one matrix of ranks: a row per language, a column per n-gram of any profile."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        self.grams = np.unique(np.fromiter((g for _, g, _ in rows), np.int64, len(rows)))
        self.ranks = np.full((len(self.langs), len(self.grams)), PROFILE, np.int32)
        row = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[row[lang], np.searchsorted(self.grams, gram)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and one minus its share of the greatest distance."""
        keys, n = counted(text or "")
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        if len(keys) > PROFILE:
            least = np.partition(n, len(n) - PROFILE)[len(n) - PROFILE]
            often = n >= least
            keys, n = keys[often], n[often]
        top = keys[np.argsort(-n, kind="stable")[:PROFILE]]
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        known = self.grams[at] == top
        ranks = self.ranks[:, at[known]]
        apart = np.where(ranks < PROFILE, np.abs(ranks - np.flatnonzero(known)), PROFILE)
        away = apart.sum(axis=1) + PROFILE * int((~known).sum())
        best = int(away.argmin())
        return self.langs[best], 1.0 - float(away[best]) / (PROFILE * len(top))


def predicted(docs: DataFrame, model: Profiles) -> DataFrame:
    """``doc_id``, ``row`` (the row key), ``lang_pred`` and ``score`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            langs, scores = pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), langs, scores], names)

    names = ["doc_id", "row", "lang_pred", "score"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row"), "text")
    return map_texts(rows, run, "doc_id long, row string, lang_pred string, score double")


def learned(docs: DataFrame) -> Profiles:
    """The profiles, gathered: 400 short rows per language."""
    return Profiles([tuple(r) for r in profiles(docs).collect()])


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``."""
    return predicted(docs, learned(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose text has no letter, so that no language can be told (or none was learned)."""
    (lang,) = unused(docs, "lang_pred")
    rows = written(predicted(docs, learned(docs)).where(F.col("lang_pred") == UNKNOWN).select("row").distinct(), "und")
    (key,) = unused(docs, "row_key")
    kept = docs.withColumn(key, row_key(docs)).join(rows.withColumnRenamed("row", key), key, "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
