"""Phrase collocation mining by vertical partitioning of suffixes (operator 12).

Every word of a piece begins a suffix of four words at most. The suffixes of a language form a tree
in which a phrase's count is the sum of the leaves below it. The tree is never built as a whole: its
word prefixes are counted first (vertical partitioning), those of two words that occur often enough
are grouped by a memory budget, and the depth-truncated subtree of every group is built on its own,
by sorting its suffixes; totals of its leaves are the counts of phrases of three and four words.
Every part of a phrase occurs at least as often as the phrase, so a suffix ends where two
neighbouring words are too rare together, and nothing is lost.

A phrase is scored by its weakest cut: ``floor(2000000 * a / (l + r))`` with the counts of the whole
and of both parts. Phrases that a longer one mostly explains are dropped, and each language's best
2,000 are returned.

Scale: a task sums up equal prefixes and suffixes of some megabytes of text before they leave it, as
compressed columns in one row per group. Prefixes are dealt by a hash of the whole prefix, so a frequent word
or pair is no hot group. Two-word prefixes above the budget (at most 10,000 by construction) are
extended: their suffixes are dealt by all their words, and partial totals of the shared nodes are
added up after. So a group holds about the budget, whatever the corpus. A bitmap of at most 2 MB
tells which pairs to follow; what passes by chance is counted too and dropped by its exact count.
Cuts and containment are joins of the counted phrases. A language is ranked in 64 parts first, each of which
passes 2,000 rows on, so the last ranking of a language sees 128,000 rows at most.

Defined cases: null or empty text: no words; null language: ``und``, as a language of that name;
repeated rows and null ids count like any row; ties rank by count, then by the phrase's bytes;
a language without candidates, and empty tables, give no rows; other columns are ignored; very long
texts are cut into parts only between pieces, where no phrase stands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesync.llm.common import map_texts
from tablesync.llm.decontaminate import bitmap
from tablesync.workspace import written

#: Words of a phrase at most, its fewest occurrences, the share (in percent) of them that a longer phrase explains.
WORDS, LEAST, EXPLAINED = 4, 30, 80

#: Rows of a language in the result; parts of a language that are ranked by themselves first.
BEST, RANKED = 2_000, 64

#: Bytes of text whose prefixes a group counts, suffixes whose subtrees a group builds (about), prefixes that are extended at most.
GROUP_BYTES, GROUP_SUFFIXES, EXTENDED = 1 << 23, 1 << 20, 10_000

#: Bytes of text that a task sums up at once.
HELD_BYTES = 1 << 22

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def pieces(text: bytes | None) -> list[list[bytes]]:
    """The words of every piece."""
    return [p.split() for p in (text or b"").translate(_PLAIN).split(b"\n")]


def mixed(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A hash of both."""
    out = key * _BASE + more
    out ^= out >> np.uint64(29)
    return out * _BASE


class Held:
    """Some texts as word numbers: ``words`` (their bytes), ``at`` (number per place, -1 ends a piece), ``lang`` (per place)."""

    def __init__(self, texts: list[tuple[str, bytes | None]]):
        self.langs = sorted({lang for lang, _ in texts})
        index = {lang: i for i, lang in enumerate(self.langs)}
        tokens, sizes = [], []
        for _, text in texts:
            before = len(tokens)
            for piece in pieces(text):
                if piece:
                    tokens += piece
                    tokens.append(None)
            sizes.append(len(tokens) - before)
        at, words = pd.factorize(np.array([*tokens, None], object)[:-1])
        self.at, self.words = at.astype(np.int64), list(words)
        self.lang = np.repeat([index[lang] for lang, _ in texts], sizes).astype(np.int64)
        self.hash = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        self.seed = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in self.langs), np.uint64, len(self.langs))

    def after(self, k: int) -> np.ndarray:
        """What stands ``k`` places on; -1 after the last place."""
        return np.concatenate((self.at[k:], np.full(min(k, len(self.at)), -1, np.int64)))

    def key(self, lang: np.ndarray, *numbers: np.ndarray) -> np.ndarray:
        """A hash of the language and the words of these numbers (-1: none)."""
        out = self.seed[lang]
        for number in numbers:
            out = np.where(number < 0, out, mixed(out, self.hash[number]))
        return out

    def column(self, numbers: np.ndarray) -> pa.Array:
        """The words of these numbers; null for -1."""
        words = pa.array([*self.words, None], pa.binary()).cast(pa.string())
        return words.take(pa.array(np.where(numbers < 0, len(self.words), numbers)))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the pair that begins at each place, and whether one does."""
        second = self.after(1)
        return self.key(self.lang, self.at, second), (self.at >= 0) & (second >= 0)


def _equal(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the distinct rows stand first, and how often each occurs; -1 is a value."""
    code = np.zeros(len(columns[0]), np.int64)
    for column in columns:  # numbers stay below rows * values
        code = np.unique(code, return_inverse=True)[1] * (int(column.max(initial=0)) + 2) + column + 1
    _, first, count = np.unique(code, return_index=True, return_counts=True)
    return first, count


#: A group's rows of a task: columns ``lang``, ``w1`` and on, ``n``, as one compressed Arrow stream.
_GROUPED = "grp int, payload binary"


def _rows(held: Held, group: np.ndarray, lang: np.ndarray, numbers: list[np.ndarray], count: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per group, which holds the group's rows in order."""
    order = np.lexsort((*numbers[::-1], lang, group))
    group, lang, numbers = group[order], lang[order], [x[order] for x in numbers]
    columns = [pa.array(held.langs, pa.string()).take(pa.array(lang)), *map(held.column, numbers)]
    columns += [pa.nulls(len(group), pa.string())] * (WORDS - len(numbers)) + [pa.array(count[order], pa.int64())]
    whole = pa.RecordBatch.from_arrays(columns, _COLUMNS)
    cuts = np.flatnonzero(np.diff(group, prepend=-2))
    for at in range(0, len(cuts), _PAYLOADS):
        some = cuts[at : at + _PAYLOADS + 1]
        ends = [*some[1:], *[len(group)] * (len(some) <= _PAYLOADS)]
        payloads = []
        for begin, end in zip(some, ends, strict=False):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(whole.slice(begin, end - begin))
            payloads.append(out.getvalue().to_pybytes())
        numbers_ = pa.array(group[some[: len(payloads)]], pa.int32())
        yield pa.RecordBatch.from_arrays([numbers_, pa.array(payloads, pa.binary())], ["grp", "payload"])


_COLUMNS = ["lang", *(f"w{i}" for i in range(1, WORDS + 1)), "n"]

#: Payloads of a batch.
_PAYLOADS = 64


def _parts(lang: str, text: bytes) -> Iterator[tuple[str, bytes]]:
    """A very long text in parts that end between pieces; one piece is never cut."""
    while len(text) > HELD_BYTES:
        cut = max(text.rfind(c, 0, HELD_BYTES) for c in (b"\n", b".", b",", b"!", b"?", b";", b":"))
        cut = cut if cut >= 0 else min((at for c in b"\n.,!?;:" if (at := text.find(bytes([c]), HELD_BYTES)) >= 0), default=len(text) - 1)
        yield lang, text[: cut + 1]
        text = text[cut + 1 :]
    yield lang, text


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[Held]:
    texts, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            for part in _parts(lang, text.as_py() or b""):
                texts.append(part)
                size += len(part[1])
                if size >= HELD_BYTES:
                    yield Held(texts)
                    texts, size = [], 0
    if texts:
        yield Held(texts)


def _prefixes(groups: int):
    """Prefixes of one and two words with their counts, dealt by a hash of the prefix; group -1: words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _holding(batches):
            begins = np.flatnonzero(held.at >= 0)
            lang, one, two = held.lang[begins], held.at[begins], held.after(1)[begins]
            first, count = _equal(lang)
            yield from _rows(held, np.full(len(first), -1), lang[first], [], count)
            for columns in ((lang, one), (lang[two >= 0], one[two >= 0], two[two >= 0])):
                first, count = _equal(*columns)
                own, *numbers = (x[first] for x in columns)
                group = (held.key(own, *numbers) % np.uint64(groups)).astype(np.int64)
                yield from _rows(held, group, own, numbers, count)

    return run


def _suffixes(bits: np.ndarray, groups: int, extended: dict[int, int]):
    """Suffixes of three and four words, as far as their pairs pass ``bits``, dealt by their first two words.

    ``extended``: the number of groups over which suffixes of a prefix are dealt by all their words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = np.uint64(len(bits) * 64 - 1)
        hot = np.array(sorted(extended), np.uint64)
        spread = np.array([extended[x] for x in sorted(extended)], np.uint64)
        for held in _holding(batches):
            pairs, there = held.pairs()
            at = pairs & limit
            often = there & ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
            more = np.concatenate((often, np.zeros(WORDS, bool)))
            begins = np.flatnonzero(often & more[1 : len(often) + 1])
            fourth = np.where(more[begins + 2], held.after(3)[begins], -1)
            columns = [held.lang[begins], held.at[begins], held.after(1)[begins], held.after(2)[begins], fourth]
            first, count = _equal(*columns)
            lang, *numbers = (x[first] for x in columns)
            prefix = held.key(lang, *numbers[:2])
            group = prefix % np.uint64(groups)
            if len(hot) and len(prefix):
                spot = np.minimum(np.searchsorted(hot, prefix), len(hot) - 1)
                whole = mixed(held.key(lang, *numbers), prefix) % spread[spot]
                group = np.where(hot[spot] == prefix, (prefix + whole) % np.uint64(groups), group)
            yield from _rows(held, group.astype(np.int64), lang, numbers, count)

    return run


def _sorted_totals(columns: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of every distinct row, and its total: leaves side by side after sorting."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= np.diff(x[order]) != 0
    at = np.flatnonzero(new)
    return order[at], np.add.reduceat(n[order], at) if len(at) else n


def _codes(column: pa.Array) -> np.ndarray:
    return pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


_COUNTED = "lang string, k int, phrase string, f long"


def _subtree(depths: tuple[int, ...], least: int):
    """Builds a group's subtree and reads the totals at ``depths``; below ``least`` they are left out."""

    def run(table: pa.Table) -> pa.Table:
        first_group = table.column("grp")[0].as_py()
        held = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("payload")]
        table = pa.concat_tables(held).combine_chunks()
        n = table.column("n").to_numpy()
        langs = table.column("lang").combine_chunks().dictionary_encode()
        lang = langs.indices.to_numpy().astype(np.int64)
        words = [table.column(f"w{i}").combine_chunks() for i in range(1, WORDS + 1)]
        codes = [_codes(w) for w in words[: max(depths)]]
        parts = []
        if first_group < 0:
            first, total = _sorted_totals([lang], n)
            parts.append([langs.dictionary.take(pa.array(lang[first])), pa.array([0] * len(first), pa.int32()), pa.array([""] * len(first)), pa.array(total)])
            depths_here: tuple[int, ...] = ()
        else:
            depths_here = depths
        for k in depths_here:
            ends = pc.is_valid(words[k - 1]).to_numpy(zero_copy_only=False)
            if k == 1:  # a prefix of one word is a row of its own; those of two are no leaves below it
                ends &= pc.is_null(words[1]).to_numpy(zero_copy_only=False)
            own = np.flatnonzero(ends)
            first, total = _sorted_totals([lang[own], *(c[own] for c in codes[:k])], n[own])
            often = np.flatnonzero(total >= least)
            at = pa.array(own[first[often]])
            phrase = pc.binary_join_element_wise(*(w.take(at) for w in words[:k]), " ")
            parts.append([langs.dictionary.take(pa.array(lang[at.to_numpy()])), pa.array([k] * len(at), pa.int32()), phrase, pa.array(total[often])])
        names = ["lang", "k", "phrase", "f"]
        whole = [pa.chunked_array([p[i] for p in parts], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))]
        return pa.Table.from_arrays(whole, names)

    return run


def _pair_key(lang: str, phrase: str) -> int:
    key = np.array([xxhash.xxh3_64_intdigest(lang)], np.uint64)
    for word in phrase.encode("utf-8").split(b" "):
        key = mixed(key, np.array([xxhash.xxh3_64_intdigest(word)], np.uint64))
    return int(key[0])


def _pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_pair_key(a, b) for a, b in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)]
        found = pa.array(np.array(keys, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([found, batch.column("f")], ["seed", "f"])


def counted(docs: DataFrame, least: int = LEAST, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """``lang``, ``k`` (words), ``phrase``, ``f`` of every phrase of one to four words with ``least`` occurrences.

    Rows of ``k`` 0 hold the number of all words of a language.
    """
    rows = docs.where("text is not null").select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(size / GROUP_BYTES))
    dealt = map_texts(rows, _prefixes(groups), _GROUPED)
    short = written(dealt.groupBy("grp").applyInArrow(_subtree((1, 2), least), _COUNTED), "phrase-prefixes")
    pairs = written(map_texts(short.where("k = 2").select("lang", "phrase", "f"), _pair_keys, "seed long, f long"), "phrase-pairs")
    total = pairs.agg(F.sum("f")).first()[0] or 0
    limit = max(group_suffixes, total // EXTENDED)
    hot = pairs.where(F.col("f") > limit).collect()  # fewer than EXTENDED rows
    extended = {r.seed % (1 << 64): math.ceil(r.f / group_suffixes) for r in hot}
    groups = max(1, math.ceil(total / group_suffixes))
    dealt = map_texts(rows, _suffixes(bitmap(pairs), groups, extended), _GROUPED)
    long = dealt.groupBy("grp").applyInArrow(_subtree((3, 4), 1 if extended else least), _COUNTED)
    long = long.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least) if extended else long
    return short.union(written(long, "phrase-suffixes"))


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of every language's best phrases."""
    found = counted(docs, least)
    words = F.split("phrase", " ")
    phrases = found.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("words"))

    def part(begin, size):
        return F.array_join(F.slice("words", begin, size), " ")

    cuts = phrases.select("lang", "phrase", "a", "k", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    counts = found.where("k between 1 and 3")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("c"))

    inner = phrases.where("k >= 3").select("lang", "words", "k", "a", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("lang", "words", "a", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("begin"))
    inner = inner.groupBy("lang", part(F.col("begin"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = weakest.join(inner, ["lang", "phrase"], "left")
    explained = F.expr(f"cast(longer as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {EXPLAINED}")
    kept = kept.where(F.col("longer").isNull() | ~explained)

    order = (F.desc("c.score"), F.desc("a"), "phrase")
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKED))).orderBy(*order)
    kept = kept.withColumn("place", F.row_number().over(parts)).where(F.col("place") <= best).drop("place")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    sizes = found.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH piece AS (SELECT lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS p
               FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents WHERE text IS NOT NULL)),
words AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM piece),
gram AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
         FROM words, (SELECT unnest(range(1, {WORDS + 1})) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY ALL),
size AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= {LEAST}),
cut AS (SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS tail
        FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
scored AS (SELECT x.lang, x.phrase, x.a, c, l.f AS l, r.f AS r, CAST((CAST(x.a AS HUGEINT) * 2000000) // (l.f + r.f) AS BIGINT) AS score
           FROM cut x JOIN f l ON l.lang = x.lang AND l.phrase = x.head JOIN f r ON r.lang = x.lang AND r.phrase = x.tail),
weak AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (SELECT lang, array_to_string(w[b:b + s - 1], ' ') AS phrase, max(a) AS longer
           FROM (SELECT *, unnest(range(1, k - s + 2)) AS b FROM (SELECT *, unnest(range(2, k)) AS s FROM cand WHERE k >= 3)) GROUP BY ALL),
kept AS (SELECT w.* FROM weak w LEFT JOIN inside i ON i.lang = w.lang AND i.phrase = w.phrase
         WHERE i.longer IS NULL OR CAST(i.longer AS HUGEINT) * 100 < CAST(w.a AS HUGEINT) * {EXPLAINED}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN size USING (lang) WHERE rank <= {BEST}
"""
