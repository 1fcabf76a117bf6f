"""License scans by an exact set-similarity join (operator 1, DataFrame functions only).

Templates of license notices are sets of words; so are the blocks of a text: its sentences, which may run
over several lines, as notices are wrapped. A block meets a template if it contains at least 80 % of the
template's words. The join finds all such blocks exactly:

* words are ordered by how many documents of the whole table have them, rarest first;
* prefix filter: a block that meets a template has one of the ``n - ceil(0.8 n) + 1`` rarest of its
  ``n`` words, so only blocks with a word of some template's prefix are looked at;
* length filter: the block has at least ``ceil(0.8 n)`` words of the templates' vocabulary;
* positional filter: the first common word, at its places in both orders, leaves enough words after it;
* what remains is verified on the whole sets.

A set knows no order and no kin, so two exact checks follow. The words that tell a license from its relatives
(``nc``, ``sa``, ``lesser``, version numbers) must be in the block. And of the template's neighbouring
words at least 60 % must be neighbours in the block, in their order: with a fifth of the words missing, two
pairs are broken by each. A text has the labels of all templates that any of its blocks meets.

Beside it, three fixed phrases are found wherever their words stand one after the other.

Scale: texts are read twice, to count the vocabulary's words (and find the phrases) and to join; only
(template, block) matches are shuffled, to their document. The template index is a fixed list of a few
hundred rows, so it is broadcast.

Defined cases: null or empty text: no words, no labels, score 0; words that are equally frequent go
by code point; repeated rows (same id and text) get the same result, each; a text without full stops is
one block, however long; empty table: no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import TERM, row_key
from tablesync.workspace import written

#: Phrases and the labels they give.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Sentences of customary license notices, the labels they give, and the words (joined by +: neighbours) without which they are another license.
TEMPLATES = (
    ("released under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", "granted"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit", "permission"),
    ("licensed under the apache license version 2 0", "apache-2", "apache 2"),
    ("you may not use this file except in compliance with the license", "apache-2", "compliance"),
    ("licensed under cc by 4 0", "cc-by", "cc by+4"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "cc sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd", "cc nd"),
    ("licensed under a creative commons attribution noncommercial license", "cc-by-nc", "commons noncommercial"),
    ("licensed under a creative commons attribution sharealike license", "cc-by-sa", "commons sharealike"),
    ("licensed under the gnu general public license version 2", "gpl-2", "gnu 2"),
    ("licensed under the gnu general public license version 3", "gpl-3", "gnu 3"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl", "gnu redistribute"),
    ("licensed under the gnu lesser general public license", "lgpl", "gnu lesser"),
    ("licensed under the gnu affero general public license", "agpl", "gnu affero"),
    ("licensed under the mozilla public license version 2 0", "mpl-2", "mozilla 2"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", "mozilla 2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "redistribution binary"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd", "redistributions"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", "fee"),
    ("released into the public domain", "public-domain", "public domain"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered"),
    ("has waived all copyright and related or neighboring rights to this work", "cc0", "waived"),
    ("all rights reserved", "all-rights-reserved", "all rights reserved"),
    ("unauthorized copying of this file via any medium is strictly prohibited", "proprietary", "unauthorized prohibited"),
)

#: Share of a template's words that a block must contain; of its neighbouring pairs.
CONTAINMENT, PAIRED = 0.8, 0.6

#: What ends a sentence; a version number goes on.
SENTENCE = "[.!?]+[ \t]+"

#: The one character beyond ASCII whose lower case is an ASCII letter.
_KELVIN = "\u212a"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _lowered(text: Column) -> Column:
    """Lower case, with A-Z the only characters that become ASCII letters."""
    return F.lower(F.replace(text, F.lit(_KELVIN), F.lit("\u00ff")))


def _cut(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(f"({TERM})"), F.lit(1))


def _may_meet(vocabulary: Column, rows: list[tuple]) -> Column:
    """Can a text with these words of the templates hold a block that meets one? Its words bound those of its blocks."""
    tests = {t: (all_, need, must) for _, _, t, _, _, need, all_, must, *_ in rows}
    return reduce(or_, [
        (F.size(F.array_intersect(vocabulary, _literal(all_))) >= need) & (F.size(F.array_intersect(vocabulary, _literal(must))) == len(must))
        for all_, need, must in tests.values()
    ])


def _blocks(docs: DataFrame, order: list[str], rows: list[tuple]) -> DataFrame:
    """``row``, ``no``, ``cut`` (all words) and ``words`` (distinct, of ``order``, in that order) of every sentence with a prefix word.

    The same set filter looks at whole texts first: most of them have too few words of any template, and are not cut into sentences.
    """
    seeds = _literal(sorted({r[0] for r in rows}))
    texts = docs.where("text is not null").select(row_key(docs).alias("row"), F.translate(_lowered(F.col("text")), "\n", " ").alias("text"))
    known = F.array_intersect(_literal(order), _cut(F.col("text")))
    # the running number keeps the optimizer from computing the words once for every test of them
    texts = texts.select("row", "text", known.alias("known"), F.monotonically_increasing_id().alias("one"))
    texts = texts.where(F.arrays_overlap("known", seeds)).where(_may_meet(F.col("known"), rows))
    blocks = texts.select("row", F.posexplode(F.split("text", SENTENCE)).alias("no", "block")).select("row", "no", _cut(F.col("block")).alias("cut"))
    blocks = blocks.withColumn("words", F.array_intersect(_literal(order), F.col("cut")))
    return blocks.where(F.arrays_overlap("words", seeds))


def _pairs(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _must(text: str) -> tuple[list[str], list[str]]:
    """Single words, and pairs of neighbours."""
    return [w for w in text.split() if "+" not in w], [w.replace("+", " ") for w in text.split() if "+" in w]


def _all_words(templates) -> list[str]:
    return sorted({w for text, *_ in templates for w in text.split()})


def vocabulary(base: DataFrame, templates=TEMPLATES) -> list[str]:
    """All words of the templates, rarest first; ``base`` has the ``vocabulary`` of every document."""
    counts = base.select(F.explode("vocabulary").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    n = dict(counts.collect())  # one row per word of the templates
    return sorted(_all_words(templates), key=lambda w: (n.get(w, 0), w))


def index(order: list[str], templates=TEMPLATES, containment: float = CONTAINMENT) -> list[tuple]:
    """The prefix words of every template: word, place (in the template), template, label, size, need, all words, and what the checks need."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for t, (text, label, must) in enumerate(templates):
        words, pairs = sorted(set(text.split()), key=rank.__getitem__), _pairs(text.split())
        need = math.ceil(containment * len(words) - 1e-9)
        checks = (*_must(must), pairs, math.ceil(PAIRED * len(pairs) - 1e-9))
        rows += [(w, i, t, label, len(words), need, words, *checks) for i, w in enumerate(words[: len(words) - need + 1])]
    return rows


_INDEX = "word string, at int, t int, label string, size int, need int, all array<string>, must array<string>, must_pairs array<string>, pairs array<string>, need_pairs int"


def matches(docs: DataFrame, order: list[str], templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Every block that meets a template: ``row`` (row key), ``no`` (of the block, from 0), ``t``, ``label``, ``share``."""
    rows = index(order, templates, containment)
    prefixes = docs.sparkSession.createDataFrame(rows, _INDEX)
    first = _blocks(docs, order, rows).select("row", "no", "cut", "words", F.posexplode("words").alias("place", "word"))
    met = first.join(F.broadcast(prefixes), "word")
    long = F.size("words") >= F.col("need")
    after = F.least(F.size("words") - F.col("place"), F.col("size") - F.col("at")) >= F.col("need")
    earliest = F.col("word") == F.element_at(F.array_intersect("words", "all"), 1)
    met = met.where(long & after & earliest & (F.size(F.array_except("must", "words")) == 0))
    met = met.withColumn("common", F.size(F.array_intersect("words", "all"))).where("common >= need")
    both = F.zip_with(F.slice("cut", 1, F.size("cut") - 1), F.slice("cut", 2, F.size("cut") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    met = met.withColumn("both", both).where(F.size(F.array_except("must_pairs", "both")) == 0)
    met = met.where(F.size(F.array_intersect("both", "pairs")) >= F.col("need_pairs"))
    return met.select("row", "no", "t", "label", (F.col("common") / F.col("size")).alias("share"))


def _places(words: Column, phrase: str) -> Column:
    """Where, in an array of lower-case words, a phrase starts."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        hit = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            hit = hit & (F.get(words, i + k) == part)
        return hit

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.coalesce(here(i), F.lit(False)))


def phrases(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Words, places of the fixed phrases, their labels and the templates' words (``vocabulary``), per document with its row key."""
    text = _lowered(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(docs).alias("row"), _cut(text).alias("words"))
    known = F.array_intersect(_literal(sorted({*_all_words(templates), *" ".join(p for p, _ in PHRASES).split()})), F.col("words"))
    rows = rows.select("doc_id", "row", F.size("words").cast("long").alias("n_words"), known.alias("known"), "words")
    none = F.array().cast("array<int>")
    at = [
        F.when(F.size(F.array_except(_literal(p.split()), F.col("known"))) == 0, _places(F.col("words"), p)).otherwise(none).alias(f"p{i}")
        for i, (p, _) in enumerate(PHRASES)
    ]
    rows = rows.select("doc_id", "row", "n_words", F.array_intersect("known", _literal(_all_words(templates))).alias("vocabulary"), *at)
    every = F.concat(*[F.col(f"p{i}") for i in range(len(PHRASES))])
    labels = F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)])
    return rows.select(
        "doc_id", "row", "n_words", "vocabulary",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(labels))).alias("base"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: words, places of the fixed phrases, labels, score (the best containment; 1 for a phrase)."""
    base = written(phrases(docs), "phrases")
    found = matches(docs, vocabulary(base)).groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max("share").alias("share"), F.count_distinct("no").alias("n_blocks")
    )
    rows = base.join(found, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        score.alias("score"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )


_TEMPLATE_ROWS = ", ".join(
    f"({t}, '{label}', string_split('{text}', ' '), CAST({_must(must)[0]} AS VARCHAR[]), CAST({_must(must)[1]} AS VARCHAR[]))"
    for t, (text, label, must) in enumerate(TEMPLATES)
)
_PHRASE_ROWS = ", ".join(f"('{label}', string_split('{text}', ' '))" for text, label in PHRASES)

SQL = f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
low AS (SELECT DISTINCT doc_id, text, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM doc),
phrase(label, parts) AS (VALUES {_PHRASE_ROWS}),
places AS (
  SELECT l.doc_id, l.text, p.label, unnest(list_filter(range(len(l.words)), lambda i: l.words[i + 1 : i + len(p.parts)] = p.parts)) AS spot
  FROM low l, phrase p WHERE list_contains(l.words, p.parts[1])),
base AS (SELECT doc_id, text, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list_sort(list(DISTINCT label)) AS base
         FROM places GROUP BY ALL),
template0(t, label, words, must, must_pairs) AS (VALUES {_TEMPLATE_ROWS}),
template AS (SELECT *, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS pairs FROM template0),
lines AS (SELECT doc_id, text, unnest(regexp_split_to_array(replace(text, chr(10), ' '), '{SENTENCE}')) AS s,
            generate_subscripts(regexp_split_to_array(replace(text, chr(10), ' '), '{SENTENCE}'), 1) AS no FROM (SELECT DISTINCT doc_id, text FROM doc)),
sets AS (SELECT doc_id, text, no, regexp_extract_all(translate(s, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM lines),
met AS (
  SELECT * FROM (
    SELECT s.doc_id, s.text, s.no, s.words, t.label, t.pairs, t.must_pairs, len(list_intersect(list_distinct(t.words), s.words)) AS common, len(list_distinct(t.words)) AS size
    FROM sets s, template t WHERE list_has_all(s.words, t.must))
  WHERE common >= ceil({CONTAINMENT} * size - 1e-9)
    AND list_has_all(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]), must_pairs)
    AND len(list_intersect(pairs, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) >= ceil({PAIRED} * len(pairs) - 1e-9)),
more AS (SELECT doc_id, text, list(DISTINCT label) AS more, max(common / CAST(size AS DOUBLE)) AS share, count(DISTINCT no) AS n_blocks FROM met GROUP BY ALL)
SELECT d.doc_id, CAST(len(l.words) AS BIGINT) AS n_words, CAST(coalesce(b.n_base, 0) AS BIGINT) AS n_base, b.first_word, b.last_word,
       coalesce(array_to_string(b.base, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.base, []), coalesce(m.more, [])))), ','), '') AS labels,
       CASE WHEN coalesce(b.n_base, 0) > 0 THEN 1.0 ELSE coalesce(m.share, 0.0) END::DOUBLE AS score,
       CAST(coalesce(m.n_blocks, 0) AS BIGINT) AS n_blocks
FROM doc d
JOIN low l ON l.doc_id IS NOT DISTINCT FROM d.doc_id AND l.text = d.text
LEFT JOIN base b ON b.doc_id IS NOT DISTINCT FROM d.doc_id AND b.text = d.text
LEFT JOIN more m ON m.doc_id IS NOT DISTINCT FROM d.doc_id AND m.text = d.text
"""
