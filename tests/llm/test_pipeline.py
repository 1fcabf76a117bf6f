"""The pipeline, stage by stage, against plain Python versions."""

from collections import Counter
from zlib import crc32

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tablesync.llm import linededup, mixing
from tests.llm import brute
from tests.llm.test_near_copies import kept


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.fixture(scope="module")
def stages(spark, small, table):
    """The documents before the first stage and after each."""
    out = [table("documents")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(spark.createDataFrame(stage(spark, out[-1], small).toArrow()))
    return out


def test_stages(stages):
    assert [len(s.columns) for s in stages] == [5] * 5 + [8]
    assert all(a.columns == b.columns for a, b in zip(stages[:-2], stages[1:-1], strict=True))


def test_language_stage(stages):
    counts = {}
    for r in stages[0].collect():
        if crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(brute.grams(r.text))
    profiles = {lang: brute.ranked(c) for lang, c in counts.items()}
    want = [tuple(r) for r in stages[0].collect() if brute.language(r.text, profiles)[0] != "und"]
    assert rows(stages[1]) == sorted(want, key=lambda t: tuple((v is None, str(v)) for v in t))


def test_line_stage(stages, over):
    want = over(linededup.SQL, documents=stages[1])
    assert {r.doc_id: r.text for r in stages[2].collect()} == dict(zip(want.doc_id, want.text, strict=True))


def test_near_duplicate_stage(stages):
    assert sorted(r.doc_id for r in stages[3].collect()) == kept([(r.doc_id, r.text) for r in stages[2].collect()])


def test_decontamination_stage(stages, table):
    items = [brute.words(r.text) for r in table("benchmark").collect()]
    want = []
    for r in stages[3].collect():
        a = brute.words(r.text)
        seeds = {tuple(a[k : k + 5]) for k in range(len(a) - 4)}
        near = [b for b in items if any(tuple(b[k : k + 5]) in seeds for k in range(len(b) - 4))]
        if not any(brute.tiled(a, b) >= 0.8 * len(b) for b in near):
            want.append(r.doc_id)
    assert sorted(r.doc_id for r in stages[4].collect()) == sorted(want)


def test_mixing_stage(stages, over):
    want = over(mixing.SQL, documents=stages[4])
    want = {r.doc_id: (r.size, r.taken, r.first_slot) for r in want.itertuples(index=False) if r.taken > 0}
    assert {r.doc_id: (r["size"], r.taken, r.first_slot) for r in stages[5].collect()} == want


def test_run_is_registered_and_agrees(spark, small, stages):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert rows(corpus_pipeline.run(spark, small)) == rows(stages[5])


def test_stages_take_odd_and_no_rows(spark, small, odd, none):
    for docs in (odd, none):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, small).toArrow(), None) if n else stage(spark, docs, small)
            assert docs.count() <= n
