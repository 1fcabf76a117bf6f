"""The line stage of the pipeline: passages that copies, short documents or their own hash protected."""

import hashlib
import random

import pytest

import corpus_pipeline
from tablesync.llm import linededup

PASSAGE = " ".join(f"passage{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))


def word(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))


def own(rng, lines=4, words=20):
    return [" ".join(word(rng) for _ in range(words)) for _ in range(lines)]


@pytest.fixture
def stage(spark, small):
    def run(texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        out = dict(corpus_pipeline.STAGES)["lines"](spark, docs, small)
        return [r.text for r in out.orderBy("doc_id").collect()]

    return run


def test_a_group_of_copies_does_not_protect_a_passage(stage):
    """20 unrelated documents hold the passage, and 100 edited copies of one text."""
    rng = random.Random(1)
    unrelated = [own(rng) for _ in range(20)]
    base = own(rng, 10)
    copies = []
    for _ in range(100):
        lines = list(base)
        lines[rng.randrange(10)] += " " + word(rng)
        copies.append(lines)
    got = stage(["\n".join([*x, PASSAGE]) for x in unrelated + copies])
    assert got == ["\n".join(x) for x in unrelated + copies]


def test_a_short_document_loses_the_passage(stage):
    rng = random.Random(2)
    texts = [own(rng, 1, 12) for _ in range(8)]
    assert stage(["\n".join([*x, PASSAGE]) for x in texts]) == ["\n".join(x) for x in texts]


def test_a_passage_of_least_hash_goes(stage):
    """The passage's leading tokens have a lesser hash than any other line, so it was the kind of all its documents."""
    rng, lead = random.Random(3), lambda line: hashlib.md5(" ".join(line.split()[:4]).encode()).hexdigest()
    texts = [own(rng, 5) for _ in range(12)]
    passage = min((" ".join(word(rng) for _ in range(8)) for _ in range(5000)), key=lead)
    assert all(lead(passage) < lead(line) for x in texts for line in x)
    assert stage(["\n".join([*x, passage]) for x in texts]) == ["\n".join(x) for x in texts]


def test_copies_are_not_emptied(stage):
    rng = random.Random(4)
    base = own(rng, 10)
    texts = ["\n".join([*base[:k], base[k] + " " + word(rng), *base[k + 1 :]]) for k in range(10)]
    assert stage(texts) == texts


def test_a_line_goes_from_all_two_line_documents(stage):
    """The line is most of every document that holds it."""
    rng = random.Random(5)
    line, texts = " ".join(word(rng) for _ in range(13)), [own(rng, 1, 12) for _ in range(50)]
    assert stage(["\n".join([*x, line]) for x in texts]) == ["\n".join(x) for x in texts]


def test_short_lines_need_more_documents(stage):
    """A line of four tokens goes from 60 documents; one that stands in ten may do so by chance; blank lines stay."""
    rng = random.Random(6)
    texts = [[*own(rng, 2), "", *own(rng, 1)] for _ in range(60)]
    docs = [[*x, "All rights reserved here."] + ["Chapter the third begins"] * (i < 10) for i, x in enumerate(texts)]
    assert stage(["\n".join(x) for x in docs]) == ["\n".join(x + ["Chapter the third begins"] * (i < 10)) for i, x in enumerate(texts)]


def test_a_large_group_of_edited_copies_keeps_its_lines(stage):
    """Edits at the leading tokens of lines, where the tree looks first."""
    rng = random.Random(7)
    base, texts = own(rng, 12), []
    for _ in range(400):
        lines = [x.split() for x in base]
        for _ in range(3):
            lines[rng.randrange(12)][rng.randrange(4)] = word(rng)
        texts.append("\n".join(" ".join(x) for x in lines))
    assert stage(texts) == texts


def test_ties_of_template_tokens(spark, over):
    """Of equally frequent tokens the last in code point order enters the template, in Spark and in SQL."""
    rng = random.Random(9)
    texts = ["\n".join([*own(rng, 3), f"same four leading tokens then {'abéz'[i % 4]} {'x' if i % 2 else 'y'} end of line"]) for i in range(16)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = over(linededup.SQL, documents=docs)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in linededup.dedupe_lines(docs).collect()}
    assert got == {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in want.itertuples(index=False)}
    assert sum(n for _, n, _ in got.values()) == 16
