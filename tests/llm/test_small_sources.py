"""Small sources of a mix whose blocks hold many words."""

import pytest

from tablesync.llm import mixing


@pytest.fixture
def docs(spark):
    rows = [(i, " ".join(["w"] * 50), "big") for i in range(2_000)]
    rows += [(10_000 + 10 * s + i, " ".join(["w"] * (3 + i)), f"small{s:02d}") for s in range(30) for i in range(s % 5 + 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_small_sources_give_their_targets(docs):
    """100 slots of about 1,000 words: a source of 9 to 75 words has far less than a slot."""
    got = mixing.placed(docs, slots=100).toPandas()
    small = got[got.doc_id >= 10_000]
    block = -(-got["size"].sum() // 100)
    assert block > 1_000
    per = small.groupby(small.doc_id // 10).agg(taken=("taken", "sum"), target=("target", "first"))
    assert (per.taken == per.target.round()).all() and (per.taken > 0).all()
    assert (small.taken <= 3 * small["size"]).all()
    used = small[small.taken > 0].first_slot
    assert used.between(0, 99).all() and used.nunique() > 20  # all over the mix
    big = got[got.doc_id < 10_000]
    assert abs(big.taken.sum() - big.target.iloc[0]) <= 3 * block


def test_large_sources_keep_their_blocks(docs):
    """Nothing changes where every block is one word."""
    got = mixing.placed(docs).toPandas()
    assert got.taken.sum() <= got["size"].sum()
    big = got[got.doc_id < 10_000]
    assert abs(big.taken.sum() - big.target.iloc[0]) <= 20


@pytest.mark.parametrize("slots", [37, 100, 1_000, mixing.SLOTS])
def test_sql_has_the_same_rule_for_small_sources(docs, over, slots):
    got = mixing.placed(docs, slots=slots).drop("row").toPandas().sort_values("doc_id").reset_index(drop=True)
    want = over(mixing.sql(slots), documents=docs).sort_values("doc_id").reset_index(drop=True)
    for name in got.columns:
        assert (got[name] == want[name]).all(), name
    assert len(got) == len(want)
