"""Fingerprints against a plain version, and block tables where many fingerprints share blocks."""

import random

import pytest

from tablesync.llm import fingerprints
from tests.llm import brute


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def halves(x):
    return signed(x >> 64), signed(x & (2**64 - 1))


def test_fingerprints_match_a_plain_version(table):
    texts = [r.text or "" for r in table("documents").select("text").collect()] + ["", "one", "two two", "a b a b a b a c", "É é É"]
    for text in sorted(texts, key=len)[:150]:
        assert fingerprints.fingerprint(text) == brute.weighted_simhash(text)


@pytest.mark.parametrize("radius", [3, 2])
@pytest.mark.parametrize("span", [(0, 32), (40, 90), (96, 128)])
def test_shared_blocks_lose_no_pair(spark, radius, span):
    rng = random.Random(7)
    base = rng.getrandbits(128)
    prints = {base}
    while len(prints) < 260:
        x = base
        for bit in rng.sample(range(*span), rng.randint(1, 5)):
            x ^= 1 << bit
        prints.add(x)
    prints |= {rng.getrandbits(128) for _ in range(40)}
    df = spark.createDataFrame([halves(x) for x in prints], "high long, low long")
    shared = {i: len({x >> i & 0xFFFFFFFF for x in prints}) for i in (0, 32, 64, 96)}
    assert min(shared.values()) <= 41  # all of the group in one block
    found = fingerprints.within(df, df, radius).collect()
    want = {(*halves(x), *halves(y)) for x in prints for y in prints if (x ^ y).bit_count() <= radius}
    assert len(found) == len(want) and {(r.high, r.low, r.its_high, r.its_low) for r in found} == want


def test_busy_blocks_are_joined_on_two_blocks(spark):
    """A group that shares one block and little else makes far fewer candidates than pairs."""
    rng = random.Random(3)
    prints = {rng.getrandbits(96) | 0xABCDEF01 << 96 for _ in range(400)}
    df = spark.createDataFrame([halves(x) for x in prints], "high long, low long")
    left = df.selectExpr("*", "0 as permutation")
    parts = left.select("high", "low", fingerprints._second_blocks("high", "low", 3).alias("b")).collect()
    assert all(len(r.b) == 4 for r in parts) and len({r.b[0] for r in parts}) > 390
    assert fingerprints.within(df, df).count() == len(prints)
