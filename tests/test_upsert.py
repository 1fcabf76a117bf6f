"""Deduplication and upsert: semantics, properties, plan shape, hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from tablesync.errors import DestinationStreamInvalidSchema, DuplicateKeys
from tablesync.operators.upsert import (
    dedupe_latest, dedupe_sparse, duplicate_keys, prepare_stage, unmatched, upsert_delete_insert, upsert_replace,
)
from tablesync.workspace import written

DDL = "k bigint, at bigint, v string"


def table(spark, data):
    return spark.createDataFrame(data, DDL)


def brute_latest(data):
    best, loose = {}, []
    for k, at, v in data:
        if k is None:
            loose.append((k, at, v))
            continue
        rank = (at is not None, at if at is not None else 0)
        if k not in best:
            best[k] = (rank, v, at)
        else:
            old_rank, old_v, _ = best[k]
            if rank > old_rank or (rank == old_rank and v < old_v):
                best[k] = (rank, v, at)
    return [(k, at, v) for k, (_, v, at) in best.items()] + loose


def key(t):
    return tuple((v is None, str(v)) for v in t)


def random_rows(seed, n=300, keys=40):
    rng = random.Random(seed)
    # a third of the rows share key 0, some keys and cursors are NULL
    out = []
    for _ in range(n):
        k = 0 if rng.random() < 0.34 else rng.choice([None, *range(keys)])
        out.append((k, rng.choice([None, *range(5)]), rng.choice("abcdef")))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_w1_dedupe_against_brute_force(spark, seed):
    data = random_rows(seed)
    want = sorted(brute_latest(data), key=key)
    df = table(spark, data)
    assert rows(dedupe_latest(df, ["k"], "at")) == want
    assert rows(dedupe_sparse(df, ["k"], "at")) == want


def test_w1_result_does_not_depend_on_partitioning(spark):
    df = table(spark, random_rows(7))
    want = rows(dedupe_latest(df, ["k"], "at"))
    for n in (1, 3, 11):
        assert rows(dedupe_latest(df.repartition(n), ["k"], "at")) == want


def test_w1_one_row_per_key_leaves_each_map_task(spark, small):
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    plan = plan_of(dedupe_latest(lines, ["l_orderkey", "l_linenumber"], "l_shipdate"))
    limits = [part for part in plan.split("\n\n") if "WindowGroupLimit" in part]
    assert any("Partial" in p for p in limits) and any("Final" in p for p in limits)


def test_dedupe_sparse_leaves_unique_stages_alone(spark):
    df = table(spark, [(i, i, "x") for i in range(10)])
    assert dedupe_sparse(df, ["k"], "at") is df


def test_q7_duplicate_policies(spark):
    df = table(spark, [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")])
    assert rows(duplicate_keys(df, ["k"])) == [(1, 2)]
    assert prepare_stage(df, ["k"], "at", "none").count() == 3
    assert prepare_stage(df, ["k"], "at", "latest").count() == prepare_stage(df, ["k"], "at", "sparse").count() == 2
    with pytest.raises(DuplicateKeys):
        prepare_stage(df, ["k"], "at", "error")
    with pytest.raises(ValueError):
        prepare_stage(df, ["k"], "at", "whatever")


def brute_upsert(target, stage):
    staged = {k for k, _, _ in stage if k is not None}
    return [r for r in target if r[0] is None or r[0] not in staged] + list(stage)


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
@pytest.mark.parametrize("seed", range(2))
def test_j1_j2_j4_upsert_against_brute_force(spark, seed, threshold):
    target, stage = random_rows(seed), random_rows(seed + 100, 100, 60)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        want = sorted(brute_upsert(target, stage), key=key)
        assert rows(upsert_replace(table(spark, target), table(spark, stage), ["k"])) == want
        assert rows(upsert_delete_insert(table(spark, target), table(spark, stage), ["k"])) == want
        want = sorted(brute_upsert(target, brute_latest(stage)), key=key)
        got = upsert_replace(table(spark, target), table(spark, stage), ["k"], cursor="at", dedupe="latest")
        assert rows(got) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_u1_columns_are_matched_by_name(spark):
    target = table(spark, [(1, 1, "a")])
    stage = table(spark, [(2, 2, "b")]).select("v", "k", "at")
    assert rows(upsert_replace(target, stage, ["k"])) == [(1, 1, "a"), (2, 2, "b")]
    with pytest.raises(DestinationStreamInvalidSchema):
        upsert_replace(target, stage.drop("v"), ["k"])


def test_q20_guard_ignores_older_rows(spark):
    target = table(spark, [(1, 5, "new"), (2, 5, "old"), (3, None, "unset"), (4, 5, "set")])
    stage = table(spark, [(1, 4, "late"), (2, 6, "newer"), (3, 1, "first"), (4, None, "none"), (5, None, "fresh"), (None, 0, "x")])
    got = rows(upsert_replace(target, stage, ["k"], "cursor", "at"))
    want = [(1, 5, "new"), (2, 6, "newer"), (3, 1, "first"), (4, 5, "set"), (5, None, "fresh"), (None, 0, "x")]
    assert got == sorted(want, key=key)
    with pytest.raises(ValueError):
        upsert_replace(target, stage, ["k"], "cursor")
    with pytest.raises(ValueError):
        upsert_replace(target, stage, ["k"], "maybe")


def test_q20_guarded_batches_commute(spark):
    a, b = [(i, 1, "a") for i in range(20)], [(i, 2, "b") for i in range(10, 30)]
    empty = table(spark, [])

    def apply(*batches):
        out = empty
        for batch in batches:
            out = written(upsert_replace(out, table(spark, batch), ["k"], "cursor", "at"))
        return rows(out)

    assert apply(a, b) == apply(b, a) == apply(a, b, a, b)


def test_composite_keys_with_a_null_part_never_match(spark):
    ddl = "a int, b int, v string"
    target = spark.createDataFrame([(1, None, "t"), (1, 1, "t")], ddl)
    stage = spark.createDataFrame([(1, None, "s"), (1, 1, "s")], ddl)
    assert rows(upsert_replace(target, stage, ["a", "b"])) == sorted([(1, 1, "s"), (1, None, "s"), (1, None, "t")], key=key)


def test_null_keys_do_not_meet_in_one_partition(spark):
    """A third of the target has a NULL key; shuffled, those rows use all partitions."""
    target = spark.range(30000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    stage = spark.range(100).select(F.col("id").alias("k"), F.lit(-1).cast("bigint").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        per_task = (
            unmatched(target, stage, ["k"]).where("k is null")
            .groupBy(F.spark_partition_id().alias("p")).count().collect()
        )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [r["count"] for r in per_task]
    assert sum(sizes) == 10000 and len(sizes) == 4 and max(sizes) < 4000


def test_target_is_not_shuffled_for_a_small_stage(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    stage = orders.where("o_orderdate >= '2001-07-01'")
    merged = upsert_replace(orders, stage, ["o_orderkey"])
    merged.collect()
    final = plan_of(merged)
    assert "BroadcastHashJoin" in final.split("Initial Plan")[0] or "BroadcastHashJoin" in final


def test_nested_columns_survive_dedupe_and_upsert(spark):
    df = spark.sql("select id k, id % 3 at, map('a', id) m, named_struct('x', map(1, id)) s, array(id) xs from range(9)")
    twice = df.unionByName(df.withColumn("at", df.at + 1))
    latest = dedupe_latest(twice, ["k"], "at")
    assert latest.count() == 9 and latest.agg(F.sum("at")).first()[0] == 18
    assert upsert_replace(df, latest, ["k"]).count() == 9
