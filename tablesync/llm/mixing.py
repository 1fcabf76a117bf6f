"""Mixing sources to target weights with a low-discrepancy source schedule (operator 10, DataFrame functions only).

Golden-ratio points run through the cumulated target shares and name the source of each slot of
the mix. A slot's rank among the slots of its source names the block it takes: the source's
documents, shuffled by a hash and repeated up to three times, form one stream of words that is cut
into blocks of equal length, and rank ``r`` takes block ``r``. As a source's ranks have no gaps,
its first ``slots`` blocks are taken.

Scale: texts are read once, to count words. Prefix sums over a source go through buckets of the
shuffle hash (sum within a bucket, offsets between buckets), and ranks of slots through runs of
slots, so a source with a third of all rows never meets in one task. The schedule has at most
``slots`` slots whatever the corpus, and blocks grow with it. Where blocks hold several words, a source
whose target is under ``FEW`` blocks is not left to the schedule, which may give it no slot or one too
many: it gives its target to the word, spread evenly over the slots from a point of its own.

Defined cases: null text or only white space: size 0, nothing taken; null source: a source of its
own, ordered last; null or repeated ids: every row is a document of its own; ties of the shuffle
order are between rows of equal id and size, which are interchangeable; empty table: no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesync.functions.sizing import broadcast_if_small
from tablesync.llm.common import WORD, row_key, unused
from tablesync.workspace import written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)

#: No source gives more than this many times its own words.
MAX_REPEATS = 3

#: Most slots of a schedule. Blocks hold ``total / SLOTS`` words, at least one.
SLOTS = 1 << 20

#: Blocks under which a source gives its target to the word.
FEW = 64

#: Golden-ratio points as 32-bit fractions: ``n * GOLDEN mod 2**32``.
GOLDEN = 2654435769
ONE = 1 << 32

#: Documents that share a bucket of the shuffle hash, on average; slots that share a run.
BUCKET_ROWS, RUN = 2_000, 4_096


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``row`` (row key), ``source``, ``size`` (words of the whole text) and the shuffle hash ``h`` of every document."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key(docs).alias("row"),
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")).alias("h"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: ``sid`` (from 0), ``source``, ``source_size``, ``total``, ``target``.

    With sources ordered by ``repeats * size / weight``, those that stop at their cap come first,
    and the level that the others share is the largest of ``(total - caps before) / weights left``.
    The windows without partitions run over one aggregated row per source.
    """
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.get(cycle, F.col("sid") % len(weights)).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * repeats).withColumn("total", F.sum("source_size").over(everything))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / left
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    target = F.round(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), 6)
    return per.select("sid", "source", "source_size", "total", target.alias("target"))


def schedule(per: DataFrame, total: int, slots: int = SLOTS) -> DataFrame:
    """Every slot that a source gets: ``sid``, ``rank`` (within the source, from 0), ``slot`` (from 0).

    Points meet shares by cells of the unit interval, so there is no join without a key.
    """
    spark = per.sparkSession
    block = max(1, math.ceil(total / slots))
    count = math.ceil(total / block)
    cell = ONE // RUN
    share = F.floor(F.col("target") / F.lit(max(1, total)) * F.lit(ONE)).cast("long")
    shares = per.select("sid", share.alias("share"))
    shares = shares.withColumn("hi", F.sum("share").over(Window.orderBy("sid"))).withColumn("lo", F.col("hi") - F.col("share"))
    covered = F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))
    cells = shares.where("share > 0").select("sid", "lo", "hi", F.explode(covered).alias("cell"))
    points = spark.range(count).select(F.col("id").alias("slot"), ((F.col("id") * GOLDEN) % ONE).alias("p"))
    points = points.withColumn("cell", F.floor(F.col("p") / cell)).withColumn("run", F.floor(F.col("slot") / RUN))
    named = points.join(cells, "cell").where("p >= lo and p < hi").select("sid", "run", "slot")
    earlier = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = named.groupBy("sid", "run").agg(F.count(F.lit(1)).alias("n"))
    runs = runs.select("sid", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1
    ranked = named.withColumn("inner", inner).join(runs, ["sid", "run"])
    return ranked.select("sid", (F.col("base") + F.col("inner")).alias("rank"), "slot")


def spread(count: int) -> Column:
    """The slot, of ``count``, of a word at ``start`` of the ``own`` words of a source: even steps from the source's golden-ratio point."""
    begin = F.floor(F.lit(count) * ((F.col("sid") * GOLDEN) % ONE) / ONE)
    return ((begin + F.floor(F.col("start") * count / F.col("own"))) % count).cast("long")


def placed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, slots: int = SLOTS
) -> DataFrame:
    """Every document with what the mix takes of it.

    ``doc_id``, ``row`` (row key), ``size``, ``source_size``, ``target`` (of its source), ``taken`` (words, repeats counted)
    and ``first_slot``: the slot of the schedule that takes the block of its first word, -1 if none does.
    """
    spark = docs.sparkSession
    sizes = written(sized(docs), "mix-sizes")
    rows, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    per = written(targets(sizes, weights, repeats), "mix-targets")
    block = max(1, math.ceil(total / slots))
    plan = written(schedule(per, total, slots), "mix-slots")
    filled = plan.groupBy("sid").agg(F.count(F.lit(1)).alias("filled"))
    few = F.lit(block > 1) & (F.col("target") < FEW * block)
    own = F.when(few, F.round("target").cast("long"))
    per = per.join(filled, "sid", "left").withColumn("own", own)
    per = per.withColumn("reach", F.coalesce("own", F.col("filled") * block, F.lit(0)))
    per = per.withColumnRenamed("source", "its")
    at = sizes.join(broadcast_if_small(per), F.col("source").eqNullSafe(F.col("its")))

    digits = min(8, max(1, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16))))
    at = at.withColumn("bucket", F.substring("h", 1, digits))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = at.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    buckets = buckets.select("sid", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    at = at.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(buckets, ["sid", "bucket"])
    at = at.withColumn("start", F.col("base") + F.col("inner"))

    def words(turn: int):
        rest = F.col("reach") - F.col("start") - F.lit(turn) * F.col("source_size")
        return F.greatest(F.lit(0), F.least(rest, F.col("size")))

    taken = sum((words(turn) for turn in range(1, repeats)), words(0))
    at = at.withColumn("taken", taken.cast("long"))
    rank = F.when(F.col("size") > 0, F.floor(F.col("start") / block)).otherwise(F.lit(-1) - F.abs(F.xxhash64("h") % RUN))
    first = plan.select("sid", "rank", F.col("slot").alias("first_slot"))
    out = at.withColumn("rank", rank).join(first, ["sid", "rank"], "left")
    slot = F.when(F.col("own").isNull(), F.col("first_slot")).when((F.col("size") > 0) & (F.col("start") < F.col("own")), spread(math.ceil(total / block)))
    return out.select("doc_id", "row", "size", "source_size", "target", "taken", F.coalesce(slot, F.lit(-1)).alias("first_slot"))


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, ``first_slot``."""
    return placed(docs).drop("row")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes words of, with ``size``, ``taken`` and ``first_slot``.

    Rows of equal id and text share a decision: that of the one taken most. The three columns replace
    columns of their names.
    """
    plan = placed(docs).groupBy("row").agg(F.max("size").alias("size"), F.max("taken").alias("taken"), F.max("first_slot").alias("first_slot"))
    own = [c for c in docs.columns if c.lower() not in ("size", "taken", "first_slot")]
    (key,) = unused(docs, "row_key")
    rows = docs.select(*[F.col(f"`{c}`") for c in own], row_key(docs).alias(key))
    out = rows.join(plan.where("taken > 0").withColumnRenamed("row", key), key)
    return out.select(*[F.col(f"`{c}`") for c in own], "size", "taken", "first_slot")


def sql(slots: int = SLOTS) -> str:
    """The same rows in SQL, small sources to the word included."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
per0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
per1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM per0),
per2 AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
                CAST(source_size * {MAX_REPEATS} AS BIGINT) AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM per1),
per3 AS (SELECT *, CAST(total - coalesce(sum(cap) OVER w, 0) AS DOUBLE)
                   / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS lev
         FROM per2 WINDOW w AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
per4 AS (SELECT *, round(least(CAST(cap AS DOUBLE), max(lev) OVER () * weight), 6) AS target FROM per3),
size0 AS (SELECT coalesce(max(total), 0) AS total, greatest(1, CAST(ceil(coalesce(max(total), 0) / {slots}.0) AS BIGINT)) AS block FROM per4),
shares AS (SELECT sid, CAST(sum(share) OVER (ORDER BY sid) AS BIGINT) AS hi, CAST(share AS BIGINT) AS share
           FROM (SELECT sid, CAST(floor(target / greatest(1, total) * {ONE}) AS BIGINT) AS share FROM per4)),
slots AS (SELECT range AS slot, (range * {GOLDEN}) % {ONE} AS p
          FROM range((SELECT CAST(ceil(total / CAST(block AS DOUBLE)) AS BIGINT) FROM size0))),
plan AS (SELECT sid, slot, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank
         FROM slots JOIN shares ON p >= hi - share AND p < hi),
filled AS (SELECT sid, count(*) AS filled FROM plan GROUP BY sid),
reach AS (SELECT sid, block, CAST(ceil(total / CAST(block AS DOUBLE)) AS BIGINT) AS slots, own, CAST(coalesce(own, filled * block, 0) AS BIGINT) AS reach
          FROM (SELECT p.sid, f.filled, z.block, z.total,
                       CASE WHEN z.block > 1 AND p.target < {FEW} * z.block THEN CAST(round(p.target) AS BIGINT) END AS own
                FROM per4 p CROSS JOIN size0 z LEFT JOIN filled f ON f.sid = p.sid)),
placed AS (
  SELECT s.doc_id, s.size, p.sid, p.source_size, p.target, r.reach, r.own, r.block, r.slots,
         coalesce(sum(s.size) OVER (PARTITION BY p.sid ORDER BY s.h, s.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN per4 p ON s.source IS NOT DISTINCT FROM p.source JOIN reach r ON r.sid = p.sid)
SELECT d.doc_id, d.size, d.source_size, d.target,
       CAST(greatest(0, least(reach - start, size)) + greatest(0, least(reach - start - source_size, size))
            + greatest(0, least(reach - start - 2 * source_size, size)) AS BIGINT) AS taken,
       CAST(CASE WHEN size > 0 AND own IS NULL THEN coalesce(q.slot, -1)
                 WHEN size > 0 AND start < own
                 THEN (CAST(floor(slots * ((d.sid * {GOLDEN}) % {ONE}) / CAST({ONE} AS DOUBLE)) AS BIGINT)
                       + CAST(floor(start * slots / CAST(own AS DOUBLE)) AS BIGINT)) % slots
                 ELSE -1 END AS BIGINT) AS first_slot
FROM placed d LEFT JOIN plan q ON q.sid = d.sid AND q.rank = CAST(floor(start / CAST(d.block AS DOUBLE)) AS BIGINT)
"""


SQL = sql()
