"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.workspace import written


def _best(links: DataFrame, turn: int) -> DataFrame:
    """Every node's neighbour (or itself) of lowest priority; priorities are drawn anew each turn."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def ranked(name: str):
        return F.struct(F.xxhash64(F.col(name), F.lit(turn)).alias("p"), F.col(name).alias("node"))

    best = both.groupBy("a").agg(F.min(ranked("b")).alias("other"))
    return best.select(F.col("a").alias("node"), F.least(F.col("other"), ranked("a")).getField("node").alias("to"))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node that has a link; nodes of a component share their root.

    Contraction: every node moves to its neighbour of lowest random priority, links follow, and what
    has become a loop or a repetition goes. About half of the nodes go each turn, also in long chains
    and stars, so there are few turns and each is smaller than the one before. Every turn is written
    to the shared folder, so lost executors cost no more than a turn.

    ``links`` has the comparable columns ``a`` and ``b``; order, loops and repetitions do not matter.
    """
    def clean(x: DataFrame) -> DataFrame:
        pairs = x.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return written(pairs.distinct(), "links")

    links, moves = clean(links), []
    while not links.isEmpty():
        move = written(_best(links, len(moves)), "moves")
        moves.append(move)
        a, b = move.toDF("a", "a_to"), move.toDF("b", "b_to")
        links = clean(links.join(a, "a").join(b, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")))
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves[-1].toDF("node", "root")
    for move in reversed(moves[:-1]):
        onward = roots.toDF("to", "root")
        roots = move.join(onward, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return written(roots, "roots")
