"""Connected components of an edge table by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageloom.llm.staging import Stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(stage: Stage, edges: DataFrame) -> DataFrame:
    """(node, root) for each node that has an edge; the root is the least node reachable.

    Each round is two joins on narrow rows; a hub is a key of the joined side,
    whose minimum is taken before the shuffle and whose rows an adaptive plan
    splits. Rounds grow with the logarithm of the longest path; edges that are
    such a result already take one. Each star is staged, so that the next one's
    plan does not repeat it, and joins are never broadcast: the plans, tables and
    threads of many rounds are what the driver would hold.
    """
    current = stage.keep(edges.where("u <> v").distinct())
    state = _state(current)
    while True:
        spread = stage.keep(_large_star(current))
        following = stage.keep(_small_star(spread).where("u <> v").distinct())
        seen = _state(following)
        stage.drop(current, spread)
        current = following
        if seen == state:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
