"""Connected components of a written edge table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut, hot_join


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(_least(both).select("u", F.least("u", "m").alias("m"), "__n"), "cc-least")
    return hot_join(both.filter("v > u"), least, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(_least(down), "cc-least")
    moved = hot_join(down, least, "u", n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v); root is the least node of its component.

    A node of any degree is handled by its least neighbour (a pre-aggregated
    minimum), which reaches the links of a hub by broadcast; no neighbour list
    is ever built. Each round is a written table; the rounds end when a round
    changes nothing. Self-links and repeated links do no harm.
    """
    now = cut(edges.filter("u <> v").select("u", "v").distinct(), "cc-edges")
    seen = _mark(now)
    while True:
        star = cut(_large_star(now, seen[0]), "cc-star")  # as many links as before
        now = cut(_small_star(star, seen[0]).filter("u <> v").distinct(), "cc-round")
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
