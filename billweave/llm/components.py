"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.tables import stored


def stars(edges: DataFrame) -> DataFrame:
    """One large star, then one small star: every node ends up linked with lesser nodes only."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    down = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    small = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
    return small.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """Edges (a, b) to (id, component): the least node that can be reached, for every node with an edge.

    Each round is stored, so that a lost executor costs a read; the number of rounds grows with the
    logarithm of the longest path. Nothing but two numbers a round reaches the driver.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    held = stored(edges.where("a <> b").select("a", "b").distinct(), folder, f"{name}-0")
    seen, number = mark(held), 0
    while seen[0]:
        number += 1
        held = stored(stars(held), folder, f"{name}-{number}")
        now = mark(held)
        if now == seen:
            break
        seen = now
    roots = held.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return held.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots).groupBy("id").agg(
        F.min("component").alias("component"))
