"""Connected components by alternating stars: every step is a join and a minimum on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..storage import drop_table, write_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the smallest node it knows."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(
        "a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them. Edges go from a down to b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """``a, b``: every linked node but the smallest of its component, with that smallest node.

    ``links`` has two bigint columns a and b in any order. The result is a written table and its path.
    """
    spark = links.sparkSession
    edges, path = write_table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                              .where("a != b").distinct(), "links")
    last = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == last:
            return edges, path
        last = mark
        after, after_path = write_table(_small_star(_large_star(edges)), "stars")
        drop_table(spark, path)
        edges, path = after, after_path
