"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from propspark.session import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each vertex hands its neighbours (the larger ones, or the smaller ones and itself) to the least of them."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    down = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """The least vertex (``root``) of the component of each vertex that has an edge; columns ``id`` and ``root``.

    ``edges`` has ``u`` and ``v`` of one orderable type; order, repeats and loops do not matter. Every round writes its
    edges to the shared folder, so a lost executor costs that round at most; rounds grow with the logarithm of
    the longest path. Only counts come to the driver.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = materialize(edges.select("u", "v").filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (here := state(now)) != before:
        before = here
        now = materialize(_stars(_stars(now, True), False), "stars")
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
