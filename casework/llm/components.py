"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(vertex, root) for every vertex of ``edges`` (a, b) but the roots; the root is the smallest vertex of its component.

    Every round hangs neighbours below the smallest one they share; the number of rounds grows with the logarithm of a
    component's size. Each round is written to the shared folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e, "edges")
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", "m")).where("a <> b").distinct()
        e = stored(small, "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
