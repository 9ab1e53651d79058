"""Connected components of an edge table, without collecting vertices or edges.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014): every step hangs neighbours on the smallest vertex they share, so the edges never
grow in number and the rounds grow with the logarithm of a component's diameter.
Each round is cut with checkpoint() in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import shared_dir


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """edges (x, y), x > y, one row each."""
    both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))) if larger else edges
    least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("v"), F.least("x", "m").alias("m"))
    near = both.where("y > x") if larger else both
    # the vertex itself hangs on its minimum, and so do its larger (or smaller) neighbours
    hung = near.join(least, F.col("x") == F.col("v")).select(F.col("y").alias("x"), F.col("m").alias("y"))
    return hung.union(least.select("v", "m")).where("x <> y").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of edges (a, b); component is the smallest id that links reach."""
    spark = edges.sparkSession
    shared_dir(spark)
    now = edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct().checkpoint()
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)")), F.count_distinct("x")).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        now = _star(_star(now, True), False).checkpoint()
    children = now.select(F.col("x").alias("id"), F.col("y").alias("component"))
    return children.union(now.select(F.col("y").alias("id"), F.col("y").alias("component")).distinct())
