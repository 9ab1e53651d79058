"""Group labels of an edge table by repeated smallest-label exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark) -> None:
    """The session's shared folder; one of our own only on a single machine where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share.")
        import tempfile

        named = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(named)


def group_labels(edges: DataFrame) -> DataFrame:
    """(id, label): nodes of edges (a, b), strings, with one label for each connected group.

    Every round a node takes the smallest label among its neighbours and then its label's own label, so
    labels reach twice as far each time; the rounds stop when none changes.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().select(F.xxhash64("a").alias("x"), F.xxhash64("b").alias("y")).checkpoint()
    now = both.select("x", F.col("x").alias("l")).distinct()
    while True:
        heard = both.join(now.select(F.col("x").alias("y"), F.col("l").alias("ly")), "y").groupBy("x").agg(F.min("ly").alias("m"))
        stepped = now.join(heard, "x").select("x", F.least("l", "m").alias("t"), F.col("l").alias("was"))
        jump = stepped.select(F.col("x").alias("t"), F.col("t").alias("further"))
        new = stepped.join(jump, "t").select("x", "further", "was").checkpoint()
        changed = new.where("further <> was").limit(1).count()
        now = new.select("x", F.col("further").alias("l"))
        if not changed:
            break
    names = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    return names.join(now, F.xxhash64("id") == F.col("x")).select("id", F.col("l").alias("label"))
