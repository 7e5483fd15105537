"""Connected components of small graphs of tokens, by smallest labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) of edges (a, b).

    Labels move along edges and then jump to their label's label, so that rounds grow with the
    logarithm of a path.  Each round is checkpointed; the graph is one of dictionary edges.
    """
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().checkpoint()
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")).checkpoint()
    while True:
        seen = both.join(label.withColumnsRenamed({"node": "b", "root": "r"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        new = label.join(seen, "node").select("node", F.least("root", "r").alias("root"), F.col("root").alias("old"))
        jump = new.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = new.join(jump, "root", "left").select("node", F.least("root", F.coalesce("far", "root")).alias("root"), "old").checkpoint()
        if new.filter("root <> old").isEmpty():
            return new.select("node", "root")
        label = new.select("node", "root")
