"""Connected components of small-key graphs, in Spark."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder that ``spark.checkpoint.dir`` names.

    Only a session in one process gets a temporary folder where none is set; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) from edges (a, b): labels sink to the least neighbour, and pointers are halved in each round."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near")).withColumnRenamed("a", "node")
        sunk = labels.join(heard, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jump = sunk.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = checkpointed(sunk.join(jump, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root"), "was"))
        if not new.where("root != was").limit(1).count():
            return new.select("node", "root")
        labels = new.select("node", "root")
