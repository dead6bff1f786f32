"""Classes of linked ids, as joins and grouped minima; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def classes(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of ``edges`` (a, b): the smallest id that each is linked to.

    Every round takes the least label among a node and its neighbours, then follows that label's
    own label, so the reach of a label doubles.  Rounds are written to the shared folder, and end
    when no label changes.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = written(labels.withColumn("was", F.lit(None).cast("long")), "labels")
    while True:
        now = labels.select("node", "label")
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m")).withColumnRenamed("a", "node")
        hooked = now.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        far = now.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = written(hooked.join(far, "label").select("node", F.least("label", "next").alias("label"), "was"), "labels")
        discard(labels)
        labels = new
        if new.filter("was <> label").isEmpty():
            discard(both)
            return new
