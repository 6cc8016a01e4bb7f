"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.runtime import release, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v): label is the least node of its component.

    Each round takes the least label among neighbours and then the label of
    that label, so that chains shorten by half; rounds are staged tables and
    end when no label changes. Hubs are pre-aggregated before every shuffle.
    """
    both = staged(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("m"))
        new = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        after = staged(new.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")), "labels")
        done = after.filter(F.col("old") != F.col("label")).isEmpty()
        release(labels)
        labels = after
        if done:
            release(both)
            return labels.select("node", "label")
