"""Connected components as a loop of Spark jobs: least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of *edges* (a, b); component is the least node reachable.

    Each round takes the least label of the neighbours, combined before the shuffle, so a
    node with very many neighbours costs one row per task. Rounds end when nothing changes.
    Every round is written to the shared folder: a lost executor repeats one round at most.
    An edge with a null end is ignored.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = stage(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = stage(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        .select("node", F.least("node", "least").alias("component"), F.lit(True).alias("moved")),
        "labels",
    )
    while not labels.where("moved").isEmpty():
        known = labels.select(F.col("node").alias("b"), F.col("component").alias("seen"))
        least = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        near = labels.select("node", "component").join(least, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "seen").alias("target")
        )
        # Jump: the label of the label, as it stood before this round.
        jump = labels.select(F.col("node").alias("target"), F.col("component").alias("jumped"))
        labels = stage(
            near.join(jump, "target", "left").select(
                "node",
                F.least("target", "jumped").alias("component"),
                (F.least("target", "jumped") < F.col("old")).alias("moved"),
            ),
            "labels",
        )
    return labels.select("node", "component")
