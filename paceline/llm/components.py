"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.session import materialise


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label: the least node of its component, for every end ``a`` or ``b`` of a link.

    A round gives each node the least label among its neighbours and then that label's own label, so that paths
    halve; each round is written to the shared folder, which cuts the lineage. Runs a job for each round.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialise(both, "links")
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), "labels")
    for _ in range(rounds):
        around = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(around, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("via"))
        onward = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        after = materialise(lower.join(onward, "via").select("node", F.least("via", "further").alias("label"), "was"), "labels")
        moved = after.filter("label < was").limit(1).count()
        labels = after.select("node", "label")
        if not moved:
            return labels
    raise RuntimeError("labels still move; allow more rounds")
