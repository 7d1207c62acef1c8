"""Connected components of an edge table, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.session import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node reachable) for the nodes of ``edges`` (a, b; any order, repeats allowed).

    Every round takes the smallest label of all neighbours and then the label's
    own label, so labels travel twice as far each time.  Labels are stored after
    each round; the driver sees one count per round.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n_node")).agg(F.min("label").alias("n_label"))
        step = labels.join(near, F.col("node") == F.col("n_node"), "left").select("node", F.col("label").alias("old"), F.least("label", "n_label").alias("mid"))
        own = labels.select(F.col("node").alias("j_node"), F.col("label").alias("j_label"))
        now = cut(step.join(own, F.col("mid") == F.col("j_node"), "left").select("node", "old", F.least("mid", "j_label").alias("label")))
        labels = now.select("node", "label")
        if now.filter("old <> label").isEmpty():
            return labels
