"""Connected components over edges of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that it reaches), from edges a, b; nodes without an edge to another node are left out.

    Each round takes the least label among a node's neighbours, then the label of that label, so paths
    halve at least. Minima are combined before the shuffle; a hub's rows meet one label in a join, which Spark's skew join splits. Each round is checkpointed. No edges give no rows.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("heard"))
        least = cut(labels.join(heard, labels.node == heard.a, "left").select("node", "component", F.least("component", F.coalesce("heard", "component")).alias("next")))
        jump = least.select(F.col("node").alias("via"), F.col("next").alias("beyond"))
        label = F.least("next", F.coalesce("beyond", "next"))
        new = cut(least.join(jump, least.next == jump.via, "left").select("node", label.alias("component"), (label < F.col("component")).cast("int").alias("moved")))
        labels = new.select("node", "component")
        if not new.agg(F.max("moved")).first()[0]:
            return labels
