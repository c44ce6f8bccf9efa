"""Connected components of an edge table, by hash-joined minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeledger.llm.shared import discard, written


def components(edges: DataFrame) -> DataFrame:
    """`node` and `component`, its least node, for every node of edges (a, b).

    In each round a node takes the least label among its neighbours' and then its label's label; labels, not edges, are
    what changes, and each round writes one table and drops the one before. A node with very many edges is one side of plain
    equi-joins, which adaptive execution splits, and of minima, which are combined before the shuffle. Edges with a null end and
    loops of a node on itself are left out, so such nodes have no row; repeated edges change nothing.
    """
    both = edges.select("a", "b").where("a <> b")
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"), F.lit(True).alias("moved")))
    while True:
        at_b = labels.select(F.col("node").alias("b"), "label")
        heard = both.join(at_b, "b").groupBy("a").agg(F.min("label").alias("heard"))
        low = labels.join(heard.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("label").alias("before"), F.least("label", F.coalesce("heard", "label")).alias("label"))
        at_label = low.select(F.col("node").alias("label"), F.col("label").alias("next"))
        last = F.least("label", F.coalesce("next", "label"))
        jumped = written(low.join(at_label, "label", "left").select("node", last.alias("label"), (last < F.col("before")).alias("moved")))
        discard(labels)
        labels = jumped
        if labels.where("moved").isEmpty():
            discard(both)
            return labels.select("node", F.col("label").alias("component"))
