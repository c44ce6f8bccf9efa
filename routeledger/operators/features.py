"""Weighted features of routes, exact Jaccard similarity, and the nearest approved family by a set-similarity join.

The nearest family of a run is found without a comparison of every run with every family. Equal sets of features are compared once.
Any family that a run meets gives a bound: the nearest one is at least as similar. With the bound b, a family can only be as near if
- it shares one of the run's rarest features, those before which the weight of all that remain falls below b of the run's (prefix filter),
- and its weight is between b of the run's and 1/b of it (length filter).
Only pairs that pass both are compared exactly. Features that all routes share come last in the order of rarity and join nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeledger.operators.graph import Graph, cut

#: Weights by kind.
WEIGHTS = {"criticalNode": 5, "sideEffectNode": 5, "toolNode": 3, "serviceNode": 2, "ordinaryNode": 1, "criticalEdge": 5}


def features(graph: Graph, nodes: DataFrame, critical: list[str] = ()) -> DataFrame:
    """trace_id, feature and weight. A node gives one feature, of the gravest kind that it is: critical by label, with a side effect by label
    and effect, of a tool by the tool, or ordinary by label; and one of its service. Edges between labels are critical or ordinary."""
    is_critical = F.col("label").isin(*critical) if critical else F.lit(False)
    of = lambda kind, *key: F.struct(F.concat(F.lit(f"{kind}:"), *key).alias("feature"), F.lit(WEIGHTS[kind]).alias("weight"))
    own = (
        F.when(is_critical, of("criticalNode", "label")).when(F.col("side_effect").isin("write", "external"), of("sideEffectNode", "label", F.lit("|"), "side_effect"))
        .when(F.col("tool").isNotNull(), of("toolNode", "tool")).otherwise(of("ordinaryNode", "label"))
    )
    of_nodes = nodes.select("trace_id", F.explode(F.array(own, of("serviceNode", "service"))).alias("f"))
    labels = nodes.select("trace_id", "span_id", "label")
    pairs = graph.edges.join(labels.toDF("trace_id", "from", "a"), ["trace_id", "from"]).join(labels.toDF("trace_id", "to", "b"), ["trace_id", "to"])
    grave = (F.col("a").isin(*critical) | F.col("b").isin(*critical)) if critical else F.lit(False)
    of_edges = pairs.select("trace_id", F.when(grave, of("criticalEdge", "a", F.lit("->"), "b")).otherwise(of("ordinaryNode", "a", F.lit("->"), "b")).alias("f"))
    return of_nodes.union(of_edges).select("trace_id", "f.*").distinct()


def feature_sets(rows: DataFrame, key: str) -> DataFrame:
    """key, set_id, set (sorted features with their weights) and total, for each key."""
    found = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("feature", F.col("weight").cast("bigint").alias("weight")))).alias("set"))
    total = F.aggregate("set", F.lit(0).cast("bigint"), lambda a, x: a + x["weight"])
    return found.select(key, F.sha2(F.to_json("set"), 256).alias("set_id"), "set", total.alias("total"))


def weight_of(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + x["weight"])


def compared(pairs: DataFrame, runs: DataFrame, families: DataFrame) -> DataFrame:
    """set_id, family, shared and either of pairs (set_id, family): the weight of what both sets have and of what either has."""
    met = pairs.join(runs.select("set_id", "set", "total"), "set_id").join(families.select("family", F.col("set").alias("theirs"), F.col("total").alias("their_total")), "family")
    met = met.withColumn("shared", weight_of(F.array_intersect("set", "theirs")))
    return met.select("set_id", "family", "shared", (F.col("total") + F.col("their_total") - F.col("shared")).alias("either"))


def jaccard(shared: Column, either: Column) -> Column:
    """The similarity as a number; two empty sets are alike."""
    return F.when(either == 0, 1.0).otherwise(shared.cast("double") / either.cast("double"))


def similarity(own: DataFrame, families: DataFrame) -> DataFrame:
    """trace_id, fingerprint, shared, either and jaccard of every run and family that share a feature."""
    runs = feature_sets(own, "trace_id").withColumn("set_id", F.col("trace_id"))
    theirs = feature_sets(families, "fingerprint").withColumnRenamed("fingerprint", "family")
    pairs = own.select(F.col("trace_id").alias("set_id"), "feature", "weight").join(families.select(F.col("fingerprint").alias("family"), "feature", "weight"), ["feature", "weight"]).select("set_id", "family").distinct()
    found = compared(pairs, runs, theirs)
    return found.select(F.col("set_id").alias("trace_id"), F.col("family").alias("fingerprint"), "shared", "either", jaccard(F.col("shared"), F.col("either")).alias("jaccard"))


def best(found: DataFrame) -> DataFrame:
    """The row of each set_id with the greatest share, ties to the smaller family."""
    exact = F.col("shared").cast("decimal(19,0)") / F.col("either").cast("decimal(18,0)")
    order = F.struct((-exact).alias("e"), "family", "shared", "either")
    return found.groupBy("set_id").agg(F.min(order).alias("x")).select("set_id", "x.family", "x.shared", "x.either")


def candidates(runs: DataFrame, families: DataFrame) -> DataFrame:
    """set_id and family of all pairs that may be the nearest: prefix and length filter under each run's bound."""
    inverted = families.select("family", "total", F.explode("set").alias("f")).select("family", "total", F.col("f.feature").alias("feature"), F.col("f.weight").alias("weight"))
    h = F.xxhash64("family")
    some = F.array_distinct(F.array(F.min("family"), F.max("family"), F.min_by("family", h), F.max_by("family", h)))
    counts = inverted.groupBy("feature", "weight").agg(F.count("*").alias("n"), some.alias("some"))
    own = runs.select("set_id", "total", F.explode("set").alias("f")).select("set_id", "total", F.col("f.feature").alias("feature"), F.col("f.weight").alias("weight"))
    met = cut(own.join(counts, ["feature", "weight"], "left"))
    # A few families of each feature, whichever: the exact similarity of the best is the bound.
    tried = met.where("n IS NOT NULL").select("set_id", F.explode("some").alias("family")).distinct()
    bound = best(compared(tried, runs, families)).select("set_id", F.col("shared").alias("s"), F.col("either").alias("e"))
    # The weight of a feature and of all that are more common than it: below the bound, those alone are not enough.
    rare = Window.partitionBy("set_id").orderBy(F.coalesce("n", F.lit(0)).desc(), F.desc("feature")).rowsBetween(Window.unboundedPreceding, 0)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    prefix = met.withColumn("rest", F.sum("weight").over(rare)).join(bound, "set_id").where((F.col("n") > 0) & (wide("rest") * wide("e") >= wide("s") * wide("total")))
    pairs = prefix.select("set_id", "feature", "weight", "total", "s", "e").join(inverted.withColumnRenamed("total", "theirs"), ["feature", "weight"])
    near = (wide("theirs") * wide("e") >= wide("s") * wide("total")) & (wide("total") * wide("e") >= wide("s") * wide("theirs"))
    return pairs.where(near).select("set_id", "family").distinct()


def distinct_sets(own: DataFrame, families: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs (trace_id, set_id, set, total), the different sets of runs, and of families, each under its least fingerprint."""
    runs = cut(feature_sets(own, "trace_id"))
    groups = feature_sets(families, "fingerprint").groupBy("set_id").agg(F.min("fingerprint").alias("family"), F.first("set").alias("set"), F.first("total").alias("total"))
    return runs, runs.groupBy("set_id").agg(F.first("set").alias("set"), F.first("total").alias("total")), cut(groups)


def nearest(own: DataFrame, families: DataFrame) -> DataFrame:
    """The most similar family of each run, ties to the smaller fingerprint: trace_id, nearest, shared and either.

    own: trace_id, feature, weight; families: fingerprint, feature, weight; a feature has one weight. A run that shares nothing with any family
    is nearest to the least fingerprint, by 0 of both sums. Without families there are no rows.
    """
    runs, sets, groups = distinct_sets(own, families)
    same = sets.join(groups.select("set_id", "family"), "set_id").select("set_id", "family", F.col("total").alias("shared"), F.col("total").alias("either"))
    others = cut(sets.join(groups.select("set_id"), "set_id", "left_anti"))
    found = same.unionByName(best(compared(candidates(others, groups), others, groups)))
    least = groups.orderBy("family").limit(1).select(F.col("family").alias("least"), F.col("total").alias("theirs"))
    met = runs.select("trace_id", "set_id", "total").join(F.broadcast(least), F.lit(True)).join(found, "set_id", "left")  # one row at most, so that each run meets it
    return met.select("trace_id", F.coalesce("family", "least").alias("nearest"), F.coalesce("shared", F.lit(0)).cast("bigint").alias("shared"), F.coalesce("either", F.col("total") + F.col("theirs")).cast("bigint").alias("either"))
