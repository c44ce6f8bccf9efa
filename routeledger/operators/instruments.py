"""Metrics with declared dimensions: labels that are not declared are refused, and a dimension of too many values is folded into one.

Two exact passes: the first counts the different values of each declared dimension, the second makes the series. The sums and counts over
all series of a metric are those of its rows, folded or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHER = "__other__"


def refused(rows: DataFrame, declared: dict[str, list[str]]) -> DataFrame:
    """metric, label and rows of labels that are not declared for their metric; label is null for metrics that are not declared at all."""
    known = F.create_map(*(x for m, d in declared.items() for x in (F.lit(m), F.array(*map(F.lit, d)).cast("array<string>"))))
    own = F.element_at(known, F.col("metric"))
    extra = F.when(own.isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array_except(F.map_keys("labels"), own))
    return rows.where("metric IS NOT NULL").select("metric", F.explode(extra).alias("label")).groupBy("metric", "label").agg(F.count("*").alias("rows"))


def series(rows: DataFrame, declared: dict[str, list[str]], most: int = 100) -> DataFrame:
    """metric, labels (one entry for each declared dimension, in order), n and total. rows: metric, labels (a map) and value.

    A label that a row lacks is the empty text. A dimension with more than `most` different values has OTHER in all series. Labels that are
    not declared are left out, and metrics too; `refused` lists them. Null values count as rows and add nothing.
    """
    known = F.create_map(*(x for m, d in declared.items() for x in (F.lit(m), F.array(*map(F.lit, d)).cast("array<string>"))))
    own = rows.where(F.col("metric").isin(*declared))
    labels = F.transform(F.element_at(known, F.col("metric")), lambda d: F.struct(d.alias("dimension"), F.coalesce(F.element_at("labels", d), F.lit("")).alias("value")))
    # Map-side sums first: rows with one set of labels become one before anything else is counted.
    packed = own.select("metric", labels.alias("labels"), "value").groupBy("metric", "labels").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    values = packed.select("metric", F.explode("labels").alias("l")).select("metric", "l.*").distinct()
    sizes = values.groupBy("metric", "dimension").agg(F.count("*").alias("size")).where(F.col("size") > most)
    folded = sizes.groupBy("metric").agg(F.collect_set("dimension").alias("folded"))  # a row for each declared metric at most
    met = packed.join(folded, "metric", "left")
    kept = F.transform("labels", lambda x: F.struct(x["dimension"].alias("dimension"), F.when(F.array_contains(F.coalesce("folded", F.array().cast("array<string>")), x["dimension"]), OTHER).otherwise(x["value"]).alias("value")))
    return met.select("metric", kept.alias("labels"), "n", "total").groupBy("metric", "labels").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
