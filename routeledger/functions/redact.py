"""Redaction of secrets by key and by value, and export of graphs without them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys whose values are secrets, those that only look like it, and what stands for a secret.
SECRET_KEYS = ["api[-_]?key", "^authorization$", "secret", "token", "password", "passwd", "credential", "private[-_]?key"]
MEASURES = [
    "tokens", "maxTokenRegressionPercent", "inputTokensP95", "outputTokensP95", "inputTokens", "outputTokens", "totalTokens", "tokenPercentile", "tokenMarginPercent",
    "gen_ai.usage.input_tokens", "gen_ai.usage.output_tokens", "gen_ai.usage.total_tokens",
]
REDACTED = "[redacted]"
#: Characters that a registered secret has at least.
LEAST_SECRET = 8


def secret_key(key: Column) -> Column:
    """Whether a key names a secret."""
    return ~key.isin(*MEASURES) & key.rlike("(?i)" + "|".join(SECRET_KEYS))


def redacted_text(text: Column, secrets: list[str]) -> Column:
    """A text with each registered secret replaced."""
    for secret in (s for s in secrets if len(s) >= LEAST_SECRET):
        text = F.replace(text, F.lit(secret), F.lit(REDACTED))
    return text


def redacted_map(values: Column, secrets: list[str] = ()) -> Column:
    """A map of attributes without secrets: those of secret keys as a whole, others where they hold a registered one."""
    return F.transform_values(values, lambda k, v: F.when(secret_key(k), F.lit(REDACTED)).otherwise(redacted_text(v, list(secrets))))


def redacted(value, secrets: list[str] = ()):
    """A document without secrets, at every depth."""
    if isinstance(value, dict):
        return {k: REDACTED if k not in MEASURES and any(re.search(p, k, re.IGNORECASE) for p in SECRET_KEYS) else redacted(v, secrets) for k, v in value.items()}
    if isinstance(value, list):
        return [redacted(v, secrets) for v in value]
    if isinstance(value, str):
        for secret in (s for s in secrets if len(s) >= LEAST_SECRET):
            value = value.replace(secret, REDACTED)
    return value


def exported(nodes: DataFrame, secrets: list[str] = ()) -> DataFrame:
    """trace_id and `document`: the nodes of each trace, of which there is a bounded number, in canonical order and the edges between them as JSON without
    secrets."""
    node = F.struct("order", "label", "service", "kind", F.col("side_effect").alias("sideEffect"), "tool", redacted_map(F.col("attributes"), secrets).alias("attributes"))
    listed = nodes.where("`order` IS NOT NULL").groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("order", F.to_json(node).alias("text"), F.col("span_id").alias("id"), "up"))).alias("n"))
    listed = listed.withColumn("place", F.map_from_arrays(F.col("n")["id"], F.col("n")["order"]))
    ends = F.transform(F.filter("n", lambda x: x["up"].isNotNull()), lambda x: F.struct(F.element_at("place", x["up"]).alias("from"), x["order"].alias("to"), F.lit("parent").alias("type")))
    edges = F.to_json(F.array_sort(F.filter(ends, lambda e: e["from"].isNotNull())))
    return listed.select("trace_id", F.concat(F.lit('{"nodes":['), F.array_join(F.col("n")["text"], ","), F.lit('],"edges":'), edges, F.lit("}")).alias("document"))
