"""Span rows: schema, readers, checks of declared types, and runs made from an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Declared fields: telemetry name, column and type.
FIELDS = [
    ("trace_id", "trace_id", "string"), ("span_id", "span_id", "string"), ("parent_span_id", "parent_span_id", "string"),
    ("name", "name", "string"), ("kind_string", "kind", "string"), ("duration_nano", "duration_ns", "bigint"),
    ("timestamp", "start_ns", "bigint"), ("status_code_string", "status_code", "string"), ("has_error", "has_error", "boolean"),
    ("service.name", "service", "string"), ("deployment.environment.name", "environment", "string"),
    ("agent.release.id", "release", "string"), ("agent.run.id", "run_id", "string"), ("agent.side_effect", "side_effect", "string"),
    ("agent.data_domain", "data_domain", "string"), ("agent.step.category", "step_category", "string"),
    ("agent.retry.number", "retry_number", "bigint"), ("agent.idempotency.present", "idempotent", "boolean"),
    ("gen_ai.tool.name", "tool", "string"), ("gen_ai.operation.name", "operation", "string"),
    ("gen_ai.usage.input_tokens", "input_tokens", "bigint"), ("gen_ai.usage.output_tokens", "output_tokens", "bigint"),
]
TYPES = {"string": T.StringType(), "bigint": T.LongType(), "boolean": T.BooleanType()}
COLUMN_OF = {name: column for name, column, _ in FIELDS}
#: Attributes beyond the declared fields, with the type before the value: `string:a`, `number:1`, `boolean:true`.
EXTRA = T.StructField("extra", T.MapType(T.StringType(), T.StringType()))
SCHEMA = T.StructType([*(T.StructField(c, TYPES[k]) for _, c, k in FIELDS), EXTRA])


def tag(name: str, column: Column) -> Column:
    """A value with its type before it, so that "1", 1 and true differ."""
    kind = next(k for _, c, k in FIELDS if c == name)
    prefix = {"string": "string:", "bigint": "number:", "boolean": "boolean:"}[kind]
    return F.concat(F.lit(prefix), column.cast("string"))


def as_spans(df: DataFrame) -> DataFrame:
    """df with exactly the columns of SCHEMA; absent ones are null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA))


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Spans from Parquet with telemetry or column names."""
    df = spark.read.parquet(path)
    names = {n: c for n, c, _ in FIELDS}
    return as_spans(df.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns)))


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """Spans from a JSON file of a captured trace: an array `rows` of objects with `data`, flat by telemetry name."""
    raw = spark.read.option("multiLine", True).json(path).select(F.explode("rows").alias("row")).select("row")
    data, outer = raw.schema["row"].dataType["data"].dataType.names, raw.schema["row"].dataType.names
    own = [F.col("row.data").getField(c).alias(c) for c in data]
    raw = raw.select(*own, *([F.col("row.timestamp")] if "timestamp" in outer and "timestamp" not in data else []))
    have = dict(raw.dtypes)
    declared = []
    for name, column, kind in FIELDS:
        if name not in have:
            declared.append(F.lit(None).cast(kind).alias(column))
        elif column == "start_ns":
            declared.append(F.coalesce(F.unix_micros(F.to_timestamp(F.col("`timestamp`"))) * 1000, F.lit(0)).alias(column))
        else:
            declared.append(F.col(f"`{name}`").cast(kind).alias(column))
    rest = [c for c in raw.columns if c not in COLUMN_OF]
    kinds = {"string": "string:", "boolean": "boolean:"}
    pairs = [F.struct(F.lit(c).alias("key"), F.concat(F.lit(kinds.get(have[c], "number:")), F.col(f"`{c}`").cast("string")).alias("value")) for c in rest]
    extra = F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull())) if pairs else F.lit(None)
    return as_spans(raw.select(*declared, extra.alias("extra")))


def verify_types(df: DataFrame) -> dict[str, list[str]]:
    """Declared fields that a table has as declared (`verified`), lacks (`unverified`) or has otherwise (`mismatched`)."""
    have, out = dict(df.dtypes), {"verified": [], "unverified": [], "mismatched": []}
    for _, column, kind in FIELDS:
        state = "unverified" if column not in have else "verified" if have[column] == kind else "mismatched"
        out[state].append(column)
    return out


def untrusted_fields(extra_kinds: DataFrame, declared: dict[str, str]) -> DataFrame:
    """trace_id and the sorted open attributes whose values have another type than declared; rows have trace_id and extra."""
    pairs = extra_kinds.select("trace_id", F.explode("extra").alias("key", "value"))
    kinds = F.create_map(*(F.lit(x) for kv in declared.items() for x in kv))
    bad = pairs.where(F.element_at(kinds, F.col("key")) != F.substring_index("value", ":", 1))
    return bad.groupBy("trace_id").agg(F.array_sort(F.collect_set("key")).alias("untrusted"))


def search(spans: DataFrame, where: Column, columns: list[str], start_ns: int, end_ns: int, limit: int, offset: int = 0, newest_first: bool = False) -> DataFrame:
    """A page of spans in [start_ns, end_ns) by time; the filter and the columns reach the scan."""
    if limit <= 0 or end_ns <= start_ns or offset < 0:
        raise ValueError("limit must be positive and the window not empty")
    found = spans.where(where & (F.col("start_ns") >= start_ns) & (F.col("start_ns") < end_ns)).select(*dict.fromkeys([*columns, "start_ns", "span_id", "trace_id"]))
    return found.orderBy(F.col("start_ns").desc() if newest_first else F.col("start_ns"), "span_id", "trace_id").offset(offset).limit(limit).select(*columns)


def discover(spans: DataFrame, root: str, release: str, most: int) -> tuple[DataFrame, bool]:
    """Ids of up to `most` traces of a release, earliest first, and whether there are more."""
    roots = spans.where((F.col("name") == root) & (F.col("release") == release)).groupBy("trace_id").agg(F.min("start_ns").alias("start_ns"))
    page = roots.orderBy("start_ns", "trace_id").limit(most + 1)
    more = page.count() > most
    return page.orderBy("start_ns", "trace_id").limit(most).select("trace_id"), more


def fetch(spans: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of the traces in `ids`, and the ids that have none."""
    wanted = ids.select("trace_id").distinct()
    return spans.join(wanted, "trace_id", "left_semi"), wanted.join(spans.select("trace_id"), "trace_id", "left_anti")


def field_values(spans: DataFrame, fields: list[str]) -> DataFrame:
    """key and value: the different values of some fields, as text."""
    pairs = F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in fields))
    return spans.select(F.explode(pairs).alias("x")).select("x.*").where("value IS NOT NULL").distinct()


def field_keys(rows: DataFrame, text: str) -> DataFrame:
    """key and kind (string, number, boolean, array, object or null) of the keys of JSON objects."""
    keys = rows.select(F.col(text), F.explode(F.json_object_keys(text)).alias("key"))
    raw = F.element_at(F.from_json(F.col(text), "map<string,string>"), F.col("key"))
    kind = F.when(raw.isNull(), "null").when(raw.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "number").when(raw.isin("true", "false"), "boolean").when(raw.startswith("{"), "object").when(raw.startswith("["), "array").otherwise("string")
    return keys.select("key", kind.alias("kind")).distinct()


def services(spans: DataFrame) -> DataFrame:
    """service, release and their spans, traces and errors."""
    return spans.groupBy("service", "release").agg(
        F.count("*").alias("spans"), F.countDistinct("trace_id").alias("traces"), F.count(F.when(F.col("has_error"), 1)).alias("errors")
    )


def logs_of(logs: DataFrame, traces: DataFrame, most_chars: int = 2000) -> DataFrame:
    """Log lines of the traces (trace_id), with bodies cut to `most_chars` characters."""
    return logs.join(traces.select("trace_id").distinct(), "trace_id", "left_semi").withColumn("body", F.substring("body", 1, most_chars))


def metric_points(series: DataFrame) -> DataFrame:
    """Flat points of nested metric results: results[].series[] with labels[] (key, value) and values[] (ts, value)."""
    each = series.select(F.explode("results").alias("r")).select(F.explode("r.series").alias("s"))
    labels = F.map_from_entries(F.transform("s.labels", lambda x: F.struct(x["key"], x["value"])))
    return each.select(labels.alias("labels"), F.explode("s.values").alias("p")).select("labels", "p.ts", "p.value")


def dealt(df: DataFrame) -> DataFrame:
    """df dealt out by trace into as many partitions as spark.sql.shuffle.partitions says. What follows takes far more time than its bytes
    suggest, so adaptive execution should not put the partitions together by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "trace_id")


def event_spans(events: DataFrame) -> DataFrame:
    """Events as spans: a run is a user's week under a generated `session` root, and clicks, errors and purchases hang
    off the latest view before them. Retries are places in a streak of one type. Events are dealt out by run once; each run's first
    event also gives its root."""
    week = F.to_date(F.date_trunc("week", "ts"))
    rows = events.select(
        "event_id", "event_type", F.floor(F.col("value") * 1000).cast("bigint").alias("us"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        F.concat_ws("-", F.col("user_id").cast("string"), week.cast("string")).alias("trace_id"), F.when(week < F.lit("2024-01-15").cast("date"), "v1").otherwise("v2").alias("release"),
    )
    run = Window.partitionBy("trace_id").orderBy("event_id")
    rows = dealt(rows).withColumn("last_view", F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).over(run.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("island", F.sum(F.when(F.col("event_type") == F.lag("event_type").over(run), 0).otherwise(1)).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("retry", F.row_number().over(Window.partitionBy("trace_id", "island").orderBy("event_id")) - 1)
    kind = F.col("event_type")
    under = kind.isin("click", "error", "purchase") & F.col("last_view").isNotNull()
    whole = Window.partitionBy("trace_id")
    rows = rows.withColumn("run_us", F.sum("us").over(whole)).withColumn("run_start", F.min("micros").over(whole)).withColumn("first", F.row_number().over(run) == 1)
    text = lambda x: F.lit(x).cast("string")
    number = lambda x: x.cast("bigint")
    step = {
        "span_id": F.concat(F.lit("e"), F.col("event_id").cast("string")), "parent_span_id": F.when(under, F.concat(F.lit("e"), F.col("last_view").cast("string"))).otherwise("root"),
        "name": kind, "kind": F.when(kind.isin("purchase", "signup"), "Client").otherwise("Internal"), "duration_ns": F.col("us") * 1000, "start_ns": F.col("micros") * 1000, "has_error": kind == "error",
        "service": F.when(kind == "purchase", "payments").when(kind == "signup", "accounts").otherwise("web"),
        "side_effect": F.when(kind == "purchase", "write").when(kind == "signup", "external").when(kind.isin("view", "click"), "read"),
        "data_domain": F.when(kind == "purchase", "money").when(kind == "signup", "people"), "retry_number": number(F.col("retry")), "tool": F.when(kind.isin("purchase", "signup"), kind),
        "output_tokens": number(F.length("event_type") * 10),
    }
    root = {
        "span_id": text("root"), "parent_span_id": text(None), "name": text("session"), "kind": text("Server"), "duration_ns": F.col("run_us") * 1000, "start_ns": F.col("run_start") * 1000, "has_error": F.lit(None).cast("boolean"),
        "service": text("web"), "side_effect": text("none"), "data_domain": text(None), "retry_number": number(F.lit(None)), "tool": text(None), "output_tokens": number(F.lit(None)),
    }
    own, top = (F.struct(*(v.alias(k) for k, v in x.items())) for x in (step, root))
    spans = rows.select("trace_id", "release", F.explode(F.when(F.col("first"), F.array(own, top)).otherwise(F.array(own))).alias("s")).select("trace_id", "release", "s.*")
    return as_spans(spans)
