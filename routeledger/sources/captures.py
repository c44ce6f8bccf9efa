"""Captured spans with open attributes, read as VARIANT: no schema is inferred, values keep their types, and odd rows keep their reason.

A capture is a JSON document with a list `rows` of objects {data, timestamp}, or a file of one such object a line. `data` is flat by
telemetry name; any other key is an open attribute, whose value may be of any type, and of another one in each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeledger.operators.selectors import list_value
from routeledger.sources.spans import FIELDS, as_spans

#: Kinds of JSON values, by how VARIANT names their types.
KINDS = {"STRING": "string", "BIGINT": "number", "DOUBLE": "number", "FLOAT": "number", "BOOLEAN": "boolean", "VOID": "null"}
DECLARED = {"string": "string", "bigint": "number", "boolean": "boolean"}
ROWS = "file string, place bigint, reason string, attributes map<string,variant>, stamp string"


def kind_of(value: Column) -> Column:
    """string, number, boolean, array, object or null."""
    said = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    known = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    return F.coalesce(F.element_at(known, said), F.when(said == "ARRAY", "array").when(said == "OBJECT", "object").when(said == "DECIMAL", "number"), F.lit("string"))


def number_text(value: Column) -> Column:
    """A number as text, whole ones without a fraction."""
    whole, wide = F.try_variant_get(value, "$", "decimal(38,0)"), F.try_variant_get(value, "$", "double")
    return F.when(whole.cast("double") == wide, whole.cast("string")).otherwise(F.regexp_replace(wide.cast("string"), r"\.0$", ""))


def tagged(value: Column) -> Column:
    """A value with its kind before it; a list as its members' tagged values, an object as JSON with its keys in order."""
    plain = lambda v: F.when(kind_of(v) == "number", F.concat(F.lit("number:"), number_text(v))).when(kind_of(v).isin("array", "object"), F.concat(kind_of(v), F.lit(":"), F.to_json(v))).otherwise(F.concat(kind_of(v), F.lit(":"), F.try_variant_get(v, "$", "string")))
    members = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.coalesce(plain(v), F.lit("null:")))
    return F.when(kind_of(value) == "array", list_value(members)).otherwise(plain(value))


def rows_of(docs: DataFrame, lines: bool) -> DataFrame:
    """ROWS of texts (file, place, value): a row for each span, or with a reason for what holds none."""
    parsed = docs.select("file", "place", F.try_parse_json("value").alias("doc"), "value")
    if not lines:
        # Null where there is no list; a document without one stays as one row with a reason.
        many = F.try_variant_get("doc", "$.rows", "array<variant>")
        one = F.struct(F.lit(0).cast("int").alias("pos"), F.lit(None).cast("variant").alias("row"), F.when(F.col("doc").isNull(), "invalid_json").otherwise("no_rows").alias("reason"))
        each = F.transform(many, lambda x, i: F.struct(i.alias("pos"), x.alias("row"), F.lit(None).cast("string").alias("reason")))
        parsed = parsed.select("file", F.explode(F.when(many.isNull(), F.array(one)).otherwise(each)).alias("e")).select("file", F.col("e.pos").cast("bigint").alias("place"), F.col("e.row").alias("doc"), "e.reason")
    else:
        parsed = parsed.select("file", "place", "doc", F.when(F.col("doc").isNull(), "invalid_json").alias("reason"))
    data = F.try_variant_get("doc", "$.data", "variant")
    is_object = F.coalesce(kind_of(data) == "object", F.lit(False))
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(~is_object, "data_is_no_object").when(F.coalesce(F.try_variant_get(data, "$.span_id", "string"), F.lit("")) == "", "missing_span_id")
    stamp = F.coalesce(F.try_variant_get("doc", "$.timestamp", "string"), F.when(is_object, F.try_variant_get(data, "$.timestamp", "string")))
    return parsed.select("file", "place", reason.alias("reason"), F.when(is_object, F.try_variant_get(data, "$", "map<string,variant>")).alias("attributes"), stamp.alias("stamp"))


def read_rows(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """ROWS of captures, one a file or, with `lines`, one span a line. A capture is read whole by one task; large ones should have a span a line."""
    text = spark.read.text(path, wholetext=not lines)
    return rows_of(text.select(F.col("_metadata.file_path").alias("file"), (F.monotonically_increasing_id() if lines else F.lit(0)).cast("bigint").alias("place"), "value").where(F.trim("value") != "" if lines else F.lit(True)), lines)


def spans_of(rows: DataFrame) -> DataFrame:
    """Spans of the rows without a reason. A declared field of another type is not emitted: it is null, and an open attribute of its own kind."""
    good = rows.where("reason IS NULL")
    value = lambda name: F.element_at("attributes", F.lit(name))

    def declared(name: str, column: str, kind: str) -> Column:
        if column == "start_ns":
            return F.coalesce(F.unix_micros(F.try_to_timestamp(F.col("stamp"))) * 1000, F.lit(0)).alias(column)
        own = F.try_variant_get(value(name), "$", kind)
        if kind == "bigint":  # whole numbers only
            own = F.when(F.try_variant_get(value(name), "$", "double") == own.cast("double"), own)
        return F.when(kind_of(value(name)) == DECLARED[kind], own).alias(column)

    kinds = F.create_map(*(F.lit(x) for n, _, k in FIELDS for x in (n, DECLARED[k])))
    broken = lambda k, v: k.isin(*(n for n, _, t in FIELDS if t == "bigint")) & (F.try_variant_get(v, "$", "double") % 1 != 0)
    taken = lambda k, v: (k == "timestamp") | (F.coalesce(F.element_at(kinds, k) == kind_of(v), F.lit(False)) & ~F.coalesce(broken(k, v), F.lit(False)))
    rest = F.map_filter("attributes", lambda k, v: (kind_of(v) != "null") & ~taken(k, v))
    return as_spans(good.select(*(declared(*f) for f in FIELDS), F.transform_values(rest, lambda _, v: tagged(v)).alias("extra")))


def refused(rows: DataFrame) -> DataFrame:
    """file, place and reason of what holds no span: invalid_json, no_rows, data_is_no_object or missing_span_id."""
    return rows.where("reason IS NOT NULL").select("file", "place", "reason")


def field_kinds(rows: DataFrame) -> DataFrame:
    """key, kind, rows and state of every attribute: `mixed` if it has several kinds, `verified` or `mismatched` if declared, else `open`."""
    pairs = rows.where("attributes IS NOT NULL").select(F.explode("attributes").alias("key", "value")).select("key", kind_of(F.col("value")).alias("kind"))
    counted = pairs.groupBy("key", "kind").agg(F.count("*").alias("rows"))
    several = counted.where("kind <> 'null'").groupBy(F.col("key").alias("of")).agg((F.count("*") > 1).alias("several"))
    declared = F.element_at(F.create_map(*(F.lit(x) for n, _, k in FIELDS for x in (n, DECLARED[k]))), F.col("key"))
    state = F.when(F.col("several"), "mixed").when(declared.isNull(), "open").when((declared == F.col("kind")) | (F.col("kind") == "null"), "verified").otherwise("mismatched")
    return counted.join(several, F.col("key") == F.col("of"), "left").select("key", "kind", "rows", state.alias("state"))
