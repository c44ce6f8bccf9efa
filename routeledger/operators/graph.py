"""Rooted trees of spans: dedup, roots, orphans, cycles, edges and quality, for all traces at once.

Everything is keyed by trace. `build` shuffles spans once, by trace_id; duplicates, names and classes are columns, the spans of a
trace, whose number is bounded, become one row of arrays, and a tree walk gives the arrays of places and digests beside them.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeledger.functions import names
from routeledger.functions.names import DEFAULT, Config
from routeledger.sources.spans import FIELDS, dealt, tag

MAX_SPANS = 10_000
SYNTHETIC = "synthetic-root"


class Graph(NamedTuple):
    """traces: trace_id, root, quality, warnings, counts; nodes: one row for each span; edges: trace_id, from, to, type.

    Of a node, `up` is its parent in the tree, `order` and `depth` its place in a walk from the root that takes siblings by digest and
    span id, null if the root does not reach it; `pre` and `last` number the walk through all trees of the trace: the nodes below one
    are those from pre + 1 to last. `digest` is that of its subtree.
    """

    traces: DataFrame
    nodes: DataFrame
    edges: DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write df to the folder in spark.checkpoint.dir and go on from there, pruned by column as Parquet, until the driver ends.

    Without that setting, as in tests in local mode, Spark's own cache holds it.
    """
    folder = df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    if getattr(spark.sparkContext, "_jsc", None) is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def usable(spans: DataFrame, most: int = MAX_SPANS) -> tuple[DataFrame, DataFrame]:
    """Rows with a span_id of traces that are not too large, and a row of counts for each trace. Rows without a trace_id are of no trace."""
    spans = spans.where("trace_id IS NOT NULL")
    counts = spans.groupBy("trace_id").agg(
        F.count("*").alias("rows"), F.count("span_id").alias("with_id"), F.max("release").alias("release"), F.max("environment").alias("environment")
    )
    state = F.when(F.col("with_id") == 0, "empty").when(F.col("with_id") > most, "too_large").otherwise("ok")
    counts = counts.select("trace_id", "release", "environment", (F.col("rows") - F.col("with_id")).alias("rejected_rows"), state.alias("state"))
    # Counted in the partitions that the trees are built in: no join, and no shuffle but that by trace.
    good = dealt(spans).withColumn("_with_id", F.count("span_id").over(Window.partitionBy("trace_id"))).where(F.col("span_id").isNotNull() & (F.col("_with_id") <= most))
    return good.drop("_with_id"), counts


def dedup(spans: DataFrame) -> DataFrame:
    """One row for each span_id: the one with most values, ties by the row's hash. `conflict` marks rows of one id that
    differ in name, service, parent or kind, `merged` ids with several rows."""
    filled = sum((F.col(c).isNotNull().cast("int") for _, c, _ in FIELDS), F.coalesce(F.size("extra"), F.lit(0)))
    what = F.xxhash64(F.coalesce("name", F.lit("")), F.coalesce("service", F.lit("")), F.coalesce("parent_span_id", F.lit("")), F.coalesce("kind", F.lit("")))
    same = Window.partitionBy("trace_id", "span_id")
    best = same.orderBy(F.desc("_filled"), "_hash")
    hashed = spans.withColumn("_filled", filled).withColumn("_what", what).withColumn("_hash", F.xxhash64(*(c for _, c, _ in FIELDS)))
    marked = hashed.withColumn("conflict", F.min("_what").over(same) != F.max("_what").over(same)).withColumn("merged", F.count("*").over(same) > 1).withColumn("_rank", F.row_number().over(best))
    return marked.where("_rank = 1").drop("_filled", "_what", "_hash", "_rank")


def project(rows: DataFrame, config: Config = DEFAULT, unicode: bool = True) -> DataFrame:
    """Nodes: canonical label, classification, fingerprint attributes as JSON and all visible attributes by tagged value."""
    visible = [(n, c) for n, c, _ in FIELDS if n not in config.volatile]
    value = lambda n, c: F.lower(c) if n in config.caseless else F.col(c)
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), tag(c, value(n, c)).alias("value")) for n, c in visible))
    present = F.filter(pairs, lambda x: x["value"].isNotNull() & (x["value"] != "string:"))
    open_pairs = F.filter(F.map_entries(F.coalesce("extra", F.create_map().cast("map<string,string>"))), lambda x: ~x["key"].isin(*config.volatile, *(n for n, _ in visible)) & (x["value"] != "string:"))
    identity = sorted((n, c) for n, c in visible if n in config.identity)
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    entries = F.filter(F.array(*(F.when(value(n, c).isNotNull() & (value(n, c) != ""), F.struct(F.lit(f'"{n}"').alias("k"), quoted(value(n, c)).alias("v"))) for n, c in identity)), lambda x: x.isNotNull())
    return rows.select(
        "trace_id", "span_id", F.nullif("parent_span_id", F.lit("")).alias("parent_id"), "conflict", "merged",
        F.coalesce("name", F.lit("")).alias("name"), names.normalised_name(F.coalesce("name", F.lit("")), config, unicode).alias("label"),
        F.coalesce("service", F.lit("unknown")).alias("service"), F.nullif("kind", F.lit("")).alias("kind"), "operation", "status_code",
        F.coalesce("start_ns", F.lit(0)).alias("start_ns"), F.coalesce("duration_ns", F.lit(0)).alias("duration_ns"),
        names.side_effect(F.col("side_effect")).alias("side_effect"), F.lower(names.filled(F.col("data_domain"))).alias("data_domain"),
        F.when(names.filled(F.col("tool")).isNotNull(), names.normalised_name(F.col("tool"), config, unicode)).alias("tool"),
        names.non_negative_integer(F.col("retry_number")).alias("retry_number"), "release", "environment", "input_tokens", "output_tokens",
        F.map_from_entries(F.concat(present, open_pairs)).alias("attributes"), entries.alias("entries"), F.lit(False).alias("synthetic"),
    )


def json_text(c: Column) -> Column:
    """A string or number as JSON; null as `null`. Control characters have lower-case escapes."""
    text = F.to_json(F.array(c))
    return F.coalesce(F.when(c.isNotNull(), text.substr(F.lit(2), F.length(text) - 2)), F.lit("null"))


def entries_json(left: str, right: str, between: str) -> Column:
    """Fingerprint attributes as JSON: of an object, or of an array of pairs."""
    entries = F.coalesce("entries", F.array().cast("array<struct<k: string, v: string>>"))
    start, end = ("[", "]") if between == "," else ("", "")
    return F.concat(F.lit(left), F.array_join(F.transform(entries, lambda e: F.concat(F.lit(start), e["k"], F.lit(between), e["v"], F.lit(end))), ","), F.lit(right))


def node_label() -> Column:
    """What identifies a node wherever it stands: a JSON array of its eight parts."""
    parts = [json_text(F.col(c)) for c in ("label", "service", "kind", "side_effect", "tool", "data_domain", "retry_number")]
    return F.concat(F.lit("["), F.concat_ws(",", *parts, entries_json("[", "]", ",")), F.lit("]"))


def utf16_length(text: Column) -> Column:
    return F.length(text) + F.length(F.regexp_replace(text, r"[\x{0}-\x{FFFF}]", ""))


#: The label of a generated root, with its length.
SYNTHETIC_TEXT = f'["{SYNTHETIC}","unknown",null,"none",null,null,null,[]]'
PLACED = "up: array<string>, depth: array<int>, order: array<bigint>, pre: array<bigint>, last: array<bigint>, digest: array<string>, orphan: array<boolean>, on_cycle: array<boolean>"
TREE = f"struct<root: string, generated: boolean, {PLACED}>"


def on_cycles(parent: list[int]) -> list[bool]:
    """Whether each node is on a cycle of parent pointers; -1 is no parent."""
    state, out = [0] * len(parent), [False] * len(parent)
    for start in range(len(parent)):
        path, i = [], start
        while i >= 0 and state[i] == 0:
            state[i] = 1
            path.append(i)
            i = parent[i]
        if i >= 0 and state[i] == 1:
            for k in path[path.index(i) :]:
                out[k] = True
        for k in path:
            state[k] = 2
    return out


def walked(ids: list, parents: list, labels: list, texts: list, root_name: str | None) -> tuple:
    """The tree of one trace, as a TREE: a walk down for the order of nodes, up for digests and sizes, and down again for places."""
    n, at = len(ids), {s: i for i, s in enumerate(ids)}
    free = [i for i in range(n) if parents[i] is None]
    named = [i for i in free if labels[i] == root_name]
    root = min(named, key=lambda i: ids[i]) if named else free[0] if len(free) == 1 else n
    parent = [-1 if p is None else at.get(p, -1) for p in parents]
    cyclic = on_cycles(parent)
    # A child on a cycle, or without a parent that is there, hangs off a generated root if there is one.
    up = [n if root == n and (p < 0 or c) else -1 if c else p for p, c in zip(parent, cyclic, strict=True)] + [-1]
    below: list[list[int]] = [[] for _ in range(n + 1)]
    for i in range(n):
        if up[i] >= 0:
            below[up[i]].append(i)
    tops = [root, *(i for i in range(n) if up[i] < 0 and i != root)]
    down = list(tops)
    for i in down:
        down += below[i]
    digest, size = [""] * (n + 1), [1] * (n + 1)
    texts = [*texts, f"{len(SYNTHETIC_TEXT)}:{SYNTHETIC_TEXT}"]
    names_ = [*ids, SYNTHETIC]
    for i in reversed(down):
        below[i].sort(key=lambda k: (digest[k], names_[k]))
        digest[i] = hashlib.sha256("|".join([texts[i], *(digest[k] for k in below[i])]).encode("utf-8", "surrogatepass")).hexdigest()
        size[i] = 1 + sum(size[k] for k in below[i])
    depth, pre, free_place = [0] * (n + 1), [0] * (n + 1), 0
    for i in tops:
        pre[i] = free_place
        free_place += size[i]
    for i in down:
        place = pre[i] + 1
        for k in below[i]:
            pre[k], depth[k] = place, depth[i] + 1
            place += size[k]
    inside = [pre[i] < size[root] for i in range(n)]
    made = root == n  # the generated root comes last
    m = n + made
    return (
        names_[root], made, [None if u < 0 else names_[u] for u in up[:m]],
        [d if x else None for d, x in zip(depth, inside, strict=False)] + [0] * made, [p if x else None for p, x in zip(pre, inside, strict=False)] + [0] * made,
        pre[:m], [p + s - 1 for p, s in zip(pre[:m], size[:m], strict=True)], digest[:m], [p is not None and k < 0 for p, k in zip(parents, parent, strict=True)] + [False] * made, cyclic + [False] * made,
    )


def build(spans: DataFrame, root_name: str | None = None, config: Config = DEFAULT, unicode: bool = True, most: int = MAX_SPANS) -> Graph:
    """The trees of all traces. Traces without usable rows, or with too many, have a row in `traces` with that quality."""
    rows, counts = usable(spans, most)
    nodes = project(dedup(rows), config, unicode).withColumn("text", node_label())
    nodes = nodes.withColumn("text", F.concat(utf16_length(F.col("text")).cast("string"), F.lit(":"), "text"))

    @F.pandas_udf(TREE)
    def tree(ids: pd.Series, parents: pd.Series, labels: pd.Series, texts: pd.Series) -> pd.DataFrame:
        found = [walked(list(i), list(p), list(x), list(t), root_name) for i, p, x, t in zip(ids, parents, labels, texts, strict=True)]
        return pd.DataFrame(found, columns=[c.split(":")[0].strip() for c in TREE[7:-1].split(", ")])

    # At most `most` spans for each trace.
    packed = nodes.groupBy("trace_id").agg(F.collect_list(F.struct(*(c for c in nodes.columns if c != "trace_id"))).alias("n"))
    packed = packed.withColumn("t", tree(*(F.col("n")[c] for c in ("span_id", "parent_id", "label", "text"))))
    places = [c.split(":")[0] for c in PLACED.split(", ")]
    served = F.transform(F.filter("n", lambda x: (x["kind"] == "Server") & x["parent_id"].isNotNull()), lambda x: x["parent_id"])
    packed = packed.withColumn("served", F.map_from_arrays(F.array_distinct(served), F.transform(F.array_distinct(served), lambda x: F.lit(True))))
    known = {"span_id": SYNTHETIC, "name": SYNTHETIC, "label": SYNTHETIC, "service": "unknown", "side_effect": "none", "duration_ns": 0, "synthetic": True}
    top = F.struct(*(F.lit(known.get(f.name)).cast(f.dataType).alias(f.name) for f in nodes.schema if f.name != "trace_id"))
    every = F.concat("n", F.when(F.col("t.generated"), F.array(top)).otherwise(F.array().cast(packed.schema["n"].dataType)))
    each = packed.select("trace_id", "t.root", "t.generated", "served", F.explode(F.arrays_zip(every.alias("n"), *(F.col(f"t.{c}").alias(c) for c in places))).alias("x"))
    watched = F.coalesce((F.col("x.n.kind") == "Client") & ~F.col("x.n.side_effect").isin("none", "unknown"), F.lit(False))
    spans_of = [F.col(f"x.n.{c}").alias(c) for c in nodes.columns if c not in ("trace_id", "text")]
    unserved = watched & F.element_at("served", F.col("x.n.span_id")).isNull()
    every = cut(each.select("trace_id", "root", "generated", *spans_of, *(F.col(f"x.{c}").alias(c) for c in places), unserved.alias("unserved")))
    real = every.where("NOT synthetic")
    found = real.groupBy("trace_id").agg(
        F.first("root").alias("root"), F.first("generated").alias("generated"), F.count("*").alias("spans"),
        *(F.array_sort(F.collect_set(F.when(c, F.col("span_id")))).alias(n) for n, c in (
            ("conflicts", F.col("conflict")), ("orphans", F.col("orphan")), ("cycle", F.col("on_cycle")), ("unserved", F.col("unserved")),
            ("merged", F.col("merged") & ~F.col("conflict")), ("parentless", F.col("parent_id").isNull()))),
        F.max((F.col("parent_id").isNull() & (F.col("label") == F.lit(root_name))).cast("int")).alias("named"),
    )
    some = lambda c: F.size(c) > 0
    quality = F.when(some("conflicts") | some("cycle"), "inconsistent").when(some("orphans") | F.col("generated"), "incomplete").otherwise("complete")
    warning = lambda kind, ids, when=None: F.struct(F.lit(kind).alias("kind"), (ids if when is None else F.when(when, ids).otherwise(F.array().cast("array<string>"))).alias("span_ids"))
    warnings = F.filter(F.array(
        # Kinds of warnings.
        warning("multiple_roots", F.col("parentless"), F.size("parentless") > 1), warning("synthetic_root", F.array("root"), F.col("generated")),
        warning("orphan_span", F.col("orphans")), warning("cycle_detected", F.col("cycle")),
        warning("duplicate_spans_merged", F.col("merged")), warning("conflicting_duplicate_spans", F.col("conflicts")),
        warning("client_span_without_server_span", F.col("unserved")),
        warning("missing_root_selector_match", F.array("root"), F.lit(root_name is not None) & (F.coalesce("named", F.lit(0)) == 0)),
    ), lambda w: F.size(w["span_ids"]) > 0)
    traces = counts.join(found.select("trace_id", "root", "generated", "spans", quality.alias("quality"), warnings.alias("warnings")), "trace_id", "left")
    traces = traces.select("trace_id", "release", "environment", "rejected_rows", "root", F.coalesce("generated", F.lit(False)).alias("generated"), F.coalesce("spans", F.lit(0)).alias("spans"), F.coalesce("quality", "state").alias("quality"), "warnings")
    edges = every.where("up IS NOT NULL").select("trace_id", F.col("up").alias("from"), F.col("span_id").alias("to"), F.lit("parent").alias("type"))
    return Graph(traces, every.drop("root", "generated"), edges)


def per_trace(nodes: DataFrame, columns: dict[str, Column], walk, returns: str) -> DataFrame:
    """Rows of struct `returns` of every trace, of which there are at most MAX_SPANS nodes: `walk` takes lists of its nodes' columns in
    the order of `pre`, and gives a list of tuples."""

    @F.pandas_udf(f"array<{returns}>")
    def run(x: pd.DataFrame) -> pd.Series:
        return pd.Series([[tuple(r) for r in walk(*map(list, row))] for row in x.itertuples(index=False)])

    own = dealt(nodes.select("trace_id", "pre", *(c.alias(f"_{n}") for n, c in columns.items())))
    packed = own.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("pre", *(F.col(f"_{n}").alias(n) for n in columns)))).alias("n"))
    return packed.select("trace_id", F.explode(run(F.struct(*(F.col("n")[n].alias(n) for n in columns)))).alias("x")).select("trace_id", "x.*")
