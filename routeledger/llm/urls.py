"""URL filters with redirect equivalence.

A page's own rule decides: of all that fit, the longest. A page without one follows its aliases: pages and targets
that redirects (`meta refresh`, or a table of them) and canonical links connect form components, and a component with
a blocked member blocks all members that no rule allows. A rule that allows a page always keeps it. Everything is
DataFrame functions; components are found by distributed label propagation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeledger.llm.components import components
from routeledger.llm.shared import needs

#: The rules of the contract of op3, as host, path and verdict.
CONTRACT_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest(url: Column) -> Column:
    """What follows the first `://`; empty if there is none."""
    return F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)


def host_of(after: Column) -> Column:
    return F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(after: Column) -> Column:
    return F.regexp_extract(after, r"^[^/?#]*(/[^?#]*)", 1)


def node_of(after: Column) -> Column:
    """The name under which a URL is linked: without scheme and fragment, its host in lower case; null if it has no host."""
    host = host_of(after)
    return F.when(host != "", F.concat(host, F.regexp_extract(after, r"^[^/?#]*([^#]*)", 1)))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a table."""
    each = [F.struct(*(F.lit(x).alias(n) for x, n in zip(r, ("host", "path", "verdict"), strict=True))) for r in rules]
    none = "cast(array() as array<struct<host: string, path: string, verdict: string>>)"
    return spark.range(1).select(F.explode(F.array(*each) if each else F.expr(none)).alias("r")).select("r.*")


def with_rule(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Add `rule` and `ruled`, those of the longest rule that fits `host` and `path`, or nulls.

    The suffixes of the different hosts are hash-joined with the rules' hosts; what remains of a host's rules, those of its own
    suffixes, meets each of its rows. Of rules of one length the greatest by host, path and verdict counts.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = df.select("host").where("host <> ''").distinct().select(F.col("host").alias("of"), F.explode(suffixes).alias("suffix"))
    size = F.length(F.concat(rules["host"], rules["path"]))
    fit = hosts.join(rules, hosts["suffix"] == rules["host"]).groupBy("of").agg(
        F.collect_set(F.struct(size.alias("size"), rules["host"].alias("host"), rules["path"].alias("path"), rules["verdict"].alias("verdict"))).alias("fit")
    )
    met = df.join(fit, df["host"] == fit["of"], "left")
    best = F.array_max(F.filter("fit", lambda r: met["path"].startswith(r["path"])))
    return met.withColumn("_best", best).select(*(met[c] for c in df.columns), F.concat("_best.host", "_best.path").alias("rule"), F.col("_best.verdict").alias("ruled"))


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, with its `.` and `..` segments resolved; what follows them stays."""
    parts = F.split(path, "/", -1)
    none = F.expr("cast(array() as array<string>)")

    def step(acc: Column, part: Column) -> Column:
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", acc).otherwise(F.concat(acc, F.array(part)))

    joined = F.array_join(F.aggregate(parts, none, step), "/")
    # A last segment of dots names a folder.
    return F.when(path.rlike(r"/\.\.?$"), F.concat(joined, F.lit("/"))).otherwise(joined)


def target(link: Column, after: Column) -> Column:
    """The node of a link found on a page whose URL has `after` behind its scheme: absolute, or relative to scheme, host, folder
    or page. Links of other schemes (`mailto:`), to a part of the page itself and empty ones have none."""
    host, path = host_of(after), F.when(path_of(after) == "", "/").otherwise(path_of(after))
    whole = F.regexp_extract(link, r"^[^?#]*", 0)
    own = F.when(link.startswith("/"), whole).otherwise(F.concat(F.regexp_extract(path, r"^(.*/)", 1), whole))
    behind = F.regexp_extract(link, r"^[^?#]*([^#]*)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), node_of(rest(link)))
        .when(link.startswith("//"), node_of(F.substring(link, 3, 1 << 30)))
        .when((link == "") | link.startswith("#") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (host == ""), None)
        .when(link.startswith("?"), node_of(F.concat(host, path, link)))
        .otherwise(node_of(F.concat(host, without_dots(own), behind)))
    )


def links(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes: all canonical links and meta refreshes of each page."""
    tag = lambda name, key, value: rf"(?i)<{name}\s[^>]*{key}\s*=\s*[\"']?{value}[^>]*>"
    every = lambda tags, link: F.transform(F.regexp_extract_all("html", F.lit(tags), F.lit(0)), lambda x: F.regexp_extract(x, link, 1))
    found = pages.where(F.col("html").rlike(r"(?i)(canonical|refresh)") & (F.col("host") != "")).select(
        rest(F.col("url")).alias("after"),
        F.explode(F.concat(
            every(tag("link", "rel", "canonical"), r"(?i)href\s*=\s*[\"']?([^\"'\s>]+)"),
            every(tag("meta", "http-equiv", "refresh"), r"(?i)url\s*=\s*[\"']?([^\"'\s>;]+)"),
        )).alias("link"),
    )
    return found.select(node_of(F.col("after")).alias("a"), target(F.col("link"), F.col("after")).alias("b")).where("a <> b")


def filter_urls(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """Judge pages (page_id, url, html): page_id, host, path, rule, verdict.

    rules has host, path and verdict (block or allow). redirects, if given, has from_url and to_url. A null url, or one without `://`, has empty host and path, no rule
    and no aliases, and is allowed; null html has no links. Repeated pages are judged each; an empty table gives none.
    """
    read = needs(pages, "page_id", "url", "html")
    rules = rule_table(pages.sparkSession, rules) if isinstance(rules, list) else needs(rules, "host", "path", "verdict").dropna()
    after = F.coalesce(rest(F.col("url")), F.lit(""))
    own = read.withColumn("host", host_of(after)).withColumn("path", path_of(after))
    edges, read = links(own), with_rule(own, rules)
    if redirects is not None:
        ends = needs(redirects, "from_url", "to_url")
        edges = edges.union(ends.select(node_of(rest(F.col("from_url"))), node_of(rest(F.col("to_url")))).where("from_url <> to_url"))
    judged = read.select("page_id", "url", "host", "path", "rule", "ruled")
    if edges.isEmpty():
        judged = judged.withColumn("blocked", F.lit(False))
    else:
        classes = components(edges)
        at = with_rule(classes.withColumn("host", host_of(F.col("node"))).withColumn("path", path_of(F.col("node"))), rules)
        bad = at.where("ruled = 'block'").select("component").distinct()
        bad = classes.join(bad, "component", "left_semi").select(F.col("node").alias("alias"), F.lit(True).alias("hit"))
        judged = judged.withColumn("alias", node_of(rest(F.col("url")))).join(bad, "alias", "left").withColumn("blocked", F.coalesce("hit", F.lit(False)))
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
    )


def _sql_host(after: str) -> str:
    return f"translate(regexp_extract({after}, '^[^/?#]*'), '{UPPER}', '{LOWER}')"


def _sql_node(after: str) -> str:
    return f"CASE WHEN {_sql_host(after)} <> '' THEN {_sql_host(after)} || regexp_extract({after}, '^[^/?#]*([^#]*)', 1) END"


def _sql_rule(value: str) -> str:
    whens = sorted(CONTRACT_RULES, key=lambda r: -len(r[0] + r[1]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v if value == 'ruled' else h + p}'" for h, p, v in whens) + " END"


ORACLE = f"""
WITH RECURSIVE p AS (SELECT page_id, html, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
q AS (SELECT page_id, html, rest, {_sql_host('rest')} AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM p),
raw AS (SELECT {_sql_node('rest')} AS a, host, unnest([
    regexp_extract(regexp_extract(html, '(?i)<link\\s[^>]*rel\\s*=\\s*["'']?canonical[^>]*>'), '(?i)href\\s*=\\s*["'']?([^"''\\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?i)<meta\\s[^>]*http-equiv\\s*=\\s*["'']?refresh[^>]*>'), '(?i)url\\s*=\\s*["'']?([^"''\\s>;]+)', 1)]) AS link
  FROM q WHERE host <> ''),
ends AS (SELECT a, CASE WHEN contains(link, '://') THEN regexp_extract(link, '(?s)^.*?://(.*)$', 1)
    WHEN starts_with(link, '//') THEN substring(link, 3) WHEN starts_with(link, '/') THEN host || link ELSE '' END AS t FROM raw),
e AS (SELECT a, {_sql_node('t')} AS b FROM ends), both_ways AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(node, root) AS (SELECT a, a FROM both_ways UNION SELECT both_ways.b, reach.root FROM reach JOIN both_ways ON reach.node = both_ways.a),
nodes AS (SELECT DISTINCT node, {_sql_host('node')} AS host, regexp_extract(node, '^[^/?#]*(/[^?#]*)', 1) AS path FROM reach),
bad AS (SELECT DISTINCT reach.root AS node FROM reach JOIN nodes USING (node) WHERE {_sql_rule('ruled')} = 'block')
SELECT page_id, host, path, {_sql_rule('rule')} AS rule,
  coalesce({_sql_rule('ruled')}, CASE WHEN {_sql_node('rest')} IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM q
"""
