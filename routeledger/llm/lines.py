"""Line dedup by site-relative frequency.

For each host, the pages that contain a line are divided by all pages of the host; a line over the boilerplate ratio is
dropped from every page of that host. Lines travel as 64-bit hashes and are counted before the shuffle; the text itself
moves at most once, to meet its own page's dropped lines. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeledger.llm.shared import needs, written

#: A line is boilerplate if it is on more than this share of a host's pages, and on so many pages at least.
RATIO, LEAST_PAGES = 0.02, 5


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, h and pages of every line over the ratio; pages has host and text. A line counts once for each page."""
    own = F.array_distinct(F.transform(F.filter(lines_of(F.col("text")), lambda x: F.trim(x) != ""), line_hash))
    counts = pages.select("host", F.explode(own).alias("h")).groupBy("host", "h").agg(F.count("*").alias("pages"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total")).withColumnRenamed("host", "of")
    return (
        counts.where(F.col("pages") >= least_pages)
        .join(totals, F.col("host").eqNullSafe(F.col("of")))
        .where(F.col("pages") > F.col("total") * F.lit(ratio))
        .select("host", "h", "pages")
    )


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """docs with `text` less its boilerplate lines, and n_lines and n_dropped.

    Lines are compared without spaces at their ends; blank ones are kept and never counted. A null host is a host; a null
    text stays null, has no lines and counts as a page. Repeated rows are pages each. Other columns are kept as they are, but for
    those named n_lines or n_dropped, which give way. An empty table gives no rows.
    """
    pages = needs(docs, host, "text").toDF("host", "text")
    # Read back from a table, boilerplate has a size that Spark knows, and a shuffle of its own where it is large.
    bad = written(boilerplate(pages, ratio, least_pages)).select(F.col("host").alias("of"), F.col("h").alias("bad"))
    own = docs.select(F.col("doc_id").alias("id"), F.col(host).alias("host"), F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), line_hash))).alias("h"))
    hits = own.join(bad, (own["h"] == bad["bad"]) & own["host"].eqNullSafe(bad["of"]), "left_semi")
    hits = hits.groupBy("id", "host").agg(F.collect_set("h").alias("hits")).withColumnRenamed("host", "of")  # of one page each
    met = docs.join(hits.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(hits["id"]) & docs[host].eqNullSafe(hits["of"]), "left")
    text, mine = docs["text"], hits["hits"]
    lines = lines_of(text)
    kept = F.filter(lines, lambda x: ~F.array_contains(mine, line_hash(x)) | (F.trim(x) == ""))
    n = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    changed = F.when(mine.isNull(), text).otherwise(F.array_join(kept, "\n")).alias("text")
    return met.select(
        *(changed if c == "text" else docs[c] for c in docs.columns if c not in ("n_lines", "n_dropped")),
        n.alias("n_lines"), F.when(mine.isNull(), 0).otherwise(n - F.size(kept)).cast("long").alias("n_dropped"),
    )


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
own AS (SELECT DISTINCT r, source, trim(l) AS line FROM (SELECT r, source, unnest(lines) AS l FROM d) WHERE trim(l) <> ''),
totals AS (SELECT source, count(*) AS total FROM d GROUP BY source),
bad AS (SELECT own.source, line FROM own JOIN totals ON own.source IS NOT DISTINCT FROM totals.source
  GROUP BY own.source, line, total HAVING count(*) >= {LEAST_PAGES} AND count(*) > total * {RATIO}::DOUBLE),
each_line AS (SELECT r, source, unnest(lines) AS l, unnest(range(1, len(lines) + 1)) AS k FROM d),
kept AS (SELECT e.r, string_agg(e.l, chr(10) ORDER BY e.k) AS text, count(*) AS n FROM each_line e
  ANTI JOIN bad ON bad.line = trim(e.l) AND bad.source IS NOT DISTINCT FROM e.source GROUP BY e.r)
SELECT doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(lines) END::BIGINT AS n_lines,
  CASE WHEN d.text IS NULL THEN 0 ELSE len(lines) - coalesce(kept.n, 0) END::BIGINT AS n_dropped,
  sha256(CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END) AS text_sha256
FROM d LEFT JOIN kept USING (r)
"""
