"""Personal data: fixed patterns, and identifiers that bootstrapped contexts discover.

Matches of the fixed patterns are the seeds, and so are long hexadecimal keys. Other words with a digit are candidates. Seeds and
candidates are instances; the two words before an instance, the two after it, and the ones on either side of it are its lexical
patterns. Patterns and instances form a bipartite graph, which is scored in rounds: a pattern's confidence is the mean score of its
different instances, and a pattern of high confidence whose instances' scores add up to enough lifts its instances to its confidence.
What one round finds counts for the patterns of the next, so discovered identifiers induce patterns in turn. Candidates and keys in
confident patterns are added to the fixed patterns' matches.
All of it is DataFrame functions. Places come from sums of sums over blocks of a text's words and matches, so that a text of
n of them costs about n * sqrt(n) small steps, and no list is copied for each of its members.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeledger.llm.shared import needs, written

#: The patterns of the contract, in its order. Quantifiers that never give back are possessive, and what
#: cannot begin within a run of its own letters looks behind, so that long runs take linear time; matches are the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
#: The kind under which discovered identifiers are listed, after the others.
FOUND = "id"
KINDS = [*PATTERNS, FOUND]
#: Words with a digit or an at sign: instances are among them, and hold or begin every match of the fixed patterns.
MARKED = r"(?:\G|(?<!\S))[^\s0-9@]*+[0-9@]\S*+"
#: A key, which is a seed though no match of the fixed patterns.
KEY = r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,128}$"
#: Candidates have so many characters at least.
LEAST_LENGTH = 6
#: Rounds of scoring at most; a pattern's least confidence, and the least sum of its instances' scores.
ROUNDS, CONFIDENCE, SUPPORT = 6, 0.8, 5
SPAN = "array<struct<start: long, kind: int, end: long>>"
#: Signs around a word that are not its own.
AROUND = (r"^[(\[{\"'«“<]*", r"[)\]}\"'»”>.,;:!?#$%&*]*$")


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    each = F.split(F.reverse(number), "")

    def add(x: Column, i: Column) -> Column:
        d = x.cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(each, add), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """Whether a match of a pattern holds."""
    n = F.length(digits(match))
    if kind == "ip":
        return F.forall(F.split(F.regexp_replace(match, r"(?<![0-9])0+(?=[0-9])", ""), r"\."), lambda part: (F.length(part) <= 3) & (F.coalesce(F.substring(part, 1, 3).cast("int"), F.lit(256)) <= 255))
    if kind == "card":
        return (n >= 12) & (n <= 19) & F.when((n >= 12) & (n <= 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: within a lambda an expression would be computed for each item."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocked(items: Column) -> Column:
    """An array in blocks of about the square root of its size; none of an empty one. `items` is a name or bound by `let`."""
    width = F.greatest(F.ceil(F.sqrt(F.size(items))).cast("int"), F.lit(1))
    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), width)
    return F.filter(F.transform(starts, lambda at: F.slice(items, at, width)), lambda part: F.size(part) > 0)


def summed(items: Column, size) -> Column:
    """struct(item, before) for each item of an array: `before` adds up the sizes of the items before it."""
    add = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda acc, x: acc + size(x))

    def within(part: Column, start: Column) -> Column:
        return F.transform(part["part"], lambda x, i: F.struct(x.alias("item"), (start + add(F.slice(part["part"], 1, i))).alias("before")))

    def placed(parts: Column) -> Column:
        upto = lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0).cast("long"), lambda acc, p: acc + p["sum"])
        return F.flatten(F.transform(parts, lambda part, i: let(upto(i), lambda start: within(part, start))))

    return let(F.transform(let(items, blocked), lambda part: F.struct(part.alias("part"), add(part).alias("sum"))), placed)


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern in order, with the places where they begin, in code points: match, start and i."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    gap = lambda gaps, i: F.length(F.element_at(gaps, (i + 1).cast("int")))
    pairs = let(between, lambda gaps: F.transform(found, lambda m, i: F.struct(m.alias("match"), gap(gaps, i).alias("gap"), i.alias("i"))))
    placed = summed(pairs, lambda x: x["gap"] + F.length(x["match"]))
    return F.transform(placed, lambda x: F.struct(x["item"]["match"].alias("match"), (x["before"] + x["item"]["gap"]).alias("start"), x["item"]["i"].alias("i")))


def spans_of(text: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    good = F.filter(located(text, PATTERNS[kind]), lambda x: valid(kind, x["match"]))
    spans = F.transform(good, lambda x: F.struct(x["start"].cast("long").alias("start"), F.lit(rank).alias("kind"), (x["start"] + F.length(x["match"])).cast("long").alias("end")))
    return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.expr(f"cast(array() as {SPAN})"))


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def met_spans(spans: Column) -> Column:
    """Sorted spans in blocks with the places that a block reaches from and to."""
    return F.transform(let(spans, blocked), lambda part: F.struct(
        part.alias("part"), F.element_at(part, 1)["start"].alias("lo"), F.aggregate(part, F.lit(0).cast("long"), lambda acc, s: F.greatest(acc, s["end"])).alias("hi"),
    ))


def first_met(blocks: Column, start: Column, end: Column) -> Column:
    """The first of the spans that overlap a place, or null."""
    near = F.filter(blocks, lambda b: (b["lo"] < end) & (b["hi"] > start))
    return F.get(F.filter(F.flatten(F.transform(near, lambda b: b["part"])), lambda s: (s["start"] < end) & (s["end"] > start)), F.lit(0))


def instances(texts: DataFrame) -> DataFrame:
    """row, start, end, instance, patterns (an array of hashes), seed and base of every instance of texts (row, text, base): base spans,
    keys, and other words with a digit that meet no base span. Of base spans that begin in one word the first counts."""
    text, gaps_of = F.col("text"), F.split("text", MARKED, -1)
    found = F.regexp_extract_all(text, F.lit(MARKED), F.lit(0))
    # Marked words with the text between the one before and it.
    pairs = let(gaps_of, lambda gaps: F.transform(found, lambda m, i: F.struct(m.alias("match"), F.element_at(gaps, (i + 1).cast("int")).alias("gap"), i.alias("i"))))
    seen = texts.where(text.rlike("[0-9@]")).select("row", "text", "base", F.element_at(gaps_of, -1).alias("tail"), pairs.alias("marked"))

    def judged(blocks: Column) -> Column:
        def one(x: Column) -> Column:
            start = x["before"] + F.length(x["item"]["gap"])
            return F.struct(x["item"]["match"].alias("match"), x["item"]["i"].alias("i"), start.alias("start"), first_met(blocks, start, start + F.length(x["item"]["match"])).alias("span"))

        return F.transform(summed(F.col("marked"), lambda x: F.length(x["gap"]) + F.length(x["match"])), one)

    # A word in which a base span only goes on is no instance of its own.
    own = lambda x: F.when(x["span"].isNull(), x["match"].rlike("[0-9]")).otherwise(x["span"]["start"] >= x["start"])

    def described(x: Column) -> Column:
        word, base = x["match"], x["span"].isNotNull()
        head, tail = (F.length(F.regexp_extract(word, around, 0)) for around in AROUND)
        start = F.when(base, x["span"]["start"]).otherwise(x["start"] + head)
        end = F.when(base, x["span"]["end"]).otherwise(x["start"] + F.length(word) - tail)
        inside = word.substr((head + 1).cast("int"), (F.length(word) - head - tail).cast("int"))
        value = F.when(base, text.substr((start + 1).cast("int"), (end - start).cast("int"))).otherwise(inside)
        return F.struct(x["i"].alias("i"), start.alias("start"), end.alias("end"), value.alias("value"), base.alias("base"))

    long_enough = lambda x: x["base"] | (F.length(x["value"]) >= LEAST_LENGTH) & x["value"].rlike("[0-9]")

    def with_patterns(marked: Column) -> Column:
        """Two neighbours on a side lie within two marked words and the gaps beside them."""
        at = lambda i: F.get(marked, i.cast("int"))
        gap = lambda i: F.coalesce(at(i)["gap"], F.when(i == F.size(marked), F.col("tail")))

        def patterns(x: Column) -> Column:
            # Phones and cards may go on over several marked words.
            i, last = x["i"], x["i"] + F.greatest(F.size(F.filter(F.split(x["value"], r"\s+"), lambda w: w.rlike("[0-9@]"))) - 1, F.lit(0))
            left = F.lower(F.concat_ws("", at(i - 2)["match"], at(i - 1)["gap"], at(i - 1)["match"], at(i)["gap"]))
            right = F.lower(F.concat_ws("", gap(last + 1), at(last + 1)["match"], gap(last + 2), at(last + 2)["match"]))
            two, one = F.regexp_extract(left, r"(?<!\S)(\S++\s++\S++)\s*+$", 1), F.regexp_extract(left, r"(?<!\S)(\S++)\s*+$", 1)
            next_one, next_two = F.regexp_extract(right, r"^\s*+(\S++)", 1), F.regexp_extract(right, r"^\s*+(\S++\s++\S++)", 1)
            words = lambda t: F.regexp_replace(t, r"\s++", " ")
            key = lambda kind, *parts: F.when(reduce(and_, (p != "" for p in parts)), F.xxhash64(F.lit(kind), *map(words, parts)))
            return F.array_compact(F.array(key("before", two), key("around", one, next_one), key("after", next_two)))

        return F.transform("found", lambda x: F.struct(x.alias("x"), patterns(x).alias("patterns")))

    seen = seen.select("row", "text", "tail", "marked", let(met_spans(F.col("base")), judged).alias("judged"))
    seen = seen.select("row", "tail", "marked", F.filter(F.transform(F.filter("judged", own), described), long_enough).alias("found")).where(F.size("found") > 0)
    each = seen.select("row", F.explode(let(F.col("marked"), with_patterns)).alias("y")).select("row", "y.x", "y.patterns")
    value = F.col("x.value")
    return each.select("row", "x.start", "x.end", F.xxhash64(F.lower(value)).alias("instance"), "patterns", (F.col("x.base") | value.rlike(KEY)).alias("seed"), "x.base")


def confident_patterns(edges: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: float = SUPPORT) -> DataFrame:
    """Patterns of high confidence and support over the graph of patterns and instances: edges (pattern, instance, seed).

    Scores only rise, so patterns once confident stay so; rounds end when confidence does not change.
    """
    graph = edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    # A pattern of fewer different instances can't reach the support.
    able = graph.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("pattern")
    graph = written(graph.join(able, "pattern"))
    scores = graph.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    good, before = None, None
    for _ in range(rounds):
        scored = graph.join(scores, "instance").groupBy("pattern").agg(F.avg("score").alias("confidence"), F.sum("score").alias("support"))
        good = written(scored.where((F.col("confidence") >= confidence) & (F.col("support") >= support)))
        reached = good.agg(F.count("*"), F.round(F.sum("confidence"), 6)).first()
        if reached == before:
            break
        before = reached
        lifted = graph.join(good, "pattern").groupBy("instance").agg(F.max("confidence").alias("best"))
        own = graph.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("own"))
        scores = own.join(lifted, "instance", "left").select("instance", F.greatest("own", F.coalesce("best", F.lit(0.0))).alias("score"))
    return good.select("pattern")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (matches of the fixed patterns), base_sha256, spans (with discovered ones) and n_found (those).

    A null text counts as empty, and an empty one has no spans; long texts are searched whole. Repeated rows and rows without doc_id are
    judged each; other columns, whatever their names, are left out. An empty table gives no rows.
    """
    texts = needs(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = F.array_sort(F.concat(*(spans_of(F.col("text"), kind) for kind in PATTERNS)))
    # A row's number is fixed once it is written; it tells equal rows apart.
    found = written(texts.select("doc_id", "text", base.alias("base")).withColumn("row", F.monotonically_increasing_id()))
    seen = written(instances(found))
    good = confident_patterns(seen.select(F.explode("patterns").alias("pattern"), "instance", "seed"))
    told = seen.where(~F.col("base")).select("row", "start", "end", F.explode("patterns").alias("pattern"))
    added = told.join(good, "pattern", "left_semi").select("row", "start", "end").distinct()
    added = added.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(KINDS.index(FOUND)).alias("kind"), "end")).alias("added"))  # of one text
    met = found.drop("text").join(added, "row", "left")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.expr(f"cast(array() as {SPAN})"))))
    return met.select(
        "doc_id", *(count(k) for k in PATTERNS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_found"),
    )
