"""Near duplicates by BagMinHash: weighted Jaccard similarity of the multisets of five-word shingles.

1. Texts of the same words in the same order are one node, that of their least doc_id.
2. A node's signature comes from hierarchical Poisson processes: the weights of a shingle are the intervals [0, 1), [1, 2),
   [2, 4), [4, 8), ...; each interval is a process of points in time at a rate of its width, and a point counts only if its
   place in the interval is below the shingle's count. A point goes to one component, which keeps its first one. Two nodes
   agree in a component with a probability equal to their weighted Jaccard similarity.
3. Components are banded, and buckets are compared with one leader each, the member that meets most others. Pairs are
   verified exactly, as the overlap of the multisets: one pair for each member of a bucket.
4. A leader is not alike all members that are alike each other. In a bucket whose members are in several connected components,
   members outside its largest component are held against the others by their signatures, in blocks of bounded size. The best few
   partners of each are verified exactly; then, for buckets that still have several components, all that longer signatures leave open.
No step holds a bucket in one task or writes all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeledger.llm.components import components
from routeledger.llm.shared import discard, needs, written
from routeledger.llm.words import GOLDEN, Memo, chunked, lower_memo, mix, runs, shingles, word_hashes

WORDS, SIMILARITY = 5, 0.8
#: Bands of rows: pairs at the threshold share a band with a probability of 0.9993.
BANDS, ROWS = 24, 6
#: Members of a block in which signatures are compared.
BLOCK = 4096
#: Partners of a member that are verified before all are.
BEST = 3
#: Components of the signatures of members that no link reaches.
LONG = 768
#: Standard errors below the threshold down to which an estimated similarity is verified.
MARGIN = 3.0
UNIT = 1.0 / (1 << 53)


class Bags:
    """Multisets of the word shingles of some texts: `items` and `counts` of text i are those from starts[i] to starts[i + 1].

    A text of fewer than k words is one shingle; a text without words has none.
    """

    def __init__(self, texts: list[str | None], memo: Memo, k: int = WORDS):
        h, at = word_hashes(texts, memo)
        whole = runs(at, k)
        all_sh = np.zeros(len(h), np.uint64)
        if len(h) >= k:
            all_sh[: len(h) - k + 1] = shingles(h, k)
        n = np.diff(at)
        for i in np.nonzero((n > 0) & (n < k))[0]:
            all_sh[at[i]] = shingles(h[at[i] : at[i + 1]], int(n[i]))[0]
            whole[at[i]] = True
        sh = all_sh[whole]
        ends = np.cumsum(np.where(n >= k, n - k + 1, np.minimum(n, 1)))
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        for x, y in zip(begins, ends, strict=True):
            sh[x:y].sort()
        first = np.ones(len(sh), bool)
        first[1:] = sh[1:] != sh[:-1]
        first[begins[begins < ends]] = True
        places = np.nonzero(first)[0]
        self.items = sh[places]
        self.counts = np.diff(np.append(places, len(sh)))
        self.starts = np.searchsorted(places, np.append(begins, len(sh)))

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.starts[i], self.starts[i + 1])
        return self.items[own], self.counts[own]


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets of sorted items; 0 if both are empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = int(np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum())
    return both / (int(a[1].sum() + b[1].sum()) - both)


def uniform(h: np.ndarray) -> np.ndarray:
    """Numbers above 0 and up to 1."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * UNIT


def bag_minhash(bags: Bags, m: int) -> np.ndarray:
    """A row of m components for each multiset, the times of the first points; those of an empty one are all infinite."""
    n = len(bags.starts) - 1
    out = np.full(n * m, np.inf)
    owner = np.repeat(np.arange(n), np.diff(bags.starts))
    total = np.bincount(owner, weights=bags.counts, minlength=n)
    # One entry for each interval [0, 1), [1, 2), [2, 4), ... into which a shingle's count reaches.
    doc, seed, low = [owner], [bags.items], [np.zeros(len(owner))]
    width, of, level = [np.ones(len(owner))], [bags.counts.astype(float)], 1
    while len(over := np.nonzero(bags.counts > level)[0]):
        doc.append(owner[over])
        seed.append(mix(bags.items[over] ^ mix(np.full(1, level, np.uint64))))
        low.append(np.full(len(over), float(level)))
        width.append(np.full(len(over), float(level)))
        of.append(bags.counts[over].astype(float))
        level *= 2
    doc, seed, low, width, of = (np.concatenate(x) for x in (doc, seed, low, width, of))
    until = (np.log(m) + 2.0) / np.maximum(total, 1.0)
    while len(doc):
        _first_points(out, doc, seed, low, width, of, m, until)
        late = np.isinf(out.reshape(n, m)).any(axis=1)
        until = until * 2.0
        own = late[doc]
        doc, seed, low, width, of = doc[own], seed[own], low[own], width[own], of[own]
    return out.reshape(n, m)


def _first_points(out, doc, seed, low, width, of, m, until) -> None:
    """Lower the components in `out` to the times of all points up to until[doc] that lie below the shingles' counts."""
    at, first, steps = np.zeros(len(doc)), 1, 1
    while len(doc):
        h = mix(seed[:, None] ^ (np.arange(first, first + steps, dtype=np.uint64) * GOLDEN)[None, :])
        t = at[:, None] - np.cumsum(np.log(uniform(h)), axis=1) / (m * width)[:, None]
        good = t <= until[doc][:, None]
        i, j = np.nonzero(good)
        again = mix(h[i, j] + np.uint64(1))
        place = again >> np.uint64(12)
        inside = (width[i] == 1.0) & (low[i] == 0.0) | (low[i] + width[i] * (place.astype(float) / 2.0**52) < of[i])
        i, j, again = i[inside], j[inside], again[inside]
        component = ((again & np.uint64(4095)) * np.uint64(m) >> np.uint64(12)).astype(np.int64)
        np.minimum.at(out, doc[i] * m + component, t[i, j])
        alive = good[:, -1]
        doc, seed, low, width, of, at = doc[alive], seed[alive], low[alive], width[alive], of[alive], t[alive, -1]
        first += steps
        steps = min(2 * steps, 64)


def signed_documents(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, `digest` (of a text's words in order), `keys` (a hash for each band) and `sig` (the low byte of each component); rows
    without doc_id or words are left out. Texts are read once, where they are; a batch's copies share one signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = lower_memo()
        for batch in batches:
            digests = [xxhash.xxh3_128_digest(" ".join((t or "").lower().split()).encode("utf-8", "surrogatepass")) for t in batch["text"]]
            batch = batch.assign(digest=digests)[[d != NO_WORDS for d in digests]]
            once = batch.drop_duplicates("digest")
            for x, y in chunked(list(once["text"])):
                part = once.iloc[x:y]
                keys, low = banded(bag_minhash(Bags(list(part["text"]), memo), bands * rows), bands, rows)
                signed = pd.DataFrame({"digest": part["digest"], "keys": list(keys), "sig": [r.tobytes() for r in low]})
                yield batch[["doc_id", "digest"]].merge(signed, on="digest")

    return needs(docs, "doc_id", "text").where("doc_id IS NOT NULL").mapInPandas(run, "doc_id long, digest binary, keys array<long>, sig binary")


#: The digest of a text without words.
NO_WORDS = xxhash.xxh3_128_digest(b"")


def banded(times: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands of signatures, and the low byte of every component."""
    # The last bits of a time may depend on how a processor takes logarithms.
    sig = mix(times.view(np.uint64) >> np.uint64(20))
    key = np.tile(np.arange(bands, dtype=np.uint64), (len(times), 1))
    for j in range(rows):
        key = mix(key * GOLDEN ^ sig[:, j::rows])
    return key.view(np.int64), (sig & np.uint64(255)).astype(np.uint8)


def signatures(texts: DataFrame, components: int) -> DataFrame:
    """id and `sig` (the low byte of each component) of texts (id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = lower_memo()
        for batch in batches:
            for x, y in chunked(list(batch["text"])):
                part = batch.iloc[x:y]
                low = banded(bag_minhash(Bags(list(part["text"]), memo), components), 1, components)[1]
                yield pd.DataFrame({"id": part["id"], "sig": [r.tobytes() for r in low]})

    return texts.mapInPandas(run, "id long, sig binary")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of the pairs (a, b) whose texts' multisets of shingles overlap enough, with `similarity`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = lower_memo()
        last = Memo(lambda text: Bags([text], memo)[0], 64)
        for batch in batches:
            for x, y in chunked(list(batch["tb"])):
                part = batch.iloc[x:y]
                own = Bags(list(part["tb"]), memo)
                found = np.array([overlap(last[t], own[i]) for i, t in enumerate(part["ta"])])
                yield part[["a", "b"]].assign(similarity=found)[found >= similarity]

    met = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")
    return met.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id and node of every row of docs (doc_id, text).

    Documents are alike if their similarity reaches the threshold; class_id is the least doc_id of those connected, and
    node the least of the same words. A text that is null or has no words is in a class of its own; so is a row without
    doc_id, whose class_id is null. Rows with one doc_id are one document, linked by the text of any of them.
    """
    signed = written(signed_documents(docs, bands, rows))
    nodes = written(signed.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("sig").alias("sig")))
    keyed = nodes.select("id", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keyed.join(sizes, "key"))  # of buckets with several members
    ids = members.select("id").distinct()
    # One plan for all sizes: the ids of members grow with the documents.
    texts = written(needs(docs, "doc_id", "text").toDF("id", "text").join(ids.hint("merge"), "id", "left_semi"))

    meets = members.groupBy("id").agg(F.sum("n").alias("meets"))
    leaders = written(members.join(meets, "id").groupBy("key").agg(F.max_by("id", F.struct("meets", -F.col("id"))).alias("leader")))
    tried = written(members.join(leaders, "key").where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct())
    links = written(verified(tried, texts, similarity).select("a", "b"))
    classes = components(links)
    sigs = nodes.select("id", "sig")
    for best in (BEST, None):
        at = _open(members.where("n > 2"), leaders, classes)
        if at.isEmpty():
            break
        if best is None:
            sigs = written(signatures(texts.join(at.select("id").distinct(), "id", "left_semi"), LONG))
        found = written(_likely(at, sigs, similarity, best).join(tried, ["a", "b"], "left_anti"))
        more = written(verified(found, texts, similarity).select("a", "b"))
        discard(at)
        if not more.isEmpty():
            tried, links = tried.union(found), links.union(more)
            classes = components(links)
    same = signed.select("doc_id", "digest").join(nodes.select("digest", F.col("id").alias("node")), "digest")
    with_class = same.join(classes, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("class"))
    with_class = with_class.groupBy("doc_id").agg(F.min("class").alias("class"), F.min("node").alias("node"))
    return (
        needs(docs, "doc_id").join(with_class, "doc_id", "left")
        .select("doc_id", F.coalesce("class", "doc_id").alias("class_id"), F.coalesce("node", "doc_id").alias("node"))
    )


def _open(members: DataFrame, leaders: DataFrame, classes: DataFrame) -> DataFrame:
    """key, id, class and `apart` (outside the largest class) of members of buckets with several classes, but for the leaders,
    which all others have met. Buckets of which one member is left besides the leader are done."""
    named = classes.select(F.col("node").alias("id"), F.col("component").alias("class"))
    at = members.join(named, "id", "left").select("key", "id", F.coalesce("class", "id").alias("class"))
    at = written(at.join(leaders, "key").where("id <> leader").drop("leader"))
    sizes = at.groupBy("key", "class").agg(F.count("*").alias("n"))
    split = sizes.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("largest"), F.count("*").alias("classes")).where("classes > 1")
    found = written(at.join(split, "key").select("key", "id", "class", (F.col("class") != F.col("largest")).alias("apart")))
    discard(at)
    return found


def _likely(at: DataFrame, sigs: DataFrame, similarity: float, best: int | None) -> DataFrame:
    """Pairs (a, b) of one bucket and different classes that may be alike by their signatures; `best`: so many of the likeliest for each
    member outside its bucket's largest class; None: all."""
    with_sig = at.join(sigs, "id")

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        n = rows.groupBy("key").agg(F.count("*").alias("n"))
        dealt = rows.join(n, "key").select("key", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)).alias("block"), F.struct("id", "class", "sig").alias("x"))
        packed = dealt.groupBy("key", "block").agg(F.collect_list("x").alias("x"))
        return packed.select("key", *(F.col(f"x.{c}").alias(f"{name}_{c}") for c in ("id", "class", "sig")))

    met = blocks(with_sig.where("apart"), "own").join(blocks(with_sig, "other"), "key")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [pd.DataFrame({"id": np.empty(0, np.int64), "other": np.empty(0, np.int64), "agree": np.empty(0)})]
            for row in batch.itertuples(index=False):
                own, other = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (row.own_sig, row.other_sig))
                least = similarity - MARGIN * np.sqrt(similarity * (1 - similarity) / own.shape[1])
                for i in range(len(own)):
                    agree = (other == own[i]).mean(axis=1)
                    likely = np.nonzero((agree >= least) & (row.other_class != row.own_class[i]))[0]
                    if best is not None and len(likely) > best:
                        likely = likely[np.argsort(-agree[likely], kind="stable")[:best]]
                    if len(likely):
                        out.append(pd.DataFrame({"id": row.own_id[i], "other": row.other_id[likely], "agree": agree[likely]}))
            yield pd.concat(out).drop_duplicates(["id", "other"])

    found = met.mapInPandas(compare, "id long, other long, agree double")
    if best is not None:
        first = Window.partitionBy("id").orderBy(F.desc("agree"), "other")
        found = found.distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= best)
    return found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without copies and near copies: one row of each class, that of its least doc_id, with all columns.

    Of rows that repeat this doc_id the least by text stays. Rows without doc_id all stay.
    """
    kept = near_duplicates(docs).where("doc_id = class_id").select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind)))
    own = docs.join(kept, "doc_id", "left_semi").select("*", F.row_number().over(first).alias("_place")).where("_place = 1").drop("_place")
    return own.select(*docs.columns).unionByName(docs.where(docs["doc_id"].isNull()))
