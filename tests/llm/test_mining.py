"""Edge cases and brute force for fingerprints, phrases and clusters."""

import collections
import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from routeledger.llm import clusters, fingerprints, phrases
from routeledger.llm.words import mix

DOCS = "doc_id long, text string, lang string"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumn("part", F.lit("x")).withColumn("h", F.lit(1)).withColumn("n", F.lit(2)).withColumn("fingerprint", F.lit(""))


# --- fingerprints


def slow_fingerprint(text):
    """The docstring, byte by byte."""
    data, size = text.encode(), fingerprints.WINDOW
    mask = (1 << 64) - 1
    table = [int(x) for x in mix(np.arange(1, 257, dtype=np.uint64))]
    hashes = []
    for i in range(len(data)):
        h = 0
        for j in range(size):
            b = data[i - size + 1 + j] if i - size + 1 + j >= 0 else 0
            h = (h * 0x9E3779B97F4A7C15 + table[b]) & mask
        hashes.append(int(mix(np.array([h], np.uint64))[0]))
    level = max(0, (len(data) // 64).bit_length() - 2)
    while sum(h % (1 << level) == 0 for h in hashes) >= 64:
        level += 1
    out = [str(level)]
    for k in range(level, level + 3):
        signs, total = "", None
        for h in hashes:
            total = ((total or 0) + (((h * 0x9E3779B97F4A7C15) & mask) ^ (h >> 29))) & mask
            if h % (1 << k) == 0:
                signs, total = signs + sign(total), None
        out.append(signs + (sign(total) if total is not None else ""))
    return ":".join(out)


def sign(total):
    at = int(mix(np.array([total], np.uint64))[0]) >> 52
    return fingerprints.LETTERS[at >> 6] + fingerprints.LETTERS[at & 63]


def slow_likeness(a, b):
    if a == b:
        return 1.0
    a, b = a.split(":"), b.split(":")
    for k in range(64):
        if 0 <= k - int(a[0]) < 3 and 0 <= k - int(b[0]) < 3:
            x, y = (re.findall("..", s[1 + k - int(s[0])]) for s in (a, b))
            row = [0] * (len(y) + 1)
            for p in x:
                new = [0]
                for j, q in enumerate(y):
                    new.append(row[j] + 1 if p == q else max(row[j + 1], new[j]))
                row = new
            return 2 * row[-1] / (len(x) + len(y)) if x and y else 0.0
    return 0.0


def test_fingerprints_against_brute_force(monkeypatch):
    rng = random.Random(3)
    texts = ["", "a", "é", "\x00\x00", "ab" * 900, "x" * 3000] + ["".join(rng.choice("abcdefgh éü ") for _ in range(rng.choice([5, 60, 300, 4000]))) for _ in range(12)]
    want = [slow_fingerprint(t) for t in texts]
    assert [fingerprints.fingerprint(t) for t in texts] == want and fingerprints.fingerprint(None) == want[0]
    monkeypatch.setattr(fingerprints, "BLOCK", 100)
    assert [fingerprints.fingerprint(t) for t in texts] == want
    for a in want:
        for b in want:
            assert fingerprints.likeness(a, b) == slow_likeness(a, b)


def test_fingerprints_tell_edited_texts():
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("etaoin shrdlu") for _ in range(n))
    for n in (100, 1000, 20_000, 300_000):
        for _ in range(5):
            a, b = make(n), make(rng.choice([0, n // 3, 5 * n]))
            own = fingerprints.fingerprint(a)
            assert fingerprints.likeness(own, fingerprints.fingerprint(fingerprints.edited(a, b))) >= 0.3
            assert fingerprints.likeness(own, fingerprints.fingerprint(make(n))) < 0.15


def test_compared_with_next(spark):
    rng = random.Random(5)
    words = ["one", "two", "three", "Größe", "\U0001f600", "ninety", "hundred"]
    rows = [(i * 7 % 101, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 200]))), "en") for i in range(101)]
    rows += [(200, None, None), (201, "", "en"), (None, "first of all", "en"), (202, "y" * 50_000, "en")]
    ordered = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    got = {r["doc_id"]: r for r in fingerprints.compared_with_next(docs_of(spark, rows).repartition(7)).collect()}
    assert len(got) == len(rows)
    for (i, a, _), (_, b, _) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        a, b = a or "", b or ""
        half = len(a) // 2
        new = a[: len(a) - half] + b[:half]
        prints = [slow_fingerprint(x) if len(x) < 9000 else fingerprints.fingerprint(x) for x in (a, new, b)]
        assert tuple(got[i]) == (i, len(a), hashlib.sha256(new.encode()).hexdigest(), prints[0], prints[1], slow_likeness(prints[0], prints[1]), slow_likeness(prints[0], prints[2]))


def test_compared_with_next_on_edge_cases(spark):
    assert fingerprints.compared_with_next(docs_of(spark, []).limit(0)).count() == 0
    (only,) = fingerprints.compared_with_next(docs_of(spark, [(5, "abc", None)])).collect()
    assert (only["n_chars"], only["near_next"], only["edited_sha256"]) == (3, 1.0, hashlib.sha256(b"aba").hexdigest())
    same = fingerprints.compared_with_next(docs_of(spark, [(1, "to be", "en")] * 60 + [(None, None, None)] * 40)).collect()
    assert len(same) == 100 and collections.Counter(r["near_next"] for r in same) == {1.0: 98, 0.0: 2}
    kept = fingerprints.fingerprints(docs_of(spark, [(1, "abc", "en"), (2, None, "en")])).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in kept} == {1: slow_fingerprint("abc"), 2: "0:::"}
    pairs = spark.createDataFrame([("0:::", "0:::"), ("0:AA:AA:AA", None), (slow_fingerprint("abc"), slow_fingerprint("abd"))], "a string, b string")
    assert [r[0] for r in pairs.select(fingerprints.likeness_of(pairs["a"], pairs["b"])).collect()] == [1.0, None, slow_likeness(slow_fingerprint("abc"), slow_fingerprint("abd"))]


# --- phrases


def slow_collocations(rows, max_n, least, top, percent):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = lang if lang is not None else "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, min(max_n, len(w) - i) + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        hidden = any(g == lang and len(q) > len(p) and c >= least and 100 * c >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), c in f.items())
        if not hidden:
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], i + 1, *x[1:]) for i, x in enumerate(mine[:top])]
    return sorted(ranked)


def test_collocations_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    vocab = ["the", "The", "a", "of", "new", "york", "İs", "ſ", "x\x00y", "\x01", "\x01\x02", "\x00", "\x1f", "b\x08", "ﬁ", "\x85z", " ", "naïve"]
    rows = []
    for i in range(250):
        words = [rng.choice(vocab[: rng.choice([4, 18])]) for _ in range(rng.choice([0, 1, 3, 30]))]
        if i % 2:
            words[5:5] = ["in", "new", "york", "city", "Hall"]
        text = "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " \r\n"]) if rng.random() < 0.3 else w + " " for w in words)
        rows.append((i, text, rng.choice(["en", "en", "de", None])))
    rows += [(300, None, "en"), (301, "", None), (302, "rare words of one piece", "fr"), (303, "to be or " * 200, "en"), (303, "to be or " * 200, "en"), (304, "und this " * 9, "und")]
    docs = docs_of(spark, rows).repartition(5)
    for args in ((5, 4, 2000, 100), (3, 9, 7, 60)):
        want = slow_collocations(rows, *args)
        for bits, held in ((12, 400_000), (4, 50)):  # room for all pairs, and for none
            monkeypatch.setattr(phrases, "HELD_SUFFIXES", held)
            got = sorted(map(tuple, phrases.collocations(docs, *args, slot_bits=bits).collect()))
            assert got == want and len(want) > 20


def test_suffixes_end_with_phrases_that_may_be_candidates(spark):
    texts = [(i, "a b. b c. c d e f", "en") for i in range(20)] + [(30, "a b c d", "en")]
    docs = docs_of(spark, texts).select("lang", "text")
    send = spark.sparkContext.broadcast
    pairs = send(phrases.frequent_slots(docs, 10, 20))
    longer = send(phrases.frequent_phrases(docs, pairs, 10, 5, 20))
    got = {r["suffix"].replace("\x00", " ") for r in phrases.suffixes(docs, pairs, longer, 5, 20).where("suffix is not null").collect()}
    assert got == {"a b", "b c", "c d e f", "d e f", "e f", "b", "c", "f", "c d", "d"}


def test_phrases_of_hot_words_are_left_out_only_below_the_top(spark, monkeypatch):
    rng = random.Random(9)
    hot, rows = [f"h{i}" for i in range(8)], []
    planted = [[f"p{i}", f"q{i}"] for i in range(12)] + [["h0", "a", "b"], ["c", "h1", "d"], ["e", "f", "h2"], ["r", "h3", "h4", "s"]]
    for lang, own in (("en", planted), ("de", planted[:3])):
        pieces = [p for p in own for _ in range(10)] + [[rng.choice(["p3", "c h1", "h1 d", "h3"])] for _ in range(30)]
        for i, p in enumerate(pieces * 2 if lang == "de" else pieces):
            rows.append((i, " ".join([*rng.choices(hot, k=rng.randrange(12)), *p, *rng.choices(hot, k=rng.randrange(12))]), lang))
    docs = docs_of(spark, rows).repartition(3)
    tables, write = [], phrases.written
    monkeypatch.setattr(phrases, "written", lambda df, *args: tables.append(write(df, *args)) or tables[-1])
    for times, bits, args in ((5, 16, (5, 10, 8, 100)), (5, 4, (4, 10, 8, 60)), (2, 16, (5, 10, 2000, 100))):
        monkeypatch.setattr(phrases, "HOT_TIMES", times, raising=False)
        tables.clear()
        assert sorted(map(tuple, phrases.collocations(docs, *args, slot_bits=bits).collect())) == slow_collocations(rows, *args)
        if args[2] < 10:
            sent = [r["suffix"].split("\x00") for r in tables[0].where("lang = 'en' and suffix is not null").collect()]
            assert sent and not any(set(words) <= set(hot) for words in sent)


def test_collocations_of_edge_cases(spark):
    assert phrases.collocations(docs_of(spark, []).limit(0), slot_bits=10).count() == 0
    assert phrases.collocations(docs_of(spark, [(1, None, None), (2, "", "en"), (3, ". , !", "en")]), least=1, slot_bits=10).count() == 0


def test_scores_beyond_64_bits(spark):
    counted = spark.createDataFrame([("en", "a\x00b", 3_000_000_000_000), ("en", "a", 4_000_000_000_000), ("en", "b", 5_000_000_000_007)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", 90_000_000_000_000)], "lang string, n long")
    (row,) = phrases.scored(counted, totals).collect()
    assert row["score"] == 1000 * 3_000_000_000_000 * 90_000_000_000_000 // (4_000_000_000_000 * 5_000_000_000_007)


# --- clusters


def slow_clusters(rows, k, rounds, seed, dims, scale):
    kept = [(i, [int(np.floor(float(np.float64(x)) * scale)) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    by = collections.Counter()
    for _, j, d in last:
        by[j] += d
    most = 2**63 - 1
    return sorted((i, j, min(d, most), min(by[j], most), min(sum(by.values()), most), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, j, d in last)


def test_clusters_against_brute_force(spark):
    rng = random.Random(7)
    for size in (1.0, 1e5, 3e7):  # the last beyond what single precision tells apart
        rows = [(i, [float(np.float32(rng.choice([0, 1, 1, rng.gauss(0, 1)]) * size)) for _ in range(8)]) for i in range(300)]
        rows += [(i + 300, rows[i % 5][1]) for i in range(100)] + [(7, rows[3][1]), (None, rows[0][1]), (900, None), (901, [1.0] * 7), (902, [float("nan")] * 8), (903, [None] * 8), (904, [float("inf")] + [0.0] * 7), (905, [])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit(1)).withColumn("v", F.lit(2)).repartition(5)
        got = sorted(map(tuple, clusters.clusters(df, k=6, rounds=3, dims=8).collect()))
        assert got == slow_clusters(rows, 6, 3, 1, 8, 64)


def test_screening_never_loses_the_nearest():
    rng = np.random.default_rng(8)
    decided = 0
    for size in (3, 300, 10**6, 10**9, 4 * 10**18):
        x = rng.integers(-size, size + 1, (400, 64))
        c = np.concatenate([rng.integers(-size, size + 1, (5, 64)), x[:3], x[:3] + 1, x[:3]])
        c = np.clip(c, -(2**63) + 1, 2**63 - 1)
        cluster, distance = clusters.nearest(x, c)
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in c] for p in x]
        assert cluster.tolist() == [e.index(min(e)) for e in exact] and [int(d) for d in distance] == [min(e) for e in exact]
        decided += (clusters.screened(x, c)[0].sum(axis=1) == 1).sum()
    assert decided > 1000  # most by screening alone


def test_clusters_of_edge_cases(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert clusters.clusters(empty).count() == 0
    few = spark.createDataFrame([(1, [0.5] * 64), (2, [1e30] * 64), (3, None)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in clusters.clusters(few).collect()}
    assert sorted(got) == [1, 2] and got[1]["inertia"] == 0 and got[1]["cluster"] != got[2]["cluster"]
