"""Edge cases and brute force for the text operators."""

import collections
import hashlib
import itertools
import json
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeledger.llm import chat, decontaminate, lines, minhash, packing, passages, pii, search, toxicity, urls
from routeledger.llm import shared as scratch
from routeledger.llm import words as text_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
VOCAB = [f"w{i}" for i in range(400)]


def words(n):
    return [RNG.choice(VOCAB) for _ in range(n)]


def docs_of(spark, texts, extra=True):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("class", F.lit("x")).withColumn("key", F.lit(1)).withColumn("hits", F.lit(2)) if extra else df


def edge_docs(spark):
    return docs_of(spark, [(1, "a b c d e f"), (2, None), (3, ""), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "x" * 5000), (6, "  \n\n ")])


def test_near_duplicates_against_brute_force(spark):
    base = words(60)
    texts = []
    for i in range(60):
        w = list(base) if i % 3 else words(60)
        for _ in range(RNG.randint(0, 3)):
            w[RNG.randrange(60)] = "changed"
        texts.append((i, " ".join(w)))
    texts += [(100, texts[0][1]), (101, texts[0][1].upper()), (102, "to be"), (103, "to be"), (104, None), (105, ""), (None, texts[1][1])]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs_of(spark, texts)).collect()}
    bags = {}
    for i, t in texts:
        w = (t or "").lower().split()
        if i is not None and w:
            k = min(5, len(w))
            bags[i] = collections.Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    label = {i: i for i, _ in texts if i is not None}
    changed = True
    while changed:
        changed = False
        for a in bags:
            for b in bags:
                if label[a] < label[b] and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
                    label[b], changed = label[a], True
    assert {i: got[i] for i in label} == label and got[None] is None
    kept = minhash.one_of_each(docs_of(spark, texts)).select("doc_id").collect()
    assert sorted(r[0] for r in kept if r[0] is not None) == sorted(set(label.values()))


def test_near_duplicates_of_edge_cases(spark):
    got = minhash.near_duplicates(edge_docs(spark)).select("doc_id", "class_id").distinct().collect()
    assert {tuple(r) for r in got} == {(1, 1), (2, 2), (3, 3), (4, 1), (5, 5), (6, 6), (None, None)}
    assert minhash.near_duplicates(edge_docs(spark).limit(0)).count() == 0


def test_near_duplicates_of_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 32)
    rng = random.Random(14)
    some = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    base, texts = some(100), []
    for i in range(700):  # most are alike the base, some only each other
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            w[rng.randrange(100)] = f"new{rng.randrange(50)}"
        texts.append((i, " ".join(w)))
    texts += [(1000 + i, " ".join(some(100))) for i in range(50)]
    bags = {i: collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for i, t in texts for w in [t.split()]}
    label = {i: i for i, _ in texts}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in bags:
        for b in bags:
            if a < b and find(a) != find(b) and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs_of(spark, texts)).collect()}
    wrong = sum(got[i] != find(i) for i in label)
    assert wrong <= 0.01 * len(label)


def test_bag_minhash_is_unbiased():
    memo = minhash.lower_memo()
    errors = []
    for _ in range(60):
        a = words(80) * RNG.randint(1, 3)
        b = a[: RNG.randint(30, len(a))] + words(20)
        bags = minhash.Bags([" ".join(a), " ".join(b)], memo)
        sig = minhash.bag_minhash(bags, 256)
        errors.append((sig[0] == sig[1]).mean() - minhash.overlap(bags[0], bags[1]))
    assert abs(np.mean(errors)) < 0.02


def test_passages(spark):
    shared = words(70)
    fuzzy = list(shared)
    fuzzy[20], fuzzy[45] = "other", "another"
    texts = [(1, " ".join(words(80) + shared + words(50))), (2, " ".join(words(30) + fuzzy + words(90))), (3, " ".join(words(200))), (4, None), (5, ""), (None, " ".join(shared)), (6, " ".join(["again", "and"] * 100)), (7, " ".join(["again", "and"] * 90))]
    got = {r["doc_id"]: r for r in passages.repeated_passages(docs_of(spark, texts)).collect()}
    assert sorted(got) == [1, 2, 6, 7]
    assert (got[1]["start"], got[1]["end"], got[1]["other"]) == (80, 150, 2) and (got[2]["start"], got[2]["end"], got[2]["other"]) == (30, 100, 1)
    assert got[7]["end"] - got[7]["start"] == 180
    left = {r["doc_id"]: r["text"] for r in passages.without_repeats(docs_of(spark, texts)).collect()}
    assert len(left[2].split()) == 120 and left[1] == texts[0][1] and left[4] is None
    assert passages.repeated_passages(edge_docs(spark)).count() == 0


def agreeing(a, b, least=40, agree=0.8):
    """Whether some diagonal of two texts has `least` words or more of which `agree` are equal."""
    for d in range(-len(b) + least, len(a) - least + 1):
        same = [x == y for x, y in zip(a[max(0, d) :], b[max(0, -d) :], strict=False)]
        if sum(same) < agree * least:
            continue
        total = np.concatenate([[0.0], np.cumsum(np.array(same) - agree)])
        low = np.minimum.accumulate(total)
        if (total[least:] - low[:-least] >= -1e-9).any():
            return True
    return False


def test_passages_with_changed_words_against_brute_force(spark):
    rng = random.Random(11)
    some = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    texts = []
    for i in range(90):
        n, changed = [(40, 0), (60, 5), (80, 8)][i % 3]
        shared = some(n)
        other = list(shared)
        for at in rng.sample(range(n), changed):
            other[at] = f"changed{i}"
        texts += [some(30) + shared + some(25), some(20) + other + some(40)]
    want = {j for i in range(0, len(texts), 2) if agreeing(texts[i], texts[i + 1]) for j in (i, i + 1)}
    got = {r["doc_id"] for r in passages.repeated_passages(docs_of(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    exact = {j for i in range(0, len(texts), 6) for j in (i, i + 1)}
    assert len(want) == 180 and exact <= got and len(got & want) >= 0.98 * len(want)


def test_passages_that_recur_within_a_document(spark):
    shared = words(60)
    once, twice = words(20) + shared + words(20), words(15) + shared + words(60) + shared + words(10)
    for first, second in ((once, twice), (twice, once)):
        docs = docs_of(spark, [(1, " ".join(first)), (2, " ".join(second)), (3, " ".join(words(25) + shared + words(5) + shared)), (4, " ".join(words(100)))])
        got = collections.defaultdict(list)
        for r in passages.repeated_passages(docs).collect():
            got[r["doc_id"]].append((r["start"], r["end"]))
        want = {1: first, 2: second}
        for i, text in want.items():
            assert sorted(got[i]) == ([(15, 75), (135, 195)] if text is twice else [(20, 80)])
        assert sorted(got[3]) == [(25, 85), (90, 150)] and 4 not in got
        left = {r["doc_id"]: len(r["text"].split()) for r in passages.without_repeats(docs).collect()}
        assert left == {1: len(first), 2: len(second) - (120 if second is twice else 60), 3: 30, 4: 100}


@pytest.mark.parametrize("copies", [1, 4])
def test_passages_whose_seeds_point_to_other_texts(spark, copies):
    rng = random.Random(5)
    some = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    shared, texts = some(60), []
    for i in range(54):
        texts += [(len(texts) + j, " ".join(some(20) + shared[i : i + 7] + some(20))) for j in range(copies)]
    texts += [(1000, " ".join(some(30) + shared + some(10))), (1001, " ".join(some(15) + shared + some(25)))]
    got = {r["doc_id"]: (r["start"], r["end"], r["other"]) for r in passages.repeated_passages(docs_of(spark, texts)).collect()}
    assert got == {1000: (30, 90, 1001), 1001: (15, 75, 1000)}


def test_passages_with_evenly_spaced_changes(spark):
    rng = random.Random(7)
    some = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    kinds = [(80, 6), (80, 7), (60, 10)]
    texts = []
    for i in range(90):
        n, every = kinds[i % 3]
        shared = some(n)
        other = [f"changed{i}" if at % every == every - 1 else w for at, w in enumerate(shared)]
        texts += [some(30) + shared + some(25), some(20) + other + some(40)]
    assert all(agreeing(texts[i], texts[i + 1]) for i in range(0, len(texts), 2))
    got = {r["doc_id"] for r in passages.repeated_passages(docs_of(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    recall = [sum(2 * i in got and 2 * i + 1 in got for i in range(k, 90, 3)) / 30 for k in range(3)]
    print(recall)
    assert min(recall) >= 0.9


def test_words_by_their_bytes():
    rng = random.Random(9)
    odd = "aAbB éİſ\x1c\x85\xa0\u3000 \n\t\r\x0b\x00zß\U0001f600\ud800"
    texts = [None, "", " ", "  a", "x" * 1000 + " y" * 5, *("".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(2000))]
    want, starts = text_words.word_hashes(texts, text_words.lower_memo())
    for most in (7, 1 << 20):
        got, own = text_words.byte_hashes(texts, most)
        assert own.tolist() == starts.tolist() and len(got) == len(want)
        assert len(set(zip(got.tolist(), want.tolist(), strict=True))) == len(set(got.tolist())) == len(set(want.tolist()))
    assert text_words.byte_hashes([])[1].tolist() == [0]


def test_passages_leave_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    kept = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
    texts = docs_of(spark, [(i, " ".join(words(30) + VOCAB[:60])) for i in range(40)])
    before = kept()
    found = passages.repeated_passages(texts)  # its tables are written, its last step has not run
    for _ in range(50):
        if not kept() - before:
            break
        time.sleep(0.1)
    assert not kept() - before
    assert found.count() == 40


def test_passages_of_equal_texts(spark, monkeypatch):
    rng = random.Random(13)
    some = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    texts = []
    for _ in range(15):
        shared = some(60)
        texts += [some(50) + shared + some(20), some(30) + shared + some(70)]
    texts += [some(200), some(30)]
    rows = collections.Counter()

    def noted(df, tidy=False, of=passages.written):
        table = of(df, tidy)
        rows[copies] += table.count() if {"seed", "leader"} & set(df.columns) else 0
        return table

    for module in (passages, scratch):
        monkeypatch.setattr(module, "written", lambda df, tidy=False: noted(df, tidy))
    for copies in (1, 12):
        docs = docs_of(spark, [(i + 100 * j, " ".join(t)) for i, t in enumerate(texts) for j in range(copies)])
        got = sorted(r[:] for r in passages.repeated_passages(docs).select("doc_id", "passage", "start", "end", "other").collect())
        if copies == 1:
            assert got == [(i, 0, *((30, 90, i - 1) if i % 2 else (50, 110, i + 1))) for i in range(30)]
    # A copy shares its whole text with the first, and that with the next one or with the text that has a passage of it.
    first = lambda i: i - 1 if i % 2 and i < 30 else i
    want = [(i + 100 * j, 0, 0, len(t), first(i) if j or first(i) < i else i + 1 if i < 30 else i + 100) for i, t in enumerate(texts[:31]) for j in range(12)]
    assert got == sorted(want)
    assert rows[12] <= 1.05 * rows[1]  # what is counted, linked and compared follows the different texts


def test_passages_in_parts(spark, monkeypatch):
    rng = random.Random(17)
    some = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    often, texts = some(50), []
    for i in range(40):
        passage = some(60)
        texts += [some(20 + i) + passage + some(30) + (often if i % 2 else []), some(10) + passage + some(15)]
    texts += [texts[0], texts[3], ["x"] * 60]
    docs = docs_of(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]).union(docs_of(spark, [(7, " ".join(texts[7])), (8, " ".join(texts[3]))]))
    once = sorted(r[:] for r in passages.repeated_passages(docs).collect())
    made = []
    monkeypatch.setattr(passages, "in_parts", lambda make, df, n, *keys, of=passages.in_parts: (made.append(n), of(make, df, n, *keys))[1])
    monkeypatch.setattr(passages, "LEAST_ROOM", 1)
    monkeypatch.setattr(passages, "MOST_SENT", 2)
    assert sorted(r[:] for r in passages.repeated_passages(docs).collect()) == once and len(once) >= 80
    assert len(made) == 7 and min(made[:5]) > 1  # no step shuffles all of its rows at a time


def test_passages_send_the_shorter_text(spark):
    pairs = spark.createDataFrame([(i, 0) for i in range(1, passages.MOST_SENT + 2)] + [(1, 900), (2, 901), (3, 901)], "id long, leader long")
    known = spark.createDataFrame([(0, 5), *((i, 10 * i) for i in range(1, 100)), (900, 7), (901, 25)], "id long, size long")
    got = {(r["id"], r["leader"]): (r["own_goes"], r["bytes"]) for r in passages.sent(pairs, known, passages.leaders(pairs, known)).collect()}
    assert got == {(i, 0): (True, 10 * i) for i in range(1, passages.MOST_SENT + 2)} | {(1, 900): (False, 7), (2, 901): (True, 20), (3, 901): (False, 25)}


def test_packing(spark):
    from tokenizers import Tokenizer

    encoder = packing.word_tokenizer()
    full = Tokenizer.from_file(encoder.path)
    texts = [(i, " ".join(words(RNG.choice([3, 50, 400, 1500])))) for i in range(40)]
    texts += [(50, None), (51, ""), (51, ""), (None, "a b"), (52, "Ünïcode ÅSTRÖM, naïve! 12.5% x-y 日本語 😀\t\tİstanbul\n\n..."), (53, "9" * 3000), *((None, "") for _ in range(60))]
    rows = packing.pack(docs_of(spark, texts), encoder, 512).collect()
    want = collections.Counter()
    for i, t in texts:
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 512)):
            part = np.array(ids[at : at + 512], "<u4")
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(filled) <= -(-sum(r["length"] for r in rows) // 512) + 3
    assert packing.pack(docs_of(spark, texts).limit(0), encoder).count() == 0


@pytest.mark.parametrize("shortest, times", [(1, 1), (1, 1000), (700, 1), (1025, 1), (300, 50)])
def test_packing_follows_the_program(shortest, times):
    rng = np.random.default_rng(shortest)
    counts = np.bincount(np.clip(rng.lognormal(6, 1, 3000).astype(int), shortest, 2048), minlength=2049) * times
    found = packing.plan(counts, 2048)
    solved, bound = packing.solve(counts, 2048)
    cover = np.zeros(2049)
    for pattern, uses in solved.items():
        assert sum(n * k for n, k in pattern) <= 2048
        for n, k in pattern:
            cover[n] += k * uses
    assert np.allclose(cover, counts) and packing.lower_bound(counts, 2048) <= bound <= sum(solved.values()) + 1e-6
    assert found.by_program >= 0.8 * found.sequences and bound - 1e-6 <= found.sequences <= sum(solved.values()) + len(solved)
    assert found.sequences <= 1.03 * bound + 2
    place = {n: sorted(zip(found.first[n], found.times[n], strict=True)) for n in found.first}
    assert all(place[n][0][0] == 0 for n in place) and packing.plan(np.zeros(2049, np.int64), 2048).sequences == 0


def test_knapsack_against_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        weights, limits = np.zeros(31), np.zeros(31, int)
        for n in rng.sample(range(1, 31), 5):
            weights[n], limits[n] = rng.random() * n, rng.randint(1, 4)
        lengths = np.nonzero(limits)[0].tolist()
        fills = packing.Fills(weights, limits, 30)
        want = max(sum(k * weights[n] for k, n in zip(ks, lengths, strict=True)) for ks in itertools.product(*(range(limits[n] + 1) for n in lengths)) if sum(k * n for k, n in zip(ks, lengths, strict=True)) <= 30)
        pattern = fills.chosen(np.array([30]))[0]
        assert abs(fills.best[30] - want) < 1e-9 and abs(sum(weights[n] * k for n, k in pattern.items()) - want) < 1e-9 and all(k <= limits[n] for n, k in pattern.items())


def test_urls(spark):
    pages = [(1, "http://a.example.net/en/x", ""), (2, "http://b.example.net/fr", None), (3, "https://EXAMPLE.com/de/q?x", ""), (4, "x", ""), (5, None, ""), (6, "http://www.org/fr/1", "<link rel='canonical' href='http://b.example.net/fr'>"), (7, "http://c.io/p", "<link rel='canonical' href='http://b.example.net/fr'>"), (8, "http://d.io", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("node", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(df, urls.CONTRACT_RULES).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2][2:] == ("net/", "block") and got[3] == ("example.com", "/de/q", "example.com/de/", "block")
    assert got[4] == ("", "", None, "allow") == got[5] and got[6][2:] == ("org/fr/", "allow") and got[7][2:] == (None, "block") and got[8] == ("d.io", "", None, "allow")
    assert urls.filter_urls(df.limit(0), urls.CONTRACT_RULES).count() == 0


def test_urls_of_all_tags_and_relative_links(spark):
    page, bad = "http://a.io/x/y/page?q=1", "http://bad.net/"
    refresh = lambda link: f'<meta http-equiv="refresh" content="0; url={link}">'
    forms = {"page2.html": "a.io/x/y/page2.html", "?p=1": "a.io/x/y/page?p=1", "../z": "a.io/x/z", "../../../z/./w?u=../k#f": "a.io/z/w?u=../k", "..": "a.io/x/", "/r/": "a.io/r/", "//B.io/p": "b.io/p",
             "HTTP://c.io/p": "c.io/p", "/go?u=http://bad.net/": "a.io/go?u=http://bad.net/", "go?u=http://bad.net/": "a.io/x/y/go?u=http://bad.net/", "mailto:x@bad.net": None}
    df = spark.createDataFrame([(i, page, refresh(k)) for i, k in enumerate(forms)], "page_id long, url string, html string").withColumn("host", F.lit("a.io"))
    assert sorted(r["b"] for r in urls.links(df).collect()) == sorted(v for v in forms.values() if v)
    pages = [(1, "http://d.io/", '<meta http-equiv="refresh" content="30">' + refresh(bad)), (2, "http://e.io/", f"<link rel=canonical href=http://e.io/><link rel=canonical href={bad}>"), (3, "http://f.io/", refresh("/go?u=http://bad.net/")), (4, "http://g.io", refresh("h")), (5, "http://g.io/h", refresh(bad))]
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), urls.CONTRACT_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block"}


def test_urls_of_random_graphs_against_brute_force(spark):
    rng = random.Random(8)
    hosts = ["a.net", "b.example.net", "c.org", "d.io", "e.f.example.com", "g.com", "h.de"]
    urls_ = [f"http://{h}/{p}" for h in hosts for p in ("", "en/1", "de/2", "fr/3", "x/4", "x/5")]
    chain = [f"http://chain{i}.io/" for i in range(40)] + ["http://end.net/z"]
    hub = [f"http://spoke{i}.io/" for i in range(50)]
    tagged = lambda link: f'<link rel="canonical" href="{link}">'
    pages = [(i, u, tagged(rng.choice(urls_)) if rng.random() < 0.5 else "") for i, u in enumerate(urls_)]
    pages += [(100 + i, u, tagged(chain[i + 1]) if i + 1 < len(chain) else None) for i, u in enumerate(chain)]
    pages += [(200 + i, u, tagged("http://hub.io/")) for i, u in enumerate(hub)] + [(300, "http://hub.io/", "<p>" + "x" * 200_000), (300, "http://hub.io/", "")]
    table = [(hub[3], "http://www.bad.net/q"), ("http://x.org/fr/", "http://bad.net/"), (None, hub[1]), ("nothing", hub[2])]
    pages += [(400, "http://x.org/fr/", ""), (401, "http://plain.io", None)]
    rules = {(h, p): v for h, p, v in urls.CONTRACT_RULES}

    def parts(u):
        rest = u.split("://", 1)[1]
        m = re.match(r"([^/?#]*)(/[^?#]*)?", rest)
        return m[1].lower(), m[2] or ""

    def ruled(u):
        h, p = parts(u)
        fit = [(len(a + b), a + b, v) for (a, b), v in rules.items() if (h == a or h.endswith("." + a)) and p.startswith(b)]
        return max(fit)[1:] if fit else (None, None)

    node = lambda u: u.split("://", 1)[1]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    ends = [(u, link) for _, u, html in pages for link in re.findall(r'href="([^"]+)"', html or "")] + [t for t in table if t[0] and "://" in t[0]]
    for x, y in ends:
        parent[find(node(x))] = find(node(y))
    bad = {find(x) for x in list(parent) if ruled("http://" + x)[1] == "block"}
    want = collections.Counter((i, *parts(u), ruled(u)[0], ruled(u)[1] or ("block" if node(u) in parent and find(node(u)) in bad else "allow")) for i, u, _ in pages)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit("x")).withColumn("of", F.lit(1))
    got = urls.filter_urls(df, urls.CONTRACT_RULES, spark.createDataFrame(table, "from_url string, to_url string")).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert {v for (i, *_, v) in want if 100 <= i < 300} == {"block"} and [v for (i, *_, v) in want if i == 400] == ["allow"]


def test_ftrl_against_one_coordinate_at_a_time():
    rng = random.Random(6)
    rates = toxicity.Rates(l1=0.5)
    rows = [(np.array(sorted(rng.sample(range(40), 6))), rng.randint(0, 1)) for _ in range(120)]
    last = 1 << toxicity.BITS
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        l1, l2 = (0.0, 0.0) if i == last else (rates.l1, rates.l2)
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((rates.beta + n[i] ** 0.5) / rates.alpha + l2)

    for _ in range(rates.passes):
        for places, y in rows:
            at = [*places.tolist(), last]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in at:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / rates.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    places, w = toxicity.ftrl(rows, rates)
    want = {i: weight(i) for i in range(40) if weight(i)} | {last: weight(last)}
    assert set(places.tolist()) == set(want) and np.allclose(w, [want[i] for i in places.tolist()])


def test_toxicity_takes_the_same_sample(spark):
    rows = [(i, " ".join(words(8) + (["vile"] if i % 3 == 0 else []))) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, [*rows, (3, "another text"), (7, None)])
    first = toxicity.train(docs, labels, sample_rows=100)
    assert first and first == toxicity.train(docs.repartition(7), labels.repartition(5), sample_rows=100)
    assert toxicity.score(docs.limit(0), first).count() == 0


def test_toxicity(spark):
    rows = [(i, " ".join(words(30) + (["vile", "scum"] if i % 4 == 0 else []))) for i in range(400)]
    docs = docs_of(spark, [*rows, (900, None), (901, ""), (None, "vile scum")])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows] + [(5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    got = toxicity.score(docs, model).collect()
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) > 390 and len(got) == 403
    assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(docs, toxicity.train(docs.limit(0), labels)).where("score = 0.5").count() == 403


def call(i, name, **arguments):
    return {"id": i, "name": name, "arguments": arguments}


def test_chat(spark):
    turns = [
        (1, 0, "user", "hé"), (1, 1, "tool", json.dumps({"tool_call_id": "b", "content": {"z": 1, "a": 2}})),
        (1, 2, "assistant", json.dumps({"tool_calls": [call("b", "calculate", expression={"$result": "a"}), call("a", "search", query="q", limit=0)]})),
        (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "r"})), (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": "r"})), (1, 5, "assistant", json.dumps({"tool_calls": [call("b", "calculate", expression="1"), call("c", "none")]})),
        (2, 0, "user", None), (2, 1, "assistant", "{not json"), (2, 2, "assistant", json.dumps({"tool_calls": [call("x", "search", query={"$result": "y"}), call("y", "search", query={"$result": "x"})]})), (None, None, "user", ""),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("line", F.lit(1))
    rows = sorted(chat.format_chats(df, chat.TOOLS).where("conv_id = 1").collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(len(rows))) and rows[0]["line"] == '{"content":"hé","role":"user"}'
    seen = [(json.loads(r["line"]).get("tool_call", {}).get("id") or json.loads(r["line"]).get("tool_call_id"), r["status"]) for r in rows[1:]]
    assert seen.index(("a", "invalid")) < seen.index(("a", "ok")) and seen.index(("b", "ok")) < len(seen) - 1 - seen[::-1].index(("b", "ok"))
    assert ("zz", "orphan") in seen and ("b", "duplicate") in seen and ("c", "invalid") in seen
    other = {r["status"] for r in chat.format_chats(df, chat.TOOLS).where("conv_id = 2").collect()}
    assert other == {"ok", "cyclic"} and chat.format_chats(df.limit(0)).count() == 0
    assert chat.fault({"query": 1}, chat.TOOLS["search"]) == "$.query: not string" and chat.fault({}, chat.TOOLS["search"]) == "$.query: missing"


def test_chat_with_many_references_and_null_conversation(spark):
    turn = lambda conv, i, *calls: (conv, i, "assistant", json.dumps({"tool_calls": list(calls)}))
    uses = lambda i, ref: call(i, "search", query={"$result": ref})
    answer = lambda conv, i, of: (conv, i, "tool", json.dumps({"tool_call_id": of, "content": "r"}))
    turns = [turn(1, 0, call("a", "search", query="q")), answer(1, 1, "a"), turn(1, 2, *(uses(f"n{i}", "a") for i in range(1100)))]
    turns += [turn(2, 0, uses("x", "y"), uses("y", "x"), uses("z", "y"), uses("own", "own"), call("free", "search", query="q"))]
    turns += [turn(None, 0, uses("late", "b")), turn(None, 1, call("b", "search", query="q")), answer(None, 2, "b"), answer(None, 3, "late")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = chat.format_chats(df, chat.TOOLS).orderBy("conv_id", "position").collect()
    said = [(r["conv_id"], json.loads(r["line"]), r["status"]) for r in rows]
    status = {(c, v["tool_call"]["id"]): s for c, v, s in said if "tool_call" in v}
    assert {k[1]: s for k, s in status.items() if k[0] == 2} == {"x": "cyclic", "y": "cyclic", "z": "cyclic", "own": "cyclic", "free": "unanswered"}
    assert collections.Counter(s for k, s in status.items() if k[0] == 1) == {"ok": 1, "unanswered": 1100}
    alone = [v["tool_call"]["id"] if "tool_call" in v else "to " + v["tool_call_id"] for c, v, s in said if c is None and s == "ok"]
    assert sorted(alone) == ["b", "late", "to b", "to late"] and alone.index("b") < alone.index("late") < alone.index("to late")


def test_chat_never_fails_on_odd_json(spark):
    odd = ['{"tool_call_id":"a","content":NaN}', '{"tool_call_id":"a","content":1e999}', '{"tool_call_id":"\\ud800x","content":"\\udc00 \\ud83d\\ude00"}', '{"tool_calls":[{"id":"b","name":["x"],"arguments":[1]}]}',
           '{"tool_calls":[]}', '{"tool_calls":[1]}', '{"a":' * 5000 + "1" + "}" * 5000, '{"tool_calls":[{"id":"c","name":"search","arguments":' + '{"a":' * 300 + "1" + "}" * 303, '{"tool_calls":' + "9" * 5000 + "}", "{", "[]", "x" * 300_000]
    df = spark.createDataFrame([(1, i, "tool", t) for i, t in enumerate(odd)] + [(1, None, None, None)] * 2, "conv_id long, turn long, role string, text string")
    rows = chat.format_chats(df, chat.TOOLS).collect()
    lines = {r["turn"]: json.loads(r["line"]) for r in rows if r["turn"] is not None}
    assert len(rows) == len(odd) + 2 and all(lines[i]["content"] == odd[i] for i in (0, 1, 4, 5, 6, 7, 8, 9, 10, 11))
    assert lines[2] == {"content": "\ufffd \U0001f600", "role": "tool", "tool_call_id": "\ufffdx"} and lines[3]["error"] == "unknown tool"


def test_chat_order_against_brute_force(spark):
    rng = random.Random(12)
    turns, said = [], {}
    for conv in [*range(12), None]:
        ids = [f"c{i}" for i in range(rng.randint(1, 14))]
        rank = {c: k for k, c in enumerate(rng.sample(ids, len(ids)))}
        uses = {c: [d for d in ids if rank[d] < rank[c] and rng.random() < 0.25] for c in ids}
        said[conv] = uses
        rows = [("tool", {"tool_call_id": c, "content": c}) for c in ids if rng.random() < 0.7]
        left = list(ids)
        while left:
            some, left = left[: rng.randint(1, 3)], left[3:] if len(left) > 3 else []
            rows.append(("assistant", {"tool_calls": [call(c, "search", query="q", **{"limit": 1}) | {"arguments": {"query": "q", "x": [{"$result": d} for d in uses[c]]}} for c in some]}))
            left = [c for c in ids if c in left and c not in some]
        rows += [("user", None)] * 3
        rng.shuffle(rows)
        turns += [(conv, t, role, json.dumps(v) if v else f"hello {t}") for t, (role, v) in enumerate(rows)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = collections.defaultdict(list)
    for r in chat.format_chats(df, {"search": {}}).orderBy("conv_id", "position").collect():
        got[r["conv_id"]].append((r["position"], r["turn"], json.loads(r["line"]), r["status"]))
    for conv, uses in said.items():
        rows = got[conv]
        assert [p for p, *_ in rows] == list(range(len(rows)))
        calls = {v["tool_call"]["id"]: p for p, _, v, _ in rows if "tool_call" in v}
        results = {v["tool_call_id"]: p for p, _, v, s in rows if "tool_call_id" in v and s == "ok"}
        assert all(calls[c] < p for c, p in results.items())
        assert all(calls[d] < calls[c] and results.get(d, -1) < calls[c] for c in calls for d in uses[c] if d in calls)
        free = [t for _, t, v, s in rows if "tool_call" not in v and "tool_call_id" not in v]
        assert free == sorted(free) and all(s in ("ok", "unanswered", "orphan") for *_, s in rows)


def test_lines(spark):
    rows = [(i, f"head\nown {i}\n\nfoot ", "en", "s" if i < 20 else None, 1) for i in range(26)] + [(90, None, "en", "s", 0), (91, "", "en", "t", 0)]
    got = {r["doc_id"]: r for r in lines.drop_boilerplate(spark.createDataFrame(rows, DOCS).withColumn("total", F.lit(1))).collect()}
    assert got[3]["text"] == "own 3\n" and got[3]["n_dropped"] == 2 and got[22]["text"] == "own 22\n" and got[90]["text"] is None and got[91]["text"] == ""


def test_lines_of_edge_cases(spark):
    rows = [(i % 10, f"same\nown {i % 10}", "en", "s", 1) for i in range(20)] + [(None, "same\nx", "en", "s", 1), (None, "same\ny", "en", None, 1), (30, "z" * 100_000 + "\nsame", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit(99)).withColumn("hits", F.lit(1)).withColumn("h", F.lit(1))
    got = lines.drop_boilerplate(df)
    assert got.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "hits", "h", "n_lines", "n_dropped"] and got.count() == 23
    kept = collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect())
    assert kept[3, "own 3", 2, 1] == 2 and kept[None, "x", 2, 1] == 1 and kept[None, "same\ny", 2, 0] == 1 and kept[30, "z" * 100_000, 2, 1] == 1
    assert lines.drop_boilerplate(df.limit(0)).count() == 0


def test_decontamination(spark):
    item = "A train travels 120 km from Paris to Lyon in 3 hours and then it returns with half of that speed to the station"
    moved = item.replace("120", "450").replace("3 hours", "7 hours").replace("Paris", "Oslo")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (1, item)], "item_id long, text string")
    texts = [(1, f"{' '.join(words(20))} {item} {' '.join(words(20))}"), (2, f"{' '.join(words(9))} {moved}"), (3, " ".join(words(50))), (4, None), (5, ""), (None, item)]
    got = {r["doc_id"] for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == {1, 2, None}
    assert {r["doc_id"] for r in decontaminate.without_benchmark(docs_of(spark, texts), bench).collect()} == {3, 4, 5, None}
    assert decontaminate.contaminated(docs_of(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_after_many_inconsistent_variants(spark):
    item = "she buys 5 red apples and then 5 green pears and then 5 blue plums and then 5 ripe figs for the table at home"
    numbers = iter(range(100, 1000))
    variants = [re.sub(r"\b5\b", lambda _: str(next(numbers)), item) for _ in range(12)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [(1, " so ".join([*variants, item.replace("5", "7")])), (2, " so ".join(variants))]
    got = {(r["doc_id"], r["consistent"]) for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == {(1, 1.0)}


def test_decontamination_on_one_diagonal_with_literal_words(spark):
    rng = random.Random(33)
    item = "a boat sails down the river for two whole days before its tired captain sees the old harbour where his brother sells fresh bread"
    w, far = item.split(), [rng.choice(VOCAB) for _ in range(2000)]
    numbers = " ".join(str(rng.randrange(1000)) for _ in range(60))
    bench = spark.createDataFrame([(1, item), (2, "12 7 55 and 3 9 18 and 4 6 88"), (3, numbers)], "item_id long, text string")
    texts = [
        (1, " ".join([*w[-8:], *far, *w[:8]])), (2, "scores 1 2 3 and 4 5 6 and 7 8 9 today"), (3, " ".join(str(rng.randrange(10_000)) for _ in range(6000))),
        (4, " ".join([*far[:50], *w[:12], "slowly", *w[12:], *far[50:90]])), (5, "see 12 7 55 and 3 9 18 and 4 6 88 here"), (6, f"{numbers} {numbers}"), (7, " ".join([*w[:9], *w[11:]])),
    ]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    assert set(got) == {(4, 1), (5, 2), (6, 3), (7, 1)} and got[4, 1]["end"] - got[4, 1]["start"] == len(w) + 1 and got[4, 1]["start"] == 50


def test_decontamination_against_brute_force(spark):
    rng = random.Random(21)
    some = lambda n: [rng.choice(["the", "of", "cat", "ran", "home", "7", "12", "kg", "Bob", "Ann.", "blue"]) for _ in range(n)]
    bench = [(i, " ".join(some(rng.choice([2, 3, 5, 7, 9, 20, 30])))) for i in range(30)] + [(40, "..."), (41, "")]
    texts = []
    for i in range(120):
        own = some(rng.randint(0, 60))
        if i % 2:
            item = rng.choice(bench)[1].split()
            own[len(own) // 2 : len(own) // 2] = [str(rng.randint(1, 99)) if w.isdigit() and rng.random() < 0.5 else w for w in item]
        texts.append((i, " ".join(own)))
    texts += [(500, bench[0][1]), (500, bench[0][1]), (None, bench[5][1]), (501, None), (502, " ".join(["7"] * 3000))]

    def parts(text):
        t = decontaminate.Templates([text], decontaminate.WordTable())
        return t.t.tolist(), t.slot.tolist(), t.value.tolist()

    want = collections.Counter()
    known = [(i, parts(x)) for i, x in bench]
    for doc, text in texts:
        tt, ts, tv = parts(text)
        for item, (it, is_, iv) in known:
            size = min(8, len(it))
            if not size or (len(it) < 3 and len(it) != len(tt)):
                continue
            literal = lambda sl, p: sum(x == 0 for x in sl[p : p + size])
            by_words = lambda sl, p: size < 6 or literal(sl, p) < 3
            same = lambda p, q: by_words(is_, p) == by_words(ts, q) and (iv[p : p + size] == tv[q : q + size] if by_words(is_, p) else it[p : p + size] == tt[q : q + size])
            hits = [(p, q) for p in range(len(it) - size + 1) for q in range(len(tt) - size + 1) if same(p, q)]
            held = []
            for side, band in {(i, (q - p + 8 * i) // 16) for p, q in hits for i in (0, 1)}:
                own = [(p, q) for p, q in hits if (q - p + 8 * side) // 16 == band]
                covered = {p + k for p, _ in own for k in range(size)}
                if len(covered) / len(it) < 0.5:
                    continue
                shares = []
                for d in {q - p for p, q in own}:
                    places = {p + k for p, q in own if q - p == d for k in range(size)}
                    values = collections.defaultdict(collections.Counter)
                    for p in places:
                        if is_[p] and ts[p + d]:
                            values[iv[p]][tv[p + d]] += 1
                    if values:
                        shares.append(sum(max(c.values()) for c in values.values()) / sum(sum(c.values()) for c in values.values()))
                best = max(shares, default=1.0)
                if best >= 0.8:
                    held.append((-len(covered) / len(it), -best, min(q for _, q in own), max(q for _, q in own) + size))
            if held:
                c, agree, start, end = min(held)
                want[doc, item, start, end, round(-c, 6), round(-agree, 6)] += 1
    docs = docs_of(spark, texts).withColumn("item", F.lit(1)).withColumn("at", F.lit(2))
    rows = decontaminate.contaminated(docs, spark.createDataFrame(bench * 2, "item_id long, text string")).collect()
    got = collections.Counter((r["doc_id"], r["item_id"], r["start"], r["end"], round(r["covered"], 6), round(r["consistent"], 6)) for r in rows)
    assert got == want and len(want) > 40
    assert decontaminate.contaminated(docs.limit(0), spark.createDataFrame(bench, "item_id long, text string")).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum((v - 9 if v > 9 else v) for v in (int(c) * (1 + i % 2) for i, c in enumerate(d[::-1]))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]


def test_personal_data(spark):
    rng = random.Random(2)
    texts = ["a.b+c@x-y.co.uk é😀 x@y.z_d@e.fg", "1.2.3.4.5.6.7.8 0001.002.3.255 1.2.3.256 1234.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (988) 555-2485 +49 12", None, "", "9" * 4000, "a" * 3000 + "@b.c"]
    texts += ["".join(rng.choice("0123.@+- ab(") for _ in range(60)) for _ in range(150)]
    got = {r["doc_id"]: r for r in pii.personal_data(docs_of(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        found = sorted((m.start(), k, m.end(), kind) for k, kind in enumerate(PATTERNS) for m in re.finditer(PATTERNS[kind], t or "") if holds(kind, m[0]))
        said = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(x[3] == k for x in found) for k in PATTERNS]
    known = [(i, f"{' '.join(words(5))} member code x{i}@site{i}.org") for i in range(30)] + [(40, "the member code AB-99213 now"), (41, "no code 12345678 here")]
    spans = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs_of(spark, known)).collect()}
    assert spans[40] == "id:16:24" and spans[41] == ""


def test_personal_data_with_phones_and_plain_emails_as_seeds(spark):
    phones = [(i, f"{' '.join(words(5))} reach me +1 (743) 555-38{i:02d} now") for i in range(10, 30)]
    emails = [(i, f"{' '.join(words(5))} write to {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}@plain.org") for i in range(30, 60)]
    long = "y" * 300
    cards = [(i, f"{long} card 4111 1111 1111 {n} or so") for i, n in zip(range(60, 80), [f"{n:04d}" for n in range(3000) if holds("card", f"411111111111{n:04d}")], strict=False)]
    new = {100: "please reach me AB-99213 soon", 101: "item 3 write to ZX12345", 102: f"z {long} card QQ-77123", 103: "no such AB-99213 here", 104: "room 123456 reach me KL-88888"}
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs_of(spark, [*phones, *emails, *cards, *new.items()])).collect()}
    at = {i: new[i].rindex(x) for i, x in ((100, "AB-99213"), (101, "ZX12345"), (102, "QQ-77123"), (104, "KL-88888"))}
    assert {i: got[i] for i in new} == {100: f"id:{at[100]}:{at[100] + 8}", 101: f"id:{at[101]}:{at[101] + 7}", 102: f"id:{at[102]}:{at[102] + 8}", 103: "", 104: f"id:{at[104]}:{at[104] + 8}"}


def test_personal_data_bootstraps_from_what_it_finds(spark):
    seeds = [(i, f"{' '.join(words(5))} member code x{i}@site{i}.org") for i in range(60)]
    first = [(100 + i, f"the member code AB-9921{i} now") for i in range(10)]
    again = [(200 + i, f"see badge no AB-9921{i}; here") for i in range(10)]
    new = [(300, "see badge no ZZ-77777, here"), (301, "nothing but ZZ-88888 here"), (302, "a badge of 12345678")]
    rows = [*seeds, *first, *again, *new]
    got = {r["doc_id"]: r for r in pii.personal_data(docs_of(spark, rows + rows[:1])).collect()}
    assert all(got[i]["spans"] == "id:16:24" and got[i]["n_found"] == 1 for i, _ in first) and all(got[i]["spans"] == "id:13:21" for i, _ in again)
    assert got[300]["spans"] == "id:13:21" and got[301]["spans"] == got[302]["spans"] == "" and got[0]["n_found"] == 0


def test_personal_data_finds_tokens(spark):
    rng = random.Random(3)
    hexed = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    token = [(i, f'{" ".join(words(4))} token = "{hexed()}"### {" ".join(words(3))}') for i in range(12)]
    rows = [*token, (50, 'my token = "AKIA-1234-XYZW" is new'), (51, f"{hexed()} stands alone"), (52, "item 1234567 and 7654321 x")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs_of(spark, rows)).collect()}
    for i, text in token:
        at = text.index('"') + 1
        assert got[i] == f"id:{at}:{at + 40}"
    assert got[50] == "id:12:26" and got[51] == "" and got[52] == ""


def test_personal_data_of_many_numbered_words(spark):
    text = " ".join(f"w{i}x {i % 250}.1.2.3 a{i}@b.cd" for i in range(8000))
    began = time.time()
    row = pii.personal_data(docs_of(spark, [(1, text), (2, "")])).where("doc_id = 1").first()
    assert row["n_ip"] == row["n_email"] == 8000 and time.time() - began < 60
    found = sorted((m.start(), k, m.end(), kind) for k, kind in enumerate(PATTERNS) for m in re.finditer(PATTERNS[kind], text) if holds(kind, m[0]))
    assert row["base_sha256"] == hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found).encode()).hexdigest()
    assert pii.personal_data(docs_of(spark, []).limit(0)).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(float).tolist()) for i in range(300)] + [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (None, [1.0] * 6)]
    rows += [(500, rows[7][1]), (501, rows[7][1])]
    vectors = search.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)))
    got = collections.defaultdict(list)
    for r in search.top_k(vectors, vectors.where(search.every(100)), 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = {i: np.floor(np.array(v) * 1024).astype(np.int64) for i, v in rows if i is not None and i not in (400, 401, 402)}
    assert sorted(got) == [0, 100, 200, 500]
    for q, found in got.items():
        want = sorted(((int(whole[q] @ v), -i) for i, v in whole.items() if i != q), reverse=True)[:10]
        assert found == [(-i, s) for s, i in want]
    assert search.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    held = {r["doc_id"] for r in decontaminate.contaminated(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")).collect()}
    assert rows and not held & {r["doc_id"] for r in rows} and max(r["length"] for r in rows) <= 2048


def test_pipeline_stages_on_small_tables(spark, tmp_path):
    """Every stage against a plain reading of what it is to keep, with nulls, repeated rows and extra columns; and empty tables."""
    import corpus_pipeline

    rng = random.Random(30)
    some = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    item = "A train travels 120 km from Paris to Lyon in 3 hours and then it returns with half of that speed to the station"
    rows = [(i, "top line\n" + " ".join(some(30) + (["vile", "scum"] if i % 5 == 0 else [])), "en", f"s{i % 2}", 1) for i in range(200)]
    near = some(80)
    rows += [(300 + i, " ".join(near[:-1] + [f"x{i}"]), "en", "t", 1) for i in range(5)] + [(310, f"{' '.join(some(9))} {item}", "en", "t", 1)]
    rows += [(320, None, None, None, None), (321, "", "en", "t", 0), (322, "twice the row", "en", "t", 1), (322, "twice the row", "en", "t", 1), (None, "no id here", "en", "t", 1)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(200)]
    tables = {"documents": spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(1)), "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string")}
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / "full" / f"{name}.parquet"))
        df.limit(0).write.parquet(str(tmp_path / "empty" / f"{name}.parquet"))
    sf, ids, docs = str(tmp_path / "full"), {}, tables["documents"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, sf)
        if name != "best_fit_packing":
            assert docs.columns == before
            docs.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            ids[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = {r[0] for r in rows if not (r[0] is not None and r[0] < 200 and r[0] % 5 == 0)}
    assert len(clean ^ set(ids["toxicity"])) <= 4
    assert set(ids["line_dedup"]) == set(ids["toxicity"]) and not any((t or "").startswith("top line") for t in ids["line_dedup"].values())
    assert set(ids["line_dedup"]) - set(ids["minhash_near_dedup"]) == {301, 302, 303, 304} and {None, 320, 321, 322} <= set(ids["minhash_near_dedup"])
    assert set(ids["minhash_near_dedup"]) - set(ids["benchmark_decontamination"]) == {310}
    packed = docs.collect()
    assert {r["doc_id"] for r in packed} == set(ids["benchmark_decontamination"]) and sum(r["doc_id"] == 322 for r in packed) == 1
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
