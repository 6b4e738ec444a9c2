import collections
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from helpers import brute_groups, roots
from voxtable.llm import intervals, neardup, registry, sigtree, spelling

SF = "/root/testdata/sf0.001"
VERSION = "key string, doc_id long, event long, arrival long, expiry long, n_chars long, lang string"


def both(spark, name, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, sf).select(*want.columns).collect()
    return collections.Counter(map(tuple, got)), collections.Counter(want.fetchall())


# Point-in-time join.


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_point_in_time_against_sql(spark, sf):
    got, want = both(spark, "op13_point_in_time", f"/root/testdata/sf{sf}")
    assert got == want


def test_push_down():
    rng = np.random.default_rng(1)
    for n in (0, 1, 40):
        level = rng.integers(0, 5, n)
        place = np.array([rng.integers(0, 16 - (1 << k) + 1) for k in level], np.int64)
        want = [max([i for i in range(n) if place[i] <= at < place[i] + (1 << level[i])], default=-1) for at in range(16)]
        assert intervals.push_down(level, place, np.arange(n), 4).tolist() == want


def brute(versions, labels, stale):
    out = []
    for doc, key, t in labels:
        ok = [v for v in versions if None not in (v[0], v[1], v[2], v[3], v[4], key, t) and v[0] == key and v[2] <= t and v[3] <= t < v[4]]
        best = max(ok, key=lambda v: (v[2], v[3], v[1], -1 if v[5] is None else v[5], v[6] or ""), default=None)
        age = t - best[2] if best else None
        fresh = best is not None and age <= stale
        out.append((doc, t, best and best[1], age, "none" if best is None else "fresh" if fresh else "stale", best[5] if fresh else None, best[6] if fresh else None))
    return collections.Counter(out)


def test_intervals_of_every_length(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BITS", 3)  # windows of 8, 64 and 512 units
    rng = random.Random(5)
    versions = []
    for i in range(400):
        event = rng.randrange(-2000, 3000)
        length = rng.choice([0, 1, 3, 8, 9, 60, 64, 70, 511, 513, 1500, 4000])
        versions.append((rng.choice(["a", "a", "a", "b", None]), i // 2, event, event + rng.choice([-5, 0, 0, 4]), event + length, rng.choice([7, None]), rng.choice(["en", "", None])))
    versions += versions[:20] + [("b", 9, None, 1, 50, 1, "x"), ("b", None, 1, 1, 50, 1, "x"), ("b", 9, 5, 5, None, 1, "x")]
    labels = [(i, rng.choice(["a", "a", "b", "c", None]), rng.randrange(-2100, 6000)) for i in range(600)] + [(None, "a", 10), (3, "a", None)]
    labels += labels[:5]
    v = spark.createDataFrame(versions, VERSION)
    asks = spark.createDataFrame(labels, "doc_id long, key string, t long")
    want = brute(versions, labels, 30)
    assert collections.Counter(map(tuple, intervals.latest(v, asks, stale=30).collect())) == want and {r[4] for r in want} == {"none", "stale", "fresh"}
    assert intervals.latest(v.limit(0), asks).where("status <> 'none'").count() == 0
    assert intervals.latest(v, asks.limit(0)).count() == 0


def test_point_in_time_of_odd_rows(spark, odd, none):
    docs = odd.selectExpr("*", "'s' as source", "length(text) as n_chars", "1 as event", "2 as arrival", "3 as `a.b`", "4 as `x y`")
    asks = docs.select("doc_id", "event", "`a.b`").unionByName(docs.selectExpr("99 as doc_id", "event", "`a.b`"))
    got = intervals.latest(intervals.document_versions(docs), intervals.label_times(asks, docs)).collect()
    assert len(got) == asks.count() and all(r["status"] == "none" for r in got if r["doc_id"] in (None, 99))
    assert intervals.latest(intervals.document_versions(docs.limit(0)), intervals.label_times(asks, docs.limit(0))).count() == asks.count()


# Spelling variants.


def words_of(rows, noise):
    n = collections.Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{doc}:{w}".encode()) if noise and doc is not None else 1
            if noise and h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return n


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, noise=97, least_points=5, least_n=3, ratio=2):
    n = {w: k for w, k in words_of(rows, noise).items() if len(w) >= least_points and k >= least_n}
    by = collections.defaultdict(list)
    for w in n:
        by[len(w)].append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by[len(w) + k] if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out.add((w, form[w], r, n[w], len(near[w]), form[w] and n[form[w]]))
    return out


def test_variants_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), noise=97).collect()]
    want = brute_variants(rows)
    assert len(got) == len(want) and set(got) == want and any(r[1] for r in got)


def test_variants_of_made_up_words(spark, odd, none, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    rng = random.Random(3)
    base = ["".join(rng.choice("abéÿ") for _ in range(rng.randint(5, 8))) for _ in range(40)] + ["aaaaaa", "aaaaa", "aaaaaaa", "b" * 3000, "b" * 2999 + "a", "b" * 2999]
    counts = [(w, 3 + i % 7 * 5) for i, w in enumerate(base)] + [("chainaaaa", 400), ("chainaaab", 200), ("chainaabb", 100), ("chainabbb", 50), ("chainbbbb", 25), ("chainbbbc", 12), ("chainbbcc", 6), ("chainbccc", 3)]
    rows = [(i, " ".join([w] * k)) for i, (w, k) in enumerate(counts)] + [(None, "alone12alone!Alone"), (5, None), (5, ""), (6, "×÷×÷× ×÷×÷× ×÷×÷×")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for noise in (None, 5):
        got = [tuple(r) for r in spelling.variants(docs, noise=noise).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_variants(rows, noise)
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert {tuple(r) for r in spelling.variants(odd, least_n=2, noise=7).collect()} == brute_variants(rows, 7, least_n=2)
    assert spelling.variants(none).count() == 0


def test_rolling_hashes():
    words = ["abcde", "abde", "aabbb", "", "abbb", "abcdé"]
    sizes = np.array([len(w) for w in words])
    points = np.array([ord(c) for c in "".join(words)], np.uint64)
    whole, without = spelling._rolling(points, np.cumsum(sizes) - sizes, sizes)
    short = [w[:i] + w[i + 1 :] for w in words for i in range(len(w))]
    same = dict(zip(words, whole.tolist(), strict=True)) | {}
    assert len(set(whole.tolist())) == len(words)
    for s, h in zip(short, without.tolist(), strict=True):
        assert same.setdefault(s, h) == h


# N-gram Jaccard join.


def families(rng, word, n, copies, changes):
    out = []
    for _ in range(6):  # copies with a few words changed, so that links chain
        base = [word() for _ in range(n)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randint(0, changes)):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize("n,percent,chunk,most,crowd", [(4, 85, 1_500_000, 64, 8), (5, 80, 2_000, 64, 100), (4, 85, 1_500_000, 5, 1)])
def test_join_against_all_pairs(spark, monkeypatch, n, percent, chunk, most, crowd):
    monkeypatch.setattr(sigtree, "CROWD", crowd)
    monkeypatch.setattr(sigtree, "BUCKET", 3 * crowd)
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    monkeypatch.setattr(neardup, "ROWS", most)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = families(rng, word, 120, 25, 5) + families(rng, word, 30, 8, 1) + families(rng, word, 9, 5, 1) + ["one", "One", "one two", "one  two\n", "", None, "  ", "a b c", "c b a"]
    texts += texts[:3]
    rows = list(enumerate(texts))
    got = sigtree.join(spark.createDataFrame(rows, "doc_id long, text string"), words=n, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(rows, n, percent) and len(got) == len(rows)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_join_against_sql(spark, sf):
    got, want = both(spark, "op12_ngram_join", f"/root/testdata/sf{sf}")
    assert got == want and any(r[0] != r[2] for r in got)


def test_join_of_odd_rows(spark, odd, none):
    got = collections.defaultdict(list)
    for r in sigtree.join(odd.selectExpr("*", "1 as `a.b`", "2 as `x y`", "3 as node", "4 as row"), words=4, percent=85).collect():
        got[r["doc_id"]].append((r["n_shingles"], r["component_id"]))
    assert sum(map(len, got.values())) == odd.count() and got[10] == [(6, 1)] and got[8] == [(1, 8)] * 2 and got[None] == [(2, None)]
    assert got[2] == got[2] and got[3] == [(0, 3)] and got[4] == [(0, 4)]
    assert sigtree.join(none).count() == 0


def test_every_linked_pair_shares_a_key():
    rng = np.random.default_rng(2)
    for percent in (80, 85, 100):
        bounds = sigtree.tiers(percent)
        for n in [*range(1, 40), 100, 333, 1000]:
            for _ in range(4):
                x = np.unique(rng.integers(0, 2**63, n, np.uint64))
                drop = int(rng.integers(0, n)) if n < 20 else int(rng.integers(0, n * (100 - percent) // 100 + 1))
                new = int(rng.integers(0, max(1, n // 6)))
                y = np.unique(np.r_[rng.permutation(x)[drop:], rng.integers(0, 2**63, new, np.uint64)])
                common = len(np.intersect1d(x, y))
                if len(y) and 100 * common >= percent * (len(x) + len(y) - common):
                    assert set(sigtree.part_keys(x, percent, bounds).tolist()) & set(sigtree.part_keys(y, percent, bounds).tolist()), (n, len(y), common)


def test_trees_lose_no_pair_and_prune():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**63, n, np.uint64)) for n in (3, 40, 200, 210, 1000)]
    sets = [np.unique(np.r_[b[: len(b) - k], rng.integers(0, 2**63, k, np.uint64)]) for b in base for k in range(0, max(2, len(b) // 8), max(1, len(b) // 60))]
    sets += [np.unique(rng.integers(0, 2**63, 200, np.uint64)) for _ in range(60)]
    size = [len(s) for s in sets]
    linked = {(i, j) for i in range(len(sets)) for j in range(i) for k in [len(np.intersect1d(sets[i], sets[j]))] if 100 * k >= 85 * (size[i] + size[j] - k)}
    levels = sigtree.tree(sigtree.folded([sigtree.bitmap(s, sigtree.width(len(s) * k)) for k, s in zip([2, 3] * len(sets), sets)]), np.array(size), np.ones(len(sets), bool))
    i, j = sigtree.candidates(levels, 85)
    found = {(b, a) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert linked <= {*found, *((b, a) for a, b in found)}
    for compared in (None, 5):
        got = sigtree.forest(sets, 85, compared)
        want = [(a, b) for a, b in linked if compared is None or b < compared]
        assert all((max(p), min(p)) in linked for p in got) and roots(got) == roots(want)
