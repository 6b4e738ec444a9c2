import collections
import hashlib
import random
import re
import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

from helpers import brute_groups, roots
from voxtable.llm import graph, licenses, lm, neardup, pii, registry, topk

SF = "/root/testdata/sf0.001"


def oracle(name, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return collections.Counter(con.sql(registry.ORACLE_SQL[name]).fetchall()), con.sql(registry.ORACLE_SQL[name]).columns


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    want, columns = oracle(name)
    assert collections.Counter(map(tuple, registry.QUERIES[name](spark, SF).select(*columns).collect())) == want


# Language model.


def test_scores_by_definition(spark, odd, none):
    import math

    rows = lm.scores(odd, order=3, block_bytes=1000, bucket_grams=50).collect()
    texts = [(r["doc_id"], re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) for r in odd.collect()]
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in texts]
    counts = collections.Counter(tuple(w[i : i + n]) for _, w in words for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(len(w) for _, w in words)

    def s(gram):
        if len(gram) == 1:
            return math.log(counts[gram] / total)
        if counts[gram] >= 2:
            return math.log(counts[gram] / counts[gram[:-1]]) if counts[gram[:-1]] >= (2 if len(gram) > 2 else 1) else math.log(0.4) + s(gram[1:])
        return math.log(0.4) + s(gram[1:])

    want = collections.Counter((d, len(w), sum(round(1e6 * s(tuple(w[max(0, i - 2) : i + 1]))) for i in range(len(w)))) for d, w in words)
    assert collections.Counter(tuple(r)[:3] for r in rows) == want
    assert all(r["mean_score"] == (r["log_score"] / r["n_words"] if r["n_words"] else None) for r in rows)
    assert lm.scores(none).count() == 0


def test_trigram_scores_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(lm.oracle_sql(order=3))
    got = lm.scores(spark.read.parquet(f"{SF}/documents.parquet"), order=3, block_bytes=50_000, bucket_grams=5000).select(want.columns)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want.fetchall())


def test_rows_never_outnumber_ngrams():
    import numpy as np

    keys = np.unique(np.random.default_rng(0).integers(0, 2**64, 1000, np.uint64))
    for buckets in (1, 7, 2**31):
        of, first = lm._runs(keys, buckets)
        assert of.tolist() == sorted({(int(k) >> 32) * buckets >> 32 for k in keys.tolist()}) and len(of) == len(first) <= 1000
        assert first[0] == 0 and (np.diff(first) > 0).all()


# Components and near duplicates.


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(250)] + [(5, 5), (7, 8), (7, 8)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == roots([(a, b) for a, b in pairs if a != b])
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n,percent,chunk,most", [(3, 85, 1_500_000, 64), (5, 80, 2_000, 64), (3, 85, 1_500_000, 5)])
def test_groups_against_all_pairs(spark, monkeypatch, n, percent, chunk, most):
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    monkeypatch.setattr(neardup, "ROWS", most)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(6):  # families of copies with a few words changed, so that links chain
        base = [word() for _ in range(120)]
        for _ in range(30):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    texts += ["one", "One", "one two", "one  two\n", "", None, "  ", "a b c", "c b a"] + texts[:3]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.groups(docs, words=n, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(rows, n, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(rows)


def test_groups_of_odd_rows(spark, odd, none):
    got = neardup.groups(odd, words=3, percent=85).collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[10][0]["component_id"] == 1 and not by[10][0]["kept"]
    assert [r["component_id"] for r in by[8]] == [8, 8]
    assert by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert all(by[d][0]["n_shingles"] == 0 and by[d][0]["component_id"] == d for d in (2, 3, 4))
    assert neardup.groups(none).count() == 0


def test_repeated_rows_are_kept_or_not_together(spark):
    rows = [(1, "some text here"), (1, "some text here"), (2, "some text here"), (3, "another one"), (3, None)]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True)]


def test_groups_of_one_id_on_different_texts(spark):
    word = lambda k, i: f"w{k}x{i}"
    text = lambda k: [word(k, i) for i in range(80)]
    near = lambda k: " ".join([*text(k)[:-1], "changed"])
    rows = [(1, " ".join(text(k))) for k in range(12)] + [(7 + k, near(k)) for k in range(12)]  # a hot id of twelve texts, and a near copy of each
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=3, percent=85).collect()
    assert len(got) == 24 and all(r["component_id"] == 1 for r in got)
    assert {r["doc_id"] for r in got if r["kept"]} == {1} and sum(r["kept"] for r in got) == 12
    again = neardup.groups(spark.createDataFrame([*rows, (1, rows[0][1])], "doc_id long, text string"), words=3, percent=85).collect()
    assert len(again) == 25 and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in again) and sum(r["kept"] for r in again) == 13


def test_banding_misses_little():
    for percent in (80, 85, 90):
        bands, perms = neardup.banding(percent)
        assert (1 - (percent / 100) ** (2 * perms)) ** bands <= 1.01e-6


# Personal data.

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fits(kind, m):
    d = re.sub(r"\D", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute_spans(text):
    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if fits(k, m[0]))


def test_base_spans_against_re(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 70))) for signs in ("01248 9.@-+ab_(%é\U0001f600", "0145 .-+", "a.@-_") for _ in range(2500)]
    texts += ["1" * 60_000, "a" * 60_000 + "@b.c", "1 " * 20_000, "+1" + "(" * 30_000, None, "", "x a@b.c_d@e.f y", "4111 1111-1111 1111", "+1 (499) 555-6503", "999.1.1.1 1.2.3.4.5"]
    rows = pii.report(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_spans(texts[r["doc_id"]])
        said = ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), texts[r["doc_id"]][:80]
        assert [r[f"n_{k}"] for k in BASE] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert set(said.split(",")) - {""} <= set(r["spans"].split(","))


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(6)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32))
    rows = [(i, f"words before secret_key={key()} and after") for i in range(30)]
    rows += [(100, "the secret_key=hunter22 is short"), (101, "about 100000 people and 2024-10-11 dates"), (102, "my secret_key=ops@corp.example.com here")]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"])
    got = {r["doc_id"]: r for r in pii.report(found).collect()}
    assert got[100]["spans"] == "identifier:15:23" and got[101]["spans"] == ""
    assert got[102]["n_email"] == 0 or got[102]["n_identifier"] == 0  # never two over each other
    clean = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    assert clean[100] == "the secret_key=[IDENTIFIER] is short" and clean[101] == rows[31][1]


def test_base_spans_of_each_kind_are_seeds(spark):
    spoken = [f"words tel: +1499555{6500 + i} and after" if i % 2 else f"words tel: +1 (499) 555-{6500 + i} and after" for i in range(30)]
    cards = [c for c in (f"4111 1111 1111 {i}" for i in range(1000, 2000)) if fits("card", c)][:30]
    texts = [*spoken, *(f"words card= {c} and after" for c in cards), "words tel: 5551234 and after", "words card= AB1234567 and after", "words size: 5551234 and after"]
    got = {r["doc_id"]: r["spans"] for r in pii.report(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert len(cards) == 30 and all(got[i].startswith("phone:11:") for i in range(30)) and all(got[i].startswith("card:12:") for i in range(30, 60))
    assert (got[60], got[61], got[62]) == ("identifier:11:18", "identifier:12:21", "")


def test_contexts_of_words_alone(spark):
    rng = random.Random(2)
    number = lambda: "".join(rng.choice("0123456789") for _ in range(9))
    rows = [f"my mail address joe{i}@example.com is old" for i in range(40)] + [f"they had about {number()} of them" for _ in range(40)] + ["my mail address joe_at_example7 is new", "they had about 2000000 of them"]
    got = {r["doc_id"]: r["spans"] for r in pii.report(pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))).collect()}
    assert got[80] == "identifier:16:31" and not any(got[i] for i in [*range(40, 80), 81])


def test_very_many_spans_in_one_text(spark):
    import time

    n = 50_000
    text = " ".join(f"id{i}00000 x@y{i}.com" for i in range(n))
    began = time.perf_counter()
    found = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    row = pii.redact(found).first()
    assert row["text"] == re.sub(BASE["email"], "[EMAIL]", text)
    assert pii.report(found).first()["n_email"] == n
    assert time.perf_counter() - began < 120


def test_spans_that_overlap(spark):
    spans = "array<struct<start:int,kind:int,end:int>>"
    rng = random.Random(11)
    rows = []
    for i in range(300):
        cut = lambda n: sorted({(a, k, a + rng.randint(1, 9)) for a in (rng.randrange(300) for _ in range(n)) for k in (rng.randrange(4),)})
        rows.append((i, "".join(rng.choice("ab é\U0001f600") for _ in range(320)), cut(rng.randint(0, 90)), [(a, 4, b) for a, _, b in cut(rng.randint(0, 90))]))
    df = spark.createDataFrame(rows, f"doc_id long, text string, base {spans}, hits {spans}")
    clear = {r["doc_id"]: [tuple(x) for x in r["c"]] for r in df.select("doc_id", pii._clear(F.col("base"), F.col("hits")).alias("c")).collect()}
    done = {r["doc_id"]: r["text"] for r in pii.redact(df.select("doc_id", "text", "base", F.col("hits").alias("found"))).collect()}
    for i, text, b, h in rows:
        assert clear[i] == sorted(x for x in h if not any(y[0] < x[2] and x[0] < y[2] for y in b))
        out, at = [], 0
        for a, k, e in sorted(b + h):
            if a >= at:
                out += [text[at:a], f"[{pii.KINDS[k].upper()}]"]
            at = max(at, e)
        assert done[i] == "".join(out) + text[at:]


def test_pii_of_odd_rows(spark, odd, none):
    assert pii.report(pii.find(odd)).count() == odd.count()
    assert {r["base_sha256"] for r in pii.report(pii.find(odd.where("doc_id in (2, 3)"))).collect()} == {hashlib.sha256(b"").hexdigest()}
    assert pii.find(none).count() == 0


# Licences.


def brute_licences(text, templates, threshold):
    """By trying every window of the text, whatever it begins and ends with."""
    from itertools import pairwise

    words = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = list(pairwise(words))
    found = []
    for t, (name, body) in enumerate(templates):
        have = set(pairwise(re.findall("[a-z0-9]+", body.lower())))
        for lo in range(len(grams)):
            for hi in range(lo, min(len(grams), lo + int(len(have) * (2 - threshold) / threshold + 1e-9))):
                w = set(grams[lo : hi + 1])
                if grams[lo] in have and grams[hi] in have and (d := 2 * len(w & have) / (len(w) + len(have))) >= threshold:
                    found.append((-d, lo - hi, name, t, lo, hi))
    kept = []
    for w in sorted(found):
        if all(w[4] > k[5] + 1 or k[4] > w[5] + 1 for k in kept):
            kept.append(w)
    return sorted((w[3], w[4], w[5] - w[4] + 2, round(-w[0], 9)) for w in kept)


def test_licences_against_all_windows(spark):
    rng = random.Random(12)
    templates = [t for t in licenses.TEMPLATES if len(t[1].split()) < 45]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(templates)[1].split()
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(words))
                words[i : i + rng.randint(0, 1)] = rng.choice([[], ["the"], ["License,", "the"]])
            parts += words + [rng.choice(["of the", "x y z", "the License", ""])]
        texts.append("".join(w + rng.choice([" ", " ", "\n", " -- "]) for w in parts))
    got = collections.defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect():
        got[r["doc_id"]].append((r["template"], r["word"], r["n_words"], round(r["dice"], 9)))
    for i, t in enumerate(texts):
        assert sorted(got[i]) == brute_licences(t, templates, 0.8), t


def test_licences(spark, odd, none):
    body = next(t for n, t in licenses.TEMPLATES if n == "MIT" and t.startswith("Permission"))
    wrapped = "\n".join(" * " + line for line in textwrap.wrap(body, 50))
    lines = [
        (1, "x\nReleased under the MIT licence.\n"), (2, "RELEASED under the -- mit License!"), (3, "released under the"), (4, None), (5, "Licensed under the Apache License, Version 2.0.\n" * 3),
        (6, "Copyright 2020 Foo. Released under the MIT License."), (7, "This work is licensed under the\nGNU General Public License, version 3."), (8, "intro words\n" + wrapped + "\nmore words"), (9, "one line of prose " * 40 + "Licensed under CC BY 4.0. " + "and more prose " * 40),
    ]
    got = collections.Counter((r["doc_id"], r["license"], round(r["dice"], 3)) for r in licenses.scan(spark.createDataFrame(lines, "doc_id long, text string")).collect())
    assert got == {(1, "MIT", 0.857): 1, (2, "MIT", 1.0): 1, (5, "Apache-2.0", 1.0): 3, (6, "MIT", 1.0): 1, (7, "GPL-3.0", 1.0): 1, (8, "MIT", 1.0): 1, (9, "CC-BY-4.0", 1.0): 1}
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0 and licenses.scan(odd, []).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(odd, [("x", "y z")] * 6000)


# Exact search.


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_search_with_ties_and_repeats(spark, parts):
    import math

    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(6)]) for i in range(400)] + [(20, [1.0] * 6), (20, [1.0] * 6), (900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (None, [1.0] * 6), (904, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "1 as qb", "2 as rank", "vec_id as ids")
    got = topk.search(df, F.col("vec_id") % 20 == 0, k=5, parts=parts, query_block=7, block=50).collect()
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = collections.Counter()
    for q, v in fine:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in fine if i != q)[:5]
            want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    assert collections.Counter(map(tuple, got)) == want
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = df.where("vec_id in (20, 40)")
    assert topk.search(few, F.col("vec_id") % 20 == 0).count() == 3 * 1 + 1 * 3


def test_search_moves_fewer_entries_than_there_are(spark):
    rng = random.Random(18)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(3000)] + [(5000 + i, [0.5] * 16) for i in range(1500)]  # a third of all rows is one vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    counts: dict[str, int] = {}
    got = topk.search(df, F.col("vec_id") % 50 == 0, k=10, block=500, counts=counts).collect()
    assert len(got) == 10 * counts["queries"] and counts["queries"] == 90
    assert counts["candidates"] == 3000 + 20  # of equal vectors, those that can be among the best
    everything = counts["queries"] * counts["candidates"] * 2
    assert counts["gathered"] <= 0.1 * everything and counts["collected"] < 0.2 * everything


# Licences in one long text.


def test_many_notices_in_one_text():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    found = scanner.scan("\n".join(f"{licenses.TEMPLATES[0][1]} part{i} of it" for i in range(4000)))
    assert len(found) == 4000 and [f[2] for f in found] == list(range(0, 44_000, 11))


# Pipeline.


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, "12 !!", "en", "s", 5), (9002, None, "en", "s", None), (9003, "mail joe.b@example.com now please friend", "en", "s", 40)], docs.schema)
    docs = docs.unionByName(extra)
    kept = [{r["doc_id"] for r in docs.collect()}]
    for name, stage in c.STAGES[:-1]:
        docs = c.settle(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append({r["doc_id"] for r in docs.collect()})
    assert kept[0] - kept[1] == {9001, 9002}
    assert kept[1] - kept[2] < {r["doc_id"] for r in docs.sparkSession.read.parquet(f"{SF}/documents.parquet").collect()}
    assert docs.where("doc_id = 9003").first()["text"] == "mail [EMAIL] now please friend"
    packed = c.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept[-1] == kept[-2]
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0


def test_pipeline_keeps_rows_not_ids(spark):
    import corpus_pipeline as c

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (5, a + " end"), (5, b), (6, a), (6, a), (7, None), (None, b), (None, b), (8, "alone here"), (8, "alone here")]
    got = c.drop_near_duplicates(spark, spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], schema), SF)
    assert got.schema.names == schema.names
    # Id 5 loses its copy of 1's text and keeps its own; repeated rows leave one; rows without a text or an id link with nothing.
    assert collections.Counter((r["doc_id"], r["text"]) for r in got.collect()) == collections.Counter([(1, a), (5, b), (7, None), (None, b), (None, b), (8, "alone here")])


def test_language_stage_goes_by_the_models_score(spark, monkeypatch):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    model = c.langid.fit([("the dog and the fox", "en"), ("der hund und das haus", "de"), ("le chien et la maison", "fr"), ("el perro y la casa", "es")] * 20)
    monkeypatch.setattr(c.langid, "train", lambda docs: model)
    rows = [(1, "the dog and the house"), (2, "ꙮꙗꙋ"), (3, "la maison et le chien")]
    known = spark.createDataFrame([(d, t, None, "s", 1) for d, t in rows], docs.schema)
    score = {r["doc_id"]: r["score"] for r in c.langid.predict(known, model).collect()}
    assert score[2] < c.LEAST_SHARE < min(score[1], score[3])
    assert {r["doc_id"] for r in c.identify_language(spark, known, SF).collect()} == {1, 3}


def test_language_stage_without_labels(spark):
    import corpus_pipeline as c

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, "some words"), (2, "12 !!"), (3, None), (1, "some words"), (None, "no id")]
    got = c.identify_language(spark, spark.createDataFrame([(d, t, None, "s", 1) for d, t in rows], schema), SF)
    assert collections.Counter((r["doc_id"], r["text"]) for r in got.collect()) == collections.Counter([(1, "some words"), (1, "some words"), (None, "no id")])


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_of_odd_rows(spark, odd, empty):
    import corpus_pipeline as c

    docs = odd.limit(0) if empty else odd
    columns = docs.columns
    for _, stage in c.STAGES[:-1]:
        docs = c.settle(stage(spark, docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" not in docs.columns else docs, SF))
        assert docs.columns == [*columns, "n_chars"]
    ids = [r["doc_id"] for r in docs.collect()]
    packed = c.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == set(ids)
    assert not empty or not ids
    if not empty:
        assert sorted(i for i in ids if i) == [1, 6, 7, 8, 9] and None in ids  # one of the equal rows of 8, and 1 for its copy 10
