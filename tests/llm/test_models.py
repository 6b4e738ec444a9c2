import itertools
import zlib

import numpy as np
import pytest

from voxtable.llm import langid, registry, toxicity

SF = "/root/testdata/sf0.01"


def brute_marginals(emit, moves):
    """Over all label sequences."""
    n, k = emit.shape
    out = np.zeros((n, k))
    for seq in itertools.product(range(k), repeat=n):
        w = np.exp(sum(emit[i, s] for i, s in enumerate(seq)) + sum(moves[a, b] for a, b in zip(seq, seq[1:], strict=False)))
        for i, s in enumerate(seq):
            out[i, s] += w
    return out / out.sum(axis=1, keepdims=True)


def test_marginals_against_all_sequences(monkeypatch):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(langid, "SEGMENT", 3)
    sizes = np.array([1, 7, 3, 4])
    emit, moves = rng.normal(size=(15, 3)), np.array([[1.0, -1, 0], [0.5, 0, 0], [0, 0, 2]])
    # The first word's incoming move is uniform over labels: fold it into its emission.
    got = langid.marginals(emit, sizes, moves)
    at = 0
    for n in sizes:
        e = emit[at : at + n].copy()
        e[0] += np.log(np.exp(moves).mean(axis=0))
        assert np.allclose(got[at : at + n], brute_marginals(e, moves))
        at += n


@pytest.fixture(scope="module")
def predicted(spark):
    return {r["doc_id"]: r for r in registry.op10_language_crf(spark, SF).collect()}


def test_held_out_accuracy(spark, predicted):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 100 and all(predicted[d["doc_id"]]["held_out"] for d in held)
    assert np.mean([predicted[d["doc_id"]]["lang_pred"] == d["lang"] for d in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in predicted.values())


def test_language_of_odd_rows(spark, odd, none):
    model = langid.fit([("the dog and the fox", "en"), ("der hund und das haus", "de")] * 20)
    rows = langid.predict(odd, model, keep=True).collect()
    assert len(rows) == odd.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["row"]["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert letters or r["score"] == 0
    mixed = langid.predict(spark.createDataFrame([(1, "the dog and the fox the dog und das haus")], "doc_id long, text string"), model).first()
    assert mixed["lang_pred"] == "en" and 0.4 < mixed["score"] < 1
    assert langid.predict(none, langid.train(none)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.train(none)).collect()} == {"und"}


def test_language_ignores_labels(spark, predicted):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    blank = docs.selectExpr("doc_id", "text", "'xx' as lang", "'none' as source")
    same = {r["doc_id"]: r["lang_pred"] for r in langid.predict(blank, model).collect()}
    assert same == {k: r["lang_pred"] for k, r in predicted.items()}


def test_chain_learns_and_later_models_see_earlier_ones():
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(300)]
    texts, labels = [], []
    for _ in range(800):
        a, b = rng.random() < 0.3, rng.random() < 0.3
        texts.append(" ".join([*rng.choice(words, 30), *["spam"] * a, *["nasty"] * (a and b)]))
        labels.append((int(a), int(a and b)))
    owner, f = toxicity.doc_features(texts)
    rows = np.split(f, np.searchsorted(owner, np.arange(1, len(texts))))
    chain = toxicity.fit(rows, np.array(labels), ["spam", "nasty"])
    x = np.zeros((len(texts), len(chain.features)))
    owner, f = toxicity.doc_features(texts, chain.features)
    x[owner, f.astype(int)] = 1
    got = np.stack(chain.predict(x), axis=1) >= 0.5
    assert (got == np.array(labels)).mean() > 0.98
    assert len(chain.links[1].weights) == len(chain.links[1].chosen) + 2  # base and one earlier category


def test_out_of_fold_by_brute_force():
    rng = np.random.default_rng(3)
    n, vocabulary = 240, 40
    rows = [np.unique(rng.choice(vocabulary, 8)).astype(np.uint64) * np.uint64(77) for _ in range(n)]
    dense = np.array([[w * 77 in r.tolist() for w in range(vocabulary)] for r in rows], float)
    y = (dense[:, 3] + dense[:, 5] + rng.random(n) > 1.2).astype(float)
    earlier, fold = [rng.random(n)], rng.integers(0, 4, n)
    got = toxicity.out_of_fold(toxicity.Sample(rows), y, earlier, fold, 6)
    often = np.flatnonzero(dense.sum(axis=0) >= 4)
    for k in range(4):
        train = fold != k
        z = []
        for w in often:
            a, b = (dense[train, w] @ y[train] + 0.1) / (y[train].sum() + 1), (dense[train, w] @ (1 - y[train]) + 0.1) / ((1 - y[train]).sum() + 1)
            p = dense[train, w].mean()
            z.append(abs(a - b) / np.sqrt(p * (1 - p) * (1 / (y[train].sum() + 1) + 1 / ((1 - y[train]).sum() + 1))))
        best = sorted(w for _, w in sorted((-v, w) for v, w in zip(z, often, strict=True))[:6] if z[list(often).index(w)] > 4)
        odds = np.log(np.clip(earlier[0], 1e-3, 1 - 1e-3) / np.clip(1 - earlier[0], 1e-3, 1))
        x = np.column_stack([np.ones(n), dense[:, best], odds])
        w, ridge = np.zeros(x.shape[1]), np.array([1e-6] + [1.0] * (x.shape[1] - 1))
        for _ in range(20_000):  # plain ascent
            w = w + 0.01 * (x[train].T @ (y[train] - 1 / (1 + np.exp(-x[train] @ w))) - ridge * w)
        assert len(best) and np.allclose(got[~train], 1 / (1 + np.exp(-x[~train] @ w)), atol=1e-3)


def test_held_out_toxicity(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chain = toxicity.train(docs, labels.where("doc_id % 2 = 0"), registry.CATEGORIES)
    rows = toxicity.predict(docs.join(labels.where("doc_id % 2 = 1").select("doc_id", "toxic"), "doc_id"), chain, keep=True).select("p_toxic", "row.toxic").collect()
    toxic = [r["p_toxic"] >= 0.5 for r in rows if r["toxic"]]
    clean = [r["p_toxic"] >= 0.5 for r in rows if not r["toxic"]]
    assert len(toxic) > 30 and np.mean(toxic) > 0.6 and np.mean(clean) < 0.01


def test_one_id_repeated_does_not_flood_training(spark):
    docs = spark.createDataFrame([(1, f"text number {i} of one id", "en") for i in range(500)] + [(i, f"other {i}", "en") for i in range(2, 30)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 30)] + [(40, 1, 2), (41, 1, -1)], "doc_id long, quality int, toxic int")
    seen = []
    keep = toxicity.fit
    try:
        toxicity.fit = lambda rows, y, names: seen.append((len(rows), sorted(set(y[:, -1].tolist())))) or keep(rows, y, names)
        toxicity.train(docs, labels, registry.CATEGORIES)
    finally:
        toxicity.fit = keep
    assert seen == [(29, [0, 1])]


def test_every_language_and_long_texts_train(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "fit", lambda rows: seen.extend(rows))
    rows = [(i, f"text {i} of language {i % 230}", f"l{i % 230}") for i in range(2, 2000)] + [(5000 + i, "long words only here " * 3000, "long") for i in range(30)]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {lang for _, lang in seen} == {f"l{i}" for i in range(230)} | {"long"}
    assert [len(t) for t, lang in seen if lang == "long"] == [20_000]  # equal texts once


def test_toxicity_of_labelled_rows(spark):
    rows = {r["doc_id"]: r for r in registry.op5_toxicity_chain(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    toxic = [rows[r["doc_id"]]["is_toxic"] for r in labels if r["toxic"]]
    clean = [rows[r["doc_id"]]["is_toxic"] for r in labels if not r["toxic"]]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.005


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (8, 0, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(odd, labels, registry.CATEGORIES)
    rows = toxicity.predict(odd, chain, keep=True).collect()
    assert len(rows) == odd.count() and all(0 <= r["p_toxic"] <= 1 for r in rows)
    untrained = toxicity.train(none, labels.limit(0), registry.CATEGORIES)
    assert {r["p_toxic"] for r in toxicity.predict(odd, untrained).collect()} == {0.0}
    assert toxicity.predict(none, untrained).count() == 0
