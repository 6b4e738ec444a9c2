"""Toxicity by a classifier chain.

The categories are columns of 0/1 labels, in an order.  Each has a logistic model over
the presence of selected words and word beginnings; a later category's model also sees the earlier categories'
probabilities.  For training those are out of fold (each row's comes from a model that did not see it, neither for its weights nor
for its choice of features), so a later model learns how far to trust them; for prediction they come from the model fitted to all training rows.

Training takes a bounded sample of labelled rows (about ``per_class`` of each value of the last
category, by the hash of their id; of repeated ids the greatest labels count); prediction takes every row and its whole text.  Null and empty texts
have no features and get the chain's base probabilities, far below the threshold.  Rows without labels, or with a label that is null or neither 0 nor 1,
do not train; without both values of a category its probability is the share seen (0 without rows).  Row ids may repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text, small_batches, stretch, whole_row, within_share
from .words import Spelling, tokens

_TOKEN = re.compile(r"\w+|[^\w\s]+")
PREFIXES = (4, 5, 6)


def doc_features(texts: list[str], selected: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) pairs, each once, sorted: hashes of words and of word beginnings; with ``selected``
    (sorted hashes) only those, as places in it."""
    sizes, codes, words = tokens([t.lower() for t in texts], _TOKEN)
    s = Spelling(words)
    text = np.repeat(np.arange(len(texts)), sizes)
    pairs = []
    for h, ok in [(s.whole(), np.ones(len(words), bool)), *(s.prefix(n) for n in PREFIXES)]:
        if selected is None:
            feature, keep = h, ok[codes]
        else:
            at = np.minimum(np.searchsorted(selected, h), max(len(selected) - 1, 0))
            feature = at.astype(np.uint64)
            keep = (ok & (selected[at] == h))[codes] if len(selected) else np.zeros(len(codes), bool)
        pairs.append(np.stack([text[keep].astype(np.uint64), feature[codes[keep]]]))
    both = np.concatenate(pairs, axis=1)
    order = np.lexsort((both[1], both[0]))
    both = both[:, order]
    if both.shape[1]:
        both = both[:, np.append(True, (np.diff(both[0]) != 0) | (np.diff(both[1]) != 0))]
    return both[0].astype(np.int64), both[1]


@dataclass
class Link:
    """One category's model: over the features chosen for it and the earlier categories' log-odds."""

    name: str
    chosen: np.ndarray
    weights: np.ndarray
    base: float | None = None  # a constant probability, where labels have one value only

    def probability(self, x: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
        if self.base is not None:
            return np.full(len(x), self.base)
        return _sigmoid(_design(x[:, self.chosen], earlier) @ self.weights)


@dataclass
class Chain:
    features: np.ndarray  # sorted hashes
    links: list[Link] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for link in self.links:
            out.append(link.probability(x, out))
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _design(x: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    odds = [np.log(np.clip(p, 1e-3, 1 - 1e-3) / np.clip(1 - p, 1e-3, 1)) for p in earlier]
    return np.column_stack([np.ones(len(x)), x, *odds])


def _newton(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _places(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places in ``known`` (sorted) of the values that are in it."""
    if not len(known):
        return np.zeros(0, np.int32)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return at[known[at] == values].astype(np.int32)


class Sample:
    """Training texts as (text, feature) pairs, sorted by text; features that fewer than ``least`` texts have are never chosen."""

    def __init__(self, rows: list[np.ndarray], least: int = 4) -> None:
        self.n = len(rows)
        feature = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
        feature.sort()
        first = np.flatnonzero(np.append(True, feature[1:] != feature[:-1])) if len(feature) else np.zeros(0, np.int64)
        total = np.diff(np.append(first, len(feature)))
        self.features = feature[first[total >= least]]
        slots = [_places(self.features, r) for r in rows]
        self.owner = np.repeat(np.arange(self.n, dtype=np.int32), [len(s) for s in slots])
        self.slot = np.concatenate(slots) if rows else np.zeros(0, np.int32)

    def chosen(self, y: np.ndarray, among: np.ndarray, most: int) -> np.ndarray:
        """The features that tell the labels of the texts in ``among`` apart best: of the ``most`` with the greatest difference, in
        standard errors, between their shares in both classes, those beyond 4."""
        inside = among[self.owner]
        own, slot = self.owner[inside], self.slot[inside]
        total = np.bincount(slot, minlength=len(self.features))
        pos = np.bincount(slot, weights=y[own], minlength=len(self.features))
        n, p1 = among.sum(), y[among].sum()
        p0 = n - p1
        a, b = (pos + 0.1) / (p1 + 1), (total - pos + 0.1) / (p0 + 1)
        share = total / max(n, 1)
        z = (a - b) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / (p1 + 1) + 1 / (p0 + 1)))
        best = np.argsort(-np.abs(z), kind="stable")[:most]
        return np.sort(best[np.abs(z[best]) > 4])

    def presence(self, chosen: np.ndarray) -> np.ndarray:
        """(texts, chosen features) of 0 and 1."""
        place = np.full(len(self.features), -1)
        place[chosen] = np.arange(len(chosen))
        x = np.zeros((self.n, len(chosen)))
        used = place[self.slot] >= 0
        x[self.owner[used], place[self.slot[used]]] = 1
        return x


def out_of_fold(sample: Sample, y: np.ndarray, earlier: list[np.ndarray], fold: np.ndarray, most: int) -> np.ndarray:
    """Each text's probability from a model, features and weights, of the other folds' texts."""
    out = np.zeros(sample.n)
    for k in np.unique(fold):
        train = fold != k
        if not train.any() or y[train].min() == y[train].max():
            out[~train] = y[train].mean() if train.any() else 0.0
            continue
        design = _design(sample.presence(sample.chosen(y, train, most)), earlier)
        out[~train] = _sigmoid(design[~train] @ _newton(design[train], y[train]))
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, names: list[str], most: int = 256, folds: int = 5, seed: int = 5) -> Chain:
    """rows: each training text's feature hashes; labels: (texts, categories) of 0 and 1."""
    sample, everyone = Sample(rows), np.ones(len(rows), bool)
    ys = [labels[:, c].astype(float) for c in range(len(names))]
    chosen = [sample.chosen(y, everyone, most) for y in ys]
    union = np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
    chain, earlier = Chain(sample.features[union]), []
    fold = np.random.default_rng(seed).integers(0, folds, sample.n)
    for c, (name, y) in enumerate(zip(names, ys, strict=True)):
        if not sample.n or y.min() == y.max():
            chain.links.append(Link(name, np.zeros(0, np.int64), np.zeros(0), float(y.mean()) if sample.n else 0.0))
            earlier.append(np.full(sample.n, chain.links[-1].base))
            continue
        chain.links.append(Link(name, np.searchsorted(union, chosen[c]), _newton(_design(sample.presence(chosen[c]), earlier), y)))
        if c + 1 < len(names):
            earlier.append(out_of_fold(sample, y, earlier, fold, most))
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text", per_class: int = 3000, most_chars: int = 20_000) -> Chain:
    """categories: (name, SQL expression over ``labels`` giving 0 or 1), in the chain's order.  A sampled id trains with one text, the first by
    hash; of a text of more than ``most_chars`` code points a stretch of that length trains, which begins where its hash says."""
    ys = [f"_y{i}" for i in range(len(categories))]
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), *[F.expr(e).cast("int").alias(y) for y, (_, e) in zip(ys, categories, strict=True)]).dropna()
    for y in ys:
        marked = marked.where(F.col(y).isin(0, 1))
    last = ys[-1]
    marked = marked.groupBy("doc_id").agg(*[F.max(y).alias(y) for y in ys])
    seen = {r[last]: r["n"] for r in marked.groupBy(last).agg(F.count("*").alias("n")).collect()}  # two rows
    share = F.when(F.col(last) == 1, per_class / max(1, seen.get(1, 0))).otherwise(per_class / max(1, seen.get(0, 0)))
    sample = marked.where(within_share(F.col("doc_id"), share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            owner, feature = doc_features(texts)
            parts = np.split(feature, np.searchsorted(owner, np.arange(1, len(texts))))
            yield pa.RecordBatch.from_arrays([pa.array((x.tobytes() for x in parts), pa.binary()), *batch.columns[1:]], names=["f", *ys])

    small_batches(docs)
    drawn = id_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").select("doc_id", stretch(F.col("text"), most_chars).alias("text"), *ys)  # about 2 * per_class ids
    one = drawn.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"), *[F.first(y).alias(y) for y in ys])
    found = one.select("text", *ys).mapInArrow(run, "f binary, " + ", ".join(f"{y} int" for y in ys)).collect()
    found = sorted(found, key=lambda r: (r["f"], *[r[y] for y in ys]))
    y = np.array([[r[y] for y in ys] for r in found]).reshape(len(found), len(ys))
    return fit([np.frombuffer(r["f"], np.uint64) for r in found], y, [name for name, _ in categories])


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", *, keep: bool = False) -> DataFrame:
    """(doc_id, p_<category> double for each category); with ``keep`` also ``row``, a struct of the input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x = np.zeros((len(texts), len(chain.features)))
            owner, feature = doc_features(texts, chain.features)
            x[owner, feature.astype(np.int64)] = 1
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, chain.predict(x)), *batch.columns[2:]], names=["doc_id", *names, *["row"] * keep])

    names = [f"p_{link.name}" for link in chain.links]
    small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), *[whole_row(docs).alias("row")] * keep)
    out = T.StructType().add("doc_id", "long")
    for n in names:
        out = out.add(n, "double")
    return rows.mapInArrow(run, out.add("row", docs.schema) if keep else out)
