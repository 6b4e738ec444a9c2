"""Language of texts by a linear-chain conditional random field over their words.

Each word's label depends on its spelling (character n-grams of one to four, those at the
word's ends being its affixes, and a lexicon of words seen often in training) and on its
neighbour's label through learned transitions.  Forward-backward gives each word's label
probabilities, exactly and over whole texts: a text is cut into segments, each segment's
transfer matrix is multiplied out, the segments are chained, and then every
segment is run from its true start and end.  A text's distribution is the mean over
its words, so code-switched texts weigh each language by its words.

A null text, or one without letters, is ``und`` with score 0; so is every text if no labelled
rows exist.  Row ids may repeat or be null (a null id is not held out); equal texts of a language train once.  Equal scores go to the language first in
alphabetical order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stretch, whole_row, within_share
from .words import Spelling, tokens

BUCKETS = 1 << 17
SEGMENT = 64
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (BUCKETS + lexicon + 1, labels); the last row stays zero
    lexicon: np.ndarray  # sorted hashes of the words in it
    moves: np.ndarray  # (labels, labels)


def _features(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weights that each word uses, laid end to end, and the word of each."""
    s = Spelling(words)
    rows, owner = [], []
    for n in (1, 2, 3, 4):
        h, inside = s.grams(n)
        rows.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
        owner.append(s.word[inside])
    if len(lexicon):
        h = s.whole()
        at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
        known = lexicon[at] == h
        rows.append(BUCKETS + at[known])
        owner.append(np.flatnonzero(known))
    return np.concatenate(rows), np.concatenate(owner)


def _emissions(words: list[str], model: Model) -> np.ndarray:
    rows, owner = _features(words, model.lexicon)
    out = np.empty((len(words), len(model.langs)))
    for k in range(len(model.langs)):
        out[:, k] = np.bincount(owner, weights=model.weights[rows, k], minlength=len(words))
    return out


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)


def _chains(emit: np.ndarray, live: np.ndarray, moves: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward vectors (segments, steps, labels) between given ends; steps that are not live pass on."""
    s, n, k = emit.shape
    fore, back = np.empty((s, n, k)), np.empty((s, n, k))
    a = first
    for t in range(n):
        a = np.where(live[:, t, None], _normal((a @ moves) * emit[:, t]), a)
        fore[:, t] = a
    b = last
    for t in range(n - 1, -1, -1):
        back[:, t] = b
        b = np.where(live[:, t, None], _normal((emit[:, t] * b) @ moves.T), b)
    return fore, back


def marginals(emit: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Label probabilities of every word: emit (words, labels) in log, texts of ``sizes`` words, moves in log."""
    k = emit.shape[1]
    e = np.exp(emit - emit.max(axis=1, keepdims=True)) + 1e-30
    m = np.exp(moves - moves.max())
    segs = -(-sizes // SEGMENT)
    text = np.repeat(np.arange(len(sizes)), segs)
    seg_first = np.cumsum(segs) - segs
    number = np.arange(len(text)) - seg_first[text]
    start = (np.cumsum(sizes) - sizes)[text] + number * SEGMENT
    length = np.minimum(SEGMENT, sizes[text] - number * SEGMENT)
    live = np.arange(SEGMENT)[None, :] < length[:, None]
    at = np.where(live, start[:, None] + np.arange(SEGMENT), 0)
    grid = e[at]
    transfer = np.broadcast_to(np.eye(k), (len(text), k, k)).copy()
    for t in range(SEGMENT):
        step = (transfer.reshape(-1, k) @ m).reshape(-1, k, k) * grid[:, t, None, :]
        step /= np.maximum(step.max(axis=(1, 2), keepdims=True), 1e-300)
        transfer = np.where(live[:, t, None, None], step, transfer)
    begin, end = np.full((len(text), k), 1 / k), np.full((len(text), k), 1 / k)
    for i in range(1, int(segs.max(initial=0))):
        which = np.flatnonzero(segs > i)
        s = seg_first[which] + i
        begin[s] = _normal(np.einsum("si,sij->sj", begin[s - 1], transfer[s - 1]))
        s = seg_first[which] + segs[which] - 1 - i
        end[s] = _normal(np.einsum("sij,sj->si", transfer[s + 1], end[s + 1]))
    fore, back = _chains(grid, live, m, begin, end)
    return _normal(fore * back)[live]


def fit(rows: list[tuple[str, str]], epochs: int = 4, rate: float = 0.15, seed: int = 7) -> Model:
    """Train on (text, lang) rows: conditional likelihood by AdaGrad, every word labelled with its row's language."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS + 1, 0)), np.zeros(0, np.uint64), np.zeros((0, 0)))
    k = len(langs)
    sizes, codes, words = tokens([t.lower() for t, _ in rows], _WORD)
    often = np.flatnonzero(np.bincount(codes, minlength=len(words)) >= 3)
    lexicon = np.unique(Spelling([words[i] for i in often]).whole())
    weights, total = np.zeros((BUCKETS + len(lexicon) + 1, k)), np.full((BUCKETS + len(lexicon) + 1, k), 1e-6)
    moves, moves_total = np.zeros((k, k)), np.full((k, k), 1e-6)
    feature, owner = _features(words, lexicon)
    order = np.argsort(owner, kind="stable")
    feature, owner = feature[order], owner[order]
    feature_at = np.searchsorted(owner, np.arange(len(words) + 1))
    gold = np.repeat([langs.index(x) for _, x in rows], sizes)
    text = np.repeat(np.arange(len(rows)), sizes)
    place = np.arange(len(codes)) - (np.cumsum(sizes) - sizes)[text]
    starts = np.flatnonzero(place % SEGMENT == 0)
    lengths = np.diff(np.append(starts, len(codes)))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(starts)), max(1, len(starts) // 512)):
            live = np.arange(SEGMENT)[None, :] < lengths[part][:, None]
            at = np.where(live, starts[part][:, None] + np.arange(SEGMENT), 0)
            used, local = np.unique(codes[at[live]], return_inverse=True)
            lo, hi = feature_at[used], feature_at[used + 1]
            n = hi - lo
            pick = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            f, o = feature[pick], np.repeat(np.arange(len(used)), n)
            score = np.stack([np.bincount(o, weights=weights[f, i], minlength=len(used)) for i in range(k)], axis=1)
            e = np.exp(score - score.max(axis=1, keepdims=True)) + 1e-30
            grid = np.ones((*live.shape, k))
            grid[live] = e[local]
            m = np.exp(moves - moves.max())
            even = np.full((len(part), k), 1 / k)
            fore, back = _chains(grid, live, m, even, even)
            miss = -_normal(fore * back)[live]
            right = gold[at[live]]
            miss[np.arange(len(miss)), right] += 1
            pair = live[:, 1:]
            joint = fore[:, :-1][pair][:, :, None] * m[None] * (grid[:, 1:] * back[:, 1:])[pair][:, None, :]
            expected = (joint / np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)
            grad_moves = np.diag(np.bincount(gold[at[:, 1:][pair]], minlength=k).astype(float)) - expected
            by_word = np.stack([np.bincount(local, weights=miss[:, i], minlength=len(used)) for i in range(k)], axis=1)
            rows_used, slot = np.unique(f, return_inverse=True)
            g = np.stack([np.bincount(slot, weights=by_word[o, i], minlength=len(rows_used)) for i in range(k)], axis=1) / len(part)
            total[rows_used] += g * g
            weights[rows_used] += rate * g / np.sqrt(total[rows_used])
            g = grad_moves / max(1, pair.sum())
            moves_total += g * g
            moves += rate * g / np.sqrt(moves_total)
    return Model(langs, weights.astype(np.float32), lexicon, moves)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: CRC-32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 250, most_chars: int = 20_000) -> Model:
    """Fit on a bounded sample: of every language about ``per_lang`` different texts, by the hash of id and text, among those that are not held
    out; of a longer text, a stretch of ``most_chars`` code points that begins where the hash says."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    seen = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    if not seen:
        return fit([])
    share = F.create_map(*[x for r in seen for x in (F.lit(r["lang"]), F.lit(per_lang / r["n"]))])[F.col("lang")]
    drawn = rows.where(within_share(F.struct("doc_id", "text"), share)).select(stretch(F.col("text"), most_chars).alias("text"), "lang").distinct()
    return fit(sorted((r["text"], r["lang"]) for r in drawn.collect()))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, keep: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_words); with ``keep`` also ``row``, a struct of the input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else t.lower() for t in batch.column(2).to_pylist()]
            sizes, codes, words = tokens(texts, _WORD)
            letters = np.fromiter((any(map(str.isalpha, w)) for w in words), bool, len(words))
            if not letters.all():  # numerals that count as word characters
                lettered = letters[codes]
                sizes = np.bincount(np.repeat(np.arange(len(texts)), sizes)[lettered], minlength=len(texts))
                codes = codes[lettered]
            best, score = ["und"] * len(texts), np.zeros(len(texts))
            full = np.flatnonzero(sizes)
            if len(full) and model.langs:
                p = marginals(_emissions(words, model)[codes], sizes[full], model.moves)
                mean = np.add.reduceat(p, np.cumsum(sizes[full]) - sizes[full]) / sizes[full][:, None]
                for i, j in zip(full.tolist(), mean.argmax(axis=1).tolist(), strict=True):
                    best[i] = model.langs[j]
                score[full] = np.clip(mean.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score), pa.array(sizes, pa.int64()), *batch.columns[3:]], names=["doc_id", "held_out", "lang_pred", "score", "n_words", *["row"] * keep])

    small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"), *[whole_row(docs).alias("row")] * keep)
    out = T.StructType().add("doc_id", "long").add("held_out", "boolean").add("lang_pred", "string").add("score", "double").add("n_words", "long")
    return rows.mapInArrow(run, out.add("row", docs.schema) if keep else out)
