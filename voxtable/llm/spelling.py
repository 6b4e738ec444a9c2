"""Spelling variants: words that differ by one code point, found by rolling-hash deletions.

Words of whole texts are counted in Spark.  Each word gives integer keys, all of them from polynomial hashes of its prefixes and suffixes, so no shortened
string is ever built: the hash of the word without code point i is ``prefix(i) * B^(rest) + suffix(i + 1)``.  Two words differ by a
replaced code point exactly if they are equal without the one at the same place, so (hash, place) is their key; and by an inserted one exactly if one
is the other without some code point, so a shortened hash meets a whole one.  Keys are dealt to radix partitions and sorted there, and runs of
equal keys give each pair once, in a pass over Arrow batches that keeps no more than the run at hand.  Such a run is bounded by the
alphabet, not by the number of words.  Pairs are then verified on the strings, since hashes may collide.

A word's form is its near word with the most occurrences, if these are ``ratio`` times its own or more; forms are followed to the root by
pointer jumping, in a number of rounds that grows as the logarithm of the longest chain.

Defined results: null and empty texts have no words; a text of any length is read whole; repeated rows count again.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, settle, small_batches
from .words import mix

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
HELD = 200_000  # distinct words that a task holds before it hands on their counts
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def counted(docs: DataFrame, *, noise: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): maximal letter runs of all texts, A-Z lower-cased.  With ``noise``, a run of which the crc32 of ``id:run`` is divisible by it loses
    the code point at that number modulo its length: slips of known places, so that there is something to find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            kept = {w: n for w, n in held.items() if w}
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(kept.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Counter(_RUN.findall(text.encode().lower().decode()))  # of bytes: A-Z only
                if noise and doc is not None:
                    start = zlib.crc32(b"%d:" % doc)
                    for w in list(found):
                        h = zlib.crc32(w.encode(), start)
                        if h % noise == 0:
                            n, at = found.pop(w), h % len(w)
                            held[w[:at] + w[at + 1 :]] += n
                held.update(found)
                if len(held) > HELD:
                    yield out()
        yield out()

    rows = id_text(docs, id_col, text_col)
    small_batches(rows)
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _rolling(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, hash of each word without each of its code points), all modulo 2^64.

    With P(i) the running sum of ``point * B^place`` over all words laid end to end, a prefix is a difference of P and a suffix one more,
    shifted by one place; both are then brought to the word's own start by the inverse power."""
    n = len(points)
    power = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, _BASE, np.uint64), out=power[1:])
    back = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64), out=back[1:])
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(points + np.uint64(1)) * power[:n], out=total[1:], dtype=np.uint64)
    word = np.repeat(np.arange(len(sizes)), sizes)
    first, end, at = starts[word], (starts + sizes)[word], np.arange(n)
    prefix, suffix = total[at] - total[first], total[end] - total[at + 1]
    without = (prefix + suffix * back[1]) * back[first]
    return mix((total[starts + sizes] - total[starts]) * back[starts]), mix(without)


def keys(words: DataFrame) -> DataFrame:
    """(key, kind, id) of (id long, word): kind 0 for a whole word, 1 for a word without some code point, 2 for one without that at a known place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelt = batch.column(1).to_pylist()
            ids = batch.column(0).to_numpy()
            sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
            for lo, hi in _portions(sizes):
                points = np.frombuffer("".join(spelt[lo:hi]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                size = sizes[lo:hi]
                starts = np.cumsum(size) - size
                whole, without = _rolling(points, starts, size)
                word = np.repeat(np.arange(hi - lo), size)
                length = size.astype(np.uint64)
                place = (np.arange(len(points)) - starts[word]).astype(np.uint64)
                whole, without = mix(whole + length), mix(without + length[word] - np.uint64(1))
                # Equal letters in a row: leaving out either gives the same string, and one key of it is enough.
                new = np.ones(len(points), bool)
                new[1:] = (points[1:] != points[:-1]) | (word[1:] != word[:-1])
                placed = mix(without + (place + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
                key = np.concatenate([whole, without[new], placed])
                kind = np.repeat(np.array([0, 1, 2], np.int8), [hi - lo, int(new.sum()), len(points)])
                of = np.concatenate([np.arange(hi - lo), word[new], word]) + lo
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind), pa.array(ids[of])], names=["key", "kind", "id"])

    return words.mapInArrow(run, "key long, kind byte, id long")


def _portions(sizes: np.ndarray, most: int = 200_000) -> Iterator[tuple[int, int]]:
    """Ranges of words of about so many code points (or one word)."""
    lo, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if total and total + s > most:
            yield lo, i
            lo, total = i, 0
        total += s
    if lo < len(sizes):
        yield lo, len(sizes)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of ids from rows sorted by (key, kind): whole with shortened, and shortened at the same place with each other."""
    rest = np.zeros((3, 0), np.int64)
    names = ["a", "b"]

    def pairs(rows: np.ndarray) -> pa.RecordBatch:
        key, kind, who = rows
        a, b = [], []
        if len(key):
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            end = np.repeat(np.r_[first[1:], len(key)], np.diff(np.r_[first, len(key)]))
            at, step = np.flatnonzero(kind != 1), 1  # a shortened word alone meets nothing
            while len(at := at[at + step < end[at]]):  # row i with row i + step of its run
                ok = at[((kind[at] == 2) | (kind[at + step] == 1)) & (who[at] != who[at + step])]
                a.append(who[ok])
                b.append(who[ok + step])
                step += 1
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=names)

    for batch in batches:
        rows = np.concatenate([rest, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])], axis=1)
        cut = int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0
        yield pairs(rows[:, :cut])
        rest = rows[:, cut:]
    yield pairs(rest)


def near(words: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n): every two of the words (word, n) that differ by one code point, both ways round."""
    named = words.select(F.xxhash64("word").alias("id"), "word", "n")
    radix = F.shiftrightunsigned("key", 48)
    dealt = keys(named.select("id", "word")).withColumn("radix", radix).repartition("radix").sortWithinPartitions("key", "kind")
    found = dealt.select("key", "kind", "id").mapInArrow(_met, "a long, b long").distinct()
    left, right = named.toDF("a", "a_word", "a_n"), named.toDF("b", "b_word", "b_n")
    met = found.join(left, "a").join(right, "b").where(F.levenshtein("a_word", "b_word", 1) == 1)
    ways = F.array(F.struct(F.col("a_word").alias("a"), F.col("b_word").alias("b"), "a_n", "b_n"), F.struct(F.col("b_word").alias("a"), F.col("a_word").alias("b"), F.col("b_n").alias("a_n"), F.col("a_n").alias("b_n")))
    return met.select(F.explode(ways).alias("p")).select("p.*")


def followed(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form) without circles: pointers are doubled until none moves."""
    at = settle(links.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = settle(at.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        at = after.select("word", "root")
        if after.where("_moved").isEmpty():
            return at


def variants(docs: DataFrame, *, noise: int | None = None, least_points: int = 5, least_n: int = 3, ratio: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words with so many code points and occurrences."""
    words = settle(counted(docs, noise=noise, id_col=id_col, text_col=text_col).where((F.col("n") >= least_n) & (F.length("word") >= least_points)))
    best = near(words).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.m") >= F.col("n") * ratio, -F.col("best.m")))
    done = settle(joined.select("word", F.when(F.col("form_n").isNotNull(), F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"))
    roots = followed(done.where("form is not null"))
    return done.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
