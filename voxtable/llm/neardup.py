"""Near duplicates: min-max hashing, banding, exact confirmation, components.

Each permutation of the shingle hashes is evaluated once and gives two signature values, the least and the greatest; a band
is a few permutations' pairs.  Bands and rows follow from the threshold so that a pair at it is missed with
a probability of about ``MISS`` (for large sets; in sets of a few shingles minimum and maximum depend on each other, which makes
it 1.7 times that for 6 shingles in common of 7).

Texts with equal shingle sets are one class from the start, so copies cost a row each and never meet again.  In each
band bucket every class is tied to one pivot only (a star, not all pairs); the stars' components are the
groups within which links can be.  Each group is confirmed on full shingle sets, in chunks of a bounded number of classes and
shingles, in two passes.  The first finds the links within each chunk and with a few hubs that every chunk of the group gets.
What they connect has a largest component in each group, and links within it change nothing more: only the
classes outside it are compared, chunk by chunk, with all others of their group.  A class's common counts come from an inverted
index, and what is emitted is a forest of links, never all pairs.  A group of near copies costs as much as its members; only
classes that stay outside, though they share a band with it, cost a comparison with each chunk.

Words are runs of anything but blanks and U+0009 to U+000D, with A-Z lower-cased.  Texts with fewer words than a shingle
are one shingle; null, empty and blank texts have none and link with nothing.  Rows with a null id link with nothing either
(component null, kept).  Rows with equal ids and different texts are linked each by its own text: a class is named by the 64-bit
hash of its set's digest, and ids come back only when the components are known.  One row of a component is kept, the first by
id, hash of the text, and place in the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, small_batches, whole_row
from .graph import components
from .words import mix

MISS = 1e-6
CHUNK = 1_500_000  # shingles of a chunk, on average at most
ROWS = 64  # classes of a chunk, on average at most
SALTS = 64  # tasks among which a group in several chunks is dealt for joins
_HUBS = [0, 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D, 0x1B873593CC9E2D51]  # the hubs come first in the orders that these give


def banding(percent: int) -> tuple[int, int]:
    """(bands, permutations a band) for a threshold in percent."""
    t, perms = percent / 100, 4 if percent >= 83 else 3
    return math.ceil(math.log(MISS) / math.log(1 - t ** (2 * perms))), perms


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    found = [(t or "").encode().lower().split() for t in texts]  # of bytes: ASCII only, as the contract says
    known: dict[bytes, int] = {}
    for f in found:
        for w in f:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
    out = []
    for f in found:
        h = np.fromiter(map(known.__getitem__, f), np.uint64, len(f))
        if not len(h):
            out.append(h)
            continue
        n = min(words, len(h))
        s = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            s = mix(s * np.uint64(0xC2B2AE3D27D4EB4F) + h[k : len(h) - n + 1 + k])
        out.append(np.unique(s))
    return out


def band_keys(hashes: np.ndarray, bands: int, perms: int) -> np.ndarray:
    """A 64-bit key for each band of one set's min-max signature."""
    rng = np.random.default_rng(20)
    a = rng.integers(0, 2**63, bands * perms, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, bands * perms, np.uint64)
    low = np.full(bands * perms, 2**64 - 1, np.uint64)
    high = np.zeros(bands * perms, np.uint64)
    for i in range(0, len(hashes), 2048):
        v = hashes[None, i : i + 2048] * a[:, None] + b[:, None]
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    key = np.arange(bands, dtype=np.uint64)
    for k in range(perms):
        key = mix(mix(key + low[k::perms]) + high[k::perms])
    return key.view(np.int64)


def sketches(rows: DataFrame, words: int, bands: int, perms: int) -> DataFrame:
    """(doc_id, key, n, set binary, bands array<long>[, row]) of (doc_id, key, text[, row]): size and 128-bit digest of each row's
    shingle set; bands are null for an empty set."""
    more = rows.columns[3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist(), words)
            done: dict[bytes, np.ndarray] = {}
            keys = []
            for s in sets:
                d = xxhash.xxh3_128_digest(s.tobytes())
                if len(s) and d not in done:
                    done[d] = band_keys(s, bands, perms)
                keys.append((d, done.get(d)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(map(len, sets), pa.int64()), pa.array((d for d, _ in keys), pa.binary()), pa.array((k for _, k in keys), pa.list_(pa.int64())), *batch.columns[3:]],
                names=["doc_id", "key", "n", "set", "bands", *more],
            )

    small_batches(rows)
    out = T.StructType().add("doc_id", "long").add("key", "long").add("n", "long").add("set", "binary").add("bands", T.ArrayType(T.LongType()))
    for f in rows.schema.fields[3:]:
        out = out.add("row", f.dataType)
    return rows.mapInArrow(run, out)


def forest(sets: list[np.ndarray], percent: int, compared: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets: i and j are linked if 100 * common >= percent * union.  With ``compared``, of the
    links that the first so many sets have."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    hashes, slot = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    at = np.cumsum(size) - size
    order = np.argsort(slot, kind="stable")
    posting = owner[order]
    first = np.searchsorted(slot[order], np.arange(len(hashes) + 1))
    label, out = np.arange(n), []

    def compare(i: int) -> None:
        mine = slot[at[i] : at[i] + size[i]]
        lo, hi = first[mine], first[mine + 1]
        length = hi - lo
        ends = np.cumsum(length)
        common = np.bincount(posting[np.repeat(lo - (ends - length), length) + np.arange(ends[-1])], minlength=n)
        linked = np.flatnonzero(100 * common >= percent * (size + size[i] - common))
        for x in np.unique(label[linked]):
            if x != label[i]:
                out.append((i, int(linked[label[linked] == x][0])))
                label[label == x] = label[i]

    if compared is not None:
        for i in range(compared):
            compare(i)
        return out
    compare(0)
    todo = np.ones(n, bool)
    todo[0] = False
    while True:
        big = int(np.bincount(label, minlength=n).argmax())
        outside = np.flatnonzero(todo & (label != big))
        if not len(outside):
            return out
        todo[outside[0]] = False
        compare(int(outside[0]))


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(doc_id, key, text): ``key`` tells rows of one id apart by their text."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("key"), text.alias("text"), *more)


def _with_group(members: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """Members (root, node, ...) with facts (root, ...) about their groups, of which there are few: a group's members meet them in many tasks."""
    salted = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("_salt", F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(SALTS)).cast("int")).join(salted, ["root", "_salt"], how).drop("_salt")


def confirmed(rows: DataFrame, classes: DataFrame, coarse: DataFrame, words: int, percent: int, linked: Callable[..., list[tuple[int, int]]] = forest) -> DataFrame:
    """(node, root) of the components of true links within the groups of ``coarse``; ``linked`` finds a forest of them in a chunk."""
    size = F.greatest(F.ceil(F.sum("n") / CHUNK), F.ceil(F.count("*") / ROWS)).cast("int")
    hubs = [F.min(F.col("node").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x)) for x in _HUBS]
    weights = classes.join(coarse, "node").groupBy("root").agg(size.alias("chunks"), F.array(*hubs).alias("hubs"))
    # Most groups are one chunk, of which nothing more need be known.
    weights = settle(weights.where("chunks > 1"))
    members = _with_group(coarse.join(classes.select("node", "set", "first"), "node"), weights, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk")
    members = members.select(F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key"), "node", "set", "root", "chunks", chunk, F.coalesce(F.array_contains("hubs", F.col("node")), F.lit(False)).alias("hub"))
    texts = rows.join(members, ["doc_id", "key"]).select("root", "chunks", "chunk", "node", "set", "hub", "text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(6).to_pylist(), words)
            mine = pa.array([xxhash.xxh3_128_digest(s.tobytes()) == d for s, d in zip(sets, batch.column(4).to_pylist(), strict=True)])
            out = pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array((s.tobytes() for s in sets), pa.binary())], names=[*batch.schema.names[:6], "data"])
            yield out.filter(mine)  # another text may have the same key

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "node", "set"]).drop_duplicates("set")
        node = pdf["node"].to_numpy()
        pairs = linked([np.frombuffer(d, np.uint64) for d in pdf["data"]], percent, int((pdf["side"] == 0).sum()) if (pdf["side"] == 0).any() else None)
        return pd.DataFrame({"a": [node[i] for i, _ in pairs], "b": [node[j] for _, j in pairs]}, dtype=np.int64)

    full = settle(texts.mapInArrow(sets_of, "root long, chunks int, chunk int, node long, set binary, hub boolean, data binary"))
    everywhere = F.sequence(F.lit(0), F.col("chunks") - 1)
    first = full.select("root", F.explode(F.when(F.col("hub"), everywhere).otherwise(F.array("chunk"))).alias("part"), F.lit(1).alias("side"), "node", "set", "data")
    links = settle(first.groupBy("root", "part").applyInPandas(confirm, "a long, b long"))
    if weights.isEmpty():
        return settle(components(links))
    # Of groups in several chunks: the classes that are not in the largest component, in chunks of their own.
    several = _with_group(coarse, weights.select("root")).join(classes.select("node", "n"), "node")
    several = settle(several.join(components(links).withColumnRenamed("root", "found"), "node", "left").select("root", "node", "n", F.coalesce("found", "node").alias("found")))
    largest = several.groupBy("root", "found").agg(F.count("*").alias("m")).groupBy("root").agg(F.max(F.struct("m", "found"))["found"].alias("largest"))
    outside = settle(_with_group(several, largest).where("found <> largest").select("root", "node", "n"))
    sides = settle(outside.groupBy("root").agg(size.alias("sides")))
    side = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("sides")).cast("int").alias("other")
    large = _with_group(full.where("chunks > 1"), sides)
    left = large.join(outside.select("node"), "node").select("root", F.explode(everywhere).alias("part"), side, F.lit(0).alias("side"), "node", "set", "data")
    right = large.select("root", F.col("chunk").alias("part"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other"), F.lit(1).alias("side"), "node", "set", "data")
    more = left.unionByName(right).groupBy("root", "part", "other").applyInPandas(confirm, "a long, b long")
    return settle(components(links.unionByName(more)))


def _decide(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, *, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, each with a number ``at`` of its own, and (at, doc_id, n_shingles, component_id, kept) of each."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    bands, perms = banding(percent)
    rows = keyed(docs, id_col, text_col)
    carried = keyed(docs, id_col, text_col, whole_row(docs).alias("row")) if keep else rows
    sketched = settle(sketches(carried, words, bands, perms).withColumn("at", F.monotonically_increasing_id()))
    linkable = sketched.where("n > 0 and doc_id is not null")
    classes = linkable.groupBy("set").agg(F.min(F.struct("doc_id", "key", "at")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = settle(classes.select(F.xxhash64("set").alias("node"), "set", "first", "n", "bands"))
    spread = classes.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    pivots = settle(spread.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("_last")).where("pivot <> _last").select("bucket", "pivot"))
    stars = spread.join(pivots, "bucket").where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    coarse = settle(components(stars))
    joined = confirmed(rows, classes, coarse, words, percent)
    reached = classes.select("set", "node", "first").join(joined, "node", "left").select("set", "first", F.coalesce("root", "node").alias("root"))
    heads = reached.groupBy("root").agg(F.min("first").alias("head"))
    reached = reached.join(heads, "root").select("set", "head")
    out = sketched.select("at", "doc_id", "n", "set").join(reached, "set", "left")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("head.doc_id")).otherwise(F.col("doc_id")))
    return sketched, out.select("at", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.when(linked, F.col("at") == F.col("head.at")).otherwise(True).alias("kept"))


def groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each input row.  Kept is the smallest id of a component, in all rows that have it, and
    rows without an id."""
    decided = _decide(docs, words, percent, id_col, text_col)[1].drop("at")
    return decided.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def first_rows(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``.  The decision is each row's own, by its number, so ids may repeat."""
    sketched, decided = _decide(docs, words, percent, id_col, text_col, keep=True)
    return sketched.select("at", "row").join(decided.where(~F.col("kept")).select("at"), "at", "left_anti").select("row.*")
