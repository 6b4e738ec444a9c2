"""Exact Jaccard join on word n-grams by signature trees.

A node of a signature tree holds the OR of the token bitmaps of all sets below it, the least and greatest of their sizes, and the most tokens
that a set has beyond its bits.  Two nodes can hold a linked pair only if their sizes and the bits that they share allow the overlap that a link of
the smallest sets would need; the dual traversal goes down from the pair (root, root) and drops all other pairs of nodes.  Pairs of
sets that are left are confirmed on the full sets.

The upper levels of the hierarchy are Spark keys, so that no task holds a tree of the corpus.  First by size: linked sets lie in the same tier of
sizes or in neighbouring ones.  Then by parts of the sets: a scheme for each tier cuts the token space into parts by hash, one more (and a few) than the
tokens by which linked sets of that tier can differ; so at least one part that is not empty has the very same tokens in both, and its hash is a
key.  A set whose non-empty parts are too few for that gives keys under further seeds, until they are enough: of a pair, the set that is done
first makes sure of it.  That holds for every pair, so nothing is lost.

Sets that share a key are a bucket.  Each distinct bucket is searched by a signature tree of its own, whose bitmaps travel with the sets (a bit or two for
each token), and comes out as a forest of the pairs that the bounds let through.  Of a key that many sets of one batch share, the batch hands on one set,
which is tied to the others, and whose bucket is then tied together unseen, as is one of more than ``BUCKET`` sets.  Groups that hang together by such ties are
searched by trees again, now with full sets, in chunks of bounded size (``neardup.confirmed``), and links come out as a forest.

Defined results: equal sets are one class from the start.  Null, empty and blank texts have no tokens and link with nothing; texts with fewer
words than an n-gram have one token.  Rows with a null id link with nothing (component null).  Rows with equal ids are linked each by its own text.
Tokens are 64-bit hashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small_batches
from .graph import components
from .neardup import confirmed, keyed, shingle_sets
from .words import mix

FANOUT = 4
SEEDS = 16
BUCKET = 256  # sets of a bucket that a tree searches
CROWD = 8  # sets of a batch with one key, before one stands for them
_SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)


# Trees.


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """bits / 64 words; a token sets the bit that its hash names."""
    out = np.zeros(bits // 64, np.uint64)
    at = mix(s * _SPREAD) & np.uint64(bits - 1)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def width(n: int, most: int = 1 << 16) -> int:
    """Bits of a bitmap for sets of about n tokens: a power of two, so that a wide one folds into a narrow one."""
    return min(max(64, 1 << (2 * n - 1).bit_length() - 1), most)


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps as rows of the narrowest one's width."""
    least = min(map(len, maps))
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, least), axis=0) for m in maps])


def tree(maps: np.ndarray, size: np.ndarray, wanted: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Levels from the sets up to one root, each (bitmaps, least sizes, greatest sizes, most tokens beyond the bits, whether a wanted set is below)."""
    levels = [(maps, size, size, size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64), wanted)]
    while len(levels[-1][1]) > 1:
        at = np.arange(0, len(levels[-1][1]), FANOUT)
        folds = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.logical_or)
        levels.append(tuple(f.reduceat(x, at, axis=0) for f, x in zip(folds, levels[-1], strict=True)))
    return levels


def candidates(levels: list[tuple[np.ndarray, ...]], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of sets, one of them wanted, that no bound on the way from (root, root) down rules out."""
    i = j = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        maps, least, most, beyond, wanted = levels[depth]
        ok = (wanted[i] | wanted[j]) & (100 * most[i] >= percent * least[j]) & (100 * most[j] >= percent * least[i])
        if not depth:
            ok &= i < j
        i, j = i[ok], j[ok]
        common = np.empty(len(i), np.int64)
        for lo in range(0, len(i), 1024):
            common[lo : lo + 1024] = np.bitwise_count(maps[i[lo : lo + 1024]] & maps[j[lo : lo + 1024]]).sum(axis=1)
        overlap = np.minimum(common + np.minimum(beyond[i], beyond[j]), np.minimum(most[i], most[j]))
        ok = (100 + percent) * overlap >= percent * (least[i] + least[j])
        i, j = i[ok], j[ok]
        if depth:
            below = len(levels[depth - 1][1])
            a, b = np.divmod(np.arange(FANOUT * FANOUT), FANOUT)
            i, j = (FANOUT * i[:, None] + a).ravel(), (FANOUT * j[:, None] + b).ravel()
            ok = (i <= j) & (j < below)
            i, j = i[ok], j[ok]
    return i, j


def forest(sets: list[np.ndarray], percent: int, compared: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets: i and j are linked if 100 * common >= percent * union.  With ``compared``, of the
    links that the first so many sets have."""
    order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))  # a common least hash tells of likeness
    wanted = np.array([compared is None or i < compared for i in order], bool)
    size = np.array([len(sets[i]) for i in order], np.int64)
    bits = width(2 * int(np.median(size)))
    levels = tree(np.stack([bitmap(sets[i], bits) for i in order]), size, wanted)
    root, out = list(range(len(sets))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(*(x.tolist() for x in candidates(levels, percent)), strict=True):
        a, b = order[i], order[j]
        x, y = find(a), find(b)
        if x != y:
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                root[x] = y
                out.append((a, b))
    return out


# Keys of the upper levels.


def tiers(percent: int, most: int = 1 << 40) -> np.ndarray:
    """The first size of each tier; linked sets lie in one tier or in neighbouring ones (above 95 percent tiers are wider than they need be)."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // min(percent, 95) + 1)
    return np.array(out)


def part_keys(s: np.ndarray, percent: int, bounds: np.ndarray) -> np.ndarray:
    """Keys of a set (64-bit hashes): two linked sets share one at least."""
    n, out = len(s), []
    tier = int(np.searchsorted(bounds, n, "right")) - 1
    for scheme in (tier, tier + 1):
        top = int(bounds[scheme + 1]) - 1
        differ = 2 * top * (100 - percent) // (100 + percent)
        parts = differ + 1 + differ // 48
        own = (n + min(n * 100 // percent, top)) * (100 - percent) // (100 + percent)  # by which a linked set can differ from this one
        for seed in range(SEEDS + 1):
            name = np.uint64(((scheme * 64 + seed) * 0x9E3779B97F4A7C15 + 1) % 2**64)
            if seed == SEEDS:  # still too few: one key for all such sets of the scheme
                out.append(mix(np.array([name])))
                break
            h = mix(s ^ name)
            part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            h = mix(h * _SPREAD)
            full = np.flatnonzero(np.bincount(part, minlength=parts))
            # Halves of 32 bits: their sums are exact as doubles for up to two million tokens in a part, which has a few on average.
            low, high = (np.bincount(part, weights=(h >> np.uint64(k) & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=parts)[full] for k in (0, 32))
            key = mix(low.astype(np.uint64) + name) * _SPREAD + mix(high.astype(np.uint64) ^ (full.astype(np.uint64) + np.uint64(1)) * _SPREAD)
            out.append(mix(key))
            if len(full) > own:
                break
    return np.concatenate(out).view(np.int64)


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _sort_keys(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both sorted by key, the first place of each key, and its number of rows."""
    order = np.argsort(key, kind="stable")
    key, node = key[order], node[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key, node, first, np.diff(np.r_[first, len(key)])


def buckets(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(unseen boolean, members array<long>): sets, by their nodes, that share a key; ``unseen`` ones hang together without a look at them.
    texts: (text), of rows that can link."""
    bounds = tiers(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for s in shingle_sets(batch.column(0).to_pylist(), words):
                if len(s) and (node := _node(_digest(s))) not in found:
                    found[node] = part_keys(s, percent, bounds)
            if not found:
                continue
            key, node, first, n = _sort_keys(np.concatenate(list(found.values())), np.repeat(np.fromiter(found, np.int64, len(found)), [len(k) for k in found.values()]))
            head, crowd = np.repeat(node[first], n), np.repeat(n > CROWD, n)
            alone = np.zeros(len(key), bool)
            alone[first] = True
            tied = np.unique(np.stack([head[crowd & ~alone], node[crowd & ~alone]]), axis=1)
            spread = mix(mix(tied[0].view(np.uint64)) ^ tied[1].view(np.uint64)).view(np.int64)
            kept = alone | ~crowd
            # kind 0: a set; 1: a set that stands for others; 2: two sets that are tied.
            kind = np.r_[crowd[kept].astype(np.int8), np.full(len(spread), 2, np.int8)]
            other = pa.concat_arrays([pa.nulls(int(kept.sum()), pa.int64()), pa.array(tied[1])])
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[key[kept], spread]), pa.array(kind), pa.array(np.r_[node[kept], tied[0]]), other], names=["key", "kind", "node", "other"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, bool, list[int]] = (None, False, [])  # the last key's bucket, which may go on

        def out(done: list[tuple[bool, list[int]]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in done], pa.bool_()), pa.array([m for _, m in done], pa.list_(pa.int64()))], names=["unseen", "members"])

        for batch in batches:
            kind, who = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            pair = kind == 2
            done = [(True, [a, b]) for a, b in zip(who[pair].tolist(), batch.column(3).filter(pa.array(pair)).to_pylist(), strict=True)]
            key, node, stands = batch.column(0).to_numpy()[~pair], who[~pair], kind[~pair] == 1
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.r_[first, len(key)])
            for at in np.flatnonzero((size > 1) | (first == 0) | (first + size == len(key))).tolist():
                lo, hi = int(first[at]), int(first[at] + size[at])
                unseen, members = bool(stands[lo:hi].any()), sorted(set(node[lo:hi].tolist()))
                if held[0] == key[lo]:
                    unseen, members = unseen or held[1], sorted({*held[2], *members})
                elif len(held[2]) > 1:
                    done.append(held[1:])
                held = (int(key[lo]), unseen, members)
                if len(members) > BUCKET:  # goes out in parts, which a member of both ties together
                    done.append((True, members))
                    held = (int(key[lo]), True, members[:1])
            yield out(done)
        yield out([held[1:]] if len(held[2]) > 1 else [])

    small_batches(texts)
    rows = texts.mapInArrow(run, "key long, kind byte, node long, other long")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "unseen boolean, members array<long>")


def ties(found: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs by which all links within buckets hang together.  classes: (node, n, map)."""
    chained = found.where("unseen").select(F.posexplode("members").alias("i", "b"), "members").where("i > 0").select(F.expr("members[i - 1]").alias("a"), "b")
    seen = found.where("not unseen").select("members").distinct().select(F.xxhash64("members").alias("bucket"), F.explode("members").alias("node"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def pairs(t: pa.Table) -> pa.RecordBatch:
            key, node, size = (t.column(i).to_numpy() for i in range(3))
            maps = [np.frombuffer(m, np.uint64) for m in t.column(3).to_pylist()]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            a, b = [], []
            for lo, hi in itertools.pairwise([*first.tolist(), len(key)]):
                i, j = candidates(tree(folded(maps[lo:hi]), size[lo:hi], np.ones(hi - lo, bool)), percent)
                label = list(range(hi - lo))
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if label[x] != label[y]:
                        old = label[y]
                        label = [label[x] if v == old else v for v in label]
                        a.append(node[lo + x])
                        b.append(node[lo + y])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if t.num_rows:
                key = t.column(0).to_numpy()
                cut = int(np.argmax(key == key[-1]))
                yield pairs(t.slice(0, cut))
                rest = t.slice(cut)
        if rest is not None:
            yield pairs(rest)

    small_batches(found)
    rows = seen.join(classes.select("node", "n", "map"), "node").select("bucket", "node", "n", "map")
    likely = rows.repartition("bucket").sortWithinPartitions("bucket", "n").mapInArrow(search, "a long, b long")
    return chained.unionByName(likely)


def join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each input row: the size of its set and the smallest id that links lead to."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    rows = keyed(docs, id_col, text_col)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist(), words)
            digests = [_digest(s) for s in sets]
            maps = [bitmap(s, width(len(s))).tobytes() if len(s) else None for s in sets]
            arrays = [*batch.columns[:2], pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()), pa.array(map(_node, digests), pa.int64()), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "n", "set", "node", "map"])

    small_batches(rows)
    sketched = settle(rows.mapInArrow(sketch, "doc_id long, key long, n long, set binary, node long, map binary"))
    linkable = sketched.where("n > 0 and doc_id is not null")
    classes = settle(linkable.groupBy("node", "set").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.first("n").alias("n"), F.first("map").alias("map")))
    found = settle(buckets(rows.where("doc_id is not null").select("text"), words, percent))
    coarse = settle(components(ties(found, classes, percent)))
    joined = confirmed(rows, classes, coarse, words, percent, forest)
    reached = classes.select("set", "node", "first").join(joined, "node", "left").select("set", F.coalesce("root", "node").alias("root"), F.col("first.doc_id").alias("id"))
    heads = reached.groupBy("root").agg(F.min("id").alias("component_id"))
    found = reached.join(heads, "root").select("set", "component_id")
    out = sketched.join(found, "set", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"))


def oracle_sql(words: int = 4, percent: int = 85) -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
with recursive w as (select doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') as w from documents where doc_id is not null),
s as (select distinct doc_id, unnest([array_to_string(list_slice(w, i, i + {words - 1}), ' ') for i in range(1, greatest(len(w) - {words - 1}, 1) + 1)]) as s from w where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= {percent} * (x.n + y.n - k)),
both_ways as (select a, b from e union all select b, a from e),
comp(doc_id, root) using key (doc_id) as (
  select doc_id, doc_id from w
  union
  select b.b, min(c.root) from comp c join both_ways b on b.a = c.doc_id join recurring.comp o on o.doc_id = b.b where c.root < o.root group by b.b)
select w.doc_id, coalesce(n.n, 0) as n_shingles, comp.root as component_id from w join comp using (doc_id) left join n using (doc_id)
"""
