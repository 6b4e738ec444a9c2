"""Stupid-backoff language-model scores of documents, by joining n-grams with their counts.

Documents fall into blocks by a hash.  A block's exploded n-grams are its distinct 64-bit hashes with their numbers, cut by hash range
into buckets that only the block's own n-grams fill; they travel as one packed row for each bucket.  A bucket's rows from all blocks make its part of the
count tables (one part holds every occurrence of its n-grams), and joining them to those sums answers each block by place.  Each block sums its
documents' scores.  An n-gram, however common, costs its bucket one entry a block, and all work is in proportion to the distinct
n-grams of the blocks: a row is never empty, so that there are never more rows than n-grams.

    S(w | v...) = count(v... w) / count(v...)     if count(v... w) >= min_count
                = alpha * S(w | shorter context)  else;   S(w) = count(w) / N

Counts are those of all documents, the scored one included; each of its n-grams is there at least once, so that ``min_count`` 1 would
never back off, and 2 asks for a second occurrence anywhere.
Scores are natural logarithms in whole millionths, so sums do not depend on their order.
Words are runs of anything but blanks and U+0009 to U+000D, with A-Z lower-cased.  Null, empty and blank
texts have no words and score 0 (no mean).  Every row, repeated or not, counts and is scored; ids may repeat or be null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, small_batches
from .words import mix

BLOCK_BYTES = 8 << 20  # of text in a block
BUCKET_GRAMS = 2_000_000  # n-grams, counted once a block, in a bucket


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers by byte planes, so that their leading zeros vanish."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)


def unsqueeze(data: bytes, kind: type = np.uint64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def grams(texts: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(words of each text; for n from 1: hashes of the n-grams that end at each word; whether the text reaches so far back)."""
    found = [t.encode().lower().split() for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    known: dict[bytes, int] = {}
    for f in found:
        for w in f:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
    words = np.fromiter((known[w] for f in found for w in f), np.uint64, int(sizes.sum()))
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashes, real = [words], [np.ones(len(words), bool)]
    for n in range(1, order):
        h = np.zeros(len(words), np.uint64)
        h[1:] = mix(hashes[-1][:-1] * np.uint64(0x9DDFEA08EB382D69) + words[1:])
        hashes.append(h)
        real.append(place >= n)
    return sizes, hashes, real


def _runs(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(the buckets of sorted keys that are not empty, where each begins)."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    return of[first].astype(np.int64), first


_LISTS = pa.schema([("bucket", pa.int64()), ("block", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_REPLIES = pa.schema([("block", pa.int32()), ("bucket", pa.int64()), ("n", pa.int32()), ("totals", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


def scores(docs: DataFrame, order: int = 2, min_count: int = 2, alpha: float = 0.4, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_grams: int = BUCKET_GRAMS) -> DataFrame:
    """(doc_id, n_words long, log_score long, mean_score double): natural logarithm of the text's score in millionths, and its mean over the words."""
    small_batches(docs)
    rows = id_text(docs, id_col, text_col)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.sum(words.cast("long")).alias("words")).first()
    in_all = max(1, size["words"] or 0)
    blocks = max(1, -(-(size["bytes"] or 0) // block_bytes))
    buckets = min(2**31, max(1, -(-in_all * order // bucket_grams)))
    # Equal rows fall into different blocks by their place.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))

    def explode(table: pa.Table) -> pa.Table:
        _, hashes, real = grams(table.column("text").to_pylist(), order)
        block, out = table.column("block")[0].as_py(), []
        for n, (h, ok) in enumerate(zip(hashes, real, strict=True)):
            keys, counts = np.unique(h[ok], return_counts=True)
            of, first = _runs(keys, buckets)
            for bucket, lo, hi in zip(of.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=False):  # no keys, no runs
                out.append((bucket, block, n, squeeze(np.diff(keys[lo:hi], prepend=np.uint64(0))), squeeze(counts[lo:hi].astype(np.uint32))))
        return _table(out, _LISTS)

    def total(table: pa.Table) -> pa.Table:
        out = []
        bucket, all_n = table.column("bucket")[0].as_py(), np.array(table.column("n").to_pylist())
        for n in np.unique(all_n).tolist():
            part = table.filter(pa.array(all_n == n))
            keys = [np.cumsum(unsqueeze(x), dtype=np.uint64) for x in part.column("keys").to_pylist()]
            counts = np.concatenate([unsqueeze(x, np.uint32) for x in part.column("counts").to_pylist()])
            _, slot = np.unique(np.concatenate(keys), return_inverse=True)
            summed = np.bincount(slot, weights=counts).astype(np.uint64)
            if n:
                summed[summed < min_count] = 0
            answers = np.split(summed[slot], np.cumsum([len(k) for k in keys])[:-1])
            out += [(b, bucket, n, squeeze(a)) for b, a in zip(part.column("block").to_pylist(), answers, strict=True)]
        return _table(out, _REPLIES)

    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        sizes, hashes, real = grams(table.column("text").to_pylist(), order)
        answers = {(n, b): t for n, b, t in zip(*(replies.column(c).to_pylist() for c in ("n", "bucket", "totals")), strict=True)}
        count = []
        for n, (h, ok) in enumerate(zip(hashes, real, strict=True)):
            c = np.zeros(len(h), np.int64)
            if ok.any():
                keys, slot = np.unique(h[ok], return_inverse=True)
                found = np.concatenate([unsqueeze(answers.pop((n, b))) for b in _runs(keys, buckets)[0].tolist()])
                c[ok] = found.astype(np.int64)[slot]
            count.append(c)
        if (count[0] == 0).any():
            raise ValueError("a word without a count")
        value = np.log(count[0] / in_all)
        for n in range(1, order):
            context = np.concatenate([[1], count[n - 1][:-1]])[: len(value)]
            seen = real[n] & (count[n] > 0) & (context > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                value = np.where(seen, np.log(count[n] / context), np.where(real[n], np.log(alpha) + value, value))
        units = np.round(value * 1e6).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(units)])
        ends = np.cumsum(sizes)
        return pa.table([table.column("doc_id"), pa.array(sizes), pa.array(before[ends] - before[ends - sizes])], names=["doc_id", "n_words", "log_score"])

    lists = dealt.groupBy("block").applyInArrow(explode, "bucket long, block int, n int, keys binary, counts binary")
    replies = lists.groupBy("bucket").applyInArrow(total, "block int, bucket long, n int, totals binary")
    done = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, "doc_id long, n_words long, log_score long")
    return done.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("log_score").cast("double") / F.col("n_words")))


def oracle_sql(order: int = 2, min_count: int = 2, alpha: float = 0.4) -> str:
    """The same in DuckDB's SQL, for unique ids and an order of two or three."""
    if order not in (2, 3):
        raise ValueError("written for orders of two and three")
    one = "case when b.n is not null then ln(b.n / cv.n) when p.v is not null then ln({0}) + ln(cw.n / (select count(*) from t)) else ln(cw.n / (select count(*) from t)) end".format(alpha)
    value = one if order == 2 else f"case when c.n is not null then ln(c.n / cb.n) when p.u is not null then ln({alpha}) + {one} else {one} end"
    three = """,
c3 as (select u, v, w, count(*) as n from p where u is not null group by u, v, w having count(*) >= {0})""".format(min_count)
    join3 = " left join c3 c on c.u = p.u and c.v = p.v and c.w = p.w left join b cb on cb.v = p.u and cb.w = p.v"
    return f"""
with l as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
t as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from l),
p as (select doc_id, i, w, lag(w) over (partition by doc_id order by i) as v, lag(w, 2) over (partition by doc_id order by i) as u from t),
u as (select w, count(*) as n from t group by w),
b as (select v, w, count(*) as n from p where v is not null group by v, w having count(*) >= {min_count}){three if order == 3 else ""},
s as (select p.doc_id, cast(round(1e6 * {value}) as bigint) as x
  from p join u cw on cw.w = p.w left join u cv on cv.w = p.v left join b on b.v = p.v and b.w = p.w{join3 if order == 3 else ""})
select l.doc_id, cast(len(ws) as bigint) as n_words, coalesce(cast(sum(x) as bigint), 0) as log_score, cast(sum(x) as double) / len(ws) as mean_score from l left join s on s.doc_id = l.doc_id group by l.doc_id, len(ws)
"""
