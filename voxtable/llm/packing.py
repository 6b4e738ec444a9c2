"""Packing documents into sequences: dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so an instance is a histogram of at most
``capacity`` counts, whatever the size of the corpus.  The driver packs that histogram:
the Martello-Toth reduction permanently fixes one- to three-piece sets that dominate every
other way to fill the sequence of the largest piece, a whole run of equal sets at once;
the remainder goes best-fit, largest first.  The plan is a list of (length, range of ranks)
-> (sequence, offset).  Each piece's rank among those of its length comes from counts by
(length, salt), so no length, however common, is numbered by one task.

Null texts count as empty: only the end id.  Every piece of every row is packed;
row ids may repeat (their pieces are then told apart by place only).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec, encode_around, groups
from .common import id_text, settle, shuffle_parts, small_batches


def pieces(docs: DataFrame, ranks: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", *, with_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id; longer ones than the
    capacity are cut into full pieces, of which the first may be shorter.  ``added``: strings that are one id each wherever a
    text holds them (a tokenizer's added tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, end = codec(ranks), np.array([end_id], "<u4")
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in groups(texts):
                rows: list[tuple] = []
                for name, ids in zip(names[lo:hi], encode_around(c, texts[lo:hi], added or {}), strict=True):
                    ids = np.append(ids, end)
                    at = 0
                    for k, stop in enumerate(range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)):
                        data = ids[at:stop].tobytes()
                        rows.append((name, k, at, stop - at, zlib.crc32(data), data if with_ids else None))
                        at = stop
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns[: len(names_out)], names=names_out)

    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names_out = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    small_batches(docs)
    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence, largest first) and how many sequences have each."""
    left = Counter({k: n for k, n in counts.items() if n})
    sizes = sorted(left)
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> None:
        need = Counter(pattern)
        n = min(left[k] // m for k, m in need.items())
        out.append((pattern, n))
        for k, m in need.items():
            left[k] -= n * m
            if not left[k]:
                del sizes[bisect_left(sizes, k)]

    def most(limit: int, used: tuple[int, ...]) -> int:
        """The largest length up to the limit of which a piece is left besides those used."""
        i = bisect_right(sizes, limit) - 1
        while i >= 0 and left[sizes[i]] <= used.count(sizes[i]):
            i -= 1
        return sizes[i] if i >= 0 else 0

    def smallest(n: int, used: tuple[int, ...]) -> int:
        """The sum of the n smallest pieces left (very large if there are fewer)."""
        total = 0
        for k in sizes:
            have = min(n, left[k] - used.count(k))
            total, n = total + have * k, n - have
            if not n:
                return total
        return capacity + 1

    # Reduction.  For each piece j, largest first: a set with j dominates if every other set with j can be split so
    # that each part fits under one of its pieces.  What stays unproven remains a partner for the smaller ones.
    for j in sizes[::-1]:
        while left[j]:
            room = capacity - j
            k = most(room, (j,))
            if not k:
                take((j,))
            elif k == room or smallest(2, (j,)) > room:  # an exact fit, or only one more fits
                take((j, k))
            elif smallest(3, (j,)) > room:  # at most two more fit: of any pair, the larger is at most k and the smaller at most half
                b = most(room - k, (j, k))
                if b and b >= most(room // 2, (j,)):
                    take((j, k, b))
                elif k >= max((x + y for x in sizes[: bisect_right(sizes, room)] if left[x] > (x == j) and (y := most(min(x, room - x), (j, x)))), default=0):
                    take((j, k))  # one piece covers every pair
                else:
                    break
            else:
                break
    rest = left
    # Best fit, largest first, over open patterns by room.
    rooms: dict[int, list[list]] = {}
    order: list[int] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = capacity - sum(pattern)
        if room not in rooms:
            rooms[room] = []
            insort(order, room)
        rooms[room].append([pattern, n])

    for size in sizes[::-1]:
        n = rest[size]
        while n:
            i = bisect_left(order, size)
            if i == len(order):
                fit = capacity // size
                if n >= fit:
                    put((size,) * fit, n // fit)
                if n % fit:
                    put((size,) * (n % fit), 1)
                break
            room = order[i]
            pattern, have = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(i)
            fit = room // size
            used = min(have, n // fit)
            if used:
                put(pattern + (size,) * fit, used)
                n -= used * fit
                if have > used:
                    put(pattern, have - used)
            else:  # fewer pieces than this room holds
                put(pattern + (size,) * n, 1)
                if have > 1:
                    put(pattern, have - 1)
                n = 0
    return out + [(p, n) for x in rooms.values() for p, n in x]


def pack(cut: DataFrame, capacity: int = 1024, salts: int | None = None) -> DataFrame:
    """The rows of ``pieces`` (settled: it is read twice) with sequence_id and offset."""
    spark = cut.sparkSession
    salts = salts or 2 * shuffle_parts(spark)
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counted = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    counted = settle(counted)  # at most capacity * salts rows
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    ranges, base = [], 0
    used: Counter[int] = Counter()
    for pattern, n in plan(counts, capacity):
        at = 0
        for size in pattern:
            ranges.append((size, used[size], used[size] + n, base, at))
            used[size] += n
            at += size
        base += n
    if used != Counter(counts):
        raise AssertionError("the plan does not hold every piece")
    before = counted.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("_local", local).join(before.hint("merge"), ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_local") - 1)
    slots = spark.createDataFrame(ranges or [(0, 0, 0, 0, 0)], "length long, lo long, hi long, base long, offset long")
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    return placed.select(*[ranked[c] for c in cut.columns], (F.col("base") + F.col("_rank") - F.col("lo")).alias("sequence_id"), "offset")
