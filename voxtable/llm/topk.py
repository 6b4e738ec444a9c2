"""Exact top-k by inner product: the three-phase uniform threshold algorithm.

Vectors are scaled to whole numbers.  A node holds one of ``parts`` slices of the dimensions for every candidate, in blocks that stay
where they are; a node's score list for a query is the partial inner products over its slice.  Queries go through in
rounds of a bounded number, whose vectors are broadcast (at most ``QUERY_BYTES``).  In each round

1. every node gives, for each query, its k greatest entries; the exact totals of these entries (what a node did not give is
   fetched from it) have a k-th best, which is a safe cutoff;
2. the cutoffs are broadcast, one number a query: a vector whose entries are all below cutoff / parts cannot reach the cutoff, so
   each node gives its entries at or above that and nothing else;
3. of vectors that came from some nodes only, the missing entries are fetched from the others; totals at or above the
   cutoff are ranked, ties to the smaller id.

What moves are entries, never vectors but for those of which entries are fetched, block by block.  Of equal vectors only the first few ids can be
among the best, so only those become candidates (2k rows of a vector at most, whoever asks), however often a vector is repeated.

Vectors that are null or hold null or non-finite components, and rows without an id, take no part.  Shorter vectors count as
padded with zeros.  Repeated rows are candidates each; a repeated query row is answered each time; a
query never meets candidates that bear its own id.  Fewer than k candidates: all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import add_to, fresh_path, settle, shuffle_parts, small_batches

QUERY_BYTES = 32 << 20  # of vectors that a round broadcasts
SLICE = 256  # queries at a time, so that a task's score matrices stay small
_ENTRIES = "node int, block int, q int, n int, qi binary, ci binary, partial binary"  # of one node, block and slice of queries, packed
_TOTALS = "qi int, block int, ci int, total long"


def scaled(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", factor: int = 64) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    v = F.col(vec_col)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long"))
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """The rows that can be among the k best of some query: of each vector, k rows of an id and 2k in all, those with the smallest ids.
    (Without the rows of its own id, a query meets the first k of any vector's others among these.)"""
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
    return rows.withColumn("_n", nth("v", "vec_id")).where(F.col("_n") <= k).withColumn("_n", nth("v")).where(F.col("_n") <= 2 * k).drop("_n")


def _matrix(vectors: pd.Series, dim: int, kind: str) -> np.ndarray:
    out = np.zeros((len(vectors), dim), kind)
    for i, x in enumerate(vectors):
        out[i, : len(x)] = x
    return out


def _slices(dim: int, parts: int) -> list[slice]:
    at = np.linspace(0, dim, parts + 1).astype(int)
    return [slice(int(a), int(b)) for a, b in zip(at, at[1:], strict=False)]


def cells(rows: DataFrame, n: int, dim: int, parts: int, kind: str) -> DataFrame:
    """(node, block, ids, data): every node's slice of every block, in order of ids; rows are dealt by a hash of id and place."""
    cuts = _slices(dim, parts)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        data, ids = _matrix(pdf["v"], dim, kind), pdf["vec_id"].to_numpy(np.int64)
        return pd.DataFrame([(i, pdf["block"].iloc[0], ids, np.ascontiguousarray(data[:, c]).tobytes()) for i, c in enumerate(cuts)], columns=["node", "block", "ids", "data"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    spread = dealt.repartition(min(n, shuffle_parts(rows.sparkSession)), "block")
    return settle(spread.groupBy("block").applyInPandas(pack, "node int, block int, ids array<long>, data binary"))


class Round:
    """The queries of a round, as workers use them: (ids, vectors) and, from the second phase on, the cutoffs."""

    def __init__(self, queries: Broadcast, dim: int, parts: int, kind: str, exact: str, partial: str) -> None:
        self.queries, self.cuts, self.kind, self.exact, self.partial = queries, _slices(dim, parts), kind, exact, partial

    def pack(self, node: int, block: int, qi: np.ndarray, ci: np.ndarray, partial: np.ndarray) -> pa.RecordBatch | None:
        """Entries of one node and block as a row for each slice of queries."""
        order = np.argsort(qi, kind="stable")
        qi, ci, partial = qi[order], ci[order].astype(_PLACE), partial[order].astype(self.partial)
        of = qi // SLICE
        at = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)) if len(of) else np.zeros(1, np.int64)
        rows = [(node, block, int(of[i]), j - i, (qi[i:j] % SLICE).astype(np.uint8).tobytes(), ci[i:j].tobytes(), partial[i:j].tobytes()) for i, j in zip(at.tolist(), at[1:].tolist(), strict=False)]
        return _rows(rows, _ENTRIES)

    def unpack(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(row["qi"], np.uint8).astype(np.int64), np.frombuffer(row["ci"], _PLACE).astype(np.int64), np.frombuffer(row["partial"], self.partial).astype(np.int64)

    def node(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, the queries' slices, ids, the block's slices) for a row of ``cells``."""
        q_ids, q = self.queries.value
        cut = self.cuts[row["node"]]
        ids = np.array(row["ids"], np.int64)
        data = np.frombuffer(row["data"], self.kind).reshape(-1, cut.stop - cut.start) if cut.stop > cut.start else np.zeros((len(ids), 0), self.kind)
        return q_ids, q[:, cut].astype(self.exact), ids, data.astype(self.exact)


_PLACE = "<u2"  # in a block
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _local_lists(at: Round, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's k greatest entries for every query, of the blocks of this task."""
    lists: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            q_ids, q, ids, c = at.node(row)
            none = -np.inf if c.dtype.kind == "f" else -(2**62)
            if row["node"] not in lists:
                lists[row["node"]] = [np.full((len(q), k), none, c.dtype), np.full((len(q), k), -1, np.int32), np.full((len(q), k), -1, np.int32)]
            best = lists[row["node"]]
            for lo in range(0, len(q), SLICE):
                part = slice(lo, lo + SLICE)
                score = q[part] @ c.T
                score[q_ids[part, None] == ids[None, :]] = none
                m = min(k, len(ids))
                near = np.argpartition(score, len(ids) - m, axis=1)[:, len(ids) - m :]
                found = [np.take_along_axis(score, near, axis=1), np.full(near.shape, row["block"], np.int32), near.astype(np.int32)]
                both = [np.concatenate([b[part], f], axis=1) for b, f in zip(best, found, strict=True)]
                keep = np.argpartition(both[0], m, axis=1)[:, m:]
                for b, x in zip(best, both, strict=True):
                    b[part] = np.take_along_axis(x, keep, axis=1)
    for node, (score, block, ci) in lists.items():
        qi, place = np.nonzero(score > (-np.inf if score.dtype.kind == "f" else -(2**62)))
        score, block, ci = score[qi, place], block[qi, place], ci[qi, place]
        for b in np.unique(block).tolist():
            here = block == b
            yield at.pack(node, b, qi[here], ci[here], score[here])


def _sufficient(at: Round, cutoffs: Broadcast, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's entries at or above cutoff / parts."""
    for batch in batches:
        for row in batch.to_pylist():
            q_ids, q, ids, c = at.node(row)
            for lo in range(0, len(q), SLICE):
                part = slice(lo, lo + SLICE)
                score = q[part] @ c.T
                qi, ci = np.nonzero((score * parts >= cutoffs.value[part, None]) & (q_ids[part, None] != ids[None, :]))
                if len(qi):
                    yield at.pack(row["node"], row["block"], lo + qi, ci, score[qi, ci])


def _fetched(at: Round, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries that are asked for."""
    for batch in batches:
        for row in batch.to_pylist():
            _, q, _, c = at.node(row)
            qi, ci = np.frombuffer(row["qi"], np.uint8).astype(np.int64) + SLICE * row["q"], np.frombuffer(row["ci"], _PLACE).astype(np.int64)
            partial = np.concatenate([np.einsum("ij,ij->i", q[qi[i : i + 65536]], c[ci[i : i + 65536]]) for i in range(0, len(qi), 65536)])
            yield at.pack(row["node"], row["block"], qi, ci, partial)


def _totals(known: DataFrame, held: DataFrame, at: Round, parts: int, k: int, cutoffs: Broadcast | None = None) -> DataFrame:
    """(qi, block, ci, total): of the vectors with a known entry, each query's k best of a block (with cutoffs, only those that reach the query's),
    ties to the smaller id; the entries that are not known are fetched from their nodes.  A group is one slice of queries and one block."""

    def missing(table: pa.Table) -> pa.Table:
        have = {r["node"]: np.unique(at.unpack(r)[0] << 32 | at.unpack(r)[1]) for r in table.select(["node", "qi", "ci", "partial"]).to_pylist()}
        everything = np.unique(np.concatenate(list(have.values())))
        block, q, out = table.column("block")[0].as_py(), table.column("q")[0].as_py(), []
        for node in range(parts):
            lost = np.setdiff1d(everything, have.get(node, np.zeros(0, np.int64)), assume_unique=True)
            if len(lost):
                out.append((node, block, q, len(lost), (lost >> 32).astype(np.uint8).tobytes(), (lost & 0xFFFFFFFF).astype(_PLACE).tobytes(), None))
        return pa.Table.from_batches([_rows(out, _ENTRIES)])

    def combine(table: pa.Table) -> pa.Table:
        qi, ci, partial = (np.concatenate(x) for x in zip(*(at.unpack(r) for r in table.to_pylist()), strict=True))
        keys, slot = np.unique(qi << 32 | ci, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, slot, partial)
        block, q = table.column("block")[0].as_py(), table.column("q")[0].as_py()
        qi, ci = (keys >> 32) + SLICE * q, keys & 0xFFFFFFFF
        if cutoffs is not None:
            enough = total >= cutoffs.value[qi]
            qi, ci, total = qi[enough], ci[enough], total[enough]
        order = np.lexsort((ci, -total, qi))
        first = np.flatnonzero(np.append(True, np.diff(qi[order]) != 0)) if len(order) else np.zeros(0, np.int64)
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        best = order[rank < k]
        columns = [qi[best], np.full(len(best), block), ci[best], total[best]]
        return pa.table([pa.array(c.astype(t)) for c, t in zip(columns, (np.int32, np.int32, np.int32, np.int64), strict=True)], names=["qi", "block", "ci", "total"])

    asked = known.groupBy("block", "q").applyInArrow(missing, _ENTRIES)
    fetched = held.drop("ids").join(asked.select("node", "block", "q", "qi", "ci"), ["node", "block"]).withColumn("ids", F.array().cast("array<long>")).mapInArrow(lambda b: _fetched(at, b), _ENTRIES)
    return known.unionByName(fetched).groupBy("block", "q").applyInArrow(combine, _TOTALS)


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, parts: int = 2, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = 16384, block: int = 4096, counts: dict[str, int] | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's best k rows among all with another id.  ``is_query``: over vec_id.  With ``counts``,
    how many entries the phases moved is added to it."""
    spark = vectors.sparkSession
    rows = settle(scaled(vectors, id_col, vec_col))
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    size = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(1)).alias("dim"), F.count(F.when(is_query, 1)).alias("q"), F.coalesce(largest, F.lit(0)).alias("most")).first()
    dim, block = max(parts, size["dim"]), min(block, 65536)
    kind = "<i2" if size["most"] < 2**15 else "<i4" if size["most"] < 2**31 else "<i8"
    # Sums of products that are exact in the floating type are computed in it.
    exact = next((t for t, bits in (("f4", 23), ("f8", 51)) if size["most"] ** 2 * dim * parts < 2**bits), "i8")
    partial = "<i4" if size["most"] ** 2 * dim < 2**31 else "<i8"
    few = settle(candidates(rows, k))
    held = cells(few, max(1, -(-few.count() // block)), dim, parts, kind)
    query_block = max(1, min(query_block, QUERY_BYTES // (dim * np.dtype(kind).itemsize)))
    rounds = max(1, -(-size["q"] // query_block) * 2) if size["q"] > query_block else 1  # about half full, so that none is too large
    asking = rows.where(is_query).withColumn("_r", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(rounds)).cast("int"))
    asking = settle(asking) if rounds > 1 else asking
    small_batches(vectors)
    places = held.where("node = 0").select("block", F.posexplode("ids").alias("ci", "vec_id"))
    path = fresh_path(spark)
    for r in range(rounds):
        own = asking.where(F.col("_r") == r).select("vec_id", "v").toPandas()  # about query_block rows at most
        queries = spark.sparkContext.broadcast((own["vec_id"].to_numpy(np.int64), _matrix(own["v"], dim, kind)))
        at = Round(queries, dim, parts, kind, exact, partial)

        def lists(batches: Iterator[pa.RecordBatch], at: Round = at) -> Iterator[pa.RecordBatch]:
            return _local_lists(at, k, batches)

        # Phase 1.
        gathered = settle(held.mapInArrow(lists, _ENTRIES))
        nth = F.row_number().over(Window.partitionBy("qi").orderBy(F.desc("total")))
        kth = _totals(gathered, held, at, parts, k).withColumn("_n", nth).where(F.col("_n") == k).select("qi", "total").toPandas()  # a row for each query of the round
        cut = np.full(len(own), -(2**60), np.int64)
        cut[kth["qi"].to_numpy(np.int64)] = kth["total"].to_numpy(np.int64)
        cutoffs = spark.sparkContext.broadcast(cut)

        def sufficient(batches: Iterator[pa.RecordBatch], at: Round = at, cutoffs: Broadcast = cutoffs) -> Iterator[pa.RecordBatch]:
            return _sufficient(at, cutoffs, parts, batches)

        # Phases 2 and 3.
        collected = settle(held.mapInArrow(sufficient, _ENTRIES))
        reached = _totals(collected, held, at, parts, k, cutoffs).join(places, ["block", "ci"])
        best = reached.withColumn("rank", F.row_number().over(Window.partitionBy("qi").orderBy(F.desc("total"), "vec_id"))).where(F.col("rank") <= k)
        names = np.asarray(queries.value[0])
        ids = spark.createDataFrame(pd.DataFrame({"qi": np.arange(len(names), dtype=np.int32), "query_id": names}), "qi int, query_id long")  # the round's queries
        add_to(best.join(F.broadcast(ids), "qi").select("query_id", "rank", "vec_id", F.col("total").alias("score")), path)
        if counts is not None:
            moved = {name: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for name, df in (("gathered", gathered), ("collected", collected))}
            for name, n in (*moved.items(), ("queries", len(own)), ("candidates", few.count() * (r == 0))):
                counts[name] = counts.get(name, 0) + n
        queries.unpersist()
        cutoffs.unpersist()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)
