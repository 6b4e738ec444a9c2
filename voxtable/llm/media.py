"""Media columns: lossless payloads, stored as content-defined chunks.

A text's UTF-8 bytes, padded with blanks to a positive multiple of 192, become the
samples of a grey 8-bit picture (binary PGM, 192 samples a row).  A rolling gear hash cuts
the stored form into chunks; equal chunks are kept once, found by their digest in a
Spark join; each document keeps its ordered chunk list.  Reading joins the list with the
chunks, puts them in order and verifies the result before anything is computed from it.

Equal payloads share one chunk list, so a large group of copies is written and read
once.  A null text counts as empty (192 blanks).  Long texts are many chunks.  Row
ids may repeat; each row gets its result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, small_batches

UNIT = 192
LEAST, MOST, BITS = 4096, 65536, 13  # bytes of a chunk; it is cut where BITS of the hash are zero


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=4).digest() for i in range(256)), "<u4")


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[data[i-k]] << k for k below 32, by doubling the window."""
    h = _gear()[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks; they depend on the bytes around them only (and on the least and most size)."""
    n = len(data)
    if n <= LEAST:
        return [n]
    mask = np.uint32(((1 << BITS) - 1) << (32 - BITS))
    marks = np.flatnonzero((gear_hash(np.frombuffer(data, np.uint8)) & mask) == 0) + 1
    out, at, marks = [], 0, marks.tolist()
    k = 0
    while n - at > LEAST:
        while k < len(marks) and marks[k] < at + LEAST:
            k += 1
        end = min(n, at + MOST, marks[k] if k < len(marks) else n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw + b" " * (-len(raw) % UNIT or (0 if raw else UNIT))


def to_pgm(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (UNIT, len(payload) // UNIT) + payload


def from_pgm(media: bytes) -> bytes:
    magic, size, most, payload = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255" or len(payload) != width * height:
        raise ValueError("not an 8-bit grey picture")
    return payload


def feature_of(payload: bytes) -> str:
    """Mean, deviation and 8-bin histogram of the samples, and the mean step between neighbours in a row."""
    x = np.frombuffer(payload, np.uint8)
    rows = x.reshape(-1, UNIT).astype(np.int16)
    bins = np.bincount(x >> 5, minlength=8)
    return f"{x.mean():.4f}:{x.std():.4f}:{np.abs(np.diff(rows, axis=1)).mean():.4f}:" + ",".join(map(str, bins))


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each row's unpadded bytes and the digest of its stored form."""
    return id_text(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), _media_digest("text").alias("media"))


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, with_data: bool = True) -> DataFrame:
    """(media, seq, n, digest, data): every chunk of every stored form, in order; data is compressed, and null
    without ``with_data``.  Copies met in one batch are cut once; the joins drop the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=9, write_checksum=False)
        for batch in batches:
            seen: set[bytes] = set()
            out: list[tuple] = []
            size = 0
            for media, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if media in seen:
                    continue
                seen.add(media)
                form, at = to_pgm(payload_of(text)), 0
                if hashlib.sha256(form).digest() != media:
                    raise ValueError("a stored form differs from its digest")
                ends = cuts(form)
                for seq, end in enumerate(ends):
                    piece = form[at:end]
                    out.append((media, seq, len(ends), hashlib.sha256(piece).digest(), squeeze.compress(piece) if with_data else None))
                    at, size = end, size + end - at
                if size > 8 << 20:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    small_batches(docs)
    rows = id_text(docs, id_col, text_col).select(_media_digest("text").alias("media"), "text")
    return rows.mapInArrow(run, "media binary, seq int, n int, digest binary, data binary")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lists, chunks): lists has the ordered digests of each distinct stored form, (media, seq, n, digest);
    chunks has each distinct chunk once, (digest, data)."""
    lists = chunked(docs, id_col, text_col, with_data=False).select("media", "seq", "n", "digest").distinct()
    chunks = chunked(docs, id_col, text_col).groupBy("digest").agg(F.first("data").alias("data"))
    return lists, chunks


def save(lists: DataFrame, chunks: DataFrame, path: str) -> None:
    """Keep a store in a folder: one table of lists and one of chunks, each chunk in the file range of its digest."""
    lists.write.parquet(f"{path}/lists")
    chunks.sortWithinPartitions("digest").write.parquet(f"{path}/chunks")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lists, chunks) of a saved store."""
    return spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/chunks")


def read(lists: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rebuild and verify every stored form: (media, media_bytes, payload_bytes, payload_sha256, tail_crc32, feature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for media, n, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if [p["seq"] for p in parts] != list(range(n)):
                    raise ValueError("a chunk is missing")
                form = b"".join(zstandard.decompress(p["data"]) for p in parts)
                if hashlib.sha256(form).digest() != media:
                    raise ValueError("a rebuilt form differs from its digest")
                payload = from_pgm(form)
                out.append({"media": media, "media_bytes": len(form), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "feature": feature_of(payload)})
            yield pa.RecordBatch.from_pylist(out, schema=_READ)

    small_batches(lists)
    schema = "media binary, media_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
    met = lists.join(chunks, "digest")
    # A form of one chunk is whole where the chunk is; only the others' chunks move together.
    single = met.where(F.col("n") == 1).select("media", "n", F.array(F.struct("seq", "data")).alias("parts"))
    several = met.where(F.col("n") > 1).groupBy("media").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("parts"))
    return single.mapInArrow(run, schema).unionByName(several.mapInArrow(run, schema))


_READ = pa.schema([("media", pa.binary()), ("media_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    media, seq, n, digest, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(media, pa.binary()), pa.array(seq, pa.int32()), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(data, pa.binary())], names=["media", "seq", "n", "digest", "data"])


def _media_digest(text: str):
    """SHA-256 of the stored form, as a column expression."""
    n = F.octet_length(text)
    padded = F.greatest(F.ceil(n / UNIT), F.lit(1)) * UNIT
    head = F.concat(F.lit(f"P5\n{UNIT} "), (padded / UNIT).cast("long").cast("string"), F.lit("\n255\n"))
    return F.unhex(F.sha2(F.concat(F.encode(head, "utf-8"), F.encode(F.col(text), "utf-8"), F.encode(F.repeat(F.lit(" "), (padded - n).cast("int")), "utf-8")), 256))
