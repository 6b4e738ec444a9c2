"""Byte-level BPE without regular expressions.

Pre-tokenisation looks at a whole batch of texts at once.  Every code point becomes a
symbol (letter, number, space, ...), each symbol is a transition function over eight
states, and function composition is associative: a blocked prefix scan over a
composition table gives the state after every code point, and a second lookup tells
where a piece starts.  Only the bytes of a piece decide its ids, so pieces go through
a bounded cache in front of the pair merging.

Null texts count as empty; an empty text has no ids.  Row ids may repeat: each row is
encoded by itself.  Long texts are encoded whole.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import id_text, small_batches

#: States: after which kind of code point the scan stands.
END, LETTER, NUMBER, OTHER, SPACES, LEAD, TAKE1, TAKE2 = range(8)
#: Symbols.  *_RUN: white space with white space or the end behind it; SP: a blank, and WS: other white
#: space, before something else; APO1, APO2: an apostrophe before one of the one- or two-letter endings.
S_LETTER, S_NUMBER, S_OTHER, S_RUN, S_SP, S_WS, S_APO1, S_APO2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts at this code point."""
    if symbol == S_LETTER:
        if state == TAKE2:
            return TAKE1, False
        if state == TAKE1:
            return END, False
        return LETTER, state not in (LETTER, LEAD)
    if symbol == S_NUMBER:
        return NUMBER, state not in (NUMBER, LEAD)
    if symbol in (S_OTHER, S_APO1, S_APO2):
        if state in (OTHER, LEAD):
            return OTHER, False
        return {S_OTHER: OTHER, S_APO1: TAKE1, S_APO2: TAKE2}[symbol], True
    if symbol == S_RUN:
        return SPACES, state != SPACES
    return (LEAD if symbol == S_SP else END), True


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the symbols' functions (the second eight: of a symbol that begins a text), the composition
    table (first, then), each function's value at END, and the table of starts."""
    plain = [tuple(_step(q, s)[0] for q in range(8)) for s in range(8)]
    first = [(_step(END, s)[0],) * 8 for s in range(8)]
    ids: dict[tuple[int, ...], int] = {}
    for f in plain + first:
        ids.setdefault(f, len(ids))
    todo = list(ids)
    while todo:
        f = todo.pop()
        for g in list(ids):
            for a, b in ((f, g), (g, f)):
                h = tuple(b[a[q]] for q in range(8))
                if h not in ids:
                    ids[h] = len(ids)
                    todo.append(h)
    table = np.zeros((len(ids), len(ids)), np.uint16)
    for f, i in ids.items():
        for g, j in ids.items():
            table[i, j] = ids[tuple(g[f[q]] for q in range(8))]
    starts = np.array([[_step(q, s)[1] for s in range(8)] for q in range(8)])
    return np.array([ids[f] for f in plain + first], np.uint16), table, np.array([f[END] for f in ids], np.uint8), starts


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, by code point."""
    out = np.zeros(0x110000, np.uint8)
    kinds = {"L": 1, "N": 2}
    for c in range(0x110000):
        out[c] = kinds.get(unicodedata.category(chr(c))[0], 0)
    # The code points of Unicode's White_Space property.
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    return out


def _scan(functions: np.ndarray, table: np.ndarray, width: int = 256) -> np.ndarray:
    """Inclusive prefix compositions: within rows of a grid, then over the rows' ends, then combined."""
    n = len(functions)
    if n <= width:
        out = functions.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], functions[i]]
        return out
    rows = -(-n // width)
    grid = np.zeros((width, rows), np.uint16)  # column-wise, so that each step is contiguous
    padded = np.full(rows * width, functions[-1], np.uint16)
    padded[:n] = functions
    grid[:] = padded.reshape(rows, width).T
    for i in range(1, width):
        grid[i] = table[grid[i - 1], grid[i]]
    before = _scan(np.ascontiguousarray(grid[-1]), table, width)
    grid[:, 1:] = table[before[:-1], grid[:, 1:]]
    return np.ascontiguousarray(grid.T).reshape(-1)[:n]


def boundaries(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pieces start, for the joined code points of many texts; text_starts: where each (non-empty) text does."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    of_symbol, table, at_end, starts = _monoid()
    kind = _classes()[points]
    begins = np.zeros(n + 1, bool)
    begins[text_starts] = True
    begins[n] = True
    space = kind == 3
    run = space & (np.append(space[1:], False) | begins[1:])
    symbol = np.array([S_OTHER, S_LETTER, S_NUMBER, S_WS], np.uint8)[kind]
    symbol[space & (points == 32)] = S_SP
    symbol[run] = S_RUN
    apostrophes = np.flatnonzero(points == 39)
    if len(apostrophes):
        behind = np.append(points, [0, 0])
        stop = np.append(begins, True)
        a, b = behind[apostrophes + 1], behind[apostrophes + 2]
        has1 = ~stop[apostrophes + 1]
        has2 = has1 & ~stop[np.minimum(apostrophes + 2, n)]
        one = has1 & np.isin(a, [ord(c) for c in "stmd"])
        two = has2 & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        symbol[apostrophes[one]] = S_APO1
        symbol[apostrophes[two]] = S_APO2
    functions = of_symbol[symbol + 8 * begins[:n].astype(np.uint8)]
    after = at_end[_scan(functions, table)]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = END, after[:-1]
    return np.flatnonzero(starts[before, symbol] | begins[:n])


#: Of a little-endian number, the first n bytes.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Codec:
    """Encoder and decoder for one file of ranks.  Pieces of up to 64 bytes are cached with their ids in one
    flat array; the cache is emptied when it holds ``cache`` pieces."""

    def __init__(self, path: str, cache: int = 250_000) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = {i: b for b, i in ranks.items()}
        self.merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.widths = np.zeros(max(self.pieces) + 1, np.int64)
        self.widths[list(self.pieces)] = list(map(len, self.pieces.values()))
        self.cache = cache
        self._empty()

    def _empty(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def _add(self, pieces: list[bytes]) -> None:
        ids = list(map(self.merge, pieces))
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known.update(zip(pieces, range(len(self.at), len(self.at) + len(ids)), strict=True))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.fromiter((x for y in ids for x in y), "<u4", int(size.sum()))])

    def _slots(self, data: bytes, cuts: np.ndarray) -> np.ndarray:
        """Cache places of the pieces between cuts.  Pieces of up to 15 bytes are told apart as one or two numbers (with their
        length in the last byte), so only distinct ones are looked up by their bytes."""
        if len(self.known) >= self.cache:
            self._empty()
        starts, lengths = cuts[:-1], np.diff(cuts)
        padded = data + bytes(16)
        words = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
        first: list[np.ndarray] = []  # for each distinct piece, one of its places
        code = np.empty(len(starts), np.int64)
        count = 0

        def add(rows: np.ndarray, codes: np.ndarray, n: int) -> None:
            nonlocal count
            place = np.empty(n, np.int64)
            place[codes] = rows
            first.append(place)
            code[rows] = count + codes
            count += n

        def tagged(at: np.ndarray, size: np.ndarray) -> np.ndarray:
            return words[at] & _MASKS[size] | size.astype(np.uint64) << np.uint64(56)

        rows = np.flatnonzero(lengths < 8)
        codes, distinct = pd.factorize(tagged(starts[rows], lengths[rows]))
        add(rows, codes, len(distinct))
        rows = np.flatnonzero((lengths >= 8) & (lengths < 16))
        head, _ = pd.factorize(words[starts[rows]])
        tail, tails = pd.factorize(tagged(starts[rows] + 8, lengths[rows] - 8))
        codes, distinct = pd.factorize(head * max(1, len(tails)) + tail)
        add(rows, codes, len(distinct))
        rows = np.flatnonzero(lengths >= 16)
        add(rows, np.arange(len(rows)), len(rows))

        where = np.concatenate(first)
        pieces = list(map(data.__getitem__, map(slice, starts[where].tolist(), cuts[1:][where].tolist())))
        slots = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(slots < 0).tolist()
        if missing:
            new = {pieces[i] for i in missing}
            self._add(list(new))
            slots[missing] = [self.known[pieces[i]] for i in missing]
            for p in new:  # found again only by chance
                if len(p) > 64:
                    del self.known[p]
        return slots[code]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if not len(points):
            return [np.zeros(0, "<u4") for _ in texts]
        at = boundaries(points, (ends - lengths)[lengths > 0])
        data = joined.encode()
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        place = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        slots = self._slots(data, np.append(place[at], len(data)))
        size = self.size[slots]
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[slots] - (stop - size), size) + np.arange(stop[-1])]
        first = np.searchsorted(at, np.append(ends - lengths, len(points)))
        return np.split(ids, np.append(0, stop)[first[1:-1]])

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each token starts."""
        sizes = self.widths[ids]
        return (np.cumsum(sizes) - sizes).astype("<u4")

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        out = b"".join(map(self.pieces.__getitem__, ids.tolist()))
        if offsets is not None and len(ids) and len(out) != int(offsets[-1]) + len(self.pieces[int(ids[-1])]):
            raise ValueError("offsets do not belong to these ids")
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(path)


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a ``tokenizers`` file, which are cut out of a text before anything else."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t[k] for t in found for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("only added tokens that take nothing beside them are supported")
    return {t["content"]: t["id"] for t in found}


def encode_around(c: Codec, texts: list[str], added: dict[str, int]) -> list[np.ndarray]:
    """The ids of each text, in which an added token (leftmost, the longest of several) is one id and parts the text."""
    if not added:
        return c.encode_batch(texts)
    mark = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    parts = [mark.split(t) if any(a in t for a in added) else [t] for t in texts]  # every second part is an added token
    done = iter(c.encode_batch([p for x in parts for p in x[::2]]))
    return [next(done) if len(x) == 1 else np.concatenate([np.array([added[p]], "<u4") if i % 2 else next(done) for i, p in enumerate(x)]) for x in parts]


def groups(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` code points each, so that the scan's arrays stay small."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", *, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens long, ids binary, offsets binary): little-endian unsigned 32-bit ids, and the byte
    of the UTF-8 text at which each token starts.  One row for each input row.  With ``decoded``, a column more:
    the bytes that the ids give back, in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in groups(texts):
                ids = c.encode_batch(texts[lo:hi])
                offsets = [c.offsets(x) for x in ids]
                columns = [names[lo:hi], pa.array(map(len, ids), pa.int64()), pa.array((x.tobytes() for x in ids), pa.binary()), pa.array((x.tobytes() for x in offsets), pa.binary())]
                if decoded:
                    columns.append(pa.array(map(c.decode, ids, offsets), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names_out)

    names_out = ["doc_id", "n_tokens", "ids", "offsets", *["decoded"] * decoded]
    small_batches(docs)
    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary, offsets binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """The rows of ``encode`` with ``decoded`` binary, the text's bytes, in place of the offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks)
        for batch in batches:
            ids, offsets = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            data = [c.decode(np.frombuffer(i, "<u4"), None if o is None else np.frombuffer(o, "<u4")) for i, o in zip(ids, offsets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(data, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    small_batches(encoded)
    return encoded.select("doc_id", "n_tokens", "ids", "offsets").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
