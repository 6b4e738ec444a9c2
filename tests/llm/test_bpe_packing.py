import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from voxtable.llm import bpe, packing

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_librarys(library):
    random.seed(1)
    signs = "ab1 '\n\t  stmdrevl!é　 ½中ǅ\U0001f600́"
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 16))) for _ in range(20_000)]
    texts += ["a" * 50_000, " " * 3000, "'" * 500, "", "'s's'll'LL 're're", "x\0", "<|endoftext|>"]
    for t, ids in zip(texts, bpe.codec(RANKS).encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(t), repr(t)


def test_ids_are_those_of_the_other_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["<|endoftext|> x", "\0\0", "abcdefgh" * 3, "abcdefg\0"]
    for want, got in zip(t.encode_batch(texts, add_special_tokens=False), bpe.codec(RANKS).encode_batch(texts), strict=True):
        assert want.ids == got.tolist()


def test_pieces_hold_the_ids_of_the_plain_call(spark):
    from tokenizers import Tokenizer

    from voxtable.llm import registry

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    random.seed(4)
    parts = ["<|endoftext|>", "<|endoftext|", "|>", "a", " b", " ", "\n", "1", "é", "'s"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 12))) for _ in range(3000)] + ["a <|endoftext|> b", "<|endoftext|>" * 1500, None]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS, with_ids=True, added=registry.ADDED).collect()
    found = defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append((r["piece"], bytes(r["ids"])))
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert registry.ADDED == {"<|endoftext|>": 50256} and len(found) == len(texts)
    for i, ids in enumerate(want):
        assert b"".join(d for _, d in sorted(found[i])) == np.array([*ids, 2], "<u4").tobytes(), texts[i]


def test_longest_added_token_wins():
    got = bpe.encode_around(bpe.codec(RANKS), ["x<a><a>b<a>", "", "<a>"], {"<a>": 60_000, "<a>b": 60_001})
    assert [g[-1] for g in got if len(g)] == [60_000, 60_000] and 60_001 in got[0].tolist() and not len(got[1])


def test_scan_is_associative():
    _, table, _, _ = bpe._monoid()
    rng = np.random.default_rng(0)
    f = rng.integers(0, len(table), 5000).astype(np.uint16)
    plain = f.copy()
    for i in range(1, len(f)):
        plain[i] = table[plain[i - 1], f[i]]
    assert np.array_equal(bpe._scan(f, table, 16), plain)
    a, b, c = rng.integers(0, len(table), (3, 500))
    assert np.array_equal(table[table[a, b], c], table[a, table[b, c]])


def test_encode_and_decode_rows(spark, odd, none, library):
    rows = bpe.encode(odd, RANKS, decoded=True).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    assert Counter(bytes(r["decoded"]) for r in rows) == Counter(t.encode() for t in texts)
    assert Counter(bytes(r["ids"]) for r in rows) == Counter(np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts)
    again = bpe.decode(bpe.encode(odd, RANKS), RANKS).collect()
    assert Counter(bytes(r["decoded"]) for r in again) == Counter(t.encode() for t in texts)
    assert bpe.encode(none, RANKS).count() == 0


def test_offsets_tell_foreign_ids():
    c = bpe.codec(RANKS)
    ids = c.encode_batch(["hello there"])[0]
    with pytest.raises(ValueError):
        c.decode(ids, c.offsets(ids) + np.uint32(1))


def check_plan(counts, capacity):
    used = Counter()
    for pattern, n in packing.plan(counts, capacity):
        assert sum(pattern) <= capacity and n > 0
        for k, m in Counter(pattern).items():
            used[k] += m * n
    assert used == Counter({k: v for k, v in counts.items() if v})
    return sum(n for _, n in packing.plan(counts, capacity))


def best_possible(items, capacity):
    """Fewest bins by trying all: small instances only."""
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_plan_against_all_ways():
    rng = random.Random(3)
    off = 0
    for _ in range(150):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        got, least = check_plan(Counter(items), 20), best_possible(items, 20)
        assert got <= least + 1
        off += got - least
    assert off <= 5


def test_plan_edges():
    assert packing.plan({}, 10) == []
    assert check_plan({10: 5}, 10) == 5
    assert check_plan({5: 7}, 10) == 4
    assert check_plan({7: 3, 3: 3}, 10) == 3
    assert check_plan({1: 1000}, 10) == 100


def test_pack_rows(spark, odd, none):
    cut = packing.pieces(odd, RANKS, capacity=64, with_ids=True).cache()
    rows = packing.pack(cut, 64, salts=3).collect()
    assert len(rows) == cut.count()
    tokens = {t: [*bpe.codec(RANKS).encode_batch([t])[0].tolist(), 2] for t in {r["text"] or "" for r in odd.collect()}}
    whole = defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and r["length"] == len(r["ids"]) // 4
        whole[r["doc_id"]].append(r)
    for r in odd.where("doc_id not in (8) and doc_id is not null").collect():
        parts = sorted(whole[r["doc_id"]], key=lambda p: p["piece"])
        assert b"".join(bytes(p["ids"]) for p in parts) == np.array(tokens[r["text"] or ""], "<u4").tobytes()
        assert [p["start"] for p in parts] == np.cumsum([0, *[p["length"] for p in parts]])[:-1].tolist()
        assert all(p["length"] == 64 for p in parts[1:])
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(packing.pieces(none, RANKS)).count() == 0


def test_query_digests(spark):
    from voxtable.llm import registry

    row = registry.op3_byte_bpe(spark, "/root/testdata/sf0.001").where("doc_id = 7").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id = 7").first()["text"]
    assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
