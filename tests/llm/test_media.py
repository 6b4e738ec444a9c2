import hashlib
import random
import zlib
from collections import Counter

from voxtable.llm import media, registry


def test_chunks_join_to_the_bytes_and_survive_shifts():
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    ends = media.cuts(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends))
    assert all(media.LEAST <= b - a <= media.MOST for a, b in zip([0, *ends], ends[:-1], strict=False))
    pieces = lambda d: {d[a:b] for a, b in zip([0, *media.cuts(d)], media.cuts(d), strict=False)}
    assert len(pieces(data) & pieces(b"some bytes before" + data)) >= len(ends) - 3
    assert media.cuts(b"") == [0] and media.cuts(b"a" * media.LEAST) == [media.LEAST]


def test_gear_hash_by_its_definition():
    data = bytes(range(200))
    table = media._gear().tolist()
    got = media.gear_hash(media.np.frombuffer(data, media.np.uint8)).tolist()
    for i in (0, 1, 31, 32, 150):
        assert got[i] == sum(table[data[i - k]] << k for k in range(min(i + 1, 32))) % 2**32


def test_rows(spark, odd, none):
    lists, chunks = media.store(odd)
    rows = media.owners(odd).join(media.read(lists, chunks), "media").collect()
    texts = [r["text"] or "" for r in odd.collect()]
    assert len(rows) == len(texts)
    want = Counter((hashlib.sha256(media.payload_of(t)).hexdigest(), len(t.encode()), zlib.crc32(media.payload_of(t)[-16:])) for t in texts)
    assert Counter((r["payload_sha256"], r["n_bytes"], r["tail_crc32"]) for r in rows) == want
    assert all(r["payload_bytes"] % 192 == 0 and r["payload_bytes"] > 0 for r in rows)
    assert chunks.count() == chunks.select("digest").distinct().count()
    lists, chunks = media.store(none)
    assert media.read(lists, chunks).count() == 0


def test_values_by_their_definitions(spark):
    """Nothing of the operator's own code is used for what is expected."""
    texts = ["", "a", "é" * 100, "x" * 192, "y" * 193, None, "word \U0001f600 " * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lists, chunks = media.store(docs)
    rows = {r["doc_id"]: r for r in media.owners(docs).join(media.read(lists, chunks), "media").collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        size = max(1, -(-len(raw) // 192)) * 192
        payload = raw.ljust(size, b" ")
        form = f"P5\n192 {size // 192}\n255\n".encode() + payload
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), size, len(form))
        assert (r["payload_sha256"], bytes(r["media"]), r["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(form).digest(), zlib.crc32(payload[-16:]))
        mean = sum(payload) / size
        deviation = (sum((b - mean) ** 2 for b in payload) / size) ** 0.5
        steps = [abs(payload[k] - payload[k - 1]) for k in range(size) if k % 192]
        bins = [sum(b // 32 == k for b in payload) for k in range(8)]
        assert r["feature"] == f"{mean:.4f}:{deviation:.4f}:{sum(steps) / len(steps):.4f}:" + ",".join(map(str, bins))


def test_a_saved_store_gives_back_its_media(spark, odd, tmp_path):
    media.save(*media.store(odd), str(tmp_path / "store"))
    back = media.read(*media.load(spark, str(tmp_path / "store"))).collect()
    assert {bytes(r["media"]) for r in back} == {hashlib.sha256(media.to_pgm(media.payload_of(r["text"] or ""))).digest() for r in odd.collect()}


def test_query_has_every_document(spark):
    rows = registry.op7_media_columns(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert Counter(r["doc_id"] for r in rows) == Counter(docs.keys())
    for r in rows:
        payload = media.payload_of(docs[r["doc_id"]])
        form = media.to_pgm(payload)
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(form), hashlib.sha256(form).hexdigest(), media.feature_of(payload))
