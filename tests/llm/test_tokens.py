"""Encoding, counting, packing and the store against the tokenizers library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from millrace.llm.packing import pack_documents, sum_of_squares
from millrace.llm.token_counts import resync_count, token_counts
from millrace.llm.token_store import address, crc_join, cut_points, marks, merkle, read_digests, read_documents, recipes, verify_manifest, write_store
from millrace.llm.tokens import Encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "ab's t're  \n\t'll d9²<|endoftext|><|startoftext|>éÉĳŉſµªß·×\xad́İ漢Кa.,!_- \x1c\x85\xa0"
ODD = [None, "", " ", "\n\n", "x", "a" * 5_000, "word " * 12_000, "é漢 " * 9_000, "no-space" * 9_000, "<|endoftext|>" * 30, "tail <|endoftext|> mid", "😀 emoji\r\n"]


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + 3 * i, t, "en", i, 7) for i, t in enumerate(texts)], "doc_id long, text string, lang string, piece int, n_tokens int")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(200))) for _ in range(300)]
    return ODD + made + made[:20]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_remembered_pieces_give_the_librarys_ids(path, texts):
    enc = Encoder(path)
    given = [t or "" for t in texts]
    assert enc.family in ("byte", "word")
    for _ in range(2):
        assert enc.encode(given) == enc._library(given)


def test_memory_has_a_bound(monkeypatch):
    monkeypatch.setattr("millrace.llm.tokens.MEMORY", 50)
    enc = Encoder(BYTE)
    rng = random.Random(5)
    for _ in range(20):
        batch = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(5)]
        assert enc.encode(batch) == enc._library(batch)
    assert len(enc.memory) < 400


@pytest.mark.parametrize("chunk,overlap", [(50, 8), (200, 3), (1_000, 100)])
def test_resynchronised_counts(chunk, overlap, texts):
    enc = Encoder(BYTE)
    long = [" ".join((t or "")[:300] for t in texts), "x" * 3_000, "ab cd " * 500, "   " * 800, "a  b\n\n c " * 300, "<|endoftext|> " * 200, "é漢" * 600]
    for t in long:
        assert resync_count(enc, t, chunk, overlap) == len(enc.library.encode(t, add_special_tokens=False).ids), t[:40]


def test_token_counts(spark, texts):
    enc = Encoder(BYTE)
    got = {r["doc_id"]: r for r in token_counts(documents(spark, texts), BYTE, chunk=500, overlap=20).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(enc.library.encode(t or "", add_special_tokens=False).ids)
        assert (got[3 * i]["n_bytes"], got[3 * i]["n_tokens"], got[3 * i]["over_limit"]) == (len((t or "").encode()), n, n > 512)
    piece = {r["doc_id"]: r["n_tokens"] for r in token_counts(documents(spark, texts[:4]), public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert piece[0] == 0 and piece[12 - 3] > 0
    assert token_counts(documents(spark, []), BYTE).count() == 0


def test_sum_of_squares_follows_its_rule():
    rng = np.random.default_rng(1)
    for capacity in (7, 20):
        sizes = rng.integers(1, capacity + 1, 200)
        bins, offsets = sum_of_squares(sizes, capacity)
        level = {}
        for a, b, o in zip(sizes.tolist(), bins.tolist(), offsets.tolist(), strict=True):
            gaps = [capacity - x for x in level.values() if x < capacity]
            squares = lambda g: sum(g.count(x) ** 2 for x in set(g))
            options = [squares([*(lambda h: (h.remove(g), h)[1])(list(gaps)), *([g - a] if g > a else [])]) for g in set(gaps) if g >= a]
            options.append(squares([*gaps, *([capacity - a] if a < capacity else [])]))
            assert o == level.get(b, 0)
            before = squares([capacity - x for k, x in level.items() if k != b and x < capacity] + ([capacity - o - a] if o + a < capacity else []))
            assert before == min(options)
            level[b] = o + a
        assert max(level.values()) <= capacity


def test_packing_keeps_every_id_in_place(spark, texts):
    enc = Encoder(WORD)
    got = pack_documents(documents(spark, texts), WORD, capacity=256, group=150).collect()
    whole = {3 * i: [*enc.library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    pieces, bins = {}, {}
    for r in got:
        ids = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 256 * r["piece"] and len(ids) == r["length"] and crc(ids) == r["ids_crc32"]
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces == {k: len(v) for k, v in whole.items()}
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.1 * -(-sum(pieces.values()) // 256)
    assert pack_documents(documents(spark, []), WORD).count() == 0


def cuts(ids, start=0):
    return [x - start for x in cut_points([x for x in marks(ids).tolist() if x > start], start, len(ids))]


def test_chunks_move_with_their_content(monkeypatch):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50_000, 20_000).astype("<u4")
    a, b = cuts(ids), cuts(np.concatenate([ids[5:300], ids]))
    assert a[-1] == len(ids) and max(np.diff([0, *a])) <= 1024 and min(np.diff([0, *a[:-1]])) >= 64
    assert len({x + 295 for x in a} & set(b)) > 0.9 * len(a)
    # The document before changes nothing.
    assert cuts(np.concatenate([rng.integers(0, 9, 77).astype("<u4"), ids]), 77) == a
    monkeypatch.setattr("millrace.llm.token_store.AT_ONCE", 900)
    assert cuts(ids) == a
    assert cuts(np.zeros(5_000, "<u4"))[-1] == 5_000 and cuts(np.array([7], "<u4")) == [1]


def test_crcs_join():
    rng = np.random.default_rng(3)
    for n, m in ((0, 4), (4, 0), (1, 1), (400, 4_096), (12, 100_000)):
        a, b = rng.bytes(n), rng.bytes(m)
        assert crc_join(zlib.crc32(a), zlib.crc32(b), m) == zlib.crc32(a + b)


def test_store_round_trip(spark, texts, tmp_path):
    enc = Encoder(BYTE)
    path = f"file://{tmp_path}/store"
    write_store(documents(spark, texts + texts[:40]), path, BYTE)
    want, start = {}, 0
    for i, t in enumerate(texts + texts[:40]):
        ids = [*enc.library.encode(t or "", add_special_tokens=False).ids, 0]
        want[3 * i] = (start, len(ids), crc(ids), ids)
        start += len(ids)
    got = {r["id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in read_digests(spark, path).collect()}
    assert got == {k: v[:3] for k, v in want.items()}
    assert {r["id"]: r["ids"] for r in read_documents(spark, path).collect()} == {k: v[3] for k, v in want.items()}
    held = spark.read.parquet(f"{path}/raw/part=chunks")
    assert held.count() == held.select("hashes").distinct().count()
    assert [r["id"] for r in recipes(spark, path).orderBy("start").collect()] == sorted(want)
    assert verify_manifest(spark, path).count() == 0


def test_store_notices_damage(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    write_store(documents(spark, ["some words here", "other words there"]), path, BYTE)
    rows = spark.read.parquet(f"{path}/raw/part=chunks").collect()
    bad = [(bytes(r["hashes"]), r["width"], bytes(r["ids"])[:-2] + b"\x09\x00") for r in rows]
    spark.createDataFrame(bad, "hashes binary, width int, ids binary").write.mode("overwrite").parquet(f"{path}/raw/part=chunks")
    with pytest.raises(Exception, match="does not hold what its address says"):
        read_digests(spark, path).collect()


def test_store_of_an_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    write_store(documents(spark, []), path, BYTE)
    assert read_digests(spark, path).count() == 0


def test_merkle_roots_depend_on_order_and_content():
    a, b, c = (address(2, bytes([x, 0])) for x in (1, 2, 3))
    assert len({merkle([a, b, c]), merkle([b, a, c]), merkle([a, b]), merkle([a]), merkle([])}) == 5
