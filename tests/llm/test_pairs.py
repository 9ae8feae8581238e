"""Near duplicates and components against brute force, and their edge cases."""

import random
import re

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash
from millrace.llm.components import connected_components
from millrace.llm import embedding_dedup
from millrace.llm.embedding_dedup import codes, embedding_components, list_decode
from millrace.llm.simhash import fingerprint, golay_index, keys, link_blocks, simhash_components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(1)
    path = list(range(100, 160))
    rng.shuffle(path)
    links = list(zip(path, path[1:], strict=False)) + [(1, k) for k in range(2, 50)] + [(70, 70), (71, 72), (72, 71), (71, 72)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if n != 70}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_golay_decodes_to_the_one_codeword_within_three_bits():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 2000)
    index = golay_index(words)
    for _ in range(50):
        bits = rng.choice(23, 3, replace=False)
        moved = words ^ simhash.ERRORS[simhash.SYNDROMES[0][words & 255] ^ simhash.SYNDROMES[1][words >> 8 & 255] ^ simhash.SYNDROMES[2][words >> 16]]
        assert (golay_index(moved ^ sum(1 << int(b) for b in bits)) == index).all()


def test_any_three_bits_leave_a_shared_key():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * 2 + rng.integers(0, 2, 4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    rows_a, keys_a = keys(a)
    rows_b, keys_b = keys(b)
    held = [set() for _ in a]
    for r, k in zip(rows_a.tolist(), keys_a.tolist(), strict=True):
        held[r].add(k)
    shared = set()
    for r, k in zip(rows_b.tolist(), keys_b.tolist(), strict=True):
        if k in held[r]:
            shared.add(r)
    assert len(shared) == len(a)
    assert len(keys_a) / len(a) < 10


def test_fingerprint_is_the_majority_of_shingle_hashes():
    def plain(text):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        w = re.findall("[^\x20\x09-\x0d]+", text)
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    for text in ("", " \t\n", "One", "one Two", "A b c d e É ñ", "x y z " * 50, "q\x0bw\x0ce\rr t"):
        assert fingerprint(text.encode().translate(simhash.LOWER).split(), 3) == plain(text)


def test_blocks_link_all_close_prints(spark):
    """Chunked keys and small batches change no link."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 6)
    prints = np.array([int(b) ^ (1 << int(rng.integers(0, 62))) ^ (1 << int(rng.integers(0, 62))) for b in base for _ in range(40)], np.int64)
    node = rng.permutation(len(prints)).astype(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(prints), np.int64)), pa.array(np.zeros(len(prints), np.int64)), pa.array(node), pa.array(prints)], ["key", "block", "node", "print"])
    out = [b for b in link_blocks(iter([batch.slice(i, 7) for i in range(0, len(prints), 7)]), 3)]
    got = [(a, b) for x in out for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
    want = [(node[i], node[j]) for i in range(len(prints)) for j in range(i) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 3]
    assert roots(node.tolist(), got) == roots(node.tolist(), want)


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, print string, key int")


def test_simhash_against_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for g in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(5):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    docs = [(i, t) for i, t in enumerate(rows)] + [(900, None), (901, ""), (902, " \n"), (903, "short"), (904, "SHORT"), (905, "long word " * 20_000), (None, rows[0]), (3, rows[3])]
    got = simhash_components(documents(spark, docs), block=16).collect()
    prints = {(i, fingerprint((t or "").encode().translate(simhash.LOWER).split(), 3)) for i, t in docs}
    named = sorted((i, p) for i, p in prints if i is not None)
    want = roots([i for i, _ in named], [(a, b) for a, p in named for b, q in named if a < b and (p ^ q).bit_count() <= 3])
    assert len(got) == len(docs)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert {r["fingerprint"] for r in got if r["doc_id"] in (900, 901, 902)} == {"0" * 16}
    assert sum(r["kept"] for r in got if r["doc_id"] not in (None, 3)) < 120


def test_simhash_of_an_empty_table(spark):
    assert simhash_components(documents(spark, [])).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, node int")


def brute(rows, least=0.98):
    ok = [(i, np.array(v, np.float64), k) for i, v, k in rows if k is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links = []
    for x in range(len(ok)):
        for y in range(x):
            (i, a, k), (j, b, m) = ok[x], ok[y]
            if k == m and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                links.append((i, j))
    return links


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    rows, n = [], 0
    for g in range(40):
        centre = rng.normal(size=64)
        centre /= np.linalg.norm(centre)
        for _ in range(12):
            off = rng.normal(size=64)
            off -= off @ centre * centre
            v = centre + off / np.linalg.norm(off) * rng.uniform(0, 0.25)
            rows.append((n, [float(x) for x in (v * rng.uniform(0.1, 9)).astype(np.float32)], g % 3))
            n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 2, rows[0][1], 1), (n + 3, rows[0][1], None)]  # equal vectors
    rows += [(n + 4, None, 0), (n + 5, [0.0] * 64, 0), (n + 6, [float("nan")] + [1.0] * 63, 0), (n + 7, [float("inf")] * 64, 0), (n + 8, [None] + [1.0] * 63, 0)]
    rows += [(n + 9, [1.0, 2.0, 3.0], 0), (n + 10, [2.0, 4.0, 6.0], 0), (n + 11, [], 0), (n + 12, [1e-30] * 64, 2), (n + 13, [3e30] * 64, 2)]
    links = brute(rows)
    degree = {r[0]: 0 for r in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    component = roots(degree, links)
    for block in (2048, 5):
        got = embedding_components(vectors(spark, rows), block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["n_links"], r["component_id"]) == (degree[r["vec_id"]], component[r["vec_id"]]), (block, r)
            assert r["kept"] == (r["vec_id"] == r["component_id"])


def test_embeddings_of_an_empty_table(spark):
    assert embedding_components(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("shape,n", [((2, 128), 20_000), ((2, embedding_dedup.TWO_BLOCKS), 5_000), ((3, 512), 3_000)])
def test_pairs_at_the_threshold_share_a_filter(shape, n):
    """Also at the largest size with two blocks, and with three."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    both = []
    for v in (a, 0.98 * a + np.sqrt(1 - 0.98**2) * z):
        starts, filters = list_decode(v, *shape, 0.98)
        both.append([set(filters[i:j].tolist()) for i, j in zip(starts, starts[1:], strict=False)])
    assert all(x & y for x, y in zip(*both, strict=True))
    share = embedding_dedup.missed(codes(64, *shape, 0.98)[1], 64, 0.98)
    assert share ** len(codes(64, *shape, 0.98)) < 1e-7


@pytest.mark.parametrize("blocks,size", [(2, 64), (3, 16)])
def test_decoding_finds_every_direction_that_reaches_the_threshold(blocks, size):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(400, 20)) * rng.choice([1.0, 9.0], size=(400, 20))  # uneven blocks, too
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    code = embedding_dedup.make_code(20, blocks, size, 0)
    rows, at = code.decode(v)
    scores = code.scores(v)
    every = scores[0]
    for s in scores[1:]:
        every = (every[:, :, None] + s[:, None, :]).reshape(len(v), -1)
    for i in range(len(v)):
        reached = set(np.flatnonzero(every[i] >= code.threshold).tolist())
        want = reached if len(reached) >= embedding_dedup.LIST else set(np.argsort(-every[i])[: embedding_dedup.LIST].tolist())
        assert set(at[rows == i].tolist()) == want


def test_sizes_grow_with_the_rows():
    shapes = [embedding_dedup.code_shape(n) for n in (0, 1, 5_000, 10**6, 1 << 24, (1 << 24) + 1, 10**9, 10**12)]
    assert shapes == [(2, 64), (2, 64), (2, 64), (2, 1024), (2, 4096), (3, 512), (3, 1024), (3, 16384)]


def jaccard(a, b, n=5):
    sets = [{" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set() for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_similar_texts_against_all_pairs(spark):
    rng = random.Random(12)
    texts, group = [], []
    for g in range(60):
        n = rng.choice([60, 200, 600])
        words = [f"w{rng.randrange(4_000)}" for _ in range(n)]
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randrange(1 + n // 60)):
                copy[rng.randrange(n)] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
            group.append(g)
    close = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    docs = [*enumerate(texts), (1_000, None), (1_001, ""), (1_002, "one"), (1_003, "ONE"), (1_004, "two words"), (None, texts[0]), (5, texts[5])]
    for block in (2_048, 3):
        rows = simhash.similar_components(documents(spark, docs), block=block).collect()
        assert len(rows) == len(docs)
        got = {r["doc_id"]: r["component_id"] for r in rows}
        assert sum(got[i] == got[j] for i, j in close) >= 0.98 * len(close)
        assert len({got[i] for i in range(len(texts))}) >= 60 and all(group[got[i]] == group[i] for i in range(len(texts)))
        assert got[1_000] == got[1_001] == 1_000 and got[1_002] == got[1_003] == 1_002 and got[1_004] == 1_004 and got[None] == got[0]
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert simhash.similar_components(documents(spark, [])).count() == 0
