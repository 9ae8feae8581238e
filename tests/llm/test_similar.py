"""Near duplicates of the pipeline: every pair of the given similarity, and no other, whatever the edit."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_pairs import documents, jaccard, roots

from millrace.llm import simhash


def check(spark, texts, **options):
    """Components are those of all pairs at 0.8 or more."""
    docs = list(enumerate(texts))
    close = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(documents(spark, docs), **options).collect()}
    assert got == roots(range(len(texts)), close)
    return close


def fresh(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_short_texts(spark):
    """One word less of 9, 10, 20 and 30."""
    rng, texts = random.Random(21), []
    for n, m in ((9, 8), (10, 9), (20, 17), (30, 25), (7, 6), (5, 4)):
        for _ in range(30):
            words = fresh(rng, n)
            texts += [" ".join(words), " ".join(words[:m])]
    assert len(check(spark, texts)) == 120


@pytest.mark.parametrize("kind", ["cut", "appended", "replaced"])
def test_passage_edits(spark, kind):
    """One passage gone, added or replaced, at similarities of 0.8 to 0.9."""
    rng, texts = random.Random(22), []
    for least in (0.8, 0.83, 0.86, 0.9):
        for _ in range(40):
            words = fresh(rng, 300)
            d = next(d for d in range(150, 0, -1) if jaccard(" ".join(words), " ".join(edited(rng, words, kind, d))) >= least)
            texts += [" ".join(words), " ".join(edited(rng, words, kind, d))]
    assert len(check(spark, texts)) == 160


def edited(rng, words, kind, d):
    if kind == "cut":
        return words[:-d]
    return words + fresh(rng, d) if kind == "appended" else [*words[:100], *fresh(rng, d), *words[100 + d :]]


def test_a_line_that_one_copy_repeats(spark):
    """The sets of shingles are nearly equal, however often one text repeats a line."""
    rng, texts = random.Random(23), []
    for times in (10, 20, 50, 200):
        for _ in range(20):
            body, line = fresh(rng, 300), fresh(rng, 7)
            texts += [" ".join(line + body), " ".join(line * times + body)]
    assert len(check(spark, texts)) == 80


def test_pairs_below_are_not_linked(spark):
    """Scattered edits and cut texts at 0.6 to just below 0.8, and some above."""
    rng, texts = random.Random(24), []
    for _ in range(60):
        words = fresh(rng, 300)
        copy = list(words)
        for at in rng.sample(range(300), rng.randrange(6, 16)):
            copy[at] = f"z{rng.randrange(10**6)}"
        texts += [" ".join(words), " ".join(copy), " ".join(words[: rng.randrange(180, 250)])]
    pairs = [jaccard(texts[i], texts[j]) for k in range(0, len(texts), 3) for i, j in ((k, k + 1), (k, k + 2))]
    assert sum(0.6 <= x < 0.8 for x in pairs) > 60
    check(spark, texts)


def test_keys_more_frequent_than_the_sample_said(spark, monkeypatch):
    """A passage that many texts share, no key of which is known to be frequent: its rows are counted and dealt out."""
    monkeypatch.setattr(simhash, "frequent_shingles", lambda given, shingle: (np.empty(0, np.uint64), np.empty(0, np.int64)))
    monkeypatch.setattr(simhash, "TOGETHER", 16)
    rng = random.Random(31)
    shared = " ".join(f"s{i}" for i in range(40))
    rows, twin = [], {}
    for i in range(240):
        own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
        rows.append((i, f"{shared} {own}"))
        if i % 12 == 0:
            twin[1_000 + i] = i
            rows.append((1_000 + i, f"{shared} {own} more"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), block=3).collect()}
    assert got == {i: twin.get(i, i) for i, _ in rows}


def test_blocks_too_large_come_in_parts():
    sizes = [3, 1, 50, 2, 30, 1]
    key = np.repeat(np.arange(len(sizes)), sizes)
    t = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(len(key), np.int64)), pa.array(np.arange(len(key)))], ["key", "block", "n"])
    got = list(simhash.bounded_blocks(iter([t.slice(i, 7) for i in range(0, len(key), 7)]), 12))
    assert [n for b, _ in got for n in b.column(2).to_pylist()] == list(range(len(key)))
    assert {k for b, over in got for k in b.column(0).to_pylist() if over} == {2, 4} and all(b.num_rows <= 19 for b, _ in got)
    for b, over in got:
        assert over or all(k not in (2, 4) for k in b.column(0).to_pylist())


def test_blocks_that_are_together_are_left():
    """Of 2,000 near copies in one block each is asked for once, not once for every lag."""
    n, lags = 2_000, []
    key = np.zeros(n, np.int64)

    def near(i, j):
        lags.append(len(i))
        return np.ones(len(i), bool)

    got = simhash.spanning_links(key, key, np.arange(n), near)
    assert len(lags) <= 2 and sum(lags) == n - 1 and set(got.column(1).to_pylist()) == {0}


@pytest.mark.parametrize("most", [dict(LEADERS=16), dict(LEADERS=1, STANDS=1), dict(HELD_BYTES=2_000)])
def test_components_of_many_near_copies(spark, monkeypatch, most):
    """Components are those of all pairs where one has more rows or bytes than a block."""
    for name, value in (dict(CHAIN=8) | most).items():
        monkeypatch.setattr(simhash, name, value)
    rng, texts = random.Random(41), []
    base = fresh(rng, 120)
    for i in range(90):
        words = list(base)
        for at in rng.sample(range(120), (1, 1, 1, 4, 9)[i % 5]):
            words[at] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(fresh(rng, 60)) for _ in range(20)]
    check(spark, texts, block=10)


def test_rows_with_a_partner_are_found_by_sorting():
    """As pair by pair, for random sizes and places."""
    rng, share = np.random.default_rng(42), 0.8 / 1.8
    for _ in range(300):
        n = int(rng.integers(1, 60))
        size = rng.integers(1, int(rng.integers(2, 200)), n)
        left = size - (rng.random(n) * 0.3 * size).astype(np.int64)
        near = np.minimum.outer(left, left) >= share * np.add.outer(size, size) - 1e-6
        np.fill_diagonal(near, False)
        assert (simhash.has_partner(size, left, share) == near.any(axis=1)).all()
