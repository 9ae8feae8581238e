"""The stages on a small corpus with known cases."""

import random

import corpus_pipeline
from test_pairs import jaccard, roots

from millrace.llm import queries
from millrace.llm.simhash import fingerprint

FOLDER = "/root/testdata/sf0.001"


def corpus(spark):
    rng = random.Random(1)
    en = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").filter("lang = 'en' and n_chars > 800").orderBy("doc_id").limit(12).collect()]
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first()["text"]
    leak = en[3] + " " + item
    rows = [(100 + i, t) for i, t in enumerate(en)] + [(1, en[5]), (200, leak), (201, leak + " " + leak), (300, None), (301, ""), (302, "123 !!"), (None, en[7]), (400, en[8]), (400, en[8])]
    rng.shuffle(rows)
    return spark.createDataFrame([(i, t, "en", "s", 5, True) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, predicted boolean"), en


def test_stages(spark):
    docs, en = corpus(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "near_duplicates", "decontamination", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    known = stage["language"](spark, docs, FOLDER)
    assert known.columns == docs.columns
    left = {r["doc_id"] for r in known.collect()}
    assert not left & {300, 301, 302} and 100 in left and None in left
    single = stage["near_duplicates"](spark, known, FOLDER)
    rows = [r["doc_id"] for r in single.collect()]
    assert single.columns == docs.columns and len(rows) == len(set(rows))
    assert 1 in rows and 105 not in rows and 108 in rows and 400 not in rows and None not in rows
    clean = stage["decontamination"](spark, single, FOLDER)
    kept = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == docs.columns and not kept & {200, 201}
    assert stage["toxicity"](spark, docs, FOLDER).columns == docs.columns
    packed = stage["packing"](spark, clean, FOLDER)
    assert {r["doc_id"] for r in packed.collect()} == kept


def test_stages_of_an_empty_table(spark):
    docs, _ = corpus(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_run_and_queries_on_a_small_table(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 50
    for name, query in queries.queries().items():
        assert query(spark, FOLDER).count() > 0, name


def test_near_duplicates_are_those_of_fingerprints_and_of_sets(spark):
    """Components of all pairs whose fingerprints differ in 3 bits at most or whose sets are alike to 0.8; some link by one of these only."""
    rng, texts = random.Random(41), []
    for g in range(12):
        line, body, tail, end = ([f"{x}{rng.randrange(10**6)}" for _ in range(n)] for x, n in (("l", 40), ("b", 300), ("t", 30), ("e", 8)))
        texts += [line * 60 + tail, line * 60 + tail[:10] + end * 2, line * 60 + tail[:10] + end]  # the middle one bridges
        texts += [body, body[:270], body[:250] + tail]
    texts = [" ".join(t) for t in texts] + ["", "...", None, None]
    prints = [fingerprint((t or "").encode().split(), 3) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    by_print = {p for p in pairs if (prints[p[0]] ^ prints[p[1]]).bit_count() <= 3}
    by_set = {(i, j) for i, j in pairs if jaccard(texts[i] or "", texts[j] or "") >= 0.8 or not (texts[i] or texts[j])}
    assert len(by_print - by_set) >= 10 and len(by_set - by_print) >= 10
    docs = spark.createDataFrame([(i, t, "en", "s", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [r["doc_id"] for r in corpus_pipeline.remove_near_duplicates(spark, docs, FOLDER).collect()]
    assert sorted(kept) == sorted(set(roots(range(len(texts)), by_print | by_set).values()))
