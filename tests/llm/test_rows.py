"""Rows with a null id, or an id that others have, are decided one by one."""

import corpus_pipeline
from test_pipeline import FOLDER, corpus


def test_stages_decide_per_row(spark):
    _, en = corpus(spark)
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(None, en[0]), (None, en[1]), (None, en[0]), (7, en[2]), (7, en[3]), (8, en[3]), (None, en[4] + " " + item), (7, en[5] + " " + item)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    stage = dict(corpus_pipeline.STAGES)
    single = [(r["doc_id"], r["text"]) for r in stage["near_duplicates"](spark, docs, FOLDER).collect()]
    assert sorted(single, key=str) == sorted([rows[0], rows[1], *rows[3:5], *rows[6:]], key=str)
    clean = stage["decontamination"](spark, docs, FOLDER)
    assert clean.columns == docs.columns and {r["n"] for r in clean.collect()} == {0, 1, 2, 3, 4, 5}
