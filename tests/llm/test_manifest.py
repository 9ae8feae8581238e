"""Reading notices recipes that were lost or doubled."""

import glob
import os
import shutil

import pytest
from test_tokens import BYTE, documents

from millrace.llm.token_store import read_digests, read_documents, recipes, write_store


@pytest.mark.parametrize("times", [0, 2])
def test_lost_and_doubled_recipes(spark, tmp_path, times):
    path = f"file://{tmp_path}/store"
    write_store(documents(spark, [f"some words {i}" for i in range(6)]), path, BYTE)
    assert read_digests(spark, path).count() == 6
    rows = recipes(spark, path)
    held = [r for r in rows.collect() for _ in range(times if r["id"] == 3 else 1)]
    spark.createDataFrame(held, rows.schema).write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        read_digests(spark, path).collect()


def store(spark, tmp_path, rows=40):
    path = f"{tmp_path}/store"
    write_store(documents(spark, [f"some words {i}" for i in range(rows)]), f"file://{path}", BYTE)
    return path


def test_a_store_without_its_manifest(spark, tmp_path):
    path = store(spark, tmp_path)
    shutil.rmtree(f"{path}/manifest")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_digests(spark, f"file://{path}").collect()


@pytest.mark.parametrize("column,value", [("n", 9_999), ("root", b"x" * 16), ("last", 7), ("ids", 3), ("start", 5)])
def test_an_altered_manifest(spark, tmp_path, column, value):
    path = store(spark, tmp_path)
    held = spark.read.parquet(f"file://{path}/manifest")
    for at in (0, -1):
        rows = [r.asDict() | ({column: value} if r["range"] == at else {}) for r in held.collect()]
        shutil.copytree(path, f"{path}{at}")
        spark.createDataFrame([tuple(r.values()) for r in rows], held.schema).write.mode("overwrite").parquet(f"file://{path}{at}/manifest")
        with pytest.raises(ValueError, match="manifest"):
            read_digests(spark, f"file://{path}{at}").collect()


def test_lost_recipe_files_and_ranges(spark, tmp_path):
    path = store(spark, tmp_path)
    parts = sorted(glob.glob(f"{path}/recipes/part-*"))
    os.remove(parts[-1])
    with pytest.raises(ValueError, match="manifest"):
        read_digests(spark, f"file://{path}").collect()
    # The range gone from the manifest, too.
    left = {r["range"] for r in recipes(spark, f"file://{path}").collect()}
    held = spark.read.parquet(f"file://{path}/manifest")
    rows = [r for r in held.collect() if r["range"] in left | {-1}]
    spark.createDataFrame(rows, held.schema).write.mode("overwrite").parquet(f"file://{path}/manifest")
    with pytest.raises(ValueError, match="manifest"):
        read_digests(spark, f"file://{path}").collect()


def test_an_altered_recipe(spark, tmp_path):
    path = store(spark, tmp_path)
    rows = recipes(spark, f"file://{path}")
    changed = [r.asDict() | ({"hashes": bytes(16)} if r["id"] == 6 else {}) for r in rows.collect()]
    spark.createDataFrame([tuple(r.values()) for r in changed], rows.schema).write.mode("overwrite").parquet(f"file://{path}/recipes")
    with pytest.raises(Exception, match="Merkle root"):
        read_digests(spark, f"file://{path}").collect()


def test_null_and_repeated_ids_are_documents_of_their_own(spark, tmp_path):
    rows = [(None, "a b"), (None, None), (4, "c"), (4, "c"), (4, "d e f")]
    write_store(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/s", BYTE)
    got = read_digests(spark, f"file://{tmp_path}/s").collect()
    assert sorted(str(r["id"]) for r in got) == ["4", "4", "4", "None", "None"] and len({r["start"] for r in got}) == 5
    assert read_documents(spark, f"file://{tmp_path}/s").count() == 5
