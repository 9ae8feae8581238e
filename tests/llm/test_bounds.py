"""What bounds memory, groups and samples, with ids that repeat or are null, and the guard on tokenizer files."""

import copy
import json
from collections import Counter
from unittest.mock import Mock

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_tokens import BYTE, WORD

from millrace import storage
from millrace.llm import langid, toxicity
from millrace.llm.common import TOGETHER_BYTES, TOGETHER_ROWS, small
from millrace.llm.decontaminate import _bitmap, in_bitmap
from millrace.llm.embedding_dedup import embedding_components
from millrace.llm.packing import pack, pack_documents
from millrace.llm.tokens import Encoder, family


def test_batches_are_small_in_rows_and_bytes():
    texts = ["x" * n for n in [5] * 700 + [TOGETHER_BYTES + 1, TOGETHER_BYTES // 2, TOGETHER_BYTES // 2, 1]] + [None, ""]
    given = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    got = list(small(iter([given, given.slice(0, 0)])))
    assert [t for b in got for t in b.column(1).to_pylist()] == texts
    assert all(b.num_rows <= TOGETHER_ROWS and (b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= TOGETHER_BYTES) for b in got)


def test_pieces_of_one_id_are_dealt_like_others(spark):
    cut = spark.range(2_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (1 + F.col("id") % 60).alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    got = pack(storage.materialise(cut, "pieces"), capacity=100, group=100).collect()
    groups = Counter(r["sequence_id"] >> 32 for r in got)
    assert len(got) == 2_000 and len(groups) == 20 and max(groups.values()) < 200
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 100


def test_packing_of_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None), (3, "x"), (3, "x"), (3, "y " * 9_000)], "doc_id long, text string")
    got = pack_documents(docs, WORD).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == {None: 2, 3: 3} and sum(r["length"] for r in got) == 3 + 1 + 2 + 2 + 9_001


def test_vectors_of_null_and_repeated_ids(spark):
    v, w = [1.0, 0.0, 0.5], [0.0, 1.0, 0.25]
    rows = [(None, v, 1), (5, v, 1), (5, w, 1), (5, w, 1), (None, w, 2), (None, None, 1), (9, [1.0, 0.001, 0.5], 1), (4, None, None)]
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == Counter([(None, 2, 5, False), (5, 2, 5, True), (9, 2, 5, False), (5, 1, 5, True), (5, 1, 5, True), (None, 0, None, True), (None, 0, None, True), (4, 0, 4, True)])


def test_models_of_null_and_repeated_ids(spark):
    texts = ["der hund und die katze", "the dog and the cat"]
    rows = [(i, texts[k % 2] + f" {chr(97 + k % 26)}{k}", ("de", "en")[k % 2], k % 2) for k in range(400) for i in ((None, 7)[k % 3 == 0],)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = langid.train(docs, sample=60)
    assert model.langs == ["de", "en"]
    got = langid.identify(docs, model).collect()
    assert len(got) == 400 and Counter(r["lang_pred"] for r in got) == {"de": 200, "en": 200}
    scored = toxicity.score(docs, toxicity.train(docs, sample=200)).collect()
    assert len(scored) == 400 and sum(r["predicted"] for r in scored) == 200


def test_sessions_keep_their_settings(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    pack_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), WORD).collect()
    assert spark.conf.get(key) == before


def test_bitmaps_hold_their_keys(spark):
    keys = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 500)
    bitmap = _bitmap(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert bitmap.nbytes == 1 << 21 and in_bitmap(bitmap, keys.view(np.uint64)).all()
    assert in_bitmap(bitmap, np.random.default_rng(4).integers(0, 1 << 63, 2_000).astype(np.uint64)).sum() <= 5
    assert not in_bitmap(_bitmap(spark.createDataFrame([], "key long")), keys.view(np.uint64)).any()


CHANGES = [
    ("byte", lambda s: s["pre_tokenizer"].update(add_prefix_space=True)),
    ("byte", lambda s: s["pre_tokenizer"].update(use_regex=False)),
    ("byte", lambda s: s["model"].update(dropout=0.1)),
    ("byte", lambda s: s["model"].update(ignore_merges=True)),
    ("byte", lambda s: s["model"].update(byte_fallback=True)),
    ("byte", lambda s: s.update(normalizer={"type": "NFC"})),
    ("byte", lambda s: s["added_tokens"][0].update(content="word")),
    ("byte", lambda s: s.update(post_processor={"type": "ByteLevel"})),
    ("word", lambda s: s["normalizer"]["normalizers"][1].update(content="_")),
    ("word", lambda s: s["normalizer"]["normalizers"][1].update(pattern={"String": " "})),
    ("word", lambda s: s["normalizer"]["normalizers"].pop()),
    ("word", lambda s: s["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated")),
    ("word", lambda s: s["pre_tokenizer"]["pretokenizers"][1].update(add_prefix_space=True)),
    ("word", lambda s: s["pre_tokenizer"]["pretokenizers"][1].update(use_regex=True)),
]


@pytest.mark.parametrize("kind,change", CHANGES)
def test_files_that_differ_go_to_the_library(kind, change, tmp_path):
    with open(BYTE if kind == "byte" else WORD, encoding="utf-8") as f:
        spec = json.load(f)
    assert family(spec) == kind
    vocabulary = spec["model"].pop("vocab"), spec["model"].pop("merges")
    changed = copy.deepcopy(spec)
    change(changed)
    changed["model"]["vocab"], changed["model"]["merges"] = vocabulary
    assert family(changed) is None


def test_the_files_there_are_cut_here():
    assert Encoder(public_tokenizers.path("byte_bpe_50k.json")).family == "byte" and Encoder(WORD).family == "word"


@pytest.mark.parametrize("text", ["7" * 4_000, "haus", "", "abcdefgh" * 500], ids=["no letter", "one word", "empty", "one long word"])
def test_language_answers_are_bounded_in_rows_and_bytes(monkeypatch, text):
    """Texts of few words, however many rows or bytes, are not held until they have enough words."""
    monkeypatch.setattr(langid, "HELD_ROWS", 3_000, raising=False)
    monkeypatch.setattr(langid, "HELD_BYTES", 4 << 20, raising=False)
    monkeypatch.setattr(langid, "only", lambda docs, columns: docs)
    monkeypatch.setattr(langid, "spread", lambda docs: docs)
    monkeypatch.setattr(langid, "with_fields", lambda *a: None)
    model = langid.Model(["de", "en"], np.zeros((langid.BUCKETS, 2), np.float32), np.ones((2, len(langid.NAMES)), bool))
    docs = Mock()
    docs.sparkSession.sparkContext.broadcast = lambda m: Mock(value=m)
    langid.identify(docs, model)
    label = docs.mapInArrow.call_args.args[0]
    given = (pa.RecordBatch.from_arrays([pa.array(range(a, a + 1_000)), pa.array([text] * 999 + [f"a{'bcdefg'[a // 1_000 % 6]}"])], ["doc_id", "text"]) for a in range(0, 10_000, 1_000))
    got = list(label(given))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(10_000))
    assert all(b.num_rows <= 3_000 + TOGETHER_ROWS and b.num_rows * len(text) <= (4 << 20) + TOGETHER_BYTES for b in got)
    words = [langid.UNKNOWN if not any(map(str.isalpha, text)) else "de"] * 999 + ["de"]
    assert [x for b in got for x in b.column(1).to_pylist()] == words * 10


def test_words_are_learned_in_parts_with_the_same_scores(monkeypatch):
    rng = np.random.default_rng(7)
    model = langid.Model(["de", "en"], rng.normal(-9, 1, (langid.BUCKETS, 2)).astype(np.float32), np.ones((2, len(langid.NAMES)), bool))
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(1, 60, 300)]
    whole, parts = langid.Scorer(model), langid.Scorer(model)
    whole.learn(words)
    monkeypatch.setattr(langid, "LEARN_CHARS", 100)
    parts.learn(words)
    assert parts.at == whole.at and (parts.scores == whole.scores).all() and (parts.letters == whole.letters).all()
    monkeypatch.setattr(langid, "MEMORY_CHARS", 1_000)
    parts.forget()
    assert not parts.at and not parts.chars
