"""From raw documents to packed sequences: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` writes each stage's result to the shared folder and gives it to the next.

Every stage decides on each row by its own text, whatever its id: rows with a null id, or with an id
that others have too, go or stay one by one, and of near duplicates one row is left (of those with the smallest id, the first). Null and empty texts are
not toxic, have no language (and so go with the language stage) and hold no benchmark passage. An
empty table stays empty; columns besides doc_id and text are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import toxicity
from millrace.llm.common import discard, materialise, settled, table
from millrace.llm.decontaminate import decontaminate
from millrace.llm.langid import UNKNOWN, identify
from millrace.llm.packing import pack_documents
from millrace.llm.queries import language_model, toxicity_model
from millrace.llm.simhash import similar_rows

#: A document goes if no language carries this share of its letters.
LEAST_SHARE = 0.5


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as one column beside its text: operators carry it along, so no join is needed after."""
    return docs.select(F.struct("*").alias("__row"), "text")


def _without(rows: DataFrame, rejected: DataFrame, number: str) -> DataFrame:
    """Rows but those whose number is rejected; numbers are written down, so that the few may be broadcast."""
    return rows.join(materialise(rejected.select(number), "rejected"), number, "left_anti").drop(number)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict toxic."""
    scored = toxicity.score(_rows(docs), toxicity_model(spark, sf_dir), id_col="__row")
    return scored.filter("predicted = 0").select("__row.*")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that carries at least LEAST_SHARE of their letters."""
    found = identify(_rows(docs), language_model(spark, sf_dir), id_col="__row")
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select("__row.*")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of the smallest id of each group that links hold together: those of op6 (SimHash, 3 bits), and five-word shingles alike to 0.8 or more."""
    rows, labels = similar_rows(docs, shingle=5, least=0.8, bits=3)
    return _without(rows, labels.filter("not chosen"), "row").select("payload.*")


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    rows = materialise(docs.withColumn("__number", F.monotonically_increasing_id()), "numbered")
    return _without(rows, decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col="__number").filter("contaminated"), "__number")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

#: No SQL expresses trained models, a tokenizer or packing; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, one after the other."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settled(lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
        if before is not None:
            discard(before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)  # reads pieces that it has written, and docs no more
    discard(docs)
    return out
