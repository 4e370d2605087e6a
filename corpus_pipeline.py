"""From raw documents to packed sequences: language ID, exact dedup, near dedup, packing, each stage on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import exact_dedup, langid, near_dedup, packing
from sievework.llm.common import stored

#: A document whose best language scores less is rejected, as is one without letters.
LEAST_SCORE = 0.05
#: Most rows that go whose numbers (8 bytes each) are broadcast.
MOST_SENT = 2_000_000
#: Bytes of text that go to a Python worker at once. By rows alone a whole partition's text would, and an executor would hold it
#: several times beside its heap.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most about BATCH_BYTES, and a longer text by itself."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language. The classifier learns from a bounded sample of the labelled ones.

    Where no document is labelled there is nothing to judge by, and all stay.
    """
    small_batches(spark)
    others = tuple(c for c in docs.columns if c != "doc_id")
    named = docs.select("doc_id", *(F.col(c).alias(f"doc_{c}") for c in others))
    model = langid.train(docs)
    if not model.languages:
        return docs
    scored = langid.predict(named, model, text="doc_text", keep=tuple(f"doc_{c}" for c in others))
    kept = scored.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select("doc_id", *(F.col(f"doc_{c}").alias(c) for c in others)).select(docs.columns)


def _best_rows(docs: DataFrame, group: Callable[[DataFrame], DataFrame], best: Callable[[Column], Column]) -> DataFrame:
    """The best row of each group. Rows are told apart by a number of their own, so doc_ids may be null or repeated.

    Only the numbers of the rows that go are sent to the text, as long as they are few; more are joined by a shuffle.
    """
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    grouped = stored(group(rows).join(rows.select("__row", "doc_id"), "__row"), "grouped")
    one = best(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row"))["__row"].alias("__best")
    several = grouped.groupBy("__group").agg(one, F.count("*").alias("__n")).filter("__n > 1")
    gone = stored(grouped.join(several, "__group").filter("__row <> __best").select("__row"), "gone")
    few = gone.limit(MOST_SENT + 1).count() <= MOST_SENT
    return rows.join(F.broadcast(gone) if few else gone, "__row", "left_anti").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the largest doc_id; one without doc_id only where none has one."""
    largest = lambda c: F.max(F.struct((~c["no_id"]).alias("has_id"), c["doc_id"].alias("doc_id"), c["__row"].alias("__row")))
    return _best_rows(docs, lambda rows: exact_dedup.group_equal(rows, "__row").select("__row", F.col("keep_id").alias("__group")), largest)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest doc_id; one without doc_id only where none has one."""
    small_batches(spark)
    return _best_rows(docs, lambda rows: near_dedup.group_similar(rows, "__row").select("__row", F.col("component_id").alias("__group")), F.min)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1,024 tokens."""
    small_batches(spark)
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(docs, vocabulary, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: A trained classifier and a dynamic program are beyond SQL; tests/llm/test_pipeline.py tests the decisions of the stages, not run() as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = stored(docs, name)
    return docs
