"""A corpus from raw documents to packed training sequences, in stages that each read what the last one wrote.

Cases, for all stages: null and empty texts are kept and packed as documents without words; rows that share a doc_id are
judged by their own texts, except that a doc_id counts as one document for near copies; rows without a doc_id
are scored, cut, redacted and packed like all others and never dropped as copies; repeated rows stay; an empty table
gives no rows; other columns, whatever their names, are kept up to the last stage.

Whole texts go to Python in batches of BATCH_ROWS rows at most: Spark's 10,000 rows are 20 MB and more of text, which a
task holds several times over, outside the heap and in its worker. The stages lower the session's setting for that.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from newsdesk.llm.decontaminate import remove_spans
from newsdesk.llm.minhash import drop_near_duplicates
from newsdesk.llm.packing import pack_documents
from newsdesk.llm.pii import redact
from newsdesk.llm.tables import read, stored
from newsdesk.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
BATCH_ROWS, BATCH_SETTING = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(stage: Stage) -> Stage:
    """The stage with batches of BATCH_ROWS rows at most. Frames run after the stage has returned, so the setting stays."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows = int(spark.conf.get(BATCH_SETTING))
        if not 0 < rows <= BATCH_ROWS:
            spark.conf.set(BATCH_SETTING, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; without labels nothing does."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


@in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return drop_near_duplicates(docs, width=5, percent=80)


@in_small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that consist of them for the most part go."""
    return remove_spans(docs, read(spark, sf_dir, "benchmark"))


@in_small_batches
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by the name of their kind."""
    return redact(docs)


@in_small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of sequences of at most 2048 tokens; a null text is a document with the end token alone.

    Workers live on from stage to stage, so their word caches are kept small."""
    return pack_documents(docs, cached_words=100_000)


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", packing),
]

#: The learnt and the tokenising stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
