"""A training corpus from ``documents``: toxic texts out, copies out, near copies out, sources mixed, tokens made.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet to the shared folder and rereads it as the next stage's ``docs``, so a
lost executor never costs more than one stage. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyledger.llm import bpe, exact, mixing, near, toxicity
from skyledger.session import ship_package, stored


#: Rows that a Python worker is handed at a time: texts differ in length, and five stages share the executors' memory.
ARROW_ROWS = 1024


def _prepare(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity scorer predicts as toxic. Null and empty texts stay unless texts without any
    feature are mostly toxic; equal texts fare alike; without labels of both kinds, or without documents, all stay."""
    _prepare(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the least doc_id, null last. Null counts as empty; of rows that repeat id
    and text one stays; an empty table stays empty."""
    _prepare(spark)
    return exact.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles and a similarity of 0.8: the least doc_id, null last.
    Null and empty texts are linked with nothing and stay; whole texts count, however long; an empty table stays empty."""
    _prepare(spark)
    return near.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: twice at most, never if it has no words. A null source is a source;
    equal rows count each; an empty table stays empty."""
    _prepare(spark)
    return mixing.repeat_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of each document. A null text is empty; repeated rows repeat;
    an empty table stays empty."""
    _prepare(spark)
    return bpe.encode_documents(docs, ids=True).drop("decoded")


STAGES = [
    ("toxicity", keep_clean),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("bpe", tokenize),
]

#: No SQL: classifier, near links and random rounding have none. Tests compare the near and exact stages with brute force,
#: the others with the rows of their operators, which have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
