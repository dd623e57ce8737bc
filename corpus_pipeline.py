"""A training corpus from ``documents``: language, near-duplicates, test items, mixing, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyrine.llm import decontamination, language_id, mixing, near_dedup, token_blocks
from papyrine.llm.queries import END_ID, table, tokenizer_path
from papyrine.llm.scratch import new_path, release
from papyrine.shipping import ship


def _begin(spark: SparkSession) -> None:
    """What the stage before has left in the shared folder isn't read again: its result is written by now."""
    release(ship(spark))


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return language_id.identified_documents(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return near_dedup.distinct_documents(docs, shingle=5, num=80, den=100)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return mixing.mixed_documents(docs)


def as_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return token_blocks.digests(token_blocks.token_files(docs, tokenizer_path(), END_ID))


STAGES = [
    ("language_id", with_language),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_test_items),
    ("mixing", mixed),
    ("token_output", as_token_files),
]

#: Learned language filters, alignments and token files are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result on documents; what lies between is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    paths = []
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        paths.append(new_path(spark, f"stage-{name}", kept=True))
        out.write.parquet(paths[-1])
        docs = spark.read.schema(out.schema).parquet(paths[-1])
    return STAGES[-1][1](spark, docs, sf_dir)

