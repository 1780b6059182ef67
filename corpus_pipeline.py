"""The training-data pipeline: quality rules, exact and near duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of documents, whatever their names, with the values that they had. Texts are read whole. A null text is an empty
one; texts without words leave at the first stage. Of repeated rows one stays from the second stage on; the mix may repeat
rows, which share a doc_id. A null doc_id comes last where the smallest one stays. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritally.llm.bpe import bpe_round_trip
from veritally.llm.common import table, written
from veritally.llm.exact import exact_stage
from veritally.llm.mixing import mix_stage
from veritally.llm.quality import quality_stage
from veritally.llm.simhash import near_stage

#: Words that a worker remembers in the last stage: fewer than alone, as the other stages need memory beside it.
WORDS = 100_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio keep."""
    return quality_stage(docs, table(spark, sf_dir, "labels"), held_out=True)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-equal fingerprints."""
    return near_stage(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mix_stage(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, for each row of the mix."""
    return bpe_round_trip(docs, kept=WORDS)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("simhash near dedup", near_dedup), ("source mix", mix), ("bpe", encode)]

#: SQL can't express merges, links or the likelihood ratio; the tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
