"""From documents to packed sequences, in five stages of the training-data operators.

Each stage takes the session, what its predecessor kept, and the data folder.
All but the last return the columns of ``documents``; the last returns pieces of
sequences with their token ids. ``run`` writes each stage as Parquet in the
shared folder and reads it again, so a lost executor costs one stage at most.

Defined cases are those of the operators: a null text is empty and so has too few
words; a null id is larger than any; of copies, near copies and repeated rows one
stays; an empty table gives an empty result; further columns pass through all but
the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeview.llm import exact, mixing, near, packing, quality
from lodeview.llm._shared import materialize
from lodeview.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' current policy keeps."""
    return quality.keep(docs, policy="v1")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies."""
    return exact.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near.dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mix_sources(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences, with ids."""
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("quality rules", quality_rules), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("source mix", source_mix), ("packing", sequence_packing),
]

# Hash order of k-mers, edit distances and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i}")
    return docs
