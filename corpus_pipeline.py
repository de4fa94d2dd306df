"""A training corpus from `documents`: language, exact copies, near copies, source mix, packing.

Every stage takes (spark, docs, sf_dir), docs being its predecessor's rows, and returns a
DataFrame that is written as Parquet and read again for the next one. All but the last
return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from docloom.llm.exact_dedup import without_exact_copies
from docloom.llm.language import fit, of_a_language
from docloom.llm.lineage import staged
from docloom.llm.mixing import mixed_documents
from docloom.llm.near_dedup import without_near_copies
from docloom.llm.packing import pack
from pyspark.sql import DataFrame, SparkSession


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of no language: null ones and those without a letter. Learns from the labelled rows of docs."""
    return of_a_language(docs, fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the one with the largest id stays."""
    return without_exact_copies(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts (five-word shingles, similarity 0.8 or more) the one with the smallest id stays."""
    return without_near_copies(docs, threshold=0.8)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their target weights: rows repeated, cut or left out as the mix takes them."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("source_mix", source_mix),
    ("packing", packed),
]

#: Tokenising, sketches and packing can't be expressed in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
