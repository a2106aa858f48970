"""Corpus pipeline over ``documents``: language, quality, near duplicates,
secrets, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept, which is written as Parquet and read again. All but the last
return the columns of ``documents``:

- language ID drops documents without a language (no letter);
- quality rules drop documents that fail the base rules or lie beyond the fence
  of their language and source;
- near duplicates leave the smallest doc_id of each group;
- secret scans replace every secret in ``text`` and count ``n_chars`` anew;
- best-fit packing returns one row for each piece of a document's tokens with its
  sequence and offset.

A stage on an empty table returns no rows; nulls are as the operators define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpuslens.llm.langid import language_filter
from corpuslens.llm.neardup import deduplicated
from corpuslens.llm.packing import pack_documents
from corpuslens.llm.quality import quality_filter
from corpuslens.llm.secret_scan import redact_documents
from corpuslens.llm.staging import staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_filter(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs, shingle=5, threshold=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, closing=2)
    return pieces.select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language),
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secrets),
    ("packing", packing),
]

#: Models and token ids are beyond SQL: tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
