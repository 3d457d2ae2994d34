"""The corpus pipeline: language ID, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import save
from tesserae.llm.decontaminate import decontaminate
from tesserae.llm.langid import fit, held_out, keep_known
from tesserae.llm.neardup import deduplicate
from tesserae.llm.packing import pack_documents

#: A text whose language is less sure than this is rejected, like one that is null or has no letter.
MIN_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose text is in a language that was learned; learns from docs but for those held out (crc32 of the id mod 3 is 1).

    Texts that are null, empty or without a letter go, as do all if no row has a language.  Null ids and repeated rows are
    treated each by its text; no rows give no rows.
    """
    return keep_known(docs, fit(docs.where(~held_out(docs))), MIN_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id: five-word shingles with a similarity of 0.8 or more.

    Texts without words, nulls among them, are copies of each other.  A null id stays only where its group has no other; rows
    that repeat an id but have unrelated texts all stay; no rows give no rows.
    """
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs in which no window of a benchmark item occurs: with a coverage limit of zero, contaminated ones go whole and all others stay as they are.

    Null and empty texts have no words and stay; null ids and repeated rows are treated each by its text; an empty benchmark
    takes nothing; no rows give no rows.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, max_span=10, max_coverage=0.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs and their places in sequences of 2048 tokens.

    A null or empty text is a document of its end alone; null ids and repeated rows are packed like any others; no rows give no rows.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), size=2048, end_id=0)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Models, hashes and packing are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, save(docs, STAGES[k - 1][0]) if k else docs, sf_dir)
    return docs
