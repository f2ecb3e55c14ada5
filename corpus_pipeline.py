"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

1. language: documents whose language cannot be told (no text, or no letter in it) go,
2. exact dedup: one document of each text stays,
3. MinHash near-dedup: one document of each near-duplicate component stays (five-word shingles, similarity 0.8),
4. mixing: documents as often as the target weights of their sources ask for,
5. packing: where every token of every document lies in the packed sequences.

All stages but the last return the columns of `documents`. Packing and language identification have no SQL form, so there is no
oracle; `tests/llm/test_pipeline.py` compares the stages with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewscope.llm import exact_dedup, language, minhash, mixing, packing
from reviewscope.llm.queries import held_out, table, tokenizer_text
from reviewscope.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.identified(docs, language.fit(docs.filter(~held_out(F.col("doc_id"), 4, 2))))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_text())


STAGES: list[tuple[str, Stage]] = [
    ("language", tell_language),
    ("exact_dedup", drop_copies),
    ("minhash_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
