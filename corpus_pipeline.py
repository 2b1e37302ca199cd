"""A corpus from documents to token sequences: clean, deduplicate, decontaminate, pack.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the result is
written and read again in between.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nightdesk.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity
from nightdesk.llm.registry import table
from nightdesk.llm.store import run_folder, written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each set of equal texts stays."""
    return exact_dedup.deduplicate(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.deduplicate(docs, width=5, percent=80)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in benchmark passages go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in their sequences."""
    # The workers have served the other stages before, so their cache of words is kept small.
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=300_000)


STAGES = [
    ("toxicity", toxic_out),
    ("exact_dedup", copies_out),
    ("jaccard_join", near_copies_out),
    ("decontamination", benchmark_out),
    ("packing", packed),
]

#: A fitted score and a tokenizer are no SQL; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), run_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
