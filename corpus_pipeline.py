"""Training data from raw documents: toxic texts, copies, benchmark passages and personal data go, then sources are mixed."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from answerloom.llm import curriculum, decontaminate, pii, toxicity  # noqa: E402
from answerloom.llm.common import saved, table  # noqa: E402
from answerloom.llm.oddsketch import survivors  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the field of op4 does not call toxic; the labels are read for training only."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (similarity 0.8 or more): the one with the smallest id."""
    return survivors(docs, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data masked; n_chars follows the new text."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, by the position of their first word: their columns, words taken, and the times of their rounds. An
    input column with the name of an added one gives way to it."""
    added = ["size", "taken", "position", "epochs"]
    own = [c for c in docs.columns if c not in added]
    held = docs.select("doc_id", "source", "text", F.struct(*own).alias("_held_row"))
    rows = curriculum.schedule(held, keep=("_held_row",)).where("taken > 0").select(*(F.col("_held_row")[c].alias(c) for c in own), *added)
    return curriculum.in_order(rows)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("benchmark_decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("source_mix", mixed),
]

#: The stages hold trained models and sketches: SQL cannot express them, so tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all rows that the one before kept, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
