"""A corpus run over ``documents``: each stage calls one text operator on all that the stage before kept.

Stages: quality classifier (rejected documents go), near-dedup (one of each group stays), benchmark
decontamination (documents that contain a benchmark item go), source mixing (each document as often as
the mixture takes it), sharding (every row with its shard). Every stage's result is written as Parquet
in the shared folder and read again, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm import decontaminate, mixing, near_dedup, quality, sharding
from groundwork.llm.common import read, shared_table, text_or_empty


USED = ("doc_id", "text", "source")  # columns that the operators read


def _apart(docs: DataFrame) -> DataFrame:
    """``docs`` with all other columns under names that no operator uses."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in USED else f"__column_{i}") for i, c in enumerate(docs.columns)])


def _as(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, under their own names."""
    return out.select(*[F.col(c if c in USED else f"__column_{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of the training fold, does not reject."""
    scored = quality.score(_apart(docs), read(spark, sf_dir, "labels"))
    return _as(scored.where("quality_predicted = 1"), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the smallest id.

    Rows are judged one by one, so a text that nothing resembles stays whatever else has its id: what goes is named by id and
    hash of the text. Rows that repeat the kept id and resemble each other all stay. Rows without an id stay.
    """
    groups = near_dedup.near_duplicates(docs, k=5, percent=80, bands=32, rows=5, text_key=True)
    gone = groups.where("NOT kept").select("doc_id", "text_hash").distinct()
    text_hash = F.sha2(text_or_empty("text").cast("binary"), 256)
    return _as(_apart(docs).withColumn("text_hash", text_hash).join(gone, ["doc_id", "text_hash"], "left_anti"), docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover no benchmark item of five words or more to the threshold."""
    checked = decontaminate.decontaminate(_apart(docs), read(spark, sf_dir, "benchmark"))
    return _as(checked.where(F.size(decontaminate.contaminating()) == 0), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: every document as many times as it is taken (at most twice)."""
    return _as(mixing.mixed_rows(_apart(docs)), docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their shard (columns of the shard's names are replaced)."""
    return sharding.shard(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

ORACLE_SQL = None  # SQL cannot express the classifier, the near-duplicate components or the tiling


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
