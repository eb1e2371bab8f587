"""Registered queries of the text operators: each reads its whole table through its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat,
    decontaminate,
    exact_dedup,
    licenses,
    lm_score,
    merkle,
    mixing,
    near_dedup,
    quality,
    secrets,
    sharding,
    token_align,
    token_files,
)
from .common import read


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    s = quality.score(docs, read(spark, sf_dir, "labels"))
    return s.select(
        "doc_id",
        F.col("quality_held_out").alias("held_out"),
        F.col("quality_score").alias("score"),
        F.col("quality_predicted").alias("predicted"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"), keep="max")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return m.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


def op5_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.shard(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return s.select("doc_id", "shard", "shard_depth", "shard_rows", "shard_bytes", "shard_fits")


def op6_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    d = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    d = d.select("doc_id", decontaminate.contaminating().alias("leaks"), decontaminate.untestable().alias("short"))
    best = F.try_element_at("leaks", F.lit(1))
    return d.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").alias("n_items"),
        best["item_id"].alias("best_item"),
        best["coverage"].alias("best_coverage"),
        best["tiles"].alias("best_tiles"),
        F.array_join(F.transform("leaks", lambda x: x["item_id"].cast("string")), ",", "null").alias("items"),
        F.array_join(F.transform("short", lambda x: x["item_id"].cast("string")), ",", "null").alias("untestable_items"),
        (F.size("leaks") == 0).alias("kept"),
    )


def op7_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85, bands=32, rows=6)


def op8_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(read(spark, sf_dir, "documents"))


def op9_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(read(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["name"])))
    spans = F.transform("notices", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select(
        "doc_id",
        "n_blocks",
        F.size("notices").alias("n_notices"),
        F.array_join(names, ",").alias("licenses"),
        F.array_join(spans, ",").alias("spans"),
        F.coalesce(F.aggregate("notices", F.lit(0), lambda a, x: a + x["saved"]), F.lit(0)).alias("bytes_saved"),
    )


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return chat.preference_rows(turns, chat.swapped_replies(turns))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.scratch_path(spark)
    token_files.write_token_files(read(spark, sf_dir, "documents"), path)
    return token_files.token_table(spark, path)


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merkle.manifest(read(spark, sf_dir, "documents"), checked={"text": merkle.without_newlines()})
    proof = merkle.proof_digest(F.col("path")).alias("proof_sha256")
    return m.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_secret_scan,
        op3_exact_dedup,
        op4_source_mixing,
        op5_extendible_sharding,
        op6_benchmark_tiling,
        op7_minmax_near_dedup,
        op8_lattice_lm,
        op9_license_compression,
        op10_preference_format,
        op11_token_files,
        op12_token_align,
        op13_merkle_manifest,
    )
}
