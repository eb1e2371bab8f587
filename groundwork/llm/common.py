"""Helpers shared by the text operators: reading, word rules, scratch tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.session import ensure_checkpoint_dir, ship_package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the workers, whatever the columns are called."""
    ship_package(df.sparkSession)
    if isinstance(schema, T.StructType) and any("." in c or "`" in c for c in df.columns):  # Spark would resolve these as paths
        plain = {c: f"__column_{i}" if "." in c or "`" in c else c for i, c in enumerate(df.columns)}
        inner = T.StructType([T.StructField(plain.get(f.name, f.name), f.dataType, f.nullable) for f in schema])
        return df.toDF(*plain.values()).mapInArrow(function, inner).toDF(*schema.names)
    return df.mapInArrow(function, schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts (as many bytes as characters) take the byte-wise ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def id_text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder (``spark.checkpoint.dir``) and read it back.

    Every call takes a new folder, so runs do not overwrite each other; the folder is the cluster's
    scratch space and is emptied by whoever owns it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/groundwork-llm/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sifted(df: DataFrame, wanted: DataFrame, col: str, most: int = 1 << 28) -> DataFrame:
    """Rows of ``df`` whose ``col`` may be in the column of that name in ``wanted``, without an exchange of ``df``.

    A bitmap of hashes is broadcast, 16 to 32 bits for a row of ``wanted`` and ``most`` bits (32 MB) at most: no row that is
    wanted is lost, and of the others about one in 20 stays, more beyond 16 million wanted rows. An exact join follows
    where that matters.
    """
    bits, rows = 1 << 15, wanted.count()
    while bits < min(16 * rows, most):
        bits *= 2
    slot = F.pmod(F.xxhash64(col), F.lit(bits)) + 1  # buckets of bitmaps count from 1
    at = F.bitmap_bit_position(slot)
    maps = wanted.groupBy(F.bitmap_bucket_number(slot).alias("__bucket")).agg(F.bitmap_construct_agg(at).alias("__map"))
    byte = F.conv(F.hex(F.substring("__map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = df.withColumn("__bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(maps), "__bucket")
    return near.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("__bucket", "__map")
