"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table


def _joined(links: DataFrame, minima: DataFrame) -> DataFrame:
    apart = F.xxhash64("u")
    return links.withColumn("apart", apart).join(minima.withColumn("apart", apart), ["u", "apart"]).drop("apart")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node in ``links`` (``a, b``).

    Nodes are of any type that has an order. Each step joins the links with one minimum per node; a node with very many
    links is a skewed join key, which Spark splits, since the join has one more key (made from the node) than the
    aggregate and so an exchange of its own on both sides. The link table is rewritten in the shared folder each round, so lineage
    stays short. Rounds go on until a round leaves the links as they are (a star per component).
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = shared_table(e, "links")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _joined(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _joined(large, low)
        e = shared_table(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "links",
        )
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
