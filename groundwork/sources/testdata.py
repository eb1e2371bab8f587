"""Adapter views over the driver's TPC-H-like tables.

The driver only ships ``lineitem orders customer part supplier ...`` Parquet files. Each function maps
them onto one of our logical tables with plain projections (and one join for the samples), so every
library operator runs on data whose size grows with the scale factor. The same definitions are
written independently in SQL in ``groundwork.plans.oracle``.

Mapping (fixed for the tests):

* samples_raw  = lineitem JOIN orders: wid ``'W' || (o_custkey div 2)``; label = CONTS11[l_partkey % 11];
  value = l_quantity; reporting limit = round(l_discount*100); qualifier R→'<', N→'=', A→NULL;
  units = [UG/L, MG/L, NG/L][l_linenumber % 3]; date = o_orderdate; provider by l_linestatus
  (F geotracker rank 0, O gama rank 1); ingest order = (l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_extendedprice) — (l_orderkey, l_linenumber) alone repeats in these tables;
  area = AREAS6[(o_custkey div 2) % 6].
* locations    = customer: wid as above from c_custkey (two rows per well), class MACHINERY→MW,
  BUILDING→MONITORING, else the segment; planar x/y in metres; provider rank c_custkey % 2.
* dtw          = orders: depth = o_totalprice/1000, provider rank o_orderkey % 2.
* blocks       = part: square of half-side p_size*10 m around a pseudo-random centre.
* usts         = supplier (1 tank) ∪ customer (floor(c_acctbal/1000) tanks), addresses shared by neighbouring keys.
* cleanups     = orders; facility and site ids repeat, and some site ids are NULL.
* block groups = notched squares with a hole (concave).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import square_rings
from ..params import AREAS6, CONTS11

UNIT_CYCLE = ["UG/L", "MG/L", "NG/L"]
# Total ingest order of the sample rows (provider, then line position, then the columns that make a line unique).
SAMPLE_ORDER = ("source_rank", "path", "line_no", "line_part", "line_supp", "line_price")
EXTENT_M = 20000
TILE_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None,
          spread: bool = False) -> DataFrame:
    """One test table, pruned to ``columns``.

    The test tables are single Parquet files with one row group, which Spark cannot split: the whole
    first stage (scan, adapter join, projection, partial de-duplication) would run in one task. When a
    table that drives a stage (``spread=True``) scans into fewer partitions than the session's default
    parallelism it is spread round-robin over the cores. Large inputs (many files / row groups) scan
    into many partitions and are untouched, so this never adds a shuffle at scale.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    par = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < par:
        df = df.repartition(par)
    return df


def _pick(values: list[str], idx: Column) -> Column:
    """values[idx] for a 0-based BIGINT index computed from the data."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _wid(key: str) -> Column:
    return F.concat(F.lit("W"), F.expr(f"{key} div 2").cast("string"))


def _coord(key: Column, mult: int, tile: bool = False) -> Column:
    """A pseudo-random place in a square of ``EXTENT_M``; with ``tile`` (one axis) each thousand keys have a
    square of their own, so the density, and pairs per row, stay the same at any scale factor."""
    place = (key * F.lit(mult)) % F.lit(EXTENT_M)
    if tile:
        place = place + F.floor(key / F.lit(TILE_KEYS)) * F.lit(EXTENT_M)
    return place.cast("double")


def samples_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_returnflag", "l_linestatus",
    ], spread=True)
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    k = F.expr("o_custkey div 2")
    return j.select(
        _wid("o_custkey").alias("wid"),
        _pick(CONTS11, F.col("l_partkey") % 11).alias("parlabel"),
        F.col("l_quantity").alias("parval"),
        F.when(F.col("l_returnflag") == "R", "<").when(F.col("l_returnflag") == "N", "=").alias("parvq"),
        F.round(F.col("l_discount") * 100).alias("repdl"),
        _pick(UNIT_CYCLE, F.col("l_linenumber") % 3).alias("units"),
        F.col("o_orderdate").cast("date").alias("logdate"),
        F.when(F.col("l_linestatus") == "F", "geotracker").otherwise("gama").alias("source"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("source_rank"),
        F.lit("lineitem").alias("path"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"),
        F.col("l_partkey").alias("line_part"),
        F.col("l_suppkey").alias("line_supp"),
        F.col("l_extendedprice").alias("line_price"),
        _pick(AREAS6, k % 6).alias("area"),
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    k = F.expr("c_custkey div 2")
    return c.select(
        _wid("c_custkey").alias("wid"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "MW")
        .when(F.col("c_mktsegment") == "BUILDING", "MONITORING")
        .otherwise(F.col("c_mktsegment"))
        .alias("field_pt_class"),
        (F.lit(32.5) + (k % 1000).cast("double") * F.lit(0.002)).alias("latitude"),
        (F.lit(-119.5) + ((k * 7) % 1000).cast("double") * F.lit(0.003)).alias("longitude"),
        _coord(k, 104729, tile=True).alias("x_m"),
        _coord(k, 32452843).alias("y_m"),
        (F.col("c_custkey") % 2).cast("int").alias("source_rank"),
        F.lit("customer").alias("path"),
        F.col("c_custkey").alias("line_no"),
    )


def dtw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"], spread=True)
    return o.select(
        _wid("o_custkey").alias("wid"),
        F.col("o_orderdate").cast("date").alias("logdate"),
        (F.col("o_totalprice") / 1000).alias("dtw"),
        F.when(F.col("o_orderkey") % 2 == 0, "geotracker").otherwise("gama").alias("source"),
        (F.col("o_orderkey") % 2).cast("int").alias("source_rank"),
        F.lit("orders").alias("path"),
        F.col("o_orderkey").alias("line_no"),
    )


def block_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return p.select(
        F.col("p_partkey").cast("string").alias("geoid"),
        _coord(F.col("p_partkey"), 7919, tile=True).alias("x_m"),
        _coord(F.col("p_partkey"), 15485863).alias("y_m"),
        (F.col("p_size") * 10).cast("double").alias("half_m"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as polygons (closed square rings in metres)."""
    b = block_points(spark, sf_dir)
    return b.select("geoid", square_rings("x_m", "y_m", "half_m").alias("rings"))


def notched_rings(cx: Column, cy: Column, h: Column) -> Column:
    """A square without its upper right quarter (concave), with a square hole in the lower left quarter."""

    def ring(*pts):
        return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in (*pts, pts[0])])

    q = h / 4
    hx, hy = cx - h / 2, cy - h / 2
    outer = ring((cx - h, cy - h), (cx + h, cy - h), (cx + h, cy), (cx, cy), (cx, cy + h), (cx - h, cy + h))
    return F.array(outer, ring((hx - q, hy - q), (hx + q, hy - q), (hx + q, hy + q), (hx - q, hy + q)))


def landed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of landed files: of each customer's area the lab results, of every third one the locations too."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.expr("c_custkey div 2")
    area = _pick(AREAS6, k % 3)
    kind = F.when(F.col("c_custkey") % 3 == 0, "GeoXY.zip").otherwise("EDF.zip")
    return c.select(F.concat(F.lit("landing/"), area, kind).alias("path"))


def blockgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block groups: the block squares plus water-table depth and disadvantaged-community flag (one scan)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    x = _coord(F.col("p_partkey"), 7919, tile=True)
    y = _coord(F.col("p_partkey"), 15485863)
    h = (F.col("p_size") * 10).cast("double")
    return p.select(
        F.col("p_partkey").cast("string").alias("geoid"),
        notched_rings(x, y, h).alias("rings"),
        (F.col("p_retailprice") % 10).alias("water_table_depth_m"),
        ((F.substring_index(F.col("p_brand"), "#", -1).cast("int") % 2) == 0).alias("is_dac"),
    )


def usts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Underground storage tanks from two providers, already in the common column names."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    geo = s.select(
        F.concat(F.lit("S"), (F.col("s_suppkey") % 7).cast("string")).alias("Facility_I"),
        F.col("s_name").alias("Name"),
        F.concat(F.lit("A"), F.expr("s_suppkey div 2").cast("string")).alias("Address"),
        F.lit(1.0).alias("Open_USTs"),
        _coord(F.col("s_suppkey"), 6007, tile=True).alias("x_m"),
        _coord(F.col("s_suppkey"), 9973).alias("y_m"),
        F.lit(0).alias("source_rank"),
        F.col("s_suppkey").alias("line_no"),
    )
    epa = c.select(
        F.concat(F.lit("C"), (F.col("c_custkey") % 100).cast("string")).alias("Facility_I"),
        F.col("c_name").alias("Name"),
        F.concat(F.lit("A"), F.expr("c_custkey div 3").cast("string")).alias("Address"),
        F.floor(F.col("c_acctbal") / 1000).cast("double").alias("Open_USTs"),
        _coord(F.col("c_custkey"), 6007, tile=True).alias("x_m"),
        _coord(F.col("c_custkey"), 7789).alias("y_m"),
        F.lit(1).alias("source_rank"),
        F.col("c_custkey").alias("line_no"),
    )
    return geo.unionByName(epa)


def cleanups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus"])
    return o.select(
        F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("T"), (F.col("o_orderkey") % 300).cast("string"))).alias("GLOBAL_ID"),
        F.col("o_orderpriority").alias("BUSINESS_NAME"),
        F.col("o_orderstatus").alias("STATUS"),
        _coord(F.col("o_orderkey"), 3001, tile=True).alias("x_m"),
        _coord(F.col("o_orderkey"), 4999).alias("y_m"),
    )
