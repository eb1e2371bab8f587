"""Lookup tables: contaminant limits (MCL) and unit-conversion factors.

In production they are read from a CSV/Parquet export (``read_mcl`` / ``read_unit_conversion``). The
literal tables below are the synthetic ones used with the driver's test data; they are tiny and fixed,
so joins against them broadcast with a proven size bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MCL_SCHEMA = T.StructType(
    [
        T.StructField("chem_abrv", T.StringType()),
        T.StructField("chem_name", T.StringType()),
        T.StructField("comp_conc_val", T.DoubleType()),
        T.StructField("comp_conc_type", T.StringType()),
        T.StructField("units", T.StringType()),
    ]
)

UNIT_SCHEMA = T.StructType([T.StructField("start_unit", T.StringType()), T.StructField("coef", T.DoubleType())])

# Synthetic limits for the driver's test data (one row per label of the eleven-contaminant set; mixed units).
TEST_MCL_ROWS = [
    ("TCPR123", "1,2,3-Trichloropropane", 25.0, "MCL", "UG/L"),
    ("CD", "Cadmium", 5.0, "MCL", "UG/L"),
    ("PB", "Lead", 15.0, "AL", "UG/L"),
    ("EDB", "Ethylene dibromide", 0.05, "MCL", "MG/L"),
    ("PCE", "Tetrachloroethylene", 5.0, "MCL", "UG/L"),
    ("TCE", "Trichloroethylene", 5.0, "MCL", "UG/L"),
    ("BZ", "Benzene", 1.0, "MCL", "UG/L"),
    ("BZME", "Toluene", 150.0, "MCL", "UG/L"),
    ("EBZ", "Ethylbenzene", 0.3, "MCL", "MG/L"),
    ("XYLENES", "Xylenes", 1.75, "MCL", "MG/L"),
    ("MTBE", "Methyl tert-butyl ether", 13.0, "MCL", "UG/L"),
]

# Unit factors to micrograms per litre.
TEST_UNIT_ROWS = [("UG/L", 1.0), ("MG/L", 1000.0), ("NG/L", 0.001)]


def _literal(v, dtype: T.DataType) -> str:
    if v is None:
        return f"CAST(NULL AS {dtype.simpleString()})"
    if isinstance(dtype, T.StringType):
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"CAST('{v!r}' AS {dtype.simpleString()})"


def local_table(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """A small literal table as an inline ``VALUES`` relation: planned as a JVM ``LocalRelation`` with
    exact size statistics (no Python worker, no RDD scan)."""
    names = schema.fieldNames()
    if not rows:
        return spark.createDataFrame([], schema)
    vals = ", ".join("(" + ", ".join(_literal(v, f.dataType) for v, f in zip(r, schema.fields)) + ")" for r in rows)
    df = spark.sql(f"SELECT * FROM VALUES {vals} AS t({', '.join(names)})")
    return df.select(*[df[n].cast(f.dataType).alias(n) for n, f in zip(names, schema.fields)])


ROW_NO = T.StructField("row_no", T.LongType())


def _numbered(rows, schema: T.StructType) -> tuple[list, T.StructType]:
    """Rows with their place in the table: which of two entries for one key stands first is part of the data."""
    return [(*r, i) for i, r in enumerate(rows)], T.StructType([*schema.fields, ROW_NO])


def mcl_table(spark: SparkSession, rows=None) -> DataFrame:
    return local_table(spark, *_numbered(rows if rows is not None else TEST_MCL_ROWS, MCL_SCHEMA))


def flat_mcl_table(spark: SparkSession, labels, limit: float, units: str = "UG/L") -> DataFrame:
    """One limit for every label (used by the exceedance-only per-well score)."""
    return mcl_table(spark, [(lab, lab, float(limit), "MCL", units) for lab in labels])


def unit_table(spark: SparkSession, rows=None) -> DataFrame:
    return local_table(spark, *_numbered(rows if rows is not None else TEST_UNIT_ROWS, UNIT_SCHEMA))


def read_mcl(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", True).schema(MCL_SCHEMA)
    return r.load(path).select(*MCL_SCHEMA.fieldNames(), F.monotonically_increasing_id().alias("row_no"))


def read_unit_conversion(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", True).schema(UNIT_SCHEMA)
    return r.load(path).select(*UNIT_SCHEMA.fieldNames(), F.monotonically_increasing_id().alias("row_no"))
