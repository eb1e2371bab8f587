"""Landing and tolerant parsing of tab-separated provider files.

Stage 1 — ``land_lines``: list the files with the ``binaryFile`` source (paths only; the content
column is never requested, so multi-GB zips are not materialised as one row) and unpack them in
``mapInPandas``: every text line becomes a row ``(path, member, line_no, line, error)``. A file that is
not a readable zip (an HTML error page saved as ``.zip``) becomes one row with ``error`` set instead
of failing the job. Bytes that are not UTF-8 are kept backslash-escaped. Plain (unzipped) text files
go through ``spark.read.text`` with a monotone per-file position instead.

Stage 2 — ``parse_delimited``: split every line on the separator (quotes never span fields or lines:
a field wrapped in ``"…"`` is unwrapped, a stray ``"`` stays literal text), map fields to columns *by the header of the line's own file* (a one-row-
per-file header table joined back by path), turn the pandas default missing-value markers into NULL,
and flag lines with more fields than their header (dropped, and listed by ``ingest_quarantine``).
Short lines are kept with NULL for the missing fields.

Everything after the unzip is built-in Spark expressions; the only Python is the per-file unzip.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import NA_MARKERS
from ..session import ship_package

LINES_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("member", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("line", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("header", T.StringType()),
    ]
)

_BATCH = 50_000
# Names that Hadoop gives to stores, and what pyarrow or the mount calls them.
_SCHEMES = (("s3a://", "s3://"), ("s3n://", "s3://"), ("dbfs:/", "/dbfs/"))


def _open(path: str):
    """Seekable binary handle for a local path or a filesystem URI (``hdfs://``, ``s3://``, …).

    Remote files are opened through ``pyarrow.fs`` (random access, so the zip directory at the end of
    the file is read without downloading the whole file first)."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    for scheme, standard in _SCHEMES:
        if path.startswith(scheme):
            path = standard + path[len(scheme):]
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs as pafs

    filesystem, inner = pafs.FileSystem.from_uri(path)
    return filesystem.open_input_file(inner)


def _unzip_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per-task unzip: yields bounded pandas batches of (path, member, line_no, line, error)."""
    for pdf in batches:
        for path in pdf["path"]:
            rows: list[tuple] = []
            try:
                with _open(path) as fh_zip, zipfile.ZipFile(fh_zip) as zf:
                    # every member is read through to its checksum before its first line goes out: of a
                    # damaged file nothing but the error row may reach the data
                    if (damaged := zf.testzip()) is not None:
                        raise zipfile.BadZipFile(f"bad checksum in {damaged}")
                    for info in zf.infolist():
                        if info.is_dir():
                            continue
                        with zf.open(info) as fh:
                            # utf-8-sig drops a leading byte-order mark, which would otherwise hide the
                            # first header name
                            text = io.TextIOWrapper(fh, encoding="utf-8-sig", errors="backslashreplace", newline=None)
                            header = None
                            for i, line in enumerate(text, start=1):
                                line = line.rstrip("\r\n")
                                if i == 1:
                                    header = line
                                # every row carries its member's header line, so parsing needs no
                                # second pass over the lines (which would unzip every file twice)
                                rows.append((path, info.filename, i, line, None, header))
                                if len(rows) >= _BATCH:
                                    yield pd.DataFrame(rows, columns=LINES_SCHEMA.fieldNames())
                                    rows = []
            except (zipfile.BadZipFile, zlib.error, OSError, EOFError, RuntimeError, ValueError) as e:
                # ValueError: also what pyarrow raises for a store it does not know
                rows.append((path, None, None, None, f"{type(e).__name__}: {e}", None))
            if rows:
                yield pd.DataFrame(rows, columns=LINES_SCHEMA.fieldNames())


def list_files(spark: SparkSession, root: str, glob: str = "*.zip") -> DataFrame:
    """Paths under ``root`` (recursive) whose base name matches ``glob``; file content is not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length")
    )


def land_lines(spark: SparkSession, root: str, glob: str = "*.zip", areas: Sequence[str] | None = None) -> DataFrame:
    """Every text line of every zip member under ``root``, with file path and 1-based line number.

    One zip is unpacked by one task (zips are not splittable); tasks get files packed by size; the lines
    leave the task in bounded batches. With ``areas`` only files whose name holds one of them are opened
    (A3). Land once and persist (``sinks.write_table``) when
    several providers/jobs read the same files.
    """
    # The listing is already partitioned by file size (whole files, packed up to
    # spark.sql.files.maxPartitionBytes per task), which balances the unzip work by bytes; a hash
    # repartition by path could stack several large zips into one task.
    files = list_files(spark, root, glob).select("path")
    if areas is not None:
        files = files.filter(area_from_path("path", areas).isNotNull())
    ship_package(spark)
    return files.mapInPandas(_unzip_batches, LINES_SCHEMA)


def land_text_lines(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """Lines of plain (unzipped) text files: ``line_no`` is a monotone position within each file."""
    df = (
        spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(root)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    )
    return df.select(
        "path",
        F.lit("").alias("member"),
        (F.monotonically_increasing_id() + 1).alias("line_no"),
        "line",
        F.lit(None).cast("string").alias("error"),
    )


def unquote(c: Column) -> Column:
    """A field wrapped in double quotes loses them and ``""`` becomes ``"`` (what a default CSV read does);
    a field with an unbalanced quote stays literal text."""
    wrapped = c.startswith('"') & c.endswith('"') & (F.length(c) >= 2)
    inner = F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.when(wrapped, inner).otherwise(c)


# A field of a quoted record: quotes that open it hold separators and line breaks; possessive, so that long
# fields are matched without backtracking.
_QUOTED_FIELD = r'(?:^|{sep})((?:"[^"]*+(?:""[^"]*+)*+"[^{sep}]*+)|[^{sep}]*+)'


def split_record(record: Column, sep: str) -> Column:
    """Fields of a record in which quoted fields may hold the separator; quotes are taken off as ``unquote`` does,
    text behind a closing quote stays."""
    fields = F.regexp_extract_all(record, F.lit(_QUOTED_FIELD.format(sep=re.escape(sep))), F.lit(1))
    opened = r'^"([^"]*+(?:""[^"]*+)*+)"([\s\S]*)$'

    def bare(f: Column) -> Column:
        inner = F.replace(F.regexp_extract(f, opened, 1), F.lit('""'), F.lit('"'))
        return F.when(f.startswith('"'), F.concat(inner, F.regexp_extract(f, opened, 2))).otherwise(f)

    return F.transform(fields, bare)


def na_to_null(c: Column, markers: Sequence[str] = NA_MARKERS) -> Column:
    """pandas' default missing-value markers (``''``, ``NA``, ``N/A``, ``null``, ``NaN`` …) → NULL."""
    return F.when(c.isin(list(markers)), F.lit(None).cast("string")).otherwise(c)


def file_headers(lines: DataFrame) -> DataFrame:
    """The header line of every (file, member): the line with the smallest line number (one row per file)."""
    return lines.groupBy("path", "member").agg(
        F.min_by(F.col("line"), F.col("line_no")).alias("_hdr_text"), F.min("line_no").alias("_hdr_line")
    )


def parse_delimited(lines: DataFrame, columns: Sequence[str], sep: str = "\t",
                    markers: Sequence[str] = NA_MARKERS) -> DataFrame:
    """Split landed lines into the named text columns using each file's own header line.

    Returns ``path, member, line_no, <columns...>, _n_fields, _n_header`` for data lines (header lines
    and unreadable files excluded). Columns absent from a file's header are NULL. Zip-landed lines carry
    their header, so this is a single pass; plain-text lines get it from a one-row-per-file aggregate
    joined back by path (AQE broadcasts it when the file count is small).
    """
    ok = lines.filter(F.col("error").isNull() & F.col("line").isNotNull())
    pattern = re.escape(sep)
    if "header" in ok.columns:
        # zip landing: every row already carries its member's header (line 1) — one pass, no join
        body = ok.filter(F.col("line_no") > 1).withColumn("_hdr_text", F.col("header")).drop("header")
    else:
        # plain text files: header = each file's first line, found by one aggregate and joined back
        body = ok.join(file_headers(ok), ["path", "member"], "inner").filter(F.col("line_no") > F.col("_hdr_line"))
    # header names: no byte-order mark, no quotes (plain string ops, stays in generated code)
    hdr = F.split(F.regexp_replace(F.regexp_replace(F.col("_hdr_text"), "^\ufeff", ""), '"', ""), pattern, -1)
    fields = F.split(F.col("line"), pattern, -1)
    # records say how their file is quoted; plain lines have each field unwrapped by itself
    quoting = "quoted" in body.columns
    if quoting:
        fields = F.when(F.col("quoted") & F.contains("line", F.lit('"')), split_record(F.col("line"), sep)).otherwise(fields)
    body = body.withColumn("_hdr", hdr).withColumn("_f", fields)
    out = [F.col("path"), F.col("member"), F.col("line_no")]
    for name in columns:
        pos = F.array_position(F.col("_hdr"), F.lit(name))
        val = F.when(pos > 0, F.try_element_at(F.col("_f"), pos.cast("int")))
        out.append(na_to_null(val if quoting else unquote(val), markers).alias(name))
    out += [F.size("_f").alias("_n_fields"), F.size("_hdr").alias("_n_header")]
    return body.select(*out)


def well_formed(parsed: DataFrame) -> DataFrame:
    """Lines with no more fields than their header (over-long lines are dropped, I1)."""
    return parsed.filter(F.col("_n_fields") <= F.col("_n_header")).drop("_n_fields", "_n_header")


def ingest_quarantine(lines: DataFrame, parsed: DataFrame | None = None,
                      numeric: Sequence[str] = ()) -> DataFrame:
    """Rows to report: unreadable files, over-long lines, and non-empty numeric fields that do not parse.

    Columns: ``path, member, line_no, reason``.
    """
    bad_files = lines.filter(F.col("error").isNotNull()).select(
        "path", "member", "line_no", F.col("error").alias("reason")
    )
    if parsed is None:
        return bad_files
    long_lines = parsed.filter(F.col("_n_fields") > F.col("_n_header")).select(
        "path", "member", "line_no", F.lit("too many fields").alias("reason")
    )
    out = bad_files.unionByName(long_lines)
    for c in numeric:
        badnum = parsed.filter(
            (F.col("_n_fields") <= F.col("_n_header")) & F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()
        ).select("path", "member", "line_no", F.concat(F.lit(f"not a number in {c}: "), F.col(c)).alias("reason"))
        out = out.unionByName(badnum)
    return out


def to_double(c: str | Column) -> Column:
    """Text → DOUBLE; unparseable text → NULL, NaN → NULL (Spark orders NaN above all numbers)."""
    v = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def area_from_path(path: str | Column, areas: Sequence[str]) -> Column:
    """The first area whose name (as written, or lower-cased) occurs in the file's base name."""
    base = F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"([^/\\]+)$", 1)
    expr = None
    for a in areas:
        cond = base.contains(a) | base.contains(a.lower())
        expr = F.when(cond, F.lit(a)) if expr is None else expr.when(cond, F.lit(a))
    return expr
