"""Provider archives as a Spark data source: ``spark.read.format("provider_zips")``.

Each member of each archive is an input of its own. Archives' directories (a few bytes per member) are read when
the scan is planned; members are then packed by their inflated size into partitions, so a large archive spreads over many
tasks and every member is inflated once.

A task inflates a member into a spooled file of its own, which also checks its checksum, and only then gives out
rows: a damaged member gives one row with ``error`` and no data. An archive that cannot be opened is one such row. The
first way of ``LADDER`` that reads the whole member is used: plain UTF-8 with quoted fields first; where bytes or quotes do
not fit, the ways that follow. Quoted fields may hold tabs and line breaks, so a row is a *record*: lines are joined while a
quote stands open (a quote opens only at a field's start, as in a default CSV read).

Options: ``path`` (folder or file), ``glob`` (base names, default ``*.zip``), ``areas`` (comma-separated; only files whose name
holds one), ``targetBytes`` (inflated bytes a partition, default 128 MB). Rows: ``path, member, line_no`` (line at
which the record starts), ``line`` (the record as it stands), ``error, header`` (first record of the member), ``quoted``.

The same format reads a stream: each trigger takes the archives whose modification time lies between two offsets. Archives
younger than ``settleSeconds`` (default 2) wait for the next trigger, so that no two files of one instant are parted.
"""

from __future__ import annotations

import fnmatch
import io
import os
import tempfile
import time
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..session import ship_package
from .ingest import _open

FORMAT = "provider_zips"
SCHEMA = "path string, member string, line_no long, line string, error string, header string, quoted boolean"
# Ways to read a member, in this order: (encoding, fields may be quoted). Latin-1 reads any bytes; unlike the analysis'
# own second encoding it leaves backslashes as they stand, which would otherwise turn into tabs and line breaks.
LADDER = (("utf-8-sig", True), ("utf-8-sig", False), ("latin-1", True), ("latin-1", False))
_DAMAGE = (zipfile.BadZipFile, zlib.error, OSError, EOFError, RuntimeError, ValueError, NotImplementedError)
_BATCH = 20_000
_IN_MEMORY = 32 << 20
_THREADS = 16


@dataclass
class Members(InputPartition):
    """What one task reads: ``(path, member, error)``; an archive that cannot be opened has an error and no member."""

    members: tuple[tuple[str, str | None, str | None], ...]


def open_after(line: str, inside: bool, sep: str = "\t") -> bool:
    """Whether a quote stands open at the end of ``line``, given whether one stood open at its start.

    A quote opens at a field's start only; inside, two quotes are one literal quote.
    """
    if not inside and '"' not in line:
        return False
    i = 0
    while True:
        if inside:
            j = line.find('"', i)
            if j < 0:
                return True
            if line[j + 1 : j + 2] == '"':
                i = j + 2
                continue
            inside, i = False, j + 1
        elif line[i : i + 1] == '"':
            inside, i = True, i + 1
            continue
        k = line.find(sep, i)
        if k < 0:
            return False
        i = k + 1


def _lines(raw, encoding: str) -> Iterator[str]:
    raw.seek(0)
    text = io.TextIOWrapper(raw, encoding=encoding, newline=None)
    try:
        yield from text
    finally:
        text.detach()  # the file stays open for the next way


def choose(raw) -> tuple[str, bool]:
    """The first way of ``LADDER`` that reads the whole file: its bytes decode and every quote that opens is closed."""
    for encoding, quoted in LADDER:
        inside = False
        try:
            for line in _lines(raw, encoding):
                if quoted:
                    inside = open_after(line.rstrip("\n"), inside)
        except UnicodeDecodeError:
            continue
        if not inside:
            return encoding, quoted
    return LADDER[-1]


def records(raw) -> Iterator[tuple[int, str, bool]]:
    """``(line at which it starts, record, quoted)`` of every record of a file."""
    encoding, quoted = choose(raw)
    start, held, inside = 1, [], False
    for number, line in enumerate(_lines(raw, encoding), start=1):
        line = line.rstrip("\n")
        if quoted and (inside or '"' in line):
            inside = open_after(line, inside)
        held.append(line)
        if not inside:
            yield start, "\n".join(held), quoted
            start, held = number + 1, []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_member(path: str, member: str) -> Iterator[pa.RecordBatch]:
    """Records of one member, after all of it has been inflated and checked."""
    rows: list[tuple] = []
    with tempfile.SpooledTemporaryFile(max_size=_IN_MEMORY) as raw:
        try:
            with _open(path) as file, zipfile.ZipFile(file) as archive, archive.open(member) as inflated:
                while chunk := inflated.read(1 << 20):
                    raw.write(chunk)
        except _DAMAGE as e:
            yield _batch([(path, member, None, None, f"{type(e).__name__}: {e}", None, None)])
            return
        header = None
        for number, record, quoted in records(raw):
            header = record if header is None else header
            rows.append((path, member, number, record, None, header, quoted))
            if len(rows) >= _BATCH:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)


def read_members(partition: Members | None) -> Iterator[pa.RecordBatch]:
    for path, member, error in partition.members if partition else ():  # without any archive Spark asks for one empty input
        if member is None:
            yield _batch([(path, None, None, None, error, None, None)])
        else:
            yield from read_member(path, member)


def directory(path: str) -> list[tuple[str, str | None, str | None, int]]:
    """``(path, member, error, inflated size)`` of every member of an archive, from its directory alone."""
    try:
        with _open(path) as file, zipfile.ZipFile(file) as archive:
            return [(path, i.filename, None, i.file_size) for i in archive.infolist() if not i.is_dir()]
    except _DAMAGE as e:
        return [(path, None, f"{type(e).__name__}: {e}", 0)]


def packed(members: Iterable[tuple[str, str | None, str | None, int]], target: int) -> list[Members]:
    """Members in partitions of about ``target`` inflated bytes; a larger member is a partition of its own."""
    out, held, size = [], [], 0
    for path, member, error, n in sorted(members, key=lambda m: (-m[3], m[0], m[1] or "")):
        if held and size + n > target:
            out.append(Members(tuple(held)))
            held, size = [], 0
        held.append((path, member, error))
        size += n
    return [*out, Members(tuple(held))] if held else out


def files_under(root: str, glob: str, areas: Sequence[str] = ()) -> list[tuple[str, int]]:
    """``(path, modification time in ns)`` of the archives under a folder, or of the one file, sorted by path."""
    from pyarrow import fs as pafs

    if "://" in root and not root.startswith("file:"):
        store, inner = pafs.FileSystem.from_uri(root)
        front = root[: len(root) - len(inner)] if root.endswith(inner) else root.split("://")[0] + "://"
    else:
        store, inner, front = pafs.LocalFileSystem(), os.path.abspath(root.removeprefix("file:")), ""
    info = store.get_file_info(inner)
    found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(inner, recursive=True))

    def wanted(name: str) -> bool:
        return fnmatch.fnmatch(name, glob) and (not areas or any(a in name or a.lower() in name for a in areas))

    return sorted((front + f.path, f.mtime_ns) for f in found if f.is_file and wanted(f.base_name))


class _Options:
    def __init__(self, options: dict):
        self.root, self.glob = options["path"], options.get("glob", "*.zip")
        self.areas = [a for a in options.get("areas", "").split(",") if a]
        self.target = int(options.get("targetBytes", 128 << 20))
        self.settle = float(options.get("settleSeconds", 2))

    def files(self) -> list[tuple[str, int]]:
        return files_under(self.root, self.glob, self.areas)

    def partitions(self, paths: list[str]) -> list[Members]:
        with ThreadPoolExecutor(_THREADS) as pool:  # a directory is a few bytes, but may be far away
            return packed((m for found in pool.map(directory, paths) for m in found), self.target)


class ZipReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Members]:
        return self.options.partitions([p for p, _ in self.options.files()])

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        return read_members(partition)


class ZipStreamReader(DataSourceStreamReader):
    """Archives by modification time; an offset is the time up to which all archives are taken."""

    def __init__(self, options: _Options):
        self.options = options

    def initialOffset(self) -> dict:
        return {"ns": -1}

    def latestOffset(self) -> dict:
        settled = time.time_ns() - int(self.options.settle * 1e9)
        return {"ns": max([t for _, t in self.options.files() if t <= settled], default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Members]:
        return self.options.partitions([p for p, t in self.options.files() if start["ns"] < t <= end["ns"]])

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        return read_members(partition)


class ProviderZips(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(_Options(self.options))

    def streamReader(self, schema) -> ZipStreamReader:
        return ZipStreamReader(_Options(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to this session; workers get the package."""
    ship_package(spark)
    spark.dataSource.register(ProviderZips)


def _reading(reader, glob: str, areas: Sequence[str] | None, target_bytes: int | None):
    reader = reader.format(FORMAT).option("glob", glob)
    if areas is not None:
        reader = reader.option("areas", ",".join(areas) or "\0")  # no areas: no file's name holds this
    return reader.option("targetBytes", target_bytes) if target_bytes else reader


def land_records(
    spark: SparkSession,
    root: str,
    glob: str = "*.zip",
    areas: Sequence[str] | None = None,
    target_bytes: int | None = None,
) -> DataFrame:
    """Every record of every archive under ``root`` (see the module): one scan, members spread by size."""
    register(spark)
    return _reading(spark.read, glob, areas, target_bytes).load(root)


def land_records_stream(
    spark: SparkSession, root: str, glob: str = "*.zip", areas: Sequence[str] | None = None, settle_seconds: float = 2
) -> DataFrame:
    """As ``land_records``, as a stream of newly landed archives."""
    register(spark)
    return _reading(spark.readStream, glob, areas, None).option("settleSeconds", settle_seconds).load(root)


def whole_archives(records: DataFrame) -> DataFrame:
    """Rows of undamaged archives, and the error rows: of an archive with a damaged member no data row stays.

    ``records`` is read twice; give it a written table (the bronze layer) so that nothing is inflated again.
    """
    damaged = records.where(F.col("error").isNotNull()).select("path").distinct()
    sound = records.where(F.col("error").isNull()).join(damaged, "path", "left_anti")
    return sound.select(*records.columns).unionByName(records.where(F.col("error").isNotNull()))
