"""Provider archives as a data source: members, quoting, encodings, damage, streams."""

import io
import os
import struct
import zipfile

import pytest

from groundwork.sources import ingest, providers, zips
from tests.conftest import rows

HEADER = "\t".join(providers.EDF_SAMPLE_COLS)


def _zip(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for name, text in members:
            zf.writestr(name, text if isinstance(text, bytes) else text.encode())


def _damage(path, member):
    """Flip a byte of a member's data, so that its checksum fails."""
    with zipfile.ZipFile(path) as zf:
        at = zf.getinfo(member).header_offset
    raw = bytearray(path.read_bytes())
    name, extra = struct.unpack("<HH", raw[at + 26 : at + 30])
    raw[at + 30 + name + extra + 12] ^= 0xFF
    path.write_bytes(raw)


def _body(k, n=40):
    return HEADER + "\n" + "".join(f"T{k}\tMW{i}\tBZ\t{i}.5\t=\t0.1\tUG/L\t2015-03-02\n" for i in range(n))


def test_same_rows_as_land_lines(spark, tmp_path):
    _zip(tmp_path / "VenturaEDF.zip", [("a.txt", _body(1)), ("b.txt", "﻿" + _body(2).replace("\n", "\r\n"))])
    (tmp_path / "deep").mkdir()
    _zip(tmp_path / "deep" / "KernEDF.zip", [("k.txt", _body(3, 3))])
    (tmp_path / "broken_EDF.zip").write_bytes(b"<html>not found</html>")
    old = ingest.land_lines(spark, str(tmp_path)).withColumnRenamed("path", "p")
    new = zips.land_records(spark, str(tmp_path)).withColumnRenamed("path", "p")
    strip = lambda df: sorted((r.p.split("/")[-1], r.member, r.line_no, r.line, r.header) for r in df.where("error is null").collect())
    assert strip(new) == strip(old)
    (bad,) = new.where("error is not null").collect()
    assert bad.p.endswith("broken_EDF.zip") and bad.error.startswith("BadZipFile") and bad.line is None
    only = zips.land_records(spark, str(tmp_path), areas=["Kern"])
    assert {r.path.split("/")[-1] for r in only.select("path").distinct().collect()} == {"KernEDF.zip"}
    assert zips.land_records(spark, str(tmp_path), areas=[]).count() == 0


def test_one_archive_of_many_members_uses_many_tasks(spark, tmp_path):
    _zip(tmp_path / "VenturaEDF.zip", [(f"m{i}.txt", _body(i)) for i in range(12)])
    size = len(_body(0))
    df = zips.land_records(spark, str(tmp_path), target_bytes=2 * size)
    assert df.rdd.getNumPartitions() >= 6
    assert df.count() == 12 * 41
    assert zips.land_records(spark, str(tmp_path)).rdd.getNumPartitions() == 1  # small ones are packed


def test_damaged_member_gives_no_data(spark, tmp_path):
    _zip(tmp_path / "VenturaEDF.zip", [("a.txt", _body(1)), ("b.txt", _body(2, 400))])
    _zip(tmp_path / "KernEDF.zip", [("k.txt", _body(3, 3))])
    _damage(tmp_path / "VenturaEDF.zip", "b.txt")
    df = zips.land_records(spark, str(tmp_path))
    bad = df.where("error is not null").collect()
    assert [r.member for r in bad] == ["b.txt"] and df.where("member = 'b.txt' and line is not null").count() == 0
    assert df.where("member = 'a.txt'").count() == 41
    whole = zips.whole_archives(df)
    assert {r.member for r in whole.where("error is null").select("member").distinct().collect()} == {"k.txt"}
    assert whole.where("error is not null").count() == 1


def test_quoted_records_latin1_and_unbalanced_quotes(spark, tmp_path):
    quoted = HEADER + '\nT1\t"MW\t1"\t"B\nZ"\t2.0\t=\t0.1\t"UG ""x"" /L"\t2015-03-02\nT1\tMW2\tBZ\t1.0\t=\t0.1\tUG/L\t2015-03-03\n'
    latin = (HEADER + '\nT2\t"Pozo ñ"\tBZ\t1.0\t=\t0.1\tUG/L\t2015-03-02\n').encode("latin-1")
    loose = HEADER + '\nT3\t"MW2"\tPB\t1.0\t=\t0.1\tUG/L\t2015-03-02\nT3\tMW1\t"PB\t1.0\t=\t0.1\tUG/L\t2015-03-02\n'
    inner = HEADER + '\nT4\tMW 5" pipe\tPB\t1.0\t=\t0.1\tUG/L\t2015-03-02\n'
    escape = (HEADER + "\nT5\tMW\\x\tPB\t1.0\t=\t0.1\tUG/L\t2015-03-02\xff\n").encode("latin-1")
    _zip(tmp_path / "VenturaEDF.zip", [("q.txt", quoted), ("l.txt", latin), ("u.txt", loose), ("i.txt", inner), ("e.txt", escape)])
    df = zips.land_records(spark, str(tmp_path))
    parsed = ingest.parse_delimited(df, providers.EDF_SAMPLE_COLS)
    assert parsed.where("_n_fields <> _n_header").count() == 0
    got = {(r.member, r.line_no): r for r in parsed.collect()}
    q = got["q.txt", 2]
    assert (q.FIELD_PT_NAME, q.PARLABEL, q.UNITS, q.LOGDATE) == ("MW\t1", "B\nZ", 'UG "x" /L', "2015-03-02")
    assert got["q.txt", 4].FIELD_PT_NAME == "MW2"  # line numbers are those of the file
    assert got["l.txt", 2].FIELD_PT_NAME == "Pozo ñ"
    assert [got["u.txt", n].PARLABEL for n in (2, 3)] == ["PB", '"PB']
    assert got["u.txt", 2].FIELD_PT_NAME == '"MW2"'  # a file with an open quote is read without quoting
    assert got["i.txt", 2].FIELD_PT_NAME == 'MW 5" pipe'
    assert got["e.txt", 2].FIELD_PT_NAME == "MW\\x" and got["e.txt", 2].LOGDATE == "2015-03-02ÿ"
    assert rows(df.where("quoted = false").select("member").distinct()) == [("u.txt",)]


@pytest.mark.parametrize("text, quoted, want", [
    ("", True, []),
    ('a\t"b\nc"\td\ne\n', True, [(1, 'a\t"b\nc"\td'), (3, "e")]),
    ('a\t"b""\n""c"\n', True, [(1, 'a\t"b""\n""c"')]),
    ('a"b\t"\n', False, [(1, 'a"b\t"')]),
    ('"a"b\t"c"\n"d\n', False, [(1, '"a"b\t"c"'), (2, '"d')]),
    ("a\n\nb", True, [(1, "a"), (2, ""), (3, "b")]),
])
def test_records(text, quoted, want):
    got = list(zips.records(io.BytesIO(text.encode())))
    assert [(n, r) for n, r, _ in got] == want and all(q == quoted for *_, q in got)


def test_long_quoted_field_parses(spark, tmp_path):
    long = '"' + 'x""y ' * 60_000 + '"'
    _zip(tmp_path / "VenturaEDF.zip", [("q.txt", HEADER + f"\nT1\t{long}\tBZ\t2.0\t=\t0.1\tUG/L\t2015-03-02\n")])
    (r,) = ingest.parse_delimited(zips.land_records(spark, str(tmp_path)), providers.EDF_SAMPLE_COLS).collect()
    assert r.FIELD_PT_NAME == 'x"y ' * 60_000 and r.LOGDATE == "2015-03-02"


def test_stream_takes_each_archive_once(spark, tmp_path):
    land, out, state = tmp_path / "land", str(tmp_path / "out"), str(tmp_path / "state")
    land.mkdir()
    _zip(land / "VenturaEDF.zip", [("a.txt", _body(1, 5))])

    def run():
        df = zips.land_records_stream(spark, str(land), settle_seconds=0)
        df.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination(120)
        return spark.read.schema(zips.SCHEMA).parquet(out).count()

    assert run() == 6
    assert run() == 6
    _zip(land / "KernEDF.zip", [("k.txt", _body(2, 3)), ("l.txt", _body(3, 1))])
    os.utime(land / "KernEDF.zip")
    assert run() == 6 + 4 + 2
