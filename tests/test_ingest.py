import datetime as dt
import zipfile

import pytest

from groundwork import operators as op
from groundwork.sources import ingest, providers
from tests.conftest import rows

EDF_HEADER = "\t".join(providers.EDF_SAMPLE_COLS)


def _zip(path, member, text: bytes):
    with zipfile.ZipFile(path, "w") as zf:
        zf.writestr(member, text)


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    d = tmp_path_factory.mktemp("landing")
    lines = [
        EDF_HEADER,
        "T06 01\tMW 1\tBZ\t2.5\t=\t0.5\tUG/L\t2015-03-02",          # D1 id, ISO date
        "T06 01\tMW 1\tBZ\t3.5\t=\t0.5\tUG/L\t3/2/2015",             # US date, same sample → max kept
        "T1\tMW2\tCD\t1.0\t\t0.1\tUG/L\t2015-03-02 00:00:00\textra",  # I1 one field too many
        "T1\tMW3\tCD\t1.0\t=",                                        # I2 short line: kept, NULLs
        'T1\tMW4\t"PB\t1.0\t=\t0.1\tUG/L\t2015-03-02',               # I3 stray quote kept literally
        "T1\tMW5\tPB\tabc\t=\t0.1\tUG/L\t2015-03-02",                 # I6 bad number
        "T1\tNA\tPB\t1.0\t=\t0.1\tUG/L\t2015-03-02",                  # I7 NA point name → NULL wid
        "T1\tMW6\tPB\t1.0\t=\t0.1\tUG/L\t2015-13-02",                 # D4 bad date
    ]
    body = ("\n".join(lines) + "\n").encode() + "T1\tMW7\tTCE\t1.0\t=\t0.1\tUG/L\t2015-03-02\xff\n".encode("latin-1")
    _zip(d / "VenturaEDF.zip", "ventura.txt", body)
    _zip(d / "KernEDF.zip", "kern.txt", (EDF_HEADER + "\nT9\tMW1\tBZ\t1.0\t=\t0.1\tUG/L\t2016-01-01\n").encode())  # I8
    (d / "broken_EDF.zip").write_bytes(b"<html>not found</html>")  # I5
    return str(d)


def test_land_lines(spark, landing):
    lines = ingest.land_lines(spark, landing)
    assert lines.filter("error is not null").count() == 1
    per_file = {r.path.split("/")[-1]: r["max(line_no)"] for r in lines.groupBy("path").max("line_no").collect() if r.path}
    assert per_file["KernEDF.zip"] == 2 and per_file["VenturaEDF.zip"] == 10  # line_no restarts per file
    assert lines.filter(lines.line.contains("\\xff")).count() == 1  # I4 backslash-escaped


def test_parse_and_normalise(spark, landing):
    lines = ingest.land_lines(spark, landing)
    parsed = ingest.parse_delimited(lines, providers.EDF_SAMPLE_COLS)
    s = providers.edf_samples(parsed)
    got = {r.line_no: r for r in s.collect() if r.area == "Ventura"}
    assert got[2].wid == "T0601-MW1" and got[2].logdate == dt.date(2015, 3, 2)
    assert got[3].logdate == dt.date(2015, 3, 2)
    assert 4 not in got  # too many fields
    assert got[5].repdl is None and got[5].units is None  # short line kept
    assert got[6].parlabel == '"PB'
    assert got[7].parval is None
    assert got[8].wid is None
    assert got[9].logdate is None
    clean = op.clean_samples(s)
    # kept: the larger of the two T0601-MW1 benzene values, and the stray-quote row; the others lack a
    # required value (short line: no date; bad number; NA id; bad date; escaped byte in the date)
    assert rows(clean.filter("area = 'Ventura'"), "wid", "parlabel", "parval") == [
        ("T0601-MW1", "BZ", 3.5), ("T1-MW4", '"PB', 1.0)
    ]
    assert clean.filter("area = 'Kern'").count() == 1


def test_quarantine(spark, landing):
    lines = ingest.land_lines(spark, landing)
    parsed = ingest.parse_delimited(lines, providers.EDF_SAMPLE_COLS)
    q = ingest.ingest_quarantine(lines, parsed, numeric=["PARVAL", "REPDL"])
    reasons = sorted(r.reason.split(":")[0] for r in q.collect())
    assert reasons == ["BadZipFile", "not a number in PARVAL", "too many fields"]


def test_manifest_and_missing(spark, landing):
    from groundwork.sources.manifest import missing_sources, source_manifest_for_areas

    areas = spark.createDataFrame([("Ventura",), ("Kern",)], "area string")
    man = source_manifest_for_areas(areas)
    assert man.count() == 2 * 13
    names = {r.file_name for r in man.collect()}
    assert "VenturaEDF.zip" in names and "gama_ddw_kern_v2.zip" in names
    miss = missing_sources(man, ingest.list_files(spark, landing))
    assert miss.filter("file_name in ('VenturaEDF.zip', 'KernEDF.zip')").count() == 0
    assert miss.count() == 24


def test_plain_text_files_and_site_readers(spark, tmp_path):
    d = tmp_path / "sites"
    d.mkdir()
    ust_h = "\t".join(providers.GEO_UST_COLS)
    (d / "permitted_ust.txt").write_text(
        ust_h + "\nF1\tGas Co\t1 Main St\tOxnard\t93030\tVentura\t34.2\t-119.2\nF2\tOil\tNA\tOxnard\t93030\tVentura\tabc\t-119.1\n"
    )
    cl_h = "\t".join(providers.CLEANUP_COLS)
    (d / "sites.txt").write_text(cl_h + "\nT1\tShop\t12\tElm\tOxnard\t93030\tLUST\tOpen\n")
    lines = ingest.land_text_lines(spark, str(d))
    tanks = providers.geotracker_usts(ingest.parse_delimited(lines.filter(lines.path.endswith("/permitted_ust.txt")), providers.GEO_UST_COLS))
    got = {r.Facility_I: r for r in tanks.collect()}
    assert got["F1"].Open_USTs == 1.0 and got["F1"].Latitude == 34.2 and got["F1"].Address == "1 Main St"
    assert got["F2"].Address is None and got["F2"].Latitude is None  # NA marker, bad number
    sites = providers.cleanup_sites(ingest.parse_delimited(lines.filter(lines.path.endswith("/sites.txt")), providers.CLEANUP_COLS))
    r = sites.first()
    assert (r.GLOBAL_ID, r.CASE_TYPE, r.STATUS) == ("T1", "LUST", "Open")
    # the federal tank layer arrives as a table; keep its listed columns, one record per address overall
    epa = spark.createDataFrame([("E1", "1 Main St", "3")], "Facility_I string, Address string, Open_USTs string")
    inv = op.ust_union(tanks, providers.usepa_usts(epa))
    assert {(x.Address, x.Facility_I) for x in inv.collect()} == {("1 Main St", "E1"), (None, "F2")}


def test_bom_and_quoted_fields(spark, tmp_path):
    d = tmp_path / "bom"
    d.mkdir()
    header = "\ufeff" + "\t".join(providers.EDF_SAMPLE_COLS)
    body = 'T1\t"MW 1"\t"BZ"\t2.0\t=\t0.1\t"UG/L"\t2015-03-02\nT1\tMW2\t"say ""hi"""\t1.0\t=\t0.1\tUG/L\t2015-03-02\n'
    _zip(d / "VenturaEDF.zip", "v.txt", (header + "\n" + body).encode("utf-8"))
    parsed = ingest.parse_delimited(ingest.land_lines(spark, str(d)), providers.EDF_SAMPLE_COLS)
    got = sorted((r.wid, r.parlabel, r.units) for r in providers.edf_samples(parsed).collect())
    assert got == [("T1-MW1", "BZ", "UG/L"), ("T1-MW2", 'say "hi"', "UG/L")]
