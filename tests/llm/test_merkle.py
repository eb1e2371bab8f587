"""Merkle manifest against a plain version and against SQL."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from groundwork.llm import merkle, oracle
from groundwork.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, hash int, n int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    out = []
    for v in row:
        s = None if v is None else str(v)
        out.append("-" if s is None else f"{len(s.encode())}:{s}")
    return h(*out)


def tree(nodes):
    """Top of the nodes, and per node its (left, right) siblings upwards."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = nodes[p - p % 3 : p - p % 3 + 3]
            paths[i].append(("".join(run[: p % 3]), "".join(run[p % 3 + 1 :])))
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        place = [p // 3 for p in place]
    return (nodes or [None])[0], paths


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[s] = tree([leaf(r) for r in by[s]])
    root, above = tree([made[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        for r, low in zip(by[s], made[s][1], strict=True):
            path = low + up
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            copy = (*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4])
            folded = leaf(copy)
            for left, right in path:
                folded = h(left, folded, right)
            out.append((r[0], leaf(r), made[s][0], root, h(*(x for p in path for x in p)), folded, folded == root))
    return out


def manifest(df):
    m = merkle.manifest(df, checked={"text": merkle.without_newlines()})
    return m.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def test_query_against_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    out = QUERIES["op13_merkle_manifest"](spark, SF)
    got = sorted(map(tuple, out.collect()))
    assert out.columns == COLUMNS and got == sorted(brute([tuple(r) for r in docs.collect()]))
    assert {r[-1] for r in got} == {True, False}


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cur = con.execute(oracle.ORACLE["op13_merkle_manifest"])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(COLUMNS)
    want = sorted(tuple(r[names.index(c)] for c in COLUMNS) for r in cur.fetchall())
    assert sorted(map(tuple, QUERIES["op13_merkle_manifest"](spark, SF).collect())) == want


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_odd_rows_and_several_layers(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = [(i, "hot", "en", i, f"text {i}\nline") for i in range(100)]  # more than one layer of blocks
    rows += [(i, f"s{i % 7}", None, None, "é\n\n" * i) for i in range(200, 230)]
    rows += [(None, None, None, None, None), (None, None, "en", 1, "x\n"), (5, "", "de", 0, ""), (5, "", "de", 0, ""), (5, "", "de", 1, "other"), (None, "hot", "en", 0, "z")]
    rows += [(-3, "hot", "en", 9, "w " * 50_000), (2**62, "lone", "en", 1, "\n")]
    df = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], SCHEMA)
    assert Counter(map(tuple, manifest(df).collect())) == Counter(brute(rows))


@pytest.mark.parametrize("n", [0, 1, 3, 4, 10])
def test_few_leaves(spark, n):
    for rows in ([(i, "s", "en", i, f"a\n{i}") for i in range(n)], [(i, f"s{i}", "en", i, f"a\n{i}") for i in range(n)]):
        df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
        assert sorted(map(tuple, manifest(df).collect())) == sorted(brute(rows))


def test_no_leaf_is_joined_with_a_single_task(spark):
    """A source with nearly all rows is rolled up in blocks: no group is larger than a block."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("x").alias("text"))
    leaves = merkle.numbered(rows.select("source", "doc_id", F.lit("00").alias("hash")), ["source", "doc_id"], "source")
    blocks = merkle._rolled(leaves.select(F.lit(0).alias("tree"), "n", "rank", "hash"), [])
    assert blocks.count() == -(-3000 // 3**merkle.LEVELS)
    assert [r["rank"] for r in leaves.orderBy("doc_id").collect()] == list(range(3000))
    assert merkle.manifest(rows).where("verified").count() == 3000
