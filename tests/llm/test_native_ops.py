"""Exact dedup, mixing, sharding and preference formatting against brute force, odd rows included."""

import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from groundwork.llm import chat, exact_dedup, mixing, sharding
from groundwork.llm.oracle import ORACLE
from groundwork.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, ord long, depth int, rows string, doc string, shard string"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "Same Text", "a"), (5, "same text", "a"), (3, "SAME TEXT", None), (3, "same text", None), (7, "Ärger", "b"),
        (8, "ärger", "b"), (9, None, "b"), (10, "", "c"), (None, "same text", "c"), (None, "only null id", None),
        (11, long, "a"), (12, long, "a"), (13, " \t\n ", "b"),
    ]
    rows += [(100 + i, "hot copy", "hot") for i in range(40)]
    return spark.createDataFrame([(*r, 1, 2, "x", "y", "z") for r in rows], SCHEMA)


def lower(t):
    return (t or "").encode().lower().decode()


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(odd, keep):
    got = exact_dedup.exact_dedup(odd, keep=keep).collect()
    source = odd.collect()
    assert len(got) == len(source)
    groups = {}
    for r in source:
        groups.setdefault(hashlib.sha256(lower(r.text).encode()).hexdigest(), []).append(r.doc_id)
    pick = min if keep == "min" else max
    kept = {}
    for r in got:
        g = groups[r.text_sha256]
        ids = [i for i in g if i is not None]
        assert r.group_size == len(g) and r.keep_id == (pick(ids) if ids else None)
        kept.setdefault(r.text_sha256, []).extend([r.doc_id] * r.kept)
    assert all(len(k) == 1 for k in kept.values()) and len(kept) == len(groups)
    assert sorted((r.doc_id or 0) for r in got) == sorted((r.doc_id or 0) for r in source)


def test_exact_dedup_empty(odd):
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


def test_mixing(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and got[0].__fields__[: len(odd.columns)] == odd.columns
    size, taken, target = {}, {}, {}
    for r in got:
        assert r.mix_size == len((r.text or "").encode().split()) and 0 <= r.mix_copies <= 2
        size[r.source] = size.get(r.source, 0) + r.mix_size
        taken[r.source] = taken.get(r.source, 0) + r.mix_size * r.mix_copies
        target[r.source] = r.mix_target
    total = sum(size.values())
    cap = {s: 2 * n for s, n in size.items()}
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), [3, 1, 2] * 3, strict=False))
    want, left, free = {}, 1.5 * total, set(size)
    while free:  # share by weight, stop at twice the size, share the excess again
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > cap[s]}
        if not full:
            want |= {s: weight[s] * level for s in free}
            break
        want |= {s: float(cap[s]) for s in full}
        left -= sum(cap[s] for s in full)
        free -= full
    largest = max(r.mix_size for r in got)
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 2 * largest
    assert sum(taken.values()) <= 1.5 * total
    again = mixing.mix(odd.repartition(5)).collect()
    key = lambda r: (r.doc_id or 0, r.text or "", r.mix_size, r.mix_copies)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixing_nothing(odd):
    assert mixing.mix(odd.limit(0)).count() == 0
    blank = mixing.mix(odd.where("doc_id IN (9, 10)")).collect()
    assert [r.mix_copies for r in blank] == [0, 0]


def test_mixed_rows(odd):
    copies = sum(r.mix_copies for r in mixing.mix(odd).collect())
    out = mixing.mixed_rows(odd)
    assert out.columns == odd.columns and out.count() == copies


def bits(row):
    text = hashlib.md5((row.text or "").encode()).hexdigest()
    return int(hashlib.md5(f"{'' if row.doc_id is None else row.doc_id}:{text}".encode()).hexdigest()[:15], 16)


def brute_shard(rows, limit):
    out = {}

    def split(members, depth):
        size = sum(len((r.text or "").encode()) for r in members)
        if not members:
            return
        if size <= limit or depth == sharding.BITS:
            name = format(bits(members[0]) >> (sharding.BITS - depth), f"0{depth}b") if depth else "all"
            for r in members:
                out.setdefault((r.doc_id, r.text), []).append((name, depth, len(members), size, size <= limit))
            return
        for b in (0, 1):
            split([r for r in members if bits(r) >> (sharding.BITS - depth - 1) & 1 == b], depth + 1)

    split(rows, 0)
    return out


@pytest.mark.parametrize("limit", [10, 40, 500, 1 << 30])
def test_sharding(odd, limit):
    want = brute_shard(odd.collect(), limit)
    got = sharding.shard(odd, limit=limit)
    assert got.columns[: len(odd.columns) - 1] == [c for c in odd.columns if c != "shard"]
    seen = {}
    for r in got.collect():
        seen.setdefault((r.doc_id, r.text), []).append((r.shard, r.shard_depth, r.shard_rows, r.shard_bytes, r.shard_fits))
    assert seen == want


def test_sharding_by_shuffle(odd, monkeypatch):
    monkeypatch.setattr(sharding, "BROADCAST_SHARDS", 0)
    rows = sharding.shard(odd, limit=40).collect()
    want = brute_shard(odd.collect(), 40)
    assert len(rows) == odd.count() and all((r.shard, r.shard_depth) == want[r.doc_id, r.text][0][:2] for r in rows)


def test_sharding_empty(odd):
    assert sharding.shard(odd.limit(0)).count() == 0


def test_preference_rows(spark):
    schema = "conv_id long, turn long, role string, text string, part string"
    chosen = [
        (1, 0, "user", "hi", "x"), (1, 1, "assistant", "good", "x"), (1, 2, "user", "bye", "x"),
        (2, 0, "user", "same", "x"), (2, 1, "assistant", "same", "x"), (2, 1, "assistant", "same", "x"),
        (3, 0, "user", "alone", "x"), (None, 0, "user", "lost", "x"), (4, None, None, None, "x"),
    ]
    rejected = [
        (1, 0, "user", "hi", "x"), (1, 1, "assistant", "bad", "x"), (1, 2, "user", "bye", "x"),
        (2, 0, "user", "same", "x"), (2, 1, "assistant", "same", "x"), (2, 1, "assistant", "same", "x"),
        (4, None, None, None, "x"), (4, 5, "assistant", "more", "x"),
    ]
    df = chat.preference_rows(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema))
    got = {(r.conv_id, r.part, r.turn, r.role, r.rendered.split("\n")[1].removesuffix("<|im_end|>"), r.trained, r.copies) for r in df.collect()}
    assert got == {
        (1, "prompt", 0, "user", "hi", False, 1),
        (1, "chosen", 1, "assistant", "good", True, 1), (1, "chosen", 2, "user", "bye", False, 1),
        (1, "rejected", 1, "assistant", "bad", True, 1), (1, "rejected", 2, "user", "bye", False, 1),
        (2, "prompt", 0, "user", "same", False, 1), (2, "prompt", 1, "assistant", "same", False, 2),
        (3, "chosen", 0, "user", "alone", False, 1),
        (4, "prompt", -1, "user", "", False, 1), (4, "rejected", 5, "assistant", "more", True, 1),
    }
    empty = spark.createDataFrame([], schema)
    assert chat.preference_rows(empty, chat.swapped_replies(empty)).count() == 0


def test_preference_pairs(spark):
    schema = "conv_id long, turn long, role string, text string"
    chosen = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "good"), (1, 2, "user", "bye"), (1, 2, "user", "bye"),
        (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "alone"),
        *[(4, i, "user", f"t{i}") for i in range(12)],
    ]
    rejected = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (2, 0, "user", "same"), (2, 1, "assistant", "same"),
        *[(4, i, "user", f"t{i}") for i in range(12)],
    ]
    rows = chat.preference_rows(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema))

    def turn(role, text):
        return f"<|im_start|>{role}\n{text}<|im_end|>\n"

    got = {r.conv_id: r for r in chat.preference_pairs(rows, max_turns=10).collect()}
    assert set(got) == {1, 2, 3, 4}
    one = got[1]
    assert (one.n_turns, one.whole, one.prompt) == (5, True, turn("user", "hi"))
    assert one.chosen == [turn("assistant", "good"), turn("user", "bye"), turn("user", "bye")] and one.chosen_trained == [True, False, False]
    assert one.rejected == [turn("assistant", "bad")] and one.rejected_trained == [True]
    assert one.prompt_sha256 == hashlib.sha256(one.prompt.encode()).hexdigest()
    assert got[2].prompt == turn("user", "same") + turn("assistant", "same") and got[2].chosen == got[2].rejected == []
    assert got[3].prompt == "" and got[3].chosen == [turn("user", "alone")] and got[3].rejected == []
    assert not got[4].whole and got[4].n_turns == 12 and got[4].prompt is None and got[4].chosen is None
    assert chat.preference_pairs(rows, max_bytes=60).where("whole").select("conv_id").collect() == [(3,)]
    assert chat.preference_pairs(rows.limit(0)).count() == 0


def test_hot_conversation_joins_can_be_split(spark, tmp_path):
    """Three quarters of the turns in one conversation: both joins read partitions that Spark split."""
    path = str(tmp_path / "turns")
    turns = spark.range(60_000).select(
        F.when(F.col("id") % 4 > 0, F.lit(7)).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.sha2(F.col("id").cast("string"), 256).alias("text"),
    )
    turns.repartition(8).write.parquet(path)
    want = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    }
    before = {k: spark.conf.get(k, None) for k in want}
    try:
        for k, v in want.items():
            spark.conf.set(k, v)
        t = spark.read.parquet(path)
        other = t.select("conv_id", "turn", "role", F.concat("text", F.lit("x")).alias("text"))
        for df in (chat.swapped_replies(t), chat.preference_rows(t, other)):
            df.collect()
            assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_swapped_replies_over_gaps(spark):
    ids = [3, 10, 11, 500, 900, 10**12, *range(2000, 4000, 20)]
    rows = [(i, n, role, f"{role} {i}") for i in ids for n, role in enumerate(("user", "assistant")) if (i, role) != (900, "assistant")]
    turns = spark.createDataFrame([*rows, (None, 1, "assistant", "lost")], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.role): r.text for r in chat.swapped_replies(turns).collect()}
    order = sorted(ids)
    reply = {i: f"assistant {j}" if j != 900 else "" for i, j in zip(order, order[1:])} | {order[-1]: ""}
    assert got == {(i, role): reply[i] if role == "assistant" else text for i, _, role, text in rows}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    want = con.execute(ORACLE[name]).fetchall()
    columns = [d[0] for d in con.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(map(tuple, want), key=repr)


def test_rows_without_id_are_parted_by_their_texts(spark):
    rows = [(None if i % 2 else 7, f"{i:02d}" + "x" * 248) for i in range(80)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), limit=500).collect()
    assert all(r.shard_fits and r.shard_bytes <= 500 for r in out) and len({r.shard for r in out}) >= 40
