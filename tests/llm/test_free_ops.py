"""Quality, secrets, decontamination, near-dedup, LM scores and licenses against brute force."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwork.llm import common, decontaminate, graph, hashing, licenses, lm_score, mixing, near_dedup, quality, secrets, sharding
from groundwork.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, row string, leaks string, id string, quality_score string"
LONG = " ".join(f"w{i % 977}" for i in range(40_000))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", "x", "y", "z", "q") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, [(1, None), (2, ""), (3, " \t\n"), (None, "some text here"), (4, LONG), (5, "twice"), (5, "twice"), (6, "É ß ñ")])


# quality


def test_neighbour_sums():
    texts = [np.array([1, 2, 3, 2]), np.array([7]), np.array([2, 2, 9])]
    total = quality.NeighbourSums()
    total.add(texts[:1])
    total.add(texts[1:])
    index = quality.index_vectors(quality.DIM, 41).astype(int)
    want = np.zeros((quality.BUCKETS, quality.DIM), int)
    for t in texts:
        for i, j in itertools.permutations(range(len(t)), 2):
            if abs(i - j) <= quality.WINDOW:
                want[t[i]] += index[t[j]]
    met, sums = total.rows()
    assert met.tolist() == [1, 2, 3, 7, 9] and (sums == want[met]).all()


def test_whole_shapes_count():
    a, b = b"a-" * 20 + b"1", b"a-" * 20 + b"B"
    assert quality.shape(a) != quality.shape(b) and len(quality.shape(a)) == len(a)


def test_quality_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op1_quality_classifier"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(got[r.doc_id], r.quality) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert np.mean([r.predicted == q for r, q in held]) > 0.93


def test_temperature_is_the_best_one_and_finite():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 4, 4000)
    for scale in (0.02, 0.5, 3.0, 40.0):  # labels drawn at a known temperature, far beyond any grid, too
        y = (rng.random(4000) < 1 / (1 + np.exp(-np.clip(z / scale, -60, 60)))).astype(int)
        assert scale < 0.1 or abs(np.log(quality.temperature(z, y) / scale)) < 0.35
    y = (z > 0).astype(int)  # parted without an error
    assert 0 < quality.temperature(z, y) < 0.25
    assert quality.temperature(np.zeros(4), np.array([0, 1, 0, 1])) == 1.0 == quality.temperature(z, 1 - y)


def test_labelled_id_of_many_rows_lends_one_row(spark, monkeypatch):
    rows = [(1, f"plain words number {i}") for i in range(300)] + [(i, f"other text {i}") for i in (4, 5, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 4, 5, 7, 8)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)))
    quality.train(docs, labels)
    folds = [i for i in (1, 4, 5, 7, 8) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert seen == [len(folds)] and len({i % 2 for i in folds}) == 2


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    out = quality.score(odd, labels)
    rows = out.collect()
    assert len(rows) == odd.count() and out.columns[:-3] == [c for c in odd.columns if c != "quality_score"]
    assert all(0 <= r.quality_score <= 1 for r in rows)
    assert [r.quality_score for r in quality.score(odd, labels.limit(0)).collect()] == [1.0] * len(rows)
    assert quality.score(odd.limit(0), labels).count() == 0


# secrets


def brute_spans(text):
    out = []
    for k, r in enumerate((*secrets.BASE, *secrets.ADDED)):
        for m in re.finditer(r.pattern, text, re.ASCII):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), k, f"{r.kind}:{m.start()}:{m.end()}"))
    return sorted(out)


def test_trigram_queries():
    q = secrets.trigram_query(secrets.BASE[0].pattern)
    assert {b"pas", b"tok", b"sec"} <= secrets.trigrams(q)
    assert secrets.trigrams(secrets.trigram_query(r"AKIA[A-Z0-9]+")) == {b"aki", b"kia"}
    for p in (r"[0-9a-f]+", r"(abc)?x*", r"(abc|[a-z]+)", r".*"):
        assert secrets.trigram_query(p) is True


def test_secrets(spark, odd):
    rng = random.Random(3)
    bits = ["Password = 'abc123XY'", "token:short", "API_KEY: a.b/c+d=e-f", "apikey=123456", "AKIA" + "Z9" * 8, "AKIA" + "Z9" * 7, "0123456789abcdef" * 2,
            "é ü", "ſecret=abcdefgh", "passwd =\n", "xoxb-1234567890-abc", "ghp_" + "a1" * 18, "Authorization: Bearer abcdefghijklmnop.q", "\n", "secret:token=abcdefgh"]
    rows = [(100 + i, " ".join(rng.choices(bits, k=rng.randint(0, 12)))) for i in range(200)]
    df = table(spark, rows).unionByName(odd)
    got = secrets.find_secrets(df).collect()
    want = Counter()
    for r in df.collect():
        s = brute_spans(r.text or "")
        base = ",".join(t for _, k, t in s if k < 3)
        want[r.doc_id, *(sum(x[1] == k for x in s) for k in range(3)), hashlib.sha256(base.encode()).hexdigest(), ",".join(t for *_, t in s)] += 1
    assert Counter(tuple(r) for r in got) == want
    assert secrets.find_secrets(odd.limit(0)).count() == 0


# decontamination


def brute_coverage(doc, item, least):
    """Greedy string tiling as defined: longest unmarked common run first."""
    least = min(least, len(item))
    md, mi, covered = [False] * len(doc), [False] * len(item), 0
    while item:
        best = (least - 1, 0, 0)
        for q in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while q + n < len(item) and p + n < len(doc) and doc[p + n] == item[q + n] and not md[p + n] and not mi[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < least:
            break
        md[p : p + n] = [True] * n
        mi[q : q + n] = [True] * n
        covered += n
    return covered / len(item) if item else 0.0


def test_tiling_against_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        item = [rng.choice("abcdef") for _ in range(rng.randint(1, 30))]
        doc = [rng.choice("abcdefg") for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(len(item))
            doc[rng.randint(0, len(doc)) : 0] = item[a : a + rng.randint(1, 12)]
        want = brute_coverage(doc, item, 3)
        found = decontaminate.hits(" ".join(doc), decontaminate.Index([(1, " ".join(item))], 3), 0.01)
        assert (found[0]["coverage"] if found else 0.0) == pytest.approx(want)


def test_decontaminate(spark, odd, monkeypatch):
    words = [f"q{i}" for i in range(40)]
    items = [(1, " ".join(words)), (2, "Tiny item"), (3, None), (4, ""), (None, "some text here"), (5, " ".join(words))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    reordered = " ".join(["pad"] * 50 + words[20:] + ["x", "y"] + words[:20])
    docs = table(spark, [(20, reordered), (21, " ".join(words[:20])), (22, "a tiny, ITEM!"), (23, " ".join(words[::-1]))]).unionByName(odd)
    for size in (8 << 20, 100):  # one block, several blocks
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        out = decontaminate.decontaminate(docs, bench)
        assert out.columns == [c for c in docs.columns if c != "leaks"] + ["leaks"]
        got = {r.doc_id: [(h.item_id, h.coverage) for h in r.leaks] for r in out.collect()}
        assert got.pop(20) == [(1, 1.0), (5, 1.0)] and got.pop(22) == [(2, 1.0)]
        assert not any(got.values()) and out.count() == docs.count()
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("size(leaks) > 0").count() == 0


def test_shared_preamble_is_not_listed_for_every_item():
    rng = random.Random(6)
    preamble = [f"p{i}" for i in range(12)]
    items = [(i, " ".join(preamble + [f"i{rng.randrange(10**6)}" for _ in range(48)])) for i in range(10_000)]
    index = decontaminate.Index(items, decontaminate.LEAST)
    doc = " ".join((preamble + ["x"]) * 50)
    start = time.process_time()
    assert decontaminate.hits(doc, index, decontaminate.COVERAGE) == []
    assert time.process_time() - start < 0.5  # 0.05 s on an idle machine; listing every pair took minutes
    found = decontaminate.hits(doc + " " + items[77][1], index, decontaminate.COVERAGE)
    assert [(h["item_id"], h["coverage"]) for h in found] == [(77, 1.0)]


def test_rolling_runs():
    ids = np.random.default_rng(1).integers(0, 1 << 40, 200).astype(np.uint64)
    for width in (1, 5, 200, 201):
        want = [sum(int(x) * pow(decontaminate._BASE, width - 1 - j, 1 << 64) for j, x in enumerate(ids[i : i + width])) % (1 << 64) for i in range(len(ids) - width + 1)]
        assert decontaminate.rolling(ids, width).tolist() == want


def test_text_ids_and_column_names(spark, tmp_path):
    words = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([("mmlu-1", words), (None, words)], "item_id string, text string")
    docs = spark.createDataFrame([(1, words, "a", 2), (2, "clean", "b", 3)], "doc_id long, text string, Leaks string, `a.b` int")
    out = decontaminate.decontaminate(docs, bench)
    assert out.columns == ["doc_id", "text", "a.b", "leaks"]
    assert [[h.item_id for h in r.leaks] for r in out.orderBy("doc_id").collect()] == [["mmlu-1", None], []]


@pytest.mark.parametrize("name", ["Shard", "MIX_SIZE", "Quality_Score", "a.b", "Leaks", "row"])
def test_any_column_name(spark, name):
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, words, "s", "x"), (2, "two words", "t", "y")], f"doc_id long, text string, source string, `{name}` string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    kept = lambda added: 0 if name.lower() in added else 1
    for out, added in (
        (sharding.shard(docs), ["shard", "shard_depth", "shard_rows", "shard_bytes", "shard_fits"]),
        (mixing.mix(docs), ["mix_size", "mix_source_size", "mix_target", "mix_copies"]),
        (quality.score(docs, labels), ["quality_score", "quality_held_out", "quality_predicted"]),
    ):
        assert len(out.columns) == 3 + kept(added) + len(added) and out.count() == 2
    assert mixing.mixed_rows(docs.drop("mix_size")).count() > 0


def test_items_without_id_are_matched(spark, tmp_path):
    nameless, named = " ".join(f"n{i}" for i in range(12)), " ".join(f"q{i}" for i in range(9))
    spark.createDataFrame([(None, nameless), (7, named), (None, "too short"), (None, None)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    texts = [(1, f"before {nameless} after"), (2, f"{nameless} and {named}"), (3, f"it is too short, {nameless[:14]}"), (4, None)]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op6_benchmark_tiling"](spark, str(tmp_path)).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4)] == [False, False, True, True]
    assert [(got[i].n_items, got[i].best_item, got[i].items) for i in (1, 2, 3)] == [(1, None, "null"), (2, 7, "7,null"), (0, None, "")]


def test_short_items_do_not_contaminate(spark, tmp_path):
    items = [(1, "Paris"), (2, "it is so true"), (3, "five words are just enough")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [(1, "a walk in Paris: it is so true"), (2, "five words are just enough in Paris"), (3, "clean")]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op6_benchmark_tiling"](spark, str(tmp_path)).collect()}
    want = {1: (False, "", "1,2"), 2: (True, "3", "1"), 3: (False, "", "")}
    assert {i: (r.contaminated, r.items, r.untestable_items) for i, r in got.items()} == want
    import corpus_pipeline

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.doc_id for r in corpus_pipeline.decontaminate_stage(spark, docs, str(tmp_path)).collect()) == [1, 3]


def test_benchmark_passages_found(spark):
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i for i, t in docs.items() if any(b in t for b in bench)}
    got = {r.doc_id for r in QUERIES["op6_benchmark_tiling"](spark, SF).where("contaminated").collect()}
    assert want and want <= got


# near duplicates


def brute_components(rows, k, percent):
    """Component of each (id, text); rows with one id are nodes of their own."""
    rows = sorted(set(rows), key=lambda r: (r[0], r[1] or ""))
    sets, parent = [], list(range(len(rows)))
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    return {r: rows[root(i)][0] for i, r in enumerate(rows)}


@pytest.mark.parametrize(("k", "percent", "rows"), [(3, 85, 6), (5, 80, 5)])
def test_near_duplicates(spark, odd, monkeypatch, k, percent, rows):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # several blocks in one bucket
    rng = random.Random(11)
    made = []
    for g in range(6):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(120)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = f"edit{rng.random()}"
            made.append((1000 + len(made), " ".join(copy)))
    rng.shuffle(made)
    made += [(50, "Two words"), (51, "two WORDS"), (52, "two words more"), (5000, made[0][1].upper()), (5001, made[1][1])]
    # ids with several texts: one that nothing resembles, one in another group, one that another id repeats
    made += [(5000, "a text of its own that nothing here resembles"), (5000, made[40][1]), (900, made[2][1]), (900, "word by word " + made[60][1]), (901, made[60][1])]
    docs = table(spark, made).unionByName(odd)
    out = near_dedup.near_duplicates(docs, k=k, percent=percent, bands=32, rows=rows, text_key=True)
    texts = docs.selectExpr("doc_id AS i", "text", "sha2(coalesce(text, ''), 256) AS h").distinct()
    got = out.join(texts, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h"))).where("doc_id IS NOT NULL OR text IS NOT NULL").collect()
    assert len(got) == docs.count() and {r.kept for r in got if r.doc_id == 5000} == {True, False}
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_components([x for x in plain if x[0] is not None], k, percent)
    for r in got:
        assert r.component_id == (want[r.doc_id, r.text] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    sizes = {r.doc_id: r.n_shingles for r in got}
    assert sizes[1] == sizes[2] == sizes[3] == 0 and sizes[50] == 1
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_sifted_loses_no_wanted_row(spark):
    df = spark.createDataFrame([(i if i % 50 else None, f"t{i}") for i in range(-4000, 4000)] + [(7, "again")], "id long, text string")
    for ids in ([], [7], list(range(-4000, 4000, 3)), [2**62, 5, 5]):
        wanted = spark.createDataFrame([(i,) for i in ids], "id long")
        for most in (1 << 28, 1 << 15):
            out = common.sifted(df, wanted, "id", most)
            got, exact = {tuple(r) for r in out.collect()}, {tuple(r) for r in df.collect() if r.id in set(ids)}
            assert out.columns == df.columns and exact <= got and len(got) <= len(exact) + 800


def test_near_duplicates_exchange_no_texts(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join([*words[i : i + 60], f"x{i // 2}"])) for i in range(40)] + [(900, "quite alone here")], "doc_id long, text string")
    plans, write = {}, near_dedup.shared_table

    def noted(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(near_dedup, "shared_table", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more rows than are broadcast
    try:
        near_dedup.near_duplicates(docs, k=3, percent=85, bands=32, rows=6).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.findall(r"hashpartitioning\(id#\d+L?, \d+\)", plans["sets"])  # texts would meet the candidates by id alone
    assert len(re.findall(r"Exchange hashpartitioning\(id#\d+L?, key#\d+L?, ", plans["sets"])) == 2  # sets and candidates


def test_near_duplicate_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_components(docs, 3, 85)
    assert {r.doc_id: r.component_id for r in QUERIES["op7_minmax_near_dedup"](spark, SF).collect()} == {i: c for (i, _), c in want.items()}


def test_block_links_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(40)]
    links = near_dedup.block_links(list(range(40)), sets, 60, 100)
    want = brute_components_of([set(s.tolist()) for s in sets], 60)
    parent = list(range(40))
    for a, b in links:
        ra, rb = sorted((parent[a], parent[b]))
        parent = [ra if p == rb else p for p in parent]
    assert parent == want


def brute_components_of(sets, percent):
    parent = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            ra, rb = sorted((parent[a], parent[b]))
            parent = [ra if p == rb else p for p in parent]
    return parent


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == parent


def test_words_and_windows():
    assert hashing.split_words("A\x0bÉ\x1cb c  D".encode()) == [b"a", "É\x1cb c".encode(), b"d"]
    h = hashing.word_hashes([b"a", b"b", b"a", b"b", b"a"])
    w = hashing.windows(h, 2)
    assert len(w) == 4 and w[0] == w[2] and w[1] == w[3] and w[0] != w[1]
    assert len(hashing.windows(h[:1], 3)) == 1 and len(hashing.windows(h[:0], 3)) == 0


# language model


def test_lattice_against_enumeration():
    probs = {"▁": 0.1, "a": 0.2, "b": 0.1, "ab": 0.15, "▁a": 0.05, "<0xC3>": 0.02, "<0xA9>": 0.03, "ba": 0.25}
    logs = {p: math.log(x) for p, x in probs.items()}

    def total(s):
        if not s:
            return 1.0
        p = sum(probs[s[:n]] * total(s[n:]) for n in range(1, len(s) + 1) if s[:n] in probs)
        if s[0] not in probs:
            p += math.prod(probs[b] for b in lm_score.spelt(s[0])) * total(s[1:])
        return p

    for w in ("a", "abba", "baé", "", "ababab", "é"):
        assert lm_score.lattice_log10(w, logs, 2) == pytest.approx(math.log10(total("▁" + w)))


@pytest.mark.parametrize("head", [0, 50, 200_000])
def test_lm_scores(spark, odd, head):
    docs = table(spark, [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]).unionByName(odd)
    got = lm_score.lm_scores(docs, head_words=head).collect()
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in [*t, b""])
    n, v = sum(c.values()), len(c)
    want = sorted(
        (i or 0, held(i), len(t) + 1, sum(c[w] > 0 for w in [*t, b""]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*t, b""]), 5))
        for i, t in rows
    )
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_lm_empty(spark, odd):
    assert lm_score.lm_scores(odd.limit(0)).count() == 0
    held = table(spark, [(i, "only held out") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2])
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in lm_score.lm_scores(held).collect())


# licenses


def test_licenses(spark, odd):
    long = "filler words " * 3000
    rows = [
        (20, "text.\nReleased under the MIT License."), (21, long + "This work is licensed under the GNU General Public License, version 3. " + long),
        (22, "This work is licensed under the GNU General Public License, version 2.\nLicensed under CC BY-NC 4.0."), (23, "a licence to write"),
        (24, "Licensed under the Apache License, Version 2.0 and also released under the MIT license"), (25, "licensed under the GPL of the sea, version 3"),
        (26, "Licensed under CC BY-ND 4.0."),
    ]
    docs = table(spark, rows).unionByName(odd)
    got = licenses.find_licenses(docs).collect()
    assert len(got) == docs.count()
    found = {r.doc_id: sorted(x.name for x in r.notices) for r in got}
    assert (found[20], found[21], found[22], found[24]) == (["MIT"], ["GPL-3.0"], ["CC-BY-NC-4.0", "GPL-2.0"], ["Apache-2.0", "MIT"])
    assert found[23] == found[25] == found[26] == [] and not any(found[i] for i in (None, 1, 2, 3, 4, 5, 6))
    text = dict(rows)
    for r in got:
        for x in r.notices:
            assert "licen" in text[r.doc_id][x.start : x.end].lower()
    assert licenses.find_licenses(odd.limit(0)).count() == 0


def test_license_lines_found(spark):
    name = {"MIT License": "MIT", "Apache License": "Apache-2.0", "CC BY-NC 4.0": "CC-BY-NC-4.0", "General Public License, version 3": "GPL-3.0"}
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in QUERIES["op9_license_compression"](spark, "/root/testdata/sf0.01").collect():
        assert set(filter(None, r.licenses.split(","))) == {v for k, v in name.items() if k in docs[r.doc_id]}


@pytest.mark.parametrize("leader", ["\n", "\n * ", "\r\n# "])
def test_license_notices_wrapped_anywhere(leader):
    templates = licenses.Templates(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES:
        words = re.sub(r"\{\d+\}", "", text).split()
        wraps = [" ".join(words[:i]) + leader + " ".join(words[i:]) for i in range(1, len(words))]
        for wrapped in [*wraps, leader.join(words)]:
            got = licenses.scan_text(f"Some title.{leader}{wrapped}{leader}More of the text.", templates)
            assert [r["name"] for r in got] == [name], wrapped


GNU = (
    "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by "
    "the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n"
)
CLAUSES = (
    "{}. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n{}. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
ENDORSE = "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
ADVERTISE = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.\n"
WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (GNU.format("program", "Affero General Public", "3"), ["AGPL-3.0"]),
        (GNU.format("program", "Lesser General Public", "3"), ["LGPL-3.0"]),
        (GNU.format("library", "Lesser General Public", "2.1"), ["LGPL-2.1"]),
        (GNU.format("library", "Library General Public", "2"), ["LGPL-2.0"]),
        (GNU.format("program", "General Public", "2"), ["GPL-2.0"]),
        (GNU.format("program", "General Public", "3"), ["GPL-3.0"]),
        (GNU.format("script", "General Public", "3").replace(" ", "\ndnl "), ["GPL-3.0"]),
        (GNU.format("program", "Imaginary General Public", "3"), []),
        ("This work is licensed under the GNU Lesser General Public License, version 2.", ["LGPL-2.0"]),
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
        ("Licensed under the terms. " + GNU.format("program", "General Public", "3").replace("This program is ", "Foo is "), ["GPL-3.0"]),
        (BSD + CLAUSES.format(1, 2) + "3. Neither the name of the copyright holder " + ENDORSE + WARRANTY, ["BSD-3-Clause"]),
        (BSD + CLAUSES.format("*", "*") + "* Neither the name of Some Long Company Name, Inc. " + ENDORSE + WARRANTY, ["BSD-3-Clause"]),
        (BSD + CLAUSES.format("a", "b") + WARRANTY, ["BSD-2-Clause"]),
        (BSD + CLAUSES.format(1, 2) + ADVERTISE + "4. Neither the name of the copyright holder " + ENDORSE + WARRANTY, ["BSD-4-Clause"]),
        (BSD + "1. Redistributions must be free of charge.", ["LicenseRef-BSD"]),
        ("Released under the <a href='x'>MIT</a> License.<br>Licensed under CC BY 4.0.", ["MIT", "CC-BY-4.0"]),
    ],
)
def test_license_told_from_its_relatives(text, want):
    templates = licenses.Templates(licenses.TEMPLATES)
    for t in (text, f"İ intro of the software.\n{text}\nMore text.", text.replace(" ", "\n * ")):
        got = licenses.scan_text(t, templates)
        assert [r["name"] for r in got] == want
        for r in got:
            assert not t[r["start"] : r["end"]].startswith(" ") and r["missing"] <= 4


def test_license_once_in_many_blocks():
    notice = GNU.format("program", "Affero General Public", "3")
    text = "\n".join(f"{notice} Part {i} of the collection, copyright of nobody." for i in range(40))
    got = licenses.scan_text(text, licenses.Templates(licenses.TEMPLATES))
    assert [(r["name"], r["start"]) for r in got] == [("AGPL-3.0", m.start()) for m in re.finditer("This program", text)]
