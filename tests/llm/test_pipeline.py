"""The corpus pipeline, stage by stage on what the stage before kept, against brute force."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from groundwork.llm import decontaminate, mixing, quality, sharding
from tests.llm.test_free_ops import brute_components, brute_coverage
from tests.llm.test_native_ops import brute_shard

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The small tables with odd rows, and columns whose names the operators use themselves."""
    d = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng = random.Random(4)
    base = docs.where("doc_id = 3").first().text.split()[:200]
    odd = [(900, None, None, None), (901, "", "en", "src0"), (902, " \n", None, None), (903, None, "de", "src1"), (904, None, "de", "src1"), (904, None, "de", "src1")]
    # an id with a copy of another text and with a text of its own, which must not go with the copy
    odd += [(905, docs.where("doc_id = 7").first().text, "en", "src0"), (905, docs.where("doc_id = 8").first().text.replace("e", "o"), "en", "src0")]
    odd += [(910 + i, " ".join(base[:100] + [f"edit{rng.random()}"] + base[101:]), "en", "hot") for i in range(5)]
    odd += [(930, docs.where("doc_id = 5").first().text + "\n" + bench[0], "en", "hot"), (None, docs.where("doc_id = 6").first().text, "en", "hot")]
    extra = spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in odd], docs.schema)
    all_docs = docs.unionByName(extra)
    for name in ("row", "leaks", "shard", "depth", "bytes", "target", "ord", "doc", "mix_copies", "kept", "quality_score"):
        all_docs = all_docs.withColumn(name, F.lit("x"))
    all_docs.coalesce(1).write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").coalesce(1).write.parquet(f"{d}/{t}.parquet")
    return d


def rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "mixing", "sharding"]
    kept = {}
    for name, stage in cp.STAGES:
        kept[name] = stage(spark, docs, corpus).cache()
        if name != "sharding":
            assert kept[name].columns == docs.columns
        check = globals()[f"check_{name}"]
        check(spark, corpus, docs, kept[name])
        docs = kept[name]
    assert rows(cp.run(spark, corpus)) == rows(docs)
    for df in kept.values():
        df.unpersist()


def check_quality(spark, corpus, docs, got):
    scored = quality.score(docs.select("doc_id", "text"), spark.read.parquet(f"{corpus}/labels.parquet"))
    want = rows(scored.where("quality_score >= 0.7").select("doc_id", "text"))
    assert rows(got.select("doc_id", "text")) == want and not rows(got) - rows(docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{corpus}/labels.parquet").collect()}
    ids = {r.doc_id for r in got.collect()}
    good, bad = [i for i, q in labels.items() if q == 1], [i for i, q in labels.items() if q == 0]
    assert sum(i in ids for i in good) >= 0.95 * len(good) and sum(i in ids for i in bad) <= 0.4 * len(bad)


def check_near_dedup(spark, corpus, docs, got):
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    component = brute_components([x for x in plain if x[0] is not None], 5, 80)
    want = collections.Counter((i, t) for i, t in plain if i is None or component[i, t] == i)
    assert rows(got.select("doc_id", "text")) == want and len(want) < len(set(plain))


def check_decontaminate(spark, corpus, docs, got):
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    ids = rows(got.select("doc_id", "text"))
    for (i, text), n in rows(docs.select("doc_id", "text")).items():
        words = decontaminate.words_of(text or "")
        known = set(words)
        # brute force only where enough of an item's words occur at all
        near = [x for x in items if sum(w in known for w in x) >= 0.6 * len(x)]
        leaked = any(" ".join(x) in " ".join(words) for x in near)
        if not leaked and len(words) < 150:
            leaked = any(brute_coverage(words, x, decontaminate.LEAST) >= decontaminate.COVERAGE for x in near)
        assert ids.get((i, text), 0) == (0 if leaked else n)


def check_mixing(spark, corpus, docs, got):
    want = collections.Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.text] += r.mix_copies
    assert rows(got.select("doc_id", "text")) == +want
    size = collections.Counter()
    for r in docs.collect():
        size[r.source] += len((r.text or "").encode().split())
    taken = sum(len((r.text or "").encode().split()) for r in got.collect())
    largest = max(len((r.text or "").encode().split()) for r in docs.collect())
    assert 1.5 * sum(size.values()) - 2 * largest <= taken <= 1.5 * sum(size.values())


def check_sharding(spark, corpus, docs, got):
    want = brute_shard(docs.collect(), sharding.SHARD_BYTES)
    seen = {}
    for r in got.collect():
        seen.setdefault((r.doc_id, r.text), []).append((r.shard, r.shard_depth, r.shard_rows, r.shard_bytes, r.shard_fits))
    assert seen == want


def test_empty_documents(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, corpus).count() == 0
