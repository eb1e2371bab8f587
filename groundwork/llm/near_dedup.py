"""Near duplicates by min-max hashing.

A document's set is its distinct word shingles (64-bit hashes). Under each of ``bands * rows / 2``
permutations both the smallest and the largest value are kept, so a signature needs half the hash
evaluations of plain MinHash; the values are cut into ``bands`` bands of ``rows``. Two documents that
share a band are candidates; links are confirmed on the full sets.

With 32 bands of 6 rows a pair at similarity 0.85 shares no band with a chance below 1e-6 (0.8 with
rows of 5: below 1e-5).

How candidates are checked without listing all pairs of a bucket:

1. Rows with equal sets are one class (aggregate with map-side combine); it goes on as a node made of its smallest
   id and a hash of the set, so that an id with several texts is several nodes.
2. Star: in each bucket every member is compared with the bucket's smallest id. That is linear in the
   bucket, and one large group of close copies ends here as one component.
3. Rest: a bucket that still has several components may hide links between two members that are not its
   centre. Its members are dealt into blocks of at most ``BLOCK``; each pair of blocks is one group
   that counts all intersections exactly (a product of 0/1 matrices over the shingles that two members
   share, in column chunks) and returns the links, at most one per member. No bucket is left out and
   none is capped.

Components are those of all confirmed links. Shingle sets are computed again for candidates only, so
the sets of all documents are never stored; the candidates' texts are sifted out where they are read, by a bitmap of
their ids, and not exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import in_arrow, shared_table, sifted, text_or_empty
from .graph import components

BLOCK = 512
_COLUMNS = 4096
_CHUNK = 2048


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of a non-empty set: minima and maxima of each permutation, ``rows / 2`` permutations a band."""
    perms = bands * rows // 2 + bands * rows % 2
    a, b = hashing.multipliers(perms, 29), hashing.multipliers(perms, 31)
    low = high = None
    for i in range(0, len(shingles), _CHUNK):
        v = shingles[i : i + _CHUNK, None] * a + b
        lo, hi = v.min(axis=0), v.max(axis=0)
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    values = np.stack([low, high], axis=1).ravel()[: bands * rows].reshape(bands, rows)
    return hashing.scramble((values * hashing.multipliers(rows, 37)).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def _signatures(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, flat = [], [], []
            for text in batch.column(1):
                s = hashing.shingle_set(text.as_py(), k)
                sizes.append(len(s))
                keys.append(hashing.xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    flat.append(band_keys(s, bands, rows))
            ends = np.cumsum([0] + [bands if n else 0 for n in sizes]).astype(np.int32)
            values = np.concatenate(flat).view(np.int64) if flat else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(ends, values), *batch.columns[2:]],
                ["id", "n", "set_key", "bands", *batch.schema.names[2:]],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [hashing.shingle_set(t.as_py(), k) for t in batch.column(1)]
            keys = pa.array([hashing.xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), keys, pa.ListArray.from_arrays(ends, values)], ["id", "set_key", "items"]
            )

    return run


def block_links(ids: list, sets: list[np.ndarray], numerator: int, denominator: int) -> list[tuple]:
    """A spanning forest of the links among the sets: exact intersections as a product of 0/1 matrices."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    rank = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], rank[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), dtype=np.float32)  # counts up to the set sizes, far below 2**24: exact
    total = int(shared.sum())
    for start in range(0, total, _COLUMNS):
        a, b = np.searchsorted(column, [start, start + _COLUMNS])
        x = np.zeros((n, min(_COLUMNS, total - start)), dtype=np.float32)
        x[owner[a:b], column[a:b] - start] = 1
        both += x @ x.T
    union = sizes[:, None] + sizes[None, :] - both
    i, j = np.nonzero(np.triu(denominator * both >= numerator * union, 1))
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((ids[x], ids[y]))
    return out


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    text_key: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_shingles, component_id, kept``.

    Documents whose shingle sets have ``100 * intersection >= percent * union`` are linked;
    ``component_id`` is the smallest id reachable over links and ``kept`` says that it is the row's own.
    Words are runs of other characters than ASCII white space, with A-Z lowered; a text of fewer than
    ``k`` words is one shingle. Null, empty and blank texts have no shingles and are linked with nothing.
    Rows that repeat an id are judged one by one: each has the component of its own set, so a text that nothing else
    resembles is kept whatever else has its id. A row with a null id cannot be
    referred to: it has a null component and is kept. With ``text_key`` the result also has the 128-bit
    ``set_key`` of each row's set and its ``text_hash`` (SHA-256 of the text as it stands). Other columns are not read; ids
    are integers.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    rows_of = ids.withColumn("text_hash", F.sha2("text", 256)) if text_key else ids
    kinds = "id long, n long, set_key binary, bands array<long>" + (", text_hash string" if text_key else "")
    signed = shared_table(in_arrow(rows_of, _signatures(k, bands, rows), kinds), "signatures")
    classes = signed.where("n > 0 AND id IS NOT NULL").groupBy("set_key")
    classes = classes.agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    node = F.struct("id", F.xxhash64("set_key").alias("key"))
    classes = shared_table(classes.select(node.alias("rep"), "set_key", "n", "bands"), "classes")
    members = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(
        F.min(F.struct("rep", "n")).alias("centre"),
        F.count("*").alias("size"),
        F.bit_xor(F.xxhash64("rep")).alias("mark"),
    )
    # one more key than the aggregate's, so that the join has an exchange of its own and a large bucket is split
    apart = F.crc32(F.col("bucket").cast("string").cast("binary"))
    met = members.withColumn("apart", apart).join(buckets.where("size > 1").withColumn("apart", apart), ["bucket", "apart"])
    crowds = shared_table(met.select("bucket", "rep", "n", "centre", "size", "mark"), "crowds")
    pairs = shared_table(
        crowds.where(
            (F.col("rep") != F.col("centre.rep"))
            & (100 * F.least("n", "centre.n") >= percent * F.greatest("n", "centre.n"))
        )
        .select(F.col("rep").alias("a"), F.col("centre.rep").alias("b"))
        .distinct(),
        "pairs",
    )
    wanted = shared_table(crowds.select("rep").distinct(), "wanted")
    candidates = sifted(ids, wanted.select("rep.id"), "id")
    found = in_arrow(candidates, _sets(k), "id long, set_key binary, items array<long>")
    # one exchange by both columns serves the join and the duplicates
    sets = found.select("id", F.xxhash64("set_key").alias("key"), "items")
    sets = sets.join(wanted.select("rep.id", "rep.key"), ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    sets = shared_table(sets.select(F.struct("id", "key").alias("rep"), "items"), "sets")

    def confirmed(p: DataFrame) -> DataFrame:
        # both sides rename the same columns, so that Spark exchanges the sets once
        x = p.join(sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), "a")
        x = x.join(sets.select(F.col("rep").alias("b"), F.col("items").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        union = F.size("x") + F.size("y") - both
        return x.where(100 * both >= percent * union).select("a", "b")

    links = shared_table(confirmed(pairs).distinct(), "stars")
    stars = shared_table(components(links), "components")

    # buckets with several components left; those with the same members are taken once
    joined = crowds.where("size > 2").join(stars.withColumnRenamed("node", "rep"), "rep", "left")
    joined = joined.withColumn("component", F.coalesce("component", "rep"))
    open_buckets = (
        joined.groupBy("bucket", "size", "mark")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi")
        .groupBy("size", "mark")
        .agg(F.min("bucket").alias("bucket"))
    )
    rest = crowds.join(open_buckets.select("bucket"), "bucket").select("bucket", "rep", "size")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    slot = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, F.col("slot")).alias("i"), F.greatest(o, F.col("slot")).alias("j")),
    )
    dealt = (
        rest.withColumn("blocks", blocks)
        .withColumn("slot", slot)
        .select("bucket", "rep", F.explode(others).alias("at"))
        .select("bucket", "at.i", "at.j", "rep")
        .join(sets, "rep")
        .select("bucket", "i", "j", "rep.id", "rep.key", "items")
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        nodes = list(zip(frame["id"].tolist(), frame["key"].tolist(), strict=True))
        found = block_links(nodes, [np.asarray(s) for s in frame["items"]], percent, 100)
        return pd.DataFrame([(*x, *y) for x, y in found], columns=["ai", "ak", "bi", "bk"], dtype="int64")

    more = dealt.groupBy("bucket", "i", "j").applyInPandas(compare, "ai long, ak long, bi long, bk long")
    end = lambda i, k: F.struct(F.col(i).alias("id"), F.col(k).alias("key"))
    more = shared_table(more.select(end("ai", "ak").alias("a"), end("bi", "bk").alias("b")).distinct(), "more")
    if not more.isEmpty():
        stars = shared_table(components(links.unionByName(more)), "components")

    of_class = classes.join(stars.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep")["id"].alias("component")
    )
    out = signed.drop("bands").join(shared_table(of_class, "of-class"), "set_key", "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("id").isNull() | (component == F.col("id"))).alias("kept"),
        *(["set_key", "text_hash"] if text_key else []),
    )
