"""Sharding by extendible hashing.

A row's address is the leading bits of a 60-bit hash of its key and text. The directory starts with one bucket
and splits, bit by bit, only those buckets whose bytes exceed the limit; the leaves are the shards.
Because a bucket's bytes only shrink with depth, a row's shard is the shallowest prefix that fits.

The directory is built from byte totals per prefix: one aggregate to a base depth (about ``SLACK`` bits
deeper than an even split needs), its roll-up to the shallower levels, and further rounds of eight bits
for the few buckets that are still too large there. Only totals move, never texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, shared_table, text_or_empty

BITS = 60
SLACK = 4
SHARD_BYTES = 16 << 20
BROADCAST_SHARDS = 100_000  # about 5 MB; a larger directory is joined by shuffle


def key_hash(key_col: str, text_col: str) -> Column:
    """60 bits of MD5 of the key as text (null: empty) and the text's own MD5, which parts rows that share a key."""
    key = F.concat(id_text(key_col), F.lit(":"), F.md5(text_or_empty(text_col).cast("binary")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: Column) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """Shards of ``sizes`` (``h, bytes``): ``depth, prefix, shard_rows, shard_bytes``.

    A bucket that is too large at the full depth (one key whose rows alone exceed the limit) is a shard.
    """
    found, low, base = None, 0, sizes
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    high = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + SLACK)
    while True:
        at = base.groupBy(_prefix(F.col("h"), F.lit(high)).alias("slot")).agg(
            F.count("*").alias("n"), F.sum("bytes").alias("bytes")
        )
        levels = at.select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "slot", "n", "bytes")
        up = F.call_function("shiftright", F.col("slot"), (F.lit(high) - F.col("depth")).cast("int"))
        sums = levels.groupBy("depth", up.alias("prefix")).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
        sums = shared_table(sums, f"sums{high}")
        fits = sums.where((F.col("bytes") <= limit) | (F.col("depth") == BITS))
        parents = sums.where(F.col("bytes") > limit).select(
            (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent")
        )
        leaf = fits.withColumn("parent", F.call_function("shiftright", "prefix", F.lit(1)))
        leaf = leaf.join(parents, ["depth", "parent"], "left_semi")
        if low == 0:
            leaf = leaf.select("depth", "prefix", "n", "bytes").unionByName(
                fits.where("depth = 0").select("depth", "prefix", "n", "bytes")
            )
        leaf = leaf.select("depth", "prefix", F.col("n").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
        found = leaf if found is None else found.unionByName(leaf)
        large = sums.where((F.col("depth") == high) & (F.col("bytes") > limit)).select(F.col("prefix").alias("large"))
        if high == BITS or large.isEmpty():
            return shared_table(found, "directory")
        base = base.join(large, _prefix(F.col("h"), F.lit(high)) == F.col("large"), "left_semi")
        low, high = high, min(BITS, high + 8)


def shard(
    docs: DataFrame, limit: int = SHARD_BYTES, key_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """``docs`` (its columns, or only those of ``carry``) with ``shard`` (the prefix bits, 'all' at depth 0), ``shard_depth, shard_rows, shard_bytes, shard_fits``.

    Bytes are the UTF-8 bytes of the text (null: 0). Rows that share a key, or have none, are parted by their
    texts; only rows equal in both share an address. Where such rows alone exceed the limit, or one text does, the shard cannot be split further
    and ``shard_fits`` is false. An empty table has no shards. Columns of these names, in any case, are replaced.
    """
    added = ("shard", "shard_depth", "shard_rows", "shard_bytes", "shard_fits")
    cols = [f"`{c}`" for c in (docs.columns if carry is None else carry) if c.lower() not in added]
    rows = docs.select(F.struct(*cols).alias("doc"), key_hash(key_col, text_col).alias("__h"))
    sizes = docs.select(
        key_hash(key_col, text_col).alias("h"), F.octet_length(text_or_empty(text_col)).cast("long").alias("bytes")
    )
    d = directory(shared_table(sizes, "sizes"), limit)
    depths = [r[0] for r in d.select("depth").distinct().collect()] or [0]  # at most 61 numbers

    def located(df: DataFrame, small: bool) -> DataFrame:
        """Each row with its shard: of its prefixes at the depths in use exactly one is in the directory."""
        at = [F.struct(F.lit(k).alias("depth"), _prefix(F.col("__h"), F.lit(k)).alias("prefix")) for k in sorted(depths)]
        e = df.withColumn("__at", F.explode(F.array(*at)))
        return e.withColumn("depth", F.col("__at.depth")).withColumn("prefix", F.col("__at.prefix")).drop("__at").join(
            F.broadcast(d) if small else d, ["depth", "prefix"]
        )

    d = d.select("depth", "prefix", F.col("shard_rows").alias("__rows"), F.col("shard_bytes").alias("__bytes"))
    if d.count() <= BROADCAST_SHARDS:
        joined = located(rows, True)
    else:  # find the place of each address first, so that texts move once
        places = located(docs.select(key_hash(key_col, text_col).alias("__h")).distinct(), False)
        joined = rows.join(places, "__h")
    bits = F.when(F.col("depth") == 0, F.lit("all")).otherwise(
        F.substring(F.lpad(F.bin("prefix"), BITS, "0"), -F.col("depth"), F.col("depth"))
    )
    return joined.select(
        "doc.*",
        bits.alias("shard"),
        F.col("depth").cast("int").alias("shard_depth"),
        F.col("__rows").alias("shard_rows"),
        F.col("__bytes").alias("shard_bytes"),
        (F.col("__bytes") <= limit).alias("shard_fits"),
    )
