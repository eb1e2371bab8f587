"""Merkle manifest of a dataset: a root over all rows, and a proof per row, by nested-struct rollup.

Every row is a leaf; leaves of a source ascend by id, and runs of ``ARITY`` nodes become their hash until one node,
the source's subroot, remains; subroots in the order of sources lead to the root likewise.

A node's place among its source's leaves, written in base ``ARITY``, says where it stands: its last digit is its
place in its run. Blocks of ``ARITY ** LEVELS`` leaves are rolled up by grouping the digit columns away one after the
other, nesting child structs in their parent (one exchange by block serves all these groupings, and a block has a
bounded size, so a source may hold any part of the rows). Block nodes are rolled up in the same way, layer by layer.
Proofs come from the nested structs by transform and explode: no leaf is joined with anything; a block meets the path
above it by one join on (source, block), one row per ``ARITY ** LEVELS`` leaves.

Places come from one range sort: each partition's rows are numbered as they lie, and the partitions' counts (one
row per partition and source in it) are summed. Every layer is a table in the shared folder, so a lost
executor repeats no more than its own tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, shared_table

ARITY = 3
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """A value with its length in bytes in front, or '-' for null, so that no two rows read alike."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def numbered(df: DataFrame, order: list[str], group: str | None = None) -> DataFrame:
    """``df`` with each row's ``rank`` (from 0) in ``order`` inside ``group`` and the group's size ``n``; nulls first.

    ``order`` starts with ``group``. Rows that tie in all of ``order`` get different ranks in any order.
    """
    at = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    at = shared_table(at, "ordered").withColumn("part", F.shiftright("at", 33))
    by = F.lit(0) if group is None else F.col(group)
    parts = at.groupBy(by.alias("of"), "part").agg(F.count("*").alias("part_n"), F.min("at").alias("part_at"))
    before = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "of",
        "part",
        (F.coalesce(F.sum("part_n").over(before), F.lit(0)) - F.col("part_at")).alias("shift"),
        F.sum("part_n").over(Window.partitionBy("of")).alias("n"),
    )
    parts = shared_table(parts, "parts").withColumnRenamed("part", "in_part")
    met = at.join(parts, (at["part"] == parts["in_part"]) & by.eqNullSafe(parts["of"]))
    return met.select(*df.columns, (F.col("at") + F.col("shift")).alias("rank"), "n")


def _rolled(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """One row per block: ``tree, n, block, node``; ``node`` nests ``ARITY ** LEVELS`` nodes (``tree, n, rank, hash``).

    A level at which a tree has one node left passes it on as it is.
    """
    digits = [f"d{j}" for j in range(LEVELS)]
    df = nodes.select(
        "tree",
        "n",
        F.floor(F.col("rank") / ARITY**LEVELS).alias("block"),
        *[(F.floor(F.col("rank") / ARITY**j) % ARITY).cast("int").alias(d) for j, d in enumerate(digits)],
        "hash",
        *payload,
    )
    df = df.repartition("tree", "n", "block").withColumn("node", F.struct("d0", "hash", *payload))
    for j in range(LEVELS):
        above = digits[j + 1 :]
        df = df.groupBy("tree", "n", "block", *above).agg(F.sort_array(F.collect_list("node")).alias("kids"))
        joined = F.array_join(F.transform("kids", lambda x: x["hash"]), "")
        hashed = F.when(F.col("n") > ARITY**j, F.sha2(joined, 256)).otherwise(F.col("kids")[0]["hash"])
        place = F.col(above[0]) if above else F.lit(0)
        df = df.withColumn("node", F.struct(place.alias("digit"), hashed.alias("hash"), "kids"))
    return df.select("tree", "n", "block", "node")


def _forest(leaves: DataFrame, payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Layers of blocks, from the leaves (``tree, n, rank, hash`` and ``payload``) up, and ``tree, hash`` of the tops."""
    layers, tops, nodes = [], None, leaves
    width = ARITY**LEVELS
    while True:
        layer = shared_table(_rolled(nodes, payload if not layers else []), f"layer-{len(layers)}")
        layers.append(layer)
        done = layer.where(F.col("n") <= width).select("tree", F.col("node.hash").alias("hash"))
        tops = done if tops is None else tops.unionByName(done)
        if layer.where(F.col("n") > width).isEmpty():
            return layers, tops
        nodes = layer.where(F.col("n") > width).select(
            "tree", F.ceil(F.col("n") / width).alias("n"), F.col("block").alias("rank"), F.col("node.hash").alias("hash")
        )


def _paths(layers: list[DataFrame], starts: DataFrame, payload: list[str]) -> DataFrame:
    """Every leaf: ``tree, rank, hash, payload`` and the columns of ``starts``, its ``path`` (``left, right``) grown to the leaf.

    ``starts`` has one row per tree: ``tree, path`` above its top, and what else its leaves carry.
    """
    carried = [c for c in starts.columns if c not in ("tree", "path")]
    width, above = ARITY**LEVELS, None
    for depth, layer in reversed(list(enumerate(layers))):
        own = payload if depth == 0 else []
        tops = layer.where(F.col("n") <= width).join(starts, "tree")
        df = tops.select("tree", "n", "block", "node", "path", *carried)
        if above is not None:
            upper = above.select("tree", F.col("rank").alias("block"), "path", *carried)
            df = df.unionByName(layer.where(F.col("n") > width).join(upper, ["tree", "block"]).select(*df.columns))
        df = df.withColumn("rank", F.col("block"))
        for j in reversed(range(LEVELS)):
            hashes = F.transform("node.kids", lambda x: x["hash"])
            sides = lambda x, i: F.struct(
                x.alias("node"),
                F.array_join(F.slice(hashes, F.lit(1), i), "").alias("left"),  # noqa: B023
                F.array_join(F.slice(hashes, i + 2, F.lit(ARITY)), "").alias("right"),  # noqa: B023
                i.alias("place"),
            )
            df = df.select("tree", "n", "rank", "path", *carried, F.explode(F.transform("node.kids", sides)).alias("kid"))
            step = F.array(F.struct("kid.left", "kid.right"))
            df = df.select(
                "tree",
                "n",
                (F.col("rank") * ARITY + F.col("kid.place")).alias("rank"),
                F.when(F.col("n") > ARITY**j, F.concat(step, "path")).otherwise(F.col("path")).alias("path"),
                *carried,
                F.col("kid.node").alias("node"),
            )
        above = df.select("tree", "rank", "path", *carried, "node.hash", *[f"node.{c}" for c in own])
        if depth:
            above = shared_table(above, f"paths-{depth}")
    return above


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` and the siblings along ``path`` lead to."""
    return F.aggregate(path, start, lambda h, s: digest(s["left"], h, s["right"]))


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    id_col: str = "doc_id",
    source_col: str = "source",
    checked: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, leaf, subroot, root, path, folded_root, verified``.

    A leaf is the SHA-256 of the row's ``fields``. ``path`` lists the siblings on the way to the root, from the leaf up, as
    ``left`` and ``right`` of the own node, both empty where a run has one node. ``folded_root`` is the root that the row leads
    to along ``path`` when the columns of ``checked`` are replaced (a copy to be verified; by default the row itself),
    ``verified`` whether it is the root.

    A null source is a source of its own, the first. Null ids come first in their source; rows that share an id, or have
    none, stand in the order of their hash, and equal rows are leaves of their own. A lone leaf is its source's subroot, a
    lone subroot the root. Nulls, empty and long texts are hashed like any other value. Other columns are not read, whatever
    their names; an empty table gives an empty result.
    """
    seen = checked or {}
    leaf = digest(*[field(F.col(f"`{f}`")) for f in fields])
    copy = digest(*[field(seen.get(f, F.col(f"`{f}`"))) for f in fields])
    rows = docs.select(
        F.col(f"`{source_col}`").alias("source"),
        F.col(f"`{id_col}`").alias("id"),
        leaf.alias("hash"),
        copy.alias("copy"),
    )
    rows = numbered(shared_table(rows, "leaves"), ["source", "id", "hash"], "source")
    rows = shared_table(rows, "ranked")
    sources = numbered(rows.where("rank = 0").select("source"), ["source"]).select("source", F.col("rank").alias("tree"))
    sources = shared_table(sources, "sources")
    of = sources.select(F.col("source").alias("name"), "tree")
    leaves = rows.join(of, rows["source"].eqNullSafe(of["name"])).select("tree", "n", "rank", "hash", "id", "copy")
    layers, subroots = _forest(leaves, ["id", "copy"])

    subroots = shared_table(subroots, "subroots")
    many = subroots.count()
    above = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(many).cast("long").alias("n"), F.col("tree").alias("rank"), "hash")
    top_layers, top = _forest(above, [])
    top = top.select("tree", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("hash").alias("root"))
    up = _paths(top_layers, top, []).select(F.col("rank").alias("tree"), "path", F.col("hash").alias("subroot"), "root")
    out = _paths(layers, shared_table(up, "subroot-paths"), ["id", "copy"])
    out = out.withColumn("folded_root", fold(F.col("copy"), F.col("path")))
    return out.select(
        F.col("id").alias(id_col),
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        "path",
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def without_newlines(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text as a copy has it that lost its line breaks, for every id whose CRC is even; others as they are."""
    even = F.col(id_col).isNotNull() & (F.crc32(id_text(id_col).cast("binary")) % 2 == 0)
    return F.when(even, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))
