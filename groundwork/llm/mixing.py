"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, gone through at most ``max_repeats`` times.
An item (document, repeat) has a virtual finish time: the words of its source up to and including it,
divided by the source's target. Items are taken in the order of finish time until their total reaches
the budget, so at any point every source has had its share.

Scale: a source may hold any part of the rows, so running sums are made in two levels. Inside a source
the shuffle order is cut into buckets of about ``BUCKET_ROWS`` documents; bucket totals (a few bytes
each) are summed along the source, rows are summed along their bucket. The global order is cut into
slots of finish time in the same way, and only the one slot in which the budget runs out is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, shared_table, text_or_empty, word_count

BUCKET_ROWS = 5000
SPACE = float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_repeats: int) -> DataFrame:
    """Per source (``source, rows, source_size``) its ``ord, weight, target``.

    The budget ``share * total`` is divided by weight; a target stops at ``max_repeats`` times its
    source's size and the excess goes to the others by weight. Closed form: with sources in the order
    of capacity per weight, the level is the first ``(budget - capacity before) / (weight from here)``
    that the source's own ratio reaches. One row per source goes through these windows.
    """
    by_name = Window.orderBy(F.col("source").isNotNull().desc(), "source")
    s = sizes.withColumn("ord", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("ord") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", max_repeats * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "ord")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    s = (
        s.withColumn("budget", share * F.sum("source_size").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("budget") - F.col("cap_before")) / F.col("weight_left"))
    )
    s = s.withColumn("final", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "ord", "level"))).over(everything))
    capped = F.col("final").isNull() | (F.col("ratio") < F.col("final.level"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("final.level") * F.col("weight"))
    return s.select("source", "rows", "source_size", "ord", "budget", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_repeats: int = 2,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """``docs`` with its columns (or only those of ``carry``) and ``mix_size, mix_source_size, mix_target, mix_copies`` (0..max_repeats).

    Sizes are words; a null text has none and gets no copies, as nothing of it can be taken. A null
    source is a source of its own, the last. Null ids and repeated rows are ordinary items; rows that
    share an id, or have none, are spread by their texts, and items that tie in both are interchangeable. Reruns
    agree: the order comes from ids, texts and ``seed`` alone. Columns of these four names, in any case, are replaced.
    """
    spark = docs.sparkSession
    added = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
    cols = [f"`{c}`" for c in (docs.columns if carry is None else carry) if c.lower() not in added]
    rows = docs.select(
        F.struct(*cols).alias("doc"),  # the input's columns stay apart from the names used below
        F.col(source_col).alias("source"),
        word_count(text_or_empty(text_col)).alias("mix_size"),
        F.md5(F.concat(F.lit(seed + ":"), id_text(id_col), F.lit(":"), F.md5(text_or_empty(text_col).cast("binary")))).alias("__key"),
    ).withColumn("__u", F.conv(F.substring("__key", 1, 13), 16, 10).cast("long"))
    small = shared_table(rows.select("source", "mix_size", "__key", "__u"), "sizes")
    sizes = small.groupBy("source").agg(F.count("*").alias("rows"), F.sum("mix_size").alias("source_size"))
    targets = shared_table(source_targets(sizes, weights, share, max_repeats), "targets")

    def placed(df: DataFrame) -> DataFrame:
        t = targets.withColumnRenamed("source", "__source").withColumnRenamed("source_size", "mix_source_size")
        buckets = F.greatest(F.ceil(F.col("rows") / BUCKET_ROWS), F.lit(1))
        return df.join(t, df["source"].eqNullSafe(F.col("__source"))).withColumn(
            "__bucket", F.floor(F.col("__u") / SPACE * buckets)
        )

    totals = placed(small).groupBy("ord", "__bucket").agg(F.sum("mix_size").alias("bucket_size"))
    along = Window.partitionBy("ord").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = shared_table(
        totals.select("ord", "__bucket", F.coalesce(F.sum("bucket_size").over(along), F.lit(0)).alias("start")), "starts"
    )

    def queued(df: DataFrame) -> DataFrame:
        inside = Window.partitionBy("ord", "__bucket").orderBy("__u", "__key", "mix_size").rowsBetween(
            Window.unboundedPreceding, 0
        )
        return placed(df).join(starts, ["ord", "__bucket"]).withColumn(
            "__cum", F.col("start") + F.sum("mix_size").over(inside)
        )

    def items(df: DataFrame, keep: list[str]) -> DataFrame:
        """One row per repeat, with its place in the global order."""
        r = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("__repeat")
        e = df.select(*keep, r).withColumn("__cum", F.col("__cum") + F.col("__repeat") * F.col("mix_source_size"))
        return e.withColumn("finish", F.try_divide(F.col("__cum").cast("double"), F.col("target")))

    q = items(queued(small), ["ord", "mix_size", "mix_source_size", "target", "__cum"]).where("mix_size > 0")
    n_rows = small.count()
    slots = float(max(1, n_rows // BUCKET_ROWS))
    q = q.withColumn("slot", F.floor(F.col("finish") * slots))
    slot_sums = q.groupBy("slot").agg(F.sum("mix_size").alias("slot_size"))
    upto = Window.orderBy("slot")
    budget = targets.agg(F.max("budget")).first()[0] or 0.0
    # what comes to the driver: the one slot in which the budget runs out, and the last item taken there
    crossing = (
        slot_sums.withColumn("upto", F.sum("slot_size").over(upto)).where(F.col("upto") > budget).orderBy("slot").first()
    )
    last = None
    if crossing is not None:
        room = budget - (crossing["upto"] - crossing["slot_size"])
        order = Window.orderBy("finish", "ord", "__cum").rowsBetween(Window.unboundedPreceding, 0)
        here = q.where(F.col("slot") == crossing["slot"]).withColumn("run", F.sum("mix_size").over(order))
        last = here.where(F.col("run") <= room).agg(F.max(F.struct("finish", "ord", "__cum")).alias("last")).first()[0]

    taken = F.lit(0)
    for r in range(max_repeats):
        cum = F.col("__cum") + r * F.col("mix_source_size")
        finish = F.try_divide(cum.cast("double"), F.col("target"))
        slot = F.floor(finish * slots)
        place = F.struct(finish.alias("finish"), F.col("ord"), cum.alias("__cum"))
        fits = F.lit(True)
        if crossing is not None:
            fits = slot < crossing["slot"]
        if last is not None:
            at = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["ord"]).alias("ord"), F.lit(last["__cum"]).cast("long").alias("__cum"))
            fits = fits | ((slot == crossing["slot"]) & (place <= at))
        taken = taken + F.when((F.col("mix_size") > 0) & fits, 1).otherwise(0)
    full = queued(rows)
    return full.select(
        "doc.*", "mix_size", "mix_source_size", F.col("target").alias("mix_target"), taken.cast("int").alias("mix_copies")
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as it is taken."""
    m = mix(docs, **options)
    return m.where("mix_copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(
        *[f"`{c}`" for c in docs.columns]
    )
