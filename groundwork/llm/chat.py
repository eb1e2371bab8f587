"""Preference formatting of conversations.

Input: the turns (``conv_id, turn, role, text``) of chosen and of rejected conversations with equal ids.
The longest common turn prefix is rendered once as the prompt; the turns after it are the two
completions, each with a loss mask that is on only where the assistant speaks.

The result has one row per rendered turn, in the order (pair, part, turn): no conversation is gathered
into one row or task, however many turns it has. The prefix is found by counting: a turn number at which
the multisets of (role, text) of the two sides differ has a non-zero balance; the first such number ends
the prompt. That is an aggregate with map-side combine, so one huge conversation does not crowd a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.operators.joins import splittable_join

from .common import shared_table, shuffle_partitions

HEAD, TAIL = "<|im_start|>", "<|im_end|>\n"  # fixed values: the public ChatML markers
PAIR_TURNS, PAIR_BYTES = 4096, 16 << 20  # what one pair record may hold


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit("\n"), text, F.lit(TAIL))


def _turns(df: DataFrame) -> DataFrame:
    return df.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def preference_rows(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows ``conv_id, part, turn, role, rendered, trained, copies``; part is prompt, chosen or rejected.

    ``rendered`` is the turn in ChatML; ``trained`` is the loss mask of that row. Turns without a conv_id
    belong to no conversation and are left out; a null turn number sorts first (-1), a null role is the
    user's, a null text empty. Turns that repeat in everything are one row with ``copies``; different
    turns with one number stand in the order of role and text. A pair whose sides are equal is all
    prompt; a conversation on one side only has an empty prompt and one completion. Extra columns are
    not read.
    """
    sides = _turns(chosen).withColumn("side", F.lit(1)).unionByName(_turns(rejected).withColumn("side", F.lit(-1)))
    balance = sides.groupBy("conv_id", "turn", "role", "text").agg(
        F.count_if(F.col("side") == 1).alias("in_chosen"), F.count_if(F.col("side") == -1).alias("in_rejected")
    )
    splits = (
        balance.where(F.col("in_chosen") != F.col("in_rejected"))
        .groupBy("conv_id")
        .agg(F.min("turn").alias("split"))
    )
    b = splittable_join(balance, splits, "conv_id", "left")
    shared = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    parts = F.when(shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("in_chosen").alias("copies")))).otherwise(
        F.filter(
            F.array(
                F.struct(F.lit("chosen").alias("part"), F.col("in_chosen").alias("copies")),
                F.struct(F.lit("rejected").alias("part"), F.col("in_rejected").alias("copies")),
            ),
            lambda x: x["copies"] > 0,
        )
    )
    return b.select("conv_id", "turn", "role", "text", F.explode(parts).alias("p")).select(
        "conv_id",
        F.col("p.part").alias("part"),
        "turn",
        "role",
        rendered(F.col("role"), F.col("text")).alias("rendered"),
        ((F.col("p.part") != "prompt") & (F.col("role") == "assistant")).alias("trained"),
        F.col("p.copies").alias("copies"),
    )


def preference_pairs(rows: DataFrame, max_turns: int = PAIR_TURNS, max_bytes: int = PAIR_BYTES) -> DataFrame:
    """One record per conversation of ``preference_rows``: ``conv_id, n_turns, n_bytes, whole, prompt, prompt_sha256, chosen,
    chosen_trained, rejected, rejected_trained``.

    ``prompt`` is the rendered prompt; ``chosen`` and ``rejected`` are the completions' rendered turns in order, ``*_trained``
    their loss masks, turn by turn. Repeated turns are repeated. A conversation of more than ``max_turns`` turns or
    ``max_bytes`` bytes is too long for one row: its record says ``whole`` false and has null parts, and its rows are the
    result. Counts are taken first, so such a conversation is never gathered. An empty part is ``''`` or an empty array.
    """
    n, size = F.sum("copies"), F.sum(F.col("copies") * F.octet_length("rendered"))
    sizes = rows.groupBy("conv_id").agg(n.alias("n_turns"), size.alias("n_bytes"))
    sizes = sizes.withColumn("whole", (F.col("n_turns") <= max_turns) & (F.col("n_bytes") <= max_bytes))
    small = splittable_join(rows, sizes.where("whole").select("conv_id"), "conv_id")
    turn = F.struct("turn", "role", "rendered", "trained", "copies")
    part = {p: F.sort_array(F.collect_list(F.when(F.col("part") == p, turn))) for p in ("prompt", "chosen", "rejected")}
    got = small.groupBy("conv_id").agg(*[a.alias(f"_{p}") for p, a in part.items()])

    def field(p: str, name: str) -> Column:
        return F.flatten(F.transform(f"_{p}", lambda x: F.array_repeat(x[name], x["copies"].cast("int"))))

    prompt = F.array_join(field("prompt", "rendered"), "")
    completions = [
        c for p in ("chosen", "rejected") for c in (field(p, "rendered").alias(p), field(p, "trained").alias(f"{p}_trained"))
    ]
    got = got.select("conv_id", prompt.alias("prompt"), F.sha2(prompt.cast("binary"), 256).alias("prompt_sha256"), *completions)
    return splittable_join(sizes, got, "conv_id", "left")


def _next_ids(t: DataFrame) -> DataFrame:
    """``conv_id, next_id``: the next conversation that is there, null behind the last.

    Two levels: within range partitions, and from the end of each to the first id of the next one, so
    that no task sees more than its range (or one row a partition).
    """
    parts = shuffle_partitions(t.sparkSession)
    ids = t.select("conv_id").distinct().repartitionByRange(parts, "conv_id")
    ids = shared_table(ids.withColumn("range", F.spark_partition_id()), "conversation-ranges")
    firsts = ids.groupBy("range").agg(F.min("conv_id").alias("first_id"))
    firsts = firsts.select("range", F.lead("first_id").over(Window.orderBy("range")).alias("next_first"))
    within = F.lead("conv_id").over(Window.partitionBy("range").orderBy("conv_id"))
    return (
        ids.withColumn("within", within)
        .join(F.broadcast(firsts), "range")
        .select("conv_id", F.coalesce("within", "next_first").alias("next_id"))
    )


def swapped_replies(turns: DataFrame) -> DataFrame:
    """Rejected sides for conversations that come without: the last reply is the next conversation's.

    The table has no preference pairs, so the rejected side of a conversation is the conversation with
    its last assistant turn answered by the last assistant turn of the next conversation by id, however
    far that id is (an off-topic reply; empty where there is none).
    """
    t = _turns(turns)
    last = (
        t.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    )
    other = last.select(F.col("conv_id").alias("next_id"), F.col("last.text").alias("other"))
    swap = (
        last.select("conv_id", F.col("last.turn").alias("last_turn"), F.col("last.text").alias("last_text"))
        .join(_next_ids(t), "conv_id")
        .join(other, "next_id", "left")
        .drop("next_id")
    )
    is_last = (F.col("role") == "assistant") & (F.col("turn") == F.col("last_turn")) & (F.col("text") == F.col("last_text"))
    return splittable_join(t, swap, "conv_id", "left").select(
        "conv_id",
        "turn",
        "role",
        F.when(is_last, F.coalesce("other", F.lit(""))).otherwise(F.col("text")).alias("text"),
    )
