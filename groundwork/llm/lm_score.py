"""Language-model scores by subword lattice likelihood.

The vocabulary is that of an existing tokenizer (its file is a parameter; pieces never cross a word). A
word's probability is the sum over all its segmentations into pieces, each the product of its pieces'
unigram probabilities, found by a forward recursion in log space; a text's is the product over its words
and the end token. Characters outside the vocabulary are spelt by the tokenizer's byte pieces.

Piece probabilities are learnt from the training rows: words are counted over the whole corpus, each
distinct word is segmented by the tokenizer once, and its pieces weigh as often as the word occurs
(plus one for every piece).

Plan: (1) word counts, partial per task, then by word; (2) piece counts, at most one row per vocabulary
entry, which is what goes to the driver; (3) lattice score of each distinct word once; (4) document
sums. For (4) the ``HEAD_WORDS`` commonest words are broadcast (a fixed number of rows) and summed where the
text is read; occurrences of all other words are joined with the word table by shuffle, so every word of
every text counts exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import id_text, in_arrow, shared_table, text_or_empty

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
HEAD_WORDS = 200_000
_FLUSH = 200_000
SPACE = "▁"


def load_pieces(path: str) -> dict[str, int]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))}


def spelt(ch: str) -> list[str]:
    """Byte pieces of a character that is no piece itself."""
    return [f"<0x{b:02X}>" for b in ch.encode("utf-8", "surrogatepass")]


def lattice_log10(word: str, logs: dict[str, float], longest: int) -> float:
    """log10 of the summed probability of all segmentations of a word (with the word-start mark).

    ``logs`` has the natural logarithm of each piece's probability, ``longest`` its longest piece.
    """
    s = SPACE + word
    get, alpha = logs.get, [0.0]
    for end in range(1, len(s) + 1):
        terms = []
        for start in range(max(0, end - longest), end):
            lp = get(s[start:end])
            if lp is not None:
                terms.append(alpha[start] + lp)
        if s[end - 1] not in logs:
            terms.append(alpha[end - 1] + sum(logs[b] for b in spelt(s[end - 1])))
        top = max(terms)
        alpha.append(top if len(terms) == 1 else top + math.log(sum([math.exp(t - top) for t in terms])))
    return alpha[-1] / math.log(10)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, count in training, count) per task; flushed at a bounded number of distinct words."""

    def out(train: Counter, rest: Counter) -> Iterator[pa.RecordBatch]:
        words = list(train.keys() | rest.keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(words, pa.binary()),
                pa.array([train.get(w, 0) for w in words], pa.int64()),
                pa.array([train.get(w, 0) + rest.get(w, 0) for w in words], pa.int64()),
            ],
            ["word", "c", "uses"],
        )

    train, rest = Counter(), Counter()
    for batch in batches:
        for text, held in zip(batch.column(0), batch.column(1), strict=True):
            (rest if held.as_py() else train).update(hashing.split_words(text.as_py()))
            if len(train) + len(rest) > _FLUSH:
                yield from out(train, rest)
                train, rest = Counter(), Counter()
    if train or rest:
        yield from out(train, rest)


def _segment(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        counts: Counter = Counter()
        for f in frames:
            words = [bytes(w).decode("utf-8", "replace") for w in f["word"]]
            for pieces, c in zip(sp.encode(words, num_threads=1), f["c"], strict=True):
                for p in pieces:
                    counts[p] += c
        yield pd.DataFrame({"piece": list(counts), "n": list(counts.values())}).astype("int64")

    return run


def _lattices(logs: dict[str, float]):
    longest = max(map(len, logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [w.as_py().decode("utf-8", "replace") for w in b.column(0)]
            lp = pa.array([lattice_log10(w, logs, longest) for w in words], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, lp], ["word", "c", "uses", "lp"])

    return run


def _documents(head):
    """Per row: words, known words, base and lattice sums over head words, and the rest as (word, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = head.value  # word -> (known, log10(c + 1), lattice log10)
        for b in batches:
            n, known, logs, lps, rest, ends, times = [], [], [], [], [], [0], []
            for text in b.column(1):
                words = hashing.split_words(text.as_py())
                k, s, lp = 0, 0.0, 0.0
                left: Counter = Counter()
                for w, m in Counter(words).items():
                    t = table.get(w)
                    if t is None:
                        left[w] = m
                    else:
                        k += m * t[0]
                        s += m * t[1]
                        lp += m * t[2]
                n.append(len(words))
                known.append(k)
                logs.append(s)
                lps.append(lp)
                rest.extend(left)
                times.extend(left.values())
                ends.append(len(rest))
            items = pa.StructArray.from_arrays([pa.array(rest, pa.binary()), pa.array(times, pa.int64())], ["word", "m"])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()),
                 pa.array(lps, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)],
                ["row", "words", "known", "logs", "lps", "rest"],
            )

    return run


def lm_scores(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    folds: int = 7,
    held_fold: int = 2,
    head_words: int = HEAD_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Rows with ``crc32(id as text) % folds == held_fold`` are held out (a null id counts as the empty
    text). Words are runs of other characters than ASCII white space with A-Z lowered, and each text has
    one end token; a null text is empty and has only that. ``base_score`` is the add-one unigram score
    over words, ``score`` the lattice log10 probability. Rows that repeat an id are scored one by one.
    With no training rows all counts are 0. Other columns are not read.
    """
    spark = docs.sparkSession
    held = F.crc32(id_text(id_col).cast("binary")) % folds == held_fold
    rows = docs.select(
        F.col(id_col).alias("id"), held.alias("held_out"), text_or_empty(text_col).cast("binary").alias("text")
    )
    counts = in_arrow(rows.select("text", "held_out"), _word_counts, "word binary, c long, uses long")
    counts = shared_table(counts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("uses").alias("uses")), "counts")
    ends = rows.where(~F.col("held_out")).count()
    t = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n_train, distinct = t[0] + ends, t[1] + (ends > 0)
    log_base = math.log10(n_train + distinct + 1)  # N + 1 * (V + 1)

    ids = load_pieces(tokenizer)
    pieces = counts.where("c > 0").select("word", "c").mapInPandas(_segment(tokenizer), "piece long, n long")
    weight = np.ones(max(ids.values()) + 1)
    for r in pieces.groupBy("piece").agg(F.sum("n").alias("n")).collect():  # a row per vocabulary entry at most
        weight[r["piece"]] += r["n"]
    mass = sum(weight[i] for i in ids.values()) + ends + 1
    logs = {piece: math.log(weight[i] / mass) for piece, i in ids.items()}
    end_lp = math.log10((ends + 1) / mass)

    words = shared_table(in_arrow(counts, _lattices(logs), "word binary, c long, uses long, lp double"), "words")
    top = words.orderBy(F.desc("uses"), "word").limit(head_words).select("word", "c", "lp").toArrow()
    head = spark.sparkContext.broadcast(
        {w: (int(c > 0), math.log10(c + 1), lp) for w, c, lp in zip(*(top.column(i).to_pylist() for i in range(3)), strict=True)}
    )

    # a row number of this run's own, since ids may repeat: the sums below meet their row again by it
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text")
    part = in_arrow(
        numbered.select(F.struct("row", "id", "held_out").alias("row"), "text"),
        _documents(head),
        f"row struct<row:long,id:{docs.schema[id_col].dataType.simpleString()},held_out:boolean>, words long, known long,"
        " logs double, lps double, rest array<struct<word:binary,m:long>>",
    )
    part = shared_table(part, "documents")
    tail = part.select("row.row", F.explode("rest").alias("r")).select("row", "r.word", "r.m")
    known = words.select("word", "c", "lp")
    tail = tail.join(known, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("t_known"),
        F.sum(F.col("m") * F.log10(F.col("c") + 1)).alias("t_logs"),
        F.sum(F.col("m") * F.col("lp")).alias("t_lps"),
    )
    n_tokens = F.col("words") + 1
    or0 = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        part.select("row.*", "words", "known", "logs", "lps")
        .join(tail, "row", "left")
        .select(
            F.col("id").alias(id_col),
            "held_out",
            n_tokens.alias("n_tokens"),
            (F.col("known") + or0("t_known") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
            F.lit(n_train).cast("long").alias("train_tokens"),
            (F.col("logs") + or0("t_logs") + F.lit(math.log10(ends + 1)) - n_tokens * F.lit(log_base)).alias("base_score"),
            (F.col("lps") + or0("t_lps") + F.lit(end_lp)).alias("score"),
        )
    )
