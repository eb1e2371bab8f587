"""Alignment of two tokenizers over the same texts, with corpus-wide counts of linked ids.

Tokenizer A is a byte-level BPE of the ``tokenizers`` library and sees space+text; B is a sentencepiece model
and sees the text, to which it adds that space itself.

Spans come from the tokenizers: A's character offsets and the spans of B's proto are the coarse ends of tokens,
wherever a span is not empty and does not reach into the next one. The others are refined with decoded
bytes, counted on from the last coarse end: tokens that share a multibyte character, byte-fallback tokens (the proto
gives the whole character to the last of them), and spaces that A's offsets leave out or B adds. A text whose joined
token bytes are not space+text has no tokens.

Offsets where A and B tokens both end cut them into groups; an A and a B token are linked where their bytes
overlap. Texts are cut where both tokenizers start anew whatever stands before (``segments``), which is a
group's end too, so each distinct segment is aligned once per worker and looked up after.

Plan: one pass over the texts gives a row per document with its linked id pairs, each once with its number of
links (written to the shared folder). Pair counts are a partial aggregate, at most one row per pair of ids that
ever meet. Documents meet them again through a join on the pair, whose result is summed per document: by broadcast where the
table of pairs has at most ``BROADCAST_PAIRS`` rows (it is bounded by the vocabularies, not by the corpus), else by
shuffle, with the same result.
"""

from __future__ import annotations

import gc
import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, shared_table, text_or_empty
from .segments import Lookup, Whole, byte_level_cuts, byte_of_symbol, joinable, piece_cuts

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BROADCAST_PAIRS = 1_000_000  # about 80 MB
_CHUNK = 512
SPACE = "▁"
_PAIR = 32  # an id pair is one number: A's id above B's 32 bits


def coarse_and_refined(spans: np.ndarray, lengths: np.ndarray, lead: int) -> np.ndarray:
    """End of each token in bytes, from spans ``(begin, end)`` in bytes and from lengths of decoded bytes.

    A span's end is taken as it is where the span is not empty, ends behind all earlier ones and does not reach into
    the next; any other end is counted on from the last end taken, by lengths. ``lead`` is the number of bytes in
    front of the text that the spans are measured in.
    """
    n = len(lengths)
    if n == 0:
        return np.empty(0, np.int64)
    begin, end = spans[:, 0], spans[:, 1]
    reach = np.concatenate([[0], np.maximum.accumulate(end)[:-1]])
    following = np.append(begin[1:], end[-1])
    coarse = (begin < end) & (end > reach) & (begin >= reach) & (end <= following)
    total = np.cumsum(lengths)
    # last coarse token at or before each one; before the first, counting starts at the front
    last = np.maximum.accumulate(np.where(coarse, np.arange(n), -1))
    anchor = np.where(last >= 0, end[last] + lead, 0)
    return anchor + total - np.where(last >= 0, total[last], 0)


class Aligner:
    """Alignments of texts with a space in front, segment by segment."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        symbols = byte_of_symbol()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in symbols for c in token)
            self.bytes_a[i] = bytes(symbols[c] for c in token) if known else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)
        ]
        self.length_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        # ids as text, each inside and at the end of its side of a group
        self.text = [f"{i}{mark}" for i in range(len(self.bytes_a)) for mark in ",|"]
        self.text += [f"{i}{mark}" for i in range(len(self.bytes_b)) for mark in ",;"]
        if byte_level_cuts(byte_level) and piece_cuts(names):
            self.of = Lookup(self._segments, spaced=True, most=1 << 19, keep=True)
        else:
            self.of = Whole(lambda parts: [self.align([p])[0] for p in parts], spaced=True)

    def _segments(self, parts: list[str]) -> list[tuple]:
        """Segments that stand between others are aligned many at a time."""
        inner, chunks = [], []
        for i, p in enumerate(parts):
            if joinable(p):
                inner.append(i)
            else:
                chunks.append([i])
        chunks += [inner[i : i + _CHUNK] for i in range(0, len(inner), _CHUNK)]
        out: list = [None] * len(parts)
        for chunk in chunks:
            if [parts[i] for i in chunk] == [" "]:  # a text's last space; B makes nothing of an empty text
                out[chunk[0]] = self.align([" a", " "])[1]
                continue
            for i, value in zip(chunk, self.align([parts[i] for i in chunk]), strict=True):
                out[i] = value
        return out

    def align(self, parts: list[str]) -> list[tuple]:
        """For segments that make up one text with a space in front: ``(n_a, groups, pairs)`` each.

        ``groups`` is text, empty where a tokenizer changes the segment; ``pairs`` are the linked id pairs, A's id in the
        upper half, one 64-bit number a link. Segments that stand with a changed one are halved until it stands alone.
        """
        text = "".join(parts)
        raw = text.encode()
        encoding = self.a.encode(text, add_special_tokens=False)
        proto = self.b.encode(text[1:], return_type="proto").pieces
        ids_a = encoding.ids
        ids_b, begin_b, stop_b = zip(*[(p.id, p.begin, p.end) for p in proto], strict=True) if len(proto) else ((), (), ())
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != raw or b"".join(map(self.bytes_b.__getitem__, ids_b)) != raw:
            half = len(parts) // 2
            return self.align(parts[:half]) + self.align(parts[half:]) if half else [(0, "", b"")]
        spans_a = np.fromiter(chain.from_iterable(encoding.offsets), np.int64, 2 * len(ids_a)).reshape(-1, 2)
        wide = len(raw) != len(text)
        if wide:  # characters to bytes
            code = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
            width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
            spans_a = np.concatenate([[0], np.cumsum(width)])[spans_a]
        spans_b = np.array([begin_b, stop_b], np.int64).T
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        end_a = coarse_and_refined(spans_a, self.length_a[ids_a], 0)
        end_b = coarse_and_refined(spans_b, self.length_b[ids_b], 1)
        last_a, last_b, place_a, place_b = grouped(end_a, end_b)
        which = np.empty(len(ids_a) + len(ids_b), np.int64)
        which[place_a] = 2 * ids_a + last_a
        which[place_b] = 2 * (len(self.bytes_a) + ids_b) + last_b
        tokens = list(map(self.text.__getitem__, which.tolist()))
        at_a, at_b = linked(end_a, end_b)
        pairs = (ids_a[at_a] << _PAIR | ids_b[at_b]).astype("<i8").tobytes()

        ends = np.cumsum([len(p.encode()) for p in parts] if wide else [len(p) for p in parts])
        stop_a = np.searchsorted(end_a, ends, "right")
        stops = (stop_a, stop_a + np.searchsorted(end_b, ends, "right"), 8 * np.searchsorted(at_a, stop_a))
        out, a, t, k = [], 0, 0, 0
        for a1, t1, k1 in zip(*(x.tolist() for x in stops), strict=True):
            out.append((a1 - a, "".join(tokens[t:t1])[:-1], pairs[k:k1]))
            a, t, k = a1, t1, k1
        return out

    def documents(self, texts: list[str]) -> Iterator[tuple]:
        """For each text, null or empty or not: ``(n_a, n_b, n_groups, groups, pairs, times)``, distinct pairs ascending."""
        for got in self.of(texts):
            n_a, groups, pairs = zip(*got, strict=True) if got else ((), ("",), ())
            if all(groups):
                distinct, times = np.unique(np.frombuffer(b"".join(pairs), dtype="<i8"), return_counts=True)
                text, n = ";".join(groups), sum(n_a)
                n_groups = text.count(";") + 1
                yield n, text.count(",") + 2 * n_groups - n, n_groups, text, distinct, times
            else:
                yield 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)


_aligners: dict[tuple[str, str], Aligner] = {}  # a worker serves many tasks


def aligner(byte_level: str, pieces: str) -> Aligner:
    if (byte_level, pieces) not in _aligners:
        _aligners[byte_level, pieces] = Aligner(byte_level, pieces)
    return _aligners[byte_level, pieces]


def grouped(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups end where tokens of both sides end. Whether each token of A, and of B, is its side's last in a group, and its
    place when groups are written one after the other, A's tokens before B's."""
    cuts = np.intersect1d(end_a, end_b)
    stop_a, stop_b = np.searchsorted(end_a, cuts, "right"), np.searchsorted(end_b, cuts, "right")
    last_a, last_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    last_a[stop_a - 1] = last_b[stop_b - 1] = True
    many_a, many_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
    place_a = np.arange(len(end_a)) + np.repeat(stop_b - many_b, many_a)
    return last_a, last_b, place_a, np.arange(len(end_b)) + np.repeat(stop_a, many_b)


def linked(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B of all overlapping tokens, ascending in A; both sides cover the same bytes.

    The tokens that overlap one of the other side are a run of neighbours, so links are listed run by run.
    """
    start_a = np.concatenate([[0], end_a[:-1]])
    first = np.searchsorted(end_b, start_a, "right")  # first B token that ends behind A's start
    last = np.searchsorted(end_b, end_a, "left")  # the B token that holds A's last byte
    many = last - first + 1
    at_a = np.repeat(np.arange(len(end_a)), many)
    return at_a, np.arange(len(at_a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)


def _rows(byte_level: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, row = aligner(byte_level, pieces).documents, TaskContext.get().partitionId() << 33
        gc.disable()  # nothing here makes cycles, and the collector would go through the store of segments again and again
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                n_a, n_b, n_groups, digest, ends, keys, many = [], [], [], [], [0], [], []
                for a, b, g, groups, pairs, times in documents(part.column(1).to_pylist()):
                    n_a.append(a)
                    n_b.append(b)
                    n_groups.append(g)
                    digest.append(hashlib.sha256(groups.encode()).hexdigest() if g else "")
                    keys.append(pairs)
                    many.append(times)
                    ends.append(ends[-1] + len(pairs))
                items = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(many), pa.int64())], ["pair", "n"]
                )
                rows = pa.array(range(row, row + len(part)), pa.int64())
                row += len(part)
                yield pa.RecordBatch.from_arrays(
                    [rows, part.column(0), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(digest),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)],
                    ["row", "id", "n_a", "n_b", "n_groups", "groups_sha256", "links"],
                )
        gc.enable()

    return run


_SCHEMA = "row long, id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<struct<pair:long,n:long>>"


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, total, best`` of every id pair linked anywhere; ``best`` marks the pairs with the most links of their B id."""
    counts = aligned.select(F.explode("links").alias("l")).groupBy(F.col("l.pair").alias("pair")).agg(F.sum("l.n").alias("total"))
    counts = shared_table(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << _PAIR) - 1))), "pair-counts")
    top = counts.groupBy("b").agg(F.max("total").alias("top"))
    return shared_table(counts.join(top, "b").select("pair", "total", (F.col("total") == F.col("top")).alias("best")), "pairs")


def align(
    docs: DataFrame,
    byte_level: str = BYTE_LEVEL,
    pieces: str = PIECES,
    broadcast_pairs: int = BROADCAST_PAIRS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_links`` are the overlapping token pairs, ``n_best`` those whose id pair is linked corpus-wide as often as any
    other pair of the same B id, ``count_sum`` the sum of the pairs' counts over the links. Strings of special tokens
    are plain text. Null and empty texts, and texts that one of the tokenizers changes, have no tokens: all numbers
    are 0 and ``groups_sha256`` is ''. Rows that repeat an id, or have none, are rows of their own and all count.
    Ids are integers. Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    aligned = shared_table(in_arrow(rows, _rows(byte_level, pieces), _SCHEMA), "aligned")
    counts = pair_counts(aligned)
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    kept = ["row", "id", "n_a", "n_b", "n_groups", "groups_sha256"]
    links = aligned.select(*kept, F.explode_outer("links").alias("l")).select(*kept, "l.pair", "l.n")
    or0 = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = links.join(counts, "pair", "left").groupBy(*kept).agg(
        or0("n").alias("n_links"),
        or0(F.when(F.col("best"), F.col("n"))).alias("n_best"),
        or0(F.col("n") * F.col("total")).alias("count_sum"),
    )
    return sums.select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
