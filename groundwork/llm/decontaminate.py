"""Benchmark decontamination by greedy string tiling.

A document is contaminated by a benchmark item when tiles cover enough of the item. Tiles are common
word sequences of at least ``LEAST`` words, taken longest first; each word of the item and of the document
belongs to one tile at most, so passages in another order still count while one phrase that repeats
does not count twice. An item shorter than ``LEAST`` words is matched as a whole and its hits are
reported, but it cannot be tested: an answer like "Paris" stands in many clean texts. A hit of such an
item does not contaminate a document by itself (``contaminating``, ``untestable``).

Seeds come from running Karp-Rabin hashes: the windows of the items are a hash index, the windows of a
document are looked up in it and equal windows are compared word by word. Neighbouring seeds on one
diagonal are a maximal match.

The benchmark is the small side: it is cut by hash into blocks of about ``BLOCK_BYTES`` of text, each of
which is broadcast in turn; at most ``BLOCKS_LIVE`` indexes are live at a time, after which the documents are written with
what was found so far. The documents stream through these blocks in one scan and are never
shuffled, so a passage that a third of them share costs no more than any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import in_arrow, shared_table, text_or_empty

LEAST = 5
COVERAGE = 0.6
BLOCK_BYTES = 8 << 20
BLOCKS_LIVE = 4
_WORDS = re.compile(r"\w+")
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)


def hit_type(kind: T.DataType) -> T.ArrayType:
    """Type of the hits of items whose ids are of ``kind``."""
    fields = [("item_id", kind), ("coverage", T.DoubleType()), ("tiles", T.IntegerType()), ("words", T.IntegerType())]
    return T.ArrayType(T.StructType([T.StructField(*f) for f in fields]))


def contaminating(leaks: str = "leaks", least: int = LEAST) -> Column:
    """The hits of items that contaminate by themselves: of ``least`` words or more."""
    return F.filter(leaks, lambda x: x["words"] >= least)


def untestable(leaks: str = "leaks", least: int = LEAST) -> Column:
    """The hits of items too short to tell a leak from common words."""
    return F.filter(leaks, lambda x: x["words"] < least)


def words_of(text: str) -> list[str]:
    """Words without punctuation, in lower case."""
    return _WORDS.findall(text.lower())


_held = np.ones((2, 1), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the base's inverse and of the base; kept for the next text."""
    global _held
    if _held.shape[1] < n:
        steps = np.repeat(np.array([[_INVERSE], [_BASE]], dtype=np.uint64), 2 * n, axis=1)
        steps[:, 0] = 1
        _held = np.cumprod(steps, axis=1, dtype=np.uint64)
    return _held[:, :n]


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``width`` word numbers (modulo 2**64).

    It runs along the words: a window's hash is the difference of two running sums, whose terms carry the base's
    inverse powers, brought to the window's place.
    """
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    down, up = _powers(len(ids))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * down, dtype=np.uint64)])
    return (sums[width:] - sums[:-width]) * up[width - 1 :]


class Index:
    """Window index of a block of items: word numbers, and for each window length in use sorted hashes."""

    def __init__(self, items: list[tuple[int | None, str]], least: int):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        starts: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if len(words) < (least if item_id is None else 1):
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.uint64)
            starts.setdefault(min(least, len(ids)), []).append((len(self.items), ids))
            self.items.append((item_id, ids))
        self.windows = {}
        for width, group in starts.items():
            h = np.concatenate([rolling(ids, width) for _, ids in group])
            at = np.concatenate([np.arange(len(ids) - width + 1) for _, ids in group])
            item = np.repeat([k for k, _ in group], [len(ids) - width + 1 for _, ids in group])
            order = np.argsort(h, kind="stable")
            self.windows[width] = (h[order], order, item, at)  # hashes in order, and where each lies item by item
        self.lengths = np.array([len(ids) for _, ids in self.items], dtype=np.int64)

    def seeds(self, ids: np.ndarray, threshold: float = 0.0) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
        """Per item: window length, and the places of equal windows in the document and in the item.

        Only items that the windows found can cover to ``threshold`` are listed: each window of an item is looked up
        once, however often the document holds it, so a phrase that many items share costs one entry per item.
        """
        out = {}
        for width, (hashes, order, item, at) in self.windows.items():
            h = rolling(ids, width)
            if not len(h):
                continue
            places = np.flatnonzero(np.convolve(ids == 0, np.ones(width, int), "valid") == 0)
            places = places[np.argsort(h[places], kind="stable")]
            met = h[places]
            kinds = met[np.append(True, met[1:] != met[:-1])] if len(met) else met
            lo, hi = np.searchsorted(hashes, kinds), np.searchsorted(hashes, kinds, side="right")
            count = hi - lo
            w = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            if not len(w):
                continue
            entries = np.sort(order[w])  # windows of the items that the document holds, item by item
            k, q = item[entries], at[entries]
            first = np.append(True, k[1:] != k[:-1])
            # words that these windows cover: each adds what lies behind the one before
            fresh = np.where(first, width, np.minimum(width, np.diff(q, prepend=0)))
            starts = np.flatnonzero(first)
            covered = np.add.reduceat(fresh, starts)
            stops = np.append(starts[1:], len(k))
            for i in np.flatnonzero(covered / self.lengths[k[starts]] >= threshold).tolist():
                one, own = int(k[starts[i]]), q[starts[i] : stops[i]]
                words = self.items[one][1]
                wanted = rolling(words, width)[own]
                a, b = np.searchsorted(met, wanted), np.searchsorted(met, wanted, side="right")
                n = b - a
                pk = places[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                qk = np.repeat(own, n)
                same = np.ones(len(pk), bool)
                for j in range(width):
                    same &= ids[pk + j] == words[qk + j]
                if same.any():
                    out[one] = (width, pk[same], qk[same])
        return out


def greedy_tiles(width: int, p: np.ndarray, q: np.ndarray, n_doc: int, n_item: int) -> list[tuple[int, int, int]]:
    """Tiles ``(place in document, place in item, length)`` from seeds of ``width`` words."""
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(p) != 1) | (np.diff(p - q) != 0)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(p))) + width - 1
    matches = list(zip(length.tolist(), p[first].tolist(), q[first].tolist(), strict=True))
    in_doc, in_item = np.zeros(n_doc, bool), np.zeros(n_item, bool)
    tiles = []
    while matches:
        size, a, b = min(matches, key=lambda m: (-m[0], m[2], m[1]))
        tiles.append((a, b, size))
        in_doc[a : a + size] = True
        in_item[b : b + size] = True
        left = []
        for n, x, y in matches:  # what the new tile leaves of each match
            free = ~(in_doc[x : x + n] | in_item[y : y + n])
            if free.all():
                left.append((n, x, y))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
            left += [(e - s, x + s, y + s) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if e - s >= width]
        matches = left
    return tiles


def hits(text: str, index: Index, threshold: float) -> list[dict]:
    """Items of a block that the text's tiles cover to ``threshold`` at least."""
    get = index.vocabulary.get
    ids = np.array([get(w, 0) for w in words_of(text)], dtype=np.uint64)
    out = []
    for k, (width, p, q) in index.seeds(ids, threshold).items():
        item_id, item = index.items[k]
        reach = np.zeros(len(item), bool)  # no tiling covers more than all seeds together
        for j in range(width):
            reach[q + j] = True
        if reach.mean() >= threshold:
            tiles = greedy_tiles(width, p, q, len(ids), len(item))
            coverage = sum(t[2] for t in tiles) / len(item)
            if coverage >= threshold:
                out.append({"item_id": item_id, "coverage": coverage, "tiles": len(tiles), "words": len(item)})
    return out


def by_coverage(hit: dict) -> tuple:
    """Order of the hits of a document: coverage descending, then item id, hits without an id last."""
    return -hit["coverage"], hit["item_id"] is None, hit["item_id"] if hit["item_id"] is not None else 0, hit["tiles"]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    b = benchmark.select(F.col(item_col).alias("item"), text_or_empty(text_col).alias("text"))
    total = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = total // BLOCK_BYTES + 1
    for k in range(n):
        yield [tuple(r) for r in b.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).orderBy("item", "text").collect()]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = COVERAGE,
    least: int = LEAST,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``leaks``: an array of (item_id, coverage, tiles, words), by coverage descending then item id.

    ``words`` is the item's length; ``contaminating`` picks the hits that count, ``untestable`` the others.

    The array is empty for clean documents, among them null and empty texts. Benchmark items without an
    id are matched like others and reported with a null item id, behind equal coverages; of fewer than
    ``least`` words they are left out. Items without words match nothing; items that repeat an id, or lack
    one, are matched one by one.
    Item ids are of any type and keep it. Repeated documents are rows like others. A column ``leaks`` (in any case) of the input is replaced.
    """
    spark = docs.sparkSession
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "leaks"])
    at, last = docs.columns.index(text_col), len(docs.columns)
    hit = hit_type(benchmark.schema[item_col].dataType)
    arrow_hit = to_arrow_type(hit)
    out = docs.withColumn("leaks", F.array().cast(hit))
    schema = T.StructType([*docs.schema.fields, T.StructField("leaks", hit)])
    live = []
    for items in _blocks(benchmark, item_col, item_text_col):
        if len(live) == BLOCKS_LIVE:  # what the blocks so far found is written, and their indexes go
            out = shared_table(out, "leaks")
            while live:
                live.pop().unpersist()
        shared = spark.sparkContext.broadcast(Index(items, least))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                found = [
                    sorted(old.as_py() + hits(t.as_py() or "", index, threshold), key=by_coverage)
                    for t, old in zip(b.column(at), b.column(last), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*b.columns[:last], pa.array(found, arrow_hit)], b.schema.names)

        live.append(shared)
        out = in_arrow(out, run, schema)
    return out
