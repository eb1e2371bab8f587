"""Token-id files in Simple-8b words.

``write_token_files`` tokenises documents in the order of their ids and writes them; ``read_documents`` and
``token_table`` read such files back. Files are written through Spark's text sink (one record a line, lines
ended by the eight bytes ``END``), so they lie on any file system that Spark can reach and only whole task
outputs are ever seen; they are read through its binary reader.

A file is a run of records, everything in little-endian 64-bit units. A record holds whole documents:

    magic, shard, number in shard, documents, ids, blocks, words, escapes      (8 units)
    document ids; bits that tell present ids from nulls; end of each document in the record's ids
    word offset of each block; escape offset of each block                      (``simple8b``)
    words; escapes (32 bits each, filled up to a whole unit)

Shards and numbers in shard ascend with the documents, so sorting records by both gives the global order.

Plan: one range exchange of the texts by (id, hash of the text), so that rows that share an id or have none
spread too; each task sorts externally, tokenises steps of ``STEP`` bytes of text and closes a record at ``RECORD_IDS`` ids.
Files end after ``RECORDS`` records, whatever the partition's size. Reading is one task per few files;
places in the whole run come from record totals in two levels (along a shard, then over the shards, of
which there are as many as partitions). A lost executor repeats its tasks; no state is kept elsewhere.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.session import ensure_checkpoint_dir

from . import simple8b
from .common import in_arrow, shared_table, text_or_empty
from .segments import Pieces, Whole, byte_level_cuts, byte_of_symbol, joined_pieces

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
END = "\nS8BEND\n"
MAGIC = int.from_bytes(b"S8BIDS01", "little")
HEADER = 8
RECORD_IDS = 1 << 18
RECORDS = 32
STEP = 1 << 23  # bytes of text that are encoded at a time
TOGETHER = 2000  # distinct pieces that are encoded as one text


class Encoder:
    """Ids of texts by a ``tokenizers`` file, without special tokens, as 32-bit little-endian numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if byte_level_cuts(path) and not any(c.isspace() for t in added for c in t):
            symbols = byte_of_symbol()
            vocabulary = self.tokenizer.get_vocab()
            self.length = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # of each id, in bytes
            for token, i in vocabulary.items():
                self.length[i] = len(token) if all(c in symbols for c in token) else len(token.encode())
            self.of = Pieces(self._pieces, added)
        else:
            self.of = Whole(self._texts, spaced=False)

    def _texts(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and how many each has. Pieces that may follow one another are encoded as texts of many and cut apart by their bytes."""
        counts = np.zeros(len(pieces), np.int64)
        inner, joined, front = joined_pieces(pieces)
        sizes = pc.binary_length(joined).to_numpy()
        found = []
        for i in range(0, len(inner), TOGETHER):
            size = sizes[i : i + TOGETHER]
            text = pc.binary_join(pa.array([joined.slice(i, TOGETHER)], pa.list_(pa.binary())), b"")[0].as_py().decode()
            ids = np.frombuffer(self._texts([text])[0], dtype="<u4")
            ends, stops = np.cumsum(self.length[ids]), np.cumsum(size)
            start = np.searchsorted(ends, stops - size + front[i : i + TOGETHER], "right")
            stop = np.searchsorted(ends, stops, "right")
            counts[inner[i : i + TOGETHER]] = stop - start
            steps = np.zeros(len(ids) + 1, np.int64)
            steps[start] += 1
            steps[stop] -= 1
            found.append(ids[np.cumsum(steps[:-1]) > 0])
        outer = np.setdiff1d(np.arange(len(pieces)), inner)
        alone = [np.frombuffer(b, dtype="<u4") for b in self._texts(pieces.take(pa.array(outer)).cast(pa.string()).to_pylist())]
        counts[outer] = [len(a) for a in alone]
        if not len(outer):
            return np.concatenate([np.empty(0, np.uint32), *found]), counts
        ids = np.empty(counts.sum(), np.uint32)
        of_inner = np.ones(len(pieces), bool)
        of_inner[outer] = False
        of_inner = np.repeat(of_inner, counts)
        ids[of_inner], ids[~of_inner] = np.concatenate([np.empty(0, np.uint32), *found]), np.concatenate(alone)
        return ids, counts

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (Arrow strings without nulls), one text after another, and where each text's ids end."""
        if isinstance(self.of, Pieces):
            return self.of(texts.cast(pa.string()))
        parts = [b"".join(p) for p in self.of(texts.to_pylist())]
        return np.frombuffer(b"".join(parts), dtype="<u4"), np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        ids, ends = self.flat(pa.array(texts, pa.string()).fill_null(""))
        return np.split(ids, ends)[:-1]


_encoders: dict[str, Encoder] = {}  # a worker serves many tasks


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _units(a: np.ndarray) -> bytes:
    """Bytes of ``a`` filled up with zeros to whole 64-bit units."""
    b = a.tobytes()
    return b + bytes(-len(b) % 8)


def pack_record(shard: int, number: int, doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    words, escapes, word_at, escape_at = simple8b.encode(flat)
    head = np.array([MAGIC, shard, number, len(ids), len(flat), len(word_at), len(words), len(escapes)], dtype="<i8")
    return b"".join(
        [
            head.tobytes(),
            np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
            _units(np.packbits(np.array([d is not None for d in doc_ids], dtype=bool), bitorder="little")),
            np.cumsum([len(i) for i in ids], dtype="<i8").tobytes(),
            word_at.astype("<i8").tobytes(),
            escape_at.astype("<i8").tobytes(),
            words.astype("<u8").tobytes(),
            _units(escapes.astype("<u4")),
        ]
    )


class Record:
    """A record of a file's content, its arrays views of that content."""

    def __init__(self, content: bytes, at: int):
        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(content, dtype=kind, count=n, offset=at)
            at += -(-a.nbytes // 8) * 8
            return a

        magic, self.shard, self.number, docs, self.n_ids, blocks, n_words, n_escapes = take("<i8", HEADER).tolist()
        if magic != MAGIC:
            raise ValueError("not a token-id record")
        self.doc_ids = take("<i8", docs)
        self.present = np.unpackbits(take("<u1", -(-docs // 8)), count=docs, bitorder="little").astype(bool)
        self.ends = take("<i8", docs)
        self.word_at, self.escape_at = take("<i8", blocks), take("<i8", blocks)
        self.words, self.escapes = take("<u8", n_words), take("<u4", n_escapes)
        if content[at : at + len(END)] != END.encode():
            raise ValueError("a token-id record does not end where it should")
        self.next = at + len(END)

    def ids(self) -> np.ndarray:
        return simple8b.decode(self.words, self.escapes, self.word_at, self.escape_at, self.n_ids)

    def document(self, i: int) -> np.ndarray:
        """Ids of one document; only its own blocks are decoded."""
        start = int(self.ends[i - 1]) if i else 0
        return simple8b.ids_between(
            self.words, self.escapes, self.word_at, self.escape_at, self.n_ids, start, int(self.ends[i])
        )


def records(content: bytes) -> Iterator[Record]:
    at = 0
    while at < len(content):
        r = Record(content, at)
        yield r
        at = r.next


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The rows of ``batches`` anew, as many at a time as hold about ``STEP`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(batch):
            before = int(ends[at - 1]) if at else 0
            stop = min(int(np.searchsorted(ends, before + STEP - size)) + 1, len(batch))
            held.append(batch.slice(at, stop - at))
            size += int(ends[stop - 1]) - before
            at = stop
            if size >= STEP:
                yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
                held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))


def _packed(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, number = encoder(path), TaskContext.get().partitionId(), 0
        doc_ids, ids, held = [], [], 0
        for ds, texts in _steps(batches):
            flat, ends = encode.flat(texts)
            sizes = np.diff(ends, prepend=0) + 1  # with the end id
            closed, ds, at = np.cumsum(sizes), ds.to_pylist(), 0
            while at < len(ends):
                before = int(closed[at - 1]) if at else 0
                stop = min(int(np.searchsorted(closed, before + RECORD_IDS - held)) + 1, len(ends))
                start = before - at
                part = np.insert(flat[start : ends[stop - 1]], ends[at:stop] - start, np.uint32(end_id))
                doc_ids += ds[at:stop]
                ids += np.split(part, closed[at : stop - 1] - before)
                held += len(part)
                at = stop
                if held >= RECORD_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([pack_record(shard, number, doc_ids, ids)])], ["record"])
                    doc_ids, ids, held, number = [], [], 0, number + 1
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([pack_record(shard, number, doc_ids, ids)])], ["record"])

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str = TOKENIZER,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the token ids of ``docs`` as files under ``path``, documents in ascending order of ids.

    Each document's ids are followed by ``end_id``; a null or empty text has only that. Strings of special
    tokens in a text are encoded as the tokenizer does by itself. Ids of documents are integers; null ids
    stand first, and rows that repeat an id stay rows of their own, in the order of their text's hash.
    An empty table gives no record. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    placed = rows.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash").select("id", "text")
    packed = in_arrow(placed, _packed(tokenizer, end_id), "record binary")
    # bytes go to the sink as they are: a cast to string checks and changes nothing
    packed.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option(
        "maxRecordsPerFile", RECORDS
    ).text(path)


def _documents(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for r in records(content.as_py()):
                    raw = memoryview(r.ids().astype("<u4", copy=False)).cast("B")
                    ends = (4 * r.ends).tolist()
                    parts = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                    n_tokens = np.diff(r.ends, prepend=0)
                    columns = [
                        pa.array([r.shard] * len(ends), pa.int64()),
                        pa.array([r.number] * len(ends), pa.int64()),
                        pa.array(r.doc_ids, pa.int64(), mask=~r.present),
                        pa.array(r.ends - n_tokens, pa.int64()),
                        pa.array(n_tokens, pa.int64()),
                        pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([bytes(p) for p in parts], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, _COLUMNS[: len(columns)])

    return run


_COLUMNS = ["shard", "number", "id", "at", "n_tokens", "ids_crc32", "ids"]
_READ = "shard long, number long, id long, at long, n_tokens long, ids_crc32 long"


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: ``shard, number, id, at, n_tokens, ids_crc32, ids``.

    ``shard, number`` are its record, ``at`` is its place there, ``ids`` are 32-bit little-endian numbers
    and ``ids_crc32`` is their unsigned CRC; without ``with_ids`` that last column is left out. All ids are
    decoded either way. A damaged record raises an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return in_arrow(files, _documents(with_ids), _READ + ", ids binary" * with_ids)


def token_table(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start, n_tokens, ids_crc32`` of every document in the files; ``start`` counts all ids before it."""
    read = shared_table(read_documents(spark, path, with_ids=False), "token-table")
    totals = read.groupBy("shard", "number").agg(F.sum("n_tokens").alias("n"))
    before = Window.unboundedPreceding
    along = Window.partitionBy("shard").orderBy("number").rowsBetween(before, -1)
    over = Window.orderBy("shard").rowsBetween(before, -1)  # one row per partition written
    shards = totals.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("shard_start"))
    starts = totals.select("shard", "number", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("record_start"))
    starts = starts.join(shards, "shard").select("shard", "number", (F.col("shard_start") + F.col("record_start")).alias("before"))
    return read.join(starts, ["shard", "number"]).select(
        F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def scratch_path(spark: SparkSession) -> str:
    """A new folder for files in the shared scratch space."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/groundwork-llm/{uuid.uuid4().hex}/token-files"
