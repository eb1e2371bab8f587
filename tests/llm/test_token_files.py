"""Token-id files: the codec by round trips, files and tables against the tokenizer itself."""

import os
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from groundwork.llm import segments, simple8b, token_files
from groundwork.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(40_000))
ODD = [
    (5, "a plain text"), (None, None), (2, ""), (2, "  two  spaces \n\n and\tlines   x"), (9, LONG), (2, "  two  spaces \n\n and\tlines   x"),
    (-4, "né 中文。 \U0001f9ff▁x <|endoftext|> y"), (None, "no id"), (7, " \t\r\n "), (8, "don't  I'll 123 4 5"), (2**62, "zero\x00byte"),
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(token_files.TOKENIZER)


@pytest.mark.parametrize("top", [2, 255, 50_257, 2**32 - 1])
@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 20_000])
def test_codec_round_trip(n, top):
    rng = np.random.default_rng(n + top % 1000)
    ids = (rng.random(n) ** 6 * top).astype(np.uint32)
    if n:
        ids[rng.integers(0, n, max(1, n // 50))] = top
    words, escapes, word_at, escape_at = simple8b.encode(ids)
    assert (simple8b.decode(words, escapes, word_at, escape_at, n) == ids).all()
    for a, b in [(0, 0), (0, n), (n // 3, n // 2), (max(0, n - 1), n)]:
        assert (simple8b.ids_between(words, escapes, word_at, escape_at, n, a, b) == ids[a:b]).all()
    assert len(words) <= max(n, 0) and len(word_at) == -(-n // simple8b.BLOCK)


def test_codec_is_compact_and_escapes_pay():
    ids = np.full(30_000, 5, np.uint32)
    ids[::500] = 4_000_000_000
    words, escapes, *_ = simple8b.encode(ids)
    assert len(escapes) == 60 and len(words) * 8 < len(ids) * 0.6  # 15 to 20 ids a word in spite of the wide ones


def test_lookups_change_no_tokens(plain, spark):
    texts = [t for _, t in ODD if t] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r.text]
    texts += ["", " ", "a", " a", "a ", "a  b", "\n", "x \n y", "x\t y", "  ", "a\u3000 b", "it 's", "<|endoftext|> <|endoftext|>", "a\x1f b"]
    assert segments.byte_level_cuts(token_files.TOKENIZER)
    encode, whole = token_files.Encoder(token_files.TOKENIZER), [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in encode(texts)] == whole
    assert [i.tolist() for i in encode(texts)] == whole  # all looked up
    encode.of.most = 3
    assert [i.tolist() for t in texts for i in encode([t])] == whole  # emptied time and again
    encode.of = segments.Whole(encode._texts, spaced=False)
    assert [i.tolist() for i in encode(texts)] == whole


ATOMS = [*" \n\t\r'.,!(09azAZ\x00\x1f\x7f\x85\xa0é×\u0301\u3000中。\u0663²\U0001f9ff\U0001d400\ufeff", "'s", "'re", "'S", "<|endoftext|>", "\n\n", " \n", "don't", "<|", "|>"]


@pytest.mark.parametrize("most, longest", [(1 << 19, 64), (20, 3), (0, 64)])
def test_pieces_change_no_tokens(plain, most, longest):
    rng = np.random.default_rng(most + longest)
    texts = ["".join(ATOMS[i] for i in rng.integers(0, len(ATOMS), rng.integers(0, 12))) for _ in range(4000)]
    texts += ["".join(p) for n in range(5) for p in product([" ", "\n", "'", ".", "a", "1", "é", "'s"], repeat=n)]
    encode, whole = token_files.Encoder(token_files.TOKENIZER), [plain.encode(t, add_special_tokens=False).ids for t in texts]
    encode.of.most, encode.of.longest = most, longest
    for i in range(0, 2 * len(texts), 500):
        part = [j % len(texts) for j in range(i, i + 500)]
        assert [g.tolist() for g in encode([texts[j] for j in part])] == [whole[j] for j in part]
        assert len(encode.of.held) <= most


def test_a_known_word_is_looked_up_whatever_stands_around_it():
    encode, asked = token_files.Encoder(token_files.TOKENIZER), []
    compute = encode.of.compute
    encode.of.compute = lambda pieces: (asked.extend(pieces.to_pylist()), compute(pieces))[1]
    encode(["an an oddwordx, or (this) one.\nOddwordy 12 it's"])
    asked.clear()
    encode(["an oddwordx. an oddwordx an oddwordx,\nOddwordy one, or it's 12 (this).\nOddwordy"])
    assert asked == [b")."]


def test_met_again_pieces_stay_when_the_store_is_full():
    encode = token_files.Encoder(token_files.TOKENIZER)
    encode.of.most = 10
    encode(["often word" + " often" * 3])
    encode([" ".join(f"{a}{b}x" for a in "abcd" for b in "efgh")])
    assert encode.of.held.to_pylist() == [b" often"]


def test_steps_keep_every_row_in_order(monkeypatch):
    monkeypatch.setattr(token_files, "STEP", 10)
    rows = [(i, "x" * (i * 7 % 23)) for i in range(100)]
    batches = [pa.RecordBatch.from_pylist([{"id": d, "text": t} for d, t in rows[i : i + 13]], pa.schema([("id", pa.int64()), ("text", pa.string())])) for i in range(0, 100, 13)]
    steps = [list(zip(ds.to_pylist(), ts.to_pylist(), strict=True)) for ds, ts in token_files._steps(iter(batches))]
    assert [r for s in steps for r in s] == rows
    assert all(sum(len(t) for _, t in s[:-1]) < 10 for s in steps) and all(sum(len(t) for _, t in s) >= 10 for s in steps[:-1])


def test_segments_join_to_the_text():
    texts = ["", " ", "a  b c", "\n x y\n z ", "a b"]
    for spaced in (False, True):
        of = segments.Lookup(lambda parts: parts, spaced)
        want = [" " * (spaced and t != "") + t for t in texts]
        assert ["".join(v if " " in v or not i and not spaced else v for i, v in enumerate(p)) for p in of(texts)] == want
    assert of(["a  b c"]) == [[" a", "  b", " c"]]


def brute(plain, rows):
    out = []
    for d, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((d, len(ids), zlib.crc32(ids.tobytes())))
    return out


def test_query_against_the_tokenizer(spark, plain):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op11_token_files"](spark, SF).collect()))
    want, start = [], 0
    for d, n, crc in sorted(brute(plain, docs)):
        want.append((d, start, n, crc))
        start += n
    assert got == want


def test_odd_rows_order_and_random_access(spark, plain, tmp_path):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in ODD], "doc_id long, text string, id string, record string")
    path = str(tmp_path / "ids")
    token_files.write_token_files(df, path)
    got = token_files.token_table(spark, path).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(brute(plain, ODD))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got][:-1]).tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    contents = [open(os.path.join(path, f), "rb").read() for f in sorted(os.listdir(path)) if f.startswith("part-")]
    seen = [r for c in contents for r in token_files.records(c)]
    assert sorted((r.shard, r.number) for r in seen) == [(r.shard, r.number) for r in seen]
    assert all((r.document(i) == np.split(r.ids(), r.ends[:-1])[i]).all() for r in seen for i in range(len(r.ends)))
    with pytest.raises(ValueError):
        list(token_files.records(contents[0][8:]))


def test_records_close_and_files_turn_over(spark, plain, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "RECORD_IDS", 50)
    monkeypatch.setattr(token_files, "RECORDS", 3)
    rows = [(i, " ".join(f"word{j}" for j in range(i % 23))) for i in range(300)]
    path = str(tmp_path / "ids")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = token_files._packed(token_files.TOKENIZER, 7)
    got = [bytes(r.record) for r in docs.coalesce(1).mapInArrow(packed, "record binary").collect()]
    assert [r.doc_ids.tolist() for g in got for r in token_files.records(g + token_files.END.encode())]
    token_files.write_token_files(docs, path, end_id=7)
    table = token_files.token_table(spark, path).orderBy("doc_id").collect()
    assert [r.n_tokens for r in table] == [n for _, n, _ in brute(plain, rows)]
    assert [r.start for r in table] == np.cumsum([0] + [r.n_tokens for r in table][:-1]).tolist()


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_files.token_table(spark, path).collect() == []
