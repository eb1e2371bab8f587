"""Alignment of two tokenizers against a plain byte-by-byte version."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from groundwork.llm import segments, token_align
from groundwork.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(40_000))
ODD = [
    (5, "a plain text"), (None, None), (2, ""), (2, "  two  spaces \n\n and\tlines   x "), (9, LONG), (2, "  two  spaces \n\n and\tlines   x "),
    (-4, "né 中文。 \U0001f9ff x<|endoftext|> y <s> <0x0A> </s>"), (3, "marks ▁ in text"), (None, "no id"), (7, " \t\r\n "), (8, "\U0001f9ff\U0001f9ff  中　中 é"),
    (6, "same word same word"), (10, "ﬁ x"), (11, "zero\x00byte"),
]


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(token_align.BYTE_LEVEL)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=token_align.PIECES)
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.symbol = {chr(b): b for b in shown}
        self.symbol |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def byte(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        raw = (" " + text).encode()
        a = [(i, bytes(self.symbol[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, self.byte(i)) for i in self.b.encode(text)]
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            return [], []
        return a, b


def owners(tokens):
    """Token place at every byte."""
    return [k for k, (_, x) in enumerate(tokens) for _ in x]


def brute(rows):
    plain, docs, counts = Plain(), [], Counter()
    for d, t in rows:
        a, b = plain.tokens(t)
        links = sorted(set(zip(owners(a), owners(b), strict=True)))
        pairs = [(a[i][0], b[j][0]) for i, j in links]
        counts.update(pairs)
        ends = set(np.cumsum([len(x) for _, x in a])) & set(np.cumsum([len(x) for _, x in b]))
        groups, at = [], 0
        for e in sorted(ends):
            side = lambda ts: ",".join(str(i) for (i, _), stop in zip(ts, np.cumsum([len(x) for _, x in ts]), strict=True) if at < stop <= e)  # noqa: B023, E731
            groups.append(side(a) + "|" + side(b))
            at = e
        docs.append((d, len(a), len(b), groups, pairs))
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return [
        (d, na, nb, len(g), len(p), sum(counts[x] == top[x[1]] for x in p), sum(counts[x] for x in p),
         hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, na, nb, g, p in docs
    ]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_odd_rows_by_broadcast_and_by_shuffle(spark):
    df = spark.createDataFrame([(d, t, 1, "y") for d, t in ODD], "doc_id long, text string, row int, pair string")
    want = Counter(brute([r for r in ODD if r[1] != LONG]))
    few = df.where("doc_id <> 9 OR doc_id IS NULL")
    for bound in (token_align.BROADCAST_PAIRS, 0):
        out = token_align.align(few, broadcast_pairs=bound)
        assert out.columns == COLUMNS and Counter(map(tuple, out.collect())) == want
    long = token_align.align(df).where("doc_id = 9").first()
    assert long.n_a > 40_000 and long.n_links >= long.n_groups > 30_000
    assert token_align.align(df.limit(0)).collect() == []


def test_query_against_the_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000 OR text IS NULL").select("doc_id", "text").collect()]
    got = token_align.align(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(rows) > 150 and sorted(map(tuple, got)) == sorted(brute(rows))
    whole = QUERIES["op12_token_align"](spark, SF)
    assert whole.columns == COLUMNS and whole.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_lookups_change_nothing(spark):
    texts = [t for _, t in ODD] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    by_segment = token_align.Aligner(token_align.BYTE_LEVEL, token_align.PIECES)
    whole = token_align.Aligner(token_align.BYTE_LEVEL, token_align.PIECES)
    whole.of = token_align.Whole(lambda parts: [whole.align([p])[0] for p in parts], spaced=True)
    for x, y in zip(by_segment.documents(texts), whole.documents(texts), strict=True):
        assert x[:4] == y[:4] and (x[4] == y[4]).all() and (x[5] == y[5]).all()


def test_a_full_store_keeps_words_met_again():
    asked, often = [], [f"c{i}" for i in range(16)]
    of = segments.Lookup(lambda parts: asked.extend(parts) or parts, spaced=True, most=64, keep=True)
    for i in range(100):
        words = often + [f"r{i}x{j}" for j in range(8)]
        assert of([" ".join(words)]) == [[" " + w for w in words]] and len(of.held) <= 64
    assert [asked.count(" " + w) for w in often] == [1] * 16 and len(asked) == 816


def test_a_changed_segment_is_found_by_halving():
    aligner, calls = token_align.Aligner(token_align.BYTE_LEVEL, token_align.PIECES), []
    align = aligner.align
    aligner.align = lambda parts: calls.append(len(parts)) or align(parts)
    words = [f"w{i}" for i in range(token_align._CHUNK)]
    words[77] = "x\u2581y"
    (odd,), (plain,) = aligner.documents([" ".join(words)]), aligner.documents([" ".join(words[78:])])
    assert odd[:4] == (0, 0, 0, "") and plain[0] > 300 and len(calls) < 30


@pytest.mark.parametrize("spans, lengths, lead, want", [
    ([(0, 3), (3, 4)], [3, 1], 0, [3, 4]),
    ([(0, 0), (0, 3), (3, 3), (3, 3), (3, 6)], [1, 3, 1, 1, 1], 1, [1, 4, 5, 6, 7]),  # byte fallback, the space in front added
    ([(0, 1), (1, 3), (1, 3), (3, 5)], [1, 1, 1, 2], 0, [1, 2, 3, 5]),  # two tokens share a character
    ([(0, 2), (4, 6)], [2, 4], 0, [2, 6]),  # spaces left out in front
    ([(0, 0), (2, 3)], [2, 1], 0, [2, 3]),
])
def test_refining(spans, lengths, lead, want):
    assert token_align.coarse_and_refined(np.array(spans), np.array(lengths), lead).tolist() == want
