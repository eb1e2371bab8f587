"""Secret scans through a trigram inverted index.

Each rule is a regular expression. A Boolean query over trigrams is derived from its parse tree: every
match must contain the trigrams of its literal runs (AND), alternatives and small character sets give OR.
Only trigrams that occur in some query are indexed. Blocks of documents are indexed in the tasks that
read them: one pass over a block's bytes gives the postings (trigram -> documents of the block), each
rule's query is evaluated by intersecting and uniting postings, and only the candidates are verified
with the regular expression. A rule without mandatory trigrams scans every document. Texts never move.

Trigrams are taken from UTF-8 bytes with A-Z lowered, so an index entry serves both cases.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as rc
import re._parser as rp
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, text_or_empty

BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if ``group`` (0: all of it) has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# Public key formats that the method adds.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("bearer", r"Authorization:\x20*Bearer\x20+[A-Za-z0-9._~+/-]{16,}"),
)

# Queries: True (anything matches), ("and", {queries}), ("or", {queries}) or a trigram.
Query = object
_MOST = 64  # literal alternatives followed at once; beyond that a part is treated as unknown


def _both(a: Query, b: Query) -> Query:
    if a is True or a == b:
        return b
    return a if b is True else ("and", frozenset({a, b}))


def _either(qs: list[Query]) -> Query:
    if not qs or any(q is True for q in qs):
        return True
    return qs[0] if len(set(qs)) == 1 else ("or", frozenset(qs))


def _of_strings(strings: set[str]) -> Query:
    """What texts that contain one of the strings must have."""
    each = []
    for s in strings:
        b = s.lower().encode()
        q: Query = True
        for i in range(len(b) - 2):
            q = _both(q, b[i : i + 3])
        each.append(q)
    return _either(each)


def _walk(tree) -> tuple[Query, set[str] | None]:
    """(query, exact strings or None if they are too many) of a parsed expression."""
    query: Query = True
    run: set[str] = {""}

    def close() -> None:
        nonlocal query, run
        query, run = _both(query, _of_strings(run)), {""}

    exact = True
    for op, arg in tree:
        q: Query = True
        strings: set[str] | None = None
        if op is rc.LITERAL:
            strings = {chr(arg).lower()}
        elif op is rc.IN:
            chars: set[str] | None = set()
            for o, a in arg:
                if o is rc.LITERAL:
                    chars.add(chr(a).lower())
                elif o is rc.RANGE and a[1] - a[0] < 8:
                    chars |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
                else:
                    chars = None
                    break
            strings = chars if chars and len(chars) <= 8 else None
        elif op is rc.SUBPATTERN:
            q, strings = _walk(arg[3])
        elif op is rc.BRANCH:
            parts = [_walk(t) for t in arg[1]]
            if all(p[1] is not None for p in parts):
                strings = set().union(*(p[1] for p in parts))
            else:
                q = _either([p[0] if p[1] is None else _both(p[0], _of_strings(p[1])) for p in parts])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, sub = arg
            sq, ss = _walk(sub)
            if low == high == 1:
                q, strings = sq, ss
            elif low == 0 and high == 1 and ss is not None:
                strings = ss | {""}
            elif low == high and ss is not None and len(ss) == 1:
                strings = {next(iter(ss)) * low}
            elif low >= 1:
                q = sq if ss is None else _both(sq, _of_strings(ss))
        if strings is not None and len(run) * len(strings) <= _MOST:
            run = {a + b for a in run for b in strings}
            query = _both(query, q)
        else:
            exact = False
            close()
            query = _both(query, q)
            if strings is not None:
                run = set(strings)
    if exact:
        return query, run
    close()
    return query, None


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regular expression; True where nothing is mandatory."""
    query, strings = _walk(rp.parse(pattern))
    return query if strings is None else _both(query, _of_strings(strings))


def trigrams(query: Query) -> set[bytes]:
    if query is True:
        return set()
    if isinstance(query, bytes):
        return {query}
    return set().union(*map(trigrams, query[1]))


def candidates(query: Query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Documents (numbers below n) that satisfy a query."""
    if query is True:
        return np.arange(n)
    if isinstance(query, bytes):
        return postings.get(query, np.empty(0, np.int64))
    found = [candidates(q, postings, n) for q in query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate(found))
    out = found[0]
    for f in found[1:]:
        out = np.intersect1d(out, f, assume_unique=True)
    return out


def index_block(texts: list[bytes], wanted: list[bytes]) -> dict[bytes, np.ndarray]:
    """Postings of the wanted trigrams over a block of texts."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    blob = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
    if len(blob) < 3 or not wanted:
        return {}
    keys = np.frombuffer(b"".join(wanted), dtype=np.uint8).reshape(-1, 3)
    first = np.zeros(256, bool)
    first[keys[:, 0]] = True
    at = np.flatnonzero(first[blob[:-2]])
    code = (blob[at].astype(np.int32) << 16) | (blob[at + 1].astype(np.int32) << 8) | blob[at + 2]
    wide = keys.astype(np.int32)
    codes = (wide[:, 0] << 16) | (wide[:, 1] << 8) | wide[:, 2]
    order = np.argsort(codes)
    place = np.searchsorted(codes[order], code)
    place[place == len(codes)] = 0
    hit = codes[order][place] == code
    which, doc = order[place[hit]], np.searchsorted(ends, at[hit], side="right")
    pair = np.unique(which.astype(np.int64) * (len(texts) + 1) + doc)
    which, doc = pair // (len(texts) + 1), pair % (len(texts) + 1)
    cuts = np.searchsorted(which, np.arange(len(wanted) + 1))
    return {w: doc[cuts[i] : cuts[i + 1]] for i, w in enumerate(wanted)}


def matches(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scan(rules: tuple[Rule, ...], base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        wanted = sorted(set().union(*map(trigrams, queries)))
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
            lo = 0
            while lo < len(column):
                texts, size, hi = [], 0, lo
                while hi < len(column) and (size < BLOCK_BYTES or hi == lo):
                    texts.append(column[hi].as_py())
                    size += len(texts[-1])
                    hi += 1
                postings = index_block(texts, wanted)
                decoded: dict[int, str] = {}
                for k, (rule, query, pattern) in enumerate(zip(rules, queries, compiled, strict=True)):
                    for d in candidates(query, postings, len(texts)).tolist():
                        if d not in decoded:
                            decoded[d] = texts[d].decode("utf-8", "replace")
                        found[lo + d] += [(s, k, e) for s, e in matches(rule, pattern, decoded[d])]
                lo = hi
            counts, digests, spans = [[] for _ in range(base)], [], []
            for hits in found:
                hits.sort()
                text = [f"{rules[k].kind}:{s}:{e}" for s, k, e in hits]
                own = ",".join(t for t, (_, k, _) in zip(text, hits, strict=True) if k < base)
                digests.append(hashlib.sha256(own.encode()).hexdigest())
                spans.append(",".join(text))
                for k in range(base):
                    counts[k].append(sum(h[1] == k for h in hits))
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["id", *(f"n_{r.kind}" for r in rules[:base]), "base_sha256", "spans"],
            )

    return run


def find_secrets(
    docs: DataFrame, base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_<kind>`` of each base kind, ``base_sha256, spans``.

    A span is ``kind:start:end`` of a whole match in code points, end exclusive; matches of a kind are
    leftmost and do not overlap, those of different kinds may. Spans are ordered by start, then kind as
    listed. A null or empty text has no spans (empty strings; the digest is that of the empty string).
    Null ids and repeated rows are scanned like others; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = ", ".join([f"id {id_type}", *(f"n_{r.kind} long" for r in base), "base_sha256 string", "spans string"])
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    return in_arrow(rows, _scan((*base, *added), len(base)), fields).withColumnRenamed("id", id_col)
