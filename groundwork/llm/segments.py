"""Cutting texts where no tokenizer in use can join across, so that repeated stretches are encoded once.

A cut stands before an ASCII space that follows a letter, mark, number, punctuation or symbol. Byte-level
BPE with the common split pattern starts a new pre-token there, and a sentencepiece model whose pieces
hold the space mark only in front cannot merge over it. ``byte_level_cuts`` and ``piece_cuts`` check a
vocabulary for this; where the check fails, texts are encoded whole.

``Pieces`` is for byte-level BPE alone and cuts finer, by the same pattern: also between letters, digits and
ASCII punctuation and around a lone line break. It works on the texts' Arrow buffers, without an object per word.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SOLID = frozenset("LMNPS")
_PLAIN = frozenset(map(chr, range(0x21, 0x7F)))


def solid(part: str) -> bool:
    """Whether a space behind ``part`` starts a new segment."""
    return part[-1:] in _PLAIN or (part != "" and unicodedata.category(part[-1])[0] in _SOLID)


def joinable(segment: str) -> bool:
    """Whether the segment stays one when others stand before and behind it."""
    return segment[:1] == " " and solid(segment)


def byte_level_cuts(path: str) -> bool:
    """Whether a ``tokenizers`` file is byte-level BPE that splits by its common pattern and changes no text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    return (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in added)
    )


def byte_of_symbol() -> dict[str, int]:
    """Byte-level BPE's symbols: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def piece_cuts(pieces: list[str], mark: str = "▁") -> bool:
    """Whether no piece holds the space mark behind another character."""
    return not any(mark in p.lstrip(mark) for p in pieces)


class Lookup:
    """What ``compute`` says of each segment of a text; words met before in this worker are looked up.

    ``compute`` gets distinct segments as a list and gives a list. At most ``most`` words of at most ``longest``
    characters are held; the store is emptied when it is full. With ``keep``, words that were met again since the last time
    stay then, up to half of it (every fourth text is looked at for them): fewer to compute, for more memory.
    """

    def __init__(self, compute: Callable[[list[str]], list], spaced: bool, most: int = 1 << 19, longest: int = 64, keep: bool = False):
        self.compute, self.spaced, self.most, self.longest, self.keep = compute, spaced, most, longest, keep
        self.held: dict[str, object] = {}  # by word: the value of the word with a space in front
        self.again: set[str] = set()  # held words met again

    def __call__(self, texts: list[str]) -> list[list]:
        """Values of the segments of each text in order; with ``spaced``, of the text with a space in front."""
        out, words, odd, shortened = [], [], [], []
        get, known = self.held.get, self.held.keys()
        for k, text in enumerate(texts):
            parts = text.split(" ") if text else []
            values = list(map(get, parts))
            out.append(values)
            if self.keep and k % 4 == 0 and len(self.again) < self.most // 2:
                self.again |= known & set(parts)
            if parts and not self.spaced:
                values[0] = None  # no space in front
            missing = [i for i, v in enumerate(values) if v is None]
            loose = [i for i in missing if parts[i][-1:] not in _PLAIN and not solid(parts[i])]
            if missing and not self.spaced and missing[0] == 0 and not loose:
                odd.append((values, 0, parts[0]))
                del missing[0]
            elif loose:
                missing = self._joined(parts, values, missing, loose, odd, shortened)
            if missing:
                words.append((values, missing, [parts[i] for i in missing]))
        new = list(set().union(*[ws for *_, ws in words]))
        found = dict(zip(new, self.compute([" " + w for w in new]), strict=True))
        for values, places, ws in words:
            for i, w in zip(places, ws, strict=True):
                values[i] = found[w]
        new = list({s for *_, s in odd} - {""})
        other = dict(zip(new, self.compute(new), strict=True))
        for values, i, s in odd:
            values[i] = other.get(s, ())
            if not s:
                shortened.append(values)
        for values in shortened:
            values[:] = [v for v in values if v != ()]
        if len(self.held) + len(found) > self.most:
            self.held = {w: self.held[w] for w in islice(self.again, self.most // 2)}
            self.again = set()
        self.held.update(found)
        for w in [w for w in found if len(w) > self.longest]:
            del self.held[w]
        return out


    def _joined(self, parts: list[str], values: list, missing: list[int], loose: list[int], odd: list, shortened: list) -> list[int]:
        """Parts that end in white space (``loose``) joined to the next one, noted in ``odd``; the missing words that remain."""
        joined, behind = set(), 0
        for i in loose if self.spaced or loose[0] == 0 else [0, *loose]:
            if i < behind:
                continue
            behind = i + 1
            while behind < len(parts) and not solid(parts[behind - 1]):
                behind += 1
            odd.append((values, i, " " * (i > 0 or self.spaced) + " ".join(parts[i:behind])))
            joined.update(range(i, behind))
            if behind > i + 1:
                values[i + 1 : behind] = [()] * (behind - i - 1)
                shortened.append(values)
        return [i for i in missing if i not in joined]


class Whole:
    """As ``Lookup``, every text being one segment."""

    def __init__(self, compute: Callable[[list[str]], list], spaced: bool):
        self.compute, self.front = compute, " " * spaced

    def __call__(self, texts: list[str]) -> list[list]:
        found = iter(self.compute([self.front + t for t in texts if t]))
        return [[next(found)] if t else [] for t in texts]


_LOOSE, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _SPACE, _BREAK, _WIDE = range(8)  # kinds of bytes; _MARK: ASCII punctuation
_KIND = np.full(256, _LOOSE, np.uint8)
for _kind, _bytes in (
    (_MARK, range(0x21, 0x7F)), (_LETTER, range(0x41, 0x5B)), (_LETTER, range(0x61, 0x7B)), (_DIGIT, range(0x30, 0x3A)),
    (_APOSTROPHE, b"'"), (_SPACE, b" "), (_BREAK, b"\t\n\v\f\r"), (_WIDE, range(0x80, 0x100)),
):
    _KIND[list(_bytes)] = _kind
_ASCII_SOLID = (_LETTER, _DIGIT, _MARK, _APOSTROPHE)
_NEVER, _ALWAYS, _BEHIND_BREAK, _BEHIND_WIDE = range(4)  # whether a cut stands between two bytes, by 8 * kind + kind
_CUT = np.full(64, _NEVER, np.uint8)
for _a in _ASCII_SOLID:
    _CUT[[8 * _a + _SPACE, 8 * _a + _BREAK]] = _ALWAYS
    _CUT[8 * _BREAK + _a] = _BEHIND_BREAK  # a line break that stands alone
for _a, _b in ((_LETTER, _DIGIT), (_LETTER, _MARK), (_LETTER, _APOSTROPHE), (_DIGIT, _MARK), (_DIGIT, _APOSTROPHE)):
    _CUT[8 * _a + _b] = _ALWAYS
    if _b != _APOSTROPHE:  # "'s" is one
        _CUT[8 * _b + _a] = _ALWAYS
for _b in (_SPACE, _BREAK, _DIGIT, _MARK, _APOSTROPHE):
    _CUT[8 * _WIDE + _b] = _BEHIND_WIDE
_SOLID_FIRST, _SOLID_LAST = r"^[\pL\pM\pN\pP\pS]", r"[\pL\pM\pN\pP\pS]$"
_TOGETHER = 1 << 16  # pieces that are put together at a time
_UNKNOWN, _OTHER, _SOLID_CHARACTER, _WIDE_LETTER = range(4)
_characters = np.zeros(0x110000, np.uint8)  # what was asked for so far


def _wide_kinds(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Kinds of the characters beyond ASCII that end before the places ``at`` of UTF-8 bytes."""
    b = [data[np.maximum(at - k, 0)].astype(np.int32) for k in (1, 2, 3, 4)]
    two = (b[1] & 0x1F) << 6 | b[0] & 0x3F
    three = (b[2] & 0x0F) << 12 | (b[1] & 0x3F) << 6 | b[0] & 0x3F
    four = (b[3] & 0x07) << 18 | (b[2] & 0x3F) << 12 | (b[1] & 0x3F) << 6 | b[0] & 0x3F
    points = np.minimum(np.where(b[1] >= 0xC0, two, np.where(b[2] >= 0xE0, three, four)), 0x10FFFF)
    for c in np.unique(points[_characters[points] == _UNKNOWN]).tolist():
        category = unicodedata.category(chr(c))[0]
        settled = c < 0x530 or 0x4E00 <= c < 0x9FA6  # letters in every Unicode version in use
        _characters[c] = _WIDE_LETTER if category == "L" and settled else _SOLID_CHARACTER if category in _SOLID else _OTHER
    return _characters[points]


def _buffers(texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """The data buffer of strings or bytes, as an array too, and the places in it where each starts and the last ends."""
    _, offsets, data = texts.buffers()
    data = pa.py_buffer(b"") if data is None else data
    return data, np.frombuffer(data, np.uint8), np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]


def _parts(bounds: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Runs of neighbours whose bounds (ascending) lie about ``size`` apart, or of one that is larger: work that stays in the processor's cache."""
    out, at = [], 0
    while at < len(bounds) - 1:
        stop = max(at + 1, int(np.searchsorted(bounds, int(bounds[at]) + size, "right")) - 1)
        out.append((at, stop))
        at = stop
    return out


def piece_starts(data: np.ndarray, offsets: np.ndarray, by_spaces: np.ndarray) -> np.ndarray:
    """Places in the texts' UTF-8 bytes where pieces start: those where every text starts and the cuts inside it.

    Texts marked in ``by_spaces`` are cut before spaces alone.
    """
    low, high = int(offsets[0]), int(offsets[-1])
    kinds = _KIND[data[low:high]]
    cut = np.zeros(len(kinds), np.uint8)
    cut[1:] = _CUT[(kinds[:-1] << 3) + kinds[1:]]
    at = np.flatnonzero(cut == _BEHIND_BREAK)
    cut[at] = (at > 1) & np.isin(kinds[at - 2], _ASCII_SOLID)
    at = np.flatnonzero(cut == _BEHIND_WIDE)
    wide, blank = _wide_kinds(data, at + low), np.isin(kinds[at], (_SPACE, _BREAK))
    cut[at] = (wide == _WIDE_LETTER) | blank & (wide == _SOLID_CHARACTER)
    for i in np.flatnonzero(by_spaces):
        a, b = int(offsets[i]) - low, int(offsets[i + 1]) - low
        cut[a:b] &= kinds[a:b] == _SPACE
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    cut[starts - low] = 1
    return np.flatnonzero(cut).astype(np.int32) + np.int32(low)


class Pieces:
    """Token ids of texts by those of their pieces; pieces met before in this worker are looked up.

    ``compute`` gets distinct pieces (an Arrow array of bytes) and gives their ids, one after another, and how many each
    has. Texts that hold one of the strings ``whole`` are cut before spaces alone. At most ``most`` pieces of at most
    ``longest`` bytes are held from one call to the next; of more, those met again since the last time, up to half of it.
    """

    def __init__(self, compute: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], whole: list[str], most: int = 1 << 19, longest: int = 64):
        self.compute, self.whole, self.most, self.longest = compute, whole, most, longest
        self.held = pa.array([], pa.binary())
        self.ids, self.counts, self.uses = np.empty(0, np.uint32), np.empty(0, np.int32), np.empty(0, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (Arrow strings without nulls) and where each text's ids end."""
        buffer, data, offsets = _buffers(texts)
        by_spaces = np.zeros(len(texts), bool)
        for s in self.whole:
            by_spaces |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        starts = [piece_starts(data, offsets[a : b + 1], by_spaces[a:b]) for a, b in _parts(offsets, 8 * _TOGETHER)]
        starts = np.concatenate([np.empty(0, np.int32), *starts])
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        bounds = pa.py_buffer(np.append(starts, offsets[-1]))
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, bounds, buffer])
        coded = pa.chunked_array([self.held, pieces]).dictionary_encode().chunks[-1]  # the held pieces have the first codes
        known, codes = coded.dictionary, coded.indices.to_numpy()
        found, counts = self.compute(known.slice(len(self.held)))
        self.ids, self.counts = np.concatenate([self.ids, found]), np.concatenate([self.counts, counts.astype(np.int32)])
        in_step = np.bincount(codes, minlength=len(known))
        uses = in_step.copy()
        uses[: len(self.held)] += self.uses
        firsts = np.cumsum(self.counts, dtype=np.int64) - self.counts
        text_pieces = np.searchsorted(starts, offsets)
        ids, ends, done = np.empty(int(self.counts @ in_step), np.uint32), np.zeros(len(texts), np.int64), 0
        for a, b in _parts(text_pieces, _TOGETHER):
            part = codes[text_pieces[a] : text_pieces[b]]
            n = self.counts[part]
            behind = np.append(0, np.cumsum(n, dtype=np.int64))
            place = np.repeat(firsts[part] - behind[:-1], n)
            place += np.arange(len(place))
            ids[done : done + len(place)] = self.ids[place]
            ends[a:b] = done + behind[text_pieces[a + 1 : b + 1] - text_pieces[a]]
            done += len(place)
        self._hold(known, uses)
        del known, coded, codes, pieces
        pa.default_memory_pool().release_unused()  # a step's memory is not kept for the worker's life
        return ids, ends

    def _hold(self, known: pa.Array, uses: np.ndarray) -> None:
        stays = np.diff(_buffers(known)[2]) <= self.longest
        if np.count_nonzero(stays) > self.most:
            stays &= uses > 1
            if np.count_nonzero(stays) > self.most // 2:
                among = np.flatnonzero(stays)
                most_used = np.argsort(-uses[among], kind="stable")[: self.most // 2]
                stays[:] = False
                stays[among[most_used]] = True
            uses = np.ones_like(uses)  # each time they have to be met anew
        if not stays.all():
            self.ids = self.ids[np.repeat(stays, self.counts)]
            known, uses, self.counts = known.filter(pa.array(stays)), uses[stays], self.counts[stays]
        self.held, self.uses = known, uses


def joined_pieces(pieces: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Which of the pieces may follow one another in one text, those as bytes to join, and how many bytes were put in front of each.

    Such a piece ends in a character that no white space is part of; if none stands in front, a line break is put there.
    """
    _, data, offsets = _buffers(pieces)
    first, last = _KIND[data[offsets[:-1]]], _KIND[data[offsets[1:] - 1]]
    starts, ends = np.isin(first, (*_ASCII_SOLID, _SPACE, _BREAK)), np.isin(last, _ASCII_SOLID)
    for ok, kinds, pattern in ((starts, first, _SOLID_FIRST), (ends, last, _SOLID_LAST)):
        at = np.flatnonzero(kinds == _WIDE)
        ok[at] = pc.match_substring_regex(pieces.take(pa.array(at)).cast(pa.string()), pattern).to_numpy(zero_copy_only=False)
    inner = np.flatnonzero(starts & ends)
    bare = ~np.isin(first[inner], (_SPACE, _BREAK))
    front = pa.array([b"", b"\n"], pa.binary()).take(pa.array(bare.astype(np.int8)))
    return inner, pc.binary_join_element_wise(front, pieces.take(pa.array(inner)), pa.scalar(b"", pa.binary())), bare.astype(np.int64)
