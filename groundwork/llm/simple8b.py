"""Simple-8b word-aligned coding of token ids, with escapes and per-block offsets (numpy; no Spark here).

A 64-bit word holds a 4-bit selector and 60 bits that the selector divides into equal slots. A slot of all
ones is an escape: its id stands in full in a list beside the words, so that one rare id does not widen
a whole word. Ids are cut into blocks of ``BLOCK``; every block starts a new word, and its offsets into
the words and the escapes are kept, so that any block is decoded by itself and all of them at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTHS = 60 // COUNTS
_MARKS = (np.uint64(1) << WIDTHS.astype(np.uint64)) - np.uint64(1)
_LARGEST = np.minimum(_MARKS - np.uint64(1), np.uint64((1 << 32) - 1)).astype(np.uint32)  # id that is no escape
_SHIFT = np.uint64(60)
_WORD_BYTES, _ESCAPE_BYTES = 8, 4
_RARE = 3 / 4  # a selector that escapes a larger share of the ids at hand is not tried
_AT_ONCE = 32


def _window(flags: np.ndarray, count: int) -> np.ndarray:
    """How many of the ``count`` flags from every place on are set, along the rows; the places behind the last hold none."""
    total, width, behind = None, 1, 0
    part = flags.view(np.uint8)
    while True:
        if count & width:
            if total is None:
                total = part.copy()
            else:
                total[:, : max(0, total.shape[1] - behind)] += part[:, behind:]
            behind += width
        if 2 * width > count:
            return total
        twice = part.copy()
        twice[:, :-width] += part[:, width:]
        part, width = twice, 2 * width


def _choices(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """For every place the selector of a word that starts there, the fewest bytes per id, and how many ids it takes."""
    n = len(ids)
    rows = -(-n // block)
    square = np.zeros(rows * block, dtype=np.uint32)
    square[:n] = ids
    square = square.reshape(rows, block)
    left = np.minimum(block, n - block * np.arange(rows))[:, None] - np.arange(block, dtype=np.int64)
    best = np.full((rows, block), np.inf, dtype=np.float32)
    choice = np.zeros((rows, block), dtype=np.int8)
    for s, (count, mark) in enumerate(zip(COUNTS.tolist(), _MARKS.tolist(), strict=True)):
        if mark < 1 << 32:
            escaped = square >= mark
            rare = int(np.count_nonzero(escaped))
            if rare > _RARE * n:
                continue
            cost = _window(escaped, count).astype(np.float32)
            cost *= _ESCAPE_BYTES
            cost += _WORD_BYTES
        else:
            cost = np.full((rows, block), _WORD_BYTES, dtype=np.float32)
        cost[:-1] *= 1 / np.minimum(count, block - np.arange(block)).astype(np.float32)
        cost[-1] /= np.clip(left[-1], 1, count)
        np.maximum(choice, (cost < best).view(np.int8) * np.int8(s), out=choice)  # selectors are tried in ascending order
        np.minimum(best, cost, out=best)
        if mark >= 1 << 32 or not rare:  # wider slots hold fewer ids at the same cost a word
            break
    choice = choice.ravel()[:n]
    return choice, np.minimum(COUNTS[choice], left.ravel()[:n])


def _starts(step: np.ndarray, block: int) -> np.ndarray:
    """Places where words start, from how many ids a word takes at each place: all blocks at once, a word further each time."""
    at = np.arange(0, len(step), block)
    stop, start = np.append(at[1:], len(step)), np.zeros(len(step), dtype=bool)
    while len(at):
        start[at] = True
        at = at + step[at]
        inside = at < stop
        at, stop = at[inside], stop[inside]
    return np.flatnonzero(start)


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``words, escapes, word offsets, escape offsets`` of unsigned 32-bit ids; offsets have one entry a block.

    At every place the selector with the fewest bytes per id is taken, its escapes counted in (of those that hold
    a quarter of the ids or more).
    """
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    n = len(ids)
    if n == 0:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), np.empty(0, np.uint32), none, none
    few = _AT_ONCE * block  # blocks at a time, so that the work stays in the processor's cache
    chosen = [_choices(ids[i : i + few], block) for i in range(0, n, few)]
    choice, step = (np.concatenate(x) for x in zip(*chosen, strict=True))
    starts = _starts(step, block)
    wide = np.zeros(n + int(COUNTS[0]), dtype=np.uint64)
    wide[:n] = ids
    selectors = choice[starts].astype(np.int64)
    ends = np.append(starts[1:], n)

    words = selectors.astype(np.uint64) << _SHIFT
    for s, (count, width, mark) in enumerate(zip(COUNTS.tolist(), WIDTHS.tolist(), _MARKS, strict=True)):
        at = np.flatnonzero(selectors == s)
        if len(at):
            first, size, word = starts[at], ends[at] - starts[at], words[at]
            short = np.flatnonzero(size < count)  # a block ends in them
            for k in range(count):
                values = np.minimum(wide[first + k], mark)
                values[short[size[short] <= k]] = 0
                word |= values << np.uint64(k * width)
            words[at] = word
    escaped = ids > np.repeat(_LARGEST[selectors], ends - starts)
    firsts = np.arange(0, n, block)
    before = np.concatenate([[0], np.cumsum(escaped)])
    return words, ids[escaped], np.searchsorted(starts, firsts), before[firsts]


def decode(
    words: np.ndarray, escapes: np.ndarray, word_at: np.ndarray, escape_at: np.ndarray, n: int,
    first: int = 0, last: int | None = None, block: int = BLOCK,
) -> np.ndarray:
    """The ids of blocks ``first`` up to ``last`` (not included), all selectors at once; all blocks by default."""
    blocks = len(word_at)
    last = blocks if last is None else last
    if first >= last:
        return np.empty(0, np.uint32)
    w0, w1 = int(word_at[first]), int(word_at[last]) if last < blocks else len(words)
    e0, e1 = int(escape_at[first]), int(escape_at[last]) if last < blocks else len(escapes)
    words, escapes, offsets = words[w0:w1], escapes[e0:e1], np.asarray(word_at[first:last], np.int64) - w0
    total = min(n, last * block) - first * block
    selectors = (words >> _SHIFT).astype(np.int64)
    counts = COUNTS[selectors]
    before = np.cumsum(counts) - counts
    owner = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1  # block of each word
    starts = owner * block + before - before[offsets][owner]
    stops = np.minimum((owner + 1) * block, total)
    out = np.empty(total + 1, dtype=np.uint32)  # empty slots go to the last place
    escaped = np.zeros(total + 1, dtype=bool)
    for s, (count, width, mark) in enumerate(zip(COUNTS.tolist(), WIDTHS.tolist(), _MARKS, strict=True)):
        at = np.flatnonzero(selectors == s)
        if len(at):
            first, size, word = starts[at], stops[at] - starts[at], words[at]
            short = np.flatnonzero(size < count)
            for k in range(count):
                values, target = word >> np.uint64(k * width) & mark, first + k
                target[short[size[short] <= k]] = total
                out[target], escaped[target] = values, values == mark
    out, escaped = out[:total], escaped[:total]
    out[escaped] = escapes
    return out


def ids_between(words, escapes, word_at, escape_at, n: int, start: int, stop: int, block: int = BLOCK) -> np.ndarray:
    """Ids ``start`` up to ``stop`` (not included); only the blocks that hold them are decoded."""
    if start >= stop:
        return np.empty(0, np.uint32)
    first = start // block
    part = decode(words, escapes, word_at, escape_at, n, first, -(-stop // block), block)
    return part[start - first * block : stop - first * block]
