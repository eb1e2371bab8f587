"""License scans by conditional compression.

Candidate blocks are the stretches around words that license notices use, wherever lines break. Each
block is compressed, line breaks and comment marks taken as spaces, by zstandard once alone and once with each template as raw
dictionary. The templates are ranked by how much they shorten the block; the leading ones are then
confirmed by exact wording: the template's words must stand in the block in order, with at most a tenth
missing and none of its names, numbers or versions, and no other name, number or version among them
(the GPL's notice with "Affero" or "Lesser" in it is another license's). ``{n}`` in a template stands for
up to n words of any kind, such as the holder's name.

Texts are read once where they lie; nothing is shuffled. The templates are a parameter; the default
holds short public notices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, text_or_empty

# Public license notices, by SPDX identifier. The sentence that all BSD licenses share does not say
# which one it is: where no list of clauses is confirmed, it is reported under a name of its own.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:"
)
_BSD_CLAUSES = (
    f"{_BSD} {{1}} Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. {1} Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU %s "
    "License as published by the Free Software Foundation, either version %s of the License, or (at your option) any "
    "later version."
)
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU % ("Affero General Public", "3")),
    ("BSD-2-Clause", f"{_BSD_CLAUSES} This software is provided by {{14}} as is and any express or implied"),
    (
        "BSD-3-Clause",
        f"{_BSD_CLAUSES} {{20}} be used to endorse or promote products derived from this software without specific prior "
        "written permission.",
    ),
    (
        "BSD-4-Clause",
        f"{_BSD_CLAUSES} {{1}} All advertising materials mentioning features or use of this software must display the "
        "following acknowledgement",
    ),
    ("LicenseRef-BSD", _BSD),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is released under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", _GNU % ("General Public", "2")),
    ("GPL-3.0", _GNU % ("General Public", "3")),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.0", "This work is licensed under the GNU Lesser General Public License, version 2."),
    ("LGPL-2.0", "This work is licensed under the GNU Library General Public License, version 2."),
    ("LGPL-2.0", _GNU % ("Library General Public", "2")),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", _GNU % ("Lesser General Public", "2.1")),
    ("LGPL-3.0", _GNU % ("Lesser General Public", "3")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction',
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
_CUE = re.compile(r"licen[sc]e|copyright|\bhereby\b|redistribut|public\W{1,40}domain|creative\W{1,40}commons|\bcc0\b", re.I)
_BREAK = re.compile(r"\s*\n[\s*#/;%!>|-]*")
_WORD = re.compile(r"\{\d+\}|[a-z0-9]+(?:[.+-][a-z0-9]+)*", re.I | re.A)
_GAP = re.compile(r"\{(\d+)\}")
_MARKUP = re.compile(r"</?[a-z][a-z0-9]{0,10}(?:\s[^<>]{0,300})?/?>|&#?\w{1,8};|^[ \t]*(?:dnl|rem)\b|\{\d+\}", re.I | re.M)
# Words that carry no name, number or version: of these a tenth may be missing.
_PLAIN = frozenset(
    "a an and any are as at be by can either files following for forms free from further granted hereby in included "
    "international is it later licensed may met modification modify notice obtaining of option or permission permitted "
    "person program provided published redistribute released subject software source terms that the this to under use "
    "version with without work you your".split()
)
BEFORE, AFTER, LINE = 400, 2500, 6000


def blocks(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold a notice: ``BEFORE`` characters ahead of a cue, in whole words, to ``AFTER`` behind it, merged."""
    out: list[tuple[int, int]] = []
    for m in _CUE.finditer(text):
        start = max(0, m.start() - BEFORE)
        while 0 < start < m.start() and text[start - 1].isalnum() and text[start].isalnum():
            start += 1
        end = min(len(text), m.end() + AFTER)
        if out and start <= out[-1][1] and end - out[-1][0] <= LINE:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


class Templates:
    """Compressors with each template as raw dictionary, and the templates' words."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.plain = zstandard.ZstdCompressor(level=3)
        self.all = []
        for name, text in templates:
            raw = zstandard.ZstdCompressionDict(_GAP.sub("", text).lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.all.append((name, [w.lower() for w in _WORD.findall(text)], zstandard.ZstdCompressor(level=3, dict_data=raw)))

    def ranked(self, block: str) -> list[tuple[int, int]]:
        """(bytes saved, template number), most first; ties in the order of the templates."""
        data = _BREAK.sub(" ", block).lower().encode("utf-8", "replace")
        alone = len(self.plain.compress(data))
        saved = [(alone - len(c.compress(data)), k) for k, (_, _, c) in enumerate(self.all)]
        return sorted(saved, key=lambda s: (-s[0], s[1]))


Word = tuple[str, int, int]


def words_of(block: str) -> list[Word]:
    """Words in lower case with start and end; HTML tags, entities and comment leaders are none."""
    plain = _MARKUP.sub(lambda m: " " * len(m.group()), block)
    return [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(plain)]


def _segments(words: list[str]) -> list[tuple[int, list[str]]]:
    """A template's words between its gaps, each with the words that the gap before it may have."""
    out: list[tuple[int, list[str]]] = [(0, [])]
    for w in words:
        if _GAP.fullmatch(w):
            out.append((int(w[1:-1]), []))
        else:
            out[-1][1].append(w)
    return out


def _edges(want: list[str], run: list[str]) -> list[tuple[int, int, int]]:
    """(words of ``want`` missing, extra words, length) for each beginning of ``run`` that holds more of ``want`` in order."""
    row, out = [0] * (len(want) + 1), [(len(want), 0, 0)]
    for n, w in enumerate(run, 1):
        before, diagonal = row[-1], 0
        for j, x in enumerate(want, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == w else max(row[j], row[j - 1])
        if row[-1] > before:
            out.append((len(want) - row[-1], n - row[-1], n))
    return out


def _places(segment: list[str], found: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """(first, last + 1, missing, extra) where a segment stands: its names all there, and between them only plain words more."""
    names = {w for w in segment if w not in _PLAIN} or {max(segment, key=len)}
    if not names <= set(found):
        return
    ours = [i for i, w in enumerate(segment) if w in names]
    theirs = [i for i, w in enumerate(found) if w not in _PLAIN or w in names]
    n, want = len(ours), [segment[i] for i in ours]
    for k in range(len(theirs) - n + 1):
        at = theirs[k : k + n]
        if [found[i] for i in at] != want:
            continue
        missing = extra = 0
        for (i, i2), (j, j2) in zip(zip(ours, ours[1:]), zip(at, at[1:]), strict=True):
            m, _, length = _edges(segment[i + 1 : i2], found[j + 1 : j2])[-1]
            missing, extra = missing + m, extra + j2 - j - 1 - (i2 - i - 1 - m)
        room = 2 * len(segment) + 2
        low = max(theirs[k - 1] + 1 if k else 0, at[0] - room)
        high = min(theirs[k + n] if k + n < len(theirs) else len(found), at[-1] + 1 + room)
        for m1, e1, n1 in _edges(segment[: ours[0]][::-1], found[low : at[0]][::-1]):
            for m2, e2, n2 in _edges(segment[ours[-1] + 1 :], found[at[-1] + 1 : high]):
                yield at[0] - n1, at[-1] + 1 + n2, missing + m1 + m2, extra + e1 + e2


def wording(found: list[Word], words: list[str]) -> tuple[int, int, int] | None:
    """Start and end in the block of the words found in order, and how many are missing; None if not confirmed."""
    parts = [(gap, s) for gap, s in _segments(words) if s]
    size = sum(len(s) for _, s in parts)
    plain = [w for w, _, _ in found]
    states: list[tuple[int, int, int, int]] = []
    for k, (gap, segment) in enumerate(parts):
        places = [p for p in _places(segment, plain) if p[2] <= size // 10]
        if k:
            places = [(a, d, m + m2, e + e2) for a, b, m, e in states for c, d, m2, e2 in places if b <= c <= b + gap]
        states = [p for p in places if p[2] <= size // 10]
        if not states:
            return None
    fit = [p for p in states if p[3] - p[2] <= max(2, size // 5)]
    if not fit:
        return None
    first, end, missing, _ = min(fit, key=lambda p: (p[2] + p[3], p[2], p[0], p[1]))
    return found[first][1], found[end - 1][2], missing


def scan_text(text: str, templates: Templates) -> list[dict]:
    """Confirmed notices of a text: name, start, end, bytes saved, words missing."""
    out: dict[tuple[str, int], dict] = {}
    stretches = blocks(text)
    while stretches:
        start, end = stretches.pop()
        part = text[start:end]
        found = words_of(part)
        for saved, k in templates.ranked(part):
            name, words, _ = templates.all[k]
            if (w := wording(found, words)) is not None:
                s, e, missing = w
                row = {"name": name, "start": start + s, "end": start + e, "saved": saved, "missing": missing}
                out.setdefault((name, start + s), row)
                # a block may hold several notices: go on before and behind a confirmed one
                stretches += [x for x in ((start, start + s), (start + e, end)) if _CUE.search(text, *x)]
                break
    rows: list[dict] = []
    for r in sorted(out.values(), key=lambda r: (r["start"], -r["end"], r["name"])):
        if not rows or r["end"] > rows[-1]["end"]:  # blocks that overlap may show a part of another block's notice
            rows.append(r)
    return rows


_FOUND = "array<struct<name:string,start:int,end:int,saved:int,missing:int>>"
_ARROW_FOUND = pa.list_(
    pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("saved", pa.int32()), ("missing", pa.int32())])
)


def find_licenses(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_blocks, notices`` (name, start, end in code points, saved, missing).

    A null or empty text has no blocks and an empty array. Null ids and repeated rows are scanned like
    others; of templates that save equally much the first listed is tried first. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(templates)
        for b in batches:
            texts = [x.as_py() for x in b.column(1)]
            n = [len(blocks(x)) for x in texts]
            found = [scan_text(x, t) if k else [] for x, k in zip(texts, n, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int32()), pa.array(found, _ARROW_FOUND)], ["id", "n_blocks", "notices"]
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return in_arrow(rows, run, f"id {id_type}, n_blocks int, notices {_FOUND}").withColumnRenamed("id", id_col)
