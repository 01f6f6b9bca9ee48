"""License scans by conditional compression.

Blocks are the surroundings of words that licences use, across line ends and comment marks. A
block that says what a template says compresses better when the template is the compressor's
raw dictionary: templates are ranked by how much smaller the block gets. Those that save
anything are then aligned with the block word by word, and one counts wherever few of its words
are missing or different; where several fit the same words, the closest and longest one does.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

# Names and wording of licence notices (fixed values).
_GNU = ("you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; "
        "either version {} of the License, or (at your option) any later version.")
TEMPLATES = {
    "AGPL-3.0-or-later": ("This program is free software: " + _GNU.format("Affero General Public License", "3"),),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "CC-BY-4.0": ("This work is licensed under the Creative Commons Attribution 4.0 International License.",
                  "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "GPL-2.0-or-later": ("This program is free software; " + _GNU.format("General Public License", "2"),),
    "GPL-3.0-or-later": ("This program is free software: " + _GNU.format("General Public License", "3"),),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-2.1-or-later": ("This library is free software; " + _GNU.format("Lesser General Public License", "2.1"),),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": ("Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            'documentation files (the "Software"), to deal in the Software without restriction'),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
TRIGGER = re.compile(
    r"licen[cs]|redistribution|permission\W+is\W+hereby|permission\W+to\W+use|copyright|released\W+under|public\W+domain", re.IGNORECASE)
LINE = 300  # characters of a long line that a span reaches beyond the licence's words
MISSING = 0.15  # share of a template's words that may be missing or different
CHANGED, ADDED = 4, 1  # cost of a missing or different word, and of a word in between
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_WRAP = re.compile(r"\s*\n[\s#*/;%!>|-]*")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def wordings() -> list[tuple[str, str]]:
    """Name and wording of every template; each licence also has its identifier line."""
    return [(name, w) for name, known in TEMPLATES.items() for w in (*known, f"SPDX-License-Identifier: {name}")]


# A block holds twice the longest template around a trigger, for marks and blanks at line ends.
REACH = 2 * max(len(w) for _, w in wordings())


def blocks(text: str) -> list[tuple[int, int]]:
    """Start and end of the candidate blocks, in order. Every trigger has its whole surroundings
    in one of them; where triggers are dense, blocks overlap and stay short."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        if not out or min(m.end() + REACH, len(text)) > out[-1][1]:
            out.append((max(m.start() - REACH, 0), min(m.end() + 2 * REACH, len(text))))
    return out


@lru_cache(1)
def _compressors() -> tuple[zstandard.ZstdCompressor, list[tuple[str, tuple[str, ...], Counter, zstandard.ZstdCompressor]]]:
    plain = zstandard.ZstdCompressor(level=3)
    known = []
    for name, wording in wordings():
        # The dictionary is a whole number of repeats: very short raw ones are ignored.
        raw = zstandard.ZstdCompressionDict((wording.lower() + "\n").encode() * 2, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        mine = tuple(words(wording))
        known.append((name, mine, Counter(mine), zstandard.ZstdCompressor(level=3, dict_data=raw)))
    return plain, known


def ranked(block: str) -> list[tuple[float, str, tuple[str, ...], Counter]]:
    """Templates by how much of the block's compressed size they save, best first."""
    data = _WRAP.sub(" ", block).lower().encode("utf-8", "surrogatepass")
    plain, known = _compressors()
    size = len(plain.compress(data))
    rank = [((size - len(c.compress(data))) / size, name, w, bag) for name, w, bag, c in known]
    return sorted(rank, key=lambda r: (-r[0], r[1], len(r[2])))


def aligned(wording: tuple[str, ...], mine: list[str]) -> list[tuple[int, int, int, int]]:
    """Cost, first word, end and differing words of the places of ``mine`` that say the wording.

    Edit distance from any start to every end; a word with a digit, such as a version, must be
    there. Of a place's ends all that are cheap enough are given.
    """
    limit = CHANGED * MISSING * len(wording)
    exact = [w for w in wording if any(map(str.isdigit, w))]
    column = [(CHANGED * i, 0, i) for i in range(len(wording) + 1)]  # cost, -start, differing
    out = []
    for j, w in enumerate(mine):
        fresh = [(0, -j - 1, 0)]
        for i, want in enumerate(wording):
            cost, start, differing = column[i]
            step = (cost, start, differing) if want == w else (cost + CHANGED, start, differing + 1)
            cost, start, differing = column[i + 1]
            added = (cost + ADDED, start, differing)
            cost, start, differing = fresh[i]
            fresh.append(min(step, added, (cost + CHANGED, start, differing + 1)))
        column = fresh
        cost, start, differing = column[-1]
        if cost <= limit and not Counter(exact) - Counter(mine[-start:j + 1]):
            out.append((cost, -start, j + 1, differing))
    return out


@lru_cache(4096)
def matches(block: str) -> tuple[tuple[float, int, str, int, int, float, int], ...]:
    """Cost a word, -words, licence, start, end, saved share, differing words of the places in
    the block that say a template, overlapping ones included."""
    found = list(_WORD.finditer(block))
    mine, out = [m.group().lower() for m in found], []
    bag = Counter(mine)
    for saved, name, wording, wanted in ranked(block):
        # Fewer words in common than an alignment needs: none is there.
        if saved <= 0 or (wanted - bag).total() > MISSING * len(wording):
            continue
        out += [(cost / len(wording), -len(wording), name, found[a].start(), found[b - 1].end(), saved, differing)
                for cost, a, b, differing in aligned(wording, mine)]
    return tuple(out)


def chosen(places: set[tuple[float, int, str, int, int, float, int]]) -> list[tuple[float, int, str, int, int, float, int]]:
    """The places that do not overlap a closer or longer one, in order of their start."""
    starts: list[int] = []
    kept: list[tuple[float, int, str, int, int, float, int]] = []
    for p in sorted(places, key=lambda p: (p[0], p[1], p[3], p[2], p[4])):
        at = bisect.bisect(starts, p[3])
        if (at and kept[at - 1][4] > p[3]) or (at < len(kept) and starts[at] < p[4]):
            continue
        starts.insert(at, p[3])
        kept.insert(at, p)
    return kept


def confirmed(block: str) -> tuple[str, float, int, int] | None:
    """Licence, saved share, differing words, words beside it of the block's closest; or None."""
    places = chosen(set(matches(block)))
    if not places:
        return None
    _, size, name, _, _, saved, differing = min(places)
    return name, saved, differing, len(words(block)) + size + differing


def scan(text: str | None) -> tuple[int, list[tuple[str, int, int, float, int, int]]]:
    """Number of candidate blocks and name, start, end, saved, differing, extra of the licences.

    A span is the lines that hold the licence's words (of long lines, the surroundings).
    """
    text = text or ""
    spans = blocks(text)
    places: dict[tuple, float] = {}
    for a, b in spans:
        for cost, size, name, start, end, saved, differing in matches(text[a:b]):
            key = (cost, size, name, start + a, end + a, differing)
            places[key] = max(places.get(key, 0.0), saved)  # overlapping blocks see a place twice
    out = []
    for _, size, name, start, end, saved, differing in chosen({(*k[:5], s, k[5]) for k, s in places.items()}):
        first = max(text.rfind("\n", 0, start) + 1, start - LINE)
        stop = text.find("\n", end)
        last = min(len(text) if stop < 0 else stop, end + LINE)
        out.append((name, first, last, saved, differing, len(words(text[first:last])) + size + differing))
    return len(spans), out


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_blocks, n_licenses, licenses (names, sorted, comma-joined), spans
    (name:start:end:differing:extra by start, comma-joined) for each row of ``docs``.

    Positions are code points. A licence that is there twice has two spans and one name; two
    on one line are two. Null and empty texts have no blocks. Repeated rows each give a
    row. Nothing is shuffled; blocks that repeat are judged once per worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, spans = [], [], []
            for text in batch.column("text"):
                count, found = scan(text.as_py())
                n.append(count)
                names.append(sorted({f[0] for f in found}))
                spans.append(",".join(f"{f[0]}:{f[1]}:{f[2]}:{f[4]}:{f[5]}" for f in found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([len(x) for x in names], pa.int64()),
                 pa.array([",".join(x) for x in names], pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_blocks", "n_licenses", "licenses", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_blocks long, n_licenses long, licenses string, spans string")
