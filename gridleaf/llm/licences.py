"""Licence scans: which known notices a text contains.

A notice of m five-word shingles belongs to the class c, the power of two with c / 2 < m <= c. A text is seen through
overlapping windows of 2 c shingles, c apart, so each copy of a notice lies whole in one of them and shares enough of it
for MinHash: with one row in a band, a window misses a notice it holds by the share ``THRESHOLD`` in ``MISS`` of cases
at most, and the number of bands of each class follows from that. Retrieved pairs are verified on the words themselves.
A notice of fewer than five words is one shingle of its own length and is compared word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows
from .notices import WHOLE
from .words import window_hashes, word_hashes

SHINGLE, THRESHOLD, MISS = 5, 0.8, 1e-6
MARKS = b".,;:!?()\"'"
#: Shingles of a text whose bands are held at once.
PIECE = 1 << 14

_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons {} {} License."

# Wording of public licence notices.
LINES: dict[str, str] = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "apache-2.0-terms": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-terms": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit-licensed-line": "Licensed under the MIT License.",
    "mit-source-line": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "bsd-source-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "isc-line": "Released under the ISC License.",
    "isc-licensed-line": "Licensed under the ISC License.",
    "bsl-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mpl-1.1-notice": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    "mpl-2.0-line": "Licensed under the Mozilla Public License, Version 2.0.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-2.1-line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "gpl-2.0-notice": _GNU.format("program", "", 2),
    "gpl-3.0-notice": _GNU.format("program", "", 3),
    "lgpl-2.1-notice": _GNU.format("library", "Lesser", 2.1),
    "lgpl-3.0-notice": _GNU.format("library", "Lesser", 3),
    "agpl-3.0-notice": _GNU.format("program", "Affero", 3),
    "gfdl-notice": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "public-domain-line": "This work is in the public domain.",
    **{f"cc-{k}-{v}-line": f"Licensed under CC {k.upper()} {v}." for k in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for v in ("3.0", "4.0") if (k, v) != ("by-nc", "4.0")},
    **{
        f"cc-{k}-{v}-notice": _CC.format(name, f"{v} {port}")
        for k, name in (
            ("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc", "Attribution-NonCommercial"),
            ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
        )
        for v, port in (("3.0", "Unported"), ("4.0", "International"))
    },
}

#: Notices of SHINGLE words or more: usual lines and headers, and whole texts.
TEMPLATES: dict[str, str] = {**LINES, **{f"{name}-text": text for name, text in WHOLE.items()}}

#: Notices of fewer words.
SHORT: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-name": "Apache License 2.0",
    "apache-2.0-version-name": "Apache License, Version 2.0",
    "mit-name": "MIT License",
    "isc-name": "ISC License",
    "bsd-name": "BSD License",
    "mpl-2.0-name": "Mozilla Public License 2.0",
    "cc0-1.0-name": "CC0 1.0",
    **{f"cc-{k}-{v}-name": f"CC {k.upper()} {v}" for k in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd") for v in ("3.0", "4.0")},
    **{
        f"spdx-{k.lower()}": f"SPDX-License-Identifier: {k}"
        for k in (
            "Apache-2.0", "MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "Zlib", "Unlicense", "MPL-1.1", "MPL-2.0", "EPL-2.0", "CC0-1.0", "CC-BY-3.0", "CC-BY-4.0",
            "CC-BY-SA-3.0", "CC-BY-SA-4.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later",
            "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later",
        )
    },
}


def plain_words(text: bytes | None) -> list[bytes]:
    """Words with A-Z lowered and marks at their ends taken off; words of marks alone are left out."""
    return [w for w in (x.strip(MARKS) for x in text.lower().split()) if w] if text else []


def shingles(words: list[bytes]) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


@dataclass
class Class:
    """Notices of one size: names, their shingles, and a MinHash value of each for every band."""

    size: int
    names: list[str]
    sets: list[frozenset]
    values: np.ndarray  # notices x bands


def bands(size: int, smallest: int) -> int:
    """Bands of one row that miss a window of ``2 * size`` shingles with THRESHOLD of a notice in MISS of cases at most."""
    common = math.ceil(THRESHOLD * smallest)
    alike = common / (2 * size + smallest - common)
    return math.ceil(math.log(MISS) / math.log(1 - alike))


def hashes_of(words: list[bytes]) -> np.ndarray:
    return window_hashes(word_hashes(words), SHINGLE)


def permuted(h: np.ndarray, n: int) -> np.ndarray:
    """Bands x shingles: the mixed hashes under n multiplications by odd numbers. The classes share the first bands."""
    factors = np.random.default_rng(20).integers(1 << 32, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        return h[None, :] * factors[:, None]


def classes(templates: dict[str, str]) -> list[Class]:
    """The notices by class; one of fewer than SHINGLE words has none (see ``whole_notices``) and is an error."""
    groups: dict[int, list[tuple[str, list[bytes]]]] = {}
    for name, text in sorted(templates.items()):
        words = plain_words(text.encode())
        if len(words) < SHINGLE:
            raise ValueError(f"notice {name!r} has fewer than {SHINGLE} words")
        m = len(set(shingles(words)))
        groups.setdefault(1 << (m - 1).bit_length(), []).append((name, words))
    out = []
    for size, held in sorted(groups.items()):
        sets = [frozenset(shingles(w)) for _, w in held]
        n = bands(size, min(map(len, sets)))
        values = np.array([permuted(hashes_of(w), n).min(axis=1) for _, w in held])
        out.append(Class(size, [n for n, _ in held], sets, values))
    return out


def retrieved(h: np.ndarray, known: list[Class]) -> Iterator[tuple[Class, int, int]]:
    """``(class, window, notice)`` that meet in a band; window i of a class starts at shingle ``i * size``.

    Classes whose notices are all too long to have THRESHOLD of them in the text are left out. The minima of all bands are halved step by step, so a class of twice the size costs half as much; long texts go
    through in pieces that share the windows at their ends.
    """
    known = [c for c in known if len(h) / min(map(len, c.sets)) >= THRESHOLD]
    if not known:
        return
    largest = known[-1].size
    most = max(c.values.shape[1] for c in known)
    step = -(-PIECE // largest) * largest
    for begin in range(0, len(h), step):
        part = h[begin : begin + step + largest]
        least = permuted(part, most)
        size = 1
        for c in known:
            while size < c.size:
                if least.shape[1] % 2:
                    least = np.concatenate([least, np.full((most, 1), np.iinfo(np.uint64).max)], axis=1)
                least = np.minimum(least[:, 0::2], least[:, 1::2])
                size *= 2
            own = least[: c.values.shape[1]]
            windows = np.concatenate([np.minimum(own[:, :-1], own[:, 1:]), own[:, -1:]], axis=1)
            count = -(-min(step, len(h) - begin) // size)  # windows that start in this piece
            for t, value in enumerate(c.values):
                for w in np.flatnonzero((windows[:, :count] == value[:, None]).any(axis=0)).tolist():
                    yield c, begin // size + w, t


def whole_notices(templates: dict[str, str]) -> dict[tuple[bytes, ...], list[str]]:
    """Word sequences of the notices of fewer than SHINGLE words, with their names; one without words is an error."""
    out: dict[tuple[bytes, ...], list[str]] = {}
    for name, text in sorted(templates.items()):
        words = tuple(plain_words(text.encode()))
        if not words:
            raise ValueError(f"notice {name!r} has no words")
        if len(words) < SHINGLE:
            out.setdefault(words, []).append(name)
    return out


def places(words: list[bytes], short: dict[tuple[bytes, ...], list[str]]) -> Iterator[tuple[str, float, int, int]]:
    """``name, 1.0, places, first_word`` of each short notice whose words stand in the text in one sequence."""
    sizes: dict[bytes, set[int]] = {}
    for notice in short:
        sizes.setdefault(notice[0], set()).add(len(notice))
    found: dict[str, list[int]] = {}
    for first in sizes.keys() & set(words):
        for i, w in enumerate(words):
            if w == first:
                for n in sizes[first]:
                    for name in short.get(tuple(words[i : i + n]), ()) if i + n <= len(words) else ():
                        found.setdefault(name, []).append(i)
    for name, at in sorted(found.items()):
        yield name, 1.0, len(at), min(at)


def matches(text: bytes | None, known: list[Class]) -> Iterator[tuple[str, float, int, int]]:
    """``name, containment, windows, first_word`` of each notice that the whole text contains."""
    words = plain_words(text)
    if len(words) < SHINGLE:
        return
    found: dict[str, list] = {}
    for c, w, t in retrieved(hashes_of(words), known):
        start, inside = w * c.size, {}
        for i, s in enumerate(shingles(words[start : start + 2 * c.size + SHINGLE - 1])):
            if s in c.sets[t]:
                inside.setdefault(s, start + i)
        share = len(inside) / len(c.sets[t])
        if share >= THRESHOLD:
            best = found.setdefault(c.names[t], [0.0, 0, len(words)])
            found[c.names[t]] = [max(best[0], share), best[1] + 1, min(best[2], *inside.values())]
    for name, (share, windows, first) in sorted(found.items()):
        yield name, share, windows, first


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, notice, containment, windows, first_word``: a row for each document and notice it contains.

    ``containment`` is the greatest share of the notice's shingles in one window, ``windows`` how many windows hold
    THRESHOLD of it, ``first_word`` where the first of its shingles there starts (marks don't count as words). A notice
    of fewer than SHINGLE words is found where all of them stand in sequence: containment 1, and ``windows`` counts the
    places. Null texts and texts shorter than every notice give no rows; null ids are carried; rows that repeat are
    scanned each for itself; an empty table gives no rows; other columns are not read. The notices are broadcast: a list
    of the caller's, else TEMPLATES (some 250 KB).
    """
    chosen = templates or TEMPLATES
    short = whole_notices(chosen)
    named = {name for names in short.values() for name in names}
    shared = docs.sparkSession.sparkContext.broadcast((classes({k: v for k, v in chosen.items() if k not in named}), short))

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        known, exact = shared.value
        for doc_id, text in rows:
            for match in matches(text, known) if known else ():
                yield (doc_id, *match)
            for match in places(plain_words(text), exact) if exact else ():
                yield (doc_id, *match)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", F.col("text").cast("binary")), work, f"doc_id {kind}, notice string, containment double, windows bigint, first_word bigint")
