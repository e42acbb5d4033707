"""License scans by Dice coefficient over word bigrams (operator 2).

A template is a set of word bigrams; a passage matches it when
2 |A & B| / (|A| + |B|) reaches the threshold t. That needs t / (2 - t) of the
template's bigrams in the passage, and a passage of at most (2 - t) / t times the
template's size: these bounds prune templates for a document and passages for a
template before any coefficient is taken.

Passages of a document are its word windows, wherever they lie in lines, that
begin and end with a bigram of the template (a longer one has a smaller
coefficient). Bigrams of whole slices of text are looked up at once; the templates
of which a document holds enough bigrams are found in one count, and only their
windows are looked at: for each beginning, distinct bigrams up to every end are
running sums. Templates are parameters of a checked size; documents never move.

Defined results: a null or empty text has no match; equal scores go to the
longer passage, then to the template first by name, then to the earlier place;
repeated rows are judged each on its own; an empty table gives no rows; texts of
any length are scanned whole; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.shared import documents
from codeloom.llm.words import mix, ragged, scan_words, table_slices, text_buffer

THRESHOLD = 0.8
MOST_TEMPLATE_BYTES = 8 << 20

#: Licence statements, notices and short licence texts (fixed values: the usual wordings, by SPDX name). ``read_templates`` takes others.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "MIT-text": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "BSL-1.0": [
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Released under the 3-Clause BSD License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


@dataclass
class Templates:
    names: list[str]  # one for each template text, sorted
    sizes: np.ndarray
    bigrams: np.ndarray  # sorted hashes of all templates' bigrams
    inside: np.ndarray  # templates x bigrams: whether a template has one
    holders: tuple[np.ndarray, np.ndarray]  # of each bigram: where its templates begin in a list of templates
    need: np.ndarray  # how many of a template's bigrams a match has at least
    most: np.ndarray  # how many bigrams it has at most
    threshold: float


def bigrams_of(words) -> np.ndarray:
    """A hash for each word but the first of its document: itself and the word before; 0 at first words."""
    h = np.zeros(len(words.hashes), np.uint64)
    if len(h) > 1:
        h[1:] = mix(words.hashes[1:] * np.uint64(5) + words.hashes[:-1]) | np.uint64(1)
    starts = words.first[:-1]
    h[starts[starts < len(h)]] = 0
    return h


def load_templates(templates: dict[str, list[str]], threshold: float) -> Templates:
    pairs = sorted((name, text) for name, texts in templates.items() for text in texts)
    if sum(len(t.encode()) for _, t in pairs) > MOST_TEMPLATE_BYTES:
        raise ValueError(f"templates exceed {MOST_TEMPLATE_BYTES} bytes; scan with parts of them")
    w = scan_words(*text_buffer(pa.array([t for _, t in pairs], pa.string())))
    h = bigrams_of(w)
    known = np.unique(h[h > 0])
    inside = np.zeros((len(pairs), len(known)), bool)
    for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
        inside[i, np.searchsorted(known, h[a:b][h[a:b] > 0])] = True
    sizes = inside.sum(1)
    bigram, template = np.nonzero(inside.T)
    # A little slack, so that rounding never decides.
    need = np.maximum(1, np.ceil(sizes * threshold / (2 - threshold) - 1e-9)).astype(np.int64)
    most = np.floor(sizes * (2 - threshold) / threshold + 1e-9).astype(np.int64)
    return Templates([n for n, _ in pairs], sizes, known, inside, (np.searchsorted(bigram, np.arange(len(known) + 1)), template), need, most, threshold)


def read_templates(table: DataFrame, name: str = "name", text: str = "text") -> dict[str, list[str]]:
    """Templates from a table (full licence texts, say), whose size is checked before it is read."""
    size = table.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    if size > MOST_TEMPLATE_BYTES:
        raise ValueError(f"templates exceed {MOST_TEMPLATE_BYTES} bytes; scan with parts of them")
    out: dict[str, list[str]] = {}
    for r in table.select(F.col(f"`{name}`").alias("n"), F.col(f"`{text}`").alias("t")).where("n IS NOT NULL AND t IS NOT NULL").collect():
        out.setdefault(r.n, []).append(r.t)
    return out


def windows(t: Templates, i: int, h: np.ndarray, ids: np.ndarray, before: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(dice, first word, end word) of the best window of template i from each beginning that matches at all.

    h, ids: bigrams of a document by their second words, ids -1 where no template has
    it; before: where the same bigram stood last.
    """
    own = np.zeros(len(ids), bool)
    known = np.flatnonzero(ids >= 0)
    own[known] = t.inside[i, ids[known]]
    at = np.flatnonzero(own)
    need, most, size, n = int(t.need[i]), int(t.most[i]), int(t.sizes[i]), len(h)
    for k, x in enumerate(at.tolist()):
        if len(at) - k < need:
            break
        end = min(n, x + most + 1)
        while True:
            fresh = before[x:end] < x
            different = np.cumsum(fresh)
            if different[-1] > most or end == n:
                break
            end = min(n, end + max(64, end - x))  # what repeats does not count
        stop = int(np.searchsorted(different, most, "right"))
        shared = np.cumsum(fresh[:stop] & own[x : x + stop])
        if not stop or shared[-1] < need:
            continue
        dice = np.where(own[x : x + stop], 2 * shared / (different[:stop] + size), 0.0)
        top = dice.max()
        if top >= t.threshold - 1e-12:
            y = int(np.flatnonzero(dice >= top - 1e-12)[-1])
            yield float(top), x - 1, x + y + 1


def scan_document(t: Templates, which: list[int], h: np.ndarray, ids: np.ndarray, lines: np.ndarray) -> list[tuple[str, float, int, int, int, int]]:
    """Best passage of each licence name: (name, dice, first line, end line, first word, end word); lines: word positions where lines begin."""
    _, same = np.unique(h, return_inverse=True)
    order = np.lexsort((np.arange(len(h)), same))
    before = np.full(len(h), -1, np.int64)
    again = same[order][1:] == same[order][:-1]
    before[order[1:][again]] = order[:-1][again]
    # A first word has no bigram: it never counts as a new one.
    before[0] = len(h)
    best: dict[str, tuple] = {}
    for i in which:
        for dice, a, b in windows(t, i, h, ids, before):
            rank = (-round(dice, 12), -(b - a), t.names[i], a)
            if t.names[i] not in best or rank < best[t.names[i]][0]:
                first, last = int(np.searchsorted(lines, a, "right")) - 1, int(np.searchsorted(lines, b - 1, "right")) - 1
                best[t.names[i]] = (rank, (t.names[i], dice, first, last + 1, a, b))
    return [x for _, x in sorted(best.values())]


_PLACES = ("first_line", "end_line", "first_word", "end_word")
SCHEMA = (
    "doc_id long, n_words long, license string, dice double, n_licenses long, first_line long, end_line long, first_word long, end_word long, "
    "matches array<struct<license:string,dice:double,first_line:long,end_line:long,first_word:long,end_word:long>>"
)
_MATCH = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), *[(c, pa.int64()) for c in _PLACES]]))


def candidates(t: Templates, ids: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """(document, template) wherever a document has as many different bigrams of a template as a match needs."""
    at = np.flatnonzero(ids >= 0)
    if not len(at):
        return []
    doc = np.searchsorted(first, at, "right") - 1
    pair = np.unique(doc * len(t.bigrams) + ids[at])
    doc, bigram = np.divmod(pair, len(t.bigrams))
    begin, templates = t.holders
    n = begin[bigram + 1] - begin[bigram]
    template = templates[ragged(begin[bigram], n)]
    both, count = np.unique(np.repeat(doc, n) * len(t.names) + template, return_counts=True)
    doc, template = np.divmod(both, len(t.names))
    enough = count >= t.need[template]
    return list(zip(doc[enough].tolist(), template[enough].tolist(), strict=True))


def scan(batches: Iterator[pa.RecordBatch], t: Templates) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in table_slices(batch, "content"):
            n = hi - lo
            w = scan_words(data, offsets)
            h = bigrams_of(w)
            ids = np.full(len(h), -1, np.int64)
            if len(h) and len(t.bigrams):
                at = np.minimum(np.searchsorted(t.bigrams, h), len(t.bigrams) - 1)
                known = (t.bigrams[at] == h) & (h > 0)
                ids[known] = at[known]
            newline = np.flatnonzero(data == 10)
            found: list[list] = [[] for _ in range(n)]
            by_doc: dict[int, list[int]] = {}
            for d, i in candidates(t, ids, w.first):
                by_doc.setdefault(d, []).append(i)
            for d, which in by_doc.items():
                a, b = int(w.first[d]), int(w.first[d + 1])
                breaks = newline[np.searchsorted(newline, offsets[d]) : np.searchsorted(newline, offsets[d + 1])]
                lines = np.concatenate([[0], np.searchsorted(w.starts[a:b], breaks)])
                found[d] = scan_document(t, which, h[a:b], ids[a:b], lines)
            top = [x[0] if x else (None, 0.0, None, None, None, None) for x in found]
            listed = [[dict(zip(("license", "dice", *_PLACES), m, strict=True)) for m in x] for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, n), pa.array(w.counts), pa.array([x[0] for x in top], pa.string()), pa.array([x[1] for x in top], pa.float64()), pa.array([len(x) for x in found], pa.int64()),
                    *(pa.array([x[i] for x in top], pa.int64()) for i in range(2, 6)), pa.array(listed, _MATCH),
                ],
                names=["doc_id", "n_words", "license", "dice", "n_licenses", *_PLACES, "matches"],
            )


def license_scan(df: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its best licence, the Dice coefficient, the lines of the passage, and all licences found."""
    t = load_templates(TEMPLATES if templates is None else templates, threshold)
    return df.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("content")).mapInArrow(lambda it: scan(it, t), SCHEMA)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).withColumn("dice", F.round("dice", 9)).drop("matches")
