"""License scans: winnowed template fingerprints in an inverted index, then banded alignment.

Templates (short notices, SPDX tags, openings and passages of public licences) are tokenised; words between asterisks are
key words.  A document matches a template at a place if an alignment matches ``COVERAGE`` of the template's words in order,
among them every key word, with at most ``INSERTED`` times the template's words of other words in between.

1. Index.  Such an alignment breaks at most (unmatched + inserted) times, so one unbroken run of it has a length that
   follows from the template's size.  Word pairs of the template are winnowed with the window that keeps at least one pair
   of every run of that length; the kept ones go to an inverted index.  No match is lost.
2. Candidates.  Every pair of a document is looked up; a hit names a template and a diagonal.  Diagonals stay whose stretch
   of the document holds enough of the template's words, and all its key words.
3. Alignment.  Within the band that the allowed breaks can reach, the best alignment that inserts no more words than
   allowed is found (most key words, then most words, then the shortest span) and held against the rule above.
4. A match is void if a word that names another licence (``QUALIFIERS``) stands inside it, if a negation stands up to
   ``NEGATED`` words before it in the same sentence, or if it is one of few words (``SHORT``) with a sentence's end inside.  "or version 3", "OR Apache-2.0" and the like behind a match name
   further licences, which are reported with places of their own.

The index is a fixed table of some kilobytes and travels with the code; documents are scanned in one pass without a
shuffle, whole texts in slices of bounded size.

Defined cases: null, empty and wordless texts have no match; a template that occurs several times is reported once per
place; of matches that overlap, of one licence or several, the better covered stays (ties: the longer template, then its
name, then the shorter span, then the earlier place); repeated rows are reported each; a null id is kept; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from kilngraph.llm.storage import slices

#: Share of a template's words that must be matched, and share that may be inserted.
COVERAGE, INSERTED = 0.8, 0.1
#: Words before a match that are searched for a negation.
NEGATED = 4
#: Templates of at most so many words match within a sentence only.
SHORT = 4

# Licence names and the notices and passages by which they are recognised; key words between asterisks.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the *MIT* License.",
        "Licensed under the *MIT* License.",
        "This project is licensed under the terms of the *MIT* license.",
        "*MIT* *License*",
        "*Permission* is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, *sublicense*, and/or sell copies of the Software",
        "*Permission* is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, *sublicense*, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the *Apache* License, Version *2.0*.",
        "*Apache* License Version *2.0*, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Licensed under the *Apache* License, Version *2.0* (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "licensed under the *GNU* *General* Public License, version *3*.",
        "Licensed under the *GPLv3*.",
        "*GNU* *GPL*, version *3*",
        "*GNU* *GPL* *v3*",
        "*GNU* *GENERAL* PUBLIC LICENSE Version *3*, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the *GNU* *General* Public License as published by the Free Software Foundation, either version *3* of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "licensed under the *GNU* *General* Public License, version *2*.",
        "Licensed under the *GPLv2*.",
        "*GNU* *GPL*, version *2*",
        "*GNU* *GPL* *v2*",
        "*GNU* *GENERAL* PUBLIC LICENSE Version *2*, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the *GNU* *General* Public License as published by the Free Software Foundation; either version *2* of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("licensed under the *GNU* *Lesser* *General* Public License, version *3*.", "*GNU* *LESSER* *GENERAL* PUBLIC LICENSE Version *3*, 29 June 2007"),
    "LGPL-2.1": ("licensed under the *GNU* *Lesser* *General* Public License, version *2.1*.", "*GNU* *LESSER* *GENERAL* PUBLIC LICENSE Version *2.1*, February 1999"),
    "LGPL": ("licensed under the *GNU* *Lesser* *General* Public License",),
    "AGPL-3.0": ("licensed under the *GNU* *Affero* *General* Public License, version *3*.", "*GNU* *AFFERO* *GENERAL* PUBLIC LICENSE Version *3*, 19 November 2007"),
    "BSD": (
        "Licensed under the *BSD* License.",
        "*Redistribution* and use in source and binary forms, with or without *modification*, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the *Mozilla* Public License, v. *2.0*.",
        "Licensed under the *Mozilla* Public License, version *2.0*.",
        "If a copy of the *MPL* was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ),
    "ISC": ("Licensed under the *ISC* License.", "*Permission* to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this *permission* notice appear in all copies."),
    "CC-BY": ("Licensed under *CC* *BY* *4.0*.", "*CC* *BY* *4.0*", "*CC* *BY* *3.0*", "licensed under a *Creative* *Commons* *Attribution* *4.0* International License."),
    "CC-BY-SA": ("Licensed under *CC* *BY-SA* *4.0*.", "licensed under a *Creative* *Commons* *Attribution-ShareAlike* *4.0* International License."),
    "CC-BY-NC": ("Licensed under *CC* *BY-NC* *4.0*.", "licensed under a *Creative* *Commons* *Attribution-NonCommercial* *4.0* International License."),
    "CC-BY-ND": ("Licensed under *CC* *BY-ND* *4.0*.", "licensed under a *Creative* *Commons* *Attribution-NoDerivatives* *4.0* International License."),
    "CC-BY-NC-SA": ("Licensed under *CC* *BY-NC-SA* *4.0*.", "licensed under a *Creative* *Commons* *Attribution-NonCommercial-ShareAlike* *4.0* International License."),
    "CC-BY-NC-ND": ("Licensed under *CC* *BY-NC-ND* *4.0*.", "licensed under a *Creative* *Commons* *Attribution-NonCommercial-NoDerivatives* *4.0* International License."),
    "CC0": ("To the extent possible under law, the author has *waived* all *copyright* and related or neighboring rights to this work.", "*Creative* *Commons* Legal Code *CC0* *1.0* Universal"),
    "BSL-1.0": (
        "*Boost* *Software* *License*",
        "*Permission* is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare *derivative* works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ),
    "Zlib": ("Licensed under the *zlib* License.", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to *alter* it and *redistribute* it freely, subject to the following restrictions"),
    "Unlicense": ("This is free and *unencumbered* software released into the public *domain*.",),
}
#: SPDX identifiers and the licence each names.
SPDX: dict[str, str] = {
    "MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-3.0": "GPL-3.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0",
    "LGPL-2.1-only": "LGPL-2.1", "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0",
    "BSD-2-Clause": "BSD", "BSD-3-Clause": "BSD", "MPL-2.0": "MPL-2.0", "ISC": "ISC", "CC-BY-4.0": "CC-BY", "CC-BY-SA-4.0": "CC-BY-SA", "CC-BY-NC-4.0": "CC-BY-NC", "CC-BY-ND-4.0": "CC-BY-ND", "CC0-1.0": "CC0", "Unlicense": "Unlicense", "BSL-1.0": "BSL-1.0", "Zlib": "Zlib", "CC-BY-3.0": "CC-BY", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3.0", "AGPL-3.0": "AGPL-3.0",
}
#: Words that turn a licence's name into another's, negations, and what ends a sentence.
QUALIFIERS = frozenset("affero lesser library nc nd sa sharealike noncommercial noderivatives noderivs".split())
NEGATIONS = frozenset("not never no neither nor cannot isn aren wasn weren without".split())
SENTENCE_END = re.compile(rb"[.!?;:\n]")
SENTENCE_BREAK = re.compile(rb"[.!?;]\s")
#: Words are runs of letters and digits, lower-cased; everything beyond ASCII is a word character.
_FOLD = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def tokenise(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def all_templates() -> dict[str, tuple[str, ...]]:
    """The notices, and one wholly key SPDX tag per identifier."""
    out = dict(TEMPLATES)
    for name, family in SPDX.items():
        out[family] = (*out[family], f"*SPDX-License-Identifier: {name}*")
    return out


class Template:
    """One template: word ids, key words, and what an alignment must and may have."""

    def __init__(self, family: str, number: int, text: str, vocabulary: dict[bytes, int], coverage: float):
        words = [(w, i % 2 == 1) for i, part in enumerate(text.split("*")) for w in tokenise(part.encode())]
        self.family, self.number = family, number
        self.ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w, _ in words]
        self.keys = [key for _, key in words]
        self.must = np.array(sorted({i for i, key in zip(self.ids, self.keys, strict=True) if key}), np.int64)
        self.need = max(math.ceil(coverage * len(words) - 1e-9), sum(self.keys))
        self.spare = math.floor(INSERTED * len(words) + 1e-9)
        self.band = len(words) - self.need + self.spare
        #: The longest unbroken run of any alignment that fits has so many words at least.
        self.run = -(-self.need // (self.band + 1))

    def fingerprints(self) -> list[tuple[int, int, int]]:
        """(first word, second word, place) of the winnowed pairs; single words (second 0) if runs can be that short."""
        pairs = self.run >= 2 and len(self.ids) >= 2
        grams = [(a, b) for a, b in zip(self.ids, self.ids[1:], strict=False)] if pairs else [(a, 0) for a in self.ids]
        window = max(1, self.run - 1 if pairs else self.run)
        order = [(g[0] * 2_654_435_761 + g[1] * 40_503) % (1 << 32) for g in grams]
        kept = {min(range(i, i + window), key=lambda p: (order[p], -p)) for i in range(max(1, len(grams) - window + 1)) if i + window <= len(grams)}
        return [(*grams[p], p) for p in sorted(kept or range(len(grams)))]


class TemplateIndex:
    def __init__(self, templates: dict[str, tuple[str, ...]] | None = None, coverage: float = COVERAGE):
        self.vocabulary: dict[bytes, int] = {}
        self.templates = [Template(f, n, text, self.vocabulary, coverage) for f, texts in (templates or all_templates()).items() for n, text in enumerate(texts)]
        size = self.width = len(self.vocabulary) + 1
        posted = sorted((a * size + b, t, p) for t, template in enumerate(self.templates) for a, b, p in template.fingerprints())
        self.grams, self.owner, self.place = (np.array(x, np.int64) for x in zip(*posted, strict=True)) if posted else (np.empty(0, np.int64),) * 3
        self.inside, self.musts = np.zeros((len(self.templates), size), bool), np.zeros((len(self.templates), size), bool)
        for t, template in enumerate(self.templates):
            self.inside[t, template.ids] = True
            self.musts[t, template.must] = True
        self.n_must = self.musts.sum(1)
        self.spdx = sorted(((tokenise(k.encode()), v) for k, v in SPDX.items()), key=lambda x: -len(x[0]))
        self.families = {t.family for t in self.templates}

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(template, diagonal) of every alignment that can fit."""
        present = np.zeros(self.width, bool)
        present[ids] = True
        possible = (self.musts & present).sum(1) == self.n_must
        if not possible.any() or not len(ids):
            return
        ahead = np.append(ids[1:], 0)
        for grams in (ids * self.width + ahead, ids * self.width):
            low, high = np.searchsorted(self.grams, grams), np.searchsorted(self.grams, grams, side="right")
            at = np.flatnonzero((high > low) & (ids > 0))
            if not len(at):
                continue
            size = high[at] - low[at]
            row = np.repeat(np.arange(len(at)), size)
            post = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[at], size)
            found = np.unique(np.stack([self.owner[post], at[row] - self.place[post]], 1), axis=0)
            for t in np.unique(found[:, 0]).tolist():
                if possible[t]:
                    template, diagonals = self.templates[t], found[found[:, 0] == t, 1]
                    n = len(template.ids)
                    begin, end = np.clip(diagonals - template.band, 0, len(ids)), np.clip(diagonals + n + template.band, 0, len(ids))
                    enough = np.ones(len(diagonals), bool)
                    for marks, least in ((self.inside[t, ids], template.need), *((ids == k, 1) for k in template.must.tolist())):
                        many = np.concatenate([[0], np.cumsum(marks)])
                        enough &= many[end] - many[begin] >= least
                    for d in diagonals[enough].tolist():
                        yield t, d


def align(template: Template, words: list[int], diagonal: int) -> tuple[int, int, int, int]:
    """The best alignment within the band of the diagonal: matched words, matched key words, first and last place.

    Best of those with at most ``template.spare`` inserted words: most key words, most words, shortest span.  A cell holds,
    for each number of inserted words so far, the best (key words, words, first place); a later first place is better.
    """
    band, spare = template.band, template.spare
    low, width = diagonal - band, 2 * band + 1
    none = (0, 0, -1)
    empty = (none,) * (spare + 1)
    above, best = [empty] * (width + 1), (0, 0, 0, -1, -1)
    for i, (want, key) in enumerate(zip(template.ids, template.keys, strict=True)):
        row, left = [], empty
        for c in range(width):
            j = i + low + c
            # Skip a document word (one more inserted, unless nothing is matched yet), or a template word.
            cell = tuple(map(max, (none, *left[:-1]), above[c + 1]))
            if 0 <= j < len(words) and words[j] == want:
                hits = tuple((k + key, m + 1, first if m else j) if m or not s else none for s, (k, m, first) in enumerate(above[c]))
                best = max(best, *((k, m, first - j, first, j) for k, m, first in hits if m))
                cell = tuple(map(max, cell, hits))
            row.append(cell)
            left = cell
        above = [*row, empty]
    return best[1], best[0], best[3], best[4]


def fits(template: Template, matched: int, keys: int, first: int, last: int) -> bool:
    return matched >= template.need and keys == sum(template.keys) and last - first + 1 - matched <= template.spare


def _named_behind(index: TemplateIndex, family: str, tag: bool, words: list[bytes], at: int) -> Iterator[tuple[str, int, int]]:
    """(licence, first word, last word) of further licences named directly behind a match that ends before ``at``."""
    base = family.rsplit("-", 1)[0]
    while at < len(words) and words[at] in (b"or", b"and"):
        at += 1
        if tag:
            named = next(((v, len(k)) for k, v in index.spdx if words[at : at + len(k)] == k), None)
            if not named:
                return
            yield named[0], at, at + named[1] - 1
            at += named[1]
        else:
            begin = at
            at += at < len(words) and words[at] in (b"version", b"v")
            number = words[at].decode(errors="replace") if at < len(words) and words[at].isdigit() else None
            minor = words[at + 1].decode() if number and at + 1 < len(words) and words[at + 1] in (b"0", b"1") else None
            name = f"{base}-{number}.{minor or 0}"
            if number is None or name not in index.families:
                return
            at += 1 if minor is None else 2
            yield name, begin, at - 1


def scan_text(index: TemplateIndex, text: bytes | None) -> list[tuple[str, int, float, int, int, int, int]]:
    """(family, template, coverage, first word, last word, first byte, end byte) of every match in one text."""
    if not text:
        return []
    folded = text.translate(_FOLD)
    ids = np.fromiter(map(index.vocabulary.get, (split := folded.split()), repeat(0)), np.int64, len(split))
    found = set()
    words: list[int] | None = None
    for t, diagonal in index.candidates(ids):
        template = index.templates[t]
        words = ids.tolist() if words is None else words
        matched, keys, first, last = align(template, words, diagonal)
        if fits(template, matched, keys, first, last):
            found.add((matched / len(template.ids), t, first, last))
    if not found:
        return []
    spans = [x.span() for x in _WORD.finditer(folded)]
    kept: list[tuple] = []
    for share, t, first, last in sorted(found, key=lambda m: (-m[0], -len(index.templates[m[1]].ids), index.templates[m[1]].family, m[1], m[3] - m[2], m[2])):
        template = index.templates[t]
        if any(w.decode(errors="replace") in QUALIFIERS for w in split[first : last + 1] if index.vocabulary.get(w) not in template.ids):
            continue
        if any(w.decode(errors="replace") in NEGATIONS and not SENTENCE_END.search(text[spans[first - b][1] : spans[first][0]]) for b in range(1, NEGATED + 1) if first - b >= 0 for w in [split[first - b]]):
            continue
        if len(template.ids) <= SHORT and SENTENCE_BREAK.search(text[spans[first][0] : spans[last][0]]):
            continue
        if all(last < k[3] or first > k[4] for k in kept):
            kept.append((template.family, template.number, share, first, last))
            tag = split[first : first + 3] == [b"spdx", b"license", b"identifier"]
            kept += [(name, template.number, 1.0, a, b) for name, a, b in _named_behind(index, template.family, tag, split, last + 1)]
    return [(*m, spans[m[3]][0], spans[m[4]][1]) for m in sorted(kept, key=lambda m: m[3])]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: dict[str, tuple[str, ...]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per match: id, license, template, coverage, word span and character span [start_char, end_char), matched text."""
    index = TemplateIndex(templates, coverage)
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, license string, template int, coverage double, first_word long, last_word long, start_char long, end_char long, matched_text string"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], ddl).schema)
    text_name = docs.select(text_col).columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_name):
                ids, rows = batch.column(0).to_pylist(), []
                for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                    for family, number, share, first, last, begin, end in scan_text(index, text):
                        at = len(text[:begin].decode())
                        span = text[begin:end].decode()
                        rows.append((ids[i], family, number, share, first, last, at, at + len(span), span))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

    return docs.select(id_col, text_col).mapInArrow(run, ddl)
