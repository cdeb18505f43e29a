"""License scans: conditional compression proposes, exact wording confirms.

A candidate block (the words around a license word, as many on both sides as
the longest template can span, whatever the lines) is compressed alone
and with every template as a raw-content zstandard dictionary. The templates are
ranked by the bytes they save; the best one whose wording stands in the block is
found, its words are taken out and the rest is ranked again, until none saves
enough. A place goes to the template with the fewest differences.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import map_rows

# Public notices by SPDX identifier, in short forms, the published
# headers and what is characteristic of the license texts ("BSD" is the opening that
# all BSD licenses share; the clauses tell which one it is).
TEMPLATES = [
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"),
    ("AGPL-3.0", "free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-4-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC-BY-3.0", "licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-3.0", "licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-3.0", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International Public License"),
    ("CC-BY-NC-ND-4.0", "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-3.0", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License."),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-SA-4.0", "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-3.0", "licensed under a Creative Commons Attribution-NoDerivs 3.0 Unported License."),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International Public License"),
    ("CC-BY-ND-4.0", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-3.0", "licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "A Work made available under CC0 may be protected by copyright and related or neighboring rights"),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("GPL-1.0", "This License Agreement applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this General Public License."),
    ("GPL-2.0", "This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this General Public License."),
    ("GPL-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.0", "free software: you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in sorted({n for n, _ in TEMPLATES} - {"BSD"})]
TEMPLATES += [
    (name, f"SPDX-License-Identifier: {name}-{form}")
    for name in ("AGPL-3.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0") for form in ("only", "or-later")
]
# One of these stands in every template, and one must be left in a changed
# wording. They are looked for word by word, as a notice may be wrapped
# between any two words.
CUES = (
    "licens", "licenc", "copyright", "permission", "permitted", "domain", "unencumbered", "endorse", "redistribut",
    "merchantab", "commons", "hereby", "mozilla", "waived",
)
CUE = re.compile("|".join(CUES))
# What may not differ: numbers, negations and the words that tell related licenses apart.
FIXED = re.compile(r"\d|\b(?:no|not|without|lesser|library|affero|noncommercial|sharealike|noderivatives)\b")
TOKEN = re.compile(r"[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*")


# Stands for a word that a template has taken; no word of a text is like it.
TAKEN = "\n"


def words_of(text: str) -> list[str]:
    return [w.lower() for w in TOKEN.findall(text)]


def candidate_blocks(text: str | None, reach: int) -> Iterator[tuple[list[str], list[tuple[int, int]]]]:
    """Blocks as their words and the words' places in the text: ``reach`` words
    before and after each license word, across line ends; stretches that meet
    merge. A long one is cut into blocks of ``4 * reach`` words which share
    ``reach``, so that what spans no more than that stands whole in a block."""
    low = (text or "").lower()
    if not any(c in low for c in CUES):
        return
    places = [m.span() for m in TOKEN.finditer(text)]
    words = [text[a:b].lower() for a, b in places]
    spans: list[list[int]] = []
    for i, word in enumerate(words):
        if CUE.search(word):
            if spans and i - reach <= spans[-1][1]:
                spans[-1][1] = min(len(words), i + reach + 1)
            else:
                spans.append([max(0, i - reach), min(len(words), i + reach + 1)])
    for start, end in spans:
        while True:
            stop = min(end, start + 4 * reach)
            yield words[start:stop], places[start:stop]
            if stop == end:
                break
            start += 3 * reach


class LicenseScanner:
    def __init__(self, templates: list[tuple[str, str]] | None = None, level: int = 9, least: float = 0.05):
        """``least``: a template must save this share of its own length to be
        compared with other wordings than its own."""
        self.templates = templates or TEMPLATES
        self.least = least
        # Words alone are compressed: line ends, comment signs and case don't count.
        self.texts = [" ".join(words_of(t)).encode() for _, t in self.templates]
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.with_template = [
            zstandard.ZstdCompressor(
                level=level, write_content_size=False, write_dict_id=False,
                dict_data=zstandard.ZstdCompressionDict(t, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            )
            for t in self.texts
        ]
        self.words = [words_of(t) for _, t in self.templates]
        for (name, text), words in zip(self.templates, self.words, strict=True):
            if not any(map(CUE.search, words)):
                raise ValueError(f"no license word in a template of {name}: {text}")
        self.triples = [_triples(w) for w in self.words]
        # A tenth of a template's words may be added to it.
        self.reach = max(len(w) + len(w) // 10 for w in self.words)

    def savings(self, words: list[str], wanted: list[int]) -> list[float]:
        """For each wanted template the saved bytes per byte of template."""
        data = " ".join(words).encode()
        alone = len(self.plain.compress(data))
        return [(alone - len(self.with_template[k].compress(data))) / len(self.texts[k]) for k in wanted]

    def differences(self, k: int, words: list[str]) -> tuple[list[tuple[str, str]], int, int]:
        """Wording of template ``k`` against a stretch of words: pairs of
        template words and the words found instead, and from where to where it
        stands. Words before and after the template's are no difference."""
        template = self.words[k]
        codes = SequenceMatcher(None, template, words, autojunk=False).get_opcodes()
        out = []
        for i, (tag, a0, a1, b0, b1) in enumerate(codes):
            outside = a0 == a1 and (i == 0 or i == len(codes) - 1)
            if tag != "equal" and not outside:
                extra = words[b0:b1] if a0 < a1 and i not in (0, len(codes) - 1) or a0 == a1 else []
                out.append((" ".join(template[a0:a1]), " ".join(extra)))
        equal = [c for c in codes if c[0] == "equal"]
        return out, equal[0][3] if equal else 0, equal[-1][4] if equal else 0

    def _exact(self, k: int, joined: str) -> Iterator[tuple[int, int]]:
        """Where template ``k`` stands word for word, in words."""
        wanted = f" {self.texts[k].decode()} "
        at = joined.find(wanted)
        while at >= 0:
            first = joined.count(" ", 0, at)
            yield first, first + len(self.words[k])
            at = joined.find(wanted, at + len(wanted) - 1)

    def _stretches(self, k: int, triples: dict[tuple, list[int]]) -> Iterator[int]:
        """First words of the stretches that can hold template ``k`` with a
        tenth of its words changed: each change breaks three triples of words
        at most and moves the others by one word."""
        n = len(self.words[k])
        most = n // 10
        shifts: dict[int, int] = {}
        for t, own in self.triples[k].items():
            for i in triples.get(t, ()):
                for j in own:
                    shifts[i - j] = shifts.get(i - j, 0) + 1
        tried = None
        for d in sorted(shifts):
            if tried is None or d > tried + most:
                if sum(shifts.get(e, 0) for e in range(d, d + most + 1)) >= n - 2 - 3 * most:
                    tried = d
                    yield d

    def wording(self, k: int, words: list[str]) -> list[tuple[int, int, int]]:
        """Where template ``k`` stands: ``first word, end, differing words``.
        Short notices must be word for word; of long ones a tenth of the words
        may differ, but nothing of FIXED."""
        n = len(self.words[k])
        found = [(a, b, 0) for a, b in self._exact(k, f" {' '.join(words)} ")]
        if n <= 15:
            return found
        for d in self._stretches(k, _triples(words)):
            start = max(0, d - n // 10)
            changed, a, b = self.differences(k, words[start : d + n + 2 * (n // 10)])
            differing = sum(len(x.split()) + len(y.split()) for x, y in changed)
            if 0 < differing <= n // 10 and not any(FIXED.search(f"{x} {y}") for x, y in changed):
                found.append((start + a, start + b, differing))
        return found

    def confirm(self, words: list[str]) -> list[tuple[int, int, int, float, int]]:
        """Templates in a block: ``first word, end, template, saving, differing
        words``, every place of every template.

        A round compresses what is left of the block with every open template
        and ranks them by the bytes each saves. The first one that stands there
        word for word wins, or else the first in a changed wording; its words
        are taken out and the rest is ranked again, until no template saves the
        least share. One whose wording isn't there is closed: words only go.
        """
        found, left, still = [], list(words), list(range(len(self.words)))
        while still:
            saved = dict(zip(still, self.savings([w for w in left if w != TAKEN], still), strict=True))
            ranked = sorted((k for k in still if saved[k] >= self.least), key=lambda k: -saved[k] * len(self.texts[k]))
            winner, closed = None, set()
            for k in ranked:
                places = self.wording(k, left)
                if not places:
                    closed.add(k)
                elif winner is None or not any(d == 0 for *_, d in winner[1]) and any(d == 0 for *_, d in places):
                    winner = k, places
                    if any(d == 0 for *_, d in places):
                        break
            if winner is None:
                break
            k, places = winner
            # Of its places that share words, the one with the fewest differences.
            for a, b, differing in sorted(places, key=lambda p: (p[2], p[0])):
                if TAKEN not in left[a:b]:
                    found.append((a, b, k, saved[k], differing))
                    left[a:b] = [TAKEN] * (b - a)
            still = [j for j in still if j not in closed and (j != k or len(self.words[k]) > 15)]
        return found

    def scan(self, text: str | None) -> list[tuple[int, int, str, float, int]]:
        """``start, end, license, saving, differing`` of each place in a whole
        text, in its order. Of templates that share words of the text, the one
        with the smallest share of differing words holds the place, then the
        longest."""
        found = []
        for words, places in candidate_blocks(text, self.reach):
            found += [(places[a][0], places[b - 1][1], k, s, d) for a, b, k, s, d in self.confirm(words)]
        found.sort(key=lambda f: (f[4] / len(self.words[f[2]]), -len(self.words[f[2]]), f[0], f[2], -f[3]))
        starts: list[int] = []
        taken: list[tuple] = []
        for f in found:
            at = bisect.bisect(starts, f[0])
            if (at and taken[at - 1][1] > f[0]) or (at < len(taken) and taken[at][0] < f[1]):
                continue
            starts.insert(at, f[0])
            taken.insert(at, f)
        return [(a, b, self.templates[k][0], s, d) for a, b, k, s, d in taken]


def _triples(words: list[str]) -> dict[tuple, list[int]]:
    out: dict[tuple, list[int]] = {}
    for i, t in enumerate(zip(words, words[1:], words[2:], strict=False)):
        out.setdefault(t, []).append(i)
    return out


@functools.lru_cache(maxsize=1)
def scanner() -> LicenseScanner:
    return LicenseScanner()


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and license found: ``doc_id, license, n_blocks,
    first_start, saving, differing_words``; documents without one are absent.
    ``n_blocks``: at how many places of the text wording of the license stands;
    ``first_start``: the character at which the first one begins.

    Null and empty texts hold none; a null id is carried; repeated rows give
    repeated rows; an empty table gives an empty result; other columns are not
    read. Texts of any length are scanned whole, block by block.
    """
    names = ["doc_id", "license", "n_blocks", "first_start", "saving", "differing_words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().scan
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1)):
                per: dict[str, list] = {}
                for start, _, name, saving, differing in scan(text.as_py()):
                    row = per.setdefault(name, [name, 0, start, saving, differing])
                    row[1] += 1
                    row[3] = max(row[3], saving)
                    row[4] = min(row[4], differing)
                at += [i] * len(per)
                rows += [per[name] for name in sorted(per)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names,
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_rows(
        rows, run,
        f"doc_id {kind}, license string, n_blocks bigint, first_start bigint, saving double, differing_words bigint",
    )
