"""License scan by conditional compression.

A block of text around a licence word is compressed alone and with each template as a zstandard raw
dictionary. Every template is confirmed at every place of the block by the exact differences in wording
between the template and the words that align with it; the bytes it saves decide between equals. (They
are no condition: in a block that names many licences, one may save nothing beside its likes.)
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts that name or grant a licence. ``<...>`` stands for any words (at most ten).
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
}
#: Lower-case strings one of which every template and every text under it has.
SIGNS = ("licen", "permission", "redistribut", "free software", "all rights reserved", "copyright", "public domain")
_word = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_sign = re.compile("|".join(map(re.escape, SIGNS)), re.I)


def words(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower().strip("."), m.start(), m.end()) for m in _word.finditer(text)]


class Scanner:
    """Templates with their dictionaries; made once in each worker."""

    def __init__(self, templates: dict[str, str], reach: float = 0.1, level: int = 3):
        self.reach = reach
        self.plain = zstandard.ZstdCompressor(level=level)
        self.alone = {n: len(self.plain.compress(t.lower().encode())) for n, t in templates.items()}
        self.with_template = {}
        for name, text in templates.items():
            raw = zstandard.ZstdCompressionDict(text.lower().encode() * (1 + 16 // len(text)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.with_template[name] = zstandard.ZstdCompressor(level=level, dict_data=raw)
        self.words = {n: [w for w, _, _ in words(t)] for n, t in templates.items()}
        self.longest = max(map(len, templates.values()))

    def blocks(self, text: str):
        """Merged windows of a template's length around every licence word."""
        lo = hi = -1
        for m in _sign.finditer(text):
            a, b = max(0, m.start() - self.longest - 64), min(len(text), m.end() + self.longest + 64)
            if a <= hi and b - lo <= 16 * self.longest:
                hi = b
                continue
            if lo >= 0:
                yield lo, hi
            lo, hi = a, b
        if lo >= 0:
            yield lo, hi

    def places(self, template: list[str], block: list[str]) -> list[tuple[int, int, int]]:
        """Runs of the block that the template aligns with: (wording differences, first, last word).

        Only those within reach; runs may overlap, where several starts lead to one place.
        """
        n, found, past = len(template), set(), -1
        at: dict[str, list[int]] = {}
        for i, w in enumerate(block):
            at.setdefault(w, []).append(i)
        slack = max(1, int(n * self.reach))
        # Of the rarest words, one more than may differ: one of them is intact wherever the template stands.
        rare = sorted(range(n), key=lambda j: len(at.get(template[j], ())))
        anchors = range(n) if n <= 16 else [j for k, j in enumerate(rare) if k <= slack or len(at.get(template[j], ())) <= 4]
        starts = {max(0, i - j) for j in anchors for i in at.get(template[j], ())}
        need = Counter(template)
        for s in sorted(starts):
            if s < past:
                continue
            run = block[s : s + n + slack]
            if run[:n] == template:
                found.add((0, s, s + n))
                past = s + n - slack
                continue
            # No alignment matches more words than both have in common.
            if n - (need & Counter(run)).total() > n * self.reach:
                continue
            ops = [o for o in SequenceMatcher(None, template, run, autojunk=False).get_matching_blocks() if o.size]
            if not ops:
                continue
            end = ops[-1].b + ops[-1].size
            matched = sum(o.size for o in ops)
            d = n - matched + max(0, end - ops[0].b - matched)
            if d <= n * self.reach:
                found.add((d, s + ops[0].b, s + end))
        return sorted(found)

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, int]]:
        """(licence, start, end, bytes saved, wording differences), one for each confirmed place."""
        low = (text or "").lower()
        if not any(s in low for s in SIGNS):
            return []
        hits: dict[tuple[str, int, int], tuple[int, int, int]] = {}
        for lo, hi in self.blocks(text):
            block = text[lo:hi]
            raw = block.lower().encode()
            alone = len(self.plain.compress(raw))
            spots = words(block)
            bare = [w for w, _, _ in spots]
            for name, c in self.with_template.items():
                saved, t = alone - len(c.compress(raw)), self.words[name]
                for d, a, b in self.places(t, bare):
                    # Blocks overlap: a place in two of them counts once.
                    place = (name, lo + spots[a][1], lo + spots[b - 1][2])
                    hits[place] = min(hits.get(place, (1, 0, 0)), (3 * d - len(t), -saved, d))
        # Where several winners align, the one of more words and fewer differences holds the place.
        starts, taken = [], []
        for (score, saved, d), (name, a, b) in sorted((v, k) for k, v in hits.items()):
            i = bisect(starts, a)
            if (i == 0 or taken[i - 1][2] <= a) and (i == len(taken) or taken[i][1] >= b):
                starts.insert(i, a)
                taken.insert(i, (name, a, b, -saved, d))
        return taken


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, reach: float = 0.1) -> DataFrame:
    """(doc_id, license, start, end, saved, differences) for each licence text found.

    Positions are characters of the text. Null and empty texts hold none, repeated rows repeat their
    results, null ids are carried through, an empty table gives no rows, other columns are ignored.
    """

    def run(batches):
        scanner = Scanner(templates, reach)
        for batch in batches:
            found = [(d, *f) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in scanner.scan(t)]
            cols = list(zip(*found)) if found else [()] * 6
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "license", "start", "end", "saved", "differences"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, start long, end long, saved long, differences long")
