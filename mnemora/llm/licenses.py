"""License scans by MinHash bands over text windows, in DataFrame operations only.

Words are runs of ASCII letters and digits of the lower-cased text, shingles five words, hashed. A
template whose own text runs over n shingles (repeats included) sees a text through overlapping windows of
3n shingles, one starting every n, so each stretch of twice the template's length lies whole in one: a
licence may be interrupted by as many words as it has itself. A window retrieves a template
if any of `BANDS` MinHash values (bands of one row) agree; the hash functions are the shingle hash
under exclusive-or with fixed numbers. A window that holds 0.8 of a template without repeats has a Jaccard
similarity of 0.25 to it at least. With independent functions it would be missed once in (1 - 0.25)^-64, some
10^8, times; exclusive-ors of one hash are not independent, so recall is measured: `test_retrieval_misses_nothing`
asks for thousands of edited templates in windows full of other words, and none is missed. What is retrieved
is then verified exactly: the share of the template's distinct shingles that the window contains must reach
`CONTAINMENT`.

All of this happens inside a row: no shuffle, no Python, nothing collected; a row's memory grows with its
own text. Windows are built only where they overlap a shingle that holds an anchor word. That loses
nothing: a template's anchors are checked, when the plan is made, to touch more than
1 - CONTAINMENT of its shingles, so a window without an anchored shingle cannot contain enough of the others.

Defined results: null text = empty text; texts of fewer than five words match only templates that short, which are
sought as a whole; templates without enough anchors are scanned over all windows; a template's
repeats count once; every row gives one row, ids may be null or repeated; a text may be as long as a row can hold;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import column, whole_text

SHINGLE, BANDS, CONTAINMENT = 5, 64, 0.8

# Notices, opening paragraphs and disclaimers of public licences, as their stewards publish them.
TEMPLATES = {
    "AGPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "All-rights-reserved": "All rights reserved",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "BSD-clauses": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "BSD-disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES '
        "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
        "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies."
    ),
    "ISC-disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "LGPL-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in "
        "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software."
    ),
    "MIT-disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT-notice": "Released under the MIT License",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one "
        "at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}
#: Words that anchor templates.
ANCHORS = ("licen", "copyright", "permission", "redistribution", "mozilla", "gnu", "unencumbered", "sublicense", "software", "copies", "warrant")


#: An anchor word, and what any text with one contains.
ANCHOR_WORD = "|".join(ANCHORS) + "|^cc$"


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def shingle_hash(words: tuple[str, ...]) -> int:
    """What Spark's xxhash64 gives for the words as columns."""
    from xxhash import xxh64_intdigest

    h = 42
    for w in words:
        h = xxh64_intdigest(w.encode(), h)
    return h - (1 << 64) if h >> 63 else h


@lru_cache(maxsize=1)
def band_masks() -> list[int]:
    """The numbers that make the bands' hash functions, from a rule."""
    return [shingle_hash(("band", str(k))) for k in range(BANDS)]


def template_shingles(text: str) -> list[tuple[str, ...]]:
    words = words_of(text)
    return list(dict.fromkeys(zip(*(words[i:] for i in range(SHINGLE)), strict=False)))


def span_of(text: str) -> int:
    """The shingles that a template runs over, repeats included: its windows' stride, and a third of their width."""
    return max(0, len(words_of(text)) - SHINGLE + 1)


def _anchored(shingles: list[tuple[str, ...]]) -> bool:
    touched = sum(any(re.search(ANCHOR_WORD, w) for w in s) for s in shingles)
    return touched > (1 - CONTAINMENT) * len(shingles) + 1e-9


@lru_cache(maxsize=4)
def _prepared(templates: tuple[tuple[str, str], ...], anchored: bool = True) -> list[tuple[str, int, list[int], list[int]]]:
    """(name, span, shingle hashes, MinHash values) of each template; checks that the anchors hold, if the
    scan is to rely on them."""
    out = []
    for name, text in templates:
        shingles = template_shingles(text)
        if not shingles or anchored and not _anchored(shingles):
            raise ValueError(f"template {name}: it needs {SHINGLE} words, and anchors in more than a share of {1 - CONTAINMENT:.2g} of its shingles")
        hashes = [shingle_hash(s) for s in shingles]
        out.append((name, span_of(text), hashes, [min(h ^ mask for h in hashes) for mask in band_masks()]))
    return out


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _containment(span: int, hashes: list[int], least: list[int], everywhere: bool = False) -> Column:
    """The largest share of a template's shingles that a retrieved window contains."""
    stride, width, every = span, 3 * span, _longs(hashes)
    # by anchor word (counted from 0): the windows, by their first shingle, that hold one of its shingles
    first = lambda i: F.greatest(F.lit(0), F.ceil((i - (SHINGLE - 1) - (width - 1)) / stride)).cast("int")
    last = lambda i: F.floor(F.least(i, F.size("sh") - 1) / stride).cast("int")
    at = F.array_distinct(F.flatten(F.transform("anchors", lambda i: F.when(first(i) <= last(i), F.sequence(first(i), last(i))).otherwise(F.array().cast("array<int>")))))
    if everywhere:
        at = F.sequence(F.lit(0), F.floor((F.size("sh") - 1) / stride).cast("int"))
    windows = F.transform(at, lambda k: F.slice("sh", k * stride + 1, width))
    agrees = lambda w: F.exists(F.arrays_zip(_longs(band_masks()).alias("mask"), _longs(least).alias("least")), lambda b: F.array_min(F.transform(w, lambda x: x.bitwiseXOR(b["mask"]))) == b["least"])
    # a band agrees through a shingle of the template, so what holds none of them needs no minima
    retrieved = F.filter(F.filter(windows, lambda w: F.arrays_overlap(w, every)), agrees)
    shares = F.transform(retrieved, lambda w: F.size(F.array_intersect(w, every)) / F.lit(float(len(hashes))))
    sought = F.arrays_overlap("sh", every) if everywhere else (F.size("anchors") > 0) & F.arrays_overlap("sh", every)
    return F.coalesce(F.when(sought, F.array_max(shares)), F.lit(0.0))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per row of docs: <id_col>, matches (array of struct<license, containment>, by license)."""
    given = sorted((templates or TEMPLATES).items())
    if blank := [name for name, text in given if not words_of(text)]:
        raise ValueError(f"templates without words: {blank}")
    short = [(name, words_of(text)) for name, text in given if len(words_of(text)) < SHINGLE]
    held = {name: _anchored(s) for name, text in given if (s := template_shingles(text))}
    ready = _prepared(tuple(t for t in given if held.get(t[0])))
    loose = _prepared(tuple(t for t in given if held.get(t[0]) is False), anchored=False)
    low = docs.select(column(id_col).alias("id"), F.lower(whole_text(text_col)).alias("low"))
    anchored = F.lit(bool(loose))
    for a in (*ANCHORS, "cc", *(max(words, key=len) for _, words in short)):
        anchored = anchored | F.contains("low", F.lit(a))
    none = F.array().cast("array<int>")
    words = low.select("id", F.when(anchored, F.filter(F.split("low", "[^a-z0-9]+"), lambda w: w != "")).alias("w"))
    marked = words.select("id", "w", F.when(F.size("w") >= SHINGLE, F.filter(F.transform("w", lambda w, i: F.when(w.rlike(ANCHOR_WORD), i)), lambda i: i.isNotNull())).otherwise(none).alias("anchors"))
    at = lambda i: [F.get("w", i + k) for k in range(SHINGLE)]
    hashed = F.when((F.size("w") >= SHINGLE) if loose else F.size("anchors") > 0, F.transform(F.sequence(F.lit(0), F.size("w") - SHINGLE), lambda i: F.xxhash64(*at(i))))
    # a template of fewer words than a shingle is one shingle of its own length
    spaced = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    whole = [F.coalesce(F.contains(spaced, F.lit(f" {' '.join(words)} ")), F.lit(False)).cast("double").alias(f"short{k}") for k, (_, words) in enumerate(short)]
    shingled = marked.select("id", "anchors", hashed.alias("sh"), *whole)
    found = [F.struct(F.lit(name).alias("license"), _containment(span, hashes, least).alias("containment")) for name, span, hashes, least in ready]
    found += [F.struct(F.lit(name).alias("license"), _containment(span, hashes, least, everywhere=True).alias("containment")) for name, span, hashes, least in loose]
    found += [F.struct(F.lit(name).alias("license"), F.col(f"short{k}").alias("containment")) for k, (name, _) in enumerate(short)]
    every = F.array_sort(F.array(*found)) if short or loose else F.array(*found)
    return shingled.select(F.col("id").alias(id_col), F.filter(every, lambda m: m["containment"] >= CONTAINMENT).alias("matches"))
