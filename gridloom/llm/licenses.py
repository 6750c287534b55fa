"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest licensed ancestor directory.

Every line of a file is a possible header, and the whole text a possible
licence file. Besides, every run of as many words as a template has is compared
with it, so a notice may be wrapped or stand inside a paragraph, and a full
licence text inside a longer file. Weights are inverse document frequencies
over the whole corpus; words that no template has weigh as the rarest do. A
text without words that carry enough of a template's norm cannot reach the
threshold, so most texts are never compared.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored

#: Licence notices by name (fixed values).
TEMPLATES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
}
#: Further wordings of headers (fixed values); found in windows of words only.
NOTICES = (
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("EPL-2.0", "are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *((f"CC-{k.replace(' ', '-')}-4.0", f"Licensed under CC {k} 4.0.") for k in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")),
    *((f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.") for k, name in (
        ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)
#: Full licence texts by name; of AGPL, EPL and CC-BY the opening, which every copy of the text has.
TEXTS = {f.stem: f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
#: Least cosine of a match.
THRESHOLD = 0.6
#: Full texts make a licence file if they cover at least this part of its words.
COVERED = 0.5

_TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


@dataclass(frozen=True)
class Weights:
    """Inverse document frequencies of the templates' words, and that of any other word."""

    idf: dict[str, float]
    other: float

    def vector(self, words: list[str]) -> dict[str, float]:
        return {w: n * self.idf.get(w, self.other) for w, n in Counter(words).items()}


def cosine(a: dict[str, float], b: dict[str, float]) -> float:
    dot = sum(x * b[w] for w, x in a.items() if w in b)
    return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if dot else 0.0


def heavy_words(vectors: dict[str, dict[str, float]], threshold: float) -> set[str]:
    """Words of which a text must have one to come to ``threshold``: the lightest of a template, up to that norm, are not needed."""
    out: set[str] = set()
    for v in vectors.values():
        whole, light = sum(x * x for x in v.values()), 0.0
        for w, x in sorted(v.items(), key=lambda i: i[1]):
            light += x * x
            if math.sqrt(light / whole) >= threshold - 1e-9:
                out.add(w)
    return out


def corpus_weights(docs: DataFrame, words: set[str], text: str = "text") -> Weights:
    """Weights of ``words`` from all texts: each task counts the texts that hold a word, Spark adds up."""
    words = frozenset(words)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, Counter()
        for batch in it:
            for t in batch.column("text").to_pylist():
                n += 1
                found.update(words.intersection(tokens(t or "")))
        yield pa.RecordBatch.from_arrays([pa.array(["", *found]), pa.array([n, *found.values()], pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in rows}
    total = n.get("", 0)
    idf = lambda df: math.log((1 + total) / (1 + df)) + 1
    return Weights({w: idf(n.get(w, 0)) for w in words}, idf(0))


class Windows:
    """Templates that are compared with every run of as many words: (licence, wording, full text or not, weights) each."""

    def __init__(self, templates: list[tuple[str, str, bool, Weights]], threshold: float):
        self.threshold, self.known = threshold, {}
        for _, t, _, _ in templates:
            for w in tokens(t):
                self.known.setdefault(w, len(self.known))
        v = len(self.known) + 1  # the last stands for all words that no template has
        self.names, self.full, self.sizes = [], [], []
        self.idf, self.vectors = np.zeros((len(templates), v)), np.zeros((len(templates), v))
        for k, (name, t, full, weights) in enumerate(templates):
            words = tokens(t)
            self.names.append(name)
            self.full.append(full)
            self.sizes.append(len(words))
            self.idf[k] = weights.other
            for w, i in self.known.items():
                self.idf[k, i] = weights.idf.get(w, weights.other)
            for w, x in weights.vector(words).items():
                self.vectors[k, self.known[w]] = x
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))
        #: By word, its part of each template's squared norm: a text cannot come nearer than the root of its words' sum.
        self.share = np.ascontiguousarray(((self.vectors / self.norms[:, None]) ** 2).T)

    def find(self, text: str) -> list[tuple[str, float, int, int, bool, int]]:
        """(licence, cosine, first character, end, full text or not, words) of the best place of every licence, in order of place.

        Where places overlap, full texts go before notices, then the nearer one,
        the longer one, the earlier one and the name decide.
        """
        low = text.lower()
        numbers: dict[str, int] = {}
        code = [numbers.setdefault(w, len(numbers)) for w in _TOKEN.findall(low)]
        held = np.array([self.known.get(w, -1) for w in numbers], dtype=np.int64)
        may = np.flatnonzero(self.share[held].sum(axis=0) >= self.threshold**2 - 1e-9)
        if not len(may) or not code:
            return []
        code = np.array(code, dtype=np.int64)
        n = len(code)
        pos = np.argsort(code, kind="stable")
        key = code[pos] * (n + 1) + pos
        places = []
        for k in may.tolist():
            size = min(self.sizes[k], n)
            w = self.idf[k][held][code]
            dot = np.concatenate(([0.0], np.cumsum(w * self.vectors[k][held][code])))
            dot = dot[size:] - dot[:-size]
            # Squared norms: a word adds 1 + 2c times its squared weight, c how often the window holds it already.
            at, before, after = np.arange(n), np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
            group = key - pos
            before[pos] = at - np.searchsorted(key, group + np.maximum(pos - size + 1, 0))
            after[pos] = np.searchsorted(key, group + np.minimum(pos + size - 1, n - 1), side="right") - 1 - at
            come, go = (1 + 2 * before) * w * w, (1 + 2 * after) * w * w
            norm = come[:size].sum() + np.concatenate(([0.0], np.cumsum(come[size:] - go[: n - size])))
            score = np.round(dot / (self.norms[k] * np.sqrt(np.maximum(norm, 1e-12))), 9)
            near = np.flatnonzero(score >= self.threshold)
            near = near[np.lexsort((near, -score[near]))]
            free = np.ones(n, dtype=bool)
            for s in near.tolist():
                if free[s]:
                    free[max(0, s - size + 1): s + size] = False
                    places.append((not self.full[k], -float(score[s]), -size, s, self.names[k]))
        if not places:
            return []
        taken, best = np.zeros(n, dtype=bool), {}
        for notice, score, size, s, name in sorted(places):
            if not taken[s: s - size].any():
                taken[s: s - size] = True
                best.setdefault(name, (s, -score, -size, not notice))
        spans = [m.span() for m in _TOKEN.finditer(low)]
        if len(low) != len(text):  # letters whose small form is longer
            back = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text]).tolist()
            spans = [(back[a], back[b - 1] + 1) for a, b in spans]
        return [(name, min(score, 1.0), spans[s][0], spans[s + size - 1][1], full, size) for name, (s, score, size, full) in sorted(best.items(), key=lambda i: i[1][0])]


def scan_text(text: str, weights: Weights, vectors: dict[str, dict[str, float]], heavy: set[str], threshold: float) -> tuple | None:
    """(licence, cosine, first character, end, whole) of the best line or of the whole text; ties to the earlier, then by name."""
    low = text.lower()
    if not any(w in low for w in heavy):
        return None
    best, at = None, 0
    for line in text.split("\n"):
        words = tokens(line)
        if not heavy.isdisjoint(words):
            v = weights.vector(words)
            for name, t in vectors.items():
                c = cosine(v, t)
                if c >= threshold and (best is None or (-c, at, name) < best[0]):
                    best = ((-c, at, name), at + len(line))
        at += len(line) + 1
    words = tokens(low)
    if heavy.isdisjoint(words):
        return None
    v = weights.vector(words)
    whole = max(((c, name) for name, t in vectors.items() if (c := cosine(v, t)) >= threshold), key=lambda x: (x[0], [-ord(k) for k in x[1]]), default=None)
    if whole:
        return whole[1], whole[0], 0, len(text), True
    return None if best is None else (best[0][2], -best[0][0], best[0][1], best[1], False)


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, path: str = "path", text: str = "text",
         notices: tuple[tuple[str, str], ...] = NOTICES, texts: dict[str, str] = TEXTS) -> DataFrame:
    """Adds licence, score, start, stop, licence_file, licences and inherited, inherited_from to (path, other columns without the text).

    ``licences`` lists the best place of every licence that reaches the
    threshold in a window of words: licence, score, start, stop, full_text.
    ``licence`` is that of the nearest full text, if full texts cover half of
    the words, or else of the whole text, if that is near a notice; either is a
    licence file. Otherwise it is that of the best line or window. A file
    without a licence of its own inherits that of the nearest directory above
    it that holds a licence file; of several in a directory the best counts,
    ties to the smaller path, and ``inherited_from`` names it. Null and empty
    texts have no licence; a null path inherits nothing. Columns whose names
    clash with the new ones are replaced. Repeated rows stay; an empty table
    gives no rows.
    """
    short = {w for t in templates.values() for w in tokens(t)}
    every = short.union(*(tokens(t) for _, t in notices), *(tokens(t) for t in texts.values()))
    wide = corpus_weights(files, every, text)
    weights = Weights({w: wide.idf[w] for w in short}, wide.other)
    vectors = {name: weights.vector(tokens(t)) for name, t in templates.items()}
    heavy = heavy_words(vectors, threshold)
    windows = Windows([(k, t, False, weights) for k, t in templates.items()] + [(k, t, False, wide) for k, t in notices] + [(k, t, True, wide) for k, t in texts.items()], threshold)
    windows = files.sparkSession.sparkContext.broadcast(windows)  # templates x their words, three times
    new = ["licence", "score", "start", "stop", "licence_file", "licences", "inherited", "inherited_from"]

    def judge(t: str | None) -> tuple:
        if not t:
            return None, None, None, None, False, []
        own, found = scan_text(t, weights, vectors, heavy, threshold), windows.value.find(t)
        listed = [dict(zip(("licence", "score", "start", "stop", "full_text"), x)) for x in found]
        full = [x for x in found if x[4]]
        if full and sum(x[5] for x in full) >= COVERED * len(tokens(t)):
            best = min(full, key=lambda x: (-x[1], x[2], x[0]))
            return *best[:4], True, listed
        if own is None or not own[4]:
            near = min(found, key=lambda x: (-x[1], x[2], x[0]), default=None)
            if near and (own is None or near[1] > own[1] + 1e-9):
                own = (*near[:4], False)
        return *(own or (None, None, None, None, False)), listed

    @F.pandas_udf("licence string, score double, start long, stop long, licence_file boolean, licences array<struct<licence: string, score: double, start: long, stop: long, full_text: boolean>>")
    def find(texts):
        import pandas as pd

        rows = [judge(t) for t in texts]
        return pd.DataFrame(rows, columns=new[:6]).astype({"licence": object, "score": "Float64", "start": "Int64", "stop": "Int64", "licence_file": bool})

    # Other columns travel as one struct, so that no name of theirs is in the way.
    row = F.struct(*[F.col(f"`{c}`") for c in files.columns if c != text and c not in new])
    found = files.select(row.alias("row"), F.col(f"`{path}`").alias("path"), find(F.col(f"`{text}`")).alias("found"))
    found = found.select("row", "path", "found.*").withColumn("_dir", directory(F.col("path")))
    return inherit(stored(found, "licences")).select("row.*", *new)


def directory(path: Column) -> Column:
    """The part before the last slash, empty without one."""
    return F.regexp_extract(path, r"^(?s)(.*)/[^/]*$", 1)


def inherit(found: DataFrame, path: str = "path") -> DataFrame:
    """Adds inherited and inherited_from by joins of directories with the licence files above them."""
    files = found.filter(F.col("licence_file") & F.col(path).isNotNull())
    held = files.groupBy("_dir").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(path).alias("p"), "licence")).alias("best"))
    held = held.select(F.col("_dir").alias("_above"), F.col("best.licence").alias("inherited"), F.col("best.p").alias("inherited_from"))
    # Each directory that needs a licence, once, with all directories above it; the root is the empty string.
    needy = found.filter(F.col("licence").isNull() & F.col(path).isNotNull()).select("_dir").distinct()
    parts = F.when(F.col("_dir") == "", F.array().cast("array<string>")).otherwise(F.split("_dir", "/"))
    needy = needy.withColumn("_n", F.size(parts)).select("_dir", F.posexplode(F.transform(F.sequence(F.col("_n"), F.lit(0)), lambda k: F.when(k == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, k), "/")))).alias("_up", "_above"))
    near = needy.join(held, "_above").groupBy("_dir").agg(F.min(F.struct("_up", "inherited", "inherited_from")).alias("_near"))
    near = near.select("_dir", F.lit(False).alias("_own"), "_near.inherited", "_near.inherited_from")
    out = found.withColumn("_own", F.col("licence").isNotNull() | F.col(path).isNull())
    return out.join(near, ["_dir", "_own"], "left").drop("_own")
