"""Licence scan: a trained paragraph classifier confirmed by template comparison, with SQL functions only.

A paragraph is what lies between blank lines, so notices wrapped over lines are whole;
a long one is read in windows of ``WINDOW`` words, every half window.  Word n-grams (one and
two words) of sentences of each licence family, with words dropped and other words around
them, and of other prose with the same words train a multinomial logistic regression with
an L1 penalty, so that most weights are zero.  One class is "unknown"; a temperature fitted
on examples kept apart calibrates the probabilities.

Every window of every paragraph is classified.  Its family is the likeliest class if that is
not "unknown", reaches ``least``, and a template of the same family confirms it: the window
holds at least ``coverage`` of the template's n-grams.  Otherwise it is "unknown".

How it runs: one narrow pass without a shuffle.  Words become numbers through a literal table
of hash buckets (an array of small maps, so a lookup costs the same whatever the vocabulary),
numbers and pairs of them become n-grams, and weights are summed, from literal arrays.
All tables have a size fixed by the templates.

Edge cases: null and empty texts have no paragraph.  Very long texts and lines are read
whole, window by window.  Rows that repeat a doc_id and text are found once each; those with
another text are told apart by ``version``.  A null doc_id is carried along.  Of windows that
tie, each stands for itself; of equal classes the first in ``FAMILIES`` wins.  An empty table
gives an empty result.  Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket, buckets, literal

UNKNOWN = "unknown"
TOKEN = r"[a-z0-9]+(?:[.+\-][a-z0-9]+)*"
#: Words in a window, and hash buckets of the literal tables.
WINDOW, BUCKETS = 100, 512

# Sentences by which licences are named or granted, by family.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "This project is distributed under the terms of the MIT license, see the LICENSE file.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the 2-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "either version 3 of the License, or (at your option) any later version of the GNU General Public License",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "Licensed under GPL-3.0.",
        "Licensed under the GPLv3 or later.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "MPL": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Released under the Unlicense license.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "Zlib": [
        "Licensed under the zlib license.",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "Boost": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",
        "SPDX-License-Identifier: BSL-1.0",
    ],
}
# Sentences with the same words that name no licence.
OTHERS = [
    "A driver must carry a valid license at all times.",
    "The license of the restaurant was renewed last year.",
    "She is a licensed nurse and works in version two of the programme.",
    "Permission to land was granted by the tower, free of charge.",
    "The copyright of the song belongs to the composer.",
    "All rights reserved. Do not copy without permission.",
    "Please read the terms of the license before you sign.",
    "The software is licensed per seat under the terms of the contract.",
    "Licensed under a custom agreement between both parties.",
    "The new version of the software was released to the public.",
    "Fishing licenses are sold at the general store.",
    "Public libraries and the foundation are free to use.",
    "The apache helicopter and the mozilla mascot were on show.",
    "This work is protected by copyright law.",
    "Released under license from the publisher in 2004.",
    "The license fee is subject to the following conditions.",
    "Creative people need a license to fail, say common sense and the public.",
    "General terms: a copy of the license is kept in the source file.",
    "No part of this publication may be reproduced, distributed or transmitted in any form or by any means without the prior written permission of the publisher.",
    "You may not use, copy or modify this software; it is proprietary and confidential.",
    "By using this website you agree to the terms of service and the privacy policy.",
    "The court held that the license did not cover redistribution of the photographs.",
    "Students at MIT published a paper on the general theory of public goods.",
    "The boost to the economy was distributed over all regions of the country.",
    "The authors will not be held liable for any loss arising from the use of this book.",
    "Warranty is void if the seal is broken; see the manual for more details.",
    "The library is open to the public; you should have received a card along with this letter.",
    "The unlicensed taxi was stopped near the creative district of the city.",
    "We compared several open source licenses and found that most projects use a permissive one.",
    "Attribution of the painting to the master is disputed by international experts.",
    "The foundation published a list of conditions and a disclaimer with the documentation.",
    "In the hope that it will be useful we list the opening hours of the museum.",
    "The binary was compiled from source with the new compiler without modification.",
    "Permission is needed to film in the park; a copy of the notice shall be shown to the guard.",
    "This program is broadcast every evening and can be received in the whole country.",
    "Anyone is free to attend, either in person or by any other means.",
]
FAMILIES = [UNKNOWN, *TEMPLATES]
COMMON = "the of and is in to a for that with was on by this it as are be from or an at which have not work license software copy terms under use free any other all time people said year world".split()


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def grams(words: list[str]) -> set[str]:
    """One word of at least four letters, or two words."""
    return {*(w for w in words if len(w) > 3), *(f"{a} {b}" for a, b in zip(words, words[1:]))}


@dataclass(frozen=True)
class Model:
    """``weights[gram]``: a weight a class; ``templates``: (family number, n-grams)."""

    bias: np.ndarray
    weights: dict[str, np.ndarray]
    temperature: float
    templates: list[tuple[int, set[str]]]

    def probabilities(self, found: set[str]) -> np.ndarray:
        z = (self.bias + sum((self.weights[g] for g in found if g in self.weights), np.zeros(len(self.bias)))) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def examples(copies: int, seed: int) -> list[tuple[list[str], int]]:
    """Sentences with up to a quarter of their words dropped and other words around them; halves of two other sentences; plain words."""
    rng = random.Random(seed)
    syllables = ["ta", "mo", "re", "lin", "ko", "ra", "sen", "do", "mik", "al", "ver", "un"]

    def filler(n: int) -> list[str]:
        return [rng.choice(COMMON) if rng.random() < 0.4 else rng.choice(syllables) + rng.choice(syllables) for _ in range(n)]

    out = []
    for y, texts in enumerate([OTHERS, *TEMPLATES.values()]):
        for text in texts:
            for _ in range(copies):
                words = tokens(text)
                gone = rng.random() * (0.25 if len(words) > 6 else 0.12)
                kept = [w for w in words if rng.random() >= gone] or words
                room = rng.choice([0, 8, WINDOW - len(kept)])
                cut = rng.randrange(room + 1) if room > 0 else 0
                out.append((filler(cut) + kept + filler(max(0, room - cut)), y))
    for _ in range(copies * len(OTHERS)):
        a, b = (tokens(rng.choice(OTHERS)) for _ in range(2))
        out.append((filler(rng.randrange(40)) + a[: rng.randrange(1 + len(a))] + b[rng.randrange(1 + len(b)) :] + filler(rng.randrange(40)), 0))
        out.append((filler(rng.randrange(4, WINDOW)), 0))
    return out


def matrix(rows: list[tuple[list[str], int]], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(rows), len(number)), np.float32)
    for i, (words, _) in enumerate(rows):
        x[i, [number[g] for g in grams(words) if g in number]] = 1
    return x, np.array([y for _, y in rows])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@lru_cache(maxsize=1)
def trained(copies: int = 8, steps: int = 160, rate: float = 2.0, l1: float = 4e-5) -> Model:
    """Accelerated proximal gradient descent on the fixed sentences above; the driver does this once, its size never changes."""
    vocabulary = sorted({g for texts in [OTHERS, *TEMPLATES.values()] for t in texts for g in grams(tokens(t))})
    number = {g: k for k, g in enumerate(vocabulary)}
    x, y = matrix(examples(copies, 1), number)
    n_classes = len(FAMILIES)
    share = np.bincount(y, minlength=n_classes)
    row = (1 / share[y] * np.where(y == 0, 4, 1))[:, None].astype(np.float32) / (n_classes + 3)
    onto = np.eye(n_classes, dtype=np.float32)[y]
    w, b = np.zeros((len(vocabulary), n_classes), np.float32), np.zeros(n_classes, np.float32)
    ahead, t = w, 1.0
    for _ in range(steps):
        miss = (softmax(x @ ahead + b) - onto) * row
        step = ahead - rate * (x.T @ miss)
        step = np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = step + (t - 1) / t_next * (step - w), step, t_next
        b -= rate * miss.sum(0)
    apart, truth = matrix(examples(3, 2), number)
    z = apart @ w + b
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = min((0.25 * 1.2**k for k in range(16)), key=loss)
    weights = {g: w[k].astype(np.float64) for g, k in number.items() if np.any(w[k])}
    templates = [(FAMILIES.index(f), grams(tokens(t))) for f, texts in TEMPLATES.items() for t in texts]
    return Model(b.astype(np.float64), weights, float(temperature), templates)


def once(value: Column, keep=None) -> Column:
    """``value`` as a generated column, so that filters and later steps don't compute it again; rows that don't meet ``keep`` go."""
    return F.explode(F.filter(F.array(value), keep) if keep else F.array(value))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, version, paragraph, words) of every paragraph with a word."""
    text = F.coalesce(docs["text"], F.lit(""))
    cut = docs.select("doc_id", F.xxhash64(text).alias("version"), F.posexplode(F.split(text, r"\n[ \t\r\x0b\x0c]*\n", -1)).alias("paragraph", "block"))
    words = F.regexp_extract_all(F.lower("block"), F.lit(f"({TOKEN})"), F.lit(1))
    return cut.select("doc_id", "version", "paragraph", once(words, lambda w: F.size(w) > 0).alias("words"))


def scanned(docs: DataFrame, least: float = 0.6, coverage: float = 0.6, model: Model | None = None) -> DataFrame:
    """doc_id, version, paragraph, part, family, probability, unknown_probability and the confirming template's coverage.

    One row a window whose likeliest class is a family; ``family`` is "unknown" where that is not confirmed.
    """
    m = model or trained()
    every = sorted({*m.weights, *(g for _, gs in m.templates for g in gs)})
    number = {g: k for k, g in enumerate(every)}
    words = sorted({w for g in every for w in g.split()})
    place = {w: k for k, w in enumerate(words)}
    follow: list[list[tuple[int, int]]] = [[] for _ in words]
    for g, k in number.items():
        if " " in g:
            follow[place[g.split()[0]]].append((place[g.split()[1]], k))
    zero = np.zeros(len(FAMILIES))
    table = literal([m.weights.get(g, zero).tolist() for g in every], "array<array<double>>")
    word_table, alone = buckets(words, BUCKETS), literal([number.get(w) for w in words], "array<int>")
    seconds, pairs = (literal([[x[k] for x in of] for of in follow], "array<array<int>>") for k in (0, 1))

    key, there = ["doc_id", "version", "paragraph"], lambda x: x.isNotNull()
    ids = F.transform("words", lambda w: F.element_at(F.get(word_table, bucket(w, BUCKETS)), w))
    numbered = paragraphs(docs).select(*key, once(ids, lambda a: F.exists(a, there)).alias("ids"))
    one = F.transform("ids", lambda w: F.get(alone, w))
    two = F.transform("ids", lambda w, i: F.get(F.get(pairs, w), F.array_position(F.get(seconds, w), F.get("ids", i + 1)) - 1))
    known = numbered.select(*key, F.size("ids").alias("n"), once(F.struct(one.alias("one"), two.alias("two"))).alias("at"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - WINDOW) / (WINDOW // 2)).cast("int"))
    parts = known.select(*key, "at", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    own = lambda c: F.slice(c, F.col("part") * (WINDOW // 2) + 1, F.lit(WINDOW))
    grams_of = F.array_distinct(F.filter(F.concat(own(F.col("at.one")), own(F.col("at.two"))), there))
    met = parts.select(*key, "part", once(grams_of, lambda a: F.size(a) > 0).alias("grams"))
    start = literal(m.bias.tolist(), "array<double>")
    z = F.aggregate("grams", start, lambda acc, g: F.zip_with(acc, F.get(table, g), lambda a, b: a + b), lambda acc: F.transform(acc, lambda v: v / m.temperature))
    best = met.select("*", once(z).alias("z")).withColumn("best", (F.array_position("z", F.array_max("z")) - 1).cast("int")).where("best > 0")
    p = best.withColumn("e", F.transform("z", lambda v: F.exp(v - F.array_max("z")))).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    hits = F.lit(0.0)
    for family in range(1, len(FAMILIES)):
        shares = [F.size(F.array_intersect("grams", literal([number[g] for g in sorted(gs)], "array<int>"))) / float(len(gs)) for k, gs in m.templates if k == family]
        hits = F.when(F.col("best") == family, F.greatest(*shares, F.lit(0.0))).otherwise(hits)
    p = p.withColumn("probability", F.element_at("e", F.col("best") + 1) / F.col("total")).withColumn("unknown_probability", F.element_at("e", 1) / F.col("total")).withColumn("coverage", hits)
    sure = (F.col("probability") >= least) & (F.col("coverage") >= coverage)
    name = F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("best") + 1)
    return p.select("doc_id", "version", "paragraph", "part", F.when(sure, name).otherwise(UNKNOWN).alias("family"), "probability", "unknown_probability", "coverage")
