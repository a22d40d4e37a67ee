"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs (lines, and the sentences of blocks of lines) are described by word 1- to 3-grams that occur in licence
templates. Logistic regressions with an L1 penalty, so with few weights, tell for each family on its own whether a paragraph
grants it; so a dual licence shows both. Their probabilities are calibrated by a temperature and a threshold for "unknown" on
held-out samples and on whole templates that the calibrated fit has not seen. A prediction counts only if a template of the
family is largely contained in the paragraph, or the paragraph in it.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
UNKNOWN = "unknown"
SENTENCE_END = re.compile(r"[.!?;](?=\s)")
PART = 5  # distinct pairs of words from which a part of a template counts

# Usual notices of each family and passages of the licences themselves, as their publishers word them.
TEMPLATES = {
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
        "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.",
        "Apache License Version 2.0, January 2004",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:",
        "Unless You explicitly state otherwise, any Contribution intentionally submitted for inclusion in the Work by You to the Licensor shall be under the terms and conditions of this License, without any additional terms or conditions.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Licensed under the 3-clause BSD License.",
        "Licensed under the 2-clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.',
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC0-1.0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. Dedicated to the public domain under CC0 1.0 Universal.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "EPL-2.0": (
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
        'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT\'S ACCEPTANCE OF THIS AGREEMENT.',
        "Eclipse Public License - v 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "EUPL-1.2": (
        "Licensed under the EUPL, Version 1.2.",
        'Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence");',
        "European Union Public Licence v. 1.2",
        "SPDX-License-Identifier: EUPL-1.2",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "Activities other than copying, distribution and modification are not covered by this License; they are outside its scope.",
        "You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty.",
        "You are not required to accept this License, since you have not signed it. However, nothing else grants you permission to modify or distribute the Program or its derivative works.",
        "You must cause the modified files to carry prominent notices stating that you changed the files and the date of any change.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
        "SPDX-License-Identifier: ISC",
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "Mozilla Public License Version 2.0",
        "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license:",
        "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "Zlib": (
        "Released under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "SPDX-License-Identifier: Zlib",
    ),
}
# Names by which the families are called.
NAMES = {
    "AGPL-3.0": ("AGPLv3", "AGPL-3.0", "GNU AGPL v3"),
    "Apache-2.0": ("Apache License 2.0", "Apache 2.0", "Apache License, Version 2.0"),
    "BSD": ("BSD-3-Clause", "BSD-2-Clause", "BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "3-Clause BSD License", "2-Clause BSD License"),
    "BSL-1.0": ("BSL-1.0", "Boost Software License 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "CC0-1.0": ("CC0 1.0", "CC0"),
    "EPL-2.0": ("EPL-2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "EUPL-1.2": ("EUPL-1.2", "European Union Public Licence 1.2"),
    "GPL-2.0": ("GPLv2", "GPL-2.0", "GNU GPL v2", "GPL-2.0-only", "GPL-2.0-or-later", "GNU General Public License v2.0"),
    "GPL-3.0": ("GPLv3", "GPL-3.0", "GNU GPL v3", "GPL-3.0-only", "GPL-3.0-or-later", "GNU General Public License v3.0"),
    "ISC": ("ISC License", "ISC"),
    "LGPL-2.1": ("LGPLv2.1", "LGPL-2.1", "GNU LGPL v2.1"),
    "LGPL-3.0": ("LGPLv3", "LGPL-3.0", "GNU LGPL v3"),
    "MIT": ("MIT License", "MIT", "MIT License (MIT)"),
    "MPL-2.0": ("MPL 2.0", "Mozilla Public License 2.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License", "zlib"),
}
# Forms of a line that is a title, of a notice, and of talk that grants nothing, about a name.
TITLE_FORMS = ("{}", "The {}", "License: {}", "Licence: {}")
NOTICE_FORMS = ("licensed under {}", "licensed under the {}", "released under {}", "released under the {}", "released under a {}", "distributed under {}", "distributed under the {}", "available under the {}", "is {} licensed")
TALK_FORMS = ("This is not licensed under the {}.", "It was never released under the {}.", "The code is not distributed under {}.", "This work is not available under the {}.", "It is not {} licensed.", "No part of it is licensed under {}.")
TITLE = 10  # words of a line that may be a title
# Talk of licences that grants none.
NEAR_MISSES = (
    "All rights reserved.", "Copyright 2020 by the authors.", "See the license file for details.", "A driver's license is required.", "The license was revoked by the court.", "This software is proprietary and confidential.",
    "MIT is a university in Cambridge.", "The Apache helicopter was seen again.", "The general public may use this work.", "Released under pressure from the public.", "This work is licensed.", "Version 3 of the software is available.", "Licensed under a commercial agreement.",
)


TALK = r"(?i)licen[cs]e|copyright|spdx|creative commons|\bcc[ -]by|public domain|redistribut"


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def grams(ts: list[str], least: int = 1, most: int = 3) -> set[tuple[str, ...]]:
    return {tuple(ts[i : i + n]) for n in range(least, most + 1) for i in range(len(ts) - n + 1)}


@dataclass(frozen=True)
class LicenceModel:
    """What fit() learned. titles: pairs of words of whole lines that name a licence."""

    families: tuple[str, ...]
    index: dict[tuple[str, ...], int]
    weights: np.ndarray  # grams x families
    bias: np.ndarray
    temperature: float
    threshold: float
    templates: dict[str, tuple[frozenset, ...]]  # pairs of words
    agreement: float
    titles: dict[str, tuple[frozenset, ...]] = field(default_factory=dict)

    @cached_property
    def pairs(self) -> frozenset:
        return frozenset().union(*(t for ts in self.templates.values() for t in ts))

    @cached_property
    def least_pairs(self) -> int:
        """Fewer template pairs than this confirm no template, so a paragraph with fewer needs no score."""
        least = min((len(t) for ts in self.templates.values() for t in ts), default=1)
        return max(1, math.ceil(self.agreement * min(least, PART) - 1e-9))

    @cached_property
    def title_pairs(self) -> frozenset:
        return frozenset().union(*(t for ts in self.titles.values() for t in ts))

    @cached_property
    def holders(self) -> dict[tuple[str, str], list[tuple[int, int, int, bool]]]:
        """For each pair of words the (number, family, size, whether it is a title) of the templates that have it."""
        out: dict = {}
        every = [(k, t, title) for k, f in enumerate(self.families) for ts, title in ((self.templates[f], False), (self.titles.get(f, ()), True)) for t in ts]
        for n, (k, t, title) in enumerate(every):
            for p in t:
                out.setdefault(p, []).append((n, k, len(t), title))
        return out

    def worth(self, ts: list[str]) -> bool:
        """Whether a template may be confirmed somewhere in the words, or a title in a line of them."""
        known, named = self.pairs, self.title_pairs
        own = {p for p in zip(ts, ts[1:]) if p in known or p in named}
        return len(own) >= self.least_pairs and len(own & known) >= self.least_pairs or not own.isdisjoint(named)

    def agreements(self, ts: list[str]) -> dict[int, float]:
        """confirmed() of the families that share a pair of words with the paragraph."""
        own = set(zip(ts, ts[1:]))
        both: dict = {}
        for p in own:
            for t in self.holders.get(p, ()):
                both[t] = both.get(t, 0) + 1
        best: dict[int, float] = {}
        for (_, k, size, title), n in both.items():
            if title:
                share = n / max(size, len(own)) if len(ts) <= TITLE else 0.0
            else:
                share = max(n / size, n / len(own) if len(own) >= PART else 0.0)
            best[k] = max(best.get(k, 0.0), share)
        return best

    def found(self, ts: list[str]) -> list[int]:
        """Columns of the known grams among tokens."""
        known, index = self.index, self.index
        one = [(t,) in known for t in ts]
        out = set()
        for i, ok in enumerate(one):
            if not ok:
                continue
            for n in (1, 2, 3):
                if (k := index.get(tuple(ts[i : i + n]))) is not None:
                    out.add(k)
        return sorted(out)

    def probabilities(self, ts: list[str]) -> np.ndarray:
        """One for each family; they need not add up to 1."""
        z = (self.bias + self.weights[self.found(ts)].sum(axis=0)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def confirmed(self, family: str, ts: list[str]) -> float:
        """Largest share of pairs of words that a template has in the paragraph or, for a part of a template, the reverse.

        A part counts from five distinct pairs on. A title has to agree both ways, so it is confirmed only where it
        stands alone.
        """
        own = grams(ts, 2, 2)
        best = 0.0
        for t in self.templates[family]:
            both = len(own & t)
            best = max(best, both / len(t), both / len(own) if len(own) >= PART else 0.0)
        if own and len(ts) <= TITLE:
            best = max([best, *(len(own & t) / max(len(own), len(t)) for t in self.titles.get(family, ()))])
        return best

    def families_of(self, paragraph: str) -> list[tuple[str, float, float]]:
        """(family, probability, agreement) of every family above the threshold that a template confirms, likeliest first."""
        ts = tokens(paragraph)
        if not self.worth(ts):
            return []
        same = {k: v for k, v in self.agreements(ts).items() if v >= self.agreement}
        if not same:
            return []
        p = self.probabilities(ts)
        return sorted(((self.families[k], float(p[k]), v) for k, v in same.items() if p[k] >= self.threshold), key=lambda g: (-g[1], g[0]))

    def classify(self, paragraph: str) -> tuple[str, float, float]:
        """(likeliest family, probability, agreement with its templates), or unknown."""
        ts = tokens(paragraph)
        best = next(iter(self.families_of(paragraph)), None)
        return best or (UNKNOWN, float(1 - self.probabilities(ts).max()), 0.0)

    def scan(self, text: str) -> tuple[int, list[tuple[int, str, float, float]]]:
        """(lines that are not blank, hits (line, family, probability, agreement)).

        Lines are judged whole, then the sentences of each block of lines between blank ones, as they run on over line
        ends. A family shows once in a block, by its first line or else the line on which its sentence begins.
        """
        count, hits, block = 0, [], []
        for line in [*text.split("\n"), ""]:
            if line.strip():
                block.append(line)
                continue
            if block:
                hits += self._block(block, count)
                count += len(block)
                block = []
        return count, hits

    def _block(self, lines: list[str], first: int) -> list[tuple[int, str, float, float]]:
        whole = "\n".join(lines)
        if not self.worth(tokens(whole)):
            return []
        hits, seen = [], set()

        def keep(at: int, part: str) -> None:
            for family, p, same in self.families_of(part):
                if family not in seen:
                    seen.add(family)
                    hits.append((first + at, family, p, same))

        for k, line in enumerate(lines):
            keep(k, line)
        at = 0
        for end in [*(m.end() for m in SENTENCE_END.finditer(whole)), len(whole)]:
            if (at or end < len(whole) or len(lines) > 1) and whole[at:end].strip():
                begin = at + len(whole[at:end]) - len(whole[at:end].lstrip())
                keep(whole.count("\n", 0, begin), whole[at:end])
            at = end
        return sorted(hits)


def _varied(rng: random.Random, text: str, filler: list[str]) -> str:
    """A template as it is met: in part, with words lost, amid other words."""
    ws = text.split()
    if len(ws) > 14 and rng.random() < 0.4:
        cut = rng.randrange(8, len(ws))
        at = rng.randrange(len(ws) - cut + 1)
        ws = ws[at : at + cut]
    if len(ws) > 10:
        ws = [w for w in ws if rng.random() > 0.05]
    if filler and rng.random() < 0.4:
        more = rng.choice(filler).split()[: rng.randrange(1, 40)]
        ws = more + ws if rng.random() < 0.5 else ws + more
    return " ".join(ws)


def _amid(rng: random.Random, notice: str, filler: list[str]) -> str:
    """A short notice whole, within a sentence of its own or amid other words."""
    if notice.endswith("."):
        said = notice
    else:
        said = rng.choice(("This software is {}.", "The code is {}.", "It is {}", "{}.", "{}")).format(notice).replace("is is ", "is ")
    more = rng.choice(filler).split()[: rng.randrange(1, 20)] if filler and rng.random() < 0.4 else []
    return " ".join([*more, said] if rng.random() < 0.5 else [said, *more])


def _design(texts: list[str], shell: LicenceModel) -> np.ndarray:
    x = np.zeros((len(texts), len(shell.index)), np.float32)
    for r, t in enumerate(texts):
        x[r, shell.found(tokens(t))] = 1
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _descend(x: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a logistic regression a column of y with an L1 penalty, by accelerated proximal steps.

    Equal rows are taken together with their number.
    """
    total = len(x)
    _, first, times = np.unique(np.packbits(np.hstack([x, y]) > 0, axis=1), axis=0, return_index=True, return_counts=True)
    x, y, times = x[first], y[first], times.astype(np.float32)[:, None]
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (times[:, 0] * (x @ v))
        v /= np.linalg.norm(v)
    step = 4 * total / (float(times[:, 0] @ (x @ v) ** 2) + total)
    w = prev = np.zeros((x.shape[1], y.shape[1]), np.float32)
    b = np.zeros(y.shape[1], np.float32)
    t = 1.0
    for _ in range(steps):
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u = w + np.float32((t - 1) / t2) * (w - prev)
        g = times * (_sigmoid(x @ u + b) - y)
        new = u - step * (x.T @ g) / total
        new = np.sign(new) * np.maximum(0, np.abs(new) - np.float32(step * penalty))
        b = b - step * g.sum(axis=0) / total
        w, prev, t = new.astype(np.float32), w, t2
    return w, b


def fit(unknown: list[str], copies: int = 40, penalty: float = 1e-4, steps: int = 300, agreement: float = 0.75, seed: int = 7) -> LicenceModel:
    """Fits on variations of the templates against `unknown` paragraphs and NEAR_MISSES.

    A first fit leaves out a quarter of the rows and a whole template of each family with four and more; on these the
    temperature and the threshold are set. The fit that is kept has all rows.
    """
    rng = random.Random(seed)
    families = tuple(sorted(TEMPLATES))
    index: dict[tuple[str, ...], int] = {}
    owners: dict[str, set[int]] = {}
    for k, f in enumerate(families):
        for t in TEMPLATES[f]:
            owners.setdefault(t, set()).add(k)
            for g in sorted(grams(tokens(t))):
                index.setdefault(g, len(index))
    titles = {f: [t for name in NAMES[f] for form in TITLE_FORMS if len(tokens(t := form.format(name))) > 1] for f in families}
    notices = {f: [form.format(name) for name in NAMES[f] for form in NOTICE_FORMS] for f in families}
    talk = [form.format(name) for f in families for name in NAMES[f] for form in TALK_FORMS]
    for t in sorted({t for f in families for t in titles[f] + notices[f]}) + list(TALK_FORMS):
        for g in sorted(grams(tokens(t))):
            index.setdefault(g, len(index))
    unseen = {TEMPLATES[f][1] for f in families if len(TEMPLATES[f]) >= 4}
    rows = [(_varied(rng, t, unknown) if c else t, ks, t in unseen) for t, ks in owners.items() for c in range(copies)]
    for k, f in enumerate(families):
        named = [(t, {k}, False) for t in titles[f] for _ in range(3)]
        named += [(_amid(rng, t, unknown) if c else t, {k}, False) for t in notices[f] for c in range(4)]
        rows += [(t, ks, n % 10 == 9) for n, (t, ks, _) in enumerate(named)]
    rows += [(_amid(rng, t, unknown) if c else t, set(), n % 10 == 9) for n, t in enumerate(talk) for c in range(3)]
    short = {f: TEMPLATES[f][-1].rpartition(": ")[2] for f in families}
    for _ in range(2 * copies):  # a choice of two
        a, b = rng.sample(range(len(families)), 2)
        for text in (f"SPDX-License-Identifier: {short[families[a]]} OR {short[families[b]]}", f"{TEMPLATES[families[a]][0]} {TEMPLATES[families[b]][0]}"):
            rows.append((text, {a, b}, False))
    rows += [(t, set(), False) for t in [*unknown, *NEAR_MISSES * copies]]
    rows += [(" ".join(rng.choice(unknown or ["a b"]).split()[: rng.randrange(1, 60)]), set(), False) for _ in range(len(unknown))]
    rng.shuffle(rows)
    shell = LicenceModel(families, index, np.zeros((len(index), len(families))), np.zeros(len(families)), 1.0, 0.5, {}, agreement)
    x = _design([t for t, _, _ in rows], shell)
    y = np.zeros((len(rows), len(families)), np.float32)
    for r, (_, ks, _) in enumerate(rows):
        y[r, list(ks)] = 1
    held = np.array([new or r < len(rows) // 4 for r, (_, _, new) in enumerate(rows)])
    w, b = _descend(x[~held], y[~held], penalty, steps)
    z, truth = x[held] @ w + b, y[held]
    loss = lambda temp: -np.log(np.abs(1 - truth - _sigmoid(z / temp)) + 1e-12).mean()
    temperature = float(min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0), key=loss))
    pairs = lambda ts: tuple(dict.fromkeys(frozenset(grams(tokens(t), 2, 2)) for t in ts))
    templates = {f: pairs([*TEMPLATES[f], *(t for t in notices[f] if len(tokens(t)) > 2)]) for f in families}
    shell = replace(shell, templates=templates, titles={f: pairs(ts) for f, ts in titles.items()})
    # of paragraphs that grant nothing, the likeliest family that a template confirms: no other can be reported
    wrong = []
    for p, text in zip(_sigmoid(z / temperature)[truth.sum(axis=1) == 0], [t for (t, ks, _), h in zip(rows, held) if h and not ks]):
        wrong.append(max((float(p[k]) for k in np.flatnonzero(p > 0.5) if shell.confirmed(families[k], tokens(text)) >= agreement), default=0.0))
    wrong.sort()
    threshold = min(0.95, max(0.5, wrong[int(0.995 * (len(wrong) - 1))] if wrong else 0.5))
    w, b = _descend(x, y, penalty, steps)
    return replace(shell, weights=w.astype(float), bias=b.astype(float), temperature=temperature, threshold=threshold)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 300, max_paragraphs: int = 1500) -> LicenceModel:
    """Fits with max_paragraphs paragraphs without licence words of max_docs documents, both those of least hash."""
    # two steps, so that texts of no more than max_docs rows are moved
    ids = docs.select(id_col).where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(max_docs)
    rows = docs.select(id_col, text_col).join(F.broadcast(ids.distinct()), id_col, "left_semi").orderBy(id_col, text_col).limit(max_docs)
    p = F.trim(F.col("p"))
    found = rows.select(F.explode(F.split(text_col, "\n")).alias("p")).select(p.alias("p")).where((F.size(F.split("p", " ")) > 1) & ~F.col("p").rlike(TALK)).distinct()
    return fit(sorted(r.p for r in found.orderBy(F.xxhash64("p"), "p").limit(max_paragraphs).collect()))


def scan(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_paragraphs, licences (families found, ascending), licence (the most probable; of equal
    ones the last by name), and hits: (paragraph, family, probability, agreement) by paragraph and family.

    A paragraph is a line that is not blank; licences that run over line ends count where they begin. The whole text is
    read, however long; time is in proportion to it. Null and empty texts have no paragraph. Repeated rows come out as
    often as they occur, an empty table gives an empty one, extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size follows the templates
    hit = "array<struct<paragraph: int, family: string, probability: double, agreement: double>>"

    @F.pandas_udf(f"n_paragraphs long, hits {hit}")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            n, hits = shared.value.scan(t or "")
            rows.append((n, [dict(zip(("paragraph", "family", "probability", "agreement"), h)) for h in hits]))
        return pd.DataFrame(rows, columns=["n_paragraphs", "hits"])

    out = docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("r")).select("doc_id", "r.*")
    best = F.array_max(F.transform("hits", lambda h: F.struct(h["probability"], h["family"])))
    return out.select("doc_id", "n_paragraphs", F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["family"]))).alias("licences"), best["family"].alias("licence"), "hits")
