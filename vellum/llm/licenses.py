"""Licence scans: windows of normalised text against licence templates by the Dice coefficient over word bigrams.

A template of n bigrams is compared with the windows of n bigrams of a text
(less at the text's end). The Dice coefficient of two bags of n and m bigrams
that share x is 2x / (n + m), so that a window needs t x n / (2 - t) of the
template's bigrams, and a text as many at all, to reach t: this prunes
templates and windows before any bag is compared.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.words import mix, runs, text_words

DICE = 0.8
MAX_TEMPLATE_BYTES = 16 << 20  # templates are broadcast

# Notices by which texts name their licence, and the opening paragraphs of licences.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE "
                   "file distributed with this work for additional information regarding copyright ownership. The ASF licenses this "
                   "file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("Apache-1.1", "Licensed under the Apache Software License, Version 1.1."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this "
                "file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which "
                "accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which "
                "is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the "
                 "\"License\"). You may not use this file except in compliance with the License."),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions "
                 "of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence."),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
                "http://www.boost.org/LICENSE_1_0.txt)"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("BSD-4-Clause", "Released under the 4-Clause BSD License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Released under the ISC License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("CC0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or "
                "neighboring rights to this work."),
    ("CC0-1.0", "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

# Fixed values: (name, what the header calls the work, the licence, its version) of the GNU licences.
GNU = [("GPL-1.0", "program", "GNU General Public License", "1"), ("GPL-2.0", "program", "GNU General Public License", "2"),
       ("GPL-3.0", "program", "GNU General Public License", "3"), ("LGPL-2.0", "library", "GNU Library General Public License", "2"),
       ("LGPL-2.1", "library", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "library", "GNU Lesser General Public License", "3"),
       ("AGPL-3.0", "program", "GNU Affero General Public License", "3")]
for _name, _work, _license, _version in GNU:
    for _subject in dict.fromkeys((_work, "program")):
        _opening = f"This {_subject} is free software; you can redistribute it and/or modify it under the terms of the {_license}"
        TEMPLATES += [(_name, f"{_opening} as published by the Free Software Foundation, either version {_version} of the License, or (at your "
                              "option) any later version."),
                      (_name, f"{_opening} as published by the Free Software Foundation; version {_version} of the License."),
                      (_name, f"{_opening} version {_version} as published by the Free Software Foundation.")]
    TEMPLATES += [(_name, f"Licensed under the {_license}, version {_version}."),
                  (_name, f"under the terms of the {_license} version {_version} or later"),
                  (_name, f"under the terms of the {_license}, version {_version}, or (at your option) any later version")]
for _version in ("1.1", "1.2", "1.3"):
    TEMPLATES.append((f"GFDL-{_version}", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
                                          f"Documentation License, Version {_version} or any later version published by the Free Software Foundation;"))

# Versions and elements of the Creative Commons licences.
CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
CC_ELEMENTS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
               "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _code, _elements in CC_ELEMENTS.items():
    for _version, _kind in CC_VERSIONS.items():
        TEMPLATES += [(f"CC-{_code}-{_version}", f"Licensed under CC {_code} {_version}."),
                      (f"CC-{_code}-{_version}", f"This work is licensed under a Creative Commons {_elements} {_version} {_kind} License."),
                      (f"CC-{_code}-{_version}", f"This work is licensed under a Creative Commons {_elements} {_version} License."),
                      (f"CC-{_code}-{_version}", f"Creative Commons {_elements} {_version} {_kind}"),
                      (f"CC-{_code}-{_version}", f"licensed under a Creative Commons {_elements} {_version} License")]

# Openings that several licences share and notices without a version; they have a family's name.
OPENINGS: list[tuple[str, str]] = [
    ("MIT-family", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                   "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
                   "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
                   "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("BSD-family", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                   "the following conditions are met:"),
    ("BSD-family", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC-family", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
]
for _name, _license in dict.fromkeys((n.split("-")[0], x) for n, _, x, _ in GNU):
    OPENINGS += [(f"{_name}-family", f"Licensed under the {_license}."),
                 (f"{_name}-family", f"This program is free software; you can redistribute it and/or modify it under the terms of the {_license} as "
                                     "published by the Free Software Foundation.")]
OPENINGS += [(f"CC-{c}-family", f"This work is licensed under a Creative Commons {e} License.") for c, e in CC_ELEMENTS.items()]


def whole_texts() -> list[tuple[str, str]]:
    """(licence, its whole text) of the files beside this module; read on the driver."""
    return [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8"))
            for f in sorted((resources.files("vellum.llm") / "license_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")]


def bigrams(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * np.uint64(0x100000001B3) + words[1:]) if len(words) > 1 else np.zeros(0, np.uint64)


def dice(shared: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    return 2 * shared / (n + m)


@dataclass
class Templates:
    names: list[str]
    bags: list[Counter]
    sizes: list[int]
    threshold: float
    keys: np.ndarray  # all templates' bigrams, sorted
    caps: np.ndarray  # (templates, bigrams) how often a template has them
    owners: np.ndarray  # (templates, bigrams) which templates have them
    near: np.ndarray

    @classmethod
    def of(cls, templates: Sequence[tuple[str, str]], threshold: float = DICE) -> Templates:
        if sum(len(t.encode()) for _, t in templates) > MAX_TEMPLATE_BYTES:
            raise ValueError("templates are too large to be broadcast at once; scan in several calls")
        bags = [Counter(bigrams(text_words(t)).tolist()) for _, t in templates]
        keep = [i for i, b in enumerate(bags) if b]
        keys = np.array(sorted(set().union(*[bags[i] for i in keep])), np.uint64)
        caps = np.zeros((len(keep), len(keys)), np.int32)
        for j, i in enumerate(keep):
            caps[j, np.searchsorted(keys, np.array(list(bags[i]), np.uint64))] = list(bags[i].values())
        near = np.zeros(1 << 20, bool)
        near[(keys >> np.uint64(44)).astype(np.int64)] = True
        return cls([templates[i][0] for i in keep], [bags[i] for i in keep], [sum(bags[i].values()) for i in keep], threshold, keys, caps,
                   caps > 0, near)

    def shared(self, j: int, own: np.ndarray, kinds: np.ndarray, starts: np.ndarray, firsts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Bigrams that the windows from `starts` share with template j, of which the words have `own` (places) and `kinds`.

        Of a bigram that the template has c times, a window counts an
        occurrence if it holds less than c earlier ones: each occurrence counts
        in the windows that start in one range of places.
        """
        texts = np.searchsorted(firsts, own, "right") - 1
        inside = own < stops[texts] - 1
        own, kinds, texts = own[inside], kinds[inside], texts[inside]
        order = np.lexsort((own, kinds))
        at, kind = own[order], kinds[order]
        back = np.arange(len(at)) - self.caps[j, kind]
        earlier = np.where((back >= 0) & (kind[back] == kind), at[back], -1)
        low = np.maximum(np.maximum(earlier + 1, at - self.sizes[j] + 1), firsts[texts[order]])
        return np.searchsorted(np.sort(low), starts, "right") - np.searchsorted(own, starts, "left")

    def matches(self, words: np.ndarray, firsts: np.ndarray) -> dict[tuple[int, str], tuple[float, int]]:
        """(text, licence) -> (Dice coefficient of its best window, the window's first word) for texts that begin at `firsts`.

        Licences differ in a word or two and hold each other's notices, so that
        one passage reaches the threshold of several templates: windows are
        taken by evidence (shared bigrams less those that only one side has),
        and one that overlaps a taken one of another licence does not count.
        """
        pairs = bigrams(words)
        some = np.flatnonzero(self.near[(pairs >> np.uint64(44)).astype(np.int64)])
        if not len(some) or not len(self.keys):
            return {}
        kinds = np.minimum(np.searchsorted(self.keys, pairs[some]), len(self.keys) - 1)
        real = self.keys[kinds] == pairs[some]
        some, kinds = some[real], kinds[real]
        stops = np.append(firsts[1:], len(words))
        longest = int((stops - firsts).max())
        windows: dict[int, list[tuple[int, float, int, int, int, int]]] = {}
        for j, n in enumerate(self.sizes):
            need = math.ceil(self.threshold * n / (2 - self.threshold) - 1e-9)
            if need >= longest:
                continue
            has = self.owners[j, kinds]
            own = some[has]
            if len(own) < need:
                continue
            starts = own[np.searchsorted(own, own + n) - np.arange(len(own)) >= need]
            if not len(starts):
                continue
            both = self.shared(j, own, kinds[has], starts, firsts, stops)
            texts = np.searchsorted(firsts, starts, "right") - 1
            sizes = np.minimum(n, stops[texts] - 1 - starts)
            got = dice(both, n, sizes)
            for i in np.flatnonzero((sizes >= need) & (got >= self.threshold)).tolist():
                d, m = int(texts[i]), int(sizes[i])
                windows.setdefault(d, []).append((n + m - 3 * int(both[i]), -float(got[i]), -n, int(starts[i] - firsts[d]), j, m))
        best: dict[tuple[int, str], tuple[float, int]] = {}
        for d, found in windows.items():
            ids = {name: i for i, name in enumerate(dict.fromkeys(self.names[w[4]] for w in found))}
            taken = np.full(int(stops[d] - firsts[d]), -1, np.int32)
            kept: dict[str, tuple[float, int, int]] = {}
            for _, less, n, at, j, m in sorted(found):
                name = self.names[j]
                span = taken[at:at + m + 1]
                if ((span >= 0) & (span != ids[name])).any():
                    continue
                if (span < 0).all():  # further windows on the same passage take no words around it
                    span[:] = ids[name]
                kept[name] = min(kept.get(name, (0.0, 0, 0)), (less, n, at))
            best.update({(d, name): (-less, at) for name, (less, _, at) in kept.items()})
        return best


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] | None = None, threshold: float = DICE, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(doc_id, license, dice, word_at): one row per document row and licence named in it, with its best window.

    Words are runs of letters and digits, case apart; windows start at any
    word of the whole text. Of a licence's windows the one with the highest
    coefficient counts, of equal ones that of the longest template, then the
    earliest; windows that overlap one of another licence with more evidence do
    not. Without `templates`, TEMPLATES, OPENINGS (under a family's name) and the
    whole texts count. Null and
    empty texts, and texts of one word, name none; ids may be null or
    repeated: each row gives its own result. Other columns are not read.
    """
    known = [*TEMPLATES, *OPENINGS, *whole_texts()] if templates is None else list(templates)
    sent = docs.sparkSession.sparkContext.broadcast(Templates.of(known, threshold))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            found = []
            for row, words, firsts in runs(batch.column("text")):
                found += [(row + d, name, *got) for (d, name), got in known.matches(words, firsts).items()]
            if found:
                r, names, got, at = zip(*found)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(r)), pa.array(names), pa.array(got, pa.float64()),
                                                  pa.array(at, pa.int64())], ["doc_id", "license", "dice", "word_at"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        search, f"doc_id {kind}, license string, dice double, word_at long")
