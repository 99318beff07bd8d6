"""Licence notices in documents, by the Dice coefficient over word bigrams.

Texts and templates are normalised alike: ASCII letters in lower case, everything but
letters, digits and non-ASCII characters a separator, and words that vary from copy to copy
(years, "c") dropped. A template is the bag of its word bigrams, between marks for its
begin and end. In a document only bigrams of templates matter. From each of them every
passage is compared that ends at another one of the same template, is no longer than a
Dice coefficient d allows ((2-d)/d times the template's bigrams) and can hold enough of them
(d/(2-d) times), whatever stands between. Of the passages of one template those of best Dice
are taken first, so notices that follow each other are told apart (of changed copies without
a word between, the end of one and the begin of the next may be the better passage).

Defined cases: null, empty and short texts match nothing; repeated rows are matched alike;
several notices are all found; of templates that claim the same words the one that shares
more bigrams wins, then the one of better Dice, then the one named first; an empty table
gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
# Words without a bigram of the template that a passage may go on over; None: any number.
GAP = None
WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
VARYING = re.compile("(?:19|20)[0-9]{2}|c")

# Notices and short texts of common public licences. Licences that look alike
# need a template each: the one that shares more of a text names it.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted
    provided that the following conditions are met: 1. Redistributions of source code must retain the
    above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions
    in binary form must reproduce the above copyright notice, this list of conditions and the
    following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_ADVERTISING = """All advertising materials mentioning features or use of this software must display
    the following acknowledgement: This product includes software developed by the organization."""
_BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to
    endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS
    OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
    FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
    CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
    DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
    DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER
    IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
    THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
    fee is hereby granted"""
_ISC_NOTICE = """, provided that the above copyright notice and this permission notice appear in all
    copies."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
    SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
    AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
    WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
    OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
    SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
    and associated documentation files (the "Software"), to deal in the Software without restriction,
    including without limitation the rights to use, copy, modify, merge, publish, distribute,
    sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
    furnished to do so"""
_MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
    BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
    NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
    OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
    CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def _gnu(name: str, version: str) -> list[str]:
    """Notices of a licence of the GNU family."""
    return [f"This work is licensed under the GNU {name} License, version {version}."] + [
        f"""This {what} is free software; you can redistribute it and/or modify it under the terms of the
        GNU {name} License as published by the Free Software Foundation; either version {version} of the
        License, or (at your option) any later version."""
        for what in ("program", "library", "software")
    ]


def _creative_commons() -> dict[str, list[str]]:
    """Notices of the six licences in each of their versions."""
    out = {}
    for version, where in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"),
                           ("2.0", "Generic"), ("1.0", "Generic")):
        bare = "NoDerivatives" if version == "4.0" else "NoDerivs"
        for marks in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
            words = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": bare}
            full = "-".join(words[m] for m in marks.split("-"))
            out[f"CC-{marks}-{version}"] = [
                f"Licensed under CC {marks} {version}.",
                f"This work is licensed under a Creative Commons {full} {version} {where} License.",
            ]
    return out


TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        f"""{_MIT}, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software. {_MIT_END}""",
    ],
    "MIT-0": [f"{_MIT}. {_MIT_END}"],
    "ISC": [_ISC + _ISC_NOTICE, f"{_ISC}{_ISC_NOTICE} {_ISC_END}"],
    "0BSD": [f"{_ISC}. {_ISC_END}"],
    "BSD-2-Clause": [_BSD, f"{_BSD} {_BSD_END}"],
    "BSD-3-Clause": [f"{_BSD} 3. {_BSD_NAMES}", f"{_BSD} 3. {_BSD_NAMES} {_BSD_END}"],
    "BSD-4-Clause": [
        f"{_BSD} 3. {_BSD_ADVERTISING} 4. {_BSD_NAMES}",
        f"{_BSD} 3. {_BSD_ADVERTISING} 4. {_BSD_NAMES} {_BSD_END}",
    ],
    "BSL-1.0": [
        """Distributed under the Boost Software License, Version 1.0. (See accompanying file
        LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)""",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of
        the software and accompanying documentation covered by this license (the "Software") to use,
        reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative
        works of the Software, and to permit third-parties to whom the Software is furnished to do so,
        all subject to the following: The copyright notices in the Software and this entire statement,
        including the above license grant, this restriction and the following disclaimer, must be
        included in all copies of the Software, in whole or in part, and all derivative works of the
        Software, unless such copies or derivative works are solely in the form of machine-executable
        object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL
        THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER
        LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
        THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "Artistic-2.0": [
        "Licensed under the Artistic License 2.0.",
        """This program is free software; you can redistribute it and/or modify it under the terms of the
        Artistic License 2.0.""",
    ],
    "EPL-1.0": [
        """This program and the accompanying materials are made available under the terms of the Eclipse
        Public License v1.0 which accompanies this distribution, and is available at
        http://www.eclipse.org/legal/epl-v10.html""",
    ],
    "EPL-2.0": [
        """This program and the accompanying materials are made available under the terms of the Eclipse
        Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
        """This program and the accompanying materials are made available under the terms of the Eclipse
        Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.""",
    ],
    "GPL-2.0": _gnu("General Public", "2"),
    "GPL-3.0": _gnu("General Public", "3"),
    "LGPL-2.0": _gnu("Library General Public", "2"),
    "LGPL-2.1": _gnu("Lesser General Public", "2.1"),
    "LGPL-3.0": _gnu("Lesser General Public", "3"),
    "AGPL-3.0": _gnu("Affero General Public", "3"),
    "MPL-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
        the MPL was not distributed with this file, You can obtain one at
        http://mozilla.org/MPL/2.0/.""",
    ],
    **_creative_commons(),
    "CC0-1.0": [
        """To the extent possible under law, the author has dedicated all copyright and related and
        neighboring rights to this software to the public domain worldwide.""",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
    "all-rights-reserved": ["All rights reserved."],
}


def normalised(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words of a text and where they stand."""
    words, spans = [], []
    for match in WORD.finditer(_lower(text)):
        if not VARYING.fullmatch(match[0]):
            words.append(match[0])
            spans.append(match.span())
    return words, spans


def _lower(text: str) -> str:
    return text.translate(_UPPER)


_UPPER = {c: c + 32 for c in range(65, 91)}


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    """Twice what two bags share over all they hold."""
    size = a.total() + b.total()
    return 2 * (a & b).total() / size if size else 0.0


class Matcher:
    def __init__(
        self, templates: dict[str, list[str]], threshold: float = THRESHOLD, gap: int | None = GAP
    ):
        self.threshold, self.gap = threshold, gap
        self.bags = [(name, Counter(bigrams(normalised(t)[0])))
                     for name, texts in templates.items() for t in texts]
        self.sizes = [bag.total() for _, bag in self.bags]
        # Bigrams that a passage must share, and may have.
        low = threshold / (2 - threshold)
        self.least = [max(1, ceil(size * low - 1e-9)) for size in self.sizes]
        self.most = [floor(size / low + 1e-9) for size in self.sizes]
        self.owners: dict[tuple[str, str], list[int]] = {}
        for k, (_, bag) in enumerate(self.bags):
            for pair in bag:
                self.owners.setdefault(pair, []).append(k)
        self.firsts = {a for a, _ in self.owners}

    def matches(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, dice, start, end) of the notices in a text, in order, none overlapping."""
        if not text:
            return []
        words, spans = normalised(text)
        hits: dict[int, list[int]] = {}
        firsts, owners = self.firsts, self.owners
        for at, word in enumerate(words[:-1]):
            if word in firsts:
                for k in owners.get((word, words[at + 1]), ()):
                    hits.setdefault(k, []).append(at)
        open_: dict[int, list[tuple]] = {}
        for k, places in hits.items():
            if len(places) >= self.least[k]:
                own = (self._best(k, words, places, n, len(words)) for n in range(len(places)))
                open_[k] = [p for p in own if p]
                heapify(open_[k])
        best: list[tuple[str, float, int, int]] = []
        taken: list[tuple[int, int]] = []  # first and last words, in order
        while True:
            for k, heap in open_.items():
                self._clear(k, words, hits[k], heap, taken)
            tops = [(heap[0][1], heap[0][0], k, heap[0]) for k, heap in open_.items() if heap]
            if not tops:
                return sorted(best, key=lambda m: m[2])
            _, score, k, (_, _, a, b, _) = min(tops)
            taken.insert(bisect_left(taken, (a, b)), (a, b))
            best.append((self.bags[k][0], -score, spans[a][0], spans[b][1]))

    def _clear(self, k: int, words: list[str], places: list[int], heap: list[tuple], taken: list):
        """Brings a passage without taken words to the top, if there is one."""
        while heap:
            _, _, a, b, n = heap[0]
            at = bisect_left(taken, (a + 1,))  # the first that begins behind a
            if at and taken[at - 1][1] >= a:
                heappop(heap)
            elif at < len(taken) and taken[at][0] <= b:
                heappop(heap)
                shorter = self._best(k, words, places, n, taken[at][0])
                if shorter:
                    heappush(heap, shorter)
            else:
                return

    def _best(self, k: int, words: list[str], places: list[int], n: int, stop: int) -> tuple | None:
        """(-dice, -shared, first word, last word, n) of the best passage from hit n to before a word."""
        first, most, far = places[n], self.most[k], n + self.least[k] - 1
        if far >= len(places) or places[far] - first >= most:
            return None
        bag, size, limit = self.bags[k][1], self.sizes[k], min(first + most, stop - 1)
        seen: dict[tuple[str, str], int] = {}
        shared, prior, best, found = 0, first, self.threshold, None
        for m in range(n, len(places)):
            at = places[m]
            if at >= limit or self.gap is not None and at - prior > self.gap:
                break
            prior = at
            pair = words[at], words[at + 1]
            count = seen.get(pair, 0)
            if count == bag[pair]:
                continue
            seen[pair] = count + 1
            shared += 1
            score = 2 * shared / (at - first + 1 + size)
            if score >= best:
                best, found = score, (-score, -shared, first, at + 1, n)
        return found


def _scan(templates: dict[str, list[str]], threshold: float, gap: int | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold, gap)
        kind = pa.list_(pa.struct([
            ("licence", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("end", pa.int32())
        ]))
        for batch in batches:
            rows = [
                [dict(zip(("licence", "dice", "start", "end"), m)) for m in matcher.matches(t.as_py())]
                for t in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "matches"]
            )

    return run


def scan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    templates: dict[str, list[str]] | None = None,
    threshold: float = THRESHOLD,
    gap: int | None = GAP,
) -> DataFrame:
    """(doc_id, matches) of every document row; a match has licence, dice, start and end."""
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(
        _scan(templates or TEMPLATES, threshold, gap),
        f"doc_id {kind}, matches array<struct<licence:string,dice:double,start:int,end:int>>",
    )


def digest(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_matches, licences, best) of scanned documents; licences sorted, each once."""
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"])))
    return scanned.select(
        "doc_id", F.size("matches").alias("n_matches"), F.concat_ws(",", names).alias("licences"),
        F.round(F.array_max(F.transform("matches", lambda m: m["dice"])), 6).alias("best"),
    )
