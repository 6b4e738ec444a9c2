"""Licence scans: Dice coefficient over word bigrams against templates.

A text is normalised whole (ASCII letters and digits, lower-cased; signs, other letters and white space to single blanks), so lines do not matter.  A window is a stretch of
it that begins and ends with word pairs of a template.  Windows and templates are sets of word bigrams: Dice = 2 * common / (sum of
sizes).  A template of ``b`` bigrams can reach a threshold t only with windows of b * t / (2 - t) to b * (2 - t) / t bigrams;
a template of which a text has fewer than b * t / (2 - t) is pruned for it, and windows stay within the upper bound of
places (a window with more places than that repeats word pairs).  Of windows that overlap, whatever their templates, the best
stays: greatest Dice, then the longest, then by licence, template and place; then the best of those that do not overlap it, and so on.

The templates (``TEMPLATES``, or the caller's list, checked against ``MOST_TEMPLATES``) go to the workers with the function.

Null and empty texts, texts without two words, and an empty template list give no rows.  Row ids may repeat or be null: each row gives its
own results.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, small_batches

#: Notices by which works name their licence, and whole licences that are short.
_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS '
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _NO_WARRANTY + "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _NO_WARRANTY + "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
]
MOST_TEMPLATES = 5000
_WORD = re.compile(b"[a-z0-9]+")


def words_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits, lower-cased."""
    return _WORD.findall(text.encode().lower())


class Scanner:
    """Templates as sets of bigrams, by bigram."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float) -> None:
        self.threshold = threshold
        self.licenses = [name for name, _ in templates]
        grams = [set(zip(w, w[1:], strict=False)) for w in (words_of(t) for _, t in templates)]
        self.sizes = list(map(len, grams))
        # Whole numbers of bigrams, with a margin for the bounds' own rounding.
        self.least = [max(1, int(b * threshold / (2 - threshold) - 1e-9)) for b in self.sizes]
        self.most = [int(b * (2 - threshold) / threshold + 1e-9) for b in self.sizes]
        self.having: dict[tuple[bytes, bytes], list[int]] = {}
        for i, g in enumerate(grams):
            for x in g:
                self.having.setdefault(x, []).append(i)
        self.first: dict[bytes, set[bytes]] = {}
        for a, b in self.having:
            self.first.setdefault(a, set()).add(b)

    def hits(self, words: list[bytes]) -> dict[int, list[int]]:
        """For each template, the places of its bigrams."""
        out: dict[int, list[int]] = {}
        first, having = self.first, self.having
        for i, a in enumerate(words[:-1]):
            if a in first and words[i + 1] in first[a]:
                for t in having[a, words[i + 1]]:
                    out.setdefault(t, []).append(i)
        return out

    def windows(self, words: list[bytes]) -> Iterator[tuple]:
        """(-dice, -places, license, template, first bigram, last bigram, common, bigrams of the window) at or above the threshold."""
        for t, places in self.hits(words).items():
            b, least, most = self.sizes[t], self.least[t], self.most[t]
            lo = 0
            for k, start in enumerate(places):
                lo = max(lo, k)
                while lo < len(places) and places[lo] < start + most:
                    lo += 1
                if lo - k < least:  # not enough of the template within reach
                    continue
                seen: set[tuple[bytes, bytes]] = set()
                common, at, mine = 0, start, places[k:lo]
                own: set[tuple[bytes, bytes]] = set()
                for end in mine:
                    seen.update(zip(words[at : end + 1], words[at + 1 : end + 2], strict=True))
                    at = end + 1
                    own.add((words[end], words[end + 1]))
                    common = len(own)
                    dice = 2 * common / (len(seen) + b)
                    if dice >= self.threshold:
                        yield -dice, start - end, self.licenses[t], t, start, end, common, len(seen)

    def scan(self, text: str) -> list[tuple]:
        """The windows that stay, in order of place."""
        words, kept, starts = words_of(text), [], []
        for w in sorted(self.windows(words)):
            at = bisect.bisect(starts, w[4])  # windows that stay lie apart, so only the neighbours can be met; a bigram reaches one word further
            if (at == 0 or kept[at - 1][5] + 1 < w[4]) and (at == len(kept) or w[5] + 1 < kept[at][4]):
                kept.insert(at, w)
                starts.insert(at, w[4])
        return sorted(((w[2], w[3], w[4], w[5] - w[4] + 2, w[6], w[7], self.sizes[w[3]], -w[0], b" ".join(words[w[4] : w[5] + 2]).decode()) for w in kept), key=lambda r: r[2])


_SCHEMA = "doc_id long, license string, template int, word int, n_words int, common long, n_window long, n_template long, dice double, passage string"


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, template, word, n_words, common, n_window, n_template, dice, passage): the windows that stay, by the template's
    number and the first word's place, from 0."""
    templates = TEMPLATES if templates is None else templates
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates: too many to send to every worker")
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            rows = [(d, *w) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in scanner.scan(t)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    small_batches(docs)
    return id_text(docs, id_col, text_col).mapInArrow(run, _SCHEMA)


def oracle_sql(templates: list[tuple[str, str]] | None = None, threshold: float = 0.8) -> str:
    """The same in DuckDB's SQL, by a join of all windows with their bigrams, for unique ids."""
    rows = ", ".join("(%d, '%s', '%s')" % (i, n.replace("'", "''"), t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES if templates is None else templates))
    split = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
    return f"""
with kw as (select template, license, {split.format("t")} as w from (values {rows}) x(template, license, t)),
kg as (select distinct template, license, w[i] || ' ' || w[i + 1] as gram from (select template, license, w, unnest(range(1, len(w))) as i from kw)),
k as (select template, license, gram, count(*) over (partition by template) as b from kg),
l as (select doc_id, {split.format("text")} as w from documents where text is not null),
g as (select doc_id, i - 1 as p, w[i] || ' ' || w[i + 1] as gram from (select doc_id, w, unnest(range(1, len(w))) as i from l)),
h as (select doc_id, p, gram, template, license, b from g join k using (gram)),
s as (select a.doc_id, a.template, a.license, a.b, a.p as lo, z.p as hi from h a join h z on z.doc_id = a.doc_id and z.template = a.template and z.p >= a.p and z.p < a.p + floor(a.b * (2 - {threshold}) / {threshold} + 1e-9)),
c as (select s.doc_id, s.template, s.license, s.b, s.lo, s.hi, count(distinct h.gram) as common from s join h on h.doc_id = s.doc_id and h.template = s.template and h.p between s.lo and s.hi group by s.doc_id, s.template, s.license, s.b, s.lo, s.hi having 2 * count(distinct h.gram) >= {threshold} * s.b),
n as (select c.*, len(list_distinct(list_transform(range(lo + 1, hi + 2), lambda i: w[i] || ' ' || w[i + 1]))) as n_window from c join l using (doc_id)),
d as (select *, cast(2 * common as double) / (n_window + b) as dice from n where cast(2 * common as double) / (n_window + b) >= {threshold}),
f as (select doc_id, list_reduce(list([struct_pack(license := license, template := template, lo := lo, hi := hi, common := common, n_window := n_window, b := b, dice := dice)] order by dice desc, hi - lo desc, license, template, lo),
  lambda a, x: case when len(list_filter(a, lambda y: x[1].lo <= y.hi + 1 and y.lo <= x[1].hi + 1)) = 0 then list_concat(a, x) else a end) as kept from d group by doc_id),
u as (select doc_id, unnest(kept) as x from f)
select u.doc_id, x.license, cast(x.template as int) as template, cast(x.lo as int) as word, cast(x.hi - x.lo + 2 as int) as n_words, cast(x.common as bigint) as common, cast(x.n_window as bigint) as n_window, cast(x.b as bigint) as n_template, x.dice,
  list_aggregate(w[x.lo + 1:x.hi + 2], 'string_agg', ' ') as passage from u join l using (doc_id)
"""
