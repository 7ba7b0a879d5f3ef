"""Licence scan: one suffix automaton of all licence templates' words gives, for each word of a file, the longest
match that ends there; long matches are chained into spans of a template, and the share of the template that a
chain covers is its score.

Words are lower-cased (A-Z) runs of letters, digits and everything outside ASCII. A null text has no words. A file
without any match has score 0 and null places. Rows stay one to one, also for repeated or null doc_id; an empty table gives an empty one,
columns other than the two named ones are not looked at, and a long text takes time in proportion.
"""

from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, encode

#: Phrases whose every occurrence counts, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices and texts of public licences.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("lgpl", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"),
    ("agpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
)
MIN_MATCH = 4
MAX_GAP = 12
MIN_COVER = 0.5

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased, as UTF-8."""
    return encode(text).translate(_WORD).split()


@dataclass(frozen=True)
class Hit:
    """Words first..last of a file that a chain of matches with one template spans, and the template's share covered."""

    label: str
    first: int
    last: int
    cover: float


class Automaton:
    """Generalised suffix automaton over word sequences. `ends[state]` has, for each template that holds the state's words,
    the places where they end, ascending; `known[state]` the phrases that end where the state's words end."""

    def __init__(self, templates, phrases=()):
        self.next, self.link, self.length = [{}], [-1], [0]
        self.labels = [label for label, _ in templates]
        texts = [words(t) for _, t in templates]
        self.sizes = [len(t) for t in texts]
        self.ends: list[dict[int, set[int]]] = [{}]
        for k, text in enumerate(texts):
            self._insert(text, k)
        parts = [(words(p), label) for p, label in phrases]
        for part, _ in parts:
            self._insert(part, None)
        by_length = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in by_length:
            for k, places in self.ends[s].items():
                self.ends[self.link[s]].setdefault(k, set()).update(places)
        # Shorter matches are no part of a chain.
        self.ends = [{k: sorted(v) for k, v in e.items()} if n >= MIN_MATCH else {} for n, e in zip(self.length, self.ends)]
        own: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for part, label in parts:
            s = 0
            for w in part:
                s = self.next[s][w]
            own[s].append((len(part), label))
        self.known: list[tuple[tuple[int, str], ...]] = [()] * len(self.next)
        for s in reversed(by_length):
            self.known[s] = (*own[s], *self.known[self.link[s]])

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        clone = self._new(self.length[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _insert(self, text: list[bytes], template: int | None) -> None:
        last = 0
        for i, w in enumerate(text):
            q = self.next[last].get(w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
            else:
                cur, p = self._new(self.length[last] + 1), last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = cur
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][w]
                    self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
                last = cur
            if template is not None:
                self.ends[last].setdefault(template, set()).add(i)

    def matches(self, text: list[bytes]):
        """Each place where words of the file end a match: (place, length, state), from matching statistics."""
        step, link, length = self.next, self.link, self.length
        root = step[0]
        s = n = 0
        for i, w in enumerate(text):
            if n == 0:
                t = root.get(w)
                if t is None:
                    continue
                s, n = t, 1
            else:
                while s and w not in step[s]:
                    s = link[s]
                    n = length[s]
                t = step[s].get(w)
                if t is None:
                    s = n = 0
                    continue
                s, n = t, n + 1
            yield i, n, s

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int, str]], list[Hit]]:
        """Every place of a phrase as (start, words, label), and the chains of long matches."""
        places, long, held = [], [], None
        for i, n, s in self.matches(text):
            for m, label in self.known[s]:
                if n >= m:
                    places.append((i - m + 1, m, label))
            if held and not (i == held[0] + 1 and n == held[1] + 1):
                long.append(held)
                held = None
            if n >= MIN_MATCH:
                held = (i, n, s)
        if held:
            long.append(held)
        return places, self._chains(long)

    def _chains(self, long: list[tuple[int, int, int]]) -> list[Hit]:
        """Matches with one template in the order of both texts, no further apart than MAX_GAP words, are one chain. Of chains
        that share words of the file, the one with the largest share of its template counts, then the longer one, then the
        one first in the file, then in the list of templates."""
        found: list[tuple[Hit, int]] = []
        open_: dict[int, list[int]] = {}  # template: first, last, place in the template, words covered

        def close(k: int) -> None:
            first, last, _, covered = open_.pop(k)
            if (cover := min(1.0, covered / self.sizes[k])) >= MIN_COVER:
                found.append((Hit(self.labels[k], first, last, cover), k))

        for end, n, s in long:
            for k, places in self.ends[s].items():
                start = end - n + 1
                # The next place in the template after what the chain has; a chain that is over begins anew.
                later = bisect_right(places, open_[k][2]) if k in open_ else 0
                if k in open_ and (start - open_[k][1] > MAX_GAP or later == len(places)):
                    close(k)
                    later = 0
                at = places[later]
                begin = at - n + 1
                if k in open_:
                    chain = open_[k]
                    chain[3] += min(n, at - max(chain[2], begin - 1), end - chain[1])
                    chain[1], chain[2] = end, at
                else:
                    open_[k] = [start, end, at, n]
        for k in list(open_):
            close(k)
        kept: list[Hit] = []
        for h, _ in sorted(found, key=lambda x: (-x[0].cover, x[0].first - x[0].last, x[0].first, x[1])):
            if all(h.last < x.first or h.first > x.last for x in kept):
                kept.append(h)
        return sorted(kept, key=lambda h: h.first)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, places (array of first, words, label) of the phrases and spans (array of label, first, last, cover)."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        automaton = Automaton(templates, phrases)
        for batch in batches:
            sizes, places, spans = [], [], []
            for t in column(batch, "text"):
                w = words(t)
                found, hits = automaton.scan(w)
                sizes.append(len(w))
                places.append([{"first": a, "words": m, "label": label} for a, m, label in found])
                spans.append([{"label": h.label, "first": h.first, "last": h.last, "cover": h.cover} for h in hits])
            p = pa.array(places, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("label", pa.string())])))
            q = pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), p, q], ["doc_id", "n_words", "places", "spans"])

    picked = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, n_words bigint, places array<struct<first:bigint,words:bigint,label:string>>, spans array<struct<label:string,first:bigint,last:bigint,cover:double>>")
