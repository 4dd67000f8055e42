"""License scans: a generalised suffix automaton of licence wording, streamed over whole texts.

The automaton accepts every run of words that stands in some template. A text's words walk it once and
give matching statistics: at each word, how long the longest run ending there is that some template
holds. Base phrases are read off the statistics (a phrase ends where the run is at least as long and
the phrase's state is on the suffix links). Long runs are then chained along each template, both sides
moving forward, and a template counts where its chained spans cover enough of it; each such chain is a copy.

Defined results: null and empty texts have no words and no labels; texts of any length are scanned
whole; repeated rows are scanned each; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that are counted at every place, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Wording whose coverage gives further labels.
TEMPLATES = [
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-work", "this work is licensed under the gnu general public license version 3"),
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("apache-terms", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("as-is", "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", "released under the mit license"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-notice", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license"),
    ("reserved", "all rights reserved"),
    ("gpl-or-later", "either version 3 of the license or at your option any later version"),
    ("gpl-copy", "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache-as-is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not "
        "limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an "
        "action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of "
        "merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or "
        "tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    ("bsd-3rd-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the "
        "software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special "
        "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with "
        "the use or performance of this software",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any "
        "purpose commercial or non commercial and by any means",
    ),
    ("cc0-notice", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this "
        "software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
]

#: Runs of at least so many words are chained, or a whole template of fewer.
LONG = 3
#: The share of a template that chained spans cover where it counts.
COVERED = 0.8


def _separators() -> bytes:
    """Byte table: A-Z to lower case, separators to a space. Bytes of other characters are above 7F and stay."""
    table = bytearray(range(256))
    for c in range(128):
        ch = chr(c)
        table[c] = ord(ch.lower()) if ch.isalnum() else 32
    return bytes(table)


SEPARATORS = _separators()


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(SEPARATORS).split() if text else []


class Automaton:
    """Generalised suffix automaton over word ids. ``ends[v]`` gives, for each template that holds v's runs, where they end."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.templates = [(label, words(text)) for label, text in templates]
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [{}]
        for t, (_, tokens) in enumerate([*self.templates, *((p, words(p)) for p in phrases)]):
            last = 0
            for i, word in enumerate(tokens):
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
                if t < len(self.templates):
                    self.ends[last].setdefault(t, set()).add(i)
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):  # a run's places hold for its suffixes
            for t, places in self.ends[v].items():
                self.ends[self.link[v]].setdefault(t, set()).update(places)
        at = {self.walk(words(p)): (len(words(p)), label) for p, label in phrases.items()}
        self.phrases: list[list[tuple[int, str]]] = []
        for v in range(len(self.next)):
            found, u = [], v
            while u > 0:
                if u in at:
                    found.append(at[u])
                u = self.link[u]
            self.phrases.append(found)

        # Shorter runs that end with a state's, in other places: those of its suffix links, each with its longest run.
        self.least = min([LONG, *(len(tokens) for _, tokens in self.templates)])
        self.places = [[(t, end) for t, ends in found.items() for end in ends] for found in self.ends]
        self.shorter: list[list[tuple[tuple[int, int], int]]] = [[] for _ in self.next]
        for v in sorted(range(1, len(self.next)), key=lambda v: self.length[v]):
            u, own = self.link[v], set(self.places[v])
            if u > 0:
                self.shorter[v] = [(p, self.length[u]) for p in self.places[u] if p not in own and self.length[u] >= self.least] + [(p, n) for p, n in self.shorter[u] if p not in own]

    def held(self, v: int, n: int) -> dict[tuple[int, int], int]:
        """(template, place) at which a run of n words in state v or one of its suffixes ends, with the longest such run."""
        return dict.fromkeys(self.places[v], n) | dict(self.shorter[v])

    def walk(self, tokens: list[bytes]) -> int:
        v = 0
        for w in tokens:
            v = self.next[v][self.vocabulary[w]]
        return v

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for p's runs and c, taken off q, which holds longer runs too."""
        r = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = r
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = r
            p = self.link[p]
        return r

    def _extend(self, p: int, c: int) -> int:
        if (q := self.next[p].get(c)) is not None:  # an earlier template has this run
            return q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        new = self._state(self.length[p] + 1, 0, {})
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def statistics(self, ids: list[int | None]) -> Iterator[tuple[int, int, int]]:
        """(place, run length, state) at each word that the automaton knows."""
        edges, link, length = self.next, self.link, self.length
        v = n = 0
        for i, c in enumerate(ids):
            if c is None:
                v = n = 0
                continue
            while (u := edges[v].get(c)) is None:
                v = link[v]
                n = length[v]
            v, n = u, n + 1
            yield i, n, v


def chains(runs: list[tuple[int, int, int]], long: int) -> list[tuple[int, list[int]]]:
    """(weight, runs from first to last) of the best chain that ends with each run (start in text, start in template, length), both moving forward.

    Weight is template words covered. Runs further apart in the text than four templates' lengths aren't of one copy.
    """
    best: list[tuple[int, int]] = []
    for j, (s, t, n) in enumerate(runs):
        value, before = n, -1
        for i in range(j - 1, -1, -1):
            s0, t0, n0 = runs[i]
            if s - s0 > 4 * long:
                break
            new = n - max(0, s0 + n0 - s, t0 + n0 - t)
            if s0 < s and t0 < t and new > 0 and best[i][0] + new > value:
                value, before = best[i][0] + new, i
        best.append((value, before))
    out = []
    for j, (value, _) in enumerate(best):
        chained = []
        while j >= 0:
            chained.append(j)
            j = best[j][1]
        out.append((value, chained[::-1]))
    return out


def copies(runs: list[tuple[int, int, int]], long: int) -> tuple[float, list[tuple[int, int, float]]]:
    """The best coverage, and (start, end, coverage) of each copy of a template in the text, in order.

    The chains of most weight, then the shortest, are taken first; those that overlap them are sought anew among the runs that are left.
    """
    left, most, found = sorted(set(runs)), 0.0, []
    while left:
        ended = chains(left, long)
        end = lambda chained: max(left[j][0] + left[j][2] for j in chained)  # noqa: B023, E731
        ended = sorted((-value, end(chained) - left[chained[0]][0], chained) for value, chained in ended)
        taken: list[tuple[int, int, float]] = []
        for _, size, chained in ended:
            cover = len({k for j in chained for k in range(left[j][1], left[j][1] + left[j][2])}) / long
            most = max(most, cover)
            start = left[chained[0]][0]
            at = bisect_left(taken, (start,))
            if cover >= COVERED and (at == len(taken) or taken[at][0] >= start + size) and (at == 0 or taken[at - 1][1] <= start):
                taken.insert(at, (start, start + size, cover))
        if not taken:
            break
        found += taken
        starts = [x[0] for x in taken]
        free = lambda s, n: (k := bisect_left(starts, s + n)) == 0 or taken[k - 1][1] <= s  # noqa: B023, E731
        left = [(s, t, n) for s, t, n in left if free(s, n)]
    return most, sorted(found)


def scan_words(automaton: Automaton, tokens: list[bytes]) -> dict:
    """Base places, labels, score and covered spans of one text."""
    ids = list(map(automaton.vocabulary.get, tokens))
    places: list[int] = []
    base: set[str] = set()
    runs: dict[int, list[tuple[int, int, int]]] = {}
    open_: dict[tuple[int, int], int] = {}  # the places in templates at which the text's last words stand, with the length of each run
    last = -1

    def ended(over: dict[tuple[int, int], int], at: int) -> None:
        for (t, end), n in over.items():
            if n >= min(LONG, len(automaton.templates[t][1])):
                runs.setdefault(t, []).append((at - n + 1, end - n + 1, n))

    for i, n, v in automaton.statistics(ids):
        for size, label in automaton.phrases[v]:
            if size <= n:
                places.append(i - size + 1)
                base.add(label)
        # A run ends, for its template, where the next word of the text isn't the template's, whatever other templates go on.
        held = automaton.held(v, n) if n >= automaton.least else {}
        if open_:
            ended(open_ if i != last + 1 else {(t, end): size for (t, end), size in open_.items() if (t, end + 1) not in held}, last)
        open_, last = held, i
    ended(open_, last)
    labels, spans, score = set(base), [], 1.0 if places else 0.0
    for t, found in runs.items():
        label, template = automaton.templates[t]
        cover, copied = copies(found, len(template))
        score = max(score, cover)
        if copied:
            labels.add(label)
            spans += [(label, *c) for c in copied]
    return {"n_words": len(tokens), "places": places, "base": base, "labels": labels, "score": min(1.0, score), "spans": spans}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, end: long, cover: double>>"


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row for each document: counts, labels, score, and each copy of a covered template: its words from start to before end."""
    automaton = Automaton(TEMPLATES if templates is None else templates, BASE if phrases is None else phrases)
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))]
    names = [part.split(" ")[0] for part in SCHEMA.split(", ")[:9]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                r = scan_words(automaton, words(text.as_py()))
                p = r["places"]
                spans = [{"label": a, "start": s, "end": e, "cover": c} for a, s, e, c in sorted(r["spans"])]
                out.append((doc_id, r["n_words"], len(p), min(p, default=None), max(p, default=None), ",".join(sorted(r["base"])), ",".join(sorted(r["labels"])), r["score"], spans))
            columns = list(zip(*out, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
