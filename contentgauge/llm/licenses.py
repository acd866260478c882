"""Licence scans: matching statistics against licence templates, chained into covered spans.

All templates go into one generalised suffix automaton over words. A text runs through it word by
word and keeps a state and the length of the longest suffix read so far that some template holds
(its matching statistics); only where such a match cannot be extended is it written down, if it is
long enough. Matches of a template that follow each other in text and template are chained; a chain
that covers enough of the template is a span with the template's label. What is kept per text is
its matches. The automaton is built once per worker from the templates, a fixed small list.

Phrases that are looked for word for word are templates too: a place is where the automaton's
state holds the end of the phrase.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# fixed values: phrases asked for word for word and their labels
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# fixed values: notices as their licences word them
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this
work"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""),
)
LONG = 3        # words of a match worth keeping, unless the template is shorter
COVERED = 0.8   # share of a template's words that a chain must match
STRAY = 0.5     # words between two matches of a chain, at most this share of the template


def _separators() -> bytes:
    """Byte table: A-Z to a-z, all ASCII but letters and digits to a space."""
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b).lower()
        out[b] = ord(c) if c.isalnum() else 32
    return bytes(out)


TABLE = _separators()


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: ASCII letters in lower case, digits and all that is not ASCII."""
    return (text or b"").translate(TABLE).split()


@dataclass
class Template:
    label: str
    words: list[bytes]
    exact: bool  # only word for word

    @property
    def least(self) -> int:
        return min(LONG, len(self.words))


@dataclass
class State:
    length: int
    link: int
    next: dict[bytes, int] = field(default_factory=dict)
    ends: list[tuple[int, int]] = field(default_factory=list)  # (template, its words read) of the state's strings


class Automaton:
    """Generalised suffix automaton of the templates' words."""

    def __init__(self, templates: list[Template]):
        self.templates = templates
        self.states = [State(0, -1)]
        for t, template in enumerate(templates):
            last = 0
            for k, word in enumerate(template.words):
                last = self._extend(last, word)
                self.states[last].ends.append((t, k + 1))
        # a string also ends wherever a longer one with that suffix does
        for s in sorted(range(1, len(self.states)), key=lambda s: -self.states[s].length):
            state = self.states[s]
            state.ends = sorted(set(state.ends))
            if state.link > 0:
                self.states[state.link].ends.extend(state.ends)
        self.phrases = self._phrases()

    def _extend(self, last: int, word: bytes) -> int:
        states = self.states
        if word in states[last].next:  # an earlier template holds these words
            return self._split(last, states[last].next[word], word)
        new = len(states)
        states.append(State(states[last].length + 1, 0))
        at = last
        while at >= 0 and word not in states[at].next:
            states[at].next[word] = new
            at = states[at].link
        if at >= 0:
            states[new].link = self._split(at, states[at].next[word], word)
        return new

    def _split(self, at: int, to: int, word: bytes) -> int:
        """The state of exactly the strings of ``at`` with ``word`` after them."""
        states = self.states
        if states[to].length == states[at].length + 1:
            return to
        copy = len(states)
        states.append(State(states[at].length + 1, states[to].link, dict(states[to].next)))
        while at >= 0 and states[at].next.get(word) == to:
            states[at].next[word] = copy
            at = states[at].link
        states[to].link = copy
        return copy

    def _phrases(self) -> list[list[tuple[int, int]]]:
        """Per state: (words, template) of the exact phrases that are suffixes of its strings."""
        own: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, template in enumerate(self.templates):
            if template.exact:
                at = 0
                for word in template.words:
                    at = self.states[at].next[word]
                own[at].append((len(template.words), t))
        out: list[list[tuple[int, int]]] = [[] for _ in self.states]
        for s in sorted(range(1, len(self.states)), key=lambda s: self.states[s].length):
            out[s] = out[self.states[s].link] + own[s]
        return out

    def read(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
        """(matches, places): matches (state, length, end) that the next word does not extend, ``LONG`` words or
        a whole shorter template; places (start, template) of the exact phrases."""
        states, phrases = self.states, self.phrases
        steps, links, lengths = [s.next for s in states], [s.link for s in states], [s.length for s in states]
        start, first = steps[0].get, steps[0]
        least = min((t.least for t in self.templates), default=1)
        matches, places = [], []
        at = length = 0
        for i, word in enumerate(words):
            if not length:
                at = start(word, 0)
                length = 1 if at else 0
            else:
                to = steps[at].get(word)
                if to is None:
                    if length >= least:
                        matches.append((at, length, i))
                    while at >= 0 and word not in steps[at]:
                        at = links[at]
                    if at < 0:
                        at = length = 0
                        continue
                    length = lengths[at] + 1
                    at = steps[at][word]
                else:
                    at, length = to, length + 1
            if length > 1 or word in first:
                for n, t in phrases[at]:
                    if n <= length:
                        places.append((i + 1 - n, t))
        if length >= least:
            matches.append((at, length, len(words)))
        return matches, places

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, start, end, share) of chains that cover at least ``COVERED`` of their template.

        A chain's matches ascend in text and template without overlap in either (what overlaps is cut
        from the later one); between two lie at most ``STRAY`` of the template's words. A match is
        compared with those that end so near before it only.
        """
        of: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for state, length, end in matches:
            for t, k in self.states[state].ends:
                template = self.templates[t]
                n = min(length, k)
                if not template.exact and n >= template.least:
                    of[t].append((end - n, k - n, n))
        out = []
        for t, found in of.items():
            template = self.templates[t]
            size = len(template.words)
            gap, chains, open_ = max(1, int(size * STRAY)), [], []
            for start, at, n in sorted(found):
                # ends in the text ascend with the starts, so older chains are out of reach for good
                open_ = [c for c in open_ if start - c["end"] <= gap]
                best = None
                for c in open_:
                    cut = max(c["end"] - start, c["at"] - at, 0)
                    if cut < n and at + cut - c["at"] <= gap and (best is None or c["words"] - cut > best[0]):
                        best = (c["words"] - cut, cut, c)
                chain = {"start": start, "end": start + n, "at": at + n, "words": n}
                if best and best[0] > 0:
                    chain = chain | {"start": best[2]["start"], "words": best[0] + n}
                open_.append(chain)
                chains.append(chain)
            out.extend((template.label, c["start"], c["end"], c["words"] / size) for c in chains if c["words"] >= COVERED * size)
        return out


def templates(phrases=PHRASES, notices=TEMPLATES) -> list[Template]:
    return [Template(label, words_of(text.encode()), True) for text, label in phrases] + [
        Template(label, words_of(text.encode()), False) for label, text in notices]


@lru_cache(maxsize=4)
def automaton(phrases=PHRASES, notices=TEMPLATES) -> Automaton:
    return Automaton(templates(phrases, notices))


FOUND = pa.struct([
    ("n_words", pa.int64()),
    ("places", pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))),
    ("spans", pa.list_(pa.struct([
        ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))),
    ("score", pa.float64()),
])
SCHEMA = ("n_words long, places array<struct<start: long, label: string>>, "
          "spans array<struct<label: string, start: long, end: long, share: double>>, score double")


def _scan(text: bytes | None, machine: Automaton) -> dict:
    words = words_of(text)
    matches, places = machine.read(words)
    spans = sorted(machine.spans(matches), key=lambda s: (s[1], s[2], s[0], s[3])) if matches else []
    named = [(start, machine.templates[t].label) for start, t in sorted(places)]
    return {
        "n_words": len(words), "places": [dict(zip(("start", "label"), p, strict=True)) for p in named],
        "spans": [dict(zip(("label", "start", "end", "share"), s, strict=True)) for s in spans],
        "score": 1.0 if named else max([s[3] for s in spans], default=0.0),
    }


def scan(docs: DataFrame, text: str = "text", phrases=PHRASES, notices=TEMPLATES) -> DataFrame:
    """The documents with ``n_words``, ``places``, ``spans`` and ``score`` (columns of these names are replaced).

    ``places``: where an exact phrase's words stand consecutively (first word's number from 0). ``spans``: chains
    of long matches that cover a notice, with the words they reach over and the share of its words matched.
    ``score`` is the best such share, 1 where a phrase stands; 0 without either. A null or empty text has no words.
    """
    phrases, notices = tuple(map(tuple, phrases)), tuple(map(tuple, notices))
    if not all(t.words for t in templates(phrases, notices)):
        raise ValueError("a phrase or notice without words")
    keep = [c for c in docs.columns if c not in ("n_words", "places", "spans", "score", "_found", "_bytes")]

    def run(batches):
        machine = automaton(phrases, notices)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_bytes"))
            found = pa.array([_scan(t.as_py(), machine) for t in texts], FOUND)
            rest = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(rest + found.flatten(), keep + [f.name for f in FOUND])

    rows = docs.select(*keep, F.col(text).cast("binary").alias("_bytes"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_bytes")
    return rows.mapInArrow(run, f"{kinds}, {SCHEMA}" if kinds else SCHEMA)


def labelled(found: DataFrame) -> DataFrame:
    """Scanned documents with ``n_base``, ``first_word``, ``last_word``, ``base_labels`` and ``labels``: both lists
    distinct, sorted and comma-joined, ``labels`` with those of the spans."""
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    more = F.concat(base, F.transform("spans", lambda s: s["label"]))
    return found.withColumns({
        "n_base": F.size("places").cast("long"), "first_word": F.array_min(starts), "last_word": F.array_max(starts),
        "base_labels": F.array_join(F.array_sort(F.array_distinct(base)), ","),
        "labels": F.array_join(F.array_sort(F.array_distinct(more)), ","),
    })
