"""Licence statements by a generalised suffix automaton.

The automaton holds the word sequences of all templates and phrases. A text is streamed
through it once; after every word the state and length give the longest match that ends
there (the matching statistics). A phrase ends where its state lies on the suffix links of
the current state. Long matches are chained per template, in order in text and template,
into covered spans; a template counts when enough of its words are covered. Notices of one
family differ by a word or two, so of overlapping spans of different labels only the one with
the most covered words stays.

The families are those of ``TEMPLATES``: their notices, not the bodies of the long licences.
The automaton is built from the fixed texts below, so its size is fixed. Words are taken
from UTF-8 bytes, on which lower-casing A-Z is exact. NULL and empty texts have no words
and no labels. Repeated rows give equal results, an empty table an empty one.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The phrases whose places are counted, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Public licence notices, from which the method adds labels.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software and to permit persons to whom the software is furnished to do so",
        "released under the mit license",
        "licensed under the mit license",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0 the license you may not use this file except in "
        "compliance with the license you may obtain a copy of the license at",
        "licensed under the apache license version 2 0",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee "
        "is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "gpl-3": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version",
    ],
    "cc-by-nc": [
        "licensed under cc by nc 4 0",
        "this work is licensed under the creative commons attribution noncommercial 4 0 international license",
    ],
    "gpl-2": [
        "this work is licensed under the gnu general public license version 2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation either version 2 of the license "
        "or at your option any later version",
    ],
    "lgpl": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu "
        "lesser general public license as published by the free software foundation either version 2 1 of the "
        "license or at your option any later version",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu "
        "lesser general public license as published by the free software foundation either version 3 of the "
        "license or at your option any later version",
    ],
    "agpl-3": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "affero general public license as published by the free software foundation either version 3 of the "
        "license or at your option any later version",
    ],
    "mpl-2": [
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
        "was not distributed with this file you can obtain one at",
    ],
    "epl-2": [
        "this program and the accompanying materials are made available under the terms of the eclipse public "
        "license 2 0 which is available at",
    ],
    "cc0": [
        "to the extent possible under law the author has waived all copyright and related or neighboring rights "
        "to this work",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify "
        "publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
    ],
    "boost": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the "
        "software and accompanying documentation covered by this license the software to use reproduce display "
        "distribute execute and transmit the software and to prepare derivative works of the software",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be "
        "held liable for any damages arising from the use of this software permission is granted to anyone to use "
        "this software for any purpose including commercial applications and to alter it and redistribute it freely "
        "subject to the following restrictions",
    ],
}
# the licences of one family, whose notices differ by the names of their terms and the version
for _terms in ("", "nc", "sa", "nd", "nc sa", "nc nd"):
    _names = {"nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
    for _version in ("4 0 international", "3 0 unported"):
        TEMPLATES.setdefault("-".join(["cc-by", *_terms.split()]), []).append(
            f"this work is licensed under a creative commons {' '.join(['attribution', *map(_names.get, _terms.split())])} {_version} license"
        )
#: Words of the shortest match that may be chained.
LEAST = 4
#: Share of a template's words that its chained matches must cover, unless it is short.
SHARE = 0.6
#: Templates of so few words must be covered whole.
SHORT = 12
#: Words between two matches of one chain.
GAP = 24

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
RESULT = (
    "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,"
    "score:double,spans:array<struct<label:string,start:long,end:long,share:double>>>"
)


class Automaton:
    """Suffix automaton of several word sequences.

    ``steps[state][word]`` is the next state, ``link`` the suffix link, ``size`` the length
    of the longest string of a state, ``places[state]`` maps a sequence to the position
    where that string first ends in it.
    """

    def __init__(self, sequences: list[list[bytes]]) -> None:
        self.steps: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.places: list[dict[int, int]] = [{}]
        for number, sequence in enumerate(sequences):
            state = 0
            for place, word in enumerate(sequence):
                state = self._extend(state, word)
                self.places[state].setdefault(number, place)
        # a state's strings also end where those of the states that link to it end
        for state in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            for number, place in self.places[state].items():
                above = self.places[self.link[state]]
                above[number] = min(place, above.get(number, place))

    def _new(self, size: int, link: int, steps: dict[bytes, int]) -> int:
        self.steps.append(dict(steps))
        self.link.append(link)
        self.size.append(size)
        self.places.append({})
        return len(self.size) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        """A copy of ``target`` for the strings that are one word longer than ``state``'s."""
        copy = self._new(self.size[state] + 1, self.link[target], self.steps[target])
        self.link[target] = copy
        while state >= 0 and self.steps[state].get(word) == target:
            self.steps[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        known = self.steps[last].get(word)
        if known is not None:
            return known if self.size[known] == self.size[last] + 1 else self._split(last, word, known)
        fresh = self._new(self.size[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.steps[state]:
            self.steps[state][word] = fresh
            state = self.link[state]
        if state >= 0:
            known = self.steps[state][word]
            exact = self.size[known] == self.size[state] + 1
            self.link[fresh] = known if exact else self._split(state, word, known)
        return fresh

    def walk(self, sequence: list[bytes]) -> int:
        state = 0
        for word in sequence:
            state = self.steps[state][word]
        return state


@lru_cache(maxsize=1)
def model():
    """Automaton, sequence lengths and labels, and per state the phrases that end there."""
    phrases = [p.encode().split() for p in PHRASES]
    pairs = [(t.encode().split(), label) for label, texts in TEMPLATES.items() for t in texts]
    sequences = phrases + [t for t, _ in pairs]
    labels = [*PHRASES.values(), *(label for _, label in pairs)]
    automaton = Automaton(sequences)
    ends = {automaton.walk(p): (len(p), PHRASES[b" ".join(p).decode()]) for p in phrases}
    outputs: list[list[tuple[int, str]]] = []
    for state in range(len(automaton.size)):
        found, up = [], state
        while up > 0:
            if up in ends:
                found.append(ends[up])
            up = automaton.link[up]
        outputs.append(found)
    return automaton, [len(s) for s in sequences], labels, outputs, len(phrases)


def matches(found: list[bytes]):
    """Maximal matches (text end, length, state) of at least LEAST words, and phrase places."""
    automaton, _, _, outputs, _ = model()
    steps, link, size = automaton.steps, automaton.link, automaton.size
    first = steps[0]
    long, places = [], []
    state = length = 0
    for at, word in enumerate(found):
        if state == 0 and word not in first:
            continue
        before = (at - 1, length, state)
        step = steps[state].get(word)
        while step is None and state > 0:
            state = link[state]
            length = size[state]
            step = steps[state].get(word)
        if step is None:
            state = length = 0
        else:
            state, length = step, length + 1
            for width, label in outputs[state]:
                if width <= length:
                    places.append((at - width + 1, label))
        if before[1] >= LEAST and length <= before[1]:
            long.append(before)
    if length >= LEAST:
        long.append((len(found) - 1, length, state))
    return long, places


def chains(long: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
    """Covered template spans (label, first word, end, share of the template)."""
    automaton, lengths, labels, _, n_phrases = model()
    by_template: dict[int, list[tuple[int, int, int, int]]] = {}
    for end, length, state in long:
        for number, place in automaton.places[state].items():
            if number >= n_phrases and place + 1 >= length:
                by_template.setdefault(number, []).append((end - length + 1, end + 1, place + 1 - length, place + 1))
    spans = []
    for number, found in by_template.items():
        start = stop = reach = covered = 0
        for text_from, text_to, from_, to in [*sorted(found), (1 << 60, 0, 0, 0)]:
            joins = covered and text_from - stop <= GAP and reach <= to and text_from < 1 << 59
            if joins:
                covered += min(to - max(from_, reach), text_to - max(text_from, stop))
                stop, reach = max(stop, text_to), max(reach, to)
                continue
            share = covered / lengths[number]
            if covered and share >= (1.0 if lengths[number] <= SHORT else SHARE):
                spans.append((labels[number], start, stop, min(1.0, share), covered))
            start, stop, reach, covered = text_from, text_to, to, to - from_
    return sorted({s[:4] for s in unrivalled(spans)}, key=lambda s: (s[1], s[0], s[2]))


def unrivalled(spans: list[tuple]) -> list[tuple]:
    """Spans without an overlapping span of another label that covers more words."""
    ordered = sorted(spans, key=lambda s: (s[1], s[2]))
    beaten = set()
    for k, span in enumerate(ordered):
        for j in range(k + 1, len(ordered)):  # spans are short, so few others begin inside one
            other = ordered[j]
            if other[1] >= span[2]:
                break
            if other[0] != span[0] and other[4] != span[4]:
                beaten.add(k if span[4] < other[4] else j)
    return [span for k, span in enumerate(ordered) if k not in beaten]


def scan(text: bytes | None) -> dict:
    found = WORD.findall(text.lower()) if text else []
    long, places = matches(found)
    spans = chains(long)
    base = sorted({label for _, label in places})
    starts = [start for start, _ in places]
    return {
        "n_words": len(found),
        "n_base": len(places),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(base),
        "labels": ",".join(sorted({*base, *(s[0] for s in spans)})),
        "score": 1.0 if base else max((s[3] for s in spans), default=0.0),
        "spans": [dict(zip(("label", "start", "end", "share"), s)) for s in spans],
    }


def _scan(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scan(t) for t in texts], columns=list(scan(None)))


def license_scan(text: Column) -> Column:
    """Struct of counts, labels, score and covered spans for a text column."""
    return F.pandas_udf(_scan, RESULT)(text.cast("binary"))
