"""License notices in texts, by patience alignment with templates.

Words are runs of letters and digits, in lower case. A template is aligned with a
stretch of text by anchoring on words that occur once in both, keeping the longest
increasing subsequence of them, and aligning the gaps between anchors in the same
way. Coverage is the share of the template's words that the alignment matches.

Texts are searched whole. A stretch is aligned only where enough of its words
occur in the template at all, an upper bound on coverage that is counted for every
stretch, so nothing with the wanted coverage is passed over. A notice that stands
several times is found each time.

Licenses often differ in a word. A template may have keys, the words that tell its
license from others (family, variant, version): all of them must be matched, and in
the text nothing but filler may stand between the words of a key. Of notices of one
license that overlap the one with more matched words counts; of notices of several
licenses the one with the higher coverage, then more matched words, then the
earlier template. In ``v3`` the v is no part of the word.

Defined results: a NULL or empty text has no notices; rows are handled one by one,
so repeated rows repeat; no templates, no notices; an empty table gives an empty
result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from echofind.llm.common import blocks, span_hashes, words

# Wordings of public license notices, and their keys.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2"),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "apache 2",
    ),
    ("mit", "Released under the MIT License.", "mit"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction",
        "deal in",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public 3"),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
        "gnu general public",
        "foundation 3",
    ),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License version 3 as published by the Free Software Foundation",
        "gnu general public 3",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4"),
    ("cc-by-4.0", "Licensed under CC BY 4.0.", "cc by 4"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", "cc by sa 4"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "source and binary",
        "with or without",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public 2"),
)
#: Words that may stand between those of a key.
FILLER = "license licence version v software either only attribution international"
#: Words of text per word of template that an alignment may take up.
STRETCH = 1.5

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32

Alignment = list[tuple[int, int]]


def _plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes in lower case, blank where no word is; so is the v of a version."""
    plain = _PLAIN[data]
    v = np.flatnonzero(plain == 118)
    first = np.isin(v, offsets)
    v = v[first | (plain[v - 1] == 32)]
    v = v[~np.isin(v + 1, offsets)]
    plain[v[(plain[v + 1] >= 48) & (plain[v + 1] <= 57)]] = 32
    return plain


def patience(text: list, template: list) -> Alignment:
    """Pairs of positions (text, template) that a patience alignment matches, in order."""
    pairs: Alignment = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:  # what the ends share needs no anchor
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        at = {w: i for i, w in enumerate(template[c:d], c) if there[w] == 1}
        anchors = [(i, at[w]) for i, w in enumerate(text[a:b], a) if here[w] == 1 and w in at]
        chain = _longest_rise(anchors)
        if not chain:
            continue
        pairs.extend(chain)
        edges = [(a - 1, c - 1), *chain, (b, d)]
        todo.extend((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]))
    return sorted(pairs)


def _longest_rise(anchors: Alignment) -> Alignment:
    """Longest subsequence that also rises in the second place, by piles as in patience."""
    tops: list[int] = []
    where: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(anchors):
        pile = bisect_left(tops, j)
        back.append(where[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            where.append(k)
        else:
            tops[pile], where[pile] = j, k
    chain: Alignment = []
    k = where[-1] if where else -1
    while k >= 0:
        chain.append(anchors[k])
        k = back[k]
    return chain[::-1]


class Matcher:
    """Templates, ready to be looked for."""

    def __init__(self, templates: tuple[tuple[str, ...], ...], least: float):
        self.names = [name for name, *_ in templates]
        self.words = [self.word_hashes(text.encode())[0].tolist() for _, text, *_ in templates]
        self.keys = [[self._places(key, w) for key in keys] for (_, _, *keys), w in zip(templates, self.words)]
        self.filler = set(self.word_hashes(FILLER.encode())[0].tolist())
        self.need = [max(1, int(np.ceil(least * len(w) - 1e-9))) for w in self.words]
        self.width = [int(np.ceil(len(w) * STRETCH)) for w in self.words]
        self.known = np.unique(np.array([w for ws in self.words for w in ws], np.uint64))
        self.has = np.array([np.isin(self.known, np.array(ws, np.uint64)) for ws in self.words]).reshape(len(templates), len(self.known))

    @staticmethod
    def word_hashes(raw: bytes):
        offsets = np.array([0, len(raw)])
        plain = _plain(np.frombuffer(raw, np.uint8), offsets)
        starts, ends, _ = words(plain, offsets)
        return span_hashes(plain, starts, ends), starts, ends

    def _places(self, key: str, template: list) -> list[int]:
        """Where the words of a key stand in its template, in order."""
        places: list[int] = []
        for word in self.word_hashes(key.encode())[0].tolist():
            places.append(template.index(word, places[-1] + 1 if places else 0))
        return places

    def _named(self, t: int, pairs: Alignment, text: list) -> bool:
        """Whether the alignment matches every key of template ``t``, without other words inside."""
        if not self.keys[t]:
            return True
        at = {j: i for i, j in pairs}
        for places in self.keys[t]:
            if not all(j in at for j in places):
                return False
            if any(w not in self.filler for j, m in zip(places, places[1:]) for w in text[at[j] + 1 : at[m]]):
                return False
        return True

    def stretches(self, data: np.ndarray, offsets: np.ndarray):
        """Per template: first words of stretches that may reach the coverage; and all words."""
        plain = _plain(data, offsets)
        starts, ends, first = words(plain, offsets)
        hashes = span_hashes(plain, starts, ends)
        place = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        hit = np.flatnonzero(self.known[place] == hashes) if len(self.known) else np.zeros(0, np.int64)
        row = np.searchsorted(first, hit, "right") - 1
        found = []
        for t in range(len(self.words)):
            mine = self.has[t][place[hit]]
            at, own = hit[mine], row[mine]
            # a stretch that may do starts with a word of the template, and holds enough of them
            far = at + self.width[t]
            until = np.minimum(np.searchsorted(at, far), np.searchsorted(own, own, "right"))
            found.append(at[until - np.arange(len(at)) >= self.need[t]])
        return hashes, starts, ends, first, found

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[str, float, int, int]]]:
        """Per row: name, coverage, first and end byte of each notice, in order."""
        hashes, starts, ends, first, found = self.stretches(data, offsets)
        raw: list[list[tuple]] = [[] for _ in range(len(offsets) - 1)]
        for t, candidates in enumerate(found):
            rows = np.searchsorted(first, candidates, "right") - 1
            best = None  # matched words (negative), last word, row, span; the best of stretches that overlap
            for at, row in zip(candidates.tolist(), rows.tolist()):
                if best and (at > best[1] or row != best[2]):
                    raw[best[2]].append((best[0], t, *best[3:]))
                    best = None
                text = hashes[at : min(at + self.width[t], first[row + 1])].tolist()
                pairs = patience(text, self.words[t])
                if len(pairs) >= self.need[t] and (best is None or -len(pairs) < best[0]) and self._named(t, pairs, text):
                    low, high = at + pairs[0][0], at + pairs[-1][0]
                    best = (-len(pairs), high, row, int(starts[low] - offsets[row]), int(ends[high] - offsets[row]))
            if best:
                raw[best[2]].append((best[0], t, *best[3:]))
        out = []
        for spans in raw:
            own: list[list] = []  # of each license the longest; it ranks by the best coverage it overlaps
            for count, t, a, b in sorted(spans):
                coverage = -count / len(self.words[t])
                over = [s for s in own if s[2] == self.names[t] and a < s[5] and s[4] < b]
                for s in over:
                    s[0] = min(s[0], -coverage)
                if not over:
                    own.append([-coverage, (count, t), self.names[t], coverage, a, b])
            kept: list[tuple] = []
            for _, _, name, coverage, a, b in sorted(own):
                if all(b <= x or y <= a for _, _, x, y in kept):
                    kept.append((name, coverage, a, b))
            out.append(sorted(kept, key=lambda s: s[2]))
        return out


def notices(
    documents: DataFrame,
    templates: tuple[tuple[str, ...], ...] = TEMPLATES,
    least: float = 0.8,
    carry: list[str] | None = None,
) -> DataFrame:
    """Per row: ``row`` (the ``carry`` columns, default all) and ``notices``.

    A notice has ``license``, ``coverage`` (``least`` or more), ``start`` and
    ``end`` in code points, the end exclusive.
    """
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in carry or documents.columns]).alias("row"), "text")
    fields = [StructField("license", StringType()), StructField("coverage", DoubleType())]
    notice = StructType([*fields, StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([rows.schema["row"], StructField("notices", ArrayType(notice))])
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def found(batches):
        matcher = Matcher(templates, least)
        for part, data, offsets in blocks(batches):
            out = []
            for k, spans in enumerate(matcher.matches(data, offsets)):
                body = data[offsets[k] : offsets[k + 1]].tobytes() if spans else b""
                out.append(
                    [
                        {"license": n, "coverage": c, "start": len(body[:a].decode()), "end": len(body[:b].decode())}
                        for n, c, a, b in spans
                    ]
                )
            yield pa.record_batch([part.column(0), pa.array(out, kind)], ["row", "notices"])

    return rows.mapInArrow(found, schema)
