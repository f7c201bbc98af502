"""Licence scan: Dice coefficient over word bigrams against licence templates.

Templates are notices and the whole texts of licences (`licenses/`).  A text's units
are its lines, its paragraphs (runs of lines between empty ones) and itself.  Spans of
as many words as a template has are units too: in lines and paragraphs the best first
and none over another match, and in the whole text also around smaller ones.  A
unit and a template are normalised to lower-case words and compared by
``2 |A & B| / (|A| + |B|)`` over their distinct word bigrams.  As that can't
reach a threshold t unless the smaller set has t / (2 - t) of the larger one's
size, templates are sorted by size and only those within the bounds are compared.

Defined results: a null or empty text has no unit and no match; very long texts are
read whole, each by itself; a unit of one word has that word as its only item; on
equal scores the longer template wins, then the first by name; repeated rows get
equal results; an empty table gives an empty one; other columns are kept, and a
column named as an output is replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bytetext import ALNUM, blocks, constants, splitmix, text_bytes, words
from .tables import map_batches

PERCENT = 80

#: (licence, text) of well-known notices and first sentences (fixed values).
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Licensed under the BSD License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is marked with CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]


def whole_licenses() -> list[tuple[str, str]]:
    """(licence, text) of the licence texts that come with the package."""
    files = sorted(resources.files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name)
    return [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in files if f.name.endswith(".txt")]


TEMPLATES = [*NOTICES, *whole_licenses()]


def bigrams(hashes: np.ndarray) -> np.ndarray:
    if len(hashes) == 1:
        return hashes
    c = constants(2, 71)
    return np.unique(splitmix(hashes[:-1] * c[0] + hashes[1:] * c[1]))


class Templates:
    """Templates by size, and a vocabulary of their bigrams."""

    def __init__(self, texts: list[tuple[str, str]], percent: int):
        made = []
        for name, text in texts:
            hashes, _, _, _ = words(*text_bytes(pa.array([text])), ALNUM)
            if len(hashes):
                made.append((len(bigrams(hashes)), name, bigrams(hashes), len(hashes)))
        made.sort(key=lambda t: (t[0], t[1]))
        self.percent = percent
        self.sizes = [t[0] for t in made]
        self.names = [t[1] for t in made]
        self.sets = [t[2] for t in made]
        self.lengths = [t[3] for t in made]
        self.vocabulary = np.unique(np.concatenate(self.sets)) if made else np.zeros(0, np.uint64)
        #: which template has which bigram, and how many bigrams of it a match has at least
        self.member = np.array([np.isin(self.vocabulary, s) for s in self.sets]).T.reshape(len(self.vocabulary), len(made))
        self.least = np.array([max(1, -(-n * percent // (200 - percent))) for n in self.sizes], np.int64)

    def best(self, unit: np.ndarray) -> tuple[str, int, int, int] | None:
        """(licence, intersection, sum of sizes, template) with the highest Dice coefficient of at least the threshold."""
        n, p = len(unit), self.percent
        low = bisect_left(self.sizes, -(-n * p // (200 - p)))
        high = bisect_right(self.sizes, n * (200 - p) // p)
        best = None
        for k in range(low, high):
            both = len(np.intersect1d(unit, self.sets[k], assume_unique=True))
            total = n + self.sizes[k]
            if 200 * both >= p * total and (best is None or both * best[2] >= best[1] * total and (both * best[2], self.sizes[k]) > (best[1] * total, self.sizes[best[3]])):
                best = (self.names[k], both, total, k)
        return best


def units(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, first byte, end) of all lines, of the paragraphs of more than one, and of the texts of more than one paragraph."""
    out: list[tuple[int, int, int]] = []
    breaks = np.flatnonzero(data == 10)
    for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        own = breaks[np.searchsorted(breaks, a) : np.searchsorted(breaks, b)].tolist()
        lines = [(x, y) for x, y in zip([a, *(k + 1 for k in own)], [*own, b])]
        out += [(i, x, y) for x, y in lines if y > x]
        run: list[tuple[int, int]] = []
        runs = 0
        for line in [*lines, (b, b)]:
            if line[1] > line[0] and data[line[0] : line[1]].tobytes().strip():
                run.append(line)
            else:
                runs += bool(run)
                if len(run) > 1:
                    out.append((i, run[0][0], run[-1][1]))
                run = []
        if runs > 1:
            out.append((i, a, b))
    return out


def spans_within(templates: Templates, hashes: np.ndarray, hits: np.ndarray, which: np.ndarray) -> list[tuple[tuple[str, int, int, int], int, int]]:
    """(match, first word, end) of matching spans as long as a template, the best first; `hits` are places of the bigrams numbered `which`."""
    found = {}
    member = templates.member[which]
    for k in np.flatnonzero(member.sum(axis=0) >= templates.least).tolist():
        n = templates.lengths[k]
        if n < 2 or n >= len(hashes):
            continue
        own = hits[member[:, k]]
        # a span can start at its first hit, or end with the words, and loses none by it
        starts = np.unique(np.minimum(own, len(hashes) - n))
        many = np.searchsorted(own, starts + n - 1) - np.searchsorted(own, starts) >= templates.least[k]
        for start in starts[many].tolist():
            if (start, start + n) not in found:
                best = templates.best(bigrams(hashes[start : start + n]))
                if best:
                    found[start, start + n] = best
    return [(m, a, b) for (a, b), m in sorted(found.items(), key=lambda x: (-x[1][1] / x[1][2], x[0][0] - x[0][1], x[0]))]


def scan_block(templates: Templates, data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
    found: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    hashes, starts, ends, _ = words(data, offsets, ALNUM)
    if not len(hashes) or not len(templates.vocabulary):
        return found
    c = constants(2, 71)
    pairs = splitmix(hashes[:-1] * c[0] + hashes[1:] * c[1])
    which = np.searchsorted(templates.vocabulary, pairs)
    which[which == len(templates.vocabulary)] = 0
    hits = np.flatnonzero(templates.vocabulary[which] == pairs) if len(pairs) else np.zeros(0, np.int64)
    which, seen = which[hits], starts[hits]
    whole, open_units = units(data, offsets), []
    for text, first, end in whole:
        # a unit that holds no bigram of any template has a coefficient of 0
        k = np.searchsorted(seen, first)
        a, b = np.searchsorted(starts, [first, end])
        if b - a == 1 or (k < len(seen) and seen[k] < end):
            best = templates.best(bigrams(hashes[a:b])) if b > a else None
            base = int(offsets[text])
            if best:
                found[text].append({"license": best[0], "score": round(2 * best[1] / best[2], 6), "first": first - base, "end": end - base})
            else:
                open_units.append((text, a, b, first == base and end == offsets[text + 1]))
    for text, a, b, around in open_units:
        base = int(offsets[text])
        x, y = np.searchsorted(hits, [a, b - 1])
        for best, first_word, end_word in spans_within(templates, hashes[a:b], hits[x:y] - a, which[x:y]) if y > x else ():
            first, end = int(starts[a + first_word]) - base, int(ends[a + end_word - 1]) - base
            if all(m["end"] <= first or m["first"] >= end or (around and first <= m["first"] and m["end"] <= end and m["end"] - m["first"] < end - first) for m in found[text]):
                found[text].append({"license": best[0], "score": round(2 * best[1] / best[2], 6), "first": first, "end": end})
    return found


def scan_licenses(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, *, text: str = "text", licenses: str = "licenses", percent: int = PERCENT) -> DataFrame:
    """Add the matches of each text: an array of (license, score, first, end), places in bytes."""
    df = df.drop(licenses)
    names, position = df.columns, df.columns.index(text)
    made = Templates(templates, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(position))
            found: list[list[dict]] = []
            for a, b in blocks(offsets):
                found += scan_block(made, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ARROW)], names=[*names, licenses])

    return map_batches(df, run, T.StructType([*df.schema.fields, T.StructField(licenses, _TYPE)]))


_ARROW = pa.list_(pa.struct([("license", pa.string()), ("score", pa.float64()), ("first", pa.int64()), ("end", pa.int64())]))
_TYPE = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
