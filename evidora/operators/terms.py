"""Where terms stand in texts: all terms of all checklists in one pass over each text (JOIN-06, FLT-10, GAT-01, PAR-15).

An automaton of all patterns runs over a text once, whatever their number, and gives each term's first places.  What the gate asks of a text (is a
term there, is it negated, do two groups stand near one another) is then read from these places.
"""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

POSITIONS = 30
#: Terms whose negated forms don't count against a text, and what negates them (fixed values).
NEGATED = {"condoned": ("not", "no", "without"), "allowed": ("not", "no", "without"), "granted": ("not", "no", "without"), "restored": ("not",)}
BEEN = ("condoned", "allowed", "granted")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def negated(term: str) -> str:
    """The key under which a term's negated forms stand."""
    return f"!{term}"


def patterns_of(terms: Iterable[str]) -> list[tuple[str, str, bool]]:
    """(pattern, key, between word ends) of terms: a phrase is plain text, a word stands between word ends; with the negated forms of those that have any."""
    out: list[tuple[str, str, bool]] = []
    for t in sorted({t for t in terms if t}):
        out.append((t, t, " " not in t))
        for no in NEGATED.get(t, ()):
            out += [(f"{no} {t}", negated(t), True)] + ([(f"{no} been {t}", negated(t), True)] if t in BEEN else [])
    return out


class Finder:
    """An automaton of patterns; `places` gives each key's first places in a text, in ascending order and without overlaps of a key with itself."""

    def __init__(self, patterns: list[tuple[str, str, bool]], most: int = POSITIONS) -> None:
        self.keys = sorted({k for _, k, _ in patterns})
        number = {k: i for i, k in enumerate(self.keys)}
        self.most, self.automaton = most, ahocorasick.Automaton()
        of: dict[str, list[tuple[int, bool]]] = {}
        for p, k, bounded in patterns:
            of.setdefault(p, []).append((number[k], bounded))
        for p, keys in of.items():
            self.automaton.add_word(p, (len(p), keys))
        self.automaton.make_automaton()

    def places(self, text: str) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        free: dict[int, int] = {}
        last = len(text) - 1
        for end, (size, keys) in self.automaton.iter(text) if len(self.automaton) else ():
            first, alone = end - size + 1, None
            for key, bounded in keys:
                at = found.get(key)
                if at is not None and (len(at) >= self.most or first < free[key]):
                    continue
                if bounded:
                    if alone is None:
                        alone = (not first or text[first - 1] not in _WORD) and (end == last or text[end + 1] not in _WORD)
                    if not alone:
                        continue
                if at is None:
                    found[key] = [first]
                else:
                    at.append(first)
                free[key] = end + 1
        return found


def term_places(text: Column, terms: Iterable[str], most: int = POSITIONS) -> Column:
    """A map from each term that is in the text to its first places; a null text has none."""
    patterns, made = patterns_of(terms), {}

    @F.arrow_udf("map<string, array<int>>")
    def find(texts: pa.Array) -> pa.Array:
        if "finder" not in made:
            made["finder"] = Finder(patterns, most)
        finder = made["finder"]
        owners, keys, places, sizes = [], [], [], []
        for row, t in enumerate(texts.to_pylist()):
            for key, at in finder.places(t or "").items():
                owners.append(row)
                keys.append(key)
                sizes.append(len(at))
                places += at
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(places, pa.int32()))
        offsets = np.searchsorted(np.array(owners, np.int64), np.arange(len(texts) + 1)).astype(np.int32)
        return pa.MapArray.from_arrays(pa.array(offsets), pa.array(finder.keys, pa.string()).take(pa.array(keys, pa.int64())), lists)

    return find(text)


def found(places: Column, term: Column | str) -> Column:
    return F.map_contains_key(places, F.lit(term) if isinstance(term, str) else term)


def counts_against(places: Column, term: Column | str) -> Column:
    """The term is there and stands nowhere negated (FLT-11)."""
    no = F.lit(negated(term)) if isinstance(term, str) else F.concat(F.lit("!"), term)
    return found(places, term) & ~F.map_contains_key(places, no)


def places_of(places: Column, terms: Column, most: int = POSITIONS) -> Column:
    """Places of the terms, of one after another, `most` in all."""
    return F.slice(F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(places, t), F.array().cast("array<int>")))), 1, most)
