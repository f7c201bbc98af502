"""Benchmark decontamination with suffix arrays of the training texts.

Each block of training texts (a shard) gets a suffix array over its words: the
starts of its suffixes in the order of their leading words.  Suffixes that
cannot match a test suffix, as one of their leading words is in no benchmark
item, are left out.  Every suffix of every test item that begins a window is then
looked up by binary search, which tells all places of that window in the shard;
windows that follow one another in an item and in a text join into one
verbatim match, which is the longest there.

The benchmark is a test set: it is sent to the tasks in parts of bounded size,
and a training text is read once for each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import ALNUM, blocks, text_bytes, words
from .tables import fresh, map_batches, row_key, spread

WINDOW = 10
PART_WORDS = 1 << 20


class TestSuffixes:
    """The windows of test items in the order of their words.

    Only words, as numbers into a vocabulary, are sent to the tasks (12 bytes a word at
    most); a task makes the windows of them, about 100 bytes each.
    """

    def __init__(self, items: list[tuple[str, np.ndarray, int]], window: int):
        """`items`: (id, hashes of words, number of the first word in its item)."""
        self.window, self.ids = window, [i for i, _, _ in items]
        self.base = np.array([base for _, _, base in items], np.int64)
        self.counts = np.array([len(h) for _, h, _ in items], np.int64)
        hashes = np.concatenate([h for _, h, _ in items]) if items else np.zeros(0, np.uint64)
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        self.numbers = numbers.astype(np.uint32) + np.uint32(1)
        self.shortest = int(np.minimum(self.counts[self.counts > 0], window).min()) if self.counts.any() else window

    @cached_property
    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(low key, high key, item, word of the item, size) of every window."""
        many = np.where(self.counts > 0, np.maximum(1, self.counts - self.window + 1), 0)
        owner = np.repeat(np.arange(len(self.counts)), many)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        size = np.minimum(self.counts[owner], self.window)
        at = (np.cumsum(self.counts) - self.counts)[owner] + place
        column = np.arange(self.window)
        inside = column < size[:, None]
        rows = self.numbers[np.minimum(at[:, None] + column, max(0, len(self.numbers) - 1))] if len(self.numbers) else np.zeros((0, self.window), np.uint32)
        low, high = (as_keys(np.where(inside, rows, np.uint32(pad))) for pad in (0, 0xFFFFFFFF))
        return low, high, owner, place + self.base[owner], size

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "windows"}


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings of the same order."""
    width = rows.shape[1] * 4
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{width}").ravel()


def suffix_array(numbers: np.ndarray, counts: np.ndarray, window: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, their word positions) of the suffixes whose first `shortest` words are all known."""
    ends = np.repeat(np.cumsum(counts), counts)  # where each word's text ends
    unknown = np.flatnonzero(np.append(numbers == 0, True))
    run_end = np.minimum(unknown[np.searchsorted(unknown, np.arange(len(numbers)))], ends)
    at = np.flatnonzero(run_end - np.arange(len(numbers)) >= shortest)
    places = at[:, None] + np.arange(window)
    rows = np.where(places < ends[at][:, None], numbers[np.minimum(places, max(0, len(numbers) - 1))], 0).astype(np.uint32)
    keys = as_keys(rows)
    order = np.argsort(keys, kind="stable")
    return keys[order], at[order]


def matches_in_block(tests: TestSuffixes, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int, int]]]:
    """Words of each text, and (text, test item, first word, words, word of the item) of every longest match, in order."""
    hashes, _, _, counts = words(data, offsets, ALNUM)
    low, high, owner, item_word, window_size = tests.windows
    if not len(hashes) or not len(low):
        return counts, []
    found = np.searchsorted(tests.vocabulary, hashes)
    found[found == len(tests.vocabulary)] = 0
    numbers = np.where(tests.vocabulary[found] == hashes, found + 1, 0).astype(np.uint32)
    keys, places = suffix_array(numbers, counts, tests.window, tests.shortest)
    first, last = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
    some = np.flatnonzero(last > first)
    hits = np.concatenate([np.stack([places[first[k] : last[k]], np.full(last[k] - first[k], k)], axis=1) for k in some.tolist()]) if len(some) else np.zeros((0, 2), np.int64)
    word, test = hits[:, 0], hits[:, 1]
    text = np.searchsorted(np.cumsum(counts), word, side="right")
    item, place, size = owner[test], item_word[test], window_size[test]
    # windows on one diagonal of (word, place of the item) join into a longer match
    order = np.lexsort((word, word - place, item, text))
    word, text, item, place, size = (x[order] for x in (word, text, item, place, size))
    follows = np.zeros(len(word), dtype=bool)
    follows[1:] = (text[1:] == text[:-1]) & (item[1:] == item[:-1]) & (word[1:] == word[:-1] + 1) & (place[1:] == place[:-1] + 1)
    heads = np.flatnonzero(~follows)
    tails = np.append(heads[1:], len(word)) - 1 if len(heads) else heads
    base = np.append(0, np.cumsum(counts))
    return counts, [(int(text[h]), int(item[h]), int(word[h] - base[text[h]]), int(word[t] + size[t] - word[h]), int(place[h])) for h, t in zip(heads.tolist(), tails.tolist())]


_MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("word", T.LongType()), T.StructField("words", T.LongType()), T.StructField("item_word", T.LongType())]))
_ARROW_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("item_word", pa.int64())]))


def _with_part(df: DataFrame, text: str, tests: TestSuffixes, n_words: str, matches: str) -> DataFrame:
    position, names = df.columns.index(text), df.columns
    shared = df.sparkSession.sparkContext.broadcast(tests)  # 12 bytes for each of about PART_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(position))
            sizes, found = [], [[] for _ in range(batch.num_rows)]
            for a, b in blocks(offsets):
                counts, there = matches_in_block(tests, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sizes += counts.tolist()
                for t, item, word, n, place in there:
                    found[a + t].append({"item_id": tests.ids[item], "word": word, "words": n, "item_word": place})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(found, _ARROW_MATCH)], names=[*names, n_words, matches])

    return map_batches(df, run, T.StructType([*df.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(matches, _MATCH)]))


def _parts(benchmark: DataFrame, item_id: str, text: str, window: int) -> Iterator[TestSuffixes]:
    """The test items, in parts of at most PART_WORDS words; longer items are cut into pieces that share window - 1 words.  Only one part is held at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{text}`")).toLocalIterator():
        hashes, _, _, _ = words(*text_bytes(pa.array([row[1] or ""])), ALNUM)
        step = max(1, PART_WORDS - window + 1)
        for base in range(0, max(1, len(hashes) - window + 1), step):
            piece = hashes[base : base + step + window - 1]
            if held and size + len(piece) > PART_WORDS:
                yield TestSuffixes(held, window)
                held, size = [], 0
            held.append((str(row[0]), piece, base))
            size += len(piece)
    yield TestSuffixes(held, window)


def benchmark_matches(df: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, n_words: str = "n_words", matches: str = "matches") -> DataFrame:
    """The table with each text's number of words and its verbatim matches with test items.

    A match is (item_id, word, words, item_word): `words` words from word number
    `word` of the text are those of the item from `item_word` on.  It covers one or
    more windows of `window` item words; an item of fewer words is one window.

    Defined results: a null text has no words and no match; very long texts are read
    whole, each by itself; an item without words
    matches nothing; items that share an id count as one; repeated items and rows
    give repeated matches, so there are no ties; an empty table gives an empty one, and with an empty
    benchmark nothing matches; a column named as an output is replaced.
    """
    df = df.drop(n_words, matches)
    parts = _parts(benchmark, item_id, item_text, window)
    one = next(parts)
    out = _with_part(df, text, one, n_words, matches)
    more = []
    own = fresh(df, ["row", "n", "more"])
    key = row_key(F.lit(None).cast("string"), F.col(f"`{text}`"))
    for part in parts:
        extra = _with_part(df.select(F.col(f"`{text}`").alias("text")).distinct(), "text", part, own["n"], own["more"])
        more.append(extra.where(F.size(own["more"]) > 0).select(row_key(F.lit(None).cast("string"), F.col("text")).alias(own["row"]), own["more"]))
    if not more:
        return out
    extra = reduce(DataFrame.union, more).groupBy(own["row"]).agg(F.flatten(F.collect_list(own["more"])).alias(own["more"]))
    out = spread(out.withColumn(own["row"], key), own["row"]).join(extra, own["row"], "left")
    none = F.array().cast(_MATCH)
    return out.withColumn(matches, F.concat(matches, F.coalesce(own["more"], none))).drop(own["row"], own["more"])


def words_hit(matches: str) -> Column:
    """The number of distinct words that matches cover."""
    ordered = F.array_sort(F.transform(F.col(matches), lambda m: F.struct(m["word"].alias("word"), (m["word"] + m["words"]).alias("end"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda s, m: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), m["end"] - F.greatest(s["end"], m["word"]))).alias("n"), F.greatest(s["end"], m["end"]).alias("end"))
    return F.aggregate(ordered, zero, step, lambda s: s["n"])
