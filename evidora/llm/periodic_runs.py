"""Periodic runs of words: stretches that repeat with a period, such as looping output of a generator.

A run of period q is a stretch of words in which words q apart are equal, that no neighbouring word extends, with q its
smallest period, of at least `least_words` words and `exponent` periods.

The scan.  For every lag q up to n / exponent the array of word numbers is compared with itself shifted by q; a stretch of equal places of
length l is a stretch of l + q words with period q.  Its period is the smallest one if its first q words are no repetition of
a shorter block, which needs only those words.  So each lag is decided by itself, and lags can be dealt out.

Blocks.  The texts of a block of half a megabyte are compared together: they lie one after another, longest first, with word
numbers of their own, and lag q takes those that are long enough for it.

Long texts.  The work of a text grows with the square of its words.  Texts of over `LONG_BYTES` bytes are therefore cut into
ranges of `RANGE_LAGS` lags, and (text, range) pairs are dealt to the tasks with the word numbers only; what the ranges find is
brought back to the text.  A range of a text of n words costs at most RANGE_LAGS * n comparisons and ships 4n bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import NOT_SPACE, blocks, text_bytes, words
from .filter_audit import text_key
from .tables import map_batches, settle

EXPONENT = 3
LEAST_WORDS = 24
LONG_BYTES = 48 << 10
RANGE_LAGS = 4096

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def word_numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of each word, starts, ends, words of each text): equal numbers for equal words of one text, and for no others."""
    hashes, starts, ends, counts = words(data, offsets, NOT_SPACE, lower=False)
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    with np.errstate(over="ignore"):
        codes, _ = pd.factorize(hashes + owner * np.uint64(0x9E3779B97F4A7C15))
    return codes.astype(np.int32), starts, ends, counts


def _primitive(block: np.ndarray) -> bool:
    """Whether the block is no repetition of a shorter one."""
    n, left, p = len(block), len(block), 2
    while left > 1:
        if p * p > left:
            p = left
        if left % p == 0:
            while left % p == 0:
                left //= p
            if (block[n // p :] == block[: n - n // p]).all():
                return False
        p += 1
    return True


def scan(codes: np.ndarray, counts: np.ndarray, first_lag: int, last_lag: int, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs with periods from first_lag to last_lag in texts that lie one after another.

    Words of different texts must have different numbers.  Sorted by text, start and period.
    """
    order = np.argsort(-counts, kind="stable")
    begins = np.cumsum(counts) - counts
    line = np.concatenate([codes[begins[t] : begins[t] + counts[t]] for t in order.tolist()]) if len(codes) else codes
    at = np.append(0, np.cumsum(counts[order]))
    falling = -counts[order]
    found: list[tuple[int, int, int]] = []
    for q in range(first_lag, min(last_lag, int(counts.max(initial=0)) // exponent) + 1):
        n = int(at[np.searchsorted(falling, -max(least, exponent * q), side="right")])
        if not n:
            break
        need = max(least, exponent * q) - q
        same = np.flatnonzero(line[q:n] == line[: n - q])
        if len(same) < need:
            continue
        whole = same[need - 1 :] - same[: len(same) - need + 1] == need - 1
        if not whole.any():
            continue
        edge = np.flatnonzero(np.diff(same) != 1)
        lefts, rights = same[np.append(0, edge + 1)], same[np.append(edge, len(same) - 1)]
        for i in np.flatnonzero(rights - lefts + 1 >= need).tolist():
            if _primitive(line[lefts[i] : lefts[i] + q]):
                found.append((int(lefts[i]), int(rights[i] - lefts[i]) + 1 + q, q))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    start, length, period = np.array(found, dtype=np.int64).T
    place = np.searchsorted(at, start, side="right") - 1
    text, start = order[place], start - at[place]
    sort = np.lexsort((period, start, text))
    return text[sort], start[sort], length[sort], period[sort]


def _dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return np.cumsum(edges[:n]) > 0


def _collapsed(raw: bytes, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> bytes:
    return b" ".join([raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())])


def _tell(batch: pa.RecordBatch, counts: list[int], starts: list[np.ndarray], runs: list[np.ndarray], kept: list[bytes]) -> pa.RecordBatch:
    flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
    offsets = np.append(0, np.cumsum([len(r) for r in runs])).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=[pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]))
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), listed, pa.array([k.decode() for k in kept], pa.string())], names=[*batch.schema.names, "n_words", "runs", "collapsed"])


def _in_place(rows: DataFrame, exponent: int, least: int) -> DataFrame:
    """(all columns, n_words, runs, collapsed); the text is the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            for a, b in blocks(offsets):
                own = data[offsets[a] : offsets[b]]
                codes, starts, ends, counts = word_numbers(own, offsets[a : b + 1] - offsets[a])
                text, start, length, period = scan(codes, counts, 1, int(counts.max(initial=0)), exponent, least)
                raw, begins, cut = own.tobytes(), np.append(0, np.cumsum(counts)), np.searchsorted(text, np.arange(b - a + 1))
                runs, kept = [], []
                for t in range(b - a):
                    mine = slice(cut[t], cut[t + 1])
                    keep = ~_dropped(int(counts[t]), start[mine], length[mine], period[mine])
                    runs.append(np.stack([start[mine], length[mine], period[mine]], axis=1))
                    kept.append(_collapsed(raw, starts[begins[t] : begins[t + 1]], ends[begins[t] : begins[t + 1]], keep))
                yield _tell(batch.slice(a, b - a), counts.tolist(), starts, runs, kept)

    return map_batches(rows, run, _with_results(rows.schema))


def _with_results(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])


def lag_ranges(texts: DataFrame, exponent: int, lags: int) -> DataFrame:
    """(key, first, last, codes): for each (key, text), a row for every range of lags; copies within a task give theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, key in enumerate(batch.column(0).to_pylist()):
                if key in done:
                    continue
                done.add(key)
                own = data[offsets[i] : offsets[i + 1]]
                codes = word_numbers(own, np.array([0, len(own)]))[0]
                raw = codes.astype("<i4").tobytes()
                for first in range(1, len(codes) // exponent + 1, lags):
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([first + lags - 1], pa.int64()), pa.array([raw], pa.binary())], names=["key", "first", "last", "codes"])

    return map_batches(texts, run, "key binary, first long, last long, codes binary")


def _scan_ranges(ranges: DataFrame, exponent: int, least: int) -> DataFrame:
    """(key, start, length, period) of each range; rows with equal (key, first) stand together, and the first of them is scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for key, first, last, raw in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if (key, first) == before:
                    continue
                before = key, first
                codes = np.frombuffer(raw, dtype="<i4")
                _, start, length, period = scan(codes, np.array([len(codes)]), first, last, exponent, least)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(start), pa.binary()), *map(pa.array, (start, length, period))], names=["key", "start", "length", "period"])

    return map_batches(ranges, run, "key binary, start long, length long, period long")


def _brought_back(rows: DataFrame, n: int) -> DataFrame:
    """Rows whose last two columns are text and sorted runs, with n_words, runs and collapsed after the first n columns and the text."""
    kept = T.StructType([*rows.schema.fields[:n], rows.schema.fields[n]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(n))
            for i, runs in enumerate(batch.column(n + 1).to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                _, starts, ends, counts = words(own, np.array([0, len(own)]), NOT_SPACE, lower=False)
                table = np.array([[r["start"], r["length"], r["period"]] for r in runs or []], dtype=np.int64).reshape(-1, 3)
                keep = ~_dropped(int(counts[0]), *table.T)
                row = batch.slice(i, 1).select(list(range(n + 1)))
                yield _tell(row, counts.tolist(), [starts], [table], [_collapsed(own.tobytes(), starts, ends, keep)])

    return map_batches(rows, run, _with_results(kept))


def periodic_runs(df: DataFrame, *, text: str = "text", exponent: int = EXPONENT, least_words: int = LEAST_WORDS, long_bytes: int = LONG_BYTES, lags: int = RANGE_LAGS) -> DataFrame:
    """The table with n_words, runs (structs of start, length, period, in words from 0, by start and period) and collapsed.

    `collapsed` is the text's words joined by one space, without those that some run contains after its first period.

    Defined results: words are ``[^\\x20\\x09-\\x0D]+``, as they stand; a null or empty text, or one without words, has no words,
    no runs and an empty collapsed text; repeated rows get equal results; runs of equal start have different periods, so there are no ties; texts
    of any length are read whole; an empty table gives an empty one.  Columns named n_words, runs or collapsed are replaced.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    names = [c for c in df.columns if c.lower() not in ("n_words", "runs", "collapsed")]
    place = names.index(text)
    # plain names while the rows go through the tasks, so that no column can clash; the text comes last
    rest = [c for c in names if c != text]
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(f"`{text}`").alias("text"))
    is_long = F.octet_length(F.coalesce("text", F.lit(""))) > long_bytes
    short = _in_place(plain.where(~is_long), exponent, least_words)
    long = plain.where(is_long).withColumn("key", text_key(F.col("text")))
    ranges = lag_ranges(long.select("key", "text"), exponent, lags)
    dealt = ranges.groupBy("key", "first").agg(F.first("last").alias("last"), F.first("codes").alias("codes"))  # copies meet before the shuffle
    runs = _scan_ranges(dealt, exponent, least_words).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "period", "length"))).alias("runs"))
    runs = settle(runs.select(F.col("key").alias("of"), F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs")))
    met = long.join(runs, F.col("key") == F.col("of"), "left").select(*[f"c{i}" for i in range(len(rest))], "text", "runs")
    out = short.unionByName(_brought_back(met, len(rest)))
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(rest)]
    back.insert(place, F.col("text").alias(text))
    return out.select(*back, "n_words", "runs", "collapsed")
