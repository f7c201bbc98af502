"""Near-dedup and suffix dedup against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidora.llm import near_dedup, suffix_dedup

from . import brute

LETTERS = ["a", "bé", "Cat", "dog", "ewe", "fox", "gnu", "hen", "ibex", "jay", "koi", "lynx"]


def rand_text(r, n):
    return " ".join("".join(r.choice(LETTERS) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus(seed):
    r = random.Random(seed)
    base = [rand_text(r, n) for n in (200, 120, 60, 40)]
    passage = rand_text(r, 90)
    rows = []
    for i in range(90):
        words = r.choice(base).split(" ")
        for _ in range(r.choice([0, 1, 2, 4, 8, 12])):
            words[r.randrange(len(words))] = rand_text(r, 1)
        text = " ".join(words)
        if r.random() < 0.2:
            text = rand_text(r, 30) + " " + passage[r.randint(0, 60) :] + rand_text(r, 20)
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, "one"), (103, "one"), (104, "ONE two"), (105, " \t"), (106, rand_text(r, 5000))]
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, "quite alone in this world"), (107, "ab" * 900), (108, "x" * 1500), (3, "another text under the same id " * 3)]
    return rows


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    rows = corpus(size)
    df = spark.createDataFrame([(d, t, "x", 1.5) for d, t in rows], "doc_id long, text string, node string, `group` double")
    got = near_dedup.near_duplicates(df, size=size, percent=percent).collect()
    want = brute.near(rows, size, percent)
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted([(d, n, c) for (d, _), (n, c) in zip(rows, want)], key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION_ROWS", 8)
    monkeypatch.setattr(near_dedup, "GROUP_ROWS", 8)
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, size=3, percent=85).collect()
    want = brute.near(rows, 3, 85)
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted([(r.doc_id, r.component_id) for r in got], key=key) == sorted([(d, c) for (d, _), (_, c) in zip(rows, want)], key=key)


@pytest.mark.parametrize("percent,sizes", [(85, (82, 90, 100)), (80, (74, 85, 100)), (85, (62, 72, 84, 98))])
def test_exact_labels_of_chained_extensions(percent, sizes):
    for order in itertools.permutations(sizes):
        sets = [np.arange(n, dtype=np.uint64) for n in order]
        assert near_dedup.exact_labels(sets, percent).tolist() == [0] * len(sets)


def test_exact_labels_against_all_pairs():
    r = np.random.default_rng(5)
    for _ in range(60):
        base = [r.integers(0, 1 << 40, 120).astype(np.uint64) for _ in range(2)]
        sets = [np.unique(np.append(base[k][: r.integers(60, 121)], r.integers(0, 1 << 40, r.integers(0, 25)).astype(np.uint64))) for k in r.integers(0, 2, 12)]
        want = list(range(len(sets)))
        for i, j in itertools.combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
        assert near_dedup.exact_labels(sets, 85).tolist() == want


def _odd_key(x):
    return tuple((v is not None, v or 0) for v in x)


@pytest.mark.parametrize("length,hot", [(400, 2048), (150, 2), (40, 2048)])
def test_remove_repeats(spark, monkeypatch, length, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_ENTRIES", hot)
    rows = corpus(7)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, row string")
    got = suffix_dedup.remove_repeats(df, length=length, passages={"long_ones": 300}).collect()
    want = brute.repeats([t for _, t in rows], length)
    mine = [(r.doc_id, len((r.text or "").encode()), sum(s.end - s.first for s in r.removed_spans), len(r.removed_spans), bytes(r.kept_bytes)) for r in got]
    assert sorted(mine, key=_odd_key) == sorted([(d, *w) for (d, _), w in zip(rows, want)], key=_odd_key)
    told = brute.repeats([t for _, t in rows], 300)
    assert sorted([(r.doc_id, sum(s.end - s.first for s in r.long_ones)) for r in got], key=_odd_key) == sorted([(d, w[1]) for (d, _), w in zip(rows, told)], key=_odd_key)


def test_entries_beside_a_hot_hash_stay_together(spark, monkeypatch):
    # of 300 hashes, two entries each agree in the window at their anchor; they come far apart; another hash has 9 entries
    names = [(g, k) for k in range(2) for g in range(300)] + [(300, k) for k in range(9)]
    rows = [(g, k, 0, 1, 0, 1, bytearray([k + 1]) + b"%010d" % g) for g, k in names]
    entries = suffix_dedup.settle(spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), suffix_dedup._ENTRY_TYPE))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows come together anyway
    try:
        for hot in (1 << 14, 4):
            monkeypatch.setattr(suffix_dedup, "HOT_ENTRIES", hot)
            found = [(r.gram, r.span, r.first, r.last) for r in suffix_dedup.all_matches(entries, 10).collect()]
            assert sorted(found) == sorted((g, k, 0, 0) for g, k in names)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_very_long_text(spark):
    r = random.Random(3)
    passage = rand_text(r, 100)
    text = " ".join([rand_text(r, 200_000), passage, rand_text(r, 200_000), passage, "z" * 1_000_000])
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string"), length=400).first()
    assert len(text) > 2_000_000 and [s.end - s.first for s in got.removed_spans][-1] >= 1_000_000
    assert passage[5:-5] not in got.kept_bytes.decode("utf8", "ignore")


def test_batches_against_kept_levels(spark, tmp_path):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(11))][:80]
    length, hits = 150, {}
    for low in range(0, len(rows), 20):
        batch = spark.createDataFrame(rows[low : low + 20], "doc_id long, text string")
        # each batch goes to an index opened anew
        index = suffix_dedup.RepeatIndex(spark, str(tmp_path / "index"), length)
        for h in index.add(batch).collect():
            hits.setdefault(bytes(h.row), []).append({"first": h.first, "last": h.last})
        assert len(index.levels) <= 3 and sum(n for _, n in index.levels) > 0
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r.doc_id: bytes(r.k) for r in df.select("doc_id", suffix_dedup.row_key(F.col("doc_id"), F.col("text")).alias("k")).collect()}
    got = {}
    for i, text in rows:
        ranges = suffix_dedup.merged_ranges(sorted(hits.get(keys[i], []), key=lambda x: (x["first"], x["last"])), length)
        got[i] = (sum(b - a for a, b in ranges), len(ranges))
    want = brute.repeats([t for _, t in rows], length)
    assert got == {i: (w[1], w[2]) for (i, _), w in zip(rows, want)}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(df).count() == 0
    assert suffix_dedup.remove_repeats(df).count() == 0
