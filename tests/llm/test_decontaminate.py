from __future__ import annotations

import pickle
import random

from pyspark.sql import functions as F

from evidora.llm import decontaminate

from . import brute
from .test_dedup import rand_text


def test_matches(spark, monkeypatch):
    r = random.Random(4)
    items = [(i, rand_text(r, r.choice([3, 9, 10, 11, 40]))) for i in range(12)] + [(50, None), (51, ""), (52, "?!"), (3, "four short words here"), (60, "solo")]
    docs = []
    for i in range(60):
        text = rand_text(r, 60)
        for _ in range(r.randint(0, 3)):
            words = (r.choice(items)[1] or "").upper().split(" ")
            a = r.randint(0, max(0, len(words) - 10))
            text += r.choice([" ", ", "]) + "-".join(words[a : a + r.choice([9, 10, 12, 40])]) + " " + rand_text(r, r.randint(0, 9))
        docs.append((i, text))
    docs += [(90, None), (91, ""), (92, items[4][1]), (92, items[4][1]), (None, "solo"), (93, (items[4][1] + " ") * 30)]
    want = brute.leaks([t for _, t in docs], items, 10)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    by_id = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    for part in (1 << 20, 30):
        monkeypatch.setattr(decontaminate, "PART_WORDS", part)
        out = decontaminate.benchmark_matches(df, bench)
        got = out.select("doc_id", "n_words", decontaminate.words_hit("matches").alias("hit"), F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"]))).alias("ids")).collect()
        assert sorted([(g.doc_id, g.n_words, g.hit, g.ids) for g in got], key=by_id) == sorted([(d, *w) for (d, _), w in zip(docs, want)], key=by_id)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.benchmark_matches(docs, bench).count() == 0
    one = decontaminate.benchmark_matches(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), bench).first()
    assert (one.n_words, one.matches) == (2, [])


def test_what_is_sent_stays_small(spark, monkeypatch):
    r = random.Random(1)
    text = rand_text(r, 200_000)
    bench = spark.createDataFrame([(1, text), (2, rand_text(r, 60))], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "PART_WORDS", 50_000)
    parts = list(decontaminate._parts(bench, "item_id", "text", 10))
    assert len(parts) == 5 and all(len(pickle.dumps(p)) <= 50_000 * 12 + 10_000 for p in parts)
    assert sum(len(p.windows[0]) for p in parts) == 200_000 - 9 + 51
    assert all(len(pickle.dumps(p)) <= 50_000 * 12 + 10_000 for p in parts)  # also after windows are made
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert decontaminate.benchmark_matches(docs, bench).select(decontaminate.words_hit("matches")).first()[0] == 200_000
