"""Filter audit, Jaccard join and periodic runs against plain versions, and their odd inputs."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evidora.llm import filter_audit, jaccard_join, periodic_runs, queries
from evidora.llm.components import connected_components

from . import brute

SF = "/root/testdata/sf0.001"


def rows_of(name):
    t = pq.read_table(f"{SF}/{name}.parquet")
    return t.to_pylist()


# ---- filter audit


def failed(text, later):
    w = brute.split_words(text)
    checks = {
        "A": len(w) < 50,
        "B": 100 * len(set(w)) < 65 * len(w),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": later,
    }
    return {k for k, v in checks.items() if v}


def wanted_audit(docs, labels):
    least = {}
    for d, _, text in docs:
        if d is not None:
            least[text or ""] = min(least.get(text or "", d), d)
    good, toxic = ({x["doc_id"] for x in labels if x[k] == 1} for k in ("quality", "toxic"))
    rows = [(part or "", failed(text or "", d is not None and least[text or ""] < d), {n for n, s in (("good", good), ("toxic", toxic)) if d in s}) for d, part, text in docs]
    return brute.audits(rows, ["good", "toxic"], list(itertools.permutations("ABCDE")))


def got_audit(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_op11(spark):
    got = got_audit(queries.op11_filter_audit(spark, SF))
    assert got == wanted_audit([(d["doc_id"], d["source"], d["text"]) for d in rows_of("documents")], rows_of("labels"))
    assert any(v[2] for v in got.values()) and any(v[4] for v in got.values()) and any(v[5] for v in got.values())


def test_op11_on_odd_rows(spark, tmp_path):
    """Null texts, sources and ids, repeated rows and ids, an unlabelled and a twice labelled document."""
    docs = [(1, "a", None), (2, "a", ""), (2, "a", ""), (None, None, ""), (None, "", "X # y"), (3, "", "X # y"), (3, "b", "X # y"), (4, None, "w " * 60 + "é"), (5, "b", "Ä" * 20 + "A")]
    labels = [{"doc_id": 2, "quality": 1, "toxic": 0}, {"doc_id": 2, "quality": 0, "toxic": 1}, {"doc_id": None, "quality": 1, "toxic": 1}, {"doc_id": 4, "quality": 0, "toxic": None}]
    spark.createDataFrame([(d, t, "x", s) for d, s, t in docs], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([tuple(x.values()) for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert got_audit(queries.op11_filter_audit(spark, str(tmp_path))) == wanted_audit(docs, [x for x in labels if x["doc_id"] is not None])
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/e/labels.parquet")
    assert queries.op11_filter_audit(spark, f"{tmp_path}/e").count() == 0


def test_audit_of_other_filters_and_orders(spark):
    """Any number of filters, orders of one's own, names of several letters, clashing column names."""
    r = random.Random(4)
    rows = [("p" if r.random() < 0.3 else "q", *[r.random() < 0.4 for _ in range(3)], r.random() < 0.5) for _ in range(300)]
    df = spark.createDataFrame(rows, "part string, mask boolean, n boolean, `order` boolean, before boolean")
    orders = [("first", "third"), ("third", "second", "first"), ("second",)]
    told = filter_audit.audit(df, {"first": F.col("mask"), "second": F.col("n"), "third": F.col("order")}, part=F.col("part"), marks={"lucky": F.col("before")}, orders=orders, between=">")
    got = {(x.part, x.filter_order.replace(">", ""), x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.lucky_lost) for x in told.collect()}
    names = {"first": 1, "second": 2, "third": 3}
    plain = [(x[0], {f for f, k in names.items() if x[k]}, {"lucky"} if x[4] else set()) for x in rows]
    want = {}
    for part, order in itertools.product("pq", orders):
        left = [x for x in plain if x[0] == part]
        for step, f in enumerate(order, 1):
            mine, fail = [x for x in left if f in x[1]], [x for x in plain if x[0] == part and f in x[1]]
            left = [x for x in left if f not in x[1]]
            want[part, "".join(order), step] = (len(left), len(mine), len(fail) - len(mine), sum(x[1] == {f} for x in fail), sum(bool(x[2]) for x in mine))
    assert got == want
    with pytest.raises(ValueError):
        filter_audit.audit(df, {str(k): F.col("n") for k in range(9)}, part=F.col("part"))
    with pytest.raises(ValueError):
        filter_audit.audit(df, {"a": F.col("n")}, part=F.col("part"), orders=[("a", "a")])


# ---- Jaccard join


def test_op12(spark):
    docs = [(d["doc_id"], d["text"]) for d in rows_of("documents")]
    want = sorted((d, n, c) for (d, _), (n, c) in zip(docs, brute.near(docs, 4, 85)))
    assert sorted(tuple(r)[:3] for r in queries.op12_jaccard_join(spark, SF).collect()) == want


def near_texts(r, n, kinds):
    rows = []
    for k in range(n):
        words = [f"b{k % kinds}x{i}" for i in range(90)]
        for at in r.sample(range(90), r.choice([0, 1, 1, 2, 3, 5])):
            words[at] = f"c{r.randrange(40)}"
        rows.append((k, " ".join(words[: r.choice([90, 90, 84])])))
    return rows


@pytest.mark.parametrize("limits", [(16, 2048, 1 << 20, 32), (2, 16, 400, 4)])
def test_join_of_large_groups(spark, monkeypatch, limits):
    """Large groups of near copies; lists and units far above their limits give the same."""
    for name, value in zip(("SMALL", "LIST_ROWS", "UNIT_ITEMS", "SHARED"), limits):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_texts(random.Random(3), 150, 2)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()}
    assert got == {d: w for (d, _), w in zip(rows, brute.near(rows, 3, 85))}


def test_join_of_a_large_group_tells_no_pairs(spark, monkeypatch):
    """What lists chain grows with a group's size, not with its square, and sets that only resemble the group stay out of it."""
    told = []

    def counted(edges):
        told.append(edges.count())
        return connected_components(edges)

    monkeypatch.setattr(jaccard_join, "connected_components", counted)
    monkeypatch.setattr(jaccard_join, "LISTS", 1)
    r, rows = random.Random(7), []
    for k in range(240):
        words = [f"b{i}" for i in range(90)]
        for at in r.sample(range(90), r.choice([1, 1, 2, 3])):
            words[at] = f"c{k}x{at}"
        rows.append((k, " ".join(words)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()}
    assert got == {d: w for (d, _), w in zip(rows, brute.near(rows, 3, 85))}
    assert 1 < len({c for _, c in got.values()}) < 200
    assert max(told) < 4 * len(rows)


def test_chains_join_what_passes_the_filters():
    """Labels are joined if a pair of their postings passes, across sizes too, and others are not."""
    size = np.array([80, 100, 100, 100, 120])
    behind, fine = np.zeros((5, jaccard_join.SLOTS), "<u2"), np.zeros((5, jaccard_join.FINE), np.uint8)
    behind[:, 0], fine[:, 0] = size - 1, size
    fine[2, 0], fine[2, 1] = 50, 50
    got = jaccard_join.chained_labels(np.arange(5), size, np.zeros(5, np.int64), behind, fine, 85)
    assert got[1] == got[3] and len(set(got.tolist())) == 4
    assert len(set(jaccard_join.chained_labels(np.array([0, 1, 1, 3, 4]), size, np.zeros(5, np.int64), behind, fine, 85).tolist())) == 3


@pytest.mark.parametrize(
    "edges, want",
    [
        ([], {}),
        ([(2, 1), (1, 3), (1, 1), (None, 4)], {1: 1, 2: 1, 3: 1}),
        ([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9)], {**{k: 1 for k in range(1, 6)}, 8: 8, 9: 8}),
        ([(3, 1), (3, 2)], {1: 1, 2: 1, 3: 1}),
    ],
)
def test_components_of_stars_and_of_what_is_none(spark, edges, want):
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(tuple(x) for x in got) == sorted(want.items())


def test_join_on_odd_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (None, "A b C d e"), (4, "x y"), (5, "x  y"), (6, "x y z"), (None, "lonely here"), (7, " \t\n")]
    df = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id long, text string, node string, size int")
    got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, size=4, percent=85).collect())
    want = sorted((d is None, d, n, c) for (d, _), (n, c) in zip(rows, brute.near(rows, 4, 85)))
    assert got == want
    assert jaccard_join.jaccard_components(df.limit(0), size=4, percent=85).count() == 0


def test_filters_lose_no_pair():
    """Prefixes of any ranking meet, and the first common n-gram passes all filters, for all linked pairs at and above the border."""
    r = np.random.default_rng(5)
    for percent in (50, 80, 85, 100):
        linked = 0
        for _ in range(400):
            n = int(r.integers(1, 60))
            x = r.choice(200, n, replace=False)
            y = np.unique(np.concatenate([r.choice(x, max(1, n - int(r.integers(0, 1 + n // 3))), replace=False), r.integers(200, 400, int(r.integers(0, 4)))]))
            rank, hashes = r.permutation(400), r.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2)
            both = len(np.intersect1d(x, y))
            if 100 * both < percent * (len(x) + len(y) - both):
                continue
            linked += 1
            x, y = x[np.argsort(rank[x])], y[np.argsort(rank[y])]
            heads = [z[: int(jaccard_join.prefix_length(np.array([len(z)]), percent)[0])] for z in (x, y)]
            common = [g for g in heads[0] if g in heads[1]]
            assert common
            at = [int(np.flatnonzero(z == common[0])[0]) for z in (x, y)]
            behind = np.stack([np.bincount(jaccard_join._slot(hashes[z[a + 1 :]]), minlength=jaccard_join.SLOTS) for z, a in zip((x, y), at)]).astype("<u2")
            ok = jaccard_join.passing(np.array([0]), np.array([1]), np.array([len(x), len(y)]), np.array(at), behind, percent)
            assert ok.all()
        assert linked > 10


def test_filters_part_most_other_pairs():
    size, behind = np.array([100, 100, 80, 100]), np.zeros((4, jaccard_join.SLOTS), "<u2")
    behind[:, 0] = size - 1
    behind[3] = 0
    behind[3, 1] = 99
    p = lambda i, j, pos: bool(jaccard_join.passing(np.array([i]), np.array([j]), size, np.array(pos), behind, 85)[0])
    assert p(0, 1, [0, 0, 0, 0]) and not p(0, 2, [0, 0, 0, 0])  # length
    assert not p(0, 1, [9, 0, 0, 0]) and p(0, 1, [8, 8, 0, 0])  # position
    assert not p(0, 3, [0, 0, 0, 0])  # suffix


# ---- periodic runs


def looped(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def told_runs(doc_id, w):
    runs = brute.runs_of(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), brute.sha(brute.collapse(w, runs)))


def test_op13(spark):
    docs = [(d["doc_id"], d["text"]) for d in rows_of("documents")]
    want = [told_runs(d, looped(d, brute.split_words(t))) for d, t in docs]
    assert sorted(tuple(r)[:8] for r in queries.op13_periodic_runs(spark, SF).collect()) == sorted(want)
    assert sum(w[1] > 0 for w in want) > 10


def odd_texts():
    r = random.Random(8)
    texts = [None, "", " \t\n ", "w", "w " * 23, "w " * 24, "W w " * 12, "a b c " * 30, "x y z " * 8 + "x y", ("a b " * 4 + "c ") * 9, "é e " * 30]
    for _ in range(60):  # nested and overlapping runs over few words
        parts = []
        for _ in range(r.randint(1, 6)):
            block = [r.choice("abc") for _ in range(r.randint(1, 9))]
            parts += block * r.randint(1, 12) + [r.choice("abcd") for _ in range(r.randint(0, 5))]
        texts.append(" ".join(parts))
    return texts


@pytest.mark.parametrize("limits", [(1 << 20, 4096), (40, 3)])
def test_runs_of_odd_texts(spark, limits):
    """Texts of nested runs, as whole texts and as ranges of lags; columns of the result's and of working names."""
    rows = [(i, t, "own", "k", f"t{i}") for i, t in enumerate(odd_texts() + odd_texts()[20:30])]
    df = spark.createDataFrame(rows, "c1 long, body string, runs string, key string, text string")
    out = periodic_runs.periodic_runs(df, text="body", long_bytes=limits[0], lags=limits[1])
    assert out.columns == ["c1", "body", "key", "text", "n_words", "runs", "collapsed"]
    got = {r.c1: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        w = brute.split_words(t)
        runs = brute.runs_of(w)
        assert ([tuple(x) for x in got[i].runs], got[i].collapsed, got[i].n_words, got[i].body, got[i].text) == (runs, brute.collapse(w, runs), len(w), t, f"t{i}")
    assert periodic_runs.periodic_runs(df.limit(0), text="body").count() == 0


def test_other_exponents(spark):
    texts = ["a b c a b c", "a a a a", "x a b a b a b a b y"]
    out = periodic_runs.periodic_runs(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), exponent=2, least_words=4).collect()
    assert {r.i: [tuple(x) for x in r.runs] for r in out} == {i: brute.runs_of(t.split(), 2, 4) for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(spark.createDataFrame([("a",)], "text string"), exponent=1)


def test_a_long_loop(spark):
    """A text of 40,000 words that is one loop of 9,000, found over ranges of lags."""
    w = [f"w{i}" for i in range(9000)]
    text = " ".join((w * 5)[:40_000])
    row = periodic_runs.periodic_runs(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert len(row) == 2 and all([tuple(x) for x in r.runs] == [(0, 40_000, 9000)] and r.collapsed == " ".join(w) for r in row)
