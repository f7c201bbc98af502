"""The vector index against a full scan: exact mode, recall, filters, hot cells and odd vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidora.operators.ranking import vector_top_k
from evidora.sources import vector_index
from evidora.sources.postings import index_path
from evidora.sources.vector_index import VectorIndex, fit_centroids


def clustered(n, seed=3, width=12, groups=10):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, width)) * 3
    # a third of all vectors is of one group
    of = np.where(r.random(n) < 1 / 3, 0, r.integers(0, groups, n))
    return centres[of] + r.normal(size=(n, width)) * 0.5


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(clustered(2000))], "id long, vector array<double>, label int").cache()


@pytest.fixture(scope="module")
def index(spark, rows):
    return VectorIndex.build(rows, index_path(spark), cells=12)


def as_tuples(df):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())


@pytest.mark.parametrize("k, probes, part, block", [(10, 1, 16_384, 256), (3, 4, 50, 7), (60, 2, 16_384, 256)])
def test_exact_mode_is_a_full_scan(spark, rows, index, monkeypatch, k, probes, part, block):
    monkeypatch.setattr(vector_index, "PART_ROWS", part)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", block)
    queries = rows.where("id % 40 = 0").select(F.col("id").alias("query_id"), "vector")
    assert as_tuples(index.search(queries, k, probes=probes, exact=True)) == as_tuples(vector_top_k(queries, rows, k))
    where = F.col("label") == 1
    assert as_tuples(index.search(queries, k, probes=probes, exact=True, where=where)) == as_tuples(vector_top_k(queries, rows, k, where=where))


def test_recall_with_few_cells(rows, index):
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    want = {t[:1] + t[2:3] for t in as_tuples(vector_top_k(queries, rows, 10))}
    got = {t[:1] + t[2:3] for t in as_tuples(index.search(queries, 10, probes=3))}
    assert len(got & want) / len(want) >= 0.9


def test_pruned_scan(index, rows):
    queries = rows.where("id = 7").select(F.col("id").alias("query_id"), "vector")
    picked = index._picked(queries.select("query_id", F.col("vector").alias("v")), 2)
    assert picked.count() == 2 and index.vectors.count() == 2000 and int(index.n.sum()) == 2000
    plan = index._scored(picked, 5, None)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, None, "y"), (3, [2.0], "z"), (4, [0.5, 0.5, 9.0], "w"), (5, [1.0, 0.0], "x")], "id long, vector array<double>, cellar string")
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0, 1.0])], "query_id string, vector array<double>")
    index = VectorIndex.build(rows, index_path(spark), cells=3)
    assert as_tuples(index.search(queries, 3, probes=1, exact=True)) == as_tuples(vector_top_k(queries, rows, 3))
    empty = VectorIndex.build(rows.limit(0), index_path(spark), cells=3)
    assert empty.search(queries, 3, exact=True).count() == 0 and index.search(queries.limit(0), 3, exact=True).count() == 0


def test_centroids():
    assert len(fit_centroids(np.ones((50, 4)), 8)) == 1
    near = fit_centroids(clustered(400, groups=4), 4)
    assert len(near) == 4 and np.linalg.norm(near[:, None] - near[None], axis=2)[np.triu_indices(4, 1)].min() > 1


def test_products_in_parts(spark, rows, monkeypatch):
    from evidora.operators import ranking

    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    want = as_tuples(vector_top_k(queries, rows, 7))
    for n in (1, 60, 5000):
        monkeypatch.setattr(ranking, "PRODUCTS", n)
        assert as_tuples(vector_top_k(queries, rows.repartition(3), 7)) == want


def test_probes_reach_the_recall_on_vectors_without_structure(spark):
    flat = np.random.default_rng(5).normal(size=(3000, 24))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(flat)], "id long, vector array<double>").cache()
    index = VectorIndex.build(rows, index_path(spark), cells=32)
    ask = lambda rest: rows.where(f"id % 100 = {rest}").select(F.col("id").alias("query_id"), "vector")
    probes = index.probes_for(ask(50), 10, 0.94)
    wanted = {(q, i) for q, _, i, _ in as_tuples(index.search(ask(0), 10, exact=True))}
    got = lambda n: len(wanted & {(q, i) for q, _, i, _ in as_tuples(index.search(ask(0), 10, probes=n))}) / len(wanted)
    assert got(4) < 0.9 <= got(probes)
    assert index.probes_for(ask(0).where("false"), 10, 0.94) == 32
