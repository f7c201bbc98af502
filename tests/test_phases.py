"""The stored index against counting every document, and phased retrieval's rules one by one."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from evidora.config import Config
from evidora.functions.text import RERANK
from evidora.operators.ranking import overlap_top
from evidora.plans.phases import attempt_phrase, search_phases
from evidora.sources import postings
from evidora.sources.postings import OverlapIndex, index_path


def corpus(n, seed=1):
    """Documents of a few topics, whose words have very different frequencies."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        topic = r.randrange(6)
        words = [f"common{int(r.paretovariate(0.8)) % 30:02d}" for _ in range(r.randint(0, 30))] + [f"topic{topic}word{r.randrange(40)}" for _ in range(r.randint(0, 25))]
        r.shuffle(words)
        rows.append((i, " ".join(words) if words else None))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(900), "doc_id long, text string").cache()


@pytest.fixture(scope="module")
def index(spark, docs):
    return OverlapIndex.build(docs, index_path(spark), block=8)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_index_equals_counting(spark, docs, index, monkeypatch, k):
    monkeypatch.setattr(postings, "PROBED", 2)
    asked = [(i, t) for i, t in corpus(60, seed=2)] + [(100, ""), (101, "nowhere"), (102, "common00 common01"), (103, "nowhere topic1word1 topic1word2 elsewhere")]
    questions = spark.createDataFrame(asked, "query_id int, text string")
    top, read = index.search(questions, k)
    want = sorted(tuple(r) for r in overlap_top(questions, docs, k).select("query_id", "doc_id", "shared", "score", "rank").collect())
    assert sorted(tuple(r) for r in top.select("query_id", "doc_id", "shared", "score", "rank").collect()) == want
    told = {r.query_id: r for r in read.collect()}
    assert 101 not in told and all(r.read <= r.postings and r.blocks_read <= r.blocks for r in told.values())
    if k == 5:  # most postings of a topic's question lie in blocks that are skipped
        assert sum(r.read for r in told.values()) < 0.8 * sum(r.postings for r in told.values())


def test_blocks_hold_like_documents(spark, index):
    sizes = [r.n for r in index.postings.select("n").collect()]
    assert max(sizes) <= 8 and index.postings.groupBy("token", "block").count().where("count > 1").count() == 0
    at = index.terms.where("token = 'common01'").first()
    assert at.n_docs > at.n_blocks


def test_empty_index_and_repeats(spark, docs):
    empty = OverlapIndex.build(docs.limit(0), index_path(spark))
    assert empty.top(docs.limit(3).withColumnRenamed("doc_id", "query_id"), 3).count() == 0
    one = OverlapIndex.build(spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, None), (4, "-")], "doc_id long, text string"), index_path(spark))
    got = one.top(spark.createDataFrame([("q", "alpha alpha BETA gamma")], "query_id string, text string"), 5).collect()
    assert [(r.doc_id, r.shared, r.score, r["rank"]) for r in got] == [(1, 2, round(2 / 3, 6), 1), (2, 2, round(2 / 3, 6), 2)]


def variant(query, name, phase, ordinal, phrase, *, strictness="relaxed", priority=50, key=None, court="ANY"):
    return (query, name, phase, ordinal, phrase, strictness, priority, key or name, court)


SCHEMA = "query_id int, variant_id string, phase string, ordinal int, phrase string, strictness string, priority int, canonical_key string, court string"
LIMITS = (("primary", 3), ("fallback", 2), ("rescue", 1), ("micro", 1), ("revolving", 1), ("browse", 1))


def verdicts(strict=0, provisional=0, details=5, flawed=False, covered=True, results=9):
    """A judge that says the same of every question."""
    values = {"strict": strict, "provisional": provisional, "details": details, "flawed": flawed, "covered": covered, "results": results}
    return lambda hits: hits.select("query_id").distinct().select("query_id", *[F.lit(v).alias(k) for k, v in values.items()])


def run(spark, index, rows, judge, cfg=replace(Config(), attempts=5, phase_limits=LIMITS), **more):
    kind = lambda hits: hits.withColumn("kind", F.when(F.col("doc_id") % 3 == 0, "statute").otherwise("case"))
    return search_phases(spark.createDataFrame(rows, SCHEMA), index, kind, judge, cfg, **more)


def ran(found):
    return [(r.query_id, r.variant_id, r.attempt_no) for r in found.attempts.orderBy("query_id", "attempt_no").collect()]


def outcome(found, query=1):
    return found.outcomes.where(F.col("query_id") == query).first()


def test_phases_follow_limits_and_budget(spark, index):
    rows = [variant(1, f"p{i}", "primary", i, f"topic1word{i} common01", priority=50 + i) for i in range(1, 6)]
    rows += [variant(1, f"f{i}", "fallback", i, f"topic2word{i} common01") for i in (1, 2)] + [variant(1, "r1", "rescue", 1, "topic3word1 common02")]
    found = run(spark, index, rows, verdicts())
    # ordinals 1..3 are kept, and run by priority; the fifth attempt is the last
    assert ran(found) == [(1, "p3", 1), (1, "p2", 2), (1, "p1", 3), (1, "f1", 4), (1, "f2", 5)]
    assert (outcome(found).stop_reason, outcome(found).stop_phase, outcome(found).status, found.searches) == ("budget_exhausted", "rescue", "partial", 2)
    found.release()


def test_enough_stops_and_later_phases_are_not_planned(spark, index):
    rows = []
    for q in (1, 2):
        rows += [variant(q, "a", "primary", 1, "topic1word1 common01", court="SC", strictness="strict"), variant(q, "b", "primary", 2, "topic1word2 common03", court="HC", strictness="strict"), variant(q, "c", "fallback", 1, "topic1word3"), variant(q, "d", "browse", 1, "topic1word4")]
    found = run(spark, index, rows, verdicts(strict=4))
    assert ran(found) == [(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "b", 2)] and found.searches == 1
    assert (outcome(found).stop_reason, outcome(found).stop_phase, outcome(found).status) == ("enough_candidates", "primary", "completed")
    # of two questions, only the open one goes on
    half = lambda hits: verdicts(strict=4)(hits.where("query_id = 1")).union(verdicts()(hits.where("query_id = 2")))
    found = run(spark, index, rows, half)
    assert [x[:2] for x in ran(found)] == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (2, "d")] and outcome(found, 2).stop_reason == "completed"


@pytest.mark.parametrize(
    "judge, court, stops",
    [
        (verdicts(strict=4), "HC", True),
        (verdicts(strict=4), "ANY", False),  # no attempt of the other court
        (verdicts(strict=3), "HC", False),
        (verdicts(strict=4, details=1), "HC", False),
        (verdicts(strict=4, covered=False), "HC", False),
        (verdicts(strict=2, provisional=2), "HC", True),
        (verdicts(strict=2, provisional=2, flawed=True), "HC", False),
    ],
)
def test_what_is_enough(spark, index, judge, court, stops):
    rows = [variant(1, "a", "primary", 1, "topic1word1 common01", court="SC"), variant(1, "b", "primary", 2, "topic1word2 common03", court=court), variant(1, "c", "fallback", 1, "topic1word3")]
    found = run(spark, index, rows, judge)
    assert (outcome(found).stop_reason == "enough_candidates") == stops and (len(ran(found)) == 2) == stops


def test_utility_reorders_later_phases(spark, index):
    """The key that found nothing goes behind the one that did, though its priority is higher; the budget then cuts it."""
    rows = [variant(1, "p1", "primary", 1, "nowhere atall", key="bad"), variant(1, "p2", "primary", 2, "topic1word1 common01", key="good")]
    rows += [variant(1, "f1", "fallback", 1, "topic1word5", key="bad", priority=60), variant(1, "f2", "fallback", 2, "topic1word6", key="good", priority=50)]
    found = run(spark, index, rows, verdicts(), replace(Config(), attempts=3, phase_limits=LIMITS))
    assert [x[1] for x in ran(found)] == ["p1", "p2", "f2"]
    got = {r.variant_id: r for r in found.attempts.collect()}
    assert got["p1"].utility == 0.14 and got["p1"].parsed == 0 and got["p2"].parsed == 14
    share = got["p2"].case_share
    assert got["p2"].utility == pytest.approx(14 / 16 * 0.4 + share * 0.45 - (1 - share) * 0.18)
    assert got["f2"].mean_utility == pytest.approx((got["p2"].utility + got["f2"].utility) / 2, abs=1e-4)


def test_repeats_and_empty_phrases_cost_nothing(spark, index):
    rows = [variant(1, "a", "primary", 1, "topic1word1 common01"), variant(1, "b", "primary", 2, "Topic1word1  COMMON01"), variant(1, "c", "fallback", 1, "supreme court judgment"), variant(1, "d", "rescue", 1, "topic1word1 common01")]
    found = run(spark, index, rows, verdicts())
    assert [x[1] for x in ran(found)] == ["a", "d"] and outcome(found).skipped == 1
    again = run(spark, index, rows + [variant(1, "e", "micro", 1, "topic2word2")], verdicts(), carry=found)
    assert [x[1:] for x in ran(again)] == [("a", 1), ("d", 2), ("e", 3)] and outcome(again).skipped == 3 and again.searches == 1
    assert again.candidates.count() >= found.candidates.count()


def test_guarantee_runs_what_has_not_run(spark, index):
    rows = [variant(1, f"p{i}", "primary", i, f"topic1word{i} common01", strictness="strict") for i in range(1, 6)]
    rows += [variant(1, "late", "primary", 6, "topic2word1", priority=10), variant(1, "later", "primary", 7, "topic2word2", priority=20), variant(1, "same", "primary", 8, "topic1word1 common01", priority=90)]
    few = run(spark, index, rows, verdicts(results=2), replace(Config(), attempts=3, phase_limits=LIMITS))
    assert [x[1] for x in ran(few)] == ["p1", "p2", "p3", "later"] and outcome(few).guaranteed and few.searches == 2
    enough = run(spark, index, rows, verdicts(results=3), replace(Config(), attempts=3, phase_limits=LIMITS))
    assert not outcome(enough).guaranteed and outcome(enough).attempts == 3


def test_candidates_know_what_found_them(spark, index):
    rows = [variant(1, "a", "primary", 1, "topic1word1 topic1word2 common01", strictness="strict", priority=90), variant(1, "b", "fallback", 1, "topic1word1 common01", priority=40)]
    found = run(spark, index, rows, verdicts())
    both = [r for r in found.candidates.collect() if len(r.variant_ids) == 2]
    assert both and all((r.variant_ids, r.phases, r.strict_hits, r.relaxed_hits, r.high_priority_hits) == (["a", "b"], ["fallback", "primary"], 1, 1, 1) for r in both)


def test_no_variants(spark, index):
    nothing = run(spark, index, [variant(1, "a", "primary", 1, " ")], verdicts())
    assert (outcome(nothing).status, outcome(nothing).attempts, nothing.searches) == ("no_match", 0, 0) and nothing.candidates.count() == 0


def test_attempt_phrases(spark):
    got = spark.createDataFrame([("delay Supreme Court judgment condoned",), ("bail",), ("High Court",), (None,)], "p string").select(attempt_phrase(F.col("p")).alias("p")).collect()
    assert [r.p for r in got] == ["delay condoned", "bail judgment", "", ""]


def test_tokens_can_be_given(spark, docs, index):
    questions = docs.where("doc_id < 5").select(F.col("doc_id").alias("query_id"), RERANK.distinct(F.col("text")).alias("tokens"))
    assert index.top(questions, 1).where("query_id = doc_id").count() >= 3


def test_kinds_are_told_once_for_all_phases(spark, monkeypatch):
    from evidora import phase_queries

    told = []
    real = phase_queries._kinds
    monkeypatch.setattr(phase_queries, "_kinds", lambda docs: told.append(1) or real(docs))
    phase_queries._phased(spark, "/root/testdata/sf0.001")
    assert told == [1]
