"""The shared request rate and the read-through cache."""

from __future__ import annotations

import glob
import time

import pytest
from pyspark.sql import functions as F

from evidora.sources import pages as pages_source
from evidora.sources.pages import Slots
from evidora.sources.postings import index_path
from evidora.sources.request_cache import RequestCache, request_digest


def test_lanes_share_the_slots():
    """Whatever moments the lanes ask at, no slot is used twice and each lane keeps to its own."""
    used = {}
    for lane in range(4):
        slots, now = Slots(10.0, lane, 4), 1000.0 + 0.037 * lane
        for _ in range(20):
            number, start = slots.next_start(now)
            assert number % 4 == lane and start > now and used.setdefault(number, lane) == lane
            slots.last, now = number, start + 0.011 * lane
    assert len(used) == 80
    slots = Slots(10.0, 1, 4)
    slots.last = 10_005
    assert slots.next_start(1000.0)[0] == 10_009  # a used slot isn't used again


def test_four_tasks_keep_the_rate_together(spark, tmp_path):
    folder = str(tmp_path)

    def fetch(phrase, page):
        with open(f"{folder}/{phrase}-{page}", "w") as f:
            f.write(repr(time.time()))
        return 200, "<p>x</p>"

    pages_source.register(spark, fetch, "rated_pages")
    rows = spark.read.format("rated_pages").option("phrases", "|".join(f"p{k}" for k in range(8))).option("maxPages", "3").option("requestsPerSecond", "12").option("readers", "4").load()
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 24
    times = sorted(float(open(p).read()) for p in glob.glob(f"{folder}/p*"))
    gaps = [b - a for a, b in zip(times, times[1:])]
    assert len(times) == 24 and min(gaps) > 0.5 / 12 and times[-1] - times[0] > 22 / 12


def test_time_is_over(spark):
    pages_source.register(spark, lambda phrase, page: (200, "<p>x</p>"), "late_pages")
    rows = spark.read.format("late_pages").option("phrases", "a|b").option("requestsPerSecond", "0.2").option("readers", "1").option("budgetMs", "10").load().collect()
    assert len(rows) <= 1  # the next slot comes after the time of the phrase


@pytest.mark.parametrize("text, want", [("2020-03-01", "1-3-2020"), ("1/12/1999", "1-12-1999"), ("31-2-2020", None), ("March", None), (None, None), (" 05-06-2001 ", "5-6-2001")])
def test_dates_of_a_search(text, want):
    assert pages_source.api_date(text) == want


def test_search_parameters_reach_the_fetcher(spark):
    def fetch(phrase, page, parameters=None):
        return 200, f"{phrase}: {sorted((parameters or {}).items())}"

    pages_source.register(spark, fetch, "asked_pages")
    read = spark.read.format("asked_pages").option("phrases", "p").option("maxPages", "1")
    assert read.load().first().html == "p: []"
    full = read.options(court="sc", fromDate="2019-01-02", toDate="never", title=" State ", author="", bench="b", cite="AIR 1", maxCites="900", pagesAtOnce="x")
    assert full.load().first().html == "p: [('bench', 'b'), ('cite', 'AIR 1'), ('doctypes', 'supremecourt'), ('fromdate', '2-1-2019'), ('maxcites', '50'), ('title', 'State')]"
    assert pages_source.search_parameters({"court": "HC", "doctypes": "judgments"}) == {"doctypes": "judgments"}


def keys(*names):
    return F.array(*[request_digest(F.col(n)) for n in names])


@pytest.fixture
def cache(spark):
    return RequestCache(spark, index_path(spark, "cache"), ok_seconds=3600, failed_seconds=600)


def source(asked_for, answers):
    """A fetch that notes which requests it gets."""

    def fetch(asked):
        ids = [r.request_id for r in asked.select("request_id").collect()]
        asked_for.append(sorted(ids))
        return asked.sparkSession.createDataFrame([(i, *answers[i]) for i in ids if i in answers], "request_id long, value string, error_code string")

    return fetch


def rows(df):
    return sorted((r.request_id, r.value, r.error_code, r.cached) for r in df.collect())


def test_second_run_fetches_nothing(spark, cache):
    requests = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "a")], "request_id long, url string").withColumn("keys", keys("url"))
    answers, asked = {1: ("A", None), 2: (None, "http_403"), 3: ("", None)}, []
    first = rows(cache.read_through(requests, source(asked, answers), F.lit("2024-01-01 00:00:00")))
    assert first == [(1, "A", None, False), (2, None, "http_403", False), (3, None, "parse_empty", False), (4, "A", None, False)] and asked == [[1, 2, 3]]
    again = rows(cache.read_through(requests, source(asked, answers), F.lit("2024-01-01 00:05:00")))
    assert [r[:3] for r in again] == [r[:3] for r in first] and all(r[3] for r in again) and asked[1] == []
    rows(cache.read_through(requests, source(asked, answers), F.lit("2024-01-01 00:11:00")))
    assert asked[2] == [2, 3]  # failures live shorter
    rows(cache.read_through(requests, source(asked, answers), F.lit("2024-01-01 01:00:01")))
    assert asked[3] == [1, 2, 3]
    rows(cache.read_through(requests, source(asked, answers), F.lit("2023-12-31 00:00:00")))
    assert asked[4] == [1, 2, 3]  # entries of the future don't count


def test_only_some_failures_are_remembered(spark, cache):
    codes = ["http_403", "http_429", "parse_empty", "timeout", "network", "unknown", "http_500"]
    requests = spark.createDataFrame(list(enumerate(codes)), "request_id long, url string").withColumn("keys", keys("url"))
    answers, asked = {i: (None, c) for i, c in enumerate(codes)}, []
    cache.read_through(requests, source(asked, answers), F.lit("2024-01-01 00:00:00")).collect()
    cache.read_through(requests, source(asked, answers), F.lit("2024-01-01 00:01:00")).collect()
    assert asked[1] == [3, 4, 5, 6]


def test_any_key_answers_and_values_win(spark, cache):
    make = lambda *r: spark.createDataFrame(list(r), "request_id long, url string, doc string").withColumn("keys", keys("url", "doc"))
    asked = []
    cache.read_through(make((1, "u1", "d1")), source(asked, {1: (None, "http_429")}), F.lit("2024-01-01 00:00:00")).collect()
    # the same document by another address: its failure is known
    assert rows(cache.read_through(make((2, "u2", "d1")), source(asked, {}), F.lit("2024-01-01 00:01:00"))) == [(2, None, "http_429", True)]
    cache.read_through(make((3, "u3", "d3")), source(asked, {3: ("V", None)}), F.lit("2024-01-01 00:02:00")).collect()
    # a later failure under another address of the document doesn't hide the value that is alive
    assert rows(cache.read_through(make((4, "u4", "d3")), source(asked, {}), F.lit("2024-01-01 00:03:00"))) == [(4, "V", None, True)]
    both = make((5, "u1", "d3"))
    assert rows(cache.read_through(both, source(asked, {}), F.lit("2024-01-01 00:04:00"))) == [(5, "V", None, True)]
    # after the failure's time a value takes its place
    assert rows(cache.read_through(make((6, "u1", "d1")), source(asked, {6: ("W", None)}), F.lit("2024-01-01 00:20:00"))) == [(6, "W", None, False)]
    assert rows(cache.read_through(make((7, "u1", None)), source(asked, {}), F.lit("2024-01-01 00:21:00"))) == [(7, "W", None, True)]


def test_odd_requests(spark, cache):
    odd = spark.createDataFrame([(1, []), (2, None), (3, ["k"])], "request_id long, keys array<string>")
    asked = []
    assert rows(cache.read_through(odd, source(asked, {1: ("A", None), 3: ("C", None)}), F.lit("2024-01-01 00:00:00"))) == [(1, "A", None, False), (2, None, None, False), (3, "C", None, False)]
    cache.read_through(odd, source(asked, {}), F.lit("2024-01-01 00:01:00")).collect()
    assert asked == [[1, 2, 3], [1, 2]]
    assert cache.read_through(odd.limit(0), source(asked, {}), F.lit("2024-01-01 00:01:00")).count() == 0


def test_digests_tell_parts_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "c"), ("", "c"), ("c", None)], "a string, b string")
    assert df.select(request_digest(F.col("a"), F.col("b")).alias("d")).distinct().count() == 5
