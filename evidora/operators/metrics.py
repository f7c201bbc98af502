"""Attempt, run and evaluation metrics (AGG-05..23, WIN-06, FBK-05)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.text import clamp

RATES = ("utility", "case_rate", "statute_rate", "challenge_rate", "timeout_rate")


def attempt_utility(parsed: Column, cases: Column, case_share: Column, statute_share: Column, challenged: Column, limited: Column, timed_out: Column) -> Column:
    """How useful an attempt was, in 0..1 (AGG-06)."""
    blocked = challenged | limited
    empty = F.when(blocked, 0.02).when(timed_out, 0.08).otherwise(0.14)
    full = F.least(parsed, F.lit(16)) / 16 * 0.4 + case_share * 0.45 - statute_share * 0.18 - F.when(blocked, 0.22).otherwise(0.0) - F.when(timed_out, 0.1).otherwise(0.0)
    return F.when((parsed <= 0) | (cases <= 0), empty).otherwise(clamp(full))


def variant_utility(attempts: DataFrame, key: str = "canonical_key", order: str = "ts", rates: tuple[str, ...] = RATES) -> DataFrame:
    """Attempts, mean rates and the last status of each key (AGG-05, STM-02).

    Means are exact and rounded once; rounding at each step, as a running mean would, differs by 1e-4 at most for each attempt.
    """
    return attempts.groupBy(key).agg(F.count("*").alias("attempts"), *[F.round(F.avg(r), 4).alias(f"mean_{r}") for r in rates], F.max_by("status", F.struct(order, "attempt_id")).alias("last_status"))


def stepwise_utility(attempts: DataFrame, key: str = "canonical_key", order: str = "ts", rate: str = "utility") -> DataFrame:
    """The running mean rounded to four places at each attempt, in order; halves go up, as doubles have them.

    Each mean depends on the rounded one before it, so a key's attempts have to be read in order.  They come sorted within a partition and are folded as they
    pass: a task holds a batch and one mean, however many attempts a key has.
    """
    rows = attempts.select(F.col(key).alias("key"), F.col(rate).cast("double").alias("x"), F.col(order).alias("o"), "attempt_id").repartition("key").sortWithinPartitions("key", "o", "attempt_id")
    kind = rows.schema["key"]
    arrow = to_arrow_type(kind.dataType)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, mean, begun = None, 0, 0.0, False

        def told(keys: list, ns: list[int], means: list[float]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.array(ns, pa.int32()), pa.array(means, pa.float64())], names=["key", "attempts", "mean"])

        for batch in batches:
            out: tuple[list, list[int], list[float]] = ([], [], [])
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not begun or k != now:
                    if begun:
                        for values, value in zip(out, (now, n, mean)):
                            values.append(value)
                    now, n, mean, begun = k, 0, 0.0, True
                mean = None if mean is None or x is None else math.floor((mean * n + x) / (n + 1) * 1e4 + 0.5) / 1e4
                n += 1
            yield told(*out)
        if begun:
            yield told([now], [n], [mean])

    made = rows.select("key", "x").mapInArrow(fold, T.StructType([kind, T.StructField("attempts", T.IntegerType()), T.StructField("mean", T.DoubleType())]))
    return made.select(F.col("key").alias(key), "attempts", "mean")


def attempt_metrics(attempts: DataFrame, group: list[str]) -> DataFrame:
    """Conditional counts and ratios of attempts (AGG-07..09)."""
    return attempts.groupBy(*group).agg(
        F.count("*").alias("attempts"),
        F.count_if(F.col("status") == "challenge").alias("challenged"),
        F.count_if(F.col("status") == "limited").alias("limited"),
        F.count_if(F.col("status") == "ok").alias("succeeded"),
        F.round(F.max("elapsed"), 4).alias("max_elapsed"),
        F.round(F.avg("elapsed"), 4).alias("avg_elapsed"),
        F.round(F.try_divide(F.count_if(F.col("status") == "ok"), F.count("*")), 4).alias("success_rate"),
    )


def insights(cases: DataFrame, *, group: str = "query_id", fetched: str | None = None) -> DataFrame:
    """Result quality of each query (AGG-10, AGG-12); the dominant court goes SC, HC, UNKNOWN on ties."""
    n = {c: F.count_if(F.col("court") == c) for c in ("SC", "HC", "UNKNOWN")}
    dominant = F.when((n["SC"] >= n["HC"]) & (n["SC"] >= n["UNKNOWN"]), "SC").when((n["HC"] >= n["SC"]) & (n["HC"] >= n["UNKNOWN"]), "HC").otherwise("UNKNOWN")
    out = cases.groupBy(group).agg(
        F.count("*").alias("n_cases"),
        F.round(F.avg("score"), 3).alias("avg_score"),
        F.round(F.avg(F.col("detail_checked").cast("int")), 3).alias("verification_coverage"),
        n["SC"].alias("sc_count"),
        n["HC"].alias("hc_count"),
        dominant.alias("dominant_court"),
        F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("top_doc"),
        F.max("score").alias("top_score"),
        *([F.max(fetched).alias("_fetched")] if fetched else []),
    )
    if fetched:
        out = out.withColumn("efficiency", F.round(F.coalesce(F.try_divide("n_cases", "_fetched"), F.lit(0.0)), 3)).drop("_fetched")
    summary = F.format_string("%d case candidates were ranked with %s court dominance. Top result %s has %s%% confidence.", "n_cases", "dominant_court", F.col("top_doc").cast("string"), F.round(F.col("top_score") * 100).cast("int").cast("string"))
    return out.withColumn("summary", summary)


def session_summary(runs: DataFrame) -> DataFrame:
    """Totals over a session's runs; zeros without any (AGG-13, AGG-14)."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return runs.agg(
        F.count("*").alias("total_runs"),
        F.round(zero(F.avg((F.col("cases") > 0).cast("int"))), 4).alias("success_rate"),
        F.round(zero(F.avg("cases")), 4).alias("avg_cases"),
        F.round(zero(F.avg("avg_score")), 4).alias("avg_score"),
        F.count_if("blocked").alias("blocked_runs"),
    )


def retention(fixtures: DataFrame, phrases: DataFrame, *, hook_gate: float = 95.0) -> DataFrame:
    """Share of expected hooks that some phrase of their query keeps (AGG-15): fixtures (query_id, hooks), phrases (query_id, phrase)."""
    hooks = fixtures.select("query_id", F.explode("hooks").alias("hook"))
    kept = hooks.join(phrases, "query_id", "left").groupBy("query_id", "hook").agg(F.bool_or(F.coalesce(F.contains(F.lower("phrase"), F.lower("hook")), F.lit(False))).alias("kept"))
    rate = F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.count_if("kept"), F.count("*")), F.lit(0.0)), 3)
    return kept.agg(F.count("*").alias("hooks"), F.count_if("kept").alias("kept"), rate.alias("retention"), (rate >= hook_gate).alias("passed"))


def coverage_gates(runs: DataFrame, base_coverage: float | None = None, base_no_match: float | None = None) -> DataFrame:
    """coverage@50, no-match rate and their changes against a baseline (AGG-16): runs (query_id, expected, found, phrases, strict)."""
    coverage = F.round(F.avg(F.coalesce(F.try_divide("found", "expected"), F.lit(0.0))), 4)
    no_match = F.round(F.avg(((F.col("strict") == 0) | (F.col("phrases") < 5)).cast("int")), 4)
    out = runs.agg(F.count("*").alias("queries"), coverage.alias("coverage_at_50"), no_match.alias("no_match_rate"))
    if base_coverage:
        out = out.withColumn("coverage_gain", F.round((F.col("coverage_at_50") - base_coverage) / base_coverage, 4)).withColumn("coverage_passed", F.col("coverage_gain") >= 0.30)
    if base_no_match:
        out = out.withColumn("no_match_drop", F.round((F.lit(base_no_match) - F.col("no_match_rate")) / base_no_match, 4)).withColumn("no_match_passed", F.col("no_match_drop") >= 0.35)
    return out


def early_stop(phases: DataFrame, *, group: str = "query_id", order: str = "phase_ix", strict_needed: int = 4, details_needed: int = 2) -> DataFrame:
    """The first phase after which a query has enough, from running totals over its phases (WIN-06)."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = phases.withColumns({c: F.sum(c).over(w) for c in ("strict", "provisional", "details")})
    ready = ((F.col("strict") >= strict_needed) | (F.col("strict") + F.col("provisional") >= strict_needed)) & (F.col("details") >= details_needed)
    return rows.groupBy(group).agg(F.min(F.when(ready, F.col(order))).alias("stop_phase"), F.max(order).alias("last_phase"))


def run_status(stop_reason: Column, n_results: Column) -> Column:
    """completed, partial, blocked or no_match (FBK-05)."""
    return F.when(stop_reason == "blocked", "blocked").when(n_results <= 0, "no_match").when(stop_reason.isin("budget_exhausted", "timeout"), "partial").otherwise("completed")


def lane_stats(rows: DataFrame, *, group: str = "query_id") -> DataFrame:
    """What strict variants retrieved, what of it was accepted and rejected, and what is related (AGG-21): rows with strict_hits, tier and shown."""
    retrieved, accepted = F.count_if(F.col("strict_hits") > 0), F.count_if(F.col("tier").isin("exact_strict", "exact_provisional"))
    return rows.groupBy(group).agg(
        F.greatest(retrieved, accepted).alias("strict_retrieved"),
        accepted.alias("strict_accepted"),
        F.greatest(F.lit(0), retrieved - accepted).alias("strict_rejected"),
        F.count_if(F.col("shown").isin("near_miss", "unverified", "related")).alias("related_accepted"),
    )


def running_counts(rows: DataFrame, value: str, *, group: str = "query_id", order: str = "rank") -> DataFrame:
    """Add `running`, how often a row's value has come so far in its group (AGG-22)."""
    w = Window.partitionBy(group, value).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.count("*").over(w))
