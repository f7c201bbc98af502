"""Phased retrieval with feedback: a batch of questions searched phase by phase, each with its planned variants (WIN-06, ORD-05, ORD-06, STM-01, QRY-22..26, FBK-06).

All open questions go through a phase together: their variants of that phase are one query set of the stored index.  What they found is appended to
the attempts and hits, the utility of their keys is brought up to date, and questions that have enough are closed.  Later phases are
planned for open questions only, so a closed one costs nothing more; when all are closed no further search is made.

Every step is a stored table in the shared folder; a lost executor costs the step it was in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config
from ..operators.candidates import provenance
from ..operators.metrics import attempt_utility, run_status
from ..sources.postings import OverlapIndex
from ..sources.scratch import Scratch
from ..streaming.state import adaptive_score

#: Results asked for at each attempt, and what is enough (fixed values).
PER_ATTEMPT, STRICT_ENOUGH, BEST_EFFORT, DETAILS_ENOUGH, LEAST_RESULTS = 14, 4, 4, 2, 3
#: Phases whose variants keep their court; the others look everywhere.
SCOPED = ("primary", "fallback")
GUARANTEE = "guarantee"


@dataclass
class Phased:
    """What a phased search did.  The tables stay until `release`.

    attempts: (query_id, variant_id, phase, phrase, strictness, priority, canonical_key, court, signature, attempt_no, parsed, case_share, statute_share, utility, mean_utility);
    hits: what `describe` made of (query_id, variant_id, doc_id, shared, score, rank, …) of every attempt; candidates: each (query_id, doc_id) once, with what retrieved it;
    outcomes: (query_id, stop_reason, stop_phase, attempts, skipped, n_results, guaranteed, status).
    """

    attempts: DataFrame
    hits: DataFrame
    candidates: DataFrame
    outcomes: DataFrame
    searches: int
    scratch: Scratch

    def release(self) -> None:
        self.scratch.release()


def attempt_phrase(phrase: Column) -> Column:
    """What is searched for: the phrase without names of courts, and a single word with `judgment`."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(phrase, F.lit("")), r"(?i)(^|[^a-zA-Z0-9_])(?:supreme court|high court|judgment)(?=[^a-zA-Z0-9_]|$)", "$1 "), r"\s+", " "))
    return F.when((bare != "") & ~F.contains(bare, F.lit(" ")), F.concat(bare, F.lit(" judgment"))).otherwise(bare)


def plan_phase(pool: DataFrame, limit: int, budget: int, attempts: DataFrame | None) -> DataFrame:
    """The pool's variants in the order in which they run, with runs, skipped and exhausted (ORD-05, ORD-06).

    The phase's limit cuts by ordinal first.  The rest is ordered by priority and the utility of its key so far; repeats of a signature are skipped and cost
    nothing, and what comes when a question has used up its budget doesn't run.
    """
    rows = pool.withColumn("_place", F.row_number().over(Window.partitionBy("query_id").orderBy("ordinal", "variant_id"))).where(F.col("_place") <= limit)
    rows = rows.withColumn("phrase", attempt_phrase(F.col("phrase"))).where("phrase <> ''")
    court = F.when(F.col("phase").isin(*SCOPED), F.nullif("court", F.lit("ANY")))
    rows = rows.withColumn("court", court).withColumn("signature", F.concat_ws("|", "phase", F.lower("phrase"), F.coalesce("court", F.lit(""))))
    if attempts is None:
        rows = rows.withColumns({"_used": F.lit(0).cast("long"), "_mean": F.lit(None).cast("double"), "_cases": F.lit(None).cast("double"), "_seen": F.lit(False)})
    else:
        used = attempts.groupBy("query_id").agg(F.max("attempt_no").alias("_used"))
        so_far = attempts.groupBy("query_id", "canonical_key").agg(F.round(F.avg("utility"), 4).alias("_mean"), F.round(F.avg("case_share"), 4).alias("_cases"))
        seen = attempts.select("query_id", "signature").distinct().withColumn("_seen", F.lit(True))
        rows = rows.join(used, "query_id", "left").join(so_far, ["query_id", "canonical_key"], "left").join(seen, ["query_id", "signature"], "left")
        rows = rows.withColumn("_used", F.coalesce("_used", F.lit(0))).withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    rows = rows.withColumn("_score", adaptive_score(F.col("priority"), F.col("_mean"), F.col("_cases"), F.lit(None).cast("double"), F.lit(None).cast("double")))
    order = [F.desc("_score"), F.desc("priority"), F.asc("ordinal"), F.asc("variant_id")]
    rows = rows.withColumn("_new", ~F.col("_seen") & (F.row_number().over(Window.partitionBy("query_id", "signature").orderBy(*order)) == 1))
    before = F.coalesce(F.sum(F.col("_new").cast("long")).over(Window.partitionBy("query_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("attempt_no", F.col("_used") + before + 1).withColumn("exhausted", F.col("attempt_no") > budget)
    return rows.withColumn("runs", F.col("_new") & ~F.col("exhausted")).withColumn("skipped", ~F.col("_new") & ~F.col("exhausted"))


def search_phases(
    variants: DataFrame,
    index: OverlapIndex,
    describe: Callable[[DataFrame], DataFrame],
    judge: Callable[[DataFrame], DataFrame],
    cfg: Config = Config(),
    *,
    per_attempt: int = PER_ATTEMPT,
    court_floor: bool = True,
    carry: Phased | None = None,
) -> Phased:
    """Run the variants of all questions, phase by phase.

    variants: (query_id, variant_id, phase, ordinal, phrase, strictness, priority, canonical_key, court), the court being SC, HC, ANY or null.
    `describe` gets hits and adds at least `kind` (and `court`, if attempts are to be held to theirs).  `judge` gets all hits of the open questions so far and returns
    (query_id, strict, provisional, details, flawed, covered, results): how many exact and provisional results there are, how many documents
    were looked into, whether a provisional one lacks a core element, whether the chain of elements is covered, and how many rows would be shown.

    A question is closed with `enough_candidates` when details, the courts' floor (an attempt of each court in the scoped phases) and either bound are met, and with
    `budget_exhausted` when variants are left but no attempts.  Then questions with too few results get their next relaxed variants that
    have not run, a few attempts beyond the budget, as a phase of its own.  `carry` continues an earlier search of the same questions: its attempts, hits
    and utilities count, and its signatures aren't searched again.

    Defined results: a question without variants has no outcome row; a variant without words is no attempt; ties fall to ordinal and variant_id;
    repeated variants are one by signature; no variants give empty tables.
    """
    spark = variants.sparkSession
    scratch = Scratch(spark, "phases")
    pool = scratch.store(variants.select("query_id", "variant_id", "phase", F.col("ordinal").cast("long").alias("ordinal"), "phrase", "strictness", F.col("priority").cast("long").alias("priority"), "canonical_key", "court"), "variants")
    attempts, hits = (carry.attempts, carry.hits) if carry else (None, None)
    stops: DataFrame | None = None
    skips: list[DataFrame] = []
    verdicts: DataFrame | None = None
    searches = 0

    def run(planned: DataFrame, name: str) -> None:
        """Search for what runs, and add its hits and attempts."""
        nonlocal attempts, hits, searches
        searches += 1
        wanted = planned.where("runs")
        found = index.top(wanted.select(F.struct("query_id", "variant_id").alias("query_id"), F.col("phrase").alias("text")), per_attempt, scratch=scratch)
        found = found.select("query_id.query_id", "query_id.variant_id", "doc_id", "shared", "score", "rank")
        found = found.join(wanted.select("query_id", "variant_id", "phase", "strictness", "priority", "canonical_key", F.col("court").alias("scope")), ["query_id", "variant_id"])
        told = describe(found)
        if "court" in told.columns:
            told = told.where("scope is null or scope = court")
        told = scratch.store(told, f"hits-{name}")
        share = lambda test: F.avg(test.cast("double"))
        got = told.groupBy("query_id", "variant_id").agg(F.count("*").alias("parsed"), share(F.col("kind").isin("case", "unknown")).alias("case_share"), share(F.col("kind") == "statute").alias("statute_share"))
        no = F.lit(False)
        made = wanted.join(got, ["query_id", "variant_id"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("parsed", "case_share", "statute_share")})
        made = made.withColumn("utility", attempt_utility(F.col("parsed"), F.col("parsed"), F.col("case_share"), F.col("statute_share"), no, no, no))
        made = made.select("query_id", "variant_id", "phase", "phrase", "strictness", "priority", "canonical_key", "court", "signature", "attempt_no", "parsed", "case_share", "statute_share", "utility")
        if attempts is not None:
            made = attempts.drop("mean_utility").unionByName(made)
        so_far = Window.partitionBy("query_id", "canonical_key").orderBy("attempt_no").rowsBetween(Window.unboundedPreceding, 0)
        attempts = scratch.store(made.withColumn("mean_utility", F.round(F.avg("utility").over(so_far), 4)), f"attempts-{name}")
        hits = told if hits is None else hits.unionByName(told)

    def opened(rows: DataFrame) -> DataFrame:
        return rows if stops is None else rows.join(stops, "query_id", "left_anti")

    def judged(name: str) -> DataFrame:
        """The verdict of every question, new for those open."""
        new = judge(opened(hits)).select("query_id", "strict", "provisional", "details", "flawed", "covered", "results")
        if verdicts is not None:
            new = new.unionByName(verdicts.join(new.select("query_id"), "query_id", "left_anti"))
        return scratch.store(new, f"verdicts-{name}")

    for phase, limit in cfg.phase_limits:
        planned = plan_phase(opened(pool.where(F.col("phase") == phase)), limit, cfg.attempts, attempts)
        planned = scratch.store(planned.drop("_place", "_used", "_mean", "_cases", "_seen", "_new", "_score"), f"plan-{phase}")
        state = planned.agg(F.count("*").alias("n"), F.count_if("runs").alias("runs")).first()
        if not state["n"]:
            continue
        skips.append(planned.where("skipped").select("query_id"))
        if state["runs"]:
            run(planned, phase)
            verdicts = judged(phase)
        spent = planned.groupBy("query_id").agg(F.bool_or("exhausted").alias("exhausted"))
        closing = spent
        if verdicts is not None:
            closing = closing.join(verdicts, "query_id", "left")
            floors = attempts.where(F.col("phase").isin(*SCOPED)).groupBy("query_id").agg((F.bool_or(F.coalesce(F.col("court") == "SC", F.lit(False))) & F.bool_or(F.coalesce(F.col("court") == "HC", F.lit(False)))).alias("floor"))
            closing = closing.join(floors, "query_id", "left")
            good = (F.col("strict") >= STRICT_ENOUGH) | ((F.col("strict") + F.col("provisional") >= BEST_EFFORT) & ~F.col("flawed"))
            ready = good & F.col("covered") & (F.col("details") >= DETAILS_ENOUGH) & (F.coalesce("floor", F.lit(False)) if court_floor else F.lit(True))
            reason = F.when(F.coalesce(ready, F.lit(False)), "enough_candidates").when(F.col("exhausted"), "budget_exhausted")
        else:
            reason = F.when(F.col("exhausted"), "budget_exhausted")
        new = closing.select("query_id", reason.alias("stop_reason"), F.lit(phase).alias("stop_phase")).where("stop_reason is not null")
        stops = scratch.store(new if stops is None else stops.unionByName(new), f"stops-{phase}")

    everyone = pool.select("query_id").distinct()
    few = None
    if attempts is not None and cfg.guarantee_extra_attempts:
        known = everyone.join(verdicts.select("query_id", "results"), "query_id", "left") if verdicts is not None else everyone.withColumn("results", F.lit(0))
        few = scratch.store(known.where(F.coalesce("results", F.lit(0)) < LEAST_RESULTS).select("query_id"), "few")
        # a phrase that ran already, in whatever phase, would find the same
        ran = attempts.select("query_id", F.lower("phrase").alias("_ran")).distinct()
        rest = pool.where("strictness = 'relaxed'").join(few, "query_id", "left_semi").withColumn("_ran", F.lower(attempt_phrase(F.col("phrase")))).join(ran, ["query_id", "_ran"], "left_anti").drop("_ran")
        by_priority = Window.partitionBy("query_id").orderBy(F.desc("priority"), "variant_id")
        rest = rest.withColumn("phase", F.lit(GUARANTEE)).withColumn("ordinal", F.row_number().over(by_priority).cast("long"))
        extra = plan_phase(rest, cfg.guarantee_extra_attempts * 3, 1 << 30, attempts)
        place = F.sum(F.col("runs").cast("long")).over(Window.partitionBy("query_id").orderBy("attempt_no", "ordinal"))
        extra = extra.withColumn("_nth", place).withColumn("runs", F.col("runs") & (F.col("_nth") <= cfg.guarantee_extra_attempts))
        extra = scratch.store(extra.where("runs").drop("_place", "_used", "_mean", "_cases", "_seen", "_new", "_score", "_nth"), f"plan-{GUARANTEE}")
        if not extra.isEmpty():
            run(extra, GUARANTEE)
            helped = judge(hits.join(extra.select("query_id").distinct(), "query_id", "left_semi")).select(*(verdicts.columns if verdicts is not None else ["query_id", "strict", "provisional", "details", "flawed", "covered", "results"]))
            verdicts = scratch.store(helped if verdicts is None else helped.unionByName(verdicts.join(helped.select("query_id"), "query_id", "left_anti")), "verdicts-last")

    if attempts is None:
        return _nothing(pool, scratch)
    out = everyone.join(attempts.groupBy("query_id").agg(F.max("attempt_no").alias("attempts"), F.bool_or(F.col("phase") == GUARANTEE).alias("guaranteed")), "query_id", "left")
    if stops is not None:
        out = out.join(stops, "query_id", "left")
    else:
        out = out.withColumns({"stop_reason": F.lit(None).cast("string"), "stop_phase": F.lit(None).cast("string")})
    skipped = skips[0]
    for s in skips[1:]:
        skipped = skipped.union(s)
    out = out.join(skipped.groupBy("query_id").agg(F.count("*").alias("skipped")), "query_id", "left")
    out = out.join(verdicts.select("query_id", F.col("results").alias("n_results")), "query_id", "left") if verdicts is not None else out.withColumn("n_results", F.lit(0).cast("long"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("attempts", "skipped", "n_results")}
    out = out.withColumns(zero | {"guaranteed": F.coalesce("guaranteed", F.lit(False)), "stop_reason": F.coalesce("stop_reason", F.lit("completed"))})
    out = scratch.store(out.withColumn("status", run_status(F.col("stop_reason"), F.col("n_results"))), "outcomes")
    merged = hits.join(attempts.select("query_id", "variant_id", "phase", F.col("mean_utility").alias("utility")), ["query_id", "variant_id", "phase"])
    merged = merged.withColumn("key", F.struct("query_id", "doc_id"))
    candidates = provenance(merged, url="key").select("key.query_id", "key.doc_id", "variant_ids", "canonical_keys", "phases", "best_utility", "strict_hits", "relaxed_hits", "high_priority_hits")
    best = merged.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    candidates = scratch.store(candidates.join(best, ["query_id", "doc_id"]), "candidates")
    return Phased(attempts, hits, candidates, out.select("query_id", "stop_reason", "stop_phase", "attempts", "skipped", "n_results", "guaranteed", "status"), searches, scratch)


def _nothing(pool: DataFrame, scratch: Scratch) -> Phased:
    """No attempt was made."""
    key = pool.schema["query_id"].dataType.simpleString()
    empty = lambda schema: pool.sparkSession.createDataFrame([], f"query_id {key}, {schema}")
    attempts = empty("variant_id string, phase string, phrase string, strictness string, priority long, canonical_key string, court string, signature string, attempt_no long, parsed long, case_share double, statute_share double, utility double, mean_utility double")
    hits = empty("variant_id string, doc_id long, shared long, score double, rank int, phase string, strictness string, priority long, canonical_key string, scope string, kind string")
    candidates = empty("doc_id long, variant_ids array<string>, canonical_keys array<string>, phases array<string>, best_utility double, strict_hits long, relaxed_hits long, high_priority_hits long, score double")
    outcomes = pool.select("query_id").distinct().selectExpr("query_id", "'completed' as stop_reason", "cast(null as string) as stop_phase", "0L as attempts", "0L as skipped", "0L as n_results", "false as guaranteed", "'no_match' as status")
    return Phased(attempts, hits, candidates, outcomes, 0, scratch)
