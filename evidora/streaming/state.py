"""State over time: rate limits, cooldowns, breakers, rings, utilities (STM-01..11, SRC-13..15, SRC-18).

Each has a batch form over an event table, and where a live stream needs it a
streaming form of the same meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seconds(ts: Column) -> Column:
    """A point in time as seconds, with or without a time zone."""
    return ts.cast("timestamp").cast("double")


def rate_limit(events: DataFrame, *, key: str, ts: str = "ts", order: str = "event_id", window: str = "60 seconds", limit: int = 40) -> DataFrame:
    """Add the window's start, the place in it and whether the request is over the limit (STM-04, SRC-15)."""
    start = F.window(F.col(ts), window)["start"]
    w = Window.partitionBy(key, "window_start").orderBy(ts, order)
    return events.withColumn("window_start", start).withColumn("place", F.row_number().over(w)).withColumn("rejected", F.col("place") > limit)


def window_counts(events: DataFrame, *, key: str, ts: str = "ts", window: str = "60 seconds", limit: int = 40, late: str | None = None) -> DataFrame:
    """Requests for each key and window, and how many are over the limit; for streams with a watermark `late`."""
    rows = events.withWatermark(ts, late) if late else events
    n = F.count("*")
    counts = rows.groupBy(key, F.window(F.col(ts), window).alias("w")).agg(n.alias("n"))
    return counts.select(key, F.col("w.start").alias("window_start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("over"))


def blocked_runs(events: DataFrame, *, key: str, blocked: Column, ts: str = "ts", order: str = "event_id", threshold: int = 3) -> DataFrame:
    """Add the number of blocked attempts since the last success, and whether that stops the run (STM-03, STM-06)."""
    w = Window.partitionBy(key).orderBy(ts, order)
    rows = events.withColumn("_blocked", blocked).withColumn("island", F.sum((~F.col("_blocked")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(key, "island").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("blocked_count", F.sum(F.col("_blocked").cast("int")).over(inner))
    return rows.withColumn("stopped", F.col("blocked_count") >= threshold).drop("_blocked")


def circuit_breaker(events: DataFrame, *, key: str, failed: Column, ts: str = "ts", order: str = "event_id", failures: int = 2, open_seconds: int = 30) -> DataFrame:
    """Add whether the breaker is open at each event: opened by the latest run of failures before it (STM-06)."""
    rows = blocked_runs(events, key=key, blocked=failed, ts=ts, order=order, threshold=failures).withColumnRenamed("blocked_count", "failures").drop("stopped", "island")
    before = Window.partitionBy(key).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1)
    opened = F.max(F.when(F.col("failures") >= failures, F.col(ts))).over(before)
    reset = F.max(F.when(F.col("failures") == 0, F.col(ts))).over(before)
    is_open = opened.isNotNull() & (reset.isNull() | (opened > reset)) & (seconds(F.col(ts)) < seconds(opened) + open_seconds)
    return rows.withColumn("open", F.coalesce(is_open, F.lit(False)))


def cooldowns(events: DataFrame, *, key: str, wait: Column, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Add until when a key has to wait, as set by the events before, and how long that still is (STM-05)."""
    before = Window.partitionBy(key).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1)
    until = F.max(F.col("_until")).over(before)
    rows = events.withColumn("_until", F.when(wait > 0, seconds(F.col(ts)) + wait))
    return rows.withColumn("wait_until", until).withColumn("remaining", F.round(F.greatest(F.coalesce(F.col("wait_until") - seconds(F.col(ts)), F.lit(0.0)), F.lit(0.0)), 3)).drop("_until")


def first_requests(events: DataFrame, signature: Column, *, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(signature, first_event, n, skipped): repeated requests are run once (STM-08, STM-09)."""
    g = events.groupBy(signature.alias("signature")).agg(F.min_by(order, F.struct(ts, order)).alias("first_event"), F.count("*").alias("n"))
    return g.withColumn("skipped", F.col("n") - 1)


def unseen_requests(stream: DataFrame, signature: Column, *, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A stream's requests without repeats of a signature within the watermark, whose state is dropped behind it (STM-08)."""
    return stream.withColumn("signature", signature).withWatermark(ts, late).dropDuplicatesWithinWatermark(["signature"])


def recency_ring(events: DataFrame, *, owner: str, item: str, ts: str = "ts", order: str = "event_id", size: int = 20) -> DataFrame:
    """The latest `size` items of each owner, each at its last use (STM-10, SRC-18)."""
    last = events.groupBy(owner, item).agg(F.max(F.struct(ts, order)).alias("last"))
    w = Window.partitionBy(owner).orderBy(F.desc("last"))
    return last.withColumn("place", F.row_number().over(w)).where(F.col("place") <= size).select(owner, item, F.col(f"last.{ts}").alias(ts), "place")


def spent_budget(attempts: DataFrame, *, group: str, cost: Column, order: list[str], most_attempts: int, most_cost: float) -> DataFrame:
    """Add running totals and whether an attempt is still within the budgets (STM-11, ORD-06)."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = attempts.withColumn("attempt_no", F.count("*").over(w)).withColumn("spent", F.round(F.sum(cost).over(w), 4))
    reason = F.when(F.col("attempt_no") > most_attempts, "budget_exhausted").when(F.col("spent") > most_cost, "timeout")
    return rows.withColumn("stop_reason", reason).withColumn("runs", reason.isNull())


def phase_budget(variants: DataFrame, limits: dict[str, int], most: int, *, group: str = "query_id", order: str = "ordinal", score: Column | None = None, key: str = "variant_id") -> DataFrame:
    """The variants that run, in order (ORD-05, ORD-06).

    A phase's limit cuts by input order first; those left are sorted by score in their phase, and phases follow one another up to `most` (D6).
    """
    phases = list(limits)
    ix = F.array_position(F.array(*[F.lit(p) for p in phases]), F.col("phase"))
    limit = F.element_at(F.create_map(*[x for p, n in limits.items() for x in (F.lit(p), F.lit(n))]), F.col("phase"))
    rows = variants.where(F.col("phase").isin(phases)).withColumn("_place", F.row_number().over(Window.partitionBy(group, "phase").orderBy(order, key))).where(F.col("_place") <= limit)
    rows = rows.withColumn("_score", score if score is not None else F.col("priority").cast("double"))
    w = Window.partitionBy(group).orderBy(ix, F.desc("_score"), F.desc("priority"), order, key)
    return rows.withColumn("run_ix", F.row_number().over(w)).where(F.col("run_ix") <= most).drop("_place", "_score")


def adaptive_score(priority: Column, utility: Column, case_rate: Column, challenge_rate: Column, timeout_rate: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.coalesce(priority, F.lit(0)) + zero(utility) * 40 + zero(case_rate) * 18 - zero(challenge_rate) * 14 - zero(timeout_rate) * 8


def sessions(events: DataFrame, *, key: str, ts: str = "ts", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Events for each session, as an extension: sessions end after a gap."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(key, F.session_window(F.col(ts), gap).alias("s")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n", "total")


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what there is into a memory table, and read that: for results small enough for the driver."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what there is; each micro-batch's changed rows are written as Parquet under `path`, and the latest of each key is read back.

    The stream runs in update mode and has its key as its first column, so nothing is held by the driver.
    """
    key = stream.columns[0]

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch-{number:09d}")

    query = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{path}/batch-*")
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "_batch")]), "_batch").alias("_row"))
    return latest.select(key, "_row.*")


def utility_stream(events: DataFrame, *, key: str, value: str) -> DataFrame:
    """Attempts and mean of each key, for streams in complete or update mode (STM-02)."""
    return events.groupBy(key).agg(F.count("*").alias("attempts"), F.round(F.avg(value), 4).alias("mean_value"))


def carry_state(events: DataFrame, *, key: str, value: str, signature: str) -> DataFrame:
    """The scheduler's carried state as a stream in update mode (STM-01): (carry, n, total), `carry` being the key and one of its signatures.

    Every (key, signature) has a state of its own in the state store, so a key may have any number of signatures and none is ever forgotten; `carried` puts a key's together.
    """
    carry = F.struct(F.col(key).alias(key), F.col(signature).cast("string").alias("signature"))
    return events.groupBy(carry.alias("carry")).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("total"))


def carried(rows: DataFrame, *, key: str) -> DataFrame:
    """(key, attempts, mean_value, skipped, signatures) from the latest row of each (key, signature): a repeat of a signature is skipped."""
    n = F.sum("n")
    out = rows.select("carry.*", "n", "total").groupBy(key).agg(n.alias("attempts"), F.round(F.sum("total") / n, 4).alias("mean_value"), (n - F.count("*")).alias("skipped"), F.count("*").alias("signatures"))
    return out


def repeats_alive(events: DataFrame, *, key: list[str], ts: str, order: str, ttl_seconds: int) -> DataFrame:
    """Add `repeat`: the same key was seen at most so many seconds before; each sighting renews it (STM-07, SRC-13)."""
    last = F.lag(seconds(F.col(ts))).over(Window.partitionBy(*key).orderBy(ts, order))
    return events.withColumn("repeat", F.coalesce(seconds(F.col(ts)) - last <= ttl_seconds, F.lit(False)))
