"""A read-through cache of requests: only what isn't known is fetched, failures too are remembered for a while (SRC-09, STM-07, PAR-18)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .stores import VectorStore

#: Failures that are remembered: asking again soon would fail again (fixed values).
REMEMBERED = ("http_403", "http_429", "parse_empty")
OK_SECONDS, FAILED_SECONDS = 6 * 3600, 900


def request_digest(*parts: Column) -> Column:
    """A digest of a request's parts; nulls and the order of the parts count."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)])), 256)


class RequestCache:
    """Entries by digest in a log of batches: (id, value, error_code, fetched_at), the value null for a failure.

    A request may have several keys (its address, the address in canonical form, the document's number): an entry under any of them answers it, and what
    is fetched is stored under all.  An entry is alive for `ok_seconds`, a failure for `failed_seconds`.  Failures other than `REMEMBERED` are never
    stored, and none is while a value is alive; a value takes the place of a failure.
    """

    def __init__(self, spark: SparkSession, path: str, *, ok_seconds: int = OK_SECONDS, failed_seconds: int = FAILED_SECONDS) -> None:
        self.spark, self.ok_seconds, self.failed_seconds = spark, ok_seconds, failed_seconds
        self.store = VectorStore(spark, path)

    def _alive(self, now: Column) -> DataFrame:
        entries = self.store.read()
        if entries is None:
            return self.spark.createDataFrame([], "id string, value string, error_code string, fetched_at timestamp")
        age = now.cast("timestamp").cast("double") - F.col("fetched_at").cast("double")
        return entries.where((age >= 0) & (age <= F.when(F.col("value").isNotNull(), self.ok_seconds).otherwise(self.failed_seconds)))

    def read_through(self, requests: DataFrame, fetch: Callable[[DataFrame], DataFrame], now: Column, *, scratch: Scratch | None = None) -> DataFrame:
        """(request_id, value, error_code, cached) of every request.

        requests: (request_id, keys, …), the keys being digests, the main one first; request_id is unique.  `fetch` gets one request for each main key that no live entry
        answers, and returns (request_id, value, error_code).  Requests with equal main keys are fetched once and all get the answer.

        Defined results: a request without keys is fetched for itself and not stored; a fetch that returns nothing for a request gives nulls; an empty value is
        the failure parse_empty.  Entries of the future are not read.
        """
        scratch = scratch or Scratch(self.spark, "requests")
        keyed = requests.select("request_id", F.posexplode_outer("keys").alias("place", "id"))
        # a value under any key goes before a failure, then the latest
        hits = keyed.join(self._alive(now), "id").groupBy("request_id").agg(F.max_by(F.struct("value", "error_code"), F.struct(F.col("value").isNotNull().alias("has"), "fetched_at", -F.col("place"))).alias("hit"))
        hits = scratch.store(hits, "hits")
        misses = requests.join(hits, "request_id", "left_anti").withColumn("main", F.coalesce(F.get("keys", F.lit(0)), F.concat(F.lit("request:"), F.col("request_id").cast("string"))))
        first = misses.groupBy("main").agg(F.min("request_id").alias("request_id"))
        asked = misses.join(first.select("request_id"), "request_id", "left_semi").drop("main")
        got = fetch(asked).select("request_id", F.nullif("value", F.lit("")).alias("value"), F.when((F.col("value") == "") & F.col("error_code").isNull(), "parse_empty").otherwise(F.col("error_code")).alias("error_code"))
        got = scratch.store(got, "fetched")
        answers = first.join(got, "request_id", "left").select("main", "value", "error_code")
        fetched = scratch.store(misses.select("request_id", "main", "keys").join(answers, "main", "left"), "answers")
        self._remember(fetched, now)
        return hits.select("request_id", "hit.value", "hit.error_code", F.lit(True).alias("cached")).union(fetched.select("request_id", "value", "error_code", F.lit(False)))

    def _remember(self, fetched: DataFrame, now: Column) -> None:
        worth = fetched.where(F.col("value").isNotNull() | F.col("error_code").isin(*REMEMBERED))
        rows = worth.select(F.explode(F.array_distinct("keys")).alias("id"), "value", F.when(F.col("value").isNull(), F.col("error_code")).alias("error_code"))
        # of several answers for a key, a value goes before a failure
        rows = rows.groupBy("id").agg(F.max_by(F.struct("value", "error_code"), F.struct(F.col("value").isNotNull().alias("has"), "value", "error_code")).alias("r")).select("id", "r.*")
        known = self._alive(now).where("value is not null").select("id")
        rows = rows.join(known.withColumn("_known", F.lit(True)), "id", "left").where("value is not null or _known is null").drop("_known")
        rows = rows.withColumn("fetched_at", now.cast("timestamp"))
        if not rows.isEmpty():
            self.store.upsert(rows)
