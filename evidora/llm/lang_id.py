"""Language of web pages by Bayesian evidence fusion.

Evidence: the likelihood of the visible text under byte-trigram models, the
language that the markup declares, the suffix of the address, and the host.
The text models are fitted from a bounded sample of labelled documents
(`sample` a language).  All else is counted over all pages by grouped
aggregation: pages whose text alone is clear vote for what declarations mean and
for the languages of suffixes and hosts; a host's prior is smoothed towards its
suffix's and that towards all pages', and a page's own vote is taken out of it.

Defined results: a null or empty page has no text evidence; a very long one is
read whole, by itself; a page without a
declaration, or one that no clear page has, gets no evidence from it; a null
address has an empty host and suffix; repeated rows count as often as they come;
on equal posteriors the first language by name wins; without any labelled
document the result has null languages; the result has its own columns only, so
there are no clashing names; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .bytetext import LOWER, blocks, text_bytes
from .tables import map_batches, settle
from .url_filter import host_of

SAMPLE = 400
BUCKETS = 1 << 15
PARTS = 32
MOST_SENT = 100_000
CLEAR = 0.99
TEMPER = 0.1  # neighbouring trigrams overlap and are far from independent
MOST_NATS = 30.0
STRENGTH = 5.0

_UNSEEN = re.compile(r"(?is)<!--.*?-->|<(script|style|nav|footer|noscript)\b.*?</\1\s*>|<[^>]*>|&[#\w]+;")


def visible(html: str | None) -> str:
    return _UNSEEN.sub(" ", html or "")


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of every byte trigram, A-Z lower-cased."""
    low = LOWER[data].astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.uint32)
    code = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(17)


def fit_text_models(df: DataFrame, *, lang: str = "lang", text: str = "text", row_id: str = "doc_id", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities of the buckets) from at most `sample` labelled documents a language.

    Buckets are counted by grouped aggregation; the driver gets at most BUCKETS rows for each language.
    """
    rows = df.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{row_id}`").alias("id"), F.col(f"`{text}`").alias("text")).where("lang is not null")
    # the first of each language by hash, in parts of it first, so that no task gets all of a common language
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("id"), "id"))
    picked = rows.select("lang", "id").distinct().withColumn("part", F.pmod(F.xxhash64("id", F.lit(PARTS)), F.lit(PARTS)))
    picked = picked.withColumn("k", place("lang", "part")).where(F.col("k") <= sample)
    picked = settle(picked.withColumn("k", place("lang")).where(F.col("k") <= sample).select("lang", "id"))
    # `sample` rows for each language; not sent to the tasks if there are very many languages
    picked = F.broadcast(picked) if picked.count() <= MOST_SENT else picked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            langs = batch.column(0).to_pylist()
            for a, b in blocks(offsets):
                for name in sorted(set(langs[a:b])):
                    counts = np.zeros(BUCKETS, np.int64)
                    for i in range(a, b):
                        if langs[i] == name:
                            counts += np.bincount(trigrams(data[offsets[i] : offsets[i + 1]]), minlength=BUCKETS)
                    some = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * (len(some) + 1)), pa.array(np.append(some, -1)), pa.array(np.append(counts[some], 0))], names=["lang", "bucket", "n"])

    counted = map_batches(rows.join(picked, ["lang", "id"]).select("lang", "text"), run, "lang string, bucket long, n long")
    counts = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts["lang"].to_pylist()))
    total = np.zeros((len(names), BUCKETS + 1))
    total[[names.index(x) for x in counts["lang"].to_pylist()], counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    total = total[:, :BUCKETS]  # the last one only tells that there is the language
    return names, np.log((total + 0.5) / (total.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))


def text_evidence(df: DataFrame, names: list[str], models: np.ndarray, *, html: str = "html", out: str = "text_nats") -> DataFrame:
    """Add the log-likelihood of each language, against the best one, as an array."""
    columns, position = [c for c in df.columns if c != html], df.columns.index(html)
    shared = df.sparkSession.sparkContext.broadcast(models.astype(np.float32))  # BUCKETS numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            _, sizes = text_bytes(batch.column(position))
            nats = []
            for a, b in blocks(sizes, 8 << 20):
                for page in batch.column(position).slice(a, b - a).to_pylist():
                    grams = trigrams(np.frombuffer(visible(page).encode(), np.uint8))
                    score = models @ np.bincount(grams, minlength=BUCKETS).astype(np.float32) * TEMPER if len(grams) else np.zeros(len(names), np.float32)
                    nats.append(np.round(np.maximum(score - score.max(initial=-np.inf), -MOST_NATS), 3).tolist() if len(names) else [])
            kept = [batch.column(k) for k in range(batch.num_columns) if k != position]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(nats, pa.list_(pa.float64()))], names=[*columns, out])

    fields = [f for f in df.schema.fields if f.name != html]
    return map_batches(df, run, T.StructType([*fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def declared_of(html: Column) -> Column:
    """The language that the markup declares, without its region; empty if none."""
    return F.lower(F.coalesce(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})", 1), F.lit("")))


def suffix_of(host: Column) -> Column:
    return F.lower(F.regexp_extract(host, r"([A-Za-z]+)(?::\d+)?$", 1))


def _share(part: Column, whole: Column, towards: Column) -> Column:
    return (part + STRENGTH * towards) / (whole + STRENGTH)


def identify(pages: DataFrame, documents: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", sample: int = SAMPLE) -> DataFrame:
    """(page_id, language, probability, declared, text_language, host) for each page."""
    names, models = fit_text_models(documents, sample=sample)
    host = host_of(F.col(f"`{url}`"))
    base = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), suffix_of(host).alias("suffix"), declared_of(F.col(f"`{html}`")).alias("declared"), F.col(f"`{html}`").alias("html"))
    if not names:
        null = F.lit(None).cast("string")
        return base.select("page_id", null.alias("language"), F.lit(None).cast("double").alias("probability"), "declared", null.alias("text_language"), "host")
    n = len(names)
    seen = text_evidence(base, names, models)
    total = F.aggregate("text_nats", F.lit(0.0), lambda s, x: s + F.exp(x))
    best = F.array_position("text_nats", F.lit(0.0)).cast("int")
    seen = seen.withColumn("clear", F.when((1 / total >= CLEAR), best)).withColumn("text_best", F.when(F.array_min("text_nats") < 0, best))
    seen = settle(seen)
    votes = [F.count(F.when(F.col("clear") == k + 1, 1)).alias(f"v{k}") for k in range(n)]
    array = lambda make: F.array(*[make(k) for k in range(n)])
    everywhere = seen.agg(*votes).first()
    all_votes = sum(everywhere)
    top = [(v + 1) / (all_votes + n) for v in everywhere]
    suffixes = seen.groupBy("suffix").agg(*votes).select("suffix", array(lambda k: F.col(f"v{k}")).alias("suffix_votes"))
    hosts = seen.groupBy("host", "suffix").agg(*votes).select("host", "suffix", array(lambda k: F.col(f"v{k}")).alias("host_votes"))
    # a table, so that the pages of a hot host can be split in the join
    hosts = settle(hosts.join(suffixes, "suffix").select("host", "host_votes", "suffix_votes"))
    said = seen.where("clear is not null and declared <> ''").groupBy("declared").agg(*votes).select("declared", array(lambda k: F.log((F.col(f"v{k}") + 0.1) / (F.lit(float(everywhere[k])) + 1.0))).alias("said"))
    out = seen.join(hosts, "host", "left").join(said, "declared", "left")

    def posterior(k: int) -> Column:
        own = F.coalesce((F.col("clear") == k + 1).cast("int"), F.lit(0))
        any_own = F.col("clear").isNotNull().cast("int")
        size = lambda votes: F.aggregate(votes, F.lit(0).cast("long"), lambda s, x: s + x)
        by_suffix = _share(F.get("suffix_votes", F.lit(k)) - own, size("suffix_votes") - any_own, F.lit(top[k]))
        by_host = _share(F.get("host_votes", F.lit(k)) - own, size("host_votes") - any_own, by_suffix)
        return F.get("text_nats", F.lit(k)) + F.log(by_host) + F.coalesce(F.get("said", F.lit(k)), F.lit(0.0))

    out = out.withColumn("nats", array(posterior)).withColumn("most", F.array_max("nats"))
    sure = 1 / F.aggregate("nats", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("most")))
    labels = F.array(*[F.lit(x) for x in names])
    return out.select("page_id", F.get(labels, F.array_position("nats", F.col("most")).cast("int") - 1).alias("language"), F.round(sure, 4).alias("probability"), "declared", F.get(labels, F.col("text_best") - 1).alias("text_language"), "host")
