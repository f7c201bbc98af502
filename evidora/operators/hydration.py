"""Detail texts for candidates, and what is shown in the end (PAR-18, PAR-19, FLT-02, FLT-03, FLT-06, FLT-07, FLT-14, ORD-09, FBK-01, FBK-04, FBK-06, AGG-20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import squeeze
from .candidates import CASE_CUES, STATUTE_BODY, STATUTE_TITLE, VERSUS, any_cue, keep_or_all
from .ingest import non_judgment


def verify_pool(df: DataFrame, limit: int, *, group: str = "query_id", rank: str = "rank") -> DataFrame:
    """Add whether a candidate's detail is fetched: the first `limit` of each question (ORD-09)."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(rank))
    return df.withColumn("to_verify", place <= limit)


def hydrate(candidates: DataFrame, details: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Fill candidates from their detail records; those without one stay as they are (SRC-06, PAR-18, JOIN-02)."""
    fields = ["title", "court", "court_text", "author", "bench", "cites", "cited_by", "evidence_windows", "detail_text"]
    extra = details.select(key, *[F.col(f).alias(f"_d_{f}") for f in fields if f in details.columns])
    rows = candidates.join(extra, key, "left")
    out = []
    for c in candidates.columns:
        d = f"_d_{c}"
        if d not in rows.columns:
            out.append(F.col(c))
        elif c == "court":
            out.append(F.when(F.coalesce(F.col(d), F.lit("UNKNOWN")) != "UNKNOWN", F.col(d)).otherwise(F.col(c)).alias(c))
        elif c == "title":
            longer = F.length(F.coalesce(F.col(d), F.lit(""))) > F.length(F.coalesce(F.col(c), F.lit("")))
            out.append(F.when(longer, F.col(d)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.coalesce(F.col(d), F.col(c)).alias(c))
    out += [F.col(f"_d_{f}").alias(f) for f in fields if f"_d_{f}" in rows.columns and f not in candidates.columns]
    return rows.select(*out)


def usable_detail(text: Column, windows: Column, body: Column) -> Column:
    """A detail page that has content and is no search page (FLT-14)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return ~low.rlike("skip to main content|no matching results") & ((F.size(windows) > 0) | (F.size(body) > 0))


def semantic_candidate(hits: DataFrame) -> DataFrame:
    """Vector hits as candidates, with a snippet of at most 500 characters (PAR-19)."""
    text = squeeze(F.col("text"))
    return hits.withColumn("snippet", F.when(F.length(text) > 500, F.concat(F.left(text, F.lit(497)), F.lit("..."))).otherwise(text)).withColumn("semantic_hash", F.concat_ws(":", "doc_id", "id"))


def crawl_counts(df: DataFrame, *, group: str = "phrase") -> DataFrame:
    """How many crawled rows look like cases, statutes or neither (FLT-02, FLT-03)."""
    title, text = F.lower("title"), F.lower(F.concat_ws(" ", "title", "snippet"))
    statute = any_cue(title, STATUTE_TITLE) | any_cue(text, STATUTE_BODY)
    case = any_cue(text, CASE_CUES) | text.rlike(VERSUS)
    return df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(statute & ~case).alias("statutes"), F.count_if(case).alias("cases"), F.count_if(~statute & ~case).alias("noise"))


def judgment_focus(df: DataFrame, *, group: str = "query_id") -> DataFrame:
    """Rows of judgments only, or all of a question that has none (FLT-06)."""
    statute = non_judgment(F.col("docsource")) | any_cue(F.lower("title"), STATUTE_TITLE)
    return keep_or_all(df, ~statute, group=group)


def needs_fragment(snippet: Column, source: Column) -> Column:
    """A candidate whose snippet is too short to judge (FLT-07)."""
    return (F.length(F.coalesce(snippet, F.lit(""))) < 240) & ~non_judgment(source)


def hydration_report(df: DataFrame, *, most: int = 8) -> DataFrame:
    """Coverage of detail texts, errors of each code, and a few of them (AGG-20)."""
    total = df.agg(F.round(F.avg((F.col("detail_text").isNotNull()).cast("int")), 3).alias("coverage"))
    bad = df.where("error_code is not null")
    codes = bad.groupBy("error_code").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("doc_id")), 1, most).alias("samples"))
    # one row of totals, and the codes where there are any
    return total.join(codes, F.lit(True), "left").select("error_code", F.coalesce("n", F.lit(0)).alias("n"), "samples", "coverage")


def promoted(df: DataFrame, *, group: str = "query_id", fetched: str = "fetched", least: int = 20) -> DataFrame:
    """Add an exploratory row where much was fetched and no tier has a row: the best reject (FBK-01)."""
    w = Window.partitionBy(group)
    none = F.max((F.col("tier") != "reject").cast("int")).over(w) == 0
    best = F.row_number().over(w.orderBy(F.desc("score"), F.asc("doc_id"))) == 1
    return df.withColumn("promoted", none & best & (F.col(fetched) >= least))


def display_rows(df: DataFrame, *, group: str = "query_id", least: int = 3) -> DataFrame:
    """Exact rows, and near misses up to `least` rows in all, with the mode of the result (FBK-04)."""
    w = Window.partitionBy(group)
    exact = F.col("tier").isin("exact_strict", "exact_provisional")
    n = F.count_if(exact).over(w)
    near = F.row_number().over(Window.partitionBy(group, "tier").orderBy(F.desc("score"), F.asc("doc_id")))
    rows = df.withColumn("_n", n).withColumn("_near", near).where(exact | ((F.col("tier") == "near_miss") & (F.col("_near") <= least - F.col("_n"))))
    return rows.withColumn("result_mode", F.when(F.col("_n") >= least, "exact").when(F.col("_n") > 0, "mixed").otherwise("exploratory")).drop("_n", "_near")


def pass_two(summary: DataFrame) -> DataFrame:
    """Add whether a question gets a second pass: few exact results and time left (FBK-06)."""
    few = (F.col("n_exact") < 3) & (F.col("time_left_ms") > 2000)
    return summary.withColumn("second_pass", few & (F.col("reasoner_calls_left") > 0)).withColumn("guarantee", few)
