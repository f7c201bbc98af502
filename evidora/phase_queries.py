"""Registered queries of the stored index and of phased retrieval, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions.text import RERANK
from .operators import candidates as C
from .plans.phases import Phased, search_phases
from .queries import CASE_LIKE, CLASSIFIED, OVERLAP, STATUTE, TOKENS, _benchmark, _court
from .registry import query, table
from .sources.postings import OverlapIndex, index_path
from .sources.request_cache import RequestCache, request_digest
from .sources.scratch import Scratch
from .sources.vector_index import VectorIndex
from .streaming import state as T


def overlap_index(spark: SparkSession, sf_dir: str) -> OverlapIndex:
    """An index of all documents' tokens, in the shared folder."""
    return OverlapIndex.build(table(spark, sf_dir, "documents").select("doc_id", "text"), index_path(spark, "overlap-index"))


@query(f"WITH {OVERLAP} SELECT query_id, doc_id, shared, score, rank FROM ranked WHERE rank <= 10")
def index_overlap_topk(spark, sf_dir):
    """SRC-01, WIN-01, ORD-04: the ten documents that share most of each passage's tokens, by the stored index."""
    return overlap_index(spark, sf_dir).top(_benchmark(spark, sf_dir), 10)


@query(f"""
WITH {OVERLAP}, df AS (SELECT token, count(*) AS n FROM d GROUP BY token)
SELECT query_id, CAST(sum(n) AS BIGINT) AS postings, true AS within FROM q JOIN df USING (token) GROUP BY query_id
""")
def index_reads(spark, sf_dir):
    """SRC-01: the postings of each passage's tokens, and that no more than these were read to find its ten best."""
    told = overlap_index(spark, sf_dir).search(_benchmark(spark, sf_dir), 10)[1]
    return told.select("query_id", "postings", (F.col("read") <= F.col("postings")).alias("within"))


VECTORS_SQL = """
WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_dot_product(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings{where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
"""


def vector_index(spark: SparkSession, sf_dir: str) -> tuple[VectorIndex, DataFrame]:
    """An index of all vectors in the shared folder, and the queries: every hundredth vector."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return VectorIndex.build(rows, index_path(spark, "vector-index"), cells=32), rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")


@query(VECTORS_SQL.format(where="") + "SELECT query_id, id, score, rank FROM r WHERE rank <= 10")
def index_vector_topk(spark, sf_dir):
    """SRC-12, ORD-03: the ten nearest vectors by the cells of the stored index, in its exact mode."""
    index, queries = vector_index(spark, sf_dir)
    return index.search(queries, 10, probes=4, exact=True)


@query(VECTORS_SQL.format(where=" WHERE label = 1") + "SELECT query_id, id, score, rank FROM r WHERE rank <= 10")
def index_vector_filtered(spark, sf_dir):
    """FLT-08, SRC-12: the same with a filter on the payload."""
    index, queries = vector_index(spark, sf_dir)
    return index.search(queries, 10, probes=4, exact=True, where=F.col("label") == 1)


@query(VECTORS_SQL.format(where="") + "SELECT count(*) AS wanted, true AS reached FROM r WHERE rank <= 10")
def index_vector_recall(spark, sf_dir):
    """SRC-12: whether the index without its exact mode finds nine tenths of the ten nearest vectors, of all queries together.

    How many cells that takes depends on the vectors, so it is measured on other rows than those asked for.
    """
    index, queries = vector_index(spark, sf_dir)
    probes = index.probes_for(index.vectors.where("id % 100 = 50").select(F.col("id").alias("query_id"), "vector"), 10, RECALL_AIM)
    wanted = index.search(queries, 10, exact=True).select("query_id", "id")
    found = index.search(queries, 10, probes=probes).select("query_id", "id", F.lit(1).alias("found"))
    return wanted.join(found, ["query_id", "id"], "left").agg(F.count("*").alias("wanted"), (F.count("found") >= 0.9 * F.count("*")).alias("reached"))


#: The recall that other rows have to show, for one of nine tenths of the rows asked for.
RECALL_AIM = 0.94


#: Variants of a passage: (phase, ordinal, strictness, priority, first token, tokens, court, key).  Later ones of a key follow what its earlier ones found.
SLICES = [
    ("primary", 1, "strict", 95, 1, 5, "SC", "head"),
    ("primary", 2, "strict", 90, 6, 5, "HC", "middle"),
    ("primary", 3, "strict", 85, 11, 5, "ANY", "tail"),
    ("primary", 4, "strict", 80, 16, 5, "ANY", "late"),
    ("fallback", 1, "relaxed", 60, 1, 3, "ANY", "head"),
    ("fallback", 2, "relaxed", 58, 16, 8, "ANY", "late"),
    ("fallback", 3, "relaxed", 56, 24, 8, "ANY", "last"),
    ("rescue", 1, "relaxed", 50, 6, 2, "SC", "middle"),
    ("rescue", 2, "relaxed", 44, 11, 2, "HC", "tail"),
    ("micro", 1, "relaxed", 40, 32, 3, "ANY", "last"),
    ("browse", 1, "relaxed", 30, 1, 40, "ANY", "whole"),
]
PHASED = replace(Config(), attempts=6, guarantee_extra_attempts=1, phase_limits=(("primary", 3), ("fallback", 2), ("rescue", 2), ("micro", 1), ("revolving", 1), ("browse", 1)))
GOOD, COVERED = 0.65, 0.8


def sliced_variants(questions: DataFrame) -> DataFrame:
    """The variants of SLICES for each (query_id, text)."""
    k = F.col("k")
    made = [F.struct(F.lit(p).alias("phase"), F.lit(o).alias("ordinal"), F.array_join(F.slice(k, first, n), " ").alias("phrase"), F.lit(s).alias("strictness"), F.lit(pr).alias("priority"), F.lit(key).alias("canonical_key"), F.lit(c).alias("court"), F.lit(f"{p}_{o}").alias("variant_id")) for p, o, s, pr, first, n, c, key in SLICES]
    return questions.select("query_id", RERANK.distinct(F.col("text")).alias("k")).select("query_id", F.inline(F.array(*made)))


def _kinds(docs: DataFrame) -> DataFrame:
    """(doc_id, court, n_chars, kind) by the decision list, with cues of this corpus."""
    docs = docs.withColumn("court", _court())
    made = C.classify(F.left("text", F.lit(60)), F.col("text"), F.col("court"), statute_title=["|".join(STATUTE)], statute_body=["|".join(STATUTE)], case=["|".join(CASE_LIKE)])
    return docs.select("doc_id", "court", "n_chars", made["kind"].alias("kind"))


def judge_hits(hits: DataFrame) -> DataFrame:
    """How much of what was found is good: by kind, by the share of a variant's tokens, and by the text's length."""
    good = F.col("score") >= GOOD
    once = hits.groupBy("query_id", "doc_id").agg(
        F.bool_or(good & (F.col("kind") == "case") & (F.col("strictness") == "strict")).alias("strict"),
        F.bool_or(good & F.col("kind").isin("case", "unknown")).alias("provisional"),
        F.bool_or(good & (F.col("n_chars") >= 200)).alias("detail"),
        F.bool_or(good).alias("good"),
        F.max("score").alias("best"),
    )
    n = lambda c: F.count_if(c)
    return once.groupBy("query_id").agg(
        n(F.col("strict")).alias("strict"),
        n(F.col("provisional") & ~F.col("strict")).alias("provisional"),
        n(F.col("detail")).alias("details"),
        F.lit(False).alias("flawed"),
        (F.max("best") >= COVERED).alias("covered"),
        n(F.col("good")).alias("results"),
    )


def _phased(spark: SparkSession, sf_dir: str) -> Phased:
    # every phase asks for kinds, so the texts are judged once and what is told of them is stored
    told = Scratch(spark, "kinds")
    kinds = told.store(_kinds(table(spark, sf_dir, "documents")), "kinds")
    found = search_phases(sliced_variants(_benchmark(spark, sf_dir)), overlap_index(spark, sf_dir), lambda hits: hits.join(kinds, "doc_id"), judge_hits, PHASED)
    found.scratch.also(told)
    return found


def _phase_sql() -> str:
    """The same by SQL: all variants are searched, and then each phase keeps those that would have run."""
    values = ", ".join(f"('{p}', {o}, '{s}', {pr}, {first}, {n}, '{c}', '{key}', '{p}_{o}')" for p, o, s, pr, first, n, c, key in SLICES)
    score = "priority + 40 * coalesce(mean, 0) + 18 * coalesce(cases, 0)"
    parts = [
        CLASSIFIED.strip(),
        f"slices(phase, ordinal, strictness, priority, first, n, court, key, variant_id) AS (VALUES {values})",
        # in the order of their first places, which list_distinct doesn't keep
        "kr AS (SELECT item_id AS query_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 3) AS r FROM benchmark)",
        "kk AS (SELECT query_id, list_filter(r, lambda t, i: list_position(r, t) = i) AS k FROM kr)",
        "v0 AS (SELECT query_id, s.*, k[first:first + n - 1] AS s FROM kk, slices s)",
        "v AS MATERIALIZED (SELECT query_id, phase, ordinal, strictness, priority, key, variant_id, CASE WHEN phase IN ('primary', 'fallback') AND court <> 'ANY' THEN court END AS scope, CASE WHEN len(s) = 1 THEN list_append(s, 'judgment') ELSE s END AS toks FROM v0)",
        f"dt AS MATERIALIZED (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents)",
        "vt AS (SELECT query_id, variant_id, len(toks) AS size, unnest(toks) AS token FROM v)",
        "hs AS (SELECT query_id, variant_id, doc_id, round(count(*) / any_value(size), 6) AS score FROM vt JOIN dt USING (token) GROUP BY ALL)",
        "h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant_id ORDER BY score DESC, doc_id) AS rank FROM hs) WHERE rank <= 14)",
        "hk AS MATERIALIZED (SELECT h.query_id, h.variant_id, h.doc_id, score, kind, k.court, n_chars, scope, strictness, priority, key FROM h JOIN v USING (query_id, variant_id) JOIN k USING (doc_id) JOIN documents USING (doc_id))",
        "hu AS MATERIALIZED (SELECT query_id, variant_id, count(*) AS parsed, avg(CASE WHEN kind IN ('case', 'unknown') THEN 1.0 ELSE 0.0 END) AS case_share, avg(CASE WHEN kind = 'statute' THEN 1.0 ELSE 0.0 END) AS statute_share FROM hk WHERE scope IS NULL OR scope = court GROUP BY ALL)",
        # a guarantee attempt of a scoped variant isn't held to its court
        "hf AS MATERIALIZED (SELECT query_id, variant_id, count(*) AS parsed, avg(CASE WHEN kind IN ('case', 'unknown') THEN 1.0 ELSE 0.0 END) AS case_share, avg(CASE WHEN kind = 'statute' THEN 1.0 ELSE 0.0 END) AS statute_share FROM hk GROUP BY ALL)",
    ]
    utility = "CASE WHEN coalesce(parsed, 0) <= 0 THEN 0.14 ELSE greatest(0.0, least(1.0, least(parsed, 16) / 16 * 0.4 + case_share * 0.45 - statute_share * 0.18)) END"
    fields = f"variant_id, phase, attempt_no, key, strictness, priority, scope, coalesce(parsed, 0) AS parsed, coalesce(case_share, 0) AS case_share, {utility} AS utility"
    verdict = """SELECT query_id, count(*) FILTER (strict) AS strict, count(*) FILTER (provisional AND NOT strict) AS provisional, count(*) FILTER (detail) AS details, max(best) >= {covered} AS covered, count(*) FILTER (good) AS results FROM (
  SELECT query_id, doc_id, bool_or(score >= {good} AND kind = 'case' AND a.strictness = 'strict') AS strict, bool_or(score >= {good} AND kind IN ('case', 'unknown')) AS provisional, bool_or(score >= {good} AND n_chars >= 200) AS detail, bool_or(score >= {good}) AS good, max(score) AS best
  FROM hk JOIN {att} a USING (query_id, variant_id) WHERE a.scope IS NULL OR a.scope = hk.court GROUP BY ALL) GROUP BY query_id"""
    att, stop = None, None
    for i, (phase, limit) in enumerate(PHASED.phase_limits):
        unstopped = f"AND query_id NOT IN (SELECT query_id FROM {stop})" if stop else ""
        used = f"LEFT JOIN (SELECT query_id, max(attempt_no) AS used FROM {att} GROUP BY query_id) USING (query_id) LEFT JOIN (SELECT query_id, key, round(avg(utility), 4) AS mean, round(avg(case_share), 4) AS cases FROM {att} GROUP BY ALL) USING (query_id, key)" if att else ", (SELECT 0 AS used, NULL AS mean, NULL AS cases)"
        parts.append(f"pool{i} AS MATERIALIZED (SELECT *, coalesce(used, 0) + row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, priority DESC, ordinal, variant_id) AS attempt_no FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ordinal, variant_id) AS place FROM v WHERE phase = '{phase}' {unstopped}) {used} WHERE place <= {limit} AND len(toks) > 0)")
        before = f"SELECT * FROM {att} UNION ALL " if att else ""
        parts.append(f"att{i} AS MATERIALIZED ({before}SELECT query_id, {fields} FROM pool{i} LEFT JOIN hu USING (query_id, variant_id) WHERE attempt_no <= {PHASED.attempts})")
        att = f"att{i}"
        parts.append(f"ver{i} AS MATERIALIZED ({verdict.format(good=GOOD, covered=COVERED, att=att)})")
        parts.append(f"floor{i} AS (SELECT query_id, bool_or(scope = 'SC') AND bool_or(scope = 'HC') AS floor FROM {att} WHERE phase IN ('primary', 'fallback') GROUP BY query_id)")
        ready = "coalesce((strict >= 4 OR strict + provisional >= 4) AND covered AND details >= 2 AND coalesce(floor, false), false)"
        was = f"SELECT * FROM {stop} UNION ALL " if stop else ""
        parts.append(f"stop{i} AS MATERIALIZED ({was}SELECT query_id, stop_reason, '{phase}' AS stop_phase FROM (SELECT query_id, CASE WHEN {ready} THEN 'enough_candidates' WHEN exhausted THEN 'budget_exhausted' END AS stop_reason FROM (SELECT query_id, bool_or(attempt_no > {PHASED.attempts}) AS exhausted FROM pool{i} GROUP BY query_id) LEFT JOIN ver{i} USING (query_id) LEFT JOIN floor{i} USING (query_id)) WHERE stop_reason IS NOT NULL)")
        stop = f"stop{i}"
    last = len(PHASED.phase_limits) - 1
    parts += [
        f"few AS (SELECT item_id AS query_id FROM benchmark LEFT JOIN ver{last} ON query_id = item_id WHERE coalesce(results, 0) < 3 AND item_id IN (SELECT query_id FROM v))",
        f"rest AS (SELECT query_id, phase AS was, strictness, priority, key, variant_id, toks, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, variant_id) AS ordinal FROM v SEMI JOIN few USING (query_id) WHERE strictness = 'relaxed' AND NOT EXISTS (SELECT 1 FROM {att} a JOIN v w USING (query_id, variant_id) WHERE a.query_id = v.query_id AND w.toks = v.toks))",
        f"extra AS (SELECT *, coalesce(used, 0) + row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, priority DESC, ordinal, variant_id) AS attempt_no, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, priority DESC, ordinal, variant_id) AS nth FROM rest LEFT JOIN (SELECT query_id, max(attempt_no) AS used FROM {att} GROUP BY query_id) USING (query_id) LEFT JOIN (SELECT query_id, key, round(avg(utility), 4) AS mean, round(avg(case_share), 4) AS cases FROM {att} GROUP BY ALL) USING (query_id, key) WHERE ordinal <= {3 * PHASED.guarantee_extra_attempts} AND len(toks) > 0)",
        f"att AS MATERIALIZED (SELECT * FROM {att} UNION ALL SELECT query_id, variant_id, 'guarantee' AS phase, attempt_no, key, strictness, priority, NULL AS scope, coalesce(parsed, 0) AS parsed, coalesce(case_share, 0) AS case_share, {utility} AS utility FROM extra LEFT JOIN hf USING (query_id, variant_id) WHERE nth <= {PHASED.guarantee_extra_attempts})",
        "atm AS MATERIALIZED (SELECT *, round(avg(utility) OVER (PARTITION BY query_id, key ORDER BY attempt_no), 4) AS mean_utility FROM att)",
        f"ver AS ({verdict.format(good=GOOD, covered=COVERED, att='att')})",
    ]
    return "WITH " + ",\n".join(parts)


PHASE_SQL = _phase_sql()
_LAST_STOP = f"stop{len(PHASED.phase_limits) - 1}"


@query(PHASE_SQL + " SELECT query_id, variant_id, phase, attempt_no, parsed, round(case_share, 6) AS case_share, round(utility, 6) AS utility, mean_utility FROM atm")
def phased_attempts(spark, sf_dir):
    """ORD-05, ORD-06, STM-01, AGG-05, AGG-06: what each passage's variants found, phase by phase, until it had enough."""
    return _phased(spark, sf_dir).attempts.select("query_id", "variant_id", "phase", "attempt_no", "parsed", F.round("case_share", 6).alias("case_share"), F.round("utility", 6).alias("utility"), "mean_utility")


@query(
    PHASE_SQL
    + f""" SELECT query_id, coalesce(stop_reason, 'completed') AS stop_reason, stop_phase, attempts, coalesce(results, 0) AS n_results, guaranteed,
  CASE WHEN coalesce(results, 0) <= 0 THEN 'no_match' WHEN stop_reason = 'budget_exhausted' THEN 'partial' ELSE 'completed' END AS status
FROM (SELECT query_id, max(attempt_no) AS attempts, bool_or(phase = 'guarantee') AS guaranteed FROM att GROUP BY query_id) LEFT JOIN {_LAST_STOP} USING (query_id) LEFT JOIN ver USING (query_id)"""
)
def phased_outcomes(spark, sf_dir):
    """WIN-06, FBK-05, FBK-06: when and why the search of each passage stopped."""
    return _phased(spark, sf_dir).outcomes.select("query_id", "stop_reason", "stop_phase", "attempts", "n_results", "guaranteed", "status")


@query(
    PHASE_SQL
    + """ SELECT query_id, doc_id, array_to_string(list_sort(list_distinct(list(variant_id))), ',') AS variants, array_to_string(list_sort(list_distinct(list(phase))), ',') AS phases, max(mean_utility) AS best_utility,
  count(*) FILTER (a.strictness = 'strict') AS strict_hits, count(*) FILTER (a.strictness = 'relaxed') AS relaxed_hits, count(*) FILTER (a.priority >= 80) AS high_priority_hits, max(score) AS score
FROM hk JOIN atm a USING (query_id, variant_id) WHERE a.scope IS NULL OR a.scope = hk.court GROUP BY query_id, doc_id"""
)
def phased_candidates(spark, sf_dir):
    """AGG-04, STM-01: every candidate of a passage once, with what retrieved it."""
    found = _phased(spark, sf_dir).candidates
    return found.select("query_id", "doc_id", F.array_join("variant_ids", ",").alias("variants"), F.array_join("phases", ",").alias("phases"), "best_utility", "strict_hits", "relaxed_hits", "high_priority_hits", "score")


# ---------------------------------------------------------------- cached requests

#: What a page's address answers, by the page's number.
ANSWERS = [None, "http_403", "http_429", "timeout", None, "parse_empty", "network"]


@query(f"""
WITH p AS (SELECT page_id, [{', '.join('NULL' if a is None else repr(a) for a in ANSWERS)}][1 + page_id % {len(ANSWERS)}] AS code, length(html) AS n FROM pages)
SELECT page_id, run, CASE WHEN code IS NULL THEN n END AS n_chars, code AS error_code, CASE run WHEN 1 THEN false WHEN 2 THEN coalesce(code IN ('http_403', 'http_429', 'parse_empty'), true) ELSE code IS NULL END AS cached
FROM p, (SELECT unnest([1, 2, 3]) AS run)
""")
def request_cache(spark, sf_dir):
    """SRC-09, STM-07: every page asked for three times through the cache: at once, after ten minutes and after half an hour."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    code = F.get(F.array(*[F.lit(a) for a in ANSWERS]), (F.col("page_id") % len(ANSWERS)).cast("int"))

    def fetch(asked: DataFrame) -> DataFrame:
        answer = F.when(code.isNull(), F.col("html")).when(code == "parse_empty", F.lit(""))
        return asked.join(pages, asked["request_id"] == pages["page_id"]).select("request_id", answer.alias("value"), F.when(code != "parse_empty", code).alias("error_code"))

    cache = RequestCache(spark, index_path(spark, "requests"))
    requests = pages.select(F.col("page_id").alias("request_id"), F.array(request_digest(F.col("url"), F.col("page_id")), request_digest(F.col("page_id"))).alias("keys"))
    out = None
    for run, at in enumerate(("2024-01-01 00:00:00", "2024-01-01 00:10:00", "2024-01-01 00:30:00"), 1):
        got = cache.read_through(requests, fetch, F.lit(at)).select(F.col("request_id").alias("page_id"), F.lit(run).alias("run"), F.length("value").cast("long").alias("n_chars"), "error_code", "cached")
        out = got if out is None else out.union(got)
    return out


@query("""
WITH e AS (SELECT user_id, value, event_type || ':' || CAST(floor(value) AS BIGINT) AS signature FROM events)
SELECT user_id, count(*) AS attempts, round(avg(value), 4) AS mean_value, count(*) - count(DISTINCT signature) AS skipped, count(DISTINCT signature) AS signatures FROM e GROUP BY user_id
""")
def carried_state(spark, sf_dir):
    """STM-01: attempts, means and repeated signatures of each user, as a stream over the events there are."""
    folder = index_path(spark, "carried")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    stream = stream.withColumn("signature", F.concat_ws(":", "event_type", F.floor("value").cast("string")))
    return T.carried(T.run_to_table(T.carry_state(stream, key="user_id", value="value", signature="signature"), f"{folder}/out", f"{folder}/log"), key="user_id")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, epoch(ts) AS s, lag(epoch(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS last FROM events)
SELECT event_id, coalesce(s - last <= 86400, false) AS repeat FROM e
""")
def repeats_alive(spark, sf_dir):
    """STM-07, SRC-13: events whose user and type were seen at most a day before."""
    return T.repeats_alive(table(spark, sf_dir, "events"), key=["user_id", "event_type"], ts="ts", order="event_id", ttl_seconds=86_400).select("event_id", "repeat")
