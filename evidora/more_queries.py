"""More registered queries: fields of normalised rows, sets, tokenisers, mentions, scores in context, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .operators import checklists as K
from .operators import gate as G
from .operators import html as P
from .operators import hydration as Y
from .operators import ingest as I
from .operators import intent as Q
from .operators import metrics as M
from .operators import references as N
from .operators import scoring as S
from .operators import variants as V
from .plans import search as plan
from .queries import GATE_TEXT, MADE, OVERLAP, SCORE_PARTS, _made, _scored, _starts_sql
from .registry import query, table


def sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# ---------------------------------------------------------------- normalised fields


@query("""
WITH r AS (SELECT o_orderkey AS k, o_orderdate AS d, o_orderkey % 4 AS c, o_orderkey % 50 AS s, o_orderstatus AS st FROM orders)
SELECT CAST(k AS VARCHAR) AS doc_id, CASE WHEN c = 0 THEN 'SC' WHEN c = 1 THEN 'HC' ELSE 'UNKNOWN' END AS court, CASE WHEN k % 3 = 2 THEN NULL ELSE CAST(d AS DATE) END AS decision_date,
  array_to_string(list_distinct_ordered, '|') AS tokens, CASE WHEN c = 3 THEN 'Order ' || k || '. Held under Section ' || s || '(1) of the IPC with status ' || st || '. statutory material' ELSE 'Held under Section ' || s || '(1) of the IPC with status ' || st END AS text
FROM (SELECT *, CASE WHEN c = 3 THEN ['section ' || s || '(1)', 'ipc', 'statutory material', 'non judgment'] ELSE ['section ' || s || '(1)', 'ipc'] END AS list_distinct_ordered FROM r)
""")
def doc_fields(spark, sf_dir):
    """PAR-01, PAR-04..06: orders as raw rows under other names: dates in three forms, courts, statutory material and statute tokens."""
    k = F.col("o_orderkey")
    day = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 3 == 1, F.date_format("o_orderdate", "d-M-yyyy")).otherwise("no date")
    court = F.get(F.array(F.lit("Supreme Court of India"), F.lit("Delhi High Court"), F.lit("District Court"), F.lit("Central Regulations")), (k % 4).cast("int"))
    snippet = F.concat(F.lit("Held under  Section "), (k % 50).cast("string"), F.lit("(1) of the IPC with status "), F.col("o_orderstatus"))
    raw = table(spark, sf_dir, "orders").select(k.alias("documentId"), F.concat(F.lit("Order "), k.cast("string")).alias("headline"), court.alias("courtName"), day.alias("publishdate"), snippet.alias("snippet"))
    made = I.normalise_documents(raw)
    return made.select("doc_id", "court", "decision_date", F.array_join("statute_tokens", "|").alias("tokens"), "text")


# ---------------------------------------------------------------- sets and tokens

_T = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 3)"


@query(f"""
WITH c AS (SELECT conv_id, list_distinct(flatten(list({_T}) FILTER (role = 'user'))) AS a, list_distinct(flatten(list({_T}) FILTER (role <> 'user'))) AS b FROM conversations GROUP BY conv_id),
z AS (SELECT conv_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM c)
SELECT conv_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ' ') AS either, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ' ') AS only_asked, array_to_string(list_sort(list_intersect(a, b)), ' ') AS shared FROM z
""")
def token_sets(spark, sf_dir):
    """SET-03..05: union, difference and intersection of what is asked and answered in each conversation."""
    rows = table(spark, sf_dir, "conversations").withColumn("k", X.RERANK.all(F.col("text")))
    user = F.col("role") == "user"
    side = lambda condition: F.array_distinct(F.flatten(F.collect_list(F.when(condition, F.col("k")))))
    sets = rows.groupBy("conv_id").agg(side(user).alias("a"), side(~user).alias("b"))
    shown = lambda xs: F.array_join(F.array_sort(xs), " ")
    return sets.select("conv_id", shown(F.array_union("a", "b")).alias("either"), shown(F.array_except("a", "b")).alias("only_asked"), shown(F.array_intersect("a", "b")).alias("shared"))


def _tok(kept: str, least: int, stop=(), digits: bool = False) -> str:
    test = f"length(t) >= {least}" + (" OR regexp_matches(t, '[0-9]')" if digits else "")
    more = f" AND NOT list_contains({sql_list(stop)}, t)" if stop else ""
    return f"array_to_string(list_filter(regexp_extract_all(lower(text), '[{kept}]+'), lambda t: ({test}){more}), ' ')"


@query(f"""
SELECT conv_id, turn, {_tok('a-z0-9', 3, X.CONTEXT_STOP)} AS context, {_tok('a-z0-9', 3, X.KEYWORD_STOP + X.CONNECTOR_STOP)} AS keywords, {_tok('a-z0-9()/\\-', 2, (), True)} AS rewrite, {_tok('a-z0-9', 5, X.CORE_STOP)} AS core,
  {_tok('a-z0-9()', 2)} AS coach, {_tok('a-z0-9()/\\-', 2)} AS grounding, {_tok('a-z0-9', 2)} AS advisory, {_tok('a-z0-9()/\\-', 1)} AS evaluation FROM conversations
""")
def tokenisers(spark, sf_dir):
    """TOK-04..06, TOK-08, TOK-11: every turn by the tokenisers that no other query runs."""
    each = {"context": X.CONTEXT, "keywords": X.KEYWORDS, "rewrite": X.REWRITE, "core": X.CORE, "coach": X.COACH, "grounding": X.GROUNDING, "advisory": X.ADVISORY, "evaluation": X.EVALUATION}
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[F.array_join(t.all(F.col("text")), " ").alias(n) for n, t in each.items()])


TERMS = ["the", "and the", "license", "dans", "zzz"]


@query(f"SELECT doc_id, len(list_filter({sql_list(TERMS)}, lambda x: contains(lower(text), x))) AS n FROM documents")
def term_counts(spark, sf_dir):
    """JOIN-04: how many terms of a list are in each document."""
    terms = F.array(*[F.lit(t) for t in TERMS], F.lit(""), F.lit(None).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", X.count_terms_of(F.col("text"), terms).cast("long").alias("n"))


# ---------------------------------------------------------------- mentions and predicates

_TRANSITION = "crpc|code of criminal procedure, 1973|bnss|bharatiya nagarik suraksha sanhita, 2023|code of criminal procedure reference read as bnss reference"


@query(f"""
WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part)
SELECT k AS part, array_to_string(list_distinct_in_order, '|') AS sections, 's.o. ' || k || '(e)' AS notification_ids, CAST(1 + k % 28 AS VARCHAR) || ' march ' || (1990 + k % 30) AS notification_dates, '{_TRANSITION}' AS aliases, k % 2 = 0 AS either
FROM (SELECT *, ['section ' || s || ' pc act', 'section ' || (s + 1) || '(2)(a) pc act'] AS list_distinct_in_order FROM p)
""")
def statute_mentions(spark, sf_dir):
    """QRY-07, QRY-08: mentions in questions made of parts."""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    text = F.concat(F.when(F.col("p_partkey") % 2 == 0, "Does either Section ").otherwise("Does Section "), s.cast("string"), F.lit(" of the Cr.P.C. or section "), (s + 1).cast("string"), F.lit("(2)(a) PC Act apply after notification S.O. "), k, F.lit("(e) dated "), (1 + F.col("p_partkey") % 28).cast("string"), F.lit("th March "), (1990 + F.col("p_partkey") % 30).cast("string"), F.lit("?"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), text.alias("text")).withColumn("r", N.references(F.col("text")))
    joined = lambda name: F.array_join(F.col(f"r.{name}"), "|").alias(name)
    return rows.select("part", joined("sections"), joined("notification_ids"), joined("notification_dates"), joined("aliases"), N.asks_for_either(F.col("text"), F.col("r")).alias("either"))


_LOW = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9()./:\\-\\s]', ' ', 'g'), '[\\s\\x{00a0}]+', ' ', 'g'))"


@query(f"""
WITH m AS ({MADE} UNION ALL SELECT conv_id, turn + 1, text FROM conversations)
SELECT conv_id, turn, regexp_matches(lower(text), '(^|[^a-z0-9_])(?:or|either|alternatively|versus|vs\\.?|instead of)([^a-z0-9_]|$)') AS either_word,
  regexp_matches({_LOW}, '\\b(?:dismissed|refused|rejected|denied|declined|quashed|allowed|granted|restored|not condoned|time barred|barred by limitation)\\b') AS named,
  regexp_matches({_LOW}, '\\b(?:whether|when|can|could|would|if)\\b') AND regexp_matches({_LOW}, '\\b(?:condon(?:e|ed|ation)|quash(?:ed|ing)?|dismiss(?:ed)?|allow(?:ed)?|grant(?:ed)?|refus(?:e|ed)|reject(?:ed)?|discharge|framing\\s+of\\s+charge)\\b') AS open_ended FROM m
""")
def question_flags(spark, sf_dir):
    """FLT-15: what kind of question every turn is, and every question made of parts (turn 0)."""
    t = F.col("text")
    rows = _made(spark, sf_dir).select("conv_id", F.col("turn").cast("long").alias("turn"), "text").union(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn") + 1, "text"))
    return rows.select("conv_id", "turn", N.disjunctive_words(t).alias("either_word"), K.disposition(t).alias("named"), K.open_ended(t).alias("open_ended"))


# ---------------------------------------------------------------- scores in context

SCORED = """
d AS (SELECT doc_id, lower('t ' || text) AS body, doc_id % 5 / 4.0 AS req, doc_id % 3 / 2.0 AS core, doc_id % 7 / 6.0 AS side, doc_id % 2 / 1.0 AS hook, doc_id % 4 < 2 AS rel, doc_id % 6 < 4 AS oc, doc_id % 11 = 0 AS con, doc_id % 8 < 5 AS checked,
  doc_id % 10 / 100.0 AS fusion, doc_id % 9 / 8.0 AS rerank, doc_id % 3 AS strict, doc_id % 13 / 12.0 AS util, (doc_id % 90) * 10 AS cited, doc_id % 60 AS cites, CASE WHEN lang = 'en' THEN 'SC' WHEN lang = 'de' THEN 'HC' ELSE 'UNKNOWN' END AS court FROM documents),
m AS (SELECT *, CASE WHEN checked THEN 1.0 ELSE 0.62 END AS w, (contains(body, 'the'))::INT + (contains(body, 'les'))::INT AS n_anchors, (contains(body, 'and'))::INT AS n_issues, (contains(body, 'que'))::INT AS n_procedures, (contains(body, 'der'))::INT AS n_statutes FROM d),
f AS (SELECT *, util >= 0.55 AND checked AND strict > 0 AS proven, NOT checked AND strict = 0 AND util < 0.25 AS broad FROM m),
r AS (SELECT *, least(n_anchors * 0.018, 0.09) + least(n_issues * 0.05, 0.16) + least(n_procedures * 0.045, 0.12) + least(n_statutes * 0.03, 0.1) + w * (req * 0.26 + core * 0.26 + side * 0.1 + hook * 0.2)
  + CASE WHEN rel THEN 0.08 * w ELSE -0.16 END + CASE WHEN oc THEN 0.09 * w ELSE -0.24 END - CASE WHEN con THEN 0.32 ELSE 0 END - CASE WHEN hook < 1 THEN 0.1 ELSE 0 END + CASE WHEN checked THEN 0.05 ELSE -0.12 END
  + least(1.0, fusion * 8) * 0.06 + (rerank - 0.5) * 0.16 + CASE WHEN proven THEN 0.06 ELSE 0 END - CASE WHEN broad THEN 0.08 ELSE 0 END + CASE court WHEN 'SC' THEN 0.04 WHEN 'HC' THEN 0.03 ELSE 0 END
  + CASE WHEN cited >= 50 THEN least(cited / 3000, 0.09) ELSE 0 END + CASE WHEN cites >= 20 THEN least(cites / 2500, 0.04) ELSE 0 END + CASE WHEN doc_id % 12 = 0 THEN 0.03 ELSE 0 END AS raw FROM f)
"""


def candidates_in_context(spark, sf_dir) -> DataFrame:
    """Documents as candidates whose context, gate and provenance columns follow from their number."""
    k = F.col("doc_id")
    share = lambda n: (k % n) / float(n - 1)
    docs = table(spark, sf_dir, "documents")
    court = F.when(F.col("lang") == "en", "SC").when(F.col("lang") == "de", "HC").otherwise("UNKNOWN")
    columns: dict[str, Column] = {
        "query": F.lit(""), "title": F.lit("t"), "snippet": F.lit(""), "body": F.col("text"), "court": court,
        "anchors": F.array(F.lit("the"), F.lit("les")), "issues": F.array(F.lit("and")), "procedures": F.array(F.lit("que")), "statutes": F.array(F.lit("der")),
        "required_coverage": share(5), "core_coverage": share(3), "peripheral_coverage": share(7), "hook_coverage": (k % 2).cast("double"),
        "relation_satisfied": k % 4 < 2, "relation_required": F.lit(True), "outcome_satisfied": k % 6 < 4, "outcome_required": F.lit(True), "polarity_mismatch": k % 6 >= 4, "contradiction": k % 11 == 0,
        "detail_checked": k % 8 < 5, "fusion_score": (k % 10) / 100.0, "rerank_score": share(9), "strict_hits": k % 3, "relaxed_hits": F.lit(0), "best_utility": share(13),
        "cited_by": (k % 90) * 10, "cites": k % 60, "evidence_flag": k % 12 == 0,
    }
    return docs.select("doc_id", *[v.alias(n) for n, v in columns.items()])


@query(f"""
WITH {SCORED}, s AS (SELECT *, least(0.92, greatest(0.0, least(1.0, 1 / (1 + exp(-(raw - 0.45) * 3.1))))) AS sq FROM r)
SELECT doc_id, round(raw, 6) AS raw_score, round(CASE WHEN proven THEN least(0.94, sq + 0.03) ELSE sq END, 3) AS score FROM s
""")
def context_score(spark, sf_dir):
    """SCR-03..05: the scorer with context, gate, provenance and authority columns."""
    return S.score_candidates(candidates_in_context(spark, sf_dir)).select("doc_id", F.round("raw_score", 6).alias("raw_score"), "score")


@query(f"""
WITH lexical AS (WITH {OVERLAP}, {SCORE_PARTS} SELECT squashed AS score FROM s),
context AS (WITH {SCORED}, s AS (SELECT *, least(0.92, greatest(0.0, least(1.0, 1 / (1 + exp(-(raw - 0.45) * 3.1))))) AS sq FROM r) SELECT CASE WHEN proven THEN least(0.94, sq + 0.03) ELSE sq END AS score FROM s),
f2 AS (SELECT score FROM lexical UNION ALL SELECT score FROM context)
SELECT CASE WHEN score >= 0.86 THEN 'VERY_HIGH' WHEN score >= 0.71 THEN 'HIGH' WHEN score >= 0.51 THEN 'MEDIUM' ELSE 'LOW' END AS band, count(*) AS n, round(avg(round(score, 3)), 3) AS avg_score FROM f2 GROUP BY 1
""")
def score_bands(spark, sf_dir):
    """SCR-06: the best candidates of each passage and the candidates in context, by band."""
    rows = _scored(spark, sf_dir).select("band", "score").union(S.score_candidates(candidates_in_context(spark, sf_dir)).select("band", "score"))
    return rows.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("avg_score"))


# ---------------------------------------------------------------- reports


@query("""
WITH e AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'http_403' WHEN 1 THEN 'http_429' WHEN 2 THEN 'timeout' END AS code, page_id % 5 > 2 AS there FROM pages),
t AS (SELECT round(avg(there::INT), 3) AS coverage FROM e), c AS (SELECT code, count(*) AS n, array_to_string(list_sort(list(page_id))[1:8], ',') AS samples FROM e WHERE code IS NOT NULL GROUP BY code)
SELECT code AS error_code, coalesce(n, 0) AS n, samples, coverage FROM t LEFT JOIN c ON true
""")
def hydration_errors(spark, sf_dir):
    """AGG-20: coverage of detail texts and the errors of those that are missing, with messages made of the page's number."""
    message = F.get(F.array(F.lit("HTTP 403"), F.lit("status 429"), F.lit("Timed out")), (F.col("page_id") % 5).cast("int"))
    there = F.col("page_id") % 5 > 2
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.when(~there, P.error_code(message)).alias("error_code"), F.when(there, F.col("html")).alias("detail_text"))
    return Y.hydration_report(rows).select("error_code", "n", F.array_join("samples", ",").alias("samples"), "coverage")


@query("""
WITH r AS (SELECT l_orderkey AS query_id, count(*) FILTER (l_returnflag = 'N') AS retrieved, count(*) FILTER (l_linestatus = 'F') AS accepted, count(*) FILTER (l_quantity >= 40) AS related FROM lineitem GROUP BY l_orderkey)
SELECT query_id, greatest(retrieved, accepted) AS strict_retrieved, accepted AS strict_accepted, greatest(0, retrieved - accepted) AS strict_rejected, related AS related_accepted FROM r
""")
def precision_lanes(spark, sf_dir):
    """AGG-21: what strict variants retrieved and what of it was accepted, with order lines as candidates."""
    line = table(spark, sf_dir, "lineitem")
    tier = F.when(F.col("l_linestatus") == "F", "exact_strict").otherwise("reject")
    rows = line.select(F.col("l_orderkey").alias("query_id"), (F.col("l_returnflag") == "N").cast("int").alias("strict_hits"), tier.alias("tier"), F.when(F.col("l_quantity") >= 40, "related").alias("shown"))
    return M.lane_stats(rows)


@query("""
WITH d AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)
SELECT source AS query_id, lang AS print, doc_id, n AS running FROM d
""")
def fingerprint_counts(spark, sf_dir):
    """AGG-22: running counts of a fingerprint among a question's rows, with sources as questions and languages as fingerprints."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("lang").alias("print"), "doc_id")
    return M.running_counts(rows, "print", order="doc_id").select("query_id", "print", "doc_id", "running")


@query("""
WITH r AS (SELECT conv_id, count(*) AS n, max(turn) AS last FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN last % 4 = 0 THEN CASE WHEN n <= 1 THEN 'no_match' ELSE 'completed' END WHEN last % 4 = 1 THEN 'blocked' WHEN n <= 1 THEN 'no_match' ELSE 'partial' END AS status FROM r
""")
def run_states(spark, sf_dir):
    """FBK-05: the status of each run, with conversations as runs."""
    runs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    reason = F.get(F.array(F.lit("none"), F.lit("blocked"), F.lit("timeout"), F.lit("budget_exhausted")), (F.col("last") % 4).cast("int"))
    return runs.select("conv_id", M.run_status(reason, F.col("n") - 1).alias("status"))


@query()
def search_response(spark, sf_dir):
    """SRC-20: one response for each passage, with its status and the first page of its cases."""
    from .queries import _benchmark, _searched

    made = plan.respond(_benchmark(spark, sf_dir), _searched(spark, sf_dir), page=1, page_size=5)
    return made.select("query_id", "status", "mode", "n_exact", "n_exploratory", "n_pages", F.transform("cases", lambda c: c["doc_id"]).alias("doc_ids"))


@query("""
WITH u AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m FROM customer)
SELECT k, 'delay ' || lower(m) || ' doctypes:' || CASE WHEN n % 3 = 0 THEN 'supremecourt' WHEN n % 3 = 1 THEN 'highcourts' ELSE 'judgments' END || ' fromdate:1-1-' || (1990 + n) || ' todate:31-12-' || (1990 + n) AS compiled FROM u
""")
def token_queries(spark, sf_dir):
    """QRY-30, QRY-31, SET-04: queries in the dialect of document types and dates."""
    from .operators.planning import directives

    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.lower("c_mktsegment").alias("m"))
    court = F.get(F.array(F.lit("SC"), F.lit("HC"), F.lit("ANY")), F.col("n") % 3)
    window = Q.date_window(F.concat(F.lit("in "), (1990 + F.col("n")).cast("string")))
    types = directives(court, F.lit("context"), F.lit(False))["doctypes"]
    return rows.select("k", V.token_query(F.array(F.lit("delay"), F.lit("appeal")), F.array(F.col("m"), F.lit("delay")), F.array(F.lit("appeal")), types, window).alias("compiled"))


@query("""
WITH p AS (SELECT page_id, regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']+)["'']', 1) AS l FROM pages), u AS (SELECT DISTINCT page_id, unnest(l) AS l FROM p)
SELECT page_id, CASE WHEN l LIKE 'http%' THEN l ELSE 'https://h/browse' || l END AS url FROM u WHERE l LIKE 'http%' AND (contains(l, '/browse/') OR contains(l, '/search/')) OR l LIKE '/%'
""")
def browse_pages(spark, sf_dir):
    """SRC-08: links of every page as browse links; the base makes them so here."""
    from .sources.pages import browse_links

    return browse_links(table(spark, sf_dir, "pages"), "https://h/browse")


@query("""
WITH a AS (SELECT p_size AS phrase, p_partkey % 500 AS id, 0 AS part, p_partkey AS ordinal, p_name AS name FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_size, p_partkey % 500, 1, p_partkey, p_name FROM part WHERE p_partkey % 2 = 1),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT phrase, id, ordinal, name FROM (SELECT *, row_number() OVER (PARTITION BY phrase, id ORDER BY part, ordinal) AS r FROM u) WHERE r = 1
""")
def expanded_rows(spark, sf_dir):
    """SET-01, SET-06: a search's rows and those of its expansion, the first of each key."""
    from .sources.pages import expanded

    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("phrase"), (F.col("p_partkey") % 500).alias("id"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("name"))
    return expanded(rows.where("ordinal % 2 = 0"), rows.where("ordinal % 2 = 1"))


@query("""
WITH RECURSIVE r AS (SELECT user_id, event_id, epoch(ts) AS secs, CASE WHEN event_type IN ('view', 'click') THEN 'acquire' ELSE 'release' END AS action, event_type AS owner, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, n, event_id, action, action = 'acquire' AS granted, CASE WHEN action = 'acquire' THEN owner END AS holder, CASE WHEN action = 'acquire' THEN secs + 36000 ELSE 0 END AS until FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.n, r.event_id, r.action, (r.action = 'acquire' AND (w.holder IS NULL OR w.until <= r.secs)) OR (r.action = 'release' AND w.holder IS NOT NULL AND w.until > r.secs AND w.holder = r.owner),
    CASE WHEN r.action = 'acquire' AND (w.holder IS NULL OR w.until <= r.secs) THEN r.owner WHEN w.holder IS NULL OR w.until <= r.secs THEN NULL WHEN r.action = 'release' AND w.holder = r.owner THEN NULL ELSE w.holder END,
    CASE WHEN r.action = 'acquire' AND (w.holder IS NULL OR w.until <= r.secs) THEN r.secs + 36000 ELSE w.until END FROM w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1)
SELECT user_id, event_id, action, granted FROM w
""")
def lock_model(spark, sf_dir):
    """SRC-14: locks as a model: which of a user's events would get or free the lock."""
    from .sources.stores import lock_grants

    action = F.when(F.col("event_type").isin("view", "click"), "acquire").otherwise("release")
    made = lock_grants(table(spark, sf_dir, "events").withColumn("action", action), key="user_id", owner="event_type", hold_seconds=36000)
    return made.select("user_id", "event_id", "action", "granted")


MODES = G.Checklist(axes=(("a", ("the",), True),), groups=(G.Group("g1", ("this",)), G.Group("g2", ("from",))), outcome=("was",), outcome_required=True).with_pairs()


def _in(word: str) -> str:
    return f"regexp_matches(t, '(^|[^a-z0-9_]){word}([^a-z0-9_]|$)')"


@query(f"""
WITH t AS (SELECT doc_id, {GATE_TEXT} AS t FROM documents), {_starts_sql('s', {'g1': ['this'], 'g2': ['from']})},
n AS (SELECT DISTINCT a.doc_id FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.g = 'g1' AND b.g = 'g2' AND abs(a.pos - b.pos) <= 220),
f AS (SELECT doc_id, {_in('this')}::INT AS h1, {_in('from')}::INT AS h2, {_in('was')}::INT AS oc, {_in('the')}::INT AS a, (doc_id IN (SELECT doc_id FROM n))::INT AS rel FROM t)
SELECT doc_id, 'hooks' AS mode, round((h1 + h2 + (rel = 1 AND h1 + h2 > 1)::INT + oc) / 4, 6) AS core_coverage, a / 1.0 AS peripheral_coverage, round((h1 + h2) / 2, 6) AS hook_coverage FROM f
UNION ALL SELECT doc_id, 'plain', oc / 1.0, a / 1.0, 1.0 FROM f
""")
def gate_modes(spark, sf_dir):
    """GAT-08: signals under a checklist in the modes with and without hooks."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    modes = [K.signals_of(rows.withColumn("checklist", K.in_mode(K.checklist_column(MODES), hooks=hooks))).select("doc_id", F.lit(name).alias("mode"), "core_coverage", "peripheral_coverage", "hook_coverage") for name, hooks in (("hooks", True), ("plain", False))]
    return modes[0].union(modes[1])


STEPS = G.Checklist(
    axes=(("place", ("that",), True),),
    groups=(G.Group("g1", ("this",)), G.Group("g2", ("und",)), G.Group("g3", ("que",))),
    outcome=("was",),
    outcome_contradictions=("allowed",),
    outcome_required=True,
    steps=tuple(G.Step(f"s{i}", (w,)) for i, w in enumerate(("the", "and", "for", "with"))) + (G.Step("c", ("this",), ("from",), mandatory=False),),
)


@query(f"""
WITH t AS (SELECT d.doc_id, coalesce(quality, 0) = 1 AS verified, {GATE_TEXT} AS t FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), {_starts_sql('s', {'l': ['this'], 'r': ['from']})},
n AS (SELECT DISTINCT a.doc_id FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.g = 'l' AND b.g = 'r' AND abs(a.pos - b.pos) <= 260),
f AS (SELECT doc_id, verified, {_in('this')}::INT + {_in('und')}::INT + {_in('que')}::INT AS h, ({_in('was')} AND NOT {_in('allowed')})::INT AS oc, {_in('the')}::INT + {_in('and')}::INT + {_in('for')}::INT + {_in('with')}::INT AS s, (doc_id IN (SELECT doc_id FROM n) OR NOT verified)::INT AS c, {_in('that')}::INT AS a, {_in('allowed')} AS con FROM t),
g AS (SELECT *, round(h / 3, 6) AS hook, round((h + oc + s) / 8, 6) AS core, round((a + c) / 2, 6) AS side, round((h + oc + s + a + c) / 10, 6) AS req, round(s / 4, 6) AS steps FROM f)
SELECT doc_id, CASE WHEN verified AND NOT con AND core >= 1 AND hook >= 1 AND oc = 1 AND c = 1 AND side >= 0.6 THEN 'exact_strict'
  WHEN NOT con AND ((core >= 1 AND hook >= 1 AND oc = 1) OR (core >= 0.35 AND hook >= 0.5 AND req >= 0.35 AND steps >= 0.25 AND (oc = 1 OR core >= 0.6))) THEN 'exact_provisional'
  WHEN NOT con AND core >= 0.75 AND req >= 0.75 THEN 'near_miss' ELSE 'reject' END AS tier, core AS core_coverage, steps AS step_coverage, c = 1 AS chain_satisfied FROM g
""")
def gate_steps(spark, sf_dir):
    """GAT-03, GAT-05: tiers under a checklist with mandatory steps and a chain, in which near misses occur."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = docs.select("doc_id", "text", (F.coalesce("quality", F.lit(0)) == 1).alias("detail_checked"), F.lit(1).alias("context_strength"))
    return G.gate(G.signals(rows, STEPS), STEPS).select("doc_id", "tier", "core_coverage", "step_coverage", "chain_satisfied")
