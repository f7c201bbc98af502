"""Registered queries over the standard tables, each with its SQL where SQL can say it.

A query applies operators of this package to whole tables.  Its SQL is written for
DuckDB, from the operator's meaning, to check the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import hashing as H
from .functions import text as X
from .operators import candidates as C
from .operators import gate as G
from .operators import html as P
from .operators import ingest as I
from .operators import intent as Q
from .operators import metrics as M
from .operators import ranking as R
from .operators import recall as L
from .operators import scoring as S
from .operators import checklists as K
from .operators import variants as V
from .operators.terms import places_of, term_places
from .plans import search as plan
from .registry import QUERIES, SQL, query, shared_folder, table
from .sources.postings import OverlapIndex, index_path
from .streaming import state as T

# ---------------------------------------------------------------- SQL parts

TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) >= 3))"
SQUEEZE = "trim(regexp_replace(coalesce({0}, ''), '[\\s\\x{{00a0}}]+', ' ', 'g'))"


def sql_stop(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


SCORING_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda t: length(t) >= 3 and not list_contains(" + sql_stop(X.SCORING_STOP) + ", t)))"

OVERLAP = f"""
q AS (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS token FROM benchmark),
qn AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id),
d AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents),
hits AS (SELECT query_id, doc_id, count(*) AS shared FROM q JOIN d USING (token) GROUP BY ALL),
overlap AS (SELECT query_id, doc_id, shared, round(shared / n, 6) AS score FROM hits JOIN qn USING (query_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM overlap)
"""


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _lexical(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return R.overlap_top(_benchmark(spark, sf_dir), table(spark, sf_dir, "documents"), k)


# ---------------------------------------------------------------- retrieval


@query(f"WITH {OVERLAP} SELECT query_id, doc_id, shared, score, rank FROM ranked WHERE rank <= 5")
def tok_overlap_topk(spark, sf_dir):
    """TOK-02, SCR-01, WIN-01, ORD-01, ORD-04: the five documents that share most of each passage's tokens."""
    return _lexical(spark, sf_dir, 5)


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_dot_product(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, score, rank FROM r WHERE rank <= 10
""")
def vector_topk(spark, sf_dir):
    """JOIN-15, ORD-03, SRC-12: nearest vectors of every hundredth one among all."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.vector_top_k(vectors.where("id % 100 = 0").withColumnRenamed("id", "query_id"), vectors, 10)


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_dot_product(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings WHERE label = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, score, rank FROM r WHERE rank <= 10
""")
def vector_topk_filtered(spark, sf_dir):
    """FLT-08, JOIN-15: the same with a payload filter that reaches the scan."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    store = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return R.vector_top_k(queries, store, 10, where=F.col("label") == 1)


SECOND_LIST = """
second AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, doc_id DESC) AS rank FROM overlap),
lex AS (SELECT query_id, doc_id, min(rank) AS lexical_rank FROM ranked WHERE rank <= 18 GROUP BY ALL),
sem AS (SELECT query_id, doc_id, min(rank) AS semantic_rank FROM second WHERE rank <= 24 GROUP BY ALL),
fused AS (SELECT query_id, doc_id, lexical_rank, semantic_rank,
  round(coalesce(1.2 / (60 + lexical_rank), 0.0), 8) AS lexical_score, round(coalesce(0.9 / (60 + semantic_rank), 0.0), 8) AS semantic_score,
  round(coalesce(1.2 / (60 + lexical_rank), 0.0) + coalesce(0.9 / (60 + semantic_rank), 0.0), 8) AS fusion_score
  FROM lex FULL JOIN sem USING (query_id, doc_id))
"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = R.overlap_lists(_benchmark(spark, sf_dir), table(spark, sf_dir, "documents"), {"score": 18, "shared": 24})
    return R.fuse_ranks(lists.where("list = 'score'"), lists.where("list = 'shared'"))


@query(f"WITH {OVERLAP}, {SECOND_LIST} SELECT query_id, doc_id, lexical_rank, semantic_rank, lexical_score, semantic_score, fusion_score FROM fused")
def rrf_fusion(spark, sf_dir):
    """JOIN-01, WIN-02: two ranked lists fused by reciprocal ranks."""
    return _fused(spark, sf_dir)


@query(f"""
WITH {OVERLAP}, {SECOND_LIST},
dom AS (SELECT *, CASE WHEN semantic_score > lexical_score THEN 'semantic' ELSE 'lexical' END AS dominant FROM fused),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, dominant ORDER BY fusion_score DESC, coalesce(lexical_rank, 2147483647), doc_id) AS sr,
  row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, coalesce(lexical_rank, 2147483647), doc_id) AS fr,
  greatest(1, least(18, count(*) OVER (PARTITION BY query_id))) AS target FROM dom),
f AS (SELECT *, sr <= greatest(1, floor(target * 0.82)) AS fits FROM n),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fits DESC, fr) AS position FROM f)
SELECT query_id, doc_id, fusion_score, dominant, position FROM p WHERE position <= target
""")
def dominance_quota(spark, sf_dir):
    """WIN-03: no source has more than its share of the list."""
    return R.dominance_quota(_fused(spark, sf_dir), 18).select("query_id", "doc_id", "fusion_score", "dominant", "position")


@query(f"""
WITH {OVERLAP},
h AS (SELECT r.query_id, r.doc_id, r.rank, round(len(list_intersect({TOKENS.format('b.text')}, {TOKENS.format('left(d.text, 500)')})) / len({TOKENS.format('b.text')}), 6) AS rerank_score
  FROM ranked r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d USING (doc_id) WHERE rank <= 20)
SELECT query_id, doc_id, rank, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 10 THEN 0 ELSE 1 END, CASE WHEN rank <= 10 THEN -rerank_score END, rank, doc_id) AS new_rank FROM h
""")
def rerank_head_tail(spark, sf_dir):
    """ORD-02, SCR-08, SCR-09, JOIN-03: the head re-ranked by the snippet's overlap, the tail as it was."""
    top = _lexical(spark, sf_dir, 20).select("query_id", "doc_id", "rank")
    rows = top.join(table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(500)).alias("snippet")), "doc_id").join(_benchmark(spark, sf_dir).withColumnRenamed("text", "query"), "query_id")
    return R.rerank_head(rows, F.col("query"), F.col("snippet"), 10).select("query_id", "doc_id", "rank", "rerank_score", "new_rank")


# ---------------------------------------------------------------- text and ingestion


@query("""
WITH t AS (SELECT lang, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 3 and not list_contains(""" + sql_stop(X.SCORING_STOP) + """, t)) AS k FROM documents)
SELECT lang, count(*) AS n_docs, CAST(sum(len(k)) AS BIGINT) AS n_tokens, CAST(sum(len(list_distinct(k))) AS BIGINT) AS n_distinct, max(len(k)) AS longest FROM t GROUP BY lang
""")
def token_stats_by_lang(spark, sf_dir):
    """TOK-01, FLT-18: tokens of each language."""
    rows = table(spark, sf_dir, "documents").select("lang", X.SCORING.all(F.col("text")).alias("k"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size("k").cast("long")).alias("n_tokens"), F.sum(F.size(F.array_distinct("k")).cast("long")).alias("n_distinct"), F.max(F.size("k").cast("long")).alias("longest"))


@query(f"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(nullif({SQUEEZE.format("left(" + SQUEEZE.format('text') + ", 60)")}, ''), 'Untitled case') AS title, CASE WHEN lang = 'en' THEN 'SC' WHEN lang = 'de' THEN 'HC' ELSE 'UNKNOWN' END AS court,
  'https://example.org/doc/' || doc_id || '/' AS url, length({SQUEEZE.format('text')}) AS n_chars, sha256({SQUEEZE.format('text')}) AS text_sha256 FROM documents
""")
def doc_normalize(spark, sf_dir):
    """PAR-02, PAR-03, PAR-05: documents as normalised rows, with languages as courts."""
    court = F.when(F.col("lang") == "en", "Supreme Court of  India").when(F.col("lang") == "de", "HIGH COURT (Delhi)").otherwise("District court")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tid"), "text", court.alias("court"))
    made = I.normalise_documents(docs.withColumn("title", F.left(X.squeeze(F.col("text")), F.lit(60))))
    return made.select("doc_id", F.left("title", F.lit(60)).alias("title"), "court", "url", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query("SELECT min(doc_id) AS doc_id, lang, source, n_chars FROM (SELECT *, first_value(lang) OVER w AS l, row_number() OVER w AS rn FROM documents WINDOW w AS (PARTITION BY text ORDER BY doc_id)) WHERE rn = 1 GROUP BY doc_id, lang, source, n_chars")
def first_wins_dedupe(spark, sf_dir):
    """SET-02: the first document of each text; texts are known by a digest of 256 bits, so none is shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("digest"))
    return I.first_of_each(docs, ["digest"], ["doc_id"]).select("doc_id", "lang", "source", "n_chars")


@query(f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace({SQUEEZE.format('text')}, '(?i)\\b(?:Para|Paragraph|Section|Held|Issue|Facts)\\b', chr(10) || '\\0', 'g'), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda p: {SQUEEZE.format('p')}), lambda p: p <> '') AS parts FROM documents)
SELECT doc_id, len(parts) AS n_segments, coalesce(list_max(list_transform(parts, lambda p: length(p))), 0) AS longest, sha256(array_to_string(parts, '|')) AS parts_sha256 FROM s
""")
def segment_sentences(spark, sf_dir):
    """PAR-07: sentences and marked parts of every document."""
    parts = table(spark, sf_dir, "documents").select("doc_id", I.segments(F.col("text")).alias("parts"))
    return parts.select("doc_id", F.size("parts").cast("long").alias("n_segments"), F.coalesce(F.array_max(F.transform("parts", F.length)), F.lit(0)).cast("long").alias("longest"), F.sha2(F.array_join("parts", "|"), 256).alias("parts_sha256"))


@query()
def chunk_pack(spark, sf_dir):
    """PAR-08: documents packed into chunks; checked by a plain fold in the tests."""
    return I.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", "chunk_ix", "chunk_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query("""
WITH t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 2)) AS token FROM documents),
c AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL),
v AS (SELECT token, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(token, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, x: (xor(h, x) * 16777619) & 4294967295) AS h FROM (SELECT DISTINCT token FROM c)),
b AS (SELECT doc_id, h % 192 AS bucket, sum((CASE WHEN h % 2 = 0 THEN 1.0 ELSE -1.0 END) * least(3.2, 1 + length(token) / 12.0) * n) AS raw FROM c JOIN v USING (token) GROUP BY ALL),
l AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM b GROUP BY doc_id)
SELECT doc_id, count(*) AS n_buckets, round(sum(round(raw / norm, 7)), 4) AS total, round(max(abs(round(raw / norm, 7))), 4) AS largest FROM b JOIN l USING (doc_id) GROUP BY doc_id
""")
def hash_embedding(spark, sf_dir):
    """EMB-01: hashed unit vectors of all documents, as sums a document."""
    made = I.hash_embedding(table(spark, sf_dir, "documents"), row_id="doc_id")
    return made.groupBy("doc_id").agg(F.count("*").alias("n_buckets"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max(F.abs("value")), 4).alias("largest"))


@query("""
WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 3) AS k FROM documents),
u AS (SELECT doc_id, unnest(k) AS a, generate_subscripts(k, 1) AS i FROM t),
w AS (SELECT doc_id, i, a || ' ' || lead(a, 1) OVER p || ' ' || lead(a, 2) OVER p AS g FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, count(*) AS n, arg_min(g, i) AS f, string_agg(g, '|' ORDER BY i) AS s FROM w WHERE g IS NOT NULL GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_windows, coalesce(f, '') AS first_window, sha256(coalesce(s, '')) AS windows_sha256 FROM t LEFT JOIN g USING (doc_id)
""")
def ngram_windows(spark, sf_dir):
    """WIN-07: windows of three tokens."""
    tokens = X.RERANK.all(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", X.ngrams(tokens, 3).alias("grams"))
    return rows.select("doc_id", F.size("grams").cast("long").alias("n_windows"), F.coalesce(F.get("grams", F.lit(0)), F.lit("")).alias("first_window"), F.sha2(F.array_join("grams", "|"), 256).alias("windows_sha256"))


@query("""
SELECT conv_id, turn, left(sha256(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || '|' || role), 32) AS cache_key, left(sha256(text), 16) AS text_key FROM conversations
""")
def cache_key(spark, sf_dir):
    """QRY-33: keys of requests."""
    rows = table(spark, sf_dir, "conversations")
    clean = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0), " ")
    return rows.select("conv_id", "turn", H.cache_key(32, clean, F.col("role")).alias("cache_key"), H.cache_key(16, F.col("text")).alias("text_key"))


@query("""
SELECT DISTINCT source, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(source, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, x: (h * 31 + x) & 4294967295) AS poly31 FROM documents
""")
def phrase_hash(spark, sf_dir):
    """QRY-34: the polynomial hash of names."""
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", H.poly31(F.col("source")).alias("poly31"))


# ---------------------------------------------------------------- candidates

STATUTE, CASE_LIKE = ["thing", "license"], ["with", "dans", "und"]


def _edge(words) -> str:
    return f"(^|[^a-z0-9_])(?:{'|'.join(words)})([^a-z0-9_]|$)"


CLASSIFIED = f"""
c AS (SELECT doc_id, lang, source, trim(lower(left(text, 60))) AS title, trim(lower(left(text, 60))) || ' ' || lower(text) AS body, CASE WHEN lang = 'en' THEN 'SC' WHEN lang = 'de' THEN 'HC' ELSE 'UNKNOWN' END AS court FROM documents),
f AS (SELECT *, regexp_matches(title, '{_edge(CASE_LIKE)}') OR regexp_matches(title, ' v(?:s\\.?|\\.?) ') AS tc, regexp_matches(body, '{_edge(CASE_LIKE)}') OR regexp_matches(body, ' v(?:s\\.?|\\.?) ') AS bc,
  regexp_matches(title, '{_edge(STATUTE)}') AS ts, regexp_matches(body, '{_edge(STATUTE)}') AS bs FROM c),
k AS (SELECT *, CASE WHEN title = '' THEN 'noise' WHEN ts AND NOT tc THEN 'statute' WHEN bs AND NOT bc THEN 'statute' WHEN tc OR (bc AND NOT ts) THEN 'case' WHEN ts OR bs THEN 'statute' WHEN court <> 'UNKNOWN' AND length(title) > 8 THEN 'unknown' ELSE 'noise' END AS kind,
  CASE WHEN title = '' THEN 'pseudo-result title' WHEN ts AND NOT tc THEN 'statutory-title signal' WHEN bs AND NOT bc THEN 'statutory-body signal' WHEN tc OR (bc AND NOT ts) THEN 'case-law signals' WHEN ts OR bs THEN 'statute-like body' WHEN court <> 'UNKNOWN' AND length(title) > 8 THEN 'court-tagged candidate' ELSE 'insufficient legal case signals' END AS reason FROM f)
"""


def _court(lang: str = "lang") -> Column:
    return F.when(F.col(lang) == "en", "SC").when(F.col(lang) == "de", "HC").otherwise("UNKNOWN")


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("court", _court())
    made = C.classify(F.left("text", F.lit(60)), F.col("text"), F.col("court"), statute_title=["|".join(STATUTE)], statute_body=["|".join(STATUTE)], case=["|".join(CASE_LIKE)])
    return docs.withColumn("c", made).select("doc_id", "lang", "source", "court", "c.kind", "c.reason")


@query(f"WITH {CLASSIFIED} SELECT doc_id, court, kind, reason FROM k")
def classify_rows(spark, sf_dir):
    """FLT-01: every document by the decision list, with cues of this corpus."""
    return _classified(spark, sf_dir).select("doc_id", "court", "kind", "reason")


@query(f"WITH {CLASSIFIED}, n AS (SELECT kind, count(*) AS n FROM k GROUP BY kind) SELECT kind, coalesce(n, 0) AS n FROM (SELECT unnest(['case', 'statute', 'noise', 'unknown']) AS kind) LEFT JOIN n USING (kind)")
def class_counts(spark, sf_dir):
    """AGG-01: documents of each kind, with zeros."""
    return C.kind_counts(_classified(spark, sf_dir))


@query(f"WITH {CLASSIFIED} SELECT reason, count(*) AS n FROM (SELECT unnest([reason, court]) AS reason FROM k) GROUP BY reason")
def reason_hist(spark, sf_dir):
    """AGG-02: the reasons' histogram."""
    return C.reason_histogram(_classified(spark, sf_dir).withColumn("reasons", F.array("reason", "court")))


@query(f"""
WITH {CLASSIFIED}, g AS (SELECT *, kind IN ('case', 'unknown') AND court <> 'UNKNOWN' AS good FROM k), s AS (SELECT *, bool_or(good) OVER (PARTITION BY source, lang) AS anyone FROM g)
SELECT doc_id, source, lang, kind, court FROM s WHERE good OR NOT anyone
""")
def filter_with_fallback(spark, sf_dir):
    """FLT-04: cases of a court, or all of a group that has none."""
    rows = _classified(spark, sf_dir).withColumn("query_id", F.concat_ws("|", "source", "lang"))
    return C.keep_or_all(rows, F.col("kind").isin("case", "unknown") & (F.col("court") != "UNKNOWN")).select("doc_id", "source", "lang", "kind", "court")


@query("""
WITH l AS (SELECT d.doc_id, d.source, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic, length(d.text) AS n FROM documents d LEFT JOIN labels l USING (doc_id)),
s AS (SELECT *, round(0.12 * quality + least(n, 600) / 6000.0 - 0.05 * toxic, 6) AS score FROM l), b AS (SELECT *, bool_or(score >= 0.18) OVER (PARTITION BY source) AS anyone FROM s)
SELECT doc_id, source, score FROM b WHERE score >= 0.18 OR NOT anyone
""")
def relevance_filter(spark, sf_dir):
    """FLT-05: rows from the least relevance on, or all of a group without any."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    score = F.round(0.12 * F.coalesce("quality", F.lit(0)) + F.least(F.length("text"), F.lit(600)) / 6000.0 - 0.05 * F.coalesce("toxic", F.lit(0)), 6)
    return C.keep_or_all(docs.withColumn("score", score), F.col("score") >= Config().min_relevance, group="source").select("doc_id", "source", "score")


@query("""
WITH r AS (SELECT md5(text) AS url, doc_id, lang, source, n_chars, text AS snippet FROM documents),
q AS (SELECT *, (CASE WHEN lang IN ('en', 'de') THEN 10 ELSE 0 END) + least(length(snippet), 600) / 120.0 AS quality FROM r)
SELECT url, min(doc_id) AS ordinal, count(*) AS n, arg_max(source, (quality, -doc_id)) AS title FROM q GROUP BY url
""")
def merge_duplicates(spark, sf_dir):
    """AGG-03: copies of a text become one row; the better one is the base."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.md5("text").alias("url"), F.col("doc_id").alias("ordinal"), F.col("source").alias("title"), F.col("text").alias("snippet"), _court().alias("court"))
    n = rows.groupBy("url").agg(F.count("*").alias("n"))
    return C.merge_duplicates(rows).join(n, "url").select("url", "ordinal", "n", "title")


@query("""
SELECT l_orderkey AS url, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS variant_ids, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS phases, round(max(l_discount), 4) AS best_utility,
  count(*) FILTER (l_returnflag = 'N') AS strict_hits, count(*) FILTER (l_returnflag <> 'N') AS relaxed_hits, count(*) FILTER (l_quantity >= 80) AS high_priority_hits FROM lineitem GROUP BY l_orderkey
""")
def provenance_agg(spark, sf_dir):
    """AGG-04: what each candidate was found by, with order lines as attempts."""
    line = table(spark, sf_dir, "lineitem")
    attempts = line.select(F.col("l_orderkey").alias("url"), F.col("l_suppkey").alias("variant_id"), F.col("l_partkey").alias("canonical_key"), F.col("l_linestatus").alias("phase"), F.col("l_discount").alias("utility"), F.when(F.col("l_returnflag") == "N", "strict").otherwise("relaxed").alias("strictness"), F.col("l_quantity").alias("priority"))
    made = C.provenance(attempts)
    return made.select("url", F.array_join(F.transform("variant_ids", lambda v: v.cast("string")), ",").alias("variant_ids"), F.array_join("phases", ",").alias("phases"), F.round("best_utility", 4).alias("best_utility"), "strict_hits", "relaxed_hits", "high_priority_hits")


@query("""
SELECT d.doc_id, d.lang, 'labelled' AS side FROM documents d SEMI JOIN labels USING (doc_id) UNION ALL SELECT d.doc_id, d.lang, 'unlabelled' FROM documents d ANTI JOIN labels USING (doc_id)
""")
def anti_semi(spark, sf_dir):
    """JOIN-12, JOIN-13, SET-01: documents with a label and those without."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return C.known(docs, labels, ["doc_id"]).withColumn("side", F.lit("labelled")).unionByName(C.unseen(docs, labels, ["doc_id"]).withColumn("side", F.lit("unlabelled")))


LEXICON = {"greeting": ["hello", "thanks"], "english": ["the ", " and "], "german": [" und ", " der "], "french": [" les ", " des "], "spanish": [" los ", " que "]}


def _label_sql(text: str) -> str:
    cases = ", ".join(f"CASE WHEN {' OR '.join(f'''contains({text}, '{t}')''' for t in terms)} THEN '{label}' END" for label, terms in LEXICON.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


@query(f"SELECT conv_id, turn, array_to_string({_label_sql('lower(text)')}, ',') AS labels, len({_label_sql('lower(text)')}) AS n FROM conversations")
def lexicon_label(spark, sf_dir):
    """QRY-03, QRY-04: labels of every turn, by a lexicon of this corpus."""
    rows = table(spark, sf_dir, "conversations").withColumn("l", C.labels_of(F.col("text"), LEXICON))
    return rows.select("conv_id", "turn", F.array_join("l", ",").alias("labels"), F.size("l").cast("long").alias("n"))


# ---------------------------------------------------------------- scoring

SCORE_PARTS = f"""
b AS (SELECT r.query_id, r.doc_id, {SCORING_TOKENS.format('b.text')} AS q, {SCORING_TOKENS.format("left(d.text, 80) || ' ' || left(d.text, 500) || ' ' || d.text")} AS c, d.lang, d.text, r.score AS rr FROM ranked r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d USING (doc_id) WHERE rank <= 10),
o AS (SELECT *, CASE WHEN len(q) > 0 THEN len(list_intersect(q, c)) / len(q) ELSE 0.0 END AS raw FROM b),
w AS (SELECT *, 0.2 * raw * 0.16 + 0.05 + (least(1.0, greatest(0.0, rr)) - 0.5) * 0.16 + CASE WHEN lang = 'en' THEN 0.04 WHEN lang = 'de' THEN 0.03 ELSE 0.0 END AS raw_score FROM o),
s AS (SELECT *, least(0.92, greatest(0.0, least(1.0, 1 / (1 + exp(-(raw_score - 0.45) * 3.1))))) AS squashed FROM w)
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _lexical(spark, sf_dir, 10).select("query_id", "doc_id", F.col("score").alias("rerank_score"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(80)).alias("title"), F.left("text", F.lit(500)).alias("snippet"), F.col("text").alias("body"), _court().alias("court"), F.lit(True).alias("detail_checked"))
    return S.score_candidates(top.join(docs, "doc_id").join(_benchmark(spark, sf_dir).withColumnRenamed("text", "query"), "query_id"))


@query(f"WITH {OVERLAP}, {SCORE_PARTS} SELECT query_id, doc_id, round(raw_score, 6) AS raw_score, round(squashed, 3) AS score FROM s")
def weighted_score(spark, sf_dir):
    """SCR-01..07: the scorer over the best candidates of each passage."""
    return _scored(spark, sf_dir).select("query_id", "doc_id", F.round("raw_score", 6).alias("raw_score"), "score")


@query("""
WITH c AS (SELECT c_custkey AS doc_id, c_nationkey AS query_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'SC' WHEN c_mktsegment = 'MACHINERY' THEN 'HC' ELSE 'UNKNOWN' END AS court, round((c_acctbal + 1000) / 11000.0, 6) AS score FROM customer),
b AS (SELECT *, bool_or(court = 'SC') OVER (PARTITION BY query_id) AND bool_or(court = 'HC') OVER (PARTITION BY query_id) AS has_both FROM c),
p AS (SELECT *, round(CASE WHEN has_both AND court = 'SC' THEN least(1.0, score + 0.025) ELSE score END, 6) AS preferred_score FROM b)
SELECT doc_id, query_id, court, score, preferred_score, row_number() OVER (PARTITION BY query_id ORDER BY preferred_score DESC, score DESC, doc_id) AS new_rank FROM p
""")
def court_preference(spark, sf_dir):
    """WIN-05: customers of a nation as rows, market segments as courts."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("query_id"), F.when(F.col("c_mktsegment") == "BUILDING", "SC").when(F.col("c_mktsegment") == "MACHINERY", "HC").otherwise("UNKNOWN").alias("court"), F.round((F.col("c_acctbal").cast("double") + 1000) / 11000.0, 6).alias("score"))
    return R.prefer_court(rows)


@query(f"""
WITH RECURSIVE {OVERLAP},
kr AS (SELECT doc_id, lang || ':' || source AS day, md5(lower(text)) AS print, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 5 AND NOT list_contains({sql_stop(X.CORE_STOP)}, t))[1:28] AS r FROM documents),
kd AS (SELECT doc_id, day, print, array_to_string(list_filter(r, lambda t, i: list_position(r, t) = i)[1:14], ' ') AS core FROM kr),
c AS (SELECT query_id, doc_id, rank, day, print, CASE WHEN length(core) >= 30 THEN core END AS core FROM ranked JOIN kd USING (doc_id) WHERE rank <= 40),
w AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS rank, CAST([] AS VARCHAR[]) AS cores, CAST([] AS VARCHAR[]) AS prints, CAST([] AS VARCHAR[]) AS days, CAST(NULL AS BIGINT) AS kept FROM c
  UNION ALL SELECT query_id, rank, CASE WHEN ok AND core IS NOT NULL THEN list_append(cores, core) ELSE cores END, CASE WHEN ok THEN list_append(prints, print) ELSE prints END, CASE WHEN ok THEN list_append(days, day) ELSE days END, CASE WHEN ok THEN doc_id END
  FROM (SELECT c.*, w.cores, w.prints, w.days, NOT coalesce(list_contains(w.cores, c.core), false) AND NOT list_contains(w.prints, c.print) AND len(list_filter(w.days, lambda d: d = c.day)) < 2 AS ok FROM w JOIN c ON c.query_id = w.query_id AND c.rank = w.rank + 1))
SELECT c.query_id, c.doc_id, c.rank, c.day AS court_day FROM w JOIN c ON c.query_id = w.query_id AND c.doc_id = w.kept
""")
def diversify_greedy(spark, sf_dir):
    """WIN-04, AGG-22: the candidates of each passage without repeats of content, chosen in rounds; checked by recursion, and by a plain loop in the tests."""
    top = _lexical(spark, sf_dir, 40).select("query_id", "doc_id", "rank")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.array(R.core_key(F.col("text"))).alias("keys"), F.md5(F.lower("text")).alias("fingerprint"))
    rows = top.join(docs, "doc_id").withColumn("court_day", F.concat_ws(":", "lang", "source"))
    return R.diversify(rows, max_per_court_day=2).select("query_id", "doc_id", "rank", "court_day")


CHECK = G.Checklist(axes=(("place", ("the", "les", "der"), True), ("link", ("with", "und"), True)), groups=(G.Group("g1", ("this", "that")), G.Group("g2", ("from", "for")), G.Group("g3", ("nothing",), required=False)), outcome=("was", "were"), outcome_contradictions=("allowed",), outcome_required=True).with_pairs()


def _has_sql(text: str, words) -> str:
    return f"regexp_matches({text}, '{_edge(words)}')"


GATE_TEXT = "trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9()./:\\-\\s]', ' ', 'g'), '[\\s\\x{00a0}]+', ' ', 'g'))"


@query(f"""
WITH t AS (SELECT doc_id, {GATE_TEXT} AS t FROM documents),
h AS (SELECT doc_id, {_has_sql('t', ['this', 'that'])} AS h1, {_has_sql('t', ['from', 'for'])} AS h2, {_has_sql('t', ['was', 'were'])} AND NOT {_has_sql('t', ['allowed'])} AS oc, {_has_sql('t', ['the', 'les', 'der'])} AS a1, {_has_sql('t', ['with', 'und'])} AS a2 FROM t)
SELECT doc_id, round((h1::INT + h2::INT) / 2, 6) AS hook_coverage, oc AS outcome_satisfied, round((a1::INT + a2::INT) / 2, 6) AS peripheral_coverage FROM h
""")
def coverage(spark, sf_dir):
    """GAT-01, FLT-10, FLT-11: a small checklist's signals in every document."""
    made = G.signals(table(spark, sf_dir, "documents").select("doc_id", "text"), CHECK)
    return made.select("doc_id", "hook_coverage", "outcome_satisfied", "peripheral_coverage")


def _starts_sql(name: str, groups: dict[str, list[str]]) -> str:
    """SQL of (doc_id, g, pos): the first 30 places of each group's words, one word after another."""
    words = ", ".join(f"('{g}', {k}, '{w}')" for g, ws in groups.items() for k, w in enumerate(ws))
    return f"""{name}_w AS (SELECT doc_id, string_split_regex(t, '[^a-z0-9_]') AS k FROM t),
{name}_u AS (SELECT doc_id, unnest(k) AS w, generate_subscripts(k, 1) AS i FROM {name}_w),
{name}_p AS (SELECT doc_id, w, sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(w) - 1 AS pos FROM {name}_u),
{name}_g AS (SELECT doc_id, g, o, pos FROM {name}_p JOIN (VALUES {words}) v(g, o, word) ON v.word = {name}_p.w),
{name} AS (SELECT doc_id, g, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY o, pos) AS r FROM {name}_g) WHERE r <= 30)"""


@query(f"""
WITH t AS (SELECT doc_id, {GATE_TEXT} AS t FROM documents), {_starts_sql('s', {'l': ['this'], 'r': ['from']})},
n AS (SELECT DISTINCT a.doc_id FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.g = 'l' AND b.g = 'r' AND abs(a.pos - b.pos) <= 220)
SELECT t.doc_id, (SELECT count(*) FROM s WHERE s.doc_id = t.doc_id AND g = 'l') AS n_left, (SELECT count(*) FROM s WHERE s.doc_id = t.doc_id AND g = 'r') AS n_right, t.doc_id IN (SELECT doc_id FROM n) AS near FROM t
""")
def proximity_join(spark, sf_dir):
    """JOIN-06: whether two words stand within 220 characters of one another."""
    rows = table(spark, sf_dir, "documents").select("doc_id", G.gate_text(F.col("text")).alias("t"))
    rows = rows.select("doc_id", term_places(F.col("t"), ["this", "from"]).alias("at"))
    rows = rows.select("doc_id", places_of(F.col("at"), F.array(F.lit("this"))).alias("l"), places_of(F.col("at"), F.array(F.lit("from"))).alias("r"))
    return rows.select("doc_id", F.size("l").cast("long").alias("n_left"), F.size("r").cast("long").alias("n_right"), G.near_starts(F.col("l"), F.col("r"), 220).alias("near"))


GATED = f"""
t AS (SELECT doc_id, doc_id // 5 AS source, text, {GATE_TEXT} AS t FROM documents), {_starts_sql('s', {'g1': ['this', 'that'], 'g2': ['from', 'for']})},
n AS (SELECT DISTINCT a.doc_id FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.g = 'g1' AND b.g = 'g2' AND abs(a.pos - b.pos) <= 220),
h AS (SELECT t.doc_id, source AS query_id, coalesce(l.quality, 0) = 1 AS verified, ({_has_sql('t', ['this', 'that'])})::INT AS h1, ({_has_sql('t', ['from', 'for'])})::INT AS h2, t.doc_id IN (SELECT doc_id FROM n) AS rel, {_has_sql('t', ['was', 'were'])} AS o,
  {_has_sql('t', ['allowed'])} AND NOT regexp_matches(t, '(^|[^a-z0-9_])(?:not|no|without)\\s+(?:been\\s+)?allowed([^a-z0-9_]|$)') AS con, ({_has_sql('t', ['the', 'les', 'der'])})::INT AS a1, ({_has_sql('t', ['with', 'und'])})::INT AS a2 FROM t LEFT JOIN labels l ON l.doc_id = t.doc_id),
c AS (SELECT *, (o AND NOT con) AS oc, round((h1 + h2) / 2, 6) AS hook, round((h1 + h2 + (rel AND h1 + h2 > 1)::INT + (o AND NOT con)::INT) / 4, 6) AS core, round((a1 + a2) / 2, 6) AS side, round((h1 + h2 + (rel AND h1 + h2 > 1)::INT + (o AND NOT con)::INT + a1 + a2) / 6, 6) AS req FROM h),
g AS (SELECT *, CASE WHEN verified AND NOT con AND core >= 1 AND hook >= 1 AND rel AND oc AND side >= 0.6 THEN 'exact_strict'
  WHEN NOT con AND ((core >= 1 AND hook >= 1 AND rel AND oc) OR (core >= 0.35 AND hook >= 0.5 AND req >= 0.35 AND (oc OR core >= 0.6))) THEN 'exact_provisional'
  WHEN NOT con AND core >= 0.75 AND req >= 0.75 THEN 'near_miss' ELSE 'reject' END AS tier FROM c),
v AS (SELECT *, least(1.0, greatest(0.0, 0.6 * 0.45 + (core * 0.34 + 0.22 + 0.1 + hook * 0.12 + CASE WHEN rel THEN 0.08 ELSE 0 END + CASE WHEN oc THEN 0.08 ELSE 0 END + side * 0.06) * 0.55))
  - CASE WHEN verified THEN 0 ELSE 0.06 END - CASE WHEN rel THEN 0 ELSE 0.03 END - CASE WHEN oc THEN 0 ELSE 0.04 END AS v1 FROM g),
k AS (SELECT *, least(least(1.0, greatest(0.0, v1 - CASE WHEN oc THEN 0 ELSE 0.16 END - CASE WHEN con THEN 0.25 ELSE 0 END)), CASE WHEN verified THEN 1.0 ELSE 0.55 END, CASE tier WHEN 'exact_strict' THEN 0.95 WHEN 'exact_provisional' THEN 0.7 WHEN 'near_miss' THEN 0.45 ELSE 0.5 END) AS conf FROM v),
q AS (SELECT *, round(conf, 3) AS confidence FROM k),
p AS (SELECT *, count(*) FILTER (tier LIKE 'exact%') OVER w AS n_exact, count(*) FILTER (tier = 'near_miss') OVER w AS n_near,
  tier = 'reject' AND NOT con AND NOT verified AND oc AND (req >= 0.25 OR core >= 0.2) AS e1, tier = 'reject' AND NOT con AND (oc OR (req >= 0.3 AND core >= 0.3 AND hook >= 0.4)) AND (req >= 0.25 OR core >= 0.25 OR hook >= 0.4) AS e2, tier = 'reject' AND NOT con AND oc AND (req >= 0.3 OR core >= 0.3 OR hook >= 0.5) AS e3,
  round(req * 0.45 + core * 0.35 + hook * 0.1 + CASE WHEN oc THEN 0.1 ELSE 0 END + confidence * 0.4, 6) AS s1, round(req * 0.4 + core * 0.35 + hook * 0.15 + CASE WHEN oc THEN 0.12 ELSE 0 END - CASE WHEN oc THEN 0 ELSE 0.08 END + confidence * 0.35, 6) AS s2, round(req * 0.4 + core * 0.35 + hook * 0.15 + CASE WHEN oc THEN 0.1 ELSE 0 END + confidence * 0.35, 6) AS s3 FROM q WINDOW w AS (PARTITION BY query_id)),
p1 AS (SELECT *, e3 AND row_number() OVER (PARTITION BY query_id, e3 ORDER BY s3 DESC, doc_id) <= 3 - n_exact AS third, e1 AND n_exact = 0 AND n_near = 0 AND row_number() OVER (PARTITION BY query_id, e1 ORDER BY s1 DESC, doc_id) <= 8 AS first FROM p),
p2 AS (SELECT *, e2 AND NOT first AS e2b, n_near + count(*) FILTER (first) OVER (PARTITION BY query_id) AS near2 FROM p1),
tiers AS (SELECT *, CASE WHEN tier <> 'reject' THEN tier WHEN third THEN 'promoted' WHEN first THEN 'unverified' WHEN e2b AND row_number() OVER (PARTITION BY query_id, e2b ORDER BY s2 DESC, doc_id) <= 4 - near2 THEN 'related' END AS shown FROM p2)
"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    # five documents are the candidates of a question, so that some questions have few results and each pass of the back-fill occurs
    rows = docs.select("doc_id", F.floor(F.col("doc_id") / 5).alias("query_id"), "text", (F.coalesce("quality", F.lit(0)) == 1).alias("detail_checked"), F.lit(0.6).alias("score"), F.lit(1).alias("context_strength"))
    return G.split_tiers(G.calibrate(G.gate(G.signals(rows, CHECK), CHECK)))


@query(f"WITH {GATED} SELECT query_id, doc_id, tier, shown, confidence, core AS core_coverage, req AS required_coverage, rel AS relation_satisfied FROM tiers")
def gate_tiers(spark, sf_dir):
    """GAT-03..07, FLT-17, ORD-07, JOIN-05, JOIN-06: tiers and confidence of every document."""
    return _gated(spark, sf_dir).select("query_id", "doc_id", "tier", "shown", "confidence", "core_coverage", "required_coverage", "relation_satisfied")


@query(f"""
WITH {GATED} SELECT query_id, count(*) AS n, count(*) FILTER (tier = 'exact_strict') AS n_exact_strict, count(*) FILTER (tier = 'exact_provisional') AS n_exact_provisional, count(*) FILTER (tier = 'near_miss') AS n_near_miss, count(*) FILTER (tier = 'reject') AS n_reject,
  round(avg(req), 3) AS avg_required_coverage, round(avg(core), 3) AS avg_core_coverage, round(avg(hook), 3) AS avg_hook_coverage, count(*) FILTER (NOT rel) AS relation_failures, count(*) FILTER (NOT oc) AS polarity_failures, count(*) FILTER (con) AS contradictions, max(confidence) AS max_confidence FROM tiers GROUP BY query_id
""")
def gate_summary(spark, sf_dir):
    """AGG-11: the gate's summary of each group."""
    return G.gate_summary(_gated(spark, sf_dir))


# ---------------------------------------------------------------- small joins


@query("SELECT a.n_name AS left_name, b.n_name AS right_name, a.n_regionkey AS region FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def pair_selfjoin(spark, sf_dir):
    """JOIN-05: pairs of nations of a region, each once."""
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("left_name"), F.col("n_regionkey").alias("region")), n.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("right_name"), F.col("n_regionkey").alias("region"))
    return a.join(b, "region").where("ka < kb").select("left_name", "right_name", "region")


@query("""
WITH r AS (SELECT r_regionkey AS query_id, r_name FROM region), n AS (SELECT n_regionkey AS query_id, list(lower(n_name) ORDER BY n_nationkey) AS actors FROM nation GROUP BY 1),
x AS (SELECT query_id, unnest(actors) AS a, unnest([lower(r_name), 'trade']) AS p FROM r JOIN n USING (query_id)),
y AS (SELECT query_id, a, p FROM (SELECT query_id, unnest(actors) AS a FROM n) JOIN (SELECT query_id, unnest([lower(r_name), 'trade']) AS p FROM r) USING (query_id))
SELECT DISTINCT query_id, array_to_string(string_split(trim(regexp_replace(a || ' ' || p, '\\s+', ' ', 'g')), ' ')[1:13], ' ') AS phrase FROM y WHERE length(a || ' ' || p) >= 8
""")
def axis_cartesian(spark, sf_dir):
    """JOIN-07: combinations of a region's terms as phrases."""
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.lower("n_name").alias("n")))), lambda x: x["n"]).alias("actors"))
    rows = n.join(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("query_id"), F.array(F.lower("r_name"), F.lit("trade")).alias("procedures")), "query_id")
    return Q.combine_axes(rows, names=("actors", "procedures"), each=1000).select("query_id", "phrase")


@query("""
WITH t AS (SELECT doc_id, text, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 2)) AS k FROM documents),
a AS (SELECT doc_id AS left_id, k AS x FROM t WHERE doc_id % 100 = 0 AND len(k) > 0)
SELECT left_id, doc_id AS right_id, len(list_intersect(x, k)) AS shared, len(x) AS n_left, len(k) AS n_right FROM a JOIN t ON len(list_intersect(x, k)) > 0 AND 100 * len(list_intersect(x, k)) >= 55 * (len(x) + len(k) - len(list_intersect(x, k)))
""")
def jaccard_recall(spark, sf_dir):
    """JOIN-10: documents whose token set is near that of every hundredth one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.SIGNATURE.distinct(F.col("text")).alias("tokens"))
    return L.jaccard_of_stated(docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "left_id"), docs.withColumnRenamed("doc_id", "right_id"), 55)


STRIP = "trim(regexp_replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&#39;', ''''), '&quot;', '\"'), '[\\s\\x{{00a0}}]+', ' ', 'g'))"


@query(f"SELECT page_id, length({STRIP.format('html')}) AS n_chars, sha256({STRIP.format('html')}) AS text_sha256 FROM pages")
def html_strip(spark, sf_dir):
    """PAR-09: visible text of every page."""
    rows = table(spark, sf_dir, "pages").select("page_id", P.strip_tags(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


@query(f"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)(<a\\b[^>]*>.*?</a>)', 1) AS a FROM pages)
SELECT page_id, len(a) AS n_links, array_to_string(list_transform(a, lambda x: regexp_extract(x, '(?is)href\\s*=\\s*["'']([^"'']*)["'']', 1)), '|') AS hrefs, array_to_string(list_transform(a, lambda x: {STRIP.format('x')}), '|') AS texts FROM l
""")
def html_links(spark, sf_dir):
    """PAR-10, PAR-13: anchors of every page."""
    rows = table(spark, sf_dir, "pages").select("page_id", P.links(F.col("html")).alias("a"))
    return rows.select("page_id", F.size("a").cast("long").alias("n_links"), F.array_join(F.transform("a", lambda x: x["href"]), "|").alias("hrefs"), F.array_join(F.transform("a", lambda x: x["text"]), "|").alias("texts"))


BREAKS = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?i)</(?:p|div|blockquote|pre|li|h[1-6]|tr|td)>|<br\\s*/?>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"
for _entity, _char in P.BREAK_ENTITIES:
    BREAKS = f"replace({BREAKS}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"


@query(f"""
WITH p AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1), lambda x: {STRIP.format('x')}), lambda x: length(x) > 40)[1:40] AS b,
  list_filter(list_transform(string_split_regex(replace({BREAKS}, chr(13), chr(10)), '\\n+'), lambda x: {SQUEEZE.format('x')}), lambda x: length(x) > 80)[1:80] AS dense FROM pages),
k AS (SELECT page_id, CASE WHEN len(b) > 0 THEN b ELSE dense END AS b FROM p)
SELECT page_id, len(b) AS n_blocks, sha256(array_to_string(b, '|')) AS blocks_sha256 FROM k
""")
def html_detail(spark, sf_dir):
    """PAR-14: body blocks of every page (no page here has preformatted text or quotations)."""
    rows = table(spark, sf_dir, "pages").select("page_id", P.body_blocks(F.col("html")).alias("b"))
    return rows.select("page_id", F.size("b").cast("long").alias("n_blocks"), F.sha2(F.array_join("b", "|"), 256).alias("blocks_sha256"))


EVIDENCE = {"relation": "with|dans", "polarity": "the|les", "hook": "and|des", "role": "zzz", "chain": "zzz"}


@query(f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[\\n.!?]+'), lambda x: {SQUEEZE.format('x')}), lambda x: length(x) > 30) AS s FROM documents),
e AS (SELECT doc_id, list_filter(s, lambda x: (regexp_matches(lower(x), 'with|dans') AND regexp_matches(lower(x), 'and|des')) OR (regexp_matches(lower(x), 'the|les') AND regexp_matches(lower(x), 'and|des')) OR (regexp_matches(lower(x), 'with|dans') AND regexp_matches(lower(x), 'the|les')))[1:28] AS w FROM s)
SELECT doc_id, len(w) AS n_windows, sha256(array_to_string(w, '|')) AS windows_sha256 FROM e
""")
def evidence_windows(spark, sf_dir):
    """PAR-15: sentences with two kinds of cues, with cues of this corpus."""
    rows = table(spark, sf_dir, "documents").select("doc_id", P.evidence_windows(F.array("text"), 28, EVIDENCE).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_windows"), F.sha2(F.array_join("w", "|"), 256).alias("windows_sha256"))


#: What pages get at their end, by their number.
MARKS = ["", "<div class='CF-Turnstile'></div>", "<p>No Matching Results</p>", "<title>Just a moment...</title><p>no matching results</p>", "<script src=/cdn-cgi/challenge-platform/h></script>"]


@query(f"""
WITH p AS (SELECT page_id, html || [{', '.join("'" + m.replace("'", "''") + "'" for m in MARKS)}][1 + page_id % {len(MARKS)}] AS html FROM pages)
SELECT page_id, regexp_matches(lower(html), 'attention required|just a moment|cf-chl|cloudflare|cdn-cgi/challenge-platform|__cf_chl|cf-turnstile|cf_clearance|checking your browser|verify you are human') AS challenged, regexp_matches(html, '(?i)no matching results') AS no_match FROM p
""")
def page_checks(spark, sf_dir):
    """FLT-13: challenge pages and pages without a match, with marks put at the pages' ends."""
    mark = F.get(F.array(*[F.lit(m) for m in MARKS]), (F.col("page_id") % len(MARKS)).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("html", mark).alias("html"))
    return pages.select("page_id", P.challenged(F.col("html")).alias("challenged"), F.col("html").rlike("(?i)no matching results").alias("no_match"))


def _title_tokens(name: str, key: str, text: str, source: str) -> str:
    """SQL of the first ten distinct title tokens of each row."""
    return f"""{name}_all AS (SELECT k, t, min(i) AS i FROM (SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS t, generate_subscripts(regexp_extract_all(lower({text}), '[a-z0-9]+'), 1) AS i FROM {source}) WHERE length(t) >= 3 AND NOT list_contains({sql_stop(X.TITLE_STOP)}, t) GROUP BY ALL),
{name} AS (SELECT k, t FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS r FROM {name}_all) WHERE r <= 10)"""


@query(f"""
WITH {_title_tokens('l', 'page_id', "regexp_extract(html, '(?is)<title>(.*?)</title>', 1)", 'pages')}, {_title_tokens('r', 'doc_id', 'text', 'documents')},
n AS (SELECT k, count(*) AS n FROM l GROUP BY k), c AS (SELECT l.k AS left_id, r.k AS right_id, round(count(*) / any_value(n.n), 6) AS score FROM l JOIN r USING (t) JOIN n ON n.k = l.k GROUP BY ALL)
SELECT left_id, right_id, score FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS place FROM c WHERE score >= 0.35) WHERE place = 1
""")
def title_best_match(spark, sf_dir):
    """JOIN-11, SRC-07, TOK-09: the document whose beginning shares most of a page's title."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("left_id"), F.lit(None).cast("string").alias("number"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("right_id"), F.lit(None).cast("string").alias("number"), F.col("text").alias("title"))
    return L.best_title(pages, docs)


# ---------------------------------------------------------------- attempts and metrics

ATTEMPTS = """
a AS (SELECT event_id AS attempt_id, user_id, event_type, ts, value, CASE WHEN event_type = 'error' THEN 'challenge' WHEN value < 10 THEN 'limited' ELSE 'ok' END AS status,
  round(CASE WHEN value < 5 THEN 0.14 ELSE greatest(0.0, least(1.0, least(value, 16) / 16 * 0.4 + 0.45 * (event_id % 4) / 4.0 - 0.18 * (event_id % 3) / 3.0 - CASE WHEN event_type = 'error' THEN 0.22 ELSE 0.0 END)) END, 6) AS utility FROM events)
"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    error = F.col("event_type") == "error"
    status = F.when(error, "challenge").when(F.col("value") < 10, "limited").otherwise("ok")
    utility = M.attempt_utility(F.when(F.col("value") < 5, 0.0).otherwise(F.col("value")), F.lit(1), (F.col("event_id") % 4) / 4.0, (F.col("event_id") % 3) / 3.0, error & (F.col("value") >= 5), F.lit(False), F.lit(False))
    return e.select(F.col("event_id").alias("attempt_id"), "user_id", "event_type", "ts", "value", status.alias("status"), F.round(utility, 6).alias("utility"), F.col("value").alias("elapsed"))


@query(f"WITH {ATTEMPTS} SELECT user_id, count(*) AS attempts, round(avg(utility), 4) AS mean_utility, arg_max(status, (ts, attempt_id)) AS last_status FROM a GROUP BY user_id")
def variant_utility(spark, sf_dir):
    """AGG-05, AGG-06, STM-02: attempts, mean utility and last status of each key."""
    return M.variant_utility(_attempts(spark, sf_dir), key="user_id", rates=("utility",))


@query(f"""
WITH RECURSIVE {ATTEMPTS}, o AS (SELECT user_id, utility, row_number() OVER (PARTITION BY user_id ORDER BY ts, attempt_id) AS n FROM a),
w AS (SELECT user_id, n, floor(utility * 1e4 + 0.5) / 1e4 AS mean FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, floor((w.mean * (o.n - 1) + o.utility) / o.n * 1e4 + 0.5) / 1e4 FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)
SELECT user_id, CAST(max(n) AS INT) AS attempts, arg_max(mean, n) AS mean FROM w GROUP BY user_id
""")
def stepwise_utility(spark, sf_dir):
    """AGG-05: the running mean rounded at each step."""
    return M.stepwise_utility(_attempts(spark, sf_dir), key="user_id")


@query(f"""
WITH {ATTEMPTS} SELECT event_type, count(*) AS attempts, count(*) FILTER (status = 'challenge') AS challenged, count(*) FILTER (status = 'limited') AS limited, count(*) FILTER (status = 'ok') AS succeeded,
  round(max(value), 4) AS max_elapsed, round(avg(value), 4) AS avg_elapsed, round(count(*) FILTER (status = 'ok') / count(*), 4) AS success_rate FROM a GROUP BY event_type
""")
def attempt_metrics(spark, sf_dir):
    """AGG-08, AGG-09: conditional counts and ratios."""
    return M.attempt_metrics(_attempts(spark, sf_dir), ["event_type"])


@query(f"WITH {ATTEMPTS} SELECT event_type AS phase, status, count(*) AS n FROM a GROUP BY ALL")
def phase_hist(spark, sf_dir):
    """AGG-07: histogram of phases and states."""
    return _attempts(spark, sf_dir).groupBy(F.col("event_type").alias("phase"), "status").agg(F.count("*").alias("n"))


@query(f"WITH {ATTEMPTS} SELECT user_id, round(avg(utility), 4) AS mean_utility, count(*) AS attempts FROM a GROUP BY user_id ORDER BY mean_utility DESC, user_id LIMIT 6")
def top_utility(spark, sf_dir):
    """AGG-19: the six keys of highest utility."""
    made = M.variant_utility(_attempts(spark, sf_dir), key="user_id", rates=("utility",))
    return made.orderBy(F.desc("mean_utility"), "user_id").limit(6).select("user_id", "mean_utility", "attempts")


@query(f"""
WITH {ATTEMPTS}, u AS (SELECT event_type, round(avg(utility), 4) AS mu, round(avg((status = 'challenge')::INT), 4) AS ch FROM a GROUP BY event_type),
v AS (SELECT e.event_id AS variant_id, e.user_id AS query_id, e.event_type, (e.event_id % 100) AS priority, u.mu, u.ch FROM events e JOIN u USING (event_type))
SELECT query_id, variant_id, round(priority + mu * 40 - ch * 14, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(priority + mu * 40 - ch * 14, 4) DESC, variant_id) AS place FROM v
""")
def adaptive_order(spark, sf_dir):
    """ORD-05, JOIN-09: variants in the order of priority and what was learned of their kind."""
    a = _attempts(spark, sf_dir)
    u = a.groupBy("event_type").agg(F.round(F.avg("utility"), 4).alias("mu"), F.round(F.avg((F.col("status") == "challenge").cast("int")), 4).alias("ch"))
    rows = a.select(F.col("attempt_id").alias("variant_id"), F.col("user_id").alias("query_id"), "event_type", (F.col("attempt_id") % 100).alias("priority")).join(u, "event_type")
    score = F.round(T.adaptive_score(F.col("priority"), F.col("mu"), F.lit(0.0), F.col("ch"), F.lit(0.0)), 4)
    return R.rank_within(rows.withColumn("score", score), ["query_id"], [F.desc("score"), F.asc("variant_id")], "place").select("query_id", "variant_id", "score", "place")


PHASE_OF = {"primary": 3, "fallback": 2, "rescue": 1, "micro": 1, "revolving": 1}


@query("""
WITH v AS (SELECT p_partkey AS variant_id, p_size AS query_id, (p_partkey * 7) % 90 AS priority, ['primary', 'fallback', 'rescue', 'micro', 'revolving'][1 + p_partkey % 5] AS phase FROM part),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, phase ORDER BY variant_id) AS place FROM v),
k AS (SELECT *, CASE phase WHEN 'primary' THEN 3 WHEN 'fallback' THEN 2 ELSE 1 END AS lim, list_position(['primary', 'fallback', 'rescue', 'micro', 'revolving'], phase) AS ix FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ix, priority DESC, variant_id) AS run_ix FROM k WHERE place <= lim)
SELECT query_id, variant_id, phase, priority, run_ix FROM r WHERE run_ix <= 6
""")
def phase_budget(spark, sf_dir):
    """ORD-06, STM-11: parts as variants; each phase's limit cuts by input order, then the order of scores holds (D6)."""
    v = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("variant_id"), F.col("p_size").alias("query_id"), ((F.col("p_partkey") * 7) % 90).alias("priority"), F.get(F.array(*[F.lit(p) for p in PHASE_OF]), (F.col("p_partkey") % 5).cast("int")).alias("phase"))
    return T.phase_budget(v, PHASE_OF, 6, order="variant_id").select("query_id", "variant_id", "phase", "priority", "run_ix")


@query(f"""
WITH {OVERLAP}, c AS (SELECT r.query_id, r.doc_id, r.score, CASE WHEN d.lang = 'en' THEN 'SC' WHEN d.lang = 'de' THEN 'HC' ELSE 'UNKNOWN' END AS court, coalesce(l.quality, 0) AS q FROM ranked r JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id) WHERE rank <= 10),
n AS (SELECT query_id, count(*) AS n_cases, round(avg(score), 3) AS avg_score, round(avg(q), 3) AS verification_coverage, count(*) FILTER (court = 'SC') AS sc_count, count(*) FILTER (court = 'HC') AS hc_count, count(*) FILTER (court = 'UNKNOWN') AS un, arg_max(doc_id, (score, -doc_id)) AS top_doc, max(score) AS top_score FROM c GROUP BY query_id)
SELECT query_id, n_cases, avg_score, verification_coverage, sc_count, hc_count, CASE WHEN sc_count >= hc_count AND sc_count >= un THEN 'SC' WHEN hc_count >= sc_count AND hc_count >= un THEN 'HC' ELSE 'UNKNOWN' END AS dominant_court, top_doc, top_score FROM n
""")
def insights(spark, sf_dir):
    """AGG-10, AGG-12: result quality of each passage."""
    top = _lexical(spark, sf_dir, 10).join(table(spark, sf_dir, "documents").select("doc_id", _court().alias("court")), "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    made = M.insights(top.withColumn("detail_checked", F.coalesce("quality", F.lit(0)) == 1))
    return made.select("query_id", "n_cases", "avg_score", "verification_coverage", "sc_count", "hc_count", "dominant_court", "top_doc", "top_score")


@query("""
WITH r AS (SELECT conv_id, count(*) AS cases, avg(length(text)) / 1000 AS avg_score, bool_or(contains(lower(text), 'sorry')) AS blocked FROM conversations GROUP BY conv_id)
SELECT count(*) AS total_runs, round(avg((cases > 0)::INT), 4) AS success_rate, round(avg(cases), 4) AS avg_cases, round(avg(avg_score), 4) AS avg_score, count(*) FILTER (blocked) AS blocked_runs FROM r
""")
def session_summary(spark, sf_dir):
    """AGG-13, AGG-14: conversations as runs."""
    runs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("cases"), (F.avg(F.length("text")) / 1000).alias("avg_score"), F.bool_or(F.contains(F.lower("text"), F.lit("sorry"))).alias("blocked"))
    return M.session_summary(runs)


@query("""
WITH i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS place FROM (SELECT DISTINCT item_id FROM benchmark)), n AS (SELECT count(*) AS n FROM i),
f AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 7))) AS hook FROM benchmark),
d AS (SELECT item_id, text FROM documents, n JOIN i ON i.place = documents.doc_id % n.n),
k AS (SELECT item_id, hook, bool_or(coalesce(contains(lower(d.text), hook), false)) AS kept FROM f LEFT JOIN d USING (item_id) GROUP BY ALL)
SELECT count(*) AS hooks, count(*) FILTER (kept) AS kept, round(100.0 * count(*) FILTER (kept) / count(*), 3) AS retention, round(100.0 * count(*) FILTER (kept) / count(*), 3) >= 95.0 AS passed FROM k
""")
def eval_retention(spark, sf_dir):
    """AGG-15: share of each passage's long words that the documents dealt to it keep."""
    from pyspark.sql.window import Window

    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), X.Tokenizer(least=7).distinct(F.col("text")).alias("hooks"))
    ids = items.select("query_id").distinct()
    places = ids.select("query_id", (F.row_number().over(Window.orderBy("query_id")) - 1).alias("place"))  # of stated queries only
    n_items = ids.agg(F.nullif(F.count("*"), F.lit(0)).alias("n_items"))
    dealt = table(spark, sf_dir, "documents").crossJoin(F.broadcast(n_items)).select(F.pmod("doc_id", "n_items").alias("place"), F.col("text").alias("phrase"))
    return M.retention(items, dealt.join(F.broadcast(places), "place").select("query_id", "phrase"))


@query("""
WITH r AS (SELECT l_orderkey, count(*) AS expected, count(*) FILTER (l_returnflag = 'R') AS found, count(*) AS phrases, count(*) FILTER (l_linestatus = 'F') AS strict FROM lineitem GROUP BY l_orderkey),
g AS (SELECT count(*) AS queries, round(avg(found / expected), 4) AS coverage_at_50, round(avg((strict = 0 OR phrases < 5)::INT), 4) AS no_match_rate FROM r)
SELECT *, round((coverage_at_50 - 0.2) / 0.2, 4) AS coverage_gain, round((coverage_at_50 - 0.2) / 0.2, 4) >= 0.30 AS coverage_passed, round((0.9 - no_match_rate) / 0.9, 4) AS no_match_drop, round((0.9 - no_match_rate) / 0.9, 4) >= 0.35 AS no_match_passed FROM g
""")
def eval_coverage(spark, sf_dir):
    """AGG-16: coverage and no-match gates against a baseline, with orders as questions."""
    runs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("expected"), F.count_if(F.col("l_returnflag") == "R").alias("found"), F.count("*").alias("phrases"), F.count_if(F.col("l_linestatus") == "F").alias("strict"))
    return M.coverage_gates(runs, 0.2, 0.9)


@query("""
WITH p AS (SELECT user_id AS query_id, date_trunc('day', ts) AS day, dense_rank() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts)) AS phase_ix, event_type FROM events),
c AS (SELECT query_id, phase_ix, count(*) FILTER (event_type = 'purchase') AS strict, count(*) FILTER (event_type = 'click') AS provisional, count(*) AS details FROM p GROUP BY ALL),
s AS (SELECT query_id, phase_ix, sum(strict) OVER w AS s, sum(provisional) OVER w AS p, sum(details) OVER w AS d FROM c WINDOW w AS (PARTITION BY query_id ORDER BY phase_ix ROWS UNBOUNDED PRECEDING))
SELECT query_id, min(phase_ix) FILTER ((s >= 4 OR s + p >= 4) AND d >= 2) AS stop_phase, max(phase_ix) AS last_phase FROM s GROUP BY query_id
""")
def early_stop(spark, sf_dir):
    """WIN-06: the day on which a user had enough, from running totals."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    days = e.groupBy(F.col("user_id").alias("query_id"), "day").agg(F.count_if(F.col("event_type") == "purchase").alias("strict"), F.count_if(F.col("event_type") == "click").alias("provisional"), F.count("*").alias("details"))
    days = days.withColumn("phase_ix", F.row_number().over(Window.partitionBy("query_id").orderBy("day")))
    return M.early_stop(days)


# ---------------------------------------------------------------- state over time

BLOCKED = "event_type = 'error' OR value < 20"


def _blocked() -> Column:
    return (F.col("event_type") == "error") | (F.col("value") < 20)


@query("""
WITH w AS (SELECT event_id, user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, ts FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_start ORDER BY ts, event_id) AS place FROM w)
SELECT event_id, user_id, window_start, place, place > 2 AS rejected FROM r
""")
def rate_limit_tumbling(spark, sf_dir):
    """STM-04, SRC-15: requests of each user in tumbling windows, two of which pass."""
    made = T.rate_limit(table(spark, sf_dir, "events"), key="user_id", window="6 hours", limit=2)
    return made.select("event_id", "user_id", "window_start", "place", "rejected")


@query(f"""
WITH b AS (SELECT *, ({BLOCKED}) AS blocked FROM events),
i AS (SELECT *, sum((NOT blocked)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT event_id, user_id, CAST(sum(blocked::INT) OVER w AS BIGINT) AS blocked_count, sum(blocked::INT) OVER w >= 3 AS stopped FROM i WINDOW w AS (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def blocked_islands(spark, sf_dir):
    """STM-03: blocked attempts since the last success."""
    return T.blocked_runs(table(spark, sf_dir, "events"), key="user_id", blocked=_blocked()).select("event_id", "user_id", "blocked_count", "stopped")


@query(f"""
WITH b AS (SELECT *, ({BLOCKED}) AS blocked FROM events), i AS (SELECT *, sum((NOT blocked)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM b),
f AS (SELECT *, sum(blocked::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM i),
o AS (SELECT *, max(CASE WHEN failures >= 2 THEN ts END) OVER w AS opened, max(CASE WHEN failures = 0 THEN ts END) OVER w AS reset FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, user_id, CAST(failures AS BIGINT) AS failures, coalesce(opened IS NOT NULL AND (reset IS NULL OR opened > reset) AND epoch(ts) < epoch(opened) + 86400, false) AS open FROM o
""")
def circuit_breaker(spark, sf_dir):
    """STM-06: whether the breaker is open at each event; two failures open it for a day."""
    made = T.circuit_breaker(table(spark, sf_dir, "events"), key="user_id", failed=_blocked(), open_seconds=86400)
    return made.select("event_id", "user_id", "failures", "open")


@query("""
WITH u AS (SELECT *, CASE WHEN event_type = 'error' THEN epoch(ts) + 3600 * value END AS until FROM events),
w AS (SELECT *, max(until) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wait_until FROM u)
SELECT event_id, user_id, round(greatest(coalesce(wait_until - epoch(ts), 0.0), 0.0), 3) AS remaining FROM w
""")
def cooldown_running_max(spark, sf_dir):
    """STM-05: how long a user still has to wait."""
    made = T.cooldowns(table(spark, sf_dir, "events"), key="user_id", wait=F.when(F.col("event_type") == "error", 3600 * F.col("value")).otherwise(0.0))
    return made.select("event_id", "user_id", "remaining")


@query("""
WITH c AS (SELECT user_id AS k, ts AS fetched_at, value FROM events WHERE event_type = 'view'), r AS (SELECT event_id AS request_id, user_id AS k, ts FROM events WHERE event_type = 'purchase')
SELECT r.request_id, arg_max(c.value, (c.fetched_at, c.value)) AS value, max(c.fetched_at) AS fetched_at FROM r LEFT JOIN c ON c.k = r.k AND epoch(r.ts) - epoch(c.fetched_at) BETWEEN 0 AND 172800 GROUP BY r.request_id
""")
def ttl_lookup(spark, sf_dir):
    """JOIN-16, STM-07: the latest view of the same user in the two days before a purchase."""
    e = table(spark, sf_dir, "events")
    cache = e.where("event_type = 'view'").select(F.col("user_id").alias("key"), F.col("ts").alias("fetched_at"), "value")
    requests = e.where("event_type = 'purchase'").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("key"), "ts")
    return L.valid_lookup(requests, cache, 172800).select("request_id", "value", "fetched_at")


@query("""
WITH l AS (SELECT user_id, event_type, max((ts, event_id)) AS last FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS place FROM l)
SELECT user_id, event_type, last[1] AS ts, place FROM r WHERE place <= 2
""")
def recency_ring(spark, sf_dir):
    """STM-10, SRC-18: the two kinds of events that each user had last."""
    return T.recency_ring(table(spark, sf_dir, "events"), owner="user_id", item="event_type", size=2)


@query("""
SELECT event_type || '|' || user_id AS signature, arg_min(event_id, (ts, event_id)) AS first_event, count(*) AS n, count(*) - 1 AS skipped FROM events GROUP BY 1
""")
def repeated_requests(spark, sf_dir):
    """STM-08, STM-09: repeated requests and the one that runs."""
    return T.first_requests(table(spark, sf_dir, "events"), F.concat_ws("|", "event_type", F.col("user_id").cast("string")))


@query("""
WITH r AS (SELECT event_id, user_id, count(*) OVER w AS attempt_no, round(sum(value) OVER w, 4) AS spent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, user_id, attempt_no, spent, CASE WHEN attempt_no > 8 THEN 'budget_exhausted' WHEN spent > 400 THEN 'timeout' END AS stop_reason FROM r
""")
def spent_budget(spark, sf_dir):
    """STM-11: attempts and time against their budgets."""
    made = T.spent_budget(table(spark, sf_dir, "events"), group="user_id", cost=F.col("value"), order=["ts", "event_id"], most_attempts=8, most_cost=400)
    return made.select("event_id", "user_id", "attempt_no", "spent", "stop_reason")


@query("""
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts) - epoch(lag(ts) OVER w) >= 86400 THEN 1 ELSE 0 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 DAY AS session_end, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s.s
""")
def session_windows(spark, sf_dir):
    """An extension: sessions of each user that end after a day."""
    return T.sessions(table(spark, sf_dir, "events"), key="user_id", gap="1 day")


# ---------------------------------------------------------------- questions

USER = "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


#: Pieces of questions; a part's number chooses one of each, so that every branch of the question operators occurs.
PIECES = [
    (4, 1, ["Whether the State's", "Can a department's", "Show cases where an accused's", "Find a"]),
    (4, 4, ["criminal appeal", "revision petition", "discharge application", "matter"]),
    (4, 16, ["under section 197 crpc", "under section 19 of the prevention of corruption act", "under section 5 of the limitation act or section 302 ipc", ""]),
    (5, 1, ["was dismissed as time barred", "was allowed", "can be quashed without sanction", "met with delay not condoned", "is discussed"]),
    (4, 5, ["in the supreme court", "before a high court", "in the supreme court or a high court", ""]),
    (4, 7, ["in 2019", "in march 2015", "since 1998", ""]),
]
_CHOSEN = ", ".join(f"[{', '.join(repr(x) if chr(39) not in x else chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in xs)}][1 + p_partkey // {step} % {n}]" for n, step, xs in PIECES)
#: (conv_id, turn, text) of the questions made of parts.
MADE = f"SELECT p_partkey AS conv_id, 0 AS turn, array_to_string([{_CHOSEN}], ' ') AS text FROM part"


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    chosen = [F.get(F.array(*[F.lit(x) for x in xs]), (F.floor(k / step) % n).cast("int")) for n, step, xs in PIECES]
    return table(spark, sf_dir, "part").select(k.alias("conv_id"), F.lit(0).alias("turn"), F.concat_ws(" ", *chosen).alias("text"))


@query(f"""
WITH m AS ({MADE}), u AS (SELECT conv_id, turn, lower(text) AS t FROM m), y AS (SELECT *, TRY_CAST(nullif(regexp_extract(t, '(?:^|[^0-9a-z_])(19[5-9][0-9]|20[0-9]{{2}})(?:[^0-9a-z_]|$)', 1), '') AS INT) AS y FROM u)
SELECT conv_id, turn, CASE WHEN y IS NOT NULL AND NOT regexp_matches(t, '(?:^|[^a-z0-9_])(january|february|march|april|may|june|july|august|september|october|november|december)(?:[^a-z0-9_]|$)|month[: ]') THEN make_date(y, 1, 1) WHEN y IS NOT NULL AND contains(t, 'march') THEN make_date(y, 3, 1) END AS from_date,
  CASE WHEN regexp_matches(t, '(^|[^a-z0-9_])(?:supreme court|sc)([^a-z0-9_]|$)') AND NOT regexp_matches(t, '(^|[^a-z0-9_])(?:high court|hc)([^a-z0-9_]|$)') THEN 'SC' WHEN regexp_matches(t, '(^|[^a-z0-9_])(?:high court|hc)([^a-z0-9_]|$)') AND NOT regexp_matches(t, '(^|[^a-z0-9_])(?:supreme court|sc)([^a-z0-9_]|$)') THEN 'HC' ELSE 'ANY' END AS court_hint FROM y
""")
def question_hints(spark, sf_dir):
    """QRY-11, QRY-12: year, month and court that a question mentions, in questions made of parts."""
    made = _made(spark, sf_dir).withColumn("w", Q.date_window(F.col("text")))
    return made.select("conv_id", "turn", F.col("w.from_date").alias("from_date"), Q.court_hint(F.col("text")).alias("court_hint"))


COACH_ACTORS, COACH_PROCEDURES = {"a": ["the "], "b": [" der "]}, {"p": ["and"], "q": ["que"]}


_COACHED = "SELECT p_partkey AS conv_id, 0 AS turn, concat_ws(' ', 'when', CASE WHEN p_partkey % 2 = 0 THEN 'the state' END, CASE WHEN p_partkey % 3 = 0 THEN 'and later' END, CASE WHEN p_partkey % 5 < 2 THEN 'without reasons' END, CASE WHEN p_partkey % 7 < 2 THEN 'under section 302 ipc' END) AS text FROM part"


@query(f"""
WITH m AS ({_COACHED}),
c AS (SELECT conv_id, turn, contains(text, 'the ') AS actor, contains(text, 'and') AS proceeding, contains(text, 'without') AS ex, contains(text, 'section') AS hook FROM m),
s AS (SELECT *, round((CASE WHEN proceeding THEN 0.32 ELSE 0 END) + (CASE WHEN ex THEN 0.28 ELSE 0 END) + (CASE WHEN actor THEN 0.22 ELSE 0 END) + (CASE WHEN hook THEN 0.13 ELSE 0 END) + (CASE WHEN ex THEN 0.05 ELSE 0 END), 3) AS score FROM c)
SELECT conv_id, turn, score AS coach_score, CASE WHEN NOT ex AND NOT hook THEN 'WEAK' WHEN NOT proceeding AND score >= 0.5 THEN 'FAIR' WHEN NOT proceeding THEN 'WEAK' WHEN score >= 0.75 THEN 'STRONG' WHEN score >= 0.5 THEN 'FAIR' ELSE 'WEAK' END AS grade,
  CASE WHEN actor AND proceeding THEN CASE WHEN ex OR hook THEN 'READY_FOR_EXACT' ELSE 'NEEDS_SPECIFICITY' END ELSE 'NOT_READY' END AS readiness FROM s
""")
def coach_score(spark, sf_dir):
    """QRY-32: how complete a question is, with a small lexicon, in questions made of parts."""
    k = F.col("p_partkey")
    text = F.concat_ws(" ", F.lit("when"), F.when(k % 2 == 0, "the state"), F.when(k % 3 == 0, "and later"), F.when(k % 5 < 2, "without reasons"), F.when(k % 7 < 2, "under section 302 ipc"))
    made = table(spark, sf_dir, "part").select(k.alias("conv_id"), F.lit(0).alias("turn"), text.alias("text"))
    made = Q.coach(Q.intent_profile(made, actors=COACH_ACTORS, procedures=COACH_PROCEDURES, issues={"never": "zzzz"}))
    return made.select("conv_id", "turn", F.round("coach_score", 3).alias("coach_score"), "grade", "readiness")


@query()
def question_intents(spark, sf_dir):
    """QRY-01..16: intents of all questions and of those made of parts; a plain version of the parts is in the tests."""

    def told(texts: DataFrame) -> DataFrame:
        made = Q.intent_profile(texts)
        return made.select("query_id", "cleaned", F.array_join("statutes", "|").alias("statutes"), F.array_join("issues", "|").alias("issues"), "either", "polarity", "court_hint", F.size("anchors").alias("n_anchors"))

    return Q.once_a_text(_every_question(spark, sf_dir), told).drop("text")


def _every_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, text) of the conversations' questions, and of those made of parts, with turn -1."""
    own = _questions(spark, sf_dir).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text")
    return own.union(_made(spark, sf_dir).select(F.col("conv_id").cast("long"), F.lit(-1).cast("long"), "text"))


def _of_questions(spark: SparkSession, sf_dir: str, told) -> DataFrame:
    """What `told` makes of the checklists of the texts, for every question; (conv_id, turn) is that of one question."""
    asked = _every_question(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text")
    return Q.once_a_text(asked, lambda texts: told(K.build_checklists(Q.intent_profile(texts)))).drop("text")


@query()
def question_checklists(spark, sf_dir):
    """QRY-36: the checklist of every question; the tests compare with a plain version."""
    c = F.col("checklist")
    return _of_questions(spark, sf_dir, lambda made: made.select("query_id", F.size(F.filter(c["axes"], lambda a: a["required"])).alias("n_axes"), F.size(c["groups"]).alias("n_groups"), F.size(c["relations"]).alias("n_relations"), c["polarity"].alias("polarity"), F.size(c["steps"]).alias("n_steps"), F.to_json(c).alias("checklist")))


@query()
def query_variants(spark, sf_dir):
    """QRY-17..24, AGG-18: guarded variants of all questions over the phases; the tests compare with a plain version of the guards."""
    planned = lambda made: V.planned_variants(V.keyword_pack(V.canonical_intent(made)))
    return _of_questions(spark, sf_dir, lambda made: C.merge_variants(planned(made)).select("query_id", "phase", "variant_id", "phrase", "strictness", "priority", "merged"))


@query("""
WITH u AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 3) AS k FROM conversations WHERE role = 'user'),
p AS (SELECT conv_id, turn, list_filter(k, lambda t: length(t) >= 7) AS must, list_filter(k, lambda t: length(t) BETWEEN 4 AND 6) AS maybe, list_filter(k, lambda t: length(t) = 3) AS never FROM u)
SELECT conv_id, turn, array_to_string(must, ' ANDD ') || CASE WHEN len(maybe) > 0 THEN CASE WHEN len(must) > 0 THEN ' ANDD ' ELSE '' END || '(' || array_to_string(maybe, ' ORR ') || ')' ELSE '' END || array_to_string(list_transform(never, lambda t: ' NOTT ' || t), '') AS compiled FROM p
""")
def boolean_queries(spark, sf_dir):
    """QRY-31: questions as strings of the boolean dialect: long words have to be there, short ones must not."""
    rows = _questions(spark, sf_dir).withColumn("k", X.RERANK.all(F.col("text")))
    long, some, short = (F.filter("k", test) for test in (lambda t: F.length(t) >= 7, lambda t: F.length(t).between(4, 6), lambda t: F.length(t) == 3))
    return rows.select("conv_id", "turn", Q.boolean_query(long, some, short).alias("compiled"))


_SIGNED = "list_sort(list_distinct(list_transform(k[1:{n}], lambda t: left(sha256(t), 16))))"


def _recall_level(level: int, name: str) -> str:
    return f"SELECT q.conv_id AS query_id, e.conv_id || '-' || e.turn AS entry_id, {level} AS ix, '{name}' AS level, round(len(list_intersect(q.{name}, e.{name})) / (len(q.{name}) + len(e.{name}) - len(list_intersect(q.{name}, e.{name}))), 6) AS score FROM q JOIN e ON len(list_intersect(q.{name}, e.{name})) > 0 AND 100 * len(list_intersect(q.{name}, e.{name})) >= 55 * (len(q.{name}) + len(e.{name}) - len(list_intersect(q.{name}, e.{name})))"


#: For each part a stored question of ten words (turn 1), and one that shares its first 10, 8, 5, 4 or none of them (turn 0): the levels of recall.
RECALLED = """SELECT p_partkey AS conv_id, 1 AS turn, array_to_string([p_partkey || 'w' || j FOR j IN range(1, 11)], ' ') AS text FROM part UNION ALL
SELECT p_partkey, 0, array_to_string([CASE WHEN j <= [10, 8, 5, 4, 0][1 + p_partkey % 5] THEN p_partkey || 'w' || j ELSE p_partkey || 'z' || j END FOR j IN range(1, 11)], ' ') FROM part"""


@query(f"""
WITH m AS ({RECALLED}), u AS (SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS clean, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 2) AS k FROM m),
s AS (SELECT conv_id, turn, left(sha256(clean), 32) AS h, {_SIGNED.format(n=8)} AS "full", {_SIGNED.format(n=6)} AS medium, {_SIGNED.format(n=4)} AS broad FROM u), q AS (SELECT * FROM s WHERE turn = 0), e AS (SELECT * FROM s WHERE turn > 0),
f AS (SELECT q.conv_id AS query_id, e.conv_id || '-' || e.turn AS entry_id, 0 AS ix, 'exact' AS level, 1.0 AS score FROM q JOIN e USING (h) UNION ALL {_recall_level(1, '"full"').replace("'" + '"full"' + "' AS level", "'full' AS level")} UNION ALL {_recall_level(2, 'medium')} UNION ALL {_recall_level(3, 'broad')})
SELECT query_id, entry_id, level, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ix, score DESC, entry_id) AS place FROM f) WHERE place = 1
""")
def recall_lookup(spark, sf_dir):
    """JOIN-10, FBK-02: for each part's question, the stored question it is nearest to, by the exact text and the three levels."""
    k = F.col("p_partkey")
    same = F.get(F.array(*[F.lit(n) for n in (10, 8, 5, 4, 0)]), (k % 5).cast("int"))
    ten = F.sequence(F.lit(1), F.lit(10))
    stored = F.transform(ten, lambda j: F.concat(k.cast("string"), F.lit("w"), j.cast("string")))
    asked = F.transform(ten, lambda j: F.concat(k.cast("string"), F.when(j <= same, "w").otherwise("z"), j.cast("string")))
    both = table(spark, sf_dir, "part").select(k.alias("conv_id"), F.posexplode(F.array(F.array_join(asked, " "), F.array_join(stored, " "))).alias("turn", "query"))
    asked = L.signatures(both)
    first = asked.where("turn = 0").withColumnRenamed("conv_id", "query_id")
    stored = asked.where("turn > 0").withColumn("entry_id", F.concat_ws("-", "conv_id", "turn"))
    return L.recall_lookup(first, stored)


#: A lexicon of this corpus for the flagship's checklists.
CORPUS_LEXICON = {"actors": {"state": ["the "], "department": [" der "]}, "procedures": {"appeal": ["tion"], "trial": ["und"]}, "issues": {"delay condoned": "in", "discharge": "que"}}


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = table(spark, sf_dir, "documents"), _benchmark(spark, sf_dir)
    vectors = I.embed_with_model(docs.select(F.col("doc_id").alias("id"), "text")).select("id", "vector")
    wanted = I.embed_with_model(asked, passage=False).select("query_id", "vector")
    index = OverlapIndex.build(docs.select("doc_id", "text"), index_path(spark, "overlap-index"))
    return plan.search(asked, docs, vectors=vectors, query_vectors=wanted, index=index, court=_court(), lexicons=CORPUS_LEXICON)


@query()
def search_pipeline(spark, sf_dir):
    """The flagship plan: every benchmark passage as a question against all documents, by its planned variants phase by phase and by vectors, scored, gated by the checklist built from it, and diversified."""
    return _searched(spark, sf_dir).select("query_id", "doc_id", "place", "score", "band", "tier", "shown", "confidence", F.array_join("reasons", "; ").alias("reasons"))


@query(f"""
WITH {OVERLAP}, {SCORE_PARTS}, k AS (SELECT query_id, doc_id, round(squashed, 3) AS score FROM s WHERE round(squashed, 3) >= 0.27)
SELECT query_id, doc_id, score, 'exact' AS tier, NULL AS note FROM k UNION ALL SELECT item_id, NULL, 0.0, 'advisory', 'No verified result; widen the question.' FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM k)
""")
def advisory_results(spark, sf_dir):
    """FBK-01, FBK-03: results of each passage from a least score on, or one advisory row."""
    rows = _scored(spark, sf_dir).where(F.col("score") >= 0.27).select("query_id", "doc_id", "score", F.lit("exact").alias("tier"))
    return L.advisory_rows(_benchmark(spark, sf_dir), rows)


@query("""
SELECT user_id, count(*) AS attempts, round(avg(value), 4) AS mean_value FROM events GROUP BY user_id
""")
def stream_utility(spark, sf_dir):
    """STM-02: a live mean of each key, run as a stream over the events there are; micro-batches go to a table, not to the driver."""
    import uuid

    folder = f"{shared_folder(spark)}/utility-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    return T.run_to_table(T.utility_stream(stream, key="user_id", value="value"), f"{folder}/out", f"{folder}/log")


from . import more_queries, phase_queries  # noqa: E402, F401  (register their queries too)
