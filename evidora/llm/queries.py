"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chunk_dedup, decontaminate, filter_audit, jaccard_join, lang_id, license_scan, matroska, near_dedup, periodic_runs, suffix_dedup, toxicity, url_filter
from .tables import settle, table


def toxicity_categories() -> dict[str, Column]:
    """The chain's categories over `labels`, in order."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


#: Bytes of the shortest repeated string that op7 reports beside those that it removes: passages of fifty words are longer.
PASSAGE = 200

URL_RULES = [
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity_categories())
    return toxicity.score(docs, chain).select("doc_id", "p_low_quality", "p_toxic", "rejected")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, decoded="decoded")
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def url_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, bad) of all pages, by a chain fitted on the labelled documents and by their links."""
    chain = toxicity.train(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), toxicity_categories())
    return url_filter.page_labels(table(spark, sf_dir, "pages"), chain)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by their own text and links."""
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), url_labels(spark, sf_dir), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "bad_share")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.array_max(F.transform("licenses", lambda m: F.struct(m["score"].alias("score"), (-m["first"]).alias("first"), m["license"].alias("license"))))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda m: m["license"])))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), best["license"].alias("license"), best["score"].alias("score"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes go; `n_passage` tells how many bytes are in repeated strings of PASSAGE bytes, which stay."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400, passages={"passages": PASSAGE})
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return found.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("kept_bytes")).alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
        F.aggregate("passages", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"]).alias("n_passage"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.benchmark_matches(docs, table(spark, sf_dir, "benchmark"), window=10)
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    hit = decontaminate.words_hit("matches")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_dedup.dedup_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return found.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        "n_chunks",
        (n_bytes - F.octet_length("kept_bytes")).alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = matroska.store_texts(docs).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "media")
    read = matroska.read_media(stored)
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.size("packets").cast("long").alias("n_packets"),
        "error",
    )


def audit_filters(text: Column, later: Column) -> dict[str, Column]:
    """The five filters of op11 as conditions of failure."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
        "E": later,
    }


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter says is told once by text; the narrow rows then meet their group of copies and their labels."""
    text = F.coalesce("text", F.lit(""))
    said = {name: F.coalesce(c, F.lit(False)).alias(name) for name, c in audit_filters(text, F.lit(False)).items() if name != "E"}
    docs = table(spark, sf_dir, "documents")
    docs = settle(docs.select("doc_id", F.col("source").alias("part"), filter_audit.text_key(F.col("text")).alias("key"), *said.values()))
    rows = filter_audit.later_copies(docs, into="E")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(labels.withColumnRenamed("doc_id", "labelled"), F.col("doc_id") == F.col("labelled"), "left")
    told = filter_audit.audit(rows, {n: F.col(n) for n in "ABCDE"}, part=F.col("part"), marks={"good": F.col("good"), "toxic": F.col("toxic")})
    return told.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, percent=85).select("doc_id", "n_shingles", "component_id")


def with_loops(docs: DataFrame) -> DataFrame:
    """The documents, every tenth by crc32 of its id with a loop: from some word on it repeats the words from there with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    looped = docs.withColumn("__w", F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    looped = looped.withColumn("__n", F.greatest(F.size("__w"), F.lit(0)))
    looped = looped.withColumn("__a", F.when(F.col("__n") > 0, g % F.col("__n")).cast("int"))
    looped = looped.withColumn("__p", (1 + F.floor((F.col("__n") - F.col("__a")) / (3 + g % 8))).cast("int"))
    loop, rest = F.slice("__w", F.col("__a") + 1, F.col("__p")), F.col("__n") - F.col("__a")
    made = F.concat(F.slice("__w", F.lit(1), F.col("__a")), F.flatten(F.array_repeat(loop, (rest / F.col("__p")).cast("int"))), F.slice(loop, F.lit(1), rest % F.col("__p")))
    text = F.when(F.col("__n") > 0, F.array_join(made, " ")).otherwise(F.col("text"))
    return looped.withColumn("text", text).drop("__w", "__n", "__a", "__p")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_loops(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # runs come by start and then period, so the first of the greatest exponent is kept
    longest = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{n}").alias(n) for n in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, n, i, a || ' ' || lead(a, 1) OVER p || ' ' || lead(a, 2) OVER p AS g FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
sh AS (SELECT DISTINCT doc_id, g FROM g WHERE g IS NOT NULL UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2),
c AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN c AS cx ON cx.doc_id = x JOIN c AS cy ON cy.doc_id = y WHERE 100 * k >= 85 * (cx.n + cy.n - k)),
both AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
r AS (SELECT doc_id AS doc, doc_id AS reached FROM w UNION SELECT r.doc, b.y FROM r JOIN both b ON b.x = r.reached),
m AS (SELECT doc, min(reached) AS component_id FROM r GROUP BY doc)
SELECT doc AS doc_id, coalesce(c.n, 0) AS n_shingles, component_id, doc = component_id AS kept FROM m LEFT JOIN c ON c.doc_id = m.doc
""".replace("both AS", "sym AS").replace("JOIN both b", "JOIN sym b")

OP8_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bu AS (SELECT item_id, least(10, len(w)) AS n, unnest(w) AS a, generate_subscripts(w, 1) AS i, len(w) AS total FROM b),
bg AS (SELECT item_id, n, i, total, string_agg(a, ' ') OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND (n - 1) FOLLOWING) AS g FROM bu),
items AS (SELECT DISTINCT item_id, n, g FROM bg WHERE i + n - 1 <= total),
du AS (SELECT doc_id, n, unnest(w) AS a, generate_subscripts(w, 1) AS i, len(w) AS total FROM d, (SELECT DISTINCT n FROM items)),
dg AS (SELECT doc_id, n, i, total, string_agg(a, ' ') OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN CURRENT ROW AND (n - 1) FOLLOWING) AS g FROM du),
hits AS (SELECT doc_id, i, n, item_id FROM dg JOIN items USING (n, g) WHERE i + n - 1 <= total),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


OP11_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
least_id AS (SELECT text, min(doc_id) AS least_id FROM t GROUP BY text),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text), regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > least_id, false)] AS fails
  FROM w JOIN least_id USING (text) LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE position(x IN filter_order) = 0),
s AS (SELECT filter_order, step, ascii(substr(filter_order, CAST(step AS INT), 1)) - 64 AS k, [ascii(substr(filter_order, CAST(i AS INT), 1)) - 64 FOR i IN range(1, step)] AS before
  FROM o, range(1, 6) AS r(step) WHERE length(filter_order) = 5),
m AS (SELECT part, filter_order, step, k, fails[k] AS own, list_bool_or([fails[i] FOR i IN before]) IS TRUE AS gone, list_sum(CAST(fails AS INT[])) = 1 AS alone, n, good, toxic FROM c, s),
r AS (SELECT part, filter_order, CAST(step AS INT) AS step, k,
  coalesce(sum(n) FILTER (NOT gone AND NOT own), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (own AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (own AND alone), 0) AS unique_fails, coalesce(sum(good) FILTER (own AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT gone), 0) AS toxic_lost
  FROM m GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM r
"""

_OP12_SETS = """
g AS (SELECT doc_id, n, i, a || ' ' || lead(a, 1) OVER p || ' ' || lead(a, 2) OVER p || ' ' || lead(a, 3) OVER p AS g FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
sh AS (SELECT DISTINCT doc_id, g FROM g WHERE g IS NOT NULL UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 3),"""
#: As for op6, with sets of four words.
OP12_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),{_OP12_SETS}
c AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN c AS cx ON cx.doc_id = x JOIN c AS cy ON cy.doc_id = y WHERE 100 * k >= 85 * (cx.n + cy.n - k)),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
r AS (SELECT doc_id AS doc, doc_id AS reached FROM w UNION SELECT r.doc, b.y FROM r JOIN sym b ON b.x = r.reached),
m AS (SELECT doc, min(reached) AS component_id FROM r GROUP BY doc)
SELECT doc AS doc_id, coalesce(c.n, 0) AS n_shingles, component_id FROM m LEFT JOIN c ON c.doc_id = m.doc
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the whole result; the other queries are compared with brute force in the tests."""
    return {"op6_near_dedup": OP6_SQL, "op8_decontaminate": OP8_SQL, "op11_filter_audit": OP11_SQL, "op12_jaccard_join": OP12_SQL}
