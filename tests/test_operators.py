"""Operators without SQL against plain versions, and edge cases on literals."""

from __future__ import annotations

import math
import random
import re
import tempfile
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evidora.config import PROFILES, parse_flag, profile_config
from evidora.functions import hashing as H
from evidora.functions import text as X
from evidora.operators import candidates as C
from evidora.operators import gate as G
from evidora.operators import html as P
from evidora.operators import ingest as I
from evidora.operators import intent as Q
from evidora.operators import metrics as M
from evidora.operators import ranking as R
from evidora.operators import recall as L
from evidora.operators import references as N
from evidora.sources import pages as pages_source
from evidora.operators.terms import counts_against, places_of, term_places
from evidora.sources.stores import StaleVersion, VectorStore, lookup_documents, backfill_years, index_job, live_entries, pick_provider, read_fixtures
from evidora.queries import QUERIES
from evidora.streaming import state as T


def one(spark, column, **values):
    """The value of a column expression over one row."""
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


# --- configuration


def test_profiles():
    assert profile_config().elapsed_ms == 14000 and profile_config("recall_max").attempts == 10
    assert profile_config(settings={"elapsed_ms": "99999"}).elapsed_ms == 20000
    assert profile_config(settings={"attempts": "", "reasoner_calls": "0"}).attempts == 8
    assert all(profile_config(p).profile == p for p in PROFILES)
    assert parse_flag("ON", False) and not parse_flag("no", True) and parse_flag("?", True)
    with pytest.raises(ValueError):
        profile_config("other")


# --- hashes and texts


def plain_fnv(s):
    h = 2166136261
    for c in s:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


@pytest.mark.parametrize("word", ["", "a", "section", "x" * 200])
def test_hashes(spark, word):
    assert one(spark, H.fnv1a(F.col("t")), t=word) == plain_fnv(word)
    h = 0
    for c in word:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    assert one(spark, H.poly31(F.col("t")), t=word) == h


def test_tokenisers(spark):
    assert one(spark, X.SCORING.all(F.col("t")), t="The CASE of état-major, acts; acts") == ["tat", "major", "acts", "acts"]
    assert one(spark, X.REWRITE.all(F.col("t")), t="Section 13(1)(e) a 5 x") == ["section", "13(1)(e)", "5"]
    assert one(spark, X.SCORING.all(F.col("t")), t=None) == []
    assert one(spark, X.ngrams(X.RERANK.all(F.col("t")), 3), t="one two three four") == ["one two three", "two three four"]
    assert one(spark, X.ordered_distinct(F.split("t", ",")), t="b , a,b,,a") == ["b", "a"]
    assert one(spark, X.overlap_ratio(F.array(), F.array(F.lit("a"))), t="x") == 0.0


# --- ingestion


def plain_chunks(parts, least, most):
    tied = lambda p: re.search(I.SECTION, p) or re.search(I.CITATION, p)
    out, now = [], ""
    for p in parts:
        joined = f"{now} {p}".strip()
        if not now:
            now = p
        elif len(joined) <= most:
            now = joined
        elif tied(p) and len(now) < least:
            out.append(joined[:most].strip())
            now = joined[most:].strip()
        else:
            out.append(now)
            now = p
    return [*out, now] if now else out


def test_chunks_as_a_plain_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    cited = spark.createDataFrame([(-1, ("Short one. " * 20 + "See section 197 crpc " + "and so on " * 60 + ". ") * 4)], "doc_id long, text string")
    docs = docs.union(cited)
    for least, most in ((450, 1400), (220, 340)):
        parts = {r.doc_id: r.p for r in docs.select("doc_id", I.segments(F.col("text")).alias("p")).collect()}
        got = {}
        for r in I.chunk_documents(docs, least, most).orderBy("doc_id", "chunk_ix").collect():
            got.setdefault(r.doc_id, []).append(r.text)
        assert got == {d: plain_chunks(p, least, most) for d, p in parts.items()}


def test_dense_and_sparse_embeddings_agree(spark):
    docs = spark.createDataFrame([(1, "appeal dismissed as time barred appeal"), (2, ""), (3, "a b c"), (4, None)], "doc_id long, text string")
    dense = {r.doc_id: r.v for r in I.embed(docs, out="v", dim=32).collect()}
    for d, text in ((1, "appeal dismissed as time barred appeal"), (3, "a b c")):
        plain = [0.0] * 32
        for t in re.findall("[a-z0-9]{2,}", text):
            plain[plain_fnv(t) % 32] += (1 if plain_fnv(t) % 2 == 0 else -1) * min(3.2, 1 + len(t) / 12)
        norm = math.sqrt(sum(x * x for x in plain)) or 1.0
        assert all(math.isclose(x / norm, y, abs_tol=1e-6) for x, y in zip(plain, dense[d]))
    sparse = I.hash_embedding(docs, row_id="doc_id", dim=32).collect()
    for r in sparse:
        assert math.isclose(dense[r.doc_id][r.bucket], r.value, abs_tol=1e-6)
    assert math.isclose(sum(x * x for x in dense[1]), 1, abs_tol=1e-5) and set(dense[2]) == set(dense[4]) == {0.0}


def test_normalised_rows(spark):
    raw = spark.createDataFrame(
        [("7", "State v. Roy on 3 May 2020", "Supreme Court of India", "2020-05-03", "under section 197 of the CrPC", None), (None, "Old Act", "Central Act", "5/4/2021", "x", "https://h/doc/99/"), (None, None, None, "nonsense", None, None)],
        "tid string, title string, docsource string, publishdate string, snippet string, url string",
    )
    rows = I.normalise_documents(raw).collect()
    assert [r.doc_id for r in rows] == ["7", "99", "synthetic_untitled"]
    assert [r.court for r in rows] == ["SC", "UNKNOWN", "UNKNOWN"]
    assert [str(r.decision_date) for r in rows] == ["2020-05-03", "2021-04-05", "None"]
    assert "section 197" in rows[0].statute_tokens and "crpc" in rows[0].statute_tokens and "non judgment" in rows[1].statute_tokens


def test_raw_rows_of_sources(spark):
    rows = [(7, "<b>State</b> &amp; Roy", "High Court", "2020-01-02", [("AIR 1", None), (None, "SCC 2")], "12", "b. J", "under section 5"), (None, None, None, None, None, "x", None, None)]
    df = spark.createDataFrame(rows, "tid long, caseTitle string, docsource string, judgmentDate string, citeList array<struct<value: string, cite: string>>, numcites string, coram string, summary string")
    first, second = I.raw_documents(df).collect()
    assert (first.title, first.court, first.courtName, first.decisionDate, first.bench, first.snippet) == ("State & Roy", "High Court", "High Court", "2020-01-02", "b. J", "under section 5")
    assert (first.docId, first.url, first.citations, first.numcites, second.numcites, second.docId, second.citations) == ("7", "https://example.org/doc/7/", ["AIR 1", "SCC 2"], 12, None, None, [])
    made = I.normalise_documents(I.raw_documents(df)).collect()
    assert (made[0].doc_id, made[0].court, str(made[0].decision_date), made[0].citations) == ("7", "HC", "2020-01-02", ["AIR 1", "SCC 2"]) and made[1].title == "Untitled case"


# --- ranking


def plain_diversify(rows, per_print, per_day):
    seen, prints, days, kept = set(), [], [], []
    for r in sorted(rows, key=lambda r: r["rank"]):
        keys = {k for k in r["keys"] if k}
        if keys & seen or prints.count(r["fingerprint"]) >= per_print or days.count(r["court_day"]) >= per_day:
            continue
        kept.append(r["rank"])
        seen |= keys
        prints.append(r["fingerprint"])
        days.append(r["court_day"])
    return kept


def test_diversify_as_a_plain_loop(spark):
    r = random.Random(3)
    rows = [{"query_id": q, "rank": k + 1, "keys": r.sample([None, "a", "b", "c", "d", "e", "f"], 2), "fingerprint": r.choice("xyzuvw"), "court_day": r.choice(["SC:1", "SC:2", "HC:1"])} for q in range(6) for k in range(25)]
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "query_id long, rank int, keys array<string>, fingerprint string, court_day string")
    got = R.diversify(df, max_per_fingerprint=2, max_per_court_day=3).collect()
    for q in range(6):
        want = plain_diversify([x for x in rows if x["query_id"] == q], 2, 3)
        assert sorted(x.rank for x in got if x.query_id == q) == want
        assert sorted(x.rank for x in R.diversify(df.where(F.col("query_id") == q), max_per_fingerprint=2, max_per_court_day=3, pool=25).collect()) == want


def test_diversity_of_long_chains_and_large_groups(spark):
    """Each row conflicts with the next one only; a group of thousands; unknown values claim nothing."""
    chain = [(1, k + 1, [f"k{k}", f"k{k + 1}"], f"p{k}", None) for k in range(40)]
    assert sorted(x.rank for x in R.diversify(spark.createDataFrame(chain, "query_id int, rank int, keys array<string>, fingerprint string, court_day string")).collect()) == list(range(1, 41, 2))
    r = random.Random(6)
    large = [(q, k + 1, None if k % 7 == 0 else [f"w{r.randrange(900)}", None], None if k % 5 == 0 else f"p{r.randrange(700)}", None if k % 3 == 0 else f"d{r.randrange(300)}") for q, n in ((1, 3000), (2, 5)) for k in range(n)]
    df = spark.createDataFrame(large, "query_id int, rank int, keys array<string>, fingerprint string, court_day string")
    got = R.diversify(df, max_per_court_day=2).collect()
    for q in (1, 2):
        rows = [{"rank": x[1], "keys": x[2] or [], "fingerprint": x[3] or f"none{x[1]}", "court_day": x[4] or f"none{x[1]}"} for x in large if x[0] == q]
        assert sorted(x.rank for x in got if x.query_id == q) == plain_diversify(rows, 1, 2)
    assert R.diversify(df.limit(0)).count() == 0


def plain_identity(title, snippet, court, detail, urls):
    def norm(t):
        t = re.sub(r"\bon\s+\d{1,2}\s+[a-z]{3,9},?\s+\d{4}\b", " ", (t or "").lower())
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", re.sub(r"\bvs\.?(?![a-z0-9_])", " v ", t))).strip()

    day = re.search(r"\bon\s+(\d{1,2}\s+[a-z]{3,9},?\s+\d{4})\b", title or "", re.I)
    day, keys = day[1].lower() if day else "unknown", []
    cited = re.search(r"^Equivalent citations:\s*(.+)$", detail or "", re.I | re.M)
    if cited:
        key = norm(re.sub(r"(?i)^(?:equivalent citations:\s*)+", "", cited[1].strip())).replace(" ", "")
        keys += [f"eq:{key[:180]}"] if len(key) >= 8 else []
    keys += [f"doc:{m[1]}" for u in urls for m in [re.search(r"/(?:doc|docfragment)/(\d+)/?", u or "", re.I)] if m]
    body = re.search(r"Body:\s*([\s\S]+)", detail or "", re.I)
    body = norm((body[1] if body else detail or "")[:1000])[:280]
    seed = body if len(body) >= 80 else norm(snippet)[:220]
    keys += [f"content:{court}:{day}:{seed}"] if len(seed) >= 60 else []
    words = [w for w in norm(f"{snippet} {detail or ''}").split() if len(w) > 4 and w not in X.CORE_STOP][:28]
    core = " ".join(list(dict.fromkeys(words))[:14])
    return list(dict.fromkeys(keys + ([f"core:{court}:{day}:{core}"] if len(core) >= 30 else [])))


def test_identity_keys(spark):
    long = "the tribunal refused condonation because sufficient cause was never shown by the appellant department " * 3
    rows = [
        ("State Vs. Roy on 12 March, 2019", "short", "SC", "Equivalent citations: Equivalent citations: AIR 2019 SC 1\nBody: " + long, "https://h/doc/12/", None),
        ("A v B", long, "HC", None, "https://h/docfragment/7", "https://h/doc/8/"),
        ("A v B on 1 may 2000", "tiny", "UNKNOWN", "x", "https://h/search/7", "https://h/doc/9"),
        (None, None, "SC", "equivalent citations: ab", None, None),
        ("t", long, "SC", "first line\nEQUIVALENT CITATIONS:  1999 (3) SCC 55 , 1999 Cri LJ 1\nmore", "https://h/doc/5", "https://h/doc/5/"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, snippet string, court string, detail string, url string, whole string")
    got = {r.i: r.k for r in df.select("i", R.identity_keys(F.col("title"), F.col("snippet"), F.col("court"), detail=F.col("detail"), urls=(F.col("url"), F.col("whole"))).alias("k")).collect()}
    for i, (title, snippet, court, detail, *urls) in enumerate(rows):
        assert got[i] == plain_identity(title, snippet or "", court, detail, urls), i
    assert len(got[0]) == 4 and got[4][0].startswith("eq:19993scc55") and got[3] == []


def test_vector_blocks_agree(spark, monkeypatch):
    rows = [(i, [math.sin(i * k) for k in range(1, 5)]) for i in range(40)]
    store = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = store.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    whole = sorted(map(tuple, R.vector_top_k(queries, store, 4).collect()))
    monkeypatch.setattr(R, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, R.vector_top_k(queries, store, 4).collect())) == whole and len(whole) == 14 * 4


# --- candidates


def plain_merge(rows):
    def quality(r):
        return (10 if r["court"] != "UNKNOWN" else 0) + (12 if r["detail_text"] else 0) + (1 if r["cites"] is not None else 0) + min(len(r["snippet"]), 600) / 120

    out = {}
    for r in sorted(rows, key=lambda r: r["ordinal"]):
        if r["url"] not in out:
            out[r["url"]] = dict(r)
            continue
        a = out[r["url"]]
        base, rest = (r, a) if quality(r) > quality(a) else (a, r)
        out[r["url"]] = {
            "url": a["url"], "ordinal": a["ordinal"],
            "title": base["title"] if base["title"] and not base["title"].lower().startswith("untitled case") else rest["title"] or base["title"],
            "snippet": base["snippet"] if len(base["snippet"]) >= len(rest["snippet"]) else rest["snippet"],
            "court": base["court"] if base["court"] != "UNKNOWN" else rest["court"],
            "detail_text": base["detail_text"] if base["detail_text"] is not None else rest["detail_text"],
            "cites": base["cites"] if base["cites"] is not None else rest["cites"],
        }
    return sorted(tuple(x[k] for k in ("url", "title", "snippet", "court", "detail_text", "cites")) for x in out.values())


def test_merge_as_a_plain_fold(spark):
    r = random.Random(8)
    rows = [{"url": f"u{r.randrange(6)}", "ordinal": i, "title": r.choice(["", "Untitled case 3", f"t{i}"]), "snippet": "s" * r.choice([0, 10, 500, 700]), "court": r.choice(["SC", "HC", "UNKNOWN"]), "detail_text": r.choice([None, f"d{i}"]), "cites": r.choice([None, i])} for i in range(40)]
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "url string, ordinal long, title string, snippet string, court string, detail_text string, cites long")
    got = C.merge_duplicates(df).select("url", "title", "snippet", "court", "detail_text", "cites").collect()
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(map(tuple, got), key=key) == sorted(plain_merge(rows), key=key)


@pytest.mark.parametrize(
    "title,body,court,kind",
    [("", "x", "SC", "noise"), ("Search", "appeal", "SC", "noise"), ("Limitation Act, 1963", "", "UNKNOWN", "statute"), ("State vs Roy", "", "UNKNOWN", "case"), ("Some text here", "the petitioner came", "UNKNOWN", "case"), ("Some text here", "a notification of rules", "SC", "statute"), ("Some text here", "plain", "HC", "unknown"), ("Short", "plain", "HC", "noise")],
)
def test_kinds(spark, title, body, court, kind):
    assert one(spark, C.classify(F.col("t"), F.col("b"), F.col("c"))["kind"], t=title, b=body, c=court) == kind


# --- gate

CHECK = G.Checklist(axes=(("actor", ("state",), True),), groups=(G.Group("sec197", ("section 197",)), G.Group("pc", ("pc act", "corruption"))), outcome=("required",), outcome_contradictions=("allowed",), outcome_required=True).with_pairs()


def test_gate_tiers(spark):
    near = "the state argued that section 197 and the pc act apply and sanction is required"
    far = "section 197 " + "word " * 80 + " the pc act and the state required"
    rows = [("q", 1, near, True), ("q", 2, far, True), ("q", 3, near + " but it was allowed", True), ("q", 4, near + " and not allowed", True), ("q", 5, "nothing", True), ("q", 6, "pc act only required here", False), ("q", 7, None, False)]
    df = spark.createDataFrame(rows, "query_id string, doc_id long, text string, detail_checked boolean").withColumn("score", F.lit(0.8)).withColumn("context_strength", F.lit(0))
    out = {r.doc_id: r for r in G.split_tiers(G.calibrate(G.gate(G.signals(df, CHECK), CHECK))).collect()}
    assert out[1].tier == "exact_strict" and out[1].confidence <= 0.95
    assert not out[2].relation_satisfied and out[2].tier != "exact_strict"
    assert out[3].contradiction and out[3].tier == "reject" and out[4].tier == "exact_strict"
    assert out[5].tier == "reject" and out[7].tier == "reject" and out[5].shown is None
    assert G.gate_summary(G.calibrate(G.gate(G.signals(df, CHECK), CHECK))).first().n == 7


def plain_positions(text, term):
    pattern = re.escape(term) if " " in term else rf"(?<![a-z0-9_]){re.escape(term)}(?![a-z0-9_])"
    return [m.start() for m in re.finditer(pattern, text)]


def test_positions_and_nearness(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["this", "from", "thisfrom", "x", "pc act", "pc", "not allowed", "allowed", "no been allowed", "disallowed"]) for _ in range(r.randint(0, 200))) for _ in range(40)] + ["", None, "this", "pc pc act act"]
    terms = ["this", "pc act", "from", "allowed", "pc pc", "pc", "absent", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    at = F.col("at")
    rows = df.withColumn("at", term_places(F.col("t"), terms)).select("t", "at", places_of(at, F.array(F.lit("this"), F.lit("pc act"))).alias("both"), counts_against(at, "allowed").alias("against"), G.near_starts(places_of(at, F.array(F.lit("this"))), places_of(at, F.array(F.lit("pc act"))), 20).alias("near"))
    for g in rows.collect():
        t = g.t or ""
        want = {x: plain_positions(t, x)[:30] for x in terms if x}
        assert {k: v for k, v in g["at"].items() if k[0] != "!"} == {k: v for k, v in want.items() if v}
        a, b = want["this"], want["pc act"]
        assert g.both == (a + b)[:30] and g.near == any(abs(x - y) <= 20 for x in a for y in b)
        assert g.against == (bool(want["allowed"]) and not re.search(r"(^|[^a-z0-9_])(?:not|no|without)\s+(?:been\s+)?allowed([^a-z0-9_]|$)", t))


# --- metrics, questions, recall


def test_stepwise_mean(spark):
    r = random.Random(4)
    rows = [(i, r.choice("ab"), i, r.random()) for i in range(50)]
    df = spark.createDataFrame(rows, "attempt_id long, canonical_key string, ts long, utility double")
    for g in M.stepwise_utility(df).collect():
        mean = 0.0
        for n, x in enumerate(x[3] for x in rows if x[1] == g.canonical_key):
            mean = math.floor(((mean * n + x) / (n + 1)) * 1e4 + 0.5) / 1e4
        assert math.isclose(g.mean, mean, abs_tol=2e-4)


def test_empty_session(spark):
    runs = spark.createDataFrame([], "cases long, avg_score double, blocked boolean")
    assert tuple(M.session_summary(runs).first()) == (0, 0.0, 0.0, 0.0, 0)


@pytest.mark.parametrize(
    "text,want",
    [("sanction was not required here", "not_required"), ("prior sanction needed", "required"), ("cannot proceed at all without sanction", "required"), ("the appeal was dismissed", "dismissed"), ("can delay be condoned", "unknown"), ("whether the plea was refused", "refused"), ("état", "unknown"), (None, "unknown")],
)
def test_polarity(spark, text, want):
    assert one(spark, Q.polarity(F.col("t")), t=text) == want


def test_intent(spark):
    df = spark.createDataFrame([(1, "Please find cases where the State filed a criminal appeal under section 378 CrPC in March 2021 before the Supreme Court and delay was not condoned")], "query_id long, text string")
    r = Q.coach(Q.intent_profile(df)).first()
    assert "please" not in r.cleaned.lower() and "cases where" not in r.cleaned.lower() and r.court_hint == "SC" and "criminal" in r.domains and "state" in r.actors and "criminal appeal" in r.procedures
    assert (str(r.window.from_date), str(r.window.to_date)) == ("2021-03-01", "2021-03-31")
    assert "section 378 crpc" in r.statutes and "crpc" in r.statutes and not r.either and r.grade == "STRONG" and r.readiness == "READY_FOR_EXACT"
    variants = Q.synthesise_variants(Q.intent_profile(df)).collect()
    assert any(v.strictness == "strict" for v in variants) and len({v.variant_id for v in variants}) == len(variants)


def test_hook_groups(spark):
    rows = [(1, 0, "crpc"), (1, 1, "section 197 crpc"), (1, 2, "Section 197 CrPC"), (1, 3, "pc act"), (1, 4, "odd hook")]
    out = Q.hook_groups(spark.createDataFrame(rows, "query_id long, ordinal int, term string")).orderBy("rank").collect()
    assert [g.group_id for g in out] == ["sec_197_crpc", "pc_act", "odd_hook"] and out[0].required


def test_query_strings(spark):
    args = [F.array(F.lit("pc act"), F.lit("delay")), F.array(F.lit("x"), F.lit("y")), F.array(F.lit("z"))]
    assert one(spark, Q.boolean_query(*args), t="") == '"pc act" ANDD delay ANDD (x ORR y) NOTT z'
    assert one(spark, Q.site_query(*args, "example.org"), t="") == 'site:example.org "pc act" "delay" x y -z'
    assert one(spark, Q.predicate(F.col("t"), ["pc act"], ["x", "y"], ["z"]), t="PC Act with y")


def test_recall(spark):
    stored = L.signatures(spark.createDataFrame([("e1", "delay in filing the appeal was not condoned"), ("e2", "sanction for prosecution of public servant")], "entry_id string, query string"))
    asked = L.signatures(spark.createDataFrame([(1, "Delay in filing the appeal was not condoned!"), (2, "delay in filing the appeal was condoned late"), (3, "quite another matter")], "query_id long, query string"))
    out = {r.query_id: (r.entry_id, r.level) for r in L.recall_lookup(asked, stored).collect()}
    assert out == {1: ("e1", "exact"), 2: ("e1", "full")}


def test_jaccard_pairs_are_complete(spark):
    r = random.Random(11)
    rows = [(i, [f"w{int(30 * r.random() ** 2)}" for _ in range(r.randint(0, 12))]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    for percent in (50, 85, 100):
        got = {(x.a, x.b) for x in L.jaccard_pairs(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), percent, left_id="a", right_id="b").collect()}
        sets = {i: set(t) for i, t in rows}
        assert got == {(a, b) for a in sets for b in sets if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}


def test_containment_by_rare_prefixes(spark):
    """All pairs with the share are candidates, and far fewer others than those that share a token."""
    r = random.Random(4)
    word = lambda: f"w{int(r.paretovariate(0.5)) % 200:03d}"
    left = [(i, list({word() for _ in range(r.randint(0, 10))})) for i in range(150)]
    right = [(i, list({word() for _ in range(r.randint(0, 10))})) for i in range(200)]
    a, b = spark.createDataFrame(left, "left_id int, tokens array<string>"), spark.createDataFrame(right, "right_id int, tokens array<string>")
    shared = {(i, j): len(set(x) & set(y)) / len(x) for i, x in left for j, y in right if set(x) & set(y)}
    for least in (0.35, 0.5, 1.0):
        got = {tuple(x) for x in L.containment_candidates(a, b, least).collect()}
        assert {p for p, s in shared.items() if s >= least} <= got <= set(shared)
        assert len(got) < 0.8 * len(shared) or least == 0.35
    assert len({tuple(x) for x in L.containment_candidates(a, b, 0.35).collect()}) < len(shared)


def test_best_title(spark):
    left = spark.createDataFrame([(1, "7", "no words shared"), (2, None, "State of Kerala versus Roy"), (3, None, "zzz yyy")], "left_id long, number string, title string")
    right = spark.createDataFrame([(10, "7", "other"), (11, None, "Roy versus State Kerala"), (12, None, "Kerala")], "right_id long, number string, title string")
    assert sorted(map(tuple, L.best_title(left, right).collect())) == [(1, 10, 1.0), (2, 11, 1.0)]


# --- pages


SEARCH_PAGE = """<div class="result"><a href="/doc/1/">State vs Roy on 3 May, 2020</a><a href="/doc/1/?x">Full Document</a><a href="?authors=z">A</a></div>
<div class='x result y'><a href='/docfragment/2/?q'>Appeal of Das</a></div><div class="result"><a href="/about">none</a></div>"""
DETAIL = """<h2>State vs Roy</h2><h3>Supreme Court of India</h3><h3>Author: A. Judge</h3><h3>Bench: B. Judge</h3><h3>Equivalent citations: AIR 2020 SC 1</h3>
<a>Cites 1,234</a><a>Cited by 56</a><blockquote>The appellant argued that sanction under section 197 was required for the trial.</blockquote><p>short</p>"""


def test_search_rows(spark):
    pages = spark.createDataFrame([(1, SEARCH_PAGE), (2, '<h4><a href="/doc/5/">Five against the world</a></h4>'), (3, '<a href="/doc/6/">Six and more</a><a href="/doc/7/">Seven</a><a href="/doc/6/">Six</a>'), (4, None), (5, "")], "page_id long, html string")
    out = sorted(tuple(r) for r in P.search_rows(pages, "https://h").select("page_id", "url", "title", "mode").collect())
    assert out == [(1, "https://h/doc/1/", "State vs Roy on 3 May, 2020", "container"), (1, "https://h/doc/2/", "Appeal of Das", "container"), (2, "https://h/doc/5/", "Five against the world", "heading"), (3, "https://h/doc/6/", "Six and more", "links"), (3, "https://h/doc/7/", "Seven", "links")]


def test_search_modes(spark):
    title = '<div class="result_title x"><span></span><a href="/doc/11/">Roy against Das</a></div><p>text</p>'
    context = '<p><a href="/doc/12/">Das v. Roy</a> the appellant filed an appeal. Cited by 4</p><div>' + "filler " * 900 + '</div><a href="/doc/13/">About this site</a>'
    nothing = '<b>No matching results</b><a href="/doc/14/">Fourteen</a>'
    pages = spark.createDataFrame([(1, title), (2, context), (3, nothing)], "page_id long, html string")
    out = sorted(tuple(r) for r in P.search_rows(pages, "https://h").select("page_id", "url", "title", "mode").collect())
    assert out == [(1, "https://h/doc/11/", "Roy against Das", "title"), (2, "https://h/doc/12/", "Das v. Roy", "context")]


def test_detail(spark):
    r = one(spark, P.detail_record(F.col("h")), h=DETAIL)
    assert (r.title, r.court, r.author, r.bench, r.citations, r.cites, r.cited_by) == ("State vs Roy", "SC", "A. Judge", "B. Judge", "AIR 2020 SC 1", 1234, 56)
    assert len(r.evidence_windows) == 1 and r.body == [r.evidence_windows[0] + "."]
    text = one(spark, P.detail_text(P.detail_record(F.col("h"))), h=DETAIL)
    assert text.startswith("Title: State vs Roy\nCourt: Supreme Court of India\n") and "Cited by count: 56" in text
    q = one(spark, P.evidence_quality(F.col("t")), t="The appellant said section 197 crpc read with the ipc is mandatory here. " * 2)
    assert q.relation and q.polarity and q.hook_intersection and q.role and not q.chain


def test_hydration_report_without_errors(spark):
    from evidora.operators.hydration import hydration_report

    rows = spark.createDataFrame([(1, None, "x"), (2, None, None)], "doc_id long, error_code string, detail_text string")
    assert [tuple(r) for r in hydration_report(rows).collect()] == [(None, 0, None, 0.5)]


def test_model_embeddings(spark):
    from evidora.operators import planning

    rows = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (4, "four"), (5, None)], "id long, text string")
    plain = {r.id: r.vector for r in I.embed_with_model(rows, dim=8).collect()}
    answers = {"one": '{"embedding": [3, 4]}', "two": '{"embeddings": [[0, 2]]}', "three": '{"data": [[1, 0, 0]]}', "four": "broken"}

    def model(prompt):
        out = F.lit(None).cast("string")
        for k, v in answers.items():
            out = F.when(F.get_json_object(prompt, "$.inputText") == k, v).otherwise(out)
        return out

    planning.register_model("embedding", model)
    try:
        got = {r.id: r.vector for r in I.embed_with_model(rows, dim=8).collect()}
    finally:
        planning._HOOKS.pop("embedding")
    assert got[1] == [0.6, 0.8] and got[2] == [0.0, 1.0] and got[3] == [1.0, 0.0, 0.0] and got[4] == plain[4] and got[5] == [0.0] * 8


def test_error_codes(spark):
    for message, code in [("HTTP 403", "http_403"), ("status 429", "http_429"), ("Timed out", "timeout"), ("ECONNRESET", "network"), (None, "unknown")]:
        assert one(spark, P.error_code(F.col("m")), m=message) == code


# --- sources


def fetch(phrase, page):
    if phrase == "bad":
        return 500, ""
    if phrase == "down":
        raise ConnectionResetError("gone")
    if phrase == "busy|x":
        return (429, "", "0") if len(list(BUSY.glob("*"))) < 2 and not (BUSY / f"{len(list(BUSY.glob('*')))}").touch() else (200, "No matching results")
    return (200, f'<a href="/doc/{page + 1}/">Title number {page + 1} of {phrase}</a>') if page < 2 else (200, "No matching results")


BUSY = Path(tempfile.mkdtemp(prefix="busy-"))


def test_page_source_waits_and_filters(spark):
    pages_source.register(spark, fetch, "fixture_pages_2")
    began = time.monotonic()
    pages = spark.read.format("fixture_pages_2").option("phrases", '["busy|x", "down", "one"]').option("maxPages", "2").load()
    got = sorted((r.phrase, r.page, r.status, r.html[:20]) for r in pages.collect())
    assert got[0] == ("busy|x", 0, 200, "No matching results") and got[1] == ("down", 0, 0, "ConnectionResetError") and len(got) == 4
    assert time.monotonic() - began > 0.3  # two waits of at least 120 and 240 ms
    reader = pages_source.PageReader(["a", "b", "c"], 3, fetch, 0, 1000, 0.0)
    left = list(reader.pushFilters([pages_source.In(("phrase",), ("b", "c")), pages_source.EqualTo(("phrase",), "c"), pages_source.EqualTo(("page",), 1)]))
    assert reader.phrases == ["c"] and len(left) == 1
    one = pages_source.crawl(spark.createDataFrame([("a|b", 0, 200, '<a href="/doc/1/">Title of one</a>')], "phrase string, page int, status int, html string"), "https://h").first()
    assert one.phrase == "a|b"


def test_page_source(spark):
    pages_source.register(spark, fetch, "fixture_pages")
    pages = spark.read.format("fixture_pages").option("phrases", "one|bad").option("maxPages", "5").load()
    assert sorted((r.phrase, r.page, r.status) for r in pages.collect()) == [("bad", 0, 500), ("one", 0, 200), ("one", 1, 200), ("one", 2, 200)]
    rows = pages_source.crawl(pages, "https://h").collect()
    assert [(r.phrase, r.url, r.place) for r in rows] == [("one", "https://h/doc/1/", 1), ("one", "https://h/doc/2/", 2)]
    assert pages_source.retry_delay(429, 2, "3") == 3240 and pages_source.retry_delay(200, 1) is None and pages_source.retry_delay(0, 3, network_error=True) == 660


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    raw = spark.createDataFrame([("1", "First case", "appeal dismissed as time barred. " * 30), ("2", "Second", "sanction required"), ("1", "First case", "appeal dismissed as time barred. " * 30)], "docId string, title string, text string")
    counts = index_job(spark, raw, store, dim=16, least=220, most=340)
    assert counts["documents"] == 2 and counts["chunks"] > 2
    store.upsert(store.read().where("doc_id = '2'").withColumn("title", F.lit("changed")))
    assert store.read().count() == counts["chunks"] and store.read().where("title = 'changed'").count() == 1
    with pytest.MonkeyPatch.context() as m:
        m.setattr(VectorStore, "COMPACT", 3)
        for n in range(5):
            store.upsert(store.read().where("doc_id = '2'").withColumn("title", F.lit(f"changed {n}")))
    other = VectorStore(spark, store.path)  # a second writer sees the same
    assert len(other._log()) <= 4 and other.read().count() == counts["chunks"] and other.read().where("title = 'changed 4'").count() == 1
    twice = store.read().where("doc_id = '2'")
    store.upsert(twice.union(twice))
    assert store.read().count() == counts["chunks"]
    q = store.read().where("doc_id = '2'").select(F.lit(1).alias("query_id"), F.col("values").alias("vector"))
    assert store.query(q, 1).first()["id"] == "2#c0001"


def _vectors(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, n int")


def _stored(store):
    return {r.id: r.n for r in store.read().collect()}


def test_no_commit_is_lost_to_a_compaction(spark, tmp_path, monkeypatch):
    """A batch that comes while others are compacted stays, and is newer than the compacted one."""
    store, other = VectorStore(spark, str(tmp_path / "v")), VectorStore(spark, str(tmp_path / "v"))
    store.upsert(_vectors(spark, ("a", 1)))
    store.upsert(_vectors(spark, ("b", 1)))
    commit = store._commit

    def late(folder, read_version=None):
        other.upsert(_vectors(spark, ("c", 1), ("a", 2)))
        return commit(folder, read_version)

    monkeypatch.setattr(store, "_commit", late)
    store.compact()
    assert _stored(other) == {"a": 2, "b": 1, "c": 1}
    monkeypatch.undo()
    store.compact()
    assert len(store._log()) == 1 and _stored(store) == {"a": 2, "b": 1, "c": 1}
    store.upsert(_vectors(spark, ("b", 5)))
    assert _stored(store) == {"a": 2, "b": 5, "c": 1}


def test_two_compactions_at_once(spark, tmp_path, monkeypatch):
    store, other = VectorStore(spark, str(tmp_path / "v")), VectorStore(spark, str(tmp_path / "v"))
    for n in range(3):
        store.upsert(_vectors(spark, ("a", n), (f"x{n}", n)))
    commit = store._commit

    def late(folder, read_version=None):
        other.compact()
        other.upsert(_vectors(spark, ("a", 9)))
        return commit(folder, read_version)

    monkeypatch.setattr(store, "_commit", late)
    store.compact()
    assert _stored(store) == {"a": 9, "x0": 0, "x1": 1, "x2": 2}


def test_first_writers_meet(spark, tmp_path, monkeypatch):
    """Two writers that both find an empty store keep both their rows; a commit that names an old version is refused."""
    store, other = VectorStore(spark, str(tmp_path / "v")), VectorStore(spark, str(tmp_path / "v"))
    commit = store._commit

    def late(folder, read_version=None):
        other.upsert(_vectors(spark, ("b", 1)))
        return commit(folder, read_version)

    monkeypatch.setattr(store, "_commit", late)
    store.upsert(_vectors(spark, ("a", 1)))
    assert _stored(store) == {"a": 1, "b": 1}
    seen = store.version()
    with pytest.raises(StaleVersion):
        store.upsert(_vectors(spark, ("b", 2)), read_version=seen)
    assert _stored(store) == {"a": 1, "b": 1} and store.version() == seen + 1 and len([p for p in (tmp_path / "v").iterdir() if not p.name.startswith("_")]) == 3
    monkeypatch.undo()
    assert store.upsert(_vectors(spark, ("b", 3)), read_version=store.version()) == seen + 2 and _stored(store)["b"] == 3


def test_which_of_several_new_rows_is_taken(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    store.upsert(_vectors(spark, ("a", 5), ("a", 1), ("b", 2)))
    assert _stored(store) == {"a": 5, "b": 2}
    rows = spark.createDataFrame([("a", 7, 1), ("a", 3, 2)], "id string, n int, at int")
    store.upsert(rows, order=F.col("at"))
    assert _stored(store) == {"a": 3, "b": 2}


def test_small_sources(spark, tmp_path):
    assert pick_provider("api", {"web"}) == ("web", "api is not configured") and pick_provider("auto", {"api"}) == ("api", None)
    (tmp_path / "f.json").write_text('[{"id": "q1", "query": "x", "expected": {"polarity": "refused", "requiredHooks": ["a"]}}]')
    assert read_fixtures(spark, str(tmp_path / "f.json")).first().expected.requiredHooks == ["a"]
    df = spark.createDataFrame([(1, "2019-01-01"), (2, "2020-01-01"), (3, "2021-01-01")], "id long, d string").select("id", F.to_date("d").alias("decision_date"))
    backfill_years(df, str(tmp_path / "y"), 2019, 2020)
    backfill_years(df.where("id = 3"), str(tmp_path / "y"), 2021, 2021)
    assert spark.read.parquet(str(tmp_path / "y")).count() == 3
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "doc_id long, name string")
    found = {lookup_documents(spark.createDataFrame([(1,), (3,)], "doc_id long"), docs.repartition(n)).where("doc_id = 1").first().name for n in (1, 2, 3)}
    assert len(found) == 1
    cache = spark.createDataFrame([("k", "old", 10), ("k", "new", 20), ("j", "gone", 1)], "key string, value string, at long").withColumn("written_at", F.timestamp_seconds("at"))
    assert [tuple(r) for r in live_entries(cache, F.timestamp_seconds(F.lit(25)), 20).collect()] == [("k", "new")]


# --- streams


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, float(i)) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, t string, user_id long, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    out = T.run_available(T.utility_stream(stream, key="user_id", value="value"), "u1", "complete", str(tmp_path / "c1"))
    assert {(r.user_id, r.attempts) for r in out.collect()} == {(0, 20), (1, 20), (2, 20)}
    live = T.run_available(T.window_counts(stream, key="user_id", window="30 minutes", limit=5, late="1 minute"), "u2", "append", str(tmp_path / "c2"))
    assert {r.n for r in live.collect()} <= {10} and all(r.over == 5 for r in live.collect())
    repeats = T.unseen_requests(stream, F.col("user_id").cast("string"), late="1 hour").select("user_id")
    assert sorted(r.user_id for r in T.run_available(repeats, "u4", "append", str(tmp_path / "c4")).collect()) == [0, 1, 2]
    told = T.run_to_table(T.utility_stream(stream, key="user_id", value="value"), str(tmp_path / "out"), str(tmp_path / "c5"))
    assert {(r.user_id, r.attempts) for r in told.collect()} == {(0, 20), (1, 20), (2, 20)}
    carried = T.carried(T.run_to_table(T.carry_state(stream.withColumn("sig", (F.col("event_id") % 5).cast("string")), key="user_id", value="value", signature="sig"), str(tmp_path / "o3"), str(tmp_path / "c3")), key="user_id")
    assert {(r.user_id, r.attempts, r.skipped) for r in carried.collect()} == {(0, 20, 15), (1, 20, 15), (2, 20, 15)}


def test_carried_state_forgets_nothing_and_goes_on_after_a_restart(spark, tmp_path):
    """Six thousand signatures of one key, repeated in a second run that starts from the first one's checkpoint."""
    schema = "user_id long, value double, sig string"
    make = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    run = lambda: {r.user_id: (r.attempts, r.mean_value, r.skipped, r.signatures) for r in T.carried(T.run_to_table(T.carry_state(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), key="user_id", value="value", signature="sig"), str(tmp_path / "out"), str(tmp_path / "log")), key="user_id").collect()}
    make("a", [(1, 1.0, f"s{i}") for i in range(6000)] + [(2, 4.0, "x"), (2, 2.0, "x"), (2, 0.0, None)])
    assert run() == {1: (6000, 1.0, 0, 6000), 2: (3, 2.0, 1, 2)}
    make("b", [(1, 3.0, f"s{i}") for i in range(6000)] + [(3, 5.0, "y")])
    assert run() == {1: (12000, 2.0, 6000, 6000), 2: (3, 2.0, 1, 2), 3: (1, 5.0, 0, 1)}
    assert run()[1] == (12000, 2.0, 6000, 6000)  # nothing new



# --- word ends, long numbers, whole jobs


def test_a_marker_begins_a_part_after_other_letters(spark):
    assert one(spark, I.segments(F.col("t")), t="uno \u00f1Para dos Held\u00e9 tres Parad") == ["uno \u00f1", "Para dos", "Held\u00e9 tres Parad"]


def test_numbers_of_notifications_have_any_length(spark):
    assert one(spark, N.references(F.col("t"))["notification_ids"], t="after S.O. 1000000(e) and GSR 12(a)") == ["s.o. 1000000(e)", "g.s.r. 12(a)"]


def test_bands_have_the_candidates_of_the_passages_too(spark):
    sf = "/root/testdata/sf0.001"
    n = lambda name: QUERIES[name](spark, sf).count()
    assert sum(r.n for r in QUERIES["score_bands"](spark, sf).collect()) == n("weighted_score") + n("context_score") > n("context_score")


@pytest.mark.parametrize("name, wanted", [("classify_rows", 1), ("reason_hist", 1), ("filter_with_fallback", 1)])
def test_a_text_is_searched_once_for_a_cue(spark, name, wanted):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("(?:thing|license)") == 2 * wanted  # in the title and in the body


def test_a_repeated_text_is_worked_out_once(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else f"Whether section {i % 5} ipc applies") for i in range(40)], "n long, text string")
    given = []

    def make(texts):
        given.append(texts.count())
        return texts.select("query_id", "text", F.length("text").alias("size"))

    got = Q.once_a_text(rows, make)
    assert given == [5] and got.columns == ["n", "text", "size"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((r.n, r.text, None if r.text is None else len(r.text)) for r in rows.collect()), key=str)


def test_questions_made_of_parts_share_their_texts(spark, monkeypatch):
    given = []
    real = Q.intent_profile
    monkeypatch.setattr(Q, "intent_profile", lambda texts, **k: given.append((texts.count(), texts.distinct().count())) or real(texts, **k))
    assert QUERIES["question_intents"](spark, "/root/testdata/sf0.01").count() > given[0][0] == given[0][1]


@pytest.mark.parametrize("percent, entries, cells, block", [(55, 1 << 22, 1 << 20, 1 << 20), (55, 64, 16, 40), (80, 100, 50, 200), (20, 64, 64, 64)])
def test_stated_sets_meet_all_near_ones(spark, monkeypatch, percent, entries, cells, block):
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(40)]
    sets = [[], None, ["w0"], ["w0"]] + [rng.sample(words, rng.randint(1, 12)) for _ in range(60)]
    sets += [rng.sample(s, len(s) - 1) + ["new"] for s in sets[10:40]]
    rows = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>")
    for name, value in (("ENTRIES", entries), ("CELLS", cells), ("STATED_TOKENS", block)):
        monkeypatch.setattr(L, name, value)
    got = L.jaccard_of_stated(rows.where("id % 3 = 0").withColumnRenamed("id", "left_id"), rows.withColumnRenamed("id", "right_id"), percent)
    want = {(i, j, len(a & b), len(a), len(b)) for i, a in enumerate(map(set, (s or [] for s in sets))) if i % 3 == 0 for j, b in enumerate(map(set, (s or [] for s in sets))) if a & b and 100 * len(a & b) >= percent * len(a | b)}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_recall_sends_no_side_to_all_tasks(spark):
    plan = QUERIES["recall_lookup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_titles_are_matched_without_a_join_on_words(spark):
    rows = lambda kind, rows: spark.createDataFrame(rows, f"{kind}_id long, number string, title string")
    left = rows("left", [(1, None, "alpha bravo charlie"), (2, "n1", "delta echo"), (3, None, "nothing shared here"), (4, None, None)])
    right = rows("right", [(9, None, "bravo alpha"), (7, None, "alpha charlie zulu"), (8, "n1", "foxtrot"), (6, None, "delta echo"), (5, None, "alpha golf hotel")])
    made = L.best_title(left, right)
    assert sorted(map(tuple, made.collect())) == [(1, 7, 0.666667), (2, 8, 1.0)]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # that of the numbers


def test_titles_follow_few_pairs(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{k:02}" for k in range(40)]
    text = lambda: " ".join(r.choices(words, weights=[1 / (k + 1) for k in range(40)], k=r.randint(0, 9)))
    left, right = [(k, text()) for k in range(150)], [(k, text()) for k in range(400)]
    left += [(k + 1000, t) for k, t in left[:60]]
    best = []
    for i, t in left:
        x = set(t.split())
        shared = [(-len(x & set(u.split())), k) for k, u in right]
        if x and round(-min(shared)[0] / len(x), 6) >= 0.35:
            best.append((i, min(shared)[1], round(-min(shared)[0] / len(x), 6)))
    frames = [spark.createDataFrame(rows, f"{side}_id long, title string").withColumn("number", F.lit(None).cast("string")) for side, rows in (("left", left), ("right", right))]
    asked = [df.select(f"{side}_id", F.array_sort(X.TITLE.distinct(F.col("title"))).alias("tokens")) for side, df in zip(("left", "right"), frames)]
    blocks = list(L._title_blocks(asked[0].where(F.size("tokens") > 0), 0.35))
    assert sum(len(ids) for b in blocks for ids in b[0]) == sum(bool(t) for _, t in left)
    n_sets = len({frozenset(t.split()) for _, t in left if t})
    assert sum(len(b[0]) for b in blocks) == n_sets and all(len(b[7]) < 0.9 * len(b[5]) for b in blocks)  # equal sets are one, and common tokens are not followed
    assert sorted(map(tuple, L.best_title(*frames).collect())) == sorted(best)
    monkeypatch.setattr(L, "STATED_TOKENS", 64)
    monkeypatch.setattr(L, "ENTRIES", 16)
    monkeypatch.setattr(L, "CELLS", 8)
    monkeypatch.setattr(X, "HEAD", 12)
    assert sorted(map(tuple, L.best_title(*frames).collect())) == sorted(best)
    # a text's beginning tells its first tokens, but not where they repeat or are cut
    monkeypatch.setattr(X, "HEAD", 60)
    texts = ["w00 " * 40 + " ".join(words[:12]), " ".join(words[:30]), " ".join(words[:14]) + "x", None, "", " ".join(["K" * 30, *words[:11]])]
    made = spark.createDataFrame([(t,) for t in texts], "t string").select(X.TITLE.distinct(F.col("t"))).collect()
    assert [row[0] for row in made] == [[f"{w}" for w in dict.fromkeys((t or "").lower().split())][:10] for t in texts]
