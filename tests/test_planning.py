from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidora.operators import hydration as Y
from evidora.operators import planning as N


@pytest.mark.parametrize(
    "text,good",
    [('{"a": 1}', True), ('```json\n{"a": [1, 2,],}\n```', True), ('Sure: {"a": "br}ace", "b": {"c": 1}} and more }', True), ("no object", False), ('{"a": ', False), ("[1]", False), (None, False), ("", False)],
)
def test_repair(text, good):
    assert (N.repaired(text) is not None) == good


def test_plans(spark):
    answer = '```json\n{"actors": ["State", "state ", 5], "legal_hooks": ["section 197 CrPC", "limitation act"], "outcome_required": ["dismissed"], "query_variants_strict": ["state appeal dismissed", "state appeal"], "must_not_have_terms": ["was dismissed"],}\n```'
    df = spark.createDataFrame([(1, answer, "does 197 need sanction"), (2, None, "x"), (3, answer, "appeal was dismissed under the limitation act")], "query_id long, answer string, question string")
    rows = N.parse_plans(df, "answer").withColumn("plan", N.ground_plan(F.col("plan"), F.col("question"))).orderBy("query_id").collect()
    a, b, c = (r.plan for r in rows)
    assert a.actors == ["state", "5"] and a.legal_hooks == ["section 197 crpc"] and a.outcome_required == [] and a.query_variants_strict == ["state appeal"] and a.must_not_have_terms == [] and a.dropped_hooks == 1 and a.dropped_outcome
    assert b.actors == [] and not b.dropped_outcome
    assert c.outcome_required == ["dismissed"] and c.legal_hooks == ["limitation act"]
    variants = N.plan_variants(N.parse_plans(df, "answer")).collect()
    assert {(v.query_id, v.phrase) for v in variants} == {(q, p) for q in (1, 3) for p in ("state appeal dismissed", "state appeal")}


def test_hooks_and_words(spark):
    assert N.model("plan", F.lit("x")) is None
    N.register_model("echo", lambda c: F.upper(c))
    df = spark.createDataFrame([("delay condonation appeal",)], "t string")
    assert df.select(N.model("echo", F.col("t")).alias("x")).first()["x"] == "DELAY CONDONATION APPEAL"
    widened = df.select(N.widen(F.array("t")).alias("x")).first()["x"]
    assert "condonation of delay" in widened and "criminal appeal" in widened and "pc act" not in widened
    assert df.select(N.has_signal(F.split("t", " "), ["appeal"]).alias("x")).first()["x"]
    assert df.select(N.category_terms(F.lit('[{"name": "A"}, {"value": "b"}]')).alias("x")).first()["x"] == ["a", "b"]
    d = df.select(N.directives(F.lit("SC"), F.lit("precision"), F.lit(False)).alias("x")).first()["x"]
    assert (d.doctypes, d.exclusion_policy, d.expand_categories) == ("supremecourt", "strict", False)


def test_variants_of_results(spark):
    results = spark.createDataFrame([(1, 1, "State versus Roy"), (1, 2, "Das Company"), (1, 9, "late")], "query_id long, place int, title string")
    intents = spark.createDataFrame([(1, ["section 5"], ["appeal"], [])], "query_id long, statutes array<string>, procedures array<string>, issues array<string>")
    assert [r.phrase for r in N.trace_variants(results, intents, most=3).orderBy("ordinal").collect()] == ["state versus roy section 5", "state versus roy appeal", "das company section 5"]
    templates = spark.createDataFrame([("civil", 0, "p one"), ("civil", 1, "p two"), ("tax", 0, "p one")], "label string, ordinal int, phrase string")
    asked = spark.createDataFrame([(1, ["tax", "civil"])], "query_id long, domains array<string>")
    assert {r.phrase for r in N.templates_for(asked, "domains", templates).collect()} == {"p one", "p two"}
    variants = spark.createDataFrame([(1, "a", 5, False), (1, "b", 9, True), (1, "c", 7, False), (2, "d", 1, False)], "query_id long, variant_id string, priority int, ran boolean")
    needed = spark.createDataFrame([(1, 2), (2, 5)], "query_id long, n_results int")
    assert [r.variant_id for r in N.guarantee_variants(variants, needed).collect()] == ["c"]


def test_hydration(spark):
    cands = spark.createDataFrame([(1, "short", "UNKNOWN", "s"), (2, "a long title here", "HC", "s")], "doc_id long, title string, court string, snippet string")
    details = spark.createDataFrame([(1, "a longer title", "SC", "text")], "doc_id long, title string, court string, detail_text string")
    out = {r.doc_id: r for r in Y.hydrate(cands, details).collect()}
    assert (out[1].title, out[1].court, out[1].detail_text) == ("a longer title", "SC", "text") and (out[2].court, out[2].detail_text) == ("HC", None)
    df = spark.createDataFrame([(1, 1, 0.9, "exact_strict"), (1, 2, 0.8, "near_miss"), (1, 3, 0.7, "near_miss"), (1, 4, 0.6, "near_miss"), (2, 5, 0.3, "reject")], "query_id long, doc_id long, score double, tier string").withColumn("fetched", F.lit(30))
    shown = Y.display_rows(df).collect()
    assert sorted(r.doc_id for r in shown) == [1, 2, 3] and {r.result_mode for r in shown} == {"mixed"}
    assert [r.doc_id for r in Y.promoted(df).where("promoted").collect()] == [5]
    hits = spark.createDataFrame([("d", "d#c0001", "x" * 600)], "doc_id string, id string, text string")
    assert len(Y.semantic_candidate(hits).first().snippet) == 500


BROKEN = [
    # cut within a list, after a whole one
    ('```json\n{"actors": ["State", "state"], "proceeding": ["criminal appeal"], "legal_hooks": ["section 378 crpc", "limit', {"actors": ["state"], "proceeding": ["criminal appeal"], "legal_hooks": ["section 378 crpc"]}),
    # a list without its bracket, then another field
    ('Here: {"actors": ["department", "officer", "legal_hooks": ["section 197"], "must_have_terms": [', {"actors": ["department", "officer"], "legal_hooks": ["section 197"]}),
    # typographic quotation marks and escapes
    ('{\u201cactors\u201d: [\u201cunion of india\u201d, "a \\"quoted\\" one"], "case_anchors": ["A v. B", ""', {"actors": ["union of india", 'a "quoted" one'], "case_anchors": ["a v. b"]}),
    # a whole object needs no salvage
    ('{"actors": ["x"], "proceeding": ["y",],}', {"actors": ["x"], "proceeding": ["y"]}),
    ("no object here", {}),
    (None, {}),
]


def test_broken_answers(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(BROKEN)], "i int, answer string")
    for r in N.parse_plans(df, "answer").collect():
        want = dict.fromkeys(N.PLAN_LIMITS, []) | BROKEN[r.i][1]
        assert r.plan.asDict() == want, r.i


def test_salvaged_sketches(spark):
    answers = [
        '{"actors": ["State"], "proceeding": ["appeal"], "outcome": ["delay refused"], "hooks": ["section 5"], "polarity": "refused", "court_hint": "S',
        '{"strict_terms": ["one two", "three', 
        '{"polarity": "refused"}',
        'nothing',
    ]
    got = [r.s for r in spark.createDataFrame(list(enumerate(answers)), "i int, a string").orderBy("i").select(N.salvaged_sketch(F.col("a")).alias("s")).collect()]
    assert got[0].strict_terms == ["State appeal delay refused section 5", "appeal delay refused section 5", "State delay refused section 5"] and (got[0].polarity, got[0].court_hint) == ("refused", None)
    assert got[1].strict_terms == ["one two"] and got[1].actors == [] and got[2] is None and got[3] is None


def test_models_answers_reach_checklists_and_variants(spark, monkeypatch):
    from evidora.operators.intent import coach, intent_profile
    from evidora.plans import search as plan

    monkeypatch.setattr(N, "_HOOKS", {})
    questions = spark.createDataFrame([(1, "state criminal appeal delay not condoned under section 378 crpc"), (2, "some words")], "query_id int, text string")
    intents = coach(intent_profile(questions))
    plain = plan.planned_intents(intents)
    assert "plan" not in plain.columns
    N.register_model("plan", lambda text: F.lit('{"actors": ["advocate general"], "legal_hooks": ["section 378 crpc", "article 999"], "query_variants_strict": ["State Appeal Limitation Crpc"], "query_variants_broad": ["late appeals by the state"'))
    N.register_model("keywords", lambda text: F.lit('["belated criminal appeals of states"]'))
    asked = plan.planned_intents(intents)
    row = asked.where("query_id = 1").first()
    assert "advocate general" in [t for a in row.checklist.axes for t in a.terms] and row.plan.legal_hooks == ["section 378 crpc"] and row.plan.dropped_hooks == 1
    made = plan.question_variants(asked, courts=False).collect()
    first = [v for v in made if v.purpose == "model_plan" and v.query_id == 1]
    assert [(v.phrase, v.phase) for v in sorted(first, key=lambda v: -v.priority)] == [("state appeal limitation crpc", "primary"), ("late appeals by the state", "fallback")]
    # suggested keywords come after a question's own, so they show where it has few
    assert any("belated criminal appeals" in v.phrase for v in made if v.query_id == 2) and len({(v.query_id, v.variant_id) for v in made}) == len(made)
