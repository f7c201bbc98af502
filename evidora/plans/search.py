"""The flagship plan: a batch of questions against a corpus (SRC-20, and the lifecycle from question to tiers)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config
from ..operators import gate as G
from ..operators.candidates import classify, keep_or_all
from ..operators.checklists import build_checklists, checklist_terms, in_mode, signals_of
from ..operators.intent import coach, intent_profile
from ..operators.metrics import insights
from ..operators.planning import ground_plan, merge_keywords, model, parse_plans, plan_variants
from ..operators.ranking import diversify, dominance_quota, fuse_ranks, identity_keys, overlap_top, rank_within, repeat_print, rerank_head, vector_top_k
from ..operators.scoring import score_candidates
from ..operators.variants import canonical_intent, keyword_pack, phrase, planned_variants
from ..sources.postings import OverlapIndex
from ..sources.scratch import Scratch
from .phases import Phased, search_phases


def valid_requests(queries: DataFrame, *, least_chars: int = 12, default: int = 20) -> DataFrame:
    """Questions long enough, with their number of results held in 5..40 (FLT-16)."""
    n = F.coalesce(F.col("max_results"), F.lit(default)) if "max_results" in queries.columns else F.lit(default)
    return queries.where(F.length(F.trim(F.coalesce("text", F.lit("")))) >= least_chars).withColumn("max_results", F.greatest(F.lit(5), F.least(F.lit(40), n)))


def retrieve(queries: DataFrame, docs: DataFrame, cfg: Config = Config(), *, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, mode: str = "context") -> DataFrame:
    """(query_id, doc_id, fusion_score, position, …): the lexical list, fused with the vector list if there is one."""
    return fused(overlap_top(queries, docs, cfg.lexical_top_k).select("query_id", "doc_id", "rank"), cfg, vectors=vectors, query_vectors=query_vectors, mode=mode)


def fused(lexical: DataFrame, cfg: Config, *, vectors: DataFrame | None, query_vectors: DataFrame | None, mode: str = "context") -> DataFrame:
    """A ranked list of words, fused with the vectors' list, each with no more than its share."""
    if vectors is not None and query_vectors is not None:
        semantic = vector_top_k(query_vectors, vectors, cfg.semantic_top_k, cap=cfg.vector_top_k_cap).withColumnRenamed("id", "doc_id")
    else:
        semantic = lexical.where("false")
    fused = fuse_ranks(lexical.select("query_id", "doc_id", "rank"), semantic.select("query_id", "doc_id", "rank"), mode=mode, k=cfg.rrf_k)
    return dominance_quota(fused, cfg.lexical_top_k, cap=cfg.dominance_cap)


#: Share of candidates whose chain of elements has to be covered before a question has enough (fixed value).
CHAIN_COVERED = 0.75


def planned_intents(intents: DataFrame) -> DataFrame:
    """The intents with their checklists; where there is a model for plans, its answers are parsed, held to what the question bears out, and go into the checklists (SRC-19, PAR-20..22)."""
    answer = model("plan", F.col("text"))
    if answer is None:
        return build_checklists(intents)
    planned = parse_plans(intents.withColumn("_answer", answer), "_answer").drop("_answer")
    return build_checklists(planned.withColumn("plan", ground_plan(F.col("plan"), F.col("text"))), plan="plan")


def question_variants(asked: DataFrame, *, courts: bool) -> DataFrame:
    """The planned variants of each question with its checklist, for search_phases.

    With `courts`, scoped phases look at the court that the question names, or at both in turn; without, a court is never asked for.
    """
    packed = keyword_pack(canonical_intent(asked))
    suggested = model("keywords", F.col("text"))
    if suggested is not None:
        more = F.coalesce(F.from_json(suggested, "array<string>"), F.array().cast("array<string>"))
        packed = packed.withColumn("keywords", F.col("keywords").withField("search_phrases", merge_keywords(F.col("keywords.search_phrases"), F.transform(more, lambda p: phrase(p)))))
    made = planned_variants(packed)
    if "plan" in asked.columns:  # a model's variants go before the planned ones of their strictness
        strict = F.col("strictness") == "strict"
        own = plan_variants(asked).select(
            "query_id",
            F.lower("phrase").alias("phrase"),
            "strictness",
            F.when(strict, "primary").otherwise("fallback").alias("phase"),
            (F.when(strict, 101).otherwise(71) - F.col("ordinal") % 8).cast("long").alias("priority"),
            F.lit("model_plan").alias("purpose"),
            F.lit("precision").alias("mode"),
            F.col("ordinal").cast("long").alias("ordinal"),
        )
        own = own.withColumns({"tokens": F.split("phrase", " "), "canonical_key": F.concat_ws(":", "strictness", "phrase"), "variant_id": F.concat_ws("_", F.lit("model"), "phase", "ordinal"), "run_ix": F.lit(0)})
        made = own.select(made.columns).union(made)
    hint = asked.select("query_id", "court_hint")
    court = F.when(F.col("court_hint") != "ANY", F.col("court_hint")).when(F.col("ordinal") % 2 == 1, "SC").otherwise("HC") if courts else F.lit("ANY")
    return made.join(hint, "query_id").withColumn("court", court)


def _phases(asked: DataFrame, docs: DataFrame, texts: DataFrame, index: OverlapIndex, cfg: Config, gated: Callable[[DataFrame], DataFrame], courts: bool) -> Phased:
    """The phased search of all questions: hits are classified, and gated by their question's checklist to tell who has enough."""

    # every phase asks for kinds, so the texts are judged once
    kind = classify(F.left("body", F.lit(80)), F.col("body"), F.col("court"))["kind"]
    kinds = Scratch(docs.sparkSession, "kinds")
    told = kinds.store(texts.select("doc_id", "court", kind.alias("kind")), "kinds")

    def describe(hits: DataFrame) -> DataFrame:
        return hits.join(told, "doc_id")

    def judge(hits: DataFrame) -> DataFrame:
        rows = hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
        rows = gated(rows.join(texts.select("doc_id", "body"), "doc_id").withColumn("detail_checked", F.length("body") > 0))
        n = lambda c: F.count_if(c)
        return rows.groupBy("query_id").agg(
            n(F.col("tier") == "exact_strict").alias("strict"),
            n(F.col("tier") == "exact_provisional").alias("provisional"),
            n(F.col("detail_checked")).alias("details"),
            F.bool_or((F.col("tier") == "exact_provisional") & (F.size("missing") > 0)).alias("flawed"),
            (F.avg(F.col("chain_satisfied").cast("double")) >= CHAIN_COVERED).alias("covered"),
            n(F.col("tier") != "reject").alias("results"),
        )

    found = search_phases(question_variants(asked, courts=courts), index, describe, judge, cfg, court_floor=courts)
    found.scratch.also(kinds)
    return found


def search(
    queries: DataFrame,
    docs: DataFrame,
    cfg: Config = Config(),
    *,
    checklist: G.Checklist | None = None,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    index: OverlapIndex | None = None,
    court: Column | None = None,
    day: Column | None = None,
    lexicons: dict | None = None,
    hooks: bool = True,
    graph: bool = True,
) -> DataFrame:
    """Ranked, scored, gated and diversified rows of each question.

    queries: (query_id, text); docs: (doc_id, text, …); vectors: (id, vector) of the documents and query_vectors: (query_id,
    vector), if there are any; lexicons: other ones for intent_profile.  Only the few retrieved candidates are joined with their texts.  Each question is gated by the checklist
    built from it, in the mode that `hooks` and `graph` tell (GAT-08); a constant one takes its place if given.

    With an `index` of the documents, the words' list comes from a phased search of each question's planned variants (phases.search_phases), beside the question's own words, and
    candidates carry what found them; without one, it is that of the question's own words over all documents.

    Small tables are stored on the way; `scratch` of the result removes them, when the result has been stored or is no longer used.
    """
    scratch = Scratch(docs.sparkSession, "search")
    held = scratch.store
    asked = planned_intents(coach(intent_profile(valid_requests(queries), **(lexicons or {}))))
    asked = held(asked.withColumn("checklist", in_mode(F.col("checklist"), hooks=hooks, graph=graph)), "asked")
    terms = None if checklist is not None else checklist_terms(asked)
    texts = docs.select("doc_id", F.col("text").alias("body"), (court if court is not None else F.lit("UNKNOWN")).alias("court"), (day if day is not None else F.lit(None).cast("date")).alias("day"))

    def signalled(rows: DataFrame) -> DataFrame:
        return G.signals(rows, checklist, text="body") if checklist is not None else signals_of(rows, text="body", terms=terms)

    questions = asked.select("query_id", "text")
    if index is None:
        found = retrieve(questions, docs, cfg, vectors=vectors, query_vectors=query_vectors)
    else:
        gated = lambda rows: G.gate(signalled(rows.join(asked.select("query_id", "checklist"), "query_id")), checklist)
        phased = _phases(asked, docs, texts, index, cfg, gated, court is not None)
        own = index.top(questions, cfg.lexical_top_k, scratch=scratch).select("query_id", "doc_id", "score")
        traced = phased.candidates.select("query_id", "doc_id", F.col("score").alias("variant_score"), "strict_hits", "relaxed_hits", "best_utility")
        words = own.join(traced, ["query_id", "doc_id"], "full").withColumn("score", F.coalesce("score", F.lit(0.0)))
        # what more of a question's variants found goes first, then what shares more of its words
        order = [F.desc(F.coalesce("strict_hits", F.lit(0)) * 2 + F.coalesce("relaxed_hits", F.lit(0)) + F.col("score") * 4), F.desc("score"), F.asc("doc_id")]
        words = held(rank_within(words, ["query_id"], order), "words")
        found = fused(words.where(F.col("rank") <= cfg.lexical_top_k).select("query_id", "doc_id", "rank"), cfg, vectors=vectors, query_vectors=query_vectors)
        found = found.join(words.select("query_id", "doc_id", "strict_hits", "relaxed_hits", "best_utility"), ["query_id", "doc_id"], "left")
        scratch.also(phased.scratch)
    rows = found.join(texts, "doc_id").join(asked.select("query_id", F.col("text").alias("query"), "anchors", "issues", "procedures", "statutes", "max_results", "checklist"), "query_id")
    rows = rerank_head(rows.withColumnRenamed("position", "rank"), F.col("query"), F.col("body"), 22)
    rows = rows.withColumn("title", F.left(F.col("body"), F.lit(80))).withColumn("snippet", F.left(F.col("body"), F.lit(500))).withColumn("detail_checked", F.length("body") > 0)
    scored = held(score_candidates(held(signalled(held(rows, "rows")), "signals")), "scored")
    scored = keep_or_all(scored, F.col("score") >= cfg.min_relevance)
    scored = rank_within(scored, ["query_id"], [F.desc("score"), F.asc("new_rank"), F.asc("doc_id")], "score_rank")
    # rows without a known court or day are no repeats of one another
    court_day = F.when((F.col("court") != "UNKNOWN") & F.col("day").isNotNull(), F.concat_ws(":", "court", "day"))
    keys = identity_keys(F.col("title"), F.col("snippet"), F.col("court"), detail=F.col("body"))
    scored = scored.withColumn("keys", keys).withColumn("fingerprint", repeat_print(F.col("title"), F.col("snippet"))).withColumn("court_day", court_day)
    # a question has no more candidates than the lists that were fused
    kept = held(diversify(scored, rank="score_rank", pool=2 * (cfg.lexical_top_k + cfg.semantic_top_k), max_per_fingerprint=cfg.max_per_fingerprint, max_per_court_day=cfg.max_per_court_day), "kept")
    kept = G.split_tiers(G.calibrate(G.gate(kept, checklist)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score_rank"))
    out = kept.withColumn("place", place).where(F.col("place") <= F.col("max_results"))
    out.scratch = scratch
    return out


RESPONSE = ("exact_strict", "exact_provisional", "promoted"), ("near_miss", "unverified", "related")


def respond(questions: DataFrame, results: DataFrame, *, page: int = 1, page_size: int = 20, least: int = 3) -> DataFrame:
    """(query_id, status, mode, n_exact, n_exploratory, n_pages, cases): one response for each question, paged (SRC-20, FBK-04, FBK-05).

    Exact rows come first, then exploratory ones, each in the order of their place; a question without any result has the status `no_match`.
    """
    exact, near = F.col("shown").isin(*RESPONSE[0]), F.col("shown").isin(*RESPONSE[1])
    rows = results.where(exact | near).withColumn("_near", ~exact)
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("query_id").orderBy("_near", "place", "doc_id")))
    case = F.when((F.col("_at") > (page - 1) * page_size) & (F.col("_at") <= page * page_size), F.struct("_at", "doc_id", "shown", "confidence", "score", "title"))
    made = rows.groupBy("query_id").agg(F.count_if(~F.col("_near")).alias("n_exact"), F.count_if("_near").alias("n_exploratory"), F.array_sort(F.collect_list(case)).alias("cases"))
    n = F.coalesce("n_exact", F.lit(0)) + F.coalesce("n_exploratory", F.lit(0))
    out = questions.select("query_id").distinct().join(made, "query_id", "left")
    mode = F.when(F.coalesce("n_exact", F.lit(0)) >= least, "exact").when(F.coalesce("n_exact", F.lit(0)) > 0, "mixed").otherwise("exploratory")
    return out.select("query_id", F.when(n > 0, "completed").otherwise("no_match").alias("status"), mode.alias("mode"), F.coalesce("n_exact", F.lit(0)).alias("n_exact"), F.coalesce("n_exploratory", F.lit(0)).alias("n_exploratory"), F.ceil(n / page_size).alias("n_pages"), F.coalesce("cases", F.array().cast(made.schema["cases"].dataType)).alias("cases"))


def search_insights(results: DataFrame) -> DataFrame:
    return insights(results)
