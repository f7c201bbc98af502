"""Weighted scores of candidates (SCR-01..07, FLT-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SCORING, clamp, count_terms_of, overlap_ratio

#: (least score, band), the highest first (fixed values).
BANDS = [(0.86, "VERY_HIGH"), (0.71, "HIGH"), (0.51, "MEDIUM")]
#: Share of each overlap in the blend, and the weights of blend and overlaps in the lexical score (fixed values).
BLEND = {"raw": 0.2, "must": 0.35, "strict": 0.25, "checklist": 0.2}
LEXICAL = {"blend": 0.16, "must": 0.08, "strict": 0.05, "checklist": 0.04}
#: (weight of a match, most) of context terms (fixed values).
CONTEXT = {"anchors": (0.018, 0.09), "issues": (0.05, 0.16), "procedures": (0.045, 0.12), "statutes": (0.03, 0.1)}
#: Weights of proposition coverage where a detail text was checked; else they count UNCHECKED of that (fixed values).
COVERAGE = {"required_coverage": 0.26, "core_coverage": 0.26, "peripheral_coverage": 0.1, "hook_coverage": 0.2}
UNCHECKED = 0.62


def band(score: Column, bands: list[tuple[float, str]] = BANDS, low: str = "LOW") -> Column:
    out = F.lit(low)
    for least, name in reversed(bands):
        out = F.when(score >= least, name).otherwise(out)
    return out


def squash(raw: Column, cap: float = 0.92) -> Column:
    """The raw score on the scale of confidence: a logistic curve around 0.45, at most `cap`."""
    return F.least(F.lit(cap), clamp(1 / (1 + F.exp(-(raw - 0.45) * 3.1))))


def lexical_score(corpus: Column, *, raw: Column, must: Column, strict: Column, checklist: Column) -> dict[str, Column]:
    """Overlaps of the query's token lists with the candidate's tokens, their blend and the lexical score (SCR-02)."""
    have = {k: overlap_ratio(v, corpus) for k, v in {"raw": raw, "must": must, "strict": strict, "checklist": checklist}.items()}
    have["blend"] = sum((have[k] * w for k, w in BLEND.items()), F.lit(0.0))
    have["lexical"] = sum((have[k] * w for k, w in LEXICAL.items()), F.lit(0.0))
    return have


def score_candidates(df: DataFrame) -> DataFrame:
    """Score candidate rows joined with their query, proposition signals and provenance (SCR-07).

    Needs title, snippet, court and the query's text; what else there is of body,
    must_tokens, strict_tokens, checklist_tokens, contradiction_tokens, anchors, issues, procedures,
    statutes, the coverage columns of the gate, fusion_score, rerank_score, strict_hits, relaxed_hits,
    best_utility, cites, cited_by, author, bench and evidence_flag is used.  Adds score, band, reasons and
    raw_score.
    """
    has = {c.lower() for c in df.columns}
    col = lambda c, default=None: F.col(c) if c in has else F.lit(default)
    texts = lambda c: F.col(c) if c in has else F.array().cast("array<string>")
    corpus = F.concat_ws(" ", "title", "snippet", col("body", "").cast("string"))
    tokens = lambda c: SCORING.distinct(F.array_join(texts(c), " "))
    df = df.withColumn("_corpus", corpus)
    parts = lexical_score(SCORING.distinct(F.col("_corpus")), raw=SCORING.distinct(F.col("query")), must=tokens("must_tokens"), strict=tokens("strict_tokens"), checklist=tokens("checklist_tokens"))
    df = df.withColumns({f"_{k}": v for k, v in parts.items()}).withColumns({f"{k}_matched": count_terms_of(F.col("_corpus"), texts(k)) for k in CONTEXT})
    df = df.withColumn("_contra", count_terms_of(F.col("_corpus"), tokens("contradiction_tokens")))
    checked = F.coalesce(col("detail_checked", False).cast("boolean"), F.lit(False))
    weight = F.when(checked, 1.0).otherwise(UNCHECKED)
    if_ = lambda cond, value: F.when(F.coalesce(cond, F.lit(False)), value).otherwise(F.lit(0.0))
    raw = F.col("_lexical")
    for k, (w, most) in CONTEXT.items():
        raw = raw + F.least(F.col(f"{k}_matched") * w, F.lit(most))
    gated = "required_coverage" in has
    if gated:
        for k, w in COVERAGE.items():
            raw = raw + F.greatest(F.col(k), F.lit(0.0)) * w * weight
        raw = raw + if_(F.col("relation_satisfied") & F.col("relation_required"), 0.08 * weight) + if_(F.col("outcome_satisfied") & F.col("outcome_required"), 0.09 * weight)
        raw = raw - if_(~F.col("relation_satisfied") & F.col("relation_required"), F.lit(0.16)) - if_(F.col("polarity_mismatch"), F.lit(0.24)) - if_(F.col("contradiction"), F.lit(0.32)) - if_(F.col("hook_coverage") < 1, F.lit(0.1))
    drift = (F.col("_contra") > 0) & (col("required_coverage", 0.0) < 0.4) & (col("core_coverage", 0.0) < 0.4) & ~F.coalesce(col("outcome_satisfied", not gated).cast("boolean"), F.lit(False))
    raw = raw - if_(drift, F.least(F.lit(0.22), F.col("_contra") * 0.06))
    raw = raw + F.when(checked, 0.05).otherwise(-0.12)
    fusion = clamp(F.coalesce(col("fusion_score").cast("double"), F.lit(0.0)) * 8)
    raw = raw + fusion * 0.06 + if_(col("rerank_score").isNotNull(), (clamp(col("rerank_score").cast("double")) - 0.5) * 0.16)
    strict, relaxed, utility = (F.coalesce(col(c, 0).cast("double"), F.lit(0.0)) for c in ("strict_hits", "relaxed_hits", "best_utility"))
    known = col("best_utility").isNotNull()
    proven = known & checked & (strict > 0) & (utility >= 0.55)
    broad = known & ~checked & (strict == 0) & (utility < 0.25)
    raw = raw + if_(proven, F.lit(0.06)) - if_(broad, F.lit(0.08))
    raw = raw + F.when(F.col("court") == "SC", 0.04).when(F.col("court") == "HC", 0.03).otherwise(0.0)
    raw = raw + if_(col("cited_by", 0) >= 50, F.least(col("cited_by", 0) / 3000, F.lit(0.09))) + if_(col("cites", 0) >= 20, F.least(col("cites", 0) / 2500, F.lit(0.04)))
    for c in ("author", "bench"):
        raw = raw + if_(F.length(col(c).cast("string")) > 2, F.lit(0.015))
    raw = raw + if_(col("evidence_flag", False).cast("boolean"), F.lit(0.03))
    df = df.withColumn("raw_score", raw)
    squashed = squash(F.col("raw_score"))
    capped = F.when(F.coalesce(broad & (relaxed > 0), F.lit(False)), F.least(squashed, F.lit(0.68))).otherwise(squashed)
    final = F.when(F.coalesce(proven, F.lit(False)), F.least(F.lit(0.94), capped + 0.03)).otherwise(capped)
    percent = lambda x: F.round(x * 100).cast("int").cast("string")
    say = lambda cond, *text: F.when(F.coalesce(cond, F.lit(False)), F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]))
    reasons = [say(F.col("_blend") > 0.16, "Token overlap ", percent(F.col("_blend")), "%"), say(F.col("_must") > 0.2, "Canonical term overlap ", percent(F.col("_must")), "%"), say(F.col("_strict") > 0.2, "Strict-query overlap ", percent(F.col("_strict")), "%")]
    reasons += [say(F.col(f"{k}_matched") > 0, f"{k.capitalize()} matched: ", F.col(f"{k}_matched").cast("string")) for k in CONTEXT]
    if gated:
        reasons += [say(F.col(k) > 0, f"{k.replace('_', ' ').capitalize()} ", percent(F.col(k)), "%") for k in COVERAGE]
        reasons += [say(F.col("polarity_mismatch"), "Outcome polarity mismatch"), say(F.col("contradiction"), "Contradiction against the required outcome")]
    reasons += [say(drift, "Contradiction-only lexical drift"), say(checked, "Detail verified"), say(~checked, "Detail not verified"), say(proven, "High-utility strict retrieval"), say(broad, "Broad-only low-utility retrieval")]
    df = df.withColumn("score", F.round(final, 3)).withColumn("band", band(final)).withColumn("reasons", F.filter(F.array(*reasons), lambda r: r.isNotNull()))
    return df.drop("_corpus", "_contra", *[f"_{k}" for k in parts])
