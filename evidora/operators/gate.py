"""The proposition gate: signals, tiers, confidence (GAT-01, GAT-03..07, JOIN-05, JOIN-06, FLT-09..11, FLT-17, ORD-07, AGG-11).

A checklist is data: axes, hook groups, relations between groups, an outcome,
and steps.  Its terms become part of the plan, so one plan judges all candidates of a
checklist.  Checklists that are built from questions are columns of the rows instead: see checklists.py.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clamp, let, squeeze
from .terms import POSITIONS, counts_against, found, places_of, term_places

RELATION_WINDOW, CHAIN_WINDOW = 220, 260


@dataclass(frozen=True)
class Group:
    group_id: str
    terms: tuple[str, ...]
    required: bool = True
    min_match: int = 1


@dataclass(frozen=True)
class Step:
    """A step of the chain: words that have to stand near one another, or a term that has to be there."""

    step_id: str
    left: tuple[str, ...]
    right: tuple[str, ...] = ()
    mandatory: bool = True


@dataclass(frozen=True)
class Checklist:
    axes: tuple[tuple[str, tuple[str, ...], bool], ...] = ()  # (label, terms, required)
    groups: tuple[Group, ...] = ()
    relations: tuple[tuple[str, str], ...] = ()  # pairs of group ids that have to interact
    outcome: tuple[str, ...] = ()
    outcome_contradictions: tuple[str, ...] = ()
    outcome_required: bool = False
    contradictions: tuple[str, ...] = ()
    interaction_required: bool = False
    steps: tuple[Step, ...] = field(default=())

    def with_pairs(self, most: int = 4) -> Checklist:
        """The checklist with a relation between each two of the first required groups (JOIN-05)."""
        ids = [g.group_id for g in self.groups if g.required][:most]
        return Checklist(**{**self.__dict__, "relations": tuple(combinations(ids, 2))})


def gate_text(text: Column) -> Column:
    """Lower-case text of letters, digits and ``().,/:-`` (TOK-10)."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9()./:\-\s]", " "))


def near_starts(left: Column, right: Column, window: int) -> Column:
    """Some place of either list is within `window` characters of one of the other."""
    return F.exists(left, lambda x: F.exists(right, lambda y: F.abs(x - y) <= window))


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def _share(parts: list[Column], empty: float) -> Column:
    return sum((p.cast("int") for p in parts), F.lit(0)) / len(parts) if parts else F.lit(empty)


def signals(df: DataFrame, checklist: Checklist, *, text: str = "text", evidence: str | None = None, checked: str = "detail_checked") -> DataFrame:
    """Add the proposition's signals to each candidate (GAT-01, GAT-02, GAT-05)."""
    # one pass over a text gives the places of all terms; what follows reads these
    terms = [t for _, ts, _ in checklist.axes for t in ts] + [t for g in checklist.groups for t in g.terms] + [t for s in checklist.steps for t in (*s.left, *s.right)] + [*checklist.outcome, *checklist.outcome_contradictions, *checklist.contradictions]
    df = df.withColumn("_t", term_places(gate_text(F.col(text)), terms))
    if evidence:
        own = F.when(F.length(F.coalesce(F.col(evidence), F.lit(""))) > 0, gate_text(F.col(evidence)))
        df = df.withColumn("_e", F.coalesce(F.when(own.isNotNull(), term_places(own, terms)), F.col("_t")))
    else:
        df = df.withColumn("_e", F.col("_t"))
    t, e = F.col("_t"), F.col("_e")
    some = lambda where, words: _any([found(where, x) for x in words if x])
    at = lambda where, words: places_of(where, F.array(*[F.lit(x) for x in words]))
    groups = {g.group_id: g for g in checklist.groups}
    required = [g for g in checklist.groups if g.required]
    hooks = [some(t, g.terms) if g.min_match <= 1 else sum((found(t, x).cast("int") for x in g.terms), F.lit(0)) >= g.min_match for g in required]
    pairs = [(a, b) for a, b in checklist.relations if a in groups and b in groups]
    # the places of a group are put together once, for all its relations
    related = {g: f"_p{i}" for i, g in enumerate(sorted({g for pair in pairs for g in pair}))}
    df = df.withColumns({name: at(e, groups[g].terms) for g, name in related.items()})
    relations = [near_starts(F.col(related[a]), F.col(related[b]), RELATION_WINDOW) for a, b in pairs]
    chain = lambda s: let(at(t, s.right), lambda right: near_starts(at(t, s.left), right, CHAIN_WINDOW)) if s.left else F.lit(False)
    steps = [(s, chain(s) if s.right else some(t, s.left)) for s in checklist.steps]
    df = df.withColumns({f"_h{i}": x for i, x in enumerate(hooks)} | {f"_r{i}": x for i, x in enumerate(relations)} | {f"_s{i}": x for i, (_, x) in enumerate(steps)} | {f"_a{i}": some(t, words) for i, (_, words, _) in enumerate(checklist.axes)})
    h = [F.col(f"_h{i}") for i in range(len(hooks))]
    satisfied = _all([F.col(f"_r{i}") for i in range(len(relations))])
    outcome = some(e, checklist.outcome)
    against = _any([counts_against(e, x) for x in checklist.outcome_contradictions if x])
    outcome_ok = (outcome & ~against) if checklist.outcome_required else F.lit(True)
    df = df.withColumn("relation_satisfied", satisfied).withColumn("outcome_satisfied", outcome_ok).withColumn("contradiction", against | _any([counts_against(e, x) for x in checklist.contradictions if x]))
    # chain steps count only for candidates whose detail text was checked
    verified = F.coalesce(F.col(checked), F.lit(False)) if checked in df.columns else F.lit(False)
    step_ok = [(s, F.col(f"_s{i}") | ~verified if s.right else F.col(f"_s{i}")) for i, (s, _) in enumerate(steps)]
    mandatory = [c for s, c in step_ok if s.mandatory]
    interacts = bool(relations) or checklist.interaction_required
    enough = (sum((x.cast("int") for x in h), F.lit(0)) > 1) if len(h) > 1 else F.lit(True)
    core = [*h, *([F.col("relation_satisfied") & enough] if interacts else []), *([F.col("outcome_satisfied")] if checklist.outcome_required else []), *mandatory]
    peripheral = [*[F.col(f"_a{i}") for i, a in enumerate(checklist.axes) if a[2]], *[c for s, c in step_ok if not s.mandatory]]
    out = df.withColumns(
        {
            "hook_coverage": F.round(_share(h, 1.0), 6),
            "core_coverage": F.round(_share(core, 1.0), 6),
            "peripheral_coverage": F.round(_share(peripheral, 1.0), 6),
            "required_coverage": F.round(_share([*core, *peripheral], 0.0), 6),
            "step_coverage": F.round(_share(mandatory, 1.0), 6),
            "chain_satisfied": _all([c for s, c in step_ok if s.right]),
            "polarity_mismatch": F.lit(checklist.outcome_required) & ~F.col("outcome_satisfied"),
            "relation_required": F.lit(interacts),
            "outcome_required": F.lit(checklist.outcome_required),
            "missing": F.filter(F.array(*[F.when(~x, F.lit(f"hook group:{g.group_id}")) for g, x in zip(required, h)], F.when(F.lit(interacts) & ~F.col("relation_satisfied"), F.lit("required hook interaction")), *[F.when(~F.col(f"_a{i}") & F.lit(r), F.lit(label)) for i, (label, _, r) in enumerate(checklist.axes)]), lambda m: m.isNotNull()),
        }
    )
    return out.drop("_t", "_e", *[c for c in out.columns if re.fullmatch(r"_[hrsap]\d+", c)])


def threshold(n: Column) -> Column:
    """Share of the required parts that a near miss has to have (GAT-04)."""
    return F.when(n <= 1, 1.0).when(n == 2, 0.5).when(n == 3, 2 / 3).otherwise(0.75)


def _sizes(checklist: Checklist | None, column: str) -> dict[str, Column]:
    """What the gate has to know of a checklist, of a constant one or of the row's own."""
    if checklist is not None:
        n = {"hooks": sum(g.required for g in checklist.groups), "axes": sum(a[2] for a in checklist.axes), "must": sum(s.mandatory for s in checklist.steps), "side": sum(not s.mandatory for s in checklist.steps)}
        flags = {"relations": bool(checklist.relations), "interacts": checklist.interaction_required, "outcome": checklist.outcome_required}
        return {k: F.lit(v) for k, v in (n | flags).items()}
    c = F.col(column)
    count = lambda xs, test: F.size(F.filter(xs, test))
    return {
        "hooks": count(c["groups"], lambda g: g["required"]), "axes": count(c["axes"], lambda a: a["required"]), "must": count(c["steps"], lambda s: s["mandatory"]), "side": count(c["steps"], lambda s: ~s["mandatory"]),
        "relations": F.size(c["relations"]) > 0, "interacts": c["interaction_required"], "outcome": c["outcome_required"],
    }


def gate(df: DataFrame, checklist: Checklist | None = None, *, column: str = "checklist", strength: str = "context_strength", checked: str = "detail_checked") -> DataFrame:
    """Add `branch`, the branch of an ordered decision list that a row takes, and its `tier`: exact_strict, exact_provisional, near_miss or reject (GAT-03).

    Without a constant checklist, each row's own is in `column`.
    """
    k = _sizes(checklist, column)
    related = k["relations"] | k["interacts"]
    n_core = k["hooks"] + related.cast("int") + k["outcome"].cast("int") + k["must"]
    least, core_least = threshold(n_core + k["axes"] + k["side"]), F.greatest(F.lit(0.65), threshold(n_core))
    c = F.col
    context = F.coalesce(c(strength), F.lit(0)) if strength in df.columns else F.lit(0)
    verified = F.coalesce(c(checked), F.lit(False)) if checked in df.columns else F.lit(False)
    fine = ~c("contradiction")
    doctrinal = (k["hooks"] > 0) | related | k["outcome"]
    complete = (c("core_coverage") >= 1) & (c("hook_coverage") >= 1) & c("relation_satisfied") & c("outcome_satisfied")
    strict = verified & fine & complete & (c("step_coverage") >= 1) & c("chain_satisfied") & (c("peripheral_coverage") >= 0.6)
    provisional = fine & complete & (c("step_coverage") >= F.when(verified, 1.0).otherwise(0.75))
    single = fine & (k["hooks"] == 1) & ~k["outcome"] & ~related & (c("hook_coverage") >= 1) & (c("required_coverage") >= 0.5) & (c("core_coverage") >= 0.5) & (context >= 2)
    relaxed = fine & (c("core_coverage") >= 0.35) & (c("hook_coverage") >= 0.5) & (c("required_coverage") >= 0.35) & (c("step_coverage") >= 0.25) & (verified | (context >= 1)) & (c("outcome_satisfied") | (c("core_coverage") >= 0.6))
    close = (c("core_coverage") >= core_least) & (c("required_coverage") >= least)
    supported = (context >= 2) & (c("required_coverage") >= F.greatest(F.lit(0.4), least - 0.2)) & (c("core_coverage") >= F.greatest(F.lit(0.35), core_least - 0.25)) & (c("hook_coverage") >= 0.5) & (c("outcome_satisfied") | (c("core_coverage") >= 0.65))
    near_miss = doctrinal & fine & (close | supported)
    branch = F.when(strict, "strict").when(provisional, "provisional").when(single, "single_hook").when(relaxed, "relaxed").when(near_miss, "near_miss").otherwise("reject")
    tier = F.when(c("branch") == "strict", "exact_strict").when(c("branch").isin("provisional", "single_hook", "relaxed"), "exact_provisional").otherwise(c("branch"))
    return df.withColumn("doctrinal", doctrinal).withColumn("branch", branch).withColumn("tier", tier)


#: Most confidence of a tier (fixed values).
TIER_CAPS = {"exact_strict": 0.95, "exact_provisional": 0.70, "near_miss": 0.45, "reject": 0.5}


def calibrate(df: DataFrame, *, score: str = "score", checked: str = "detail_checked", sentences: str = "evidence_quality") -> DataFrame:
    """Add `confidence`: base and structure blended, adjusted, and capped by tier (GAT-06).

    `sentences`, if there, is a struct of what the detail text's sentences show (html.evidence_quality).
    """
    c = F.col
    yes = lambda name: c(name) if name in df.columns else F.lit(True)
    shows = lambda name: F.coalesce(c(f"{sentences}.{name}"), F.lit(False)) if sentences in df.columns else F.lit(False)
    verified = F.coalesce(c(checked), F.lit(False)) if checked in df.columns else F.lit(False)
    plus = lambda condition, w: F.when(condition, w).otherwise(0.0)
    structure = c("core_coverage") * 0.34 + c("step_coverage") * 0.22 + plus(c("chain_satisfied"), 0.1) + c("hook_coverage") * 0.12 + plus(c("relation_satisfied"), 0.08) + plus(c("outcome_satisfied"), 0.08) + c("peripheral_coverage") * 0.06
    value = clamp(c(score) * 0.45 + structure * 0.55) - plus(~verified, 0.06)
    value = value + plus(shows("role"), 0.02) + plus(shows("chain"), 0.02) + plus(shows("relation"), 0.03) + plus(shows("polarity"), 0.03) + plus(shows("hook_intersection"), 0.03)
    value = value - plus(~yes("role_satisfied"), 0.12) - plus(~yes("proceeding_satisfied"), 0.08) - plus(~c("chain_satisfied"), 0.12)
    value = value - plus(~shows("relation") & ~c("relation_satisfied"), 0.03) - plus(~shows("polarity") & ~c("outcome_satisfied"), 0.04)
    value = clamp(value - plus(c("polarity_mismatch"), 0.16) - plus(c("contradiction"), 0.25))
    cap = F.lit(0.5)
    for tier, most in TIER_CAPS.items():
        cap = F.when(c("tier") == tier, most).otherwise(cap)
    if sentences in df.columns:  # only what its sentences bear out in all ways is sure
        sure = (c("tier") == "exact_strict") & verified & shows("role") & shows("chain") & shows("relation") & shows("polarity") & shows("hook_intersection")
        cap = F.when(sure, cap).otherwise(F.least(cap, F.lit(TIER_CAPS["exact_provisional"])))
    cap = F.when(verified, cap).otherwise(F.least(cap, F.lit(0.55)))
    return df.withColumn("confidence", F.round(F.least(value, cap), 3)).withColumn("saturated", value > cap)


def split_tiers(df: DataFrame, *, group: str = "query_id", key: str = "doc_id", checked: str = "detail_checked", unverified: int = 8, related: int = 4, promoted: int = 3) -> DataFrame:
    """Rows with their `shown` tier, after three passes that back-fill groups with few results (GAT-07, ORD-07).

    exact ones and near misses are shown as they are.  Of the rejects without contradiction,
    1. where nothing is exact or near, up to `unverified` whose detail was not checked are shown as `unverified`;
    2. where fewer than `related` are near by now, the best others as `related`, as many as lack;
    3. where fewer than `promoted` are exact, the best as `promoted`, as many as lack; this goes before the other two.
    Each pass has its own order of strength; ties go by key.
    """
    c = F.col
    w = Window.partitionBy(group)
    verified = F.coalesce(c(checked), F.lit(False)) if checked in df.columns else F.lit(False)
    exact, close = c("tier").isin("exact_strict", "exact_provisional"), c("tier") == "near_miss"
    reject = (c("tier") == "reject") & ~c("contradiction")
    some = lambda need, core, hook: (c("required_coverage") >= need) | (c("core_coverage") >= core) | (c("hook_coverage") >= hook)
    fits = ~c("polarity_mismatch")
    loosely = fits | ((c("required_coverage") >= 0.3) & (c("core_coverage") >= 0.3) & (c("hook_coverage") >= 0.4))
    doctrinal = c("doctrinal") if "doctrinal" in df.columns else F.lit(True)
    strength = lambda a, b, h, o, minus, conf: F.round(c("required_coverage") * a + c("core_coverage") * b + c("hook_coverage") * h + F.when(c("outcome_satisfied"), o).otherwise(0.0) - F.when(c("polarity_mismatch"), minus).otherwise(0.0) + c("confidence") * conf, 6)
    rows = df.withColumns({"_exact": F.count_if(exact).over(w), "_near": F.count_if(close).over(w)})
    place = lambda able, order: F.when(able, F.row_number().over(Window.partitionBy(group, able).orderBy(F.desc(order), F.asc(key))))
    passes = {
        "_1": (reject & ~verified & fits & doctrinal & some(0.25, 0.2, 2.0), strength(0.45, 0.35, 0.1, 0.1, 0.0, 0.4)),
        "_2": (reject & loosely & some(0.25, 0.25, 0.4), strength(0.4, 0.35, 0.15, 0.12, 0.08, 0.35)),
        "_3": (reject & fits & some(0.3, 0.3, 0.5), strength(0.4, 0.35, 0.15, 0.1, 0.0, 0.35)),
    }
    rows = rows.withColumns({f"{n}s": order for n, (_, order) in passes.items()} | {f"{n}a": F.coalesce(able, F.lit(False)) for n, (able, _) in passes.items()})
    rows = rows.withColumn("_3p", place(c("_3a"), "_3s")).withColumn("_1p", place(c("_1a"), "_1s"))
    third = F.coalesce(c("_3p") <= promoted - c("_exact"), F.lit(False))
    first = F.coalesce((c("_exact") == 0) & (c("_near") == 0) & (c("_1p") <= unverified), F.lit(False))
    rows = rows.withColumns({"_third": third, "_first": first})
    rows = rows.withColumn("_2a", c("_2a") & ~c("_first")).withColumn("_2p", place(c("_2a"), "_2s")).withColumn("_near", c("_near") + F.count_if(c("_first")).over(w))
    second = F.coalesce(c("_2p") <= related - c("_near"), F.lit(False))
    shown = F.when(c("tier") != "reject", c("tier")).when(c("_third"), F.lit("promoted")).when(c("_first"), F.lit("unverified")).when(second, F.lit("related"))
    out = rows.withColumn("shown", shown)
    return out.select(*df.columns, "shown")


def gate_summary(df: DataFrame, *, group: str = "query_id") -> DataFrame:
    """Coverage averages, failures and the tiers' counts of each group (AGG-11)."""
    return df.groupBy(group).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in TIER_CAPS],
        *[F.round(F.avg(k), 3).alias(f"avg_{k}") for k in ("required_coverage", "core_coverage", "hook_coverage")],
        F.count_if(~F.col("relation_satisfied")).alias("relation_failures"),
        F.count_if("polarity_mismatch").alias("polarity_failures"),
        F.count_if("contradiction").alias("contradictions"),
        F.max("confidence").alias("max_confidence"),
    )


def mentions_groups(phrase: Column, groups: tuple[Group, ...]) -> Column:
    """All required groups have a term in the phrase; with one group any of its terms (FLT-09)."""
    low = F.lower(phrase)
    needed = [g for g in groups if g.required]
    return _all([_any([F.contains(low, F.lit(t)) for t in g.terms]) for g in needed])
