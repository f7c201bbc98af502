"""Keyword packs, canonical intents and planned query variants (QRY-19, QRY-21..23, QRY-31)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import cache_key
from ..functions.text import KEYWORDS, REWRITE, ordered_distinct, squeeze
from .intent import PHASES, keyword_windows
from .ranking import rank_within

# Words that widen a search where an outcome is meant (fixed values).
OUTCOME_SYNONYMS = [
    (r"\b(?:delay\s+not\s+condon(?:ed|able)|condonation(?:\s+of\s+delay)?\s+(?:refused|rejected|denied|declined)|refused)\b", ["condonation of delay refused", "application for condonation rejected", "delay condonation denied"]),
    (r"\b(?:time[-\s]*barred|barred by limitation|dismissed as time barred|limitation)\b", ["appeal dismissed as time barred", "barred by limitation", "dismissed on limitation"]),
    (r"\b(?:sanction\s+required|prior sanction|mandatory sanction|required)\b", ["sanction required for prosecution", "prior sanction mandatory", "previous sanction required"]),
    (r"\b(?:sanction\s+not\s+required|without\s+sanction|no\s+sanction\s+required|not required)\b", ["sanction not required", "without prior sanction", "no sanction required"]),
]
ONLY_ASKS = r"\b(?:doctypes|sortby|fromdate|todate):\S+|\b(?:cases?|precedents?|judgments?)\s+where\b|\b(?:find|show|list)\s+(?:me\s+)?(?:cases?|precedents?|judgments?)\b"


def phrase(text: Column, words: int = 12) -> Column:
    """A search phrase: letters, digits and ``()/.-``, without what only asks, of so many words at most."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), ONLY_ASKS, " ")
    return F.array_join(F.slice(F.split(squeeze(F.regexp_replace(low, r"[^a-z0-9\s()/.-]", " ")), " "), 1, words), " ")


def _long(xs: Column, least: int, most: int | None = None) -> Column:
    return ordered_distinct(F.filter(xs, lambda p: F.length(p) >= least), most)


def _each(xs: Column, words: int, most: int = 99) -> Column:
    return F.slice(F.transform(xs, lambda x: phrase(x, words)), 1, most)


def _or_blank(xs: Column, most: int) -> Column:
    return F.when(F.size(xs) > 0, F.slice(xs, 1, most)).otherwise(F.array(F.lit("")))


def _cross(xs: Column, ys: Column, words: int = 12) -> Column:
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: phrase(F.concat_ws(" ", x, y), words))))


def _named(p: Column, hook: Column) -> Column:
    """The phrase names a hook, with or without the word section."""
    return F.contains(p, F.regexp_replace(hook, r"^section\s+", ""))


def keyword_pack(intents: DataFrame, *, text: str = "cleaned") -> DataFrame:
    """Add `keywords`, a struct of primary, legal_signals and search_phrases, of each intent (QRY-19).

    Phrases come from pairs of statutes with outcomes and procedures, synonyms, combined axes, concepts, court variants and windows.  With two
    statutes or more a phrase has to name one; without any it has to name an actor, a procedure and an outcome.
    """
    no = F.array().cast("array<string>")
    hooks, outcomes, procedures, actors = (F.col(c) for c in ("statutes", "issues", "procedures", "actors"))

    def pairs(hs: Column) -> Column:
        two = F.flatten(F.transform(F.slice(hs, 1, 3), lambda a, i: F.transform(F.slice(hs, i + 2, F.greatest(F.lit(0), F.lit(3) - i)), lambda b: phrase(F.concat_ws(" ", a, b), 11))))
        more = F.concat(_each(outcomes, 6, 3), _each(procedures, 6, 3))
        return _long(F.flatten(F.transform(two, lambda p: F.concat(F.array(p), F.transform(more, lambda m: phrase(F.concat_ws(" ", p, m), 12))))), 10, 12)

    bag = F.concat_ws(" ", phrase(F.col(text)), F.array_join(outcomes, " "), F.array_join(procedures, " "), F.array_join(hooks, " "))
    wider = F.concat(F.array(phrase(F.col(text))), _each(outcomes, 12), _each(procedures, 12), _each(hooks, 12), *[F.when(bag.rlike(p), F.array(*[F.lit(x) for x in xs])).otherwise(no) for p, xs in OUTCOME_SYNONYMS])
    axes = F.concat(
        _cross(_cross(_or_blank(actors, 3), F.slice(procedures, 1, 3)), _or_blank(hooks, 4)),
        _cross(F.slice(outcomes, 1, 4), _or_blank(procedures, 3)),
        _cross(F.slice(hooks, 1, 4), _or_blank(outcomes, 4)),
    )
    tokens_of = lambda c: F.flatten(F.transform(c, lambda x: F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: F.length(t) > 2)))
    df = intents.withColumns(
        {
            "_core": F.slice(F.filter(_each(hooks, 8), lambda h: F.length(h) > 2), 1, 6),
            "_pairs": pairs(F.filter(_each(hooks, 8), lambda h: F.length(h) > 3)),
            "_wider": _long(wider, 6, 16),
            "_axes": _long(axes, 8),
            "_concepts": _long(F.concat(_each(actors, 10), _each(procedures, 10), _each(hooks, 10), _each(outcomes, 10), _each(F.col("domains"), 10)), 4),
            "_signals": _long(F.concat(_each(hooks, 10), _each(procedures, 10), _each(outcomes, 10)), 4, 16),
            "_windows": keyword_windows(F.col(text)),
            "_tokens": KEYWORDS.all(F.col(text)),
            "_words": F.array(tokens_of(actors), tokens_of(procedures), tokens_of(outcomes)),
        }
    )

    def fits(p: Column, alone: Column) -> Column:
        hooked = F.exists("_core", lambda h: _named(p, h))
        toks = F.split(p, "[^a-z0-9]+")
        shaped = (F.size(toks) >= 4) & F.forall("_words", lambda ws: F.exists(ws, lambda w: F.array_contains(toks, w)))
        return F.when(F.size("_core") >= 2, hooked).when(F.size("_core") == 0, shaped & alone).otherwise(True)

    courts = lambda xs, most: F.flatten(F.transform(F.slice(xs, 1, most), lambda p: F.transform(F.array(F.lit(" supreme court"), F.lit(" high court")), lambda c: F.concat(phrase(p, 10), c))))
    search = F.concat("_pairs", "_wider", F.slice("_axes", 1, 10), F.slice("_concepts", 1, 8), courts(F.col("_axes"), 4), courts(F.col("_pairs"), 3), F.slice("_windows", 1, 4))
    search = F.slice(F.filter(_long(_each(search, 12), 8), lambda p: fits(p, F.lit(True))), 1, 24)
    primary = ordered_distinct(F.concat("_concepts", "_wider", "_tokens", "_signals", "_windows", "_axes"))
    primary = F.slice(F.filter(primary, lambda p: F.array_contains(F.col("_pairs"), p) | fits(p, F.contains(p, F.lit(" ")))), 1, 36)
    return df.select(*intents.columns, F.struct(primary.alias("primary"), F.col("_signals").alias("legal_signals"), search.alias("search_phrases")).alias("keywords"))


def canonical_intent(checked: DataFrame) -> DataFrame:
    """Add `canonical`: what all variants of a question have to keep (QRY-21).

    checked has an intent and its checklist (checklists.build_checklists).
    """
    c = F.col("checklist")
    required = F.filter(c["groups"], lambda g: g["required"])
    axis = lambda i: F.slice(F.get(c["axes"], F.lit(i))["terms"], 1, 8)
    hooks = F.transform(required, lambda g: F.get(g["terms"], F.lit(0)))
    made = F.struct(
        axis(0).alias("actors"),
        axis(1).alias("proceedings"),
        F.slice(c["outcome"], 1, 8).alias("outcomes"),
        hooks.alias("hooks"),
        F.transform(required, lambda g: g["group_id"]).alias("group_ids"),
        c["polarity"].alias("polarity"),
        c["outcome_contradictions"].alias("exclusions"),
        F.col("either").alias("either"),
        F.col("court_hint").alias("court"),
        F.col("window").alias("window"),
        F.concat(F.slice(axis(0), 1, 2), F.slice(axis(1), 1, 2), hooks).alias("must_have"),
    )
    return checked.withColumn("canonical", made)


def planned_variants(canonical: DataFrame, *, group: str = "query_id", strict: int = 12, broad: int = 24, most: int = 40) -> DataFrame:
    """Variants of each question over the phases, guarded, and with a backstop where no strict one is left (QRY-22, QRY-23).

    canonical has `canonical` and `keywords`.  Strict phrases are actor, proceeding and outcome (three of each) with the hooks; a
    strict phrase has to name every required hook (one, where the question asks for either), and none may name a term that contradicts the outcome.  Where no
    strict phrase is left, the hooks with the main proceeding and outcome, and the question's own words, stand in.  Broad ones are the keyword pack's, four
    a phase.  A phrase is told once a question, in its first phase.
    """
    c = F.col("canonical")
    hooks = F.array_join(F.when(c["either"], F.slice(c["hooks"], 1, 1)).otherwise(c["hooks"]), " ")
    lanes = _cross(_cross(_cross(_or_blank(c["actors"], 3), _or_blank(c["proceedings"], 3), 16), F.array(hooks), 16), _or_blank(c["outcomes"], 3), 16)
    keeps = lambda p: F.when(c["either"] & (F.size(c["hooks"]) > 0), F.exists(c["hooks"], lambda h: _named(p, h))).otherwise(F.forall(c["hooks"], lambda h: _named(p, h)))
    clear = lambda p: ~F.exists(c["exclusions"], lambda x: F.contains(p, x) & ~F.exists(c["outcomes"], lambda o: F.contains(o, x)))
    words = lambda p: F.size(F.split(p, " "))
    tight = F.filter(_long(lanes, 8), lambda p: keeps(p) & clear(p) & (words(p) >= 4))
    backstop = _long(F.array(phrase(F.concat_ws(" ", hooks, F.get(c["proceedings"], F.lit(0)), F.get(c["outcomes"], F.lit(0))), 14), phrase(F.col("cleaned"), 14)), 8, 2)
    df = canonical.withColumn("_tight", tight)
    df = df.withColumn("_strict", F.when(F.size("_tight") > 0, F.slice("_tight", 1, strict)).otherwise(backstop)).withColumn("_backstop", F.size("_tight") == 0)
    df = df.withColumn("_broad", F.slice(F.filter(ordered_distinct(F.concat("keywords.search_phrases", "keywords.primary")), lambda p: clear(p) & (words(p) >= 2) & ~F.array_contains(F.col("_strict"), p)), 1, broad))
    tag = lambda xs, name: F.transform(xs, lambda p, i: F.struct(p.alias("phrase"), F.lit(name).alias("strictness"), (i + 1).alias("ix")))
    rows = df.select(group, "_backstop", F.explode(F.concat(tag(F.col("_strict"), "strict"), tag(F.col("_broad"), "relaxed"))).alias("v")).select(group, "_backstop", "v.*")
    is_strict = F.col("strictness") == "strict"
    made = rows.select(
        group,
        "phrase",
        "strictness",
        F.when(is_strict, F.lit("primary")).otherwise(F.get(F.array(*[F.lit(p) for p in PHASES]), F.floor((F.col("ix") - 1) / 4).cast("int"))).alias("phase"),
        F.when(is_strict, 100 - F.col("ix")).otherwise(70 - F.col("ix")).cast("long").alias("priority"),
        F.when(is_strict & F.col("_backstop"), "backstop").when(is_strict, "strict_lane").otherwise("keyword_pack").alias("purpose"),
        F.when(F.col("ix") >= 10, "expansion").otherwise("precision").alias("mode"),
        F.col("ix").cast("long").alias("ordinal"),
    )
    made = made.withColumns({"tokens": REWRITE.all(F.col("phrase")), "canonical_key": F.concat_ws(":", "strictness", F.lower("phrase")), "variant_id": F.concat_ws("_", "phase", "ordinal", cache_key(8, F.col("phrase"), F.col("strictness")))})
    return rank_within(made, [group], [F.desc("priority"), F.asc("variant_id")], "run_ix").where(F.col("run_ix") <= most)


def token_query(must: Column, any_of: Column, never: Column, doctypes: Column, window: Column) -> Column:
    """A query string in the ``doctypes:`` dialect: words without those ruled out, document types and dates (QRY-31, SET-04)."""
    day = lambda name, d: F.when(d.isNotNull(), F.concat(F.lit(f"{name}:"), F.date_format(d, "d-M-yyyy")))
    words = F.array_except(F.array_distinct(F.concat(must, any_of)), never)
    return squeeze(F.concat_ws(" ", F.array_join(words, " "), F.when(doctypes != "", F.concat(F.lit("doctypes:"), doctypes)), day("fromdate", window["from_date"]), day("todate", window["to_date"])))
