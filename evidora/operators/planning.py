"""Model plans and what is left of query planning (PAR-20..22, QRY-20..31, QRY-35, SRC-19, UDF-03, FLT-12, FLT-15).

A model is a hook: a function from a column of prompts to a column of texts.  Without one the plan is
the deterministic one, which is the default everywhere.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import ordered_distinct, squeeze

Hook = Callable[[Column], Column]
_HOOKS: dict[str, Hook] = {}

PLAN_TYPE = "struct<actors: array<string>, proceeding: array<string>, legal_hooks: array<string>, outcome_required: array<string>, outcome_negative: array<string>, must_have_terms: array<string>, must_not_have_terms: array<string>, query_variants_strict: array<string>, query_variants_broad: array<string>, case_anchors: array<string>>"
#: Most items of each list of a plan (fixed values).
PLAN_LIMITS = {"actors": 6, "proceeding": 6, "legal_hooks": 10, "outcome_required": 6, "outcome_negative": 6, "must_have_terms": 12, "must_not_have_terms": 12, "query_variants_strict": 8, "query_variants_broad": 8, "case_anchors": 8}
#: Words that widen a search where their seed is mentioned (fixed values).
SYNONYMS = {
    "sanction": ["prior sanction", "previous sanction", "sanction for prosecution"],
    "condonation": ["delay condonation", "condonation of delay", "delay condoned", "delay not condoned"],
    "limitation": ["time barred", "barred by limitation", "limitation act section 5"],
    "quash": ["quashing", "set aside proceedings", "section 482 crpc quashing"],
    "prosecution": ["criminal prosecution", "trial for offence", "prosecution under section"],
    "appeal": ["criminal appeal", "appeal against acquittal", "appellate challenge"],
    "corruption": ["prevention of corruption act", "pc act", "disproportionate assets"],
}
OUTCOME_EVIDENCE = r"(^|[^a-z0-9_])(?:dismissed|refused|rejected|denied|quashed|allowed|granted|required|not required|mandatory|condoned|time barred|barred by limitation)([^a-z0-9_]|$)"


def register_model(name: str, hook: Hook) -> None:
    """Add a model hook: plan, sketch, keywords, embedding or rerank."""
    _HOOKS[name] = hook


def model(name: str, prompt: Column) -> Column | None:
    """The model's answer, or None where there is no such hook."""
    return _HOOKS[name](prompt) if name in _HOOKS else None


def balanced_object(text: str) -> str | None:
    """The first whole ``{...}`` of a text; braces within strings do not count."""
    depth, first = 0, None
    for m in re.finditer(r'"(?:\\.|[^"\\])*"|[{}]', text, re.S):
        if m[0] == "{":
            first = m.start() if depth == 0 and first is None else first
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if depth == 0:
                return text[first : m.end()]
    return None


def repaired(text: str | None) -> str | None:
    """A text as JSON of an object: fences go, the object is found, trailing commas go; None if nothing helps."""
    if not text:
        return None
    bare = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", text.strip())
    found = balanced_object(bare)
    for candidate in (bare, found, re.sub(r",(\s*[}\]])", r"\1", found) if found else None):
        try:
            value = json.loads(candidate) if candidate else None
        except ValueError:
            continue
        if isinstance(value, dict):
            return json.dumps(value)
    return None


@F.pandas_udf(T.StringType())
def _repair(texts: pd.Series) -> pd.Series:
    return texts.map(repaired)


#: Characters looked at after a list that neither ends nor is followed by another field (fixed value).
CUT_LIST = 1800
_STRING = r'"((?:\\.|[^"\\])*)"'


def loose_text(answer: Column) -> Column:
    """An answer with plain quotation marks and without fences, from its first brace on; null if it has none."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(answer, F.lit("")), "[\u201c\u201d]", '"'), "[\u2018\u2019]", "'")
    plain = F.regexp_replace(plain, "```[a-zA-Z]*", "")
    return F.when(F.contains(plain, F.lit("{")), F.regexp_extract(plain, r"(?s)(\{.*)", 1))


def _decoded(token: Column) -> Column:
    """What stands between the quotation marks of a JSON string, as text."""
    read = F.get(F.from_json(F.concat(F.lit('["'), F.regexp_replace(token, r"[\n\r\t]", " "), F.lit('"]')), "array<string>"), F.lit(0))
    return squeeze(F.coalesce(read, F.regexp_replace(token, r"\\\\(.)", "$1")))


def loose_list(text: Column, key: str, most: int, longest: int = 160) -> Column:
    """The strings of a list field, wherever it stands and whether or not it ends: up to its bracket or the next field, whichever comes first, or CUT_LIST characters (PAR-20)."""
    rest = F.regexp_extract(F.coalesce(text, F.lit("")), rf'(?is)"{key}"\s*:\s*\[(.*)', 1)
    whole = F.regexp_extract(rest, r"(?s)^([^\]]*)\]", 1)
    cut = F.regexp_extract(rest, r'(?is)^(.*?),\s*"[a-z_][a-z0-9_]*"\s*:', 1)
    ends = F.contains(rest, F.lit("]"))
    own = F.when(ends & ((cut == "") | (F.length(whole) <= F.length(cut))), whole).when(cut != "", cut).otherwise(F.left(rest, F.lit(CUT_LIST)))
    found = F.transform(F.regexp_extract_all(own, F.lit(_STRING), 1), _decoded)
    return F.slice(F.array_distinct(F.filter(found, lambda x: (x != "") & (F.length(x) <= longest))), 1, most)


def loose_field(text: Column, key: str) -> Column:
    """The first string value of a field; null without one."""
    return F.nullif(_decoded(F.regexp_extract(F.coalesce(text, F.lit("")), rf'(?is)"{key}"\s*:\s*{_STRING}', 1)), F.lit(""))


#: Most items of each list of a sketch (fixed values).
SKETCH_LIMITS = {"actors": 8, "proceeding": 8, "outcome": 10, "hooks": 12, "strict_terms": 8, "broad_terms": 8}


def salvaged_sketch(answer: Column) -> Column:
    """The fields of a sketch from an answer that is no whole object; null if it has none of them (PAR-20, PAR-21).

    Where it has no strict terms, they are put together from the first actor, proceeding, outcome and hook, twelve words at most and two at least.
    """
    text = loose_text(answer)
    lists = {k: loose_list(text, k, n) for k, n in SKETCH_LIMITS.items()}
    first = lambda k: F.coalesce(F.get(lists[k], F.lit(0)), F.lit(""))
    made = [F.slice(F.split(squeeze(F.concat_ws(" ", *[first(k) for k in ks])), " "), 1, 12) for ks in (("actors", "proceeding", "outcome", "hooks"), ("proceeding", "outcome", "hooks"), ("actors", "outcome", "hooks"))]
    made = F.array_distinct(F.transform(F.filter(F.array(*made), lambda ws: F.size(ws) >= 2), lambda ws: F.array_join(ws, " ")))
    strict = F.when(F.size(lists["strict_terms"]) > 0, lists["strict_terms"]).otherwise(made)
    sketch = F.struct(*[(strict if k == "strict_terms" else v).alias(k) for k, v in lists.items()], loose_field(text, "polarity").alias("polarity"), loose_field(text, "court_hint").alias("court_hint"))
    some = F.size(strict) + sum((F.size(lists[k]) for k in ("actors", "proceeding", "outcome", "hooks")), F.lit(0)) > 0
    return F.when(text.isNotNull() & some, sketch)


def parse_plans(df: DataFrame, answer: str, plan: str = "plan") -> DataFrame:
    """Add the plan of a model's loose answer: repaired, typed, cleaned and cut to its limits (PAR-20, PAR-21).

    Of an answer that is no whole object, the lists that can be read are taken one by one.  The scan for the balanced object needs a state for each
    character, so it is an Arrow function; all else is built in.
    """
    typed = df.withColumn("_json", _repair(F.col(answer))).withColumn("_plan", F.from_json("_json", PLAN_TYPE, {"mode": "PERMISSIVE"}))
    none = F.array().cast("array<string>")
    clean = lambda xs, most: F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(xs, none), lambda x: squeeze(F.lower(x))), lambda x: (x != "") & (F.length(x) <= 120))), 1, most)
    loose = loose_text(F.col(answer))
    field = lambda k, n: F.when(F.col("_json").isNull(), loose_list(loose, k, n, 120)).otherwise(F.col("_plan")[k])
    made = F.struct(*[clean(field(k, n), n).alias(k) for k, n in PLAN_LIMITS.items()])
    return typed.withColumn(plan, made).drop("_json", "_plan")


def ground_plan(plan: Column, question: Column) -> Column:
    """The plan without what the question does not bear out (PAR-22).

    Outcomes go if the question has no outcome word, with the variants that name them; hooks go if the question has none of their words.
    """
    q = F.lower(F.coalesce(question, F.lit("")))
    words = F.regexp_extract_all(q, F.lit("[a-z0-9]+"), 0)
    evident = q.rlike(OUTCOME_EVIDENCE)
    none = F.array().cast("array<string>")
    dropped = F.when(evident, none).otherwise(F.concat(plan["outcome_required"], plan["outcome_negative"]))
    borne = lambda t: F.exists(F.regexp_extract_all(t, F.lit("[a-z0-9]+"), 0), lambda w: (F.length(w) > 1) & (w != "section") & F.array_contains(words, w))
    free = lambda t: ~F.exists(dropped, lambda d: F.contains(t, d))
    made = {k: plan[k] for k in PLAN_LIMITS}
    made |= {k: F.when(evident, plan[k]).otherwise(none) for k in ("outcome_required", "outcome_negative")}
    made |= {k: F.filter(plan[k], free) for k in ("must_not_have_terms", "query_variants_strict", "query_variants_broad")}
    made["legal_hooks"] = F.filter(plan["legal_hooks"], borne)
    return F.struct(*[v.alias(k) for k, v in made.items()], F.size(F.filter(plan["legal_hooks"], lambda t: ~borne(t))).alias("dropped_hooks"), (~evident & (F.size(F.concat(plan["outcome_required"], plan["outcome_negative"])) > 0)).alias("dropped_outcome"))


def plan_variants(df: DataFrame, plan: str = "plan", *, group: str = "query_id") -> DataFrame:
    """(query_id, ordinal, phrase, strictness) of a plan's variants (QRY-24)."""
    tag = lambda xs, s: F.transform(xs, lambda x: F.struct(x.alias("phrase"), F.lit(s).alias("strictness")))
    p = F.col(plan)
    rows = df.select(group, F.posexplode(F.concat(tag(p["query_variants_strict"], "strict"), tag(p["query_variants_broad"], "relaxed"))).alias("ordinal", "v"))
    return rows.select(group, "ordinal", "v.phrase", "v.strictness")


def widen(terms: Column, synonyms: dict[str, list[str]] = SYNONYMS, most: int = 24) -> Column:
    """Synonyms of the seeds that the terms mention (QRY-27, JOIN-14)."""
    bag = F.lower(F.array_join(terms, " "))
    parts = [F.when(F.contains(bag, F.lit(seed)), F.array(*[F.lit(v) for v in values])).otherwise(F.array().cast("array<string>")) for seed, values in synonyms.items()]
    return F.slice(F.array_distinct(F.concat(*parts)), 1, most)


def templates_for(df: DataFrame, labels: str, templates: DataFrame, *, group: str = "query_id") -> DataFrame:
    """(query_id, phrase): the templates of each label, by a join with a template table (label, ordinal, phrase) (QRY-27, QRY-28)."""
    rows = df.select(group, F.explode(labels).alias("label")).join(templates, "label")
    return rows.groupBy(group, "phrase").agg(F.min("ordinal").alias("ordinal"))


def merge_keywords(own: Column, suggested: Column, most: int = 36) -> Column:
    """The deterministic keywords, then a model's, without repeats (QRY-20)."""
    return ordered_distinct(F.concat(F.coalesce(own, F.array().cast("array<string>")), F.coalesce(suggested, F.array().cast("array<string>"))), most)


def trace_variants(results: DataFrame, intents: DataFrame, *, group: str = "query_id", most: int = 6) -> DataFrame:
    """(query_id, ordinal, phrase): the best titles so far with the question's pivots (QRY-25)."""
    titles = results.select(group, "place", F.array_join(F.slice(F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]{3,}"), 0), 1, 6), " ").alias("seed")).where("place <= 3")
    pivots = intents.select(group, F.posexplode(F.slice(F.array_distinct(F.concat("statutes", "procedures", "issues")), 1, 3)).alias("pivot_ix", "pivot"))
    rows = titles.join(pivots, group).withColumn("phrase", squeeze(F.concat_ws(" ", "seed", "pivot")))
    first = rows.groupBy(group, "phrase").agg(F.min(F.struct("place", "pivot_ix")).alias("at"))
    ordinal = F.row_number().over(Window.partitionBy(group).orderBy("at", "phrase"))
    return first.withColumn("ordinal", ordinal).where(F.col("ordinal") <= most).select(group, "ordinal", "phrase")


def guarantee_variants(variants: DataFrame, needed: DataFrame, *, group: str = "query_id", extra: int = 1) -> DataFrame:
    """The first variants not run yet of the questions with too few results (QRY-26, FBK-06)."""
    from .ranking import top_within

    rows = variants.where("not ran").join(needed.where("n_results < 3").select(group), group, "left_semi")
    return top_within(rows, [group], [F.desc("priority"), F.asc("variant_id")], extra, "extra_ix")


def directives(court: Column, mode: Column, statutory: Column) -> Column:
    """Which documents a source is asked for (QRY-30, QRY-35)."""
    doctypes = F.when(court == "SC", "supremecourt").when(court == "HC", "highcourts").otherwise("judgments")
    policy = F.when(mode == "precision", "strict").when(statutory, "keep_statutes").otherwise("balanced")
    return F.struct(doctypes.alias("doctypes"), policy.alias("exclusion_policy"), (mode != "precision").alias("expand_categories"))


def category_terms(categories: Column) -> Column:
    """Terms of the categories a source returns, as names and values of its JSON (QRY-35)."""
    pairs = F.regexp_extract_all(F.coalesce(categories, F.lit("")), F.lit(r'"(?:value|name|formInput)"\s*:\s*"([^"]+)"'), 1)
    return ordered_distinct(F.transform(pairs, lambda p: F.lower(p)), 24)


def has_signal(tokens: Column, signals: list[str]) -> Column:
    """A phrase says enough: a signal word, or four tokens (FLT-12)."""
    known = F.arrays_overlap(tokens, F.array(*[F.lit(s) for s in signals])) if signals else F.lit(False)
    return known | (F.size(tokens) >= 4)


def sparse_intent(actors: Column, procedures: Column, issues: Column, statutes: Column) -> Column:
    """Too little is known of what is asked: fewer than two of the four axes (FLT-15)."""
    return sum(((F.size(c) > 0).cast("int") for c in (actors, procedures, issues, statutes)), F.lit(0)) < 2
