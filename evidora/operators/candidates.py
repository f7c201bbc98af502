"""Classification, merging, provenance and filters of candidate rows (FLT-*, AGG-01..04, AGG-18, JOIN-12..14, SET-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let

KINDS = ("case", "statute", "noise", "unknown")
_EDGE, _END = r"(?<![a-z0-9_])", r"(?![a-z0-9_])"


def worded(pattern: str) -> str:
    """The pattern between word ends of ASCII letters and digits."""
    return f"{_EDGE}(?:{pattern}){_END}"


# Cues of the classifier (fixed values).
STATUTE_TITLE = ["constitution of india", "indian penal code|code of criminal procedure", r"(?:prevention of corruption|limitation)\s+act", r"act,\s*\d{4}", r"code,\s*\d{4}", r"rules,\s*\d{4}"]
STATUTE_BODY = [*STATUTE_TITLE, "regulation|notification|ordinance", r"section\s+\d+[a-z]?[^a-z0-9_][\s\S]{0,70}[^a-z0-9_](?:punishment|whoever|shall be punished)"]
CASE_CUES = [r"on\s+\d{1,2}\s+[a-z]{3,9}\s+\d{4}", "petitioner|respondent|appellant|appeal|criminal appeal|writ petition|judgment|tribunal"]
VERSUS = r" v(?:s\.?|\.?) "
PSEUDO_TITLE = "^(search|full document|similar judgments?)$"


def any_cue(text: Column, cues: list[str]) -> Column:
    out = F.lit(False)
    for c in cues:
        out = out | text.rlike(worded(c))
    return out


def classify(title: Column, body: Column, court: Column, *, statute_title: list[str] | None = None, statute_body: list[str] | None = None, case: list[str] | None = None) -> Column:
    """(kind, reason) by an ordered decision list; the cues are parameters (FLT-01)."""
    title = F.trim(F.lower(F.coalesce(title, F.lit(""))))
    text = F.lower(F.concat_ws(" ", title, F.coalesce(body, F.lit(""))))
    case_like = lambda x: any_cue(x, case if case is not None else CASE_CUES) | x.rlike(VERSUS)
    statute_like = lambda x, cues, default: any_cue(x, cues if cues is not None else default)
    is_ = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))

    def decided(f: Column) -> Column:
        title = f["title"]
        t_case, b_case, t_statute, b_statute = (f[c] for c in ("t_case", "b_case", "t_statute", "b_statute"))
        return (
            F.when((title == "") | title.rlike(PSEUDO_TITLE), is_("noise", "pseudo-result title"))
            .when(t_statute & ~t_case, is_("statute", "statutory-title signal"))
            .when(b_statute & ~b_case, is_("statute", "statutory-body signal"))
            .when(t_case | (b_case & ~t_statute), is_("case", "case-law signals"))
            .when(t_statute | b_statute, is_("statute", "statute-like body"))
            .when((court != "UNKNOWN") & (F.length(title) > 8), is_("unknown", "court-tagged candidate"))
            .otherwise(is_("noise", "insufficient legal case signals"))
        )

    # each cue is looked for once in a text, whatever the list asks
    cues = lambda x: F.struct(x["title"].alias("title"), case_like(x["title"]).alias("t_case"), case_like(x["text"]).alias("b_case"), statute_like(x["title"], statute_title, STATUTE_TITLE).alias("t_statute"), statute_like(x["text"], statute_body, STATUTE_BODY).alias("b_statute"))
    return let(let(F.struct(title.alias("title"), text.alias("text")), cues), decided)


def kind_counts(df: DataFrame, kind: str = "kind", domain: tuple[str, ...] = KINDS) -> DataFrame:
    """(kind, n) with a row for every kind of the domain (AGG-01)."""
    every = df.sparkSession.createDataFrame([(k,) for k in domain], f"`{kind}` string")
    return every.join(df.groupBy(kind).agg(F.count("*").alias("n")), kind, "left").select(kind, F.coalesce("n", F.lit(0)).alias("n"))


def reason_histogram(df: DataFrame, reasons: str = "reasons") -> DataFrame:
    """(reason, n) over array columns (AGG-02)."""
    # Spark puts a filter before a plain explode, which would work out the reasons twice
    rows = df.select(F.posexplode_outer(reasons).alias("place", "reason")).where("place is not null")
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def keep_or_all(df: DataFrame, keep: Column, *, group: str = "query_id") -> DataFrame:
    """Rows that meet the condition; a group in which none does stays whole (FLT-04, FLT-05, FLT-06)."""
    w = Window.partitionBy(group)
    good = F.coalesce(keep, F.lit(False))
    return df.withColumn("_good", good).withColumn("_some", F.bool_or("_good").over(w)).where("_good or not _some").drop("_good", "_some")


def quality(df: DataFrame) -> Column:
    """How much a candidate row tells (AGG-03)."""
    there = lambda c: F.col(c).isNotNull() if c in df.columns else F.lit(False)
    windows = F.coalesce(F.size("evidence_windows") > 0, F.lit(False)) if "evidence_windows" in df.columns else F.lit(False)
    full = (F.col("full_url").isNotNull() & (F.col("full_url") != F.col("url"))) if "full_url" in df.columns else F.lit(False)
    parts = [(F.col("court") != "UNKNOWN", 10), (there("detail_text"), 12), (windows, 8), (there("court_text"), 4), (full, 2), (there("cites"), 1), (there("cited_by"), 1)]
    score = sum((F.when(F.coalesce(c, F.lit(False)), float(n)).otherwise(0.0) for c, n in parts), F.lit(0.0))
    return score + F.least(F.length(F.coalesce("snippet", F.lit(""))), F.lit(600)) / 120.0


def merge_duplicates(df: DataFrame, *, key: str = "url", order: str = "ordinal", group: list[str] | None = None) -> DataFrame:
    """One row for each key, merged from its duplicates in order (AGG-03).

    The row of higher quality is the base and the other fills its gaps; a merged row is
    judged again against the next one, so duplicates are folded in order.  Equal rows are folded once: what
    is held for a key are its different rows.
    """
    by = [*(group or []), key]
    fields = [c for c in df.columns if c not in by and c != order]
    ranked = df.groupBy(*by, *fields).agg(F.min(order).alias(order))
    has = set(fields)
    opt = [c for c in ("court_text", "cites", "cited_by", "author", "full_url", "detail_text", "evidence_windows") if c in has]

    def score(r: Column) -> Column:
        s = F.when(r["court"] != "UNKNOWN", 10.0).otherwise(0.0)
        for c, n in (("detail_text", 12.0), ("court_text", 4.0), ("cites", 1.0), ("cited_by", 1.0)):
            if c in has:
                s = s + F.when(r[c].isNotNull(), n).otherwise(0.0)
        if "evidence_windows" in has:
            s = s + F.when(F.size(r["evidence_windows"]) > 0, 8.0).otherwise(0.0)
        return s + F.least(F.length(F.coalesce(r["snippet"], F.lit(""))), F.lit(600)) / 120.0

    def merge(a: Column, b: Column) -> Column:
        swap = score(b) > score(a)
        base = lambda c: F.when(swap, b[c]).otherwise(a[c])
        rest = lambda c: F.when(swap, a[c]).otherwise(b[c])
        size = lambda x: F.length(F.coalesce(x, F.lit("")))
        out = {c: base(c) for c in fields}
        if "title" in has:
            named = (base("title") != "") & ~base("title").rlike("(?i)^untitled case")
            out["title"] = F.when(F.coalesce(named, F.lit(False)), base("title")).otherwise(F.coalesce(F.nullif(rest("title"), F.lit("")), base("title")))
        out["snippet"] = F.when(size(base("snippet")) >= size(rest("snippet")), base("snippet")).otherwise(rest("snippet"))
        out["court"] = F.when(base("court") != "UNKNOWN", base("court")).otherwise(rest("court"))
        for c in opt:
            out[c] = F.coalesce(base(c), rest(c))
        return F.struct(*[out[c].alias(c) for c in fields])

    lists = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*fields).alias("r")))).alias("rows"))
    first = F.get("rows", F.lit(0))
    merged = F.aggregate(F.slice("rows", 2, 1 << 30), first["r"], lambda acc, x: merge(acc, x["r"]))
    return lists.select(*by, first["o"].alias(order), merged.alias("m")).select(*by, order, "m.*")


def provenance(attempts: DataFrame, *, url: str = "url") -> DataFrame:
    """What retrieved each candidate (AGG-04): attempts have url, variant_id, canonical_key, phase, utility, strictness, priority."""
    return attempts.groupBy(url).agg(
        F.array_sort(F.collect_set("variant_id")).alias("variant_ids"),
        F.array_sort(F.collect_set("canonical_key")).alias("canonical_keys"),
        F.array_sort(F.collect_set("phase")).alias("phases"),
        F.max("utility").alias("best_utility"),
        F.count_if(F.col("strictness") == "strict").alias("strict_hits"),
        F.count_if(F.col("strictness") == "relaxed").alias("relaxed_hits"),
        F.count_if(F.coalesce("priority", F.lit(0)) >= 80).alias("high_priority_hits"),
    )


def unseen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among those seen (JOIN-12)."""
    return df.join(seen.select(*keys), keys, "left_anti")


def known(df: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are among the others (JOIN-13)."""
    return df.join(others.select(*keys), keys, "left_semi")


def labels_of(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """Labels one of whose terms is in the text, in the lexicon's order (QRY-03)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = []
    for label, terms in lexicon.items():
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(low, F.lit(t.lower()))
        out.append(F.when(hit, F.lit(label)))
    return F.filter(F.array(*out), lambda x: x.isNotNull()) if out else F.array().cast("array<string>")


def patterns_of(text: Column, patterns: dict[str, str]) -> Column:
    """Labels whose pattern is in the lower-case text, in order (QRY-04)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = [F.when(low.rlike(p), F.lit(label)) for label, p in patterns.items()]
    return F.filter(F.array(*out), lambda x: x.isNotNull()) if out else F.array().cast("array<string>")


def merge_variants(df: DataFrame, *, group: str = "query_id") -> DataFrame:
    """Variants of one phase and phrase become one (AGG-18).

    The higher priority wins, strict wins ties, then the earlier one; token lists
    are joined in that order without repeats.
    """
    key = F.lower("phrase")
    order = F.struct((-F.coalesce("priority", F.lit(0))).alias("p"), (F.col("strictness") != "strict").alias("s"), F.col("ordinal").alias("o"))
    rows = F.array_sort(F.collect_list(F.struct(order.alias("order"), "variant_id", "phrase", "strictness", "priority", "tokens")))
    g = df.groupBy(group, "phase", key.alias("phrase_key")).agg(rows.alias("rows"), F.min("ordinal").alias("ordinal"))
    best = F.get("rows", F.lit(0))
    return g.select(group, "phase", "ordinal", best["variant_id"].alias("variant_id"), best["phrase"].alias("phrase"), best["strictness"].alias("strictness"), best["priority"].alias("priority"), F.slice(F.array_distinct(F.flatten(F.transform("rows", lambda r: r["tokens"]))), 1, 24).alias("tokens"), F.size("rows").cast("long").alias("merged"))
