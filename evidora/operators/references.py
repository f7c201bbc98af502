"""Mentions of statutes in a question, and whether it asks for one of two (QRY-07, QRY-08)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, ordered_distinct, squeeze

MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
SECTION = r"[0-9]+(?:\([0-9a-z]+\))*"
# Statutes by the patterns that name them, and how they are called then (fixed values).
CRPC = r"cr\.?\s*p\.?\s*c\.?|crpc|code\s+of\s+criminal\s+procedure(?:\s*,?\s*1973)?|criminal\s+procedure\s+code"
BNSS = r"bnss|bharatiya\s+nagarik\s+suraksha\s+sanhita(?:\s*,?\s*2023)?"
GENERAL_CLAUSES = r"general\s+clauses\s+act(?:\s*,?\s*1897)?"
STATUTES = [
    (CRPC, ["crpc", "code of criminal procedure, 1973"]),
    (BNSS, ["bnss", "bharatiya nagarik suraksha sanhita, 2023"]),
    (GENERAL_CLAUSES, ["general clauses act, 1897", "general clauses act"]),
]
# What a code that replaced another is called, where either is named (fixed values).
TRANSITION = ["crpc", "code of criminal procedure, 1973", "bnss", "bharatiya nagarik suraksha sanhita, 2023", "code of criminal procedure reference read as bnss reference"]
# The act that a section belongs to, by what stands around it (fixed values).
ACT_HINTS = [
    (r"prevention\s+of\s+corruption\s+act", "prevention of corruption act"),
    (r"pc\s*act", "pc act"),
    (r"general\s+clauses\s+act", "general clauses act"),
    (r"limitation\s+act", "limitation act"),
    (r"code\s+of\s+criminal\s+procedure|crpc|cr\.?\s*p\.?\s*c\.?", "crpc"),
    (r"indian\s+penal\s+code|ipc", "ipc"),
    (r"code\s+of\s+civil\s+procedure|cpc", "cpc"),
]
# Disjunctions that say nothing of two statutes (fixed values).
IDLE_DISJUNCTIONS = r"\b(?:laws?\s+or\s+proceedings?|interpreted\s+or\s+applied|applied\s+or\s+interpreted|rules?\s+or\s+regulations?|acts?\s+or\s+rules?)\b"
# Words of choice, short names of notifications, and how sections, notifications, acts and days are written (fixed values).
CONNECTOR = r"(?:or|versus|vs\.?|instead\s+of|alternatively)"
NOTICE = r"(?:s\.?\s*o\.?|g\.?\s*s\.?\s*r\.?)"
CALLED_SECTION = r"(?:section|sec\.?|s\.)\s*"
NOTICE_NUMBER = rf"(?:^|[^a-z0-9])({NOTICE})\s*([0-9]+\([a-z]\))(?=$|[^a-z0-9])"
NAMED_ACT = r"\b([a-z][a-z\s]{2,70}?\sact(?:\s*,\s*\d{4})?)\b"
NAMED_DAY = rf"\b([0-3]?\d)(?:st|nd|rd|th)?\s+({MONTHS})\s+(19\d{{2}}|20\d{{2}})\b"
AROUND = 80


def words_of(pattern: str) -> str:
    return f"(?<![a-z0-9_])(?:{pattern})(?![a-z0-9_])"


def plain(text: Column) -> Column:
    """Lower-case text of letters, digits and ``().,:/-``."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s().,:/-]", " "))


def act_hint(window: Column) -> Column:
    """The act that is named in a piece of text, the first by the table; null if none."""
    return F.coalesce(*[F.when(window.rlike(words_of(p)), F.lit(name)) for p, name in ACT_HINTS])


def _pieces(text: Column, start: str, use) -> Column:
    """use(what comes before, what comes from there on) for each place where a pattern begins."""

    def each(pieces: Column) -> Column:
        n = F.size(pieces)
        before = lambda i: F.array_join(F.slice(pieces, F.lit(1), i), "")
        after = lambda i: F.array_join(F.slice(pieces, i + 1, n), "")
        own = F.transform(F.sequence(F.lit(0), n - 1), lambda i: use(before(i), after(i)))
        # the text before the first place is no piece, unless a place is at its very start
        return F.filter(own, lambda x: x.isNotNull())

    return let(F.split(text, f"(?={start})"), each)


def explicit_sections(low: Column) -> Column:
    """Sections that are called so, with the act that stands near them."""
    lead = rf"(?<![a-z0-9_]){CALLED_SECTION}"

    def own(before: Column, after: Column) -> Column:
        number = F.regexp_extract(after, rf"^{CALLED_SECTION}({SECTION})", 1)
        hint = act_hint(F.concat(F.right(before, F.lit(20)), F.left(after, F.lit(140))))
        return F.when(number != "", F.concat_ws(" ", F.lit("section"), number, hint))

    return _pieces(low, lead + "[0-9]", own)


def bare_sections(low: Column) -> Column:
    """Numbers with sub-sections in a legal context, that aren't called sections; no notification numbers."""
    called = F.regexp_extract_all(low, F.lit(rf"(?<![a-z0-9_]){CALLED_SECTION}({SECTION})"), 1)

    def own(before: Column, after: Column) -> Column:
        number = F.regexp_extract(after, r"^([0-9]+(?:\([0-9a-z]+\)){1,3})(?:$|[^a-z0-9])", 1)
        window = F.concat(F.right(before, F.lit(50)), F.left(after, F.lit(80)))
        hint = act_hint(window)
        legal = (hint.isNotNull() | window.rlike(r"\bsection\b")) & ~window.rlike(words_of(rf"{NOTICE}|notification|gazette"))
        return F.when((number != "") & ~F.array_contains(called, number) & legal, F.concat_ws(" ", F.lit("section"), number, hint))

    return _pieces(low, r"(?<![a-z0-9])[0-9]+\(", own)


def references(text: Column) -> Column:
    """sections, statutes, notification_ids, notification_dates, aliases, hard, soft and references of a question (QRY-07)."""
    none = F.array().cast("array<string>")

    def made(low: Column) -> Column:
        sections = ordered_distinct(F.concat(explicit_sections(low), bare_sections(low)), 24)
        named = [F.when(low.rlike(words_of(p)), F.array(*[F.lit(x) for x in names])).otherwise(none) for p, names in STATUTES]
        acts = F.transform(F.regexp_extract_all(low, F.lit(NAMED_ACT), 1), plain)
        statutes = ordered_distinct(F.concat(*named, acts), 20)
        kind = F.transform(F.regexp_extract_all(low, F.lit(NOTICE_NUMBER), 1), lambda k: F.when(k.startswith("g"), "g.s.r.").otherwise("s.o."))
        ids = ordered_distinct(F.zip_with(kind, F.regexp_extract_all(low, F.lit(NOTICE_NUMBER), 2), lambda k, n: F.concat(k, F.lit(" "), n)), 8)
        part = lambda k: F.regexp_extract_all(low, F.lit(NAMED_DAY), k)
        dates = F.zip_with(F.zip_with(F.transform(part(1), lambda d: d.cast("int").cast("string")), part(2), lambda d, m: F.concat_ws(" ", d, m)), part(3), lambda d, y: F.concat_ws(" ", d, y))
        return F.struct(sections.alias("sections"), statutes.alias("statutes"), ids.alias("notification_ids"), ordered_distinct(dates, 8).alias("notification_dates"), F.when(low.rlike(words_of(f"{CRPC}|{BNSS}")), F.array(*[F.lit(x) for x in TRANSITION])).otherwise(none).alias("aliases"))

    def joined(r: Column) -> Column:
        swap = F.when(F.size(r["aliases"]) > 0, F.array(F.lit("statutory reference substitution"))).otherwise(none)
        return F.struct(
            *[r[k].alias(k) for k in ("sections", "statutes", "notification_ids", "notification_dates", "aliases")],
            ordered_distinct(F.concat(r["sections"], r["statutes"], r["aliases"], r["notification_ids"]), 18).alias("hard"),
            ordered_distinct(F.concat(r["aliases"], r["statutes"], r["sections"], r["notification_ids"], r["notification_dates"], swap), 26).alias("soft"),
            ordered_distinct(F.concat(r["sections"], r["statutes"], r["notification_ids"]), 28).alias("references"),
        )

    return let(let(plain(text), made), joined)


def disjunctive_words(text: Column) -> Column:
    """The question has a word of choice."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike(words_of(r"or|either|alternatively|versus|vs\.?|instead of"))


def asks_for_either(text: Column, refs: Column) -> Column:
    """The question asks for one statute or another, or one proceeding or another (QRY-08)."""

    def decided(low: Column) -> Column:
        needles = F.concat(refs["sections"], refs["statutes"], refs["aliases"], refs["notification_ids"])
        names = lambda part: F.exists(needles, lambda n: F.contains(part, n))
        either = low.rlike(r"\beither\b")

        def sides(before: Column, after: Column) -> Column:
            left = F.right(before, F.lit(AROUND))
            right = F.regexp_replace(F.left(after, F.lit(AROUND)), rf"^{CONNECTOR}", "")
            return F.when(after.rlike(rf"^{CONNECTOR}(?![a-z0-9_])"), names(left) & names(right) & ~F.concat_ws(" ", left, right).rlike(IDLE_DISJUNCTIONS))

        two = F.exists(_pieces(low, rf"(?<![a-z0-9_]){CONNECTOR}(?![a-z0-9_])", sides), lambda x: x)
        kinds = "(?:appeal|revision|petition|application|charge)"
        return (
            F.when(~disjunctive_words(low), F.lit(False))
            .when(low.rlike(rf"\b{kinds}\s+or\s+{kinds}\b"), F.lit(True))
            .when(low.rlike(rf"\bsection\s*{SECTION}\s+or\s+section\s*\d+"), F.lit(True))
            .when(low.rlike(IDLE_DISJUNCTIONS) & ~either, F.lit(False))
            .otherwise(two | (either & names(low)))
        )

    return let(plain(text), decided)


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))
