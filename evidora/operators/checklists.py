"""Checklists built from questions, and their signals in candidates (QRY-14, QRY-17, QRY-18, QRY-36, GAT-01, GAT-02, GAT-05, GAT-08, FLT-15, ORD-08).

A checklist is a struct column of the question's row, so one plan judges the candidates of
many questions, each by its own.  All of it is work within a row: a question has a few terms only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, ordered_distinct
from .gate import CHAIN_WINDOW, RELATION_WINDOW, Checklist, gate_text
from .intent import DISPOSITION, OPEN_QUESTION
from .references import any_of, asks_for_either, disjunctive_words, references
from .terms import counts_against, found, places_of, term_places

GROUP = "struct<group_id: string, terms: array<string>, required: boolean, min_match: int>"
STEP = "struct<step_id: string, kind: string, left: array<string>, right: array<string>, mandatory: boolean>"
CHECKLIST = (
    f"struct<axes: array<struct<label: string, terms: array<string>, required: boolean>>, groups: array<{GROUP}>, relations: array<struct<left: string, right: string>>, "
    f"outcome: array<string>, outcome_contradictions: array<string>, polarity: string, outcome_required: boolean, contradictions: array<string>, interaction_required: boolean, "
    f"steps: array<{STEP}>, role: string, role_actors: array<string>>"
)

# Families of statutes by what a term says, in order (fixed values).
FAMILIES = [
    ("pc_act", r"prevention of corruption|pc act"),
    ("crpc", r"\bcrpc\b|criminal procedure|\bbnss\b|bharatiya nagarik suraksha sanhita"),
    ("ipc", r"\bipc\b|indian penal code"),
    ("cpc", r"\bcpc\b|civil procedure"),
    ("limitation_act", r"limitation act"),
]
# Sections that belong to a family where the question names it (fixed values).
SECTION_FAMILIES = [("limitation_act", "5"), ("pc_act", "13"), ("pc_act", "19"), ("crpc", "197|482|378"), ("ipc", "406|420|409|120b|302|304|307")]
# What else a family is called (fixed values).
FAMILY_NAMES = {
    "pc_act": ["prevention of corruption act", "pc act"],
    "crpc": ["crpc", "cr.p.c", "code of criminal procedure", "bnss", "bharatiya nagarik suraksha sanhita"],
    "ipc": ["ipc", "indian penal code"],
    "cpc": ["cpc", "code of civil procedure"],
    "limitation_act": ["limitation act", "section 5 limitation act"],
}
# Words of the axes that count where the question has them (fixed values).
ACTOR_HINTS = ["state", "government", "union of india", "prosecution", "department", "director", "accused", "complainant", "public servant"]
PROCEEDING_HINTS = ["criminal appeal", "appeal", "revision", "writ petition", "trial", "investigation", "section 482 crpc", "special leave petition"]
OUTCOME_HINTS = ["dismissed", "rejected", "refused", "denied", "allowed", "quashed", "acquitted", "convicted", "time barred", "barred by limitation", "delay not condoned", "sanction required", "sanction not required"]
OUTCOME_PHRASES = ["delay not condoned", "condonation refused", "condonation rejected", "appeal dismissed as time barred", "barred by limitation", "sanction required", "sanction not required", "proceedings quashed", "appeal allowed", "appeal dismissed"]
# Cues that provisions have to interact; the last three only between two statutes (fixed values).
INTERACTION_CUES = ["read with", "vis-a-vis", "vis a vis", "interplay", "interaction"]
STATUTORY_CUES = ["requires under", "for prosecution under", "under section"]
INTERACTION_PATTERNS = [
    r"\b(?:offence|prosecution|charge)\s+under\s+section\s*[0-9]+",
    r"\brequires?\s+(?:sanction|approval|permission)\s+under\s+section\s*[0-9]+",
    r"\bfor\s+section\s*[0-9]+(?:\([0-9a-z]+\))*\s+under\s+section\s*[0-9]+",
    r"\bsection\s*[0-9]+(?:\([0-9a-z]+\))*\s+.*\b(?:with|read with|along with|vis[-\s]?a[-\s]?vis)\b",
]
# Terms that say an outcome, and terms that contradict it (fixed values).
OUTCOMES = {
    "required": (["required", "must be required", "mandatory", "necessary", "sanction required", "prior sanction", "previous sanction"], ["not required", "no sanction required", "sanction unnecessary", "without sanction", "sanction dispensed"]),
    "not_required": (["not required", "no sanction required", "sanction unnecessary", "without sanction", "sanction not required"], ["sanction required", "prior sanction", "mandatory sanction", "previous sanction"]),
    "allowed": (["allowed", "granted", "condoned", "restored", "set aside rejection"], ["dismissed", "refused", "rejected", "declined", "not condoned", "time barred"]),
    "refused": (["refused", "rejected", "declined", "not condoned", "denied"], ["allowed", "granted", "condoned", "restored", "set aside refusal"]),
    "dismissed": (["dismissed", "time barred", "barred by limitation", "dismissed as barred", "delay not condoned"], ["allowed", "restored", "set aside dismissal", "delay condoned"]),
    "quashed": (["quashed", "set aside", "proceedings quashed"], ["upheld", "confirmed", "sustained", "prosecution continued"]),
}
# Other words for actors and proceedings in a text (fixed values).
ACTOR_WORDS = {"state": ["state", "state of", "government", "union of india"], "prosecution": ["prosecution", "state", "state counsel"], "department": ["department", "authority", "government"], "public servant": ["public servant", "officer"]}
PROCEEDING_WORDS = {"criminal appeal": ["criminal appeal", "appeal against acquittal"], "appeal": ["appeal", "appellant"], "delay condonation": ["delay condonation", "condonation of delay", "application for condonation", "section 5 limitation"], "sanction for prosecution": ["sanction", "sanction required", "prior sanction", "previous sanction", "prosecution sanction", "sanction under section 197", "sanction under section 19"]}
OUTCOME_WORDS = {"delay condonation refused": ["delay not condoned", "condonation refused", "condonation rejected", "not been condoned", "application dismissed"], "appeal dismissed as time barred": ["time barred", "barred by limitation", "dismissed"], "sanction required": ["sanction required", "prior sanction"], "sanction not required": ["sanction not required", "without sanction"]}
CONDONATION = ["condonation of delay", "delay condonation", "application for condonation", "section 5 limitation"]
REFUSAL = ["not condoned", "condonation refused", "condonation rejected", "time barred", "appeal dismissed", "barred by limitation"]
REFUSAL_CUE = r"\b(?:not condoned|refused|rejected|denied|declined|dismissed|time barred|barred by limitation)\b"
OUTCOME_LIKE = r"\b(?:discharge|framing of charge|frame charge|charge framed|quash|quashing)\b"
STATUTORY = r"\bsection\s*\d+|\barticle\s*\d+|\b(?:ipc|crpc|bnss|cpc|pc act|limitation act|prevention of corruption act)\b|\b[a-z][a-z\s]{2,}\s+act\b"


def none() -> Column:
    return F.array().cast("array<string>")


def literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else none()


# Verbs of an outcome that an open question asks about (fixed values).
ASKED_ABOUT = r"(?:condon(?:e|ed|ation)|quash(?:ed|ing)?|dismiss(?:ed)?|allow(?:ed)?|grant(?:ed)?|refus(?:e|ed)|reject(?:ed)?|discharge|framing\s+of\s+charge)"
# Parts that an actor plays, in a question (fixed values).
ASKS_RESPONDENT, ASKS_PROSECUTION, ASKS_APPEAL = r"\brespondent\b", r"\bprosecution\b", r"\bappeal\b"
ASKS_APPELLANT = r"\bappellant\b|\b(?:filed|preferred|instituted|brought)\s+(?:an?\s+)?(?:criminal\s+)?appeal\b|\bappeal\s+by\b"
# The same in a text, around the actor's name (fixed values).
PLAYS_APPELLANT = [("", ".{0,90}(?:filed|preferred|presented|instituted|moved).{0,90}appeal"), (r"(?:appellant|appellants)\s*[:\-]?\s*(?:the\s+)?", ""), (r"^\s*(?:the\s+)?", r".{0,70}\bvs\b")]
PLAYS_RESPONDENT = [(r"(?:respondent|respondents)\s*[:\-]?\s*(?:the\s+)?", ""), (r"\bvs\b.{0,90}(?:the\s+)?", "")]
PLAYS_PROSECUTION = [("", ".{0,70}(?:prosecution|prosecutor|investigation)"), ("(?:prosecution|prosecutor).{0,70}", "")]
# What is about delay, about sanction, and about both outcomes at once (fixed values).
ABOUT_DELAY = r"\b(?:condonation|delay|limitation|time[- ]*barred|barred\s+by\s+limitation|not\s+condoned|section\s*5)\b"
DELAY_TERM = r"\b(?:condonation|delay|time[- ]*barred|barred\s+by\s+limitation|not\s+condoned)\b"
DELAY_WORD = r"\b(?:condonation|delay|limitation|time[- ]*barred|not\s+condoned)\b"
SANCTION_NOT, SANCTION_NEEDED = r"\b(?:not required|no sanction required|without sanction)\b", r"\b(?:must|required|mandatory|necessary|prior|previous)\b"
FAILED, WENT_ON, HANDS_OFF = r"\b(?:failed|dismissed|rejected)\b", r"\b(?:proceeded|continued|allowed)\b", r"\b(?:refused|declined)\s+to\s+interfere\b"


def family_of(term: Column) -> Column:
    """The family of statutes that a term names; null if none (QRY-18)."""
    return F.coalesce(*[F.when(term.rlike(p), F.lit(name)) for name, p in FAMILIES])


def section_of(term: Column) -> Column:
    """The section that a term names; empty if none (QRY-18)."""
    return F.regexp_extract(term, r"\b([0-9]+(?:\([0-9a-z]+\))*)", 1)


def slug(text: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(40))


def weak(term: Column) -> Column:
    """A term that says too little to be a hook (FLT-15)."""
    return (F.length(term) <= 1) | term.rlike(r"^\d{1,4}$") | term.rlike(r"^[ivxlcdm]+$")


def statutory(term: Column) -> Column:
    """A term that names a statute or a part of one (FLT-15)."""
    return term.rlike(STATUTORY)


def open_ended(text: Column) -> Column:
    """The question asks for the outcome itself (FLT-15)."""
    low = gate_text(text)
    return low.rlike(rf"\b{OPEN_QUESTION}\b") & low.rlike(rf"\b{ASKED_ABOUT}\b")


def disposition(text: Column) -> Column:
    """The question names an outcome (FLT-15)."""
    return gate_text(text).rlike(rf"\b{DISPOSITION}\b")


def hook_entry(term: Column, families: Column) -> Column:
    """group_id, family and other words of a hook term; a section without a family takes the one that the question's terms name (QRY-18)."""

    def bound(section: Column) -> Column:
        by_rule = [F.when(section.rlike(rf"^(?:{numbers})(?:\(|$)") & F.array_contains(families, F.lit(name)), F.lit(name)) for name, numbers in SECTION_FAMILIES]
        only = F.when(F.size(families) == 1, F.get(families, F.lit(0)))
        return F.when(section != "", F.coalesce(family_of(term), *by_rule, only)).otherwise(family_of(term))

    def made(section: Column, family: Column) -> Column:
        group = F.when(section != "", F.concat_ws("_", F.lit("sec"), family, slug(section))).otherwise(F.coalesce(family, F.concat(F.lit("hook_"), slug(term))))
        spaced = F.regexp_replace(section, r"[()]", " ")
        numbers = F.when(term.rlike(r"\bsection\s*[0-9]"), F.array(F.concat(F.lit("section "), section), F.concat(F.lit("section "), spaced), section, spaced)).otherwise(none())
        names = none()
        for name, words in FAMILY_NAMES.items():
            names = F.when(family == name, literals(words)).otherwise(names)
        words = F.filter(ordered_distinct(F.concat(F.array(term), numbers, names), 12), lambda w: ~weak(w))
        return F.struct(group.alias("group_id"), family.alias("family"), (section != "").alias("sectioned"), words.alias("terms"), F.lit(True).alias("required"), F.lit(1).alias("min_match"))

    return let(section_of(term), lambda s: let(F.struct(bound(s).alias("f")), lambda b: made(s, b["f"])))


def hook_groups_of(terms: Column, either: Column, plan_groups: Column | None = None, most: int = 8) -> Column:
    """The hook groups of a question's legal terms: bound, merged, pruned, promoted and sorted (QRY-14, QRY-17, ORD-08).

    Groups of one family and section are one.  A family alone goes if a group of it with a section is there.  Required
    groups come first, then statutory ones, then those with more terms.  Where the question asks for either
    of two, only statutory groups are required, and two of them at most; some group always is.  `plan_groups`, of a model's plan, are
    merged with the others.
    """

    def entries(clean: Column) -> Column:
        families = F.array_distinct(F.filter(F.transform(clean, family_of), lambda f: f.isNotNull()))
        own = F.transform(clean, lambda t: hook_entry(t, families))
        if plan_groups is None:
            return own

        def planned(g: Column) -> Column:
            words = F.filter(F.transform(g["terms"], gate_text), lambda t: ~weak(t))
            first = hook_entry(F.coalesce(F.get(F.filter(words, lambda t: section_of(t) != ""), F.lit(0)), F.get(words, F.lit(0)), gate_text(g["group_id"])), families)
            return F.struct(first["group_id"].alias("group_id"), first["family"].alias("family"), first["sectioned"].alias("sectioned"), F.slice(words, 1, 12).alias("terms"), g["required"].alias("required"), F.greatest(F.lit(1), F.least(g["min_match"], F.size(words), F.lit(4))).alias("min_match"))

        return F.concat(F.filter(F.transform(F.coalesce(plan_groups, F.array().cast(f"array<{GROUP}>")), planned), lambda g: F.size(g["terms"]) > 0), own)

    def merged(rows: Column) -> Column:
        keys = F.array_distinct(F.transform(rows, lambda e: e["group_id"]))

        def one(key: Column, place: Column) -> Column:
            same = F.filter(rows, lambda e: e["group_id"] == key)
            words = F.slice(F.array_distinct(F.flatten(F.transform(same, lambda e: e["terms"]))), 1, 16)
            needed = F.exists(same, lambda e: e["required"]) & (~either | F.exists(words, statutory))
            first = F.get(same, F.lit(0))
            # what it is sorted by comes first
            return F.struct((~needed).alias("optional"), (~F.exists(words, statutory)).alias("plain"), (-F.size(words)).alias("fewer"), place.alias("place"), key.alias("group_id"), words.alias("terms"), F.array_max(F.transform(same, lambda e: e["min_match"])).alias("min_match"), first["family"].alias("family"), first["sectioned"].alias("sectioned"))

        groups = F.transform(keys, one)
        return let(groups, lambda gs: F.array_sort(F.filter(gs, lambda g: g["sectioned"] | g["family"].isNull() | ~F.exists(gs, lambda o: o["sectioned"] & (o["family"] == g["family"])))))

    def settled(groups: Column) -> Column:
        none_required = ~F.exists(groups, lambda g: ~g["optional"])
        main = F.coalesce(F.array_position(F.transform(groups, lambda g: ~g["plain"]), F.lit(True)), F.lit(0)) - 1
        main = F.when(main < 0, 0).otherwise(main)

        def last(g: Column, i: Column) -> Column:
            needed = F.when(none_required, i == main).otherwise(~g["optional"] & (~either | (i < 2)))
            return F.struct(g["group_id"].alias("group_id"), g["terms"].alias("terms"), needed.alias("required"), g["min_match"].cast("int").alias("min_match"))

        return F.slice(F.transform(groups, last), 1, most)

    clean = F.filter(F.transform(F.coalesce(terms, none()), gate_text), lambda t: (F.length(t) >= 2) & ~weak(t))
    return let(let(let(clean, entries), merged), settled)


def _words_for(values: Column, table: dict[str, list[str]], exact: bool) -> Column:
    """The values, and other words for those that the table has."""

    def more(v: Column) -> Column:
        parts = [F.when((v == k) if exact else F.contains(v, F.lit(k)), literals(words)).otherwise(none()) for k, words in table.items()]
        return F.concat(F.array(v), *parts)

    return ordered_distinct(F.flatten(F.transform(values, more)))


def _hints(low: Column, hints: list[str]) -> Column:
    return F.filter(literals(hints), lambda h: F.contains(low, h))


def relations_of(groups: Column, low: Column, either: Column) -> Column:
    """(relations, interaction_required): pairs of required groups that have to stand near one another (JOIN-05)."""
    required = F.filter(groups, lambda g: g["required"])
    statutes = F.size(F.filter(groups, lambda g: F.exists(g["terms"], statutory)))
    cue = any_of([F.contains(low, F.lit(c)) for c in INTERACTION_CUES]) | (any_of([F.contains(low, F.lit(c)) for c in STATUTORY_CUES]) & (statutes >= 2))
    shape = any_of([low.rlike(p) for p in INTERACTION_PATTERNS]) & (statutes >= 2)
    needed = (F.size(required) > 1) & (cue | shape | ~either)
    ids = F.slice(F.transform(required, lambda g: g["group_id"]), 1, 4)
    pairs = let(ids, lambda r: F.flatten(F.transform(r, lambda a, i: F.transform(F.slice(r, i + 2, F.lit(4)), lambda b: F.struct(a.alias("left"), b.alias("right"))))))
    return F.struct(F.when(needed, F.slice(pairs, 1, 8)).otherwise(F.array().cast("array<struct<left: string, right: string>>")).alias("relations"), needed.alias("interaction_required"))


def role_target(low: Column) -> Column:
    """The part that the question's actor has to play: appellant, respondent, prosecution or none."""
    return F.when(low.rlike(ASKS_RESPONDENT), "respondent").when(low.rlike(ASKS_PROSECUTION) & ~low.rlike(ASKS_APPEAL), "prosecution").when(low.rlike(ASKS_APPELLANT), "appellant").otherwise("none")


def build_checklists(intents: DataFrame, *, text: str = "cleaned", plan: str | None = None, out: str = "checklist") -> DataFrame:
    """Add the checklist of each question, from its intent (QRY-36).

    intents has the columns that intent_profile adds.  `plan` names a column of model plans (planning.PLAN_TYPE), whose
    actors, proceeding, hooks and outcomes then come first.
    """
    of_plan = (lambda k: F.coalesce(F.col(f"{plan}.{k}"), none())) if plan else (lambda k: none())
    df = intents.withColumn("_q", gate_text(F.col(text)))
    q = F.col("_q")
    refs = references(F.col(text))
    df = df.withColumn("_refs", refs)
    df = df.withColumn("_either", disjunctive_words(F.col(text)) | asks_for_either(F.col(text), F.col("_refs")))
    about_delay = F.concat_ws(" ", q, F.array_join("issues", " "), F.array_join("procedures", " "), F.array_join("statutes", " ")).rlike(ABOUT_DELAY)
    fitting = lambda xs: F.filter(xs, lambda t: about_delay | ~t.rlike(DELAY_TERM))
    norm = lambda most, *parts: F.slice(F.array_distinct(F.filter(F.transform(F.concat(*parts), gate_text), lambda t: F.length(t) >= 2)), 1, most)
    df = df.withColumns(
        {
            "_actors": norm(16, of_plan("actors"), F.col("actors"), _hints(q, ACTOR_HINTS)),
            "_proceedings": norm(16, of_plan("proceeding"), F.col("procedures"), _hints(q, PROCEEDING_HINTS)),
            "_hooks": norm(24, of_plan("legal_hooks"), F.col("statutes")),
            "_outcomes": norm(16, fitting(of_plan("outcome_required")), F.col("issues"), _hints(q, OUTCOME_PHRASES), _hints(q, OUTCOME_HINTS)),
            "_against": norm(16, fitting(F.concat(of_plan("outcome_negative"), of_plan("must_not_have_terms")))),
        }
    )
    df = df.withColumn("_groups", hook_groups_of(F.col("_hooks"), F.col("_either"), F.col(f"{plan}.hook_groups") if plan and "hook_groups" in intents.schema[plan].dataType.names else None))
    df = df.withColumn("_relations", relations_of(F.col("_groups"), q, F.col("_either")))
    bag = F.concat_ws(" ", q, F.array_join("_outcomes", " "))
    about_sanction = bag.rlike(r"\bsanction\b")
    sanction = F.when(about_sanction & bag.rlike(SANCTION_NOT), "not_required").when(about_sanction & bag.rlike(SANCTION_NEEDED), "required")
    mixed = q.rlike(r"\bor\b") & bag.rlike(FAILED) & bag.rlike(WENT_ON)
    hands_off = (F.col("polarity") == "refused") & bag.rlike(HANDS_OFF) & ~bag.rlike(DELAY_WORD)
    asks = open_ended(F.col(text)) & ~disposition(F.col(text)) & ~F.coalesce(sanction, F.col("polarity")).isin("required", "not_required")
    df = df.withColumn("_polarity", F.when(mixed | hands_off | asks, "unknown").otherwise(F.coalesce(sanction, F.col("polarity"))))
    defaults = lambda k: F.coalesce(*[F.when(F.col("_polarity") == name, literals(both[k])) for name, both in OUTCOMES.items()], none())
    needed = F.col("_polarity") != "unknown"
    df = df.withColumns({"_needed": needed, "_terms": norm(14, F.col("_outcomes"), defaults(0)), "_contra": norm(16, F.col("_against"), defaults(1))})
    hooked = F.exists("_groups", lambda g: g["required"])
    independent = F.exists("_proceedings", lambda t: ~statutory(t) & ~t.rlike(OUTCOME_LIKE))
    plain_one = F.exists("_proceedings", lambda t: ~t.rlike(OUTCOME_LIKE))
    df = df.withColumns({"_hooked": hooked, "_proceeds": independent | (~hooked & plain_one)})
    actors = F.when(F.size("_actors") > 0, _words_for(F.col("_actors"), ACTOR_WORDS, True)).otherwise(none())
    proceedings = F.when(F.col("_proceeds"), _words_for(F.col("_proceedings"), PROCEEDING_WORDS, False)).otherwise(none())
    outcomes = F.when(F.col("_needed"), ordered_distinct(F.concat(_words_for(F.col("_terms"), OUTCOME_WORDS, False), _words_for(F.transform("issues", gate_text), OUTCOME_WORDS, False)))).otherwise(none())
    df = df.withColumns({"_actor_words": actors, "_proceeding_words": proceedings, "_outcome_words": outcomes, "_role": role_target(q)})
    step = lambda name, kind, left, right, mandatory: F.struct(name.alias("step_id"), F.lit(kind).alias("kind"), left.alias("left"), right.alias("right"), F.lit(mandatory).alias("mandatory"))
    role = ~F.col("_hooked") & (F.col("_role") != "none") & (F.size("_actor_words") > 0)
    delay = q.rlike(r"\b(?:condonation|delay condonation|section 5 limitation)\b") | F.exists("_proceeding_words", lambda t: F.contains(t, F.lit("condonation")))
    chain = ~F.col("_hooked") & delay & F.col("_polarity").isin("refused", "dismissed") & q.rlike(REFUSAL_CUE)
    mandatory = [
        F.when(role, step(F.concat(F.lit("role:"), F.col("_role")), "role", F.col("_actor_words"), none(), True)),
        F.when(F.size("_proceeding_words") > 0, step(F.lit("proceeding:primary"), "proceeding", F.col("_proceeding_words"), none(), True)),
        F.when(F.size("_outcome_words") > 0, step(F.lit("outcome:primary"), "outcome", F.col("_outcome_words"), none(), True)),
        F.when(chain, step(F.lit("chain:condonation_refusal"), "chain", F.array_distinct(F.concat(literals(CONDONATION), F.filter("_proceeding_words", lambda t: t.rlike("condonation|delay")))), F.array_distinct(F.concat(literals(REFUSAL), F.col("_outcome_words"))), True)),
    ]
    side = F.transform(F.concat(F.slice("_actor_words", 1, 2), F.slice(F.transform("domains", gate_text), 1, 2)), lambda t: step(F.concat(F.lit("peripheral:"), t), "term", F.array(t), none(), False))
    axis = lambda label, terms, required: F.struct(F.lit(label).alias("label"), terms.alias("terms"), required.alias("required"))
    made = F.struct(
        F.array(axis("actor or party role", F.col("_actors"), F.size("_actors") > 0), axis("proceeding or posture", F.col("_proceedings"), F.col("_proceeds")), axis("statute or section", F.col("_hooks"), F.col("_hooked")), axis("required outcome", F.col("_terms"), F.col("_needed"))).alias("axes"),
        F.col("_groups").alias("groups"),
        F.col("_relations.relations").alias("relations"),
        F.col("_terms").alias("outcome"),
        F.col("_contra").alias("outcome_contradictions"),
        F.col("_polarity").alias("polarity"),
        F.col("_needed").alias("outcome_required"),
        F.slice(F.array_distinct(F.concat("_against", "_contra")), 1, 18).alias("contradictions"),
        F.col("_relations.interaction_required").alias("interaction_required"),
        F.concat(F.filter(F.array(*mandatory), lambda s: s.isNotNull()), side).alias("steps"),
        F.when(role, F.col("_role")).otherwise("none").alias("role"),
        F.when(role, F.col("_actor_words")).otherwise(none()).alias("role_actors"),
    )
    return df.withColumn(out, made.cast(CHECKLIST)).select(*intents.columns, out)


def checklist_column(checklist: Checklist) -> Column:
    """A constant checklist as a column, for the same judgement by signals_of."""
    row = (
        [(label, list(terms), required) for label, terms, required in checklist.axes],
        [(g.group_id, list(g.terms), g.required, g.min_match) for g in checklist.groups],
        [tuple(r) for r in checklist.relations if set(r) <= {g.group_id for g in checklist.groups}],
        list(checklist.outcome), list(checklist.outcome_contradictions), "unknown", checklist.outcome_required, list(checklist.contradictions), checklist.interaction_required,
        [(s.step_id, "chain" if s.right else "term", list(s.left), list(s.right), s.mandatory) for s in checklist.steps],
        "none", [],
    )

    def lit(v) -> Column:
        if isinstance(v, list):
            return F.array(*map(lit, v))
        return F.struct(*map(lit, v)) if isinstance(v, tuple) else F.lit(v)

    return lit(row).cast(CHECKLIST)


def in_mode(checklist: Column, *, hooks: bool = True, graph: bool = True) -> Column:
    """A checklist without required hooks and relations, or without steps, for the simpler modes of the gate (GAT-08)."""
    out = checklist
    if not hooks:
        out = out.withField("groups", F.transform(out["groups"], lambda g: g.withField("required", F.lit(False))))
        out = out.withField("relations", F.array().cast("array<struct<left: string, right: string>>")).withField("interaction_required", F.lit(False))
    if not graph:
        out = out.withField("steps", F.array().cast(f"array<{STEP}>")).withField("role", F.lit("none"))
    return out


def quoted(term: Column) -> Column:
    return F.concat(F.lit(r"\Q"), term, F.lit(r"\E"))


def checklist_terms(df: DataFrame, checklist: str = "checklist") -> list[str]:
    """All terms of the rows' checklists: as many as the stated questions have."""
    c = F.col(checklist)
    lists = F.concat(
        F.flatten(F.transform(c["axes"], lambda a: a["terms"])), F.flatten(F.transform(c["groups"], lambda g: g["terms"])), F.flatten(F.transform(c["steps"], lambda s: F.concat(s["left"], s["right"]))), c["outcome"], c["outcome_contradictions"], c["contradictions"]
    )
    return [r["term"] for r in df.select(F.explode(lists).alias("term")).distinct().collect() if r["term"]]


def near_of(places: Column, left: Column, right: Column, window: int, most: int) -> Column:
    """Some term of either list stands near one of the other (JOIN-06)."""
    return let(places_of(places, right, most), lambda b: F.exists(places_of(places, left, most), lambda x: F.exists(b, lambda y: F.abs(x - y) <= window)))


def role_fits(text: Column, role: Column, actors: Column) -> Column:
    """The text shows an actor in the role (GAT-02)."""
    who = F.concat(F.lit("(?:"), F.array_join(F.transform(actors, quoted), "|"), F.lit(")"))
    plays = lambda shapes: any_of([F.regexp_like(text, F.concat(F.lit(before), who, F.lit(after))) for before, after in shapes])
    fits = F.when(role == "appellant", plays(PLAYS_APPELLANT)).when(role == "respondent", plays(PLAYS_RESPONDENT)).when(role == "prosecution", plays(PLAYS_PROSECUTION)).otherwise(F.lit(True))
    return F.when(F.size(actors) == 0, F.lit(True)).otherwise(fits)


def signals_of(df: DataFrame, *, text: str = "text", evidence: str | None = None, checked: str = "detail_checked", checklist: str = "checklist", terms: list[str] | None = None) -> DataFrame:
    """Add the signals of each candidate under its question's own checklist: what gate.signals adds for a constant one (GAT-01, GAT-02, GAT-05).

    The terms of all checklists are found in one pass over each text; they are those of the rows, or `terms` if these are known already.
    """
    c = F.col(checklist)
    terms = checklist_terms(df, checklist) if terms is None else terms
    df = df.withColumn("_x_t", gate_text(F.col(text)))
    df = df.withColumn("_t", term_places(F.col("_x_t"), terms))
    if evidence:
        own = F.when(F.length(F.coalesce(F.col(evidence), F.lit(""))) > 0, gate_text(F.col(evidence)))
        df = df.withColumn("_e", F.coalesce(F.when(own.isNotNull(), term_places(own, terms)), F.col("_t")))
    else:
        df = df.withColumn("_e", F.col("_t"))
    t, e = F.col("_t"), F.col("_e")
    verified = F.coalesce(F.col(checked), F.lit(False)) if checked in df.columns else F.lit(False)
    words = lambda group: F.flatten(F.transform(F.filter(c["groups"], lambda g: g["group_id"] == group), lambda g: g["terms"]))
    any_has = lambda where, terms: F.exists(terms, lambda x: found(where, x))

    def step_ok(s: Column) -> Column:
        chain = near_of(t, s["left"], s["right"], CHAIN_WINDOW, 30)
        return F.when(s["kind"] == "chain", ~verified | chain).when(s["kind"] == "role", ~verified | role_fits(F.col("_x_t"), c["role"], c["role_actors"])).otherwise(any_has(t, s["left"]))

    flags = {
        "_h": F.transform(F.filter(c["groups"], lambda g: g["required"]), lambda g: F.size(F.filter(g["terms"], lambda x: found(t, x))) >= g["min_match"]),
        "_r": F.transform(c["relations"], lambda r: near_of(e, words(r["left"]), words(r["right"]), RELATION_WINDOW, 30)),
        "_a": F.transform(F.filter(c["axes"], lambda a: a["required"]), lambda a: F.struct(a["label"].alias("label"), any_has(t, a["terms"]).alias("ok"))),
        "_s": F.transform(c["steps"], lambda s: F.struct(s["kind"].alias("kind"), s["step_id"].alias("step_id"), s["mandatory"].alias("mandatory"), step_ok(s).alias("ok"))),
        "_o": any_has(e, c["outcome"]),
        "_x": F.exists(c["outcome_contradictions"], lambda x: counts_against(e, x)),
        "_y": F.exists(c["contradictions"], lambda x: counts_against(e, x)),
    }
    df = df.withColumns(flags)
    outcome_ok = ~c["outcome_required"] | (F.col("_o") & ~F.col("_x"))
    df = df.withColumns({"relation_satisfied": F.forall("_r", lambda x: x), "outcome_satisfied": outcome_ok, "contradiction": F.col("_x") | F.col("_y")})
    interacts = (F.size(c["relations"]) > 0) | c["interaction_required"]
    hits = F.size(F.filter("_h", lambda x: x))
    enough = (F.size("_h") <= 1) | (hits > 1)
    must = F.transform(F.filter("_s", lambda s: s["mandatory"]), lambda s: s["ok"])
    some = lambda condition, value: F.when(condition, F.array(value)).otherwise(F.array().cast("array<boolean>"))
    df = df.withColumn("_core", F.concat("_h", some(interacts, F.col("relation_satisfied") & enough), some(c["outcome_required"], F.col("outcome_satisfied")), must))
    df = df.withColumn("_side", F.concat(F.transform("_a", lambda a: a["ok"]), F.transform(F.filter("_s", lambda s: ~s["mandatory"]), lambda s: s["ok"])))
    share = lambda xs, empty: F.round(F.when(F.size(xs) > 0, F.size(F.filter(xs, lambda x: x)) / F.size(xs)).otherwise(F.lit(empty)), 6)
    kind_ok = lambda *kinds: F.forall(F.filter("_s", lambda s: s["kind"].isin(*kinds) & s["mandatory"]), lambda s: s["ok"])
    groups = F.filter(c["groups"], lambda g: g["required"])
    missing = F.concat(
        F.transform(F.filter(F.arrays_zip(F.transform(groups, lambda g: g["group_id"]).alias("id"), F.col("_h").alias("ok")), lambda z: ~z["ok"]), lambda z: F.concat(F.lit("hook group:"), z["id"])),
        F.when(interacts & ~F.col("relation_satisfied"), F.array(F.lit("required hook interaction"))).otherwise(none()),
        F.transform(F.filter("_a", lambda a: ~a["ok"]), lambda a: a["label"]),
    )
    out = df.withColumns(
        {
            "hook_coverage": share(F.col("_h"), 1.0),
            "core_coverage": share(F.col("_core"), 1.0),
            "peripheral_coverage": share(F.col("_side"), 1.0),
            "required_coverage": share(F.concat("_core", "_side"), 0.0),
            "step_coverage": share(must, 1.0),
            "chain_satisfied": kind_ok("chain"),
            "role_satisfied": kind_ok("role"),
            "proceeding_satisfied": kind_ok("proceeding"),
            "polarity_mismatch": c["outcome_required"] & ~F.col("outcome_satisfied"),
            "relation_required": interacts,
            "outcome_required": c["outcome_required"],
            "missing": missing,
        }
    )
    return out.drop("_t", "_e", "_x_t", "_core", "_side", *flags)


def sparse(intents: DataFrame, *, text: str = "cleaned") -> Column:
    """Too little is asked to search by parts: no statute, no issue, few anchors, few words (FLT-15)."""
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda t: F.length(t) > 1))
    return (F.size("statutes") == 0) & (F.size("issues") == 0) & (F.size("anchors") <= 8) & (words <= 9)
