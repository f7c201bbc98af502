"""Text functions as column expressions: tokenisers, overlap, cleaning (TOK-01..11, SCR-01).

Tokens are runs of ASCII letters and digits (some tokenisers keep more), so that
word boundaries mean the same whatever letters stand around them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Characters of a text's beginning.
HEAD = 512


@dataclass(frozen=True)
class Tokenizer:
    """What a token is: characters kept, least length, stop words, most tokens."""

    kept: str = "a-z0-9"
    least: int = 1
    stop: tuple[str, ...] = field(default=())
    digits_pass: bool = False  # a token with a digit may be shorter
    most: int = 0  # most distinct tokens; 0 for all

    def all(self, text: Column) -> Column:
        """Tokens in order, with repeats; none for a null text."""
        found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[{self.kept}]+"), 0)
        if self.digits_pass:
            found = F.filter(found, lambda t: (F.length(t) >= self.least) | t.rlike("[0-9]"))
        elif self.least > 1:
            found = F.filter(found, lambda t: F.length(t) >= self.least)
        if self.stop:
            stop = F.array(*[F.lit(s) for s in self.stop])
            found = F.filter(found, lambda t: ~F.array_contains(stop, t))
        return found

    def distinct(self, text: Column) -> Column:
        """Tokens in the order of their first occurrence.

        Where only `most` are asked for and a text's beginning has more, it is not cut to its end: only the beginning's last token may be a part of one.
        """
        found = F.array_distinct(self.all(text))
        if not self.most:
            return found
        return let(F.array_distinct(self.all(F.left(text, F.lit(HEAD)))), lambda k: F.slice(F.when(F.size(k) > self.most, k).otherwise(found), 1, self.most))


# Stop words of the scorers and the context, title and diversity tokenisers (fixed values).
SCORING_STOP = ("the", "and", "for", "with", "this", "that", "into", "under", "where", "when", "from", "between", "about", "case", "precedent")
CORE_STOP = ("the", "and", "for", "with", "that", "this", "from", "into", "under", "where", "when", "case", "appeal", "application", "filed", "state", "order", "court", "high", "supreme", "condonation", "delay")

# Stop words of the context and keyword tokenisers, connectors, and words of titles (fixed values).
CONTEXT_STOP = ("a", "an", "and", "or", "the", "to", "of", "in", "for", "with", "on", "at", "by", "from", "under", "into", "after", "before", "where", "when", "whether", "please", "kindly", "find", "show", "give", "cases", "case", "precedent", "precedents", "judgment", "judgments")
KEYWORD_STOP = ("a", "an", "and", "or", "the", "to", "of", "in", "for", "with", "on", "at", "by", "from", "under", "into", "after", "before", "where", "when", "whether", "please", "find", "show", "give", "cases", "case", "precedent", "precedents", "judgment", "judgments")
CONNECTOR_STOP = ("there", "their", "about", "between", "through", "based", "also", "anything", "found")
TITLE_STOP = ("the", "and", "for", "with", "from", "this", "that", "case", "versus", "judgment", "order", "court", "india", "state", "application", "appeal")

SCORING = Tokenizer(least=3, stop=SCORING_STOP)  # TOK-01
RERANK = Tokenizer(least=3)  # TOK-02
EMBEDDING = Tokenizer(least=2)  # TOK-03
SIGNATURE = Tokenizer(least=2)  # TOK-07
CORE = Tokenizer(least=5, stop=CORE_STOP)  # TOK-08
REWRITE = Tokenizer(kept="a-z0-9()/\\-", least=2, digits_pass=True)  # TOK-06
CONTEXT = Tokenizer(least=3, stop=CONTEXT_STOP)  # TOK-04
KEYWORDS = Tokenizer(least=3, stop=KEYWORD_STOP + CONNECTOR_STOP)  # TOK-05
TITLE = Tokenizer(least=3, stop=TITLE_STOP, most=10)  # TOK-09
COACH = Tokenizer(kept="a-z0-9()", least=2)  # TOK-11
GROUNDING = Tokenizer(kept="a-z0-9()/\\-", least=2)  # TOK-11
ADVISORY = Tokenizer(least=2)  # TOK-11
EVALUATION = Tokenizer(kept="a-z0-9()/\\-")  # TOK-11


def let(value: Column, use) -> Column:
    """use(value), with the value computed once for each row, also where `use` has it inside a lambda."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of the distinct tokens of a that b has; 0 if a has none (SCR-01)."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def squeeze(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x{00a0}]+", " "))


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether any term is in the lower-case text, as plain text."""
    out = F.lit(False)
    for t in terms:
        if t:
            out = out | F.contains(text, F.lit(t.lower()))
    return out


def count_terms(text: Column, terms: list[str]) -> Column:
    """How many of the terms are in the lower-case text (JOIN-04)."""
    hits = [F.contains(text, F.lit(t.lower())).cast("int") for t in terms if t]
    return sum(hits, F.lit(0)) if hits else F.lit(0)


def count_terms_of(text: Column, terms: Column) -> Column:
    """The same for an array column of terms; empty and null ones do not count."""
    wanted = F.coalesce(terms, F.array().cast("array<string>"))
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.size(F.filter(wanted, lambda t: t.isNotNull() & (t != "") & F.contains(low, F.lower(t)))))


def ngrams(tokens: Column, size: int, most: int | None = None) -> Column:
    """Windows of `size` tokens as phrases (WIN-07)."""
    none = F.array().cast("array<string>")
    made = let(tokens, lambda k: F.when(F.size(k) >= size, F.transform(F.sequence(F.lit(1), F.size(k) - (size - 1)), lambda i: F.array_join(F.slice(k, i, size), " "))).otherwise(none))
    return F.slice(made, 1, most) if most else made


def ordered_distinct(values: Column, most: int | None = None) -> Column:
    """Trimmed values without empty and repeated ones, the first of each stays (AGG-17)."""
    made = F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))
    return F.slice(made, 1, most) if most else made


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def has_word(text: Column, word_pattern: str) -> Column:
    """Whether a pattern stands as a word of ASCII letters and digits in a lower-case text."""
    return text.rlike(f"(?<![a-z0-9_])(?:{word_pattern})(?![a-z0-9_])")
