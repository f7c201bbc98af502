"""HTML to text, links, result rows and detail records (PAR-09..17, FLT-02, FLT-13, FLT-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, squeeze

# Entities, and marks of pages that hold content back (fixed values).
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&#39;", "'"), ("&quot;", '"')]
BREAK_ENTITIES = [*ENTITIES, ("&lt;", "<"), ("&gt;", ">")]
BLOCK_END = r"(?i)</(?:p|div|blockquote|pre|li|h[1-6]|tr|td)>|<br\s*/?>"
# Cues of evidence sentences (fixed values).
CUES = {
    "relation": r"read with|vis[- ]?a[- ]?vis|interplay|interaction|requires under|applies to",
    "polarity": "required|not required|mandatory|necessary|refused|dismissed|rejected|not condoned|time barred|allowed|quashed",
    "hook": r"section\s*\d+[a-z]?(?:\([0-9a-z]+\))?|crpc|ipc|cpc|prevention of corruption act|pc act|limitation act",
    "role": "appellant|respondent|petitioner|accused|state of|government|prosecution|filed appeal|preferred appeal",
    "chain": "condonation of delay|delay condonation|application for condonation|not condoned|barred by limitation",
}
# Marks of a challenge page (fixed values).
CHALLENGE = ["attention required", "just a moment", "cf-chl", "cloudflare", "cdn-cgi/challenge-platform", "__cf_chl", "cf-turnstile", "cf_clearance", "checking your browser", "verify you are human"]


def strip_tags(html: Column) -> Column:
    """Visible text on one line (PAR-09)."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeeze(out)


def with_breaks(html: Column) -> Column:
    """Text with a line break where a block ends; scripts and styles go."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    out = F.regexp_replace(F.regexp_replace(out, BLOCK_END, "\n"), "<[^>]*>", " ")
    for entity, char in BREAK_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.replace(out, F.lit("\r"), F.lit("\n"))


def links(html: Column) -> Column:
    """(href, text) of all anchors, in order (PAR-10)."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), 1)
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1).alias("href"), strip_tags(a).alias("text")))


def absolute(href: Column, base: str) -> Column:
    """An absolute address; null for an empty one (PAR-13)."""
    return F.when(F.coalesce(href, F.lit("")) == "", None).when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(F.lit(base.rstrip("/")), href)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), href))


def doc_number(url: Column) -> Column:
    """The document's number in an address; null if there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)/(?:doc|docfragment)/(\d+)/?", 1), F.lit(""))


def canonical_url(href: Column, base: str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/doc/"), doc_number(href), F.lit("/"))


def count_after(html: Column, word: str) -> Column:
    """The number behind a label such as 'Cites 1,234' (PAR-11)."""
    return F.expr("try_cast(NULL AS INT)") if not word else F.nullif(F.regexp_replace(F.regexp_extract(html, rf"(?i)>\s*{word}\s*([0-9,]+)\s*<", 1), ",", ""), F.lit("")).try_cast("int")


def title_score(title: Column) -> Column:
    """How much an anchor's text looks like the title of a case (PAR-12)."""
    low = F.lower(F.trim(title))
    part = lambda cond, n: F.when(cond, n).otherwise(0)
    case_like = low.rlike(r" v(?:s\.?|\.?) |(^|[^a-z0-9_])(?:petitioner|respondent|appellant|appeal|judgment|tribunal)([^a-z0-9_]|$)")
    statute = low.rlike(r"(^|[^a-z0-9_])(?:act|code|rules),\s*\d{4}|constitution of india|indian penal code")
    score = part(case_like, 6) + part(low.rlike(r" v(?:s\.?|\.?) "), 5) + part(low.rlike(r"(^|[^a-z0-9_])on\s+\d{1,2}\s+[a-z]{3,9},?\s+\d{4}"), 4) + part(low.rlike(r"(^|[^a-z0-9_])(?:appeal|petition|petitioner|respondent|judgment)([^a-z0-9_]|$)"), 2)
    score = score - part(statute, 8) - part(low.rlike("^section([^a-z0-9_]|$)"), 5) - part(F.length(low) < 10, 2)
    return F.when(low == "", -10).otherwise(score)


#: What is said around a search result, and of a case.
RESULT_WORDS = r"\b(?:cites|cited by|full document|petitioner|respondent|appellant|judgment|appeal)\b"
CASE_WORDS = r" v(?:s\.?|\.?) |\b(?:petitioner|respondent|appellant|appeal|judgment|tribunal)\b"
CONTEXT_CHARS = 4200


def search_rows(pages: DataFrame, base: str, *, html: str = "html", page_id: str = "page_id") -> DataFrame:
    """(page_id, ordinal, title, url, mode) of the results of search pages (PAR-10).

    A page is read by the first of five modes that gives a result: result containers, result titles, headings, links to documents
    in the context of a search result (what follows them speaks of a case), and all links to documents.  A page that says
    that nothing matches has no result.  An address counts once a page.
    """
    text = F.coalesce(F.col(html), F.lit(""))
    ours = lambda a: doc_number(a["href"]).isNotNull() & ~F.lower(a["text"]).rlike("^(full document|similar judgments?|search)$")
    of = lambda source, mode: F.transform(source, lambda c: F.struct(F.filter(links(c), ours).alias("links"), F.lit(mode).alias("mode")))
    some = lambda rows: F.exists(rows, lambda r: F.size(r["links"]) > 0)
    chunk = F.slice(F.split(text, r"(?i)<div[^>]*class=[\"'][^\"']*\bresult\b[^\"']*[\"'][^>]*>"), 2, 1 << 30)
    titles = F.transform(F.slice(F.split(text, r"(?i)<div[^>]*class=[\"'][^\"']*result_title[^\"']*[\"'][^>]*>"), 2, 1 << 30), lambda c: F.regexp_extract(F.left(c, F.lit(5200)), r"(?is)^(.{0,700}?<a\b[^>]*>.*?</a>)", 1))
    heads = F.regexp_extract_all(text, F.lit(r"(?is)(<h4[^>]*>.*?</h4>)"), 1)

    def in_context(pieces: Column) -> Column:
        """Each link to a document with what follows it, as far as that speaks of a case."""
        n = F.size(pieces)
        after = lambda i: F.left(F.array_join(F.slice(pieces, i + 2, n), ""), F.lit(CONTEXT_CHARS))
        speaks = lambda c: F.lower(strip_tags(c)).rlike(RESULT_WORDS) | c.rlike(r"(?i)result[_\s-]?title|result[_\s-]?snippet|class=[\"'][^\"']*result")
        own = F.transform(F.slice(pieces, 2, 1 << 30), lambda p, i: F.when(speaks(after(i)) & F.lower(strip_tags(after(i))).rlike(CASE_WORDS), F.regexp_extract(p, r"(?is)^(<a\b[^>]*>.*?</a>)", 1)))
        return F.filter(own, lambda x: x.isNotNull())

    around = let(F.split(text, r"(?i)(?=<a[^>]+href=[\"'][^\"']*/(?:doc|docfragment)/\d)"), in_context)
    modes = {"container": chunk, "title": titles, "heading": heads, "context": around, "links": F.array(text)}
    rows = pages.withColumns({f"_{name}": of(source, name) for name, source in modes.items()})
    picked = F.col("_links")
    for name in reversed(list(modes)[:-1]):
        picked = F.when(some(F.col(f"_{name}")), F.col(f"_{name}")).otherwise(picked)
    empty = F.lower(text).contains("no matching results")
    rows = rows.withColumn("_rows", F.when(~empty, picked)).drop(*[f"_{name}" for name in modes])
    rows = rows.select(page_id, F.posexplode("_rows").alias("chunk_ix", "_row")).where(F.size("_row.links") > 0)
    # the best link of a container, title, heading or context; every one of a harvest
    scored = F.transform("_row.links", lambda a: F.struct(title_score(a["text"]).alias("score"), a["text"].alias("title"), canonical_url(a["href"], base).alias("url")))
    best = F.array_max(F.transform(scored, lambda a: a["score"]))
    picked = F.when(F.col("_row.mode") == "links", scored).otherwise(F.slice(F.filter(scored, lambda a: a["score"] == best), 1, 1))
    rows = rows.select(page_id, "chunk_ix", F.col("_row.mode").alias("mode"), F.posexplode(picked).alias("link_ix", "_a"))
    first = rows.groupBy(page_id, F.col("_a.url").alias("url")).agg(F.min(F.struct("chunk_ix", "link_ix", F.col("_a.title").alias("title"), "mode")).alias("f"))
    return first.select(page_id, (F.col("f.chunk_ix") * 1000 + F.col("f.link_ix")).alias("ordinal"), "f.title", "url", "f.mode")


def sentences(text: Column, least: int = 30) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n.!?]+"), squeeze)
    return F.filter(parts, lambda s: F.length(s) > least)


def body_blocks(html: Column) -> Column:
    """Body text by priority: preformatted lines, quotations, paragraphs, dense lines (PAR-14)."""
    lines = lambda x: F.transform(F.split(with_breaks(x), r"\n+"), squeeze)
    inner = lambda tag: F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1)
    longer = lambda xs, n, most: F.slice(F.filter(xs, lambda s: F.length(s) > n), 1, most)
    pre = longer(F.flatten(F.transform(inner("pre"), lines)), 40, 140)
    quotes = longer(F.transform(inner("blockquote"), strip_tags), 30, 80)
    paragraphs = longer(F.transform(inner("p"), strip_tags), 40, 40)
    dense = longer(lines(html), 80, 80)
    return F.when(F.size(pre) > 0, pre).when(F.size(quotes) > 0, quotes).when(F.size(paragraphs) > 0, paragraphs).otherwise(dense)


def evidence_windows(blocks: Column, most: int = 28, cues: dict[str, str] = CUES) -> Column:
    """Sentences with two kinds of cues that belong together (PAR-15)."""
    def good(s: Column) -> Column:
        low = F.lower(s)
        c = {k: low.rlike(p) for k, p in cues.items()}
        return (c["relation"] & c["hook"]) | (c["polarity"] & c["hook"]) | (c["relation"] & c["polarity"]) | (c["role"] & c["polarity"]) | (c["chain"] & c["polarity"])

    return F.slice(F.filter(F.flatten(F.transform(blocks, lambda b: sentences(b))), good), 1, most)


def detail_record(html: Column) -> Column:
    """Title, court, citations, author, bench, counts, body and evidence of a detail page (PAR-14)."""
    heads = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h3[^>]*>(.*?)</h3>"), 1), strip_tags), lambda h: h != "")
    of = lambda pattern: F.get(F.filter(heads, lambda h: F.lower(h).rlike(pattern)), F.lit(0))
    after = lambda label: F.trim(F.regexp_replace(of(f"^{label}:"), f"(?i)^{label}:\\s*", ""))
    title = F.nullif(strip_tags(F.regexp_extract(html, r"(?is)<h2[^>]*>(.*?)</h2>", 1)), F.lit(""))
    blocks = body_blocks(html)
    court_text = of(r"(^|[^a-z0-9_])court([^a-z0-9_]|$)")
    place = F.lower(F.concat_ws(" ", court_text, title, F.array_join(F.slice(blocks, 1, 2), " ")))
    court = F.when(F.contains(place, F.lit("supreme court")), "SC").when(F.contains(place, F.lit("high court")), "HC").otherwise("UNKNOWN")
    return F.struct(title.alias("title"), court_text.alias("court_text"), court.alias("court"), after("equivalent citations").alias("citations"), after("author").alias("author"), after("bench").alias("bench"), count_after(html, "Cites").alias("cites"), count_after(html, r"Cited\s*by").alias("cited_by"), evidence_windows(blocks).alias("evidence_windows"), F.slice(blocks, 1, 28).alias("body"))


def detail_text(record: Column, most: int = 12000) -> Column:
    """A detail record as text, at most `most` characters (PAR-16)."""
    line = lambda label, value: F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(label), value.cast("string")))
    lines = [line("Title: ", record["title"]), line("Court: ", record["court_text"]), line("Equivalent citations: ", record["citations"]), line("Author: ", record["author"]), line("Bench: ", record["bench"]), line("Cites count: ", record["cites"]), line("Cited by count: ", record["cited_by"]), line("Evidence windows:\n", F.array_join(record["evidence_windows"], "\n")), line("Body:\n", F.array_join(record["body"], "\n"))]
    return F.left(F.concat_ws("\n", *lines), F.lit(most))


def evidence_quality(text: Column, cues: dict[str, str] = CUES, most: int = 160) -> Column:
    """Which kinds of evidence the sentences of a text have (PAR-17)."""
    found = F.slice(sentences(F.lower(text)), 1, most)
    hooks = lambda s: F.size(F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(f"({cues['hook']})"), 1), squeeze)))
    any_ = lambda test: F.exists(found, test)
    return F.struct(
        any_(lambda s: s.rlike(cues["relation"])).alias("relation"),
        any_(lambda s: s.rlike(cues["polarity"])).alias("polarity"),
        any_(lambda s: (hooks(s) >= 2) & (s.rlike(cues["relation"]) | s.rlike(cues["polarity"]))).alias("hook_intersection"),
        any_(lambda s: s.rlike(cues["role"])).alias("role"),
        any_(lambda s: s.rlike(cues["chain"]) & (s.rlike(cues["polarity"]) | F.contains(s, F.lit("appeal")))).alias("chain"),
    )


def challenged(html: Column) -> Column:
    """Whether a page is a browser challenge instead of content (FLT-13)."""
    low = F.lower(F.coalesce(html, F.lit("")))
    out = F.lit(False)
    for marker in CHALLENGE:
        out = out | F.contains(low, F.lit(marker))
    return out


def error_code(message: Column) -> Column:
    """The class of a fetch error (AGG-20)."""
    m = F.lower(F.coalesce(message, F.lit("")))
    cases = [(r"(^|\D)403(\D|$)|forbidden|cloudflare|challenge|just a moment", "http_403"), (r"(^|\D)429(\D|$)|rate[_ -]?limit|throttle", "http_429"), ("timeout|timed out|abort", "timeout"), ("detail_parse_empty|empty detail|no evidence windows", "parse_empty"), ("network|fetch failed|econn|enotfound|socket|dns", "network")]
    out = F.lit("unknown")
    for pattern, code in reversed(cases):
        out = F.when(m.rlike(pattern), code).otherwise(out)
    return out
