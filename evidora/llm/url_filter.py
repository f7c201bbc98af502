"""URL filter by a path-template tree and a list of explicit rules.

Only DataFrame functions are used.  Addresses are counted by host and path
segments first (digit runs become ``{n}`` and long hexadecimal ones ``{x}``), so
whatever follows works on counts.  From the root of a host's tree down, one depth after
another:

* a place with many children that have few addresses each is variable, and
  those children become one wildcard ``*``; a child with more addresses does not
  by this rule;
* other sibling branches whose labelled shares of bad pages do not differ
  significantly from what the other siblings have are merged into ``*``; a branch
  that does differ keeps its name.

A template's share of bad labelled pages is smoothed towards its host's, and
that towards all hosts'; templates above `reject` are blocked.  An explicit rule
that fits goes before the method's verdict.

Labels can be made of the pages themselves (`page_labels`): a page is bad if a
classifier chain finds its visible text toxic or of low quality, or if most of what is visible stands in links.
Nothing is known of hosts beforehand; names of hosts known to be bad can be given as seeds.

Defined results: a null address, or one without ``://``, has an empty host and an
empty path and is judged as their template; very long addresses are read to their
end; repeated rows count as often as they come; of several labels for an id the highest
counts, and null ones are left out; a share equal to `reject` is allowed, and of rules
that fit the longest wins, of equally long ones the last by name; an empty table gives an
empty one; other columns are kept, and a column named as an output is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import fresh, settle
from .toxicity import Chain, score

MANY_CHILDREN = 12
FEW_EACH = 4.0
Z = 1.96
#: Pages that the shares above a template's and a host's own count for.
STRENGTH = 3.0
REJECT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of the visible characters from which on a page is one of links.
LINKS = 0.5
UNSEEN = r"(?is)<!--.*?-->|<(script|style|nav|footer|noscript)\b.*?</\1\s*>|<[^>]*>|&[#\w]+;"
ADDRESS = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, as a struct; null if none does.

    A rule is (host and path prefix, verdict).  Rules are parameters and become part of the plan.
    """
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # longer ones are asked first
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def segments_of(path: Column) -> Column:
    """Generalised segments."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"(?i)(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}", "{x}"), r"\d+", "{n}"))


def _sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))


def _places(now: DataFrame, depth: int) -> DataFrame:
    """Places with paths that go on below `depth`, and their leaves."""
    return now.where(F.size("template") > depth).groupBy("host", F.slice("template", 1, depth).alias("above")).agg(F.count("*").alias("leaves"))


def template_tree(leaves: DataFrame) -> DataFrame:
    """(host, segments, template) for leaves (host, segments, n, labelled, bad)."""
    now = leaves.withColumn("template", F.col("segments"))
    depth = 0
    # a place with one leaf keeps its names all the way down, so the tree ends where no place has more
    while _places(now, depth).where("leaves > 1").limit(1).count():
        depth += 1
        cut = now.withColumn("above", F.slice("template", 1, depth - 1)).withColumn("own", F.try_element_at("template", F.lit(depth)))
        nodes = settle(_sums(cut.where("own is not null"), "host", "above", "own"))
        places = nodes.groupBy("host", "above").agg(F.count("*").alias("children"), F.count_if(F.col("n") < FEW_EACH).alias("small"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        places = settle(places)  # tables on both sides, so that the children of one place can be split
        both = nodes.join(places, ["host", "above"])
        rest_labelled, rest_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        pooled = (F.col("all_bad") + 0.5) / (F.col("all_labelled") + 1.0)
        error = F.sqrt(pooled * (1 - pooled) * (1.0 / (F.col("labelled") + 1.0) + 1.0 / (rest_labelled + 1.0)))
        apart = F.abs((F.col("bad") + pooled) / (F.col("labelled") + 1.0) - (rest_bad + pooled) / (rest_labelled + 1.0))
        variable = (F.col("small") >= MANY_CHILDREN) & (F.col("n") < FEW_EACH)
        alike = (F.col("children") > 1) & (apart <= Z * error)
        names = both.select("host", "above", "own", F.when(variable | alike, F.lit("*")).otherwise(F.col("own")).alias("name"))
        now = cut.join(names, ["host", "above", "own"], "left")
        tail = F.slice("template", F.lit(depth + 1), F.size("template"))
        now = now.withColumn("template", F.when(F.col("own").isNull(), F.col("template")).otherwise(F.concat("above", F.array("name"), tail))).drop("above", "own", "name")
        now = settle(now.select("host", "segments", "template", "n", "labelled", "bad"))
    return now


def judge_templates(tree: DataFrame, reject: float) -> DataFrame:
    """(host, template, labelled, share, blocked): shares are smoothed towards the host's, and those towards all."""
    total = tree.agg(F.sum("labelled").alias("total_labelled"), F.sum("bad").alias("total_bad"))
    top = total.select(((F.coalesce("total_bad", F.lit(0)) + 1.0) / (F.coalesce("total_labelled", F.lit(0)) + 2.0)).alias("top")).first()[0]
    hosts = _sums(tree, "host").select("host", ((F.col("bad") + STRENGTH * F.lit(top)) / (F.col("labelled") + STRENGTH)).alias("host_share"))
    share = (F.col("bad") + STRENGTH * F.col("host_share")) / (F.col("labelled") + STRENGTH)
    judged = settle(_sums(tree, "host", "template")).join(settle(hosts), "host").withColumn("share", share)
    return judged.select("host", "template", "labelled", "share", (F.col("share") > reject).alias("blocked"))


def link_share(html: Column) -> Column:
    """Share of a page's visible characters, without white space, that stand in links; 0 of a page without text."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>", " ")
    size = lambda text: F.length(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), r"\s+", ""))
    return F.coalesce(F.try_divide(size(F.array_join(F.regexp_extract_all(shown, F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), 1), "")), size(shown)), F.lit(0.0))


def page_labels(pages: DataFrame, chain: Chain, seeds: list[str] = (), *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, bad) of every page: by its visible text, where any category of the chain reaches its threshold, by its share of links, or by a seed word in its host's name."""
    visible = F.regexp_replace(F.coalesce(F.col(f"`{html}`"), F.lit("")), UNSEEN, " ")
    linked = link_share(F.col(f"`{html}`")) >= LINKS
    named = F.arrays_overlap(F.split(host_of(F.col(f"`{url}`")), r"[.\-]"), F.array(*map(F.lit, seeds))) if seeds else F.lit(False)
    texts = pages.select(F.col(f"`{page_id}`").alias("page_id"), (linked | named).alias("shown_bad"), visible.alias("text"))
    scored = score(texts, chain, rejected="toxic_text")
    bad = reduce(lambda a, b: a | b, [F.col(f"p_{c}") >= t for c, t in zip(chain.categories, chain.thresholds)])
    return scored.select("page_id", (bad | F.col("shown_bad")).alias("bad"))


def filter_urls(df: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], *, url: str = "url", page_id: str = "page_id", label_id: str = "page_id", bad: str = "bad", reject: float = REJECT) -> DataFrame:
    """Add host, path, rule, verdict, template and bad_share to each row; `labels` has (label_id, bad boolean)."""
    df = df.drop("host", "path", "rule", "verdict", "template", "bad_share")
    own = fresh(df, ["segments", "label", "found", "key", "blocked"])
    marks = labels.select(F.col(f"`{label_id}`").alias(page_id), F.col(f"`{bad}`").cast("long").alias(own["label"])).dropna().groupBy(page_id).agg(F.max(own["label"]).alias(own["label"]))
    pages = df.withColumn("host", host_of(F.col(f"`{url}`"))).withColumn("path", path_of(F.col(f"`{url}`"))).withColumn(own["segments"], segments_of(F.col("path")))
    counted = pages.select(page_id, "host", F.col(own["segments"]).alias("segments")).join(marks, page_id, "left")
    label = F.col(own["label"])
    leaves = counted.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count(label).alias("labelled"), F.coalesce(F.sum(label), F.lit(0)).alias("bad"))
    tree = template_tree(settle(leaves))
    judged = judge_templates(tree, reject)
    found = tree.select("host", "segments", "template").join(judged, ["host", "template"])
    # the template in words only where the leaves are joined: a leaf is known by its host and segments
    found = found.select("host", F.col("segments").alias(own["segments"]), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), F.round("share", 6).alias("bad_share"), F.col("blocked").alias(own["blocked"]))
    out = pages.join(settle(found), ["host", own["segments"]], "left").withColumn(own["found"], fitting_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col(f"{own['found']}.verdict"), F.when(F.col(own["blocked"]), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "host", "path", F.col(f"{own['found']}.rule").alias("rule"), verdict.alias("verdict"), "template", "bad_share")
