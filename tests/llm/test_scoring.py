"""Toxicity chain, language ID, URL filter, licence scan and chunk dedup on small tables."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidora.llm import chunk_dedup, lang_id, license_scan, queries, toxicity, url_filter
from evidora.llm.bytetext import text_bytes

from .test_dedup import rand_text

SF = "/root/testdata/sf0.01"


# --- toxicity


def test_chain_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = labels.where("pmod(xxhash64(doc_id), 3) = 0")
    chain = toxicity.train(docs, labels.join(held, "doc_id", "left_anti"), {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}, sample=2000)
    got = toxicity.score(docs, chain).join(held, "doc_id").select("rejected", "toxic").collect()
    right = sum(bool(r.toxic) == r.rejected for r in got) / len(got)
    caught = [r.rejected for r in got if r.toxic]
    assert right > 0.97 and sum(caught) / len(caught) > 0.8
    assert len(chain.models[1].weights) == len(chain.models[0].weights) + 1  # the earlier category is a feature


def test_linear_model_is_at_its_optimum():
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 4))
    y = (r.random(300) < 1 / (1 + np.exp(-x @ [1, -2, 0, 0.5]))).astype(float)
    m = toxicity.fit_linear(x, y)
    p = 1 / (1 + np.exp(-m.log_odds(x)))
    assert np.allclose(x.T @ (y - p), toxicity.PENALTY * m.weights, atol=1e-3) and abs((y - p).sum()) < 1e-3


def plain_logistic(x, y, penalty):
    """The ridge-penalised optimum by plain gradient steps, one weight after another; the bias is not penalised."""
    w = [0.0] * (len(x[0]) + 1)
    for _ in range(4000):
        g = [0.0] * len(w)
        for row, t in zip(x, y):
            z = sum(a * b for a, b in zip(row, w)) + w[-1]
            e = t - 1 / (1 + math.exp(-max(-30, min(30, z))))
            for k, v in enumerate(row):
                g[k] += e * v
            g[-1] += e
        w = [a + 0.05 * (b - (penalty * a if k < len(w) - 1 else 1e-6 * a)) for k, (a, b) in enumerate(zip(w, g))]
    return w


def test_the_chain_as_a_plain_version():
    """A later model's last feature in training is the earlier one's log-odds from the other folds; in use, those of the whole fit."""
    r = np.random.default_rng(3)
    x = r.normal(size=(30, 2))
    first = (x[:, 0] + 0.7 * r.normal(size=30) > 0).astype(int)
    second = (first + 0.8 * r.normal(size=30) > 0.5).astype(int)
    chain = toxicity.fit_chain(x, np.stack([first, second], axis=1), ["a", "b"], np.zeros(0, np.uint64))
    odds = lambda rows, w: [sum(a * b for a, b in zip(row, w)) + w[-1] for row in rows]
    w1 = plain_logistic(x.tolist(), first.tolist(), toxicity.PENALTY)
    folds = [i % toxicity.FOLDS for i in range(len(x))]
    ahead = [0.0] * len(x)
    for f in range(toxicity.FOLDS):
        w = plain_logistic([row for row, k in zip(x.tolist(), folds) if k != f], [t for t, k in zip(first.tolist(), folds) if k != f], toxicity.PENALTY)
        for i, k in enumerate(folds):
            if k == f:
                ahead[i] = odds([x[i].tolist()], w)[0]
    w2 = plain_logistic([[*row, a] for row, a in zip(x.tolist(), ahead)], second.tolist(), toxicity.PENALTY)
    assert np.allclose([*chain.models[0].weights, chain.models[0].bias], w1, atol=2e-3) and np.allclose([*chain.models[1].weights, chain.models[1].bias], w2, atol=2e-3)
    new = r.normal(size=(5, 2))
    want1 = odds(new.tolist(), w1)
    want2 = odds([[*row, a] for row, a in zip(new.tolist(), want1)], w2)
    assert np.allclose(chain.log_odds(new), np.stack([want1, want2], axis=1), atol=2e-2)
    # the threshold is the one of the highest F1 of the out-of-fold predictions
    p = 1 / (1 + np.exp(-np.array(ahead)))
    f1 = lambda t: 2 * ((p >= t) & (first == 1)).sum() / ((p >= t).sum() + first.sum())
    assert math.isclose(f1(chain.thresholds[0]), max(f1(t) for t in p), abs_tol=1e-9)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "a bad word", 0.5), (2, None, None), (2, "", 1.0), (None, "x", 2.0), (1, "a bad word", 0.5)], "doc_id long, text string, p_toxic double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    chain = toxicity.train(docs, none, {"toxic": F.col("toxic") == 1})
    out = toxicity.score(docs, chain).collect()
    assert len(out) == 5 and {r.p_toxic for r in out} == {0.5}
    some = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (2, 0)], "doc_id long, toxic int")
    chain = toxicity.train(docs, some, {"toxic": F.col("toxic") == 1})
    assert toxicity.score(docs, chain, drop=True).columns == docs.columns
    assert toxicity.score(docs.limit(0), chain).count() == 0


# --- licences


def dice(a, b):
    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        return set(zip(w, w[1:])) if len(w) > 1 else set(w)

    a, b = grams(a), grams(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0


def test_licenses(spark):
    r = random.Random(6)
    texts = []
    for i in range(60):
        lines = [rand_text(r, 8) for _ in range(4)]
        words = r.choice(license_scan.TEMPLATES)[1].split(" ")
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = "other"
        lines.insert(r.randint(0, 4), " ".join(words))
        texts.append("\n".join(lines))
    texts += ["All rights reserved", "", None, "MIT", "\n\n", license_scan.TEMPLATES[3][1].replace(", ", ",\n")]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    for row in license_scan.scan_licenses(df).collect():
        raw = (row.text or "").encode()
        for m in row.licenses:
            unit = raw[m.first : m.end].decode()
            best = max(dice(unit, t) for _, t in license_scan.TEMPLATES)
            assert math.isclose(m.score, best, abs_tol=1e-6) and any(n == m.license and math.isclose(dice(unit, t), best) for n, t in license_scan.TEMPLATES)
        lines = [x for x in (row.text or "").split("\n") if any(dice(x, t) >= 0.8 for _, t in license_scan.TEMPLATES)]
        assert len([m for m in row.licenses if b"\n" not in raw[m.first : m.end]]) == len(lines)
    assert license_scan.scan_licenses(df).where("doc_id = 65").first().licenses[0].license == "MIT"
    assert license_scan.scan_licenses(df.limit(0)).count() == 0
    twice = license_scan.scan_licenses(df.union(df)).groupBy("doc_id").agg(F.count_distinct(F.to_json(F.struct("licenses"))).alias("n"))
    assert twice.where("n > 1").count() == 0


def test_whole_licenses(spark):
    r = random.Random(2)
    whole = dict(license_scan.whole_licenses())
    assert {"MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "BSD-3-Clause"} <= whole.keys() and len(whole["GPL-3.0"].split()) > 5000
    texts = []
    for name, text in whole.items():
        words = text.split(" ")
        for _ in range(len(words) // 50):
            words[r.randrange(len(words))] = "other"
        texts += [(name, " ".join(words)), (name, rand_text(r, 300) + "\n\n" + " ".join(words) + "\n\n" + rand_text(r, 100_000))]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    for row in license_scan.scan_licenses(df).collect():
        name = texts[row.doc_id][0]
        longest = max(row.licenses, key=lambda m: m.end - m.first)
        unit = row.text.encode()[longest.first : longest.end].decode()
        assert longest.license == name and math.isclose(longest.score, dice(unit, whole[name]), abs_tol=1e-6)


# --- chunks


def brute_chunks(raw):
    codes = chunk_dedup._GEAR.tolist()
    h, out, first = 0, [], 0
    mask = ((1 << chunk_dedup.MASK_BITS) - 1) << 40
    for i, byte in enumerate(raw):
        h = ((h << 1) + codes[byte]) & (2**64 - 1)
        size = i + 1 - first
        enough = len(raw) - (i + 1) >= chunk_dedup.LEAST and ((size >= chunk_dedup.LEAST and h & mask == 0) or size == chunk_dedup.MOST)
        if enough or i + 1 == len(raw):
            out.append((first, i + 1))
            first = i + 1
    return out


def test_chunks(spark):
    r = random.Random(8)
    shared = rand_text(r, 120)
    rows = [(i, rand_text(r, r.randint(1, 200)) + (shared if i % 3 == 0 else "") + rand_text(r, 20)) for i in range(30)]
    rows += [(50, "short"), (51, "short"), (52, rand_text(r, 100_000) + shared), (40, None), (41, ""), (42, rows[5][1]), (42, rows[5][1]), (None, rows[6][1]), (43, "x" * 3000)]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, row string, removed_spans string")
    got = chunk_dedup.dedup_chunks(df).collect()
    home = {}
    order = sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0))
    for d, t in order:
        raw = (t or "").encode()
        for a, b in brute_chunks(raw):
            home.setdefault(raw[a:b], (d, a))
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        runs = []
        for a, b in brute_chunks(raw):
            if home[raw[a:b]] != (d, a):
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
        want.append((d, len(brute_chunks(raw)), [tuple(x) for x in runs]))
    key = lambda x: tuple((v is not None, v or 0) for v in x[:2]) + (x[2],)
    assert sorted([(g.doc_id, g.n_chunks, [(s.first, s.end) for s in g.removed_spans]) for g in got], key=key) == sorted(want, key=key)
    assert any(g.removed_spans for g in got if g.doc_id in (3, 6, 9))
    assert chunk_dedup.dedup_chunks(df.limit(0)).count() == 0


def test_chunks_survive_an_insertion():
    raw = random.Random(2).randbytes(40_000)
    other = raw[:20_000] + b"inserted" + raw[20_000:]
    pieces = [{x[a:b] for a, b in zip([0, *e], e)} for x in (raw, other) for e in [chunk_dedup.text_chunks(np.frombuffer(x, np.uint8))]]
    assert len(pieces[0] - pieces[1]) < 6


def test_licenses_within_lines(spark):
    texts = ["Copyright 2020 Foo Project. Released under the MIT License. See the file.", "# Foo is fast. Licensed under the\n# Apache License, Version 2.0. Foo is small.", "Permission to use,\n\ncopy, modify, and/or distribute"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = [*license_scan.TEMPLATES, ("whole", "Permission to use, copy, modify, and/or distribute")]
    got = [(m.license, t[m.first : m.end]) for r, t in zip(license_scan.scan_licenses(df, own).orderBy("doc_id").collect(), texts) for m in r.licenses]
    assert got == [("MIT", "Released under the MIT License"), ("Apache-2.0", "Licensed under the\n# Apache License, Version 2.0"), ("whole", texts[2])]


# --- addresses


@pytest.mark.parametrize(
    "url,host,path",
    [(None, "", ""), ("no scheme", "", ""), ("http://A.Example.COM", "a.example.com", ""), ("x://h?q=/a", "h", ""), ("http://É.com:80/A/b?c#d", "É.com:80", "/A/b"), ("http://a//b#", "a", "//b"), ("://h/p://x", "h", "/p://x"), ("http:///en/", "", "/en/")],
)
def test_address(spark, url, host, path):
    row = spark.createDataFrame([(url,)], "url string").select(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).first()
    assert tuple(row) == (host, path)


def brute_rule(host, path, rules):
    fits = [(len(r), r, v) for r, v in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def brute_tree(rows):
    """{(host, segments): (template, bad share)} from (host, path, bad or None) rows."""
    leaves = {}
    for host, path, bad in rows:
        parts = []
        for s in path.split("/"):
            if s:
                s = re.sub(r"(?i)(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}", "{x}", s)
                parts.append(re.sub(r"\d+", "{n}", s))
        n = leaves.setdefault((host, tuple(parts)), [0, 0, 0])
        n[0] += 1
        n[1] += bad is not None
        n[2] += bool(bad)
    name = {k: list(k[1]) for k in leaves}
    for d in range(max((len(k[1]) for k in leaves), default=0)):
        nodes = {}
        for k, n in leaves.items():
            if len(name[k]) > d:
                node = nodes.setdefault((k[0], tuple(name[k][:d])), {}).setdefault(name[k][d], [0, 0, 0])
                for j in range(3):
                    node[j] += n[j]
        new = {}
        for place, children in nodes.items():
            total = [sum(c[j] for c in children.values()) for j in range(3)]
            small = sum(c[0] < url_filter.FEW_EACH for c in children.values())
            for own, c in children.items():
                variable = small >= url_filter.MANY_CHILDREN and c[0] < url_filter.FEW_EACH
                pooled = (total[2] + 0.5) / (total[1] + 1)
                rest = [total[j] - c[j] for j in range(3)]
                error = math.sqrt(pooled * (1 - pooled) * (1 / (c[1] + 1) + 1 / (rest[1] + 1)))
                apart = abs((c[2] + pooled) / (c[1] + 1) - (rest[2] + pooled) / (rest[1] + 1))
                alike = len(children) > 1 and apart <= url_filter.Z * error
                new[place, own] = "*" if variable or alike else own
        for k in leaves:
            if len(name[k]) > d:
                name[k][d] = new[(k[0], tuple(name[k][:d])), name[k][d]]
    total = [sum(n[j] for n in leaves.values()) for j in range(3)]
    top = (total[2] + 1) / (total[1] + 2)
    hosts, templates = {}, {}
    for k, n in leaves.items():
        for table, key in ((hosts, k[0]), (templates, (k[0], tuple(name[k])))):
            x = table.setdefault(key, [0, 0])
            x[0] += n[1]
            x[1] += n[2]
    s = url_filter.STRENGTH
    out = {}
    for k in leaves:
        h, t = hosts[k[0]], templates[k[0], tuple(name[k])]
        share = (t[1] + s * (h[1] + s * top) / (h[0] + s)) / (t[0] + s)
        out[k[0], k[1]] = ("/" + "/".join(name[k]), share)
    return leaves, out


def test_filter_urls(spark):
    r = random.Random(9)
    rules = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/", "allow"), ("b.net/x", "block")]
    rows, labels = [], []
    for i in range(900):
        host = r.choice(["a.example.com", "A.example.com", "b.net", "www.b.net", "c.org", "notcom"])
        kind = r.choice(["en", "fr", "spam", "p"])
        rest = {"en": str(r.randint(1, 99)), "fr": f"{r.randint(1, 99)}.html", "spam": f"win/{r.randint(1, 9)}", "p": "".join(r.choice("abcdefgh") for _ in range(5))}[kind]
        rows.append((i, f"http://{host}/{kind}/{rest}?q=1" if r.random() < 0.95 else r.choice([None, "nothing", f"http://{host}/1/2/3/4/5/6/7/8/9", f"http://{host}"]), "x"))
        if r.random() < 0.5:
            labels.append((i, r.random() < (0.95 if kind == "spam" else 0.1)))
    rows += [rows[0], (None, "http://c.org/spam/win/1", "x")]
    labels += [(None, True), (5, None), (7, True), (7, False)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.filter_urls(df, spark.createDataFrame(labels, "page_id long, bad boolean"), rules).collect()
    marks = {}
    for i, bad in labels:
        if i is not None and bad is not None:
            marks[i] = max(marks.get(i, False), bad)
    parsed = []
    for i, url, _ in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        parsed.append((m[1].lower() if m else "", m[2] if m else "", marks.get(i)))
    _, tree = brute_tree(parsed)
    assert len(got) == len(rows) and any(g.verdict == "block" and g.rule is None for g in got)
    for g in got:
        rule, verdict = brute_rule(g.host, g.path, rules)
        parts = tuple(p for p in url_filter_segments(g.path))
        template, share = tree[g.host, parts]
        assert g.rule == rule and g.template == template and math.isclose(g.bad_share, share, abs_tol=1e-6)
        assert g.verdict == (verdict or ("block" if share > url_filter.REJECT else "allow"))
    assert url_filter.filter_urls(df.limit(0), spark.createDataFrame([], "page_id long, bad boolean"), rules).count() == 0


@pytest.mark.parametrize("heavy", [500, 1500, 5000])
def test_heavy_branch_among_many_small_ones(spark, heavy):
    names = ["".join(p) for p in itertools.product("ghijklmnop", repeat=3)]
    paths = [f"u/{name}" for name in names] + ["u/spam"] * heavy
    df = spark.createDataFrame([(i, f"http://h.com/{p}") for i, p in enumerate(paths)], "page_id long, url string")
    labels = df.select("page_id", F.col("url").endswith("/spam").alias("bad"))
    got = url_filter.filter_urls(df, labels, []).groupBy("template", "verdict").count().collect()
    assert sorted(map(tuple, got)) == [("/u/*", "allow", len(names)), ("/u/spam", "block", heavy)]


def test_deep_paths_differ_below_the_sixth_segment(spark):
    paths = [f"a/b/c/d/e/f/{kind}/{i}" for kind in ("ads", "docs") for i in range(60)] + ["z/" * 40]
    df = spark.createDataFrame([(i, f"http://h.com/{p}") for i, p in enumerate(paths)], "page_id long, url string")
    labels = df.where("page_id < 120").select("page_id", F.col("url").contains("/ads/").alias("bad"))
    got = url_filter.filter_urls(df, labels, []).orderBy("page_id").collect()
    assert {g.verdict for g in got[:60]} == {"block"} and {g.verdict for g in got[60:]} == {"allow"}
    assert {g.template.split("/")[7] for g in got[:60]} == {"ads"} and {g.template.split("/")[7] for g in got[60:120]} == {"docs"}
    assert got[120].template.count("/") == 40


def test_op4_on_the_given_pages(spark):
    """The whole query against brute force: its labels, its tree and its rules."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    marks = {r.page_id: r.bad for r in queries.url_labels(spark, SF).collect()}
    assert len(marks) == 250
    rows = [(r.page_id, r.url) for r in pages.select("page_id", "url").collect()]
    parsed = []
    for i, url in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        parsed.append((m[1].lower() if m else "", m[2] if m else "", marks[i]))
    _, tree = brute_tree(parsed)
    got = {r.page_id: r for r in queries.op4_url_filter(spark, SF).collect()}
    by_tree = 0
    for (i, _), (host, path, _) in zip(rows, parsed):
        rule, verdict = brute_rule(host, path, queries.URL_RULES)
        template, share = tree[host, tuple(url_filter_segments(path))]
        r = got[i]
        by_tree += rule is None and share > url_filter.REJECT
        assert (r.host, r.path, r.rule, r.template) == (host, path, rule, template) and math.isclose(r.bad_share, share, abs_tol=1e-6)
        assert r.verdict == (verdict or ("block" if share > url_filter.REJECT else "allow"))
    paths = {(h, tuple(url_filter_segments(p))) for h, p, _ in parsed}
    assert by_tree > 0 and len({(r.host, r.template) for r in got.values()}) < len(paths) / 2


def test_pages_label_the_paths_where_junk_stands(spark):
    """No word list: pages of labelled junk and of good text stand under different paths of one host, and one path holds pages of links."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    chain = toxicity.train(docs, labels, queries.toxicity_categories())
    kind = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "junk").otherwise("fine")
    pages = docs.join(labels, "doc_id").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h.com/"), kind, F.lit("/x/"), F.col("doc_id")).alias("url"), F.concat(F.lit("<p>"), F.regexp_replace("text", "[<>&]", " "), F.lit("</p>")).alias("html"))
    links = spark.createDataFrame([(10_000 + i, f"http://h.com/list/{i}", "<nav>x</nav>" + "<a href=/y>more of this and that</a>" * 20 + "text") for i in range(15)], "page_id long, url string, html string")
    pages = pages.union(links)
    got = url_filter.filter_urls(pages.select("page_id", "url"), url_filter.page_labels(pages, chain), []).groupBy(F.split("template", "/")[1].alias("kind"), "verdict").count().collect()
    verdicts = {k: {r.verdict for r in got if r.kind == k} for k in ("junk", "fine", "list")}
    assert verdicts == {"junk": {"block"}, "fine": {"allow"}, "list": {"block"}}
    shares = spark.createDataFrame([("<a>ab</a>cd",), ("<script>x</script>",), (None,), ("<A href=x>a <b>b</b></A>",)], "h string").select(F.round(url_filter.link_share(F.col("h")), 3).alias("s")).collect()
    assert [r.s for r in shares] == [0.5, 0.0, 0.0, 1.0]


def url_filter_segments(path):
    leaves, _ = brute_tree([("", path, None)])
    return next(iter(leaves))[1]


# --- languages


def test_languages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = lang_id.identify(pages, docs).collect()
    assert len(got) == 250 and sum(g.language == g.declared for g in got) / 250 > 0.97
    names, models = lang_id.fit_text_models(docs, sample=20)
    seen = lang_id.text_evidence(docs.select("doc_id", "lang", F.col("text").alias("html")), names, models)
    right = [names[int(np.argmax(r.text_nats))] == r.lang for r in seen.collect()]
    assert sum(right) / len(right) > 0.9


def test_languages_of_texts_that_were_not_seen(spark):
    """Fitted on a half of the documents; pages are made of the other half, declare nothing or something false, and stand on hosts of all languages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    half = F.pmod(F.xxhash64("text"), F.lit(2)) == 0  # copies fall into one half
    other = docs.where(~half & (F.length("text") > 200))
    declared = F.when(F.col("doc_id") % 3 == 0, F.lit('<html lang="de">')).otherwise(F.lit("<html>"))
    pages = other.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h"), F.col("doc_id") % 4, F.lit(".com/"), F.col("doc_id")).alias("url"), F.concat(declared, F.lit("<p>"), F.regexp_replace("text", "[<>&]", " "), F.lit("</p>")).alias("html"))
    want = {r.doc_id: r.lang for r in other.collect()}
    got = lang_id.identify(pages, docs.where(half)).collect()
    assert len(got) == len(want) and sum(r.language == want[r.page_id] for r in got) >= 0.97 * len(got) and len(set(want.values())) == 4


def test_language_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(1, None, None), (2, "http://a.de/", ""), (3, "x", "<html lang='de-AT'><p>Der und die</p>"), (3, "x", "<html lang='de-AT'><p>Der und die</p>"), (None, "http://b.fr:80/x", "<html lang=xx>" + "z" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = lang_id.identify(pages, docs).collect()
    assert len(out) == 5 and all(r.language for r in out) and {r.declared for r in out} == {"", "de", "xx"}
    assert lang_id.identify(pages.limit(0), docs).count() == 0
    assert {r.language for r in lang_id.identify(pages, docs.limit(0)).collect()} == {None}


def test_text_bytes_of_slices():
    data, offsets = text_bytes(pa.array(["a", "bc", None, "def"]).slice(1))
    assert data.tobytes() == b"bcdef" and offsets.tolist() == [0, 2, 2, 5]
