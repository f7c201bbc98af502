"""Odd inputs that several operators share: clashing names, empty tables, very long texts, ties, and recall at the border."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from evidora.llm import byte_bpe, chunk_dedup, decontaminate, lang_id, license_scan, matroska, near_dedup, suffix_dedup, tables, toxicity, url_filter

from .test_dedup import rand_text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()


@pytest.fixture(scope="module")
def chain(spark):
    return toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})


def text_operators(ranks, chain):
    return {
        "toxicity": lambda df: toxicity.score(df, chain),
        "bpe": lambda df: byte_bpe.encode_documents(df, ranks, public_tokenizers.PATTERN, decoded="decoded"),
        "licenses": lambda df: license_scan.scan_licenses(df),
        "chunks": lambda df: chunk_dedup.dedup_chunks(df),
        "repeats": lambda df: suffix_dedup.remove_repeats(df),
        "media": lambda df: matroska.read_media(matroska.store_texts(df)),
        "leaks": lambda df: decontaminate.benchmark_matches(df, df.sparkSession.createDataFrame([(1, "one two three")], "item_id long, text string")),
    }


def test_clashing_names_and_empty_tables(spark, ranks, chain):
    """Columns of the outputs' and of working names come in; the result has each name once, and the others as they were."""
    names = ["p_toxic", "rejected", "token_ids", "decoded", "licenses", "n_chunks", "removed_spans", "kept_bytes", "row", "__row", "media", "payload", "feature", "n_words", "matches", "gram", "level", "order", "words"]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(["some words here", None, "", "some words here"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for name, run in text_operators(ranks, chain).items():
        out = run(df)
        assert len(set(out.columns)) == len(out.columns), name
        got = {r.doc_id: r for r in out.collect()}
        assert len(got) == 4, name
        made = {f.name for f in out.schema.fields if f.name not in df.columns or f.dataType != df.schema[f.name].dataType} | {"error"}
        for n in set(names) & set(out.columns) - made:
            assert n in ("feature", "media", "payload") or all(got[i][n] == f"{n}{i}" for i in got), (name, n)
        assert run(df.limit(0)).count() == 0, name


def test_very_long_texts(spark, ranks, chain):
    """One text of several megabytes goes through every operator whole."""
    r = random.Random(9)
    long = " ".join([rand_text(r, 150_000), "Released under the MIT License.", "one two three", rand_text(r, 150_000)])
    assert len(long) > 1_500_000
    df = spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")
    out = {name: run(df).where("doc_id = 1").first() for name, run in text_operators(ranks, chain).items()}
    raw = long.encode()
    assert bytes(out["bpe"].decoded) == raw and bytes(out["media"].payload).rstrip(b"\xff") == raw
    assert [m.license for m in out["licenses"].licenses] == ["MIT"] and out["leaks"].matches[0].word > 100_000
    assert out["chunks"].n_chunks > len(raw) // 400 and 0 <= out["toxicity"].p_toxic <= 1 and bytes(out["repeats"].kept_bytes) == raw
    near = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame([(1, long), (2, long[:-60]), (3, "x")], "doc_id long, text string")).collect()}
    assert near[2].component_id == 1 and not near[2].kept and near[3].kept


def test_odd_addresses(spark):
    rows = [(1, "http://h.com/" + "a/" * 4000, "x"), (2, None, "y"), (2, None, "y"), (3, "http://h.com/a/b", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, template string").withColumn("host", F.lit("own"))
    labels = spark.createDataFrame([(1, True), (1, False), (None, True)], "page_id long, bad boolean")
    out = url_filter.filter_urls(df, labels, [("h.com/a/", "allow"), ("com/a/", "block")]).collect()
    assert len(out) == 4 and all(r.rule == "h.com/a/" for r in out if r.host) and {r.path for r in out if not r.host} == {""}


def test_equal_scores_stay_together():
    p = np.array([0.9, 0.4, 0.4, 0.4, 0.1])
    y = np.array([1, 1, 0, 1, 0])
    t = toxicity.best_threshold(p, y)
    assert 0.1 < t <= 0.4  # the three equal ones are on one side


def test_ties_of_words_and_ids(spark):
    """Words of equal chi-square are taken by hash, and a document with two texts counts once."""
    rows = [(i, f"word{i % 2} same{i % 2} both", None) for i in range(40)] + [(0, "another text", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    chains = [toxicity.train(df.repartition(n), labels, {"toxic": F.col("toxic") == 1}) for n in (1, 3)]
    assert chains[0].vocabulary.tolist() == chains[1].vocabulary.tolist() and np.allclose(chains[0].models[0].weights, chains[1].models[0].weights)


def test_language_names_do_not_clash(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("language", F.lit("zz")).withColumn("clear", F.lit(1))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = lang_id.identify(pages, docs)
    assert out.columns == ["page_id", "language", "probability", "declared", "text_language", "host"] and out.where("language = 'zz'").count() == 0


def test_near_duplicates_at_the_border(spark):
    """Pairs of 85 to 87 % are all found; the miss probability of a pair at the threshold is below 1e-4."""
    r = random.Random(12)
    rows, pairs = [], 0
    for k in range(150):
        words = [f"w{k}x{r.randrange(10**9)}" for _ in range(200)]
        other = list(words)
        # each change in the middle takes three shingles of 198 on each side
        for at in r.sample(range(10, 190, 6), 5):
            other[at] = f"z{k}y{r.randrange(10**9)}"
        a, b = ({tuple(x[i : i + 3]) for i in range(198)} for x in (words, other))
        assert 85 <= 100 * len(a & b) / len(a | b) < 87
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        pairs += 1
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()
    found = sum(r.component_id == r.doc_id - 1 for r in got if r.doc_id % 2)
    assert found == pairs


def test_crowded_regions_and_groups(spark, monkeypatch):
    """One large group of near copies of one another, in regions and groups far above their limits, beside others."""
    monkeypatch.setattr(near_dedup, "REGION_ROWS", 16)
    monkeypatch.setattr(near_dedup, "GROUP_ROWS", 16)
    monkeypatch.setattr(near_dedup, "PIVOTS", 4)
    r = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(200):
        words = list(base)
        for at in r.sample(range(120), r.choice([0, 1, 1, 2, 3, 6])):
            words[at] = f"c{r.randrange(40)}"
        rows.append((k, " ".join(words)))
    from . import brute

    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85).collect()}
    assert got == {d: c for (d, _), (_, c) in zip(rows, brute.near(rows, 3, 85))}


def test_checkpoints_need_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        tables.shared_folder(Session())
