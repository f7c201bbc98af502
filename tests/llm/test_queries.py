"""The registered queries and the pipeline against brute force on a small table set."""

from __future__ import annotations

import base64
import zlib
from pathlib import Path

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken

import corpus_pipeline
from evidora.llm import byte_bpe, matroska, queries, toxicity
from evidora.llm.byte_bpe import ByteBPE

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


@pytest.fixture(scope="module")
def items():
    t = pq.read_table(f"{SF}/benchmark.parquet")
    return list(zip(t["item_id"].to_pylist(), t["text"].to_pylist()))


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).open("rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op2(spark, docs, reference_encoding):
    got = {r.doc_id: tuple(r) for r in queries.op2_byte_bpe(spark, SF).collect()}
    for d, text in docs:
        ids = reference_encoding.encode_ordinary(text or "")
        assert got[d] == (d, len(ids), brute.sha(",".join(map(str, ids))), brute.sha((text or "").encode()))


def test_decoding_by_itself(spark, docs):
    ranks = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
    df = spark.createDataFrame([*docs[:40], (None, None)], "doc_id long, decoded string").withColumnRenamed("decoded", "text")
    both = byte_bpe.decode_documents(byte_bpe.encode_documents(df, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    assert all(r.decoded == (r.text or "").encode() for r in both.collect())


def test_bpe_on_odd_texts(reference_encoding):
    import random

    r = random.Random(12)
    bpe = ByteBPE(Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes(), public_tokenizers.PATTERN)
    tokens = list(bpe.ranks)
    texts = ["", " ", "\n\n  \t x", "<|endoftext|>", "a" * 5000, " " * 3000 + "é", "\u0000�😀" * 50, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))]
    texts += [b"".join(r.choices(tokens, k=r.randint(1, 6))).decode("utf8", "ignore") for _ in range(5000)]
    for t in texts:
        ids = bpe.encode(t)
        assert ids.tolist() == reference_encoding.encode_ordinary(t) and bpe.decode(ids) == t.encode()


def test_op6(spark, docs):
    want = sorted((d, n, c, d == c) for (d, _), (n, c) in zip(docs, brute.near(docs, 3, 85)))
    assert sorted(map(tuple, queries.op6_near_dedup(spark, SF).collect())) == want


def test_op7(spark, docs):
    texts = [t for _, t in docs]
    told = [w[1] for w in brute.repeats(texts, queries.PASSAGE)]
    want = sorted((d, n, gone, spans, brute.sha(kept), n_told) for (d, _), (n, gone, spans, kept), n_told in zip(docs, brute.repeats(texts, 400), told))
    assert sorted(map(tuple, queries.op7_suffix_dedup(spark, SF).collect())) == want


def test_op8(spark, docs, items):
    want = sorted((d, n, hit, len(ids), brute.sha(",".join(ids)), hit > 0) for (d, _), (n, hit, ids) in zip(docs, brute.leaks([t for _, t in docs], items, 10)))
    assert sorted(map(tuple, queries.op8_decontaminate(spark, SF).collect())) == want


def test_op10(spark, docs):
    got = {r.doc_id: r for r in queries.op10_matroska(spark, SF).collect()}
    for d, text in docs:
        raw = (text or "").encode()
        payload = matroska.padded(raw)
        media = matroska.write(payload)
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.error) == (len(raw), len(payload), brute.sha(payload), zlib.crc32(payload[-32:]), len(media), brute.sha(media), None)


def test_other_queries_return_every_row(spark, docs):
    n_pages = pq.read_metadata(f"{SF}/pages.parquet").num_rows
    for name, n in (("op1_toxicity", len(docs)), ("op3_lang_id", n_pages), ("op4_url_filter", n_pages), ("op5_license_scan", len(docs)), ("op9_chunk_dedup", len(docs))):
        assert queries.queries()[name](spark, SF).count() == n
    text = dict(docs)
    found = {r.doc_id: r.licenses for r in queries.op5_license_scan(spark, SF).collect()}
    for d, t in text.items():
        assert ("MIT" in found[d].split(",")) == ("Released under the MIT License." in t.split("\n"))


def test_pipeline(spark, docs, items, reference_encoding):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    table = spark.read.parquet(f"{SF}/documents.parquet")
    chain = toxicity.train(table, labels, queries.toxicity_categories())
    left = [(r.doc_id, r.text) for r in toxicity.score(table, chain).collect() if not r.rejected]
    left = [(d, t) for (d, t), (n, c) in zip(left, brute.near(left, 5, 80)) if d == c]
    # cut repeats to whole characters, as the stage does
    cut = []
    for (d, t), (_, gone, _, kept) in zip(left, brute.repeats([t for _, t in left], corpus_pipeline.REPEAT_BYTES)):
        cut.append((d, kept.decode("utf8", "ignore") if gone else t))
    clean = {d: t for (d, t), (_, hit, _) in zip(cut, brute.leaks([t for _, t in cut], items, 10)) if not hit}
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(clean)
    ascii_rows = 0
    for r in got:
        assert r.round_trip and r.token_ids == reference_encoding.encode_ordinary(r.text) and r.n_tokens == len(r.token_ids)
        assert r.n_chars == len(r.text)
        if r.text.isascii():
            ascii_rows += 1
            assert r.text == clean[r.doc_id]
    assert ascii_rows > 20
    assert [c for c in got[0].asDict() if c not in ("token_ids", "n_tokens", "round_trip")] == table.columns


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [(1, "plain text of a few words here", "en", "s", 30, "x"), (1, "plain text of a few words here", "en", "s", 30, "x"), (2, None, None, None, None, None), (None, "", "fr", "s", 0, "y"), (None, "lonely words", "fr", "s", 12, "y"), (3, "é" * 1000 + " " + "é" * 1000, "de", "s", 2001, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for empty in (False, True):
        now = docs.where("false") if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
            assert name == "byte_bpe" or now.columns == docs.columns
        out = now.collect()
        assert empty == (not out)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert len([r for r in kept if r.doc_id == 1]) == 1 and len(kept) == 5
