"""Toxicity categories from a classifier chain.

Categories are predicted one after another by linear models.  A later model
gets the earlier categories' log-odds as features; while it is trained these are
out-of-fold predictions, so it sees them as good as they will be on new texts.

The chain is fitted on the driver from a bounded sample of labelled rows
(`sample` rows, those with the least hash of their id): features of a text are
the words that tell the sample's categories apart best by chi-square, and the
shape of the text.  All texts are then scored whole, in blocks, with a model of
fixed size.

Defined results: a null or empty text has no words and gets the score of its
shape; very long texts are read whole, in blocks, and count as one document; rows
of the labels with a null id or a null label are left out, of several labels for an
id the highest counts, and of several texts for an id the one with the least digest;
without any labelled row, or with one class only, a category has its smoothed
share as probability; words of equal chi-square are taken by their hash, and rows of
equal score stay on one side of a threshold; repeated rows get equal scores; a
column named as an output is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import ALNUM, blocks, text_bytes, words
from .tables import map_batches, settle

SAMPLE = 8000
WORDS = 256
FOLDS = 5
PENALTY = 1.0
_SHAPE = 6

_DIGIT, _UPPER, _SYMBOL = (np.zeros(256, bool) for _ in range(3))
_DIGIT[48:58] = _UPPER[65:91] = True
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def shapes(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Length, and shares of digits, upper case, symbols and repeated words, of each text."""
    size = np.diff(offsets)
    out = np.zeros((len(size), _SHAPE))
    out[:, 0] = np.log1p(size) / 10
    out[:, 1] = np.log1p(counts) / 10
    for k, kind in enumerate((_DIGIT, _UPPER, _SYMBOL)):
        total = np.append(0, np.cumsum(kind[data]))
        out[:, 2 + k] = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)
    ends = np.cumsum(counts)
    out[:, 5] = [1 - len(np.unique(hashes[e - n : e])) / n if n else 0.0 for e, n in zip(ends.tolist(), counts.tolist())]
    return out


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.weights + self.bias, -30, 30)


def fit_linear(x: np.ndarray, y: np.ndarray, start: Linear | None = None) -> Linear:
    """Ridge-penalised logistic regression by Newton steps; the optimum does not depend on the start."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    if not len(y) or y.min() == y.max():
        return Linear(np.zeros(x.shape[1]), float(np.log(share / (1 - share))))
    design = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(design.shape[1], PENALTY)
    ridge[-1] = 1e-6
    w = np.zeros(design.shape[1])
    w[-1] = np.log(share / (1 - share))
    if start is not None:
        w[:-1], w[-1] = start.weights, start.bias
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - ridge * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return Linear(w[:-1], float(w[-1]))


@dataclass
class Chain:
    """Models in order; each has the earlier ones' log-odds behind the text's features."""

    categories: list[str]
    vocabulary: np.ndarray
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        hashes, _, _, counts = words(data, offsets, ALNUM)
        x = np.zeros((len(counts), len(self.vocabulary) + _SHAPE))
        if len(self.vocabulary) and len(hashes):
            at = np.searchsorted(self.vocabulary, hashes)
            at[at == len(self.vocabulary)] = 0
            known = self.vocabulary[at] == hashes
            x[np.repeat(np.arange(len(counts)), counts)[known], at[known]] = 1
        x[:, len(self.vocabulary) :] = shapes(data, offsets, hashes, counts)
        return x

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for model in self.models:
            out = np.hstack([out, model.log_odds(np.hstack([x, out]))[:, None]])
        return out


def word_counts(sample: DataFrame, categories: list[str]) -> DataFrame:
    """(word, n, then a count for each category): in how many of the sample's texts a word is, and in how many of those that have the category."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            labels = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1).astype(np.int64)
            for a, b in blocks(offsets):
                hashes, _, _, counts = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
                owner = np.repeat(np.arange(a, b), counts)
                order = np.lexsort((owner, hashes))
                hashes, owner = hashes[order], owner[order]
                first = np.ones(len(hashes), bool)
                first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                word, at = np.unique(hashes[first], return_inverse=True)
                sums = [np.bincount(at, minlength=len(word))] + [np.bincount(at, weights=y[owner[first]], minlength=len(word)).astype(np.int64) for y in labels.T]
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), *map(pa.array, sums)], names=["word", "n", *categories])

    counted = map_batches(sample.select("text", *categories), run, ", ".join(f"`{c}` long" for c in ["word", "n", *categories]))
    return counted.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(f"`{c}`").alias(c) for c in categories])


def best_words(sample: DataFrame, categories: list[str]) -> np.ndarray:
    """The WORDS words with the highest chi-square for any category; equal ones in the order of their hash."""
    rows, *totals = sample.agg(F.count("*"), *[F.sum(f"`{c}`") for c in categories]).first()
    if not rows:
        return np.zeros(0, np.uint64)
    scores = []
    for c, total in zip(categories, totals):
        a, b = F.col(f"`{c}`").cast("double"), F.col("n") - F.col(f"`{c}`")
        d = rows - F.col("n") - total + a
        scores.append(F.coalesce(F.try_divide(rows * (a * d - b * (total - a)) ** 2, F.col("n") * F.lit(float(rows - total)) * total * (rows - F.col("n"))), F.lit(0.0)))
    found = word_counts(sample, categories).where("n >= 3").select("word", F.greatest(F.lit(0.0), *scores).alias("score")).where("score > 0")
    return np.sort(np.array([r["word"] for r in found.orderBy(F.desc("score"), "word").limit(WORDS).collect()], np.int64).view(np.uint64))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which out-of-fold predictions have the highest F1."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = 0  # equal scores stay together
    k = int(np.argmax(f1))
    after = p[order][k + 1] if k + 1 < len(y) else 0.0
    return float((p[order][k] + after) / 2)


def fit_chain(x: np.ndarray, labels: np.ndarray, categories: list[str], vocabulary: np.ndarray) -> Chain:
    """Fit the models in turn, each on out-of-fold predictions of those before it."""
    chain = Chain(categories, vocabulary)
    fold = np.arange(len(x)) % FOLDS  # rows come in the order of a hash
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        ahead = np.zeros(len(x))
        chain.models.append(fit_linear(x, y))
        for f in range(FOLDS):
            ahead[fold == f] = fit_linear(x[fold != f], y[fold != f], chain.models[-1]).log_odds(x[fold == f])
        chain.thresholds.append(best_threshold(1 / (1 + np.exp(-ahead)), y))
        x = np.hstack([x, ahead[:, None]])
    return chain


def sample_features(sample: DataFrame, empty: Chain) -> DataFrame:
    """(order, id, words, shape, then the labels): the features of the sample's texts as rows of fixed size."""
    names = [c for c in sample.columns if c != "text"]
    position = sample.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(position))
            rest = [batch.column(k) for k in range(batch.num_columns) if k != position]
            for a, b in blocks(offsets):
                x = empty.features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                bits = np.packbits(x[:, :-_SHAPE].astype(bool), axis=1)
                shape = np.ascontiguousarray(x[:, -_SHAPE:])
                made = [pa.array([r.tobytes() for r in bits], pa.binary()), pa.array([r.tobytes() for r in shape], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in rest), *made], names=[*names, "words", "shape"])

    fields = [f for f in sample.schema.fields if f.name != "text"]
    return map_batches(sample, run, T.StructType([*fields, T.StructField("words", T.BinaryType()), T.StructField("shape", T.BinaryType())]))


def train(df: DataFrame, labels: DataFrame, categories: dict[str, Column], *, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", sample: int = SAMPLE) -> Chain:
    """Fit a chain; categories are boolean columns over the labels, in the chain's order.

    What reaches the driver are WORDS words and, for each of at most `sample` documents,
    a row of a few hundred bytes; the texts stay with the executors.
    """
    names = list(categories)
    marked = labels.select(F.col(f"`{label_id}`").alias("id"), *[c.cast("int").alias(n) for n, c in categories.items()]).dropna()
    some = marked.groupBy("id").agg(*[F.max(n).alias(n) for n in names]).withColumn("order", F.xxhash64("id")).orderBy("order", "id").limit(sample)
    texts = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    found = texts.join(F.broadcast(some), "id")  # at most `sample` rows of numbers
    one = settle(found.groupBy("order", "id", *names).agg(F.min_by("text", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("text")))
    vocabulary = best_words(one, names)
    rows = sample_features(one, Chain(names, vocabulary)).toArrow().sort_by([("order", "ascending"), ("id", "ascending")])
    y = np.stack([rows[n].to_numpy() for n in names], axis=1) if rows.num_rows else np.zeros((0, len(names)))
    bits = np.frombuffer(b"".join(rows["words"].to_pylist()), np.uint8).reshape(rows.num_rows, -(-len(vocabulary) // 8))
    shape = np.frombuffer(b"".join(rows["shape"].to_pylist()), np.float64).reshape(rows.num_rows, _SHAPE)
    x = np.hstack([np.unpackbits(bits, axis=1, count=len(vocabulary)).astype(float), shape])
    return fit_chain(x, y, names, vocabulary)


def score(df: DataFrame, chain: Chain, *, text: str = "text", prefix: str = "p_", rejected: str = "rejected", reject: str | None = None, drop: bool = False) -> DataFrame:
    """Add each category's probability and whether the last one (or `reject`) reaches its threshold.

    With `drop`, rows that reach it go instead, and no column is added.
    """
    outs = [] if drop else [*(f"{prefix}{c}" for c in chain.categories), rejected]
    df = df.drop(*outs)
    names, position = df.columns, df.columns.index(text)
    last = chain.categories.index(reject or chain.categories[-1])
    shared = df.sparkSession.sparkContext.broadcast(chain)  # WORDS weights for each category

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(position))
            for a, b in blocks(offsets):
                odds = chain.log_odds(chain.features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                p = 1 / (1 + np.exp(-odds))
                bad = p[:, last] >= chain.thresholds[last]
                part = batch.slice(a, b - a)
                if drop:
                    yield part.filter(pa.array(~bad))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(np.round(c, 6)) for c in p.T), pa.array(bad)], names=[*names, *outs])

    extra = [T.StructField(n, T.DoubleType()) for n in outs[:-1]] + [T.StructField(n, T.BooleanType()) for n in outs[-1:]]
    return map_batches(df, run, T.StructType([*df.schema.fields, *extra]))
