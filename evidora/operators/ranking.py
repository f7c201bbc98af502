"""Ranks, fusion, re-ranking, top-k and diversification (WIN-*, ORD-*, JOIN-01, JOIN-15, FLT-08, SCR-08)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.text import CORE, RERANK, Tokenizer, clamp, overlap_ratio
from ..sources.scratch import Scratch

#: (lexical, semantic) weights by query mode (fixed values).
MODE_WEIGHTS = {"precision": (1.35, 0.75), "context": (1.2, 0.9), "expansion": (1.05, 1.0)}


def rank_within(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """1-based rank in each group; `order` has to be a total order (WIN-01, ORD-01)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def top_within(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group (ORD-03, ORD-04); Spark keeps k rows a group before it shuffles."""
    return rank_within(df, group, order, rank).where(F.col(rank) <= k)


INDEX_TOKENS = 1 << 20
#: (document, question) entries that a task counts at once: a document's own number at least.
ENTRIES = 1 << 21
#: The order of each list that overlap_lists can keep: (column, direction), the first of equal rows last.
BEST = {"score": [("score", "descending"), ("doc_id", "ascending")], "shared": [("shared", "descending"), ("doc_id", "descending")]}


def _question_blocks(queries: DataFrame, tokenizer: Tokenizer) -> Iterator[tuple[list, np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(ids, sizes, token starts, tokens, questions) of blocks of at most INDEX_TOKENS tokens: an inverted index of stated questions.

    A block is what is held on the driver and sent to the tasks at once: a few MB.
    """
    held: list[tuple] = []
    n = 0

    def index() -> tuple:
        ids = [q for q, _ in held]
        sizes = np.array([len(t) for _, t in held], np.int64)
        tokens = pa.array([t for _, ts in held for t in ts], pa.string())
        coded = tokens.dictionary_encode() if len(tokens) else pa.array([], pa.string()).dictionary_encode()
        code, owner = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(held)), sizes)
        order = np.lexsort((owner, code))
        begins = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
        return ids, sizes, begins, coded.dictionary, owner[order]

    for row in queries.select("query_id", tokenizer.distinct(F.col("text")).alias("tokens")).toLocalIterator():
        if held and n + len(row["tokens"]) > INDEX_TOKENS:
            yield index()
            held, n = [], 0
        held.append((row["query_id"], row["tokens"]))
        n += len(row["tokens"])
    if held:
        yield index()


def overlap_lists(queries: DataFrame, docs: DataFrame, lists: dict[str, int], *, tokenizer: Tokenizer = RERANK) -> DataFrame:
    """(list, query_id, doc_id, shared, score, rank): for each list, the k documents that come first in its order (BEST) for each question.

    The questions are stated ones; blocks of them go to the tasks as an inverted index of bounded size.
    All tokens of a document are in one row, so counting needs no shuffle: tokens are cut by Spark, and a
    task counts its batch's by the index and keeps k rows a question and list.  Only those are dealt by question.
    """
    kind = queries.schema["query_id"].dataType
    own = docs.select("doc_id", tokenizer.distinct(F.col("text")).alias("tokens"))
    schema = T.StructType([T.StructField("list", T.StringType()), T.StructField("query_id", kind), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("shared", T.LongType()), T.StructField("score", T.DoubleType())])
    id_type = to_arrow_type(kind)
    out = None
    for ids, sizes, begins, vocabulary, owner in _question_blocks(queries, tokenizer):
        shared_index = docs.sparkSession.sparkContext.broadcast((ids, sizes, begins, vocabulary, owner))

        def run(batches: Iterator[pa.RecordBatch], shared_index=shared_index) -> Iterator[pa.RecordBatch]:
            ids, sizes, begins, vocabulary, owner = shared_index.value
            names = pa.array(ids, id_type)
            best: dict[str, pa.Table | None] = dict.fromkeys(lists)
            for batch in batches:
                tokens = batch.column(1)
                row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                found = pc.index_in(tokens.flatten(), value_set=vocabulary)
                known = found.is_valid().to_numpy(zero_copy_only=False)
                code, row = found.drop_null().to_numpy().astype(np.int64), row[known]
                many = begins[code + 1] - begins[code]
                # slices of whole documents with about ENTRIES (document, question) entries each
                per_row = np.cumsum(np.bincount(row, weights=many, minlength=batch.num_rows).astype(np.int64))
                edges = np.unique(np.searchsorted(per_row, np.arange(0, per_row[-1] if len(per_row) else 0, ENTRIES), side="left")) if len(per_row) else []
                edges = np.unique([0, *edges, batch.num_rows])
                token_at = np.searchsorted(row, edges)
                for a, b in zip(token_at[:-1].tolist(), token_at[1:].tolist()):
                    if a == b:
                        continue
                    codes, rows, n_each = code[a:b], row[a:b], many[a:b]
                    at = np.repeat(begins[codes] - (np.cumsum(n_each) - n_each), n_each) + np.arange(n_each.sum())
                    pairs, n = np.unique(np.repeat(rows, n_each) * len(ids) + owner[at], return_counts=True)
                    doc, query = pairs // len(ids), pairs % len(ids)
                    score = np.floor(n / sizes[query] * 1e6 + 0.5) / 1e6
                    table = pa.table({"query": query, "doc_id": batch.column(0).take(pa.array(doc)), "shared": n.astype(np.int64), "score": score})
                    for name, k in lists.items():
                        both = table if best[name] is None else pa.concat_tables([best[name], table])
                        both = both.sort_by([("query", "ascending"), *BEST[name]])
                        q = both["query"].to_numpy()
                        place = np.arange(len(q)) - np.searchsorted(q, q)
                        best[name] = both.filter(pa.array(place < k))
            for name, table in best.items():
                if table is not None and table.num_rows:
                    yield from table.select(["doc_id", "shared", "score"]).add_column(0, "query_id", names.take(table["query"].combine_chunks())).add_column(0, "list", pa.array([name] * table.num_rows)).to_batches()

        kept = own.mapInArrow(run, schema)
        out = kept if out is None else out.union(kept)
    if out is None:
        out = own.sparkSession.createDataFrame([], schema)
    ranked = []
    for name, k in lists.items():
        order = [(F.desc if way == "descending" else F.asc)(column) for column, way in BEST[name]]
        ranked.append(top_within(out.where(F.col("list") == name), ["list", "query_id"], order, k))
    rows = ranked[0]
    for more in ranked[1:]:
        rows = rows.union(more)
    return rows


def overlap_top(queries: DataFrame, docs: DataFrame, k: int, *, tokenizer: Tokenizer = RERANK) -> DataFrame:
    """(query_id, doc_id, shared, score, rank): the k documents that share most of each question's tokens (WIN-01, ORD-04)."""
    return overlap_lists(queries, docs, {"score": k}, tokenizer=tokenizer).drop("list")


QUERY_BLOCK = 4096
#: Products that a task holds at once: 16 MB.
PRODUCTS = 1 << 21


def vector_top_k(queries: DataFrame, store: DataFrame, k: int, *, where: Column | None = None, cap: int = 80) -> DataFrame:
    """(query_id, id, score, rank) of the k nearest vectors of each query by dot product (JOIN-15, SRC-12).

    queries: (query_id, vector); store: (id, vector, ...).  k is held in 1..cap.
    A payload filter reaches the scan.  The stated queries go to the tasks in blocks
    of QUERY_BLOCK vectors; a task multiplies its batch with the block and keeps k rows a query before
    anything is shuffled.  Vectors of another length than the query's score as if the shorter one ended with zeros.
    """
    k = max(1, min(cap, k))
    rows = (store if where is None else store.where(where)).select("id", F.col("vector").cast("array<double>").alias("v"))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", store.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("v"))
    id_type = to_arrow_type(queries.schema["query_id"].dataType)
    out = None

    def dense(column: pa.Array, width: int) -> np.ndarray:
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.fill_null(column.flatten(), 0.0).to_numpy(zero_copy_only=False)
        made = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
        made[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        return made

    def kept(block: list[tuple]) -> DataFrame:
        width = max((len(v or ()) for _, v in block), default=0)
        shared = store.sparkSession.sparkContext.broadcast(([q for q, _ in block], dense(pa.array([v for _, v in block], pa.list_(pa.float64())), width)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked = shared.value
            best = None
            for batch in batches:
                step = max(1, PRODUCTS // max(1, len(asked)))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    product = asked @ dense(part.column(1), asked.shape[1])[:, : asked.shape[1]].T
                    # all that come near a query's k-th best product of this part are rounded, so that ties are decided by id
                    if product.shape[1] > k:
                        least = np.partition(product, product.shape[1] - k, axis=1)[:, product.shape[1] - k]
                        query, row = np.nonzero(product >= least[:, None] - 1.1e-6)
                    else:
                        query, row = np.nonzero(np.ones(product.shape, bool))
                    value = product[query, row]
                    table = pa.table({"query": query, "id": part.column(0).take(pa.array(row)), "score": np.sign(value) * np.floor(np.abs(value) * 1e6 + 0.5) / 1e6})
                    table = (table if best is None else pa.concat_tables([best, table])).sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
                    q = table["query"].to_numpy()
                    best = table.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))
            if best is not None and best.num_rows:
                yield from best.select(["id", "score"]).add_column(0, "query_id", pa.array(ids, id_type).take(best["query"].combine_chunks())).to_batches()

        return rows.mapInArrow(run, schema)

    block: list[tuple] = []
    for row in asked.toLocalIterator():
        block.append((row["query_id"], row["v"]))
        if len(block) == QUERY_BLOCK:
            out, block = (kept(block) if out is None else out.union(kept(block))), []
    if block or out is None:
        out = kept(block) if out is None else out.union(kept(block))
    return top_within(out, ["query_id"], [F.desc("score"), F.asc("id")], k)


def payload_filter(court: str | None = None, date_from: str | None = None, date_to: str | None = None) -> Column:
    """Court equality and an inclusive date range, either end open (FLT-08)."""
    out = F.lit(True)
    if court and court != "ANY":
        out = out & (F.col("court") == court)
    if date_from:
        out = out & (F.col("decision_date") >= F.lit(date_from).cast("date"))
    if date_to:
        out = out & (F.col("decision_date") <= F.lit(date_to).cast("date"))
    return out


def fuse_ranks(lexical: DataFrame, semantic: DataFrame, *, group: str = "query_id", key: str = "doc_id", mode: str = "context", k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (JOIN-01, WIN-02).

    Inputs have (group, key, rank); a key that a list has several times counts with its least rank.
    """
    w_lex, w_sem = MODE_WEIGHTS[mode]
    one = lambda df, name: df.groupBy(group, key).agg(F.min("rank").alias(name))
    both = one(lexical, "lexical_rank").join(one(semantic, "semantic_rank"), [group, key], "full_outer")
    part = lambda rank, w: F.coalesce(F.lit(w) / (F.lit(k) + F.col(rank)), F.lit(0.0))
    both = both.withColumn("lexical_score", F.round(part("lexical_rank", w_lex), 8)).withColumn("semantic_score", F.round(part("semantic_rank", w_sem), 8))
    return both.withColumn("fusion_score", F.round(part("lexical_rank", w_lex) + part("semantic_rank", w_sem), 8))


def fusion_order(key: str = "doc_id") -> list[Column]:
    return [F.desc("fusion_score"), F.coalesce("lexical_rank", F.lit(2**31 - 1)).asc(), F.col(key).asc()]


def dominance_quota(fused: DataFrame, limit: int, *, group: str = "query_id", key: str = "doc_id", cap: float = 0.82) -> DataFrame:
    """The first `limit` rows of each group, no source having more than its share of them (WIN-03).

    Rows over their source's quota are skipped; if rows are missing then, the
    best skipped ones come after the others.  Quotas count each source by itself, so
    a rank in the source and one in the list say all.
    """
    source = F.when(F.col("semantic_score") > F.col("lexical_score"), F.lit("semantic")).otherwise(F.lit("lexical"))
    everything = Window.partitionBy(group)
    rows = rank_within(fused.withColumn("dominant", source), [group, "dominant"], fusion_order(key), "source_rank")
    rows = rank_within(rows, [group], fusion_order(key), "fused_rank")
    target = F.greatest(F.lit(1), F.least(F.lit(limit), F.count("*").over(everything)))
    rows = rows.withColumn("target", target).withColumn("fits", F.col("source_rank") <= F.greatest(F.lit(1), F.floor(F.col("target") * cap)))
    rows = rank_within(rows, [group], [F.desc("fits"), F.asc("fused_rank")], "position")
    return rows.where(F.col("position") <= F.col("target")).drop("source_rank", "target", "fits")


def rerank_head(df: DataFrame, query: Column, text: Column, top_n: int, *, group: str = "query_id", rank: str = "rank", key: str = "doc_id") -> DataFrame:
    """Re-rank the first top_n rows of each group by lexical overlap; the rest keeps its place (ORD-02, SCR-08, SCR-09)."""
    a, b = RERANK.distinct(query), RERANK.distinct(text)
    scored = df.withColumn("rerank_score", F.round(clamp(overlap_ratio(a, b)), 6))
    in_head = F.col(rank) <= top_n
    order = [F.when(in_head, F.lit(0)).otherwise(1).asc(), F.when(in_head, -F.col("rerank_score")).asc(), F.col(rank).asc(), F.col(key).asc()]
    return rank_within(scored, [group], order, "new_rank")


def prefer_court(df: DataFrame, *, group: str = "query_id", court: str = "court", score: str = "score", first: str = "SC", second: str = "HC", boost: float = 0.025, key: str = "doc_id") -> DataFrame:
    """Where a group has both courts, rows of the first get a little more, at most 1 (WIN-05)."""
    w = Window.partitionBy(group)
    both = F.bool_or(F.col(court) == first).over(w) & F.bool_or(F.col(court) == second).over(w)
    boosted = F.when(both & (F.col(court) == first), F.least(F.lit(1.0), F.col(score) + boost)).otherwise(F.col(score))
    return rank_within(df.withColumn("preferred_score", F.round(boosted, 6)), [group], [F.desc("preferred_score"), F.desc(score), F.asc(key)], "new_rank")


def core_key(text: Column) -> Column:
    """The first distinct long words of a text, as an identity key; null if they are few (TOK-08)."""
    words = F.slice(F.array_distinct(F.slice(CORE.all(text), 1, 28)), 1, 14)
    key = F.array_join(words, " ")
    return F.when(F.length(key) >= 30, F.concat(F.lit("core:"), key))


# Marks of a judgment's title and detail text by which repeats are known (fixed values).
DAY_OF_JUDGMENT = r"(?i)(?:^|[^a-z0-9_])on\s+(\d{1,2}\s+[a-z]{3,9},?\s+\d{4})(?:[^a-z0-9_]|$)"
CITATION_LINE = r"(?im)^Equivalent citations:\s*(.+)$"
CITATION_AGAIN = r"(?i)^(?:equivalent citations:\s*)+"
BODY_OF_DETAIL = r"(?is)Body:\s*(.+)"
DOCUMENT_NUMBER = r"(?i)/(?:doc|docfragment)/(\d+)/?"


def plain_words(text: Column) -> Column:
    """Lower-case words without the day of judgment, `vs` as v."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(^|[^a-z0-9_])on\s+\d{1,2}\s+[a-z]{3,9},?\s+\d{4}(?=[^a-z0-9_]|$)", "$1 ")
    low = F.regexp_replace(low, r"(^|[^a-z0-9_])vs\.?(?=[^a-z0-9_]|$)", "$1 v ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9\s]", " "), r"\s+", " "))


def judgment_day(title: Column) -> Column:
    """The day that a title names, or `unknown`."""
    found = F.lower(F.regexp_extract(F.coalesce(title, F.lit("")), DAY_OF_JUDGMENT, 1))
    return F.when(found != "", found).otherwise("unknown")


def identity_keys(title: Column, snippet: Column, court: Column, *, detail: Column | None = None, urls: tuple[Column, ...] = (), semantic: Column | None = None) -> Column:
    """Keys of which two rows share one if they are the same judgment: by citation, meaning, document number, content and core words (WIN-04).

    A key is left out where too little is known for it; equal keys come once.
    """
    detail = F.lit(None).cast("string") if detail is None else detail
    day = judgment_day(title)
    cited = F.regexp_replace(F.trim(F.regexp_extract(F.coalesce(detail, F.lit("")), CITATION_LINE, 1)), CITATION_AGAIN, "")
    cited = F.replace(plain_words(cited), F.lit(" "), F.lit(""))
    body = F.regexp_extract(F.coalesce(detail, F.lit("")), BODY_OF_DETAIL, 1)
    body = F.left(plain_words(F.left(F.when(body != "", body).otherwise(F.coalesce(detail, F.lit(""))), F.lit(1000))), F.lit(280))
    seed = F.when(F.length(body) >= 80, body).otherwise(F.left(plain_words(snippet), F.lit(220)))
    core = CORE.all(plain_words(F.concat_ws(" ", snippet, detail)))
    core = F.array_join(F.slice(F.array_distinct(F.slice(core, 1, 28)), 1, 14), " ")
    numbers = [F.nullif(F.regexp_extract(F.coalesce(u, F.lit("")), DOCUMENT_NUMBER, 1), F.lit("")) for u in urls]
    keys = [
        F.when(F.length(cited) >= 8, F.concat(F.lit("eq:"), F.left(cited, F.lit(180)))),
        *([F.concat(F.lit("sem:"), semantic)] if semantic is not None else []),
        *[F.concat(F.lit("doc:"), n) for n in numbers],
        F.when(F.length(seed) >= 60, F.concat_ws(":", F.lit("content"), court, day, seed)),
        F.when(F.length(core) >= 30, F.concat_ws(":", F.lit("core"), court, day, core)),
    ]
    return F.array_distinct(F.filter(F.array(*keys), lambda k: k.isNotNull()))


def repeat_print(title: Column, snippet: Column) -> Column:
    """The fingerprint of a row's title and snippet."""
    return F.left(F.concat_ws(" ", plain_words(title), F.left(plain_words(snippet), F.lit(220))), F.lit(280))


def _claims(keys: Column, fingerprint: Column, court_day: Column, prints: int, days: int) -> Column:
    """What a row takes up if it is kept: (kind and value, how many rows may have it); unknown values take up nothing."""
    own = F.transform(F.array_distinct(F.coalesce(keys, F.array().cast("array<string>"))), lambda k: F.struct(F.concat(F.lit("k"), k).alias("claim"), F.lit(1).alias("room")))
    more = F.array(F.struct(F.concat(F.lit("f"), fingerprint).alias("claim"), F.lit(prints).alias("room")), F.struct(F.concat(F.lit("d"), court_day).alias("claim"), F.lit(days).alias("room")))
    return F.filter(F.concat(own, more), lambda c: c["claim"].isNotNull())


def diversify(df: DataFrame, *, group: str = "query_id", rank: str = "rank", keys: str = "keys", fingerprint: str = "fingerprint", court_day: str = "court_day", max_per_fingerprint: int = 1, max_per_court_day: int = 2, pool: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Greedy diversification in rank order (WIN-04): the rows kept, with all their columns.

    A row goes if one of its identity keys was seen among kept rows before it, or its fingerprint or its court and day (if known) is full of such.

    The choice is made in rounds over what rows claim (a key, a fingerprint, a court and day).  In each round the rows before a row with the same claim are
    counted: if those kept fill it, the row goes; if those kept and those still open leave room in all its claims, the row is kept, whatever comes of
    the open ones.  Each round decides at least the first open row of each group, and in practice nearly all; no group has to be in one row or one
    task.  `pool` looks at the first rows of each group only; such short lists are folded in order instead, within one row.  Ranks are distinct in a group.
    """
    w = Window.partitionBy(group).orderBy(rank)
    pooled = df.withColumn("_place", F.row_number().over(w))
    if pool is not None:
        return _folded(pooled.where(F.col("_place") <= pool), group, keys, fingerprint, court_day, max_per_fingerprint, max_per_court_day)
    scratch = scratch or Scratch(df.sparkSession, "diversify")
    pooled = scratch.store(pooled, "pool")
    claims = _claims(F.col(keys), F.col(fingerprint), F.col(court_day), max_per_fingerprint, max_per_court_day)
    claimed = scratch.store(pooled.select(group, "_place", F.explode(claims).alias("c")).select(group, "_place", "c.claim", "c.room"), "claims")
    free = pooled.select(group, "_place").join(claimed.select(group, "_place").distinct(), [group, "_place"], "left_anti")
    now = claimed.withColumn("kept", F.lit(False))
    while True:
        before = Window.partitionBy(group, "claim").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        n = lambda test: F.coalesce(F.sum(test.cast("int")).over(before), F.lit(0))
        counted = now.withColumn("had", n(F.col("kept"))).withColumn("open", n(~F.col("kept")))
        full, fits = F.bool_or(F.col("had") >= F.col("room")), F.bool_and(F.col("had") + F.col("open") < F.col("room"))
        judged = counted.groupBy(group, "_place").agg(F.bool_or("kept").alias("was"), full.alias("full"), fits.alias("fits"))
        judged = scratch.store(judged.where("was or not full").select(group, "_place", (F.col("was") | F.col("fits")).alias("kept")), "judged")
        if judged.where("not kept").isEmpty():
            break
        now = claimed.join(judged, [group, "_place"])
    return pooled.join(judged.select(group, "_place").union(free), [group, "_place"]).drop("_place")


def _folded(pooled: DataFrame, group: str, keys: str, fingerprint: str, court_day: str, max_per_fingerprint: int, max_per_court_day: int) -> DataFrame:
    """The same for short lists, each within one row."""
    row = F.struct("_place", F.col(keys).alias("k"), F.col(fingerprint).alias("f"), F.col(court_day).alias("c"))
    lists = pooled.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    none = F.array().cast("array<string>")
    zero = F.struct(none.alias("seen"), none.alias("prints"), none.alias("days"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        held = F.filter(x["k"], lambda v: v.isNotNull())
        full = lambda have, v, most: F.size(F.filter(have, lambda y: y == v)) >= most
        skip = F.arrays_overlap(acc["seen"], held) | full(acc["prints"], x["f"], max_per_fingerprint) | F.coalesce(full(acc["days"], x["c"], max_per_court_day), F.lit(False))
        new = F.struct(F.array_union(acc["seen"], held).alias("seen"), F.array_append(acc["prints"], x["f"]).alias("prints"), F.array_append(acc["days"], x["c"]).alias("days"), F.array_append(acc["kept"], x["_place"]).alias("kept"))
        return F.when(F.coalesce(skip, F.lit(False)), acc).otherwise(new)

    kept = lists.select(group, F.explode(F.aggregate("_rows", zero, step, lambda acc: acc["kept"])).alias("_place"))
    return pooled.join(kept, [group, "_place"]).drop("_place")
