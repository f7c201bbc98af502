"""A stored inverted index for token overlap, with bounds that let most blocks be skipped (SRC-01, WIN-01, ORD-04).

Documents are put in the order of two min-hashes of their tokens, so that documents with like words lie together, and cut into
blocks of `BLOCK`.  A posting is (token, block) with the documents of the block that have the token; postings lie in files by ranges of
(token, block), so a token's postings are together and a frequent token's are spread over several files.  With each posting stands the block's
maximum: the most tokens that any of these documents has.

A search has four steps, all of them joins and aggregations:

1. the rarest tokens of each question (all but the most frequent third) meet the postings' keys, without the documents: in a block, no document can
   share more than the tokens found there and those left out, nor more than the block's maximum;
2. the few blocks with the highest bounds are read, and give each question's k-th best count so far;
3. blocks whose bound is below that count are skipped, and the others read; where the count is so low that a document without any rare token
   could reach it, the left-out tokens but that many are added first;
4. the k best documents of all that was read are the k best of all.

The result equals that of counting every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import RERANK, Tokenizer
from .scratch import Scratch

BLOCK = 32
#: Blocks a question reads before anything is known: enough for k documents, and this many more.
PROBED = 8


class OverlapIndex:
    """postings: (token, block, docs, n, longest); terms: (token, n_docs, n_blocks)."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: Tokenizer = RERANK) -> None:
        self.spark, self.path, self.tokenizer = spark, path, tokenizer
        self.postings, self.terms = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")

    @classmethod
    def build(cls, docs: DataFrame, path: str, *, tokenizer: Tokenizer = RERANK, block: int = BLOCK) -> OverlapIndex:
        """Index all documents (doc_id, text) under `path`; those without tokens are in no posting.

        A doc_id is that of one document.  A block has at most `block` documents, so a posting's list is short whatever the token.
        """
        own = docs.select("doc_id", tokenizer.distinct(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
        near = [F.array_min(F.transform("tokens", lambda t: F.xxhash64(t))).alias("a"), F.array_min(F.transform("tokens", lambda t: F.xxhash64(F.concat(t, F.lit("."))))).alias("b")]
        rows = own.select("doc_id", "tokens", *near).repartitionByRange("a", "b", "doc_id").sortWithinPartitions("a", "b", "doc_id")
        rows = rows.select("doc_id", "tokens", F.floor(F.monotonically_increasing_id() / block).alias("block"))
        rows.write.mode("overwrite").parquet(f"{path}/documents")
        spark = docs.sparkSession
        each = spark.read.parquet(f"{path}/documents").select("block", "doc_id", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
        grouped = each.repartitionByRange("token", "block").groupBy("token", "block").agg(F.sort_array(F.collect_list("doc_id")).alias("docs"), F.count("*").alias("n"), F.max("size").alias("longest"))
        grouped.sortWithinPartitions("token", "block").write.mode("overwrite").parquet(f"{path}/postings")
        written = spark.read.parquet(f"{path}/postings")
        written.groupBy("token").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_blocks")).write.mode("overwrite").parquet(f"{path}/terms")
        return cls(spark, path, tokenizer)

    # ---- the steps of a search

    def _bounds(self, tokens: DataFrame) -> DataFrame:
        """(query_id, block, bound) from tokens (query_id, token, place, known, omitted)."""
        rare = tokens.where(F.col("place") <= F.col("known") - F.col("omitted"))
        met = rare.join(self.postings.select("token", "block", "longest"), "token")
        return met.groupBy("query_id", "block").agg(F.least(F.count("*") + F.first("omitted"), F.max("longest").cast("long")).alias("bound"))

    def _counted(self, blocks: DataFrame, tokens: DataFrame) -> DataFrame:
        """(query_id, doc_id, shared) of the documents of (query_id, block), on all tokens.

        A block's lists are shuffled as they are and counted where they meet; a question's tokens and BLOCK bound what meets there.
        """
        met = blocks.join(tokens.select("query_id", "token"), "query_id").join(self.postings.select("token", "block", "docs"), ["token", "block"])
        lists = met.groupBy("query_id", "block").agg(F.flatten(F.collect_list("docs")).alias("docs"))
        return lists.select("query_id", "block", F.explode("docs").alias("doc_id")).groupBy("query_id", "block", "doc_id").agg(F.count("*").alias("shared"))

    def search(self, queries: DataFrame, k: int, *, scratch: Scratch | None = None, told: bool = True) -> tuple[DataFrame, DataFrame | None]:
        """(the k best, what was read, if that is to be told): rows (query_id, doc_id, shared, score, rank) and (query_id, postings, read, blocks, blocks_read).

        `queries` has query_id and either text or tokens (distinct ones).  The order is that of overlap_top: score, then doc_id.  A question without tokens, or
        with none that the index knows, has no rows; an empty index or no questions give none. 
        """
        scratch = scratch or Scratch(self.spark, "overlap")
        own = F.array_distinct("tokens") if "tokens" in queries.columns else self.tokenizer.distinct(F.col("text"))
        asked = queries.select("query_id", own.alias("tokens")).select("query_id", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
        known = asked.join(self.terms, "token")
        by_rarity = Window.partitionBy("query_id").orderBy("n_docs", "token")
        tokens = known.select("query_id", "size", "token", "n_docs", "n_blocks", F.row_number().over(by_rarity).alias("place"), F.count("*").over(Window.partitionBy("query_id")).cast("int").alias("known"))
        tokens = scratch.store(tokens.withColumn("omitted", F.floor(F.col("known") / 3).cast("int")), "tokens")
        bounds = scratch.store(self._bounds(tokens), "bounds")
        most = -(-k // BLOCK) + PROBED
        best_first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        probed = scratch.store(bounds.withColumn("at", F.row_number().over(best_first)).where(F.col("at") <= most).select("query_id", "block"), "probed")
        first = scratch.store(self._counted(probed, tokens), "first")
        kth = first.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("shared"), "doc_id"))).where(F.col("at") == k).select("query_id", F.col("shared").alias("least"))
        limits = tokens.select("query_id", "omitted").distinct().join(kth, "query_id", "left").select("query_id", "omitted", F.coalesce("least", F.lit(1)).alias("least"))
        enough, low = limits.where("least > omitted").select("query_id", "least"), limits.where("least <= omitted").select("query_id", "least")
        again = tokens.drop("omitted").join(low, "query_id").withColumn("omitted", (F.col("least") - 1).cast("int"))
        left = bounds.join(enough, "query_id").union(self._bounds(again).join(low, "query_id")).where("bound >= least").select("query_id", "block")
        counted = first.union(self._counted(left.join(probed, ["query_id", "block"], "left_anti"), tokens))
        counted = scratch.store(counted, "counted") if told else counted
        sizes = tokens.select("query_id", "size").distinct()
        scored = counted.join(sizes, "query_id").select("query_id", "doc_id", "shared", F.round(F.col("shared") / F.col("size"), 6).alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
        top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if not told:
            return top, None
        totals = tokens.groupBy("query_id").agg(F.sum("n_docs").alias("postings"))
        read = counted.groupBy("query_id").agg(F.sum("shared").alias("read"), F.count_distinct("block").alias("blocks_read"))
        blocks = self.postings.agg(F.count_distinct("block").alias("blocks")).first()["blocks"]
        out = totals.join(read, "query_id", "left").withColumn("blocks", F.lit(blocks))
        return top, out.select("query_id", "postings", F.coalesce("read", F.lit(0)).alias("read"), "blocks", F.coalesce("blocks_read", F.lit(0)).alias("blocks_read"))

    def top(self, queries: DataFrame, k: int, *, scratch: Scratch | None = None) -> DataFrame:
        return self.search(queries, k, scratch=scratch, told=False)[0]


def index_path(spark: SparkSession, name: str = "index") -> str:
    """A new place for an index in the shared folder."""
    return Scratch(spark, name).folder
