"""Tables kept on storage: vectors, caches, fixtures, reports, back-fills (SRC-02, SRC-10..14, SRC-16, SRC-17, SRC-21, SRC-22)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import chunk_documents, embed, first_wins, normalise_documents
from ..operators.ranking import vector_top_k

FIXTURE = "id string, query string, expected struct<polarity: string, requiredHooks: array<string>>"


class StaleVersion(RuntimeError):
    """Another commit came after the version that was read."""


class VectorStore:
    """Vectors with payload as a log of batches; a row's latest batch holds it (SRC-11, SRC-12).

    An upsert writes the batch only.  Reading takes the latest row of each id; when there are more than `COMPACT` batches they are written
    into one.  A batch becomes visible by a file of its number, whose creation fails if another writer made that number first; then the next number
    is tried, or the commit is refused if it named the version it had read.

    A compacted batch names the batches that it stands for, and hides those only: what other writers committed while it was written stays, and
    is newer than it.  So no commit is lost, however writers meet.
    """

    COMPACT = 16

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._at(folder))) if self._files.exists(self._at(folder)) else []

    def _log(self) -> list[tuple[int, str]]:
        """(number, folder) of the batches that hold rows, oldest first; a compacted one has the number of the last batch that it stands for."""
        entries = [(int(n.split(".")[0]), n.split(".")[1]) for n in self._names("_log")]
        numbers, hidden, stands = {folder: n for n, folder in entries}, set(), {}
        for number, folder in entries:
            covers = self._names(f"_covers/{folder}")
            hidden.update(covers)
            # those it stands for were in the log before, so their own places are known by now
            stands[folder] = max((stands[c] for c in covers if c in stands), default=number)
        return sorted((stands[folder], folder) for folder in numbers if folder not in hidden)

    def version(self) -> int:
        """The number of the last commit that can be read, -1 before the first.

        A writer that died between taking a number and publishing it leaves a gap; commits that name a version are refused there until one that names
        none goes past it.
        """
        done = self._names("_log")
        return int(done[-1].split(".")[0]) if done else -1

    def _commit(self, folder: str, read_version: int | None = None) -> int:
        number = (self.version() if read_version is None else read_version) + 1
        # a number is taken by creating its file, which only one writer can
        while not self._files.createNewFile(self._at(f"_numbers/{number:09d}")):
            if read_version is not None:
                raise StaleVersion(f"version {read_version} was read, and {self.version()} is the last one")
            number += 1
        self._files.create(self._at(f"_log/{number:09d}.{folder}")).close()
        return number

    def current(self) -> str | None:
        log = self._log()
        return log[-1][1] if log else None

    def read(self) -> DataFrame | None:
        return self._rows(self._log())

    def _rows(self, log: list[tuple[int, str]]) -> DataFrame | None:
        if not log:
            return None
        parts = [self.spark.read.parquet(f"{self.path}/{folder}").withColumn("_number", F.lit(n)) for n, folder in log]
        if len(parts) == 1:
            return parts[0].drop("_number")
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return first_wins(rows, ["id"], [F.desc("_number")]).drop("_number")

    def upsert(self, records: DataFrame, *, order: Column | None = None, read_version: int | None = None) -> int:
        """Rows replace those of the same id; the version committed.

        Of several new rows of one id the last by `order` is taken, without one the greatest.  With `read_version`, the commit is refused
        (StaleVersion) if any other came after that version; the rows written for it are removed.
        """
        folder = uuid.uuid4().hex
        others = F.struct(*[F.col(f"`{c}`") for c in records.columns if c != "id"])
        row = F.max(others) if order is None else F.max_by(others, F.struct(order.alias("by"), others.alias("row")))
        records.groupBy("id").agg(row.alias("_row")).select("id", "_row.*").select(records.columns).write.parquet(f"{self.path}/{folder}")
        try:
            number = self._commit(folder, read_version)
        except StaleVersion:
            self._files.delete(self._at(folder), True)
            raise
        if len(self._log()) > self.COMPACT:
            self.compact()
        return number

    def compact(self) -> None:
        """Write all batches there are into one that stands for them."""
        log, folder = self._log(), uuid.uuid4().hex
        if len(log) < 2:
            return
        self._rows(log).write.parquet(f"{self.path}/{folder}")
        for _, covered in log:
            self._files.createNewFile(self._at(f"_covers/{folder}/{covered}"))
        self._commit(folder)

    def query(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """The nearest stored vectors of each query (SRC-12)."""
        return vector_top_k(queries, self.read().withColumnRenamed("values", "vector"), k, where=where)


def lock_grants(requests: DataFrame, *, key: str = "key", owner: str = "owner", ts: str = "ts", order: str = "event_id", hold_seconds: int = 30) -> DataFrame:
    """Which requests for a lock are granted, as a model over a request table (SRC-14).

    Requests have an action: `acquire` is granted where nobody holds the key or its time is over, `release` where its owner holds it.  A key's
    requests are folded in order, so a key is one row while it is judged.
    """
    row = F.struct(F.col(ts).cast("timestamp").cast("double").alias("at"), F.col(order).alias("no"), F.col(owner).alias("owner"), F.col("action").alias("action"))
    lists = requests.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    zero = F.struct(F.lit(None).cast("string").alias("holder"), F.lit(0.0).alias("until"), F.array().cast("array<boolean>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        free = s["holder"].isNull() | (s["until"] <= r["at"])
        mine = ~free & (s["holder"] == r["owner"].cast("string"))
        take = (r["action"] == "acquire") & free
        drop = (r["action"] == "release") & mine
        holder = F.when(take, r["owner"].cast("string")).when(drop | free, F.lit(None).cast("string")).otherwise(s["holder"])
        return F.struct(holder.alias("holder"), F.when(take, r["at"] + float(hold_seconds)).otherwise(s["until"]).alias("until"), F.array_append(s["out"], take | F.coalesce(drop, F.lit(False))).alias("out"))

    judged = lists.select(key, F.explode(F.arrays_zip("_rows", F.aggregate("_rows", zero, step, lambda s: s["out"]).alias("granted"))).alias("z"))
    return judged.select(key, F.col("z._rows.no").alias(order), F.col("z._rows.owner").alias(owner), F.col("z._rows.action").alias("action"), F.col("z.granted").alias("granted"))


def live_entries(cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Entries of a key-value table that have not expired, the latest of each key (SRC-13)."""
    fresh = cache.where(F.col("written_at").cast("timestamp").cast("double") + ttl_seconds >= now.cast("timestamp").cast("double"))
    return fresh.groupBy("key").agg(F.max_by("value", F.struct("written_at", "value")).alias("value"))


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of evaluation questions (SRC-16)."""
    return spark.read.option("multiLine", True).schema(FIXTURE).json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines (SRC-17)."""
    df.write.mode("overwrite").json(path)


def lookup_documents(candidates: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Candidates with their document's columns, where there is one: the first of its row digest if several are (SRC-02, JOIN-08)."""
    others = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in documents.columns if c != key]
    one = first_wins(documents, [key], [F.asc(F.md5(F.concat_ws("\\x00", *others)))]) if others else documents.distinct()
    return candidates.join(one, key, "left")


def index_job(spark: SparkSession, raw: DataFrame, store: VectorStore, *, dim: int = 192, least: int = 450, most: int = 1400) -> dict[str, int]:
    """Normalise, keep the first of each document, chunk, embed and store; the counts (SRC-21, AGG-23)."""
    docs = normalise_documents(raw)
    docs = first_wins(docs, ["doc_id"], [F.col("url"), F.xxhash64("text")])
    chunks = chunk_documents(docs, least, most)
    rows = embed(chunks, out="values", dim=dim).select(F.col("chunk_id").alias("id"), "values", "doc_id", "title", "court", "decision_date", "url", "text", "source_version")
    store.upsert(rows)
    # counted from what is stored, so that nothing is computed twice
    batch = spark.read.parquet(f"{store.path}/{store.current()}") if len(store._log()) == 1 else store.read()
    found = batch.agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks")).first()
    return {"documents": found["documents"], "chunks": found["chunks"]}


def backfill_years(df: DataFrame, path: str, first: int, last: int, *, date: str = "decision_date") -> None:
    """Write a window of years, each as a partition of its own that replaces the one there (SRC-22)."""
    rows = df.withColumn("year", F.year(date)).where(F.col("year").between(first, last))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def pick_provider(wanted: str, configured: set[str]) -> tuple[str, str | None]:
    """(source, reason for falling back): the source asked for if it is there, else the first that is (SRC-10)."""
    order = ["api", "web", "html"]
    if wanted in configured:
        return wanted, None
    for name in order:
        if name in configured:
            return name, None if wanted == "auto" else f"{wanted} is not configured"
    return "tables", f"{wanted} is not configured"
