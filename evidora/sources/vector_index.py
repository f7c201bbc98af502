"""A stored vector index: coarse cells as partitions, a pruned scan, and exact scores (SRC-12, ORD-03).

Cells.  Centroids are fitted by k-means on a bounded sample (`SAMPLE` vectors, those of the least hash of their id); then every vector goes to its nearest
centroid's cell, and a cell is a partition of the table.  With each cell stands its radius, the largest distance of a member to the centroid.

A search picks each query's `probes` nearest cells, reads only partitions that some query picked, and scores their vectors exactly.  In exact mode it goes on: no vector of a
cell can score more than q·c + |q|·r, so after the first cells only those are read whose bound reaches the k-th best score; the result is that of a full scan.

Cells are read in parts of `PART_ROWS` vectors, and a part's queries in blocks of `QUERY_ROWS`, so a task holds a few dozen megabytes whatever the cell.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import Scratch

SAMPLE = 20_000
PART_ROWS = 16_384
QUERY_ROWS = 256
ROUNDS = 12
#: Queries by which `probes_for` measures recall, those of the least hash of their id.
CALIBRATION = 256


def dense(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; nulls are zeros, shorter vectors end with zeros, longer ones are cut."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten(), 0.0).to_numpy(zero_copy_only=False)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), width))
    kept = at < width
    out[np.repeat(np.arange(len(sizes)), sizes)[kept], at[kept]] = flat[kept]
    return out


def _nearest(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each vector, nearest first."""
    far = (centroids**2).sum(axis=1)[None, :] - 2 * vectors @ centroids.T
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from starts that lie far apart; a cell that loses all members keeps its centroid."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(cells, len(sample)) and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    centroids = sample[chosen].copy()
    for _ in range(rounds):
        own = _nearest(sample, centroids, 1)[:, 0]
        n = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


class VectorIndex:
    """vectors: the rows with a `cell`, partitioned by it; cells: (cell, centroid, radius, n, schema of the rows)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        rows = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])  # as many as there are cells
        self.vectors = spark.read.schema(T.StructType.fromJson(json.loads(rows[0]["schema"]))).parquet(f"{path}/vectors")  # an empty index has no files
        self.centroids = np.array([r["centroid"] for r in rows])
        self.radius, self.n = np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows])

    @classmethod
    def build(cls, vectors: DataFrame, path: str, *, cells: int = 64, sample: int = SAMPLE) -> VectorIndex:
        """Index all rows (id, vector, …) under `path`; the width is that of the sample's longest vector, or of any longer one."""
        spark = vectors.sparkSession
        width = max(1, vectors.agg(F.max(F.size("vector"))).first()[0] or 1)
        some = vectors.where("vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector")).orderBy(F.xxhash64("id"), "id").limit(sample)
        held = pa.array([r["vector"] for r in some.select("vector").collect()], pa.list_(pa.float64()))
        centroids = fit_centroids(dense(held, width), cells)
        shared = spark.sparkContext.broadcast(centroids)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    own = dense(part.column(0), centroids.shape[1])
                    cell = _nearest(own, centroids, 1)[:, 0]
                    away = np.sqrt(((own - centroids[cell]) ** 2).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(cell.astype(np.int32)), pa.array(away)], names=[*part.schema.names[1:], "cell", "away"])

        plain = vectors.select(F.col("vector").cast("array<double>").alias("_v"), *vectors.columns)
        schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
        made = plain.mapInArrow(assign, schema)
        # a large cell is written by several tasks
        made.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        told = {r["cell"]: r for r in spark.read.schema(made.schema).parquet(f"{path}/vectors").groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
        rows = [(i, c.tolist(), float(told[i]["radius"]) if i in told else 0.0, int(told[i]["n"]) if i in told else 0, made.schema.json()) for i, c in enumerate(centroids)]
        spark.createDataFrame(rows, "cell int, centroid array<double>, radius double, n long, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return cls(spark, path)

    def _picked(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, v, cell) of the nearest cells; queries: (query_id, v)."""
        centroids, n = self.centroids, min(probes, len(self.centroids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = _nearest(dense(batch.column(1), centroids.shape[1]), centroids, n)
                row = np.repeat(np.arange(batch.num_rows), n)
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in batch.columns], pa.array(near.ravel().astype(np.int32))], names=["query_id", "v", "cell"])

        return queries.select("query_id", "v").mapInArrow(run, self._query_schema(queries, T.StructField("cell", T.IntegerType())))

    def _reachable(self, queries: DataFrame) -> DataFrame:
        """(query_id, v, cell) of the cells whose bound reaches `least` (all cells where it is null); queries: (query_id, v, least)."""
        centroids, radius = self.centroids, self.radius

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = dense(batch.column(1), centroids.shape[1])
                least = pc.fill_null(batch.column(2), -np.inf).to_numpy(zero_copy_only=False)
                bound = own @ centroids.T + np.sqrt((own**2).sum(axis=1))[:, None] * radius[None, :]
                row, cell = np.nonzero(bound >= least[:, None] - 2e-6 * np.maximum(1, np.abs(bound)))
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in batch.columns[:2]], pa.array(cell.astype(np.int32))], names=["query_id", "v", "cell"])

        return queries.select("query_id", "v", "least").mapInArrow(run, self._query_schema(queries, T.StructField("cell", T.IntegerType())))

    @staticmethod
    def _query_schema(queries: DataFrame, *more: T.StructField) -> T.StructType:
        return T.StructType([queries.schema["query_id"], T.StructField("v", T.ArrayType(T.DoubleType())), *more])

    def _scored(self, picked: DataFrame, k: int, where: Column | None) -> DataFrame:
        """(query_id, id, score): the k best of each (query, part of a cell)."""
        cells = [r["cell"] for r in picked.select("cell").distinct().collect()]  # as many as there are cells
        rows = self.vectors.where(F.col("cell").isin(cells)) if cells else self.vectors.where("false")
        rows = rows if where is None else rows.where(where)
        parts = F.create_map(*[x for c in range(len(self.n)) for x in (F.lit(c), F.lit(int(-(-max(1, self.n[c]) // PART_ROWS))))])
        n_parts = F.element_at(parts, F.col("cell"))
        width = self.centroids.shape[1]
        query_type, id_type = picked.schema["query_id"].dataType, self.vectors.schema["id"].dataType
        none = lambda kind: F.lit(None).cast(kind)
        own = rows.select("cell", F.pmod(F.xxhash64("id"), n_parts.cast("long")).cast("int").alias("part"), F.lit(1).alias("kind"), none(query_type).alias("query_id"), "id", F.col("vector").cast("array<double>").alias("v"))
        asked = picked.select("cell", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"), F.lit(0).alias("kind"), "query_id", none(id_type).alias("id"), "v")
        units = asked.unionByName(own).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
        schema = T.StructType([T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])

        def best(questions: list[pa.RecordBatch], vectors: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The vectors come in slices of a part, so each slice's k best are told."""
            ids = pa.concat_arrays([b.column("id") for b in vectors])
            store = np.concatenate([dense(b.column("v"), width) for b in vectors])
            for batch in questions:
                for at in range(0, batch.num_rows, QUERY_ROWS):
                    block = batch.slice(at, QUERY_ROWS)
                    product = dense(block.column("v"), width) @ store.T
                    # those near the k-th product, then rounded: rounding moves a score by half a millionth at most
                    if product.shape[1] > k:
                        least = np.partition(product, product.shape[1] - k, axis=1)[:, product.shape[1] - k]
                        query, row = np.nonzero(product >= least[:, None] - 1.1e-6)
                    else:
                        query, row = np.nonzero(np.ones(product.shape, bool))
                    value = product[query, row]
                    score = np.sign(value) * np.floor(np.abs(value) * 1e6 + 0.5) / 1e6
                    yield pa.RecordBatch.from_arrays([block.column("query_id").take(pa.array(query)), ids.take(pa.array(row)), pa.array(score)], names=["query_id", "id", "score"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit, questions, vectors, held = None, [], [], 0
            for batch in batches:
                keys = [batch.column(c).to_numpy() for c in ("cell", "part", "kind")]
                edges = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                    if a == b:
                        continue
                    now = (int(keys[0][a]), int(keys[1][a]))
                    if now != unit or held >= PART_ROWS:
                        if questions and vectors:
                            yield from best(questions, vectors)
                        vectors, held = [], 0
                        if now != unit:
                            unit, questions = now, []
                    if keys[2][a] == 0:
                        questions.append(batch.slice(a, b - a))
                    else:
                        vectors.append(batch.slice(a, b - a))
                        held += b - a
            if questions and vectors:
                yield from best(questions, vectors)

        return units.mapInArrow(run, schema)

    def search(self, queries: DataFrame, k: int, *, probes: int = 8, exact: bool = False, where: Column | None = None, scratch: Scratch | None = None) -> DataFrame:
        """(query_id, id, score, rank) of the k nearest vectors by dot product, scores rounded to six places, ties by id.

        A filter on the payload reaches the scan and holds before the k are taken.  Without `exact`, a query's vectors outside its `probes` nearest cells are not seen;
        an empty index or no queries give no rows; null vectors are zeros.
        """
        scratch = scratch or Scratch(self.spark, "vectors")
        asked = scratch.store(queries.select("query_id", F.col("vector").cast("array<double>").alias("v")), "queries")
        picked = scratch.store(self._picked(asked, probes), "picked")
        found = scratch.store(self._top(self._scored(picked, k, where), k), "found")
        if exact:
            kth = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
            left = self._reachable(asked.join(kth, "query_id", "left")).join(picked.select("query_id", "cell"), ["query_id", "cell"], "left_anti")
            more = self._scored(scratch.store(left.select("query_id", "v", "cell"), "left"), k, where)
            found = self._top(found.select("query_id", "id", "score").union(more), k)
        return found

    def probes_for(self, queries: DataFrame, k: int, recall: float, *, sample: int = CALIBRATION) -> int:
        """The fewest probes that find this share of the k nearest vectors of at most `sample` of the queries; all cells without queries.

        The exact mode tells the k nearest, and each one's cell has a place among its query's nearest cells.
        """
        some = queries.where("vector is not null").orderBy(F.xxhash64("query_id"), "query_id").limit(sample).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        asked = Scratch(self.spark, "vectors").store(some, "asked")
        wanted = self.search(asked, k, exact=True).select("query_id", "id")
        told = self.vectors.select("id", "cell").join(F.broadcast(wanted), "id").join(asked, "query_id").select("cell", "vector").collect()  # k rows a query of the sample
        if not told:
            return len(self.centroids)
        near = _nearest(dense(pa.array([r["vector"] for r in told], pa.list_(pa.float64())), self.centroids.shape[1]), self.centroids, len(self.centroids))
        place = np.argmax(near == np.array([r["cell"] for r in told])[:, None], axis=1)
        found = np.cumsum(np.bincount(place, minlength=len(self.centroids)))
        return int(np.argmax(found >= recall * len(told))) + 1

    @staticmethod
    def _top(rows: DataFrame, k: int) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))).where(F.col("rank") <= k)
