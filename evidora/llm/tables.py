"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


TEXTS = {"documents", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that lie in fewer parts than the session has cores, and so are small, are dealt over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Only a local session, whose executors are in this process, gets one of its own if none is set."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def store(df: DataFrame, name: str = "kept") -> DataFrame:
    """Write a table as Parquet into the shared folder and read it again.

    Unlike a checkpoint's, its plan starts anew: sizes that Spark estimated for joins, which multiply, are forgotten, so loops use this one.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


BATCH_BYTES = 4 << 20


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with batches of at most BATCH_BYTES: the session is asked for smaller ones if it makes larger ones.

    The setting is read when the plan runs, so it stays in the session.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH_CONF, "67108864b").removesuffix("b")) > BATCH_BYTES:
        conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Return freed memory to the system: idle workers stay for a while beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which has no such call


_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def sweep(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are no longer used: it does so when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def _freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written meanwhile are removed when it ends: what is settled or stored never needs them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    with _freed_shuffles(df.sparkSession):
        return df.select("*").checkpoint()  # a new plan, so that the setting holds for it


def forget(*settled: DataFrame) -> None:
    """Delete the files of stored or settled tables that nothing reads any more."""
    for df in settled:
        if hasattr(df, "stored_at"):
            _delete(df.sparkSession, df.stored_at)
            continue
        rdd = df._jdf.queryExecution().toRdd()
        while rdd.dependencies().size() and not rdd.isCheckpointed():
            rdd = rdd.dependencies().head().rdd()
        if rdd.getCheckpointFile().isDefined():
            _delete(df.sparkSession, rdd.getCheckpointFile().get())


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Hash-partition by key over as many partitions as the session's shuffles have."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[F.col(k) for k in keys])


def row_key(id_column: Column, text: Column) -> Column:
    """A key of a row by its id and text, of 128 bits: repeated rows share it, and null ids have one too."""
    own = F.coalesce(F.concat(F.lit("="), id_column.cast("string")), F.lit(""))
    return F.unhex(F.md5(F.concat(F.md5(F.coalesce(text, F.lit("")).cast("binary")), own).cast("binary")))


def fresh(df: DataFrame, names: Iterable[str]) -> dict[str, str]:
    """Names for working columns that the table does not have yet."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in names:
        own = f"__{name}"
        while own.lower() in taken:
            own = f"_{own}"
        taken.add(own.lower())
        out[name] = own
    return out
