"""The registered queries and their SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TEXTS = {"documents", "pages", "conversations", "benchmark"}


def query(sql: str | None = None):
    """Register a function as a query, with its SQL for DuckDB where SQL can say it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that lie in fewer parts than there are cores are dealt over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return over_cores(df) if name in TEXTS else df


def over_cores(df: DataFrame) -> DataFrame:
    """The table, dealt anew if it has fewer parts than the session has cores: then it is small, and one core would do all the work.

    Filters and columns still reach the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share: that of the checkpoints.  Only a local session gets one of its own if none is set."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="shared-")
