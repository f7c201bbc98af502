"""Tables that a plan writes on its way: in the folder that all executors share, and removed together."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..registry import shared_folder


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """A folder of stored tables.  A stored table cuts the lineage, survives the loss of executors, and stays until `release`."""

    def __init__(self, spark: SparkSession, name: str = "scratch") -> None:
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.others: list[Scratch] = []

    def also(self, other: Scratch) -> None:
        """Release another one's tables with these."""
        self.others.append(other)

    def store(self, df: DataFrame, name: str = "table") -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        remove_folder(self.spark, self.folder)
        for other in self.others:
            other.release()
