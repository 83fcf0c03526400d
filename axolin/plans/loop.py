"""Support for iterative methods: caching of loop state and cuts of its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.storagelevel import StorageLevel


def folder_ready(spark: SparkSession) -> str:
    """The checkpoint folder, which executors share. Only a local master gets a folder of its own where none is named;
    elsewhere that is an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="axolin-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder."""
    folder_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder in compressed columns: for large tables, whose checkpoint takes several times
    the disk."""
    path = f"{folder_ready(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of at most so many rows are kept in one partition.
ONE_PARTITION = 100_000


class State:
    """The current version of a loop's table. The first one is cached; each later one is checkpointed, so that plans
    do not grow with the iterations and a lost executor costs no recomputation of them."""

    def __init__(self, df: DataFrame, rows: int | None = None):
        self.few = rows is not None and rows <= ONE_PARTITION
        self.df, self.old = self._packed(df).persist(StorageLevel.MEMORY_AND_DISK), []

    def _packed(self, df: DataFrame) -> DataFrame:
        return df.coalesce(1) if self.few else df

    def step(self, df: DataFrame) -> DataFrame:
        """Make df the current version."""
        self.old.append(self.df)
        self.df = checkpoint(self._packed(df))
        return self.df

    def near(self, df: DataFrame) -> DataFrame:
        """Make df the current version, cached only: for the few updates within one iteration."""
        self.old.append(self.df)
        self.df = self._packed(df).persist(StorageLevel.MEMORY_AND_DISK)
        return self.df

    def settle(self) -> None:
        """Release the versions before the current one."""
        for d in self.old:
            d.unpersist()
        self.old = []

    def done(self) -> DataFrame:
        out = checkpoint(self.df)
        self.settle()
        self.df.unpersist()
        return out


class Written:
    """Versions of a loop's table, each one written to the checkpoint folder by a single action that also observes sums
    over its rows. The version before the last stays until the next one is there, so that a failed task can read it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.k = spark, f"{folder_ready(spark)}/loop-{uuid.uuid4().hex}", 0
        self.df: DataFrame | None = None

    def step(self, df: DataFrame, **sums: Column) -> dict[str, float]:
        """Make df the current version; the result has the sums, 0 where there is nothing to add."""
        seen = Observation()
        df.observe(seen, *[c.alias(name) for name, c in sums.items()]).write.parquet(f"{self.folder}/{self.k}")
        self.df = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.k}")
        self.k += 1
        self._drop(self.k - 3)
        return {name: seen.get[name] or 0.0 for name in sums}

    def _drop(self, k: int) -> None:
        if k >= 0:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{k}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by a column and kept by the executors, so that a loop's joins on it move the other side only."""
    return df.repartition(key).persist(StorageLevel.MEMORY_AND_DISK)
