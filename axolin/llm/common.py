"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD_CHARS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_ready(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir. Only a local master (tests) gets a folder of its
    own where there is none; elsewhere executors would not share it, so that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="axolin-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that lost executors cost no recomputation of its lineage."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The given names, with underscores added until none is a column of df (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of that very name, which may have dots in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def hash_fraction(*parts: Column) -> Column:
    """A reproducible uniform number in [0, 1) from the given values, from 52 bits of MD5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def md5_long(text: Column) -> Column:
    """The first 60 bits of the MD5 of a string as a non-negative long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
