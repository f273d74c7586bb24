"""Small helpers of all operators: tables in the shared folder, and the bounded broadcast."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_kept: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where the session has none, a folder of this process, on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="narrascope-"))
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get()
    return folder.rstrip("/")


def saved(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut and lost executors lose nothing. The table is deleted by `release`, or when the process ends."""
    path = f"{shared_folder(df.sparkSession)}/narrascope/{name}-{uuid.uuid4().hex}"
    _kept.append((df.sparkSession, path))
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the tables of `saved`; frames that read them can't be used afterwards."""
    while _kept:
        spark, path = _kept.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended
            return


atexit.register(release)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns, each computed once a row: unlike those of withColumn, they are not copied into the lambdas that use them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, text: str, most: int = 4_000_000) -> tuple[DataFrame, int]:
    """df in as many parts as hold about `most` characters of the column `text` each, and their number: what a task holds doesn't grow with the table."""
    chars = df.agg(F.sum(F.length(text)).alias("n")).first()["n"] or 0
    parts = max(1, -(-chars // most))
    return df.repartition(parts), parts


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
