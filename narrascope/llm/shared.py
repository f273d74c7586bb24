"""Tables kept in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_kept: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; where it is unset, a folder of this process, on a local master only."""
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


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/narrascope/{name}-{uuid.uuid4().hex}"
    _kept.append((spark, path))
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete the tables that `saved` has written in this process; frames that read them can't be used afterwards."""
    while _kept:
        spark, path = _kept.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended
            return


atexit.register(release)


def small_batches(df: DataFrame, most_rows: int = 2_000) -> DataFrame:
    """df, after limiting the rows of an Arrow batch in its session: texts are long, and a batch lies in memory several times."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > most_rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(most_rows))
    return df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: A key with this many rows of a join's left side, or with one row in HOT_KEYS, is hot; so there are at most HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 1_000, 4_096


def skewed_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int, how: str = "inner") -> DataFrame:
    """left joined to right on keys, without any hot key's rows in one task.

    right has one row a key, and `n`, how many of left's rows have it, which the result leaves
    out; `rows` is the number of left's rows. The hot keys' rows of right, at most `HOT_KEYS`,
    are broadcast; all others meet in a shuffle. Both must be cheap to read twice. A null key
    has no partner.
    """
    least = max(HOT_ROWS, -(-rows // HOT_KEYS))
    hot = F.broadcast(right.where(F.col("n") >= least).drop("n"))
    if hot.isEmpty():
        return left.join(right.drop("n"), keys, how)
    rest = left.join(F.broadcast(right.where(F.col("n") >= least).select(*keys)), keys, "left_anti")
    return left.join(hot, keys).unionByName(rest.join(right.where(F.col("n") < least).drop("n"), keys, how))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(column: Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo a number of folds."""
    return F.crc32(column.cast("string").cast("binary")) % modulus
