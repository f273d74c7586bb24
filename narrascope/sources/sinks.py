"""Writers and checks of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> None:
    """Parquet by book, so that readers of some books open only their files."""
    df.write.mode("overwrite").partitionBy("book_id").parquet(path)


def long_features(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, feature, value: one row per feature."""
    return df.unpivot(keys, [F.col(n).cast("double").alias(n) for n in names], "feature", "value")


def readable(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """book_id, ord, text: a block per row of df, ordered by the lengths of its names and then by the names."""
    name = F.concat_ws(" ", *(F.concat(F.lit("("), F.col(k), F.lit(")")) for k in keys))
    block = F.concat_ws("\n", name, *(F.concat(F.lit(f"\t{n}:"), F.col(n).cast("double").cast("string")) for n in names))
    order = [F.size(F.split(k, " ")) for k in keys] + [F.col(k) for k in keys]
    return df.select("book_id", F.row_number().over(Window.partitionBy("book_id").orderBy(*order)).alias("ord"), block.alias("text"))


def write_readable(df: DataFrame, keys: list[str], names: list[str], path: str) -> None:
    """One folder per book with its blocks in order."""
    blocks = readable(df, keys, names)
    blocks.repartition("book_id").sortWithinPartitions("book_id", "ord").select("book_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("book_id").text(path)


def equal_parts(books: DataFrame, parts: int, keep_rest: bool = False) -> DataFrame:
    """book_id, part: sorted books in equal parts; the remainder is dropped, or dealt out with `keep_rest`."""
    each = books.select("book_id").distinct()
    w = Window.orderBy("book_id")  # one small row a book
    if keep_rest:
        return each.select("book_id", (F.ntile(parts).over(w) - 1).alias("part"))
    size = F.floor(F.count("*").over(Window.partitionBy()) / parts)
    part = F.when(size > 0, F.floor((F.row_number().over(w) - 1) / size)).cast("int")
    return each.select("book_id", part.alias("part")).where(F.col("part") < parts)


def inconsistent(**tables: DataFrame) -> DataFrame:
    """book_id and the tables that lack it, for books that not all tables have; no rows if they agree."""
    names = list(tables)
    out = None
    for name, df in tables.items():
        one = df.select("book_id").distinct().withColumn(name, F.lit(True))
        out = one if out is None else out.join(one, "book_id", "full_outer")
    lacks = F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in names)))
    return out.select("book_id", lacks.alias("lacks")).where(F.size("lacks") > 0)


def descriptions(rows: DataFrame) -> DataFrame:
    """book_id, names (in order), combined text from (book_id, ord, character, text); books without text give nothing."""
    order = F.array_sort(F.collect_list(F.struct("ord", "character", "text")))
    grouped = rows.where("text <> ''").groupBy("book_id").agg(order.alias("d"))
    return grouped.select("book_id", F.transform("d", lambda x: x["character"]).alias("names"), F.array_join(F.transform("d", lambda x: x["text"]), "\n").alias("combined"))


def remaining(books: DataFrame, failed: DataFrame) -> DataFrame:
    return books.join(failed.select("book_id").distinct(), "book_id", "left_anti")
