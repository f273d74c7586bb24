"""Readers: everything becomes a DataFrame of the whole corpus, keyed by book_id."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrascope.functions.text import book_stem, normalized


def _named(df: DataFrame) -> DataFrame:
    """df with book_id: of the folder, if books have folders of their own, or else the file's stem."""
    path = F.col("_metadata.file_path")
    own = F.regexp_extract(path, r"/book_id=([^/]*)/", 1)
    return df.withColumn("book_id", F.when(own != "", F.url_decode(own)).otherwise(book_stem(path)))


def books(spark: SparkSession, folder: str) -> DataFrame:
    """book_id, text: one row per file."""
    return _named(spark.read.text(folder, wholetext=True)).select("book_id", F.col("value").alias("text"))


def token_lines(spark: SparkSession, folder: str, header: int = 2) -> DataFrame:
    """book_id, line_no (from 0, after the header), token."""
    lines = books(spark, folder).select("book_id", F.posexplode(F.split(F.regexp_replace("text", r"\n$", ""), "\n")).alias("pos", "token"))
    return lines.where(F.col("pos") >= header).select("book_id", (F.col("pos") - header).alias("line_no"), "token")


XML_SENTENCE = T.StructType(
    [
        T.StructField("_id", T.IntegerType()),
        T.StructField(
            "tokens",
            T.StructType(
                [
                    T.StructField(
                        "token",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("word", T.StringType()),
                                    T.StructField("lemma", T.StringType()),
                                    T.StructField("CharacterOffsetBegin", T.IntegerType()),
                                    T.StructField("CharacterOffsetEnd", T.IntegerType()),
                                    T.StructField("POS", T.StringType()),
                                    T.StructField("NER", T.StringType()),
                                ]
                            )
                        ),
                    )
                ]
            ),
        ),
    ]
)


def annotated(spark: SparkSession, folder: str) -> DataFrame:
    """book_id, sent_id, tok_idx, word, lemma, begin, end, pos, ner from annotation files in XML."""
    rows = _named(spark.read.format("xml").option("rowTag", "sentence").schema(XML_SENTENCE).load(folder))
    each = rows.where("tokens IS NOT NULL").select("book_id", (F.col("_id") - 1).alias("sent_id"), F.posexplode("tokens.token").alias("tok_idx", "t"))
    return each.select("book_id", "sent_id", "tok_idx", "t.word", "t.lemma", F.col("t.CharacterOffsetBegin").alias("begin"), F.col("t.CharacterOffsetEnd").alias("end"), F.col("t.POS").alias("pos"), F.col("t.NER").alias("ner"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the distinct trimmed lines of a list."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''").distinct()


def book_list(spark: SparkSession, path: str) -> DataFrame:
    """book, title, author, ids from a file with four fields parted by `|`."""
    raw = spark.read.csv(path, sep="|", schema="book string, title string, author string, ids string")
    return raw.select(F.trim("book").alias("book"), F.trim("title").alias("title"), F.trim("author").alias("author"), F.transform(F.split("ids", ","), lambda x: F.trim(x).cast("int")).alias("ids"))


def genders(spark: SparkSession, *paths: str) -> DataFrame:
    """name, gender from files with tabs (or `path=GENDER` for plain lists); of a name in several, the last file counts."""
    out = None
    for rank, path in enumerate(paths):
        path, _, fixed = path.partition("=")
        one = spark.read.csv(path, sep="\t", schema="name string, gender string").withColumn("rank", F.lit(rank))
        one = one.withColumn("gender", F.lit(fixed)) if fixed else one
        out = one if out is None else out.union(one)
    return out.groupBy(F.trim("name").alias("name")).agg(F.max_by(F.trim("gender"), "rank").alias("gender"))


def human_tags(spark: SparkSession, folder: str) -> DataFrame:
    """book_id, c1, c2 (ordered) from `A;B` lines."""
    rows = _named(spark.read.csv(folder, sep=";", schema="a string, b string"))
    both = rows.select("book_id", normalized(F.trim("a")).alias("a"), normalized(F.trim("b")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return both.select("book_id", F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2")).distinct()


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one if it is missing."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def readable_features(spark: SparkSession, folder: str, names: list[str], pair: bool = False) -> DataFrame:
    """Wide features from the readable form: a line `(name)` (or `(name) (name)`), then lines `<tab>feature:value`; missing ones are 0."""
    rows = books(spark, folder).select("book_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = F.col("line").startswith("(")
    w = Window.partitionBy("book_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("key", F.last(F.when(head, F.col("line")), True).over(w)).where(F.col("line").startswith("\t"))
    parts = marked.select("book_id", "key", F.regexp_extract("line", r"^\t(.*):[^:]*$", 1).alias("feature"), F.regexp_extract("line", r":([^:]*)$", 1).cast("double").alias("value"))
    wide = parts.groupBy("book_id", "key").agg(*(F.coalesce(F.max(F.when(F.col("feature") == n, F.col("value"))), F.lit(0.0)).alias(n) for n in names))
    if pair:
        return wide.select("book_id", F.regexp_extract("key", r"^\((.*)\) \((.*)\)$", 1).alias("gram1"), F.regexp_extract("key", r"^\((.*)\) \((.*)\)$", 2).alias("gram2"), *names)
    return wide.select("book_id", F.regexp_extract("key", r"^\((.*)\)$", 1).alias("gram_key"), *names)
