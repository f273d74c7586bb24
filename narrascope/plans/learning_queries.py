"""Queries on splits, training frames, classifiers and measures."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.operators import learning as m
from narrascope.operators.frames import saved, table
from narrascope.plans.base import query

_SPLIT = "books AS (SELECT DISTINCT source AS book_id FROM documents), sp AS (SELECT book_id, row_number() OVER (ORDER BY md5('0:' || book_id), book_id) <= floor(count(*) OVER () * 0.7) AS is_train FROM books)"


def books(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("source").alias("book_id"))


@query(f"WITH {_SPLIT} SELECT book_id, is_train FROM sp")
def train_test_split(spark, folder):
    return m.split_books(books(spark, folder))


@query(f"WITH {_SPLIT} SELECT d.source AS book_id, count(*) AS n FROM documents d JOIN sp ON sp.book_id = d.source WHERE NOT is_train GROUP BY ALL")
def test_book_sizes(spark, folder):
    b = books(spark, folder)
    train = m.split_books(b).where("is_train").select("book_id")
    return m.test_books(b, train).groupBy("book_id").agg(F.count("*").alias("n"))


_DOC = "SELECT d.source AS book_id, d.doc_id, quality AS label, n_chars, length(text) - length(replace(text, chr(10), '')) AS newlines, length(text) - length(replace(text, '.', '')) AS stops FROM documents d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL"
COLUMNS = ["n_chars", "newlines", "stops"]


def document_features(spark: SparkSession, folder: str) -> DataFrame:
    count = lambda x: (F.length("text") - F.length(F.replace(F.col("text"), F.lit(x), F.lit("")))).alias({"\n": "newlines", ".": "stops"}[x])
    return table(spark, folder, "documents").select(F.col("source").alias("book_id"), "doc_id", "n_chars", count("\n"), count("."))


def quality_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").alias("label"))


@query(f"SELECT book_id, doc_id, label::DOUBLE AS label, CASE WHEN label = 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, n_chars::DOUBLE AS f0, newlines::DOUBLE AS f1, stops::DOUBLE AS f2 FROM ({_DOC})")
def feature_label_join(spark, folder):
    labels = quality_labels(spark, folder).join(table(spark, folder, "documents").select("doc_id", F.col("source").alias("book_id")), "doc_id")
    frame = m.training_frame(document_features(spark, folder), labels, ["book_id", "doc_id"], COLUMNS)
    x = vector_to_array("features")
    return frame.select("book_id", "doc_id", "label", "weight", *(x[i].alias(f"f{i}") for i in range(len(COLUMNS))))


@query(
    f"WITH {_SPLIT}, f AS ({_DOC}), tr AS (SELECT f.* FROM f JOIN sp USING (book_id) WHERE is_train), s AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in COLUMNS)
    + " FROM tr) SELECT book_id, doc_id, label, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in COLUMNS)
    + " FROM f JOIN sp USING (book_id), s WHERE NOT is_train"
)
def standard_scaler(spark, folder):
    f = document_features(spark, folder).join(quality_labels(spark, folder), "doc_id").join(m.split_books(books(spark, folder)), "book_id")
    out = m.scaled(f.where("is_train"), f.where("NOT is_train"), COLUMNS)
    return out.select("book_id", "doc_id", "label", *(F.round(c, 6).alias(c) for c in COLUMNS))


@query("SELECT doc_id, n_chars FROM documents")
def feature_projection(spark, folder):
    d = table(spark, folder, "documents")
    return d.select(m.matching_columns(d.columns, ["doc_.*", "n_c.*"]))


_COUNTS = "counts AS (SELECT l_returnflag AS book_id, l_suppkey::VARCHAR AS gram_key, 1 + l_suppkey % 3 AS length, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY ALL)"
_BASE = "base AS (SELECT book_id, gram_key, length::INT AS length, n, (q >= 49)::INT AS label, (row_number() OVER (PARTITION BY book_id, length ORDER BY n DESC, gram_key) <= CASE length WHEN 1 THEN 20 WHEN 2 THEN 10 ELSE 5 END)::INT AS prediction FROM counts)"


def _predicted(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as names: a gram's length is 1 to 3 by its number, its label whether some line has a quantity of 49 or more."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("book_id"), F.col("l_suppkey").cast("string").alias("gram_key"), (1 + F.col("l_suppkey") % 3).cast("int").alias("length"))
    counts = lines.agg(F.count("*").alias("n"), F.max("l_quantity").alias("q"))
    return m.baseline_characters(counts).select("book_id", "gram_key", "length", "n", (F.col("q") >= 49).cast("int").alias("label"), "prediction")


@query(f"WITH {_COUNTS}, {_BASE} SELECT * FROM base")
def baseline_topk(spark, folder):
    return _predicted(spark, folder)


_PR = "SELECT book_id, coalesce(count(*) FILTER (label = 1 AND prediction = 1) / nullif(count(*) FILTER (prediction = 1), 0), 1.0) AS precision, count(*) FILTER (label = 1 AND prediction = 1) / nullif(count(*) FILTER (label = 1), 0) AS recall FROM base GROUP BY ALL"


@query(f"WITH {_COUNTS}, {_BASE}, pr AS ({_PR}) SELECT book_id, round(precision, 9) AS precision, round(recall, 9) AS recall FROM pr")
def precision_recall(spark, folder):
    return m.evaluate(_predicted(spark, folder)).select("book_id", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(f"WITH {_COUNTS}, {_BASE}, pr AS ({_PR}) SELECT round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall FROM pr")
def precision_recall_macro(spark, folder):
    found = m.macro(m.precision_recall(_predicted(spark, folder)))
    return found.select(F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(
    f"""WITH {_COUNTS}, {_BASE}, k AS (SELECT book_id, gram_key, unnest([CASE WHEN label = 1 THEN 'true' END, CASE WHEN prediction = 1 THEN 'predicted' END, CASE WHEN label = 1 AND prediction = 0 THEN 'missed' END, CASE WHEN label = 0 AND prediction = 1 THEN 'false' END]) AS kind FROM base)
SELECT book_id, kind, string_agg(gram_key, ',' ORDER BY gram_key) AS names FROM k WHERE kind IS NOT NULL GROUP BY ALL"""
)
def qualitative_listing(spark, folder):
    return m.listing(_predicted(spark, folder)).select("book_id", "kind", F.array_join("names", ",").alias("names"))


@query(
    """WITH occ AS (SELECT DISTINCT o_orderpriority AS book_id, o_orderkey AS s, l_suppkey::VARCHAR AS g FROM lineitem JOIN orders ON o_orderkey = l_orderkey), p AS (SELECT a.book_id, a.g AS gram1, b.g AS gram2, count(*) AS cooc_pg FROM occ a JOIN occ b USING (book_id, s) WHERE a.g <> b.g GROUP BY ALL)
SELECT book_id, gram1, gram2, cooc_pg, (row_number() OVER (PARTITION BY book_id ORDER BY cooc_pg DESC, gram1, gram2) <= count(*) OVER (PARTITION BY book_id) // 10 + 1)::INT AS prediction FROM p"""
)
def baseline_pairs(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("s"), F.col("l_suppkey").cast("string").alias("g"))
    occ = lines.join(table(spark, folder, "orders").select(F.col("o_orderkey").alias("s"), F.col("o_orderpriority").alias("book_id")), "s").distinct()
    pairs = occ.withColumnRenamed("g", "gram1").join(occ.withColumnRenamed("g", "gram2"), ["book_id", "s"]).where("gram1 <> gram2").groupBy("book_id", "gram1", "gram2").agg(F.count("*").alias("cooc_pg"))
    return m.baseline_pairs(pairs)


def _classified(spark: SparkSession, folder: str, model: str, **options) -> DataFrame:
    """Train on one part of the vectors, by number, and predict the rest: is the label 3 or less?"""
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("gram_key"), (F.col("vec_id") % 5).alias("book_id"), "embedding", (F.col("label") <= 3).cast("int").alias("label"))
    wide = v.select("book_id", "gram_key", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)))
    frame = saved(m.training_frame(wide, v.select("book_id", "gram_key", "label"), ["book_id", "gram_key"], [f"e{i}" for i in range(64)]), "frame")
    split = m.split_books(frame)
    train, test = frame.join(split.where("is_train"), "book_id", "left_semi"), frame.join(split.where("NOT is_train"), "book_id", "left_semi")
    predicted = m.train(train, model, **options).transform(test)
    return predicted.select("book_id", "gram_key", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


@query()
def classifier_svm(spark, folder):
    return _classified(spark, folder, "svm")


@query()
def classifier_linear_svm(spark, folder):
    return _classified(spark, folder, "svm", kernel="linear")


@query()
def classifier_random_forest(spark, folder):
    return _classified(spark, folder, "rf")


@query()
def classifier_extra_trees(spark, folder):
    return _classified(spark, folder, "erf")


@query()
def classifier_ada_boost(spark, folder):
    return _classified(spark, folder, "ada_boost", n_estimators=5)


@query()
def classifier_grad_boost(spark, folder):
    return _classified(spark, folder, "grad_boost", n_estimators=5)
