"""Splits, training frames, classifiers, baselines and evaluation."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier, GBTClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope.operators.candidates import by_length
from narrascope.operators.frames import saved, small


def book_order(book: Column, seed: int = 0) -> Column:
    """A portable pseudo-random number of a book: the head of an MD5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), book.cast("string")).cast("binary"))


def split_books(books: DataFrame, ratio: float = 0.7, seed: int = 0) -> DataFrame:
    """book_id, is_train: floor(n * ratio) distinct books are for training. Books, not rows, are split."""
    each = books.select("book_id").distinct().withColumn("o", book_order(F.col("book_id"), seed))
    n = each.agg(F.count("*").alias("n"))
    ranked = each.crossJoin(F.broadcast(n)).withColumn("r", F.row_number().over(Window.orderBy("o", "book_id")))  # one small row a book
    return ranked.select("book_id", (F.col("r") <= F.floor(F.col("n") * ratio)).alias("is_train"))


def test_books(books: DataFrame, train: DataFrame, named: Sequence[str] | None = None) -> DataFrame:
    """The named books, or all that training has not seen."""
    return books.where(F.col("book_id").isin(list(named))) if named else books.join(train, "book_id", "left_anti")


def matching_columns(columns: Sequence[str], patterns: Sequence[str]) -> list[str]:
    """Columns that one of the patterns matches as a whole; resolved while planning, so others are never read."""
    test = re.compile("|".join(f"(?:{p})" for p in patterns))
    return [c for c in columns if test.fullmatch(c)]


def training_frame(features: DataFrame, labels: DataFrame, keys: Sequence[str], columns: Sequence[str], positive_weight: float = 2.0) -> DataFrame:
    """keys, features (vector), label, weight; only rows that have a label."""
    joined = features.select(*keys, *columns).join(labels.select(*keys, "label"), list(keys))
    weighted = joined.withColumn("label", F.col("label").cast("double")).withColumn("weight", F.when(F.col("label") == 1, positive_weight).otherwise(1.0))
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(weighted).select(*keys, "features", "label", "weight")


def scaled(train: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """other with columns less the mean over train, divided by its population deviation (by 1 if that is 0)."""
    stats = train.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns))
    rest = [c for c in other.columns if c not in columns]
    return other.crossJoin(F.broadcast(stats)).select(*rest, *(((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}"))).alias(c) for c in columns))


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features: dot products of these approximate a Gaussian kernel. Weights follow from the seed, by expressions over arrays."""

    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def __init__(self, inputCol: str = "features", outputCol: str = "fourier", size: int = 128, gamma: float = 0.05, seed: int = 1):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, size=size, gamma=gamma, seed=seed)

    def _transform(self, df: DataFrame) -> DataFrame:
        import numpy as np

        n = len(df.select(self.getInputCol()).first()[0]) if not df.isEmpty() else 1
        rng = np.random.default_rng(self.getOrDefault(self.seed))
        size = self.getOrDefault(self.size)
        w = rng.normal(0, math.sqrt(2 * self.getOrDefault(self.gamma)), (size, n))
        b = rng.uniform(0, 2 * math.pi, size)
        rows = F.array(*(F.struct(F.array(*map(F.lit, map(float, r))).alias("w"), F.lit(float(x)).alias("b")) for r, x in zip(w, b)))
        x = vector_to_array(self.getInputCol())
        dot = lambda r: F.aggregate(F.zip_with(x, r["w"], lambda p, q: p * q), F.lit(0.0), lambda a, v: a + v)
        return df.withColumn(self.getOutputCol(), array_to_vector(F.transform(rows, lambda r: F.cos(dot(r) + r["b"]) * math.sqrt(2 / size))))


class BoostedTrees(Model):
    """A weighted vote of decision trees."""

    def __init__(self, trees: list[tuple[DecisionTreeClassificationModel, float]]):
        super().__init__()
        self.trees = trees

    def _transform(self, df: DataFrame) -> DataFrame:
        out, total = df, F.lit(0.0)
        for i, (tree, alpha) in enumerate(self.trees):
            out = tree.setPredictionCol(f"vote_{i}").setRawPredictionCol("").setProbabilityCol("").transform(out)
            total = total + F.lit(alpha) * (2 * F.col(f"vote_{i}") - 1)
        return out.withColumn("prediction", F.when(total > 0, 1.0).otherwise(0.0)).drop(*(f"vote_{i}" for i in range(len(self.trees))))


class AdaBoost(Estimator):
    """AdaBoost over shallow trees: a short driver loop, each round one distributed fit and one aggregate."""

    def __init__(self, rounds: int = 10, depth: int = 2):
        super().__init__()
        self.rounds, self.depth = rounds, depth

    def _fit(self, df: DataFrame) -> BoostedTrees:
        trees: list[tuple[DecisionTreeClassificationModel, float]] = []
        current = saved(df.select("features", "label", "weight"), "boost")
        for _ in range(self.rounds):
            tree = DecisionTreeClassifier(weightCol="weight", maxDepth=self.depth, seed=1).fit(current)
            seen = tree.transform(current).select("features", "label", "weight", (F.col("prediction") != F.col("label")).alias("wrong"))
            wrong, total = seen.agg(F.sum(F.when(F.col("wrong"), F.col("weight")).otherwise(0.0)), F.sum("weight")).first()
            error = min(max((wrong or 0.0) / (total or 1.0), 1e-9), 1 - 1e-9)
            alpha = 0.5 * math.log((1 - error) / error)
            if alpha <= 0:
                break
            trees.append((tree, alpha))
            if error < 1e-8:
                break
            current = saved(seen.select("features", "label", (F.col("weight") * F.exp(F.when(F.col("wrong"), alpha).otherwise(-alpha))).alias("weight")), "boost")
        return BoostedTrees(trees)


def svm_stages(kernel: str, gamma: float, degree: int) -> list:
    """A linear machine on the features themselves, on their monomials up to a degree, or on Fourier features of a Gaussian kernel."""
    machine = lambda column: LinearSVC(featuresCol=column, weightCol="weight", maxIter=30)
    if kernel == "linear":
        return [machine("features")]
    if kernel == "poly":
        return [PolynomialExpansion(inputCol="features", outputCol="monomials", degree=degree), machine("monomials")]
    return [FourierFeatures(gamma=gamma), machine("fourier")]


#: By name: estimator factories. Extremely randomised trees are approximated: all rows for every tree, few coarse cut points, one random feature a split.
CLASSIFIERS: dict[str, Callable[..., Estimator]] = {
    "svm": lambda kernel="rbf", gamma=0.05, degree=3, **_: Pipeline(stages=svm_stages(kernel, gamma, degree)),
    "rf": lambda n_estimators=10, max_depth=5, **_: RandomForestClassifier(weightCol="weight", numTrees=n_estimators, maxDepth=max_depth, seed=1),
    "erf": lambda n_estimators=10, max_depth=5, **_: RandomForestClassifier(weightCol="weight", numTrees=n_estimators, maxDepth=max_depth, maxBins=8, subsamplingRate=1.0, bootstrap=False, featureSubsetStrategy="1", seed=1),
    "ada_boost": lambda n_estimators=10, **_: AdaBoost(rounds=n_estimators),
    "grad_boost": lambda n_estimators=10, max_depth=3, **_: GBTClassifier(weightCol="weight", maxIter=n_estimators, maxDepth=max_depth, seed=1),
}


def train(frame: DataFrame, model: str = "svm", **options) -> Model:
    return CLASSIFIERS[model](**options).fit(frame)


def save_model(model: Model, frame_books: DataFrame, folder: str) -> None:
    """Write any model of CLASSIFIERS and the books it was trained on. Boosted trees are a pipeline of trees and a table of their votes' weights."""
    boosted = isinstance(model, BoostedTrees)
    PipelineModel([tree for tree, _ in model.trees] if boosted else [model]).write().overwrite().save(f"{folder}/model")
    spark = frame_books.sparkSession
    votes = [(i, alpha) for i, (_, alpha) in enumerate(model.trees)] if boosted else []
    spark.createDataFrame([(boosted,)], "boosted boolean").write.mode("overwrite").parquet(f"{folder}/kind")
    spark.createDataFrame(votes, "place int, weight double").write.mode("overwrite").parquet(f"{folder}/votes")
    frame_books.select("book_id").distinct().write.mode("overwrite").parquet(f"{folder}/train_books")


def load_pipeline(spark, folder: str) -> tuple[Model, DataFrame]:
    model = PipelineModel.load(f"{folder}/model")
    if spark.read.parquet(f"{folder}/kind").first().boosted:
        votes = sorted(map(tuple, spark.read.parquet(f"{folder}/votes").collect()))  # a row a round
        model = BoostedTrees([(model.stages[i], weight) for i, weight in votes])
    return model, spark.read.parquet(f"{folder}/train_books")


def precision_recall(predicted: DataFrame) -> DataFrame:
    """Per book, from (book_id, label, prediction): precision (1 if nothing is predicted), recall (null if nothing is true)."""
    hit = F.count_if((F.col("label") == 1) & (F.col("prediction") == 1))
    return predicted.groupBy("book_id").agg(F.coalesce(F.try_divide(hit, F.count_if(F.col("prediction") == 1)), F.lit(1.0)).alias("precision"), F.try_divide(hit, F.count_if(F.col("label") == 1)).alias("recall"))


def macro(metrics: DataFrame, columns: Sequence[str] = ("precision", "recall")) -> DataFrame:
    """Means over books; missing values are skipped."""
    return metrics.agg(*(F.avg(c).alias(c) for c in columns))


def evaluate(predicted: DataFrame, *measures: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All measures of each book side by side."""
    out = None
    for measure in measures or (precision_recall,):
        out = measure(predicted) if out is None else out.join(measure(predicted), "book_id", "full_outer")
    return out


def baseline_characters(counts: DataFrame, numbers: Sequence[int] = (20, 10, 5)) -> DataFrame:
    """prediction 1 for the most frequent grams of each length: counts has book_id, gram_key, length, n."""
    r = F.row_number().over(Window.partitionBy("book_id", "length").orderBy(F.desc("n"), "gram_key"))
    return counts.withColumn("prediction", F.when(r <= by_length(numbers, F.col("length"), 0), 1).otherwise(0))


def baseline_pairs(pairs: DataFrame, score: str = "cooc_pg", threshold: float | None = None) -> DataFrame:
    """prediction 1 for the best tenth (and one) of a book's pairs, or for all over a threshold."""
    if threshold is not None:
        return pairs.withColumn("prediction", F.when(F.col(score) > threshold, 1).otherwise(0))
    # a book's order is cut into ranges, ranked apart; the ranges before one add their sizes
    order = [F.desc(score), F.col("gram1"), F.col("gram2")]
    ranges = saved(pairs.repartitionByRange("book_id", *order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("book_id", "range").agg(F.count("*").alias("size"))
    book = Window.partitionBy("book_id")
    sizes = sizes.select(F.col("book_id").alias("b"), "range", (F.sum("size").over(book.orderBy("range")) - F.col("size")).alias("before"), F.sum("size").over(book).alias("all"))
    ranked = ranges.withColumn("r", F.row_number().over(Window.partitionBy("range", "book_id").orderBy(*order))).withColumnRenamed("range", "own")
    placed = ranked.join(small(sizes), F.col("book_id").eqNullSafe(F.col("b")) & (F.col("own") == F.col("range")))
    return placed.select(*pairs.columns, F.when(F.col("r") + F.col("before") <= F.floor(F.col("all") / 10) + 1, 1).otherwise(0).alias("prediction"))


def listing(predicted: DataFrame) -> DataFrame:
    """Names by book and kind: true, predicted, missed and false ones, as sorted lists."""
    kinds = F.array(F.when(F.col("label") == 1, "true"), F.when(F.col("prediction") == 1, "predicted"), F.when((F.col("label") == 1) & (F.col("prediction") != 1), "missed"), F.when((F.col("label") != 1) & (F.col("prediction") == 1), "false"))
    each = predicted.select("book_id", "gram_key", F.explode(F.array_compact(kinds)).alias("kind"))
    return each.groupBy("book_id", "kind").agg(F.array_sort(F.collect_list("gram_key")).alias("names"))

