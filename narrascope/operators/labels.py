"""Labels for candidates and pairs from lists of characters and relations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.functions import matching as m
from narrascope.functions.text import name_tokens
from narrascope.operators.coref import ordered_pairs
from narrascope.operators.frames import small


def match_edges(characters: DataFrame, candidates: DataFrame, genders: DataFrame | None = None, always_reverse: bool = False) -> DataFrame:
    """(book_id, character, gram_key, weight): the best score of a candidate as a reference to any of the character's names.

    characters: book_id, character, references. A character without a match gets, the other way
    round, the candidate to which its own name refers best; with `always_reverse` every one does.
    """
    names = characters.select("book_id", "character", F.explode(F.array_prepend(F.coalesce("references", F.array().cast("array<string>")), F.col("character"))).alias("name")).withColumn("tokens", name_tokens(F.col("name")))

    def gendered(df: DataFrame, column: str) -> DataFrame:
        if genders is None:
            return df.withColumn("gender", F.lit(None).cast("string"))
        return df.withColumn("first_name", F.lower(m.first(F.col(column)))).join(small(genders.withColumnRenamed("name", "first_name")), "first_name", "left").drop("first_name")

    each = gendered(names, "tokens").join(candidates.select("book_id", "gram_key", "gram"), "book_id").withColumn("weight", m.reference_score(F.col("tokens"), F.col("gram"), F.col("gender")))
    direct = each.groupBy("book_id", "character", "gram_key").agg(F.max("weight").alias("weight")).where("weight > 0")
    own = characters.select("book_id", "character", name_tokens(F.col("character")).alias("tokens"))
    own = own if always_reverse else own.join(direct.select("book_id", "character").distinct(), ["book_id", "character"], "left_anti")
    back = own.join(gendered(candidates.select("book_id", "gram_key", "gram"), "gram"), "book_id").withColumn("weight", m.reference_score(F.col("gram"), F.col("tokens"), F.col("gender")))
    best = back.where("weight > 0").groupBy("book_id", "character").agg(F.max_by(F.struct("gram_key", "weight"), F.struct("weight", F.col("gram_key"))).alias("x")).select("book_id", "character", "x.*")
    return direct.union(best).groupBy("book_id", "character", "gram_key").agg(F.max("weight").alias("weight"))


def assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a matching of the most pairs with weight > 0 and, of those, the greatest total weight.

    Successive shortest augmenting paths (Bellman-Ford on the residual graph), one pair more a round.
    """
    rows, columns = weights.shape
    of_row, of_column = [-1] * rows, [-1] * columns
    while True:
        cost = [0.0 if of_row[r] < 0 else np.inf for r in range(rows)]
        reach, via = [np.inf] * columns, [-1] * columns
        changed = True
        while changed:
            changed = False
            for r in range(rows):
                if cost[r] < np.inf:
                    for c in np.flatnonzero(weights[r] > 0):
                        if of_row[r] != c and cost[r] - weights[r, c] < reach[c] - 1e-12:
                            reach[c], via[c], changed = cost[r] - weights[r, c], r, True
            for c in range(columns):
                r = of_column[c]
                if r >= 0 and reach[c] + weights[r, c] < cost[r] - 1e-12:
                    cost[r], changed = reach[c] + weights[r, c], True
        free = [c for c in range(columns) if of_column[c] < 0 and reach[c] < np.inf]
        if not free:
            return [(r, c) for r, c in enumerate(of_row) if c >= 0]
        c = min(free, key=lambda x: (reach[x], x))
        while c >= 0:
            r = via[c]
            following, of_column[c], of_row[r] = of_row[r], r, c
            c = following


def matching(edges: DataFrame) -> DataFrame:
    """One-to-one (book_id, character, gram_key, weight): a matching of maximum size and then weight in each book.

    A book's edges are the names of one book's characters, so they fit one task; books run in parallel.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["character", "gram_key"])
        rows, columns = sorted(pdf["character"].unique()), sorted(pdf["gram_key"].unique())
        w = np.zeros((len(rows), len(columns)))
        w[np.searchsorted(rows, pdf["character"]), np.searchsorted(columns, pdf["gram_key"])] = pdf["weight"]
        found = assignment(w)
        return pd.DataFrame({"book_id": pdf["book_id"].iloc[0], "character": [rows[r] for r, _ in found], "gram_key": [columns[c] for _, c in found], "weight": [w[r, c] for r, c in found]})

    kind = edges.schema["book_id"].dataType.simpleString()
    return edges.groupBy("book_id").applyInPandas(one, f"book_id {kind}, character string, gram_key string, weight double")


def candidate_labels(candidates: DataFrame, edges: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """label 1 for candidates with an edge; with `matched`, for those in the matching, and the character's name."""
    if matched is None:
        hit = edges.select("book_id", "gram_key").distinct().withColumn("label", F.lit(1)).withColumn("matched", F.lit("").cast("string"))
    else:
        hit = matched.select("book_id", "gram_key", F.lit(1).alias("label"), F.col("character").alias("matched"))
    return candidates.select("book_id", "gram_key").join(hit, ["book_id", "gram_key"], "left").na.fill({"label": 0, "matched": ""})


def pair_labels(labels: DataFrame, edges: DataFrame, relations: DataFrame, literal: bool = False) -> DataFrame:
    """label of each ordered pair of positive candidates: 1 if characters that they match are related.

    relations has (book_id, c1, c2) with c1 < c2. Both directions count; with `literal` only that as stored.
    """
    either = relations.select("book_id", "c1", "c2")
    if not literal:
        either = either.union(relations.select("book_id", F.col("c2").alias("c1"), F.col("c1").alias("c2"))).distinct()
    one = edges.select("book_id", F.col("character").alias("c1"), F.col("gram_key").alias("gram1"))
    two = edges.select("book_id", F.col("character").alias("c2"), F.col("gram_key").alias("gram2"))
    related = either.join(one, ["book_id", "c1"]).join(two, ["book_id", "c2"]).where("gram1 <> gram2").select("book_id", "gram1", "gram2").distinct().withColumn("label", F.lit(1))
    return ordered_pairs(labels.where("label = 1")).join(related, ["book_id", "gram1", "gram2"], "left").na.fill({"label": 0})


def unresolved_rates(characters: DataFrame, matched: DataFrame) -> DataFrame:
    """Per book, the share of characters without a match."""
    hit = matched.select("book_id", "character").distinct().withColumn("hit", F.lit(1))
    return characters.select("book_id", "character").join(hit, ["book_id", "character"], "left").groupBy("book_id").agg(F.avg(F.when(F.col("hit").isNull(), 1.0).otherwise(0.0)).alias("unresolved"))


def rate_summary(rates: DataFrame, column: str = "unresolved") -> DataFrame:
    """Least, greatest and mean rate of all books."""
    return rates.agg(F.min(column).alias("least"), F.max(column).alias("most"), F.avg(column).alias("mean"))


def quality_names(candidates: DataFrame, edges: DataFrame, matched: DataFrame, characters: DataFrame) -> DataFrame:
    """book_id, kind, names: the duplicate and invalid candidates and the unresolved characters of each book, as sorted lists."""
    edge = edges.select("book_id", "gram_key").distinct()
    rest = candidates.select("book_id", "gram_key").join(matched.select("book_id", "gram_key").distinct(), ["book_id", "gram_key"], "left_anti")
    duplicate, invalid = rest.join(edge, ["book_id", "gram_key"], "left_semi"), candidates.select("book_id", "gram_key").join(edge, ["book_id", "gram_key"], "left_anti")
    missed = characters.select("book_id", "character").join(matched, ["book_id", "character"], "left_anti")
    each = duplicate.withColumn("kind", F.lit("duplicate")).union(invalid.withColumn("kind", F.lit("invalid"))).union(missed.withColumn("kind", F.lit("unresolved")))
    return each.toDF("book_id", "name", "kind").groupBy("book_id", "kind").agg(F.array_sort(F.collect_list("name")).alias("names"))


def quality_rates(quality: DataFrame, characters: DataFrame) -> DataFrame:
    """Per book: unresolved characters by all characters, duplicate and invalid candidates by all candidates (0 without any)."""
    known = characters.groupBy("book_id").agg(F.count("*").alias("n_characters"))
    share = lambda c, n: F.coalesce(F.try_divide(F.col(c), F.col(n)), F.lit(0.0)).alias(f"{c}_rate")
    return quality.join(known, "book_id").select("book_id", share("unresolved", "n_characters"), share("duplicate", "n_candidates"), share("invalid", "n_candidates"))


def candidate_quality(candidates: DataFrame, edges: DataFrame, matched: DataFrame, characters: DataFrame) -> DataFrame:
    """Per book: characters unmatched, candidates that duplicate another's match, candidates without any edge; as counts."""
    edge = edges.select("book_id", "gram_key").distinct().withColumn("has_edge", F.lit(1))
    pick = matched.select("book_id", "gram_key").withColumn("picked", F.lit(1))
    c = candidates.select("book_id", "gram_key").join(edge, ["book_id", "gram_key"], "left").join(pick, ["book_id", "gram_key"], "left")
    by = c.groupBy("book_id").agg(F.count("*").alias("n_candidates"), F.count_if(F.col("picked").isNull() & F.col("has_edge").isNotNull()).alias("duplicate"), F.count_if(F.col("has_edge").isNull()).alias("invalid"))
    missed = characters.select("book_id", "character").join(matched, ["book_id", "character"], "left_anti").groupBy("book_id").agg(F.count("*").alias("unresolved"))
    return by.join(missed, "book_id", "left").na.fill(0, ["unresolved"])
