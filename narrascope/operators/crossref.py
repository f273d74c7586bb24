"""Cross-reference of listed books with index entries, and features of tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.functions.text import has_capital
from narrascope.operators.frames import small


def crossref(books: DataFrame, index: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Class of each listed book that is not on the blacklist: good, ugly or bad, with the least id of its class's entries.

    books: book_id, title, author, description; index: entry_id, entry; blacklist: book_id. Good:
    some English entry has the title and `by` and the author's last name; ugly: the title alone;
    bad: neither. Plays, poems and books without a description are bad and go on the blacklist.
    """
    wanted = books.join(small(blacklist.select("book_id").distinct()), "book_id", "left_anti").withColumn("last_name", F.element_at(F.split(F.trim(F.lower("author")), r"\s+"), -1))
    story = F.col("description").isNotNull() & ~F.lower("description").rlike("play|poem")
    entries = index.select("entry_id", F.lower("entry").alias("entry")).where(~F.exists(F.split("entry", "\n"), lambda x: x.rlike("^ *language: ") & ~x.rlike("^ *language: english")))
    titled = entries.join(small(wanted.where(story).select("book_id", F.lower("title").alias("t"), "last_name")), F.contains(F.col("entry"), F.col("t")))
    by = F.coalesce(F.contains(F.regexp_replace("entry", r"\s+", " "), F.concat(F.lit("by "), F.col("last_name"))) | F.regexp_extract("entry", r"(?s)\bby\b(.*)", 1).contains(F.col("last_name")), F.lit(False))
    hits = titled.withColumn("good", by).groupBy("book_id").agg(F.min(F.when(F.col("good"), F.col("entry_id"))).alias("good_id"), F.min("entry_id").alias("any_id"))
    kind = F.when(F.col("good_id").isNotNull(), "good").when(F.col("any_id").isNotNull(), "ugly").otherwise("bad")
    return wanted.join(hits, "book_id", "left").select("book_id", kind.alias("class"), F.coalesce("good_id", "any_id").alias("entry_id"), (~story).alias("blacklisted"))


def new_blacklist(classified: DataFrame, blacklist: DataFrame) -> DataFrame:
    return blacklist.select("book_id").union(classified.where("blacklisted OR class = 'bad'").select("book_id")).distinct()


def tally(classified: DataFrame) -> DataFrame:
    return classified.agg(*(F.count_if(F.col("class") == k).alias(k) for k in ("good", "bad", "ugly")))


def tag_features(occurrences: DataFrame, literal: bool = False) -> DataFrame:
    """Per name: mean share of its tokens tagged as persons or others, mean of the last token's tag, capitals, last capital.

    occurrences: book_id, gram_key, gram, ners (of its tokens). `avg_cap` is the number of
    capitalised tokens; with `literal`, `avg_last_ner` is 0 as nothing is summed for it.
    """
    named = lambda x: x.isin("PERSON", "MISC")
    share = F.size(F.filter("ners", named)) / F.size("ners")
    last = F.when(named(F.element_at("ners", -1)), 1.0).otherwise(0.0)
    per = occurrences.groupBy("book_id", "gram_key").agg(F.avg(share).alias("avg_ner"), F.avg(last).alias("avg_last_ner"), F.first("gram").alias("g"))
    ner = F.lit(0.0) if literal else F.col("avg_last_ner")
    return per.select("book_id", "gram_key", "avg_ner", ner.alias("avg_last_ner"), F.size(F.filter("g", has_capital)).alias("avg_cap"), F.when(has_capital(F.element_at("g", -1)), 1).otherwise(0).alias("avg_last_cap"))
