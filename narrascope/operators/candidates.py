"""Name candidates: noun-phrase walks, n-grams, longest matches, count filters."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope.functions.text import has_capital, is_the, synset_word
from narrascope.operators.frames import computed, saved, small

# Fixed values.
BAD_TITLES = ("Mr.", "Mr", "Mrs.", "Ms.", "Mrs", "Ms", "Miss")
BAD_TOKENS = ("Chapter", "CHAPTER", "PART", "said", ",", "''", "and", ";", "-RSB-", "-LSB-", "_", "--", "``", ".")
BAD_TAGS = ("CC", "IN", "TO", "WDT", "WP", "WP$", "WRB", "UH", "VB", "VBD", "VBP", "VBZ", "MD")

SENTENCE = ["book_id", "cp_id", "st_id"]


@dataclass(frozen=True)
class Cutoffs:
    """Per gram length: how many, and which percentage, of the most frequent grams stay; then limits for longer grams."""

    numbers: Sequence[int] = (100, 50, 50, 10, 10)
    percents: Sequence[int] = (30, 40, 40, 10, 10)
    least_count: int = 2
    share: float = 0.05
    longer_least: int = 3
    longer_number: int = 3
    longest: int = 7
    chapter_number: int = 5
    chapter_percent: int = 30
    chapter_least: int = 4
    chapter_share: float = 0.2


def lexicon(edges: DataFrame, root: str) -> DataFrame:
    """word: all that lie under root in (parent, child). Each round joins only what is new, so cycles end; rounds are tables in the shared folder."""
    edges = edges.select("parent", "child").distinct()
    known = fresh = saved(edges.where(F.col("parent") == root).select("child").distinct(), "lexicon")
    while not fresh.isEmpty():
        step = fresh.select(F.col("child").alias("parent")).join(edges, "parent").select("child").distinct()
        fresh = saved(step.join(known, "child", "left_anti"), "lexicon")
        known = known.union(fresh)
    return known.select(synset_word(F.col("child")).alias("word")).distinct()


def noun_phrases(tokens: DataFrame, persons: Sequence[str]) -> DataFrame:
    """Every emission of the noun-phrase walk: book_id, cp_id, st_id, head (place of the last word), gram.

    tokens has SENTENCE, tok_idx, word and pos. A head is a noun with a capital or from the
    lexicon. From it the walk goes left to the nearest bad tag, ending early at a bad token, and
    may hop over that one tag into the phrase before it. Sentences become arrays once; both walks
    are filters over ranges inside the row.
    """
    order = F.array_sort(F.collect_list(F.struct("tok_idx", "word", "pos")))
    return sentence_phrases(tokens.groupBy(*SENTENCE).agg(order.alias("t")), persons)


def sentence_phrases(sentences: DataFrame, persons: Sequence[str]) -> DataFrame:
    """The same from SENTENCE and `t`, each sentence's tokens as array<struct<word, pos, ...>>: no shuffle.

    A walk sees no further than the part between two bad places that holds its head, and over a
    bad tag the part before. Sentences are cut into such parts first, so a head costs no walk over
    its whole sentence and no copy of it. What is asked of a token is a bit of its flag.
    """
    tag, bad, opens, the, cap, noun, person = (1 << i for i in range(7))
    has = lambda x, bit: x.bitwiseAND(F.lit(bit)) != 0
    is_head = lambda x: has(x, noun) & has(x, cap | person)
    named = lambda x: F.when(x["word"].isin(list(BAD_TITLES)), 0).when(x["word"].isin(list(persons)), noun | person).otherwise(noun)
    kind = lambda x: F.when(x["pos"].isin(list(BAD_TAGS)), tag | bad).when(x["word"].isin(list(BAD_TOKENS)), bad).otherwise(F.when(is_the(x["word"]), opens | the).otherwise(0).bitwiseOR(F.when(x["pos"].startswith("NN"), named(x).bitwiseOR(F.lit(opens))).otherwise(0)))
    flags = F.transform("t", lambda x: kind(x).bitwiseOR(F.when(has_capital(x["word"]), cap).otherwise(0)))
    places = lambda of, test: F.filter(F.transform(of, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())
    marked = computed(sentences.select(*SENTENCE, "t"), f=flags).where(F.exists("f", is_head))
    edged = computed(marked, e=F.concat(F.array(F.lit(-1)), places(F.col("f"), lambda x, i: has(x, bad)), F.array(F.size("f"))), w=F.transform("t", lambda x: x["word"])).drop("t")
    edge = lambda k: F.get(F.col("e"), k)
    filled = F.filter(F.sequence(F.lit(0), F.size("e") - 2), lambda k: edge(k + 1) - edge(k) > 1)
    # each part with the one before it: where that begins, the part's own first place from there, flags and words of both
    begin = lambda k: F.when(k > 0, edge(k - 1) + 1).otherwise(0)
    cut = lambda name, k: F.slice(name, begin(k) + 1, edge(k + 1) - begin(k)).alias(name)
    parts = edged.select(*SENTENCE, F.inline(F.transform(filled, lambda k: F.struct(begin(k).alias("begin"), (edge(k) + 1 - begin(k)).alias("own"), cut("f", k), cut("w", k)))))
    parts = parts.where(F.exists(F.slice("f", F.col("own") + 1, F.size("f")), is_head))
    at = lambda i: F.get(F.col("f"), i)
    start = lambda x, i: F.when(has(x, opens), F.struct(i.alias("i"), (i >= F.col("own")).alias("inside"), has(x, the).alias("the"), ((i > 0) & ~has(F.coalesce(at(i - 1), F.lit(cap)), cap)).alias("after")))
    walked = computed(
        parts,
        heads=F.filter(F.transform("f", lambda x, i: F.when((i >= F.col("own")) & is_head(x), F.struct(i.alias("h"), has(x, cap).alias("capital")))), lambda x: x.isNotNull()),
        starts=F.filter(F.transform("f", start), lambda x: x.isNotNull()),
        hop=has(F.coalesce(at(F.col("own") - 1), F.lit(0)), tag),
    )
    headed = walked.select(*SENTENCE, "begin", "w", "starts", "hop", F.inline("heads"))
    fits = lambda x: F.when(F.col("capital"), F.when(x["inside"], x["after"] & (x["i"] <= F.col("h"))).otherwise(F.col("hop"))).otherwise(x["inside"] & ((x["i"] < F.col("h")) | ((x["i"] == F.col("h")) & x["the"])))
    found = headed.select(*SENTENCE, "begin", "h", "w", F.explode(F.transform(F.filter("starts", fits), lambda x: x["i"])).alias("s"))
    return found.select(*SENTENCE, (F.col("begin") + F.col("h")).alias("head"), F.slice("w", F.col("s") + 1, F.col("h") - F.col("s") + 1).alias("gram"))


def grams(tokens: DataFrame, most: int) -> DataFrame:
    """All windows of 1 to `most` words inside a sentence: SENTENCE, pg_id, tok_idx (of the last word), n, gram_key."""
    keys = [*SENTENCE, "pg_id"]
    s = tokens.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "word"))), lambda x: x["word"]).alias("w"))
    return windows(s, keys, most)


def windows(sentences: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The same from sentences with their words as an array `w`."""
    size = F.size("w")
    ending = lambda e, n: F.struct((e - 1).cast("int").alias("tok_idx"), n.alias("n"), F.array_join(F.slice("w", e - n + 1, n), " ").alias("gram_key"))
    found = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda e: F.transform(F.sequence(F.lit(1), F.least(e, F.lit(most))), lambda n: ending(e, n))))
    return sentences.where(size > 0).select(*keys, F.inline(found))  # built in the row: the words are not copied to every gram


def longest_suffix_counts(found: DataFrame, candidates: DataFrame) -> DataFrame:
    """book_id, cp_id, gram_key, n: at every token only the longest candidate that ends there counts.

    The place is a row of `grams`; the longest is one grouped maximum, which combines before the shuffle.
    """
    hits = found.join(small(candidates.select("book_id", "gram_key").distinct()), ["book_id", "gram_key"])
    longest = hits.groupBy(*SENTENCE, "tok_idx").agg(F.max_by("gram_key", "n").alias("gram_key"))
    return longest.groupBy("book_id", "cp_id", "gram_key").agg(F.count("*").alias("n"))


def two_sided(found: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates that are the longest match ending at some token and the longest match starting at some token."""
    hits = found.join(small(candidates.select("book_id", "gram_key").distinct()), ["book_id", "gram_key"]).withColumn("start", F.col("tok_idx") - F.col("n") + 1)
    ending = hits.groupBy(*SENTENCE, "tok_idx").agg(F.max_by("gram_key", "n").alias("gram_key")).select("book_id", "gram_key")
    starting = hits.groupBy(*SENTENCE, "start").agg(F.max_by("gram_key", "n").alias("gram_key")).select("book_id", "gram_key")
    return ending.intersect(starting)


def dropped(candidates: DataFrame, kept: DataFrame) -> DataFrame:
    return candidates.join(kept, ["book_id", "gram_key"], "left_anti")


def by_length(values: Sequence[int], size: Column, beyond: int) -> Column:
    out = F.lit(beyond)
    for i, v in reversed(list(enumerate(values, 1))):
        out = F.when(size == i, v).otherwise(out)
    return out


def best(rows: DataFrame, numbers: Sequence[int], beyond: int) -> DataFrame:
    """Rows whose rank `r` is within their length's number. The constant bound lets each task keep only its best rows before the shuffle."""
    return rows.where((F.col("r") <= max([*numbers, beyond])) & (F.col("r") <= by_length(numbers, F.col("length"), beyond))).drop("r")


def ranked(counts: DataFrame, keys: list[str], most: int, sizes: DataFrame | None = None) -> DataFrame:
    """The `most` best rows of each group of counts(…, gram_key, n), with rank (n descending, then gram_key), group size and share of the group's sum.

    The constant bound lets each task keep only its best rows before the shuffle; sizes and sums are
    aggregates, or given (keys, rows, all_n).
    """
    best_first = Window.partitionBy(*keys).orderBy(F.desc("n"), "gram_key")
    sizes = counts.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum("n").alias("all_n")) if sizes is None else sizes
    top = counts.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= most)
    return top.join(sizes, keys).withColumn("share", F.col("n") / F.col("all_n")).drop("all_n")


def percent_filter(counts: DataFrame, c: Cutoffs = Cutoffs(), sizes: DataFrame | None = None) -> DataFrame:
    """Book-level filter by percentages: counts has book_id, gram_key, length, n.

    Up to the given lengths: the top percentage (the whole list when it makes less than one) with
    a count above `least_count`, and all with a large share; of these the given number. Longer
    grams need a count above `longer_least` or a large share, and `longer_number` stay. All these
    conditions hold for a first part of the ranking, so no row beyond the number is ever needed:
    with `sizes` (book_id, length, rows, all_n), counts may lack them, and `rows` may be any
    number from `rows_needed` upwards where it is not less.
    """
    r = ranked(counts.where(F.col("length") <= c.longest), ["book_id", "length"], max([*c.numbers, c.longer_number]), sizes)
    k = F.floor(by_length(c.percents, F.col("length"), 100) * F.col("rows") / 100)
    top = (k == 0) | (F.col("rank") <= k)
    inside = F.col("length") <= len(c.percents)
    good = F.when(inside, (top & (F.col("n") > c.least_count)) | (F.col("share") > c.share)).otherwise((F.col("n") > c.longer_least) | (F.col("share") > c.share))
    return best(r.where(good).select("book_id", "gram_key", "length", "n", F.col("rank").alias("r")), c.numbers, c.longer_number)


def rows_needed(c: Cutoffs = Cutoffs()) -> int:
    """From so many rows of a book and length on, the percentages are above the numbers."""
    return max(math.ceil(100 * (n + 1) / p) for n, p in zip(c.numbers, c.percents))


def flex_filter(counts: DataFrame, numbers: Sequence[int] | None = None, least: int = 2) -> DataFrame:
    """Book-level filter without percentages: a count above `least`, and the given number per length; nothing without numbers."""
    if numbers is None:
        return counts.limit(0)
    w = Window.partitionBy("book_id", "length").orderBy(F.desc("n"), "gram_key")
    return best(counts.where(F.col("n") > least).withColumn("r", F.row_number().over(w)), numbers, 0)


def chapter_filter(chapter_counts: DataFrame, book_counts: DataFrame, c: Cutoffs = Cutoffs(), mode: str = "percent", literal: bool = False) -> DataFrame:
    """Grams that stand out in some chapter.

    `flex`: a chapter count above `chapter_least`. `percent`: among the top percentage of their
    chapter with a count above 3 or of a large share, the best `chapter_number`. `literal`: a
    large share alone, with the chapter's count in place of the book's.
    """
    book = book_counts.select("book_id", "gram_key", "length", F.col("n").alias("book_n"))
    if mode == "flex":
        found = chapter_counts.where(F.col("n") > c.chapter_least)
    else:
        # of shares above s there are less than 1 / s in a chapter
        r = ranked(chapter_counts, ["book_id", "cp_id"], max(c.chapter_number, math.ceil(1 / c.chapter_share)))
        k = F.floor(c.chapter_percent * F.col("rows") / 100)
        large = F.col("share") > c.chapter_share
        if literal:
            return r.where(large).join(book, ["book_id", "gram_key"]).groupBy("book_id", "gram_key", "length").agg(F.max("n").alias("n"))
        found = r.where(((((k == 0) | (F.col("rank") <= k)) & (F.col("n") > 3)) | large) & (F.col("rank") <= c.chapter_number))
    return found.select("book_id", "gram_key").distinct().join(book, ["book_id", "gram_key"]).select("book_id", "gram_key", "length", F.col("book_n").alias("n"))


def base_features(candidates: DataFrame, stats: DataFrame) -> DataFrame:
    """count, length, book sizes and the count normalised by book length and by all candidates' counts."""
    total = F.sum("n").over(Window.partitionBy("book_id"))
    return candidates.join(stats, "book_id").select("book_id", "gram_key", F.col("n").alias("count"), "length", *[c for c in stats.columns if c != "book_id"], (F.col("n") / F.col("book_num_chars")).alias("count_norm_length"), (F.col("n") / total).alias("count_norm_char"))


def from_labels(labels: DataFrame, found: DataFrame, stats: DataFrame) -> DataFrame:
    """Base features of the candidates labelled 1, recounted."""
    positive = labels.where("label = 1").select("book_id", "gram_key").distinct()
    counts = longest_suffix_counts(found, positive).groupBy("book_id", "gram_key").agg(F.sum("n").alias("n"))
    return base_features(counts.withColumn("length", F.size(F.split("gram_key", " "))), stats)
