"""The steps of a whole run, by name, as functions from DataFrames to DataFrames.

collect: crossref, tokenize, sections, candidates; label: descriptions, relations, label_candidates,
label_pairs; features: char_features, pair_features; learning: split_books, training_frame, train;
evaluate: evaluate, baseline_characters, baseline_pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.functions.text import html_blocks
from narrascope.operators import candidates as _c
from narrascope.operators.crossref import crossref
from narrascope.operators.labels import candidate_labels as label_candidates
from narrascope.operators.labels import match_edges, matching
from narrascope.operators.labels import pair_labels as label_pairs
from narrascope.operators.learning import baseline_characters, baseline_pairs, evaluate, split_books, train, training_frame
from narrascope.operators.relations import from_descriptions as relations
from narrascope.operators.tokens import PERSONS, sections, sentence_words, tag_sql, tokenize
from narrascope.plans.features import character_features as char_features
from narrascope.plans.features import pair_features

__all__ = [
    "baseline_characters", "baseline_pairs", "candidates", "char_features", "crossref", "descriptions", "evaluate", "label_candidates", "label_pairs", "match_edges", "matching",
    "pair_features", "relations", "sections", "split_books", "tokenize", "train", "training_frame",
]


def candidates(docs: DataFrame, cutoffs: _c.Cutoffs = _c.Cutoffs(), persons: Sequence[str] = PERSONS, **columns: str) -> DataFrame:
    """Name candidates of all books: noun phrases, kept if longest on both sides, recounted, filtered by book and by chapter."""
    sentences = sentence_words(docs, **columns)
    tagged = sentences.select(*_c.SENTENCE, F.expr(f"transform(w, x -> named_struct('word', x, 'pos', {tag_sql('x')}))").alias("t"))
    found = _c.sentence_phrases(tagged, persons).where(F.size("gram") <= cutoffs.longest).select("book_id", F.array_join("gram", " ").alias("gram_key")).distinct()
    grams = _c.windows(sentences, [*_c.SENTENCE, "pg_id"], cutoffs.longest)
    chapter = _c.longest_suffix_counts(grams, _c.two_sided(grams, found))
    book = chapter.groupBy("book_id", "gram_key").agg(F.sum("n").alias("n")).withColumn("length", F.size(F.split("gram_key", " ")))
    return _c.percent_filter(book, cutoffs).unionByName(_c.chapter_filter(chapter, book, cutoffs)).distinct()


def descriptions(pages: DataFrame, block: str, page: str = "page_id", html: str = "html") -> DataFrame:
    """book_id, ord, character, text: the description blocks of pages, in page order."""
    return pages.select(F.col(page).alias("book_id"), F.posexplode(html_blocks(F.col(html), block)).alias("ord", "b")).select("book_id", "ord", F.col("b.id").alias("character"), F.col("b.text").alias("text"))
