"""Tokens, sections, rule tags.

`tokenize` turns texts into a token table with sentence, paragraph and chapter numbers by splitting
inside the row (chapter, paragraph, sentence, token), so no window and no shuffle is needed.
`sections` numbers sections of imported token streams from the newlines before each token.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Titles with a full stop, possessive marks, words and numbers, single signs.
TOKEN = r"(?:Mr|Mrs|Ms|Dr|Prof|Jr)\.|'s|[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
#: A sentence ends after a full stop and blanks; `\x01` marks the place.
_END = r"\.[ \t]+"
_TITLE = r"\b(Mr|Mrs|Ms|Dr|Prof|Jr)\. "

# Closed word classes of the rule tagger. It stands in for an external tagger.
TAGS = {
    "DT": ("the", "a", "an", "this", "that", "these", "those", "la", "le", "les", "der", "die", "das", "el"),
    "IN": ("of", "in", "on", "by", "for", "with", "from", "at", "as", "de", "en", "von"),
    "CC": ("and", "or", "but", "et", "und", "y"),
    "TO": ("to",),
    "PRP": ("he", "she", "it", "you", "they", "we", "i", "him", "her", "them"),
    "VBD": ("was", "were", "said", "had", "did"),
    "VBZ": ("is", "has", "does"),
    "VBP": ("are", "be", "have"),
    "WDT": ("which", "what", "who"),
}
PERSONS = ("helmsman", "captain", "doctor", "king", "queen", "boy", "girl", "man", "woman", "thing")


def tag_sql(word: str = "word", like: str = "regexp_like") -> str:
    """The tagger as a CASE expression that both Spark and other SQL engines read."""
    closed = " ".join(f"WHEN lower({word}) IN ({', '.join(repr(w) for w in words)}) THEN '{tag}'" for tag, words in TAGS.items())
    return (
        f"CASE {closed} WHEN NOT {like}({word}, '[0-9A-Za-z]') AND lower({word}) = upper({word}) THEN {word} WHEN {like}({word}, '^[0-9]+$') THEN 'CD' "
        f"WHEN substr({word}, 1, 1) <> lower(substr({word}, 1, 1)) THEN 'NNP' WHEN {word} LIKE '%ing' THEN 'VBG' WHEN {word} LIKE '%ed' THEN 'VBN' WHEN {word} LIKE '%ly' THEN 'RB' ELSE 'NN' END"
    )


def tag_fast(word: str) -> str:
    """The same for Spark: one look-up in the set of all closed words (a list of this length is hashed) comes before the lists of each class."""
    every = ", ".join(repr(w) for words in TAGS.values() for w in words)
    whole = tag_sql(word)
    rest = whole.index("WHEN NOT ")
    return f"CASE WHEN lower({word}) IN ({every}) THEN {whole[:rest]} END {whole[rest:]}"


def tag(word: str = "word") -> Column:
    return F.expr(tag_fast(word))


def ner(word: Column, previous: Column, persons: tuple[str, ...] = PERSONS) -> Column:
    """PERSON after a title or for a known person word, MISC for other capitalised words inside a sentence, else O."""
    titled = previous.isin("Mr.", "Mrs.", "Ms.", "Dr.", "Miss", "Prof.")
    return F.when(titled | F.lower(word).isin(*persons), "PERSON").when(word.rlike(r"^\p{Lu}") & previous.isNotNull(), "MISC").otherwise("O")


def sentence_words(docs: DataFrame, book: str = "source", chapter: str = "doc_id", text: str = "text", pg_newlines: int = 1) -> DataFrame:
    """book_id, cp_id, pg_id, st_id and the sentence's words `w`, one row a sentence, made inside the row.

    A chapter is a row; paragraphs are parted by `pg_newlines` newlines or more; a sentence ends
    with a full stop and blanks (but not after a title), or with its paragraph. Null and blank
    texts give no sentences.
    """
    paragraphs = docs.select(F.col(book).alias("book_id"), F.col(chapter).alias("cp_id"), F.posexplode(F.split(text, "\n" * (pg_newlines - 1) + "\n+")).alias("pg_id", "pg"))
    marked = F.regexp_replace(F.regexp_replace("pg", _TITLE, "$1.\x02"), _END, ".\x01")
    sentences = paragraphs.select("book_id", "cp_id", "pg_id", F.posexplode(F.split(marked, "\x01")).alias("st", "s"))
    words = F.regexp_extract_all(F.replace(F.col("s"), F.lit("\x02"), F.lit(" ")), F.lit(TOKEN), F.lit(0))
    # whatever is no blank is part of a word; a test of the words themselves would find them twice
    return sentences.where(F.col("s").rlike("[^\\s\x02]")).select("book_id", "cp_id", "pg_id", F.concat_ws("-", "pg_id", "st").alias("st_id"), words.alias("w"))


def tokenize(docs: DataFrame, **options) -> DataFrame:
    """The same, one row a token: book_id, cp_id, pg_id, st_id, tok_idx (within the sentence), word."""
    return sentence_words(docs, **options).select("book_id", "cp_id", "pg_id", "st_id", F.posexplode("w").alias("tok_idx", "word"))


def sections(tokens: DataFrame, pg_newlines: int = 2, cp_newlines: int = 3) -> DataFrame:
    """tokens(book_id, sent_id, tok_idx, begin, nl_before, ...) with st_id, pg_id and cp_id, numbered from 1.

    A paragraph begins at a book's first token and after `pg_newlines` newlines or more, a chapter
    after `cp_newlines` or more. One sort by book serves all three running sums.
    """
    order = Window.partitionBy("book_id").orderBy("begin").rowsBetween(Window.unboundedPreceding, 0)
    opening = F.row_number().over(Window.partitionBy("book_id").orderBy("begin")) == 1
    begins = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(order)
    marked = tokens.withColumn("opening", opening)
    pg = F.col("opening") | (F.col("nl_before") >= pg_newlines)
    cp = F.col("opening") | ((F.col("nl_before") >= cp_newlines) & (F.col("nl_before") >= pg_newlines))
    return marked.select(*tokens.columns, begins(F.col("tok_idx") == 0).alias("st_id"), begins(pg).alias("pg_id"), begins(cp).alias("cp_id"))


def book_stats(sectioned: DataFrame) -> DataFrame:
    """book_num_chars (the begin of the last sentence) and the numbers of sentences, paragraphs and chapters."""
    return sectioned.groupBy("book_id").agg(
        F.max(F.when(F.col("tok_idx") == 0, F.col("begin"))).alias("book_num_chars"), F.max("st_id").alias("book_num_st"), F.max("pg_id").alias("book_num_pg"), F.max("cp_id").alias("book_num_cp")
    )


def complete(sectioned: DataFrame, lines: DataFrame) -> DataFrame:
    """Books whose token lines and section tokens differ in number: none if the alignment is complete."""
    a, b = sectioned.groupBy("book_id").agg(F.count("*").alias("n_tokens")), lines.groupBy("book_id").agg(F.count("*").alias("n_lines"))
    return a.join(b, "book_id", "full_outer").where("coalesce(n_tokens, 0) <> coalesce(n_lines, 0)")


def aligned(words: list[str], lines: list[str], newline: str = "*NL*") -> list[tuple[int, int]]:
    """Of each word, the number of newline lines passed over to reach it, and the line that holds it.

    Lines are passed over until one is the word, or until the word is part of what the passed
    lines make up together: the annotator has then cut a line in several words, or joined
    several. Ends early where no line is left.
    """
    out, at = [], 0
    for word in words:
        newlines, passed = 0, ""
        while at < len(lines) and lines[at] != word and word not in passed:
            newlines += lines[at] == newline
            passed += "" if lines[at] == newline else lines[at]
            at += 1
        whole = at < len(lines) and lines[at] == word
        if not whole and word not in passed:
            break
        out.append((newlines, at if whole else at - 1))
        at += whole
    return out


def align(tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """tokens(book_id, pos, word) with nl_before and line from lines(book_id, line, text); books are walked in parallel, and words after a failed one have nulls.

    A null word or line is an empty one. Both tables are sorted by book and place and streamed to
    one walk a book.
    """
    kind = tokens.schema["book_id"].dataType.simpleString()

    def one(t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("pos")
        found = aligned(t["word"].fillna("").tolist(), s.sort_values("line")["text"].fillna("").tolist())
        rest = [None] * (len(t) - len(found))
        return t.assign(nl_before=pd.array([*(n for n, _ in found), *rest], "Int64"), line=pd.array([*(x for _, x in found), *rest], "Int64"))

    sides = tokens.select("book_id", F.col("pos").cast("bigint").alias("pos"), "word").groupBy("book_id"), lines.select("book_id", F.col("line").cast("bigint").alias("line"), "text").groupBy("book_id")
    return sides[0].cogroup(sides[1]).applyInPandas(one, f"book_id {kind}, pos bigint, word string, nl_before bigint, line bigint")


def _aligned_alike(words: pa.ListArray, lines: pa.ListArray, newline: str = "*NL*") -> tuple[pa.Array, pa.Array] | None:
    """What `aligned` gives for rows whose lines, but for newlines, are their words, none of them empty; None if some row is not of that kind."""
    size = lambda x: pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    n_words, n_lines, flat = size(words), size(lines), lines.flatten()
    if words.null_count or lines.null_count or flat.null_count:
        return None
    kept = pc.not_equal(flat, newline)
    held = flat.filter(kept)
    row = np.repeat(np.arange(len(n_lines)), n_lines)[kept.to_numpy(zero_copy_only=False)]
    if not held.equals(words.flatten()) or not np.array_equal(np.bincount(row, minlength=len(n_words)), n_words) or pc.any(pc.equal(held, "")).as_py():
        return None
    place = np.flatnonzero(kept.to_numpy(zero_copy_only=False)) - (np.cumsum(n_lines) - n_lines)[row]
    before = np.r_[-1, place[:-1]] if len(place) else place
    before[np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []] = -1
    offsets = pa.array(np.r_[0, np.cumsum(n_words)].astype(np.int32))
    return tuple(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (place - before - 1, place))


def aligned_rows(docs: DataFrame) -> DataFrame:
    """`align` for documents that hold their words and lines: docs(book_id, words, lines) with nl_before and line as arrays of the words' length, a row a document and no shuffle."""
    conf = docs.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(2000, int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))))
    kind = docs.schema["book_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            alike = _aligned_alike(batch["words"], batch["lines"])
            if alike:
                yield pa.RecordBatch.from_arrays([batch["book_id"], *alike], ["book_id", "nl_before", "line"])
                continue
            newlines, places = [], []
            for words, lines in zip(batch["words"], batch["lines"]):
                words, lines = ([x or "" for x in side.as_py() or []] for side in (words, lines))
                found = aligned(words, lines)
                rest = [None] * (len(words) - len(found))
                newlines.append([*(n for n, _ in found), *rest])
                places.append([*(x for _, x in found), *rest])
            whole = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["book_id"], pa.array(newlines, whole), pa.array(places, whole)], ["book_id", "nl_before", "line"])

    return docs.select("book_id", "words", "lines").mapInArrow(run, f"book_id {kind}, nl_before array<bigint>, line array<bigint>")


def newline_lines(text: Column) -> Column:
    """Tokens of a text, a line each, with a line for every newline."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"\n|{TOKEN}"), F.lit(0)), lambda x: F.when(x == "\n", "*NL*").otherwise(x))


def newline_tokens(text: Column) -> Column:
    """array<struct<word, nl_before, begin>>: tokens with the newlines before them and their offsets."""
    pieces = F.regexp_extract_all(text, F.lit(rf"\n|{TOKEN}|[^\S\n]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("nl"), F.array().cast("array<struct<word:string,nl_before:int,begin:int>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        word = F.trim(p) != ""
        found = F.array(F.struct(p.alias("word"), s["nl"].alias("nl_before"), s["at"].alias("begin")))
        return F.struct(
            (s["at"] + F.length(p)).alias("at"),
            F.when(p == "\n", s["nl"] + 1).when(p.rlike(r"^\s+$"), s["nl"]).otherwise(0).alias("nl"),
            F.when(word & ~p.rlike(r"^\s+$"), F.concat(s["out"], found)).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(pieces, start, step)["out"]


def as_of_sections(tokens: DataFrame, markers: DataFrame) -> DataFrame:
    """tokens(book_id, begin) with the number of the last marker (book_id, marker, begin) at or before them.

    One union and one running maximum by book; no range join.
    """
    both = tokens.select("book_id", "begin", F.lit(None).cast("int").alias("marker"), F.lit(True).alias("is_token")).unionByName(markers.select("book_id", "begin", F.col("marker").cast("int"), F.lit(False).alias("is_token")))
    order = Window.partitionBy("book_id").orderBy("begin", "is_token").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("section_id", F.last("marker", True).over(order)).where("is_token").select("book_id", "begin", "section_id")
