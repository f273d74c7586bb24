"""A corpus from raw documents to token shards, in five stages.

Each stage takes (spark, docs, folder of the tables) and works on all that its predecessor kept;
the result is written as Parquet and read again as the next one's docs. All but the last return
the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from narrascope.llm import decontaminate, langid, mixing, near_dedup, token_output
from narrascope.llm.shared import saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language can't be told go; a null lang becomes the language found.

    Null, empty and letterless texts go; repeated rows, null ids and very long texts are treated
    like others; columns other than those of `documents` are left out; an empty table stays empty.
    """
    return langid.keep_identified(docs.select(COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies (five words a shingle, similarity 0.8) stays, that with the smallest doc_id.

    Of rows that share that id, the one whose text has the smallest MD5 stays; rows with other
    texts under the same id stay if they are in another group. Rows with a null id or without
    words are no one's copies and stay. Very long texts are compared as a whole; an empty table
    stays empty.
    """
    return near_dedup.without_copies(docs.select(COLUMNS), words=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Passages of ten benchmark words or more are cut out; documents that are mostly such passages go.

    Null and empty texts stay as they are; repeated rows and null ids are treated like others; a
    very long text is cut like any other; an empty table on either side works.
    """
    return decontaminate.remove_contamination(docs.select(COLUMNS), table(spark, folder, "benchmark"), length_column="n_chars")


def source_mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents are repeated, or left out, so that sources get their target weights, in a global random order.

    Null sources are one source; rows that repeat an id get equal counts; a null id draws by its
    text; null, empty and very long texts count like others; an empty table stays empty.
    """
    return mixing.replicated(docs.select(COLUMNS)).select(COLUMNS)


def token_shards(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token shards in the order in which mixing has written its files; returned are the digests read back from them.

    A null or empty text is its end id alone; repeated rows and null ids each count; a very long
    text is encoded as a whole; an empty table gives no rows.
    """
    return token_output.op10_token_output(docs.select(COLUMNS), ordered=False)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_shards),
]

#: Language ID and tokenization have no SQL; tests hold run() against a brute-force version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
