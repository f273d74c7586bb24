"""License scans by diagonal voting.

All rolling word k-gram hashes of a document are joined to the positions of the same hashes in
the templates. A shared passage puts its matches on one diagonal (document position less template
position); the template words that a diagonal's matches cover are bits of a mask. Neighbouring
diagonals (where words were inserted or left out) are merged, and a merged span, or else its best
single diagonal, is accepted when it covers enough distinct words of the template within a span
of about its length. Short phrases are templates too: they count only when a single diagonal
covers all of their words.

Before the join a bitmap of template hashes drops k-grams that no template has, as a runtime
filter would, and what passes it is compared word by word, so a hash never decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrascope.llm.shared import small_batches
from narrascope.llm.textkernel import ALPHANUMERIC, U, Words, grams, hash_word_list, slices, text_bytes, trimmed

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Public licence notices and the labels that a passage of them gets.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "apache-2.0-short": "licensed under the apache license version 2.0",
    "gpl-3.0": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-3.0-short": "licensed under the gnu general public license version 3",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "bsd-3-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "licensed under cc by nc 4.0",
    "cc-by-4.0": "licensed under cc by 4.0",
    "cc-by-sa-4.0": "licensed under cc by sa 4.0",
}
PHRASE_K, NOTICE_K = 2, 3
LEAST_COVERAGE, SHIFT, STRETCH = 0.7, 3, 1.5
_BITS = 20


def templates() -> list[tuple[int, str, bool, list[bytes]]]:
    """(number, label, whether a phrase, words) of every template; 0 is the end mark that every text has."""
    texts = [(t, label, True) for t, label in PHRASES.items()] + [(t, label.removesuffix("-short"), False) for label, t in NOTICES.items()]

    def words(text: str) -> list[bytes]:
        split = Words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), ALPHANUMERIC)
        return split.lowered(0, len(split))

    return [(number, label, phrase, words(text)) for number, (text, label, phrase) in enumerate(texts, 1)]


END = int(hash_word_list([b"end of text"])[0].view(np.int64))
_MASK = 60  # template words a mask column holds


def gram_rows() -> tuple[list[tuple], dict[int, set[bytes]]]:
    """(template, label, phrase, words, hash, position, masks of the words covered) of every k-gram of every template, and the k-grams by k."""
    known = templates()
    columns = -(-max(len(words) for *_, words in known) // _MASK)
    rows, texts = [(0, "", False, 0, END, 0, *[0] * columns)], {PHRASE_K: set(), NOTICE_K: set()}
    for number, label, phrase, words in known:
        k = PHRASE_K if phrase else NOTICE_K
        hashes = (grams(hash_word_list(words), k) + U(k)).view(np.int64).tolist()
        for at, h in enumerate(hashes):
            covered = range(at, at + k)
            rows.append((number, label, phrase, len(words), h, at, *(sum(1 << (w - b * _MASK) for w in covered if w // _MASK == b) for b in range(columns))))
            texts[k].add(b" ".join(words[at : at + k]))
    return rows, texts


def _rolling(known: list[int], exact: dict[int, set[bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = U((1 << _BITS) - 1)
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[(np.array(known, np.int64).view(np.uint64) & mask).astype(np.int64)] = True
        number = TaskContext.get().partitionId() << 40  # with a running number: a key of each row
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(*text_bytes(batch.column(batch.schema.get_field_index("text"))), ALPHANUMERIC)
                h = words.hashes()
                n = batch.num_rows
                owner = np.repeat(np.arange(n), words.counts)
                rows, places, values = [np.arange(n)], [words.counts], [np.full(n, END)]
                for k in (PHRASE_K, NOTICE_K):
                    g = grams(h, k) + U(k)
                    at = np.flatnonzero(bitmap[(g & mask).astype(np.int64)])
                    at = at[owner[at] == owner[at + k - 1]] if len(at) else at
                    at = at[[b" ".join(words.lowered(i, i + k)) in exact[k] for i in at.tolist()]] if len(at) else at
                    rows.append(owner[at])
                    places.append(at - words.first[owner[at]])
                    values.append(g[at].view(np.int64))
                row = np.concatenate(rows)
                order = np.argsort(row, kind="stable")
                offsets = pa.array(np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32))
                listed = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x[order]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number + np.arange(n)), batch.column(batch.schema.get_field_index("doc_id")), listed(np.concatenate(places).astype(np.int64)), listed(np.concatenate(values))], names=["row", "doc_id", "places", "hashes"]
                )
                number += n

    return run


def license_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Accepted spans: row (a number of the input row), doc_id, template, label, phrase, first_word, last_word, coverage; and one row of template 0 per input row, with `last_word` its number of words.

    A null or empty text has no words and no spans. Each row is scanned by itself, so repeated
    rows and null ids don't matter; a very long text is scanned as a whole; other columns are
    ignored; an empty table gives no rows.
    """
    rows, exact = gram_rows()
    masks = [f"mask{i}" for i in range(len(rows[0]) - 6)]
    fixed = docs.sparkSession.createDataFrame(rows, "template int, label string, phrase boolean, size int, hash bigint, at bigint, " + ", ".join(f"{m} bigint" for m in masks))  # a constant table
    rolled = small_batches(docs).select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(trimmed(_rolling([r[4] for r in rows[1:]], exact)), "row bigint, doc_id bigint, places array<bigint>, hashes array<bigint>")
    each = rolled.select("row", "doc_id", F.explode(F.arrays_zip("places", "hashes")).alias("g")).select("row", "doc_id", F.col("g.places").alias("place"), F.col("g.hashes").alias("hash"))
    votes = each.join(F.broadcast(fixed), "hash").withColumn("diagonal", F.col("place") - F.col("at"))
    kind = ["row", "doc_id", "template", "label", "phrase", "size"]
    k = F.when(F.col("phrase"), PHRASE_K).otherwise(NOTICE_K)
    lines = votes.repartition("row").groupBy(*kind, "diagonal").agg(*(F.bit_or(m).alias(m) for m in masks), F.min("place").alias("low"), F.max(F.when(F.col("template") > 0, F.col("place") + k - 1).otherwise(F.col("place"))).alias("high"))
    covered = sum((F.bit_count(m) for m in masks), F.lit(0)) / F.greatest("size", F.lit(1))
    # phrases and end marks stand alone; the diagonals of notices merge with close ones
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.when(F.col("phrase") | (F.col("template") == 0) | (F.col("diagonal") - F.lag("diagonal").over(order) > SHIFT), 1).otherwise(0)
    group = lines.withColumn("new", new).withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    alone = F.struct(covered.alias("coverage"), -F.col("low"), F.col("low"), F.col("high"))
    spans = group.groupBy(*kind, "part").agg(*(F.bit_or(m).alias(m) for m in masks), F.min("low").alias("low"), F.max("high").alias("high"), F.max(alone).alias("best"))
    close = F.col("high") - F.col("low") < STRETCH * F.col("size")
    found = spans.withColumn("span", F.when((F.col("template") == 0) | close, F.struct(covered.alias("coverage"), "low", "high")).otherwise(F.struct("best.coverage", "best.low", "best.high")))
    good = (F.col("template") == 0) | (F.col("span.coverage") >= F.when(F.col("phrase"), 1.0).otherwise(LEAST_COVERAGE))
    return found.where(good).select(*kind[:-1], F.col("span.low").alias("first_word"), F.col("span.high").alias("last_word"), F.when(F.col("template") > 0, F.col("span.coverage")).alias("coverage"))


def op9_license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs; repeated rows get equal results, a null or empty text has no words, other columns are ignored, an empty table gives no rows."""
    spans = license_spans(docs)
    text, base, found = F.col("template") == 0, F.col("phrase"), F.col("template") > 0
    joined = lambda flag: F.array_join(F.array_sort(F.collect_set(F.when(flag, F.col("label")))), ",")
    each = spans.groupBy("row", "doc_id").agg(
        F.max(F.when(text, F.col("last_word"))).alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(found).alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
    )
    return each.drop("row")
