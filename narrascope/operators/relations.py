"""Relations from character descriptions.

paragraphs (book_id, paragraph_id, heading, text) describe the characters that the heading names.
Mentions of other characters in a paragraph's sentences give relations to its owners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrascope.functions import matching as m
from narrascope.functions.text import FAMILY_WORDS, nickname_references, normalized, split_characters
from narrascope.operators.frames import small
from narrascope.operators.tokens import TOKEN

#: First words of references that are broadcast, of some tens of bytes each.
HEADS = 1_000_000


def owners(paragraphs: DataFrame) -> DataFrame:
    """(book_id, paragraph_id, character) of the headings' names."""
    return paragraphs.select("book_id", "paragraph_id", F.explode(split_characters(normalized(F.col("heading")))).alias("character"))


def references(owned: DataFrame) -> DataFrame:
    """(book_id, reference, character): each name and its nickname forms; of characters that share one, the last paragraph's."""
    each = owned.select("book_id", "paragraph_id", "character", F.explode(F.array_append(nickname_references(F.col("character")), F.col("character"))).alias("reference"))
    return each.groupBy("book_id", "reference").agg(F.max_by("character", F.struct("paragraph_id", "character")).alias("character"))


def families(owned: DataFrame) -> DataFrame:
    """(book_id, reference, character) for `the X family` and the like, and `the Xs`: each points to all characters of that last name."""
    last = F.element_at(F.split("character", r"\s+"), -1)
    named = owned.select("book_id", "character", last.alias("last")).where(F.col("last").rlike("^[A-Z]")).distinct()
    forms = [F.concat_ws(" ", F.lit(the), F.col("last"), F.lit(word)) for the in ("the", "The") for word in FAMILY_WORDS] + [F.concat(F.lit(the + " "), F.col("last"), F.lit("s")) for the in ("the", "The")]
    return named.select("book_id", F.explode(F.array(*forms)).alias("reference"), "character")


def sentences(paragraphs: DataFrame) -> DataFrame:
    """(book_id, paragraph_id, sent_id, words): paragraphs are split first, so no sentence has to be matched to lines by offsets."""
    s = paragraphs.select("book_id", "paragraph_id", F.posexplode(F.split(F.regexp_replace("text", r"\.[ \t]+", ".\x01"), "\x01")).alias("sent_id", "s"))
    return s.select("book_id", "paragraph_id", "sent_id", F.regexp_extract_all("s", F.lit(TOKEN), F.lit(0)).alias("words")).where(F.size("words") > 0)


def mentions(said: DataFrame, refs: DataFrame, family: DataFrame, longest: int = 8) -> DataFrame:
    """Leftmost, longest, non-overlapping references in each sentence (never reaching its last token): book_id, paragraph_id, sent_id, start, stop, reference.

    Spans that are references come from an equi join; a fold over them, sorted by start and by
    length, keeps what begins after the last kept one ended. Only places where a reference of the
    book can begin give spans, of no more tokens than the longest such reference has at most.
    """
    known = refs.select("book_id", "reference").union(family.select("book_id", "reference")).distinct()
    # a reference's first letters, digits or sign are those of its first token, however its signs are cut
    head = lambda x: F.regexp_extract(x, r"^([\p{L}\p{N}]+|[^\p{L}\p{N}])", 1)
    finest = F.size(F.regexp_extract_all("reference", F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0)))
    heads = known.groupBy("book_id", head(F.col("reference")).alias("head")).agg(F.least(F.max(finest), F.lit(longest)).alias("most")).where("most > 0")
    places = said.select("book_id", "paragraph_id", "sent_id", "words", F.posexplode("words").alias("start", "word")).where(F.col("start") + 1 < F.size("words"))
    starts = places.select("book_id", "paragraph_id", "sent_id", "words", "start", head(F.col("word")).alias("head")).join(small(heads, HEADS), ["book_id", "head"])
    spans = starts.select("*", F.explode(F.sequence(F.lit(1), "most")).alias("n")).where(F.col("start") + F.col("n") < F.size("words"))
    text = F.regexp_replace(F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " "), " ('s|[.,;:!?])", "$1")
    hits = spans.select("book_id", "paragraph_id", "sent_id", "start", (F.col("start") + F.col("n")).alias("stop"), text.alias("reference")).join(small(known), ["book_id", "reference"])
    sorted_spans = F.array_sort(F.collect_list(F.struct("start", (-F.col("stop")).alias("order"), "stop", "reference")))
    kind = "array<struct<start:int,stop:int,reference:string>>"
    keep = lambda a, s: F.when(s["start"] >= a["end"], F.struct(s["stop"].alias("end"), F.concat(a["kept"], F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["reference"].alias("reference"))).cast(kind)).alias("kept"))).otherwise(a)
    folded = hits.groupBy("book_id", "paragraph_id", "sent_id").agg(sorted_spans.alias("s")).select("book_id", "paragraph_id", "sent_id", F.explode(F.aggregate("s", F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("kept")), keep)["kept"]).alias("k"))
    return folded.select("book_id", "paragraph_id", "sent_id", "k.start", "k.stop", "k.reference")


def mentioned(found: DataFrame, refs: DataFrame, family: DataFrame, owned: DataFrame) -> DataFrame:
    """(book_id, paragraph_id, sent_id, character): characters mentioned in a paragraph that is not theirs."""
    meant = refs.union(family.join(refs.select("book_id", "reference").distinct(), ["book_id", "reference"], "left_anti").select("book_id", "reference", "character"))
    return found.join(meant, ["book_id", "reference"]).select("book_id", "paragraph_id", "sent_id", "character").distinct().join(owned, ["book_id", "paragraph_id", "character"], "left_anti")


def relations(owned: DataFrame, seen: DataFrame) -> DataFrame:
    """(book_id, c1, c2), c1 < c2: owners of one paragraph, and mentioned characters with its owners."""
    a = owned.select("book_id", "paragraph_id", F.col("character").alias("x"))
    b = owned.select("book_id", "paragraph_id", F.col("character").alias("y"))
    s = seen.select("book_id", "paragraph_id", F.col("character").alias("x")).distinct()
    both = a.join(b, ["book_id", "paragraph_id"]).union(s.join(b, ["book_id", "paragraph_id"]))
    return both.where("x <> y").select("book_id", F.least("x", "y").alias("c1"), F.greatest("x", "y").alias("c2")).distinct()


def from_descriptions(paragraphs: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Relations of all books; `extra` has further references (book_id, reference, character), as from `resolve_mentions`."""
    owned = owners(paragraphs)
    refs = references(owned)
    if extra is not None:
        refs = refs.union(extra.join(refs, ["book_id", "reference"], "left_anti").select("book_id", "reference", "character"))
    family = families(owned)
    return relations(owned, mentioned(mentions(sentences(paragraphs), refs, family), refs, family, owned))


def valid_mentions(found: DataFrame, widest: int) -> DataFrame:
    """found: words, before_pos, first_pos. Not too long, no lone lower-case word, no determiner before, no pronoun first."""
    lone = (F.size("words") == 1) & F.get("words", F.lit(0)).rlike("^[a-z]+$")
    return found.where((F.size("words") <= widest) & ~lone & (F.coalesce("before_pos", F.lit("")) != "DT") & ~F.col("first_pos").isin("PRP", "PRP$"))


def resolve_mentions(found: DataFrame, refs: DataFrame, owned: DataFrame) -> DataFrame:
    """New references (book_id, reference, character) from mention texts (book_id, text, sex) in two relational passes.

    Exact references first; others take the characters whose reference strictly contains them, or
    into which their title resolves, or, if there are none, the titled references that resolve into
    the mention; characters of the other sex go; of several the first by paragraph wins.
    """
    new = found.select("book_id", "text", "sex").distinct().join(refs.select("book_id", F.col("reference").alias("text")), ["book_id", "text"], "left_anti").withColumn("inner", F.split("text", r"\s+"))
    known = refs.select("book_id", "reference", "character", F.split("reference", r"\s+").alias("outer"))
    none = F.lit(None).cast("string")
    both = new.join(known, "book_id")
    direct = both.where(m.contains_name(F.col("outer"), F.col("inner"), m.strict_match) | m.resolves_title(F.col("outer"), F.col("inner"), none))
    missing = new.join(direct.select("book_id", "text").distinct(), ["book_id", "text"], "left_anti")
    back = missing.join(known, "book_id").where(m.resolves_title(F.col("inner"), F.col("outer"), none))
    sexes = found.join(refs.select("book_id", F.col("reference").alias("text"), "character"), ["book_id", "text"]).where("sex <> ''").groupBy("book_id", "character").agg(F.min("sex").alias("known_sex"))
    pool = direct.unionByName(back).join(sexes, ["book_id", "character"], "left").withColumn("title_sex", F.when(m.first(F.col("inner")).isin(list(m.MALE_TITLES)), "MALE").when(m.first(F.col("inner")).isin(list(m.FEMALE_TITLES)), "FEMALE"))
    fit = pool.where(F.col("title_sex").isNull() | F.col("known_sex").isNull() | (F.col("title_sex") == F.col("known_sex")))
    place = owned.groupBy("book_id", "character").agg(F.min("paragraph_id").alias("paragraph_id"))
    return fit.join(place, ["book_id", "character"]).groupBy("book_id", F.col("text").alias("reference")).agg(F.min_by("character", F.struct("paragraph_id", "character")).alias("character"))


def mention_paragraphs(spots: DataFrame, spans: DataFrame) -> DataFrame:
    """Range join: spots (book_id, s) to spans (book_id, paragraph_id, start, stop), start <= s < stop; spans don't overlap, so it is an as-of union by book."""
    both = spots.select("book_id", "s", F.lit(None).cast("int").alias("paragraph_id"), F.lit(None).cast("int").alias("stop")).withColumn("spot", F.lit(True)).unionByName(
        spans.select("book_id", F.col("start").alias("s"), "paragraph_id", "stop").withColumn("spot", F.lit(False))
    )
    w = Window.partitionBy("book_id").orderBy("s", "spot").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(~F.col("spot"), F.struct("paragraph_id", "stop")), True).over(w)
    return both.withColumn("p", last).where("spot AND s < p.stop").select("book_id", "s", F.col("p.paragraph_id").alias("paragraph_id"))


def averages(compared: DataFrame) -> DataFrame:
    """Mean precision and recall of all books; missing values are skipped."""
    return compared.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


def weak_books(compared: DataFrame, least: float = 0.7) -> DataFrame:
    """Books whose precision or recall is under `least`."""
    return compared.where((F.col("precision") < least) | (F.col("recall") < least))


def compare(predicted: DataFrame, true: DataFrame) -> DataFrame:
    """Per book: precision 1 - FP / predicted (1 without predictions), recall 1 - FN / true (null without any)."""
    both = predicted.select("book_id", "c1", "c2").distinct().withColumn("p", F.lit(1)).join(true.select("book_id", "c1", "c2").distinct().withColumn("t", F.lit(1)), ["book_id", "c1", "c2"], "full_outer")
    hits = F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull())
    return both.groupBy("book_id").agg(F.coalesce(F.try_divide(hits, F.count("p")), F.lit(1.0)).alias("precision"), F.try_divide(hits, F.count("t")).alias("recall"))
