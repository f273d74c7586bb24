"""Column builders for names, descriptions, paths and web pages."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrascope.functions.matching import TITLES, let

SECTIONS = {"sentence": "st", "paragraph": "pg", "chapter": "cp"}


def is_the(word: Column) -> Column:
    return word.isin("the", "The", "THE")


def section_short(name: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in SECTIONS.items() for x in pair))[name]


def has_capital(word: Column) -> Column:
    return word.rlike(r"\p{Lu}")


def name_tokens(name: Column) -> Column:
    """Commas are blanks, possessive marks are tokens of their own."""
    spaced = F.regexp_replace(F.regexp_replace(F.replace(name, F.lit(","), F.lit(" ")), "'s ", " 's "), "s'", "s ' ")
    return F.filter(F.split(spaced, r"\s+"), lambda t: t != "")


#: Letters of Latin blocks that are an ASCII letter with marks, by their canonical decomposition.
_DECOMPOSED = {c: d[0] for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if (d := unicodedata.normalize("NFD", c))[0].isascii() and d != c}


def normalized(text: Column) -> Column:
    """ASCII only: marks go from letters, combining or not, curly quotes and long dashes become plain, other letters are dropped."""
    return F.regexp_replace(F.translate(text, "".join(_DECOMPOSED) + "“”’—", "".join(_DECOMPOSED.values()) + "\"\"'-"), r"[^\x00-\x7F]", "")


def strip_headers(text: Column) -> Column:
    """A book's own text: what stands between the lines that announce its start and its end, or all if there are none."""
    start, end = r"(?im)^[ *]*\*{3} *start of [^\n]*$", r"(?im)^[ *]*\*{3} *end of [^\n]*$"
    after = F.when(text.rlike(start), F.element_at(F.split(text, start, 2), 2)).otherwise(text)
    return F.trim(F.element_at(F.split(after, end, 2), 1))


def split_characters(heading: Column) -> Column:
    """`A, B and C` as a list; a bare title takes the last name of what follows it. Without ` and ` the heading is one name."""
    parts = F.filter(F.transform(F.split(F.replace(heading, F.lit(" and "), F.lit(",")), ","), lambda x: F.trim(x)), lambda x: x != "")
    named = let(parts, lambda p: F.transform(p, lambda x, i: F.when(x.isin(list(TITLES)) & F.get(p, i + 1).isNotNull(), F.concat_ws(" ", x, F.element_at(F.split(F.get(p, i + 1), r"\s+"), -1))).otherwise(x)))
    return F.when(F.contains(heading, F.lit(" and ")), named).otherwise(F.array(heading))


def nickname_references(name: Column) -> Column:
    """`A (B) C` also goes by `B`, `A C` and `B C`."""
    inner = F.regexp_extract(name, r"\(([^)]*)\)", 1)
    outside = F.filter(F.split(F.regexp_replace(name, r"\([^)]*\)", " "), r"\s+"), lambda t: t != "")
    swapped = let(outside, lambda t: F.concat(F.array(inner), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0)))))
    return F.when(F.contains(name, F.lit("(")), F.array(inner, F.array_join(outside, " "), F.array_join(swapped, " "))).otherwise(F.array().cast("array<string>"))


def span_text(tokens: Column, start: Column, stop: Column) -> Column:
    """Text of tokens (word, begin, end) start..stop-1 (from 0), with a blank wherever offsets leave a gap."""
    part = F.slice(tokens, start + 1, stop - start)
    return let(part, lambda p: F.array_join(F.transform(p, lambda t, i: F.concat(F.when((i > 0) & (t["begin"] > F.get(p, i - 1)["end"]), " ").otherwise(""), t["word"])), ""))


def strip_possessive(name: Column) -> Column:
    return F.trim(F.when(F.endswith(name, F.lit("'s")), F.regexp_replace(name, "'s$", "")).otherwise(F.regexp_replace(name, "s'$", "s")))


def name_width(name: Column) -> Column:
    """Number of word and separator pieces of a name."""
    return F.size(F.split(name, r"\W+", -1)) * 2 - 1


def coref_sex(mentions: Column, literal: bool = False) -> Column:
    """MALE or FEMALE by the first pronoun in a list of mention texts; empty if there is none, and always with `literal`."""
    he, she = F.lit("^(he|him|his|himself)$"), F.lit("^(she|her|herself)$")
    sexes = F.filter(F.transform(mentions, lambda m: F.when(F.regexp_like(F.lower(m), he), "MALE").when(F.regexp_like(F.lower(m), she), "FEMALE")), lambda s: s.isNotNull())
    return F.lit("") if literal else F.coalesce(F.get(sexes, F.lit(0)), F.lit(""))


# What follows a family's name.
FAMILY_WORDS = ("children", "house", "family", "people")


def family_name(text: Column) -> Column:
    """The X of `the X children` (house, family, people) or `the Xs`; null otherwise."""
    t = F.split(text, r"\s+")
    return let(t, lambda t: F.when(~F.get(t, F.lit(0)).isin("the", "The"), None).when((F.size(t) == 3) & F.get(t, F.lit(2)).isin(*FAMILY_WORDS), F.get(t, F.lit(1))).when((F.size(t) == 2) & F.endswith(F.get(t, F.lit(1)), F.lit("s")), F.regexp_replace(F.get(t, F.lit(1)), "s$", "")))


def url_slug(url: Column, prefix: str) -> Column:
    return F.regexp_replace(F.when(F.startswith(url, F.lit(prefix)), F.substr(url, F.lit(len(prefix) + 1))).otherwise(url), "/+$", "")


def book_stem(path: Column) -> Column:
    """File name up to its first full stop or underscore."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^([^._]*)", 1)


def synset_word(synset: Column) -> Column:
    """`first_lemma.n.01` as `first lemma`."""
    return F.translate(F.split_part(synset, F.lit("."), F.lit(1)), "_", " ")


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a[^>]*href="([^"]*)"'), F.lit(1))


def html_element(html: Column, tag: str, name: str | None = None) -> Column:
    """Text inside the first such element, without marks inside it, lower-cased."""
    at = f'<{tag}(?:\\s[^>]*class="{name}"[^>]*)>' if name else f"<{tag}(?:\\s[^>]*)?>"
    return F.lower(F.trim(F.regexp_replace(F.regexp_extract(html, f"(?s){at}(.*?)</{tag}>", 1), "<[^>]*>", "")))


def html_blocks(html: Column, name: str, drop_first_line: bool = False) -> Column:
    """All outermost `div`s of a class, with the `div`s inside them, as (id, text): without comments and marks, blank lines dropped, ending in a full stop.

    A pointer to an in-depth analysis goes if it is the last sentence; with `drop_first_line` so
    does what stands before the first line break. A block that is never closed ends with the page.
    """
    pieces = F.regexp_extract_all(F.regexp_replace(html, "(?s)<!--.*?-->", ""), F.lit(r"(?i)<div\b[^>]*>|</div\s*>|[^<]+|<"), F.lit(0))
    kind = "array<struct<id:string,text:string>>"
    block = lambda head, text: F.array(F.struct(F.regexp_extract(head, 'id="([^"]*)"', 1).alias("id"), text.alias("text"))).cast(kind)
    state = lambda depth, head, text, out: F.struct(depth.cast("int").alias("depth"), head.alias("head"), text.alias("text"), out.alias("out"))

    def step(s: Column, p: Column) -> Column:
        opens, closes = p.rlike(r"(?i)^<div\b"), p.rlike("(?i)^</div")
        outside = F.when(opens & p.rlike(f'class="{name}"'), state(F.lit(1), p, F.lit(""), s["out"])).otherwise(s)
        inside = F.when(closes & (s["depth"] == 1), state(F.lit(0), F.lit(""), F.lit(""), F.concat(s["out"], block(s["head"], s["text"]))))
        return F.when(s["depth"] == 0, outside).otherwise(inside.otherwise(state(s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0), s["head"], F.concat(s["text"], p), s["out"])))

    whole = lambda s: F.when(s["depth"] > 0, F.concat(s["out"], block(s["head"], s["text"]))).otherwise(s["out"])
    found = F.aggregate(pieces, state(F.lit(0), F.lit(""), F.lit(""), F.array().cast(kind)), step, whole)

    def cleaned(text: Column) -> Column:
        lines = F.regexp_replace(text, r"^[^\n]*\n", "") if drop_first_line else text
        plain = F.trim(F.regexp_replace(F.regexp_replace(lines, "<[^>]*>", " "), r"\s+", " "))
        plain = F.trim(F.regexp_replace(plain, r"(^|\.)\s*Read an ?in-depth analysis of[^.]*\.?$", "$1"))
        return F.when(F.endswith(plain, F.lit(".")), plain).otherwise(F.concat(plain, F.lit(".")))

    return F.transform(found, lambda b: F.struct(b["id"].alias("id"), cleaned(b["text"]).alias("text")))
