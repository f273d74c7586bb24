"""Column builders for comparing names, given as arrays of tokens.

All are built-in expressions: a comparison of two tokens is a CASE, a comparison of two names an
`aggregate` over the outer name's tokens, and the similarity ratio a dynamic programme in nested
`aggregate`s, so none of it leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles and the form that each stands for.
MALE_TITLES = {
    "Mr.": "Mr.", "Mister": "Mr.", "Monsieur": "Mr.", "M.": "M.", "Brother": "Brother", "Uncle": "Uncle", "Father": "Father",
    "King": "king", "king": "king", "Prince": "prince", "Captain": "captain", "captain": "captain", "Mester": "Mester", "Master": "Master",
}
FEMALE_TITLES = {
    "Mrs.": "Mrs.", "Ms.": "Ms.", "Miss": "Miss", "Madame": "Madame", "Madam": "Madame", "Sister": "Sister", "Aunt": "Aunt", "Mother": "Mother",
    "Lady": "lady", "lady": "lady", "Princess": "princess", "princess": "princess", "Mistress": "Miss",
}
OTHER_TITLES = {"Dr.": "Dr.", "Doctor": "Dr.", "Jr.": "Jr.", "Junior": "Jr.", "Prof.": "Prof", "Professor": "Prof.", "The": "The", "the": "The"}
TITLES = MALE_TITLES | FEMALE_TITLES | OTHER_TITLES

Match = Callable[[Column, Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def first(name: Column) -> Column:
    return F.get(name, F.lit(0))


def last(name: Column) -> Column:
    return F.get(name, F.size(name) - 1)


def rest(name: Column) -> Column:
    return F.slice(name, F.lit(2), F.greatest(F.size(name) - 1, F.lit(0)))


def is_title(token: Column) -> Column:
    return token.isin(list(TITLES))


def canonical(token: Column) -> Column:
    """What a title stands for; null for other tokens."""
    return F.create_map(*(F.lit(x) for pair in TITLES.items() for x in pair))[token]


def uncapital(token: Column) -> Column:
    return F.concat(F.lower(F.substring(token, 1, 1)), F.substr(token, F.lit(2)))


def strict_match(outer: Column, inner: Column) -> Column:
    """Equal but for the first letter's case; or `inner` is an abbreviation, with a full stop, of `outer`."""
    a, b = uncapital(outer), uncapital(inner)
    stem = F.substr(b, F.lit(1), F.greatest(F.length(b) - 1, F.lit(0)))
    short = F.endswith(b, F.lit(".")) & ~F.endswith(a, F.lit(".")) & (F.startswith(a, stem) | ((F.length(b) == 3) & F.startswith(a, F.substring(b, 1, 1)) & F.endswith(a, F.substring(b, 2, 1))))
    return short | (a == b)


def lcs_row(row: Column, letter: Column, other: Column) -> Column:
    """The next row of the longest-common-subsequence table: row[j] is for the first j letters of other."""
    start = F.struct(F.array(F.lit(0)).cast("array<int>").alias("r"))
    step = lambda a, j: F.struct(
        F.concat(a["r"], F.array(F.when(F.substr(other, j, F.lit(1)) == letter, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.get(a["r"], j - 1))).cast("int"))).alias("r")
    )
    return F.when(F.length(other) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(other), F.lit(1))), start, step)["r"]).otherwise(F.array(F.lit(0)).cast("array<int>"))


def _ratio(common: Column, a: Column, b: Column) -> Column:
    return F.when(a + b > 0, F.floor(200 * common / (a + b) + 0.5).cast("int")).otherwise(100)


def similarity(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (lengths), rounded half up: 100 for equal strings, 0 for nothing in common."""
    zero = F.array_repeat(F.lit(0), F.length(b) + 1).cast("array<int>")
    table = F.aggregate(F.split(a, ""), zero, lambda row, c: F.when(c == "", row).otherwise(lcs_row(row, c, b)))
    return _ratio(F.get(table, F.length(b)), F.length(a), F.length(b))


def prefix_similarity(b: Column, a: Column) -> Column:
    """The greatest similarity of b with a proper prefix of a."""
    zero = F.struct(F.array_repeat(F.lit(0), F.length(b) + 1).cast("array<int>").alias("row"), F.lit(0).alias("i"), F.lit(0).alias("best"))

    def step(s: Column, c: Column) -> Column:
        row = lcs_row(s["row"], c, b)
        return let(row, lambda r: F.struct(r.alias("row"), (s["i"] + 1).alias("i"), F.when(s["i"] + 1 < F.length(a), F.greatest(s["best"], _ratio(F.get(r, F.length(b)), s["i"] + 1, F.length(b)))).otherwise(s["best"]).alias("best")))

    return F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), zero, step)["best"]


def fuzzy_match(outer: Column, inner: Column) -> Column:
    """Neither is a title, and `inner` is part of `outer`, or at least 70 similar to a proper prefix of it."""
    a, b = uncapital(outer), uncapital(inner)
    return ~is_title(outer) & ~is_title(inner) & (F.contains(a, b) | (prefix_similarity(b, a) >= 70))


def contains_name(outer: Column, inner: Column, match: Match) -> Column:
    """inner's tokens match some of outer's, in order; the first or the last tokens must match each other; equal names don't count."""
    anchored = match(first(outer), first(inner)) | match(last(outer), last(inner))
    found = F.aggregate(outer, F.lit(0), lambda i, t: F.when((i < F.size(inner)) & match(t, F.get(inner, i)), i + 1).otherwise(i))
    fits = (F.size(outer) > 0) & (F.size(inner) > 0) & (outer != inner)
    return F.coalesce(F.when(fits, F.when(anchored, found == F.size(inner)).otherwise(False)), F.lit(False))


def resolves_title(outer: Column, name: Column, gender: Column, literal: bool = False) -> Column:
    """Whether the titled `name` may stand for `outer`; `gender` is that of outer's lower-cased first token, or null.

    Two equal rests under equal titles (`Mr. Finn`, `Mister Finn`) are the same person; with
    `literal` they are not.
    """
    title, other = first(name), first(outer)
    same_title = F.when(canonical(title) != canonical(other), False).when(rest(outer) == rest(name), not literal).otherwise(contains_name(rest(outer), rest(name), strict_match))
    agrees = F.when(title.isin(list(OTHER_TITLES)), True).when(gender.isNotNull(), ((gender == "MALE") & title.isin(list(MALE_TITLES))) | ((gender == "FEMALE") & title.isin(list(FEMALE_TITLES)))).otherwise(
        strict_match(F.lower(other), F.lower(F.get(name, F.lit(1))))
    )
    untitled = contains_name(outer, rest(name), strict_match) & agrees
    return F.coalesce((outer != name) & is_title(title) & F.when(is_title(other), same_title).otherwise(untitled), F.lit(False))


def token_score(outer: Column, inner: Column) -> Column:
    """0 to 1: how well a candidate's token fits a character's."""
    a, b = uncapital(outer), uncapital(inner)
    grey = ((a == "grey") & (b == "gray")) | ((a == "gray") & (b == "grey"))
    plural = (b == F.concat(a, F.lit("s"))) | (a == F.concat(b, F.lit("s")))
    short = F.endswith(b, F.lit(".")) & F.startswith(a, F.substr(b, F.lit(1), F.greatest(F.length(b) - 1, F.lit(0))))
    return let(similarity(a, b), lambda r: F.when(grey, 1.0).when(plural, 0.0).when(is_title(outer) | is_title(inner) | is_title(a) | is_title(b), 0.0).when(short, 0.5).when(r >= 80, r / 100.0).otherwise(0.0))


def name_score(outer: Column, inner: Column) -> Column:
    """Sum of token scores along a greedy in-order match, 0.5 more for outer's first token, 0.1 less for each outer token passed over; 0 unless all of inner matches."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit(0.0).alias("sum"))

    def step(s: Column, t: Column) -> Column:
        done = s["i"] >= F.size(inner)
        score = F.when(done, 0.0).otherwise(token_score(t, F.get(inner, s["i"])))
        gain = lambda x: F.when(done, s["sum"]).when(x > 0, s["sum"] + x + F.when(s["at"] == 0, 0.5).otherwise(0.0)).otherwise(s["sum"] - 0.1)
        return let(score, lambda x: F.struct((s["i"] + F.when(x > 0, 1).otherwise(0)).alias("i"), (s["at"] + 1).alias("at"), gain(x).alias("sum")))

    ok = (F.size(inner) > 0) & (F.size(outer) > 0) & ~((F.size(inner) == 1) & is_title(first(inner)))
    anchored = (token_score(first(outer), first(inner)) > 0) | (token_score(last(outer), last(inner)) > 0)
    whole = let(F.aggregate(outer, start, step), lambda s: F.when(s["i"] == F.size(inner), s["sum"]).otherwise(0.0))
    return F.coalesce(F.when(ok, F.when(anchored, whole).otherwise(0.0)), F.lit(0.0))


def reference_score(outer: Column, name: Column, gender: Column) -> Column:
    """How well `name` refers to `outer`: equal names score their length and one, then name_score, then titles."""
    title, other = first(name), first(outer)
    agreed = F.when(title.isin(list(OTHER_TITLES)), 0.2).when(gender.isNull(), 0.0).when(((gender == "MALE") & title.isin(list(MALE_TITLES))) | ((gender == "FEMALE") & title.isin(list(FEMALE_TITLES))), 0.2)
    both = F.when(canonical(title) != canonical(other), 0.0).otherwise(name_score(rest(outer), rest(name)))
    one = let(name_score(outer, rest(name)), lambda x: F.when((x > 0) & agreed.isNotNull(), x + agreed).otherwise(0.0))
    titled = F.when(~is_title(title), 0.0).when(is_title(other), both).otherwise(one)
    return F.when(F.size(outer) < F.size(name), 0.0).when(outer == name, (F.size(name) + 1).cast("double")).otherwise(let(name_score(outer, name), lambda x: F.when(x > 0, x).otherwise(titled)))
