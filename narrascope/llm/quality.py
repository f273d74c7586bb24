"""Quality rules as weak supervision: DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Documents go bad in several
ways that share few symptoms (signs strewn in, copied passages, fragments), so a document is
either good or bad in one of several modes, one for each rule to begin with. Expectation-
maximisation over the counts of vote patterns (at most 3 ** rules of them, whatever the number of
documents) estimates how common each class is and how each rule votes on it, and so how often
each rule is right on good and on bad documents. No rate is clamped; priors, worth a share of
the documents, say what a rule's author believes: that it blames few good documents, and most of
its own mode. They are needed where a rule's bad votes go with no other rule's, as agreement then
says nothing about it. The posterior probability of being good decides, in place of a filter
that every rule must pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.llm.shared import saved

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_SHORT = 1 << 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a window of three words found twice or more.

    Windows are hashed, and sorted with their places in the low bits, so equal hashes become
    neighbours; texts of 65,536 windows or more sort pairs of hash and place instead, as more
    bits are needed for a place. Windows whose hash occurs once are single. Those that share a
    hash are then sorted by their words, so the words decide, whatever the length of the text.
    """

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-3).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3).cast("bigint"), p - a["last"])).alias("n"))
        return F.aggregate(F.array_sort(places), start, step, lambda a: a["n"])

    def repeats(key: Callable[[Column], Column], place: Callable[[Column], Column]) -> Callable[[Column], Column]:
        """Places of the elements of a sorted array that have a neighbour with their key."""

        def of(s: Column) -> Column:
            same = lambda k, o: F.coalesce(key(F.get(s, k)) == key(F.get(s, k + o)), F.lit(False))
            return F.when(F.size(s) > 0, F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, -1) | same(k, 1)), lambda k: place(F.get(s, k)))).otherwise(F.array().cast("array<bigint>"))

        return of

    def of_hashes(w: Column) -> Callable[[Column], Column]:
        def of(h: Column) -> Column:
            # the shift to the left drops a hash's upper 16 bits, of which nothing depends: words are compared afterwards
            coded = F.transform(h, lambda x, i: F.shiftleft(x, 16).bitwiseOR(i.cast("bigint")))
            short = let(F.sort_array(coded), repeats(lambda x: F.shiftright(x, 16), lambda x: x.bitwiseAND(F.lit(_SHORT - 1).cast("bigint"))))
            full = let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("bigint").alias("p")))), repeats(lambda x: x["h"], lambda x: x["p"]))
            likely = F.when(F.size(h) < _SHORT, short).otherwise(full)
            # words hold no blank, so windows joined by blanks are equal only when their words are
            read = lambda p: F.struct(F.concat_ws(" ", F.get(w, p.cast("int")), F.get(w, p.cast("int") + 1), F.get(w, p.cast("int") + 2)).alias("g"), p.alias("p"))
            sure = let(F.array_sort(F.transform(likely, read)), repeats(lambda x: x["g"], lambda x: x["p"]))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(sure))

        return of

    def of_words(w: Column) -> Column:
        h = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0).cast("bigint")).otherwise(let(h, of_hashes(w)))

    return let(words, of_words)


def measures(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    blank = lambda x: F.translate(x, SPACES, "")
    words = F.array_remove(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: blank(x) != "")
    letters = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")
    return {
        "n_words": F.size("words").cast("bigint"),
        "word_chars": F.length(blank(text)).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
        "n_lines": let(lines, lambda x: F.size(x).cast("bigint")),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")),
        "n_repeat_words": repeated_words(F.col("words")),
        "n_capitals": (F.length(text) - F.length(letters)).cast("bigint"),
        "n_stops": (F.length(text) - F.length(F.translate(text, ".!?", ""))).cast("bigint"),
        "words": words,
    }


#: Rule: (vote good when, vote bad when) over the measures.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words BETWEEN 80 AND 100000", "n_words < 50"),
    "word_length": ("word_chars BETWEEN 3 * n_words AND 9 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    "symbols": ("50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "line_copies": ("n_lines > 1 AND n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    "word_copies": ("20 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    "capitals": ("10 * n_capitals <= 2 * word_chars", "10 * n_capitals > 5 * word_chars"),
    "sentences": ("n_stops > 0 AND n_words BETWEEN 2 * n_stops AND 60 * n_stops", "n_words > 200 * n_stops OR n_words < n_stops"),
}


#: Priors of a rule's share of bad votes on good documents and on its own mode, and how many votes per document they are worth.
FALSE_ALARMS, OWN_MODE = (0.01, 0.3), (0.9, 0.1)

Fit = tuple[list[float], list[list[float]]]  # of each class (good, then the modes): its share, and each rule's share of bad votes among its votes


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 300, settled: float = 1e-7) -> Fit:
    """Expectation-maximisation from the start that a document with bad votes is probably in the modes of these rules, any other good."""
    rules = len(patterns[0][0]) if patterns else len(RULES)
    total, classes = sum(n for _, n in patterns), rules + 1

    def start(v: tuple[int, ...]) -> list[float]:
        blamed = [k for k in range(1, classes) if v[k - 1] < 0]
        return [0.1] + [0.9 / len(blamed) if k in blamed else 0.0 for k in range(1, classes)] if blamed else [1.0] + [0.0] * rules

    def bad_share(k: int, j: int) -> float:
        mean, worth = FALSE_ALARMS if k == 0 else OWN_MODE if k == j + 1 else (0.5, 2 / total)
        said, blamed = (sum(w[k] * n for w, (v, n) in zip(weights, patterns) if v[j] in of) for of in ((-1, 1), (-1,)))
        return (blamed + mean * worth * total) / (said + worth * total)

    weights = [start(v) for v, _ in patterns]
    fit: Fit = ([1 / classes] * classes, [[0.5] * rules] * classes)
    for _ in range(rounds if total else 0):
        share = [(1 + sum(w[k] * n for w, (_, n) in zip(weights, patterns))) / (total + classes) for k in range(classes)]
        fit, old = (share, [[bad_share(k, j) for j in range(rules)] for k in range(classes)]), weights
        weights = [class_posteriors(v, fit) for v, _ in patterns]
        if max(abs(x[0] - y[0]) for x, y in zip(weights, old)) < settled:
            break
    return fit


def class_posteriors(votes: tuple[int, ...], fit: Fit) -> list[float]:
    """The probability of each class; the first one is good. A rule that abstains says nothing."""
    each = [math.prod([share, *(b if v < 0 else 1 - b for v, b in zip(votes, bad) if v)]) for share, bad in zip(*fit)]
    return [x / sum(each) for x in each]


def accuracies(fit: Fit) -> list[tuple[float, float]]:
    """Of each rule, how often it is right when it votes on good and on bad documents."""
    share, bad = fit
    return [(1 - bad[0][j], sum(s * b[j] for s, b in zip(share[1:], bad[1:])) / sum(share[1:])) for j in range(len(bad[0]))]


def posterior_column(votes: list[str], fit: Fit) -> Column:
    each = []
    for share, bad in zip(*fit):
        product = F.lit(share)
        for name, b in zip(votes, bad):
            product = product * F.when(F.col(name) < 0, b).when(F.col(name) > 0, 1 - b).otherwise(1.0)
        each.append(product)
    return each[0] / sum(each[1:], each[0])


def op8_quality(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per row of docs: the measures, base_failed, posterior (of being good) and kept.

    A null or empty text has no words and fails. Repeated rows get equal results; ids may be null;
    a very long text is measured as a whole; other columns are ignored; an empty table gives no
    rows.
    """
    found = measures(F.col("text"))
    words = found.pop("words")
    described = saved(docs.select("doc_id", "text").withColumn("words", words).select("doc_id", *(c.alias(n) for n, c in found.items())), "quality")
    votes = {f"vote_{r}": F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for r, (good, bad) in RULES.items()}
    voted = described.withColumns(votes)
    patterns = [(tuple(row[:-1]), row[-1]) for row in voted.groupBy(*votes).count().collect()]  # 3 ** len(RULES) rows at most
    posterior = posterior_column(list(votes), fit_votes(sorted(patterns)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (posterior >= least)).alias("kept"), posterior.alias("posterior"))
