"""Personal data by boosted trees over candidate spans: DataFrame functions only.

Strict patterns with validators give the base spans, which always stay. Generators with a high
recall propose further, overlapping candidates: masked addresses, national telephone numbers,
cards of other lengths and separators, IPv6. A candidate's weak label comes from evidence that
its features don't hold: a check digit, a numbering plan, a known top-level domain, the shape of
an address. The features are small integers of its format (signs, groups, first digit) and its
context. So a format or context in which candidates are valid far above chance is one of personal
data: among numbers of a format that only look alike, one in ten passes the check digit.

Since a feature vector has few values, all candidates of the corpus shrink, by one grouped count,
to a table of at most `2 * MOST_VECTORS` rows, on which gradient boosting of depth-2 trees is run
in plain Python, exactly as on all candidates of four fifths of the documents. The trees become
CASE expressions. For each generator the threshold is the lowest score down to which, on the
candidates of the other fifth, the share of chance hits among valid ones stays under
`1 - PRECISION`. Valid candidates over it that overlap no base span are added.

Texts are scanned with possessive patterns that start only where a match can, so time is linear.
Positions are code points, from the lengths of matches and of what lies between them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.llm.quality import let
from narrascope.llm.shared import fold, saved

KINDS = ("email", "ip", "card", "phone")
# `\G` allows a match right after another one; the look-behinds keep a failed run from being tried again from its middle.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "phone": "+"}
GENERATORS: tuple[tuple[str, str], ...] = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}+){0,3} ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{2,24}+"),
    ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}+:){2,7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:.])"),
    ("card", r"(?<![0-9])[0-9](?:[ .-]{0,2}+[0-9]){12,18}+(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z])\+?+\(?+[0-9]{1,4}+\)?+(?:[ ./-]{0,2}+\(?+[0-9]{2,5}+\)?+){1,4}+(?![0-9A-Za-z])"),
)
#: How often a candidate of each generator that is no personal data is valid by chance, at most.
CHANCE = (0.1, 0.1, 0.1, 0.7)
#: Values of each feature: generator, digits, separators, brackets, plus sign, first digit of card networks, way of writing "at", words before, neighbours, letters.
RANGES = (len(GENERATORS), 7, 5, 2, 2, 2, 3, 5, 3, 2)
MOST_VECTORS = math.prod(RANGES)
TREES, RATE, PRECISION, FOLDS = 40, 0.5, 0.95, 5
# Common top-level domains, and those kept for examples.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "biz", "eu", "uk", "de", "fr", "es", "it", "nl", "at", "ch", "pl", "se", "no", "us", "ca", "au", "jp", "cn", "in", "br", "mx", "ru", "example", "test")
CONTEXT = 24
# Words before a candidate that tell its kind.
WORDS_BEFORE = (r"(?i)phone|tel\b|call|mobile|fax", r"(?i)card|visa|credit|iban|account", r"(?i)mail|contact|write", r"(?i)\bip\b|host|server|address")

_SPANS = "array<struct<start:int,stop:int,match:string>>"


def running(values: Column) -> Column:
    """Running sums of an array of int, in chunks, so that long arrays are not copied for every element."""
    chunk = 256
    none = F.array().cast("array<int>")

    def sums(part: Column, start: Column) -> Column:
        zero = F.struct(start.cast("int").alias("s"), none.alias("out"))
        return F.aggregate(part, zero, lambda a, x: F.struct((a["s"] + x).cast("int").alias("s"), F.concat(a["out"], F.array((a["s"] + x).cast("int"))).alias("out")))["out"]

    def chunked(v: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.ceil(F.size(v) / chunk).cast("int") - 1)
        totals = F.transform(cuts, lambda c: F.aggregate(F.slice(v, c * chunk + 1, F.lit(chunk)), F.lit(0), lambda a, x: a + x))
        return let(F.concat(F.array(F.lit(0)), sums(totals, F.lit(0))), lambda b: F.flatten(F.transform(cuts, lambda c: sums(F.slice(v, c * chunk + 1, F.lit(chunk)), F.get(b, c)))))

    return let(values, lambda v: F.when(F.size(v) <= chunk, sums(v, F.lit(0))).otherwise(chunked(v)))


def located(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches with their code point ranges."""

    def spans(m: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), m, lambda gap, x: (F.length(gap) + F.length(x)).cast("int"))
        return F.zip_with(running(lengths), m, lambda stop, x: F.struct((stop - F.length(x)).cast("int").alias("start"), stop.alias("stop"), x.alias("match")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) == 0, F.array().cast(_SPANS)).otherwise(spans(m).cast(_SPANS)))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def octets(match: Column) -> Column:
    """Whether no run of digits is above 255."""
    return F.forall(F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0)), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def luhn(number: Column) -> Column:
    """Whether a string of digits has a correct check digit."""

    def value(i: Column) -> Column:
        d = F.substr(F.reverse(number), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda a, i: (a + value(i)).cast("int")) % 10 == 0


def card(match: Column) -> Column:
    return let(digits(match), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))


VALID: dict[str, Callable[[Column], Column]] = {"email": lambda m: F.lit(True), "ip": octets, "card": card, "phone": lambda m: F.length(digits(m)).between(8, 15)}


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(located(text, BASE[kind]), lambda s: VALID[kind](s["match"]))
    return F.when(F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(r"[0-9][\x20-]?[0-9]" if kind == "card" else r"[0-9]\.[0-9]"), found).otherwise(F.array().cast(_SPANS))


def _valid_candidate(kind: str, m: Column) -> Column:
    """Evidence that a candidate is what it looks like; none of it is a feature."""
    d = digits(m)
    if kind == "email":
        return F.lower(F.regexp_extract(m, "([A-Za-z]+)$", 1)).isin(*DOMAINS)
    if kind == "ip":
        halves = F.size(F.split(m, "::"))
        groups = F.size(F.regexp_extract_all(m, F.lit("[0-9A-Fa-f]+"), F.lit(0)))
        return ((halves == 2) & (groups <= 7)) | ((halves == 1) & (groups == 8) & ~m.startswith(":"))
    if kind == "card":
        return let(d, lambda x: F.when(F.length(x).between(13, 19), luhn(x)).otherwise(F.lit(False)))
    plan = d.rlike("^1?[2-9][0-9]{2}[2-9][0-9]{6}$") | d.rlike("^0[1-9][0-9]{7,9}$")
    return F.when(m.contains("+"), F.length(d).between(8, 15)).otherwise(plan)


def _features(text: Column, number: int, s: Column) -> list[Column]:
    """The features of candidate s, in the order of RANGES."""
    m, d = s["match"], digits(s["match"])
    n = F.length(d)
    separated = F.regexp_replace(m, "[0-9A-Za-z+()@_%:\\[\\]]", "")
    before = F.substr(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))
    words = F.lit(0)
    for i, pattern in reversed(list(enumerate(WORDS_BEFORE, 1))):
        words = F.when(before.rlike(pattern), i).otherwise(words)
    last = F.when(s["start"] > 0, F.substr(text, s["start"], F.lit(1))).otherwise(F.lit(" "))
    following = F.substr(text, s["stop"] + 1, F.lit(1))
    flag = lambda c: F.when(c, 1).otherwise(0)
    return [
        F.lit(number),
        F.when(n < 8, 0).when(n < 10, 1).when(n < 11, 2).when(n < 13, 3).when(n < 16, 4).when(n < 17, 5).otherwise(6),
        F.when(separated == "", 0).when(separated.rlike("^ +$"), 1).when(separated.rlike("^-+$"), 2).when(separated.rlike("^\\.+$"), 3).otherwise(4),
        flag(m.rlike("[(\\[]")),
        flag(m.contains("+")),
        flag(d.rlike("^[3-6]")),
        F.when(m.rlike("[(\\[]at[)\\]]"), 1).when(m.contains("@") & m.contains(" "), 2).otherwise(0),
        words,
        flag(last.rlike("[A-Za-z0-9]")) + flag(following.rlike("[A-Za-z0-9]")),
        flag(m.rlike("[A-Za-z]")),
    ]


_CANDIDATES = "array<struct<kind:int,start:int,stop:int,f:array<int>,is_base:boolean,valid:boolean>>"
_GATES = {"email": r"@|[(\[]at[)\]]", "ip": r":[0-9A-Fa-f]{0,4}:", "card": r"[0-9][ .-]{0,2}[0-9]", "phone": r"[0-9]{2}"}


def _candidates(text: Column) -> Column:
    """Candidates of all generators with features, whether they equal a base span of their kind, and whether they are valid."""

    def described(number: int, kind: str) -> Callable[[Column], Column]:
        def of(s: Column) -> Column:
            is_base = F.exists(F.col(kind), lambda b: (b["start"] == s["start"]) & (b["stop"] == s["stop"]))
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                s["start"].alias("start"),
                s["stop"].alias("stop"),
                F.array(*(f.cast("int") for f in _features(text, number, s))).alias("f"),
                is_base.alias("is_base"),
                (is_base | F.coalesce(_valid_candidate(kind, s["match"]), F.lit(False))).alias("valid"),
            )

        return of

    lists = []
    for number, (kind, pattern) in enumerate(GENERATORS):
        gate = F.when(text.rlike(_GATES[kind]), F.transform(located(text, pattern), described(number, kind)))
        lists.append(F.coalesce(gate.cast(_CANDIDATES), F.array().cast(_CANDIDATES)))
    return F.concat(*lists)


Tree = tuple[tuple[int, int], tuple[int, int], tuple[int, int], tuple[float, float, float, float]]  # root, left and right split (feature, most), leaves


def fit_trees(vectors: list[tuple[tuple[int, ...], int, int]], trees: int = TREES) -> list[Tree]:
    """Gradient boosting of logistic loss on (features, rows, positive rows)."""
    scores = [0.0] * len(vectors)

    def best(of: list[int], grad: list[float], hess: list[float]) -> tuple[float, tuple[int, int]]:
        g, h = sum(grad[i] for i in of), sum(hess[i] for i in of)
        out = (0.0, (0, RANGES[0]))
        for f, size in enumerate(RANGES):
            for most in range(size - 1):
                left = [i for i in of if vectors[i][0][f] <= most]
                gl, hl = sum(grad[i] for i in left), sum(hess[i] for i in left)
                if left and len(left) < len(of):
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > out[0] + 1e-9:
                        out = (gain, (f, most))
        return out

    made: list[Tree] = []
    for _ in range(trees if vectors else 0):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        grad = [pos - n * q for (_, n, pos), q in zip(vectors, p)]
        hess = [n * q * (1 - q) for (_, n, _), q in zip(vectors, p)]
        everything = list(range(len(vectors)))
        root = best(everything, grad, hess)[1]
        sides = [[i for i in everything if (vectors[i][0][root[0]] <= root[1]) == low] for low in (True, False)]
        splits, leaves = [], []
        for side in sides:
            split = best(side, grad, hess)[1]
            splits.append(split)
            for low in (True, False):
                leaf = [i for i in side if (vectors[i][0][split[0]] <= split[1]) == low]
                value = RATE * sum(grad[i] for i in leaf) / (sum(hess[i] for i in leaf) + 1)
                leaves.append(max(-4.0, min(4.0, value)))
                for i in leaf:
                    scores[i] += leaves[-1]
        made.append((root, splits[0], splits[1], tuple(leaves)))
    return made


def tree_score(trees: list[Tree], f: tuple[int, ...]) -> float:
    total = 0.0
    for root, low, high, leaves in trees:
        left = f[root[0]] <= root[1]
        split = low if left else high
        total += leaves[(0 if left else 2) + (0 if f[split[0]] <= split[1] else 1)]
    return total


def tree_column(trees: list[Tree], f: Column) -> Column:
    total = F.lit(0.0)
    for root, low, high, leaves in trees:
        side = lambda s, a, b: F.when(F.get(f, F.lit(s[0])) <= s[1], a).otherwise(b)
        total = total + F.when(F.get(f, F.lit(root[0])) <= root[1], side(low, leaves[0], leaves[1])).otherwise(side(high, leaves[2], leaves[3]))
    return total


def thresholds(trees: list[Tree], vectors: list[tuple[tuple[int, ...], int, int]], precision: float = PRECISION) -> list[float]:
    """Of each generator, the lowest score down to which this share of the valid candidates is valid by more than chance.

    Of n candidates that are no personal data, CHANCE * n are valid; so of n candidates of which
    v are valid, about (n - v) * CHANCE / (1 - CHANCE) of the valid ones are chance hits. Two
    more candidates that are not valid are added, so that few say little; and a score at which
    half of the valid ones are chance hits ends the search, however pure all above it is.
    """
    out = []
    for number, chance in enumerate(CHANCE):
        ranked = sorted(((tree_score(trees, f), n, pos) for f, n, pos in vectors if f[0] == number), reverse=True)
        least, n, pos, own_n, own_pos = math.inf, 0, 0, 0, 0
        for i, (score, rows, hits) in enumerate(ranked):
            n, pos, own_n, own_pos = n + rows, pos + hits, own_n + rows, own_pos + hits
            if i + 1 < len(ranked) and ranked[i + 1][0] >= score:
                continue
            if (own_n - own_pos) * chance / (1 - chance) > own_pos / 2:
                break
            own_n = own_pos = 0
            if (n + 2 - pos) * chance / (1 - chance) <= (1 - precision) * pos:
                least = score - 1e-9
        out.append(least)
    return out


def pii_spans(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, the base spans of each kind, and `added`, the spans that the trees add (kind number, start, stop).

    A null or empty text has no spans; a text of any length is scanned as a whole. Ids may be
    null or repeated; repeated rows get equal results; other columns are ignored; an empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    based = rows.select("doc_id", "text", *(base_spans(F.col("text"), k).alias(k) for k in KINDS))
    found = based.select("doc_id", *(F.transform(k, lambda s: F.struct(s["start"], s["stop"])).alias(k) for k in KINDS), _candidates(F.col("text")).alias("candidates"))
    found = saved(found, "pii")
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    each = found.select(held.alias("held"), F.explode("candidates").alias("c")).select("held", "c.f", "c.valid")
    counted = [(h, tuple(f), n, pos) for h, f, n, pos in each.groupBy("held", "f").agg(F.count("*"), F.count_if("valid")).collect()]  # 2 * MOST_VECTORS rows at most
    trees = fit_trees(sorted((f, n, pos) for h, f, n, pos in counted if not h))
    least = thresholds(trees, sorted((f, n, pos) for h, f, n, pos in counted if h))
    over = lambda a, b: (a["start"] < b["stop"]) & (b["start"] < a["stop"])
    base = F.concat(*KINDS)

    def selected(c: Column) -> Column:
        ok = F.lit(False)
        for number, t in enumerate(least):
            if t < math.inf:
                ok = ok | ((F.get(c["f"], F.lit(0)) == number) & (tree_column(trees, c["f"]) >= t))
        return ok & c["valid"] & ~c["is_base"] & ~F.exists(base, lambda b: over(b, c))

    picked = F.filter("candidates", selected)
    first = lambda p: F.filter(p, lambda c: ~F.exists(p, lambda d: over(d, c) & (F.get(d["f"], F.lit(0)) < F.get(c["f"], F.lit(0)))))
    return found.select("doc_id", *KINDS, F.transform(let(picked, first), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"))).alias("added"))


def _of_kind(number: int, spans: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


def op3_pii(docs: DataFrame) -> DataFrame:
    found = pii_spans(docs)
    kinds = F.array(*map(F.lit, KINDS))
    base = F.concat(*(_of_kind(i, k) for i, k in enumerate(KINDS)))
    written = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.concat(base, "added")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """text with each of the spans (kind number, start, stop; not overlapping) replaced by its kind in brackets. A null text or null spans give null, an empty text or no spans the text itself, whatever its length; columns, so rows, names and ties don't matter."""
    kinds = F.array(*map(F.lit, KINDS))
    last_first = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["stop"], s["kind"])), asc=False)
    cut = lambda t, s: F.concat(F.substr(t, F.lit(1), s["start"]), F.lit("["), F.upper(F.get(kinds, s["kind"])), F.lit("]"), F.substr(t, s["stop"] + 1))
    return F.aggregate(last_first, text, cut)
