"""Name comparison against plain Python."""

import itertools
import random

from pyspark.sql import functions as F

from narrascope.functions import matching as m
from narrascope.functions import text as ft
from narrascope.operators import coref, labels

#: Forms of two families' names, by a rule.
NAMES = sorted({form for first in ("Ada", "Adalind", "Bert", "Cora") for last in ("Lind", "Moor") for form in (first, last, f"{first} {last}", f"Mr. {last}", f"Mrs. {last}", f"Mister {last}", f"{first[0]}. {last}", f"Doctor {last}", f"The {first}", f"{last}s")})


def named(spark):
    return spark.createDataFrame([("b", x) for x in NAMES], "book_id string, gram_key string").withColumn("gram", F.split("gram_key", " "))


def strict(a, b):
    a, b = a[:1].lower() + a[1:], b[:1].lower() + b[1:]
    return a == b or (b.endswith(".") and not a.endswith(".") and (a.startswith(b[:-1]) or (len(b) == 3 and a.startswith(b[0]) and a.endswith(b[1]))))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    return 100 if not a and not b else int(200 * lcs(a, b) / (len(a) + len(b)) + 0.5)


def test_similarity(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))), "".join(rng.choice("abcd") for _ in range(rng.randint(0, 7)))) for _ in range(150)] + [("adalind", "ada"), ("margaret", "maggie")]
    df = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string")
    for r in df.select("a", "b", m.similarity(F.col("a"), F.col("b")).alias("s"), m.prefix_similarity(F.col("b"), F.col("a")).alias("p")).collect():
        assert r.s == ratio(r.a, r.b), r
        assert r.p == max([ratio(r.b, r.a[:i]) if i else 0 for i in range(len(r.a))], default=0), r


def test_strict_match(spark):
    cases = {("Tom", "T."): True, ("Tom", "tom"): True, ("Mister", "Mr."): True, ("Tom", "S."): False, ("T.", "Tom"): False, ("Tom", "Tommy"): False, ("O'Moor", "o'Moor"): True, ("TOM", "tom"): False, ("Jr.", "J."): False}
    df = spark.createDataFrame([(a, b) for a, b in cases], "a string, b string")
    assert {(r.a, r.b): r.x for r in df.select("a", "b", m.strict_match(F.col("a"), F.col("b")).alias("x")).collect()} == cases


def contains(outer, inner, match):
    if not outer or not inner or outer == inner or not (match(outer[0], inner[0]) or match(outer[-1], inner[-1])):
        return False
    rest = iter(outer)
    return all(any(match(t, x) for t in rest) for x in inner)


def fuzzy(a, b):
    low = lambda s: s[:1].lower() + s[1:]
    if a in m.TITLES or b in m.TITLES:
        return False
    a, b = low(a), low(b)
    return b in a or max(ratio(b, a[:i]) if i else 0 for i in range(len(a))) >= 70


def test_containment_edges_equal_brute_force(spark):
    for edges, match in ((coref.partial_edges, strict), (coref.nickname_edges, fuzzy)):
        expected = {(a, b) for a, b in itertools.permutations(NAMES, 2) if contains(b.split(), a.split(), match)}
        assert expected and {(r.src, r.dst) for r in edges(named(spark)).collect()} == expected


def test_title_edges(spark):
    genders = spark.createDataFrame([("ada", "FEMALE"), ("bert", "MALE")], "name string, gender string")
    found = {(r.src, r.dst) for r in coref.title_edges(named(spark), genders).collect()}
    assert {("Mr. Lind", "Bert Lind"), ("Mrs. Lind", "Ada Lind"), ("Doctor Lind", "Ada Lind"), ("Doctor Lind", "Cora Lind"), ("Mr. Lind", "Mister Lind")} <= found
    assert not {("Mr. Lind", "Ada Lind"), ("Mrs. Lind", "Bert Lind"), ("Mr. Lind", "Mrs. Lind"), ("Mr. Lind", "Bert Moor"), ("Mr. Lind", "Cora Lind")} & found
    same = spark.createDataFrame([("b", "Mr. Moor"), ("b", "Mister Moor")], "book_id string, gram_key string").withColumn("gram", F.split("gram_key", " "))
    assert coref.title_edges(same).count() == 2 and coref.title_edges(same, literal=True).count() == 0


def test_marks_go_from_letters(spark):
    df = spark.createDataFrame([("\u0150rs \u201c\u00e9\u201d \u017bak \u2014 Ng\u0169g\u0129 e\u0301 \u00df \u65e5 \u00d0\u00f3",)], "a string")
    assert df.select(ft.normalized(F.col("a"))).first()[0] == 'Ors "e" Zak - Ngugi e   o'


def test_nested_blocks(spark):
    page = '<p>x</p><div class="c" id="k1">title line\n a <div>b <div class="c">in</div></div> <!-- ad <div> --> tail. Read an in-depth analysis of X.</div><div class="d">no</div><div id="k2" class="c">open'
    df = spark.createDataFrame([(page,), ("",)], "h string")
    rows = [[tuple(x) for x in r[0]] for r in df.select(ft.html_blocks(F.col("h"), "c")).collect()]
    assert rows == [[("k1", "title line a b in tail."), ("k2", "open.")], []]
    assert df.select(ft.html_blocks(F.col("h"), "c", True)).first()[0][0].text == "a b in tail."


def test_headers_go(spark):
    df = spark.createDataFrame([("junk\n*** START OF THE BOOK X ***\nbody\nmore\n*** END OF THE BOOK X ***\nlicence",), ("plain text",)], "t string")
    assert [r[0].strip() for r in df.select(ft.strip_headers(F.col("t"))).collect()] == ["body\nmore", "plain text"]


def test_alignment(spark):
    from narrascope.operators import tokens as t

    assert t.aligned(["a", "b", "c"], ["a", "*NL*", "*NL*", "b", "c"]) == [(0, 0), (2, 3), (0, 4)]
    assert t.aligned(["well-", "known", "man"], ["well-known", "*NL*", "man"])[0] == (0, 0)  # part of a line
    assert t.aligned(["ab", "c"], ["a", "b", "c"]) == [(0, 1), (0, 2)]  # two lines make up one word
    assert t.aligned(["x", "gone", "y"], ["x", "y"]) == [(0, 0)]
    tokens = spark.createDataFrame([("b", 0, "a"), ("b", 1, "c"), ("d", 0, "z"), ("e", 0, None)], "book_id string, pos int, word string")
    lines = spark.createDataFrame([("b", 0, "a"), ("b", 1, "*NL*"), ("b", 2, "c"), ("d", 0, "q")], "book_id string, line int, text string")
    assert {(r.book_id, r.word, r.nl_before, r.line) for r in t.align(tokens, lines).collect()} == {("b", "a", 0, 0), ("b", "c", 1, 2), ("d", "z", None, None), ("e", None, 0, -1)}


def test_token_scores(spark):
    cases = {("grey", "gray"): 1.0, ("Linds", "Lind"): 0.0, ("John", "J."): 0.5, ("Mr.", "Mrs."): 0.0, ("Lindmoore", "Lindmore"): 0.94, ("Tom", "Sid"): 0.0}
    df = spark.createDataFrame([(a, b) for a, b in cases], "a string, b string")
    assert {(r.a, r.b): round(r.x, 2) for r in df.select("a", "b", m.token_score(F.col("a"), F.col("b")).alias("x")).collect()} == cases


def test_reference_scores(spark):
    cases = {("Bert Lind", "Bert Lind"): 3.0, ("Bert Lind", "Bert"): 1.5, ("Bert Lind", "Lind"): 0.9, ("Bert", "Bert Lind"): 0.0, ("Bert Lind", "Mr. Lind"): 1.1, ("Ada Lind", "Mr. Lind"): 0.0, ("Mr. Lind", "Mrs. Lind"): 0.0}
    df = spark.createDataFrame([(a, b) for a, b in cases], "a string, b string")
    sex = F.when(F.col("a").startswith("Bert"), "MALE").when(F.col("a").startswith("Ada"), "FEMALE")
    assert {(r.a, r.b): round(r.x, 6) for r in df.select("a", "b", m.reference_score(F.split("a", " "), F.split("b", " "), sex).alias("x")).collect()} == cases


def test_assignment_is_best():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(60):
        w = np.round(rng.random((rng.integers(1, 5), rng.integers(1, 5))) * (rng.random() < 0.9), 2)
        w[rng.random(w.shape) < 0.4] = 0
        rows, columns = w.shape
        best = (0, 0.0)
        for k in range(min(rows, columns) + 1):
            for r in itertools.combinations(range(rows), k):
                for c in itertools.permutations(range(columns), k):
                    if all(w[i, j] > 0 for i, j in zip(r, c)):
                        best = max(best, (k, round(sum(w[i, j] for i, j in zip(r, c)), 6)))
        found = labels.assignment(w)
        assert (len(found), round(sum(w[i, j] for i, j in found), 6)) == best


def test_text_functions(spark):
    df = spark.createDataFrame([("Berta (Bo) Smith", "the Arnolds", "Bob's", "http://x/lit/tom/", "/a/tom_sawyer.txt", "able_seaman.n.01")], "a string, b string, c string, d string, e string, f string")
    r = df.select(
        ft.nickname_references(F.col("a")), ft.family_name(F.col("b")), ft.strip_possessive(F.col("c")), ft.url_slug(F.col("d"), "http://x/lit/"), ft.book_stem(F.col("e")), ft.synset_word(F.col("f")), ft.name_tokens(F.lit("Tom, the boy's dog")), ft.name_width(F.lit("Bert Lind")), ft.coref_sex(F.array(F.lit("Tom"), F.lit("his"))), ft.section_short(F.lit("chapter"))
    ).first()
    assert list(r) == [["Bo", "Berta Smith", "Bo Smith"], "Arnold", "Bob", "tom", "tom", "able seaman", ["Tom", "the", "boy", "'s", "dog"], 3, "MALE", "cp"]
    tokens = spark.sql("SELECT array(named_struct('word', 'Mr.', 'begin', 0, 'end', 3), named_struct('word', 'Lind', 'begin', 4, 'end', 8), named_struct('word', '\\'s', 'begin', 8, 'end', 10)) AS t")
    assert tokens.select(ft.span_text(F.col("t"), F.lit(0), F.lit(3))).first()[0] == "Mr. Lind's"


def test_alignment_in_the_row(spark, tmp_path):
    from narrascope.operators import tokens as t
    from narrascope.plans import table_queries

    docs = spark.createDataFrame([("b", ["a", "c"], ["a", "*NL*", "c"]), ("d", ["z"], ["a"]), ("e", [None], []), ("f", None, None)], "book_id string, words array<string>, lines array<string>")
    assert {r.book_id: (r.nl_before, r.line) for r in t.aligned_rows(docs).collect()} == {"b": ([0, 1], [0, 2]), "d": ([None], [None]), "e": ([0], [-1]), "f": ([], [])}
    # documents of one number are walked apart
    spark.createDataFrame([(1, "a\n\nb"), (1, "c\nd\n"), (2, "\n"), (3, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = table_queries.aligned_tokens(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(1, 2, 1), (1, 2, 2)]
    assert "Exchange" not in found._jdf.queryExecution().toString()


def test_alignment_of_many_rows_at_once():
    import pyarrow as pa

    from narrascope.operators import tokens as t

    lines = [["*NL*", "a", "*NL*", "*NL*", "b", "*NL*"], [], ["c"], ["*NL*"], ["d", "*NL*", "e"]]
    words = [[x for x in row if x != "*NL*"] for row in lines]
    kind = pa.list_(pa.string())
    newlines, places = (x.to_pylist() for x in t._aligned_alike(pa.array(words, kind), pa.array(lines, kind)))
    assert [list(zip(*row)) for row in zip(newlines, places)] == [t.aligned(w, s) for w, s in zip(words, lines)]
    for w, s in (([["a"], ["b"]], [["a", "b"], []]), ([[""]], [[""]]), ([["x"]], [["y"]]), ([None], [["a"]])):
        assert t._aligned_alike(pa.array(w, kind), pa.array(s, kind)) is None
