"""Hand-made cases of sections, candidates, co-occurrence, labels, relations, learning and storage."""

import pytest
from pyspark.sql import functions as F

from narrascope.operators import candidates as c
from narrascope.operators import cooccurrence as co
from narrascope.operators import coref, crossref, labels, learning, relations
from narrascope.operators import tokens as t
from narrascope.sources import readers, sinks


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(1, 1, 1, "A"), (1, 1, 1, "A"), (1, 1, 1, "B"), (1, 1, 2, "B"), (1, 2, 3, "A"), (1, 2, 3, "C"), (2, 3, 4, "C"), (2, 3, 5, "A"), (2, 3, 5, "B")]
    occ = co.to_sections(spark.createDataFrame([("b", *r) for r in rows], "book_id string, cp_id int, pg_id int, st_id int, item string"))
    weights = spark.createDataFrame([("b", "A", 4 / 9), ("b", "B", 3 / 9), ("b", "C", 2 / 9)], "book_id string, item string, w double")
    return occ, weights


GOLDEN = {
    "count_s": ([3, 3, 2], [3, 2, 2], [2, 2, 2]),
    "count_norm_length_s": ([0.6, 0.6, 0.4], [1, 2 / 3, 2 / 3], [1, 1, 1]),
    "count_norm_char_s": ([0.375, 0.375, 0.25], [3 / 7, 2 / 7, 2 / 7], [1 / 3] * 3),
    "cooc_cand_s": ([6, 5, 3], [7, 5, 5], [6, 6, 6]),
    "cooc_cand_norm_sec_s": ([0.354167, 0.375, 0.291667], [0.346939, 0.342857, 0.342857], [1 / 3] * 3),
    "cooc_cand_norm_char_s": ([0.370370, 0.377778, 0.296296], [0.349206, 0.355556, 1 / 3], [1 / 3] * 3),
    "cooc_cand_dd_norm_sec_s": ([1, 0.75, 0.625], [1, 1, 1], [1, 1, 1]),
    "cooc_cand_dd_norm_char_s": ([1, 0.777778, 0.666667], [1, 1, 1], [1, 1, 1]),
    "cooc_sec_s": ([3, 3, 2], [3, 2, 2], [2, 2, 2]),
}


def test_section_features(golden):
    r = {(x.section_type, x.item): x for x in co.features(*golden).collect()}
    for name, expected in GOLDEN.items():
        for s, values in zip(("st", "pg", "cp"), expected):
            assert [r[s, i][name] for i in "ABC"] == pytest.approx(values, abs=1e-6), (name, s)
    one = {(x.section_type, x.item): x.cooc_sec_s for x in co.with_major(*golden, major=1).collect()}
    assert [one["st", i] for i in "ABC"] == [3, 2, 1]


def test_pairs_are_symmetric(golden):
    p = {(x.section_type, x.item, x.other): x.cooc for x in co.pairs(golden[0]).collect()}
    assert all(p[s, b, a] == n for (s, a, b), n in p.items())
    assert [p["st", "A", x] for x in "ABC"] == [3, 2, 1] and ("st", "B", "C") not in p
    f = {(x.section_type, x.item, x.other): x for x in co.pair_features(*golden).collect()}
    assert f["st", "A", "B"].cooc_norm_sec == pytest.approx(2 / 6 * 0.375) and ("st", "A", "A") not in f


def tagged(spark, *sentences):
    rows = [("b", 0, str(s), i, *x.rsplit("/", 1)) for s, text in enumerate(sentences) for i, x in enumerate(text.split())]
    return spark.createDataFrame(rows, "book_id string, cp_id int, st_id string, tok_idx int, word string, pos string")


def phrases(df, persons=("helmsman",)):
    return sorted((int(r.st_id), " ".join(r.gram)) for r in c.noun_phrases(df, persons).collect())


def test_noun_phrases(spark):
    found = phrases(
        tagged(
            spark,
            "Tom/NNP ran/VBD",  # at the start: not counted
            "then/RB Tom/NNP Moor/NNP ran/VBD",
            "saw/VBD the/DT Count/NNP of/IN Monte/NNP Cristo/NNP",  # hop over a preposition
            "and/CC the/DT helmsman/NN slept/VBD",  # from the lexicon
            "said/VBD Mr./NNP",  # a bare title
            "met/VBD old/JJ Mr./NNP Lind/NNP",
        )
    )
    hopped = ["Count", "Count of Monte", "Count of Monte Cristo", "Monte", "Monte Cristo", "the Count", "the Count of Monte", "the Count of Monte Cristo"]
    assert found == [(1, "Tom"), (1, "Tom Moor"), *((2, x) for x in hopped), (3, "the helmsman"), (5, "Mr. Lind")]


def test_longest_matches(spark):
    s = spark.createDataFrame([("b", 0, "0", 0, ["x", "Tom", "Moor", "and", "Tom"])], "book_id string, cp_id int, st_id string, pg_id int, w array<string>")
    grams = c.windows(s, [*c.SENTENCE, "pg_id"], 3)
    names = spark.createDataFrame([("b", "Tom"), ("b", "Tom Moor"), ("b", "Moor")], "book_id string, gram_key string")
    assert {r.gram_key: r.n for r in c.longest_suffix_counts(grams, names).collect()} == {"Tom": 2, "Tom Moor": 1}
    kept = c.two_sided(grams, names)
    assert {r.gram_key for r in kept.collect()} == {"Tom", "Tom Moor"}
    assert [r.gram_key for r in c.dropped(names, kept).collect()] == ["Moor"]


def test_percent_filter_keeps_all_of_few(spark):
    df = spark.createDataFrame([("b", f"g{i}", 1, 3 + i) for i in range(3)] + [("b", "a b c d e f", 6, 3), ("b", "a b c d e f g h", 8, 9)], "book_id string, gram_key string, length int, n int")
    assert {r.gram_key for r in c.percent_filter(df).collect()} == {"g0", "g1", "g2", "a b c d e f"}
    assert c.flex_filter(df).count() == 0


def test_newline_sections(spark):
    text = "A b.\nC d.\n\nE f.\n\n\nG h."
    toks = spark.createDataFrame([("b", text)], "book_id string, text string").select("book_id", F.posexplode(t.newline_tokens(F.col("text"))).alias("i", "x")).select("book_id", "x.*", F.when(F.col("x.word").rlike("[ACEG]"), 0).otherwise(1).alias("tok_idx"))
    r = {x.word: (x.pg_id, x.cp_id, x.begin) for x in t.sections(toks).collect() if x.word in "ACEG"}
    assert r == {"A": (1, 1, 0), "C": (1, 1, 5), "E": (2, 1, 11), "G": (3, 2, 18)}
    assert tuple(t.book_stats(t.sections(toks)).first()) == ("b", 18, 4, 3, 2)
    assert t.complete(t.sections(toks), toks).count() == 0


def test_sentences_keep_titles(spark):
    s = t.sentence_words(spark.createDataFrame([("b", 1, "Mr. Lind's dog ran. He slept.\n\nEnd"), ("b", 2, None), ("b", 3, "")], "source string, doc_id int, text string"))
    assert [(r.st_id, r.w) for r in s.orderBy("st_id").collect()] == [("0-0", ["Mr.", "Lind", "'s", "dog", "ran", "."]), ("0-1", ["He", "slept", "."]), ("1-0", ["End"])]


def test_as_of(spark):
    tok = spark.createDataFrame([("b", 0), ("b", 5), ("b", 9)], "book_id string, begin int")
    mark = spark.createDataFrame([("b", 1, 5), ("b", 2, 8)], "book_id string, marker int, begin int")
    assert [r.section_id for r in t.as_of_sections(tok, mark).orderBy("begin").collect()] == [None, 1, 2]


def test_closure_is_idempotent_and_cyclic(spark):
    e = spark.createDataFrame([("b", x, y) for x, y in ("ab", "bc", "ca", "cd")], "book_id string, src string, dst string")
    once = {tuple(r) for r in coref.closure(e).collect()}
    assert once == {("b", x, y) for x in "abc" for y in "abcd" if x != y}
    assert {tuple(r) for r in coref.closure(coref.closure(e)).collect()} == once


def test_unique_of_mutual_names(spark):
    n = spark.createDataFrame([("b", "D'Artagan", ["D'Artagan"]), ("b", "d'Artagan", ["d'Artagan"])], "book_id string, gram_key string, gram array<string>")
    assert [r.gram_key for r in coref.unique_names(n, coref.closure(coref.partial_edges(n))).collect()] == ["d'Artagan"]


def test_relation_labels_in_both_directions(spark):
    edges = spark.createDataFrame([("b", "A", "a", 1.0), ("b", "B", "b", 1.0)], "book_id string, character string, gram_key string, weight double")
    names = spark.createDataFrame([("b", "a"), ("b", "b"), ("b", "x")], "book_id string, gram_key string")
    marked = labels.candidate_labels(names, edges)
    rel = spark.createDataFrame([("b", "A", "B")], "book_id string, c1 string, c2 string")
    got = lambda literal: {(r.gram1, r.gram2): r.label for r in labels.pair_labels(marked, edges, rel, literal).collect()}
    assert got(False) == {("a", "b"): 1, ("b", "a"): 1} and got(True) == {("a", "b"): 1, ("b", "a"): 0}
    assert labels.unresolved_rates(spark.createDataFrame([("b", "A"), ("b", "C")], "book_id string, character string"), edges).first().unresolved == 0.5


def test_relations(spark):
    p = spark.createDataFrame([("b", 0, "Guy (Monty) Montag", "He met Clarisse and the Montags here."), ("b", 1, "Clarisse", "Mildred Montag knew her."), ("b", 2, "Mildred Montag", "Nobody.")], "book_id string, paragraph_id int, heading string, text string")
    assert {(r.c1, r.c2) for r in relations.from_descriptions(p).collect()} == {("Clarisse", "Guy (Monty) Montag"), ("Clarisse", "Mildred Montag"), ("Guy (Monty) Montag", "Mildred Montag")}
    owned = relations.owners(p)
    found = relations.mentions(relations.sentences(p), relations.references(owned), relations.families(owned))
    assert "Montag" not in {r.reference for r in found.collect()}
    text = spark.createDataFrame([("b", "Mrs. Montag", "")], "book_id string, text string, sex string")
    extra = relations.resolve_mentions(text, relations.references(owned), owned)
    assert {(r.reference, r.character) for r in extra.collect()} <= {("Mrs. Montag", "Mildred Montag"), ("Mrs. Montag", "Guy (Monty) Montag")}
    words = spark.createDataFrame([(["he"], None, "PRP"), (["dog"], "DT", "NN"), (["Tom", "Lind"], None, "NNP"), (["Tom"] * 9, None, "NNP")], "words array<string>, before_pos string, first_pos string")
    assert relations.valid_mentions(words, 5).count() == 1


def test_compare_and_measures(spark):
    rows = lambda *x: spark.createDataFrame([("b", *r) for r in x], "book_id string, c1 string, c2 string")
    assert tuple(relations.compare(rows(("a", "b"), ("a", "c")), rows(("a", "b"))).first())[1:] == (0.5, 1.0)
    p = spark.createDataFrame([("none", 1, 0), ("empty", 0, 1), ("both", 1, 1)], "book_id string, label int, prediction int")
    r = {x.book_id: (x.precision, x.recall) for x in learning.precision_recall(p).collect()}
    assert r == {"none": (1.0, 0.0), "empty": (0.0, None), "both": (1.0, 1.0)}
    assert tuple(learning.macro(learning.precision_recall(p)).first()) == (pytest.approx(2 / 3), 0.5)


def test_crossref(spark):
    books = spark.createDataFrame([("a", "Emma", "Jane Austen", "x"), ("b", "Ulysses", "James Joyce", "x"), ("c", "Nothing", "No One", "x"), ("d", "Hamlet", "W S", "a play"), ("e", "Emma", "J A", None), ("f", "Emma", "x y", "x")], "book_id string, title string, author string, description string")
    index = spark.createDataFrame([(9, "Emma, by Jane Austen"), (3, "Emma\nby Austen\n language: english"), (1, "Emma by Austen\nlanguage: french"), (5, "Ulysses, a guide")], "entry_id int, entry string")
    found = crossref.crossref(books, index, spark.createDataFrame([("f",)], "book_id string"))
    assert {(r.book_id, r["class"], r.entry_id) for r in found.collect()} == {("a", "good", 3), ("b", "ugly", 5), ("c", "bad", None), ("d", "bad", None), ("e", "bad", None)}
    assert {r.book_id for r in crossref.new_blacklist(found, spark.createDataFrame([("f",)], "book_id string")).collect()} == {"c", "d", "e", "f"}
    assert tuple(crossref.tally(found).first()) == (1, 3, 1)


def test_tag_features(spark):
    occ = spark.createDataFrame([("b", "the Tom Lind", ["the", "Tom", "Lind"], ["O", "PERSON", "PERSON"]), ("b", "the Tom Lind", ["the", "Tom", "Lind"], ["O", "O", "O"])], "book_id string, gram_key string, gram array<string>, ners array<string>")
    assert list(crossref.tag_features(occ).first())[2:] == [pytest.approx(1 / 3), 0.5, 2, 1]
    assert crossref.tag_features(occ, literal=True).first().avg_last_ner == 0


def test_classifiers_learn_and_load(spark, tmp_path):
    df = spark.range(600).selectExpr("concat('b', id % 6) AS book_id", "string(id) AS gram_key", "double(id % 20) AS x", "double((id * 7) % 13) AS y", "int((id % 20 > 9) = ((id * 7) % 13 > 6)) AS label")
    frame = learning.training_frame(learning.scaled(df, df, ["x", "y"]), df, ["book_id", "gram_key"], ["x", "y"], 1.0)
    for name, least in (("rf", 0.9), ("grad_boost", 0.9), ("svm", 0.85), ("erf", 0.6), ("ada_boost", 0.6)):
        model = learning.train(frame, name, gamma=0.5)
        assert model.transform(frame).select(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] > least, name
        learning.save_model(model, frame, str(tmp_path / name))
        again, books = learning.load_pipeline(spark, str(tmp_path / name))
        votes = lambda m: {(r.gram_key, r.prediction) for r in m.transform(frame).select("gram_key", "prediction").collect()}
        assert books.count() == 6 and votes(again) == votes(model), name
    square = df.withColumn("label", F.expr("int((x - 10) * (y - 6) > 0)"))
    for kernel, fits in (("poly", True), ("linear", False)):
        frame = learning.training_frame(learning.scaled(square, square, ["x", "y"]), square, ["book_id", "gram_key"], ["x", "y"], 1.0)
        model = learning.train(frame, "svm", kernel=kernel, degree=2)
        assert (model.transform(frame).select(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] > 0.85) == fits
    assert learning.matching_columns(["count", "count_st", "cooc_st"], ["count.*"]) == ["count", "count_st"]


def test_baselines(spark):
    pairs = spark.createDataFrame([("b", f"a{i:02}", "z", i / 40) for i in range(21)], "book_id string, gram1 string, gram2 string, cooc_pg double")
    assert learning.baseline_pairs(pairs).where("prediction = 1").count() == 3
    assert learning.baseline_pairs(pairs, threshold=0.1).where("prediction = 1").count() == 16


def test_files(spark, tmp_path):
    (tmp_path / "books").mkdir()
    (tmp_path / "books" / "tom_sawyer.txt").write_text("h1\nh2\nTom\n*NL*\nran\n")
    d = str(tmp_path / "books")
    assert [(r.book_id, r.line_no, r.token) for r in readers.token_lines(spark, d).orderBy("line_no").collect()] == [("tom", 0, "Tom"), ("tom", 1, "*NL*"), ("tom", 2, "ran")]
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "emma.xml").write_text('<root><document><sentences><sentence id="1"><tokens><token id="1"><word>Emma</word><lemma>Emma</lemma><CharacterOffsetBegin>0</CharacterOffsetBegin><CharacterOffsetEnd>4</CharacterOffsetEnd><POS>NNP</POS><NER>PERSON</NER></token><token id="2"><word>ran</word><lemma>run</lemma><CharacterOffsetBegin>5</CharacterOffsetBegin><CharacterOffsetEnd>8</CharacterOffsetEnd><POS>VBD</POS><NER>O</NER></token></tokens></sentence></sentences></document></root>')
    assert [tuple(r) for r in readers.annotated(spark, str(tmp_path / "xml")).orderBy("tok_idx").collect()] == [("emma", 0, 0, "Emma", "Emma", 0, 4, "NNP", "PERSON"), ("emma", 0, 1, "ran", "run", 5, 8, "VBD", "O")]
    (tmp_path / "list").write_text("Emma|Emma: a novel|Jane Austen|158, 20\n")
    assert [tuple(r) for r in readers.book_list(spark, str(tmp_path / "list")).collect()] == [("Emma", "Emma: a novel", "Jane Austen", [158, 20])]
    (tmp_path / "g1").write_text("tom\tFEMALE\nann\tFEMALE\n")
    (tmp_path / "g2").write_text("tom\n")
    assert {tuple(r) for r in readers.genders(spark, str(tmp_path / "g1"), f"{tmp_path}/g2=MALE").collect()} == {("tom", "MALE"), ("ann", "FEMALE")}
    (tmp_path / "tags").mkdir()
    (tmp_path / "tags" / "emma.txt").write_text("Émma;Anne\nAnne;Emma\n")
    assert [tuple(r) for r in readers.human_tags(spark, str(tmp_path / "tags")).collect()] == [("emma", "Anne", "Emma")]
    (tmp_path / "black").write_text(" a \nb\na\n\n")
    assert sorted(r.value for r in readers.lines(spark, str(tmp_path / "black")).collect()) == ["a", "b"]
    assert readers.optional(spark, str(tmp_path / "missing"), "book_id string").count() == 0


def test_readable_round_trip(spark, tmp_path):
    f = spark.createDataFrame([("b", "Tom", 1.0, 0.5), ("b", "Tom Moor", 2.0, 0.0), ("c", "Emma", 3.0, 1e-9)], "book_id string, gram_key string, count double, share double")
    sinks.write_readable(f, ["gram_key"], ["count", "share"], str(tmp_path / "r"))
    back = readers.readable_features(spark, str(tmp_path / "r"), ["count", "share", "coref"])
    assert {tuple(r)[1:] for r in back.collect()} == {("Tom", 1.0, 0.5, 0.0), ("Tom Moor", 2.0, 0.0, 0.0), ("Emma", 3.0, 1e-9, 0.0)}
    sinks.write_table(f, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("book_id = 'b'").count() == 2


def test_parts_and_checks(spark):
    b = spark.createDataFrame([(f"b{i}",) for i in range(7)], "book_id string")
    assert sinks.equal_parts(b, 3).groupBy("part").count().orderBy("part").collect() == [(0, 2), (1, 2), (2, 2)]
    assert sinks.equal_parts(b, 3, keep_rest=True).count() == 7
    assert [(r.book_id, r.lacks) for r in sinks.inconsistent(x=b, y=b.where("book_id <> 'b3'")).collect()] == [("b3", ["y"])]
    split = learning.split_books(b)
    assert split.where("is_train").count() == 4 and learning.test_books(b, split.where("is_train")).count() == 3


def test_mentions_begin_where_a_reference_can(spark):
    said = spark.createDataFrame([("b", 0, 0, "Mr. Tom met Sid 's aunt , Mr . Tom and the Moors of the hill here .".split(" "))], "book_id string, paragraph_id int, sent_id int, words array<string>")
    refs = spark.createDataFrame([("b", r, "x") for r in ("Mr. Tom", "Sid's aunt", "Sid", "hill", "")] + [("c", "met", "x")], "book_id string, reference string, character string")
    family = spark.createDataFrame([("b", "the Moors", "x")], "book_id string, reference string, character string")
    found = relations.mentions(said, refs, family)
    assert sorted((r.start, r.stop, r.reference) for r in found.collect()) == [(0, 2, "Mr. Tom"), (3, 6, "Sid's aunt"), (7, 10, "Mr. Tom"), (11, 13, "the Moors"), (15, 16, "hill")]
    # spans of all eight lengths are not made at every word
    assert "[1,2,3,4,5,6,7,8]" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_best_tenth_is_ranked_in_ranges(spark):
    rows = [(b, f"g{i % 17}", f"h{i}", i % 3) for b, n in (("x", 95), ("y", 3), (None, 40)) for i in range(n)]
    found = learning.baseline_pairs(spark.createDataFrame(rows, "book_id string, gram1 string, gram2 string, cooc_pg int"))
    for b, n in (("x", 95), ("y", 3), (None, 40)):
        own = sorted((-s, g, h) for x, g, h, s in rows if x == b)
        assert {(r.gram1, r.gram2) for r in found.collect() if r.book_id == b and r.prediction == 1} == {(g, h) for _, g, h in own[: n // 10 + 1]}
    # no window over a whole book's pairs
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(book_id" not in plan.split("row_number()")[1].split("\n")[0]


def test_noun_phrases_of_a_long_sentence(spark, tmp_path, monkeypatch):
    """A head walks over its part of the sentence, and no task holds more than its part of the documents."""
    from narrascope.operators import frames
    from narrascope.plans import text_queries

    text = " , ".join(["then Tom met the Moor"] * 6000)
    rows = [(i, text if i else "then Ann met Tom of the Moor", "en", "b", 0) for i in range(3)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(text_queries, "spread", lambda df, text: frames.spread(df, text, 50_000))
    found = text_queries.np_candidates(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 6
    got = {r.gram_key: r.n for r in found.collect()}
    assert got["Tom"] == 12001 and got["the Moor"] == 12001 and got["Tom of the Moor"] == 1 and got["Ann met Tom"] == 1
