"""The complete feature vectors and the functions of a whole run."""

import pytest
from pyspark.sql import functions as F

from narrascope import api
from narrascope.operators import candidates as c
from narrascope.operators import coref
from narrascope.operators import cooccurrence as co
from narrascope.plans import features as f
from narrascope.plans import text_queries


def test_numbers_of_features():
    assert len(f.CHARACTER) == len(set(f.CHARACTER)) == 110
    assert 2 * len(f.CHARACTER) + len(f.WIDE_PAIR) * (1 + len(coref.KINDS)) == 382


def test_vectors(spark):
    rows = [(1, 1, 1, "A"), (1, 1, 1, "A B"), (1, 1, 2, "A B"), (1, 2, 3, "A"), (1, 2, 3, "C"), (2, 3, 4, "C")]
    occ = co.to_sections(spark.createDataFrame([("b", *r) for r in rows], "book_id string, cp_id int, pg_id int, st_id int, item string"))
    base = spark.createDataFrame([("b", n, k, len(n.split()), 9, 4, 3, 2, k / 9, k / 6) for n, k in (("A", 2), ("A B", 2), ("C", 2), ("D", 0))], "book_id string, gram_key string, count int, length int, book_num_chars int, book_num_st int, book_num_pg int, book_num_cp int, count_norm_length double, count_norm_char double")
    names = base.select("book_id", "gram_key", F.split("gram_key", " ").alias("gram"))
    tags = spark.createDataFrame([("b", "A", 1.0, 1.0, 1, 1)], "book_id string, gram_key string, avg_ner double, avg_last_ner double, avg_cap int, avg_last_cap int")
    closed = coref.closure(coref.partial_edges(names))
    v = f.character_features(base, occ, tags, closed)
    assert v.columns == ["book_id", "gram_key", *f.CHARACTER]
    r = {x.gram_key: x for x in v.collect()}
    assert (r["A"].count_st, r["A"].cooc_cand_st, r["A"].coref_longer, r["A"].coref_longer_count_st, r["A"].coref_shorter) == (2, 4, 1, 2, 0)
    assert (r["A B"].coref_shorter, r["A B"].coref_shorter_count, r["A"].avg_ner, r["C"].avg_ner) == (1, 2, 1.0, 0.0)
    assert r["D"].count_st == 0  # in no section: zeros
    weights = base.select("book_id", F.col("gram_key").alias("item"), F.col("count_norm_char").alias("w"))
    p = f.pair_features(v, names, occ, weights, closed)
    assert len(p.columns) == 3 + 382 + 1
    q = {(x.gram1, x.gram2): x for x in p.collect()}
    assert len(q) == 12 and q["A", "A B"].coref == 1 and q["A", "C"].coref == 0
    assert (q["A", "C"].cooc_st, q["A B", "C"].cooc_st, q["A B", "C"].cooc_st_se, q["A", "C"].cooc_st_le, q["A", "A B"]["1_count"]) == (1, 0, 1, 0, 2)
    assert q["A", "C"].cooc_bool_norm_char_st == pytest.approx(2 / 6)


def test_candidates_of_a_text(spark):
    text = "\n\n".join(["then Tom Moor ran. so Tom slept. then Tom Moor fell."] * 4)
    found = {r.gram_key: r.n for r in api.candidates(spark.createDataFrame([("b", 1, text)], "source string, doc_id int, text string")).collect()}
    assert found["Tom Moor"] == 8 and found["Tom"] == 12


def test_descriptions(spark):
    html = '<div class="content_txt" id="Tom"><p>A boy</p><!-- ad --></div><div class="ad">x</div><div class="content_txt" id="Sid">His brother.</div>'
    assert [tuple(r) for r in api.descriptions(spark.createDataFrame([(1, html)], "page_id int, html string"), "content_txt").collect()] == [(1, 0, "Tom", "A boy."), (1, 1, "Sid", "His brother.")]


def test_names_of_the_vector_queries(spark, tmp_path, monkeypatch):
    text = "\n".join(["Alpha Beta Gamma Delta Epsilon Zeta Eta met " + " ".join(f"N{i}" for i in range(40)) + "."] * 5)
    spark.createDataFrame([(1, text, "en", "b", len(text))], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    counts = text_queries.gram_counts(c.windows(text_queries.sentences(spark, str(tmp_path)), [*c.SENTENCE, "pg_id"], 7))
    kept = {r.gram_key for r in c.percent_filter(counts).collect()}
    assert {len(n.split()) for n in kept} == {1, 2, 3, 4, 5, 6, 7}
    found, names = text_queries._candidates(spark, str(tmp_path))
    assert {r.gram_key for r in names.collect()} == kept
    labelled = {r.gram_key for r in text_queries.labelled_names(spark, str(tmp_path), names).where("label = 1").collect()}
    monkeypatch.setattr(f, "character_features", lambda base, *others: base)
    characters = {r.gram_key for r in text_queries.character_features(spark, str(tmp_path)).collect()}
    assert characters <= kept and max(len(n.split()) for n in characters) == 7 and len(characters) > 6
    monkeypatch.setattr(f, "pair_features", lambda vectors, names, *others: names)
    paired = {r.gram_key for r in text_queries.pair_features(spark, str(tmp_path)).collect()}
    # of the labelled names, those that are the longest at some place
    assert "Alpha Beta" in labelled and "N1" not in labelled and paired and paired <= labelled
