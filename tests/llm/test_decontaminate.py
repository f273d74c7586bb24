import hashlib
from collections import Counter

import narrascope.llm.decontaminate as d

from llm_words import alphanumeric

EXTRA = [(900, "the of"), (901, "Was"), (902, ""), (903, None), (904, "one two three four five six seven eight nine"), (None, "words here")]


def brute(texts, items):
    windows = {}
    for i, text in items:
        words = alphanumeric(text)
        k = min(10, len(words))
        for j in range(len(words) - k + 1 if k else 0):
            windows.setdefault(tuple(words[j : j + k]), set()).update([] if i is None else [str(i)])
    out = Counter()
    for i, text in texts:
        words, hit, found = alphanumeric(text), set(), set()
        for k in {len(w) for w in windows}:
            for j in range(len(words) - k + 1):
                if (w := tuple(words[j : j + k])) in windows:
                    found |= windows[w]
                    hit.update(range(j, j + k))
        out[(i, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    return out


def result(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


def test_equals_brute_force(spark, folder, documents, texts, monkeypatch):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    more = items.union(spark.createDataFrame(EXTRA, items.schema))
    for table, block in ((items, 200_000), (more, 200_000), (more, 700)):  # the last in several blocks
        monkeypatch.setattr(d, "BLOCK_WORDS", block)
        assert result(d.op1_contamination(documents, table)) == brute(texts, [tuple(r) for r in table.collect()])


def test_removal_leaves_nothing_and_clean_rows_alone(spark, folder, documents):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    before = {r[0]: r[1] for r in d.op1_contamination(documents, items).select("doc_id", "contaminated").collect()}
    cleaned = d.remove_contamination(documents, items, length_column="n_chars")
    assert cleaned.columns == documents.columns
    assert d.op1_contamination(cleaned, items).where("contaminated").count() == 0
    kept = {(r.doc_id, r.text) for r in cleaned.select("doc_id", "text").collect()}
    assert all((r.doc_id, r.text) in kept for r in documents.select("doc_id", "text").collect() if not before[r.doc_id])


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert d.op1_contamination(documents, items).where("contaminated").count() == 0
    assert d.op1_contamination(documents.limit(0), items).count() == 0


def test_span_limit_and_short_items(spark):
    item = "a b c d e f g h i j k l m n o p q r s t u v"
    items = spark.createDataFrame([(1, item), (2, "seven short words")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k y " + "z " * 30), (2, "x " + item + " y " + "z " * 30), (3, "the seven Short, words here " + "z " * 30)], "doc_id bigint, text string")
    kept = lambda **o: {r.doc_id: " ".join(r.text.replace("z", "").split()) for r in d.remove_contamination(docs, items, **o).collect()}
    assert kept() == {1: "x y", 2: "x y", 3: "the here"}
    assert kept(span_limit=15) == {1: "x a b c d e f g h i j k y", 2: "x y", 3: "the here"}
    assert set(kept(coverage_limit=0.3)) == {1, 3}


def test_number_of_item_blocks_changes_no_removal(spark, monkeypatch):
    alphabet = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    items = spark.createDataFrame([(1, " ".join(alphabet[:20])), (2, " ".join(alphabet[10:30])), (3, " ".join(alphabet[40:60])), (4, "seven short words")], "item_id bigint, text string").coalesce(1)
    rest = " ".join(f"z{i}" for i in range(28))
    docs = [(1, f"{' '.join(alphabet[:12])} {' '.join(alphabet[40:52])} {rest[:59]}"), (2, f"x {' '.join(alphabet[:30])} y {rest} {rest}"), (3, f"the seven short words {' '.join(alphabet[41:50])} {rest}"), (4, rest), (5, None)]
    df = spark.createDataFrame([(*x, "k") for x in docs], "doc_id bigint, text string, spans string")
    found = []
    for block in (200_000, 20):
        monkeypatch.setattr(d, "BLOCK_WORDS", block)
        found.append({r.doc_id: r.text for r in d.remove_contamination(df, items).collect()})
    assert found[0] == found[1]
    assert 1 not in found[1] and found[1][2] == f"x  y {rest} {rest}" and found[1][4] == rest and found[1][5] is None


def test_words_are_compared_not_hashes(spark, monkeypatch):
    import numpy as np

    words = [f"w{i}" for i in range(12)]
    one = d.SuffixAutomaton([("a", [w.encode() for w in words])], 10)
    text = " ".join(["other", *words[:9], "w99", *words[1:]]).encode()
    monkeypatch.setattr(d.Words, "hashes", lambda self, values=None: np.full(len(self), 7, np.uint64))
    one.filter[:] = True
    found = one.matches(d.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), d.ALPHANUMERIC))
    assert {k: v[0] for k, v in found.items()} == {0: [[11, 22]]}


def test_item_without_an_id_is_removed(spark):
    item = "a b c d e f g h i j k l"
    items = spark.createDataFrame([(None, item)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"x {item} y " + "z " * 30)], "doc_id bigint, text string")
    row = d.op1_contamination(docs, items).first()
    assert (row.n_hit, row.n_items, row.contaminated) == (12, 0, True)
    assert " ".join(d.remove_contamination(docs, items).first().text.replace("z", "").split()) == "x y"


def test_very_long_text(spark):
    item = "a b c d e f g h i j k l"
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "word " * 400_000 + item + " end" * 400_000)], "doc_id bigint, text string")
    row = d.op1_contamination(docs, items).first()
    assert (row.n_words, row.n_hit) == (800_012, 12)
    assert d.remove_contamination(docs, items).first().text == "word " * 400_000 + " end" * 400_000
