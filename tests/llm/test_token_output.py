import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from narrascope.llm import token_output as t
from narrascope.llm.textkernel import SPACED, Words, WordTable, marks


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=400), st.sampled_from([5, 64, 1024]))
def test_round_trip(ids, block):
    a = np.array(ids, np.uint64)
    p = t.pack(a, block)
    assert (t.unpack(p) == a).all() and len(t.unpack(p)) == len(a)
    assert (t.unpack(p, 1, 2) == a[block : 2 * block]).all()


def test_payload_is_dense():
    assert len(t.pack(np.zeros(1024, np.uint64))) < 250
    assert len(t.pack(np.full(1024, 4000, np.uint64))) < 1024 * 2  # 12 bits each


def test_word_table():
    words = [f"w{i}".encode() for i in range(50_000)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    w = Words(data, np.array([0, len(data)]), SPACED)
    h, second = w.hashes(), marks(w)
    table = WordTable(4)
    for s in range(0, 50_000, 7_000):
        n = np.arange(s, min(s + 7_000, 50_000), dtype=np.int32)
        assert (table.find(h[n], second[n]) == -1).all()
        table.add(h[n], second[n], n)
    assert (table.find(h, second) == np.arange(50_000)).all()
    assert (table.find(h[:9], second[:9] + np.uint64(1)) == -1).all()


def check(found, rows, tokenizer):
    start = 0
    assert len(found) == len(rows)
    for (doc, text), r in zip(rows, found):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_equals_the_library(spark, documents, texts):
    from tokenizers import Tokenizer

    odd = spark.createDataFrame([(91000, "it's a \x02 test  <|endoftext|> H̱ ẖ don't 12345 café é İ ΣΣ ½²"), (91001, "ABC abc aBc \x85 \xa0x")], "doc_id bigint, text string")
    rows = sorted(((i, x or "") for i, x in [*texts, *map(tuple, odd.collect())]), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    found = t.op10_token_output(documents.select("doc_id", "text").union(odd)).orderBy("start").collect()
    check(found, rows, Tokenizer.from_file(t.word_tokenizer()))


def test_tokenizer_that_keeps_white_space(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, " a  b\n c"), (2, ""), (3, "x  ")]
    found = t.op10_token_output(spark.createDataFrame(rows, "doc_id bigint, text string"), path).orderBy("start").collect()
    check(found, rows, Tokenizer.from_file(path))


def test_empty(spark, documents):
    assert t.op10_token_output(documents.limit(0)).count() == 0


def twins():
    """Two words of 1,032 bytes that a polynomial modulo 2**64 can't tell apart."""
    signs = "p"
    while len(signs) < 1024:
        signs += signs.translate(str.maketrans("pq", "qp"))
    return "x" * 8 + signs, "x" * 8 + signs.translate(str.maketrans("pq", "qp"))


def test_words_of_regular_build_keep_their_ids(monkeypatch):
    from tokenizers import Tokenizer

    a, b = twins()
    rows = [a, b, f"{b} {a} one", "one two three one"]
    tokenizer = Tokenizer.from_file(t.word_tokenizer())

    def encoded():
        data = "".join(rows).encode()
        ids, counts = t.WordEncoder(t.word_tokenizer()).encode(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, rows)]), 1)
        return ids.tolist(), counts.tolist()

    wanted = [[*tokenizer.encode(x, add_special_tokens=False).ids, 1] for x in rows]
    assert encoded() == (sum(wanted, []), [len(x) for x in wanted])
    # even if all words had one hash and one mark
    monkeypatch.setattr(Words, "hashes", lambda self, values=None: np.full(len(self), 7, np.uint64))
    monkeypatch.setattr(t, "marks", lambda words: np.full(len(words), 7, np.uint64))
    assert encoded() == (sum(wanted, []), [len(x) for x in wanted])


def test_a_worker_collects_garbage_again(spark):
    import gc

    t.encoder(t.word_tokenizer())
    assert gc.isenabled()
