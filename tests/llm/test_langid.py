import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from narrascope.llm import langid as g


def test_gradients():
    net = g.ByteNetwork(["a", "b", "c"])
    rng = np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 257, (7, 3)), np.array([0, 1, 3])  # 3: other
    _, grads = net.gradients(x, y)
    for k, grad in grads.items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old, e = net.p[k][at], 1e-3
        losses = []
        for step in (e, -e):
            net.p[k][at] = old + step
            losses.append(net.gradients(x, y)[0])
        net.p[k][at] = old
        assert abs((losses[0] - losses[1]) / (2 * e) - grad[at]) < 2e-3 * max(1, abs(grad[at]))


def test_every_byte_counts_once():
    net = g.ByteNetwork(["a", "b"])
    text = np.frombuffer(b"z" * 1000 + b"q" * 77, np.uint8)
    p = net.documents(text, np.array([0, 0, 1000, 1077]))
    assert np.allclose(p.sum(axis=1), [0, 1, 1], atol=1e-5)


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 !? 7"), (None, "the and of that")], "doc_id bigint, text string")
    rows = docs.select("doc_id", "text", "lang").unionByName(odd, allowMissingColumns=True)
    found = g.op6_language(rows)
    r = {x.doc_id: x for x in found.collect()}
    assert [r[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and [r[i].score for i in (-1, -2, -3)] == [0.0] * 3
    assert r[None].lang_pred == "en" and not r[None].held_out
    truth = dict(map(tuple, docs.select("doc_id", "lang").collect()))
    held = [x for x in r.values() if x.held_out and x.doc_id in truth]
    assert sum(x.lang_pred == truth[x.doc_id] for x in held) / len(held) > 0.95
    assert all(0 <= x.score <= 1 for x in r.values())


def test_nothing_to_learn_from(spark, documents):
    assert {x.lang_pred for x in g.op6_language(documents.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert g.op6_language(documents.limit(0)).count() == 0


def scalar(net, text):
    """The network in plain Python floats: mean probabilities over all bytes of a text, in windows from a zero state."""
    total = [0.0] * (len(net.languages) + 1)
    for begin in range(0, len(text), g.WINDOW):
        window = text[begin : begin + g.WINDOW]
        states = [[0.0] * (2 * g.UNITS) for _ in window]
        for d in (0, 1):
            embed, recur, h = net.p["embed"][d], net.p["recur"][d], [0.0] * g.UNITS
            for t in range(len(window)) if d == 0 else reversed(range(len(window))):
                pre = [float(embed[window[t], u]) + sum(h[k] * float(recur[k, u]) for k in range(g.UNITS)) for u in range(2 * g.UNITS)]
                z = [1 / (1 + math.exp(-x)) for x in pre[: g.UNITS]]
                h = [a + b * (math.tanh(c) - a) for a, b, c in zip(h, z, pre[g.UNITS :])]
                states[t][d * g.UNITS : (d + 1) * g.UNITS] = h
        for s in states:
            e = [math.exp(float(net.p["bias"][k]) + sum(s[u] * float(net.p["out"][u, k]) for u in range(2 * g.UNITS))) for k in range(len(total))]
            total = [a + b / sum(e) for a, b in zip(total, e)]
    return [x / max(1, len(text)) for x in total]


def test_predictions_equal_a_scalar_network(spark, documents):
    net = g.ByteNetwork(["x", "y", "z"])
    docs = documents.where("length(text) < 700 OR text IS NULL").limit(40).select("doc_id", "text", "lang").union(spark.createDataFrame([(5, "é" * 33, None)], "doc_id bigint, text string, lang string"))
    for r in g.predictions(docs, net).collect():
        text = (r.text or "").encode()
        p = scalar(net, text)
        if any(c.isalpha() for c in text.decode()):
            assert abs(max(p[:-1]) - r.score) < 1e-4 and r.lang_pred == net.languages[p.index(max(p[:-1]))]
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_held_out_is_a_fold_of_ids(spark, documents):
    found = documents.select("doc_id", g.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found) and len({r.h for r in found}) == 2


def test_sample_is_bounded_and_distinct(spark):
    docs = spark.range(3000).selectExpr("7 AS doc_id", "if(id % 2 = 0, 'same words', concat('words ', id)) AS text", "concat('l', id % 3) AS lang")
    found = g.sample_windows(docs, 100)
    assert len(found) == len({(x[0], x[1]) for x in found}) == 300
    again = g.sample_windows(docs.repartition(7), 100)
    assert found == again and len(g.sample_windows(docs, 100, 60)) == 60
    assert g.sample_windows(docs.withColumn("lang", F.lit(None).cast("string"))) == []


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "some words", "en", 3, 4, True, "x")], "doc_id bigint, text string, lang string, score int, lang_pred int, has_letter boolean, c0 string")
    net = g.ByteNetwork(["en"])
    out = g.predictions(docs, net)
    assert out.columns == ["doc_id", "text", "lang", "has_letter", "c0", "lang_pred", "score"] and out.first().lang_pred == "en"
    kept = g.keep_identified(docs)
    assert kept.columns == docs.columns and tuple(kept.first()) == tuple(docs.first())


def test_texts_of_no_learned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    import random

    rng = random.Random(1)
    noise = [(-1 - i, "".join(rng.choice("бвгджзиклмнопрст  ") for _ in range(600)), None) for i in range(40)] + [(-100, None, None), (-101, "12 !?", None)]
    more = spark.createDataFrame(noise, docs.schema)
    unlabelled = docs.withColumn("lang", F.when(F.col("doc_id") % 10 != 0, F.col("lang")))
    kept = {r.doc_id: r.lang for r in g.keep_identified(unlabelled.union(more)).collect()}
    truth = {r.doc_id: r.lang for r in docs.where("length(text) >= 40").collect()}
    assert sum(i in kept for i in truth) >= 0.985 * len(truth)
    assert sum(kept.get(i, lang) == lang for i, lang in truth.items()) >= 0.97 * len(truth) and None not in kept.values()
    assert not {-100, -101} & kept.keys()
    assert sum(-41 < i < 0 for i in kept) <= 2


def test_chunks_hold_every_window(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(g, "CHUNK_WINDOWS", 7)
    texts, langs = ["a" * 130, "", "é" * 32, None, "z" * 1000], ["x", "y", "y", "x", "x"]
    chunks = list(g._chunks(iter([pa.record_batch([pa.array(langs), pa.array(texts)], names=["lang", "text"]), pa.record_batch([pa.array(["y"]), pa.array(["b"])], names=["lang", "text"])]), ["x", "y"]))
    assert [len(x) for x, _ in chunks] == [7, 7, 7]
    x, y = (np.concatenate(z) for z in zip(*chunks))
    assert bytes(x[x != g.PAD].astype(np.uint8)) == "".join(t or "" for t in [*texts, "b"]).encode()
    assert y.tolist() == [0] * 3 + [1] + [0] * 16 + [1]


def test_learns_from_every_labelled_text(spark):
    # a text has one letter; those of the two sampled ones tell nothing of the other 18
    docs = spark.createDataFrame([(i, "abcdefghijklmnopqrst"[i % 20] * 6400, "xy"[i % 20 // 10]) for i in range(1000)], "doc_id bigint, text string, lang string")
    net = g.fit(docs, per_language=1)
    assert g.predictions(docs, net).where("lang = lang_pred").count() == 1000


def test_limit_is_that_of_all_held_out_texts(spark, documents):
    net = g.fit(documents, per_language=5)
    own = []
    for lang, text, o in g._labelled(documents).collect():
        if o % g.CHECKED == g.CHECKED - 1 and any(c.isalpha() for c in text):
            p = net.documents(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0, :-1]
            own += [p.max()] if net.languages[p.argmax()] == lang else []
    assert len(own) > 20 and abs(sorted(own)[int(g.LOST * len(own))] - g._CLOSE - net.least) < 1e-5


def test_smallest_is_exact(spark):
    rng = np.random.default_rng(4)
    for values in ([], [0.5], [0.25] * 9, [0.1, np.nextafter(0.1, 1)] * 30, [*rng.random(5000) ** 9, *[1e-9] * 70]):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        for share in (0.0, 0.002, 0.5, 0.99):
            assert g.smallest(df, share) == (sorted(values)[int(share * len(values))] if values else None)
