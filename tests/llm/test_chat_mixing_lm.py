"""Chat formatting and mixing against SQL, the language model against brute force, and the pipeline."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from narrascope.llm import chat_format, gru_lm, mixing

from llm_words import LOWER, spaced


def rows(df):
    return Counter(tuple(str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def sql(text, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df)
    return c.sql(text).df()


@given(st.lists(st.sampled_from(["[", "<", "\\", ">", "[INST] ", " </s>", "</s>", "a", " ", "<role:", "</role>", "<<SYS>>\n"]), max_size=9).map("".join))
def test_escape(text):
    e = chat_format.escape(text)
    assert chat_format.unescape(e) == text
    assert not any(m in e for m in ("[INST]", "[/INST]", "</s>", "<<SYS>>", "<</SYS>>", "<role:", "</role>"))


def test_chat_equals_sql(spark, folder):
    t = spark.read.parquet(f"{folder}/conversations.parquet").withColumn("valid", chat_format.F.lit(3))
    odd = spark.createDataFrame([(77, None, "user", None), (77, None, "user", None), (78, 2, "tool", "[INST] x </role> \\ <"), (78, 3, "assistant", ""), (79, 1, None, "text")], "conv_id bigint, turn bigint, role string, text string")
    both = t.drop("valid").unionByName(odd)
    assert rows(chat_format.op2_chat(both).toPandas()) == rows(sql(chat_format.ORACLE, conversations=both.toPandas().astype({"turn": "Int64"})))
    assert chat_format.op2_chat(t.limit(0)).count() == 1


def test_loss_is_the_assistants_text(spark):
    t = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "[a]"), (1, 2, "user", "q2"), (1, 3, "assistant", "b")], "conv_id bigint, turn bigint, role string, text string")
    pieces = [(p, w) for r in chat_format.format_chats(t).collect() for p, w in zip(r.pieces, r.loss)]
    assert "".join(p for p, _ in pieces) == "[INST] q [/INST] [\\a] </s>[INST] q2 [/INST] b </s>"
    assert [chat_format.unescape(p) for p, w in pieces if w] == ["[a]", "b"]


def test_turns_are_read_across_rows(spark):
    """The reader takes the conversation as one text: a turn cut over two rows is still one turn."""
    import hashlib

    rows_ = [(1, True, True, ["[INST] ", "one"], [False, False]), (1, True, False, [" two", " [/INST]", " "], [False, False, False]), (1, True, False, ["yes", " </s>"], [True, False])]
    df = spark.createDataFrame(rows_, "conv_id bigint, valid boolean, first boolean, pieces array<string>, loss array<boolean>").coalesce(1)
    r = df.mapInArrow(chat_format._digest(chat_format.TEMPLATE), "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean").first()
    assert (r.n_turns, r.loss_chars) == (2, 3) and r.turns_sha256 == hashlib.sha256(b"user\none two\nassistant\nyes\n").hexdigest()


def test_very_long_turn(spark):
    t = spark.createDataFrame([(1, 0, "user", "[x]" * 300_000), (1, 1, "assistant", "<y>" * 300_000)], "conv_id bigint, turn bigint, role string, text string")
    r = chat_format.op2_chat(t).where("conv_id = 1").first()
    assert (r.n_turns, r.loss_chars, r.valid) == (2, 900_000, True)


def test_mixing_equals_sql(spark, documents):
    d = documents.select("doc_id", "text", "lang", "source", "n_chars").where("n_chars IS NOT NULL").withColumn("doc_id", mixing.F.expr("if(doc_id % 50 = 3, NULL, doc_id)"))
    more = mixing.F.lit(0).alias("mix_copy"), mixing.F.lit("x").alias("_mix_source"), mixing.F.lit("y").alias("mix_source"), mixing.F.lit("z").alias("MIX_n")
    a, b = mixing.op7_mixing(d.select("*", *more)).toPandas().astype({"doc_id": "Int64"}), sql(mixing.ORACLE, documents=d.toPandas().astype({"doc_id": "Int64"}))
    assert len(a) and rows(a) == rows(b)
    ordered = [tuple(r) for r in mixing.replicated(d).select("mix_key", "text").collect()]
    assert ordered == sorted(ordered, key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode()))


def test_mixing_keeps_other_columns(spark):
    docs = spark.createDataFrame([(i, "t", "s", i, -i) for i in range(50)], "doc_id bigint, text string, source string, mix_source bigint, mix_n bigint")
    out = mixing.replicated(docs)
    assert out.columns == [*docs.columns, "mix_copy", "mix_key"]
    assert all(r.mix_source == r.doc_id == -r.mix_n for r in out.collect())
    one_id = docs.withColumn("doc_id", mixing.F.lit(7)).withColumn("text", mixing.F.col("mix_source").cast("string"))
    texts = [(r.mix_key, r.text) for r in mixing.replicated(one_id).collect()]
    assert texts == sorted(texts)
    many = mixing.BROADCAST_SOURCES
    try:
        mixing.BROADCAST_SOURCES = 0
        assert rows(mixing.replicated(docs).toPandas()) == rows(out.toPandas())
    finally:
        mixing.BROADCAST_SOURCES = many


def test_mixing_rates(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id % 100 = 0 THEN 'rare' ELSE 'hot' END AS source")
    n = {r.source: r["count"] for r in mixing.replicated(docs, weights={"rare": 0.5, "hot": 0.5}).groupBy("source").count().collect()}
    assert abs(n["rare"] - 10_000) < 400 and abs(n["hot"] - 10_000) < 400  # a rate of 50 is cut into pieces
    assert mixing.replicated(docs, weights={}).count() == 0 and mixing.replicated(docs.limit(0)).count() == 0
    same = docs.withColumn("text", mixing.F.lit(None).cast("string")).withColumn("source", mixing.F.lit(None).cast("string"))
    assert abs(mixing.replicated(same).count() - 20_000) < 700


def test_lm_counts_equal_brute_force(spark, documents, texts):
    found = gru_lm.op4_lm_scores(documents, sample=100, steps=60)
    words = lambda t: spaced((t or "").translate(LOWER)) + ["\n"]  # noqa: E731  the end
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in texts if not out(i) for w in words(t))
    total, bottom = sum(c.values()), math.log10(sum(c.values()) + 0.5 * (len(c) + 1))
    expected = Counter((i, out(i), len(words(t)), sum(w in c for w in words(t)), total, round(sum(math.log10(c[w] + 0.5) - bottom for w in words(t)), 3)) for i, t in texts)
    r = found.collect()
    assert Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 3)) for x in r) == expected
    held = [x for x in r if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)


def test_lm_learns_from_every_training_text(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "SHARD_WORDS", 5000)
    monkeypatch.setattr(gru_lm, "CHUNK_WORDS", 700)
    v = gru_lm.Vocabulary([(b"w%d" % i, 500 - i) for i in range(50)] + [(b"", 30)], 20_000, 60)
    texts = [b" ".join(b"w%d" % (k % 50) for k in range(n)) for n in (3, 0, 1999, 40)]
    chunks = list(gru_lm._chunks(iter([pa.record_batch([pa.array([t.decode() for t in texts])], names=["text"])]), v))
    assert [len(c) for c, _ in chunks] == [700, 700, 646]
    assert (np.concatenate([c for c, _ in chunks]) == v.encode(texts)[0]).all()
    assert np.flatnonzero(np.concatenate([b for _, b in chunks])).tolist() == [0, 4, 5, 2005]
    # `sample` texts teach nothing of the pattern that all others have
    docs = spark.createDataFrame([(i, " ".join("abcdefgh" * 30)) for i in range(300)], "doc_id bigint, text string")
    gain = sum(r.score - r.base_score for r in gru_lm.op4_lm_scores(docs, sample=1, steps=1).where("held_out").collect())
    r = gru_lm.op4_lm_scores(docs, sample=1, steps=1).agg({"n_tokens": "sum", "score": "sum", "base_score": "sum"}).first()
    assert gain > 0 and (r["sum(score)"] - r["sum(base_score)"]) / r["sum(n_tokens)"] > 0.01


def test_lm_errors_of_every_word_go_back():
    v = gru_lm.Vocabulary([(b"w%d" % i, 500 - i) for i in range(50)] + [(b"", 30)], 20_000, 60)
    net, rng, seen = gru_lm.Network(v), np.random.default_rng(2), Counter()
    chunks = [(rng.integers(-1, 51, n), rng.random(n) < 0.01) for n in (5000, 1, 1999)]

    def gradients(x, cls, inner, h, reset):
        seen.update(zip(cls.ravel().tolist(), inner.ravel().tolist()))
        return gru_lm.Network.gradients(net, x, cls, inner, h, reset)

    net.gradients = gradients
    assert net.read(iter(chunks), 7000) >= 7000
    _, cls, inner = net.rows(np.concatenate([ranks for ranks, _ in chunks]))
    assert not Counter(zip(cls.tolist(), inner.tolist())) - seen


def test_lm_shares_of_far_logits():
    """Logits that float32 can't raise e to, against double precision."""
    rng = np.random.default_rng(3)
    h, target = rng.normal(0, 1, (40, 4)).astype(np.float32), rng.integers(0, 6, 40)
    for size, shift in ((1, 0), (90, 0), (1, -150), (1, 150)):
        w, b = (size * rng.normal(0, 1, (4, 6))).astype(np.float32), np.full(6, shift, np.float32)
        logits = h.astype(float) @ w + b
        share = np.exp(logits - logits.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        log = (logits - logits.max(axis=1, keepdims=True) - np.log(np.exp(logits - logits.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)))[np.arange(40), target]
        found, errors = gru_lm._softmax(h, w, b, target, 0.5, True)
        assert np.allclose(found, log, rtol=1e-4, atol=2e-4) and np.allclose(errors, 0.5 * (share - np.eye(6)[target]), atol=1e-4)


def test_lm_shares_sum_to_one():
    ranked = [(b"w%d" % i, 900 - i) for i in range(800)] + [(b"", 40)]
    old = gru_lm.HEAD
    try:
        gru_lm.HEAD = 64
        v = gru_lm.Vocabulary(ranked, sum(n for _, n in ranked) + 5000, 1200)
    finally:
        gru_lm.HEAD = old
    net = gru_lm.Network(v)
    known = np.arange(801)
    share = np.array([net.log_likelihoods(np.array([k]), np.array([1]))[0] for k in [*known, -1]])
    _, cls, inner = net.rows(np.array([*known, -1]))
    assert (inner[:-1] >= 0).all() and inner[-1] < 0 and len({(c, i) for c, i in zip(cls[:64].tolist(), inner[:64].tolist())}) == 64
    share += [*v.share, np.log10(0.5) - v.log_beyond]
    missing = 5000 + 0.5 * (1200 - 801)  # mass of the words without a rank, in the same bin as the unseen one
    total = (10.0 ** share[:-1]).sum() + 10.0 ** share[-1] / 0.5 * (missing + 0.5)
    assert abs(total - 1) < 1e-4


def test_lm_gradients_and_carried_state():
    v = gru_lm.Vocabulary([(b"w%d" % i, 500 - i) for i in range(50)] + [(b"", 30)], 20_000, 60)
    net = gru_lm.Network(v)
    rng = np.random.default_rng(0)
    ranks, sizes = rng.integers(-1, 51, 700), np.array([500, 3, 150, 47])
    whole = net.log_likelihoods(ranks, sizes)
    parts = [net.log_likelihoods(x, np.array([len(x)]))[0] for x in np.split(ranks, np.cumsum(sizes)[:-1])]
    assert np.allclose(whole, parts, rtol=1e-4)
    net.p = {k: w.astype(np.float64) for k, w in net.p.items()}
    net.p["embed"] += rng.normal(0, 0.5, net.p["embed"].shape)
    x, c, i = net.rows(rng.integers(-1, 51, (5, 3)))
    reset = rng.random((5, 3)) < 0.2
    _, grads = net.gradients(x, c, i, np.zeros((3, gru_lm.UNITS)), reset)
    for k, g in grads.items():
        at, e = np.unravel_index(np.abs(g).argmax(), g.shape), 1e-3
        old, losses = net.p[k][at], []
        for step in (e, -e):
            net.p[k][at] = old + step
            losses.append(net.gradients(x, c, i, np.zeros((3, gru_lm.UNITS)), reset)[0])
        net.p[k][at] = old
        assert abs((losses[0] - losses[1]) / (2 * e) - g[at]) < 1e-3


def test_lm_scores_equal_a_scalar_network(spark):
    """The whole query's score against the network word by word in plain floats."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 37}" for k in range(20))) for i in range(60)] + [(100, "never seen words"), (101, None)], "doc_id bigint, text string")
    kept, old = [], gru_lm.Network.log_likelihoods
    head, every = gru_lm.HEAD, gru_lm.read_corpus

    def remember(network, *rest):
        every(network, *rest)
        kept.append(network)

    try:
        gru_lm.HEAD, gru_lm.read_corpus = 16, remember
        found = {r.doc_id: r.score for r in gru_lm.op4_lm_scores(docs, sample=20, steps=30).collect()}
    finally:
        gru_lm.HEAD, gru_lm.read_corpus = head, every
    net = kept[0]
    v, p, u = net.v, {k: w.astype(float) for k, w in net.p.items()}, gru_lm.UNITS
    assert old is gru_lm.Network.log_likelihoods and v.head == 16 and v.classes > 1
    for doc, text in docs.collect():
        h, row, total = np.zeros(u), v.start_row, 0.0
        for w in [*spaced(text), ""]:
            pre = p["embed"][row] + p["gate"] + h @ p["recur"]
            z = 1 / (1 + np.exp(-pre[:u]))
            h = h + z * (np.tanh(pre[u:]) - h)
            rank = v.words.get(w.encode(), -1)
            (r,), (c,), (i,) = net.rows(np.array([rank]))
            top = np.exp(h @ p["top"] + p["top_bias"])
            total += np.log10(top[c] / top.sum())
            if rank < 0:
                total += np.log10(0.5) - v.log_beyond
            else:
                inside = np.exp(h @ p["word"][c] + p["word_bias"][c])
                total += np.log10(inside[i] / inside.sum()) + v.share[rank]
            row = r
        assert abs(found[doc] - total) < 1e-3 * abs(total)


def test_lm_sample_and_ranks_are_bounded(spark):
    v = spark.sparkContext.broadcast(gru_lm.Vocabulary([(b"a", 5), (b"", 3)], 8, 2))
    one = spark.range(300).selectExpr("7 AS doc_id", "if(id % 3 = 0, concat('a a ', id), 'a a a') AS text")
    assert len(gru_lm.sample_texts(one, v, 10)) == 10 and len(gru_lm.sample_texts(one, v, 1000)) == 101
    counts = spark.range(5000).selectExpr("CAST(CAST(id AS string) AS binary) AS word", "if(id < 10, 50 + id, 1) AS n")
    ranked = gru_lm.most_frequent(counts, 500)
    assert [n for _, n in ranked[:10]] == list(range(59, 49, -1)) and 400 < len(ranked) <= 500
    assert gru_lm.most_frequent(counts, 5) and len(gru_lm.most_frequent(counts, 9000)) == 5000


def test_lm_empty(spark, documents):
    assert gru_lm.op4_lm_scores(documents.limit(0)).count() == 0


def brute_pipeline(spark, documents, folder):
    """What run() gives, stage by stage in plain Python; only the language network's own probabilities are taken from it."""
    import hashlib

    import test_decontaminate
    import test_near_dedup
    from narrascope.llm import langid
    from tokenizers import Tokenizer

    rows_ = [tuple(r) for r in documents.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    network = langid.fit(documents)
    kept = []
    for i, text, lang, source, n in rows_:
        if text and any(c.isalpha() for c in text):
            p = network.documents(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0, :-1]
            if p.max() >= network.least:
                kept.append((i, text, lang if lang is not None else network.languages[p.argmax()], source, n))
    # one row of each group of near copies
    named = [r for r in kept if r[0] is not None and spaced(r[1])]
    groups = {}
    sets = [test_near_dedup.shingles(r[1], 5) for r in named]
    parent = list(range(len(named)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for a, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(a)
    shared = Counter((a, b) for owners in where.values() for x, a in enumerate(owners) for b in owners[x + 1 :])
    for (a, b), c in shared.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            parent[find(a)] = find(b)
    for a, r in enumerate(named):
        groups.setdefault(find(a), []).append(r)
    null_first = lambda r: tuple((v is not None, v) for v in r)
    kept = [min(g, key=lambda r: (r[0], hashlib.md5(r[1].encode()).digest(), null_first(r[2:]))) for g in groups.values()] + [r for r in kept if r not in named]
    # benchmark passages
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    windows = {}
    for i, text in items:
        words = test_decontaminate.alphanumeric(text)
        k = min(10, len(words))
        for j in range(len(words) - k + 1 if k else 0):
            windows.setdefault(k, set()).add(tuple(words[j : j + k]))
    assert set(windows) == {10}
    import re

    cleaned = []
    for i, text, lang, source, n in kept:
        found = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)]
        words = test_decontaminate.alphanumeric(text)
        hit = {j + k for j in range(len(words) - 9) if tuple(words[j : j + 10]) in windows[10] for k in range(10)}
        if len(hit) > 0.5 * len(words):
            continue
        if hit:
            cut = sorted(hit, reverse=True)
            for j in cut:
                stop = found[j][1] if j + 1 not in hit else found[j + 1][0]
                text = text[: found[j][0]] + text[stop:]
            n = len(text)
        cleaned.append((i, text, lang, source, n))
    # copies
    counts = Counter(r[3] for r in cleaned)
    weights = {s: n**0.5 for s, n in counts.items()}
    copies = []
    for r in cleaned:
        rate = len(cleaned) * weights[r[3]] / sum(weights.values()) / counts[r[3]]
        assert rate < 32
        name = str(r[0]) if r[0] is not None else "text:" + hashlib.md5(r[1].encode()).hexdigest()
        u, p, k = int(hashlib.md5(f"{mixing.SEED}:{name}:1".encode()).hexdigest()[:13], 16) / 2**52, math.exp(-rate), 0
        cdf = p
        while cdf <= u:
            k += 1
            p *= rate / k
            cdf += p
        copies += [(hashlib.md5(f"{mixing.SEED}:order:{name}:{c}".encode()).hexdigest(), r[1], r[0]) for c in range(k)]
    tokenizer = Tokenizer.from_file(__import__("public_tokenizers").path("word_bpe_49k.json"))
    out, start = [], 0
    for _, text, i in sorted(copies, key=lambda c: (c[0], c[1].encode())):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_run_equals_a_brute_force_version(spark, folder, documents, tmp_path):
    import corpus_pipeline as p

    documents.withColumn("mix_key", mixing.F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (s for _, s in p.STAGES):
        assert stage.__doc__
    found = [tuple(r) for r in p.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    assert found == brute_pipeline(spark, documents, folder)


def test_run_on_an_empty_table(spark, folder, documents, tmp_path):
    import corpus_pipeline as p

    documents.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
