import random
from collections import Counter

import numpy as np

from narrascope.llm import near_dedup as n

from llm_words import LOWER, spaced


def shingles(text, k):
    w = spaced((text or "").translate(LOWER))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(texts, k=3, num=85, den=100):
    sets = [(i, shingles(t, k)) for i, t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for a, (i, s) in enumerate(sets):
        if i is not None and s:
            for g in s:
                where.setdefault(g, []).append(a)
    shared = Counter()
    for owners in where.values():
        shared.update((a, b) for x, a in enumerate(owners) for b in owners[x + 1 :])
    for (a, b), c in shared.items():
        if den * c >= num * (len(sets[a][1]) + len(sets[b][1]) - c):
            parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return Counter((i, len(s), None if i is None else least[find(a)], i is None or i == least[find(a)]) for a, (i, s) in enumerate(sets))


def result(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_equals_brute_force(documents, texts):
    assert result(n.near_duplicates(documents)) == brute(texts)


def test_chains_and_blocks(spark):
    """A group of near copies drifting apart, cut into blocks of seven rows: chains must hold across blocks."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(120):
        texts.append((i, " ".join(words)))
        words[rng.randrange(60)] = f"v{i}"
        if i % 3 == 0:
            texts.append((1000 + i, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    for num in (85, 80):
        assert result(n.near_duplicates(df, num=num, block=7)) == brute(texts, num=num)


def test_sketch_bound_keeps_similar_sets():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (300, 400)).astype(np.uint64)
    other = base.copy()
    other[:, :33] = rng.integers(0, 2**63, (300, 33)).astype(np.uint64)  # similarity 0.847
    bounds = np.arange(301) * 400
    sketch = [n.odd_sketches(n.samples(x.ravel(), bounds, np.arange(300))) for x in (base, other)]
    differ = np.bitwise_count(sketch[0] ^ sketch[1]).sum(axis=1)
    assert differ.max() <= n.most_different_bits(0.85)
    assert abs(differ.mean() - 128 * (1 - (1 - 2 / 256) ** (2 * 120 * 0.153))) < 3


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (10, 11), (11, 10), (7, 7)], "a bigint, b bigint")
    assert dict(map(tuple, n.components(edges).collect())) == {3: 3, 4: 3, 5: 3, 9: 3, 10: 10, 11: 10}


def test_empty(spark, documents):
    assert n.near_duplicates(documents.limit(0)).count() == 0


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    """With a low bound nearly all keys are hot, and results stay."""
    from narrascope.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 2)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    texts = [(i, "the same text in many rows") for i in range(30)]
    for i in range(40):
        words[rng.randrange(40)] = f"v{i}"
        texts.append((100 + i, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert result(n.near_duplicates(df, block=7)) == brute(texts)


def test_one_of_each_group_stays(spark):
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3
    rows = [
        (4, long, "en", "s1"),
        (2, long.upper(), "en", "s2"),  # an equal set
        (2, long + "new words at the end", "en", "s0"),  # another text under the same id
        (2, long + "new words at the end", "de", "s0"),  # and once more
        (7, "nothing of the kind is in here at all", None, "s3"),
        (7, "a wholly different text under an id of two", "fr", "s3"),
        (None, long, "en", "s4"),
        (8, None, "en", "s5"),
        (8, " \n", "en", "s5"),
        (8, "", "en", "s5"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `key` string, `component_id` string")
    kept = Counter(map(tuple, n.without_copies(df).collect()))
    import hashlib

    twin = min((x for x in rows[1:4]), key=lambda r: (hashlib.md5(r[1].encode()).digest(), r[2], r[3]))
    assert kept == Counter([twin, *rows[4:]])
    assert n.without_copies(df.limit(0)).count() == 0 and n.without_copies(df).columns == df.columns
