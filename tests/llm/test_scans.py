"""License scans, personal data and quality rules against brute force."""

import hashlib
import random
import re
from collections import Counter

from narrascope.llm import license_scan, pii, quality

from llm_words import alphanumeric, spaced


def test_license_base_equals_brute_force(spark, documents, texts):
    odd = [(7, "gnu GENERAL public, license; cc by cc by-nc mit  license apache license")] * 2
    more = spark.createDataFrame(odd, "doc_id bigint, text string")
    expected, found = Counter(), Counter()
    for i, text in [*texts, *odd]:
        words, places = alphanumeric(text), []
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            places += [(j, label) for j in range(len(words) - len(p) + 1) if words[j : j + len(p)] == p]
        expected[(i, len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places})))] += 1
    for r in license_scan.op9_license_scan(documents.select("doc_id", "text").union(more)).collect():
        found[(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)] += 1
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert found == expected


def test_license_notices(spark):
    mit = license_scan.NOTICES["mit"].split()
    texts = [(1, " ".join(mit)), (2, "some words before " + " ".join(mit[:12] + ["inserted"] + mit[12:])), (3, " ".join(mit[:6])), (4, "Licensed under CC BY-NC 4.0.")]
    labels = {r.doc_id: r.labels for r in license_scan.op9_license_scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert labels == {1: "mit", 2: "mit", 3: "", 4: "cc-by,cc-by-nc-4.0"}


def test_license_spans_count_a_template_place_once(spark):
    mit = license_scan.NOTICES["mit"]
    texts = [(1, "licensed under cc licensed under cc licensed under cc"), (2, "licensed under cc licensed under CC-BY 4.0"), (3, f"{mit} and again {mit}"), (4, "mit " * 3000 + "license"), (None, None), (None, None), (5, "word " * 300_000 + mit)]
    found = license_scan.op9_license_scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.labels, r.n_base) for r in found) == Counter({(1, "", 0): 1, (2, "cc-by,cc-by-4.0", 1): 1, (3, "mit", 0): 1, (4, "mit", 1): 1, (None, "", 0): 2, (5, "mit", 0): 1})
    spans = license_scan.license_spans(spark.createDataFrame(texts[2:3], "doc_id bigint, text string")).where("template > 0").orderBy("first_word").collect()
    size = len(mit.split())
    assert [(r.first_word, r.last_word, r.coverage) for r in spans] == [(0, size - 1, 1.0), (size + 2, 2 * size + 1, 1.0)]


def test_license_words_are_compared(spark, monkeypatch):
    rows, exact = license_scan.gram_rows()
    import pyarrow as pa

    monkeypatch.setattr(license_scan, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    monkeypatch.setattr(license_scan, "grams", lambda h, k: license_scan.np.full(max(0, len(h) - k + 1), rows[1][4], "i8").view("u8") - license_scan.U(k))
    batch = pa.record_batch([pa.array([1]), pa.array(["no license words here but apache license"])], names=["doc_id", "text"])
    (out,) = license_scan._rolling([rows[1][4]], exact)(iter([batch]))
    assert out.column(2).to_pylist() == [[7, 5]]


def test_license_fuzz_equals_brute_force(spark):
    """Labels and scores of notices against a scalar version: word cover by diagonals, merged when close."""
    rng = random.Random(6)
    words = sorted({w for *_, ws in license_scan.templates() for w in ws})
    texts = []
    for i in range(150):
        *_, notice = rng.choice(license_scan.templates())
        text = [w.decode() for w in notice]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = [rng.choice(words).decode()] if rng.random() < 0.5 else []
            del text[at : at + rng.randrange(2)]
        texts.append((i, " ".join(["x"] * rng.randrange(3) + text + text[: rng.randrange(9)])))
    found = {r.doc_id: (r.labels, round(r.score, 6)) for r in license_scan.op9_license_scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    for i, text in texts:
        doc, labels, score = text.encode().split(), set(), 0.0
        for _, label, phrase, template in license_scan.templates():
            k = 2 if phrase else 3
            lines = {}
            for p in range(len(doc) - k + 1):
                for a in range(len(template) - k + 1):
                    if doc[p : p + k] == template[a : a + k]:
                        lines.setdefault(p - a, []).append((p, a))
            parts = []
            for d in sorted(lines):
                if phrase or not parts or d - parts[-1][-1] > license_scan.SHIFT:
                    parts.append([])
                parts[-1].append(d)
            for part in parts:
                cover = lambda ds: len({a + j for d in ds for _, a in lines[d] for j in range(k)}) / len(template)  # noqa: E731, B023
                places = [p for d in part for p, _ in lines[d]]
                close = max(places) + k - 1 - min(places) < license_scan.STRETCH * len(template)
                c = cover(part) if close else max(cover([d]) for d in part)
                if c >= (1 if phrase else license_scan.LEAST_COVERAGE):
                    labels.add(label)
                    score = max(score, c)
        assert found[i] == (",".join(sorted(labels)), round(score, 6)), text


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def test_pii_base_equals_brute_force(spark, documents, texts):
    rng = random.Random(3)
    parts = ["a.b@c.d", "_x@d.e", "@", "1.2.3.4", ".5", "256.1.1.1", "0000255.1.2.3", "4808200777490071", "4808 2007-7749 0071", " ", "+1 (517) 555-5141", "+", "-", "é🙂", "12", "9", "\n", "(", ")", ".", "x", "+49 30 1234567", "a@b"]
    fuzz = [(10_000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(300)] + [(20_000, "+1 23456789 " * 700)]
    rows = documents.select("doc_id", "text").union(spark.createDataFrame(fuzz, "doc_id bigint, text string"))
    expected, found = Counter(), Counter()
    for i, text in [*texts, *fuzz]:
        spans = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in PATTERNS.items()}
        listed = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in spans[k])
        expected[(i, *(len(spans[k]) for k in PATTERNS), hashlib.sha256(listed.encode()).hexdigest())] += 1
    for r in pii.op3_pii(rows).collect():
        found[(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)] += 1
        assert r.n_email + r.n_ip + r.n_card + r.n_phone <= len(r.spans.split(","))
    assert found == expected


def test_cards_of_single_digits(spark):
    rows = [(1, "x " + " ".join("4111111111111111") + " y"), (2, "-".join("4111111111111111")), (3, " ".join("4111111111111112"))]
    found = {r.doc_id: (r.n_card, r.spans) for r in pii.op3_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {1: (1, "card:2:33"), 2: (1, "card:0:31"), 3: (0, "")}


def test_long_runs_are_linear(spark):
    rows = [(1, "1" * 60_000), (2, "a" * 60_000), (3, "1 " * 30_000), (4, "a." * 30_000 + "@"), (5, "+1" + "(" * 60_000)]
    assert sum(r.n_card + r.n_email + r.n_phone for r in pii.op3_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == 0


def test_trees_and_redaction(spark):
    card = lambda *f: (2, *f, 0, 0, 0, 0)
    vectors = [(card(5, 1, 0, 0, 1), 200, 199), (card(5, 0, 0, 0, 0), 300, 30), (card(4, 0, 0, 0, 1), 100, 12)]
    trees = pii.fit_trees(vectors)
    score = {f: pii.tree_score(trees, f) for f, _, _ in vectors}
    assert score[vectors[0][0]] > 1 > -1 > score[vectors[1][0]] and -1 > score[vectors[2][0]]
    least = pii.thresholds(trees, vectors)
    assert score[vectors[1][0]] < score[vectors[2][0]] < least[2] <= score[vectors[0][0]] and least[0] == least[3] == float("inf")
    assert pii.thresholds(trees, [(vectors[0][0], 2, 2)])[2] == float("inf")  # two of two say little
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(list(vectors[0][0]), "mail a@b.c now")], "f array<int>, text string")
    r = df.select(pii.tree_column(trees, F.col("f")), pii.redacted(F.col("text"), F.expr("array(named_struct('kind', 0, 'start', 5, 'stop', 10))"))).first()
    assert abs(r[0] - score[vectors[0][0]]) < 1e-9 and r[1] == "mail [EMAIL] now"


def planted(rng, count):
    """(id, text, spans that are personal data but of no base pattern) with decoys that look alike."""
    digits = lambda n, first="": first + "".join(rng.choice("0123456789") for _ in range(n - len(first)))
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))

    def card(n):
        head = digits(n - 1, rng.choice("3456"))
        return next(head + c for c in "0123456789" if luhn(head + c))

    makers = {
        "email": [lambda: f"{word()}.{word()}(at){word()}.de", lambda: f"{word()} [at] {word()} [dot] org"],
        "phone": [lambda: f"({rng.choice('23456789')}{digits(2)}) {rng.choice('23456789')}{digits(2)}-{digits(4)}", lambda: f"call me: {rng.choice('23456789')}{digits(2)}-{rng.choice('23456789')}{digits(2)}-{digits(4)}"],
        "card": [lambda: (lambda c: f"card {c[:4]} {c[4:10]} {c[10:]}")(card(15)), lambda: (lambda c: f"visa {c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}")(card(16))],
        "ip": [lambda: f"2001:db8:{digits(3)}::{digits(2)}a{digits(1)}", lambda: ":".join(digits(3, "f") for _ in range(8))],
        "base": [lambda: f"{word()}@{word()}.com", lambda: "+1 (517) 555-" + digits(4), lambda: card(16)],
        "decoy": [lambda: f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", lambda: "id " + digits(15, rng.choice("3456")), lambda: f"{digits(3)} {digits(3)} {digits(4)}", lambda: f"order {digits(4)}.{digits(4)}.{digits(4)}.{digits(4)}", lambda: f"{word()} @ {word()} . {word()}"],
    }
    rows = []
    for i in range(count):
        text, spans = "", []
        for _ in range(rng.randint(2, 9)):
            kind = rng.choice([*makers, "decoy", "decoy", "base"])
            made = rng.choice(makers[kind])()
            text += " ".join(word() for _ in range(5)) + " "
            skip = re.match(r"call me: |card |visa ", made)
            if kind in pii.KINDS:
                spans.append((kind, len(text) + (skip.end() if skip else 0), len(text) + len(made)))
            text += made + " "
        rows.append((i, text, spans))
    return rows


def test_added_spans_on_planted_data(spark):
    rows = planted(random.Random(12), 1500)
    found = pii.pii_spans(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")).collect()
    added = {(r.doc_id, pii.KINDS[a.kind], a.start, a.stop) for r in found for a in r.added}
    truth = {(i, *s) for i, _, spans in rows for s in spans}
    hits = {k: (len({t for t in truth & added if t[1] == k}), len({t for t in truth if t[1] == k}), len({t for t in added if t[1] == k})) for k in pii.KINDS}
    print("hits, planted, added:", hits)
    for kind, (hit, wanted, made) in hits.items():
        assert hit >= 0.8 * wanted and hit >= 0.9 * made, hits


def test_quality_equals_brute_force(spark, documents, texts):
    odd = [(8, "a b c a b c a b c\n \na b c\nq\na b c\n\x0b"), (9, " ".join(str(i % 30_000) for i in range(70_000)))]
    rows = documents.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id bigint, text string"))
    expected, found = Counter(), Counter()
    for i, text in [*texts, *odd]:
        text = text or ""
        w = spaced(text)
        c = Counter(zip(w, w[1:], w[2:]))
        covered = {j + k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(3)}
        seen, copies = set(), 0
        for line in text.split("\n"):
            if spaced(line):
                copies += line in seen
                seen.add(line)
        expected[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))] += 1
    for r in quality.op8_quality(rows).collect():
        found[(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)] += 1
        assert not (r.base_failed and r.kept) and 0 <= r.posterior <= 1
    assert found == expected


def test_windows_that_share_a_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(quality.F, "xxhash64", lambda *words: quality.F.length(words[0]).cast("bigint"))
    rows = [(1, " ".join(f"w{i}" for i in range(60))), (2, "a b c d a b c e f g"), (3, "a b a c a b a c")]
    assert {r.doc_id: r.n_repeat_words for r in quality.op8_quality(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {1: 0, 2: 6, 3: 8}


def reference_em(patterns, rounds):
    """The same model document by document, in numpy."""
    import numpy as np

    v = np.array([p for p, n in patterns for _ in range(n)])
    k = v.shape[1] + 1
    blamed = v < 0
    w = np.where(blamed.any(axis=1)[:, None], np.hstack([np.full((len(v), 1), 0.1), 0.9 * blamed / np.maximum(blamed.sum(axis=1), 1)[:, None]]), np.hstack([np.ones((len(v), 1)), np.zeros(v.shape)]))
    for _ in range(rounds):
        share = (w.sum(axis=0) + 1) / (len(v) + k)
        mean, worth = np.full((k, k - 1), 0.5), np.full((k, k - 1), 2.0)
        mean[0], worth[0] = quality.FALSE_ALARMS[0], quality.FALSE_ALARMS[1] * len(v)
        for j in range(k - 1):
            mean[j + 1, j], worth[j + 1, j] = quality.OWN_MODE[0], quality.OWN_MODE[1] * len(v)
        bad = (w.T @ (v < 0) + mean * worth) / (w.T @ (v != 0) + worth)
        logs = np.log(share) + (v < 0) @ np.log(bad).T + (v > 0) @ np.log(1 - bad).T
        w = np.exp(logs - logs.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
    return dict(zip(map(tuple, v.tolist()), w[:, 0].tolist()))


def test_votes_equal_a_document_by_document_fit():
    rng = random.Random(4)
    draw = lambda bad: tuple(rng.choices((-1, 0, 1), (bad, 0.1, 0.9 - bad))[0] for _ in range(3))
    patterns = sorted(Counter([draw(0.03) for _ in range(900)] + [draw(0.7) for _ in range(100)]).items())
    fit = quality.fit_votes(patterns, 40, settled=0)
    for v, p in reference_em(patterns, 40).items():
        assert abs(quality.class_posteriors(v, fit)[0] - p) < 1e-9
    assert all(good > 0.9 and 0.3 < bad < 1 for good, bad in quality.accuracies(fit))
    assert quality.fit_votes([]) == ([0.125] * 8, [[0.5] * 7] * 8)


def test_a_rule_that_others_contradict_loses_its_say():
    """Votes of a rule that blames a tenth of all documents at random, whatever the others say, move the posterior less than those of rules that agree."""
    rng = random.Random(2)
    votes = Counter()
    for _ in range(4000):
        bad = rng.random() < 0.2
        votes[tuple((-1 if rng.random() < (0.9 if bad else 0.01) else 1) for _ in range(3)) + ((-1 if rng.random() < 0.1 else 1),)] += 1
    fit = quality.fit_votes(sorted(votes.items()))
    good = lambda v: quality.class_posteriors(v, fit)[0]
    assert good((-1, -1, 1, 1)) < 0.05 and good((1, 1, 1, 1)) > 0.9
    assert quality.accuracies(fit)[0][1] > 0.6 > quality.accuracies(fit)[3][1]


def test_verdicts_come_from_the_posterior(spark, documents):
    found = quality.op8_quality(documents)
    assert found.where("kept <> (NOT base_failed AND posterior >= 0.5)").count() == 0


def test_quality_follows_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = quality.op8_quality(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    assert sum(x.kept for x in r if x.quality == 1) >= 0.98 * sum(x.quality == 1 for x in r)
    assert sum(not x.kept for x in r if x.quality == 0) >= 0.95 * sum(x.quality == 0 for x in r)


def test_empty(spark, documents):
    none = documents.limit(0)
    assert license_scan.op9_license_scan(none).count() == pii.op3_pii(none).count() == quality.op8_quality(none).count() == 0
