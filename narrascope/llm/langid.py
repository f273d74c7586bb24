"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows of `WINDOW` bytes, forwards and backwards, and
gives every position a probability for each language; a document's probabilities are the means
over all its positions. Each direction is a recurrent layer with an update gate,
`h' = h + z * (n - h)`. Training is backpropagation through time in numpy with Adam. The driver
starts the weights on windows of a bounded, hash-ordered sample, and `op6_language` leaves it at
that; for `keep_identified`, tasks then read every byte of all labelled documents once, in hash-ordered shards of about `SHARD_BYTES` bytes, so the steps grow
with the corpus, and the shards' weights are averaged by their windows. A window weighs the more
the fewer bytes its language has in all, and beside them every step repeats some windows of the
sample, so a shard without a rare language doesn't unlearn it. Prediction reads every byte of
every text.

One more class, `other`, is trained on made-up windows: letters drawn evenly from the Latin
alphabet, or from a stretch of code points whose bytes the labelled documents hardly have. It
stands for languages that were not learned; a text is told apart if one of the learned ones beats
it, by a limit from a fifth of all labelled documents, which are not learned from.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope.llm.gru_lm import _added
from narrascope.llm.shared import fold, saved, small_batches
from narrascope.llm.textkernel import slices, text_bytes, trimmed

WINDOW, UNITS, PAD = 64, 8, 256
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS, WINDOWS_PER_TEXT = 400, 8_000, 6
STEPS, BATCH, RATE = 400, 192, 0.01
SHARD_BYTES, CHUNK_WINDOWS, WIDE_BATCH, REPEATED, SHARD_RATE = 32 << 20, 1 << 16, 512, 32, 0.003
_LANES = 2048
#: A text is told apart if its probability is at least what all but this share of held-out texts reach in their own language.
LOST, CHECKED = 0.002, 5  # of CHECKED labelled texts one is held out to find that limit
_BINS, _CLOSE = 4096, 1e-5  # bins of scores in a round; scores of a text from different batches differ by less
OTHERS = 600  # made-up windows


class ByteNetwork:
    """`embed` has, per byte and direction, the summed inputs of gate and candidate; `recur` the recurrent weights."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages, self.least = languages, 0.0
        self.p = {
            "embed": rng.normal(0, 0.3, (2, 257, 2 * UNITS)).astype(np.float32),
            "recur": rng.normal(0, 0.3, (2, UNITS, 2 * UNITS)).astype(np.float32),
            "out": rng.normal(0, 0.3, (2 * UNITS, len(languages) + 1)).astype(np.float32),  # the last class is `other`
            "bias": np.zeros(len(languages) + 1, np.float32),
        }
        self._pad()

    def _pad(self) -> None:
        self.p["embed"][:, PAD] = 0
        self.p["embed"][:, PAD, :UNITS] = -40  # a closed gate: padding leaves the state as it is

    def states(self, x: np.ndarray, tape: np.ndarray | None = None) -> np.ndarray:
        """x: bytes, WINDOW x lanes; the states of both directions at all positions. tape: for each direction and position the state before, gate and candidate."""
        out = np.empty((*x.shape, 2 * UNITS), np.float32)
        for d in (0, 1):
            embed, recur = self.p["embed"][d].copy(), self.p["recur"][d].copy()
            embed[:, :UNITS] *= 0.5  # a sigmoid is a scaled tanh: one call serves gate and candidate
            recur[:, :UNITS] *= 0.5
            h = np.zeros((x.shape[1], UNITS), np.float32)
            a, g = np.empty((x.shape[1], 2 * UNITS), np.float32), np.empty((x.shape[1], 2 * UNITS), np.float32)
            for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
                np.take(embed, x[t], axis=0, out=a, mode="clip")
                np.matmul(h, recur, out=g)
                a += g
                np.tanh(a, out=a)
                z = a[:, :UNITS] * np.float32(0.5)
                z += np.float32(0.5)
                n = a[:, UNITS:]
                if tape is not None:
                    tape[d, 0, t], tape[d, 1, t], tape[d, 2, t] = h, z, n
                step = n - h
                step *= z
                h += step
                out[t, :, d * UNITS : (d + 1) * UNITS] = h
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        logits = states.reshape(-1, 2 * UNITS) @ self.p["out"]
        logits += self.p["bias"]
        np.clip(logits, -60, 60, out=logits)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        tape = np.empty((2, 3, *x.shape, UNITS), np.float32)
        states = self.states(x, tape)
        p = self.probabilities(states)
        real = x != PAD
        real = (real if weight is None else real * weight).ravel().astype(np.float32)
        real /= real.sum()
        rows, label = np.arange(len(p)), np.tile(y, len(x))
        loss = float(-(np.log(p[rows, label] + 1e-9) * real).sum())
        p[rows, label] -= 1
        p *= real[:, None]
        flat = states.reshape(-1, 2 * UNITS)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["bias"] = flat.T @ p, p.sum(axis=0)
        into = (p @ self.p["out"].T).reshape(states.shape)
        order = np.argsort(x.ravel().astype(np.int16), kind="stable")
        of, first = np.unique(x.ravel()[order], return_index=True)
        pre = np.empty((*x.shape, 2 * UNITS), np.float32)
        a, stay = np.empty((2, x.shape[1], UNITS), np.float32)
        for d in (0, 1):
            back = np.ascontiguousarray(self.p["recur"][d].T)
            dh = np.zeros((x.shape[1], UNITS), into.dtype)
            for t in range(len(x) - 1, -1, -1) if d == 0 else range(len(x)):
                h, z, n = tape[d, :, t]
                dh += into[t, :, d * UNITS : (d + 1) * UNITS]
                np.subtract(1, z, out=stay)
                np.subtract(n, h, out=a)
                a *= z
                a *= stay
                np.multiply(dh, a, out=pre[t, :, :UNITS], casting="same_kind")
                np.multiply(n, n, out=a)
                np.subtract(1, a, out=a)
                a *= z
                np.multiply(dh, a, out=pre[t, :, UNITS:], casting="same_kind")
                dh *= stay
                dh += pre[t] @ back
            every = pre.reshape(-1, 2 * UNITS)
            g["recur"][d] = tape[d, 0].reshape(-1, UNITS).T @ every
            g["embed"][d, of] = np.add.reduceat(np.take(every, order, axis=0), first, axis=0)
        g["embed"][:, PAD] = 0
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 9) -> float:
        """x: bytes, windows x WINDOW; y: numbers of languages."""
        rng = np.random.default_rng(seed)
        ahead, loss = Descent(self), 0.0
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), min(BATCH, 4 * len(x)))
            loss, g = self.gradients(np.ascontiguousarray(x[pick].T), y[pick])
            ahead.step(g, RATE * (1 - 0.9 * step / steps))
        return loss

    def read(self, chunks: Iterator[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, again: list[tuple[np.ndarray, np.ndarray]], expected: float, seed: int = 11) -> int:
        """Trains once on each window of the chunks (windows x WINDOW, numbers of languages), about `expected` in all, and returns their number.

        weight: of a window of each language; again: sets of windows of which every step repeats
        `REPEATED` each. A chunk's windows are taken in a random order, as neighbours are of one text.
        """
        rng, ahead, done = np.random.default_rng(seed), Descent(self), 0
        for x, y in chunks:
            order = rng.permutation(len(x))
            for s in range(0, len(x), WIDE_BATCH):
                of = order[s : s + WIDE_BATCH]
                more = [(some[pick], label[pick]) for some, label in again if len(some) for pick in [rng.integers(0, len(some), -(-REPEATED * len(of) // WIDE_BATCH))]]
                label = np.concatenate([y[of], *(b for _, b in more)])
                heavy = np.concatenate([weight[y[of]], np.ones(len(label) - len(of))])
                _, g = self.gradients(np.ascontiguousarray(np.concatenate([x[of], *(a for a, _ in more)]).T.astype(np.int64)), label, heavy)
                done += len(of)
                ahead.step(g, SHARD_RATE * (1 - 0.95 * min(1.0, done / expected)))
        return done

    def documents(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean probabilities of the languages, and of `other`, over all bytes of each text; zeros for an empty one."""
        n = np.diff(at)
        owner, begin, stop = _cut(at)
        total = np.zeros((len(n), len(self.languages) + 1))
        most = max(32, min(_LANES, (1 << 23) // (WINDOW * total.shape[1])))
        for s in range(0, len(owner), most):
            b, e = begin[s : s + most], stop[s : s + most]
            x, real = _filled(data, b, e)
            p = self.probabilities(self.states(x)).reshape(WINDOW, len(b), -1)
            if not real[-1].all():
                p *= real[:, :, None]
            lane = p.sum(axis=0)
            np.add.at(total, owner[s : s + most], lane)
        return total / np.maximum(n, 1)[:, None]


class Descent:
    """Steps of normalised gradients with moments, on a network's weights."""

    def __init__(self, network: ByteNetwork):
        self.network, self.n = network, 0
        self.m, self.s = ({k: np.zeros_like(w) for k, w in network.p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        size = max(1.0, float(np.sqrt(sum((w * w).sum() for w in g.values()))))
        for k, w in g.items():
            w /= size
            self.m[k] += 0.1 * (w - self.m[k])
            self.s[k] += 0.01 * (w * w - self.s[k])
            self.network.p[k] -= (rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.s[k] / (1 - 0.99**self.n)) + 1e-7)).astype(np.float32)
        self.network._pad()


def _cut(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of the texts at these offsets: number of the text, begin and end."""
    lanes = -(-np.diff(at) // WINDOW)
    first = np.cumsum(lanes) - lanes
    owner = np.repeat(np.arange(len(lanes)), lanes)
    begin = at[:-1][owner] + (np.arange(len(owner)) - first[owner]) * WINDOW
    return owner, begin, np.minimum(begin + WINDOW, at[1:][owner])


def _filled(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows as WINDOW x lanes with padding, and which places are no padding."""
    where = begin[None, :] + np.arange(WINDOW)[:, None]
    real = where < stop[None, :]
    return np.where(real, data[np.minimum(where, len(data) - 1)].astype(np.int64), PAD), real


def _chunks(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All windows of all texts (lang, text), windows x WINDOW, with the numbers of their languages, in pieces of `CHUNK_WINDOWS` (the last is shorter)."""
    number = {lang: i for i, lang in enumerate(languages)}
    parts, labels, size = [], [], 0
    for whole in batches:
        for batch in slices(whole, "text", 1 << 22):
            data, at = text_bytes(batch.column(batch.schema.get_field_index("text")))
            owner, begin, stop = _cut(at)
            if not len(owner):
                continue
            lang = np.array([number[x] for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()], np.int64)
            for s in range(0, len(owner), CHUNK_WINDOWS):
                parts.append(_filled(data, begin[s : s + CHUNK_WINDOWS], stop[s : s + CHUNK_WINDOWS])[0].T.astype(np.int16))
                labels.append(lang[owner[s : s + CHUNK_WINDOWS]])
                size += len(labels[-1])
                if size >= CHUNK_WINDOWS:
                    x, y = np.concatenate(parts), np.concatenate(labels)
                    yield x[:CHUNK_WINDOWS], y[:CHUNK_WINDOWS]
                    parts, labels, size = [x[CHUNK_WINDOWS:]], [y[CHUNK_WINDOWS:]], size - CHUNK_WINDOWS
    if size:
        yield np.concatenate(parts), np.concatenate(labels)


def _read(shipped, weight: np.ndarray, again: list[tuple[np.ndarray, np.ndarray]], expected: float):
    """Of each shard: its number of windows, and the weights after reading it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = copy.copy(shipped.value)
        network.p = {k: w.copy() for k, w in network.p.items()}
        windows = network.read(_chunks(batches, network.languages), weight, again, expected)
        if windows:
            flat = np.concatenate([network.p[k].ravel() for k in sorted(network.p)]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([windows], pa.int64()), pa.array([(flat * windows).tobytes()], pa.binary())], names=["words", "weights"])

    return run


def read_corpus(network: ByteNetwork, texts: DataFrame, size: np.ndarray, again: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Trains the network on all texts (lang, text, o): every shard starts from its weights, and the shards' means replace them. size: bytes of each language."""
    total = int(size.sum())
    if not total:
        return
    shards = -(-total // SHARD_BYTES)
    dealt = texts.repartition(shards, "o").sortWithinPartitions("o", "lang").select("lang", "text")
    weight = total / len(size) / np.maximum(size, 1)
    shipped = texts.sparkSession.sparkContext.broadcast(network)
    schema = "words bigint, weights binary"
    each = saved(dealt.mapInArrow(trimmed(_read(shipped, weight, again, max(1.0, total / shards / WINDOW))), schema), "language-weights")
    sums = each.coalesce(min(shards, 16)).mapInArrow(_added, schema).collect()  # 16 rows at most
    if not sums:
        return
    mean, at = sum(np.frombuffer(bytes(r.weights), np.float64) for r in sums) / sum(r.words for r in sums), 0
    for k in sorted(network.p):
        network.p[k] = mean[at : at + network.p[k].size].reshape(network.p[k].shape).astype(np.float32)
        at += network.p[k].size
    network._pad()


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(256, np.int64)
    for batch in batches:
        counts += np.bincount(text_bytes(batch.column(0))[0], minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256), pa.int32()), pa.array(counts)], names=["byte", "n"])


def smallest(values: DataFrame, share: float) -> float | None:
    """The least number of the one column of values that no more than this share of them are below; None without values.

    Exact: each round counts at most `_BINS` bins between the smallest and largest number in
    question, and goes on inside the bin that has the one wanted. NaN and null must not occur.
    """
    name = F.col(f"`{values.columns[0]}`")
    n, low, high = values.agg(F.count("*"), F.min(name), F.max(name)).first()
    before = int(share * n)
    while n and low < high:
        inside = values.where((name >= low) & (name <= high))
        bins = inside.groupBy(F.least(F.floor((name - low) / (high - low) * _BINS), F.lit(_BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min(name).alias("low"), F.max(name).alias("high"))
        for _, count, low, high in sorted(bins.collect()):
            if before < count:
                break
            before -= count
    return low


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text (o, lang, text): some windows from anywhere in it, one after another in one value, and their sizes."""
    for batch in batches:
        data, at = text_bytes(batch.column(batch.schema.get_field_index("text")))
        windows, sizes = [], []
        for i, n in enumerate(np.diff(at).tolist()):
            rng = np.random.default_rng(n)
            begins = rng.integers(0, max(1, n - WINDOW + 1), min(WINDOWS_PER_TEXT, 1 + n // WINDOW)).tolist() if n else []
            parts = [data[at[i] + b : min(at[i] + b + WINDOW, at[i + 1])].tobytes() for b in begins]
            windows.append(b"".join(parts))
            sizes.append([len(p) for p in parts])
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("lang", "o")), pa.array(windows, pa.binary()), pa.array(sizes, pa.list_(pa.int32()))], names=["lang", "o", "windows", "sizes"])


def other_windows(seen: list[int] | np.ndarray, count: int = OTHERS, seed: int = 13) -> list[bytes]:
    """Windows of made-up words; `seen` counts each byte in the labelled documents."""
    rng = np.random.default_rng(seed)
    common = np.asarray(seen) > np.sum(seen) / 1000
    starts = [c for c in range(0x100, 0xD700, 0x20) if not common[chr(c).encode()[0]]]
    out = []
    for i in range(count):
        letters = "abcdefghijklmnopqrstuvwxyz" if i % 2 == 0 or not starts else "".join(map(chr, range(c := int(rng.choice(starts)), c + 0x20)))
        words = "".join(letters[k] if k < len(letters) else " " for k in rng.integers(0, len(letters) + 5, WINDOW).tolist())
        out.append(words.encode()[:WINDOW])
    return out


def _labelled(docs: DataFrame) -> DataFrame:
    """lang, text and a hash of id and text, of rows with a language, a text and an id."""
    return small_batches(docs).where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("lang", "text", F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), "text"), 1).alias("o"))


def sample_windows(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> list[tuple[str, int, bytes, list[int]]]:
    """(lang, hash, windows, sizes) of the `per_language` distinct texts of each language with the least hashes of id and text, `rows` in all at most.

    A limit on the hash, from each language's count, leaves about twice as many rows as are
    wanted before anything is shuffled; rows that repeat both id and text count once.
    """
    good = _labelled(labelled)
    counts = saved(good.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = counts.count()
    if not languages:
        return []
    each = max(1, min(per_language, rows // languages))
    limits = counts.select("lang", (F.least(F.lit(1.0), (2 * each + 50) / F.col("n")) * float(2**63)).alias("most"))
    limits = F.broadcast(limits) if languages <= rows else limits  # a row a language
    near = good.join(limits, "lang").where(F.col("o").cast("double") <= F.col("most")).select("lang", "o", "text")
    found = near.mapInArrow(trimmed(_windows), "lang string, o bigint, windows binary, sizes array<int>").dropDuplicates(["lang", "o"])
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("o"))).where(F.col("rank") <= each)
    return sorted(((r.lang, r.o, bytes(r.windows), list(r.sizes)) for r in ranked.orderBy("rank", "lang").limit(rows).collect()), key=lambda x: (x[1], x[0]))


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, rows: int = SAMPLE_ROWS, whole: bool = True) -> ByteNetwork | None:
    """Train on all rows of (doc_id, text, lang) with an id, a text and a language, from a start on a bounded sample of them.

    One of `CHECKED` by the hash is not learned from; over all of those, whole, `network.least` is
    found, the lowest probability of a text that is told apart. Unless `whole`, the start is all:
    the sample's texts but one of `CHECKED`, and no limit.
    """
    found = sample_windows(labelled, per_language, rows)
    if not found:
        return None
    texts, checked = _labelled(labelled), F.col("o") % CHECKED == CHECKED - 1
    start = [x for i, x in enumerate(found) if (x[1] if whole else i) % CHECKED != CHECKED - 1]
    if whole:
        counts = saved(texts.groupBy("lang").agg(F.sum(F.when(checked, 0).otherwise(F.octet_length("text"))).alias("n")), "language-bytes").collect()  # a row a language
        size = dict(map(tuple, counts))
        languages, seen = sorted(size), np.zeros(256, np.int64)
        for byte, n in texts.where(~checked).select("text").mapInArrow(trimmed(_byte_counts), "byte int, n bigint").groupBy("byte").agg(F.sum("n")).collect():
            seen[byte] = n
    else:
        languages, seen = sorted({x[0] for x in found}), np.bincount(np.frombuffer(b"".join(x[2] for x in start), np.uint8), minlength=256)
    network = ByteNetwork(languages)
    number = {lang: i for i, lang in enumerate(languages)}

    def padded(cut: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.full((len(cut), WINDOW), PAD, np.int64)
        for i, (_, w) in enumerate(cut):
            x[i, : len(w)] = np.frombuffer(w, np.uint8)
        return x, np.array([k for k, _ in cut], np.int64)

    x, y = padded([(number[lang], w.tobytes()) for lang, _, joined, sizes in start for w in np.split(np.frombuffer(joined, np.uint8), np.cumsum(sizes)[:-1]) if len(w)])
    more, others = padded([(len(languages), w) for w in other_windows(seen)][: max(1, len(x) // len(languages))])
    if len(x):
        network.train(np.concatenate([x, more]), np.concatenate([y, others]))
    if whole:
        read_corpus(network, texts.where(~checked), np.array([size[lang] for lang in languages], np.int64), [(x.astype(np.int16), y), (more.astype(np.int16), others)])
        own = predictions(texts.where(checked).select("lang", "text"), network, ["lang"]).where(F.col("lang_pred") == F.col("lang")).select("score")
        found = smallest(saved(own, "own-scores"), LOST)
        network.least = 0.0 if found is None else max(0.0, found - _CLOSE)
    return network


def predictions(docs: DataFrame, network: ByteNetwork | None, keep: list[str] | None = None, text_column: str = "text") -> DataFrame:
    """The columns `keep` of docs (all by default) with lang_pred and score; `und` and 0 for a text that is null or has no letter, or without a network.

    Columns of docs that are named lang_pred or score are replaced. Every byte of a text of any
    length is read; repeated rows get equal results; an empty table gives no rows.
    """
    docs = small_batches(docs)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    letter_column = "has_letter"
    while letter_column in docs.columns:
        letter_column = f"_{letter_column}"
    letters = F.coalesce(F.col(f"`{text_column}`").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*kept, text_column])), letters.alias(letter_column))
    shipped = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for whole in batches:
            for batch in slices(whole, text_column):
                letter = batch.column(batch.schema.get_field_index(letter_column)).to_numpy(zero_copy_only=False).astype(bool)
                names, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
                if model is not None:
                    p = model.documents(*text_bytes(batch.column(batch.schema.get_field_index(text_column))))
                    best = p[:, :-1].argmax(axis=1)
                    names = np.where(letter, np.array(model.languages, object)[best], "und")
                    score = np.where(letter, np.minimum(p[np.arange(len(p)), best], 1.0), 0.0)
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    ddl = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    return rows.mapInArrow(trimmed(run), ddl + "lang_pred string, score double")


def held_out(id_column: Column) -> Column:
    return F.coalesce(fold(id_column, 4) == 2, F.lit(False))


def op6_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns only from a sample of the rows outside the fold with a language.

    A null or letterless text is `und` with score 0. Rows with a null doc_id are predicted but not
    learned from; a table without labelled rows gives `und` everywhere; repeated rows get equal
    results; other columns are ignored.
    """
    rows = docs.select("doc_id", "text", "lang")
    network = fit(rows.where(~held_out(F.col("doc_id"))), whole=False)
    found = predictions(rows.select("doc_id", "text"), network, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float | None = None) -> DataFrame:
    """docs without rows whose language can't be told: `und`, or a pooled probability under `least`; a null `lang` becomes the language found.

    By default the limit is what nearly all (all but `LOST`) texts of a fifth of the labelled rows
    reach. Learns from all other rows with a language and an id; without any, all rows go. A null, empty or
    letterless text is `und` and goes. Null ids and repeated rows are treated like others; every
    byte of a text of any length is read; columns may have any names; an empty table gives no
    rows.
    """
    docs = small_batches(docs)
    network = fit(docs.select("doc_id", "text", "lang"))
    found = predictions(docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), "text"), network)
    limit = (0.0 if network is None else network.least) if least is None else least
    told = found.where((F.col("lang_pred") != "und") & (F.col("score") >= limit))
    return told.select(*((F.coalesce(f"c{i}", "lang_pred") if c == "lang" else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)))
