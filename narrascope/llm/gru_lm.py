"""Language-model scoring with a gated recurrent network.

Word counts of all training documents give the vocabulary. The network predicts, word by word,
a class and a place inside its class, with a softmax over classes and another inside the class:
each of the `HEAD` most frequent words (and the end of a document) has a place of its own; the
other ranked words share places with words of their frequency bin and ending, and inside a place
a word's share is its smoothed corpus count; words without a rank are one more class of that
kind. So probabilities sum to one over all words seen in training and one unseen word. A
document's state is carried from window to window, so a score is the log-likelihood of the
complete document.

The `RANKED` most frequent words travel to the executors as one table of fixed size; words beyond
it are joined to their counts by a shuffle. Weights are trained by truncated backpropagation
through time in numpy: the driver starts them on a bounded, hash-ordered sample; then tasks read
all training documents once, whole, in hash-ordered shards of about `SHARD_WORDS` words, so the
steps grow with the corpus, and the shards' weights are averaged by their words. The state runs
through every word, and errors of every word go back, as far as the begin of its window of `SPAN`
words. The hash decides a document's shard and place, so partitions of the input don't matter.
"""

from __future__ import annotations

import copy
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope.llm.shared import fold, saved, skewed_join, small_batches
from narrascope.llm.textkernel import lower_ascii, slices, text_bytes, trimmed

RANKED, HEAD, CLASS, BINS, BIN_CLASSES = 200_000, 1024, 32, (8_192, 65_536), 8  # bins end at these ranks and at RANKED
UNITS, SUFFIXES = 24, 61
SAMPLE_TEXTS, SAMPLE_WORDS = 2_000, 3_000  # per text, from a place anywhere in it
STEPS, LANES, SPAN, RATE = 900, 64, 24, 0.012
SHARD_WORDS, CHUNK_WORDS, WIDE_LANES, SHARD_RATE = 3_000_000, 1 << 20, 512, 0.004
_ROWS = 2_048  # whose logits lie in the CPU's caches
_FLUSH = 200_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial word counts; the empty word stands for the ends of documents."""

    def flush(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    counts: Counter[bytes] = Counter()
    for whole in batches:
        for batch in slices(whole, "text"):
            data, at = text_bytes(batch.column(batch.schema.get_field_index("text")))
            raw = lower_ascii(data.tobytes())
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                counts.update(raw[a:b].split())
            counts[b""] += len(at) - 1
            if len(counts) > _FLUSH:
                yield flush(counts)
                counts = Counter()
    if counts:
        yield flush(counts)


class Vocabulary:
    """Ranked words with their counts; per rank: class, place in the class, input row, log10 of the smoothed count, and log10 of the word's share of its place."""

    def __init__(self, ranked: list[tuple[bytes, int]], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.words = {bytes(w): i for i, (w, _) in enumerate(ranked)}
        self.counts = np.array([n for _, n in ranked], np.float64)
        n = len(ranked)
        rank = np.arange(n)
        self.head = min(HEAD, n)
        self.classes = -(-self.head // CLASS)
        self.cls, self.inner = (rank // CLASS).astype(np.int32), (rank % CLASS).astype(np.int32)
        ending = np.array([zlib.crc32(w[-2:]) for w in self.words], np.int64)
        for first, stop in zip((self.head, *BINS), (*BINS, n)):
            of = np.arange(max(first, self.head), min(stop, n))
            if len(of):
                classes = min(BIN_CLASSES, -(-len(of) // CLASS))
                place = ending[of] % (classes * CLASS)
                self.cls[of], self.inner[of] = self.classes + place // CLASS, place % CLASS
                self.classes += classes
        suffix = np.array([(sum(w[-2:]) + 7 * len(w[-2:])) % SUFFIXES for w in self.words], np.int64) if n else rank
        self.input = np.where(rank < self.head, rank, self.head + suffix).astype(np.int32)
        self.log = np.log10(self.counts + 0.5)
        self.outputs = self.classes + 1
        place = self.cls * CLASS + self.inner
        self.mass = np.bincount(place, self.counts + 0.5, self.classes * CLASS)  # of each place
        self.share = np.where(rank < self.head, 0.0, self.log - np.log10(np.maximum(self.mass[place], 0.5)))
        beyond = total - self.counts.sum() + 0.5 * (distinct - n) + 0.5  # words without a rank, and one unseen word
        self.log_beyond = float(np.log10(max(beyond, 0.5)))
        self.end = self.words.get(b"", -1)
        self.start_row, self.rare_row = self.head + SUFFIXES, self.head + SUFFIXES + 1
        self.log_denominator = float(np.log10(total + 0.5 * (distinct + 1)))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """Ranks (-1: none) of all words with an end after each text, the texts' sizes, and the words without a rank."""
        ranks, sizes, rare = [], [], []
        for text in texts:
            words = text.split()
            r = np.fromiter(map(self.words.get, words, repeat(-1)), np.int32, len(words))
            rare.append([words[i] for i in np.flatnonzero(r < 0).tolist()])
            ranks.append(r)
            ranks.append(np.array([self.end], np.int32))
            sizes.append(len(words) + 1)
        return np.concatenate(ranks) if ranks else np.zeros(0, np.int32), np.array(sizes, np.int64), rare


class Descent:
    """Steps of normalised gradients with moments, on weights changed in place."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.n = p, 0
        self.m, self.s = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        size = max(1.0, float(np.sqrt(sum((w * w).sum() for w in g.values()))))
        for k, w in g.items():
            w /= size
            self.m[k] += 0.1 * (w - self.m[k])
            self.s[k] += 0.01 * (w * w - self.s[k])
            self.p[k] -= (rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.s[k] / (1 - 0.99**self.n)) + 1e-6)).astype(np.float32)


def _softmax(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, target: np.ndarray, scale: float, errors: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log of each row's share of its target, and with errors the gradient of minus their sum times scale."""
    rows = np.arange(len(h))
    logits = h @ weights
    logits += bias
    picked = logits[rows, target]
    ones = np.ones(logits.shape[1], logits.dtype)
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(logits, out=logits)
        total = logits @ ones
    if not (total.min() > 1e-30 and total.max() < 1e30):  # the largest logit goes off only where it must
        logits = h @ weights
        logits += bias
        logits -= logits.max(axis=1, keepdims=True)
        picked = logits[rows, target]
        np.exp(logits, out=logits)
        total = logits @ ones
    out = picked - np.log(total)
    if not errors:
        return out, None
    logits *= (scale / total)[:, None]
    logits[rows, target] -= scale
    return out, logits


class Network:
    """An update-gated recurrent layer under a class-factored softmax."""

    def __init__(self, v: Vocabulary, seed: int = 3):
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.v = v
        self.p = {"embed": small(v.rare_row + 1, 2 * UNITS), "recur": small(UNITS, 2 * UNITS), "gate": np.full(2 * UNITS, 0, np.float32), "top": small(UNITS, v.outputs), "top_bias": np.zeros(v.outputs, np.float32), "word": small(v.classes, UNITS, CLASS), "word_bias": np.zeros((v.classes, CLASS), np.float32)}
        # start from the unigram model
        share = np.bincount(v.cls, v.counts, v.outputs) + 0.5
        share[-1] = max(0.5, v.total - v.counts.sum())
        self.p["top_bias"] += np.log(share / share.sum()).astype(np.float32)
        inside = np.where(v.mass > 0, np.log(np.maximum(v.mass, 0.5)), -30.0).reshape(v.classes, CLASS)  # -30: places without a word
        self.p["word_bias"] += (inside - inside.max(axis=1, keepdims=True)).astype(np.float32)

    def rows(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(input row, class, place in the class; -1 for no rank) of ranks."""
        known, at = ranks >= 0, np.maximum(ranks, 0)
        v = self.v
        return np.where(known, v.input[at], np.int32(v.rare_row)), np.where(known, v.cls[at], np.int32(v.outputs - 1)), np.where(known, v.inner[at], np.int32(-1))

    def states(self, x: np.ndarray, h: np.ndarray, reset: np.ndarray | None = None, tape: np.ndarray | None = None) -> np.ndarray:
        """x: input rows, steps x lanes; h: the state before, changed in place; reset: where a document begins. tape: for each step the state before, gate and candidate."""
        out = np.empty((*x.shape, UNITS), np.float32)
        embed, recur = self.p["embed"] + self.p["gate"], self.p["recur"].copy()
        embed[:, :UNITS] *= 0.5
        recur[:, :UNITS] *= 0.5
        a, g = np.empty((x.shape[1], 2 * UNITS), np.float32), np.empty((x.shape[1], 2 * UNITS), np.float32)
        for t in range(len(x)):
            if reset is not None:
                h *= ~reset[t][:, None]
            np.take(embed, x[t], axis=0, out=a, mode="clip")
            np.matmul(h, recur, out=g)
            a += g
            np.tanh(a, out=a)
            z = a[:, :UNITS] * np.float32(0.5)
            z += np.float32(0.5)
            n = a[:, UNITS:]
            if tape is not None:
                tape[0, t], tape[1, t], tape[2, t] = h, z, n
            step = n - h
            step *= z
            h += step
            out[t] = h
        return out

    def log_shares(self, h: np.ndarray, cls: np.ndarray, inner: np.ndarray, grads: dict | None = None) -> np.ndarray:
        """Natural log of the network's share of each target; with grads, also adds gradients of minus their mean, and d/dh as "h"."""
        order = np.argsort(cls.astype(np.int16) if self.v.outputs < 1 << 15 else cls, kind="stable")
        h, cls, inner = h[order], cls[order], inner[order]
        cut = np.searchsorted(cls, np.arange(self.v.classes + 1))
        sorted_out, one = np.empty(len(h), np.result_type(h, self.p["top"])), 1 / max(1, len(h))
        if grads is not None:
            grads |= {k: np.zeros_like(self.p[k]) for k in ("top", "top_bias", "word", "word_bias")}
            into = np.empty_like(h, sorted_out.dtype)
        for s in range(0, len(h), _ROWS):
            of = slice(s, s + _ROWS)
            sorted_out[of], shares = _softmax(h[of], self.p["top"], self.p["top_bias"], cls[of], one, grads is not None)
            if grads is not None:
                grads["top"] += h[of].T @ shares
                grads["top_bias"] += np.ones(len(shares), shares.dtype) @ shares
                into[of] = shares @ self.p["top"].T
        for c in np.flatnonzero(np.diff(cut)).tolist():
            of = slice(cut[c], cut[c + 1])
            more, shares = _softmax(h[of], self.p["word"][c], self.p["word_bias"][c], inner[of], one, grads is not None)
            sorted_out[of] += more
            if grads is not None:
                grads["word"][c], grads["word_bias"][c] = h[of].T @ shares, np.ones(len(shares), shares.dtype) @ shares
                into[of] += shares @ self.p["word"][c].T
        out = np.empty_like(sorted_out)
        out[order] = sorted_out
        if grads is not None:
            grads["h"] = np.empty_like(into)
            grads["h"][order] = into
        return out

    def gradients(self, x: np.ndarray, cls: np.ndarray, inner: np.ndarray, h: np.ndarray, reset: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        tape = np.empty((3, *x.shape, UNITS), np.float32)
        states = self.states(x, h, reset, tape)
        g: dict = {}
        loss = -float(self.log_shares(states.reshape(-1, UNITS), cls.ravel(), inner.ravel(), g).mean())
        into = g.pop("h").reshape(states.shape)
        g["embed"] = np.zeros_like(self.p["embed"])
        back = np.ascontiguousarray(self.p["recur"].T)
        dh = np.zeros((x.shape[1], UNITS), into.dtype)
        pres = np.empty((*x.shape, 2 * UNITS), np.float32)
        a, stay = np.empty((2, x.shape[1], UNITS), np.float32)
        for t in range(len(x) - 1, -1, -1):
            before, z, n = tape[:, t]
            dh += into[t]
            np.subtract(1, z, out=stay)
            np.subtract(n, before, out=a)
            a *= z
            a *= stay
            np.multiply(dh, a, out=pres[t, :, :UNITS], casting="same_kind")
            np.multiply(n, n, out=a)
            np.subtract(1, a, out=a)
            a *= z
            np.multiply(dh, a, out=pres[t, :, UNITS:], casting="same_kind")
            dh *= stay
            dh += pres[t] @ back
            dh *= ~reset[t][:, None]
        flat, rows = pres.reshape(-1, 2 * UNITS), x.ravel()
        g["recur"] = tape[0].reshape(-1, UNITS).T @ flat
        order = np.argsort(rows.astype(np.int16) if self.v.rare_row < 1 << 15 else rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        g["embed"][rows[first]] = np.add.reduceat(np.take(flat, order, axis=0), first, axis=0)
        g["gate"] = g["embed"].sum(axis=0)
        return loss, g

    def train(self, texts: list[np.ndarray], steps: int = STEPS) -> float:
        """texts: ranks with the end of each text; lanes read texts one after another and carry their state on."""
        if not texts:
            return 0.0
        stream = np.concatenate(texts)
        begin = np.zeros(len(stream), bool)
        begin[np.cumsum([0, *map(len, texts[:-1])])] = True
        row, cls, inner = self.rows(stream)
        x = np.concatenate([[self.v.start_row], row[:-1]])
        x[begin] = self.v.start_row
        place = (np.arange(LANES) * len(stream)) // LANES
        h = np.zeros((LANES, UNITS), np.float32)
        ahead, loss = Descent(self.p), 0.0
        for step in range(1, steps + 1):
            at = (place[None, :] + np.arange(SPAN)[:, None]) % len(stream)
            loss, g = self.gradients(x[at], cls[at], inner[at], h, begin[at])
            place = place + SPAN
            ahead.step(g, RATE * (1 - 0.95 * step / steps))
        return loss

    def read(self, chunks: Iterator[tuple[np.ndarray, np.ndarray]], expected: float) -> int:
        """Reads all of the chunks (ranks, whether a text begins there) once, about `expected` words in all, trains on each of their windows, and returns the number of words.

        Lanes read equal parts of a chunk. A text that goes on in the next chunk keeps its state.
        """
        ahead, words, before = Descent(self.p), 0, self.v.start_row
        last = np.zeros(UNITS, np.float32)
        for stream, begin in chunks:
            row, cls, inner = self.rows(stream)
            x = np.concatenate([[before], row[:-1]])
            x[begin], before = self.v.start_row, row[-1]
            lanes = int(min(WIDE_LANES, max(1, len(stream) // (32 * SPAN))))
            place = (np.arange(lanes) * len(stream)) // lanes
            most = -(-len(stream) // lanes)  # a shorter lane reads its neighbour's first word, too
            h = np.zeros((lanes, UNITS), np.float32)
            h[0] = last
            for done in range(0, most, SPAN):
                at = np.minimum(place[None, :] + np.arange(done, min(done + SPAN, most))[:, None], len(stream) - 1)
                words += int(min(SPAN, most - done)) * lanes
                _, g = self.gradients(x[at], cls[at], inner[at], h, begin[at])
                ahead.step(g, SHARD_RATE * (1 - 0.95 * min(1.0, words / expected)))
            last = h[-1]
        return words

    def log_likelihoods(self, ranks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 of the network's share of each text (class, and word where it has a place), windows with carried state."""
        order = np.argsort(-sizes, kind="stable")
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1][order]
        size = sizes[order]
        row, cls, inner = self.rows(ranks)
        total = np.zeros(len(sizes))
        h, done = np.zeros((len(sizes), UNITS), np.float32), 0
        while len(size) and done < size[0]:
            live = int(np.searchsorted(-size, -done, "left"))
            span = int(min(max(32, 16384 // live), 2048, size[0] - done))
            where = done + np.arange(span)[:, None] + first[None, :live]
            real = done + np.arange(span)[:, None] < size[None, :live]
            where = np.minimum(where, len(ranks) - 1)
            x = row[np.maximum(where - 1, 0)]
            if done == 0:
                x[0] = self.v.start_row
            state = h[:live]
            states = self.states(x, state)
            h[:live] = state
            keep = np.flatnonzero(real.ravel())
            shares = self.log_shares(states.reshape(-1, UNITS)[keep], cls[where.ravel()[keep]], inner[where.ravel()[keep]])
            total[:live] += np.bincount(keep % live, shares, live)
            done += span
        out = np.empty(len(sizes))
        out[order] = total / np.log(10)
        return out


def held_out(id_column: Column) -> Column:
    return F.coalesce(fold(id_column, 5) == 1, F.lit(False))


def _sample(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            data, at = text_bytes(batch.column(batch.schema.get_field_index("text")))
            raw, out = lower_ascii(data.tobytes()), []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                ranks = v.encode([raw[a:b]])[0]
                s = int(np.random.default_rng(b - a).integers(0, max(1, len(ranks) - SAMPLE_WORDS + 1)))
                out.append(ranks[s : s + SAMPLE_WORDS].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("o")), pa.array(out, pa.binary())], names=["o", "ranks"])

    return run


def sample_texts(training: DataFrame, vocabulary, sample: int) -> list[np.ndarray]:
    """The ranks of the `sample` distinct texts with the least hashes of id and text; a limit on the hash, from the number of texts, leaves about twice as many before anything is sorted."""
    each = training.where("doc_id IS NOT NULL").select(F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), "text"), 1).alias("o"), "text")
    most = min(1.0, (2 * sample + 50) / max(1, each.count())) * float(2**63)
    found = each.where(F.col("o").cast("double") <= most).mapInArrow(trimmed(_sample(vocabulary)), "o bigint, ranks binary").dropDuplicates(["o"]).orderBy("o").limit(sample).collect()
    return [np.frombuffer(bytes(r.ranks), np.int32).astype(np.int64) for r in found]


def _chunks(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All texts' ranks in pieces of `CHUNK_WORDS` (the last is shorter), with the places where texts begin."""
    parts, begins, size = [], [], 0
    for whole in batches:
        for batch in slices(whole, "text", 1 << 22):
            data, at = text_bytes(batch.column(batch.schema.get_field_index("text")))
            raw = lower_ascii(data.tobytes())
            ranks, sizes, _ = v.encode([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
            begin = np.zeros(len(ranks), bool)
            begin[np.cumsum(sizes) - sizes] = True
            parts, begins, size = [*parts, ranks], [*begins, begin], size + len(ranks)
            if size >= CHUNK_WORDS:
                ranks, begin = np.concatenate(parts), np.concatenate(begins)
                cut = size - size % CHUNK_WORDS
                for a in range(0, cut, CHUNK_WORDS):
                    yield ranks[a : a + CHUNK_WORDS], begin[a : a + CHUNK_WORDS]
                parts, begins, size = [ranks[cut:]], [begin[cut:]], size - cut
    if size:
        yield np.concatenate(parts), np.concatenate(begins)


def _read(model, vocabulary, expected: float):
    """Of each shard: its number of words, and the weights after reading it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = copy.copy(model.value)
        network.p = {k: w.copy() for k, w in network.p.items()}
        words = network.read(_chunks(batches, vocabulary.value), expected)
        if words:
            flat = np.concatenate([network.p[k].ravel() for k in sorted(network.p)]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([words], pa.int64()), pa.array([(flat * words).tobytes()], pa.binary())], names=["words", "weights"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, total = 0, None
    for batch in batches:
        for n, weights in zip(*(c.to_pylist() for c in batch.columns)):
            flat = np.frombuffer(weights, np.float64)
            words, total = words + n, flat if total is None else total + flat
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([words], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["words", "weights"])


def read_corpus(network: Network, vocabulary, training: DataFrame, total: int) -> None:
    """Trains the network on all texts: every shard starts from its weights, and the shards' means replace them."""
    shards = -(-total // SHARD_WORDS)
    key = F.xxhash64(F.col("doc_id").cast("string"), "text")
    dealt = training.select(key.alias("key"), "text").repartition(shards, "key").sortWithinPartitions("key").select("text")
    model = training.sparkSession.sparkContext.broadcast(network)
    schema = "words bigint, weights binary"
    each = saved(dealt.mapInArrow(trimmed(_read(model, vocabulary, total / shards)), schema), "weights")
    sums = each.coalesce(min(shards, 16)).mapInArrow(_added, schema).collect()  # 16 rows at most
    mean, at = sum(np.frombuffer(bytes(r.weights), np.float64) for r in sums) / sum(r.words for r in sums), 0
    for k in sorted(network.p):
        network.p[k] = mean[at : at + network.p[k].size].reshape(network.p[k].shape).astype(np.float32)
        at += network.p[k].size


def _score(model, vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, network = vocabulary.value, model.value
        number = TaskContext.get().partitionId() << 40  # with a running number: a key of each row, written down once
        for whole in batches:
            for batch in slices(whole, "text", 1 << 22):
                data, at = text_bytes(batch.column(batch.schema.get_field_index("text")))
                raw = lower_ascii(data.tobytes())
                ranks, sizes, rare = v.encode([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
                n = len(sizes)
                owner = np.repeat(np.arange(n), sizes)
                known, safe = ranks >= 0, np.maximum(ranks, 0)
                logs = np.where(known, v.log[safe], 0.0) if len(v.log) else np.zeros(len(ranks))
                base = np.bincount(owner, logs, n) - sizes * v.log_denominator
                # an end that training never had counts as an unseen word
                base += np.where(v.end < 0, np.log10(0.5), 0.0)
                if network is None:
                    score = base.copy()
                else:
                    shares = np.where(known, v.share[safe], -v.log_beyond)
                    score = network.log_likelihoods(ranks, sizes) + np.bincount(owner, shares, n)
                counted = [Counter(words) for words in rare]
                key = number + np.arange(n)
                number += n
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("doc_id")), pa.array(key), pa.array(sizes), pa.array(np.bincount(owner, known, n).astype(np.int64)), pa.array(base), pa.array(score)]
                    + [pa.array([list(x) for x in values], pa.list_(kind)) for values, kind in (([c.keys() for c in counted], pa.binary()), ([c.values() for c in counted], pa.int32()))],
                    names=["doc_id", "key", "n_tokens", "known", "base", "share", "rare", "times"],
                )

    return run


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words with their counts, about `most` and never more, sorted.

    A histogram of a few hundred bins of counts tells down to which bin all words are taken; of
    the next bin those under a limit on their hash are, as words of one count may be many.
    """
    level = F.floor(F.log2("n") * 16)
    room, least, part = most, None, 0.0
    for bin_, words in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        if words > room:
            part, least = room / words, bin_
            break
        room -= words
    chosen = counts if least is None else counts.where((level > least) | ((level == least) & (F.shiftrightunsigned(F.xxhash64("word"), 1).cast("double") < part * 0.98 * float(2**63))))
    return sorted(((bytes(w), n) for w, n in chosen.toLocalIterator()), key=lambda x: (-x[1], x[0]))[:most]


def op4_lm_scores(docs: DataFrame, sample: int = SAMPLE_TEXTS, steps: int = STEPS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end alone; a text of any length is scored as a whole. A null
    doc_id is never held out, and its text is learned from. Repeated rows get equal results;
    other columns are ignored; an empty table gives no rows; without training documents score
    equals base_score.
    """
    spark = docs.sparkSession
    rows = small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    training = rows.where(~held_out(F.col("doc_id")))
    counts = saved(training.select("text").mapInArrow(trimmed(_count), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ranked = most_frequent(counts, RANKED)
    v = Vocabulary(ranked, total, distinct)
    vocabulary = spark.sparkContext.broadcast(v)
    network = None
    if total:
        network = Network(v)
        network.train(sample_texts(training, vocabulary, sample), steps)
        read_corpus(network, vocabulary, training, total)
    scored = saved(rows.mapInArrow(trimmed(_score(spark.sparkContext.broadcast(network), vocabulary)), "doc_id bigint, key bigint, n_tokens bigint, known bigint, base double, share double, rare array<binary>, times array<int>"), "scored")
    rare = scored.select("key", F.explode(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("times"))).alias("r")).select("key", F.col("r.word").alias("word"), F.col("r.times").alias("times"))
    # a word may be unseen, or rare in training, and yet stand in a great many texts
    per_word = rare.groupBy("word").agg(F.count("*").alias("n"))
    known = saved(per_word.join(counts.withColumnRenamed("n", "c"), "word", "left").select("word", "n", "c"), "rare-words")
    joined = skewed_join(rare, known, ["word"], known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    sums = joined.groupBy("key").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("more"))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.drop("rare", "times").join(sums, "key", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("share") + logs).alias("score"),
    )
