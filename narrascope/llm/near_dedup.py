"""MinHash near-duplicates with odd sketches.

Every document becomes a set of word shingles, 120 MinHash samples, 24 band keys and an odd
sketch: a parity bitmap into which the samples are folded, so that the population count of the
XOR of two sketches estimates a high similarity. Documents with equal sets, told by 128-bit keys,
collapse into one node first; nodes are numbered in a table, so no two share a number. Every bucket of a band has its smallest node as its hub, and all buckets of a hub form one
cell, so each pair that shares a bucket shares a cell, while a node is in a cell once. Sketches
are compared inside a cell, and rows without a plausible partner leave it; what stays is confirmed
on full sets and gives at most one link a row, between parts that are not yet connected. Large
cells are cut into blocks that meet pairwise. So a group of thousands of near copies yields as
many links as documents, and no pair is emitted or skipped.

With 24 bands of 5 samples, a pair at similarity 0.85 shares no bucket with probability 8e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm.shared import saved, skewed_join, small_batches
from narrascope.llm.textkernel import SPACED, U, Words, grams, mix, slices, text_bytes, trimmed

BANDS, ROWS = 24, 5
SAMPLES = BANDS * ROWS
SKETCH_WORDS = 4  # 256 bits
_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the bounds of each text's part; a text of fewer than k words has one shingle, its whole sequence."""
    h, n = words.hashes(), words.counts
    long = n >= k
    m = np.where(long, n - k + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(m)])
    values = np.empty(bounds[-1], np.uint64)
    windows = grams(h, k)
    runs = np.flatnonzero(long)
    if len(runs):
        at = np.arange(m[runs].sum()) - np.repeat(np.cumsum(m[runs]) - m[runs], m[runs])
        values[np.repeat(bounds[runs], m[runs]) + at] = windows[np.repeat(words.first[runs], m[runs]) + at]
    for i in np.flatnonzero(~long & (n > 0)):
        values[bounds[i]] = grams(h[words.first[i] : words.first[i] + n[i]], int(n[i]))[0] ^ U(n[i])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[bounds[:-1][m > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return values[new], kept[bounds]


def set_keys(values: np.ndarray, bounds: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Two 64-bit keys of each non-empty set (`full`: their numbers), as two rows."""
    if not len(full):
        return np.zeros((2, 0), np.uint64)
    sizes = (bounds[1:] - bounds[:-1])[full].astype(np.uint64) * U(0x9E3779B97F4A7C15)
    spread = mix(values)
    return np.stack([mix(np.add.reduceat(spread, bounds[:-1][full]) + sizes), mix(np.add.reduceat(mix(spread ^ U(0x5851F42D4C957F2D)), bounds[:-1][full]) ^ sizes)])


def samples(values: np.ndarray, bounds: np.ndarray, full: np.ndarray) -> np.ndarray:
    """SAMPLES x sets: the MinHash samples."""
    x, at = (values >> U(32)).astype(np.uint32), bounds[:-1][full]
    out = np.empty((SAMPLES, len(full)), np.uint32)
    if len(full):
        room = np.empty_like(x)
        for i in range(SAMPLES):
            np.bitwise_xor(x, _XOR[i], out=room)
            np.multiply(room, _MUL[i], out=room)
            out[i] = np.minimum.reduceat(room, at)
    return out


def band_keys(sampled: np.ndarray) -> np.ndarray:
    """sets x BANDS: bucket keys that also hold the band's number."""
    out = np.empty((sampled.shape[1], BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(sampled.shape[1], b + 1, np.uint64)
        for row in sampled[b * ROWS : (b + 1) * ROWS]:
            key = key * U(0x2545F4914F6CDD1D) + row
        out[:, b] = mix(key)
    return out


def odd_sketches(sampled: np.ndarray) -> np.ndarray:
    """sets x SKETCH_WORDS: bit j is the parity of the number of samples that hash to j."""
    out = np.zeros((sampled.shape[1], SKETCH_WORDS), np.uint64)
    rows = np.arange(sampled.shape[1])
    for i in range(len(sampled)):
        bit = mix(sampled[i].astype(np.uint64) + U((i + 1) << 32))
        out[rows, (bit >> U(6)) % U(SKETCH_WORDS)] ^= U(1) << (bit & U(63))
    return out


def most_different_bits(similarity: float, sigmas: float = 5.0) -> int:
    """The most bits in which two odd sketches of sets this similar differ, short of a chance of the given number of standard deviations."""
    n, differ = 64 * SKETCH_WORDS, SAMPLES * (1 - similarity)
    slope = 2 * (1 - 2 / n) ** (2 * differ)
    mean = n / 2 * (1 - (1 - 2 / n) ** (2 * differ))
    spread = (slope * slope * differ * similarity + mean) ** 0.5
    return min(n, int(mean + sigmas * spread) + 1)


def _describe(k: int, kept: list[str], text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_column):
                data, at = text_bytes(batch.column(batch.schema.get_field_index(text_column)))
                values, bounds = shingle_sets(Words(data, at, SPACED), k)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                sampled = samples(values, bounds, full)
                keys = np.zeros((2, len(n)), np.int64)
                keys[:, full] = set_keys(values, bounds, full).view(np.int64)
                bands = np.zeros((len(n), BANDS), np.int64)
                bands[full] = band_keys(sampled).view(np.int64)
                sketch = np.zeros((len(n), SKETCH_WORDS), np.int64)
                sketch[full] = odd_sketches(sampled).view(np.int64)
                listed = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(n.astype(np.int64)), *(pa.array(key, mask=n == 0) for key in keys), listed(bands), listed(sketch)],
                    names=[*kept, "n_shingles", "key", "key2", "bands", "sketch"],
                )

    return run


def _sets(k: int):
    """(text, node, key, key2) rows to (node, its set as bytes); a text that has another set gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, at = text_bytes(batch.column(batch.schema.get_field_index("text")))
                values, bounds = shingle_sets(Words(data, at, SPACED), k)
                full = np.flatnonzero(np.diff(bounds))
                wanted = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[full] for c in ("key", "key2")])
                good = full[(set_keys(values, bounds, full).view(np.int64) == wanted).all(axis=0)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch.column(batch.schema.get_field_index("node")).to_numpy(zero_copy_only=False)[good]), pa.array([values[bounds[i] : bounds[i + 1]].tobytes() for i in good], pa.binary())],
                    names=["node", "shingles"],
                )

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by (a, i, j), cut anew so that no cell is split: (rows, bounds of their cells)."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        bounds = _bounds(rest)
        if len(bounds) > 2:
            yield rest.slice(0, bounds[-2]).combine_chunks(), bounds[:-1]
            rest = rest.slice(bounds[-2])
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), _bounds(rest)


def _bounds(t: pa.Table) -> np.ndarray:
    a, i, j = (t[c].to_numpy() for c in ("a", "i", "j"))
    cut = np.flatnonzero((a[1:] != a[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
    return np.concatenate([[0], cut, [len(a)]])


def _bitmaps(t: pa.Table) -> np.ndarray:
    return t["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_WORDS)


def _plausible(most: int):
    """Of each cell, the rows whose sketch differs in few bits from another one of the cell's other (or only) block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _cells(batches):
            sketch, keep = _bitmaps(t), np.zeros(t.num_rows, bool)
            i, j, blk = (t[c].to_numpy() for c in ("i", "j", "blk"))
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                left = right = np.arange(s, e)
                if i[s] != j[s]:
                    left, right = left[blk[s:e] == i[s]], left[blk[s:e] == j[s]]
                for k in range(0, len(left), 256):
                    part = left[k : k + 256]
                    near = np.bitwise_count(sketch[part][:, None, :] ^ sketch[right][None, :, :]).sum(axis=2, dtype=np.int32) <= most
                    if i[s] == j[s]:
                        near[np.arange(len(part)), part - s] = False
                    keep[part] |= near.any(axis=1)
                    keep[right] |= near.any(axis=0)
            yield from t.select(["a", "i", "j", "node", "blk"]).filter(pa.array(keep)).to_batches()

    return run


def _links(num: int, den: int, most: int):
    """Of each cell, links that connect what its full sets connect: at most one a row.

    Any two rows of different blocks (or of the only block) are either already connected here,
    too different by their sketches, or compared on their full sets.
    """

    def cell(node, side, two, sketch, values, bounds):
        n, sizes = len(node), np.diff(bounds)
        _, ids = np.unique(values, return_inverse=True)
        marks, part = np.zeros(ids.max() + 1, bool), np.arange(n)

        def compare(x: int):
            other = part != part[x]
            if two:
                other &= side != side[x]
            other &= np.bitwise_count(sketch ^ sketch[x]).sum(axis=1, dtype=np.int32) <= most
            other &= den * np.minimum(sizes, sizes[x]) >= num * np.maximum(sizes, sizes[x])
            picked = np.flatnonzero(other)
            if not len(picked):
                return
            own = ids[bounds[x] : bounds[x + 1]]
            marks[own] = True
            if 4 * len(picked) > n:
                shared = np.add.reduceat(marks[ids], bounds[:-1], dtype=np.int64)[picked]
            else:
                shared = np.array([np.count_nonzero(marks[ids[bounds[y] : bounds[y + 1]]]) for y in picked])
            marks[own] = False
            for y in picked[den * shared >= num * (sizes[picked] + sizes[x] - shared)]:
                if part[y] != part[x]:
                    part[part == part[y]] = part[x]
                    yield node[x], node[y]

        yield from compare(0)
        largest = np.bincount(part, minlength=n).argmax()
        for x in np.flatnonzero(part != largest):  # each pair across parts has an end outside the largest
            yield from compare(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _cells(batches):
            sketch = _bitmaps(t)
            i, j, blk, node = (t[c].to_numpy() for c in ("i", "j", "blk", "node"))
            data, at = text_bytes(t["shingles"])
            values, at = np.frombuffer(data, np.uint64), at // 8
            found = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                found += cell(node[s:e], blk[s:e], i[s] != j[s], sketch[s:e], values[at[s] : at[e]], at[s : e + 1] - at[s])
            yield pa.RecordBatch.from_arrays([pa.array([int(x) for x, _ in found], pa.int64()), pa.array([int(y) for _, y in found], pa.int64())], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links between 64-bit nodes to (node, comp), comp the smallest node of the connected part.

    Alternates large-star and small-star steps; both are grouped minima that combine before the
    shuffle, each step's result is a table in the shared folder, and a node with many links is
    joined apart from the others.
    """
    links = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    while True:
        n = links.count()
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        large = saved(skewed_join(both, least, ["u"], 2 * n).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large")
        low = saved(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")), "low")
        small = skewed_join(large, low, ["hi"], n).select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi <> lo").distinct()
        new = saved(small, "links")
        settled = new.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and new.join(new.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi").isEmpty()
        links = new
        if settled:
            break
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).union(links.select(F.col("lo").alias("node"), F.col("lo").alias("comp")).distinct())


def _linked(rows: DataFrame, words: int, num: int, den: int, block: int) -> DataFrame:
    """rows (doc_id, text and perhaps more) with n_shingles, part (a number of the connected part, unlike its smallest id never shared) and component_id in place of text."""
    kept = [c for c in rows.columns if c != "text"]
    ddl = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in kept)
    described = saved(rows.mapInArrow(trimmed(_describe(words, kept, "text")), ddl + "n_shingles bigint, key bigint, key2 bigint, bands array<bigint>, sketch array<bigint>"), "described")
    total = described.count()
    key = ["key", "key2"]
    sets = described.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = saved(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbered where they are written, once
    most = most_different_bits(num / den)
    buckets = nodes.select("node", F.explode("bands").alias("band"))
    hubs = saved(buckets.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1"), "hubs")
    stars = saved(skewed_join(buckets, hubs, ["band"], BANDS * total).select("a", "node").distinct(), "stars")
    sizes = saved(stars.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("n")), "blocks")
    cells = (
        skewed_join(stars, sizes, ["a"], BANDS * total)
        .withColumn("blk", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("a", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "node", "blk")
    )
    sketches = nodes.select("node", "sketch")
    cell = ["a", "i", "j"]
    likely = saved(cells.join(sketches, "node").repartition(*cell).sortWithinPartitions(*cell).mapInArrow(trimmed(_plausible(most)), "a bigint, i int, j int, node bigint, blk int"), "likely")
    needed = nodes.select("node", "doc_id", *key).join(likely.select("node").distinct(), "node", "left_semi")
    texts = rows.select("doc_id", "text").join(needed, "doc_id")
    full_sets = saved(texts.select("node", *key, "text").mapInArrow(trimmed(_sets(words)), "node bigint, shingles binary"), "sets").dropDuplicates(["node"])
    full = likely.join(sketches, "node").join(full_sets, "node")
    edges = full.repartition(*cell).sortWithinPartitions(*cell, "node").mapInArrow(trimmed(_links(num, den, most)), "a bigint, b bigint")
    parts = saved(components(edges), "parts")
    least = saved(nodes.select("node", "doc_id").join(parts, "node").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "component-ids")
    labels = saved(skewed_join(parts, least, ["comp"], total).select("node", "comp", "component_id"), "labels")
    labelled = saved(nodes.select("node", *key, "n", F.col("doc_id").alias("own")).join(labels, "node", "left").select(*key, "n", F.coalesce("comp", "node").alias("part"), F.coalesce("component_id", "own").alias("component_id")), "labelled")
    found = described.select(*kept, "n_shingles", *(F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in key))
    return skewed_join(found, labelled, key, total, "left").select(*kept, "n_shingles", "part", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 3, num: int = 85, den: int = 100, id_column: str = "doc_id", text_column: str = "text", block: int = 500) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest linked doc_id, itself included), kept.

    Two documents are linked when den * |A & B| >= num * |A | B| for their sets of distinct
    shingles of `words` words (A-Z lower-cased, words split at ASCII white space). A null, empty
    or blank text has an empty set and no links. A row with a null doc_id is linked with nothing,
    has a null component_id and is kept. Rows that repeat a doc_id each get their own set; equal
    rows get equal results. A text of any length gives its whole set. Other columns of docs are
    ignored; an empty table gives no rows.
    """
    rows = small_batches(docs).select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    found = _linked(rows, words, num, den, block)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def without_copies(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text", block: int = 500) -> DataFrame:
    """docs, of which one row of each group of near copies stays: that with the smallest id, and of several such rows that with the smallest MD5 of its text.

    Rows without words, and rows with a null id, are linked with nothing and all stay. Of rows
    that repeat both id and text that with the smallest other columns stays. Columns may have
    any names; a very long text is compared as a whole; an empty table gives no rows.
    """
    content = F.unhex(F.md5(F.coalesce(F.col(text_column), F.lit("")).cast("binary")))
    rows = small_batches(docs).select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"), content.alias("content"))
    found = _linked(rows, words, num, den, block).where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = found.groupBy("part").agg(F.min(F.struct("doc_id", "content")).alias("f")).select(F.col("f.doc_id").alias("_own_id"), F.col("f.content").alias("_own_content"))
    blank = F.coalesce(F.translate(text_column, " \t\n\x0b\x0c\r", "") == "", F.lit(True))
    alone = docs.where(F.col(id_column).isNull() | blank)
    others = [c for c in docs.columns if c not in (id_column, text_column)]
    whole = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))) if others else F.lit(0)
    once = docs.where(F.col(id_column).isNotNull() & ~blank).groupBy(F.col(id_column).alias("_id"), content.alias("_content")).agg(F.min(whole).alias("_rest"), F.first(text_column).alias("_text"))
    kept = once.join(first, (F.col("_id").cast("bigint") == F.col("_own_id")) & (F.col("_content") == F.col("_own_content")), "left_semi")
    columns = {id_column: F.col("_id"), text_column: F.col("_text"), **{c: F.col(f"_rest.c{i}") for i, c in enumerate(others)}}
    return kept.select(*(columns[c].alias(c) for c in docs.columns)).unionByName(alone)


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least_id AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept FROM documents LEFT JOIN sizes USING (doc_id) JOIN least_id ON a = doc_id
"""
