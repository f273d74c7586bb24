"""Token ids of documents in Simple-8b shards.

Shard format. A shard folder holds Parquet files whose rows are segments in file order: `part`
and `seg` (position of the segment), `before` (ids of the part before it), `doc_ids`,
`doc_sizes` (ids of each document, end id included), and `payload`, bytes in little-endian order:

    magic b"S8B1" | u32 ids per block | u64 ids | u64 blocks | (blocks + 1) x u32 block offsets, in words | words

Each word has a selector in its upper 4 bits. Selectors 2 to 15 pack 60, 30, 20, 15, 12, 10, 8,
7, 6, 5, 4, 3, 2 and 1 ids of 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30 and 60 bits, the first
in the lowest bits. Selector 1 is an escape: the next word is one id of up to 64 bits. The last
word of a block may hold fewer ids. Blocks are independent, so all blocks of a segment are packed
and unpacked together in numpy.

Files are written by Spark's committer, so a lost executor or a repeated task leaves no partial
segment, and any file system that Spark knows will do.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm.shared import new_path, small_batches
from narrascope.llm.textkernel import BYTE_EXACT, SPACED, U, Words, WordTable, eights, marks, slices, text_bytes, trimmed

COUNTS = np.array([0, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE, BLOCK, SEGMENT_IDS, SEGMENT_TEXTS = 1, 1024, 1 << 20, 8192
_HEAD = struct.Struct("<4sIQQ")


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """The narrowest width of the table above that each id fits; 64 if none does."""
    if len(ids.ravel()) and ids.max() < len(_NARROW):
        return _NARROW[ids]
    edges = np.array(sorted(BITS[2:].tolist()), np.uint64)
    return np.array([*edges, 64], np.uint8)[np.searchsorted(U(1) << edges, ids, "right")]


_NARROW = np.array(sorted(BITS[2:].tolist()), np.uint8)[np.searchsorted(1 << np.array(sorted(BITS[2:].tolist())), np.arange(1 << 17), "right")]
_PAD = 60  # columns of zeros after a block, where its last word may reach


def pack(ids: np.ndarray, block: int = BLOCK) -> bytes:
    blocks, wide = -(-len(ids) // block), block + _PAD
    grid = np.zeros((blocks, wide), np.uint64)
    size = np.minimum(block, len(ids) - np.arange(blocks) * block)
    whole = len(ids) // block
    grid[:whole, :block] = ids[: whole * block].reshape(whole, block)
    if whole < blocks:
        grid[whole, : size[-1]] = ids[whole * block :]
    need = bit_lengths(grid)
    # selectors of longer runs have narrower ids, so of those that fit at a place the lowest number is the longest
    best = np.full((blocks, wide), 15, np.uint8)
    widest = need.copy()
    for n in range(2, _PAD + 1):
        np.maximum(widest[:, : wide - n + 1], need[:, n - 1 :], out=widest[:, : wide - n + 1])
        found = np.flatnonzero(COUNTS == n)
        if len(found):
            best -= widest <= BITS[found[0]]
    best[need > 60] = ESCAPE
    jump = COUNTS.copy()
    jump[ESCAPE] = 1
    best, flat = best.ravel(), grid.ravel()
    begun = np.zeros(len(best), bool)
    live = np.arange(blocks) * wide
    stop = live + size
    while len(live):
        begun[live] = True
        live = live + jump[best[live]]
        going = live < stop
        if not going.all():
            live, stop = live[going], stop[going]
    place_of = np.flatnonzero(begun)
    selector = best[place_of]
    place = np.concatenate([[0], np.cumsum(1 + (selector == ESCAPE))])
    words = np.zeros(place[-1], np.uint64)
    for s in range(1, 16):
        of = np.flatnonzero(selector == s)
        if len(of) and s == ESCAPE:
            words[place[of]] = U(s << 60)
            words[place[of] + 1] = flat[place_of[of]]
        elif len(of):
            value, at = np.full(len(of), U(s << 60)), place_of[of]
            for j in range(COUNTS[s]):
                value |= flat[at + j] << U(j * BITS[s])
            words[place[of]] = value
    offsets = place[np.searchsorted(place_of, np.arange(blocks + 1) * wide)]
    return _HEAD.pack(b"S8B1", block, len(ids), blocks) + offsets.astype("<u4").tobytes() + words.astype("<u8").tobytes()


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of the blocks first..last-1, all blocks by default."""
    magic, block, total, blocks = _HEAD.unpack_from(payload)
    if magic != b"S8B1":
        raise ValueError("not a Simple-8b payload")
    last = blocks if last is None else min(last, blocks)
    first = min(first, last)
    offsets = np.frombuffer(payload, "<u4", blocks + 1, _HEAD.size).astype(np.int64)
    words = np.frombuffer(payload, "<u8", offsets[last] - offsets[first], _HEAD.size + 4 * (blocks + 1) + 8 * int(offsets[first])).astype(np.uint64)
    offsets = offsets[first : last + 1] - offsets[first]
    selector = (words >> U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    # a raw word may look like an escape: a word is raw when an odd run of escape-like words, cut at block starts, ends before it
    like = selector == ESCAPE
    if like.any():
        position = np.arange(len(words))
        cut = ~np.concatenate([[False], like[:-1]])
        cut[offsets[:-1][offsets[:-1] < len(words)]] = True
        begun = np.maximum.accumulate(np.where(cut, position, 0))
        raw = (position - begun) % 2 == 1
    of_block = np.searchsorted(offsets, np.arange(len(words)), "right") - 1
    count = np.where(raw, 1, COUNTS[selector])
    count[like & ~raw] = 0
    size = np.minimum(block, total - (first + np.arange(last - first)) * block)
    ends = np.cumsum(count)
    before = np.concatenate([[0], ends])[offsets[:-1]]
    room = size[of_block] - (ends - count - before[of_block])
    count = np.minimum(count, room)
    place = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(place[-1], np.uint64)
    out[place[:-1][raw]] = words[raw]
    for s in range(2, 16):
        of = np.flatnonzero((selector == s) & ~raw)
        for j in range(COUNTS[s]):
            of = of[count[of] > j] if j else of
            out[place[of] + j] = (words[of] >> U(j * BITS[s])) & ((U(1) << U(BITS[s])) - U(1))
    return out


class WordEncoder:
    """Encodes texts of one tokenizer file.

    If the tokenizer drops white space and never joins what stands on either side of it, each
    distinct word between white space is encoded once and its ids are looked up afterwards; else
    whole texts are encoded. If, besides, it splits words by the pattern `SPLIT` and ends each
    piece with a token of its own, a new word is made up of its pieces, and each distinct piece
    is encoded once, many in one call.
    """

    LIMIT, MOST_PIECES = 1_000_000, 200_000  # entries of the tables, about 0.1 GB a worker
    # Fixed value: the splitting pattern of the tokenizer file for which pieces are known.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Words of plain Latin letters, digits and signs: lower-casing and composing can't change how they split.
    PLAIN = regex.compile(r"[!-&(-;=-~\u00A1-\u012F\u0131-\u0148\u014A-\u024F]+")

    PLAIN_ASCII = bytes(b for b in range(0x21, 0x7F) if b not in b"'<")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            parts = json.load(f)
        before = parts.get("pre_tokenizer") or {}
        split = (before.get("pretokenizers") or [before])[0]
        pattern = (split.get("pattern") or {}).get("Regex", "") if split.get("type") == "Split" else ""
        kinds = {x.get("type") for x in (parts.get("normalizer") or {}).get("normalizers", [])}
        self.by_word = split.get("invert") is True and split.get("behavior") == "Removed" and r"[^\s" in pattern and " " not in pattern and kinds <= {"NFC", "Replace", "Lowercase"}
        suffix = parts["model"].get("end_of_word_suffix")
        self.by_piece = self.by_word and pattern == self.SPLIT and "Lowercase" in kinds and bool(suffix)
        if self.by_piece:
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
            self.pieces_of = regex.compile(self.SPLIT).findall
            self.ascii_pieces = re.compile("[a-z]+|[0-9]|[^a-z0-9]+").findall  # the same for plain ASCII, faster
        self.reset()

    def reset(self) -> None:
        self.known, self.n = WordTable(), 0
        self.flat, self.at = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.text, self.text_at = np.zeros(1 << 19, np.uint8), np.zeros(1 << 16, np.int64)  # the known words themselves
        self.odd: dict[bytes, int] = {}  # words whose table keys another word has
        self.pieces: dict[str, bytes] = {}

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, np.uint32).tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encoded(self, new: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes."""
        words = [w.decode() for w in new]
        if not self.by_piece or not words:
            return self._whole(words)
        plain = self.PLAIN.fullmatch
        split = [self.ascii_pieces(w.lower()) if not b.translate(None, self.PLAIN_ASCII) else self.pieces_of(w.lower()) if plain(w) else None for b, w in zip(new, words)]
        others = iter(self._whole([w for w, x in zip(words, split) if x is None]))
        if len(self.pieces) > self.MOST_PIECES:
            self.pieces = {}
        known = self.pieces
        fresh = list({p for x in split if x for p in x} - known.keys())
        for s in range(0, len(fresh), 1000):
            part = fresh[s : s + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.last[ids]) + 1
            if len(cut) == len(part):
                raw = ids.tobytes()
                known.update(zip(part, (raw[4 * a : 4 * b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist()))))
            else:
                known.update(zip(part, self._whole(part)))
        return [next(others) if x is None else known[x[0]] if len(x) == 1 else b"".join([known[p] for p in x]) for x in split]

    def _learn(self, new: list[bytes]) -> None:
        """Gives the words the next numbers."""
        lists = self._encoded(new)
        self.flat, self.at = self._appended(self.flat, self.at, lists, np.uint32)
        self.text, self.text_at = self._appended(self.text, self.text_at, new, np.uint8)
        self.n += len(new)

    def _appended(self, flat: np.ndarray, at: np.ndarray, lists: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
        n, base = self.n, int(at[self.n])
        ends = base + np.cumsum([len(x) for x in lists]) // kind().itemsize
        while len(at) <= n + len(lists):
            at = np.concatenate([at, np.zeros_like(at)])
        while len(flat) < ends[-1]:
            flat = np.concatenate([flat, np.zeros_like(flat)])
        at[n + 1 : n + 1 + len(lists)] = ends
        flat[base : ends[-1]] = np.frombuffer(b"".join(lists), kind)
        return flat, at

    def _other(self, words: Words, numbers: np.ndarray) -> np.ndarray:
        """The words that differ, in size or in any byte, from the known word of their number."""
        start, size = words.start, words.end - words.start
        at = self.text_at[numbers]
        other = self.text_at[numbers + 1] - at != size
        live, done = np.flatnonzero(~other), 0
        while len(live):
            other[live] = eights(words.data, start[live] + done, size[live] - done) != eights(self.text, at[live] + done, size[live] - done)
            done += 8
            live = live[(size[live] > done) & ~other[live]]
        return np.flatnonzero(other)

    def encode(self, data: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts (their bytes and bounds) with `end` after each text, and the number of ids of each text."""
        raw = data.tobytes()
        if not self.by_word:
            found = [np.array([*x.ids, end], np.uint32) for x in self.tokenizer.encode_batch([raw[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], add_special_tokens=False)]
            return np.concatenate(found), np.array([len(x) for x in found])
        if self.n > self.LIMIT:
            self.reset()
        words = Words(data, at, SPACED)
        h, second = words.hashes(BYTE_EXACT), marks(words)
        numbers = self.known.find(h, second)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            pairs = np.empty(len(missing), "u8,u8")
            pairs["f0"], pairs["f1"] = h[missing], second[missing]
            order = np.lexsort((pairs["f1"], pairs["f0"]))
            pairs = pairs[order]
            first = np.ones(len(pairs), bool)
            first[1:] = pairs[1:] != pairs[:-1]
            rank = np.cumsum(first) - 1
            chosen = missing[order][first]
            fresh = np.arange(self.n, self.n + len(chosen), dtype=np.int32)
            self._learn([raw[a:b] for a, b in zip(words.start[chosen].tolist(), words.end[chosen].tolist())])
            self.known.add(h[chosen], second[chosen], fresh)
            numbers[missing[order]] = fresh[rank]
        for i in self._other(words, numbers).tolist():
            word = raw[words.start[i] : words.end[i]]
            if word not in self.odd:
                self.odd[word] = self.n
                self._learn([word])
            numbers[i] = self.odd[word]
        begin, length = self.at[numbers], self.at[numbers + 1] - self.at[numbers]
        ends = np.cumsum(length)
        counts = np.diff(np.concatenate([[0], ends])[words.first]) + 1
        owner = np.repeat(np.arange(len(counts)), words.counts)
        out = np.empty(int(counts.sum()), np.uint32)
        out[np.cumsum(counts) - 1] = end
        total = int(ends[-1]) if len(ends) else 0
        # ids lie one place further for every text before theirs
        shift = np.repeat(begin - (ends - length), length)
        place = np.arange(total)
        out[place + np.repeat(owner, length)] = self.flat[place + shift]
        return out, counts


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


_SEGMENT = "part int, seg int, before bigint, doc_ids array<bigint>, doc_sizes array<bigint>, payload binary"


def _write(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = encoder(path), TaskContext.get().partitionId()
        collects = gc.isenabled()
        gc.disable()  # millions of small objects without cycles: collections would only walk them again and again
        try:
            yield from segments(known, part, batches)
        finally:
            if collects:
                gc.enable()

    def segments(known: WordEncoder, part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = before = 0
        names: list = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def segment():
            nonlocal seg, before, names, counts, ids
            sizes, flat = np.concatenate(counts), np.concatenate(ids)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([before], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([pack(flat)], pa.binary())],
                names=["part", "seg", "before", "doc_ids", "doc_sizes", "payload"],
            )
            seg, before, names, counts, ids = seg + 1, before + len(flat), [], [], []
            return row

        for whole in batches:
            for batch in slices(whole, "text"):
                data, at = text_bytes(batch.column(batch.schema.get_field_index("text")))
                flat, sizes = known.encode(data, at, end)
                names += batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
                counts.append(sizes)
                ids.append(flat)
                if sum(map(len, ids)) >= SEGMENT_IDS or len(names) >= SEGMENT_TEXTS:
                    yield segment()
        if names:
            yield segment()

    return run


def in_file_order(docs: DataFrame) -> DataFrame:
    """docs of stored files, dealt by part number, file and row in it: readers may take files in another order."""
    file, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    placed = docs.select("*", file.alias("_file"), row.alias("_row")).withColumn("_part", F.coalesce(F.regexp_extract("_file", "part-([0-9]+)", 1).try_cast("bigint"), F.lit(-1)))
    return placed.repartitionByRange("_part", "_file", "_row").sortWithinPartitions("_part", "_file", "_row")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = 1, ordered: bool = True, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write the shards of docs into a new folder; by ascending id (ties by text, null ids first), or else docs as they stand in their files, or in docs' own order if they come from none."""
    rows = small_batches(docs)
    if not ordered and not {"_metadata", "_file", "_row", "_part"} & set(docs.columns) and docs.inputFiles():
        try:
            rows = in_file_order(rows)
        except AnalysisException:  # a plan on top of files, which hides their rows' places
            pass
    rows = rows.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    if ordered:
        rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(trimmed(_write(tokenizer, end)), _SEGMENT).write.parquet(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["payload"]).astype("<u4")
            stops = np.cumsum(row["doc_sizes"])
            start = row["base"] + row["before"] + np.concatenate([[0], stops[:-1]])
            crc = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(stops.tolist(), row["doc_sizes"])]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start, pa.int64()), pa.array(row["doc_sizes"], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files. Only one total a part reaches the driver."""
    segments = spark.read.schema(_SEGMENT).parquet(folder)
    totals = segments.select("part", F.aggregate("doc_sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n")).collect()
    bases, total = [], 0
    for part, n in sorted(totals):
        bases.append((part, total))
        total += n
    base = spark.createDataFrame(bases, "part int, base bigint")  # a row for each part
    return segments.join(F.broadcast(base), "part").mapInArrow(trimmed(_read), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_token_output(docs: DataFrame, tokenizer: str | None = None, end: int = 1, ordered: bool = True) -> DataFrame:
    """Write docs as shards in the shared folder and read their digests back.

    A null or empty text is its end id alone; a text of any length is encoded as a whole. Rows
    with equal doc_ids each count, ordered by text; a null doc_id sorts first. Other columns are
    ignored; an empty table gives no rows.
    """
    folder = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, folder, tokenizer or word_tokenizer(), end, ordered)
    return read_digests(docs.sparkSession, folder)
