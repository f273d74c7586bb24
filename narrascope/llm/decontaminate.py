"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items become one suffix automaton over words. Every document streams its
words through it; the automaton's state and length give the longest item passage that ends at
each word. A word is hit when it lies in an occurrence of a window: `window` consecutive item
words, or a whole item that has fewer. Passages that no run of item word pairs could contain are
skipped before the walk by their hashes, which changes no result: the walk itself compares words.

Items are taken in blocks of at most `BLOCK_WORDS` words, each with its own automaton and its own
pass, so neither the driver nor a broadcast grows with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.llm.shared import saved, small_batches
from narrascope.llm.textkernel import ALPHANUMERIC, Words, grams, hash_word_list, slices, text_bytes, trimmed

BLOCK_WORDS = 200_000
_FILTER_BITS = 22


class SuffixAutomaton:
    """Of some items (id or None, words); `found[state]` lists (window length, item numbers), longest first."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.ids, self.window = [i for i, _ in items], window
        self.number: dict[bytes, int] = {}
        texts = [words for _, words in items]
        hashes = np.split(hash_word_list([w for words in texts for w in words]), np.cumsum([len(words) for words in texts])[:-1]) if texts else []
        items = [(i, [self.number.setdefault(w, len(self.number)) for w in words]) for i, words in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        own: list[dict[int, set[int]]] = [{} for _ in self.link]
        self.shortest, pairs = window, []
        for number, ((_, words), h) in enumerate(zip(items, hashes)):
            size = min(window, len(words))
            self.shortest = min(self.shortest, size) if size else self.shortest
            state = 0
            for at, w in enumerate(words, 1):
                state = self.next[state][w]
                if at >= size:
                    v = state
                    while self.length[self.link[v]] >= size:
                        v = self.link[v]
                    own[v].setdefault(size, set()).add(number)
            pairs.append(grams(h, 2) if self.shortest > 1 else h)
        if self.shortest == 1:
            pairs = hashes
        self.found: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in self.link]
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.found[v] = sorted(((k, tuple(sorted(x))) for k, x in own[v].items()), reverse=True) + self.found[self.link[v]]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        if pairs:
            self.filter[(np.concatenate(pairs) & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def _extend(self, last: int, w: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        if w in nexts[last]:
            q = nexts[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and w not in nexts[p]:
            nexts[p][w] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def runs(self, words: Words) -> Iterator[tuple[int, int, list[int]]]:
        """(text, first word, numbers of the words, -1 for those of no item) of the passages that may hold a window."""
        h = words.hashes()
        pair = self.shortest > 1
        likely = self.filter[((grams(h, 2) if pair else h) & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)]
        if not len(likely):
            return
        edges = words.first[1:-1]
        edges = edges[(edges > 0) & (edges < len(h))]
        if pair:
            likely[edges - 1] = False
        flips = np.diff(likely.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(flips > 0), np.flatnonzero(flips < 0) + pair
        if not pair and len(edges):  # runs of single words may span texts
            cut = np.unique(edges)
            begin, end = np.unique(np.concatenate([begin, cut[likely[cut] & likely[cut - 1]]])), np.unique(np.concatenate([end, cut[likely[cut] & likely[cut - 1]]]))
        good = end - begin >= self.shortest
        begin, end = begin[good], end[good]
        text = np.searchsorted(words.first, begin, "right") - 1
        known = self.number.get
        for d, a, b in zip(text.tolist(), begin.tolist(), end.tolist()):
            yield d, a, [known(w, -1) for w in words.lowered(a, b)]

    def matches(self, words: Words) -> dict[int, tuple[list[list[int]], set[int], int, list[tuple[int, int]]]]:
        """Of each text with a window: its merged hit word ranges, the items with windows in it, its longest match, and the places of whole items shorter than a window."""
        out: dict[int, tuple[list[list[int]], set[int], int, list[tuple[int, int]]]] = {}
        nexts, link, length, found = self.next, self.link, self.length, self.found
        for d, a, passage in self.runs(words):
            state = size = longest = 0
            base = a - int(words.first[d])
            spans: list[list[int]] = []
            items: set[int] = set()
            short: list[tuple[int, int]] = []
            for i, w in enumerate(passage, base + 1):
                while state and w not in nexts[state]:
                    state = link[state]
                    size = length[state]
                if w in nexts[state]:
                    state, size = nexts[state][w], size + 1
                longest = max(longest, size)
                top = 0
                for k, numbers in found[state]:
                    if k <= size:
                        top = max(top, k)
                        items.update(numbers)
                        if k < self.window:
                            short.append((i - k, i))
                if top:
                    if spans and spans[-1][1] >= i - top:
                        spans[-1][0], spans[-1][1] = min(spans[-1][0], i - top), i
                    else:
                        spans.append([i - top, i])
            if spans:
                old = out.get(d, ([], set(), 0, []))
                out[d] = (merged(old[0] + spans), old[1] | items, max(old[2], longest), old[3] + short)
        return out


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def item_blocks(items: DataFrame, window: int, id_column: str, text_column: str) -> Iterator[SuffixAutomaton]:
    block, size = [], 0
    for name, text in items.select(F.col(id_column).cast("string"), text_column).where(F.col(text_column).isNotNull()).toLocalIterator():
        raw = np.frombuffer(text.encode(), np.uint8)
        split = Words(raw, np.array([0, len(raw)]), ALPHANUMERIC)
        words = split.lowered(0, len(split))
        if words:
            if block and size + len(words) > BLOCK_WORDS:
                yield SuffixAutomaton(block, window)
                block, size = [], 0
            block.append((name, words))
            size += len(words)
    yield SuffixAutomaton(block, window)


_SEEN = "n_words bigint, n_hit bigint, longest int, spans array<int>, items array<string>"


def _scan(automaton, text_column: str, again: bool, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton.value
        for whole in batches:
            for batch in slices(whole, text_column):
                data, at = text_bytes(batch.column(batch.schema.get_field_index(text_column)))
                words = Words(data, at, ALPHANUMERIC)
                hits = found.matches(words)
                n = batch.num_rows
                spans, items, longest = [[]] * n, [[]] * n, [0] * n
                if again:
                    spans, items, longest = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("spans", "items", "longest"))
                for d, (s, numbers, size, _) in hits.items():
                    old = list(zip(spans[d][::2], spans[d][1::2]))
                    spans[d] = [x for pair in merged([list(p) for p in old] + s) for x in pair]
                    items[d] = sorted({*items[d], *(found.ids[x] for x in numbers if found.ids[x] is not None)})
                    longest[d] = max(longest[d], size)
                n_hit = [sum(x[1::2]) - sum(x[::2]) for x in spans]
                first = batch.schema.names if not again else batch.schema.names[:-5]
                kept = [c for c in first if with_text or c != text_column]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(first.index(c)) for c in kept] + [pa.array(words.counts.astype(np.int64)), pa.array(n_hit, pa.int64()), pa.array(longest, pa.int32()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                    names=[*kept, "n_words", "n_hit", "longest", "spans", "items"],
                )

    return run


def _ddl(df: DataFrame, leave_out: str | None = None) -> str:
    return "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in df.schema if f.name != leave_out)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_hit, longest, spans (word ranges, flattened) and items of every row of docs.

    A null or empty text has no words; a null item text has no windows; the windows of an item
    with a null id hit words, but the item is not listed. Repeated items count once per distinct
    id, repeated documents once per row. A text of any length is read whole, in a few passes over
    its bytes. Other columns of docs are ignored, so their names don't matter; an empty table on
    either side works.
    """
    seen = small_batches(docs).select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    blocks = item_blocks(items, window, item_column, "text")
    automaton, again = next(blocks), False
    while True:
        following = next(blocks, None)
        shipped = docs.sparkSession.sparkContext.broadcast(automaton)
        base = seen.drop("n_words", "n_hit", "longest", "spans", "items") if again else seen
        seen = seen.mapInArrow(trimmed(_scan(shipped, "text", again, following is not None)), _ddl(base, None if following is not None else "text") + _SEEN)
        if following is None:
            return seen
        automaton, again, seen = following, True, saved(seen, "contamination")


def _remove(automaton, text_column: str, length_column: str | None, span_limit: int, coverage_limit: float, again: bool, last: bool):
    """Adds this block's hits to those of the blocks before, which lie in two more columns at the end; after the last block, decides and cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton.value
        pairs = lambda flat: list(zip(flat[::2], flat[1::2]))
        for whole in batches:
            for batch in slices(whole, text_column):
                column = batch.schema.get_field_index(text_column)
                data, at = text_bytes(batch.column(column))
                words = Words(data, at, ALPHANUMERIC)
                hits = {d: (spans, set(short)) for d, (spans, _, _, short) in found.matches(words).items()}
                if again:
                    old_spans, old_short = (c.to_pylist() for c in batch.columns[-2:])
                    batch = batch.select(list(range(batch.num_columns - 2)))
                    for d in range(batch.num_rows):
                        if old_spans[d]:
                            spans, short = hits.get(d, ([], set()))
                            hits[d] = merged([list(p) for p in pairs(old_spans[d])] + spans), short | set(pairs(old_short[d]))
                if not last:
                    flat = [[[x for pair in values for x in pair] for values in (hits[d][k] if d in hits else () for d in range(batch.num_rows))] for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f, pa.list_(pa.int32())) for f in flat)], names=[*batch.schema.names, *_hit_columns(batch.schema.names)])
                    continue
                if hits:
                    keep = np.ones(batch.num_rows, bool)
                    texts = batch.column(column).to_pylist()
                    for d, (spans, short) in hits.items():
                        covered = sum(e - s for s, e in spans)
                        if covered > coverage_limit * words.counts[d]:
                            keep[d] = False
                            continue
                        raw, base, left, out = texts[d].encode(), int(at[d]), 0, []
                        for s, e in spans:
                            if e - s >= span_limit or any(s <= a and b <= e for a, b in short):
                                i, j = int(words.start[words.first[d] + s]) - base, int(words.end[words.first[d] + e - 1]) - base
                                out.append(raw[left:i])
                                left = j
                        texts[d] = b"".join([*out, raw[left:]]).decode()
                    arrays = list(batch.columns)
                    arrays[column] = pa.array(texts, batch.schema.field(column).type)
                    if length_column is not None:
                        where = batch.schema.get_field_index(length_column)
                        sizes = batch.column(where).to_pylist()
                        for d in hits:
                            sizes[d] = len(texts[d])
                        arrays[where] = pa.array(sizes, batch.schema.field(where).type)
                    batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema).filter(pa.array(keep))
                yield batch

    return run


def _hit_columns(names: list[str]) -> list[str]:
    """Names of the columns of hit ranges and of short items' places that no column has."""
    more = "_" * (1 + max((len(n) for n in names), default=0))
    return [f"{more}spans", f"{more}short"]


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = 10, span_limit: int = 10, coverage_limit: float = 0.5, text_column: str = "text", length_column: str | None = None, item_column: str = "item_id") -> DataFrame:
    """docs with the same columns, without contaminated passages.

    A hit range of `span_limit` words or more, or one that holds a whole shorter item, is cut out
    of its text (and `length_column`, if named, is set to the new length); a document of which
    more than `coverage_limit` of the words are hit goes as a whole. All other rows stay as they
    are, null and empty texts included; repeated rows, and rows with null ids, are treated alike;
    a very long text is cut like any other. The hits of all blocks of items are gathered first,
    so the number of blocks changes no result. An empty table on either side works.
    """
    docs = small_batches(docs)
    length = length_column if length_column in docs.columns else None
    seen, again = docs, False
    blocks = item_blocks(items, window, item_column, "text")
    automaton = next(blocks)
    while True:
        following = next(blocks, None)
        last = following is None
        shipped = docs.sparkSession.sparkContext.broadcast(automaton)
        ddl = _ddl(docs) + ", ".join(f"{c} array<int>" for c in _hit_columns(docs.columns))
        seen = seen.mapInArrow(trimmed(_remove(shipped, text_column, length, span_limit, coverage_limit, again, last)), docs.schema if last else ddl)
        if last:
            return seen
        automaton, again, seen = following, True, saved(seen, "decontaminated")


def op1_contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    seen = contamination(docs, items)
    return seen.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


ORACLE = r"""
WITH words AS (SELECT doc_id, hash(doc_id, text) AS row, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM wins),
grams AS (SELECT doc_id, row, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM words, sizes WHERE len(w) >= k)),
hits AS (SELECT DISTINCT doc_id, row, i, grams.k, item FROM grams JOIN wins ON grams.k = wins.k AND grams.g = wins.g),
covered AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + k)) AS p FROM hits) GROUP BY row),
named AS (SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT row, item FROM hits WHERE item IS NOT NULL) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(d.n, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM words LEFT JOIN covered c USING (row) LEFT JOIN named d USING (row)
"""
