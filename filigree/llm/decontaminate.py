"""Benchmark decontamination by suffix arrays over the training texts.

Each worker joins documents into shards of SHARD_BYTES, turns words into numbers, sorts the shard's suffixes
by their first words (rank doubling in numpy), and binary-searches every suffix of the benchmark items in it.
Only suffixes that begin with a benchmark word are kept in the array; no other can match. Matches that follow one
another are joined to longest verbatim matches and reported with their places.

The benchmark is sent to the workers in blocks of at most BLOCK_WORDS words, so what is sent has a bound whatever the
table holds. The scans of the blocks follow one another on the same rows.

Null and empty texts have no words and match nothing. Items with fewer words than a window are one window, items
without words none. Every row is answered on its own, those with a repeated or null doc_id too. Repeated items are
reported each, items with a null item_id under null. Empty tables give no rows, or no matches. Further columns, whatever
their names, are not looked at; decontaminate() returns them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, in_blocks, utf8, written

WINDOW = 10
#: Benchmark words sent to the workers at a time: some 50 MB with their numbers.
BLOCK_WORDS = 2_000_000
SHARD_BYTES = 1 << 20

#: Bytes as they count in words: A-Z lower-cased, all that separates words as a space.
_FOLD = bytes(x if x >= 0x80 or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A else x + 32 if 0x41 <= x <= 0x5A else 32 for x in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions whose number is not 0, sorted by their first words, at least depth of them (0 sorts first)."""
    places = np.flatnonzero(ids)
    rank = ids.astype(np.int64)
    order = np.argsort(rank[places], kind="stable")
    length = 1
    while length < depth and len(places):
        ahead = np.zeros(len(rank), np.int64)
        ahead[: max(0, len(rank) - length)] = rank[length:]
        key = rank[places] << np.int64(32) | ahead[places]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[1], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)])
        rank = np.zeros_like(rank)
        rank[places[order]] = np.cumsum(fresh)
        length *= 2
    return places[order]


def search(ids: np.ndarray, order: np.ndarray, queries: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of the suffix array of the suffixes that begin with each query (rows of numbers, sizes of them used)."""
    width = queries.shape[1]
    padded = np.concatenate([ids, np.zeros(width, ids.dtype)])
    out = []
    for upper in (False, True):
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(order), np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            own = padded[order[np.minimum(middle, len(order) - 1)][:, None] + np.arange(width)[None, :]]
            differs = (own != queries) & (np.arange(width)[None, :] < sizes[:, None])
            at = differs.argmax(1)
            line = np.arange(len(queries))
            same = ~differs[line, at]
            less = ~same & (own[line, at] < queries[line, at]) | same & upper
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        out.append(low)
    return out[0], out[1]


def item_windows(items: list[tuple[int, str]], width: int) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the items' words, and the distinct windows: their numbers (0: unused), sizes and items as rows (window, item)."""
    number: dict[bytes, int] = {}
    found: dict[tuple, set[int]] = {}
    for k, (_, text) in enumerate(items):
        own = [number.setdefault(w, len(number) + 1) for w in words((text or "").encode())]
        for a in range(max(1, len(own) - width + 1) if own else 0):
            found.setdefault(tuple(own[a : a + width]), set()).add(k)
    windows = np.zeros((len(found), width), np.int64)
    sizes = np.zeros(len(found), np.int64)
    for r, w in enumerate(found):
        windows[r, : len(w)], sizes[r] = w, len(w)
    owners = np.array([(r, k) for r, ks in enumerate(found.values()) for k in sorted(ks)], np.int64).reshape(-1, 2)
    return number, windows, sizes, owners


class Items:
    """What a worker needs of a block of items: numbers of their words, windows, and the item_ids."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int):
        self.number, self.windows, self.sizes, self.owners = item_windows(items, width)
        self.owner_at = np.searchsorted(self.owners[:, 0], np.arange(len(self.windows) + 1))
        self.ids, self.width = pa.array([x[0] for x in items], pa.int64()), width

    def matches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words of each text, and the longest matches as rows (text, item, first word, word after the last)."""
        data, offsets = utf8(texts)
        raw, get = data.tobytes(), self.number.get
        parts, counts = [np.zeros(0, np.int64)], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = [get(w, 0) for w in words(raw[a:b])]
            counts.append(len(own))
            own.append(0)  # no match crosses documents
            parts.append(np.array(own, np.int64))
        ids, counts = np.concatenate(parts), np.array(counts, np.int64)
        first = np.concatenate([[0], np.cumsum(counts + 1)])
        order = suffix_array(ids, self.width)
        found = [np.zeros((0, 4), np.int64)]
        if len(self.windows) and len(order):
            low, high = search(ids, order, self.windows, self.sizes)
            for q in np.flatnonzero(high > low).tolist():
                starts = order[low[q] : high[q]]
                for k in self.owners[self.owner_at[q] : self.owner_at[q + 1], 1].tolist():
                    found.append(np.stack([np.searchsorted(first, starts, "right") - 1, np.full(len(starts), k), starts, starts + self.sizes[q]], 1))
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        if len(rows):  # joins windows of one item that overlap or touch
            group = rows[:, 0] * (len(self.ids) + 1) + rows[:, 1]
            far = np.concatenate([[True], (group[1:] != group[:-1]) | (rows[1:, 2] > rows[:-1, 3])])
            begin = np.flatnonzero(far)
            rows = np.concatenate([rows[begin, :3], np.maximum.reduceat(rows[:, 3], begin)[:, None]], 1)
            rows[:, 2:] -= first[rows[:, 0]][:, None]
        return counts, rows


_SPAN = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_MATCHES = "doc_id long, n_words long, matches array<struct<item_id:long,start:long,end:long>>"


def scan(rows: DataFrame, items: list[tuple[int | None, str | None]], width: int, more: bool) -> DataFrame:
    """Rows (doc_id, text, and matches where a scan went before) with their n_words and matches of the items added, and
    with the text if more scans follow."""
    shared = rows.sparkSession.sparkContext.broadcast(Items(items, width))
    again = "matches" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for block in in_blocks(batches, limit=SHARD_BYTES):
            counts, found = own.matches(block.column("text"))
            at = np.searchsorted(found[:, 0], np.arange(block.num_rows + 1))
            spans = pa.StructArray.from_arrays([own.ids.take(pa.array(found[:, 1])), pa.array(found[:, 2]), pa.array(found[:, 3])], ["item_id", "start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spans)
            if again:
                lists = pa.array([x + y for x, y in zip(block.column("matches").to_pylist(), lists.to_pylist(), strict=True)], pa.list_(_SPAN))
            texts = [block.column("text")] if more else []
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(counts), lists, *texts], ["doc_id", "n_words", "matches", "text"][: 3 + more])

    return arrow_map(rows, run, _MATCHES + ", text string" * more)


#: Scans that are chained in one stage before their rows are written.
CHAINED = 3


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in ascending order, streamed to the driver a partition at a time, in blocks of bounded size."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").orderBy("item_id").toLocalIterator():
        n = len(words((r.text or "").encode()))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += n
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, and matches (item_id, start, end in words) against the whole benchmark."""
    rows, blocks, n = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), item_blocks(benchmark), 0
    block = next(blocks, [])
    while block is not None:
        following = next(blocks, None)
        rows, n = scan(rows, block, width, following is not None), n + 1
        if following is not None and n % CHAINED == 0:
            rows = written(rows, "scanned")
        block = following
    return rows


def covered(spans):
    """How many words the matches of a document cover together."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("a"), x["end"].alias("b"))))
    step = lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], x["b"]).alias("to"))
    return F.aggregate(ordered, start, step, lambda s: s["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of docs without any match, with all their columns. Each row is judged by its own text."""
    for block in item_blocks(benchmark):
        docs = _without_matches(docs, block, width)
    return docs


def _without_matches(docs: DataFrame, items: list[tuple[int | None, str | None]], width: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Items(items, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in in_blocks(batches, limit=SHARD_BYTES):
            _, found = shared.value.matches(block.column("text"))
            keep = np.ones(block.num_rows, bool)
            keep[found[:, 0]] = False
            yield block.filter(pa.array(keep))

    return arrow_map(docs, run, docs.schema)


__all__ = ["covered", "decontaminate", "matches", "suffix_array"]
