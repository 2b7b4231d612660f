"""Removal of repeated passages, by a run-length index of the repetitive parts of a corpus.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier: in a document of smaller doc_id, or
earlier in the same one.

1. Every window of LENGTH bytes has an anchor: its least hash of GRAM bytes. Neighbouring windows with the same
   anchor at the same place make a segment, so no window occurs twice in a segment. Equal windows have equal anchors, so only segments of one anchor can share a window.
2. Segments meet by anchor. Equal segments are one string of the index: all but the first, in each worker's block of
   texts before they are moved and then across workers, repeat earlier text. An anchor with a single segment is done.
3. The distinct segments of all anchors with several segments, equal or not, are the repetitive part of the corpus. They
   are indexed in bundles of whole anchors: suffixes are sorted, the Burrows-Wheeler transform is run-compressed, and for the head of each
   run its place, the place before it in suffix order and their common length are sampled. From these samples alone
   the common length of every place with its neighbour is streamed over the text; lengths of at least LENGTH join
   places into groups, and all but the earliest of a group are marked.
   An anchor with very many distinct segments (around a passage that many documents share in contexts of their own) is
   no single bundle: its segments are cut again by the anchors of another hash family, and again, and settled in between.
4. Marks of a document are joined with its text. Documents that a Bloom filter shows to have none are not moved.

Null and empty texts, and texts shorter than LENGTH, lose nothing. Equal rows count as one document and are all returned.
Rows of one doc_id with different texts are different documents, which follow one another by a hash of their texts; so
are rows of null doc_id, which come before all others. An empty table gives no rows. Further columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, id_filter, in_blocks, maybe_in, numbers, utf8, written
from .textarrays import eights, mix, random_words, runs, word_hashes

LENGTH, GRAM = 100, 32
#: Bytes and segments that are indexed together.
BUNDLE_BYTES, BUNDLE_SEGMENTS = 1 << 19, 8_000
#: Distinct segments of one anchor from which on they get anchors of another family, and how many families there are.
HOT_SEGMENTS, FAMILIES = 20_000, 6
_BYTES = [random_words(21 + 100 * k, 256) for k in range(FAMILIES)]
_STEP = random_words(22, 5) | np.uint64(1)


def gram_hashes(data: np.ndarray, family: int = 0) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, by doubling (places near the end see zeros)."""
    h = _BYTES[family][data]
    width, k = 1, 0
    with np.errstate(over="ignore"):
        while width < GRAM:
            h = h * _STEP[k]
            h[:-width] += h[width:] >> np.uint64(7)
            h ^= h >> np.uint64(29)
            width, k = 2 * width, k + 1
        return h * _STEP[0]


def anchors(data: np.ndarray, length: int = LENGTH, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The least gram hash of the window from each place on, and whether it is that of the window's first gram."""
    grams = gram_hashes(data, family)
    low, width = grams.copy(), 1
    wanted = length - GRAM + 1
    while 2 * width <= wanted:
        low[:-width] = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = wanted - width
    if rest and len(low) > rest:
        low[:-rest] = np.minimum(low[:-rest], low[rest:])
    return low, low == grams


def segments(data: np.ndarray, offsets: np.ndarray, family: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start in it, number of windows, anchor and hash of each segment."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ends = offsets[1:][owner]
    place = np.arange(len(data))
    valid = place + LENGTH <= ends
    if not valid.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    low, leaves = anchors(data, family=family)
    starts, _, _ = runs(valid, offsets)
    fresh = np.zeros(len(data), bool)
    fresh[starts] = True
    fresh[1:] |= ((low[1:] != low[:-1]) | leaves[:-1]) & valid[1:]
    begin = np.flatnonzero(fresh)
    last = np.minimum(np.append(begin[1:], len(data)), ends[begin] - LENGTH + 1)
    n = last - begin
    text = owner[begin]
    return text, begin - offsets[text], n, low[begin].view(np.int64), word_hashes(data, begin, begin + n + LENGTH - 1).view(np.int64)


#: A bit of a segment's number of windows.
COPIED = 1 << 20
_ROW = "anchor long, segment long, doc_id long, start int, n int"


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    parts = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, parts, strict=True)], [n for n, _ in parts])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.col("text").cast("string"))


def segment_rows(docs: DataFrame) -> DataFrame:
    """All segments; n is negative where the block of texts holds an equal segment that starts earlier, and has COPIED where
    it holds such copies of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in in_blocks(batches, limit=1 << 20):
            text, start, n, anchor, segment = segments(*utf8(block.column("text")))
            doc = numbers(block.column("doc_id"))[text]
            order = np.lexsort((start, doc, segment, anchor))
            text, start, n, anchor, segment, doc = (x[order] for x in (text, start, n, anchor, segment, doc))
            again = np.zeros(len(n), bool)
            again[1:] = (anchor[1:] == anchor[:-1]) & (segment[1:] == segment[:-1])
            head = np.maximum.accumulate(np.where(again, 0, np.arange(len(n))))
            again &= (doc != doc[head]) | (start != start[head])
            n[np.unique(head[again])] |= COPIED
            # what is settled here goes on under a key of its own
            yield _batch(_ROW, np.where(again, doc * 31 + start, anchor), segment, doc, start, np.where(again, -(n & ~COPIED), n))

    return arrow_map(_texts(docs), run, _ROW)


_SETTLED = "anchor long, doc_id long, start int, n int, open boolean"


def settle(rows: DataFrame) -> DataFrame:
    """Of segments sorted by anchor, segment and place: those that repeat an earlier one (open is false), and the first of
    each distinct segment where its anchor has several, or copies of it (open). Memory does not grow with an anchor; the
    first one can come out more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("anchor", "segment", "doc_id", "start", "n")
        held = None  # of the last anchor: its first row, how many distinct segments, the first row of the last one
        for batch in batches:
            x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            done = x["n"] < 0
            if done.any():
                yield _batch(_SETTLED, x["anchor"][done], x["doc_id"][done], x["start"][done], -x["n"][done], np.zeros(int(done.sum()), bool))
                x = {c: v[~done] for c, v in x.items()}
            if not len(x["n"]):
                continue
            lead = 0
            if held is not None:
                lead = 2
                x = {c: np.concatenate([[held[0][k], held[2][k]], x[c]]).astype(x[c].dtype) for k, c in enumerate(names)}
            size = len(x["n"])
            new_anchor, new_segment = np.ones(size, bool), np.ones(size, bool)
            new_anchor[1:] = x["anchor"][1:] != x["anchor"][:-1]
            new_segment[1:] = new_anchor[1:] | (x["segment"][1:] != x["segment"][:-1])
            count = np.cumsum(new_segment)
            if lead:
                count[1:] += held[1] - count[1]
            anchor_head = np.maximum.accumulate(np.where(new_anchor, np.arange(size), 0))
            base = np.where(anchor_head > 0, count[anchor_head] - 1, 0)
            distinct = count - base
            head = np.maximum.accumulate(np.where(new_segment, np.arange(size), 0))
            own = np.arange(size) >= lead
            repeats = own & ~new_segment & ((x["doc_id"] != x["doc_id"][head]) | (x["start"] != x["start"][head]))
            opened = own & new_segment & (distinct >= 2)
            heads = anchor_head[own & new_segment & (distinct == 2)]
            copied = repeats & (distinct == 1) & ((np.arange(size) - anchor_head == 1) | (np.arange(size) == lead))
            heads = np.concatenate([heads, anchor_head[copied], np.flatnonzero(own & new_anchor & (x["n"] >= COPIED))])
            at = np.concatenate([np.flatnonzero(repeats), np.flatnonzero(opened), heads])
            yield _batch(_SETTLED, x["anchor"][at], x["doc_id"][at], x["start"][at], x["n"][at] & ~COPIED, np.arange(len(at)) >= repeats.sum())
            row = lambda k: tuple(x[c][k] for c in names)  # noqa: B023, E731
            held = (row(anchor_head[-1]), int(distinct[-1]), row(head[-1]))

    return arrow_map(rows, run, _SETTLED)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of symbols, by prefix doubling from four symbols on, or from two if they are many. Only suffixes
    that are not told apart yet are sorted again; a rank is the place of the first suffix that begins alike."""
    n = len(symbols)
    width = 4 if symbols.max() < (1 << 15) - 1 else 2
    padded = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(4, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = key << (64 // width) | padded[k : k + n]
    order, rank = np.argsort(key), np.empty(n, np.int64)
    at, key = np.arange(n), key[order]
    while True:  # key is that of the suffixes at those places of the order
        fresh = np.ones(len(at) + 1, bool)
        fresh[1:-1] = key[1:] != key[:-1]
        rank[order[at]] = at[np.maximum.accumulate(np.where(fresh[:-1], np.arange(len(at)), 0))]
        at = at[~(fresh[:-1] & fresh[1:])]
        if not len(at):
            return order
        own = order[at]
        ahead = np.minimum(own + width, n)
        key = rank[own] << 32 | np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        again = np.argsort(key)
        order[at], key = own[again], key[again]
        width *= 2


class RunIndex:
    """The run-compressed transform of some strings, with samples at the heads of its runs."""

    def __init__(self, strings: list[bytes]):
        joined = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        ends = np.cumsum([len(x) + 1 for x in strings]) - 1
        symbols = joined.astype(np.int64) + len(strings)
        symbols[ends] = np.arange(len(strings))  # all ends differ, so no match runs over one
        self.n, self.strings = len(symbols), len(strings)
        order = suffix_array(symbols)
        before = symbols[order - 1]
        heads = np.ones(self.n, bool)
        heads[1:] = before[1:] != before[:-1]
        at = np.flatnonzero(heads)
        self.letters, self.lengths = before[at], np.diff(np.append(at, self.n))
        places = order[at]
        previous = np.where(at > 0, order[at - 1], -1)
        left = np.repeat(ends, [len(x) + 1 for x in strings]) - np.arange(self.n)
        limit = np.where(previous >= 0, np.minimum(left[places], left[previous]), 0)
        common, live, width, eight = limit.copy(), np.flatnonzero(limit), 0, eights(joined)
        while len(live):  # common lengths, eight bytes at a time: the place of the lowest bit that differs
            differs = eight[places[live] + width] ^ eight[previous[live] + width]
            unlike = np.flatnonzero(differs)
            low = differs[unlike] & (~differs[unlike] + np.uint64(1))
            own = live[unlike]
            common[own] = np.minimum(limit[own], width + np.log2(low.astype(float)).astype(np.int64) // 8)
            width += 8
            live = live[(differs == 0) & (limit[live] > width)]
        by_place = np.argsort(places)
        self.places, self.previous, self.common = places[by_place], previous[by_place], common[by_place]

    def occurrences(self, pattern: bytes) -> int:
        """How often a pattern occurs, by backward search over the runs."""
        low, high = 0, self.n
        ends = np.cumsum(self.lengths)
        by_letter = np.lexsort((np.arange(len(self.letters)), self.letters))
        letters = self.letters[by_letter]
        before = np.cumsum(self.lengths[by_letter]) - self.lengths[by_letter]  # letters that sort before, and earlier ones alike
        for c in reversed(pattern):
            a, b = np.searchsorted(letters, [c + self.strings, c + self.strings + 1])
            if a == b:
                return 0
            runs_, base = by_letter[a:b], before[a]

            def rank(row: int) -> int:
                k = int(np.searchsorted(ends[runs_] - self.lengths[runs_], row))  # noqa: B023
                return int(base + (0 if k == 0 else before[a + k - 1] - base + min(self.lengths[runs_[k - 1]], row - (ends[runs_[k - 1]] - self.lengths[runs_[k - 1]]))))  # noqa: B023

            low, high = rank(low), rank(high)
            if low >= high:
                return 0
        return high - low

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every place the one before it in suffix order (-1: none) and their common length, from the samples."""
        every = np.arange(self.n)
        k = np.searchsorted(self.places, every, "right") - 1
        past = every - self.places[k]
        previous = np.where(self.previous[k] >= 0, self.previous[k] + past, -1)
        return previous, np.where(previous >= 0, np.maximum(self.common[k] - past, 0), 0)

    def repeats(self, length: int) -> np.ndarray:
        """Whether the string of that length at each place occurs at an earlier place."""
        previous, common = self.statistics()
        root = np.where(common >= length, previous, np.arange(self.n))
        while True:  # to the head of each group, by doubling
            further = root[root]
            if (further == root).all():
                break
            root = further
        first = np.arange(self.n)
        np.minimum.at(first, root, np.arange(self.n))
        return first[root] < np.arange(self.n)


def index_bundles(rows: DataFrame) -> DataFrame:
    """Marks (doc_id, start, n) of the windows of segments (sorted by anchor and place) that occur in an earlier one."""
    kind = "doc_id long, start int, n int"

    def solve(doc: np.ndarray, start: np.ndarray, strings: list[bytes]) -> pa.RecordBatch:
        again = RunIndex(strings).repeats(LENGTH)
        sizes = np.array([len(x) + 1 for x in strings])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        begin, stop, _ = runs(again, offsets)
        owner = np.searchsorted(offsets, begin, "right") - 1
        return _batch(kind, doc[owner], start[owner] + begin - offsets[owner], stop - begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, start, strings, size, last, place = [], [], [], 0, None, None
        for batch in batches:
            for a, d, s, x in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "start", "bytes")), strict=True):
                if (a, d, s) == place:  # a repeated row's segment is there once
                    continue
                place = a, d, s
                if a != last and (size > BUNDLE_BYTES or len(strings) > BUNDLE_SEGMENTS):
                    yield solve(np.array(doc), np.array(start), strings)
                    doc, start, strings, size = [], [], [], 0
                doc.append(d)
                start.append(s)
                strings.append(x)
                size += len(x)
                last = a
        if strings:
            yield solve(np.array(doc), np.array(start), strings)

    return arrow_map(rows, run, kind)


def segment_again(strings: DataFrame, family: int) -> DataFrame:
    """The segments (anchor, doc_id, start, bytes) cut by the anchors of another family. Equal windows have equal anchors in
    each family, so those of one anchor in all families so far still meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, at, n, anchor, segment = segments(*utf8(batch.column("bytes")), family)
            before, doc, start = (numbers(batch.column(c)) for c in ("anchor", "doc_id", "start"))
            with np.errstate(over="ignore"):
                both = mix(mix(before[which].view(np.uint64)) ^ anchor.view(np.uint64)).view(np.int64)
            yield _batch(_ROW, both, segment, doc[which], start[which] + at, n)

    return arrow_map(strings, run, _ROW)


def _moved(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs that may be among ids, and docs that are not."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def part(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = maybe_in(shared.value, batch.column("doc_id"))
                yield batch.filter(pa.array(found if inside else ~found))

        return arrow_map(_texts(docs), run, "doc_id long, text string")

    return part(True), part(False)


def cut_out(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """anchor, doc_id, start and bytes of segments (anchor, doc_id, start, n)."""
    wanted = opened.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n", "anchor")).alias("parts"))
    texts, _ = _moved(docs, opened)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            raw, parts = data.tobytes(), batch.column("parts")
            which = np.repeat(np.arange(batch.num_rows), np.diff(parts.offsets.to_numpy()))
            values = parts.flatten()
            start, n = numbers(values.field("start")), numbers(values.field("n"))
            a = offsets[which] + start
            cut = [raw[i:j] for i, j in zip(a.tolist(), (a + n + LENGTH - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([values.field("anchor"), pa.array(numbers(batch.column("doc_id"))[which]), values.field("start"), pa.array(cut, pa.binary())], ["anchor", "doc_id", "start", "bytes"])

    joined = texts.join(wanted, "doc_id").select("doc_id", "text", "parts")
    return arrow_map(joined, run, "anchor long, doc_id long, start int, bytes binary")


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,end:int>>, kept binary"


def _result(batch: pa.RecordBatch, marks: pa.Array | None) -> pa.RecordBatch:
    data, offsets = utf8(batch.column("text"))
    raw = data.tobytes()
    rows = []
    doc = batch.column("doc_id").to_pylist()
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        own, spans = raw[a:b], []
        if marks is not None and marks[k].is_valid:
            part = marks[k].values
            start = numbers(part.field("start"))
            change = np.zeros(b - a + 1, np.int32)
            np.add.at(change, start, 1)
            np.add.at(change, np.minimum(start + numbers(part.field("n")) + LENGTH - 1, b - a), -1)
            gone = np.cumsum(change)[:-1] > 0
            begin, end, _ = runs(gone, np.array([0, b - a]))
            spans = [{"start": i, "end": j} for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
            own = data[a:b][~gone].tobytes()
        rows.append({"doc_id": doc[k], "n_bytes": b - a, "n_removed": b - a - len(own), "n_spans": len(spans), "kept_sha256": hashlib.sha256(own).hexdigest(), "removed": spans, "kept": own})
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])
    return pa.RecordBatch.from_pylist(rows, kind)


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs (doc_id, text) whose doc_id tells texts apart, and, where it had to be replaced, a table of the numbers and the
    doc_ids they stand for: numbers follow doc_id (null first) and then a hash of the text."""
    key = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"))
    unclear = keys.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b or doc_id is null")
    if unclear.isEmpty():
        return docs, None
    pairs = docs.select(F.col("doc_id").cast("long").alias("own"), key.alias("key")).distinct().repartitionByRange("own", "key").sortWithinPartitions("own", "key")
    pairs = written(pairs.select("own", "key", F.monotonically_increasing_id().alias("row")), "numbers").withColumn("part", F.shiftright("row", 33))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    bases = pairs.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    numbers_ = written(pairs.join(F.broadcast(bases), "part").select("own", "key", (F.col("base") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).alias("number")), "numbers")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), key.alias("k"))
    joined = texts.join(numbers_, F.col("id").eqNullSafe(F.col("own")) & (F.col("k") == F.col("key")))
    return joined.select(F.col("number").alias("doc_id"), "text"), numbers_.select("number", "own")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Every row's doc_id with its removed spans (in bytes), what is kept, and their sizes."""
    docs, numbers_ = _numbered(docs)
    out = _without_repeats(written(docs, "numbered") if numbers_ is not None else docs)
    if numbers_ is None:
        return out
    return out.join(numbers_, out["doc_id"] == numbers_["number"]).select(F.col("own").alias("doc_id"), *out.columns[1:])


def _without_repeats(docs: DataFrame) -> DataFrame:
    found, family, marks = segment_rows(docs), 0, []
    while True:
        settled = written(settle(found.repartition("anchor").sortWithinPartitions("anchor", "segment", "doc_id", "start")), "settled")
        marks.append(settled.where("not open").select("doc_id", "start", "n"))
        opened, family = settled.where("open").select("anchor", "doc_id", "start", "n"), family + 1
        hot = opened.groupBy("anchor").count().where(F.col("count") > HOT_SEGMENTS).select("anchor")
        some = family < FAMILIES and not hot.isEmpty()
        hot = written(hot, "hot") if some else hot
        strings = cut_out(docs, opened.join(hot, "anchor", "left_anti") if some else opened)
        marks.append(written(index_bundles(strings.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start")), "indexed"))
        if not some:
            break
        found = segment_again(cut_out(docs, opened.join(hot, "anchor", "left_semi")), family)
    marks = reduce(DataFrame.unionAll, marks)
    marked, clean = _moved(docs, marks)
    by_doc = marks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("marks"))

    def with_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _result(batch, batch.column("marks"))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _result(batch, None)

    joined = marked.join(by_doc, "doc_id", "left").select("doc_id", "text", "marks")
    return arrow_map(joined, with_marks, _RESULT).unionAll(arrow_map(clean, plain, _RESULT))
