"""Exact Jaccard join of shingle sets by signature trees.

1. Documents with equal sets form a class, which its smallest doc_id stands for.
2. Two sets with a similarity of at least 0.8 share one of the first n - ceil(0.8 n) + 1 shingles of each in any
   common order. The order is by a sketch of the shingles' counts (of fixed size; any sketch is right, a good one
   keeps buckets small), so shingles that many documents share come last. Each set goes to the buckets of these
   shingles; buckets that the sketch shows to be large are dealt to several tasks.
3. Every set is first compared with the one set that is the smallest in most of its buckets: by bitmaps, and where
   these allow a link, by the whole sets. The components of the links found settle most buckets: all their sets are
   linked already.
4. In every other bucket, sets of different components are joined by signature trees: nodes hold the OR of their
   sets' bitmaps and their range of sizes, and a dual traversal drops pairs of nodes whose largest possible overlap
   is below what the smallest sizes need. This is done twice: once on bitmaps alone, which leaves the rows that have
   any possible partner, and then on the whole sets of these, where pairs that are left are verified at once. Only
   links that join what the task has not joined yet come out, less than one for each row.
5. Large buckets are cut into blocks of rows. First each block is joined with itself, then, under the components that
   this gives, each pair of blocks of a bucket that is still open is a task of its own.

So every pair of linked sets is either in one component already or verified: the components are those of all links.
Shingles are compared by 64-bit hashes. Sets are verified whole.

Null and empty texts, and texts of white space, have an empty set and are linked with nothing. Texts of fewer words
than a shingle have their whole sequence as one. Rows with equal doc_id are one document, and are all returned: they are
linked with one another and each with what its text is linked with. A row of null doc_id has the component of the
documents with an equal set, if there are any, and else null; it links no others. Further columns, whatever their
names, are not looked at; one_of_each() returns them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, id_filter, in_blocks, maybe_in, numbers, ragged, summed, utf8, without, written
from .components import components
from .textarrays import mix, shingle_sets

#: Cells of the sketch, as a power of two: the text's bytes less SKETCH_STEP as powers of two, within these bounds.
LEAST_BITS, MOST_BITS, SKETCH_STEP = 14, 24, 9
#: Sets of one bucket that go to one task, by the sketch's count.
HOT = 20_000
#: Rows of a bucket's block in the tree join.
BLOCK_ROWS = 2048
LEAF, FAN = 16, 8


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def shingle_counts(docs: DataFrame, width: int) -> np.ndarray:
    """How many sets have a shingle in each cell of the sketch. It grows with the texts, up to 64 MB as it is sent."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, size.bit_length() - SKETCH_STEP))

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(1 << bits, np.int64)
        for block in in_blocks(batches):
            found, _ = shingle_sets(*utf8(block.column("text")), width)
            np.add.at(total, (found >> np.uint64(64 - bits)).astype(np.int64), 1)
        return total

    return summed(_texts(docs).select("text"), count, 1 << bits)


def bitmap(tokens: np.ndarray) -> bytes:
    """A set as bits, at least two for each of its shingles; half the bits by OR is the bitmap of half the size."""
    width = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[((tokens * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def described(docs: DataFrame, counts: np.ndarray, width: int) -> DataFrame:
    """doc_id, n, two hashes of the set, its prefix (shingle and number of tasks for its bucket) and its bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**32 - 1).astype(np.uint32))

    shift = np.uint64(65 - len(counts).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for block in in_blocks(batches):
            found, at = shingle_sets(*utf8(block.column("text")), width)
            often = cells[(found >> shift).astype(np.int64)]
            with np.errstate(over="ignore"):
                one, two = mix(found), mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            h1, h2, prefix, ways, maps, sizes = [], [], [], [], [], [0]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                n = b - a
                own = found[a:b]
                p = n - (4 * n + 4) // 5 + 1 if n else 0
                first = np.lexsort((own, often[a:b]))[:p]
                prefix.append(own[first])
                ways.append(often[a:b][first] // HOT + 1)
                h1.append(one[a:b].sum(dtype=np.uint64))
                h2.append(two[a:b].sum(dtype=np.uint64))
                maps.append(bitmap(own) if n else b"")
                sizes.append(p)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(np.array(h2, np.uint64).view(np.int64)), ragged(np.concatenate(prefix).view(np.int64), ends, pa.int64()), ragged(np.concatenate(ways).astype(np.int32), ends, pa.int32()), pa.array(maps, pa.binary())],
                ["doc_id", "n", "h1", "h2", "prefix", "ways", "bitmap"],
            )

    return arrow_map(_texts(docs), run, "doc_id long, n long, h1 long, h2 long, prefix array<long>, ways array<int>, bitmap binary")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """Of sorted (token, salt) runs, the rows that have company, each with the run's first doc_id and its n.
    Runs of buckets that are dealt to several tasks are kept as they are. Memory does not grow with a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("token", "salt", "ways", "doc_id", "n")
        held: dict[str, np.ndarray] | None = None
        begun, center, center_n = False, 0, 0

        def out(x: dict[str, np.ndarray], before: np.ndarray, keep: np.ndarray, first: np.ndarray, first_n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x["token"][keep]), pa.array(x["doc_id"][keep]), pa.array(x["n"][keep]), pa.array(first[keep]), pa.array(first_n[keep])], ["token", "doc_id", "n", "center", "center_n"])

        for batch in batches:
            x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if held is not None:
                x = {c: np.concatenate([held[c], x[c]]) for c in names}
            size = len(x["token"])
            same = np.zeros(size + 1, bool)
            same[1:size] = (x["token"][1:] == x["token"][:-1]) & (x["salt"][1:] == x["salt"][:-1])
            same[0] = begun
            start = np.maximum.accumulate(np.where(same[:size], 0, np.arange(size)))
            from_held = (start == 0) & same[0]
            first, first_n = np.where(from_held, center, x["doc_id"][start]), np.where(from_held, center_n, x["n"][start])
            keep = same[:size] | same[1:] | (x["ways"] > 1)
            keep[-1] = False
            yield out(x, same, keep, first, first_n)
            held, begun, center, center_n = {c: x[c][-1:] for c in names}, bool(same[size - 1]), first[-1], first_n[-1]
        if held is not None:
            keep = np.array([begun]) | (held["ways"] > 1)
            yield out(held, keep, keep, np.array([center]), np.array([center_n]))

    return arrow_map(rows, run, "token long, doc_id long, n long, center long, center_n long")


def _alike(n, m):
    """Whether sizes allow a similarity of 0.8."""
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (F.least(n, m) > 0)


def candidate_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id and the whole set (ascending) of the documents in ids, and of some others. A Bloom filter of fixed size
    keeps the texts of the rest from being moved."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.filter(pa.array(maybe_in(shared.value, batch.column("doc_id"))))
            if block.num_rows:
                found, at = shingle_sets(*utf8(block.column("text")), width)
                yield pa.RecordBatch.from_arrays([block.column("doc_id"), ragged(found.view(np.int64), at, pa.int64())], ["doc_id", "tokens"])

    return arrow_map(_texts(docs), run, "doc_id long, tokens array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= 80 * union."""
    joined = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            sides = [(c.values.to_numpy(zero_copy_only=False).view(np.uint64), c.offsets.to_numpy()) for c in (x, y)]
            (p, p_at), (q, q_at) = sides
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                one, two = p[p_at[k] : p_at[k + 1]], q[q_at[k] : q_at[k + 1]]
                both = np.sort(np.concatenate([one, two]))
                both = int((both[1:] == both[:-1]).sum())
                keep[k] = 100 * both >= 80 * (len(one) + len(two) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return arrow_map(joined.select("a", "b", "x", "y"), run, "a long, b long")


_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


class Tree:
    """A signature tree over rows of one bitmap width, sorted by size: levels of OR-combined bitmaps with the range of
    sizes and the most shingles of a set that its own bitmap does not tell apart."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray):
        slack = sizes - _ONES[maps].sum(1)
        self.levels = [(maps, sizes, sizes, slack)]
        step = LEAF
        while len(self.levels[-1][1]) > 1:
            m, low, high, loose = self.levels[-1]
            at = np.arange(0, len(low), step)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(loose, at)))
            step = FAN

    def fan(self, level: int) -> int:
        return LEAF if level == 1 else FAN


def possible(one: tuple, i: np.ndarray, two: tuple, j: np.ndarray) -> np.ndarray:
    """Whether two nodes can hold linked sets, by their sizes and their largest possible overlap."""
    low_i, high_i, low_j, high_j = one[1][i], one[2][i], two[1][j], two[2][j]
    out = (5 * high_i >= 4 * low_j) & (5 * high_j >= 4 * low_i)
    at = np.flatnonzero(out)
    for k in range(0, len(at), 1 << 14):
        own = at[k : k + (1 << 14)]
        both = _ONES[one[0][i[own]] & two[0][j[own]]].sum(1, dtype=np.int64)
        overlap = both + np.minimum(one[3][i[own]], two[3][j[own]])
        out[own] = 9 * overlap >= 4 * (low_i[own] + low_j[own])
    return out


def tree_pairs(one: Tree, two: Tree, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of one and j of two that a dual traversal leaves (i < j in one tree)."""
    a, b = len(one.levels) - 1, len(two.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        keep = possible(one.levels[a], i, two.levels[b], j)
        i, j = i[keep], j[keep]
        if a == b == 0 or not len(i):
            return (i, j) if not same else (i[i < j], j[i < j])
        down_a, down_b = a >= b and a > 0, b >= a and b > 0
        if down_a:
            i, j = _children(i, j, one.fan(a), len(one.levels[a - 1][1]))
        if down_b:
            j, i = _children(j, i, two.fan(b), len(two.levels[b - 1][1]))
        a, b = a - down_a, b - down_b
        if same:
            keep = i <= j
            i, j = i[keep], j[keep]


def _children(i: np.ndarray, j: np.ndarray, fan: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    wide = (i[:, None] * fan + np.arange(fan)[None, :]).ravel()
    keep = wide < count
    return wide[keep], np.repeat(j, fan)[keep]


def folded(maps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of width bytes."""
    out = np.zeros((len(maps), width), np.uint8)
    for k, x in enumerate(maps):
        out[k] = np.bitwise_or.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), 0)
    return out


def join_rows(ids: np.ndarray, sizes: np.ndarray, comps: np.ndarray, maps: list[bytes], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows i and j, of different documents and components, that may be linked: all of side 0 with all of side 1, or,
    if only one side is there, all of it."""
    widths = np.array([len(x) for x in maps])
    out = [np.zeros((2, 0), np.int64)]
    sides = np.unique(side)
    for w in np.unique(widths):
        for wide in (w, 2 * w):
            for p, q in ((0, 0),) if len(sides) == 1 else ((0, 1), (1, 0)):
                p, q = sides[min(p, len(sides) - 1)], sides[min(q, len(sides) - 1)]
                if wide == w and p > q:
                    continue
                one, two = (np.flatnonzero((widths == x) & (side == s)) for x, s in ((w, p), (wide, q)))
                if not len(one) or not len(two):
                    continue
                one, two = one[np.argsort(sizes[one], kind="stable")], two[np.argsort(sizes[two], kind="stable")]
                same = wide == w and p == q
                tree = Tree(folded([maps[k] for k in one], int(w)), sizes[one])
                other = tree if same else Tree(folded([maps[k] for k in two], int(w)), sizes[two])
                i, j = tree_pairs(tree, other, same)
                a, b = one[i], two[j]
                keep = (comps[a] != comps[b]) & (ids[a] != ids[b])
                out.append(np.stack([a[keep], b[keep]]))
    i, j = np.concatenate(out, 1)
    return i, j


def spanning(ids: np.ndarray, comps: np.ndarray, i: np.ndarray, j: np.ndarray, tokens: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """Links among the pairs (i, j) of rows that join different components, each component joined by one link only."""
    label = np.unique(comps, return_inverse=True)[1]
    place = np.unique(tokens, return_inverse=True)[1]
    mark, sizes, out = np.zeros(len(tokens) + 1, bool), np.diff(at), []
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1):
        if not len(part):
            continue
        a, others = i[part[0]], j[part]
        others = others[label[others] != label[a]]
        own = place[at[a] : at[a + 1]]
        mark[own] = True
        for k in range(0, len(others), 256):
            some = others[k : k + 256]
            some = some[label[some] != label[a]]
            if not len(some):
                continue
            ends = np.cumsum(sizes[some])
            both = np.add.reduceat(mark[place[np.repeat(at[some] - ends + sizes[some], sizes[some]) + np.arange(ends[-1])]].astype(np.int64), ends - sizes[some])
            linked = some[100 * both >= 80 * (len(own) + sizes[some] - both)]
            for b in linked[np.unique(label[linked], return_index=True)[1]]:
                out.append((int(ids[a]), int(ids[b])))
                label[label == label[b]] = label[a]
        mark[own] = False
    return out


_KEYS = ["token", "i", "j"]


def _by_block(rows: DataFrame, solve: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """solve() on the rows of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = [numbers(batch.column(c)) for c in _KEYS]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], 0)) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                key = tuple(int(k[a]) for k in keys)
                if last is not None and key != last:
                    yield solve(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            yield solve(pa.Table.from_batches(held))

    return arrow_map(rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS), run, schema)


def hopeful(rows: DataFrame) -> DataFrame:
    """Of rows with bitmaps, those that have a possible partner in their pair of blocks (token, i, j)."""
    names = [*_KEYS, "doc_id", "comp", "side"]

    def solve(table: pa.Table) -> pa.RecordBatch:
        own = [table.column(c).to_numpy() for c in ("doc_id", "n", "comp", "side")]
        i, j = join_rows(own[0], own[1], own[2], table.column("bitmap").to_pylist(), own[3])
        kept = pa.array(np.unique(np.concatenate([i, j])))
        return pa.RecordBatch.from_arrays([table.column(c).take(kept).combine_chunks() for c in names], names)

    return _by_block(rows.select(*_KEYS, "doc_id", "n", "comp", "side", "bitmap"), solve, "token long, i int, j int, doc_id long, comp long, side int")


def links_in(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join the components in each pair of blocks, of rows with whole sets."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        ids, comps, side = (table.column(c).to_numpy() for c in ("doc_id", "comp", "side"))
        lists = table.column("tokens").combine_chunks()
        tokens, at = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        maps = [bitmap(tokens[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        i, j = join_rows(ids, np.diff(at), comps, maps, side)
        found = spanning(ids, comps, i, j, tokens, at)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _by_block(rows.select(*_KEYS, "doc_id", "comp", "side", "tokens"), solve, "a long, b long")


def possible_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow a link."""
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bitmap").alias(f"map_{c}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "map_a", "map_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(c).to_pylist() if c[0] == "m" else numbers(batch.column(c)) for c in ("n_a", "n_b", "map_a", "map_b"))
            width = np.array([min(len(p), len(q)) for p, q in zip(x, y, strict=True)])
            keep = np.zeros(batch.num_rows, bool)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                p, q = (folded([z[k] for k in at], int(w)) for z in (x, y))
                slack = np.minimum(n[at] - _ONES[p].sum(1, dtype=np.int64), m[at] - _ONES[q].sum(1, dtype=np.int64))
                keep[at] = 9 * (_ONES[p & q].sum(1, dtype=np.int64) + slack) >= 4 * (n[at] + m[at])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return arrow_map(joined, run, "a long, b long")


def _blocks(open_rows: DataFrame, across: bool) -> DataFrame:
    """Rows of open buckets (token, rows, doc_id, n, comp) by pairs of blocks: each block with itself, or each two blocks."""
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    rows = open_rows.withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(7)), blocks).cast("int"))
    if not across:
        return rows.select("token", F.col("own").alias("i"), F.col("own").alias("j"), "doc_id", "n", "comp", F.lit(0).alias("side"))
    others = F.filter(F.sequence(F.lit(0), blocks - 1), lambda k: k != F.col("own"))
    pairs = F.transform(others, lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"), (k < F.col("own")).cast("int").alias("side")))
    return rows.select("token", "doc_id", "n", "comp", F.inline(pairs)).select("token", "i", "j", "doc_id", "n", "comp", "side")


def open_links(docs: DataFrame, buckets: DataFrame, comps: DataFrame, sets: DataFrame, width: int, across: bool) -> DataFrame:
    """Links (a, b) between sets of different components that share a bucket, enough of them to join all that are linked in
    blocks of a bucket, or, across, in two blocks of one."""
    known = written(buckets.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("token", "doc_id", "n", F.coalesce("comp", "doc_id").alias("comp")), "known")
    who = [F.sum(F.xxhash64("doc_id", F.lit(k)).cast("decimal(38,0)")).alias(f"who{k}") for k in (0, 1)]
    totals = known.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("rows"), *who)
    totals = totals.where("low <> high").where(F.col("rows") > BLOCK_ROWS if across else F.lit(True))
    left = totals.groupBy("who0", "who1", "rows").agg(F.min("token").alias("token"))  # one of the buckets that hold the same sets
    rows = _blocks(known.join(left.select("token", "rows"), "token"), across)
    some = written(hopeful(rows.join(sets.select("doc_id", "bitmap"), "doc_id")), "hopeful")
    out = written(links_in(some.join(candidate_sets(docs, some, width), "doc_id")).distinct(), "links")
    discard(known, some)
    return out


def components_of(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links lead to, its own included) of every row."""
    return joined(docs, described(docs, shingle_counts(docs, width), width), width)


def joined(docs: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """The components of the links between sets (rows of described()) that share an entry of their prefixes."""
    sets = written(sets, "sets")
    classes = written(sets.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = sets.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    rows = reps.select("doc_id", "n", F.inline(F.arrays_zip(F.col("prefix").alias("token"), F.col("ways").alias("ways"))))
    rows = rows.toDF("doc_id", "n", "token", "ways").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("ways")).cast("int"))
    buckets = written(shared_buckets(rows.select("token", "salt", "ways", "doc_id", "n").repartition("token", "salt").sortWithinPartitions("token", "salt", "doc_id")), "buckets")
    nearest = buckets.where(F.col("center") != F.col("doc_id")).where(_alike(F.col("n"), F.col("center_n"))).groupBy("doc_id", "center").count().groupBy("doc_id").agg(F.max_by("center", F.struct("count", -F.col("center"))).alias("center"))
    pairs = written(nearest.select(F.col("center").alias("a"), F.col("doc_id").alias("b")), "pairs")
    near = written(possible_pairs(pairs, sets.select("doc_id", "n", "bitmap")), "near")
    ids = near.select(F.col("a").alias("doc_id")).unionAll(near.select(F.col("b").alias("doc_id"))).distinct()
    member = sets.select("doc_id", "n", F.when(F.col("n") > 0, F.col("h1")).alias("h1"), "h2").join(classes, ["h1", "h2"], "left").select("doc_id", "n", "rep")
    repeated = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b and doc_id is not null").select("a", "b")
    links = [written(verified(near, candidate_sets(docs, ids, width)).unionAll(repeated), "links")]
    discard(pairs, near)
    comps = components(links[0])
    for across in (False, True):
        if across and buckets.groupBy("token").count().where(F.col("count") > BLOCK_ROWS).isEmpty():
            break
        links.append(open_links(docs, buckets, comps, sets, width, across))
        if not links[-1].isEmpty():
            discard(comps)
            comps = components(functools.reduce(DataFrame.unionAll, links))
    discard(buckets, *links)
    return member.join(comps, member["rep"] == comps["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, that are their component's smallest doc_id."""
    return without(docs, components_of(docs, width).where("component_id <> doc_id").select("doc_id"))
