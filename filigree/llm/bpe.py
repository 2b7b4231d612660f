"""Byte-level BPE encoding and decoding without a regular expression.

Pre-tokenisation works on arrays of codepoint classes. Every character stands for a transition function
over eight states; composition of such functions is associative, so a blocked scan over the (finite) set of
composed functions gives the state before each character, and with it every boundary. The slices between
boundaries go through a cache of merged pairs; what the cache lacks is merged for many slices at once.

Null and empty texts give no ids. Texts are never cut; a run of any length is one slice, as the pattern says. Every row is
answered on its own, those with a repeated or null doc_id too; an empty table gives no rows. Further columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, in_blocks, utf8

#: Text bytes whose slices are held at a time.
PIECE_BYTES = 1 << 18
LETTER, NUMBER, OTHER, SPACE = range(4)
#: Symbols after looking ahead: the four classes, a space or other white space before a non-space, and the
#: apostrophe of a contraction of two or three characters.
LAST_SPACE, LAST_WHITE, SHORT, LONG, SYMBOLS = 4, 5, 6, 7, 8
#: States: nothing to join; in letters, numbers, others, white space; after a space that the next run takes; in a contraction.
FREE, IN_LETTER, IN_NUMBER, IN_OTHER, IN_WHITE, TAKEN, ONE_MORE, TWO_MORE = range(8)
#: Fixed values of the public pattern: the letters after the apostrophe of a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def codepoint_classes() -> np.ndarray:
    """The class of each codepoint."""
    import regex

    patterns = [(kind, regex.compile(p)) for kind, p in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+"))]
    out = np.full(0x110000, OTHER, np.uint8)
    for first in range(0, 0x110000, 4096):
        if not 0xD800 <= first < 0xE000:  # surrogates are no characters
            part = "".join(map(chr, range(first, first + 4096)))
            for kind, pattern in patterns:
                for m in pattern.finditer(part):
                    out[first + m.start() : first + m.end()] = kind
    return out


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a token starts at it."""
    if state == ONE_MORE:
        return FREE, False
    if state == TWO_MORE:
        return ONE_MORE, False
    if symbol in (LETTER, NUMBER):
        own = IN_LETTER if symbol == LETTER else IN_NUMBER
        return own, state not in (own, TAKEN)
    if symbol in (SHORT, LONG) and state not in (TAKEN, IN_OTHER):
        return (ONE_MORE if symbol == SHORT else TWO_MORE), True
    if symbol in (OTHER, SHORT, LONG):
        return IN_OTHER, state not in (IN_OTHER, TAKEN)
    if symbol == SPACE:
        return IN_WHITE, state != IN_WHITE
    return (TAKEN if symbol == LAST_SPACE else FREE), True


@lru_cache(1)
def transitions() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the symbols' functions: the id of each symbol (later: at a text's start), the
    table of compositions, the functions as rows, and whether a token starts, by state and symbol."""
    own = [tuple(step(s, x)[0] for s in range(8)) for x in range(SYMBOLS)]
    own += [(f[FREE],) * 8 for f in own]
    found = {tuple(range(8)): 0}
    todo = []
    for f in own:
        if f not in found:
            found[f] = len(found)
            todo.append(f)
    while todo:
        f = todo.pop()
        for g in own:
            h = tuple(g[s] for s in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    rows = np.array(list(found), np.uint8)
    table = np.array([[found[tuple(g[f])] for g in rows] for f in rows], np.uint16)
    begins = np.array([[step(s, x)[1] for x in range(SYMBOLS)] for s in range(8)])
    return np.array([found[f] for f in own], np.uint16), table, rows, begins


def scan(f: np.ndarray, table: np.ndarray, block: int = 128) -> np.ndarray:
    """Inclusive prefix compositions of f, by blocks that advance side by side."""
    n, size = len(f), len(table)
    if n <= block:
        out = f.copy()
        for k in range(1, n):
            out[k] = table[out[k - 1], f[k]]
        return out
    flat, n_blocks = table.ravel(), -(-n // block)
    grid = np.zeros(n_blocks * block, f.dtype)  # function 0 changes nothing
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(n_blocks, block).T)
    for k in range(1, block):
        grid[k] = flat[grid[k - 1].astype(np.int32) * size + grid[k]]
    before = np.zeros(n_blocks, f.dtype)
    before[1:] = scan(grid[-1], table, block)[:-1]
    grid = flat[before.astype(np.int32)[None, :] * size + grid]
    return grid.T.reshape(-1)[:n]


def token_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions at which a token starts; points: codepoints of all texts, first: positions of the texts' starts."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kinds = codepoint_classes()[points]
    starts = np.zeros(n + 1, bool)
    starts[first] = True
    ends = starts[1:].copy()
    ends[-1] = True
    symbol = kinds.copy()
    white = kinds == SPACE
    before_word = np.zeros(n, bool)
    before_word[:-1] = ~white[1:] & ~ends[:-1]
    last = white & before_word
    symbol[last] = np.where(points[last] == 32, LAST_SPACE, LAST_WHITE)
    marks = np.flatnonzero(points == 39)
    if len(marks):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[marks + 1], padded[marks + 2]
        open_one = ~ends[marks]
        open_two = open_one & ~np.concatenate([ends, [True]])[marks + 1]
        for c in CONTRACTIONS:
            hit = open_one & (one == ord(c)) if len(c) == 1 else open_two & (one == ord(c[0])) & (two == ord(c[1]))
            symbol[marks[hit]] = SHORT if len(c) == 1 else LONG
    ids, table, rows, begins = transitions()
    f = ids[symbol + np.where(starts[:-1], SYMBOLS, 0).astype(np.uint8)]
    state = np.zeros(n, np.uint8)
    state[1:] = rows[scan(f, table)[:-1], FREE]
    return np.flatnonzero(begins[state, symbol] | starts[:-1])


class PairMerger:
    """Slices to ids, by merging the adjacent pair of the lowest rank (the leftmost of equal ones) until none is left."""

    WIDE = 48

    def __init__(self, ranks: dict[bytes, int], cache_size: int = 50_000):
        self.ranks, self.cache, self.cache_size = ranks, {}, cache_size
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks.get(bytes([x]), -1) for x in range(256)], np.int64)
        self.none = len(self.tokens)
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    keys.append(a * (self.none + 1) + b)
                    values.append(rank)
        bits = max(4, (2 * len(keys)).bit_length() + 1)
        self.shift, self.slots = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.none, np.int64)
        left_keys, left_values = np.array(keys, np.int64), np.array(values, np.int64)
        at, self.probes = self._slot(left_keys), 0
        while len(left_keys):
            self.probes += 1
            free = self.keys[at] == -1
            self.keys[at[free]], self.values[at[free]] = left_keys[free], left_values[free]
            left = self.keys[at] != left_keys
            left_keys, left_values, at = left_keys[left], left_values[left], (at[left] + 1) & self.slots

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each joined pair; none where there is no such token."""
        keys = a * (self.none + 1) + b
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], self.none)
        left = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(left):
            at[left] = (at[left] + 1) & self.slots
            seen = self.keys[at[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (seen != -1)]
        return out

    def merge_many(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of short slices, all side by side."""
        size = np.array([len(x) for x in pieces])
        width = int(size.max())
        grid = np.full((len(pieces), width + 1), self.none, np.int64)
        filled = np.arange(width)[None, :] < size[:, None]
        grid[:, :width][filled] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.pair_ranks(grid[:, :-1].ravel(), grid[:, 1:].ravel()).reshape(len(pieces), width)
        rank[np.arange(width)[None, :] >= size[:, None] - 1] = self.none
        out: list = [None] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            best = rank.argmin(1)
            low = rank[np.arange(len(rows)), best]
            done = low >= self.none
            for k in np.flatnonzero(done).tolist():
                out[rows[k]] = grid[k, : size[k]].astype(np.uint32)
            keep = ~done
            rows, grid, rank, size, best, low = rows[keep], grid[keep], rank[keep], size[keep], best[keep], low[keep]
            if not len(rows):
                break
            every = np.arange(grid.shape[1])[None, :]
            grid = np.take_along_axis(grid, np.minimum(every + (every > best[:, None]), grid.shape[1] - 1), 1)
            rank = np.take_along_axis(rank, np.minimum(every[:, :-1] + (every[:, :-1] > best[:, None]), rank.shape[1] - 1), 1)
            size = size - 1
            line = np.arange(len(rows))
            grid[line, best], grid[line, size] = low, self.none
            rank[line, np.minimum(size, rank.shape[1] - 1)] = self.none
            for at, valid in ((best, best < size - 1), (best - 1, best > 0)):
                rank[line[valid], at[valid]] = self.pair_ranks(grid[line[valid], at[valid]], grid[line[valid], at[valid] + 1])
                if at is best:
                    rank[line[~valid], at[~valid]] = self.none
            widest = int(size.max())
            grid, rank = grid[:, : widest + 1], rank[:, :widest]
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one long slice, with a heap of its pairs."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        made = self.pair_ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, k, ids[k], ids[k + 1]) for k, r in enumerate(made) if r < self.none]
        heapq.heapify(heap)
        ranks, tokens = self.ranks, self.tokens
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k] if ids[k] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[k], ids[j], after[k] = r, -1, after[j]
            if after[k] < n:
                before[after[k]] = k
                if (x := ranks.get(tokens[r] + tokens[ids[after[k]]])) is not None:
                    heapq.heappush(heap, (x, k, r, ids[after[k]]))
            if before[k] >= 0 and (x := ranks.get(tokens[ids[before[k]]] + tokens[r])) is not None:
                heapq.heappush(heap, (x, before[k], ids[before[k]], r))
        return np.array([x for x in ids if x >= 0], np.uint32)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each slice as little-endian 32-bit integers."""
        get = self.cache.get
        out = list(map(get, pieces))
        if None not in out:
            return out
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        missing = {p for p, x in zip(pieces, out, strict=True) if x is None}
        made: dict[bytes, bytes] = {}
        short = []
        for p in missing:
            if (r := self.ranks.get(p)) is not None:
                made[p] = r.to_bytes(4, "little")
            elif len(p) <= self.WIDE:
                short.append(p)
            else:
                made[p] = self.merge_long(p).astype("<u4").tobytes()
        short.sort(key=len)
        for k in range(0, len(short), 4096):
            part = short[k : k + 4096]
            made |= {p: x.astype("<u4").tobytes() for p, x in zip(part, self.merge_many(part), strict=True)}
        self.cache |= {p: x for p, x in made.items() if len(p) <= self.WIDE}
        return [made[p] if x is None else x for p, x in zip(pieces, out, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def merger(path: str) -> PairMerger:
    with open(path, "rb") as f:
        return PairMerger({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions of all token starts, and the n + 1 slice offsets of the texts."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    places = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(places, offsets)
    starts = places[token_starts(points, first)]
    return starts, np.searchsorted(starts, offsets)


def encode(docs: DataFrame, ranks_path: str, column: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of docs: its doc_id, `ids` (little-endian 32-bit ids) and `offsets` (the byte at which each
    token starts, likewise), so that any token range can be decoded or mapped back to its text. With decoded, also the
    bytes that the ids decode to, from the same worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(ranks_path)
        lengths = np.array([len(x) for x in own.tokens], np.int64)
        for block in in_blocks(batches, limit=PIECE_BYTES):
            data, offsets = utf8(block.column("text"))
            starts, at = slices(data, offsets)
            raw, ends = data.tobytes(), np.append(starts[1:], len(data))[: len(starts)]  # none of empty texts
            made = own.encode([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            ids = [b"".join(made[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            places = []
            for x in ids:
                size = lengths[np.frombuffer(x, "<u4")]
                places.append((np.cumsum(size) - size).astype("<u4").tobytes())
            columns = [block.column("doc_id"), pa.array(ids, pa.binary()), pa.array(places, pa.binary())]
            columns += [pa.array([own.decode(x) for x in ids], pa.binary())] * decoded
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "offsets", "decoded"][: len(columns)])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col(column).cast("string").alias("text")), run, "doc_id long, ids binary, offsets binary" + ", decoded binary" * decoded)


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """The rows of encode() with their bytes as `decoded`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(ranks_path)
        for batch in batches:
            made = [own.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(made, pa.binary())], ["doc_id", "ids", "decoded"])

    return arrow_map(tokens.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary")


def decode_range(ids: bytes, offsets: bytes, begin: int, end: int, ranks_path: str) -> bytes:
    """The text bytes [begin, end) of one document, decoded from only those tokens that cover them."""
    at = np.frombuffer(offsets, "<u4")
    a = max(0, int(np.searchsorted(at, begin, "right")) - 1)
    b = int(np.searchsorted(at, end, "left"))
    if a >= b:
        return b""
    return merger(ranks_path).decode(ids[4 * a : 4 * b])[begin - int(at[a]) :][: end - begin]


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
