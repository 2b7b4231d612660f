"""Words and shingles of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(n, dtype=np.uint64) + (np.uint64(seed) << np.uint64(32)))


#: Longer slices are hashed as the hashes of pieces of so many bytes.
PIECE = 256
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; nothing else changes."""
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def white_space_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between white space (space and bytes 9 to 13), and the n + 1 word offsets of the texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = (data != 32) & ((data < 9) | (data > 13))
    return runs(inside, offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that stay in one text: starts, ends, and the run offsets of the texts."""
    first = np.zeros(len(inside) + 1, bool)
    first[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    last = np.ones(len(inside), bool)
    last[:-1] = ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(inside & last) + 1, np.searchsorted(starts, offsets)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (zeros past the end) as one number."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every slice: eight bytes at a time are mixed into it, so equal hashes of different slices are
    chance, whatever their structure (sums of powers modulo 2**64 are equal for a Thue-Morse word and its complement).
    Different slices of one size up to eight bytes never have one hash: each step is one-to-one."""
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64))
    if not len(out):
        return out
    long = np.flatnonzero(sizes > PIECE)
    live = np.flatnonzero((sizes > 0) & (sizes <= PIECE)) if len(long) else np.flatnonzero(sizes)
    eight, k = eights(data), 0
    with np.errstate(over="ignore"):
        while len(live):
            out[live] = mix(out[live] ^ (eight[starts[live] + k] & _MASKS[np.minimum(sizes[live] - k, 8)]))
            k += 8
            live = live[sizes[live] > k]
        if len(long):
            count = -(-sizes[long] // PIECE)
            at = np.concatenate([[0], np.cumsum(count)])
            begin = np.repeat(starts[long] - at[:-1] * PIECE, count) + np.arange(at[-1]) * PIECE
            pieces = word_hashes(data, begin, np.minimum(begin + PIECE, np.repeat(ends[long], count)))
            out[long] = mix(out[long] ^ word_hashes(pieces.view(np.uint8), 8 * at[:-1], 8 * at[1:]))
    return out


def same_slices(one: np.ndarray, starts: np.ndarray, ends: np.ndarray, two: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether slices of one are, byte by byte, those of two."""
    sizes = ends - starts
    same = sizes == other_ends - others
    live, k = np.flatnonzero(same & (sizes <= PIECE)), 0
    a, b = eights(one), eights(two)
    while len(live := live[sizes[live] > k]):
        differs = ((a[starts[live] + k] ^ b[others[live] + k]) & _MASKS[np.minimum(sizes[live] - k, 8)]) != 0
        same[live[differs]] = False
        live, k = live[~differs], k + 8
    for i in np.flatnonzero(same & (sizes > PIECE)):
        same[i] = np.array_equal(one[starts[i] : ends[i]], two[others[i] : other_ends[i]])
    return same


_PLACE = random_words(2, 64) | np.uint64(1)


def shingles(words: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words of each text, and their offsets.

    A text with fewer words, but not none, has its whole sequence as one shingle; repeats are kept.
    """
    count = np.diff(at)
    with np.errstate(over="ignore"):
        made = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            made += words[k : k + len(made)] * _PLACE[k]
        made = mix(made)
        size = np.where(count >= width, count - width + 1, np.minimum(count, 1))
        out_at = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(at[:-1] - out_at[:-1], size) + np.arange(out_at[-1])
        out = made[np.minimum(source, len(made) - 1)] if len(made) else np.zeros(out_at[-1], np.uint64)
        for k in np.flatnonzero((count > 0) & (count < width)):
            own = words[at[k] : at[k + 1]]
            out[out_at[k]] = mix((own * _PLACE[: len(own)]).sum(dtype=np.uint64)[None] + np.uint64(len(own)))[0]
    return out, out_at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text over lower-cased white-space words, ascending in each text, and their offsets."""
    data = lowered(data)
    starts, ends, at = white_space_words(data, offsets)
    found, found_at = shingles(word_hashes(data, starts, ends), at, width)
    kept = [np.unique(found[a:b]) for a, b in zip(found_at[:-1].tolist(), found_at[1:].tolist(), strict=True)]
    sizes = np.array([0, *map(len, kept)], np.int64)
    return (np.concatenate(kept) if kept else found), np.cumsum(sizes)
