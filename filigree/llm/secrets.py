"""Secrets: three patterns with fixed rules, and strings that pass a battery of randomness tests.

Patterns (assign, access, hex) are looked for in the bytes of whole texts, so letters in either case are ASCII letters only.

Any other run of at least LEAST characters of A-Z a-z 0-9 + / _ - is a candidate (padding by = is not part of it). Its encoding, the
smallest of ENCODINGS that has all its characters, gives the alphabet, of m symbols in a fixed order. Three tests ask
whether n symbols drawn evenly from it could look like the candidate:

* chi-squared: the statistic of the symbols' counts against n / m, with its exact mean m - 1 and variance;
* runs: the changes between kinds of characters (upper, lower, digit, other), against those of independent draws;
* serial: the correlation of a symbol's place in the alphabet with that of the next one.

Their p-values are joined by Fisher's rule to p_random. A candidate below LEVEL is not random and goes: words, counters,
keyboard rows, repeated blocks. Short strings seldom fail, whatever they are, so what is left has to show the opposite too: how
likely a string of written language of that length and alphabet would look as even (its letters' frequencies give mean and
variance of the same statistic) and change kinds as often (bound of a binomial tail). Both are joined to p_text. All candidates
of a length band and encoding in the corpus are one family: the band's discoveries are those of the Benjamini-Hochberg rule
at rate RATE over p_text, on a fixed scale of steps, so only counts are gathered. Long candidates are thus found by weak
evidence, short ones by strong alone, and of what is found in a band a share of at most RATE is expected to be text.

Added spans (kind random) do not overlap base spans; a UUID and a run of digits are no candidates. Null and empty texts have
no spans. Every row is scanned by itself, so repeated rows give repeated spans; each counts in its family. Rows without a
doc_id give rows without one, an empty table none. Texts are whole, of any length; further columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, in_blocks, utf8, written
from .textarrays import runs

KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGNED, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets from the smallest on, each with its symbols in order.
ENCODINGS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
    "base64any": UPPER + LOWER + DIGITS + "+/-_",
}
LEAST = 16
#: Upper ends of the length bands; the last has none.
BANDS = (20, 24, 32, 48, 80)
LEVEL, RATE = 0.001, 0.01
#: Steps of p_text: tenths of a power of ten, from 1 down to 1e-30.
STEPS, DEPTH = 10, 30

#: Frequencies of the letters a to z in written English, in percent.
LETTERS = (8.17, 1.49, 2.78, 4.25, 12.70, 2.23, 2.02, 6.09, 6.97, 0.15, 0.77, 4.03, 2.41, 6.75, 7.51, 1.93, 0.10, 5.99, 6.33, 9.06, 2.76, 0.98, 2.36, 0.15, 1.97, 0.07)
#: How text in a token is taken to look: shares of digits, capitals and other signs, and of changes between kinds.
TEXT_DIGITS, TEXT_CAPITALS, TEXT_SIGNS, TEXT_CHANGES = 0.10, 0.10, 0.05, 0.20

_UUID = re.compile(rb"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def _kind_of(symbol: str) -> int:
    return 0 if symbol in UPPER else 1 if symbol in LOWER else 2 if symbol in DIGITS else 3


def _written(symbol: str) -> float:
    """The frequency of a symbol in tokens of text."""
    kind = _kind_of(symbol)
    letters = LETTERS[ord(symbol.lower()) - ord("a")] / sum(LETTERS) if kind < 2 else 0.0
    return TEXT_CAPITALS * letters if kind == 0 else letters if kind == 1 else TEXT_DIGITS / 10 if kind == 2 else TEXT_SIGNS / 4


class Encoding:
    """An alphabet with the moments that the tests need."""

    def __init__(self, alphabet: str):
        self.m = len(alphabet)
        self.place = np.full(256, -1, np.int16)
        self.place[list(alphabet.encode())] = np.arange(self.m)
        self.kinds = np.array([_kind_of(c) for c in alphabet])
        share = np.bincount(self.kinds, minlength=4) / self.m
        self.change = 1 - (share**2).sum()
        #: A change of a kind and the one after it are not independent: the chance of two changes in a row.
        self.changes = 1 - 2 * (share**2).sum() + (share**3).sum()
        text = np.array([_written(c) for c in alphabet])
        text = text / text.sum()
        self.two, self.three = (text**2).sum(), (text**3).sum()


_ENCODINGS = {name: Encoding(alphabet) for name, alphabet in ENCODINGS.items()}


def upper_tail(z: np.ndarray) -> np.ndarray:
    """P(Z > z) of a standard normal Z, with a relative error below 2e-7 (Numerical approximation by a rational exponent)."""
    t = 1 / (1 + 0.5 * np.abs(z) / np.sqrt(2))
    poly = -1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))
    tail = 0.5 * t * np.exp(-z * z / 2 + poly)
    return np.where(z >= 0, tail, 1 - tail)


def fisher(*p: np.ndarray) -> np.ndarray:
    """Fisher's joint p-value of independent ones: the tail of a chi-squared variable with twice as many degrees."""
    x = -sum(np.log(np.maximum(v, 1e-300)) for v in p)
    term = total = np.ones_like(x)
    for k in range(1, len(p)):
        term = term * x / k
        total = total + term
    return np.exp(-x) * total


def battery(symbols: np.ndarray, sizes: np.ndarray, encoding: Encoding) -> tuple[np.ndarray, np.ndarray]:
    """p_random and p_text of strings of one encoding, given one after another as places in its alphabet."""
    m, count = encoding.m, len(sizes)
    at = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(count), sizes)
    n = sizes.astype(float)
    per = np.bincount(owner * m + symbols, minlength=count * m).reshape(count, m).astype(float)
    squares = (per**2).sum(1)
    chi = m / n * squares - n
    chi_p = upper_tail((chi - (m - 1)) / np.sqrt(2 * (m - 1) * (1 - 1 / n)))
    inner = np.ones(len(symbols), bool)
    inner[at[:-1]] = False
    kinds = encoding.kinds[symbols]
    changed = np.zeros(len(symbols), bool)
    changed[1:] = kinds[1:] != kinds[:-1]
    seen = np.bincount(owner, changed & inner, count)
    c = encoding.change
    spread = (n - 1) * c * (1 - c) + 2 * (n - 2) * (encoding.changes - c * c)
    runs_p = np.minimum(1.0, 2 * upper_tail(np.maximum(np.abs(seen - (n - 1) * c) - 0.5, 0) / np.sqrt(np.maximum(spread, 1e-9)))) if c > 0 else np.ones(count)
    value = symbols - np.bincount(owner, symbols, count)[owner] / n[owner]
    together = np.zeros(len(symbols))
    together[1:] = value[1:] * value[:-1]
    energy = np.bincount(owner, value**2, count)
    serial = np.bincount(owner, together * inner, count) / np.maximum(energy, 1e-9)
    serial_p = np.where(energy > 0, np.minimum(1.0, 2 * upper_tail(np.abs(serial + 1 / n) * np.sqrt(n))), 0.0)
    pairs = n * (n - 1) / 2
    mean = m / n * (n + 2 * pairs * encoding.two) - n
    variance = pairs * encoding.two * (1 - encoding.two) + n * (n - 1) * (n - 2) * (encoding.three - encoding.two**2)
    even_p = upper_tail((mean - chi) / (2 * m / n * np.sqrt(np.maximum(variance, 1e-9))))
    rate = np.clip(seen / (n - 1), 1e-9, 1 - 1e-9)
    gap = rate * np.log(rate / TEXT_CHANGES) + (1 - rate) * np.log((1 - rate) / (1 - TEXT_CHANGES))
    often_p = np.where(rate > TEXT_CHANGES, np.exp(-(n - 1) * gap), 1.0)
    return fisher(chi_p, runs_p, serial_p), fisher(even_p, often_p)


def _step(p: np.ndarray) -> np.ndarray:
    """The step of a p-value, rounded to the greater p."""
    return np.floor(np.minimum(-np.log10(np.maximum(p, 1e-300)) + 1e-9, DEPTH) * STEPS).astype(np.int64)


_ALPHABET = np.zeros(256, bool)
_ALPHABET[list((UPPER + LOWER + DIGITS + "+/_-").encode())] = True
_HEX = np.zeros(256, bool)
_HEX[list((DIGITS + "abcdef").encode())] = True


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Row, first byte, kind and end of all spans of the base kinds."""
    out = []
    whole = data.tobytes()
    starts, ends, _ = runs(_HEX[data], offsets)
    long = np.flatnonzero(ends - starts >= HEX_CHARS)
    rows = np.searchsorted(offsets, starts[long], "right") - 1
    out += [(r, a, 2, b) for r, a, b in zip(rows.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True)]
    for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b > a:
            out += [(r, m.start(), 0, m.end()) for m in _ASSIGN.finditer(whole, a, b) if m.end(2) - m.start(2) >= ASSIGNED]
            out += [(r, m.start(), 1, m.end()) for m in _ACCESS.finditer(whole, a, b) if m.end() - m.start() >= ACCESS_CHARS]
    return sorted(out)


def candidates(data: np.ndarray, offsets: np.ndarray, taken: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, str, float, float]]:
    """Row, first byte, end, encoding, p_random and p_text of the runs that overlap no span in taken."""
    starts, ends, _ = runs(_ALPHABET[data], offsets)
    keep = ends - starts >= LEAST
    starts, ends = starts[keep], ends[keep]
    cover = np.zeros(len(data) + 1, np.int32)
    for _, a, _, b in taken:
        cover[a] += 1
        cover[b] -= 1
    cover = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    free = cover[ends] == cover[starts]
    whole = data.tobytes()
    by_encoding: dict[str, list[tuple[int, int]]] = {}
    for a, b in zip(starts[free].tolist(), ends[free].tolist(), strict=True):
        string = whole[a:b]
        own = set(string.decode())
        kinds = {_kind_of(c) for c in own}
        if _UUID.fullmatch(string) or not kinds - {2, 3} or len(kinds) < 2:
            continue  # digits, signs, or letters of one case
        name = next(name for name, alphabet in ENCODINGS.items() if own <= set(alphabet))
        by_encoding.setdefault(name, []).append((a, len(string)))
    out = []
    for name, found in by_encoding.items():
        own = _ENCODINGS[name]
        sizes = np.array([n for _, n in found])
        symbols = np.concatenate([own.place[data[a : a + n]] for a, n in found]).astype(np.int64)
        random_p, text_p = battery(symbols, sizes, own)
        rows = np.searchsorted(offsets, [a for a, _ in found], "right") - 1
        out += [(r, a, a + n, name, p, q) for r, (a, n), p, q in zip(rows.tolist(), found, random_p.tolist(), text_p.tolist(), strict=True)]
    return sorted(out)


_SPAN = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
_FOUND = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("band", pa.int32()), ("step", pa.int32()), ("random", pa.bool_())])


def tested(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, the base spans, and the candidates with band, encoding, step of p_text, and whether they pass as random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in in_blocks(batches):
            data, offsets = utf8(block.column("text"))
            units = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            place = lambda row, byte: int(units[byte] - units[offsets[row]])  # noqa: E731, B023
            base, found = [[] for _ in offsets[1:]], [[] for _ in offsets[1:]]
            spans = base_spans(data, offsets)
            for r, a, kind, b in spans:
                base[r].append({"start": place(r, a), "rank": kind, "end": place(r, b), "kind": KINDS[kind]})
            for r, a, b, name, random_p, text_p in candidates(data, offsets, spans):
                found[r].append({"start": place(r, a), "end": place(r, b), "encoding": name, "band": int(np.searchsorted(BANDS, b - a, "right")), "step": int(_step(np.array([text_p]))[0]), "random": random_p >= LEVEL})
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_FOUND))], ["doc_id", "base", "found"])

    given = docs.select(F.col("doc_id").cast("long"), F.col(column).cast("string").alias("text"))
    return arrow_map(given, run, "doc_id long, base array<struct<start:int,rank:int,end:int,kind:string>>, found array<struct<start:int,end:int,encoding:string,band:int,step:int,random:boolean>>")


def thresholds(found: DataFrame) -> dict[tuple[str, int], int]:
    """The least step of p_text at which a family's candidates are discoveries (families without any are left out). At most
    one row for each encoding, band and step comes to the driver."""
    each = found.select(F.explode("found").alias("c")).groupBy("c.encoding", "c.band", "c.step").agg(F.count("*").alias("all"))
    families: dict[tuple[str, int], dict[int, int]] = {}
    for r in each.collect():
        families.setdefault((r.encoding, r.band), {})[r.step] = r["all"]
    out = {}
    for family, counts in families.items():
        tests, ahead = sum(counts.values()), 0
        for step in sorted(counts, reverse=True):
            ahead += counts[step]
            if 10.0 ** (-step / STEPS) * tests <= RATE * ahead:
                out[family] = step
    return out


def scan(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id and the spans of each row by start and kind: (start, rank, end, kind) in code points, end exclusive."""
    found = written(tested(docs, column), "candidates")
    least = thresholds(found)
    table = F.create_map(*[F.lit(v) for family, step in sorted(least.items()) for v in (f"{family[0]}:{family[1]}", step)]) if least else None
    rank = F.lit(KINDS.index("random"))

    def good(c: Column) -> Column:
        return F.lit(False) if table is None else c["random"] & F.coalesce(c["step"] >= F.try_element_at(table, F.concat_ws(":", c["encoding"], c["band"])), F.lit(False))

    added = F.transform(F.filter("found", good), lambda c: F.struct(c["start"].alias("start"), rank.alias("rank"), c["end"].alias("end"), F.lit("random").alias("kind")))
    return found.select("doc_id", F.array_sort(F.concat("base", added)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
