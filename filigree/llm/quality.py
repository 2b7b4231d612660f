"""Quality scores by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics (shares of character classes, word and line shapes,
repetition). From the labelled rows two means and two covariances are gathered as sums in Spark, shrunk towards
the pooled covariance and its diagonal, and factored once; a score is the logistic of the difference of the two
Gaussian log densities and log priors, from Mahalanobis distances by the cached Cholesky factors.

Null and empty texts have the statistics of an empty text and are scored like any other. A document with
contradictory labels is not learned from; repeated equal labels count once. With fewer than two classes to learn
from, every score is the (smoothed) share of label 1. Every row is scored by its own text; repeated rows are learned from
each, those of null doc_id never. An empty table gives no rows. Further columns, whatever their names, are not looked
at; keep_good() returns them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_filter, in_blocks, maybe_in, ragged, utf8, written
from .textarrays import lowered, runs, shingles, white_space_words, word_hashes

THRESHOLD = 0.3
#: Weights of a class's own covariance, the pooled one and its diagonal.
OWN, POOLED, DIAGONAL = 0.85, 0.10, 0.05
RIDGE = 1e-3

_GROUPS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\t\n\r\v\f", ".,;:'\"()?-", "!", "|", "*#$%&@~^_+=<>/\\{}[]`")
_CLASS = np.full(256, len(_GROUPS), np.uint8)  # what is in no group: bytes of other scripts and control characters
for _k, _group in enumerate(_GROUPS):
    _CLASS[list(_group.encode())] = _k
N_CLASSES = len(_GROUPS) + 1
NAMES = (
    "log_bytes", "upper_share", "lower_share", "digit_share", "space_share", "break_share", "point_share", "shout_share", "bar_share", "symbol_share", "other_share",
    "word_length", "word_spread", "distinct_words", "top_word", "distinct_lines", "line_length", "distinct_shingles", "shouted_words", "symbol_words", "repeated_words",
)


def _distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct values each group has, and how often its most frequent one occurs."""
    n, top = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b > a:
            own = np.sort(values[a:b])
            edge = np.flatnonzero(own[1:] != own[:-1])
            n[k] = len(edge) + 1
            top[k] = np.diff(np.concatenate([[-1], edge, [b - a - 1]])).max()
    return n, top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    kinds = _CLASS[data]
    share = np.bincount(owner * N_CLASSES + kinds, minlength=n * N_CLASSES).reshape(n, N_CLASSES) / np.maximum(sizes, 1)[:, None]
    starts, ends, at = white_space_words(data, offsets)
    count = np.maximum(np.diff(at), 1)
    length = (ends - starts).astype(float)
    word_owner = np.repeat(np.arange(n), np.diff(at))
    mean = np.bincount(word_owner, length, n) / count
    spread = np.sqrt(np.maximum(np.bincount(word_owner, length**2, n) / count - mean**2, 0))
    words = word_hashes(lowered(data), starts, ends)
    n_distinct, top = _distinct(words, at)
    made, made_at = shingles(words, at)
    n_shingles, _ = _distinct(made, made_at)
    line_starts, line_ends, lines_at = runs(data != 10, offsets)
    n_lines = np.maximum(np.diff(lines_at), 1)
    distinct_lines, _ = _distinct(word_hashes(data, line_starts, line_ends), lines_at)
    total = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    upper, symbol = total(kinds == 0), total(kinds == len(_GROUPS) - 1)
    shouted = np.bincount(word_owner, (upper[ends] - upper[starts] >= 2).astype(float), n) / count
    odd = np.bincount(word_owner, (symbol[ends] - symbol[starts] >= 1).astype(float), n) / count
    again = np.zeros(len(words))
    again[1:] = (words[1:] == words[:-1]) & (word_owner[1:] == word_owner[:-1])
    again = np.bincount(word_owner, again, n) / count
    root = lambda x: np.arcsin(np.sqrt(np.clip(x, 0, 1)))
    columns = [np.log1p(sizes), *(root(share[:, k]) for k in range(N_CLASSES)), np.log1p(mean), np.log1p(spread), np.log1p(n_distinct) / np.log(count + 2), root(top / count), root(distinct_lines / n_lines), np.log1p(sizes / n_lines), root(n_shingles / np.maximum(np.diff(made_at), 1)), root(shouted), root(odd), root(again)]
    return np.stack(columns, 1)


def features(docs: DataFrame, column: str = "text", only: DataFrame | None = None) -> DataFrame:
    """doc_id and the statistics x of each row; with only, of the rows whose doc_id is in it, and of some others."""
    shared = None if only is None else docs.sparkSession.sparkContext.broadcast(id_filter(only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in in_blocks(batches):
            if shared is not None:
                block = block.filter(pa.array(maybe_in(shared.value, block.column("doc_id"))))
            x = statistics(*utf8(block.column("text")))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), ragged(x.ravel(), np.arange(len(x) + 1) * x.shape[1], pa.float64())], ["doc_id", "x"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col(column).cast("string").alias("text")), run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Model:
    """Class means, inverse Cholesky factors, and the log density at the mean with the log prior."""

    means: np.ndarray
    factors: np.ndarray
    levels: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.factors):
            return np.full(len(x), self.levels[0])
        logs = [level - 0.5 * (((x - mean) @ factor.T) ** 2).sum(1) for mean, factor, level in zip(self.means, self.factors, self.levels, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(labelled: DataFrame) -> Model:
    """The model of rows (x, quality 0 or 1). Only sums come to the driver: two rows for each entry of a vector and its square."""
    size = len(NAMES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + size + size * size))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            y = batch.column("quality").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), ragged(total.ravel(), np.arange(3) * total.shape[1], pa.float64())], ["quality", "sums"])

    rows = arrow_map(labelled.select("x", F.col("quality").cast("int")), sums, "quality int, sums array<double>")
    got = rows.select("quality", F.posexplode("sums").alias("k", "v")).groupBy("quality", "k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + size + size * size))
    for r in got:
        total[r.quality, r.k] = r.v
    n = total[:, 0]
    if n.min() < 2:
        return Model(np.zeros((0, size)), np.zeros((0, size, size)), np.array([(n[1] + 0.5) / (n.sum() + 1)]))
    means = total[:, 1 : 1 + size] / n[:, None]
    spreads = total[:, 1 + size :].reshape(2, size, size) / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (spreads * n[:, None, None]).sum(0) / n.sum()
    factors, levels = [], []
    for c in (0, 1):
        shrunk = OWN * spreads[c] + POOLED * pooled + DIAGONAL * np.diag(np.diag(pooled)) + RIDGE * np.eye(size)
        low = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(low))
        levels.append(-np.log(np.diag(low)).sum() + np.log(n[c] / n.sum()))
    return Model(means, np.array(factors), np.array(levels))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(found: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of documents that have one label and are not held out."""
    clear = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most").drop("_most")
    return found.join(clear.where(~held_out(F.col("doc_id"))), "doc_id")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every row, learned from the labels that are not held out."""
    found = written(features(docs), "features")
    shared = docs.sparkSession.sparkContext.broadcast(fit(training_rows(found, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(x), pa.float64())], ["doc_id", "score"])

    return arrow_map(found, run, "doc_id long, score double")


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labels that are not held out. A Bloom filter keeps most texts without a label from being measured."""
    return fit(training_rows(features(docs, only=labels.select(F.col("doc_id").cast("long"))), labels))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(shared.value.scores(statistics(*utf8(batch.column("text")))) >= threshold))

    return arrow_map(docs, run, docs.schema)
