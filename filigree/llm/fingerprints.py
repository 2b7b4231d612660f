"""MinHash fingerprints.

A text's fingerprint has N_HASHES values: the least of its five-word shingles' hashes under each of as many
universal hash functions (multiply, add, keep the high bits), computed in numpy for all shingles of a text at
once. The share of equal values estimates the Jaccard similarity. near_pairs() joins bands of the signatures in
Spark and verifies each candidate by the exact similarity of its shingle sets, near_copies() gives the components of
these links; members() tells which texts have equal sets.

Null and empty texts, and texts without words, have no shingles: all their values are the largest, so they are
alike one another and unlike all others. Equal texts have equal fingerprints. Rows are documents each: those with one
doc_id follow one another in the order of their texts, those of null doc_id come first. members() and near_pairs() take
rows of one doc_id as one document, and leave null doc_ids out of the pairs. An empty table gives no rows. Further
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard_join
from .common import arrow_map, id_filter, in_blocks, maybe_in, ragged, utf8, written
from .textarrays import mix, random_words, shingle_sets

N_HASHES = 128
_A = random_words(11, N_HASHES) | np.uint64(1)
_B = random_words(12, N_HASHES)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16-bit minima under all hash functions."""
    low = np.full(N_HASHES, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), 4096):
            low = np.minimum(low, (shingles[k : k + 4096, None] * _A[None, :] + _B[None, :]).min(0))
    return (low >> np.uint64(20)).astype(np.uint16) if len(shingles) else np.full(N_HASHES, 0xFFFF, np.uint16)


def signatures(texts: pa.Array) -> list[bytes]:
    found, at = shingle_sets(*utf8(texts))
    return [signature(found[a:b]).astype(">u2").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def likeness(a: bytes, b: bytes) -> float:
    return float((np.frombuffer(a, ">u2") == np.frombuffer(b, ">u2")).mean())


def fingerprint(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id and signature (binary) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in in_blocks(batches):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(signatures(block.column("text")), pa.binary())], ["doc_id", "signature"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col(column).cast("string").alias("text")), run, "doc_id long, signature binary")


#: Rows of a band bucket's block. Each pair of blocks is a join key of its own, so a hot bucket is many tasks.
BLOCK_ROWS = 2048


def members(docs: DataFrame) -> DataFrame:
    """doc_id, rep, n and signature of every row: texts with equal shingle sets form a class, which its smallest doc_id
    (rep) stands for. Sets are told apart by their size and two 64-bit hashes; n is that size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in in_blocks(batches):
            found, at = shingle_sets(*utf8(block.column("text")))
            with np.errstate(over="ignore"):
                one, two = (np.concatenate([[np.uint64(0)], np.cumsum(mix(x), dtype=np.uint64)]) for x in (found, found ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
                h1, h2 = ((x[at[1:]] - x[at[:-1]]).view(np.int64) for x in (one, two))
            signs = [signature(found[a:b]).astype(">u2").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(h1), pa.array(h2), pa.array(signs, pa.binary())], ["doc_id", "n", "h1", "h2", "signature"])

    rows = arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n long, h1 long, h2 long, signature binary")
    rows = written(rows, "signatures")
    classes = rows.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    return rows.join(classes, ["n", "h1", "h2"]).select("doc_id", "rep", "n", "signature")


def near_pairs(docs: DataFrame, threshold: float = 0.8, bands: int = 32, own: DataFrame | None = None) -> DataFrame:
    """Pairs of class representatives (a < b) whose shingle sets have at least that Jaccard similarity, and the similarity.

    Classes are those of members() (own, if it is at hand): members of one class have equal sets, and a pair of
    representatives holds for all members of both. Candidates share one of the bands, and all pairs of a bucket are
    candidates but those whose sizes rule the similarity out. A pair of similarity s shares no band with
    probability (1 - s ** (128 / bands)) ** bands: 5e-8 for 0.8 and 32 bands; lower thresholds need more bands.
    """
    own = written(members(docs), "members") if own is None else own
    reps = own.where("doc_id = rep and n > 0").dropDuplicates(["doc_id"])
    wide = 2 * N_HASHES // bands
    rows = reps.select("doc_id", "n", F.posexplode(F.array(*[F.substring("signature", 1 + k * wide, wide) for k in range(bands)])).alias("band", "value"))
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    shared = rows.groupBy("band", "value").agg(F.count("*").alias("rows")).where("rows > 1").select("band", "value", blocks.alias("blocks"))
    rows = written(rows.join(shared, ["band", "value"]).withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(7)), "blocks").cast("int")), "bands")
    left = rows.select("band", "value", F.col("doc_id").alias("x"), F.col("n").alias("n_x"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    right = rows.select("band", "value", F.col("doc_id").alias("y"), F.col("n").alias("n_y"), F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), "own")).alias("i"))
    both = left.join(right, ["band", "value", "i", "j"]).where("x <> y and (i < j or x < y)").where(F.least("n_x", "n_y") / F.greatest("n_x", "n_y") >= threshold)
    found = written(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "candidates")
    ids = found.select(F.col("a").alias("doc_id")).unionAll(found.select(F.col("b").alias("doc_id"))).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # the texts of the rest are not moved
        for batch in batches:
            yield batch.filter(pa.array(maybe_in(shared.value, batch.column("id"))))

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = arrow_map(texts, wanted, "id long, text string").dropDuplicates(["id"])
    joined = found.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, x_at), (y, y_at) = (shingle_sets(*utf8(batch.column(c))) for c in ("text_a", "text_b"))
            out = []
            for k in range(batch.num_rows):
                p, q = x[x_at[k] : x_at[k + 1]], y[y_at[k] : y_at[k + 1]]
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append(both / max(1, len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "jaccard"])

    return arrow_map(joined.select("a", "b", "text_a", "text_b"), verify, "a long, b long, jaccard double").where(F.col("jaccard") >= threshold)


def banded(docs: DataFrame, bands: int) -> DataFrame:
    """The sets of docs as jaccard_join.joined() takes them, with hashes of the bands of their signatures for prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = random_words(13, bands)
        for block in in_blocks(batches):
            found, at = shingle_sets(*utf8(block.column("text")))
            with np.errstate(over="ignore"):
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(x), dtype=np.uint64)]) for x in (found, found ^ np.uint64(0xA5A5A5A5A5A5A5A5))]
                one, two = ((x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums)
                keys, maps, sizes = [], [], np.diff(at)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    parts = signature(found[a:b]).reshape(bands, -1)
                    key = salts.copy()
                    for k in range(parts.shape[1]):
                        key = mix(key ^ parts[:, k])
                    keys.append(key if b > a else key[:0])
                    maps.append(jaccard_join.bitmap(found[a:b]) if b > a else b"")
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
            flat = np.concatenate(keys).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(one), pa.array(two), ragged(flat, ends, pa.int64()), ragged(np.ones(len(flat), np.int32), ends, pa.int32()), pa.array(maps, pa.binary())],
                ["doc_id", "n", "h1", "h2", "prefix", "ways", "bitmap"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return arrow_map(rows, run, "doc_id long, n long, h1 long, h2 long, prefix array<long>, ways array<int>, bitmap binary")


def near_copies(docs: DataFrame, bands: int = 32) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links lead to, its own included) of every row. Two documents
    link if they share a band of their signatures and their shingle sets have a Jaccard similarity of 0.8 or more;
    so a link of that similarity is missed with a probability of 5e-8 at most, and none is wrong. Bands are joined in
    Spark, and links verified by whole sets, as in jaccard_join, whatever the size of a bucket."""
    return jaccard_join.joined(docs, banded(docs, bands), 5)


#: Text bytes of one part of with_next(), and the most parts: beyond these, parts grow. They are read as streams.
PART_BYTES, MOST_PARTS = 16 << 20, 1 << 15
_NONE = -(2**63)


def part_heads(rows: DataFrame, part_bytes: int) -> np.ndarray:
    """The least doc_ids (null: the least number) of parts of about part_bytes of text, ascending. Ids and sizes are sorted
    over ranges, and each range tells its own heads."""
    sizes = rows.select(F.coalesce("doc_id", F.lit(_NONE)).alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"))
    dealt = sizes.repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for batch in batches:
            ids, total = batch.column("doc_id").to_numpy(), np.cumsum(batch.column("size").to_numpy())
            fresh = np.ones(len(ids), bool)
            fresh[1:] = ids[1:] != ids[:-1]
            heads, at, places = [], -held, np.flatnonzero(fresh)
            before = total - batch.column("size").to_numpy()
            if last is None:
                heads.append(ids[0])
            while (k := int(np.searchsorted(before[places], at + part_bytes))) < len(places):
                if ids[places[k]] != last and (not heads or heads[-1] != ids[places[k]]):
                    heads.append(ids[places[k]])
                at = int(before[places[k]])
                places = places[k + 1 :]
            held, last = int(total[-1]) - at, ids[-1]
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.int64())], ["head"])

    return np.unique(np.array([r.head for r in arrow_map(dealt, run, "head long").collect()], np.int64))


def with_next(docs: DataFrame, part_bytes: int) -> DataFrame:
    """docs dealt by ranges of doc_id into parts, sorted, with the first document of the next part after each part's
    last one (is_next; after the last part, the first document). Each part is a task of its own."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    heads = part_heads(rows, part_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(heads)  # at most MOST_PARTS and the ranges' own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = shared.value
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("doc_id").fill_null(_NONE).to_numpy()
                part = np.searchsorted(heads, ids, "right") - 1
                again = np.flatnonzero(heads[part] == ids)
                for own, parts, following in ((batch, part, False), (batch.take(pa.array(again)), (part[again] - 1) % len(heads), True)):
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("text"), pa.array(parts.astype(np.int32)), pa.array([following] * own.num_rows, pa.bool_())], ["doc_id", "text", "part", "is_next"])

    dealt = arrow_map(rows, run, "doc_id long, text string, part int, is_next boolean")
    return dealt.repartitionById(max(1, len(heads)), "part").sortWithinPartitions("is_next", "doc_id", "text")


def compare_edited(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Each document with the text that has its second half replaced by the start of the next document: both
    signatures, the edited text's hash and the likeness to it and to the next document."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which waits for its next one: doc_id, text, signature, part
        for block in in_blocks(batches):
            ids, texts = block.column("doc_id").to_pylist(), [x or "" for x in block.column("text").to_pylist()]
            tails, signs, parts_ = block.column("is_next").to_pylist(), signatures(block.column("text")), block.column("part").to_pylist()
            rows, edited = [], []
            for row in zip(ids, texts, signs, parts_, tails, strict=True):
                if held is not None:
                    half = len(held[1]) // 2
                    edited.append(held[1][: len(held[1]) - half] + row[1][:half])
                    rows.append((*held, row[2]))
                held = None if row[4] else row[:4]
            made = signatures(pa.array(edited, pa.string()))
            yield pa.RecordBatch.from_pylist(
                [{"doc_id": i, "n_chars": len(t), "edited_sha256": hashlib.sha256(e.encode()).hexdigest(), "fingerprint": s.hex(), "edited_fingerprint": m.hex(), "near_edited": likeness(s, m), "near_next": likeness(s, n)} for (i, t, s, _, n), e, m in zip(rows, edited, made, strict=True)],
                pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]),
            )

    return arrow_map(with_next(docs, part_bytes), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def part_bytes_for(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(PART_BYTES, -(-total // MOST_PARTS))
