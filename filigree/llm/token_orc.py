"""Token ids in ORC files.

Documents are dealt by ranges of doc_id and sorted, so every file holds one range, its stripes and row groups
hold narrow ranges (minimum and maximum of doc_id in the row indexes), and a Bloom filter on doc_id settles
point reads. ORC stores the ids with its integer run-length encoding. Stripes are read in parallel.

Null and empty texts hold the end id alone. Rows with equal doc_id stay next to each other, in any order, and those of
null doc_id come first. An empty table gives files without rows. Further columns, whatever their names, are not written.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, in_blocks, ragged, utf8
from .textarrays import lowered, same_slices, white_space_words, word_hashes

#: Text bytes that go into one file.
FILE_BYTES = 32 << 20


#: What keeps words apart in one call: a character that is a token of its own.
_MARK = "\x01"
#: What the vocabulary's byte level makes of each byte, but for the blank, which parts words: visible bytes stay, the others follow from 256 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHER = sorted(set(range(256)) - set(_SEEN))
_LEVEL = "".join(chr(b if b in _SEEN or b == 0x20 else 256 + _OTHER.index(b)) for b in range(256))


def byte_level(text: str) -> str:
    """A character for each byte of the text. One pass over many words, where the library's own step takes them one by one."""
    return codecs.charmap_decode(text.encode(), "strict", _LEVEL)[0]


class WordEncoder:
    """Texts to ids with the tokenizers library.

    The vocabulary's pre-tokeniser drops white space and no token crosses it, so each distinct word is encoded
    once and its ids are kept in one array, found by the word's 64-bit hash. Words are hashed, compared with the known
    word's bytes, and their ids gathered for a block of texts at once; a word whose hash is that of another one is
    encoded by itself. Words that the normaliser would leave as they are go, cut into runs of
    letters, single numbers and runs of the rest, through a copy of the tokenizer without its slow normaliser and
    pattern; all others through the tokenizer itself. Only for tokenizers of that kind.
    """

    def __init__(self, path: str, end_id: int, cache_size: int = 800_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.cache_size = Tokenizer.from_file(path), end_id, cache_size
        plain = json.loads(self.tokenizer.to_str())
        plain["normalizer"] = None
        plain["pre_tokenizer"] = {"type": "WhitespaceSplit"}  # it gets texts of byte_level()
        self.plain = Tokenizer.from_str(json.dumps(plain))
        self.pieces = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.odd = regex.compile(r"['\s\p{C}]|<\|").search
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        assert len(self.mark) == 1
        self._clear()

    def _clear(self) -> None:
        """Place 0 holds the end id."""
        self.known: dict[int, int] = {}
        self.apart: dict[bytes, int] = {}
        self.ids, self.at, self.sizes = np.array([self.end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.words, self.word_at = np.zeros(0, np.uint8), np.zeros(2, np.int64)

    def _add(self, hashes: list[int], words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(hashes, range(len(self.at), len(self.at) + len(hashes)), strict=True))
        self.words = np.concatenate([self.words, np.frombuffer(b"".join(words), np.uint8)])
        self.word_at = np.concatenate([self.word_at, self.word_at[-1] + np.cumsum([len(w) for w in words], dtype=np.int64)])
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])

    def _encode(self, tokenizer, hashes: list[int], words: list[bytes], texts: list[str]) -> None:
        made, sizes = [], []
        for k in range(0, len(texts), 1000):
            text = f" {_MARK} ".join(texts[k : k + 1000])
            ids = np.array(tokenizer.encode_batch_fast([byte_level(text) if tokenizer is self.plain else text], add_special_tokens=False)[0].ids, np.uint32)
            mark = ids == self.mark[0]
            sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(mark), [len(ids)]])) - 1)
            made.append(ids[~mark])
        if made:
            self._add(hashes, words, np.concatenate(made), np.concatenate(sizes))

    def learn(self, hashes: list[int], words: list[bytes]) -> None:
        plain, pieces, other, whole = [], [], [], []
        for h, w in zip(hashes, words, strict=True):
            text = w.decode()
            if text.isascii() and text.isalpha():
                plain.append((h, w))
                pieces.append(text)
            elif self.odd(text) or text.lower() != text or not unicodedata.is_normalized("NFC", text):
                if _MARK in text:
                    ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                    self._add([h], [w], ids, np.array([len(ids)]))
                else:
                    other.append((h, w))
                    whole.append(text)
            else:
                plain.append((h, w))
                pieces.append(" ".join(self.pieces(text)))
        self._encode(self.plain, *([x[k] for x in plain] for k in (0, 1)), pieces)
        self._encode(self.tokenizer, *([x[k] for x in other] for k in (0, 1)), whole)

    def _own_place(self, word: bytes) -> int:
        """Where the ids of a word are that shares another one's hash; for the rest of the cache's life it has no hash."""
        if word not in self.apart:
            self.apart[word] = len(self.at)
            ids = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, np.uint32)
            self._add([], [word], ids, np.array([len(ids)]))
        return self.apart[word]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id, and the n + 1 id offsets of the texts."""
        if len(self.known) > self.cache_size:
            self._clear()
        data = lowered(data)
        starts, ends, at = white_space_words(data, offsets)
        hashes = word_hashes(data, starts, ends)
        order = np.argsort(hashes)
        ranked = hashes[order]
        fresh = np.ones(len(ranked), bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        first = order[fresh]
        distinct = ranked[fresh].tolist()
        found = list(map(self.known.get, distinct))
        missing = [k for k, x in enumerate(found) if x is None]
        if missing:
            raw, own = data.tobytes(), first[missing]
            self.learn([distinct[k] for k in missing], [raw[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)])
            for k in missing:
                found[k] = self.known[distinct[k]]
        place = np.empty(len(hashes), np.int64)
        place[order] = np.array(found, np.int64)[np.cumsum(fresh) - 1]
        sizes, known = ends - starts, self.word_at[place + 1] - self.word_at[place]
        unsure = np.flatnonzero((sizes != known) | (sizes > 8))  # of words of one size up to eight bytes, no two have one hash
        at_known = place[unsure]
        for k in unsure[~same_slices(data, starts[unsure], ends[unsure], self.words, self.word_at[at_known], self.word_at[at_known + 1])]:
            place[k] = self._own_place(data[starts[k] : ends[k]].tobytes())
        place = np.insert(place, at[1:], 0)
        sizes = self.sizes[place]
        total = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.at[place] - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)]
        return ids, np.concatenate([[0], total[at[1:] + np.arange(len(at) - 1)]])


@lru_cache(2)
def encoder(path: str, end_id: int) -> WordEncoder:
    return WordEncoder(path, end_id)


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, column: str = "text") -> DataFrame:
    """doc_id and `ids`, each text's ids and the end id; rows and partitions keep their order. `part` numbers the
    partition, and `local_start` counts the ids before the row in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before = encoder(tokenizer_path, end_id), 0
        for block in in_blocks(batches, limit=2 << 20):
            ids, at = own.encode(*utf8(block.column("text")))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("part"), pa.array(before + at[:-1]), pa.array(np.diff(at)), ragged(ids.astype(np.int32), at, pa.int32())], ["doc_id", "part", "local_start", "n_tokens", "ids"])
            before += int(at[-1])

    rows = docs.select(F.col("doc_id").cast("long"), F.spark_partition_id().alias("part"), F.col(column).cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, part int, local_start long, n_tokens long, ids array<int>")


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, files: int) -> None:
    """Encode docs into that many ORC files at path, in ascending doc_id order across and inside the files."""
    dealt = docs.select("doc_id", "text").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    made = encode(dealt, tokenizer_path, end_id)
    made.write.options(**{"orc.compress": "ZSTD", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}).orc(path)


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids. With doc_ids, stripes and row groups that
    cannot hold them are skipped. The totals of the parts (one row for each file) come from the count column alone."""
    rows = spark.read.orc(path)
    ends = rows.groupBy("part").agg(F.sum("n_tokens").alias("total")).orderBy("part").collect()
    before, starts = 0, {}
    for r in ends:
        starts[r.part], before = before, before + r.total
    offsets = spark.createDataFrame(list(starts.items()) or [(0, 0)], "part int, part_start long")
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens as counted in the ids read, and ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_map(tokens.select("doc_id", "start", "ids"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def files_for(docs: DataFrame) -> int:
    """How many files docs take at about FILE_BYTES each, by the texts alone."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(1, -(-total // FILE_BYTES))
