"""Fill-in-the-middle: texts are cut at two places and their parts put into another order.

A text is kept as its maximal runs of code points of one class, a class being the number of bytes of the code point: the
run's first byte, its width, and the units (code points) before it, cumulated over a block of texts. A cut at a unit is
found by binary search of the run that contains it, and its byte follows by arithmetic: first byte + units into the run
times the width. No code point is decoded and none is visited between cuts.

Forms, with MARKS P, S and M: plain is the text, psm is P prefix S suffix M middle, spm is S suffix P prefix M middle. A text
that holds a mark, and an empty one, is plain, so a mark in the output of another form is always the operator's own: marks
begin with a character that they have nowhere else, so none can overlap another or arise at a joint.

Null texts are empty. A row without a doc_id draws by the empty string in its place. Every row is transformed by itself:
repeated rows give repeated results, an empty table none. Cuts at one place give an empty middle. Texts of any length are
whole. Further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, in_blocks, numbers, utf8

MARKS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = ("plain", "psm", "spm")
#: Of a hundred texts with a key, those that are transformed, and of a hundred of these those that become spm.
TRANSFORMED, SUFFIX_FIRST = 90, 20

#: The width of a code point by its first byte; 0 where a byte only continues one.
_WIDTH = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16, np.uint8)


class RunTable:
    """Maximal runs of code points of one width over the UTF-8 bytes of several texts: first bytes, widths, and the units
    before each. No run spans two texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        width = _WIDTH[data]
        leads = np.flatnonzero(width)
        kinds = width[leads]
        first = np.ones(len(leads), bool)
        first[1:] = kinds[1:] != kinds[:-1]
        #: Units before each text, and of all.
        self.texts = np.searchsorted(leads, offsets)
        first[self.texts[self.texts < len(leads)]] = True
        self.units = np.flatnonzero(first)
        self.bytes, self.widths = leads[self.units], kinds[self.units].astype(np.int64)

    def lengths(self) -> np.ndarray:
        return np.diff(self.texts)

    def places(self, text: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """The byte of the data at which cut units of a text end."""
        if not len(self.units):
            return np.zeros(len(cut), np.int64)
        unit = self.texts[text] + cut
        run = np.maximum(np.searchsorted(self.units, unit, "right") - 1, 0)
        return self.bytes[run] + (unit - self.units[run]) * self.widths[run]


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2 ** 32 that depend on doc_id and seed alone."""
    text = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(text, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, column: str = "text", seed: int = 1) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output of each row."""
    marks = [m.encode() for m in MARKS]
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in in_blocks(batches):
            data, offsets = utf8(block.column("text"))
            runs = RunTable(data, offsets)
            n = runs.lengths()
            h = [numbers(block.column(f"h{k}")) for k in range(4)]
            one, two = h[0] % (n + 1), h[1] % (n + 1)
            low, high = np.minimum(one, two), np.maximum(one, two)
            rows = np.arange(len(n))
            cut, end = runs.places(rows, low), runs.places(rows, high)
            whole = data.tobytes()
            form = np.where(h[3] % 100 < SUFFIX_FIRST, 2, 1)
            form[(n == 0) | (h[2] % 100 >= TRANSFORMED)] = 0
            out = []
            for k, (a, b, c, d) in enumerate(zip(offsets[:-1].tolist(), cut.tolist(), end.tolist(), offsets[1:].tolist(), strict=True)):
                if form[k] and any(whole.find(mark, a, d) >= 0 for mark in marks):
                    form[k] = 0
                if not form[k]:
                    out.append(whole[a:d])
                elif form[k] == 1:
                    out.append(b"".join((p, whole[a:b], s, whole[c:d], m, whole[b:c])))
                else:
                    out.append(b"".join((s, whole[c:d], p, whole[a:b], m, whole[b:c])))
            plain = form == 0
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.array(FORMS, object)[form], pa.string()), pa.array(low, pa.int64(), mask=plain), pa.array(high - low, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    given = docs.select(F.col("doc_id").cast("long"), F.col(column).cast("string").alias("text"))
    given = given.select("doc_id", "text", *[c.alias(f"h{k}") for k, c in enumerate(draws(F.col("doc_id"), seed))])
    return arrow_map(given, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of."""

    def before(x: Column, mark: str) -> Column:
        return F.substring_index(x, mark, 1)

    def after(x: Column, mark: str) -> Column:
        return F.substring_index(x, mark, -1)

    middle = after(output, MIDDLE)
    psm = F.concat(after(before(output, SUFFIX), PREFIX), middle, before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(before(after(output, PREFIX), MIDDLE), middle, after(before(output, PREFIX), SUFFIX))
    return F.when(form == FORMS[1], psm).when(form == FORMS[2], spm).otherwise(output)
