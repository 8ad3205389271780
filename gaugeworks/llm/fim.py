"""Fill-in-the-middle: texts cut at two units and put in another order between sentinels, by a sparse checkpoint index.

Units are counted in one pass over a text's bytes, in bounded chunks, which records (unit, byte offset, code-point offset)
every STEP units. A cut searches these checkpoints and reads on from the nearest one, STEP units at most, so no list of
all units is ever held.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import fresh, raw_texts, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The given unit: whitespace and the word behind it, or whitespace alone. All its characters are one byte in UTF-8.
UNIT = re.compile(rb"[ \t-\r]*+[^ \t-\r]++|[ \t-\r]++")
STEP, CHUNK, SLICE = 512, 1 << 20, 16 << 20
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LEADS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


class Checkpoints:
    """Units of a text: their number, and places of every STEP-th end, from which any other is found by a short scan."""

    def __init__(self, text: bytes, step: int = STEP) -> None:
        self.text, self.units, self.points, self.at = text, 0, 0, [(0, 0, 0)]
        data = np.frombuffer(text, np.uint8)
        for start in range(0, len(data), CHUNK):
            part = data[start : start + CHUNK + 1]  # one byte more tells whether the last word ends here
            blank, here = _BLANK[part], min(CHUNK, len(data) - start)
            after = np.append(blank[1:here], blank[here] if len(part) > here else True)
            ends = np.flatnonzero(~blank[:here] & after) + 1
            leads = _LEADS[part[:here]]
            wanted = ends[(-self.units - 1) % step :: step]
            before = np.cumsum(leads, dtype=np.int32)[wanted - 1]
            unit = self.units + (-self.units - 1) % step + 1
            self.at += [(unit + i * step, start + int(b), self.points + int(c)) for i, (b, c) in enumerate(zip(wanted, before, strict=True))]
            self.units += len(ends)
            self.points += int(leads.sum())
        self.units += bool(len(data) and _BLANK[data[-1]])  # blanks at the end are a unit

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset of the end of the first ``unit`` units."""
        done, start, points = self.at[bisect_right(self.at, unit, key=lambda x: x[0]) - 1]
        end = start
        for m in islice(UNIT.finditer(self.text, start), unit - done):
            end = m.end()
        return end, points + int(_LEADS[np.frombuffer(self.text, np.uint8)[start:end]].sum())


def draws(doc_id: object, seed: int = 42) -> list[int]:
    """Four 32-bit numbers of a document; a null id draws as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def arrange(text: bytes, doc_id: object, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and of middle (null if plain), and the text in its new order."""
    index = Checkpoints(text)
    h = draws(doc_id, seed)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not text or p in text or s in text or m in text or h[2] % 100 >= rate:
        return index.units, "plain", None, None, text
    (a, before), (b, upto) = (index.cut(x) for x in sorted(x % (index.units + 1) for x in h[:2]))
    form = "spm" if h[3] % 100 < spm else "psm"
    parts = [s, text[b:], p, text[:a]] if form == "spm" else [p, text[:a], s, text[b:]]
    return index.units, form, before, upto - before, b"".join([*parts, m, text[a:b]])


NAMES = ("n", "form", "prefix_chars", "middle_chars", "output")


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``docs`` with ``n, form, prefix_chars, middle_chars, output`` (with underscores where it has such columns already).

    ``rate`` of 100 documents are reordered, of these ``spm`` of 100 suffix first; doc_id alone decides, so repeated rows get
    the same cuts if their texts are equal. A text that is empty, null (taken as empty) or holds a sentinel stays plain. A
    null doc_id draws as an empty one. An empty table gives no rows.
    """
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    names = fresh(docs.columns, *NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.schema.names[text_at], SLICE):
                ids = batch.column(id_at).to_pylist()
                made = [arrange(t, i, seed, rate, spm) for t, i in zip(raw_texts(batch.column(text_at)), ids, strict=True)]
                n, form, before, middle, out = zip(*made, strict=True)
                more = [pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    kinds = ("long", "string", "long", "long", "string")
    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), *(f"`{c}` {t}" for c, t in zip(names, kinds, strict=True))]))


def restore(rows: DataFrame, output: str = "output", form: str = "form", to: str = "restored") -> DataFrame:
    """``rows`` with ``to``: the text before ``transform``, from its output and form alone. A null form or output gives null.

    The first sentinels are the right ones: what stands before one can't hold it, nor complete it, as all begin with ``<``
    and end with ``>``.
    """
    second = F.when(F.col(form) == "psm", SUFFIX).otherwise(PREFIX)
    i = F.call_function("locate", second, F.col(output))
    j = F.call_function("locate", F.lit(MIDDLE), F.col(output), i)
    first, other = F.substr(output, F.lit(4), i - 4), F.substr(output, i + 3, j - i - 3)
    middle = F.substr(output, j + 3)
    back = F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", F.concat(first, middle, other)).when(F.col(form) == "spm", F.concat(other, middle, first))
    return rows.withColumn(to, back)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars`` and SHA-256 of the output and of the text rebuilt from it."""
    done = restore(transform(docs.select("doc_id", "text")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
