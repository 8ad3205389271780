"""Substring dedup: sliding runs of sentences, hashed and met globally; sentences of non-first repeats go.

A run starts at each sentence and takes the fewest sentences, at least two, that hold MIN_WORDS words; another one ends at
each sentence and reaches back as far. So all sentences of a repeated span of two or more with MIN_WORDS words in all lie
in runs inside it, whatever stands around it. A sentence of LONE_WORDS or more is also a run of its own. Runs are compared
by their lower-cased words, through a 128-bit hash. First is by (doc_id, row, place). Sentences shared through any run but
its first occurrence are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm import common

MIN_WORDS, LONE_WORDS, FLUSH = 16, 40, 400_000
#: A sentence ends behind . ! ? with blanks after it, or at a line's end; the parts joined again are the text.
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?!\s)[^.!?\n]*)*(?:[.!?]*\s*\n\s*|[.!?]+\s+|[.!?]*$)")
_NAMES = ["h1", "h2", "ord", "r", "q", "start", "n", "seat"]


def sentences(text: str) -> list[str]:
    return [x for x in SENTENCE.findall(text) if x]


def runs(parts: list[str]) -> Iterator[tuple[int, int, str]]:
    """(start, sentences, normalised text) of each run, once. Sentences without words begin and end none."""
    words = [x.lower().split() for x in parts]
    size = list(map(len, words))
    for i, n in enumerate(size):
        if n >= LONE_WORDS:
            yield i, 1, " ".join(words[i])

    def reach(i: int, step: int) -> int | None:
        """The other end of the run from i on."""
        held, j = size[i], i
        while held < MIN_WORDS or j == i:
            j += step
            if not 0 <= j < len(size):
                return None
            held += size[j]
        return j

    ahead = {i: j for i in range(len(size)) if size[i] and (j := reach(i, 1)) is not None}
    for i, j in ahead.items():
        yield i, j - i + 1, " ".join(w for x in words[i : j + 1] for w in x)
    for j in range(len(size)):
        if size[j] and (i := reach(j, -1)) is not None and ahead.get(i) != j:
            yield i, j - i + 1, " ".join(w for x in words[i : j + 1] for w in x)


def _sort(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns by (h1, h2, ord, r, q, start), each such place once (rows of equal doc_id and text are one document), and where a new hash begins."""
    order = np.lexsort(cols[5::-1])
    cols = [c[order] for c in cols]
    once = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols[:6]], axis=0)])
    cols = [c[once] for c in cols]
    return cols, np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])


def _batch(cols: list[np.ndarray], pick: np.ndarray, done: bool) -> pa.RecordBatch:
    part = [c[pick] for c in cols]
    seat = common.mix(part[3].view(np.uint64) + part[5].astype(np.uint64)).view(np.int64) if done else part[0]
    flags = np.full(len(seat), done)
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in part), pa.array(seat), pa.array(flags)], names=[*_NAMES, "done"])


def repeats(docs: DataFrame) -> DataFrame:
    """``r, q, start, n``: each run that isn't the first with its words. A task keeps only its first of each hash for the others to meet."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            a = np.array(held, np.int64)
            cols, new = _sort([np.ascontiguousarray(a[:, i]) for i in range(7)])
            yield _batch(cols, new, False)
            if not new.all():
                yield _batch(cols, ~new, True)

        for b in batches:
            for order, r, q, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                for start, n, run in runs(sentences(text or "")):
                    h = xxhash.xxh3_128_intdigest(run.encode("utf-8", "surrogatepass"))
                    held.append(((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), order, r, q, start, n))
                    if len(held) >= FLUSH:
                        yield from flush()
                        held.clear()
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        for b in batches:
            done = b.column(8).to_numpy(zero_copy_only=False)
            cols = [b.column(i).to_numpy() for i in range(7)]
            kept.append([c[~done] for c in cols])
            if done.any():
                yield pa.RecordBatch.from_arrays([pa.array(cols[i][done]) for i in (3, 4, 5, 6)], names=["r", "q", "start", "n"])
        if kept:
            cols, new = _sort([np.concatenate([k[i] for k in kept]) for i in range(7)])
            yield pa.RecordBatch.from_arrays([pa.array(cols[i][~new]) for i in (3, 4, 5, 6)], names=["r", "q", "start", "n"])

    schema = "h1 long, h2 long, ord long, r long, q long, start long, n long, seat long, done boolean"
    return docs.select("ord", "r", "q", "text").mapInArrow(local, schema).repartition("seat").mapInArrow(meet, "r long, q long, start long, n long")


def dedup(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, the text without repeated sentences, then three columns more: sentences, those
    removed, and an array of removed (start, end) sentences, end exclusive, merged (``_sentences``, ``_removed``, ``_spans``,
    with more underscores where ``docs`` has such).

    Null texts stay null and empty ones empty; an empty table gives no rows. Rows of equal doc_id and text count as one
    document. doc_ids that aren't numbers are ordered by a hash, null ones come first.
    """
    own, place, at = list(docs.columns), docs.columns.index("text"), len(docs.columns)
    r, q = common.row_id()
    gone = repeats(docs.select("doc_id", "text").select(common.order_of(docs).alias("ord"), r.alias("r"), q.alias("q"), "text"))
    kr, kq, kg = common.fresh(own, "_r", "_q", "_gone")
    gone = gone.groupBy("r", "q").agg(F.collect_set(F.struct("start", "n"))).toDF(kr, kq, kg)
    names = [*own, *common.fresh(own, "_sentences", "_removed", "_spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, total, removed, spans = [], [], [], []
            for text, cuts in zip(b.column(place).to_pylist(), b.column(at).to_pylist(), strict=True):
                parts = sentences(text or "")
                out = bytearray(len(parts))
                for c in cuts or ():
                    out[c["start"] : c["start"] + c["n"]] = b"\1" * c["n"]
                total.append(len(parts))
                removed.append(sum(out))
                edge = np.flatnonzero(np.diff(np.frombuffer(b"\0" + bytes(out) + b"\0", np.int8))).tolist()
                spans.append([{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                texts.append("".join(p for p, o in zip(parts, out, strict=True) if not o) if cuts else text)
            cols = list(b.columns[:at])
            cols[place] = pa.array(texts, pa.string())
            spans_of = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, spans_of)], names=names)

    kinds = ("long", "long", "array<struct<start:int,end:int>>")
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), *(f"`{c}` {t}" for c, t in zip(names[at:], kinds, strict=True))])
    matched = docs.withColumns({kr: r, kq: q}).join(gone, [kr, kq], "left").select(*(f"`{c}`" for c in own), kg)
    return matched.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_sentences, n_removed, spans, text`` for each row of ``docs``; other columns aren't looked at. Odd rows: as in ``dedup``."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_sentences").alias("n_sentences"), F.col("_removed").alias("n_removed"), F.col("_spans").alias("spans"), "text")
