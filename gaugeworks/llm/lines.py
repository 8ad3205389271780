"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard, components, one line kept of each.

Lines are compared lower-cased with blanks folded. A signature has one hash of each shingle of eight characters dealt to
45 bins (one-permutation MinHash, empty bins borrow from the next), cut into nine bands of five. The line kept is the
first by (doc_id, place). Lines without visible characters stay. Lines are told apart by 128 bits; of two lines whose
first 64 agree by chance only one is linked to others, and neither is taken for the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm import common

SHINGLE, SIMILAR = 8, 0.8
BANDS, ROWS = 9, 5  # a pair at 0.8 is missed with a chance of (1 - 0.8**5)**9 = 0.03, at 0.9 of 0.0003
BINS = BANDS * ROWS
SLICE, SEEN, TEXTS = 1 << 18, 400_000, 32 << 20
_NONE = 2**63 - 1
FILTER_BITS = 27  # the filter that spares other lines a shuffle has this fixed size


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def line_ids(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each line: the first half is its id, the other one tells lines with equal ids apart."""
    flat = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines]), "<i8").reshape(-1, 2)
    return np.ascontiguousarray(flat[:, 0]), np.ascontiguousarray(flat[:, 1])


def _windows(text: str) -> np.ndarray:
    """A number for each run of eight characters: its bytes where all are below 256, else a hash."""
    try:
        raw = text.encode("latin-1")
        return np.ndarray(len(raw) - SHINGLE + 1, "<u8", raw, strides=(1,)).copy()
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = np.minimum(points, 255).astype(np.uint8).tobytes()
    plain = np.ndarray(len(raw) - SHINGLE + 1, "<u8", raw, strides=(1,)).copy()
    high = np.concatenate([[0], np.cumsum(points > 255)])
    wide = np.flatnonzero(high[SHINGLE:] > high[:-SHINGLE])
    h = np.zeros(len(wide), np.uint64)
    for i in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[wide + i]
    plain[wide] = common.mix(h)
    return plain


def shingles(line: str) -> np.ndarray:
    """The distinct runs of eight characters, sorted; a line of fewer characters is one, filled up."""
    x = _windows(line.ljust(SHINGLE, "\0"))
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def signatures(lines: list[str]) -> np.ndarray:
    lines = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    h = _windows("".join(lines))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    spot = ((h >> np.uint64(40)) * np.uint64(BINS) >> np.uint64(24)).view(np.int64)
    spot += np.repeat(np.arange(len(lines)) * BINS, sizes)[: len(h)]
    worth = (h << np.uint64(22) | h >> np.uint64(42)).view(np.int64)  # the bits that don't choose the bin come first
    worth &= _NONE
    ends = np.cumsum(sizes)[:-1]
    worth[(ends[:, None] - np.arange(1, SHINGLE)).reshape(-1)] = _NONE  # runs across two lines
    least = np.full(len(lines) * BINS, _NONE, np.int64)
    np.minimum.at(least, spot, worth)
    sig = own = least.reshape(-1, BINS)
    empty = own == _NONE
    short = np.flatnonzero(empty.any(1))
    if len(short):  # an empty bin borrows, marked by the distance
        own, gaps, sig = own[short], empty[short], own.copy()
        filled = own.copy()
        for step in range(1, BINS):
            lend = np.roll(own, -step, 1)
            take = gaps & (lend != _NONE)
            filled = np.where(take, lend + step * 0x1000193, filled)
            gaps &= ~take
            if not gaps.any():
                break
        sig[short] = filled
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    s = sig.view(np.uint64).reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(common.mix(np.arange(1, BANDS + 1, dtype=np.uint64)), s.shape[:2]).copy()
    for i in range(ROWS):
        out = common.mix(out * np.uint64(0x9E3779B97F4A7C15) ^ s[:, :, i])
    return out.view(np.int64)


def _normal_lines(text: str | None) -> tuple[list[int], list[str]]:
    """Places and normalised texts of the lines with visible characters."""
    at, lines = [], []
    for i, line in enumerate((text or "").lower().split("\n")):
        line = line.strip() if "  " not in line and line.isprintable() else " ".join(line.split())  # blanks but spaces aren't printable
        if line:
            at.append(i)
            lines.append(line)
    return at, lines


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Columns (k, h, ord, r, q, at) and texts of a slice's lines; batches hold ord, r, q, text."""
    for batch in batches:
        for b in common.slices(batch, batch.schema.names[3], SLICE):
            found = [_normal_lines(t) for t in b.column(3).to_pylist()]
            lines = [x for _, xs in found for x in xs]
            if lines:
                many = [len(xs) for _, xs in found]
                of = [np.repeat(b.column(i).to_numpy(), many) for i in range(3)]
                yield np.stack([*line_ids(lines), *of, np.concatenate([np.array(a, np.int64) for a, _ in found])], 1), lines


def _scan(docs: DataFrame) -> DataFrame:
    """Bands of all lines, and their repeats: one pass over the texts."""
    n = common.deals(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        out: list[pa.RecordBatch] = []

        def flush() -> None:
            t = np.concatenate(held)
            order, first = common.later_places(list(t.T))
            for kind, rows, width in ((common.PLACES, t[order[first]], 0), (common.GONE, t[order[~first]], 3)):
                if len(rows):
                    out.append(common.blocks(kind, np.ascontiguousarray(rows[:, 0]) ^ (rows[:, 5] if width else 0), list(rows.T[width:]), n))

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            size = 0
            for t, lines in _places(batches):
                held.append(t)
                size += len(t)
                if size > SEEN:
                    flush()
                    held.clear()
                    size = 0
                if len(seen) > SEEN:
                    seen.clear()
                fresh = {k: i for i, k in enumerate(t[:, 0].tolist()) if k not in seen}
                seen.update(fresh)
                if fresh:
                    ids = np.fromiter(fresh, np.int64, len(fresh))
                    yield band_keys(signatures([lines[i] for i in fresh.values()])).reshape(-1), np.repeat(ids, BANDS)

        for b in common.star_blocks(pairs(), n):
            yield b
            yield from out
            out.clear()
        if held:
            flush()
        yield from out

    return common.meet(docs.mapInArrow(run, common.BLOCKS))


def _filter_words(ids: DataFrame) -> np.ndarray:
    """A bit for each id's last FILTER_BITS bits: 16 MB whatever the number of ids, so more of them only make it pass more."""
    words = ids.selectExpr(f"(k & {(1 << FILTER_BITS) - 1}) div 64 AS w", "shiftleft(1L, cast(k & 63 AS int)) AS bit")
    got = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[got["w"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out


def _linked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``k, h, ord, r, q, at, s``: wanted lines with their texts; a task's first place of each, all lines of a flush once."""
    sent = docs.sparkSession.sparkContext.broadcast(_filter_words(ids))
    names = ["k", "h", "ord", "r", "q", "at", "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        held, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            t = np.concatenate(held)
            order, first = common.later_places(list(t.T))
            pick = order[first]
            return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in t[pick].T), pa.array([texts[i] for i in pick.tolist()], pa.string())], names=names)

        for t, lines in _places(batches):
            low = t[:, 0] & ((1 << FILTER_BITS) - 1)
            pick = np.flatnonzero(words[low >> 6] >> (low & 63) & 1)
            if len(pick):
                held.append(t[pick])
                texts += [lines[i] for i in pick.tolist()]
                size += sum(map(len, texts[-len(pick) :]))
            if size > TEXTS:
                yield flush()
                held, texts, size = [], [], 0
        if held:
            yield flush()

    some = docs.mapInArrow(run, "k long, h long, ord long, r long, q long, at long, s string")
    return some.join(ids, "k", "left_semi")


class _Sets(dict):
    """Shingles by line; emptied when it holds 64. Pairs come sorted by one side."""

    def __missing__(self, line: str) -> np.ndarray:
        if len(self) > 64:
            self.clear()
        out = self[line] = shingles(line)
        return out


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    every = np.concatenate([x, y])
    every.sort()
    both = int((every[1:] == every[:-1]).sum())
    return both / (len(every) - both)


def jaccard(a: str, b: str) -> float:
    return _jaccard(shingles(a), shingles(b))


def _verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets()
        for b in batches:
            ok = []
            for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = sets[s], sets[t]
                ok.append(min(len(x), len(y)) >= least * max(len(x), len(y)) and _jaccard(x, y) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    ta, tb = texts.select(F.col("k").alias("a"), F.col("s").alias("sa")), texts.select(F.col("k").alias("b"), F.col("s").alias("sb"))
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, ok boolean")


def links(docs: DataFrame, least: float = SIMILAR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``node, root``: components of line ids; ``k, h, ord, r, q, at``: first places of the lines in bands with others;
    ``r, q, at``: places that repeat an earlier line to the letter. ``docs`` has ord, r, q, text.

    Two similar lines that share a band are always joined (``common.linked``)."""
    met = common.cut(_scan(docs))
    common.release(docs.sparkSession)
    edges, again = common.edges_of(met), met.where(F.col("kind") == common.GONE).selectExpr("x AS r", "y AS q", "z AS at")
    ids = common.cut(edges.select("a").union(edges.select("b")).distinct().withColumnRenamed("a", "k"))
    wanted = common.cut(_linked(docs, ids))
    texts = common.cut(wanted.select("k", "h", "s").dropDuplicates(["k"]))
    sizes = texts.select(F.col("k").alias("id"), F.length("s").alias("size"))
    roots = common.linked(edges, lambda pairs: _verify(pairs, texts, least), sizes, texts.select("k", "s"), lambda lines: [shingles(x) for x in lines], least)
    firsts = wanted.select("k", "h", "ord", "r", "q", "at").join(texts.select("k", "h"), ["k", "h"], "left_semi").select("k", "ord", "r", "q", "at")
    return roots, firsts, again


def gone_places(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``_r, _q, places``: for each document with such the places of the lines that aren't first of their component."""
    roots, firsts, again = links(docs, least)
    o = F.struct("ord", "r", "q", "at")
    own = firsts.groupBy("k").agg(F.min(o).alias("o")).join(roots.withColumnRenamed("node", "k"), "k")
    least_of = own.groupBy("root").agg(F.min("o").alias("first"))
    later = own.join(least_of, "root").where("o <> first").select("o.r", "o.q", "o.at")
    return again.union(later).groupBy(F.col("r").alias("_r"), F.col("q").alias("_q")).agg(F.collect_set(F.col("at").cast("int")).alias("_gone"))


def dedup(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """All rows and columns of ``docs``, the text without lines whose component has an earlier one, then two columns more:
    the number of lines and of those removed (``_lines`` and ``_removed``, with more underscores where ``docs`` has such).

    Null texts stay null and have no lines; empty tables give none. Rows with equal doc_id and text count as one
    document; null doc_ids come first in order. Text of which nothing is removed stays as it is to the byte.
    """
    own, place = list(docs.columns), docs.columns.index("text")
    r, q = common.row_id()
    plain = docs.select("doc_id", "text").select(common.order_of(docs).alias("ord"), r.alias("r"), q.alias("q"), "text")
    names = [*own, *common.fresh(own, "_lines", "_removed")]
    kr, kq, kg = common.fresh(own, "_r", "_q", "_gone")
    gone = gone_places(plain, least).toDF(kr, kq, kg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, gone = list(b.columns[: len(own)]), b.column(len(own))
            text = cols[place]
            total = pc.if_else(pc.equal(pc.binary_length(text), 0), 0, pc.add(pc.count_substring(text, "\n"), 1)).fill_null(0)
            hit, new = gone.is_valid(), []
            for t, cuts in zip(text.filter(hit).to_pylist(), gone.filter(hit).to_pylist(), strict=True):
                out = set(cuts)
                new.append("\n".join([x for i, x in enumerate(t.split("\n")) if i not in out]))
            cols[place] = pc.replace_with_mask(text, hit, pa.array(new, text.type))
            yield pa.RecordBatch.from_arrays([*cols, total.cast(pa.int64()), pc.list_value_length(gone).fill_null(0).cast(pa.int64())], names=names)

    matched = docs.withColumns({kr: r, kq: q}).join(gone, [kr, kq], "left").select(*(f"`{c}`" for c in own), kg)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), *(f"`{c}` long" for c in names[len(own) :])])
    return matched.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` for each row of ``docs``; other columns aren't looked at. Odd rows: as in ``dedup``."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), "text")


def clean(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs``, similar lines of the texts removed; odd rows as in ``dedup``."""
    return dedup(docs).select(*(f"`{c}`" for c in docs.columns))
