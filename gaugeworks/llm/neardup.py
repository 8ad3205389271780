"""Near-duplicate documents: ProbMinHash signatures of weighted word shingles, banding, exact verification, components.

Each shingle of five words has its count as weight. Its arrivals form a Poisson process of that rate; an arrival goes to
a random register, which keeps the earliest. A shingle ends as soon as its next arrival is later than all registers of
the document. Registers of two documents agree with the probability Jaccard of their weights. Candidates share a band of
ROWS registers; a pair counts if the Jaccard of the two shingle sets is at least 0.8, computed exactly. A text that repeats
a shingle also has bands of a second signature, with all weights 1, so equal sets of unlike counts meet as well; without
repeats the two signatures are one. Texts are told apart by 128 bits; of two texts whose first 64 agree by chance only one
is linked to others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm import common

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 5  # a pair at 0.8 is missed with a chance of (1 - 0.8**5)**20 = 0.0004
REGISTERS = BANDS * ROWS
SLICE = 4 << 20


class _Words(dict):
    """Word to 64-bit hash; emptied when it holds 200,000."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_WORDS = _Words()


def _forget() -> None:
    _WORDS.clear()


def key_of(words: list[str]) -> tuple[int, int]:
    """128 bits that name a text by its lower-cased words: those of k, by which texts are linked, and the rest."""
    d = xxhash.xxh3_128_digest("\0".join(words).encode("utf-8", "surrogatepass"))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def shingle_hashes(words: list[str]) -> np.ndarray:
    """Of each run of five words; a shorter text is one shingle."""
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        h = np.concatenate([h, np.full(SHINGLE - len(h), 0x9E3779B97F4A7C15, np.uint64)])
    out = h[: len(h) - SHINGLE + 1].copy()
    for i in range(1, SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - SHINGLE + 1 + i]
    return common.mix(out)


def prob_min_hash(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """Signatures ``(n, m)`` of ``n`` weighted sets at once; ``owner`` is the set of each element."""
    least, who = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    time, live, turn = np.zeros(len(element)), np.arange(len(element)), 0
    while len(live):
        e = element[live]
        draw = common.mix(e + np.uint64((turn * 2 + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        pick = common.mix(draw ^ np.uint64(0x5851F42D4C957F2D))
        now = time[live] - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53) / weight[live]
        spot = owner[live] * m + (pick >> np.uint64(32)).astype(np.int64) * m // (1 << 32)
        np.minimum.at(least, spot, now)
        won = now == least[spot]
        who[spot[won]] = e[won]
        time[live] = now
        limit = least.reshape(n, m).max(1) if turn else np.where(np.isinf(least.reshape(n, m)).any(1), np.inf, least.reshape(n, m).max(1))
        live = live[now < limit[owner[live]]]
        turn += 1
    return who.reshape(n, m)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """``(n, BANDS)`` 64-bit keys of register runs, different in each band."""
    s = signatures.reshape(len(signatures), BANDS, ROWS)
    out = np.broadcast_to(common.mix(np.arange(1, BANDS + 1, dtype=np.uint64)), s.shape[:2]).copy()
    for i in range(ROWS):
        out = common.mix(out * np.uint64(0x9E3779B97F4A7C15) ^ s[:, :, i])
    return out.view(np.int64)


def _bands(sets: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Band keys of weighted sets (elements, counts)."""
    if not sets:
        return []

    def keys(some: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        owner = np.repeat(np.arange(len(some)), [len(e) for e, _ in some])
        return band_keys(prob_min_hash(np.concatenate([e for e, _ in some]), np.concatenate([c for _, c in some]).astype(float), owner, len(some)))

    out = list(keys(sets))
    if again := [i for i, (_, c) in enumerate(sets) if c.max() > 1]:
        for i, more in zip(again, keys([(sets[i][0], np.ones(len(sets[i][0]))) for i in again]), strict=True):
            out[i] = np.unique(np.concatenate([out[i], more]))
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, r, q, k, h, size, bands``: r and q name the row, k and h the text's words, size is the number of its distinct shingles, bands are its keys (no size or bands without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("neardup", _forget)
        for batch in batches:
            for b in common.slices(batch, "text", SLICE):
                words = [(x or "").lower().split() for x in b.column(3).to_pylist()]
                keys = [key_of(w) for w in words]
                rows = {k: i for i, k in reversed(list(enumerate(keys))) if words[i]}
                sets = [np.unique(shingle_hashes(words[i]), return_counts=True) for i in rows.values()]
                bands: list = [None] * len(words)
                for i, row in zip(rows.values(), _bands(sets), strict=True):
                    bands[i] = row
                size = {i: len(e) for i, (e, _) in zip(rows.values(), sets, strict=True)}
                cols = [*(b.column(i) for i in range(3)), *(pa.array(x, pa.int64()) for x in zip(*keys, strict=True)), pa.array(map(size.get, range(len(words))), pa.int32()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "r", "q", "k", "h", "size", "bands"])

    r, q = common.row_id()
    return docs.select("doc_id", r.alias("r"), q.alias("q"), "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, r long, q long, k long, h long, size int, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``k, s``: sorted shingle hashes of one document of each wanted (doc_id, k, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("neardup", _forget)
        for batch in batches:
            for b in common.slices(batch, "text", SLICE):
                ks, sets = [], []
                for x, *key in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    words = (x or "").lower().split()
                    if key_of(words) == tuple(key):
                        ks.append(key[0])
                        sets.append(np.unique(shingle_hashes(words)).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(sets, pa.binary())], names=["k", "s"])

    texts = docs.select("doc_id", "text").join(wanted.hint("shuffle_hash"), "doc_id")
    return texts.select("text", "k", "h").mapInArrow(run, "k long, s binary").dropDuplicates(["k"])


def similar(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def verify(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) with ``ok``: their exact Jaccard is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(x, y) >= least for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok)], names=["a", "b", "ok"])

    sa, sb = sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), sets.select(F.col("k").alias("b"), F.col("s").alias("sb"))
    return pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, ok boolean")


def links(docs: DataFrame, prints: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``k, h, root``: components of similar texts, of each that has a similar one. Two similar texts that share a band
    are always joined (``common.linked``)."""
    n = common.deals(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for b in batches:
                if b.num_rows:
                    yield b.column(1).flatten().to_numpy(), np.repeat(b.column(0).to_numpy(), np.diff(b.column(1).offsets.to_numpy()))

        yield from common.star_blocks(pairs(), n)

    edges = common.cut(common.edges_of(common.meet(prints.where("bands is not null").select("k", "bands").mapInArrow(run, common.BLOCKS))))
    ids = edges.select("a").union(edges.select("b")).distinct().withColumnRenamed("a", "k")
    one = prints.where("bands is not null and doc_id is not null").groupBy("k").agg(F.min(F.struct("doc_id", "h")).alias("o")).join(ids, "k", "left_semi")
    one = common.cut(one.select("o.doc_id", "k", "o.h"))
    sets = common.cut(_sets(docs, one))
    sizes = sets.select(F.col("k").alias("id"), (F.octet_length("s") / 8).cast("int").alias("size"))
    roots = common.linked(edges, lambda pairs: verify(pairs, sets, least), sizes, sets, lambda s: [np.frombuffer(x, np.uint64) for x in s], least)
    return roots.withColumnRenamed("node", "k").join(one.select("k", "h"), "k").select("k", "h", "root")


def _groups(prints: DataFrame, roots: DataFrame) -> DataFrame:
    """``k, h, g, first, n``: each text's group, its first row by (doc_id, r, q), and how many rows it has; rows without a doc_id aside."""
    texts = prints.where("doc_id is not null").groupBy("k", "h").agg(F.min(F.struct("doc_id", "r", "q")).alias("first"), F.count("*").alias("n"))
    group = F.when(F.col("root").isNotNull(), F.struct("root", F.lit(None).cast("long").alias("h"))).otherwise(F.struct(F.col("k").alias("root"), "h"))
    return texts.join(roots, ["k", "h"], "left").withColumn("g", group)


def classes(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``doc_id, class_id, n_class``: class_id is the least doc_id of the component of equal or similar texts.

    Texts are compared as lower-cased words; all texts without words (null ones too) are equal. A row without a doc_id is
    a class of its own; rows with the same doc_id and text count once each in ``n_class``. Other columns aren't looked at.
    """
    prints = common.cut(fingerprints(docs))
    texts = _groups(prints, links(docs, prints, least))
    groups = texts.groupBy("g").agg(F.min("first.doc_id").alias("class_id"), F.sum("n").alias("n_class"))
    by_text = common.cut(texts.join(groups, texts["g"].eqNullSafe(groups["g"])).select("k", "h", "class_id", "n_class"))
    out = prints.select("doc_id", "k", "h").join(by_text, ["k", "h"], "left")
    own = F.col("doc_id").isNull()
    return out.select("doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(own, F.lit(1).cast("long")).otherwise(F.col("n_class")).alias("n_class"))


def keep_one(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` with one document of each class, that of least doc_id, one row of it; rows without doc_id stay.

    A document is a doc_id and its text: of two unlike texts of one doc_id both stay. Of the texts without words, null ones
    too, one stays. Other columns stay as they are.
    """
    prints = common.cut(fingerprints(docs))
    first = _groups(prints, links(docs, prints, least)).groupBy("g").agg(F.min("first").alias("first"))
    kr, kq = common.fresh(docs.columns, "_r", "_q")
    first = common.cut(first.select(F.col("first.r").alias(kr), F.col("first.q").alias(kq)))
    twice = prints.where("doc_id is not null").groupBy("r", "q").agg(F.count("*").alias("n")).where("n > 1").select(F.col("r").alias(kr), F.col("q").alias(kq))
    r, q = common.row_id()
    mine = docs.where("doc_id is not null").withColumns({kr: r, kq: q}).join(first.hint("shuffle_hash"), [kr, kq], "left_semi")
    single = mine.join(twice.hint("shuffle_hash"), [kr, kq], "left_anti")
    rest = mine.join(twice.hint("shuffle_hash"), [kr, kq], "left_semi").dropDuplicates([kr, kq])  # a row given twice
    return single.unionByName(rest).drop(kr, kq).unionByName(docs.where("doc_id is null")).select(*(f"`{c}`" for c in docs.columns))
