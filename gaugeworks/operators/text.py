"""Text metrics by n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.stemmer import stem

TINY = 2.2250738585072014e-308  # an order without a hit counts as this


def words(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def stemmed(data: DataFrame) -> DataFrame:
    """``uid, prediction, references`` with each word of more than three characters stemmed, words apart by blanks. Null texts stay null."""

    def fold(text: str | None) -> str | None:
        return text if text is None else " ".join(stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", text.lower()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told, refs = b.column(1).to_pylist(), b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(fold, told), pa.string()), pa.array([x and [fold(r) for r in x] for x in refs], pa.list_(pa.string()))], names=["uid", "prediction", "references"])

    return data.select("uid", "prediction", "references").mapInArrow(run, f"uid {dict(data.dtypes)['uid']}, prediction string, references array<string>")


def _tokens(found: Column) -> Column:
    """Words, which hold no blanks, as one string."""
    return F.array_join(found, " ")


def _grams(text: str | None, n: int) -> Counter:
    """Counts of the n-grams of words that are apart by blanks."""
    found = text.split(" ") if text else []
    return Counter(zip(*(found[i:] for i in range(n)), strict=False))


def rouge(data: DataFrame, sizes: tuple[int, ...] = (1, 2), use_stemmer: bool = False) -> DataFrame:
    """``uid, rouge_type, value`` of ``uid, prediction, references``: F-measure of clipped n-gram counts, the best reference counts.

    A row holds all that its values need, so n-grams are counted inside it, in Arrow batches, and nothing is shuffled. Texts
    too short for an n-gram, and rows without references, give 0. Each row gives its own values, a uid given twice too.
    """
    sizes = tuple(dict.fromkeys(sizes))
    names = [f"rouge{n}" for n in sizes]

    def value(p: Counter, r: Counter) -> float:
        hit = sum(min(c, r[g]) for g, c in p.items() if g in r)
        if not hit:
            return 0.0
        precision, recall = hit / p.total(), hit / r.total()
        return 2.0 * precision * recall / (precision + recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values: list[list[float]] = [[] for _ in sizes]
            for p, refs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for out, n in zip(values, sizes, strict=True):
                    mine = _grams(p, n)
                    out.append(max((value(mine, _grams(r, n)) for r in refs or ()), default=0.0))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.float64()) for v in values)], names=["uid", *names])

    kind = dict(data.dtypes)["uid"]
    toks = (stemmed(data) if use_stemmer else data).select("uid", _tokens(words(F.col("prediction"))).alias("p"), F.transform("references", lambda x: _tokens(words(x))).alias("r"))
    return toks.mapInArrow(run, ", ".join([f"uid {kind}", *(f"{n} double" for n in names)])).unpivot("uid", names, "rouge_type", "value")


def common_length(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def common_places(a: Sequence[str], b: Sequence[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence, the last ones of equal choices going by ``b`` first.

    A row of the table of lengths is kept as bits: where it grows along ``b``. Every ``step``-th row is stored; the way back
    computes the rows between two of these again. So memory is the square root of ``a`` times the bits of ``b``.
    """
    where: dict[str, int] = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1

    def rows(flat: int, start: int, end: int) -> Iterator[int]:
        """Bits that don't grow, of the rows behind ``start`` to ``end``."""
        for x in a[start:end]:
            hit = flat & where.get(x, 0)
            flat = (flat + hit | flat - hit) & full
            yield flat

    step = isqrt(len(a)) + 1
    stored = [full]
    for start in range(0, len(a), step):
        for flat in rows(stored[-1], start, min(start + step, len(a))):
            pass
        stored.append(flat)
    out: set[int] = set()
    j, length = len(b), len(b) - stored[-1].bit_count()
    for k in range(len(stored) - 2, -1, -1):
        start = k * step
        block = [stored[k], *rows(stored[k], start, min(start + step, len(a)))]
        for i in range(len(block) - 1, 0, -1):
            if not length:
                return out
            above = block[i - 1]
            before = j - (above & (1 << j) - 1).bit_count()  # length without a[i - 1]
            while True:
                if a[start + i - 1] == b[j - 1]:
                    out.add(start + i - 1)
                    j, length = j - 1, length - 1
                    break
                if before == length:
                    break
                j -= 1  # here the row above is shorter, so this row doesn't grow
                before -= 1 - (above >> j & 1)
    return out


def _measure(hit: int, p: int, r: int) -> float:
    return 2 * hit / (p + r) if hit else 0.0


_WORD = re.compile("[a-z0-9]+")


def _words_of(text: str, use_stemmer: bool) -> list[str]:
    found = _WORD.findall(text.lower())
    return [stem(w) if len(w) > 3 else w for w in found] if use_stemmer else found


def rouge_l(prediction: str, reference: str, use_stemmer: bool = False) -> float:
    p, r = (_words_of(t, use_stemmer) for t in (prediction, reference))
    return _measure(common_length(p, r), len(p), len(r))


def rouge_l_sum(prediction: str, reference: str, use_stemmer: bool = False) -> float:
    """Lines are sentences: of each reference line the union of what its subsequences with all predicted lines cover, clipped by word."""
    p, r = ([_words_of(x, use_stemmer) for x in t.split("\n")] for t in (prediction, reference))
    covered = Counter(line[i] for line in r for i in set().union(*(common_places(line, x) for x in p)))
    mine = Counter(w for x in p for w in x)
    return _measure((covered & mine).total(), mine.total(), sum(map(len, r)))


def rouge_sequences(data: DataFrame, use_stemmer: bool = False) -> DataFrame:
    """``uid, rouge_type, value``: rougeL and rougeLsum, F-measure of the longest common subsequence; the best reference counts.

    Null texts are empty and give 0, as does a row without references. Each row gives its own values. A subsequence is a
    fold over both texts, so Arrow batches are mapped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values: list[list[float]] = [[], []]
            for p, refs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for out, f in zip(values, (rouge_l, rouge_l_sum), strict=True):
                    out.append(max((f(p or "", r or "", use_stemmer) for r in refs or ()), default=0.0))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, values)], names=["uid", "rougeL", "rougeLsum"])

    kind = dict(data.dtypes)["uid"]
    wide = data.select("uid", "prediction", "references").mapInArrow(run, f"uid {kind}, rougeL double, rougeLsum double")
    return wide.unpivot("uid", ["rougeL", "rougeLsum"], "rouge_type", "value")


def bleu_words(text: Column) -> Column:
    """Words, sums of money and other signs but full stops, with their case; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"(?U)\w+|\$[\d]+|[^\s\.]+"), F.lit(0)), F.array().cast("array<string>"))


def bleu(data: DataFrame, weights: Sequence[float] = (0.25, 0.25, 0.25, 0.25)) -> DataFrame:
    """``uid, value`` of ``uid, prediction, references``: weighted n-gram precision, clipped by the best reference, times the brevity penalty.

    The penalty goes by the reference of nearest length, the shorter of two. Without a common word, and below 1e-9, the
    value is 0; so it is without references. N-grams are counted inside a row, in Arrow batches, so nothing is shuffled. Each
    row gives its own value.
    """
    if not weights:
        raise ValueError("at least one weight is needed")
    sizes = range(1, len(weights) + 1)
    counted = [f"{name}_{n}" for n in sizes for name in ("hit", "all")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[int]] = [[] for _ in counted]
            for p, refs in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                for n in sizes:
                    mine, most = _grams(p, n), Counter()
                    for r in refs:
                        most |= _grams(r, n)
                    out[2 * n - 2].append(sum(min(c, most[g]) for g, c in mine.items() if g in most))
                    out[2 * n - 1].append(mine.total())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(x, pa.int64()) for x in out)], names=["uid", "n", "near", *counted])

    toks = data.select("uid", bleu_words(F.col("prediction")).alias("p"), F.transform(F.coalesce("references", F.array().cast("array<string>")), bleu_words).alias("r"))
    gap = F.array_sort(F.transform("r", lambda x: F.struct(F.abs(F.size(x) - F.size("p")).alias("gap"), F.size(x).alias("size"))))
    toks = toks.select("uid", F.size("p").alias("n"), F.try_element_at(gap, F.lit(1))["size"].alias("near"), _tokens(F.col("p")).alias("p"), F.transform("r", _tokens).alias("r"))
    rows = toks.mapInArrow(run, ", ".join([f"uid {dict(data.dtypes)['uid']}, n int, near int", *(f"{c} long" for c in counted)]))
    logs = reduce(lambda a, b: a + b, (F.lit(float(w)) * F.ln(F.greatest(F.coalesce(F.col(f"hit_{n}") / F.greatest(F.col(f"all_{n}"), F.lit(1)), F.lit(0.0)), F.lit(TINY))) for n, w in zip(sizes, weights, strict=True)))
    penalty = F.when(F.col("n") > F.col("near"), 1.0).otherwise(F.exp(1 - F.col("near") / F.col("n")))
    value = F.when(F.col("hit_1") > 0, penalty * F.exp(logs))
    return rows.select("uid", F.when(value >= 1e-9, value).otherwise(0.0).alias("value"))
