"""Pairs of boxes of crowded datums, tile by tile: boxes are shuffled, pairs never are.

A datum has square tiles, as wide as holds about SIDE boxes of a side. A box goes to each tile that it touches; a pair is told
in the tile where the later of the two begins on each axis. A tile with more boxes than MOST is dealt as blocks of both sides,
so a task holds a block of each and gives its pairs in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.functions.geometry import EPSILON
from gaugeworks.sources.shared import cut

SIDE = 3_000  # boxes of a side that a tile is made for
MOST = 6_000  # boxes of a side beyond which a tile is split in blocks
ROWS = 100_000  # rows of a task
BATCH = 1 << 16  # pairs that go on at once
KEY = ("datum_uid", "_tx", "_ty", "_i", "_j")
BOX = ("xmin", "xmax", "ymin", "ymax")
EAST, NORTH, HOME, MORE = 1, 2, 4, 8  # begins in the tile on either axis, first of a box's rows, one of several


def sound(p: str) -> Column:
    """Boxes with an area, which alone can meet others."""
    sides = [F.col(f"{p}_{a}max") - F.col(f"{p}_{a}min") for a in "xy"]
    return F.coalesce((sides[0] > 0) & (sides[0] < float("inf")) & (sides[1] > 0) & (sides[1] < float("inf")), F.lit(False))


def crowded(truths: DataFrame, predictions: DataFrame, few: int) -> DataFrame:
    """``datum_uid, n, _left, _low, _wide`` of datums with more than ``few`` pairs of a ground truth and a prediction: boxes of the greater
    side, corner and width of the tiles."""
    rows = None
    for p, frame in (("g", truths), ("p", predictions)):
        one = frame.select("datum_uid", F.lit(int(p == "g")).alias("g"), *(F.when(sound(p), F.col(f"{p}_{c}").cast("double")).alias(c) for c in BOX))
        rows = one if rows is None else rows.union(one)
    found = rows.groupBy("datum_uid").agg(F.sum("g").alias("n_g"), F.count("*").alias("n"), *((F.min if "min" in c else F.max)(c).alias(c) for c in BOX))
    found = found.where((F.col("n_g") * (F.col("n") - F.col("n_g")) > few) & F.col("datum_uid").isNotNull()).withColumn("n", F.greatest("n_g", F.col("n") - F.col("n_g")))
    x, y = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    wide = F.greatest(F.sqrt(x * y * SIDE / F.col("n")), F.greatest(x, y) * SIDE / F.col("n"))
    return cut(found.select("datum_uid", "n", F.coalesce("xmin", F.lit(0.0)).alias("_left"), F.coalesce("ymin", F.lit(0.0)).alias("_low"), F.coalesce(wide, F.lit(1.0)).alias("_wide")))


def tasks_of(plan: DataFrame) -> int:
    total = plan.agg(F.sum("n")).first()[0] or 0
    return max(plan.sparkSession.sparkContext.defaultParallelism, -(-3 * total // ROWS))


def _tiled(frame: DataFrame, p: str, plan: DataFrame) -> DataFrame:
    """A row for each tile that a box touches, with ``_flags``."""
    rows = frame.where(sound(p)).join(F.broadcast(plan), "datum_uid")  # a row for each crowded datum
    at = lambda c, corner: F.floor((F.col(f"{p}_{c}").cast("double") - F.col(corner)) / F.col("_wide"))
    rows = rows.withColumns({"_x0": at("xmin", "_left"), "_x1": at("xmax", "_left"), "_y0": at("ymin", "_low"), "_y1": at("ymax", "_low")})
    rows = rows.withColumn("_tx", F.explode(F.sequence("_x0", "_x1"))).withColumn("_ty", F.explode(F.sequence("_y0", "_y1")))
    begins = [F.col("_tx") == F.col("_x0"), F.col("_ty") == F.col("_y0")]
    more = (F.col("_x1") > F.col("_x0")) | (F.col("_y1") > F.col("_y0"))
    flags = F.when(begins[0], EAST).otherwise(0) + F.when(begins[1], NORTH).otherwise(0) + F.when(begins[0] & begins[1], HOME).otherwise(0) + F.when(more, MORE).otherwise(0)
    return rows.withColumn("_flags", flags).drop("_x0", "_x1", "_y0", "_y1", "_left", "_low", "_wide", "n")


def _dealt(truths: DataFrame, predictions: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """Rows of both sides, ``_side`` 0 and 1, together by tile and block."""
    sides = {"g": _tiled(truths, "g", plan), "p": _tiled(predictions, "p", plan)}
    tile = ["datum_uid", "_tx", "_ty"]
    counted = sides["g"].select(*tile, F.lit(1).alias("g")).union(sides["p"].select(*tile, F.lit(0).alias("g"))).groupBy(*tile).agg(F.sum("g").alias("a"), F.count("*").alias("b"))
    heavy = counted.select(*tile, *(F.ceil(n / most).cast("int").alias(k) for n, k in ((F.col("a"), "_kg"), (F.col("b") - F.col("a"), "_kp")))).where("_kg > 1 or _kp > 1")
    heavy = cut(heavy)  # fewer rows than boxes by a factor of ``most``
    out = None
    for k, (p, key) in enumerate((("g", "gt_id"), ("p", "pd_id"))):
        rows = sides[p].join(F.broadcast(heavy), tile, "left").fillna(1, ["_kg", "_kp"])
        mine, other, own, theirs = ("_kg", "_kp", "_i", "_j") if p == "g" else ("_kp", "_kg", "_j", "_i")
        rows = rows.withColumn(own, F.pmod(F.xxhash64(key), F.col(mine)).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.greatest(F.col(other), F.lit(1)) - 1)))
        flags = F.when(F.col(theirs) > 0, F.col("_flags").bitwiseAND(~HOME)).otherwise(F.col("_flags")).bitwiseOR(F.when(F.col(other) > 1, MORE).otherwise(0))
        rows = rows.withColumn("_flags", flags).withColumn("_side", F.lit(k)).drop("_kg", "_kp")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (*KEY, "_flags", "_side")]
    return out.select(*KEY, "_flags", "_side", *rest).repartition(tasks_of(plan), *KEY).sortWithinPartitions(*KEY)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of rows whose first ``keys`` columns are equal."""
    held, last = [], None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for k in range(keys):
            change[1:] |= pc.not_equal(batch.column(k).slice(1), batch.column(k).slice(0, n - 1)).to_numpy(zero_copy_only=False)
        change[0] = last is not None and [batch.column(k)[0] for k in range(keys)] != last
        start = 0
        for at in np.flatnonzero(change).tolist():
            if at > start:
                held.append(batch.slice(start, at - start))
            yield pa.Table.from_batches(held)
            held, start = [], at
        held.append(batch.slice(start))
        last = [batch.column(k)[n - 1] for k in range(keys)]
    if held:
        yield pa.Table.from_batches(held)


def corners(rows: pa.Table, p: str) -> np.ndarray:
    return np.stack([pc.cast(rows.column(f"{p}_{c}"), pa.float64()).to_numpy() for c in BOX])


def near(g: np.ndarray, p: np.ndarray, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of boxes that share an area, a block of ground truths at a time."""
    order = np.argsort(g[0], kind="stable")
    for low in range(0, len(order), block):
        at = order[low : low + block]
        b = g[:, at]
        some = np.flatnonzero((p[0] < b[1].max()) & (p[1] > b[0][0]))
        q = p[:, some]
        i, j = np.nonzero((b[0][:, None] < q[1]) & (q[0] < b[1][:, None]) & (b[2][:, None] < q[3]) & (q[2] < b[3][:, None]))
        yield at[i], some[j]


def box_measure(g: np.ndarray, p: np.ndarray) -> np.ndarray:
    """IoU of boxes, row by row, as ``box_iou``."""
    side = lambda k: np.maximum(0.0, np.minimum(g[k + 1], p[k + 1]) - np.maximum(g[k], p[k]))
    both = side(0) * side(2)
    union = (g[1] - g[0]) * (g[3] - g[2]) + (p[1] - p[0]) * (p[3] - p[2]) - both
    return np.where(union >= EPSILON, both / np.where(union >= EPSILON, union, 1.0), 0.0)


Measure = Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray], np.ndarray]


def _told(rows: pa.Table, measure: Measure | None, of: int | None = None, met: list[np.ndarray] | None = None) -> Iterator[tuple]:
    """Of a tile's rows both sides, then batches of places of their pairs with IoU. With ``of`` only pairs are measured whose box of this
    side is one of several tiles and isn't ``met`` yet."""
    side = rows.column("_side").to_numpy()
    g, p = (rows.filter(pa.array(side == k)) for k in (0, 1))
    a, b = corners(g, "g"), corners(p, "p")
    f, h = g.column("_flags").to_numpy(), p.column("_flags").to_numpy()
    yield g, p, f, h
    for i, j in near(a, b):
        flags = f[i] | h[j]
        told = flags & (EAST | NORTH) == EAST | NORTH
        if of is not None:
            told &= ((f[i], h[j])[of] & MORE > 0) & ~met[0][(i, j)[of]]
        i, j = i[told], j[told]
        for low in range(0, len(i), BATCH):
            x, y = i[low : low + BATCH], j[low : low + BATCH]
            iou = box_measure(a[:, x], b[:, y]) if measure is None else measure(g, p, x, y)
            yes = iou >= EPSILON
            yield x[yes], y[yes], iou[yes]


def pairs(truths: DataFrame, predictions: DataFrame, plan: DataFrame, drop: tuple[str, ...], measure: Measure | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs with ``iou`` and, with nulls, boxes of one tile without a pair; ground truths and predictions of several tiles without a
    pair. Columns in ``drop`` (shapes) don't come along."""
    dealt = _dealt(truths, predictions, plan, most or MOST)
    kinds = dict(dealt.dtypes)
    sides = [[c for c in frame.columns if c != "datum_uid" and c not in drop] for frame in (truths, predictions)]
    kept = ["datum_uid", *sides[0], *sides[1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, len(KEY)):
            told = _told(rows, measure)
            g, p, f, h = next(told)
            kind = {c: rows.schema.field(c).type for c in kept}

            def out(x: np.ndarray | None, y: np.ndarray | None, iou: np.ndarray) -> Iterator[pa.RecordBatch]:
                n, cols = len(iou), []
                for c in kept:
                    frame, at = (g, x) if c in sides[0] or c == "datum_uid" and x is not None else (p, y)
                    cols.append(pa.nulls(n, kind[c]) if at is None else frame.column(c).take(pa.array(at)))
                yield from pa.table([*cols, pa.array(iou)], names=[*kept, "iou"]).combine_chunks().to_batches()

            met = np.zeros(g.num_rows, bool), np.zeros(p.num_rows, bool)
            for x, y, iou in told:
                met[0][x] = met[1][y] = True
                if len(x):
                    yield from out(x, y, iou)
            for k, flags in enumerate((f, h)):
                lone = np.flatnonzero(~met[k] & (flags & MORE == 0))
                if len(lone):
                    yield from out(lone if k == 0 else None, lone if k else None, np.zeros(len(lone)))

    def unmet(k: int) -> Callable:
        """Boxes of a side that have several tiles: the first row of each if it met nothing, other rows that did."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in groups(batches, len(KEY)):
                met = []
                told = _told(rows, measure, k, met)
                frame, flags = (lambda g, p, f, h: ((g, f), (p, h))[k])(*next(told))
                met.append(np.zeros(frame.num_rows, bool))
                for found in told:
                    met[0][found[k]] = True
                yes = (flags & MORE > 0) & ((flags & HOME > 0) != met[0])
                yield from frame.filter(pa.array(yes)).select(listed[k]).combine_chunks().to_batches()

        return run

    listed = [["_flags", "datum_uid", *dict.fromkeys([*own, *(f"{p}_{c}" for c in BOX)])] for p, own in zip("gp", sides, strict=True)]
    names = lambda cols: ", ".join(f"`{c}` {kinds[c]}" for c in cols)
    both = dealt.mapInArrow(run, f"{names(kept)}, iou double")
    alone = []
    for k, (p, key) in enumerate((("g", "gt_id"), ("p", "pd_id"))):
        rows = dealt.mapInArrow(unmet(k), names(listed[k]))
        first = F.col("_flags").bitwiseAND(HOME) > 0
        same = W.partitionBy("datum_uid", key, *(f"{p}_{c}" for c in BOX))
        lone = rows.withColumn("_met", F.max(~first).over(same)).where(first & ~F.col("_met")).select("datum_uid", *sides[k])
        flat = (truths, predictions)[k].where(~sound(p)).join(F.broadcast(plan.select("datum_uid")), "datum_uid", "left_semi").select("datum_uid", *sides[k])
        alone.append(lone.union(flat))
    return both, alone[0], alone[1]
