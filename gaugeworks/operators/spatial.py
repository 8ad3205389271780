"""Boxes of a datum that meet, without comparing all of them: a grid for each size of box.

A box has the level of the least power of eight that holds its longer side, and touches four cells at most of the grid of
that width. Two boxes that meet do so in a cell of the greater of their levels. So each box is dealt to the cells that it
touches at its own level and at those greater levels which the other side has, and a pair is told in the one cell that
holds the lower left corner of what they share. Boxes that are both smaller than a cell don't meet in it: a cell has three
parts, for pairs of which both boxes, or one of them, have its level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.geometry import EPSILON, box_iou
from gaugeworks.sources.shared import cut

FEW = 1_000_000  # pairs of boxes of a datum up to which all are compared
BOXES = 50_000  # ground truths of a task that compares
CELL = ("datum_uid", "_level", "_x", "_y", "_part")


def shared_side(axis: str) -> Column:
    return F.least(f"g_{axis}max", f"p_{axis}max") - F.greatest(f"g_{axis}min", f"p_{axis}min")


def crowded(truths: DataFrame, predictions: DataFrame, few: int) -> DataFrame:
    """Datums with more than ``few`` pairs of a ground truth and a prediction."""
    g = truths.groupBy("datum_uid").agg(F.count("*").alias("n_g"))
    p = predictions.groupBy("datum_uid").agg(F.count("*").alias("n_p"))
    return cut(g.join(p, "datum_uid").where(F.col("n_g") * F.col("n_p") > few).select("datum_uid"))


def _dealt(boxes: DataFrame, levels: DataFrame, side: str) -> DataFrame:
    """A row for each part of a cell that a box is dealt to: 0 where both boxes of a pair have the cell's level, 1 where only the
    ground truth has it, 2 where only the prediction has it."""
    rows = boxes.join(F.broadcast(levels), "datum_uid")  # a row for each datum
    own = F.col(f"_{side}level")
    rows = rows.withColumn("_level", F.explode(F.array_union(F.array(own), F.filter("_levels", lambda x: x > own)))).drop("_levels")
    width = F.pow(F.lit(2.0), F.col("_level"))
    for axis in ("x", "y"):
        rows = rows.withColumn(f"_{axis}", F.explode(F.sequence(F.floor(F.col(f"{side}_{axis}min") / width), F.floor(F.col(f"{side}_{axis}max") / width))))
    mine, other = (1, 2) if side == "g" else (2, 1)
    return rows.withColumn("_part", F.explode(F.when(F.col("_level") == own, F.array(F.lit(0), F.lit(mine))).otherwise(F.array(F.lit(other)))))


def _cells(truths: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides, a row for each part of a cell; the tasks that deal boxes and those that compare follow the number of boxes."""
    sides, levels = {}, {}
    tasks = max(truths.sparkSession.sparkContext.defaultParallelism, -(-truths.count() // BOXES))
    for side, frame, key in (("g", truths, "gt_id"), ("p", predictions, "pd_id")):
        size = F.greatest(F.col(f"{side}_xmax") - F.col(f"{side}_xmin"), F.col(f"{side}_ymax") - F.col(f"{side}_ymin"))
        sides[side] = frame.withColumn(f"_{side}level", F.when(size > 0, F.ceil(F.log2(size) / 3).cast("int") * 3)).where(F.col(f"_{side}level").isNotNull())
        levels[side] = sides[side].groupBy("datum_uid").agg(F.collect_set(f"_{side}level").alias("_levels"))
        sides[side] = sides[side].repartition(tasks, key)
    return _dealt(sides["g"], levels["p"], "g").repartition(tasks, *CELL), _dealt(sides["p"], levels["g"], "p")


def tiled(truths: DataFrame, predictions: DataFrame) -> DataFrame:
    """Rows of both sides of each pair of one datum whose boxes share an area, each pair once."""
    g, p = _cells(truths, predictions)
    met = g.join(p, list(CELL))
    width = F.pow(F.lit(2.0), F.col("_level"))
    once = [*(shared_side(a) > 0 for a in ("x", "y")), *(F.col(f"_{a}") == F.floor(F.greatest(f"g_{a}min", f"p_{a}min") / width) for a in ("x", "y"))]
    for test in once:
        met = met.where(test)
    return met.drop("_level", "_x", "_y", "_part", "_glevel", "_plevel")


def alone(truths: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of each side without a box of the other whose IoU with them counts. A box asks in each of its cells for one partner
    only, so this follows the boxes, not their pairs."""
    keep = {"g": ["datum_uid", "gt_id", *(f"g_{a}{m}" for a in "xy" for m in ("min", "max"))], "p": ["datum_uid", "pd_id", *(f"p_{a}{m}" for a in "xy" for m in ("min", "max"))]}
    g, p = _cells(truths.select(keep["g"]), predictions.select(keep["p"]))
    same = lambda a, b: [F.col(f"a.{n}") == F.col(f"b.{n}") for n in CELL]
    out = []
    for frame, mine, theirs, key in ((truths, g, p, "gt_id"), (predictions, p, g, "pd_id")):
        meets = mine.alias("a").join(theirs.alias("b"), [*same("a", "b"), *(shared_side(a) > 0 for a in ("x", "y")), box_iou("g_", "p_") >= EPSILON], "left_semi")
        out.append(frame.join(meets.select("datum_uid", key).distinct(), ["datum_uid", key], "left_anti"))
    return out[0], out[1]


def meeting(truths: DataFrame, predictions: DataFrame, few: int = FEW) -> DataFrame:
    """As ``tiled``; in datums with ``few`` pairs at most all are compared."""
    test = (shared_side("x") > 0) & (shared_side("y") > 0)
    many = crowded(truths, predictions, few)
    if many.isEmpty():
        return truths.join(predictions, "datum_uid").where(test)
    plain = truths.join(many, "datum_uid", "left_anti").join(predictions, "datum_uid").where(test)
    return plain.unionByName(tiled(truths.join(many, "datum_uid", "left_semi"), predictions.join(many, "datum_uid", "left_semi")))
