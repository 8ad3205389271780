"""Nested detection annotations as flat, checked frames of ground truths and predictions.

A datum is ``uid, groundtruths, predictions`` and metadata columns; an annotation is a struct of ``uid``, its shape, ``labels``
and, for a prediction, ``scores``; further fields are its metadata. The shape is a box (``xmin, xmax, ymin, ymax``), a
polygon (``ring`` and maybe ``holes``) or a packed bitmask (``mask``); all annotations of a frame have one kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPES = {"box": ("xmin", "xmax", "ymin", "ymax"), "polygon": ("ring", "holes"), "mask": ("mask",)}
OWN = ("uid", "labels", "scores", *(f for fields in SHAPES.values() for f in fields))


def kind_of(data: DataFrame) -> str:
    """The kind of shape of all annotations; ValueError where there is none, several, or another one on either side."""
    found = set()
    for side in ("groundtruths", "predictions"):
        fields = set(data.schema[side].dataType.elementType.fieldNames())
        kinds = {k for k, names in SHAPES.items() if names[0] in fields}
        if len(kinds) != 1:
            raise ValueError(f"{side} need one kind of shape, not {sorted(kinds)}")
        found |= kinds
    if len(found) > 1:
        raise ValueError(f"ground truths and predictions must have one kind of shape, not {sorted(found)}")
    return found.pop()


def _sound(kind: str) -> tuple[Column, str]:
    """A test of a shape, and what is wrong where it fails."""
    a = lambda name: F.col(f"a.{name}")
    if kind == "box":
        return (a("xmin") <= a("xmax")) & (a("ymin") <= a("ymax")), "a box needs its lesser sides first"
    if kind == "polygon":
        return (F.size(F.array_distinct("a.ring")) >= 3) & F.forall("a.ring", lambda p: F.size(p) == 2), "a polygon needs three points of x and y at least"
    return F.exists("a.mask", lambda w: w != 0), "a mask needs a pixel"


def _checked(rows: DataFrame, tests: list[tuple[Column, str]]) -> DataFrame:
    for test, message in tests:
        rows = rows.where(F.when(F.coalesce(test, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
    return rows


def _fields(data: DataFrame, side: str) -> list[str]:
    return data.schema[side].dataType.elementType.fieldNames()


def flatten(data: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """Ground truths, predictions (a row for each label) and their kind, as ``detection`` takes them. Metadata of the datum keeps
    its names, that of an annotation gets ``gt_`` or ``pd_`` before them.

    Reading raises where a ground truth hasn't one label without scores, a prediction not as many scores as labels and one at
    least, or a shape isn't one.
    """
    kind = kind_of(data)
    more = [c for c in data.columns if c not in ("uid", "groundtruths", "predictions")]
    sides = []
    for side, p, long in (("groundtruths", "g", "gt"), ("predictions", "p", "pd")):
        fields = _fields(data, side)
        rows = data.select(F.col("uid").alias("datum_uid"), *more, F.explode(side).alias("a"))
        none = F.lit(0)
        labels, scores = F.coalesce(F.size("a.labels"), none), F.coalesce(F.size("a.scores"), none) if "scores" in fields else none
        fair = (labels == 1) & (scores <= 0) if p == "g" else (labels == scores) & (labels > 0)
        rows = _checked(rows, [(fair, "a ground truth needs one label and no scores" if p == "g" else "a prediction needs a score for every label"), _sound(kind)])
        shape = [F.col(f"a.{n}").alias(f"{p}_{n}") for n in SHAPES[kind] if n in fields]
        own = [F.col(f"a.{n}").alias(f"{long}_{n}") for n in fields if n not in OWN]
        told = [F.col("a.labels")[0].alias("gt_label")] if p == "g" else [F.inline(F.arrays_zip(F.col("a.labels").alias("pd_label"), F.col("a.scores").alias("pd_score")))]
        sides.append(rows.select("datum_uid", F.col("a.uid").alias(f"{long}_id"), *told, *shape, *own, *more))
    return *sides, kind
