"""IoU as column expressions for boxes and packed bitmasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def box_iou(a: str, b: str) -> Column:
    """Of boxes in columns ``{a}xmin, {a}xmax, {a}ymin, {a}ymax`` and the same of ``b``; 0 where the union is nothing."""

    def side(axis: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.col(f"{a}{axis}max"), F.col(f"{b}{axis}max")) - F.greatest(F.col(f"{a}{axis}min"), F.col(f"{b}{axis}min")))

    def area(p: str) -> Column:
        return (F.col(f"{p}xmax") - F.col(f"{p}xmin")) * (F.col(f"{p}ymax") - F.col(f"{p}ymin"))

    both = side("x") * side("y")
    union = area(a) + area(b) - both
    return F.when(union >= EPSILON, both / union).otherwise(0.0)


def mask_iou(a: Column, b: Column) -> Column:
    """Of two ``array<bigint>`` bitmasks, 64 pixels a word."""

    def bits(words: Column) -> Column:
        return F.aggregate(words, F.lit(0), lambda n, w: n + F.bit_count(w))

    both = bits(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    union = bits(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    return F.when(union > 0, both / union).otherwise(0.0)
