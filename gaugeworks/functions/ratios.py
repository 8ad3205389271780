"""Zero-safe ratios that all metrics share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    both = precision + recall
    return F.when(both > 1e-9, 2.0 * precision * recall / both).otherwise(0.0)
