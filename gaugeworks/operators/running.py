"""Running sums in one order over all rows, dealt to tasks by ranges of that order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.sources.shared import cut


def running_sums(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, Column], facts: Sequence[DataFrame] = ()) -> DataFrame:
    """Rows with each of ``sums`` added up from a key's first row in ``order`` to this one.

    Rows are dealt by ranges of the keys and the whole order, written once with the number of their range, and summed up
    within a range; then the sums of the ranges before are added, a row for each key and range. So neither a frequent key
    nor equal scores decide how much one task gets. ``facts``, a row or none for each key, come along. Rows of a null key go.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    held = cut(rows.repartitionByRange(tasks, *keys, *order).withColumn("_range", F.spark_partition_id()))
    place = [*keys, "_range"]
    inside = W.partitionBy(*place).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ends = held.groupBy(*place).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    starts = ends.select(*place, *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in sums))
    for each in facts:
        starts = starts.join(each, list(keys), "left")
    out = held.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(starts, place)
    return out.withColumns({n: F.col(n) + F.col(f"{n}_before") for n in sums}).drop("_range", *(f"{n}_before" for n in sums))
