"""Incremental counts: plain sums of a stream's pairs by label, or by pair of labels.

Sums can be added up batch by batch, so a streaming aggregation in complete mode keeps them in the state store; AP and
ROC need one order over all rows and stay with the batch operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def classification_counts(pairs: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """``label, tp_i, fp_i`` for each threshold i, of a stream of winning predictions."""
    on = lambda t: F.col("pd_winner") & (F.abs("pd_score") > 1e-8) & (F.col("pd_score") >= t)
    sums = [x for i, t in enumerate(thresholds) for x in (F.count_if(F.col("match") & on(t)).alias(f"tp_{i}"), F.count_if(~F.col("match") & on(t)).alias(f"fp_{i}"))]
    return pairs.groupBy(F.col("pd_label").alias("label")).agg(*sums)


def pixel_matrix(pixels: DataFrame) -> DataFrame:
    """``gt_label, pd_label, count`` of a stream of pixels."""
    return pixels.groupBy("gt_label", "pd_label").agg(F.count("*").alias("count"))


def to_table(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, then end; a restart with the same checkpoint goes on from the last batch. Results: an in-memory table."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
