"""Semantic-segmentation metrics from pixels: ``datum_uid, gt_label, pd_label``, null for background."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.errors import EmptyCacheError
from gaugeworks.functions.ratios import f1, share
from gaugeworks.sources.shared import cut


def pixel_counts(pixels: DataFrame) -> DataFrame:
    """``datum_uid, gt_label, pd_label, count``: the pair table that all else is computed from."""
    return pixels.groupBy("datum_uid", "gt_label", "pd_label").agg(F.count("*").alias("count"))


def background(counts: DataFrame, groundtruths: Column | str | None = None, predictions: Column | str | None = None) -> DataFrame:
    """Unselected sides become background, so the pixels are conserved."""
    out = counts
    for name, by in (("gt_label", groundtruths), ("pd_label", predictions)):
        if by is not None:
            test = F.expr(by) if isinstance(by, str) else by
            out = out.withColumn(name, F.when(test, F.col(name)))
    return out


def confusion_matrix(counts: DataFrame, datums: Column | str | None = None) -> DataFrame:
    """``gt_label, pd_label, count, iou`` by label pair; for unmatched cells the ratio to their label's pixels."""
    kept = counts if datums is None else counts.where(datums)
    cells = kept.groupBy("gt_label", "pd_label").agg(F.sum("count").alias("count"))
    gt = cells.groupBy(F.col("gt_label").alias("g")).agg(F.sum("count").alias("gt_n"))
    pd = cells.groupBy(F.col("pd_label").alias("p")).agg(F.sum("count").alias("pd_n"))
    out = cells.join(gt, F.col("gt_label") == F.col("g"), "left").join(pd, F.col("pd_label") == F.col("p"), "left")
    whole = F.when(F.col("gt_label").isNull(), F.col("pd_n")).when(F.col("pd_label").isNull(), F.col("gt_n")).otherwise(F.col("gt_n") + F.col("pd_n") - F.col("count"))
    return out.where("gt_label is not null or pd_label is not null").select("gt_label", "pd_label", "count", share(F.col("count"), whole).alias("iou"))


def select(counts: DataFrame, datums: Column | str | None = None, groundtruths: Column | str | None = None, predictions: Column | str | None = None) -> DataFrame:
    """``background`` of the datums that pass; EmptyCacheError if none does."""
    kept = cut(counts if datums is None else counts.where(datums))
    if kept.isEmpty():
        raise EmptyCacheError
    return background(kept, groundtruths, predictions)


def info(counts: DataFrame, datums: Column | str | None = None, groundtruths: Column | str | None = None, predictions: Column | str | None = None) -> DataFrame:
    """Datums, pixels, and pixels with a label on either side that the filters leave; rows and labels of all."""
    kept = background(counts if datums is None else counts.where(datums), groundtruths, predictions)
    pixels = [F.coalesce(F.sum(F.when(test, F.col("count"))), F.lit(0)).cast("long") for test in (F.lit(True), F.col("gt_label").isNotNull(), F.col("pd_label").isNotNull())]
    sums = kept.agg(F.count_distinct("datum_uid").alias("number_of_datums"), *(x.alias(f"number_of_{n}") for x, n in zip(pixels, ("pixels", "groundtruth_pixels", "prediction_pixels"), strict=True)))
    labels = counts.select(F.explode(F.array("gt_label", "pd_label")).alias("label")).where("label is not null").agg(F.count_distinct("label").alias("number_of_labels"))
    return sums.crossJoin(counts.agg(F.count("*").alias("number_of_rows"))).crossJoin(labels)  # one row each


def metrics(counts: DataFrame, datums: Column | str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """``label, precision, recall, f1, iou`` and, the same on each row, ``accuracy`` and ``mean_iou`` over all labels."""
    kept = counts if datums is None else counts.where(datums)
    if labels is None:
        labels = counts.select(F.explode(F.array("gt_label", "pd_label")).alias("label")).where("label is not null").distinct()
    cells = kept.groupBy("gt_label", "pd_label").agg(F.sum("count").alias("count"))
    sides = cells.select(F.inline(F.array(F.struct(F.col("gt_label").alias("label"), F.col("count").alias("gt"), F.lit(0).cast("long").alias("pd"), F.when(F.col("gt_label") == F.col("pd_label"), F.col("count")).otherwise(0).alias("both")), F.struct(F.col("pd_label").alias("label"), F.lit(0).cast("long").alias("gt"), F.col("count").alias("pd"), F.lit(0).cast("long").alias("both")))))
    sums = sides.where("label is not null").groupBy("label").agg(F.sum("gt").alias("gt"), F.sum("pd").alias("pd"), F.sum("both").alias("both"))
    per = labels.join(sums, "label", "left").fillna(0)
    per = per.select("label", share(F.col("both"), F.col("pd")).alias("precision"), share(F.col("both"), F.col("gt")).alias("recall"), share(F.col("both"), F.col("gt") + F.col("pd") - F.col("both")).alias("iou"))
    per = per.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    right = F.sum(F.when(F.col("gt_label").eqNullSafe(F.col("pd_label")), F.col("count")).otherwise(0))
    every = cells.agg(share(right, F.sum("count")).alias("accuracy")).crossJoin(per.agg(F.avg("iou").alias("mean_iou")))
    return per.crossJoin(F.broadcast(every)).select("label", "precision", "recall", "f1", "iou", "accuracy", "mean_iou")
