"""Builders and evaluators of the three annotation domains, over DataFrames in the session or a Parquet folder.

A builder takes annotation frames until ``finalize``; an evaluator holds the pair table and the labels, which a filter
keeps. Metrics come as lists of ``Metric``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from gaugeworks import metrics
from gaugeworks.errors import EmptyCacheError
from gaugeworks.metrics import Metric
from gaugeworks.operators import annotations, classification, detection, masks, segmentation
from gaugeworks.sources import store
from gaugeworks.sources.shared import cut

Filter = Column | str | None


class Builder:
    """``add_data`` with annotation frames, as often as needed, then ``finalize`` once."""

    evaluator: type[Evaluator]

    def __init__(self, spark: SparkSession, path: str | None = None, metadata_fields: dict[str, str] | None = None, rows_per_file: int = 100_000, compression: str = "snappy", delete_if_exists: bool = False):
        self.spark, self.path, self.fields, self.frame, self.done = spark, path, metadata_fields or {}, None, False
        self.options = {"rows_per_file": rows_per_file, "compression": compression, "delete_if_exists": delete_if_exists}

    @classmethod
    def in_memory(cls, spark: SparkSession, metadata_fields: dict[str, str] | None = None) -> Builder:
        return cls(spark, None, metadata_fields)

    @classmethod
    def persistent(cls, spark: SparkSession, path: str, metadata_fields: dict[str, str] | None = None, **options) -> Builder:
        return cls(spark, path, metadata_fields, **options)

    def _add(self, pairs: DataFrame) -> None:
        if self.done:
            raise RuntimeError("this builder is finalized")
        self.frame = pairs if self.frame is None else self.frame.unionByName(pairs)

    def finalize(self, index_to_label_override: DataFrame | None = None) -> Evaluator:
        if self.done:
            raise RuntimeError("this builder is finalized")
        frame = None if self.frame is None else self.evaluator.finalized(self.frame)
        if frame is None or frame.isEmpty():
            raise EmptyCacheError
        self.done = True
        if self.path is None:
            return self.evaluator(frame, index_to_label_override, self.fields)
        store.write(frame, self.path, self.fields, **self.options, bucket=self.evaluator.bucket)
        return self.evaluator.load(self.spark, self.path, index_to_label_override)


class Evaluator:
    """The pair table, and the labels that all metrics are given for."""

    bucket: str | None = "datum_uid"  # the column that a folder is bucketed by
    finalized = staticmethod(cut)  # what is done once, before any metric
    refined = staticmethod(lambda pairs: pairs)  # the same of a filter's pairs, which are written already

    def __init__(self, pairs: DataFrame, labels: DataFrame | None = None, metadata_fields: dict[str, str] | None = None, stored: bool = False):
        self.pairs, self.fields, self.stored = pairs, metadata_fields or {}, stored
        self.labels = self._labels_of(pairs) if labels is None else labels

    @classmethod
    def load(cls, spark: SparkSession, path: str, index_to_label_override: DataFrame | None = None) -> Evaluator:
        pairs, fields = store.load(spark, path)
        return cls(pairs, index_to_label_override, fields, True)

    @staticmethod
    def delete(spark: SparkSession, path: str) -> None:
        store.delete(spark, path)

    def _names(self) -> list[str]:
        return sorted(r["label"] for r in self.labels.collect())

    def _filtered(self, pairs: DataFrame, path: str | None) -> Evaluator:
        """With the parent's labels, also those that have no row left."""
        if self.stored and path is None:
            raise ValueError("an evaluator on disk needs a path for what it filters")
        pairs = self.refined(pairs)
        if path is None:
            return type(self)(pairs, self.labels, self.fields)
        store.write(pairs, path, self.fields, bucket=self.bucket)
        return type(self).load(pairs.sparkSession, path, self.labels)

    def iterate_values(self, columns: Sequence[str], datums: Filter = None) -> DataFrame:
        return (self.pairs if datums is None else self.pairs.where(datums)).select(*columns)

    def get_info(self, **filters: Filter) -> dict:
        return self._info(self.pairs, **filters).first().asDict() | {"metadata_fields": self.fields}

    @property
    def info(self) -> dict:
        return self.get_info()


class ClassificationEvaluator(Evaluator):
    _labels_of, _info = staticmethod(classification.labels_of), staticmethod(classification.info)

    def filter(self, datums: Filter = None, groundtruths: Filter = None, predictions: Filter = None, path: str | None = None) -> Evaluator:
        return self._filtered(classification.select(self.pairs, datums, groundtruths, predictions), path)

    def compute_precision_recall(self, score_thresholds: Sequence[float] = (0.0,), hardmax: bool = True, datums: Filter = None) -> list[Metric]:
        return metrics.classification_counts(classification.precision_recall(self.pairs, score_thresholds, hardmax, datums, self.labels), hardmax)

    def compute_rocauc(self) -> list[Metric]:
        return metrics.classification_roc_auc(classification.roc_auc(self.pairs, self.labels))

    def compute_confusion_matrix(self, score_thresholds: Sequence[float] = (0.0,), hardmax: bool = True, datums: Filter = None, examples: bool = False, most: int | None = None) -> list[Metric]:
        return metrics.classification_matrix(classification.confusion_matrix(self.pairs, score_thresholds, hardmax, datums, examples, most), self._names(), hardmax)

    def compute_confusion_matrix_with_examples(self, score_thresholds: Sequence[float] = (0.0,), hardmax: bool = True, datums: Filter = None, most: int | None = None) -> list[Metric]:
        """``most``: examples of a cell, the least datums; None: all."""
        return self.compute_confusion_matrix(score_thresholds, hardmax, datums, True, most)

    def iterate_examples(self, score_thresholds: Sequence[float] = (0.0,), hardmax: bool = True, datums: Filter = None, most: int | None = None) -> DataFrame:
        """The matrix's examples as rows, for cells of any size."""
        return classification.matrix_examples(self.pairs, score_thresholds, hardmax, datums, most)

    def compute_examples(self, score_thresholds: Sequence[float] = (0.0,), hardmax: bool = True, datums: Filter = None, limit: int | None = None, offset: int = 0) -> list[Metric]:
        return metrics.classification_examples(classification.examples(self.pairs, score_thresholds, hardmax, datums, limit, offset), hardmax)


class ClassificationBuilder(Builder):
    evaluator = ClassificationEvaluator

    def add_data(self, data: DataFrame) -> None:
        """``uid, groundtruth, predictions, scores`` and metadata columns."""
        self._add(classification.make_pairs(data))


class DetectionEvaluator(Evaluator):
    """Its table is ranked and matched when it is finalized, and once more when a filter makes another one."""

    @staticmethod
    def finalized(pairs: DataFrame) -> DataFrame:
        return cut(detection.finalize(pairs))

    refined = finalized
    _labels_of, _info = staticmethod(detection.labels_of), staticmethod(detection.info)

    def filter(self, datums: Filter = None, groundtruths: Filter = None, predictions: Filter = None, path: str | None = None) -> Evaluator:
        return self._filtered(detection.select(self.pairs, datums, groundtruths, predictions), path)

    def compute_precision_recall(self, iou_thresholds: Sequence[float], score_thresholds: Sequence[float], datums: Filter = None) -> list[Metric]:
        grid = self.pairs, iou_thresholds, score_thresholds
        out = metrics.detection_counts(detection.precision_recall(*grid, datums, self.labels))
        out += metrics.detection_summary(detection.summary(*grid, datums, self.labels), list(iou_thresholds), list(score_thresholds))
        return out + metrics.detection_curve(detection.precision_recall_curve(self.pairs, iou_thresholds, datums, self.labels))

    def compute_confusion_matrix(self, iou_thresholds: Sequence[float], score_thresholds: Sequence[float], datums: Filter = None, examples: bool = False, most: int | None = None) -> list[Metric]:
        return metrics.detection_matrix(detection.confusion_matrix(self.pairs, iou_thresholds, score_thresholds, datums, examples, most), self._names())

    def compute_confusion_matrix_with_examples(self, iou_thresholds: Sequence[float], score_thresholds: Sequence[float], datums: Filter = None, most: int | None = None) -> list[Metric]:
        """``most``: examples of a cell, the least by datum and ids; None: all."""
        return self.compute_confusion_matrix(iou_thresholds, score_thresholds, datums, True, most)

    def iterate_examples(self, iou_thresholds: Sequence[float], score_thresholds: Sequence[float], datums: Filter = None, most: int | None = None) -> DataFrame:
        """The matrix's examples as rows, for cells of any size."""
        return detection.matrix_examples(self.pairs, iou_thresholds, score_thresholds, datums, most)

    def compute_examples(self, iou_thresholds: Sequence[float], score_thresholds: Sequence[float], datums: Filter = None, limit: int | None = None, offset: int = 0) -> list[Metric]:
        return metrics.detection_examples(detection.examples(self.pairs, iou_thresholds, score_thresholds, datums, limit, offset))


class DetectionBuilder(Builder):
    """All annotations of a builder have one kind of shape."""

    evaluator, kind = DetectionEvaluator, None

    def _of(self, kind: str) -> None:
        if self.kind not in (None, kind):
            raise ValueError(f"this builder holds shapes of kind {self.kind}, not {kind}")
        self.kind = kind

    def add_data(self, data: DataFrame) -> None:
        """Nested annotations, as ``annotations.flatten`` takes them."""
        truths, predictions, kind = annotations.flatten(data)
        {"box": self.add_bounding_boxes, "mask": self.add_bitmasks, "polygon": self.add_polygons}[kind](truths, predictions)

    def add_bounding_boxes(self, truths: DataFrame, predictions: DataFrame) -> None:
        self._of("box")
        self._add(detection.box_pairs(truths, predictions))

    def add_bitmasks(self, truths: DataFrame, predictions: DataFrame) -> None:
        self._of("mask")
        self._add(detection.mask_pairs(truths, predictions))

    def add_polygons(self, truths: DataFrame, predictions: DataFrame) -> None:
        self._of("polygon")
        self._add(detection.polygon_pairs(truths, predictions))


class SegmentationEvaluator(Evaluator):
    _info = staticmethod(segmentation.info)

    @staticmethod
    def _labels_of(counts: DataFrame) -> DataFrame:
        return counts.selectExpr("explode(array(gt_label, pd_label)) AS label").where("label is not null").distinct()

    def filter(self, datums: Filter = None, groundtruths: Filter = None, predictions: Filter = None, path: str | None = None) -> Evaluator:
        return self._filtered(segmentation.select(self.pairs, datums, groundtruths, predictions), path)

    def compute_precision_recall_iou(self, datums: Filter = None) -> list[Metric]:
        return metrics.segmentation(segmentation.metrics(self.pairs, datums, self.labels), segmentation.confusion_matrix(self.pairs, datums))


class SegmentationBuilder(Builder):
    evaluator = SegmentationEvaluator

    def add_data(self, data: DataFrame) -> None:
        """``uid, height, width, groundtruths, predictions`` with masks as in ``masks.word_rows``."""
        self._add(masks.mask_counts(data))
