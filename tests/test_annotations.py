"""Nested annotations: checks, kinds, metadata on pairs."""

import pytest
from pyspark.sql import functions as F

from gaugeworks import evaluator as e
from gaugeworks.operators import annotations
from gaugeworks.operators import detection as d
from gaugeworks.sources import cache

BOX = "uid:string,xmin:double,xmax:double,ymin:double,ymax:double,labels:array<string>"
SCHEMA = f"uid string, groundtruths array<struct<{BOX},size:string>>, predictions array<struct<{BOX},scores:array<double>,camera:int>>, split string"


def boxes(spark, truths, predictions, split="train"):
    return spark.createDataFrame([("u", truths, predictions, split)], SCHEMA)


GOOD = ("g", 0.0, 2.0, 0.0, 2.0, ["a"], "small")
TOLD = ("p", 0.0, 2.0, 0.0, 1.0, ["a", "b"], [0.75, 0.25], 7)


def test_metadata_reach_the_pairs(spark):
    data = boxes(spark, [GOOD, ("h", 5.0, 6.0, 5.0, 6.0, ["b"], "large")], [TOLD]).union(boxes(spark, [], [("q", 0.0, 1.0, 0.0, 1.0, ["a"], [0.5], 8)], "test").withColumn("uid", F.lit("v")))
    builder = e.DetectionBuilder.in_memory(spark, {"split": "string"})
    builder.add_data(data)
    pairs = builder.finalize().pairs
    got = {(r.gt_id, r.pd_id, r.pd_label, r.pd_score, r.iou, r.gt_size, r.pd_camera, r.split) for r in pairs.collect()}
    assert got == {("g", "p", "a", 0.75, 0.5, "small", 7, "train"), ("g", "p", "b", 0.25, 0.5, "small", 7, "train"), ("h", None, None, -1.0, 0.0, "large", None, "train"), (None, "q", "a", 0.5, 0.0, None, 8, "test")}
    assert d.info(pairs, "split = 'test'").first().number_of_datums == 1
    part = d.select(pairs, "split = 'train'", "gt_size = 'small'", "pd_camera = 7")
    assert {r.gt_id for r in part.collect()} == {"g"} and part.columns == [c for c in pairs.columns if c not in d.FINAL]


@pytest.mark.parametrize(("truths", "predictions", "message"), [
    ([(*GOOD[:5], ["a", "b"], "x")], [], "one label"), ([(*GOOD[:5], [], "x")], [], "one label"), ([], [(*TOLD[:5], ["a"], [0.5, 0.5], 1)], "score for every label"),
    ([], [(*TOLD[:5], [], [], 1)], "score for every label"), ([("g", 2.0, 0.0, 0.0, 1.0, ["a"], "x")], [], "lesser sides"), ([("g", None, 0.0, 0.0, 1.0, ["a"], "x")], [], "lesser sides"),
])
def test_bad_annotations_raise(spark, truths, predictions, message):
    g, p, _ = annotations.flatten(boxes(spark, truths, predictions))
    with pytest.raises(Exception, match=message):
        (g if truths else p).collect()


def test_polygons_and_masks_are_checked(spark):
    ring = "uid:string,ring:array<array<double>>,holes:array<array<array<double>>>,labels:array<string>"
    schema = f"uid string, groundtruths array<struct<{ring}>>, predictions array<struct<{ring},scores:array<double>>>"
    square = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]
    for bad in ([], [[0.0, 0.0], [1.0, 1.0], [0.0, 0.0]], [[0.0], [1.0], [2.0]], None):
        with pytest.raises(Exception, match="three points"):
            annotations.flatten(spark.createDataFrame([("u", [("g", bad, None, ["a"])], [])], schema))[0].collect()
    builder = e.DetectionBuilder.in_memory(spark)
    builder.add_data(spark.createDataFrame([("u", [("g", square, [[[0.5, 0.5], [1.5, 0.5], [1.5, 1.5], [0.5, 1.5]]], ["a"])], [("p", square, None, ["a"], [0.5])])], schema))
    assert builder.finalize().pairs.first().iou == pytest.approx(3 / 4)
    mask = "uid:string,mask:array<bigint>,labels:array<string>"
    kind = f"uid string, groundtruths array<struct<{mask}>>, predictions array<struct<{mask},scores:array<double>>>"
    with pytest.raises(Exception, match="needs a pixel"):
        annotations.flatten(spark.createDataFrame([("u", [("g", [0, 0], ["a"])], [])], kind))[0].collect()
    mixed = f"uid string, groundtruths array<struct<{mask}>>, predictions array<struct<{ring},scores:array<double>>>"
    both = f"uid string, groundtruths array<struct<{mask},ring:array<array<double>>>>, predictions array<struct<{ring},scores:array<double>>>"
    for schema_ in (mixed, both):
        with pytest.raises(ValueError, match="kind of shape"):
            annotations.flatten(spark.createDataFrame([], schema_))
    other = e.DetectionBuilder.in_memory(spark)
    other.add_data(boxes(spark, [GOOD], [TOLD]))
    with pytest.raises(ValueError, match="kind"):
        other.add_data(spark.createDataFrame([("u", [("g", [1], ["a"])], [])], kind))


def test_sort_override(spark):
    rows = spark.range(200).selectExpr("id % 50 AS a", "id AS b")
    got = cache.global_sort(rows, ["a"], ["b"], lambda f: f.sortWithinPartitions("a", F.desc("b"))).collect()
    assert [r.b for r in got] == sorted(range(200), key=lambda b: (b % 50, -b))
