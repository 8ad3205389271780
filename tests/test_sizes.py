"""What one task holds doesn't grow with the input."""

from pyspark.sql import functions as F

from gaugeworks.operators import classification as c
from gaugeworks.operators import detection as d
from gaugeworks.operators import masks, spatial
from gaugeworks.plans import more_queries  # noqa: F401
from gaugeworks.plans.queries import QUERIES
from gaugeworks.sources.shared import spread

SF = "/root/testdata/sf0.001"


def plan_of(frame, kind="executedPlan"):
    return getattr(frame._jdf.queryExecution(), kind)().toString()


def test_tasks_follow_the_rows(spark):
    """Rows are dealt to a number of tasks that grows with them, whatever partitions the session sets."""
    rows = spark.range(30_000).selectExpr("id % 700 AS k", "id")
    sizes = [r["count"] for r in spread(rows, "k", share=500).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 30_000 and len(sizes) > 40 and max(sizes) < 3_000


def test_one_sort_serves_a_matrix(spark):
    data = [(1, "a", ["a", "b"], [0.9, 0.1]), (2, "b", ["a", "b"], [0.9, 0.1]), (2, "b", ["a", "b"], [0.8, 0.2])]
    pairs = c.make_pairs(spark.createDataFrame(data, "uid long, groundtruth string, predictions array<string>, scores array<double>"))
    rows = c.matrix_examples(pairs, [0.5, 0.85, 0.95])
    assert plan_of(rows).count(" Sort [") == 1 and "HashAggregate" not in plan_of(rows), plan_of(rows)
    want = [(0.5, "a", "a", 1, 0.9), (0.5, "b", "a", 2, 0.9), (0.85, "a", "a", 1, 0.9), (0.85, "b", "a", 2, 0.9), (0.95, "a", None, 1, None), (0.95, "b", None, 2, None)]
    assert sorted(map(tuple, rows.collect()), key=repr) == want


def test_no_cell_is_held_as_a_list(spark):
    for name in ("classification_matrix_examples", "detection_matrix_examples"):
        assert "AS examples" not in plan_of(QUERIES[name](spark, SF), "optimizedPlan")


def test_small_boxes_of_a_large_cell_are_not_compared(spark):
    """4,000 small boxes of each side lie in one cell of a large one: each meets the large box, not each other small one there."""
    at = lambda p, of: spark.range(4_001).selectExpr("0L AS datum_uid", f"id AS {of}_id", f"'x' AS {of}_label", *(["0.5D AS pd_score"] if p == "p" else []), *(f"if(id = 4000, 0D, {x} * 8D + 1) AS {p}_{a}min" for a, x in (("x", "(id % 64)"), ("y", "(id div 64)"))), *(f"if(id = 4000, 500D, {x} * 8D + 3) AS {p}_{a}max" for a, x in (("x", "(id % 64)"), ("y", "(id div 64)"))))
    g, p = at("g", "gt"), at("p", "pd")
    a, b = (x.groupBy(*spatial.CELL).agg(F.count("*").alias(n)) for x, n in zip(spatial._cells(g, p), "ab", strict=True))
    assert a.join(b, list(spatial.CELL)).agg(F.sum(F.col("a") * F.col("b"))).first()[0] < 40_000
    assert d.box_pairs(g, p, 0).where("gt_id = pd_id").count() == 4_001
    lone_g, lone_p = spatial.alone(g.where("gt_id < 10"), p.where("pd_id > 7 and pd_id < 4000"))
    assert sorted(r.gt_id for r in lone_g.collect()) == [*range(8)] and lone_p.count() == 3_990


def test_masks_of_a_word_are_counted_by_label(spark):
    """300 masks a side share one word: the first keeps a pixel, labels (a null one too) are what is paired."""
    made = spark.range(300).selectExpr("0L AS uid", "named_struct('label', array('a', 'b', null)[cast(id % 3 AS int)], 'words', array(shiftleft(1L, cast(id % 64 AS int)))) AS m")
    masks_of = made.groupBy("uid").agg(F.lit(8).alias("height"), F.lit(8).alias("width"), F.sort_array(F.collect_list("m")).alias("groundtruths")).withColumn("predictions", F.col("groundtruths"))
    rows = masks.mask_counts(masks_of)
    got = {(r.gt_label, r.pd_label): r["count"] for r in rows.collect()}
    left, want = set(), {}
    for m in masks_of.first().groundtruths:
        bits = m["words"][0] & (1 << 64) - 1
        if bits not in left:
            left.add(bits)
            want[m["label"], m["label"]] = want.get((m["label"], m["label"]), 0) + 1
    assert got == want and sum(got.values()) == 64
    word = spark.range(300).select(F.struct(F.lit("a").alias("label"), F.lit(1).cast("long").alias("bits")).alias("m")).agg(F.collect_list("m").alias("m"))
    assert word.select(F.size(masks._first_wins(F.col("m"))["own"])).first()[0] == 1


def test_runs_of_large_order_keys(spark, tmp_path):
    """Order keys of the largest tables: the ids that order masks exceed a bigint. The shift keeps places, sides and the order of ids."""
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    items.withColumn("l_orderkey", F.col("l_orderkey") + 900 * 60_000).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = [sorted(map(tuple, QUERIES["segmentation_runs"](spark, f).collect()), key=repr) for f in (SF, str(tmp_path))]
    assert rows[0] == rows[1] and len(rows[0]) > 10
