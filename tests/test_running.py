"""Running sums by ranges against one window by key."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.operators.paging import page
from gaugeworks.operators.running import running_sums

SCORES = [0.0, -1.0, 5e-324, 1e-300, 1e-9, 0.25, 0.5, 1 - 2**-53, 1 - 1e-9, 1.0, 1.5, float("inf"), None]


def totals(frame, w):
    return frame.select("k", "id", F.count("*").over(w).alias("rows"), F.sum("n").over(w).alias("sum"), F.when(F.col("k") == "a", 11).alias("fact"))


def by_id(frame):
    return sorted(map(tuple, frame.select("k", "id", "rows", "sum", "fact").collect()), key=lambda r: r[1])


@pytest.mark.parametrize("scores", ["mixed", "logits", "constant"])
def test_running_sums_equal_one_window(spark, scores):
    """Scores of any range, and one score for all rows: no task gets more than a few times its share."""
    rng = random.Random(7)
    draw = {"mixed": lambda: rng.choice(SCORES) if rng.random() < 0.3 else rng.random(), "logits": lambda: rng.gauss(40, 30), "constant": lambda: 0.5}[scores]
    rows = [(rng.choice("abbbbb"), draw(), i, rng.randrange(3)) for i in range(3000)]
    data = spark.createDataFrame(rows, "k string, s double, id long, n long")
    order = [F.desc("s"), F.asc("id")]
    facts = spark.createDataFrame([("a", 11)], "k string, fact long")
    got = running_sums(data, ["k"], order, {"rows": F.lit(1), "sum": F.col("n")}, [facts])
    assert by_id(got) == by_id(totals(data, W.partitionBy("k").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    ranges = data.repartitionByRange(4, "k", *order).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in ranges) < 2 * 3000 / 4


def test_running_sums_of_no_rows_and_null_keys(spark):
    data = spark.createDataFrame([(None, 0.5)], "k string, s double")
    assert running_sums(data, ["k"], [F.desc("s")], {"rows": F.lit(1)}).count() == 0
    assert running_sums(data.limit(0), ["k"], [F.desc("s")], {"rows": F.lit(1)}).count() == 0


@pytest.mark.parametrize("few", [0, 10_000])
def test_pages_hold_the_keys_behind_the_offset(spark, few):
    rows = spark.createDataFrame([(k, i) for k in [None, "a", "b", "c", "d"] for i in range(2)], "k string, i long")

    def keys(limit, offset):
        return sorted((r.k or "", r.i) for r in page(rows, "k", None, limit, offset, few).collect())

    assert keys(None, 0) == sorted((k, i) for k in ["", "a", "b", "c", "d"] for i in range(2))
    assert keys(None, 1) == [(k, i) for k in "bcd" for i in range(2)]
    assert keys(2, 1) == [(k, i) for k in "bc" for i in range(2)]
    assert keys(None, 9) == keys(2, 9) == []


def test_deep_pages_equal_sorted_keys(spark):
    rng = random.Random(5)
    keys = [rng.randrange(10**6) for _ in range(3000)]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    order = sorted(set(keys))
    for limit, offset in ((None, 1), (None, 1500), (700, 0), (700, 900), (1, 2000), (5000, 2900), (10, 99_999), (None, 99_999)):
        want = set(order[offset : None if limit is None else offset + limit])
        got = page(rows, "k", None, limit, offset, 0).collect()
        assert sorted(r.i for r in got) == [i for i, k in enumerate(keys) if k in want]
