import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.errors import EmptyCacheError
from gaugeworks.functions.geometry import box_iou, mask_iou
from gaugeworks.operators import classification as c
from gaugeworks.operators import detection as d
from gaugeworks.operators import paging
from gaugeworks.sources import store

LABELS = ["ash", "beech", "cedar", "elm"]


def drawn():
    """Scores drawn at random, some of them equal or zero; elm is never right and oak never asked for."""
    rng = random.Random(12)
    rows = []
    for i in range(40):
        scores = [rng.choice([0.0, 0.25, 0.5, rng.random()]) for _ in LABELS]
        rows.append((f"t{i}", "oak" if i % 10 == 0 else rng.choice(LABELS[:3]), LABELS, scores, i))
    return rows


@pytest.fixture
def trees(spark):
    return c.make_pairs(spark.createDataFrame(drawn(), "uid string, groundtruth string, predictions array<string>, scores array<double>, n int"))


def test_roc(trees):
    """Against the share of ordered pairs of a right and a wrong row, ties counting half."""
    want = {"oak": 0.0}
    for k, label in enumerate(LABELS):
        right = [r[3][k] for r in drawn() if r[1] == label]
        wrong = [r[3][k] for r in drawn() if r[1] != label]
        want[label] = sum((x > y) + 0.5 * (x == y) for x in right for y in wrong) / (len(right) * len(wrong)) if right else 0.0
    assert {r.label: r.value for r in c.roc_auc(trees).collect()} == pytest.approx(want)
    assert c.mean_roc_auc(trees).first().value == pytest.approx(sum(want.values()) / 5)


def test_winner_is_first_of_ties(trees):
    winners = {r.datum_uid: r.pd_label for r in trees.where("pd_winner").collect()}
    assert winners == {r[0]: LABELS[r[3].index(max(r[3]))] for r in drawn()} and sum(r[3].count(max(r[3])) > 1 for r in drawn()) > 2


def test_counts_brute(trees):
    rows = trees.collect()
    for hardmax in (True, False):
        got = {(r.label, r.score_threshold): (r.tp, r.fp, r.fn, r.tn) for r in c.counts(trees, [0.0, 0.3, 0.9], hardmax).collect()}
        for (label, t), have in got.items():
            s = [r.pd_score > 1e-8 and r.pd_score >= t and (r.pd_winner or not hardmax) for r in rows]
            tp = sum(x and r.match and r.pd_label == label for x, r in zip(s, rows))
            fp = sum(x and not r.match and r.pd_label == label for x, r in zip(s, rows))
            fn = len({r.datum_uid for x, r in zip(s, rows) if r.gt_label == label and x != r.match})
            tn = len({r.datum_uid for x, r in zip(s, rows) if r.pd_label == label and not x and not r.match})
            assert have == (tp, fp, fn, tn)


def test_empty_thresholds_and_filters(trees):
    with pytest.raises(ValueError):
        c.counts(trees, [])
    with pytest.raises(EmptyCacheError):
        c.select(trees, "n > 100")


def test_no_predictions(spark):
    bad = spark.createDataFrame([("a", "x", [], [])], "uid string, groundtruth string, predictions array<string>, scores array<double>")
    with pytest.raises(Exception, match="needs predictions"):
        c.make_pairs(bad).collect()


def test_iou(spark):
    row = spark.createDataFrame([(0.0, 2.0, 0.0, 2.0, 1.0, 3.0, 0.0, 2.0, [0b1111], [0b0011])], "axmin double, axmax double, aymin double, aymax double, bxmin double, bxmax double, bymin double, bymax double, m array<bigint>, n array<bigint>")
    assert row.select(box_iou("a", "b").alias("x"), mask_iou(F.col("m"), F.col("n")).alias("y")).first() == pytest.approx((1 / 3, 0.5))


def test_iou_boundary(spark):
    """Ranked rows keep what the IoU was before them."""
    rows = [(0, 0, "a", 0, "a", 0.9, 0.1), (0, 0, "a", 1, "a", 0.8, 0.5), (0, 0, "a", 2, "a", 0.7, 0.4), (0, 0, "a", 3, "b", 0.6, 0.9)]
    pairs = spark.createDataFrame(rows, "datum_uid int, gt_id bigint, gt_label string, pd_id bigint, pd_label string, pd_score double, iou double")
    assert {r.pd_id: r.iou_prev for r in d.rank(pairs).collect()} == {0: 0.0, 1: 0.1, 2: 2.0, 3: 2.0}
    cells = {(r.gt_label, r.pd_label): r["count"] for r in d.confusion_matrix(pairs, [0.05], [0.5]).collect()}
    assert cells == {("a", "a"): 1, (None, "a"): 2, (None, "b"): 1}
    (row,) = d.examples(pairs, [0.05], [0.5]).collect()
    with pytest.raises(EmptyCacheError):
        d.select(pairs, "datum_uid = 5")
    assert ([tuple(x) for x in row.true_positives], row.false_positives, row.false_negatives) == ([(0, 0)], [1, 2, 3], [])


def test_page(spark):
    rows = spark.range(60).selectExpr("id AS i", "(id * 7) % 13 AS k")
    assert {r.k for r in paging.page(rows, "k", "k <> 5", limit=4, offset=3).collect()} == {3, 4, 6, 7}
    assert paging.page(rows, "k", limit=0).count() == 60


def test_store(spark, trees, tmp_path):
    path = str(tmp_path / "pairs")
    with pytest.raises(FileNotFoundError):
        store.load(spark, path)
    store.write(trees, path, {"n": "int"})
    back, fields = store.load(spark, path)
    assert fields == {"n": "int"} and sorted(back.collect()) == sorted(trees.collect())
    store.delete(spark, path)
    store.delete(spark, path)
