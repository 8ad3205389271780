"""Greedy matching and box pairs of crowded datums against one fold and all pairs; finalized tables."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks import evaluator as e
from gaugeworks.functions.polygons import polygon_iou
from gaugeworks.operators import detection as d
from gaugeworks.operators import matching, spatial

PAIRS = "datum_uid long, gt_id long, gt_label string, pd_id long, pd_label string, pd_score double, iou double"


def greedy(rows):
    """By plain loops; rows are (datum, gt, pd, score, iou)."""
    out, gone = set(), set()
    for datum, g, p, s, i in sorted(rows, key=lambda r: (-r[3], -r[4], r[1], r[2])):
        if (datum, "g", g) not in gone and (datum, "p", p) not in gone:
            gone |= {(datum, "g", g), (datum, "p", p)}
            out.add((datum, g, p))
    return out


def pair_rows(spark, rows):
    return spark.createDataFrame([(u, g, "x", p, "x", s, i) for u, g, p, s, i in rows], PAIRS)


@pytest.mark.parametrize(("few", "rounds"), [(10**6, 12), (3, 12), (3, 2), (0, 0)])
def test_greedy_matching(spark, few, rounds):
    """Random datums, ties in score and IoU, and a chain in which each pair waits for the one before it."""
    rng = random.Random(4)
    seen = {(rng.randrange(4), rng.randrange(30), rng.randrange(30)) for _ in range(900)}
    score = {(u, p): rng.choice([0.25, 0.5, 0.75, rng.random()]) for u, _, p in seen}
    rows = [(u, g, p, score[u, p], rng.choice([0.5, rng.random()])) for u, g, p in sorted(seen)]
    rows += [(9, k + step, k, 1 - k / 100, 0.9 - 0.1 * step) for k in range(60) for step in (0, 1)]
    rows += [(8, 0, p, 0.5, 0.5) for p in range(50)]  # one box with many rivals
    pairs = pair_rows(spark, rows)
    got = matching.one_to_one(pairs, few, rounds).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == greedy(rows)


def test_matching_of_one_crowded_datum(spark):
    """10^5 pairs of one datum are dealt to many tasks."""
    pairs = spark.range(100_000).selectExpr("0L AS datum_uid", "id % 5000 AS gt_id", "'x' AS gt_label", "cast(id / 20 AS long) AS pd_id", "'x' AS pd_label", "(hash(cast(id / 20 AS long)) & 1048575) / 1048576.0D AS pd_score", "(hash(id, 7) & 1048575) / 1048576.0D AS iou")
    want = greedy([(r.datum_uid, r.gt_id, r.pd_id, r.pd_score, r.iou) for r in pairs.collect()])
    assert {tuple(r) for r in matching.one_to_one(pairs).collect()} == want
    sizes = [r["count"] for r in pairs.repartition(8, "datum_uid", "gt_id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 30_000


def boxes(spark, n, side, rng, datums=3):
    """Boxes of very different sizes, some without area, below zero and null."""
    rows = []
    for k in range(n):
        x, y, w, h = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.0, 1.0, 2.0, 64.0, rng.uniform(0, 9), 2.0 ** rng.randint(-12, 6)]), rng.choice([1.0, rng.uniform(0, 30)])
        x, y = (round(x), round(y)) if rng.random() < 0.3 else (x, y)
        rows.append((rng.randrange(datums), k, rng.choice("ab"), rng.random(), *(map(float, (x, x + w, y, y + h)) if k % 50 else (None,) * 4), f"m{k}"))
    p = side[0]
    return spark.createDataFrame([r if p == "p" else (*r[:3], *r[4:]) for r in rows], f"datum_uid long, {side}_id long, {side}_label string, " + ("pd_score double, " if p == "p" else "") + ", ".join(f"{p}_{c} double" for c in ("xmin", "xmax", "ymin", "ymax")) + f", own_{p} string")


def test_tiles_give_the_pairs_of_all_comparisons(spark):
    rng = random.Random(11)
    g, p = boxes(spark, 300, "gt", rng), boxes(spark, 300, "pd", rng)
    whole, tiles, some = (sorted(map(tuple, d.box_pairs(g, p, few).collect()), key=repr) for few in (10**9, 0, 10_000))
    assert whole == tiles == some and len(whole) > 600
    assert {"own_g", "own_p"} <= set(d.box_pairs(g, p).columns)


def test_tiles_do_not_compare_all(spark):
    """10^5 boxes of one datum on a wide plane: what is compared stays near what meets."""
    side = lambda p, of: spark.range(50_000).selectExpr("0L AS datum_uid", f"id AS {of}_id", f"'x' AS {of}_label", *(["0.5D AS pd_score"] if p == "p" else []), f"(id * 7919 % 50000) * 1.0D AS {p}_xmin", f"(id * 7919 % 50000) + 1.5D AS {p}_xmax", f"(id * 104729 % 50000) * 1.0D AS {p}_ymin", f"(id * 104729 % 50000) + 1.5D AS {p}_ymax")
    rows = d.box_pairs(side("g", "gt"), side("p", "pd"))
    assert rows.where("gt_id = pd_id and iou > 0.99").count() == 50_000
    assert spatial.tiled(side("g", "gt"), side("p", "pd")).count() < 200_000


def test_polygons_with_holes(spark):
    square = lambda x, y, w: [[x, y], [x + w, y], [x + w, y + w], [x, y + w]]
    kinds = "datum_uid long, {0}_id long, {0}_label string, {1}ring array<array<double>>, {1}holes array<array<array<double>>>"
    g = spark.createDataFrame([(0, 0, "x", square(0.0, 0.0, 10.0), [square(2.0, 2.0, 4.0)]), (0, 1, "x", square(20.0, 0.0, 4.0), None), (1, 2, "x", [], []), (2, 3, "x", None, None)], kinds.format("gt", "g_"))
    p = spark.createDataFrame([(0, 0, "x", square(2.0, 2.0, 4.0), []), (0, 1, "x", square(1.0, 1.0, 6.0), [square(2.0, 2.0, 4.0)]), (0, 2, "x", square(21.0, 1.0, 2.0), None), (1, 3, "x", square(0.0, 0.0, 1.0), None)], kinds.format("pd", "p_")).withColumn("pd_score", F.lit(0.5))
    for few in (10**9, 0):
        found = {(r.gt_id, r.pd_id): r.iou for r in d.polygon_pairs(g, p, few).collect()}
        assert found == {(0, 1): pytest.approx(20 / 84), (1, 2): pytest.approx(4 / 16), (None, 0): 0, (2, None): 0, (None, 3): 0, (3, None): 0}


def test_holes_against_a_grid():
    """Rings and holes of any turn against points of a grid."""
    rng = random.Random(3)

    def inside(ring, x, y):
        odd = False
        for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
            odd ^= (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0
        return odd

    for _ in range(12):
        shapes = []
        for _ in range(2):
            cx, cy = rng.uniform(4, 6), rng.uniform(4, 6)
            outer = [(cx + r * c, cy + r * s) for r, (c, s) in zip([rng.uniform(2.5, 4) for _ in range(6)], [(1, 0), (0.5, 0.87), (-0.5, 0.87), (-1, 0), (-0.5, -0.87), (0.5, -0.87)], strict=True)]
            hole = [(cx + 1.2 * c, cy + 1.2 * s) for c, s in [(1, 0), (0, 1), (-1, 0), (0, -1)]]
            shapes.append((outer[:: rng.choice([1, -1])], [hole[:: rng.choice([1, -1])]]))
        (a, ah), (b, bh) = shapes
        n = both = either = 0
        for i in range(100):
            for j in range(100):
                x, y = (i + 0.5) / 10, (j + 0.5) / 10
                p, q = inside(a, x, y) and not inside(ah[0], x, y), inside(b, x, y) and not inside(bh[0], x, y)
                n, both, either = n + 1, both + (p and q), either + (p or q)
        assert polygon_iou(a, b, ah, bh) == pytest.approx(both / either, abs=0.02)


def test_finalized_tables_give_the_same_metrics(spark):
    rng = random.Random(6)
    g, p = boxes(spark, 120, "gt", rng, 6), boxes(spark, 150, "pd", rng, 6)
    pairs = d.box_pairs(g, p)
    done = d.finalize(pairs)
    assert done.columns == [*pairs.columns, *d.FINAL] and done.count() == pairs.count()
    plain = lambda f: sorted(map(repr, f.collect()))
    for metric in (lambda x, **k: d.precision_recall(x, [0.01, 0.5], [0.0, 0.5], **k), lambda x, **k: d.average_precision(x, [0.01, 0.5], **k), lambda x, **k: d.confusion_matrix(x, [0.01, 0.5], [0.0, 0.5], **k), lambda x, **k: d.outcomes(x, [0.01, 0.5], [0.0, 0.5], **k), lambda x, **k: d.examples(x, [0.1], [0.3], **k)):
        assert plain(metric(done)) == plain(metric(pairs))
        assert plain(metric(done, datums="datum_uid < 3")) == plain(metric(pairs, datums="datum_uid < 3"))
    assert plain(d.select(done, groundtruths="gt_label = 'a'")) == plain(d.select(pairs, groundtruths="gt_label = 'a'"))


def test_folder_is_ranked_once_and_read_without_an_exchange(spark, tmp_path):
    rng = random.Random(2)
    g, p = boxes(spark, 60, "gt", rng, 6), boxes(spark, 60, "pd", rng, 6)
    builder = e.DetectionBuilder.persistent(spark, f"{tmp_path}/t")
    builder.add_bounding_boxes(g, p)
    stored = builder.finalize()
    again = e.DetectionEvaluator.load(spark, f"{tmp_path}/t")
    builder = e.DetectionBuilder.in_memory(spark)
    builder.add_bounding_boxes(g, p)
    memory = builder.finalize()
    for f in (lambda x: x.compute_precision_recall([0.1, 0.5], [0.0, 0.5]), lambda x: x.compute_confusion_matrix([0.1], [0.5])):
        assert sorted(map(repr, f(stored))) == sorted(map(repr, f(again))) == sorted(map(repr, f(memory)))
    for query in (d.truths_per_label(again.pairs), d._entities(again.pairs)):
        plan = query._jdf.queryExecution().executedPlan().toString()
        assert "datum_uid" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x), plan
    assert "Window" not in d.precision_recall(again.pairs, [0.5], [0.5])._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(FileExistsError):
        again._filtered(d.base_of(again.pairs), f"{tmp_path}/t")
    part = again.filter("datum_uid < 2", path=f"{tmp_path}/f")
    assert sorted(map(repr, part.compute_confusion_matrix([0.1], [0.5]))) == sorted(map(repr, again.compute_confusion_matrix([0.1], [0.5], "datum_uid < 2")))
    e.DetectionEvaluator.delete(spark, f"{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        e.DetectionEvaluator.load(spark, f"{tmp_path}/t")
