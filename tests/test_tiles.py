"""Tiles of crowded datums: small tiles and blocks give all pairs, boxes are dealt about once, matching needs no pairs."""

import random

import pytest
from pyspark.sql import functions as F
from test_crowded import boxes

from gaugeworks.operators import detection as d
from gaugeworks.operators import tiles
from gaugeworks.plans.crowded import planes

SF = "/root/testdata/sf0.001"


def plain(frame):
    return sorted(map(repr, frame.collect()))


@pytest.mark.parametrize(("side", "most"), [(20, 6), (3000, 40)])
def test_small_tiles_and_blocks(spark, monkeypatch, side, most):
    rng = random.Random(5)
    g, p = boxes(spark, 300, "gt", rng, 2), boxes(spark, 300, "pd", rng, 2)
    whole = plain(d.box_pairs(g, p, 10**9))
    monkeypatch.setattr(tiles, "SIDE", side)
    monkeypatch.setattr(tiles, "MOST", most)
    assert plain(d.box_pairs(g, p, 0)) == whole and len(whole) > 600


def test_boxes_are_shuffled_about_once(spark):
    g, p = planes(spark, SF)
    plan = tiles.crowded(g, p, 0)
    rows = tiles._dealt(g, p, plan, tiles.MOST)
    assert rows.count() < 1.5 * (g.count() + p.count())
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("RepartitionByExpression") == 1, text
