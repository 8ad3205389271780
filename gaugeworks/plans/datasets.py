"""Annotation tables made from the sample tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import classification, detection, segmentation


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(table(spark, sf_dir, "orders"))


def pairs_of(orders: DataFrame) -> DataFrame:
    """An order is a datum; its status the truth; three labels are predicted with scores made from the keys."""
    orders = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    labels = ["F", "O", "P"]

    def score(k: int):
        base = F.col("o_orderkey") * 31 + F.col("o_custkey") * 17 + k * 619 + (F.col("o_orderkey") % (k + 2)) * 211
        return ((base % 1000) / 1000.0 + F.when(F.col("o_orderstatus") == labels[k], 0.5).otherwise(0.0)) / 1.5

    data = orders.select(F.col("o_orderkey").alias("uid"), F.col("o_orderstatus").alias("groundtruth"), F.array(*map(F.lit, labels)).alias("predictions"), F.array(*map(score, range(3))).alias("scores"), F.col("o_orderpriority").alias("priority"))
    return classification.make_pairs(data)


CLASS_CTE = """
raw AS (SELECT o_orderkey AS datum_uid, o_orderstatus AS gt_label, o_orderpriority AS priority, k, ['F','O','P'][k + 1] AS pd_label,
    ((o_orderkey * 31 + o_custkey * 17 + k * 619 + (o_orderkey % (k + 2)) * 211) % 1000 / 1000.0::DOUBLE
      + CASE WHEN o_orderstatus = ['F','O','P'][k + 1] THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / 1.5::DOUBLE AS pd_score
  FROM orders, (VALUES (0), (1), (2)) v(k)),
pairs AS (SELECT datum_uid, gt_label, pd_label, pd_score, priority, gt_label = pd_label AS match,
    row_number() OVER (PARTITION BY datum_uid ORDER BY pd_score DESC, k) = 1 AS pd_winner FROM raw)"""


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Eight events are a datum; even ones are ground truths and each odd one a prediction near the one before."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    base = events.select(F.floor(F.col("event_id") / 8).alias("datum_uid"), "event_id", "k", "event_type", ((F.col("user_id") * 7) % 50).cast("double").alias("x"), (F.col("k") % 50).cast("double").alias("y"), (10 + F.col("event_id") % 7).cast("double").alias("w"), (10 + F.col("event_id") % 5).cast("double").alias("h"))
    even = base.where("event_id % 2 = 0")
    truths = even.selectExpr("datum_uid", "event_id AS gt_id", "event_type AS gt_label", "x AS g_xmin", "x + w AS g_xmax", "y AS g_ymin", "y + h AS g_ymax")
    odd = base.where("event_id % 2 = 1").selectExpr("event_id AS pd_id", "event_id - 1 AS of", "k AS pk", "event_type AS own")
    near = odd.join(even, odd["of"] == even["event_id"]).selectExpr(
        "datum_uid", "pd_id", "if(pk % 4 = 0, own, event_type) AS pd_label", "((pd_id * 37) % 1000) / 1000.0D AS pd_score",
        "x + floor(pd_id / 8) % 4 AS l", "y + pk % 4 AS t", "w", "h + pk % 3 AS hh",
    )
    predictions = near.selectExpr("datum_uid", "pd_id", "pd_label", "pd_score", "l AS p_xmin", "l + w AS p_xmax", "t AS p_ymin", "t + hh AS p_ymax")
    return truths, predictions


def box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.box_pairs(*boxes(spark, sf_dir))


BOX_CTE = """
e AS (SELECT event_id // 8 AS datum_uid, event_id, CAST(props->>'$.k' AS BIGINT) AS k, event_type, ((user_id * 7) % 50)::DOUBLE AS x,
    (CAST(props->>'$.k' AS BIGINT) % 50)::DOUBLE AS y, (10 + event_id % 7)::DOUBLE AS w, (10 + event_id % 5)::DOUBLE AS h FROM events),
g AS (SELECT datum_uid, event_id AS gt_id, event_type AS gt_label, x AS gx0, x + w AS gx1, y AS gy0, y + h AS gy1 FROM e WHERE event_id % 2 = 0),
p0 AS (SELECT b.datum_uid, a.event_id AS pd_id, CASE WHEN a.k % 4 = 0 THEN a.event_type ELSE b.event_type END AS pd_label,
    (a.event_id * 37 % 1000)::DOUBLE / 1000.0::DOUBLE AS pd_score, b.x + (a.event_id // 8) % 4 AS l, b.y + a.k % 4 AS t, b.w, b.h + a.k % 3 AS hh
  FROM e a JOIN e b ON a.event_id - 1 = b.event_id WHERE a.event_id % 2 = 1),
p AS (SELECT datum_uid, pd_id, pd_label, pd_score, l AS px0, l + w AS px1, t AS py0, t + hh AS py1 FROM p0),
gp AS (SELECT g.datum_uid, gt_id, gt_label, pd_id, pd_label, pd_score,
    greatest(0.0::DOUBLE, least(gx1, px1) - greatest(gx0, px0)) * greatest(0.0::DOUBLE, least(gy1, py1) - greatest(gy0, py0)) AS inter,
    (gx1 - gx0) * (gy1 - gy0) + (px1 - px0) * (py1 - py0) AS areas FROM g JOIN p USING (datum_uid)),
m AS (SELECT datum_uid, gt_id, gt_label, pd_id, pd_label, pd_score, inter / (areas - inter) AS iou FROM gp WHERE inter / (areas - inter) >= 1e-9),
pairs AS (SELECT * FROM m
  UNION ALL SELECT datum_uid, gt_id, gt_label, NULL, NULL, -1.0, 0.0 FROM g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.gt_id = g.gt_id AND m.datum_uid = g.datum_uid)
  UNION ALL SELECT datum_uid, NULL, NULL, pd_id, pd_label, pd_score, 0.0 FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.pd_id = p.pd_id AND m.datum_uid = p.datum_uid)),
fit AS (SELECT *, coalesce(gt_label = pd_label, false) AS match FROM pairs WHERE pd_id IS NOT NULL),
fit2 AS (SELECT *, bool_or(match) OVER (PARTITION BY datum_uid, pd_id) AS fits FROM fit),
fit3 AS (SELECT *, row_number() OVER (PARTITION BY datum_uid, pd_id, pd_label ORDER BY pd_score DESC, iou DESC, gt_id NULLS FIRST, pd_id) AS turn FROM fit2 WHERE match OR NOT fits),
fit4 AS (SELECT *, max(iou) OVER (PARTITION BY datum_uid, gt_id, gt_label, match ORDER BY pd_score DESC, iou DESC, gt_id NULLS FIRST, pd_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM fit3 WHERE turn = 1),
ranked AS (SELECT *, CASE WHEN NOT match THEN 2.0 WHEN most IS NULL THEN 0.0 WHEN iou > most THEN most ELSE 2.0 END AS iou_prev FROM fit4),
labels AS (SELECT gt_label AS label FROM g UNION SELECT pd_label FROM p),
truths AS (SELECT gt_label AS label, count(*) AS n_gt FROM g GROUP BY 1)"""


def pixel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier is a datum, its line items are pixels."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_partkey", "l_quantity")
    return segmentation.pixel_counts(items.selectExpr(
        "l_suppkey AS datum_uid", "if(l_partkey % 11 = 0, null, l_returnflag) AS gt_label",
        "CASE l_partkey % 4 WHEN 0 THEN null WHEN 1 THEN 'A' WHEN 2 THEN l_returnflag ELSE 'N' END AS pd_label",
    ))


PIXEL_CTE = """
pixels AS (SELECT l_suppkey AS datum_uid, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_returnflag END AS gt_label,
    CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'A' WHEN 2 THEN l_returnflag ELSE 'N' END AS pd_label FROM lineitem),
counts AS (SELECT datum_uid, gt_label, pd_label, count(*) AS n FROM pixels GROUP BY ALL),
labels AS (SELECT gt_label AS label FROM counts WHERE gt_label IS NOT NULL UNION SELECT pd_label FROM counts WHERE pd_label IS NOT NULL)"""
