"""Registered queries over the sample tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.operators import classification as c
from gaugeworks.operators import detection as d
from gaugeworks.operators import paging
from gaugeworks.operators import segmentation as s
from gaugeworks.operators import text
from gaugeworks.plans import datasets as data
from gaugeworks.sources.shared import spread

THRESHOLDS, IOUS, SCORES = [0.0, 0.25, 0.5, 0.75], [0.1, 0.5, 0.75], [0.0, 0.5, 0.9]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(n, 9).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


def _values(values: list[float]) -> str:
    return "(VALUES " + ", ".join(f"({v}::DOUBLE)" for v in values) + ")"


def _class_sql(hardmax: bool) -> str:
    live = "abs(pd_score) > 1e-8" + (" AND pd_winner" if hardmax else "")
    return f"""WITH {data.CLASS_CTE}, t AS (SELECT * FROM {_values(THRESHOLDS)} v(score_threshold)),
r AS (SELECT pairs.*, score_threshold, ({live}) AND pd_score >= score_threshold AS s FROM pairs, t),
labels AS (SELECT gt_label AS label FROM pairs UNION SELECT pd_label FROM pairs),
a AS (SELECT pd_label AS label, score_threshold, count(*) FILTER (match AND s) AS tp, count(*) FILTER (NOT match AND s) AS fp,
    count(DISTINCT datum_uid) FILTER (NOT match AND NOT s) AS tn FROM r GROUP BY ALL),
b AS (SELECT gt_label AS label, score_threshold, count(DISTINCT datum_uid) AS fn FROM r WHERE match != s GROUP BY ALL),
z AS (SELECT label, score_threshold, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tn, 0) AS tn
  FROM labels CROSS JOIN t LEFT JOIN a USING (label, score_threshold) LEFT JOIN b USING (label, score_threshold)),
q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM z)
SELECT label, score_threshold, tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(CASE WHEN precision + recall > 1e-9 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1,
  round(sum(tp) OVER (PARTITION BY score_threshold) / (SELECT count(DISTINCT datum_uid) FROM pairs), 9) AS accuracy FROM q"""


@query(_class_sql(True))
def classification_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(c.precision_recall(data.class_pairs(spark, sf_dir), THRESHOLDS))


@query(_class_sql(False))
def classification_precision_recall_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(c.precision_recall(data.class_pairs(spark, sf_dir), THRESHOLDS, hardmax=False))


@query(f"""WITH {data.CLASS_CTE},
n AS (SELECT pd_label AS label, count(*) FILTER (match) AS pos, count(*) AS n, max(pd_score) AS top FROM pairs GROUP BY 1),
g AS (SELECT pd_label AS label, pd_score, count(*) FILTER (match) AS t, count(*) FILTER (NOT match) AS f FROM pairs GROUP BY 1, 2),
k AS (SELECT label, pd_score, sum(t) OVER w AS tp, sum(f) OVER w AS fp FROM g WINDOW w AS (PARTITION BY label ORDER BY pd_score DESC)),
x AS (SELECT label, pd_score, fp / (n - pos)::DOUBLE AS x, tp / pos::DOUBLE AS y FROM k JOIN n USING (label)),
l AS (SELECT label, x, y, lag(x, 1, 0.0) OVER w AS px, lag(y, 1, 0.0) OVER w AS py FROM x WINDOW w AS (PARTITION BY label ORDER BY pd_score DESC))
SELECT label, round(sum((x - px) * (y + py) / 2), 9) AS value FROM l GROUP BY 1""")
def classification_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(c.roc_auc(data.class_pairs(spark, sf_dir)))


@query(f"""WITH {data.CLASS_CTE}, t AS (SELECT * FROM {_values(THRESHOLDS)} v(score_threshold)),
r AS (SELECT pairs.*, score_threshold, abs(pd_score) > 1e-8 AND pd_winner AND pd_score >= score_threshold AS s FROM pairs, t),
u AS (SELECT score_threshold, datum_uid, gt_label FROM r GROUP BY ALL HAVING NOT bool_or(s))
SELECT score_threshold, gt_label, pd_label, count(DISTINCT datum_uid) AS count FROM r WHERE s GROUP BY ALL
UNION ALL SELECT score_threshold, gt_label, NULL, count(*) FROM u GROUP BY ALL""")
def classification_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.confusion_matrix(data.class_pairs(spark, sf_dir), THRESHOLDS)


@query(f"""WITH {data.CLASS_CTE},
r AS (SELECT *, abs(pd_score) > 1e-8 AND pd_winner AND pd_score >= 0.5 AS s FROM pairs),
d AS (SELECT datum_uid, any_value(gt_label) AS gt, max(pd_label) FILTER (s) AS pd FROM r GROUP BY 1)
SELECT datum_uid, 0.5::DOUBLE AS score_threshold, CASE WHEN pd = gt THEN pd ELSE '' END AS true_positives,
  CASE WHEN pd != gt THEN pd ELSE '' END AS false_positives, CASE WHEN pd = gt THEN '' ELSE gt END AS false_negatives FROM d""")
def classification_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = c.examples(data.class_pairs(spark, sf_dir), [0.5])
    return out.select("datum_uid", "score_threshold", *(F.array_join(n, ",").alias(n) for n in ("true_positives", "false_positives", "false_negatives")))


@query(f"""WITH {data.CLASS_CTE}, k AS (SELECT * FROM pairs WHERE priority = '1-URGENT')
SELECT count(*) AS n_rows, count(DISTINCT datum_uid) AS n_datums, round(sum(pd_score), 6) AS score FROM k k1
WHERE gt_label <> 'P' AND EXISTS (SELECT 1 FROM k k2 WHERE k2.datum_uid = k1.datum_uid AND k2.pd_label = k1.pd_label AND k2.pd_score > 0.4)""")
def classification_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = c.select(data.class_pairs(spark, sf_dir), "priority = '1-URGENT'", "gt_label <> 'P'", "pd_score > 0.4")
    return out.agg(F.count("*").alias("n_rows"), F.count_distinct("datum_uid").alias("n_datums"), F.round(F.sum("pd_score"), 6).alias("score"))


@query(f"""WITH {data.CLASS_CTE}, k AS (SELECT DISTINCT datum_uid FROM pairs WHERE pd_score > 0.5 ORDER BY 1 LIMIT 25 OFFSET 100)
SELECT datum_uid, pd_label, round(pd_score, 9) AS pd_score FROM pairs WHERE pd_score > 0.5 AND datum_uid IN (FROM k)""")
def page_over_datums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paging.page(data.class_pairs(spark, sf_dir), "datum_uid", "pd_score > 0.5", limit=25, offset=100)
    return rounded(rows.select("datum_uid", "pd_label", "pd_score"))


@query(f"WITH {data.BOX_CTE} SELECT datum_uid, gt_id, gt_label, pd_id, pd_label, pd_score, round(iou, 9) AS iou FROM pairs")
def detection_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(data.box_pairs(spark, sf_dir))


_HIT = "pd_score > 1e-9 AND gt_id IS NOT NULL AND match AND iou >= iou_threshold AND iou_prev < iou_threshold"
_GRID = f"i AS (SELECT * FROM {_values(IOUS)} v(iou_threshold)), st AS (SELECT * FROM {_values(SCORES)} v(score_threshold))"
_DET_PR = f"""{data.BOX_CTE}, {_GRID},
n AS (SELECT pd_label AS label, iou_threshold, score_threshold, count(*) FILTER ({_HIT}) AS tp, count(*) FILTER (NOT ({_HIT})) AS fp
  FROM ranked, i, st WHERE pd_score > 1e-9 AND pd_score >= score_threshold GROUP BY ALL),
z AS (SELECT label, iou_threshold, score_threshold, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(n_gt, 0) - coalesce(tp, 0) AS fn
  FROM labels CROSS JOIN i CROSS JOIN st LEFT JOIN truths USING (label) LEFT JOIN n USING (label, iou_threshold, score_threshold)),
q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM z)"""


@query(f"""WITH {_DET_PR} SELECT label, iou_threshold, score_threshold, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(CASE WHEN precision + recall > 1e-9 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1 FROM q""")
def detection_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(d.precision_recall(data.box_pairs(spark, sf_dir), IOUS, SCORES))


@query(f"WITH {_DET_PR} SELECT label, score_threshold, round(avg(recall), 9) AS value FROM q GROUP BY ALL")
def detection_average_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(d.average_recall(data.box_pairs(spark, sf_dir), IOUS, SCORES))


_CURVE = f"""{data.BOX_CTE}, {_GRID},
h AS (SELECT *, ({_HIT}) AS hit FROM ranked, i),
w AS (SELECT *, count(*) OVER o AS total, sum(hit::INT) OVER o AS done FROM h
  WINDOW o AS (PARTITION BY iou_threshold, pd_label ORDER BY pd_score DESC, iou DESC, datum_uid, gt_id NULLS FIRST, pd_id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT pd_label AS label, iou_threshold, floor(coalesce(CASE WHEN hit THEN done ELSE 0 END / nullif(n_gt, 0), 0) * 100)::INT AS bin,
    max(CASE WHEN hit THEN done ELSE 0 END / total) AS precision, max(pd_score) AS score
  FROM w LEFT JOIN truths ON pd_label = label GROUP BY ALL),
dense AS (SELECT label, iou_threshold, bin, precision, score FROM labels CROSS JOIN i CROSS JOIN (SELECT unnest(range(101))::INT AS bin) LEFT JOIN b USING (label, iou_threshold, bin)),
curve AS (SELECT label, iou_threshold, bin, coalesce(max(precision) OVER v, 0) AS precision, coalesce(max(score) OVER v, 0) AS score
  FROM dense WINDOW v AS (PARTITION BY label, iou_threshold ORDER BY bin DESC))"""


@query(f"WITH {_CURVE} SELECT label, iou_threshold, bin, round(precision, 9) AS precision, round(score, 9) AS score FROM curve")
def detection_precision_recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(d.precision_recall_curve(data.box_pairs(spark, sf_dir), IOUS))


@query(f"WITH {_CURVE} SELECT label, iou_threshold, round(sum(precision) / 101.0::DOUBLE, 9) AS value FROM curve GROUP BY ALL")
def detection_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(d.average_precision(data.box_pairs(spark, sf_dir), IOUS))


_MATCHED = f"""RECURSIVE {data.BOX_CTE},
o AS (SELECT *, row_number() OVER (PARTITION BY datum_uid ORDER BY -pd_score, -iou, gt_id, pd_id) AS n FROM pairs WHERE gt_id IS NOT NULL AND pd_id IS NOT NULL),
k AS (SELECT DISTINCT datum_uid, 0::BIGINT AS n, []::BIGINT[] AS gs, []::BIGINT[] AS ps FROM o
  UNION ALL SELECT o.datum_uid, o.n, CASE WHEN list_contains(gs, gt_id) OR list_contains(ps, pd_id) THEN gs ELSE list_append(gs, gt_id) END,
    CASE WHEN list_contains(gs, gt_id) OR list_contains(ps, pd_id) THEN ps ELSE list_append(ps, pd_id) END FROM k JOIN o ON o.datum_uid = k.datum_uid AND o.n = k.n + 1),
last AS (SELECT datum_uid, arg_max(gs, n) AS gs, arg_max(ps, n) AS ps FROM k GROUP BY 1),
one AS (SELECT datum_uid, unnest(gs) AS gt_id, unnest(ps) AS pd_id, true AS kept FROM last),
r AS (SELECT pairs.*, iou_threshold, score_threshold, pd_id IS NOT NULL AND pd_score >= score_threshold AND pd_score > 1e-9 AS scored,
    coalesce(kept, false) AND pd_id IS NOT NULL AND pd_score >= score_threshold AND pd_score > 1e-9 AND iou >= iou_threshold AS hit
  FROM pairs LEFT JOIN one USING (datum_uid, gt_id, pd_id), {_values(IOUS)} i(iou_threshold), {_values(SCORES)} s(score_threshold)),
r2 AS (SELECT *, bool_or(hit) OVER (PARTITION BY iou_threshold, score_threshold, datum_uid, gt_id) AS g_hit, bool_or(hit) OVER (PARTITION BY iou_threshold, score_threshold, datum_uid, pd_id) AS p_hit FROM r),
outcomes AS (SELECT iou_threshold, score_threshold, datum_uid, gt_id, pd_id, gt_label, pd_label FROM r2 WHERE hit
  UNION SELECT iou_threshold, score_threshold, datum_uid, NULL, pd_id, NULL, pd_label FROM r2 WHERE pd_id IS NOT NULL AND scored AND NOT p_hit
  UNION SELECT iou_threshold, score_threshold, datum_uid, gt_id, NULL, gt_label, NULL FROM r2 WHERE gt_id IS NOT NULL AND NOT g_hit)"""


@query(f"WITH {_MATCHED} SELECT iou_threshold, score_threshold, gt_label, pd_label, count(*) AS count FROM outcomes GROUP BY ALL")
def detection_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.confusion_matrix(data.box_pairs(spark, sf_dir), IOUS, SCORES)


@query(f"""WITH {_CURVE},
ap AS (SELECT label, iou_threshold AS t, sum(precision) / 101.0::DOUBLE AS v FROM curve GROUP BY ALL),
n AS (SELECT pd_label AS label, iou_threshold, score_threshold, count(*) FILTER ({_HIT}) AS tp FROM ranked, i, st WHERE pd_score >= score_threshold GROUP BY ALL),
ar AS (SELECT label, score_threshold AS t, avg(coalesce(tp / nullif(n_gt, 0), 0)) AS v
  FROM labels CROSS JOIN i CROSS JOIN st LEFT JOIN truths USING (label) LEFT JOIN n USING (label, iou_threshold, score_threshold) GROUP BY ALL),
a AS (SELECT 'AP' AS k, 'IOUs' AS o, * FROM ap UNION ALL SELECT 'AR', 'Scores', * FROM ar)
SELECT k AS metric, label, t AS threshold, round(v, 9) AS value FROM a
UNION ALL SELECT 'm' || k, NULL, t, round(avg(v), 9) FROM a GROUP BY k, t
UNION ALL SELECT k || 'AveragedOver' || o, label, NULL, round(avg(v), 9) FROM a GROUP BY k, o, label
UNION ALL SELECT 'm' || k || 'AveragedOver' || o, NULL, NULL, round(avg(v), 9) FROM a GROUP BY k, o""")
def detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(d.summary(data.box_pairs(spark, sf_dir), IOUS, SCORES))


@query(f"""WITH {data.BOX_CTE},
k AS (SELECT datum_uid, CASE WHEN gt_id % 4 = 0 THEN gt_id END AS gt_id, CASE WHEN gt_id % 4 = 0 THEN gt_label END AS gt_label, CASE WHEN pd_score > 0.3 THEN pd_id END AS pd_id,
  CASE WHEN pd_score > 0.3 THEN pd_label END AS pd_label, CASE WHEN pd_score > 0.3 THEN pd_score ELSE -1 END AS pd_score, iou FROM pairs WHERE datum_uid % 3 <> 1)
SELECT datum_uid, gt_id, gt_label, pd_id, pd_label, pd_score, CASE WHEN gt_id IS NULL OR pd_id IS NULL THEN 0 ELSE round(iou, 9) END AS iou
FROM k WHERE gt_id IS NOT NULL OR pd_id IS NOT NULL""")
def detection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(d.select(data.box_pairs(spark, sf_dir), "datum_uid % 3 <> 1", "gt_id % 4 = 0", "pd_score > 0.3"))


@query(f"""WITH {_MATCHED},
x AS (SELECT *, coalesce(gt_label = pd_label, false) AS same FROM outcomes)
SELECT datum_uid, iou_threshold, score_threshold, coalesce(string_agg(gt_id || ':' || pd_id, ',' ORDER BY gt_id, pd_id) FILTER (same), '') AS true_positives,
  coalesce(string_agg(DISTINCT pd_id::VARCHAR, ',' ORDER BY pd_id::VARCHAR) FILTER (NOT same AND pd_id IS NOT NULL), '') AS false_positives,
  coalesce(string_agg(DISTINCT gt_id::VARCHAR, ',' ORDER BY gt_id::VARCHAR) FILTER (NOT same AND gt_id IS NOT NULL), '') AS false_negatives FROM x GROUP BY ALL""")
def detection_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = d.examples(data.box_pairs(spark, sf_dir), IOUS, SCORES)
    listed = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ",").alias(c)
    both = F.array_join(F.transform("true_positives", lambda x: F.concat_ws(":", x["gt_id"], x["pd_id"])), ",").alias("true_positives")
    return out.select("datum_uid", "iou_threshold", "score_threshold", both, listed("false_positives"), listed("false_negatives"))


@query(f"""WITH {data.BOX_CTE} SELECT (SELECT count(DISTINCT datum_uid) FROM pairs) AS number_of_datums, (SELECT count(*) FROM g) AS number_of_groundtruths,
  (SELECT count(*) FROM p) AS number_of_predictions, (SELECT count(*) FROM pairs) AS number_of_rows, (SELECT count(*) FROM labels) AS number_of_labels""")
def detection_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.info(data.box_pairs(spark, sf_dir))


_SEG = f"""{data.PIXEL_CTE},
cells AS (SELECT gt_label, pd_label, sum(n)::BIGINT AS n FROM counts GROUP BY ALL),
gn AS (SELECT gt_label AS label, sum(n) AS gt FROM cells WHERE gt_label IS NOT NULL GROUP BY 1),
pn AS (SELECT pd_label AS label, sum(n) AS pd FROM cells WHERE pd_label IS NOT NULL GROUP BY 1)"""


@query(f"""WITH {_SEG} SELECT gt_label, pd_label, n AS count,
  round(n / CASE WHEN gt_label IS NULL THEN pd WHEN pd_label IS NULL THEN gt ELSE gt + pd - n END, 9) AS iou
FROM cells LEFT JOIN gn ON gt_label = gn.label LEFT JOIN pn ON pd_label = pn.label WHERE gt_label IS NOT NULL OR pd_label IS NOT NULL""")
def segmentation_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(s.confusion_matrix(data.pixel_counts(spark, sf_dir)))


@query(f"""WITH {_SEG},
k AS (SELECT label, coalesce(gt, 0) AS gt, coalesce(pd, 0) AS pd, coalesce(n, 0) AS b FROM labels LEFT JOIN gn USING (label) LEFT JOIN pn USING (label)
  LEFT JOIN cells ON gt_label = label AND pd_label = label),
q AS (SELECT label, coalesce(b / nullif(pd, 0), 0) AS precision, coalesce(b / nullif(gt, 0), 0) AS recall, coalesce(b / nullif(gt + pd - b, 0), 0) AS iou FROM k)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(CASE WHEN precision + recall > 1e-9 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1, round(iou, 9) AS iou,
  round((SELECT sum(n) FILTER (gt_label IS NOT DISTINCT FROM pd_label) / sum(n) FROM cells), 9) AS accuracy, round(avg(iou) OVER (), 9) AS mean_iou FROM q""")
def segmentation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(s.metrics(data.pixel_counts(spark, sf_dir)))


@query(f"""WITH {data.PIXEL_CTE} SELECT gt_label, pd_label, sum(n)::BIGINT AS count FROM (
  SELECT CASE WHEN gt_label <> 'N' THEN gt_label END AS gt_label, CASE WHEN datum_uid % 2 = 0 THEN pd_label END AS pd_label, n FROM counts) GROUP BY ALL""")
def segmentation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = s.background(data.pixel_counts(spark, sf_dir), "gt_label <> 'N'", "datum_uid % 2 = 0")
    return out.groupBy("gt_label", "pd_label").agg(F.sum("count").alias("count"))


@query("""WITH d AS (SELECT p_partkey AS uid, p_brand || ' ' || p_type AS prediction, unnest([p_type || ' ' || p_brand, p_name]) AS reference, unnest([0, 1]) AS ref FROM part),
t AS (SELECT uid, ref, side, regexp_extract_all(lower(x), '[a-z0-9]+') AS w
  FROM (SELECT uid, ref, 0 AS side, prediction AS x FROM d UNION ALL SELECT uid, ref, 1, reference FROM d)),
g AS (SELECT uid, ref, n, side, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS gram FROM t, (VALUES (1), (2)) v(n)),
c AS (SELECT uid, ref, n, gram, count(*) FILTER (side = 0) AS p, count(*) FILTER (side = 1) AS r FROM g GROUP BY ALL),
s AS (SELECT uid, ref, n, sum(least(p, r)) AS hit, sum(p) AS p, sum(r) AS r FROM c GROUP BY ALL)
SELECT uid, 'rouge' || n AS rouge_type, round(coalesce(max(2 * hit / (p + r)), 0), 9) AS value
FROM (SELECT DISTINCT uid FROM d) CROSS JOIN (VALUES (1), (2)) v(n) LEFT JOIN s USING (uid, n) GROUP BY ALL""")
def text_rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(text.rouge(_texts(spark, sf_dir)))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt out by uid, as the parts of a small file are one task."""
    return spread(data.table(spark, sf_dir, "part"), "p_partkey").selectExpr("p_partkey AS uid", "p_brand || ' ' || p_type AS prediction", "array(p_type || ' ' || p_brand, p_name) AS references")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assistant's turn is a prediction; the turns around it are its references."""
    near = W.partitionBy("conv_id").orderBy("turn")
    rows = data.table(spark, sf_dir, "conversations").withColumns({"last": F.lag("text").over(near), "next": F.lead("text").over(near)})
    return rows.where("role = 'assistant'").selectExpr("conv_id * 1000 + turn AS uid", "text AS prediction", "filter(array(last, next), x -> x is not null) AS references")


_SEQUENCES = r"""
t AS (SELECT conv_id * 1000 + turn AS uid, role, text AS p, lag(text) OVER w AS r1, lead(text) OVER w AS r2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
d AS (SELECT uid, ref, p, r FROM (SELECT uid, p, unnest([1, 2]) AS ref, unnest([r1, r2]) AS r FROM t WHERE role = 'assistant') WHERE r IS NOT NULL),
l AS (SELECT uid, ref, 'rougeL' AS k, 0 AS pl, regexp_extract_all(lower(p), '[a-z0-9]+') AS b, 0 AS rl, regexp_extract_all(lower(r), '[a-z0-9]+') AS a FROM d
  UNION ALL SELECT uid, ref, 'rougeLsum', pl, regexp_extract_all(lower(string_split(p, chr(10))[pl]), '[a-z0-9]+'), rl, regexp_extract_all(lower(string_split(r, chr(10))[rl]), '[a-z0-9]+')
  FROM (SELECT *, unnest(range(1, len(string_split(r, chr(10))) + 1)) AS rl FROM (SELECT *, unnest(range(1, len(string_split(p, chr(10))) + 1)) AS pl FROM d))),
q AS (SELECT row_number() OVER () AS id, * FROM l),
c AS (SELECT id, unnest(range(0, len(b) + 1)) AS j, unnest(list_prepend('', b)) AS y FROM q),
g AS (SELECT id, 0::BIGINT AS i, j, y, 0::BIGINT AS n FROM c
  UNION ALL SELECT id, i, j, y, max(CASE WHEN y = x AND j > 0 THEN up + 1 ELSE n END) OVER (PARTITION BY id ORDER BY j) FROM (
    SELECT g.id, g.i + 1 AS i, g.j, g.y, g.n, lag(g.n, 1, 0) OVER (PARTITION BY g.id ORDER BY g.j) AS up, q.a[g.i + 1] AS x FROM g JOIN q ON g.id = q.id WHERE g.i < len(q.a))),
z AS MATERIALIZED (SELECT id, i, j, y, n FROM g),
w AS (SELECT id, len(a)::BIGINT AS i, len(b)::BIGINT AS j, NULL::BIGINT AS hit FROM q WHERE k = 'rougeLsum'
  UNION ALL SELECT w.id, CASE WHEN q.a[w.i] = q.b[w.j] OR o.n <= u.n THEN w.i - 1 ELSE w.i END, CASE WHEN q.a[w.i] = q.b[w.j] OR o.n > u.n THEN w.j - 1 ELSE w.j END, CASE WHEN q.a[w.i] = q.b[w.j] THEN w.i END
  FROM w JOIN q ON w.id = q.id JOIN z o ON o.id = w.id AND o.i = w.i AND o.j = w.j - 1 JOIN z u ON u.id = w.id AND u.i = w.i - 1 AND u.j = w.j WHERE w.i > 0 AND w.j > 0),
m AS (SELECT uid, ref, rl, word, least(hits, mine) AS hit FROM (SELECT uid, ref, 0 AS rl, word, count(*) AS hits FROM (SELECT DISTINCT uid, ref, rl, hit, a[hit] AS word FROM w JOIN q USING (id) WHERE hit IS NOT NULL) GROUP BY ALL)
  JOIN (SELECT uid, ref, word, count(*) AS mine FROM (SELECT uid, ref, unnest(b) AS word FROM q WHERE k = 'rougeLsum' AND rl = 1) GROUP BY ALL) USING (uid, ref, word)),
s AS (SELECT uid, ref, 'rougeL' AS k, n AS hit, len(a) + len(b) AS t FROM q JOIN z ON q.id = z.id AND z.i = len(a) AND z.j = len(b) WHERE k = 'rougeL'
  UNION ALL SELECT uid, ref, 'rougeLsum', coalesce((SELECT sum(hit) FROM m WHERE m.uid = v.uid AND m.ref = v.ref), 0), t
  FROM (SELECT uid, ref, sum(CASE WHEN rl = 1 THEN len(b) ELSE 0 END) + sum(CASE WHEN pl = 1 THEN len(a) ELSE 0 END) AS t FROM q WHERE k = 'rougeLsum' GROUP BY ALL) v)
SELECT t.uid, k.k AS rouge_type, round(coalesce(max(2 * s.hit / nullif(s.t, 0)), 0), 9) AS value
FROM t CROSS JOIN (VALUES ('rougeL'), ('rougeLsum')) k(k) LEFT JOIN s ON s.uid = t.uid AND s.k = k.k WHERE t.role = 'assistant' GROUP BY ALL"""


@query("WITH RECURSIVE" + _SEQUENCES)
def text_rouge_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(text.rouge_sequences(turns(spark, sf_dir)))


@query("""WITH d AS (SELECT p_partkey AS uid, p_brand || ' ' || p_type AS prediction, [p_type || ' ' || p_brand, p_name] AS refs FROM part),
t AS (SELECT uid, 0 AS side, prediction AS x FROM d UNION ALL SELECT uid, unnest([1, 2]), unnest(refs) FROM d),
w AS (SELECT uid, side, regexp_extract_all(x, '[\\p{L}\\p{N}_]+|\\$[0-9]+|[^\\s\\.]+') AS w FROM t),
g AS (SELECT uid, side, n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS gram FROM w, (VALUES (1), (2)) v(n)),
c AS (SELECT uid, n, gram, side, count(*) AS c FROM g GROUP BY ALL),
m AS (SELECT uid, n, gram, coalesce(max(c) FILTER (side = 0), 0) AS p, coalesce(max(c) FILTER (side > 0), 0) AS r FROM c GROUP BY ALL),
s AS (SELECT uid, sum(least(p, r)) FILTER (n = 1) AS h1, sum(p) FILTER (n = 1) AS a1, coalesce(sum(least(p, r)) FILTER (n = 2), 0) AS h2, greatest(coalesce(sum(p) FILTER (n = 2), 0), 1) AS a2 FROM m GROUP BY 1),
l AS (SELECT p.uid, len(p.w) AS c, arg_min(len(r.w), (abs(len(r.w) - len(p.w)), len(r.w))) AS near FROM w p JOIN w r ON p.uid = r.uid AND p.side = 0 AND r.side > 0 GROUP BY ALL)
SELECT uid, round(CASE WHEN h1 > 0 AND h2 > 0 THEN (CASE WHEN c > near THEN 1 ELSE exp(1 - near / c) END) * exp(0.5 * ln(h1 / a1) + 0.5 * ln(h2 / a2)) ELSE 0 END, 9) AS value FROM l JOIN s USING (uid)""")
def text_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(text.bleu(_texts(spark, sf_dir), (0.5, 0.5)))
