"""More registered queries: filters and pages, evaluators, masks and polygons, tables, streams and judged text."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks import evaluator as e
from gaugeworks.functions.geometry import mask_iou
from gaugeworks.operators import classification as c
from gaugeworks.operators import detection as d
from gaugeworks.operators import judged, masks
from gaugeworks.operators import segmentation as s
from gaugeworks.operators import text
from gaugeworks.operators.paging import page
from gaugeworks.operators.running import running_sums
from gaugeworks.plans import datasets as data
from gaugeworks.plans.queries import IOUS, ORACLE_SQL, SCORES, THRESHOLDS, _class_sql, _values, query, rounded, turns
from gaugeworks.plans.stand_in import RuleClient
from gaugeworks.sources import cache
from gaugeworks.sources.shared import checkpoint_folder
from gaugeworks.streaming import counts as streaming
from gaugeworks.streaming import datums

URGENT = "priority = '1-URGENT'"


@query(f"SELECT round(avg(value), 6) AS value FROM ({ORACLE_SQL['classification_roc_auc']})")
def classification_mean_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.mean_roc_auc(data.class_pairs(spark, sf_dir)).select(F.round("value", 6).alias("value"))


@query(f"""WITH {data.CLASS_CTE} SELECT count(DISTINCT datum_uid) FILTER ({URGENT}) AS number_of_datums,
  (SELECT count(*) FROM (SELECT gt_label FROM pairs UNION SELECT pd_label FROM pairs)) AS number_of_labels, count(*) AS number_of_rows FROM pairs""")
def classification_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.info(data.class_pairs(spark, sf_dir), URGENT)


@query(_class_sql(True).replace("FROM pairs, t)", f"FROM pairs, t WHERE {URGENT})", 1))
def classification_of_some_datums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(c.precision_recall(data.class_pairs(spark, sf_dir), THRESHOLDS, datums=URGENT))


def _with_counts(rows: DataFrame, matrix: DataFrame, *thresholds: str) -> DataFrame:
    """Examples, each with the ``count`` of its cell; the matrix has a row for each cell."""
    a, b = rows.alias("a"), F.broadcast(matrix).alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in (*thresholds, "gt_label", "pd_label")))
    return a.join(b, same).select("a.*", "b.count")


@query(f"""WITH {data.CLASS_CTE}, t AS (SELECT * FROM {_values(THRESHOLDS)} v(score_threshold)),
r AS (SELECT pairs.*, score_threshold, abs(pd_score) > 1e-8 AND pd_winner AND pd_score >= score_threshold AS s FROM pairs, t),
x AS (SELECT score_threshold, gt_label, pd_label, datum_uid, max(pd_score) AS score FROM r WHERE s GROUP BY ALL
  UNION ALL SELECT score_threshold, gt_label, NULL, datum_uid, NULL FROM r GROUP BY score_threshold, gt_label, datum_uid HAVING NOT bool_or(s))
SELECT score_threshold, gt_label, pd_label, datum_uid, round(score, 9) AS score, count(*) OVER (PARTITION BY score_threshold, gt_label, pd_label) AS count FROM x""")
def classification_matrix_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each example; no cell is held as a list."""
    pairs = data.class_pairs(spark, sf_dir)
    return rounded(_with_counts(c.matrix_examples(pairs, THRESHOLDS), c.confusion_matrix(pairs, THRESHOLDS), "score_threshold"))


@query(f"SELECT * EXCLUDE (place, count) FROM (SELECT *, row_number() OVER (PARTITION BY score_threshold, gt_label, pd_label ORDER BY datum_uid) AS place FROM ({ORACLE_SQL['classification_matrix_examples']})) WHERE place <= 5")
def classification_matrix_some_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five least datums of each cell."""
    return rounded(c.matrix_examples(data.class_pairs(spark, sf_dir), THRESHOLDS, most=5))


@query(f"SELECT * FROM ({ORACLE_SQL['classification_matrix_examples']}) WHERE datum_uid IN (SELECT o_orderkey FROM orders ORDER BY 1 OFFSET (SELECT count(*) // 2 FROM orders))")
def classification_examples_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All behind the first half of the datums."""
    pairs = data.class_pairs(spark, sf_dir)
    half = data.table(spark, sf_dir, "orders").count() // 2
    rows = c.matrix_examples(page(pairs, "datum_uid", None, None, half, 0), THRESHOLDS)
    return rounded(_with_counts(rows, c.confusion_matrix(pairs, THRESHOLDS), "score_threshold"))


@query(f"SELECT * FROM ({ORACLE_SQL['classification_examples']}) WHERE datum_uid IN (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 20 OFFSET 7)")
def classification_examples_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = c.examples(data.class_pairs(spark, sf_dir), [0.5], limit=20, offset=7)
    return out.select("datum_uid", "score_threshold", *(F.array_join(n, ",").alias(n) for n in ("true_positives", "false_positives", "false_negatives")))


@query(f"""WITH z AS ({_class_sql(True)})
SELECT 'Precision' AS type, label, score_threshold, precision AS value FROM z UNION ALL SELECT 'Recall', label, score_threshold, recall FROM z
UNION ALL SELECT 'F1', label, score_threshold, f1 FROM z UNION ALL SELECT DISTINCT 'Accuracy', NULL, score_threshold, accuracy FROM z""")
def classification_evaluator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of an evaluator as rows; there are as many as labels and thresholds."""
    found = e.ClassificationEvaluator(data.class_pairs(spark, sf_dir)).compute_precision_recall(THRESHOLDS)
    rows = [(m.type, m.parameters.get("label"), m.parameters["score_threshold"], m.value) for m in found if m.type != "Counts"]
    return rounded(spark.createDataFrame(rows, "type string, label string, score_threshold double, value double"))


@query(ORACLE_SQL["detection_precision_recall"].replace("FROM g GROUP BY 1)", "FROM g WHERE datum_uid % 2 = 0 GROUP BY 1)", 1).replace("AS iou_prev FROM fit4)", "AS iou_prev FROM fit4 WHERE datum_uid % 2 = 0)", 1))
def detection_of_some_datums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(d.precision_recall(data.box_pairs(spark, sf_dir), IOUS, SCORES, "datum_uid % 2 = 0"))


@query(f"""WITH {ORACLE_SQL['detection_confusion_matrix'].split('WITH ', 1)[1].rsplit(' SELECT iou_threshold', 1)[0]}
SELECT iou_threshold, score_threshold, gt_label, pd_label, datum_uid, gt_id, pd_id, count(*) OVER (PARTITION BY iou_threshold, score_threshold, gt_label, pd_label) AS count FROM outcomes""")
def detection_matrix_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = data.box_pairs(spark, sf_dir)
    return _with_counts(d.matrix_examples(pairs, IOUS, SCORES), d.confusion_matrix(pairs, IOUS, SCORES), "iou_threshold", "score_threshold")


@query(f"SELECT * FROM ({ORACLE_SQL['detection_examples']}) WHERE datum_uid IN (SELECT DISTINCT event_id // 8 FROM events ORDER BY 1 LIMIT 15 OFFSET 5)")
def detection_examples_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = d.examples(data.box_pairs(spark, sf_dir), IOUS, SCORES, limit=15, offset=5)
    listed = lambda n: F.array_join(F.array_sort(F.transform(n, lambda x: x.cast("string"))), ",").alias(n)
    both = F.array_join(F.transform("true_positives", lambda x: F.concat_ws(":", x["gt_id"], x["pd_id"])), ",").alias("true_positives")
    return out.select("datum_uid", "iou_threshold", "score_threshold", both, listed("false_positives"), listed("false_negatives"))


def _rings(frame: DataFrame, p: str) -> DataFrame:
    corners = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin")]
    return frame.withColumn(f"{p}ring", F.array(*(F.array(f"{p}{x}", f"{p}{y}") for x, y in corners)))


@query(ORACLE_SQL["detection_pairs"])
def detection_polygon_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as polygons give the boxes' pairs."""
    truths, predictions = data.boxes(spark, sf_dir)
    return rounded(d.polygon_pairs(_rings(truths, "g_"), _rings(predictions, "p_")))


def _masks(frame: DataFrame, p: str) -> DataFrame:
    """80 rows of 64 pixels, a word each, of the box at half its size."""
    half = {n: F.floor(F.col(f"{p}{n}") / 2) for n in ("xmin", "xmax", "ymin", "ymax")}
    frame = frame.withColumns({f"_{n}": x.cast("int") for n, x in half.items()})
    word = "transform(sequence(0, 79), y -> if(y >= _ymin and y < _ymax, shiftleft(shiftleft(1L, _xmax - _xmin) - 1, _xmin), 0L))"
    return frame.withColumn(f"{p}mask", F.expr(word)).drop("_xmin", "_xmax", "_ymin", "_ymax")


@query(f"""WITH {data.BOX_CTE},
h AS (SELECT g.datum_uid, gt_id, pd_id, floor(gx0 / 2) AS ax, floor(gx1 / 2) AS bx, floor(gy0 / 2) AS ay, floor(gy1 / 2) AS byy, floor(px0 / 2) AS cx, floor(px1 / 2) AS dx, floor(py0 / 2) AS cy, floor(py1 / 2) AS dy FROM g JOIN p USING (datum_uid)),
i AS (SELECT *, greatest(0, least(bx, dx) - greatest(ax, cx)) * greatest(0, least(byy, dy) - greatest(ay, cy)) AS n, (bx - ax) * (byy - ay) + (dx - cx) * (dy - cy) AS t FROM h)
SELECT datum_uid, gt_id, pd_id, round(n / (t - n)::DOUBLE, 9) AS iou FROM i""")
def detection_mask_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    truths, predictions = data.boxes(spark, sf_dir)
    both = _masks(truths, "g_").join(_masks(predictions, "p_"), "datum_uid")
    return rounded(both.select("datum_uid", "gt_id", "pd_id", mask_iou(F.col("g_mask"), F.col("p_mask")).alias("iou")))


@query(f"""WITH {data.PIXEL_CTE}, k AS (SELECT datum_uid, CASE WHEN gt_label <> 'N' THEN gt_label END AS gt_label, pd_label, n FROM counts WHERE datum_uid % 2 = 0)
SELECT count(DISTINCT datum_uid) AS number_of_datums, sum(n)::BIGINT AS number_of_pixels, coalesce(sum(n) FILTER (gt_label IS NOT NULL), 0)::BIGINT AS number_of_groundtruth_pixels,
  coalesce(sum(n) FILTER (pd_label IS NOT NULL), 0)::BIGINT AS number_of_prediction_pixels, (SELECT count(*) FROM counts) AS number_of_rows, (SELECT count(*) FROM labels) AS number_of_labels FROM k""")
def segmentation_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.info(data.pixel_counts(spark, sf_dir), "datum_uid % 2 = 0", "gt_label <> 'N'")


@query("""WITH m AS (SELECT event_id // 32 AS datum_uid, event_id, event_type AS label, event_id % 2 AS side, (user_id * 7 + j * (1 + event_id % 3)) % 64 AS pixel FROM events, range(12) r(j)),
f AS (SELECT datum_uid, side, pixel, arg_min(label, event_id) AS label FROM m GROUP BY ALL),
w AS (SELECT d.datum_uid, p.pixel, g.label AS gt_label, q.label AS pd_label FROM (SELECT DISTINCT datum_uid FROM m) d CROSS JOIN range(64) p(pixel)
  LEFT JOIN f g ON g.datum_uid = d.datum_uid AND g.pixel = p.pixel AND g.side = 0 LEFT JOIN f q ON q.datum_uid = d.datum_uid AND q.pixel = p.pixel AND q.side = 1)
SELECT datum_uid, gt_label, pd_label, count(*) AS count FROM w GROUP BY ALL""")
def segmentation_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks that overlap: the first keeps a pixel."""
    events = data.table(spark, sf_dir, "events").selectExpr(
        "event_id div 32 AS uid", "event_id", "event_id % 2 AS side", "event_type AS label",
        "transform(sequence(0, 11), j -> cast((user_id * 7 + j * (1 + event_id % 3)) % 64 AS int)) AS pixels",
    )
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("event_id", "label", "pixels")))), lambda x: F.struct(x["label"].alias("label"), x["pixels"].alias("pixels"))).alias(n) for k, n in enumerate(("groundtruths", "predictions"))]
    shapes = events.groupBy("uid").agg(F.lit(8).alias("height"), F.lit(8).alias("width"), *lists)
    return masks.mask_counts(shapes)


@query("""WITH r AS (SELECT l_suppkey AS datum_uid, ((l_orderkey * 8 + l_linenumber) * 1000000000 + l_partkey * 10000 + l_suppkey) * 100 + cast(l_quantity AS bigint) AS id, l_returnflag AS label, l_orderkey % 2 AS side, l_partkey % 90 AS x, l_orderkey % 50 AS y, 1 + l_partkey % 11 AS w, 1 + l_orderkey % 9 AS h FROM lineitem),
m AS (SELECT datum_uid, side, id, label, (y + j) * 100 + x + i AS pixel FROM r, range(11) a(i), range(9) b(j) WHERE i < w AND j < h),
f AS (SELECT datum_uid, pixel, arg_min(label, id) FILTER (side = 0) AS gt_label, arg_min(label, id) FILTER (side = 1) AS pd_label FROM m GROUP BY ALL),
c AS (SELECT datum_uid, gt_label, pd_label, count(*) AS count FROM f GROUP BY ALL)
FROM c UNION ALL SELECT datum_uid, NULL, NULL, 6000 - sum(count)::BIGINT FROM c GROUP BY 1""")
def segmentation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of overlapping rectangles a datum, given as runs of pixels. Ids are decimals: order keys from 11.5 million on exceed a bigint."""
    items = data.table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS uid", "(l_orderkey * 8 + l_linenumber) * 100000000000BD + (l_partkey * 10000 + l_suppkey) * 100 + cast(l_quantity AS bigint) AS id", "l_returnflag AS label", "l_orderkey % 2 AS side",
        "transform(sequence(0L, l_orderkey % 9), j -> named_struct('start', (l_orderkey % 50 + j) * 100 + l_partkey % 90, 'length', 1 + l_partkey % 11)) AS runs",
    )
    mine = [F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("id", "label", "runs")))), lambda x: F.struct(x["label"].alias("label"), x["runs"].alias("runs"))).alias(n) for k, n in enumerate(masks.SIDES)]
    return masks.mask_counts(items.groupBy("uid").agg(F.lit(60).alias("height"), F.lit(100).alias("width"), *mine))


@query("SELECT n_name, n_nationkey FROM nation WHERE n_regionkey = 2")
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on a column that isn't chosen."""
    nation = data.table(spark, sf_dir, "nation")
    writer = cache.MemoryWriter.create(spark, nation.schema, 10)
    writer.write_table(nation)
    return next(writer.to_reader().iterate_tables(["n_name", "n_nationkey"], "n_regionkey = 2"))


@query("SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::INT AS place FROM customer")
def table_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in one order over all rows, by running sums of ranges."""
    order = [F.desc("c_acctbal"), F.asc("c_custkey")]
    rows = running_sums(data.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [], order, {"place": F.lit(1)})
    return rows.select("c_custkey", "c_acctbal", F.col("place").cast("int").alias("place"))


@query(f"""WITH {data.CLASS_CTE} SELECT pd_label AS label, {', '.join(f"count(*) FILTER ({'' if hit else 'NOT '}match AND pd_winner AND abs(pd_score) > 1e-8 AND pd_score >= {t}) AS {'tp' if hit else 'fp'}_{i}" for i, t in enumerate(THRESHOLDS) for hit in (1, 0))} FROM pairs GROUP BY 1""")
def streaming_classification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as a stream; its counts end as those of the whole table."""
    orders = spark.readStream.schema(data.table(spark, sf_dir, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    name = f"counts_{id(orders)}"
    streaming.to_table(streaming.classification_counts(data.pairs_of(orders), THRESHOLDS), name, folder).awaitTermination()
    return spark.table(name)


@query(f"SELECT label, iou_threshold, score_threshold, tp, fp, fn FROM ({ORACLE_SQL['detection_precision_recall']})")
def streaming_detection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written to the shared folder, a datum a second, and read as a stream; a last pair of no label closes all datums."""
    shared = f"{checkpoint_folder(spark)}/pairs-{uuid.uuid4().hex}"
    pairs = data.box_pairs(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.col("datum_uid") + 86_400))  # a watermark begins at 1970
    pairs.write.parquet(f"{shared}/in/part=0")
    end = spark.read.parquet(f"{shared}/in/part=0").agg((F.max("at") + F.expr("interval 1 day")).alias("at"))  # of the copy: pairs aren't made again
    last = end.select(*(F.lit(None).cast(t).alias(c) if c not in ("datum_uid", "at") else F.lit(-1).cast(t).alias(c) if c == "datum_uid" else F.col(c) for c, t in pairs.dtypes))
    for k in (1, 2):
        last.write.parquet(f"{shared}/in/part={k}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    datums.configure(spark)
    try:
        stream = spark.readStream.schema(pairs.schema).parquet(f"{shared}/in")
        datums.detection_counts(stream, f"{shared}/out", f"{shared}/state", IOUS, SCORES).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return datums.read_counts(spark, f"{shared}/out").select("label", "iou_threshold", "score_threshold", "tp", "fp", "fn")


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = data.table(spark, sf_dir, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    both = turns.withColumn("query", F.lag("text").over(w)).where("role = 'assistant' and query is not null")
    return both.selectExpr("conv_id || '-' || turn AS uid", "query", "text AS response", "array(query) AS groundtruths", "filter(split(query, '[.] ', -1), x -> x <> '') AS contexts")


@query("""WITH t AS (SELECT conv_id || '-' || turn AS uid, role, text AS response, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS query FROM conversations),
l AS (SELECT uid, response, list_filter(string_split(response, '. '), lambda x: x <> '') AS told, list_filter(string_split(query, '. '), lambda x: x <> '') AS ctx FROM t WHERE role = 'assistant' AND query IS NOT NULL),
v AS (SELECT *, list_transform(told, lambda x: length(x) % 2 = 0) AS tv, list_transform(ctx, lambda x: length(x) % 2 = 0) AS cv, len(list_filter(told, lambda x: list_contains(ctx, x))) AS tp,
    len(list_filter(ctx, lambda x: NOT list_contains(told, x))) AS fn FROM l),
r AS (SELECT *, CASE WHEN len(told) = 0 THEN 0 ELSE len(list_filter(tv, lambda x: x)) / len(told)::DOUBLE END AS ts, CASE WHEN len(ctx) = 0 THEN 0 ELSE len(list_filter(cv, lambda x: x)) / len(ctx)::DOUBLE END AS cs FROM v),
k AS (SELECT uid, unnest(cv) AS ok, unnest(range(1, len(cv) + 1)) AS pos FROM v),
p AS (SELECT uid, avg(p) FILTER (ok) AS p FROM (SELECT uid, ok, count(*) FILTER (ok) OVER (PARTITION BY uid ORDER BY pos) / pos::DOUBLE AS p FROM k) GROUP BY 1),
m AS (SELECT uid, 'answer_correctness' AS type, CASE WHEN tp = 0 THEN 0 ELSE tp / (tp + 0.5 * (len(told) - tp + fn)) END AS value FROM r
UNION ALL SELECT uid, unnest(['answer_relevance', 'bias', 'toxicity']), ts FROM r
UNION ALL SELECT uid, unnest(['context_recall', 'context_relevance']), cs FROM r
UNION ALL SELECT uid, 'hallucination', cs FROM r WHERE len(ctx) > 0
UNION ALL SELECT uid, 'faithfulness', CASE WHEN len(ctx) = 0 THEN 0 WHEN len(told) = 0 THEN 1 ELSE ts END FROM r
UNION ALL SELECT uid, 'context_precision', coalesce(p, 0) FROM r LEFT JOIN p USING (uid)
UNION ALL SELECT uid, 'summary_coherence', length(response) % 5 + 1 FROM r)
SELECT uid, type, round(value::DOUBLE, 9) AS value, 'rules' AS evaluator, 0::INT AS retries, NULL::VARCHAR AS error FROM m""")
def text_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All judged scores by a client with fixed rules."""
    return rounded(judged.judge(_responses(spark, sf_dir), RuleClient, per_task=500))  # its replies cost nothing


@query()
def text_rouge_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four ROUGE types of stems."""
    rows = turns(spark, sf_dir)
    return rounded(text.rouge(rows, use_stemmer=True).union(text.rouge_sequences(rows, use_stemmer=True)))
