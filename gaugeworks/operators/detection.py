"""Object-detection metrics: pairs by IoU, ranking, counts, precision-recall curve, AP and AR, confusion matrix.

Ground truths: ``datum_uid, gt_id, gt_label`` and a box ``g_xmin ...``; predictions: ``datum_uid, pd_id, pd_label,
pd_score`` and a box ``p_xmin ...``. Equal scores and IoUs are ordered by ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.errors import EmptyCacheError
from gaugeworks.functions.geometry import EPSILON, box_iou, mask_iou
from gaugeworks.functions.polygons import bounds, polygon_measure, with_polygon_iou
from gaugeworks.functions.ratios import f1, share
from gaugeworks.operators import spatial, tiles
from gaugeworks.operators.matching import one_to_one
from gaugeworks.operators.paging import page
from gaugeworks.operators.running import running_sums
from gaugeworks.sources.shared import cut

BASE = ("datum_uid", "gt_id", "gt_label", "pd_id", "pd_label", "pd_score", "iou")
#: Columns that ``finalize`` adds; metrics that find them don't rank or match again.
FINAL = ("match", "best", "iou_prev", "kept")
_SHAPES = tuple(f"{p}_{n}" for p in "gp" for n in ("xmin", "xmax", "ymin", "ymax", "mask", "ring", "holes"))


def _metadata(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c not in BASE and c not in _SHAPES]


def _merged(truths: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame, list[Column]]:
    """Both sides with their metadata columns told apart, and the columns that bring these together: what both have is of the datum."""
    g, p = _metadata(truths), _metadata(predictions)
    truths, predictions = truths.withColumnsRenamed({c: f"_g_{c}" for c in g}), predictions.withColumnsRenamed({c: f"_p_{c}" for c in p})
    both = [F.coalesce(*(f"_{s}_{c}" for s, has in (("g", g), ("p", p)) if c in has)).alias(c) for c in dict.fromkeys([*g, *p])]
    return truths, predictions, both


def _full(truths: DataFrame, predictions: DataFrame, more: list[Column]) -> DataFrame:
    g, p = truths.withColumnRenamed("datum_uid", "g_datum"), predictions.withColumnRenamed("datum_uid", "p_datum")
    joined = g.join(p, (F.col("g_datum") == F.col("p_datum")) & (box_iou("g_", "p_") >= EPSILON), "full")
    iou = F.when(F.col("gt_id").isNotNull() & F.col("pd_id").isNotNull(), box_iou("g_", "p_")).otherwise(0.0)
    return joined.select(F.coalesce("g_datum", "p_datum").alias("datum_uid"), "gt_id", "gt_label", "pd_id", "pd_label", F.coalesce("pd_score", F.lit(-1.0)).alias("pd_score"), iou.alias("iou"), *more)


def _with_rest(truths: DataFrame, predictions: DataFrame, both: DataFrame, more: list[Column], rest: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``both`` (pairs with ``iou``) and, with nulls, what of either side has no pair: ``rest``, if that is known."""
    both = both.where(F.col("iou") >= EPSILON)
    kinds = dict(truths.dtypes) | dict(predictions.dtypes) | {"iou": "double"}

    def rows(frame: DataFrame, given: dict[str, Column]) -> DataFrame:
        has = set(frame.columns)
        every = [c for c in kinds if c not in _SHAPES]
        return frame.select(*(F.col(c) if c in has else given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in every)).select(*BASE, *more)

    alone_g, alone_p = rest or (truths.join(both, ["datum_uid", "gt_id"], "left_anti"), predictions.join(both, ["datum_uid", "pd_id"], "left_anti"))
    alone_g = rows(alone_g, {"pd_score": F.lit(-1.0), "iou": F.lit(0.0)})
    return both.select(*BASE, *more).union(alone_g).union(rows(alone_p, {"iou": F.lit(0.0)}))


def _sides(truths: DataFrame, predictions: DataFrame, few: int) -> tuple[DataFrame | None, list[DataFrame], list[DataFrame]]:
    """Tiles of datums with more than ``few`` pairs (None: there are none), and both sides of the other datums and of these."""
    plan = tiles.crowded(truths, predictions, few)
    if plan.isEmpty():
        return None, [truths, predictions], []
    many = F.broadcast(plan.select("datum_uid"))  # a row for each crowded datum
    return plan, *([x.join(many, "datum_uid", how) for x in (truths, predictions)] for how in ("left_anti", "left_semi"))


def _tile_pairs(truths: DataFrame, predictions: DataFrame, plan: DataFrame, more: list[Column], measure: tiles.Measure | None = None) -> DataFrame:
    """As ``_with_rest``, of crowded datums."""
    kinds = dict(truths.dtypes) | dict(predictions.dtypes)
    out = None
    for rows in tiles.pairs(truths, predictions, plan, _SHAPES, measure):
        rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in rows.columns and c not in _SHAPES} | ({} if "iou" in rows.columns else {"iou": F.lit(0.0)}))
        rows = rows.withColumn("pd_score", F.coalesce("pd_score", F.lit(-1.0))).select(*BASE, *more)
        out = rows if out is None else out.union(rows)
    return out


def box_pairs(truths: DataFrame, predictions: DataFrame, few: int = spatial.FEW) -> DataFrame:
    """Overlapping pairs inside each datum, and both sides' rest with nulls, IoU 0 and score -1; metadata columns come along.

    One full join compares all boxes of a datum where these are at most ``few`` pairs; a more crowded datum is tiled. Its pairs
    go on as they are found: they are as many as the result's rows, so they aren't written or shuffled here.
    """
    truths, predictions, more = _merged(truths, predictions)
    plan, small, large = _sides(truths, predictions, few)
    rows = _full(*small, more)
    return rows if plan is None else rows.union(_tile_pairs(*large, plan, more))


def mask_pairs(truths: DataFrame, predictions: DataFrame) -> DataFrame:
    """As ``box_pairs``, of packed bitmasks ``g_mask`` and ``p_mask`` (``array<bigint>``, 64 pixels a word)."""
    truths, predictions, more = _merged(truths, predictions)
    both = truths.join(predictions, "datum_uid").withColumn("iou", mask_iou(F.col("g_mask"), F.col("p_mask")))
    return _with_rest(truths, predictions, both, more)


def polygon_pairs(truths: DataFrame, predictions: DataFrame, few: int = spatial.FEW) -> DataFrame:
    """As ``box_pairs``, of simple polygons ``g_ring`` and ``p_ring`` (``array<array<double>>`` of x and y, closed or not), with
    ``g_holes`` and ``p_holes`` (an array of such rings, null: none) if there are such columns. Only pairs whose bounding boxes
    meet are clipped."""
    truths, predictions, more = _merged(truths, predictions)
    plan, small, large = _sides(bounds(truths, "g_"), bounds(predictions, "p_"), few)
    near = small[0].join(small[1], "datum_uid").where((spatial.shared_side("x") > 0) & (spatial.shared_side("y") > 0))
    rows = _with_rest(*small, with_polygon_iou(near, "g_", "p_").drop(*_SHAPES), more)
    return rows if plan is None else rows.union(_tile_pairs(*large, plan, more, polygon_measure))


def rank(pairs: DataFrame) -> DataFrame:
    """The best row of each prediction and label with ``iou_prev``, from which any IoU threshold is answered row by row.

    A prediction with a label that fits some ground truth keeps only such rows. A finalized table has them already.
    """
    if "iou_prev" in pairs.columns:
        return pairs.where("best")
    rows = pairs.where("pd_id is not null").withColumn("match", F.coalesce(F.col("gt_label") == F.col("pd_label"), F.lit(False)))
    fits = F.max("match").over(W.partitionBy("datum_uid", "pd_id"))
    rows = rows.withColumn("fits", fits).where("match or not fits")
    order = [F.desc("pd_score"), F.desc("iou"), F.asc("gt_id"), F.asc("pd_id")]
    rows = rows.withColumn("turn", F.row_number().over(W.partitionBy("datum_uid", "pd_id", "pd_label").orderBy(*order))).where("turn = 1")
    before = W.partitionBy("datum_uid", "gt_id", "gt_label", "match").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    most = F.max("iou").over(before)
    previous = F.when(~F.col("match"), 2.0).when(most.isNull(), 0.0).when(F.col("iou") > most, most).otherwise(2.0)
    return rows.withColumn("iou_prev", previous).drop("fits", "turn")


def matched(pairs: DataFrame) -> DataFrame:
    """Pairs with ``kept``: one-to-one by falling score and IoU inside each datum, whatever the labels."""
    if "kept" in pairs.columns:
        return pairs
    kept = one_to_one(pairs).withColumn("kept", F.lit(True))
    return pairs.join(kept, ["datum_uid", "gt_id", "pd_id"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def base_of(pairs: DataFrame) -> DataFrame:
    """Pairs as before ``finalize``."""
    return pairs.drop(*FINAL)


def finalize(pairs: DataFrame) -> DataFrame:
    """Pairs with ``match``, ``best`` (a row that ``rank`` keeps), its ``iou_prev``, and ``kept`` of the one-to-one matching.

    The pairs are written once, then ranked and matched once, whatever number of metrics follows; each row is named by a number
    of that copy, so equal rows stay apart.
    """
    held = cut(base_of(pairs).withColumn("_row", F.monotonically_increasing_id()))
    best = rank(held).select("_row", F.col("iou_prev").alias("iou_prev"), F.lit(True).alias("best"))
    rows = matched(held).join(best, "_row", "left").withColumns({"best": F.coalesce("best", F.lit(False)), "match": F.coalesce(F.col("gt_label") == F.col("pd_label"), F.lit(False))})
    return rows.select(*(c for c in pairs.columns if c not in FINAL), *FINAL)


def truths_per_label(pairs: DataFrame) -> DataFrame:
    return pairs.where("gt_id is not null").select("datum_uid", "gt_id", F.col("gt_label").alias("label")).distinct().groupBy("label").agg(F.count("*").alias("n_gt"))


def _facts(pairs: DataFrame, datums: Column | str | None, labels: DataFrame | None) -> DataFrame:
    """``label, n_gt`` of all labels, or of those given: ground truths that a filter keeps. The pairs are read once for both."""
    on = F.lit(True) if datums is None else F.coalesce(F.expr(datums) if isinstance(datums, str) else datums, F.lit(False))
    sides = F.array(F.struct(F.col("gt_label").alias("label"), "datum_uid", "gt_id", "on"), F.struct(F.col("pd_label").alias("label"), *(F.lit(None).cast(dict(pairs.dtypes)[c]).alias(c) for c in ("datum_uid", "gt_id")), F.lit(False).alias("on")))
    rows = pairs.select("datum_uid", "gt_id", "gt_label", "pd_label", on.alias("on")).select(F.inline(sides)).where("label is not null")
    found = rows.groupBy("label", "datum_uid", "gt_id").agg(F.max("on").alias("on")).groupBy("label").agg(F.count_if(F.col("gt_id").isNotNull() & F.col("on")).alias("n_gt"))
    return found if labels is None else labels.select("label").join(found, "label", "left").fillna(0, "n_gt")


def labels_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("gt_label", "pd_label")).alias("label")).where("label is not null").distinct()


def _listed(values: Sequence[float]) -> list[float]:
    if not values:
        raise ValueError("at least one threshold is needed")
    return [float(v) for v in values]


def _hit(iou_threshold: Column) -> Column:
    return (F.col("pd_score") > EPSILON) & F.col("gt_id").isNotNull() & F.col("match") & (F.col("iou") >= iou_threshold) & (F.col("iou_prev") < iou_threshold)


def _kept(frame: DataFrame, datums: Column | str | None) -> DataFrame:
    return frame if datums is None else frame.where(datums)


def precision_recall(pairs: DataFrame, ious: Sequence[float], scores: Sequence[float], datums: Column | str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """``label, iou_threshold, score_threshold, tp, fp, fn, precision, recall, f1`` for the whole grid.

    ``datums`` filters ranked rows and ground truths, not the labels; ``labels`` are given where a filter lost some.
    """
    i, s = _listed(ious), _listed(scores)
    rows = _kept(rank(pairs), datums).where(F.col("pd_score") > EPSILON).withColumn("iou_threshold", F.explode(F.array(*map(F.lit, i)))).withColumn("hit", _hit(F.col("iou_threshold")))
    sums = [F.count_if(F.col("hit") & (F.col("pd_score") >= t)).alias(f"tp_{k}") for k, t in enumerate(s)] + [F.count_if(~F.col("hit") & (F.col("pd_score") >= t)).alias(f"fp_{k}") for k, t in enumerate(s)]
    wide = rows.groupBy(F.col("pd_label").alias("label"), "iou_threshold").agg(*sums)
    tall = wide.select("label", "iou_threshold", F.inline(F.array(*(F.struct(F.lit(t).alias("score_threshold"), F.col(f"tp_{k}").alias("tp"), F.col(f"fp_{k}").alias("fp")) for k, t in enumerate(s)))))
    grid = _facts(pairs, datums, labels).select("label", "n_gt", F.explode(F.array(*map(F.lit, i))).alias("iou_threshold")).select("*", F.explode(F.array(*map(F.lit, s))).alias("score_threshold"))
    zero = F.lit(0).cast("long")
    out = grid.join(tall, ["label", "iou_threshold", "score_threshold"], "left").select("label", "iou_threshold", "score_threshold", F.coalesce("tp", zero).alias("tp"), F.coalesce("fp", zero).alias("fp"), (F.coalesce("n_gt", zero) - F.coalesce("tp", zero)).alias("fn"))
    out = out.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def precision_recall_curve(pairs: DataFrame, ious: Sequence[float], datums: Column | str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """``label, iou_threshold, bin, precision, score``: 101 recall bins, each the best at this recall or a higher one."""
    i = _listed(ious)
    ranked = _kept(rank(pairs), datums).withColumn("label", F.col("pd_label"))
    hits = {f"hit_{k}": _hit(F.lit(t)) for k, t in enumerate(i)}
    rows = ranked.select("label", "pd_score", "iou", "datum_uid", "gt_id", "pd_id", *(h.alias(n) for n, h in hits.items()))
    order = [F.desc("pd_score"), F.desc("iou"), F.asc("datum_uid"), F.asc("gt_id"), F.asc("pd_id")]
    sums = {"total": F.lit(1)} | {f"right_{k}": F.col(n).cast("long") for k, n in enumerate(hits)}
    facts = cut(_facts(pairs, datums, labels))  # a row for each label
    rows = running_sums(rows, ["label"], order, sums, [facts])
    each = [F.struct(F.lit(t).alias("iou_threshold"), F.when(F.col(f"hit_{k}"), F.col(f"right_{k}")).otherwise(0).alias("right")) for k, t in enumerate(i)]
    rows = rows.select("label", "pd_score", "total", "n_gt", F.inline(F.array(*each)))
    rows = rows.select("label", "iou_threshold", F.floor(share(F.col("right"), F.col("n_gt")) * 100).cast("int").alias("bin"), share(F.col("right"), F.col("total")).alias("precision"), "pd_score")
    best = rows.groupBy("label", "iou_threshold", "bin").agg(F.max("precision").alias("precision"), F.max("pd_score").alias("score"))
    grid = facts.select("label", F.explode(F.array(*map(F.lit, i))).alias("iou_threshold")).select("*", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("bin"))
    up = W.partitionBy("label", "iou_threshold").orderBy(F.desc("bin"))
    out = grid.join(best, ["label", "iou_threshold", "bin"], "left")
    return out.select("label", "iou_threshold", "bin", F.coalesce(F.max("precision").over(up), F.lit(0.0)).alias("precision"), F.coalesce(F.max("score").over(up), F.lit(0.0)).alias("score"))


def average_precision(pairs: DataFrame, ious: Sequence[float], datums: Column | str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """``label, iou_threshold, value``: the bins' sum, from the highest recall down, over 101."""
    bins = precision_recall_curve(pairs, ious, datums, labels).groupBy("label", "iou_threshold").agg(F.sort_array(F.collect_list(F.struct("bin", "precision")), asc=False).alias("b"))
    return bins.select("label", "iou_threshold", (F.aggregate("b", F.lit(0.0), lambda s, x: s + x["precision"]) / 101.0).alias("value"))


def average_recall(pairs: DataFrame, ious: Sequence[float], scores: Sequence[float], datums: Column | str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """``label, score_threshold, value``: recall averaged over the IoU thresholds."""
    return precision_recall(pairs, ious, scores, datums, labels).groupBy("label", "score_threshold").agg(F.avg("recall").alias("value"))


def _entities(pairs: DataFrame) -> DataFrame:
    """``datum_uid, gt_id, pd_id, gt_label, pd_label, score, iou, b_score, b_iou``: a row for each matched pair, prediction and
    ground truth. It counts at thresholds that ``score`` and ``iou`` reach (null: any) and that ``b_score`` and ``b_iou``, those of
    the pair that would take its box away, don't both reach."""
    g, p = W.partitionBy("datum_uid", "gt_id"), W.partitionBy("datum_uid", "pd_id")
    on = F.col("kept") & (F.col("pd_score") > EPSILON)
    rows = matched(pairs).select(*BASE, on.alias("on"))
    most = F.max(F.when(F.col("on"), F.struct("iou", "pd_score")))
    turn = lambda side, by: F.row_number().over(W.partitionBy("datum_uid", f"{side}_id", f"{side}_label").orderBy(by)) == 1
    rows = rows.withColumns({"g_best": most.over(g), "g_first": turn("gt", F.asc("pd_id"))})
    rows = rows.withColumns({"p_best": most.over(p), "p_first": turn("pd", F.desc("pd_score"))})
    none = F.lit(None).cast("double")

    def entity(test: Column, sides: str, score: Column, iou: Column, best: str | None) -> Column:
        cols = [F.when(F.lit(c[0] in sides), F.col(c)).alias(c) for c in ("gt_id", "pd_id", "gt_label", "pd_label")]
        blocked = [none.alias("b_score"), none.alias("b_iou")] if best is None else [F.col(f"{best}.pd_score").alias("b_score"), F.col(f"{best}.iou").alias("b_iou")]
        return F.when(test, F.struct(*cols, score.alias("score"), iou.alias("iou"), *blocked))

    found = [
        entity(F.col("on"), "gp", F.col("pd_score"), F.col("iou"), None),
        entity(F.col("pd_id").isNotNull() & (F.col("pd_score") > EPSILON) & F.col("p_first"), "p", F.col("pd_score"), none, "p_best"),
        entity(F.col("gt_id").isNotNull() & F.col("g_first"), "g", none, none, "g_best"),
    ]
    return rows.select("datum_uid", F.inline(F.array_compact(F.array(*found))))


def _counts_at(i: float, s: float) -> Column:
    reached = F.coalesce(F.col("score") >= s, F.lit(True)) & F.coalesce(F.col("iou") >= i, F.lit(True))
    return reached & ~F.coalesce((F.col("b_score") >= s) & (F.col("b_iou") >= i), F.lit(False))


def outcomes(pairs: DataFrame, ious: Sequence[float], scores: Sequence[float], datums: Column | str | None = None) -> DataFrame:
    """``iou_threshold, score_threshold, datum_uid, gt_id, pd_id, gt_label, pd_label``: matched pairs, and with nulls what has no partner.

    These are the confusion matrix's examples, a row each. Matching comes before thresholds; a filter comes before matching.
    """
    i, s = _listed(ious), _listed(scores)
    grid = [F.when(_counts_at(x, y), F.struct(F.lit(x).alias("iou_threshold"), F.lit(y).alias("score_threshold"))) for x in i for y in s]
    rows = _entities(_rematched(pairs, datums))
    return rows.select("datum_uid", "gt_id", "pd_id", "gt_label", "pd_label", F.inline(F.array_compact(F.array(*grid)))).select("iou_threshold", "score_threshold", "datum_uid", "gt_id", "pd_id", "gt_label", "pd_label")


def _rematched(pairs: DataFrame, datums: Column | str | None) -> DataFrame:
    """What a filter keeps, matched anew, as it may split a datum."""
    return pairs if datums is None else base_of(pairs).where(datums) if "kept" in pairs.columns else pairs.where(datums)


def confusion_matrix(pairs: DataFrame, ious: Sequence[float], scores: Sequence[float], datums: Column | str | None = None, examples: bool = False, most: int | None = None) -> DataFrame:
    """``iou_threshold, score_threshold, gt_label, pd_label, count``; a null label stands for unmatched. Sparse.

    With ``examples`` each cell also lists its ``(datum_uid, gt_id, pd_id)``, the ``most`` least ones if that is given; else lists are
    as long as cells are large, for which ``matrix_examples`` gives rows.
    """
    i, s = _listed(ious), _listed(scores)
    grid, cell = [(x, y) for x in i for y in s], ["iou_threshold", "score_threshold", "gt_label", "pd_label"]
    entities = _entities(_rematched(pairs, datums))
    wide = entities.groupBy("gt_label", "pd_label").agg(*(F.count_if(_counts_at(x, y)).alias(f"n_{k}") for k, (x, y) in enumerate(grid)))
    tall = F.array(*(F.struct(F.lit(x).alias("iou_threshold"), F.lit(y).alias("score_threshold"), F.col(f"n_{k}").alias("count")) for k, (x, y) in enumerate(grid)))
    counts = wide.select("gt_label", "pd_label", F.inline(tall)).where("count > 0").select(*cell, "count")
    if not examples:
        return counts
    rows = matrix_examples(pairs, ious, scores, datums, most)
    listed = rows.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("datum_uid", "gt_id", "pd_id"))).alias("examples"))
    same = [counts[c].eqNullSafe(listed[c]) for c in cell]
    return counts.join(listed, same[0] & same[1] & same[2] & same[3]).select(*(counts[c] for c in cell), "count", "examples")


def matrix_examples(pairs: DataFrame, ious: Sequence[float], scores: Sequence[float], datums: Column | str | None = None, most: int | None = None) -> DataFrame:
    """``outcomes``, of each cell the ``most`` least by datum and ids if that is given: each task gives as many at most before the shuffle."""
    rows = outcomes(pairs, ious, scores, datums)
    if most is None:
        return rows
    cell = W.partitionBy("iou_threshold", "score_threshold", "gt_label", "pd_label").orderBy("datum_uid", "gt_id", "pd_id")
    return rows.withColumn("_turn", F.row_number().over(cell)).where(F.col("_turn") <= most).drop("_turn")


def examples(pairs: DataFrame, ious: Sequence[float], scores: Sequence[float], datums: Column | str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """For each datum and threshold: ``true_positives`` (gt_id, pd_id), ``false_positives`` and ``false_negatives`` (ids), sorted.

    A pair of different labels is a false positive and a false negative. ``limit`` and ``offset`` page over datums in order. The lists are bounded by the boxes of a datum.
    """
    right = F.coalesce(F.col("gt_label") == F.col("pd_label"), F.lit(False))
    paged = page(_rematched(pairs, datums), "datum_uid", None, limit, offset)
    return outcomes(paged, ious, scores).groupBy("datum_uid", "iou_threshold", "score_threshold").agg(
        F.array_sort(F.collect_set(F.when(right, F.struct("gt_id", "pd_id")))).alias("true_positives"),
        F.array_sort(F.collect_set(F.when(~right, F.col("pd_id")))).alias("false_positives"),
        F.array_sort(F.collect_set(F.when(~right, F.col("gt_id")))).alias("false_negatives"),
    )


def summary(pairs: DataFrame, ious: Sequence[float], scores: Sequence[float], datums: Column | str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """``metric, label, threshold, value``: AP by IoU, AR by score, their means over labels, over thresholds and over both; nulls where averaged."""
    none, anything = F.lit(None).cast("double"), F.lit(None).cast("string")
    out = []
    for name, over, frame in (("AP", "IOUs", average_precision(pairs, ious, datums, labels).withColumnRenamed("iou_threshold", "t")), ("AR", "Scores", average_recall(pairs, ious, scores, datums, labels).withColumnRenamed("score_threshold", "t"))):
        cube = frame.cube("label", "t").agg(F.avg("value").alias("value"), F.grouping("label").alias("all_l"), F.grouping("t").alias("all_t"))
        metric = F.concat(F.when(F.col("all_l") == 1, "m").otherwise(""), F.lit(name), F.when(F.col("all_t") == 1, f"AveragedOver{over}").otherwise(""))
        out.append(cube.select(metric.alias("metric"), F.coalesce("label", anything).alias("label"), F.coalesce("t", none).alias("threshold"), "value"))
    return out[0].union(out[1]).where("value is not null")


def select(pairs: DataFrame, datums: Column | str | None = None, groundtruths: Column | str | None = None, predictions: Column | str | None = None) -> DataFrame:
    """Pairs in which a side that isn't selected is null (score -1), with IoU 0 unless both stay; rows without a side go.

    A predicate that is null doesn't select. Raises EmptyCacheError if nothing is left. Of a finalized table it keeps the pairs,
    not their ranks and matches.
    """
    pairs = base_of(pairs)
    out = base = pairs if datums is None else pairs.where(datums)
    for by, key, side in ((groundtruths, "gt_id", ["gt_id", "gt_label"]), (predictions, "pd_id", ["pd_id", "pd_label"])):
        if by is None:
            continue
        ok = base.where(by).where(F.col(key).isNotNull()).select("datum_uid", key).distinct().withColumn("_ok", F.lit(True))
        out = out.join(ok, ["datum_uid", key], "left")
        changed = {c: F.when(F.col("_ok"), F.col(c)) for c in side}
        if key == "pd_id":
            changed["pd_score"] = F.when(F.col("_ok"), F.col("pd_score")).otherwise(-1.0)
        out = out.withColumns(changed).drop("_ok")
    out = out.where("gt_id is not null or pd_id is not null")
    out = cut(out.withColumn("iou", F.when(F.col("gt_id").isNotNull() & F.col("pd_id").isNotNull(), F.col("iou")).otherwise(0.0)).select(*pairs.columns))
    if out.isEmpty():
        raise EmptyCacheError
    return out


def info(pairs: DataFrame, datums: Column | str | None = None, groundtruths: Column | str | None = None, predictions: Column | str | None = None) -> DataFrame:
    """Datums, ground truths and predictions that the filters leave; rows and labels of all."""
    g, p = (F.lit(True) if x is None else F.expr(x) if isinstance(x, str) else x for x in (groundtruths, predictions))
    kept = _kept(pairs, datums).agg(
        F.count_distinct("datum_uid").alias("number_of_datums"), F.count_distinct(F.when(F.col("gt_id").isNotNull() & g, F.struct("datum_uid", "gt_id"))).alias("number_of_groundtruths"),
        F.count_distinct(F.when(F.col("pd_id").isNotNull() & p, F.struct("datum_uid", "pd_id"))).alias("number_of_predictions"),
    )
    every = pairs.agg(F.count("*").alias("number_of_rows")).crossJoin(labels_of(pairs).agg(F.count("*").alias("number_of_labels")))  # one row each
    return kept.crossJoin(every)

