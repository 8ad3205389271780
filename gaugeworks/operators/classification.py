"""Multiclass metrics over a pair table: one row for each predicted label of a datum.

Pairs: ``datum_uid, gt_label, pd_label, pd_score, pd_winner, match`` and any metadata columns. A sweep of thresholds is
columns of one aggregation, so rows aren't multiplied by thresholds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.errors import EmptyCacheError
from gaugeworks.functions.ratios import f1, share
from gaugeworks.operators.paging import page
from gaugeworks.operators.running import running_sums
from gaugeworks.sources.shared import cut, spread

RESERVED = ("datum_uid", "gt_label", "pd_label", "pd_score", "pd_winner", "match")
WRAP = 18446744073709551616.0  # negatives are counted unsigned


def make_pairs(data: DataFrame) -> DataFrame:
    """From ``uid, groundtruth, predictions array<string>, scores array<double>`` and metadata columns.

    The winner is the first of the highest scores. Raises where a row has no predictions or as many scores.
    """
    extra = [c for c in data.columns if c not in ("uid", "groundtruth", "predictions", "scores")]
    if clash := set(extra) & set(RESERVED):
        raise ValueError(f"metadata columns clash with reserved ones: {sorted(clash)}")
    sound = (F.size("predictions") > 0) & (F.size("predictions") == F.size("scores"))
    wrong = F.raise_error(F.lit("each datum needs predictions, with a score for each")).cast("boolean")
    best = F.array_position("scores", F.array_max("scores")) - 1
    rows = data.where(F.when(F.coalesce(sound, F.lit(False)), True).otherwise(wrong)).select(F.col("uid").alias("datum_uid"), F.col("groundtruth").alias("gt_label"), *extra, best.alias("best"), F.posexplode(F.arrays_zip("predictions", "scores")).alias("pos", "p"))
    return rows.select("datum_uid", "gt_label", F.col("p.predictions").alias("pd_label"), F.col("p.scores").alias("pd_score"), (F.col("pos") == F.col("best")).alias("pd_winner"), (F.col("gt_label") == F.col("p.predictions")).alias("match"), *extra)


def labels_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("gt_label", "pd_label")).alias("label")).where("label is not null").distinct()


def _thresholds(values: Sequence[float]) -> list[float]:
    if not values:
        raise ValueError("at least one score threshold is needed")
    return [float(v) for v in values]


def _live(hardmax: bool) -> Column:
    """The score, or -1 where it counts at no threshold."""
    on = F.abs("pd_score") > 1e-8
    return F.when(on & F.col("pd_winner") if hardmax else on, F.col("pd_score")).otherwise(-1.0)


def _sweep(frame: DataFrame, key: str, tests: dict[str, list[Column]], thresholds: list[float]) -> DataFrame:
    """``label, score_threshold`` and for each name how many rows pass its test at the threshold."""
    sums = [F.count_if(test).alias(f"{name}_{i}") for name, each in tests.items() for i, test in enumerate(each)]
    wide = frame.groupBy(F.col(key).alias("label")).agg(*sums)
    rows = [F.struct(F.lit(t).alias("score_threshold"), *(F.col(f"{n}_{i}").alias(n) for n in tests)) for i, t in enumerate(thresholds)]
    return wide.select("label", F.inline(F.array(*rows)))


def counts(pairs: DataFrame, thresholds: Sequence[float] = (0.0,), hardmax: bool = True, labels: DataFrame | None = None) -> DataFrame:
    """``label, score_threshold, tp, fp, fn, tn``, a row for each label and threshold even if all are 0.

    A false negative is a ground truth whose own prediction doesn't count or that has a counted wrong one.
    """
    ts = _thresholds(thresholds)
    rows = pairs.withColumn("live", _live(hardmax))
    least = rows.where("not match").groupBy("datum_uid", "gt_label", "pd_label").agg(F.min("live").alias("least"))
    predicted = _sweep(
        rows, "pd_label",
        {"tp": [F.col("match") & (F.col("live") >= t) & (F.col("live") >= 0) for t in ts], "fp": [~F.col("match") & (F.col("live") >= t) & (F.col("live") >= 0) for t in ts]}, ts,
    )
    negative = _sweep(least, "pd_label", {"tn": [~((F.col("least") >= t) & (F.col("least") >= 0)) for t in ts]}, ts)
    truth = rows.groupBy("datum_uid", "gt_label").agg(F.max(F.when(F.col("match"), F.col("live"))).alias("own"), F.min(F.when(F.col("match"), F.col("live"))).alias("weakest"), F.max(F.when(~F.col("match"), F.col("live"))).alias("other"))
    missed = [F.coalesce(~((F.col("weakest") >= t) & (F.col("weakest") >= 0)), F.lit(False)) | F.coalesce((F.col("other") >= t) & (F.col("other") >= 0), F.lit(False)) for t in ts]
    missing = _sweep(truth, "gt_label", {"fn": missed}, ts)
    grid = (labels_of(pairs) if labels is None else labels).select("label", F.explode(F.array(*map(F.lit, ts))).alias("score_threshold"))
    on = ["label", "score_threshold"]
    out = grid.join(predicted, on, "left").join(negative, on, "left").join(missing, on, "left")
    return out.select(*on, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("tp", "fp", "fn", "tn")))


def precision_recall(pairs: DataFrame, thresholds: Sequence[float] = (0.0,), hardmax: bool = True, datums: Column | str | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Counts with precision, recall, F1 and accuracy. ``datums`` filters rows, not the labels or the accuracy's denominator."""
    kept = pairs if datums is None else pairs.where(datums)
    n = pairs.agg(F.count_distinct("datum_uid").alias("n"))
    table = counts(kept, thresholds, hardmax, labels_of(pairs) if labels is None else labels)
    table = table.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    table = table.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    right = table.groupBy("score_threshold").agg(F.sum("tp").alias("right"))
    accuracy = right.crossJoin(F.broadcast(n)).select("score_threshold", share(F.col("right"), F.col("n")).alias("accuracy"))
    return table.join(F.broadcast(accuracy), "score_threshold").select("label", "score_threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy")


def roc_auc(pairs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``label, value``: trapezoids of true over false positive rate; ties in score are one point. Labels with zero scores only get 0."""
    sides = F.inline(F.array(F.struct(F.col("gt_label").alias("label"), F.lit(True).alias("truth")), F.struct(F.col("pd_label").alias("label"), F.lit(False).alias("truth"))))
    data = pairs.select("datum_uid", sides).where("label is not null").distinct()  # one scan for labels, truths and what was asked for
    data = cut(data.groupBy("label").agg(F.count_if("truth").alias("positives"), F.count_if(~F.col("truth")).alias("asked")))
    points = pairs.groupBy(F.col("pd_label").alias("label"), "pd_score").agg(F.count_if("match").alias("t"), F.count_if(~F.col("match")).alias("f"))
    points = running_sums(points, ["label"], [F.desc("pd_score")], {"tp": F.col("t"), "fp": F.col("f")}, [data])
    positives = F.coalesce("positives", F.lit(0)).cast("double")
    gap = F.coalesce("asked", F.lit(0)) - F.coalesce("positives", F.lit(0))
    negatives = F.when(gap < 0, gap.cast("double") + WRAP).otherwise(gap.cast("double"))
    x, y = share(F.col("fp"), negatives).alias("x"), share(F.col("tp"), positives).alias("y")
    px, py = share(F.col("fp") - F.col("f"), negatives).alias("px"), share(F.col("tp") - F.col("t"), positives).alias("py")
    points = points.select("label", "pd_score", x, y, px, py)
    areas = points.groupBy("label").agg(F.sum((F.col("x") - F.col("px")) * (F.col("y") + F.col("py")) / 2).alias("area"), F.max("pd_score").alias("top"))
    value = F.when(F.col("top") > 0, F.col("area")).otherwise(0.0)
    return (data.select("label") if labels is None else labels).join(areas, "label", "left").select("label", F.coalesce(value, F.lit(0.0)).alias("value"))


def mean_roc_auc(pairs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``value``: the mean over all labels, also those that were predicted only."""
    return roc_auc(pairs, labels).agg(F.avg("value").alias("value"))


def _tests(thresholds: Sequence[float]) -> list[tuple[float, Column, Column]]:
    """For each threshold: whether a row counts, and whether nothing of its ground truth does."""
    over = lambda c, t: (F.col(c) >= t) & (F.col(c) >= 0)
    return [(t, over("live", t), ~over("best", t)) for t in _thresholds(thresholds)]


def _cells(pairs: DataFrame, hardmax: bool) -> DataFrame:
    """Pairs with ``live`` and ``best``, the greatest of their ground truth."""
    return spread(pairs, "datum_uid").withColumn("live", _live(hardmax)).withColumn("best", F.max("live").over(W.partitionBy("datum_uid", "gt_label")))


def _once(pairs: DataFrame, hardmax: bool) -> DataFrame:
    """``datum_uid, gt_label, pd_label, live, best, first``: a row for each datum and pair of labels with its greatest ``live``, the
    greatest of its ground truth, and whether it is the ground truth's first. One sort of each task's rows serves all windows."""
    truth = W.partitionBy("datum_uid", "gt_label")
    cell = W.partitionBy("datum_uid", "gt_label", "pd_label").orderBy(F.desc("live"))
    rows = spread(pairs, "datum_uid").select("datum_uid", "gt_label", "pd_label", _live(hardmax).alias("live"))
    rows = rows.sortWithinPartitions("datum_uid", "gt_label", "pd_label", F.desc("live"))
    rows = rows.withColumn("_turn", F.row_number().over(cell)).where("_turn = 1").drop("_turn")
    return rows.withColumns({"best": F.max("live").over(truth), "first": F.row_number().over(truth.orderBy("pd_label")) == 1})


def _classified(pairs: DataFrame, thresholds: Sequence[float], hardmax: bool) -> DataFrame:
    """Each row at each threshold as tp, misclassified or unmatched (its ground truth has nothing counted); others drop out."""
    kinds = [F.struct(F.lit(t).alias("score_threshold"), F.when(on & F.col("match"), "tp").when(on, "misclassified").when(alone, "unmatched").alias("kind")) for t, on, alone in _tests(thresholds)]
    return _cells(pairs, hardmax).select("*", F.inline(F.filter(F.array(*kinds), lambda k: k["kind"].isNotNull())))


def confusion_matrix(pairs: DataFrame, thresholds: Sequence[float] = (0.0,), hardmax: bool = True, datums: Column | str | None = None, examples: bool = False, most: int | None = None) -> DataFrame:
    """``score_threshold, gt_label, pd_label, count``; a null pd_label counts unmatched ground truths. Sparse.

    A cell's datums count once, those of a ground truth through its first row. With ``examples`` each cell also lists its
    ``(datum_uid, score)``, the ``most`` least ones if that is given; else lists are as long as cells are large, for which
    ``matrix_examples`` gives rows.
    """
    tests, cell = _tests(thresholds), ["score_threshold", "gt_label", "pd_label"]
    once = _once(pairs if datums is None else pairs.where(datums), hardmax)
    sums = [F.count_if(on).alias(f"on_{i}") for i, (_, on, _) in enumerate(tests)] + [F.count_if(F.col("first") & alone).alias(f"alone_{i}") for i, (_, _, alone) in enumerate(tests)]
    wide = once.groupBy("gt_label", "pd_label").agg(*sums)
    tall = [F.struct(F.lit(t).alias("score_threshold"), label.alias("pd_label"), F.col(f"{name}_{i}").alias("count")) for i, (t, _, _) in enumerate(tests) for name, label in (("on", F.col("pd_label")), ("alone", F.lit(None).cast("string")))]
    counts = wide.select("gt_label", F.inline(F.array(*tall))).groupBy(*cell).agg(F.sum("count").alias("count")).where("count > 0")
    if not examples:
        return counts
    rows = matrix_examples(pairs, thresholds, hardmax, datums, most)
    listed = rows.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("datum_uid", "score"))).alias("examples"))
    same = [counts[c].eqNullSafe(listed[c]) for c in cell]
    return counts.join(listed, same[0] & same[1] & same[2]).select(*(counts[c] for c in cell), "count", "examples")


def matrix_examples(pairs: DataFrame, thresholds: Sequence[float] = (0.0,), hardmax: bool = True, datums: Column | str | None = None, most: int | None = None) -> DataFrame:
    """``score_threshold, gt_label, pd_label, datum_uid, score``: what the confusion matrix counts, a row each. With ``most`` only the
    least datums of each cell, of which each task gives as many at most before the shuffle."""
    once = _once(pairs if datums is None else pairs.where(datums), hardmax)
    label, score = F.lit(None).cast(dict(pairs.dtypes)["pd_label"]), F.lit(None).cast("double")
    row = lambda t, p, s: F.struct(F.lit(t).alias("score_threshold"), p.alias("pd_label"), s.alias("score"))
    kinds = [F.when(on, row(t, F.col("pd_label"), F.col("live"))).when(F.col("first") & alone, row(t, label, score)) for t, on, alone in _tests(thresholds)]
    cell = ["score_threshold", "gt_label", "pd_label"]
    rows = once.select("gt_label", "datum_uid", F.inline(F.array_compact(F.array(*kinds)))).select(*cell, "datum_uid", "score")
    if most is None:
        return rows
    turn = F.row_number().over(W.partitionBy(*cell).orderBy("datum_uid"))
    return rows.withColumn("_turn", turn).where(F.col("_turn") <= most).drop("_turn")


def examples(pairs: DataFrame, thresholds: Sequence[float] = (0.0,), hardmax: bool = True, datums: Column | str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """``datum_uid, score_threshold, true_positives, false_positives, false_negatives``: label lists of each datum that has any.
    ``limit`` and ``offset`` page over datums in order."""
    rows = _classified(page(pairs, "datum_uid", datums, limit, offset), thresholds, hardmax)

    def those(test: Column, name: str) -> Column:
        return F.array_sort(F.collect_set(F.when(test, F.col(name))))

    kind = F.col("kind")
    out = rows.groupBy("datum_uid", "score_threshold").agg(those(kind == "tp", "pd_label").alias("true_positives"), those(kind == "misclassified", "pd_label").alias("fp"), those(kind.isin("misclassified", "unmatched"), "gt_label").alias("fn"))
    return out.select("datum_uid", "score_threshold", "true_positives", F.array_except("fp", "true_positives").alias("false_positives"), F.array_except("fn", "true_positives").alias("false_negatives"))


def select(pairs: DataFrame, datums: Column | str | None = None, groundtruths: Column | str | None = None, predictions: Column | str | None = None) -> DataFrame:
    """Pairs whose (datum, ground truth) and (datum, prediction) are both selected. Raises EmptyCacheError if none is."""
    base = pairs if datums is None else pairs.where(datums)
    out = base
    for by, key in ((groundtruths, "gt_label"), (predictions, "pd_label")):
        if by is not None:
            out = out.join(base.where(by).select("datum_uid", key).distinct(), ["datum_uid", key], "left_semi")
    out = cut(out.select(*pairs.columns))  # computed once, for the test and for what follows
    if out.isEmpty():
        raise EmptyCacheError
    return out


def info(pairs: DataFrame, datums: Column | str | None = None) -> DataFrame:
    """``number_of_datums`` (filtered), ``number_of_labels`` and ``number_of_rows`` (not filtered)."""
    n = (pairs if datums is None else pairs.where(datums)).agg(F.count_distinct("datum_uid").alias("number_of_datums"))
    rest = pairs.agg(F.count("*").alias("number_of_rows"))
    return n.crossJoin(labels_of(pairs).agg(F.count("*").alias("number_of_labels"))).crossJoin(rest)
