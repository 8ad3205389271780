"""Results as plain dictionaries of type, value and parameters, from the frames that operators give."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row


@dataclass(frozen=True)
class Metric:
    type: str
    value: int | float | dict
    parameters: dict

    def __post_init__(self):
        if not isinstance(self.type, str):
            raise TypeError("a metric's type is a string")
        if isinstance(self.value, bool) or not isinstance(self.value, int | float | dict):
            raise TypeError("a metric's value is a number or a dict")
        if not isinstance(self.parameters, dict) or any(not isinstance(k, str) for k in self.parameters):
            raise TypeError("a metric's parameters are a dict with string keys")

    def to_dict(self) -> dict:
        return {"type": self.type, "value": self.value, "parameters": self.parameters}


def _only(row: Row, *names: str) -> dict:
    return {n: row[n] for n in names}


def per_column(rows: Iterable[Row], columns: dict[str, str], keys: tuple[str, ...], more: dict | None = None) -> list[Metric]:
    """A metric of each named type for every row, with the row's keys as parameters."""
    return [Metric(kind, r[c], _only(r, *keys) | (more or {})) for r in rows for kind, c in columns.items()]


RATES = {"Precision": "precision", "Recall": "recall", "F1": "f1"}


def classification_counts(frame: DataFrame, hardmax: bool) -> list[Metric]:
    rows, more = frame.collect(), {"hardmax": hardmax}
    out = per_column(rows, RATES, ("score_threshold", "label"), more)
    out += [Metric("Counts", _only(r, "tp", "fp", "fn", "tn"), _only(r, "score_threshold", "label") | more) for r in rows]
    return out + [Metric("Accuracy", v, {"score_threshold": t} | more) for t, v in {r["score_threshold"]: r["accuracy"] for r in rows}.items()]


def classification_roc_auc(frame: DataFrame) -> list[Metric]:
    rows = frame.collect()
    mean = sum(r["value"] for r in rows) / len(rows) if rows else 0.0
    return [Metric("ROCAUC", r["value"], {"label": r["label"]}) for r in rows] + [Metric("mROCAUC", mean, {})]


def _cells(rows: list[Row], labels: list[str], by: tuple[str, ...], examples: dict[str, str] | None) -> list[tuple[dict, dict]]:
    """Dense matrices by threshold. ``examples`` renames the fields of a cell's examples."""
    groups: dict[tuple, list[Row]] = defaultdict(list)
    for r in rows:
        groups[tuple(r[k] for k in by)].append(r)

    def cell(r: Row | None, skip: tuple[str, ...] = ()):
        if examples is None:
            return r["count"] if r else 0
        return {"count": r["count"] if r else 0, "examples": [{new: e[old] for old, new in examples.items() if old not in skip} for e in (r["examples"] if r else [])]}

    out = []
    for key, mine in sorted(groups.items()):
        at = {(r["gt_label"], r["pd_label"]): r for r in mine}
        value = {
            "confusion_matrix": {g: {p: cell(at.get((g, p))) for p in labels} for g in labels},
            "unmatched_ground_truths": {g: cell(at.get((g, None)), ("score", "pd_id")) for g in labels},
            "unmatched_predictions": {p: cell(at.get((None, p)), ("gt_id",)) for p in labels},
        }
        out.append((value, dict(zip(by, key, strict=True))))
    return out


def classification_matrix(frame: DataFrame, labels: list[str], hardmax: bool) -> list[Metric]:
    fields = {"datum_uid": "datum_id", "score": "score"} if "examples" in frame.columns else None
    found = _cells(frame.collect(), labels, ("score_threshold",), fields)
    kind = "ConfusionMatrixWithExamples" if fields else "ConfusionMatrix"
    return [Metric(kind, {k: v for k, v in value.items() if k != "unmatched_predictions"}, keys | {"hardmax": hardmax}) for value, keys in found]


def classification_examples(frame: DataFrame, hardmax: bool) -> list[Metric]:
    return [Metric("Examples", {"datum_id": r["datum_uid"], **{k: list(r[k]) for k in ("true_positives", "false_positives", "false_negatives")}}, {"score_threshold": r["score_threshold"], "hardmax": hardmax}) for r in frame.collect()]


def detection_counts(frame: DataFrame) -> list[Metric]:
    rows, keys = frame.collect(), ("label", "iou_threshold", "score_threshold")
    return per_column(rows, RATES, keys) + [Metric("Counts", _only(r, "tp", "fp", "fn"), _only(r, *keys)) for r in rows]


def detection_summary(frame: DataFrame, ious: list[float], scores: list[float]) -> list[Metric]:
    """AP and AR of each label, their means, and their averages over thresholds."""
    out = []
    for r in frame.collect():
        keys = {} if r["label"] is None else {"label": r["label"]}
        precision = "AP" in r["metric"]
        if not precision or r["threshold"] is None:
            keys["iou_thresholds"] = ious
        if r["threshold"] is not None:
            keys["iou_threshold" if precision else "score_threshold"] = r["threshold"]
        elif not precision:
            keys["score_thresholds"] = scores
        out.append(Metric(r["metric"], r["value"], keys))
    return out


def detection_curve(frame: DataFrame) -> list[Metric]:
    curves: dict[tuple, list] = defaultdict(list)
    for r in frame.collect():
        curves[r["label"], r["iou_threshold"]].append((r["bin"], r["precision"], r["score"]))
    return [Metric("PrecisionRecallCurve", {"precisions": [x[1] for x in sorted(c)], "scores": [x[2] for x in sorted(c)]}, {"iou_threshold": t, "label": label}) for (label, t), c in curves.items()]


def detection_matrix(frame: DataFrame, labels: list[str]) -> list[Metric]:
    fields = {"datum_uid": "datum_id", "gt_id": "ground_truth_id", "pd_id": "prediction_id"} if "examples" in frame.columns else None
    return [Metric("ConfusionMatrixWithExamples" if fields else "ConfusionMatrix", value, keys) for value, keys in _cells(frame.collect(), labels, ("score_threshold", "iou_threshold"), fields)]


def detection_examples(frame: DataFrame) -> list[Metric]:
    return [
        Metric("Examples", {"datum_id": r["datum_uid"], "true_positives": [tuple(x) for x in r["true_positives"]], "false_positives": list(r["false_positives"]), "false_negatives": list(r["false_negatives"])}, _only(r, "score_threshold", "iou_threshold"))
        for r in frame.collect()
    ]


def segmentation(metrics: DataFrame, matrix: DataFrame) -> list[Metric]:
    rows, cells = metrics.collect(), {(r["gt_label"], r["pd_label"]): r for r in matrix.collect()}
    out = per_column(rows, RATES | {"IOU": "iou"}, ("label",))
    if rows:
        out += [Metric("Accuracy", rows[0]["accuracy"], {}), Metric("mIOU", rows[0]["mean_iou"], {})]
    labels = sorted(r["label"] for r in rows)
    ratio = lambda g, p: cells[g, p]["iou"] if (g, p) in cells else 0.0
    value = {
        "confusion_matrix": {g: {p: {"iou": ratio(g, p)} for p in labels} for g in labels},
        "unmatched_ground_truths": {g: {"ratio": ratio(g, None)} for g in labels},
        "unmatched_predictions": {p: {"ratio": ratio(None, p)} for p in labels},
    }
    return [*out, Metric("ConfusionMatrix", value, {})]


def judged(frame: DataFrame) -> dict[str, list[Metric]]:
    """By response: a metric, or an Error, for each row of ``judge``."""
    return text_scores(frame, False, [])


def text_scores(frame: DataFrame, use_stemmer: bool, weights: list[float]) -> dict[str, list[Metric]]:
    """By response: a metric, or an Error, for each row of ``judge`` or ``compute_all``."""
    out: dict[str, list[Metric]] = defaultdict(list)
    for r in frame.collect():
        if r["type"] == "bleu":
            out[r["uid"]].append(Metric("BLEU", r["value"], {"weights": weights}))
        elif r["type"].startswith("rouge"):
            out[r["uid"]].append(Metric("ROUGE", r["value"], {"rouge_type": r["type"], "use_stemmer": use_stemmer}))
        else:
            keys = {"evaluator": r["evaluator"], "retries": r["retries"]}
            kind = "".join(w.capitalize() for w in r["type"].split("_"))
            out[r["uid"]].append(Metric("Error", {"type": "InvalidLLMResponseError", "message": r["error"]}, keys) if r["error"] is not None else Metric(kind, r["value"], keys))
    return dict(out)
