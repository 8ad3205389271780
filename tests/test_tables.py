"""Tables in memory and in folders, evaluators over both, and judged scores with canned replies."""

import json

import numpy as np
import pytest

from gaugeworks import evaluator as e
from gaugeworks.errors import EmptyCacheError, InvalidLLMResponseError
from gaugeworks.functions.polygons import polygon_iou
from gaugeworks.functions.stemmer import stem
from gaugeworks.metrics import Metric
from gaugeworks.operators import judged, masks, text
from gaugeworks.plans.stand_in import RuleClient
from gaugeworks.sources import cache

SCHEMA = "a long, b double, c string"


@pytest.fixture(params=["memory", "file"])
def reader(request, spark, tmp_path):
    writer = cache.MemoryWriter.create(spark, SCHEMA, 7) if request.param == "memory" else cache.FileWriter.create(spark, f"{tmp_path}/t", SCHEMA, 7, 10)
    with writer:
        writer.write_rows([])
        writer.write_rows({"a": i, "b": i / 2, "c": str(i), "other": 1} for i in range(15))
        writer.write_columns({"a": [15, 16], "b": [7.5, 8.0]})
        writer.write_table(spark.createDataFrame([(17, 8.5, "x")], SCHEMA))
    return writer.to_reader()


def test_reader(reader):
    assert reader.count_rows() == 18 and reader.schema.fieldNames() == ["a", "b", "c"] and reader.count_tables() >= 1
    assert sorted(r.b for t in reader.iterate_tables(["b"], "a > 14") for r in t.collect()) == [7.5, 8.0, 8.5]
    arrays = list(reader.iterate_arrays(["a", "b"]))
    assert max(map(len, arrays)) <= 7 and sorted(np.concatenate(arrays)[:, 0].tolist()) == list(range(18))
    for rows, x in reader.iterate_tables_with_arrays(["c", "a"], ["a"], "a < 3"):
        assert [float(r["a"]) for r in rows] == x[:, 0].tolist() and set(rows[0]) == {"c", "a"}
    assert sorted(r.a for f in reader.iterate_fragment_batch_iterators(4) for batch in f for r in batch) == list(range(18))


def test_file_cache(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        cache.FileReader.load(spark, path)
    writer = cache.FileWriter.create(spark, path, SCHEMA, 100, 10, "gzip")
    with pytest.raises(FileExistsError):
        cache.FileWriter.create(spark, path, SCHEMA)
    writer.write_table(spark.range(25).selectExpr("24 - id AS a", "id * 1.0D AS b", "'' AS c").coalesce(1))
    writer.sort_by("a")
    reader = writer.to_reader()
    assert (reader.batch_size, reader.rows_per_file, reader.compression) == (100, 10, "gzip") and reader.count_rows() == 25
    for file in reader.get_files():
        own = [r.a for r in spark.read.parquet(file).collect()]
        assert own == sorted(own) and len(own) <= 10
    assert 1 <= len(list(reader.iterate_ordered_fragments("a = 3"))) < len(reader.get_files())
    config = f"{path}/config.json"
    good = json.loads(open(config).read())
    for broken in ({k: v for k, v in good.items() if k != "schema"}, good | {"batch_size": 0}):
        (tmp_path / "t" / ".config.json.crc").unlink(missing_ok=True)
        open(config, "w").write(json.dumps(broken))
        with pytest.raises(KeyError):
            cache.FileReader.load(spark, path)
    with pytest.raises(NotADirectoryError):
        cache.FileReader.load(spark, config)
    cache.FileWriter.create(spark, path, SCHEMA, delete_if_exists=True)
    assert cache.FileReader.load(spark, path).count_rows() == 0
    cache.FileWriter.delete(spark, path)
    cache.FileWriter.delete(spark, path)


def test_memory_sort_and_json(spark, tmp_path):
    writer = cache.MemoryWriter(spark, "a long")
    writer.write_columns({"a": [3, 1, 2]})
    writer.sort_by("a")
    assert [r.a for r in next(writer.to_reader().iterate_tables()).collect()] == [1, 2, 3]
    (tmp_path / "g").write_text('{"uid": "1", "label": "x"}\n{"uid": "2", "label": "y"}\n')
    (tmp_path / "p").write_text('{"uid": "2", "label": "z"}\n')
    assert sorted((r.uid, r.gt_label, r.pd_label) for r in cache.read_json_pairs(spark, f"{tmp_path}/g", f"{tmp_path}/p").collect()) == [("1", "x", None), ("2", "y", "z")]


@pytest.mark.parametrize("kind", ["memory", "folder"])
def test_classification_evaluator(spark, tmp_path, kind):
    make = e.ClassificationBuilder.in_memory if kind == "memory" else lambda s, fields: e.ClassificationBuilder.persistent(s, f"{tmp_path}/e", fields)
    builder = make(spark, {"size": "int"})
    with pytest.raises(EmptyCacheError):
        builder.finalize()
    rows = [("u1", "a", ["a", "b"], [0.75, 0.25], 1), ("u2", "b", ["a", "b"], [0.75, 0.25], 2), ("u3", "c", ["a", "b"], [0.0, 1.0], 3)]
    builder.add_data(spark.createDataFrame(rows, "uid string, groundtruth string, predictions array<string>, scores array<double>, size int"))
    ev = builder.finalize()
    with pytest.raises(RuntimeError):
        builder.finalize()
    assert ev.info["number_of_datums"] == 3 and ev.info["number_of_labels"] == 3 and ev.info["metadata_fields"] == {"size": "int"}
    found = {(m.type, m.parameters.get("label")): m.value for m in ev.compute_precision_recall([0.5])}
    assert found["Precision", "a"] == 0.5 and found["Recall", "a"] == 1.0 and found["Recall", "c"] == 0.0 and found["Accuracy", None] == pytest.approx(1 / 3)
    assert found["Counts", "b"] == {"tp": 0, "fp": 1, "fn": 1, "tn": 1}
    (matrix,) = ev.compute_confusion_matrix_with_examples([0.5])
    assert matrix.value["confusion_matrix"]["b"]["a"] == {"count": 1, "examples": [{"datum_id": "u2", "score": 0.75}]}
    assert matrix.value["unmatched_ground_truths"]["c"] == {"count": 0, "examples": []}
    (plain,) = ev.compute_confusion_matrix([0.5])
    assert plain.value["confusion_matrix"]["a"] == {"a": 1, "b": 0, "c": 0}
    assert [m.value["datum_id"] for m in ev.compute_examples([0.5], limit=1, offset=1)] == ["u2"]
    aucs = {m.type: m.value for m in ev.compute_rocauc()}
    assert set(aucs) == {"ROCAUC", "mROCAUC"}
    part = ev.filter("size < 3") if kind == "memory" else ev.filter("size < 3", path=f"{tmp_path}/f")
    assert {m.parameters["label"] for m in part.compute_precision_recall([0.5]) if m.type == "Recall"} == {"a", "b", "c"}  # c has no row left
    with pytest.raises(EmptyCacheError):
        ev.filter("size > 9", path=f"{tmp_path}/g")
    if kind == "folder":
        with pytest.raises(ValueError):
            ev.filter("size < 3")
        assert e.ClassificationEvaluator.load(spark, f"{tmp_path}/e").info["number_of_rows"] == 6
    json.dumps([m.to_dict() for m in ev.compute_precision_recall([0.5])])


def _packed(cells):
    words = [0]
    for i in cells:
        words[0] |= 1 << i
    return [w - (1 << 64) if w >> 63 else w for w in words]


def test_detection_evaluator(spark):
    """Boxes, masks and polygons of the same shapes give the same metrics."""
    g = [("u", 1, "x", 0, 4, 0, 4), ("u", 2, "y", 4, 8, 4, 8), ("v", 3, "x", 0, 2, 0, 2)]
    p = [("u", 1, "x", 0.9, 0, 4, 0, 3), ("u", 2, "x", 0.8, 4, 8, 4, 8), ("w", 3, "y", 0.7, 0, 2, 0, 2)]
    cells = lambda b: _packed([y * 8 + x for y in range(b[2], b[3]) for x in range(b[0], b[1])])
    ring = lambda b: [[float(b[i]), float(b[j])] for i, j in ((0, 2), (1, 2), (1, 3), (0, 3))]
    found = []
    for kind, shape, of in (("boxes", "{0}xmin double, {0}xmax double, {0}ymin double, {0}ymax double", lambda b: map(float, b)), ("masks", "{0}mask array<bigint>", lambda b: [cells(b)]), ("rings", "{0}ring array<array<double>>", lambda b: [ring(b)])):
        truths = spark.createDataFrame([(*r[:3], *of(r[3:])) for r in g], "datum_uid string, gt_id long, gt_label string, " + shape.format("g_"))
        predictions = spark.createDataFrame([(*r[:4], *of(r[4:])) for r in p], "datum_uid string, pd_id long, pd_label string, pd_score double, " + shape.format("p_"))
        builder = e.DetectionBuilder.in_memory(spark)
        {"boxes": builder.add_bounding_boxes, "masks": builder.add_bitmasks, "rings": builder.add_polygons}[kind](truths, predictions)
        ev = builder.finalize()
        found.append(sorted(json.dumps(m.to_dict()) for m in (*ev.compute_confusion_matrix_with_examples([0.5], [0.0]), *ev.compute_examples([0.5], [0.0]))))
    assert found[0] == found[1] == found[2]
    assert ev.info["number_of_groundtruths"] == ev.info["number_of_predictions"] == 3
    values = {(m.type, m.parameters.get("label"), m.parameters.get("score_threshold")): m.value for m in ev.compute_precision_recall([0.5], [0.0])}
    assert values["Counts", "x", 0.0] == {"tp": 1, "fp": 1, "fn": 1} and values["AP", "x", None] == pytest.approx(51 / 101) and values["mAP", None, None] == pytest.approx(51 / 202)
    (m,) = ev.compute_confusion_matrix([0.5], [0.0])
    assert m.value["confusion_matrix"]["y"]["x"] == 1 and m.value["unmatched_ground_truths"] == {"x": 1, "y": 0} and m.value["unmatched_predictions"] == {"x": 0, "y": 1}
    assert ev.filter("datum_uid = 'u'").info["number_of_datums"] == 1


def test_polygons():
    ell = [(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)]
    assert polygon_iou(ell, ell) == pytest.approx(1) and polygon_iou(ell[::-1], ell) == pytest.approx(1)
    assert polygon_iou(ell, [(0, 0), (2, 0), (2, 2), (0, 2)]) == pytest.approx(3 / 6)
    assert polygon_iou(ell, [(2, 2), (3, 2), (3, 3), (2, 3)]) == 0 and polygon_iou([], ell) == 0 and polygon_iou([(0, 0), (1, 1)], ell) == 0
    rng = np.random.default_rng(4)
    for _ in range(20):  # a grid of points as the measure
        a, b = (np.stack([r * np.cos(t), r * np.sin(t)], 1) for t, r in ((np.sort(rng.uniform(0, 2 * np.pi, 9)), rng.uniform(0.5, 2, 9)) for _ in range(2)))
        grid = np.stack(np.meshgrid(np.linspace(-2, 2, 161), np.linspace(-2, 2, 161)), -1).reshape(-1, 2)

        def inside(poly, grid=grid):
            n, hit = np.roll(poly, -1, 0), np.zeros(len(grid), bool)
            for (x0, y0), (x1, y1) in zip(poly, n, strict=True):
                cross = (grid[:, 1] < y0) != (grid[:, 1] < y1)
                hit ^= cross & (grid[:, 0] < (x1 - x0) * (grid[:, 1] - y0) / (y1 - y0 + (y1 == y0)) + x0)
            return hit

        x, y = inside(a), inside(b)
        assert polygon_iou(a, b) == pytest.approx((x & y).sum() / max(1, (x | y).sum()), abs=0.03)


def test_segmentation_masks(spark):
    rows = [("u", 2, 3, [("a", [0, 1]), ("b", [1, 2])], [("a", [0]), ("c", [0, 5])])]
    schema = "uid string, height int, width int, groundtruths array<struct<label:string,pixels:array<int>>>, predictions array<struct<label:string,pixels:array<int>>>"
    data = spark.createDataFrame(rows, schema)
    got = {(r.gt_label, r.pd_label): r["count"] for r in masks.mask_counts(data).collect()}
    assert got == {("a", "a"): 1, ("a", None): 1, ("b", None): 1, (None, None): 2, (None, "c"): 1}
    builder = e.SegmentationBuilder.in_memory(spark)
    builder.add_data(data)
    ev = builder.finalize()
    assert ev.info["number_of_pixels"] == 6 and ev.info["number_of_groundtruth_pixels"] == 3 and ev.info["number_of_prediction_pixels"] == 2
    found = {(m.type, m.parameters.get("label")): m.value for m in ev.compute_precision_recall_iou()}
    assert found["IOU", "a"] == 0.5 and found["Accuracy", None] == 0.5 and found["ConfusionMatrix", None]["unmatched_ground_truths"]["b"] == {"ratio": 1.0}
    assert ev.filter(groundtruths="gt_label = 'a'").info["number_of_pixels"] == 6
    for bad in (("u", 0, 3, [], []), ("u", 1, 1, [("a", [1])], [])):
        with pytest.raises(Exception, match="shape"):
            masks.mask_counts(spark.createDataFrame([bad], schema)).collect()


def test_mask_forms_equal_pixels(spark):
    """Pixel lists, runs and packed words of random overlapping masks against sets of pixels; shapes that end within a word."""
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for uid in range(25):
        h, w = int(rng.integers(1, 14)), int(rng.integers(1, 30))
        both = []
        for _ in range(2):
            side = []
            for _ in range(int(rng.integers(0, 5))):
                start, length = int(rng.integers(0, h * w)), int(rng.integers(1, h * w + 1))
                a = sorted({*range(start, min(start + length, h * w)), *rng.integers(0, h * w, 3).tolist()})
                side.append((rng.choice(list("abc")).item(), a))
            both.append(side)
        rows.append((uid, h, w, *both))
        first = [{}, {}]
        for k in (0, 1):
            for label, a in both[k]:
                for x in a:
                    first[k].setdefault(x, label)
        for x in range(h * w):
            key = uid, first[0].get(x), first[1].get(x)
            want[key] = want.get(key, 0) + 1

    def runs(a):
        out = []
        for x in a:
            if out and out[-1][0] + out[-1][1] == x:
                out[-1][1] += 1
            else:
                out.append([x, 1])
        return [tuple(r) for r in out]

    def packed(a, n):
        words = [sum(1 << x % 64 for x in a if x // 64 == k) for k in range((n + 63) // 64)]
        return [x - (1 << 64) if x >> 63 else x for x in words]

    for form, kind, of in (("pixels", "array<int>", lambda a, n: a), ("runs", "array<struct<start:bigint,length:bigint>>", lambda a, n: runs(a)), ("words", "array<bigint>", packed)):
        listed = f"array<struct<label:string,{form}:{kind}>>"
        data = spark.createDataFrame([(u, h, w, *([(x, of(a, h * w)) for x, a in side] for side in both)) for u, h, w, *both in rows], f"uid long, height int, width int, groundtruths {listed}, predictions {listed}")
        assert {(r.datum_uid, r.gt_label, r.pd_label): r["count"] for r in masks.mask_counts(data).collect()} == want
    for form, kind, bad in (("runs", "array<struct<start:bigint,length:bigint>>", [(2, 3)]), ("words", "array<bigint>", [0b10000]), ("words", "array<bigint>", [0, 1]), ("pixels", "array<int>", [-1])):
        listed = f"array<struct<label:string,{form}:{kind}>>"
        with pytest.raises(Exception, match="outside the shape"):
            masks.mask_counts(spark.createDataFrame([(0, 2, 2, [("a", bad)], [])], f"uid long, height int, width int, groundtruths {listed}, predictions {listed}")).collect()


def verdicts(*words):
    return json.dumps({"verdicts": [{"verdict": w, "analysis": "x"} for w in words]})


def test_judged_scores():
    def run(metric, *replies, truths=("t",), contexts=("c1", "c2", "c3"), retries=0):
        canned, memo = list(replies), {}

        def reply(prompt, attempt):
            if (prompt, attempt) not in memo:
                memo[prompt, attempt] = canned.pop(0)
            return memo[prompt, attempt]

        return judged.score_one(judged.Judge(reply), metric, "q", "r", list(truths), list(contexts), retries)

    three = json.dumps({"statements": ["s1", "s2", "s3"]})
    assert run("answer_relevance", three, verdicts("yes", "idk", "yes")) == (pytest.approx(2 / 3), None)
    assert run("answer_relevance", json.dumps({"statements": []})) == (0.0, None)
    assert run("context_precision", verdicts("yes", "no", "yes")) == (pytest.approx(5 / 6), None)
    assert run("context_precision", verdicts("no", "no", "no"), verdicts("no", "yes", "no"), truths=("t", "u")) == (0.5, None)
    assert run("context_precision", truths=(), contexts=()) == (1.0, None) and run("context_recall", contexts=()) == (0.0, None)
    assert run("faithfulness", json.dumps({"claims": []})) == (1.0, None) and run("faithfulness", contexts=()) == (0.0, None)
    assert run("hallucination", verdicts("no", "no", "yes")) == (pytest.approx(1 / 3), None)
    with pytest.raises(ValueError):
        run("hallucination", contexts=())
    sorted_ = json.dumps({"TP": ["s1", "s2"], "FP": ["s3"], "FN": []})
    assert run("answer_correctness", three, three, sorted_) == (pytest.approx(0.8), None)
    assert run("answer_correctness", three, three, json.dumps({"TP": ["s1"], "FP": [], "FN": []}))[1]
    assert run("summary_coherence", "I'd say 4 of 5") == (4.0, None) and run("summary_coherence", "-3")[1] and run("summary_coherence", "none")[1]
    assert run("bias", json.dumps({"opinions": ["o"]}), verdicts("yes")) == (1.0, None)
    assert run("bias", json.dumps({"opinions": ["o"]}), verdicts("idk"))[1] and run("bias", json.dumps({"opinions": [1]}))[1] and run("bias", "{broken}")[1]
    assert run("context_relevance", verdicts("yes"), "no json", verdicts("yes", "yes", "no"), retries=2) == (pytest.approx(2 / 3), None)
    for wrong, kind in ((["x"], TypeError), ([{"role": "user"}], ValueError), ([{"role": "user", "content": 1}], TypeError), ("x", TypeError)):
        with pytest.raises(kind):
            judged.check_messages(wrong)
    with pytest.raises(InvalidLLMResponseError):
        judged.check_verdicts({"verdicts": [{"verdict": "yes"}]}, ("yes",))


def test_clients():
    with pytest.raises(AttributeError):
        judged.model_name(lambda m: "")
    with pytest.raises(ValueError):
        judged.openai_client(seed=1, retries=1)
    ask = [{"role": "user", "content": "x"}]
    client = judged.ChatClient(lambda model, m, **o: (None, "stop", 3, 4), "m", seed=1)
    assert client(ask) == "" and client(ask) == "" and (client.input_tokens, client.output_tokens) == (6, 8)
    for reason in ("length", "content_filter"):
        with pytest.raises(ValueError):
            judged.ChatClient(lambda model, m, reason=reason, **o: ("x", reason, 0, 0), "m")(ask)


def test_judge_frame_gives_errors(spark):
    from gaugeworks import metrics

    data = spark.createDataFrame([("1", "q", "r", ["t"], None)], "uid string, query string, response string, groundtruths array<string>, contexts array<string>")

    def make():
        def client(messages):
            return "nothing"

        client.model_name = "canned"
        return client

    out = judged.judge(data, make, ["summary_coherence"], 1)
    (m,) = metrics.judged(out)["1"]
    assert m.type == "Error" and m.parameters == {"evaluator": "canned", "retries": 1} and m.value["type"] == "InvalidLLMResponseError"
    assert judged.judge(data, RuleClient, ["hallucination"]).count() == 0
    with pytest.raises(ValueError):
        judged.judge(data, None)


def test_metric_types():
    for wrong in ((1, 1.0, {}), ("a", "x", {}), ("a", 1.0, []), ("a", 1.0, {1: 2})):
        with pytest.raises(TypeError):
            Metric(*wrong)


def test_stemmer(spark):
    pairs = {"flipping": "flip", "caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "electrical": "electr", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controll": "control", "sky": "sky"}
    assert {w: stem(w) for w in pairs} == pairs
    data = spark.createDataFrame([(1, "flipping the roaring white dolphin", ["flip the roaring white dolphin"])], "uid long, prediction string, references array<string>")
    got = {r.rouge_type: r.value for r in text.rouge(data, use_stemmer=True).collect()}
    assert got == {"rouge1": 1.0, "rouge2": 1.0}
