"""Detection counts of a stream against those of a batch, over a restart, with late pairs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import detection as d
from gaugeworks.streaming import datums

SCHEMA = "datum_uid long, gt_id long, gt_label string, pd_id long, pd_label string, pd_score double, iou double, at timestamp"
START = datetime(2024, 1, 1)
KEYS = ["label", "iou_threshold", "score_threshold", "tp", "fp", "fn"]


@pytest.fixture
def stateful(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    datums.configure(spark)
    yield spark
    spark.conf.set(key, before)


def rows_of(datum, minute, rng):
    out = []
    for k in range(rng.randint(1, 12)):
        g, p = (rng.randrange(4) if rng.random() < 0.8 else None), (rng.randrange(5) if rng.random() < 0.8 else None)
        if g is None and p is None:
            continue
        score = -1.0 if p is None else ((p * 37 + datum * 11) % 100 + 1) / 101
        out.append((datum, g, None if g is None else "ab"[g % 2], p, None if p is None else "ab"[(p + datum) % 2], score, 0.0 if g is None or p is None else (k * 7 + datum) % 10 / 10, START + timedelta(minutes=minute, seconds=k)))
    return out


def counts(frame):
    return sorted(tuple(r) for r in frame.select(KEYS).where("tp + fp + fn > 0").collect())


def test_stream_equals_batch_after_a_restart(stateful, tmp_path):
    spark, rng = stateful, random.Random(3)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def feed(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = datums.detection_counts(stream, out, state, [0.1, 0.5], [0.0, 0.5], timedelta(minutes=5), timedelta(minutes=1), timedelta(hours=9))
        query.awaitTermination()
        return query

    first = [r for datum in range(20) for r in rows_of(datum, datum, rng)]
    feed(first)
    second = [r for datum in range(15, 40) for r in rows_of(datum, datum, rng)]  # datums 15 to 19 are still open
    feed(second)  # another query with the same checkpoint
    feed([(99, 0, "a", None, None, -1.0, 0.0, START + timedelta(hours=5))])
    feed([(99, 1, "a", None, None, -1.0, 0.0, START + timedelta(hours=5, seconds=1))])
    whole = spark.createDataFrame(first + second, SCHEMA)
    assert counts(datums.read_counts(spark, out)) == counts(d.precision_recall(whole.drop("at"), [0.1, 0.5], [0.0, 0.5]))
    assert datums.late_pairs(spark, out) == 0
    before = counts(datums.read_counts(spark, out))
    late = feed([(3, 9, "a", None, None, -1.0, 0.0, START + timedelta(hours=5)), (3, 9, "a", None, None, -1.0, 0.0, START + timedelta(minutes=3))])
    assert counts(datums.read_counts(spark, out)) == before and datums.late_pairs(spark, out) == 1  # of a closed datum
    dropped = sum(op["numRowsDroppedByWatermark"] for p in late.recentProgress for op in p["stateOperators"])
    assert dropped == 1  # older than the watermark


def test_batch_parts_are_replaced(stateful, tmp_path):
    """The same batch written twice counts once."""
    spark = stateful
    rows = spark.createDataFrame([("a", 0.5, 0.5, 1, 2, 3, 0)], "label string, iou_threshold double, score_threshold double, tp long, fp long, fn long, late long")
    for _ in range(2):
        rows.write.mode("overwrite").parquet(f"{tmp_path}/out/batch=4")
    assert counts(datums.read_counts(spark, f"{tmp_path}/out")) == [("a", 0.5, 0.5, 1, 2, 3)]
    assert datums.read_counts(spark, f"{tmp_path}/out").select(F.round("precision", 6)).first()[0] == round(1 / 3, 6)


def test_state_follows_shards(stateful, tmp_path):
    """Timers are as many as shards, not datums, and each datum still closes by itself; odd ids, labels and scores come through."""
    spark = stateful
    odd = ['a "b"', "", "x\ny\\", "é 😀", "a,b]}", None]
    rows = [(f"{datum}'\"", None if k == 1 else 2**62 + k, None if k == 1 else odd[(datum + k) % 6], None if k == 2 else f"p{k}\n", None if k == 2 else odd[(datum * k) % 6], (-1.0 if k == 2 else float("nan") if datum % 7 == 0 else 0.1 + datum / 3e5), (0.0 if k else 1 / 3), START + timedelta(minutes=datum // 50)) for datum in range(300) for k in range(3)]
    schema = "datum_uid string, gt_id long, gt_label string, pd_id string, pd_label string, pd_score double, iou double, at timestamp"
    end = [(None, None, None, None, None, None, None, START + timedelta(days=1))]
    for k, part in enumerate((rows, end, end)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []
    query = datums.closed_datums(stream, timedelta(minutes=1), timedelta(minutes=1), timedelta(hours=1), shards=5).writeStream.foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    timers = [op["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress for op in p["stateOperators"]]
    assert timers and max(timers) <= 6 and all(r.late == 0 for r in seen)
    assert sorted(repr(tuple(r)[:7]) for r in seen if r.datum_uid is not None) == sorted(repr(r[:7]) for r in rows)


def test_crowded_datum_is_held_in_parts(stateful, tmp_path, monkeypatch):
    """A datum over several texts and batches closes once, whole; what comes later is late."""
    monkeypatch.setattr(datums, "CHUNK", 3)
    spark = stateful
    pair = lambda datum, k, minute: (datum, k, "a", None, None, -1.0, 0.0, START + timedelta(minutes=minute))
    parts = [[pair(1, k, 0) for k in range(10)] + [pair(2, 0, 0)], [pair(1, k, 3) for k in range(10, 14)] + [pair(2, 1, 0)], [pair(3, 0, 6)], [pair(3, 1, 6)], [pair(1, 14, 6), pair(1, 15, 6), pair(2, 2, 6)], [pair(4, 0, 90)], [pair(4, 1, 90)], [pair(3, 2, 90)]]
    for k, part in enumerate(parts):  # a batch each
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    datums.detection_counts(stream, f"{tmp_path}/out", f"{tmp_path}/state", [0.5], [0.0], timedelta(minutes=1), timedelta(minutes=1), timedelta(hours=9), shards=1).awaitTermination()
    got = {r.label: r.fn for r in datums.read_counts(spark, f"{tmp_path}/out").collect()}
    assert got == {"a": 14 + 2 + 2} and datums.late_pairs(spark, f"{tmp_path}/out") == 3 + 1
