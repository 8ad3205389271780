"""Detection counts of a stream: a datum's pairs are held until the watermark closes it, then ranked by the batch operators.

Precision and recall need all pairs of a datum together, nothing more: counts of datums add up. So the state is the pairs of
open datums. When the watermark has passed a datum's last pair by ``gap``, a timer gives the pairs on and leaves a mark, for
``keep`` more, by which pairs that come later are told and counted. Pairs older than the watermark itself are dropped, and
counted, by the engine.

Each call of the state store by Python costs more than a pair does, so datums share a key, a timer and their calls by shards,
and a pair goes through Python as one text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gaugeworks.functions.ratios import f1, share
from gaugeworks.operators import detection
from gaugeworks.sources.shared import cut

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTS = "label string, iou_threshold double, score_threshold double, tp long, fp long, fn long, late long, batch long"
SHARDS = 2048  # keys of the state; a task holds the open pairs of one of them
CHUNK = 1000  # pairs of a text at most


class _Held(StatefulProcessor):
    """The datums of a shard. A datum and its pairs are JSON; ``next`` is the shard's one timer, not later than what is due first."""

    def __init__(self, gap_ms: int, keep_ms: int):
        self.gap, self.keep = gap_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pairs = handle.getListState("pairs", "datum string, last long, pairs string")
        self.closed = handle.getListState("closed", "datum string, until long")
        self.next = handle.getValueState("next", "ms long")

    def wake(self, due: int, before: int | None) -> None:
        if before is None or due < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.next.update((due,))
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        closed, late, new, last = {datum for datum, _ in self.closed.get()}, {}, {}, {}
        for _, datum, pair, at in rows:
            if datum in closed:
                late[datum] = late.get(datum, 0) + 1
            else:
                new.setdefault(datum, []).append(pair)
                ms = int(at.timestamp() * 1000)
                last[datum] = max(last.get(datum, ms), ms)
        for datum, n in late.items():
            yield Row(pairs=f"[{datum}]", late=n)
        if new:
            self.pairs.appendList([(d, last[d], ",".join(pairs[i : i + CHUNK])) for d, pairs in new.items() for i in range(0, len(pairs), CHUNK)])
            self.wake(min(last.values()) + self.gap, self.next.get()[0] if self.next.exists() else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, due = timerValues.getCurrentWatermarkInMs(), {}
        passed = max(now - 1, expiredTimerInfo.getExpiryTimeInMs())
        held, marks = list(self.pairs.get()), list(self.closed.get())
        for datum, last, _ in held:
            due[datum] = max(due.get(datum, last), last + self.gap)
        left = [x for x in held if due[x[0]] > passed]
        marked = [x for x in marks if x[1] > passed]
        if len(left) < len(held):
            for datum, _, pairs in held:
                if due[datum] <= passed:
                    yield Row(pairs=f"[{pairs}]", late=0)
            self.pairs.put(left) if left else self.pairs.clear()
            marked += [(datum, now + self.keep) for datum, ms in due.items() if ms <= passed]
        if marked != marks:
            self.closed.put(marked) if marked else self.closed.clear()
        self.next.clear()
        if left or marked:
            self.wake(min([due[x[0]] for x in left] + [x[1] for x in marked]), None)

    def close(self) -> None:
        pass


def closed_datums(pairs: DataFrame, delay: timedelta, gap: timedelta, keep: timedelta, shards: int = SHARDS) -> DataFrame:
    """Pairs of each datum once it's closed, with ``late`` 0; or one row without a pair, with the number of pairs that came for a
    closed datum. ``pairs``: a stream of detection pairs with an event time ``at``. Datums are dealt to ``shards`` keys of the
    state, as many as the checkpoint has begun with."""
    kinds = dict(pairs.dtypes)
    ms = lambda t: int(t.total_seconds() * 1000)
    named = [F.col(c).alias(str(i)) for i, c in enumerate(detection.BASE)]  # short names: texts repeat them
    texts = (F.pmod(F.hash("datum_uid"), F.lit(shards)).alias("shard"), F.to_json(F.struct(named[0])).alias("datum"), F.to_json(F.struct(*named)).alias("pair"), "at")
    timed = pairs.withWatermark("at", f"{ms(delay)} milliseconds").select(*texts)
    closed = timed.groupBy("shard").transformWithState(_Held(ms(gap), ms(keep)), "pairs string, late long", "Append", "EventTime")
    read = F.from_json("pairs", f"array<struct<{','.join(f'`{i}`: {kinds[c]}' for i, c in enumerate(detection.BASE))}>>", {"mode": "FAILFAST"})
    return closed.select(F.inline(read), "late").toDF(*detection.BASE, "late")


def detection_counts(pairs: DataFrame, path: str, checkpoint: str, ious: Sequence[float], scores: Sequence[float], delay: timedelta = timedelta(minutes=10), gap: timedelta = timedelta(minutes=1), keep: timedelta = timedelta(hours=1), shards: int = SHARDS) -> StreamingQuery:
    """Start counting what there is of a stream into the folder ``path``, a part for each batch, which a batch that runs again
    replaces. A restart with the same checkpoint goes on with the state of open datums. The session needs the RocksDB state
    store, as ``configure`` sets it."""

    def write(batch: DataFrame, number: int) -> None:
        batch = cut(batch)  # what follows reads it several times, the state only once
        told = batch.where("late = 0").drop("late")
        rows = detection.precision_recall(told, ious, scores).select("label", "iou_threshold", "score_threshold", "tp", "fp", "fn", F.lit(0).cast("long").alias("late"))
        none = [F.lit(None).cast(t) for t in ("string", "double", "double", "long", "long", "long")]
        late = batch.where("late > 0").select(*none, "late").toDF(*rows.columns)
        rows.union(late).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return closed_datums(pairs, delay, gap, keep, shards).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """``label, iou_threshold, score_threshold, tp, fp, fn, precision, recall, f1`` of all closed datums so far."""
    rows = spark.read.schema(COUNTS).parquet(path).where("label is not null")
    sums = rows.groupBy("label", "iou_threshold", "score_threshold").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    out = sums.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def late_pairs(spark: SparkSession, path: str) -> int:
    """Pairs that came for datums already closed; those older than the watermark are in the queries' progress."""
    return spark.read.schema(COUNTS).parquet(path).agg(F.sum("late")).first()[0] or 0
