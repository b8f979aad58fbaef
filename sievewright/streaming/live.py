"""Live scores: rolling mean, bands and alerts with a cooldown, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOW = 30
HIGH, MEDIUM = 67, 35
COOLDOWN_SECONDS = 5.0

STATES = "stream_id long, event_id long, ts timestamp, mean double, frame_count long, band string, alert boolean"


def states(rows: DataFrame) -> DataFrame:
    """Batch form: rolling mean of the last 30 scores, running count and band; order (ts, event_id)."""
    w = Window.partitionBy("stream_id").orderBy("ts", "event_id")
    d = rows.withColumns({"mean": F.avg("score").over(w.rowsBetween(1 - WINDOW, 0)), "frame_count": F.row_number().over(w).cast("long")})
    return d.withColumn("band", F.when(F.col("mean") >= HIGH, "high").when(F.col("mean") >= MEDIUM, "medium").otherwise("low"))


def alerts_batch(rows: DataFrame, keep: int = 10) -> DataFrame:
    """Rows (stream_id, alerts, last): alert count and the ids of the last ones, over 5 s apart.

    The cooldown depends on the alert before, so it is a fold over each stream's
    high frames in order.  Frames arrive sorted and are folded as they pass: a
    task holds one batch, the alert before and the last ids, however long a
    stream is.  Streams without an alert have no row.
    """
    high = states(rows).where("band = 'high'").select("stream_id", F.col("ts").cast("timestamp").cast("double").alias("t"), "event_id", "ts")
    ordered = high.repartition("stream_id").sortWithinPartitions("stream_id", "ts", "event_id").drop("ts")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, now = [], None  # now: stream, alerts, time of the last, ids of the last ones
        for frame in frames:
            for stream, t, event in zip(frame["stream_id"].tolist(), frame["t"].tolist(), frame["event_id"].tolist(), strict=True):
                if now is None or now[0] != stream:
                    if now is not None:
                        out.append((now[0], now[1], ",".join(map(str, now[3]))))
                    now = (stream, 1, t, [event])
                elif t - now[2] > COOLDOWN_SECONDS:
                    now = (stream, now[1] + 1, t, [*now[3], event][-keep:])
            if out:
                yield pd.DataFrame(out, columns=["stream_id", "alerts", "last"])
                out = []
        if now is not None:
            yield pd.DataFrame([(now[0], now[1], ",".join(map(str, now[3])))], columns=["stream_id", "alerts", "last"])

    return ordered.mapInPandas(fold, f"stream_id {rows.schema['stream_id'].dataType.simpleString()}, alerts long, last string")


def summary(rows: DataFrame) -> DataFrame:
    """Frame count, and mean, highest and lowest score of the last 30 of each stream."""
    w = Window.partitionBy("stream_id")
    d = rows.withColumns({"r": F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))), "n": F.count("*").over(w)})
    return d.where(F.col("r") <= WINDOW).groupBy("stream_id").agg(F.max("n").alias("frame_count"), F.avg("score").alias("average_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"))


class Rolling(StatefulProcessor):
    """Keyed state of one stream: its last scores, frame count and last alert's time.

    A row with ``reset`` true clears the state.  Rows of one batch are taken in
    (ts, event_id) order.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scores = handle.getListState("scores", "score int")
        self.count = handle.getValueState("count", "n long")
        self.last = handle.getValueState("last", "t double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        scores = [s for (s,) in self.scores.get()] if self.scores.exists() else []
        n = self.count.get()[0] if self.count.exists() else 0
        last = self.last.get()[0] if self.last.exists() else None
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for r in batch.itertuples(index=False):
            if r.reset:
                scores, n, last = [], 0, None
                continue
            scores = [*scores, int(r.score)][-WINDOW:]
            n += 1
            mean = sum(scores) / len(scores)
            t = r.ts.timestamp()
            alert = mean >= HIGH and (last is None or t - last > COOLDOWN_SECONDS)
            last = t if alert else last
            out.append((key[0], r.event_id, r.ts, mean, n, "high" if mean >= HIGH else "medium" if mean >= MEDIUM else "low", alert))
        self.scores.clear()
        if scores:
            self.scores.put([(s,) for s in scores])
        self.count.update((n,))
        if last is None:
            self.last.clear()
        else:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["stream_id", "event_id", "ts", "mean", "frame_count", "band", "alert"])

    def close(self) -> None:
        pass


def stream_states(rows: DataFrame, watermark: str = "1 minute") -> DataFrame:
    """Streaming form of :func:`states`, with alerts; input (stream_id, event_id, ts, score[, reset]).

    Rows later than the watermark are dropped.  Needs the RocksDB state store.
    """
    if "reset" not in rows.columns:
        rows = rows.withColumn("reset", F.lit(False))
    return rows.withWatermark("ts", watermark).groupBy("stream_id").transformWithStateInPandas(Rolling(), STATES, "Append", "EventTime")


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that keyed state needs, for streams started inside; the session's own setting comes back."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_states(rows: DataFrame, sink: str, checkpoint: str, watermark: str = "1 minute") -> None:
    """Takes what has arrived of a stream of scores through :func:`stream_states` into parquet files at ``sink``.

    Ends when the files there at its start are taken.  A next call with the same
    checkpoint goes on with every stream's scores, count and last alert, and
    takes no file twice; the sink shows whole batches only.
    """
    with keyed_state(rows.sparkSession):
        query = stream_states(rows, watermark).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()


class Cancelled(Exception):
    """A scan found its cancel mark before a batch."""


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def cancel(spark: SparkSession, mark: str) -> None:
    """Asks the scan that watches ``mark`` to stop before its next batch; any session that sees the folder can ask."""
    fs, path = _path(spark, mark)
    fs.create(path, True).close()


def allow(spark: SparkSession, mark: str) -> None:
    """Takes the cancel mark away, so that the scan can be started again."""
    fs, path = _path(spark, mark)
    fs.delete(path, False)


def incremental(source: DataFrame, transform, sink: str, checkpoint: str, mark: str | None = None, after: Callable[[int], None] | None = None):
    """A stream that applies ``transform`` to each micro-batch of items and writes parquet; resumes from its checkpoint.

    Each batch is a partition ``batch_id`` of its own and replaces it, so a batch
    that is replayed after a failure is not written twice; its progress (rows
    and time) is a row of ``<sink>_progress`` in the same way, written last.
    Where a cancel mark is given and there, the stream ends before its next
    batch with nothing of it done (see :func:`outcome`).  ``after`` is called
    with the number of each batch done.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if mark is not None:
            fs, path = _path(spark, mark)
            if fs.exists(path):
                raise Cancelled(f"before batch {number}")
        done = transform(batch)
        done.write.mode("overwrite").parquet(f"{sink}/batch_id={number}")
        written = spark.read.parquet(f"{sink}/batch_id={number}")
        written.agg(F.count("*").alias("rows"), F.current_timestamp().alias("finished")).write.mode("overwrite").parquet(f"{sink}_progress/batch_id={number}")
        if after is not None:
            after(number)

    return source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcome(query) -> str:
    """Waits for a scan: "done", or "cancelled" if it stopped at its cancel mark; other failures are raised."""
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if "Cancelled: before batch" not in str(e):
            raise
        return "cancelled"
    return "done"


def partial_results(spark: SparkSession, sink: str) -> DataFrame:
    """What a scan has done so far: the rows of all batches whose progress is written, the scan running or not."""
    done = spark.read.parquet(f"{sink}_progress").select("batch_id")
    return spark.read.parquet(sink).join(done, "batch_id", "left_semi")
