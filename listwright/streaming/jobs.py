"""Micro-batch versions of the stateful operators, on file streams with ``availableNow``.

Each returns a streaming DataFrame; ``run_to_table`` drives one to its end and gives the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState

#: The store that keeps state on disk; set it on the session before a stream of much state starts.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def seen_stream(events: DataFrame, key: str, at: str) -> DataFrame:
    return events.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("n"))


def tumbling(events: DataFrame, at: str, size: str, late: str, *keys: str) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count(F.lit(1)).alias("n"))


def sliding(events: DataFrame, at: str, size: str, step: str, late: str, *keys: str) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, size, step), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, at: str, gap: str, late: str, key: str) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n"))


def deduplicated(events: DataFrame, at: str, late: str, *keys: str) -> DataFrame:
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


#: Keys are dealt to so many parts; a part's waiting rows and last values are one entry of the state.
CHANGE_PARTS = 1024


def _changes(keep: int) -> Callable:
    """A part's rows wait until the watermark has passed them, and are then told in order, all of its keys at once.

    One timer a part: at the earliest row that waits, or when a last value is forgotten. Times are microseconds.
    """
    import numpy as np
    import pandas as pd

    row, held = np.dtype([("key", "i8"), ("at", "i8"), ("tie", "i8"), ("value", "f8")]), np.dtype([("key", "i8"), ("at", "i8"), ("value", "f8")])

    def ends(a, *names: str):
        """Where the next row differs in one of the names."""
        out = np.ones(len(a), bool)
        if len(a):
            out[:-1] = np.logical_or.reduce([a[n][1:] != a[n][:-1] for n in names])
        return out

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, before = state.get if state.exists else (b"", b"")
        rows, last = [np.frombuffer(kept, row)], np.frombuffer(before, held)
        for frame in frames:
            if len(frame):
                new = np.empty(len(frame), row)
                for n, c in zip(row.names, ("key", "micros", "tie", "value"), strict=True):
                    new[n] = frame[c].to_numpy()
                rows.append(new)
        rows = np.concatenate(rows)
        rows = rows[np.lexsort((rows["tie"], rows["at"], rows["key"]))]
        rows = rows[ends(rows, "key", "at", "tie")]
        passed = state.getCurrentWatermarkMs() * 1000
        told, waiting = rows[rows["at"] <= passed], rows[rows["at"] > passed]
        if len(told):
            then, old, known = np.empty(len(told), "i8"), np.empty(len(told)), np.zeros(len(told), bool)
            final = ends(told, "key")
            first = np.concatenate(([True], final[:-1]))
            then[1:], old[1:], known[1:] = told["at"][:-1], told["value"][:-1], ~first[1:]
            if len(last):
                place = np.minimum(np.searchsorted(last["key"], told["key"]), len(last) - 1)
                mine = first & (last["key"][place] == told["key"])
                then[mine], old[mine], known[mine] = last["at"][place[mine]], last["value"][place[mine]], True
            known &= told["at"] - np.where(known, then, 0) <= keep
            changed = ~known | (old != told["value"])
            if changed.any():
                yield pd.DataFrame({"key": told["key"], "at": told["at"], "old_value": np.where(known, old, np.nan), "new_value": told["value"]})[changed]
            ended = np.empty(final.sum(), held)
            for n in held.names:
                ended[n] = told[n][final]
            last = np.concatenate([last[~np.isin(last["key"], ended["key"])], ended])
            last = last[np.argsort(last["key"])]
        last = last[last["at"] + keep > passed]
        if not len(waiting) and not len(last):
            if state.exists:
                state.remove()
            return
        state.update((waiting.tobytes(), last.tobytes()))
        wake = min([*([waiting["at"].min()] if len(waiting) else []), *([last["at"].min() + keep] if len(last) else [])])
        # A timer goes off once the watermark is beyond it, in whole milliseconds: one before the first that passes the row.
        state.setTimeoutTimestamp(max(int(-(-wake // 1000)) - 1, 1))

    return run


def price_changes(events: DataFrame, key: str, at: str, value: str, tie: str, late: str, keep_days: int) -> DataFrame:
    """(key, at, old, new) whenever a key's value differs from the one before it in event time.

    Rows may come out of order within ``late``; those behind the watermark are dropped. A value is told once
    the watermark has passed it, so no later row can change what was before it. A last value older than
    ``keep_days`` is forgotten: the next one has none before it. Rows of one time go by ``tie``; null values
    say nothing. Rows that wait are in the state store by part of the keys; a task holds one part's at a time.
    """
    rows = events.filter(F.col(value).isNotNull() & F.col(key).isNotNull()).withWatermark(at, late)
    rows = rows.select(F.pmod(F.xxhash64(key), F.lit(CHANGE_PARTS)).alias("part"), at, F.col(key).cast("long").alias("key"), F.unix_micros(at).alias("micros"), F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("value"))
    out = "key long, at long, old_value double, new_value double"
    told = rows.groupBy("part").applyInPandasWithState(_changes(keep_days * 86_400_000_000), out, "waiting binary, last binary", "append", "EventTimeTimeout")
    return told.withColumn("at", F.timestamp_micros("at"))


class ProgressLog(StreamingQueryListener):
    """Writes each batch's progress as a row of a table: query, batch, rows, dropped rows, rows of state, newest event."""

    SCHEMA = "query string, batch long, at string, rows long, dropped long, state_rows long, newest string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.running: set = set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.running.add(event.runId)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        states = p.stateOperators
        row = (p.name, p.batchId, p.timestamp, p.numInputRows, sum(x.numRowsDroppedByWatermark for x in states), sum(x.numRowsTotal for x in states), p.eventTime.get("max"))
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.running.discard(event.runId)


def logged(spark: SparkSession, path: str, run: Callable[[], object], timeout: int = 60) -> DataFrame:
    """The progress rows that ``run``'s queries leave; another thread tells them, each query's end after its last."""
    import time

    log = ProgressLog(spark, path)
    spark.streams.addListener(log)
    try:
        run()
        until = time.time() + timeout
        while log.running and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    return spark.read.schema(ProgressLog.SCHEMA).parquet(path)


#: The sent set is stored by this many buckets of its key; a batch reads only the buckets it touches.
SENT_BUCKETS = 64


def sent_bucket(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(SENT_BUCKETS)).cast("int")


def deliver_once(spark: SparkSession, alerts: DataFrame, sent_path: str, checkpoint: str, deliver: Callable[[Iterator[dict], str], bool], step: Callable[[str], None] = lambda _: None) -> None:
    """Batches of alerts whose keys weren't sent; keys count as sent only if the whole batch was delivered.

    A batch goes through three tables, each written under its number, so that a batch that is run again finds
    what was done: the outbox holds what it sends, chosen once; the ledger says that all of it went out; the
    sent set gets the outbox's keys. A crash anywhere between them is made up for by the next run, which
    neither chooses, delivers nor appends twice. ``deliver`` gets each partition's rows where they are, and
    a token of stream, batch and partition by which a receiver knows what it already got: that covers a crash
    inside of it. Nothing but one verdict a partition comes to the driver; a failed part raises, so the
    stream's checkpoint doesn't pass it. The sent set is partitioned by a bucket of the key. ``step`` is
    called before each of the steps.
    """
    import hashlib

    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    outbox, ledger = f"{checkpoint}-outbox", f"{checkpoint}-ledger"

    def done(path: str) -> bool:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def parts(number: int):
        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ok, n, token = True, 0, f"{stream}:{number}:{TaskContext.get().partitionId()}"
            for k, frame in enumerate(frames):
                rows = frame.to_pylist()
                n += len(rows)
                ok = bool(deliver(iter(rows), f"{token}:{k}")) and ok
            yield pa.RecordBatch.from_arrays([pa.array([ok]), pa.array([n], pa.int64())], names=["ok", "n"])

        return run

    def batch(df: DataFrame, number: int) -> None:
        box, mark = f"{outbox}/{number}", f"{ledger}/{number}"
        if not done(box):
            step("choose")
            keyed = df.withColumn("bucket", sent_bucket(F.col("url")))
            touched = [r["bucket"] for r in keyed.select("bucket").distinct().collect()]  # at most SENT_BUCKETS
            sent = spark.read.schema("url string, bucket int").parquet(sent_path).filter(F.col("bucket").isin(*touched) if touched else F.lit(False))
            fresh = keyed.join(sent.select("bucket", "url"), ["bucket", "url"], "left_anti").dropDuplicates(["bucket", "url"])
            fresh.write.mode("overwrite").parquet(box)
        chosen = spark.read.parquet(box)
        if not done(mark):
            step("deliver")
            verdict = chosen.drop("bucket").mapInArrow(parts(number), "ok boolean, n long").agg(F.bool_and("ok").alias("ok"), F.sum("n").alias("n")).first()
            if verdict["ok"] is False:
                raise RuntimeError("not all messages were delivered")
            step("mark")
            spark.createDataFrame([(stream, number, verdict["n"] or 0)], "stream string, batch long, messages long").coalesce(1).write.mode("overwrite").parquet(mark)
        step("append")
        part = chosen.select("url", F.lit(f"{stream}-{number}").alias("batch"), "bucket")
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(sent_path)
        step("end")

    alerts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def prime_sent(urls: DataFrame, sent_path: str) -> None:
    """A first run's state: everything there is counts as sent, and nothing is."""
    urls.select("url").distinct().withColumns({"bucket": sent_bucket(F.col("url")), "batch": F.lit("first")}).write.partitionBy("bucket", "batch").parquet(sent_path)


def run_to_table(df: DataFrame, folder: str, mode: str = "complete", timeout: int = 600, keys: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Runs a stream over what is there, into a table, and gives the table.

    Append mode writes Parquet; complete mode replaces the table with each batch's result; update mode
    appends each batch's changed rows, of which the last of each of ``keys`` counts.
    """
    spark = df.sparkSession
    path = f"{folder}/{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint")
    writer = writer.queryName(name) if name else writer
    if mode == "append":
        query = writer.format("parquet").start(f"{path}/out")
    elif mode == "update":
        query = writer.foreachBatch(lambda b, i: b.withColumn("batch_", F.lit(i).cast("long")).write.mode("append").parquet(f"{path}/out")).start()
    else:
        query = writer.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{path}/out")).start()
    try:
        if not query.awaitTermination(timeout):
            raise TimeoutError("the stream didn't end")
    finally:
        query.stop()
    out = spark.read.parquet(f"{path}/out")
    if mode != "update":
        return out
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), "batch_").alias("x"))
    return last.select("x.*")
