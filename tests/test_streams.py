"""Late rows, forgotten keys, progress and deliveries that crash."""

import datetime as dt

import pytest
from listwright.operators import reporting
from listwright.streaming import jobs
from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)


def landed(spark, tmp_path, *batches):
    """A folder with one file of (key, hours, id, value) a batch, and its stream."""
    path = str(tmp_path / "events")
    for rows in batches:
        made = [(k, START + dt.timedelta(hours=h), i, v) for k, h, i, v in rows]
        spark.createDataFrame(made, "k long, ts timestamp, id long, v double").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("k long, ts timestamp, id long, v double").option("maxFilesPerTrigger", 1).parquet(path)


def test_changes_are_told_in_event_time_and_keys_are_forgotten(spark, tmp_path):
    spark.conf.set(*jobs.ROCKS)
    stream = landed(
        spark, tmp_path,
        [(1, 0, 1, 5.0), (1, 30, 2, 7.0), (2, 1, 3, 1.0), (None, 1, 90, 1.0), (3, 2, 91, None)],
        [(1, 20, 4, 6.0), (1, 30, 5, 7.0), (1, 60, 6, 8.0)],  # the first is late, in time
        [(2, 400, 7, 1.0), (1, 61, 8, 8.0)],  # key 2 was forgotten: its equal value is told again
        [(1, 10, 9, 99.0), (9, 500, 10, 1.0)],  # the first is behind the watermark
        [(9, 2000, 11, 1.0)],
    )
    path = f"{tmp_path}/progress"
    out = {}

    def run():
        out["rows"] = jobs.run_to_table(jobs.price_changes(stream, "k", "ts", "v", "id", "24 hours", 10), str(tmp_path / "run"), "append", name="changes")

    progress = jobs.logged(spark, path, run).orderBy("batch").collect()
    got = sorted((r.key, (r["at"] - START).total_seconds() / 3600, r.old_value, r.new_value) for r in out["rows"].collect())
    assert got == [(1, 0, None, 5.0), (1, 20, 5.0, 6.0), (1, 30, 6.0, 7.0), (1, 60, 7.0, 8.0), (2, 1, None, 1.0), (2, 400, None, 1.0), (9, 500, None, 1.0)]
    assert sum(p.dropped for p in progress) == 1
    # What is left: the last row of key 9, which the watermark hasn't passed, and its timer; 1 and 2 are gone.
    assert progress[-1].state_rows < max(p.state_rows for p in progress)


def test_windows_are_told_once_and_leave_the_state(spark, tmp_path):
    stream = landed(spark, tmp_path, [(1, 1, 1, 0.0), (1, 50, 2, 0.0)], [(1, 2, 3, 0.0), (1, 80, 4, 0.0)], [(1, 3, 5, 0.0), (1, 120, 6, 0.0)])
    path, out = f"{tmp_path}/progress", {}

    def run():
        out["rows"] = jobs.run_to_table(jobs.tumbling(stream, "ts", "1 day", "24 hours"), str(tmp_path / "run"), "append", name="days")

    progress = jobs.logged(spark, path, run).orderBy("batch").collect()
    days = sorted(((r.window.start - START).days, r.n) for r in out["rows"].collect())
    assert days == [(0, 2), (2, 1), (3, 1)]  # of three rows of the first day, the last came behind the watermark
    assert sum(p.dropped for p in progress) == 1
    assert progress[-1].state_rows == 1  # the day of hour 120
    told = reporting.freshness(spark.read.schema(jobs.ProgressLog.SCHEMA).parquet(path), F.lit("2024-01-06 12:00:00").cast("timestamp"), 13).first()
    assert (told["query"], told.batches, told["rows"], told.dropped, told.fresh) == ("days", 3, 6, 1, True)
    late = reporting.freshness(spark.read.schema(jobs.ProgressLog.SCHEMA).parquet(path), F.lit("2024-01-06 12:00:00").cast("timestamp"), 11).first()
    assert late.fresh is False


@pytest.mark.parametrize("crash", ["choose", "deliver", "mark", "append", "end"])
def test_a_crash_at_any_step_neither_resends_nor_loses(spark, tmp_path, crash):
    """Deliveries are written under their token, as a receiver keeps them that knows what it already got."""
    sent, feed, out = str(tmp_path / "sent"), str(tmp_path / "feed"), tmp_path / "out"
    out.mkdir()
    jobs.prime_sent(spark.createDataFrame([("old",)], "url string"), sent)
    spark.createDataFrame([("old",), ("a",), ("b",), ("b",)], "url string").write.parquet(feed)
    stream = lambda: spark.readStream.schema("url string").parquet(feed)

    def deliver(rows, token):
        got = sorted(r["url"] for r in rows)
        if got:
            kept = out / token.replace(":", "_")
            with open(f"{kept}.calls", "a") as calls:
                calls.write("x")
            kept.write_text(",".join(got))
        return True

    def step(name):
        if name == crash:
            raise RuntimeError(name)

    with pytest.raises(Exception, match=crash):
        jobs.deliver_once(spark, stream(), sent, str(tmp_path / "c"), deliver, step)
    for _ in range(2):
        jobs.deliver_once(spark, stream(), sent, str(tmp_path / "c"), deliver)
    got = [u for p in out.iterdir() if p.suffix != ".calls" for u in p.read_text().split(",")]
    assert sorted(got) == ["a", "b"]
    assert sorted(r.url for r in spark.read.parquet(sent).collect()) == ["a", "b", "old"]
    calls = [len(p.read_text()) for p in out.iterdir() if p.suffix == ".calls"]
    assert max(calls) == (2 if crash == "mark" else 1)  # only then is a delivery repeated, under its token
    spark.createDataFrame([("a",), ("c",)], "url string").write.mode("append").parquet(feed)
    jobs.deliver_once(spark, stream(), sent, str(tmp_path / "c"), deliver)
    assert sorted(r.url for r in spark.read.parquet(sent).collect()) == ["a", "b", "c", "old"]


def test_changes_of_many_keys_take_a_call_a_part(spark, tmp_path, monkeypatch):
    """Keys share parts of the state, and are told apart in them."""
    monkeypatch.setattr(jobs, "CHANGE_PARTS", 2)
    batches = [[(k, h + k % 3, 10 * k + h, float(h * k % 4)) for k in range(40) for h in range(s, s + 10)] for s in (0, 10, 20)]
    stream = landed(spark, tmp_path, *batches, [(99, 5000, 1, 0.0)], [(99, 9000, 2, 0.0)])
    log = f"{tmp_path}/progress"
    out = {}

    def run():
        out["rows"] = jobs.run_to_table(jobs.price_changes(stream, "k", "ts", "v", "id", "24 hours", 10), str(tmp_path / "run"), "append", name="parts")

    progress = jobs.logged(spark, log, run).collect()
    got = sorted((r.key, (r["at"] - START).total_seconds() / 3600, r.old_value, r.new_value) for r in out["rows"].collect() if r.key != 99)
    expected = []
    for k in range(40):
        before = None
        for h in range(30):
            if before != (v := float(h * k % 4)):
                expected.append((k, h + k % 3, before, v))
            before = v
    assert got == sorted(expected, key=lambda r: r[:2])
    assert max(p.state_rows for p in progress) <= 2  # an entry a part, not one a row
