"""Streaming operators on ``events``, run to their end and compared with their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from listwright.operators import reporting
from listwright.plans.catalog import query, table
from listwright.sources.shared import shared_dir
from listwright.streaming import jobs


#: Files that the events are dealt to, one micro-batch each, and the rows that come a file late.
FILES, LATE = 3, 50
#: The late stream: more files, rows that come one file late and are in time, and rows three files late, most of them too late.
LATE_FILES, IN_TIME, TOO_LATE, DELAY_DAYS = 6, 7, 13, 6
_LANDED: dict[tuple[str, str, object], str] = {}


def landed(spark, sf_dir, late: bool) -> str:
    """A folder of event files in time order; with ``late``, one event in so many comes with the next file."""
    key = (spark.sparkContext.applicationId, sf_dir, late)
    if key not in _LANDED:
        events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
        first, last = events.agg(F.min("ts"), F.max("ts")).first()
        step = (last - first) / FILES
        part = F.least(F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) / F.lit(step.total_seconds() * 1e6)), F.lit(FILES - 1))
        if late:
            part = F.least(part + (F.col("event_id") % LATE == 7).cast("int"), F.lit(FILES - 1))
        _LANDED[key] = dealt(spark, events.withColumn("part", part), FILES)
    return _LANDED[key]


def dealt(spark, events, files: int) -> str:
    """A folder of folders, a micro-batch's files each, whose times follow one another (so a job each)."""
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    for k in range(files):
        rows = events.filter(F.col("part") == k).drop("part")
        rows.repartition(1).write.mode("append").parquet(path)
    return path


def late_landed(spark, sf_dir, files: int) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, files)
    if key not in _LANDED:
        events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
        day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
        wait = F.when(F.col("event_id") % LATE == IN_TIME, 1).when(F.col("event_id") % LATE == TOO_LATE, 3).otherwise(0)
        part = F.least(F.greatest(F.floor(day / 5), F.lit(0)) + wait, F.lit(LATE_FILES - 1))
        _LANDED[key] = dealt(spark, events.withColumn("part", part), files)
    return _LANDED[key]


def late_stream(spark, sf_dir, files: int = LATE_FILES):
    """The first files of the late stream, all by default."""
    path = late_landed(spark, sf_dir, files)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


#: The late stream's rows with the watermark (whole milliseconds) that each batch drops by, that of the batch before it, and the last one.
_BATCHES = f"""b AS (SELECT *, least(greatest(CAST(ts AS DATE) - DATE '2024-01-01', 0) // 5 + CASE event_id % {LATE} WHEN {IN_TIME} THEN 1 WHEN {TOO_LATE} THEN 3 ELSE 0 END, {LATE_FILES - 1}) AS part FROM events),
  w AS (SELECT part, date_trunc('milliseconds', max(max(ts)) OVER (ORDER BY part)) - INTERVAL {DELAY_DAYS} DAY AS mark FROM b GROUP BY part),
  r AS (SELECT b.*, w.mark, (SELECT max(mark) FROM w) AS last_mark FROM b LEFT JOIN w ON w.part = b.part - 2)"""


def stream(spark, sf_dir, late=True):
    path = landed(spark, sf_dir, late)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def ended(spark, df, mode="complete", keys=()):
    return jobs.run_to_table(df, f"{shared_dir(spark)}/streams", mode, keys=keys)


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1")
def seen_stream(spark, sf_dir):
    return ended(spark, jobs.seen_stream(stream(spark, sf_dir), "user_id", "ts"), "update", ["user_id"])


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window(spark, sf_dir):
    """Windows are updated batch by batch and leave the state once no event can be late enough."""
    got = ended(spark, jobs.tumbling(stream(spark, sf_dir), "ts", "1 hour", "21 days", "event_type"), "update", ["window", "event_type"])
    return got.select(F.col("window.start").alias("w"), "event_type", "n")


@query("SELECT w, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS w FROM events) GROUP BY 1")
def sliding_window(spark, sf_dir):
    got = ended(spark, jobs.sliding(stream(spark, sf_dir), "ts", "2 hours", "1 hour", "2 hours"))
    return got.select(F.col("window.start").alias("w"), "n")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM g) SELECT user_id, min(ts) AS start_ts, count(*) AS n FROM k GROUP BY user_id, i")
def session_gap(spark, sf_dir):
    got = ended(spark, jobs.sessions(stream(spark, sf_dir), "ts", "6 hours", "2 hours", "user_id"))
    return got.select("user_id", F.col("session_window.start").alias("start_ts"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedup_watermark(spark, sf_dir):
    got = ended(spark, jobs.deduplicated(stream(spark, sf_dir), "ts", "60 days", "user_id", "event_type"), "append")
    return got.select("user_id", "event_type")


@query(
    "WITH " + _BATCHES + """, k AS (SELECT * FROM r WHERE mark IS NULL OR ts > mark)
  SELECT key, "at", old_value, new_value FROM (SELECT user_id AS key, ts AS "at", value AS new_value, CASE WHEN ts - lag(ts) OVER u <= INTERVAL 4 DAY THEN lag(value) OVER u END AS old_value, last_mark FROM k WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id))
  WHERE "at" <= last_mark AND new_value IS DISTINCT FROM old_value"""
)
def price_change_stream(spark, sf_dir):
    """Changes told in event time although rows come late; those behind the watermark are left out, old values forgotten."""
    spark.conf.set(*jobs.ROCKS)
    return ended(spark, jobs.price_changes(late_stream(spark, sf_dir), "user_id", "ts", "value", "event_id", f"{DELAY_DAYS} days", 4), "append")


@query("WITH " + _BATCHES + """ SELECT time_bucket(INTERVAL '1 day', ts) AS w, event_type, count(*) AS n FROM r WHERE (mark IS NULL OR time_bucket(INTERVAL '1 day', ts) + INTERVAL 1 DAY > mark)
  AND time_bucket(INTERVAL '1 day', ts) + INTERVAL 1 DAY <= last_mark GROUP BY 1, 2""")
def late_window(spark, sf_dir):
    """Days, each told once when the watermark has passed it; later rows are dropped, and days that are told leave the state."""
    got = ended(spark, jobs.tumbling(late_stream(spark, sf_dir), "ts", "1 day", f"{DELAY_DAYS} days", "event_type"), "append")
    return got.select(F.col("window.start").alias("w"), "event_type", "n")


@query("WITH " + _BATCHES + """
  SELECT user_id, min(ts) AS start_ts, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS s FROM r WHERE event_id % 50 NOT IN (7, 13)))
  GROUP BY user_id, i HAVING max(ts) + INTERVAL 6 HOUR <= any_value(last_mark)""")
def late_session(spark, sf_dir):
    """Sessions of the rows that come in order, each told once it can't grow any more."""
    rows = late_stream(spark, sf_dir).filter(~(F.col("event_id") % LATE).isin(IN_TIME, TOO_LATE))
    got = ended(spark, jobs.sessions(rows, "ts", "6 hours", f"{DELAY_DAYS} days", "user_id"), "append")
    return got.select("user_id", F.col("session_window.start").alias("start_ts"), "n")


@query("WITH " + _BATCHES + """, q AS (SELECT 'whole' AS query, b.* FROM b UNION ALL SELECT 'stopped', b.* FROM b WHERE part < 2)
  SELECT query, count(DISTINCT part) AS batches, count(*) AS rows, date_trunc('milliseconds', max(ts)) AS newest, max(ts) >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 30 HOUR AS fresh FROM q GROUP BY 1""")
def watchdog(spark, sf_dir):
    """Two streams by what a listener wrote of their progress: one that read all, and one that stopped after two files."""
    path = f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}"

    def run():
        for name, files in (("whole", LATE_FILES), ("stopped", 2)):
            jobs.run_to_table(jobs.tumbling(late_stream(spark, sf_dir, files), "ts", "1 day", f"{DELAY_DAYS} days"), f"{shared_dir(spark)}/streams", "append", name=name)

    got = reporting.freshness(jobs.logged(spark, path, run), F.lit("2024-01-30 12:00:00").cast("timestamp"), 30)
    return got.drop("dropped")
