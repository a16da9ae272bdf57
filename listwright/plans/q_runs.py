"""Queries of what one run leaves to the next: landed files, replaced parts, carried fields, sent alerts, schedules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from listwright.operators import history, matching, reporting
from listwright.plans.catalog import query, table
from listwright.sources import landed
from listwright.sources.shared import shared_dir
from listwright.streaming import jobs


def folder(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, nullif(o_orderstatus, 'F') AS o_orderstatus, 'say \"' || o_orderpriority || '\", ' AS said, 0 AS source_priority FROM orders")
def csv_landed(spark, sf_dir):
    """Rows written as CSV and read back as strings; of two files one exists."""
    path = folder(spark, "csv")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("o_orderstatus"), F.concat(F.lit('say "'), "o_orderpriority", F.lit('", ')).alias("said"))
    rows.write.options(header=True, escape='"', ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False).csv(path)
    return landed.read_existing_csv(spark, [path, f"{path}-none"]).select("o_orderkey", "o_orderstatus", "said", "source_priority")


@query("SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS run, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' OR o_custkey % 2 = 0 GROUP BY 1, 2 UNION ALL SELECT 'log', 0, count(*) * 2 FROM orders")
def parts_replaced(spark, sf_dir):
    """Only the sources of a run are replaced, and logs only grow."""
    o, path, log = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), folder(spark, "parts"), folder(spark, "log")
    landed.replace_sources(spark, o.withColumn("run", F.lit(0)), path, "o_orderstatus")
    landed.replace_sources(spark, o.filter("o_orderstatus = 'F' and o_custkey % 2 = 0").withColumn("run", F.lit(1)), path, "o_orderstatus")
    for _ in range(2):
        landed.append_log(o.select("o_orderkey"), log)
    kept = spark.read.parquet(path).groupBy("o_orderstatus", "run").agg(F.count(F.lit(1)).alias("n"))
    return kept.unionByName(spark.read.parquet(log).agg(F.lit("log").alias("o_orderstatus"), F.lit(0).alias("run"), F.count(F.lit(1)).alias("n")))


_SIDE = "SELECT o_custkey AS url, max(o_totalprice) AS price, CAST(min(o_orderdate) AS DATE) AS date_published, CAST(max(o_orderdate) AS DATE) AS date_updated, CAST(min(o_orderkey) AS DOUBLE) AS lat, CAST(max(o_orderkey) AS DOUBLE) AS lon FROM {t} WHERE {w} GROUP BY 1"


@query(f"""WITH a AS ({_SIDE.format(t='orders', w="o_orderstatus = 'F'")}), b AS ({_SIDE.format(t='orders', w="o_orderstatus = 'O'")}) SELECT coalesce(b.url, a.url) AS url, coalesce(b.price, a.price) AS price,
  least(b.date_published, a.date_published) AS date_published, greatest(b.date_updated, a.date_updated) AS date_updated, coalesce(a.lat, b.lat) AS lat, coalesce(a.lon, b.lon) AS lon FROM a FULL JOIN b ON a.url = b.url""")
def carried_fields(spark, sf_dir):
    """Known rows and new ones: the first publication and the latest update survive, a point stays once read."""
    o = table(spark, sf_dir, "orders")
    old, new = (spark.sql(_SIDE.format(t="{o}", w=f"o_orderstatus = '{s}'"), o=o) for s in "FO")
    return history.carry_over(old, new, "url")


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS url FROM orders")
def alerts_delivered_once(spark, sf_dir):
    """The sent set after a primed first run and two deliveries of the same alerts: every key once."""
    urls = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("url"))
    feed, sent = folder(spark, "alerts"), folder(spark, "sent")
    urls.write.parquet(feed)
    jobs.prime_sent(matching.first_run(None, urls.filter("url < '5'").select(F.array("url").alias("urls")))[1], sent)
    for _ in range(2):
        jobs.deliver_once(spark, spark.readStream.schema("url string").parquet(feed), sent, folder(spark, "alerts-checkpoint"), lambda rows, _: all(True for _ in rows))
    return spark.read.parquet(sent).select("url")


@query("""SELECT event_id, CASE WHEN hour(t) >= 18 THEN date_trunc('day', t) + INTERVAL 18 HOUR WHEN hour(t) >= 6 THEN date_trunc('day', t) + INTERVAL 6 HOUR ELSE date_trunc('day', t) - INTERVAL 6 HOUR END AS due
  FROM (SELECT event_id, CAST(ts AS TIMESTAMP) - INTERVAL 4 HOUR AS t FROM events)""")
def due_starts(spark, sf_dir):
    """The latest scheduled start that was due at each event."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.select("event_id", reporting.last_due_start([6, 18], F.col("ts"), 4).cast("timestamp_ntz").alias("due"))


@query("""SELECT o_custkey FROM (SELECT o_custkey, max(CASE WHEN o_custkey % 2 = 0 THEN 3 ELSE 12 END) AS pages, count(DISTINCT o_orderkey % 13) AS read FROM orders GROUP BY 1) WHERE read >= pages""")
def complete_parts(spark, sf_dir):
    """Parts of which all pages were read."""
    progress = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_custkey") % 2 == 0, 3).otherwise(12).alias("pages"), (F.col("o_orderkey") % 13).alias("page"))
    return history.completed_parts(progress, "o_custkey", "pages", "page")


@query("""SELECT CAST(round_even(sum(o_orderkey % 100) / 60, 0) AS BIGINT) AS minutes, count(*) FILTER (o_orderkey % 500 = 7) AS n_failed,
  string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) FILTER (o_orderkey % 500 = 7) AS failed FROM orders""")
def run_minutes(spark, sf_dir):
    """A run's minutes and its failed steps."""
    steps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("name"), (F.col("o_orderkey") % 100).alias("seconds"), (F.col("o_orderkey") % 500 == 7).cast("int").alias("code"))
    return reporting.run_summary(steps)


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 4 > 0 AND NOT (o_custkey % 3 = 0 AND CAST(o_orderdate AS DATE) >= DATE '1998-01-01' - 60) AND NOT (o_custkey % 3 = 1 AND CAST(o_orderdate AS DATE) >= DATE '1998-01-01' - 7)""")
def hints_due(spark, sf_dir):
    """Listings whose page is to be read for a district: found ones after 60 days, empty ones after 7."""
    o = table(spark, sf_dir, "orders").withColumn("url", F.col("o_orderkey").cast("string"))
    rows = o.select("url", "o_orderkey", F.when(F.col("o_orderstatus") == "P", "portal").otherwise("site").alias("source_domain"), F.lit("unknown").alias("region"), F.when(F.col("o_custkey") % 4 == 0, "North").otherwise("City").alias("area"), F.lit("listing").alias("region_how"))
    k = F.col("o_custkey") % 3
    hints = o.filter("o_custkey % 3 < 2").select("url", F.to_date("o_orderdate").alias("checked_at"), F.when(k == 0, "text").otherwise("").alias("how"))
    return history.hint_due(rows, hints, F.lit("1998-01-01").cast("date"), ["portal"], "City").select("o_orderkey")
