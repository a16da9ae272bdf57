"""Queries of paged and resumable sources, over pages landed from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listwright.operators.ranges import ranked
from listwright.plans.catalog import query, table
from listwright.sources import paged
from listwright.sources.shared import shared_dir, written

PER_PAGE, POSTS = 50, 20
_BOX = "lat >= 40.2 AND lat <= 40.7 AND lon >= 22.1 AND lon <= 22.9"


def landed_orders(spark, sf_dir) -> str:
    """Orders as the search pages of four sites; one site's second page of bank sales is broken."""
    root = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    k = F.col("o_orderkey")
    point = F.array(40 + (k % 100) / 100, 22 + (k % 50) / 50)
    item = F.struct(F.concat(F.lit("n"), k).alias("id"), point.alias("coordinates"))
    site, segment = F.concat(F.lit("site"), F.col("o_custkey") % 4), F.when(F.col("o_orderstatus") == "F", "bank").otherwise("auction")
    rows = table(spark, sf_dir, "orders").select(site.alias("source"), segment.alias("segment"), k.alias("k"), item.alias("item"))
    rows = rows.withColumn("page", F.floor((F.row_number().over(Window.partitionBy("source", "segment").orderBy("k")) - 1) / PER_PAGE) + 1)
    listed = F.to_json(F.struct(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]).alias("listings")).alias("data")))
    broken = (F.col("source") == "site1") & (F.col("segment") == "bank") & (F.col("page") == 2)
    pages = rows.groupBy("source", "segment", "page").agg(listed.alias("body")).withColumn("body", F.when(broken, "{broken").otherwise(F.col("body")))
    paged.land(pages.select(F.format_string("%s/%s/%d.json", "source", "segment", "page").alias("name"), "body"), root)
    return root


@query(f"""WITH r AS (SELECT 'site' || (o_custkey % 4) AS source, CASE WHEN o_orderstatus = 'F' THEN 'bank' ELSE 'auction' END AS segment, o_orderkey AS k FROM orders),
  p AS (SELECT *, 40 + (k % 100) / 100 AS lat, 22 + (k % 50) / 50 AS lon, row_number() OVER (PARTITION BY source, segment ORDER BY k) - 1 AS i FROM r)
  SELECT source, CAST(i // {PER_PAGE} + 1 AS INTEGER) AS page, CAST(i % {PER_PAGE} AS INTEGER) AS place, lat, lon, 'n' || k AS id, FALSE AS failed FROM p
  WHERE segment = 'bank' AND i < 40 * {PER_PAGE} AND NOT (source = 'site1' AND i >= {PER_PAGE}) AND {_BOX}
  UNION ALL SELECT 'site1', 2, NULL, 40.2, 22.1, NULL, TRUE""")
def paged_search(spark, sf_dir):
    """One segment within a box, of all sites: the site that fails says so, and the others are whole."""
    paged.register(spark)
    rows = paged.searched(spark, landed_orders(spark, sf_dir), per_page=PER_PAGE).filter(f"segment = 'bank' AND {_BOX}")
    return rows.select("source", "page", "place", "lat", "lon", F.get_json_object("item", "$.id").alias("id"), F.col("error").isNotNull().alias("failed"))


def landed_channels(spark, sf_dir) -> str:
    """Orders as the posts of three channels, newest first, a page named by the number it ends before."""
    root = f"{shared_dir(spark)}/channels-{uuid.uuid4().hex}"
    channel = F.concat(F.lit("c"), F.col("o_custkey") % 3)
    rows = table(spark, sf_dir, "orders").select(channel.alias("channel"), F.col("o_orderkey").alias("post"))
    rows = ranked(rows, [F.col("channel"), -F.col("post")])
    first = rows.groupBy("channel").agg(F.min("rank_").alias("first"))
    rows = rows.join(first, "channel").withColumn("page", F.floor((F.col("rank_") - F.col("first")) / POSTS))
    block = F.transform(F.sort_array(F.collect_list("post"), asc=False), lambda p: F.concat(F.lit('<div data-post="x/'), p, F.lit('">post '), p, F.lit("</div>")))
    pages = written(rows.groupBy("channel", "page").agg(F.array_join(block, "").alias("body"), F.min("post").alias("before_next")), "channel-pages")
    before = pages.select("channel", (F.col("page") + 1).alias("page"), F.col("before_next").alias("before"))
    named = pages.join(before, ["channel", "page"], "left").select(F.concat_ws("/", "channel", F.concat(F.coalesce(F.col("before").cast("string"), F.lit("newest")), F.lit(".html"))).alias("name"), "body")
    paged.land(named, root)
    return root


@query("SELECT 'c' || (o_custkey % 3) AS channel, o_orderkey AS post, 'post ' || o_orderkey AS said FROM orders")
def channel_posts(spark, sf_dir):
    """All posts of the channels, read backwards by a stream that is stopped and goes on from its checkpoint."""
    paged.register(spark)
    root, out = landed_channels(spark, sf_dir), f"{shared_dir(spark)}/posts-{uuid.uuid4().hex}"

    def started(pages: int):
        source = spark.readStream.format("channel_posts").options(batch_pages=100, pages=pages).load(root)
        return source.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").start(f"{out}/rows")

    for pages in (100, 1_000_000):
        stream = started(pages)
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()
    return spark.read.parquet(f"{out}/rows").select("channel", "post", F.regexp_extract("html", ">([^<]*)<", 1).alias("said"))
