"""Queries over the listing view: normalisation, de-duplication, joins, roll-ups, reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listwright.functions.numbers import per_unit
from listwright.functions.text import url_key
from listwright.operators import gold, history, normalize, reporting
from listwright.plans.catalog import URL_KEY_SQL, listings, query, table, with_listings
from listwright.sources.landed import union_sources


@query(
    with_listings(
        f"""SELECT * FROM (SELECT l_partkey AS property_id, count(*) AS members, min(price_eur) AS price_min, max(price_eur) AS price_max,
  arg_min(url, (CASE WHEN source_kind <> 'portal' THEN 0 ELSE 1 END, -epoch(listing_date), ord)) AS url,
  min(first_seen) AS first_seen FROM
    (SELECT *, row_number() OVER (PARTITION BY {URL_KEY_SQL} ORDER BY ord) AS rn FROM lv) WHERE rn = 1 AND price_eur > 0 GROUP BY l_partkey)
  ORDER BY members DESC, property_id LIMIT 500"""
    )
)
def flagship_property_rollup(spark, sf_dir):
    """Union view, first-wins by URL, ranked main listing and price span per property, top 500 by size."""
    df = normalize.first_by_url(listings(spark, sf_dir, "ord", "url", "l_partkey", "source_kind", "listing_date", "price_eur", "first_seen")).filter("price_eur > 0")
    rank = F.struct(F.when(F.col("source_kind") != "portal", 0).otherwise(1), -F.unix_date("listing_date"), F.col("ord"))
    rolled = df.groupBy(F.col("l_partkey").alias("property_id")).agg(
        F.count(F.lit(1)).alias("members"), F.min("price_eur").alias("price_min"), F.max("price_eur").alias("price_max"),
        F.min_by("url", rank).alias("url"), F.min("first_seen").alias("first_seen"),
    )
    return rolled.orderBy(F.desc("members"), "property_id").limit(500)


@query("SELECT source_file, count(*) AS n, count(o_totalprice) AS with_price, count(l_quantity) AS with_area FROM (SELECT 'orders' AS source_file, o_totalprice, NULL AS l_quantity FROM orders UNION ALL SELECT 'lines', NULL, l_quantity FROM lineitem) GROUP BY 1")
def scan_union_sources(spark, sf_dir):
    both = union_sources({"orders": table(spark, sf_dir, "orders"), "lines": table(spark, sf_dir, "lineitem")})
    return both.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.count("o_totalprice").alias("with_price"), F.count("l_quantity").alias("with_area"))


@query(with_listings("SELECT ord, CAST(trunc(price_eur) AS BIGINT) AS price_eur, round_even(area_m2, 1) AS area_m2, CAST(round_even(price_eur / area_m2, 0) AS BIGINT) AS price_per_m2, source_kind = 'portal' AS is_portal FROM lv"))
def project_normalize(spark, sf_dir):
    return listings(spark, sf_dir, "ord", "price_eur", "area_m2", "source_kind").select(
        "ord", F.col("price_eur").cast("long").alias("price_eur"), F.bround("area_m2", 1).alias("area_m2"),
        per_unit(F.col("price_eur"), F.col("area_m2")).alias("price_per_m2"), (F.col("source_kind") == "portal").alias("is_portal"),
    )


@query("SELECT event_id, TRY_CAST(props AS DOUBLE) AS bad, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS good FROM events")
def try_casts(spark, sf_dir):
    from listwright.functions.numbers import number

    return table(spark, sf_dir, "events").select("event_id", number(F.col("props")).alias("bad"), number(F.get_json_object("props", "$.k")).alias("good"))



@query(
    with_listings(
        "SELECT ord FROM (SELECT ord, price_eur, area_m2, row_number() OVER (PARTITION BY source_domain, transaction, type, price_eur, area_m2 ORDER BY ord) AS rn FROM (SELECT ord, source_domain, transaction, type, nullif(floor(price_eur / 1000), 5) AS price_eur, area_m2 FROM lv)) WHERE rn = 1 OR price_eur IS NULL OR area_m2 IS NULL"
    )
)
def dedup_object(spark, sf_dir):
    df = listings(spark, sf_dir, "ord", "source_domain", "transaction", "type", "price_eur", "area_m2").withColumn("price_eur", F.nullif(F.floor(F.col("price_eur") / 1000).cast("double"), F.lit(5.0)))
    return normalize.first_by_object(df).select("ord")


@query(
    with_listings(
        """SELECT ord, CASE WHEN (transaction = 'sale' AND price_eur < 3000) OR (transaction = 'rent' AND price_eur > 20000)
  OR (transaction = 'sale' AND m > 0 AND price_eur / m < 250) THEN NULL ELSE price_eur END AS price_eur, m AS area_m2
  FROM (SELECT *, CASE WHEN area_m2 BETWEEN 5 AND 100000 THEN area_m2 END AS m FROM lv)"""
    )
)
def cross_field_nulls(spark, sf_dir):
    return normalize.validate(listings(spark, sf_dir, "ord", "url", "title", "transaction", "price_eur", "area_m2")).select("ord", "price_eur", "area_m2")



@query(with_listings("SELECT source_domain, CAST(sum(c) AS BIGINT) AS points, max(c) AS most FROM (SELECT source_domain, round(lat, 1) AS lat, lon, count(*) AS c FROM lv GROUP BY ALL) GROUP BY 1 HAVING sum(c) >= 5 AND max(c) > 0.5 * sum(c)"))
def mode_share(spark, sf_dir):
    return normalize.office_points(listings(spark, sf_dir, "source_domain", "lat", "lon").withColumn("lat", F.round("lat", 1)))


@query(
    with_listings(
        """, placed AS (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN region = 'EUROPE' THEN region ELSE 'other' END AS r FROM lv),
  home AS (SELECT source_domain FROM placed WHERE r IS NOT NULL AND source_kind <> 'portal' GROUP BY 1 HAVING count(*) >= 10 AND count_if(r = 'EUROPE') / count(*) >= 0.9)
  SELECT ord, coalesce(r, CASE WHEN source_domain IN (SELECT source_domain FROM home) THEN 'EUROPE' END) AS region FROM placed"""
    )
)
def agency_infer(spark, sf_dir):
    region = F.when(F.col("region") == "EUROPE", F.col("region")).otherwise(F.lit("other"))
    df = listings(spark, sf_dir, "ord", "l_partkey", "source_domain", "source_kind", "region").withColumn("region", F.when(F.col("l_partkey") % 3 != 0, region))
    return normalize.fill_from_agency(df, "EUROPE").select("ord", "region")




@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dim_join(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


SNAPSHOTS = """, before AS (SELECT o_custkey AS k, min(o_totalprice) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' GROUP BY 1),
  after AS (SELECT o_custkey AS k, min(o_totalprice) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_custkey % 3 > 0 GROUP BY 1)"""


def snapshots(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    by = lambda df: df.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_totalprice").alias("v"))
    return by(o.filter("o_orderdate < timestamp '1998-06-01'")), by(o.filter("o_orderdate >= timestamp '1997-01-01' and o_custkey % 3 > 0"))


@query("SELECT o_custkey AS url, CAST(min(o_orderdate) AS DATE) AS first_seen, CAST(max(o_orderdate) AS DATE) AS last_seen FROM orders GROUP BY 1")
def seen_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), F.col("o_orderdate").cast("date").alias("first_seen"), F.col("o_orderdate").cast("date").alias("last_seen"))
    return history.seen_merge(o.filter("first_seen < '1998-01-01'"), o.filter("first_seen >= '1998-01-01'"))


@query("WITH x AS (SELECT 1)" + SNAPSHOTS + " SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'new' WHEN a.k IS NULL THEN 'gone' WHEN a.v < b.v THEN 'down' WHEN a.v > b.v THEN 'up' ELSE 'same' END AS status, b.v AS old_value, a.v AS new_value FROM before b FULL JOIN after a ON a.k = b.k")
def snapshot_diff(spark, sf_dir):
    return history.snapshot_diff(*snapshots(spark, sf_dir), "k", "v")


@query("WITH x AS (SELECT 1)" + SNAPSHOTS + " SELECT k, v FROM before WHERE k NOT IN (SELECT k FROM after) AND k % 5 IN (0, 2)")
def removal_complete_parts(spark, sf_dir):
    before, after = (d.withColumn("part", F.col("k") % 5) for d in snapshots(spark, sf_dir))
    complete = spark.range(0, 3, 2).select(F.col("id").alias("part"))
    return history.removed(before, after, complete, "k", "part").select("k", "v")


@query("WITH x AS (SELECT 1)" + SNAPSHOTS + """, gone AS (SELECT k, v FROM before WHERE k NOT IN (SELECT k FROM after)), why AS (SELECT o_custkey AS k, arg_max(o_orderpriority, (o_orderdate, o_orderpriority)) AS reason
  FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-01' GROUP BY 1) SELECT k, v, reason FROM gone LEFT JOIN why USING (k)""")
def removal_reason(spark, sf_dir):
    """Gone rows with the reason logged last in the month or later."""
    before, after = snapshots(spark, sf_dir)
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("reason"))
    return history.removal_reasons(before.join(after.select("k"), "k", "left_anti"), log, "k", F.lit("1998-03-17").cast("date"))


@query("WITH k AS (SELECT l_suppkey, count(*) AS known FROM lineitem GROUP BY 1), g AS (SELECT l_suppkey, count(*) AS got FROM lineitem WHERE l_suppkey % 2 = 0 OR l_returnflag = 'A' GROUP BY 1) SELECT l_suppkey, known, coalesce(got, 0) AS got FROM k LEFT JOIN g USING (l_suppkey) WHERE known >= 20 AND coalesce(got, 0) < 0.5 * known")
def broken_source_guard(spark, sf_dir):
    known = table(spark, sf_dir, "lineitem")
    return history.broken_sources(known, known.filter("l_suppkey % 2 = 0 or l_returnflag = 'A'"), "l_suppkey")


CHANGES = """WITH c AS (SELECT * FROM (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old_price FROM orders) WHERE o_totalprice IS DISTINCT FROM old_price)"""


def changes(spark, sf_dir):
    return history.price_changes(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")


@query(CHANGES + " SELECT *, old_price IS NOT NULL AND abs(o_totalprice - old_price) <= 0.5 * old_price AS reportable FROM c")
def price_changes(spark, sf_dir):
    return changes(spark, sf_dir)


@query(CHANGES + " SELECT o_custkey, o_totalprice, old_price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM c) WHERE rn = 1 AND o_orderdate >= TIMESTAMP '1999-01-01' AND 1 - o_totalprice / old_price BETWEEN 0.01 AND 0.5")
def last_two_drop(spark, sf_dir):
    since = F.lit("1999-01-01").cast("timestamp")
    return history.last_drops(changes(spark, sf_dir), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", since, "o_orderdate").select("o_custkey", "o_totalprice", "old_price")


@query(CHANGES + " SELECT o_custkey, count(*) AS n FROM c GROUP BY 1 HAVING count(*) > 1")
def ever_changed(spark, sf_dir):
    return changes(spark, sf_dir).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(CHANGES + """ SELECT c_custkey, h FROM customer LEFT JOIN (SELECT o_custkey, string_agg(strftime(o_orderdate, '%Y-%m-%d') || '=' || CAST(floor(o_totalprice) AS BIGINT), ';' ORDER BY o_orderdate, floor(o_totalprice)) AS h
  FROM c GROUP BY 1 HAVING count(*) > 1) ON o_custkey = c_custkey""")
def price_history_lists(spark, sf_dir):
    """Each customer with the list of day and price of its changes, null where the price never changed."""
    c = changes(spark, sf_dir).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("day"), F.floor("o_totalprice").cast("long").alias("price"))
    got = history.with_history(table(spark, sf_dir, "customer").select("c_custkey"), c, "c_custkey", "day", "price")
    shown = F.array_join(F.transform("history", lambda x: F.concat_ws("=", x["day"].cast("string"), x["price"].cast("string"))), ";")
    return got.select("c_custkey", shown.alias("h"))


@query(CHANGES + """ SELECT n AS property_id, arg_min(o_custkey, (o_totalprice, o_custkey)) AS o_custkey, min(o_totalprice) AS new_price FROM (SELECT *, o_custkey % 40 AS n, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM c) WHERE rn = 1 AND 1 - o_totalprice / old_price BETWEEN 0.01 AND 0.5 GROUP BY 1""")
def group_price_drops(spark, sf_dir):
    """Of each property's members that dropped, the one with the lowest new price."""
    drops = history.last_drops(changes(spark, sf_dir), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", F.lit("1900-01-01").cast("timestamp"), "o_orderdate")
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 40).alias("property_id"))
    return history.group_drops(drops, members, "o_custkey", "o_totalprice").select("property_id", "o_custkey", "new_price")


@query("SELECT user_id, max(ts) AS ts FROM events WHERE event_type <> 'error' GROUP BY 1 HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL '2 days'".replace("(SELECT max(ts) FROM events)", "TIMESTAMP '2024-01-30 00:00:00'"))
def forgotten_sources(spark, sf_dir):
    """Users not seen for two days are forgotten."""
    seen = table(spark, sf_dir, "events").filter("event_type <> 'error'").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return history.forgotten(seen, "ts", F.lit("2024-01-30 00:00:00").cast("timestamp"), 2)


DIFF_SQL = "WITH x AS (SELECT 1)" + SNAPSHOTS + """, d AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'new' WHEN a.k IS NULL THEN 'gone' WHEN a.v < b.v THEN 'down' WHEN a.v > b.v THEN 'up' ELSE 'same' END AS status, b.v AS old_value, a.v AS new_value FROM before b FULL JOIN after a ON a.k = b.k)"""


@query(DIFF_SQL + " SELECT CAST(k % 20 AS BIGINT) AS source, count_if(status <> 'gone')::BIGINT AS listings, count_if(status = 'new')::BIGINT AS \"new\", count_if(status = 'gone')::BIGINT AS removed, count_if(status = 'down')::BIGINT AS price_down, count_if(status = 'up')::BIGINT AS price_up, count_if(status <> 'gone' AND k % 3 = 1)::BIGINT AS checked FROM d GROUP BY ROLLUP (CAST(k % 20 AS BIGINT))")
def source_counters(spark, sf_dir):
    diff = history.snapshot_diff(*snapshots(spark, sf_dir), "k", "v").withColumn("source", F.col("k") % 20)
    today = F.lit("1998-08-02").cast("date")
    return reporting.source_counters(diff.withColumn("checked_at", F.when(F.col("k") % 3 == 1, today)), "source", today)


@query(DIFF_SQL + " SELECT k, old_value, new_value FROM d WHERE new_value < old_value ORDER BY new_value / old_value, k LIMIT 300")
def top_price_drops(spark, sf_dir):
    diff = history.snapshot_diff(*snapshots(spark, sf_dir), "k", "v")
    return reporting.top_drops(diff, tie="k").select("k", "old_value", "new_value")


@query(with_listings("SELECT column_name, filled, round(100 * filled / n, 1) AS rate FROM (SELECT count(*) AS n, count(transaction) AS transaction, count(year_built) AS year_built, count(price_eur) AS price_eur FROM lv) UNPIVOT (filled FOR column_name IN (transaction, year_built, price_eur))"))
def fill_rates(spark, sf_dir):
    return normalize.fill_rates(listings(spark, sf_dir, "transaction", "year_built", "price_eur"), ["transaction", "year_built", "price_eur"])


@query("SELECT CASE WHEN event_type IN ('error') THEN 'blocked' ELSE event_type END AS status, count(*) AS n FROM events GROUP BY 1")
def status_histogram(spark, sf_dir):
    status = reporting.status_bucket(F.when(F.col("event_type") == "error", "bot_check:1").otherwise(F.col("event_type")))
    return table(spark, sf_dir, "events").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def group_sizes(spark, sf_dir):
    return reporting.histogram_of_counts(table(spark, sf_dir, "lineitem"), "l_orderkey")


RANKED = """, r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY (source_kind <> 'portal') DESC, listing_date DESC NULLS LAST,
  (CASE WHEN year_built IS NULL THEN 0 ELSE 1 END) DESC, ord) AS place FROM lv)"""


@query(
    with_listings(
        RANKED
        + """ SELECT l_partkey AS property_id, count(*) AS members, min(price_eur) AS price_min, max(price_eur) AS price_max, count(DISTINCT price_eur) > 1 AS prices_differ,
  arg_min(url, place) AS url, arg_min(transaction, place) FILTER (transaction IS NOT NULL) AS transaction, arg_min(bedrooms, place) AS bedrooms,
  min(first_seen) AS first_seen, max(listing_date) AS last_dated, arg_max(price_eur, (listing_date, -place)) AS newest_price,
  array_to_string(list_sort(list(DISTINCT source_domain)), ',') AS sources, array_to_string((list(url ORDER BY place))[2:], ',') AS other_urls FROM r GROUP BY 1"""
    )
)
def property_rollup(spark, sf_dir):
    df = listings(spark, sf_dir).withColumnRenamed("l_partkey", "property_id").withColumns({"geo": F.lit("site"), "segment": F.lit(None).cast("string")})
    names = ("property_id", "members", "price_min", "price_max", "prices_differ", "url", "transaction", "bedrooms", "first_seen", "last_dated", "newest_price")
    return gold.rollup_properties(df).select(*names, F.array_join("sources", ",").alias("sources"), F.array_join("other_urls", ",").alias("other_urls"))


@query(with_listings(RANKED + " SELECT ord, CAST(place AS INTEGER) AS place FROM r"))
def main_listing_rank(spark, sf_dir):
    return gold.ranked_members(listings(spark, sf_dir, "ord", "l_partkey", "source_kind", "listing_date", "price_eur", "area_m2", "bedrooms", "floor", "year_built", "area").withColumnRenamed("l_partkey", "property_id")).select("ord", "place")


@query("SELECT p_name AS value, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS code FROM part GROUP BY 1")
def dictionary_encode(spark, sf_dir):
    return gold.dictionary(table(spark, sf_dir, "part").withColumnRenamed("p_name", "value"), "value", "p_partkey").select("value", F.col("code").cast("long").alias("code"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN to_json([o_orderstatus, NULL, CASE WHEN o_custkey % 5 = 0 THEN o_orderpriority END])
    WHEN o_custkey % 5 = 0 THEN to_json([o_orderstatus, o_custkey::VARCHAR, o_orderpriority]) ELSE to_json([o_orderstatus, o_custkey::VARCHAR]) END AS "row" FROM orders""".replace("to_json([o_orderstatus, NULL, CASE WHEN o_custkey % 5 = 0 THEN o_orderpriority END])", "CASE WHEN o_custkey % 5 = 0 THEN to_json([o_orderstatus, NULL, o_orderpriority]) ELSE to_json([o_orderstatus]) END"))
def sparse_pack(spark, sf_dir):
    """Rows as arrays, the fullest column first, trailing nulls cut."""
    o = table(spark, sf_dir, "orders").withColumns({"o_orderpriority": F.when(F.col("o_custkey") % 5 == 0, F.col("o_orderpriority")), "o_custkey": F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey"))})
    return gold.packed_rows(o, "o_orderkey", ["o_orderpriority", "o_custkey", "o_orderstatus"])


@query(
    with_listings(
        ", due AS (SELECT ord, source_domain, url, l_partkey % 2 = 0 AS linked, first_seen AS checked_at FROM lv WHERE date_diff('day', first_seen, DATE '1996-01-01') >= CASE WHEN l_partkey % 2 = 0 THEN 7 ELSE 2 END) SELECT ord, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY source_domain ORDER BY linked, checked_at, url, ord) AS turn FROM due) WHERE turn <= 20"
    )
)
def recheck_due(spark, sf_dir):
    df = listings(spark, sf_dir, "ord", "l_partkey", "first_seen", "url", "source_domain").withColumns({"linked": F.col("l_partkey") % 2 == 0, "checked_at": F.col("first_seen"), "url": F.concat("url", F.format_string("~%020d", "ord"))})
    got = reporting.due_for_recheck(df, F.lit("1996-01-01").cast("date"), 20)
    return got.select("ord", "turn")


@query("SELECT s_suppkey, CAST((((s_suppkey - 19000) % 100) + 100) % 100 AS INTEGER) AS place FROM supplier")
def rotation(spark, sf_dir):
    day = F.date_from_unix_date(F.lit(19000))
    return table(spark, sf_dir, "supplier").select("s_suppkey", reporting.rotation(F.col("s_suppkey"), day, F.lit(100)).cast("int").alias("place"))


@query(
    """WITH RECURSIVE b AS (SELECT l_suppkey AS site, count(*) AS w, row_number() OVER (ORDER BY count(*), CAST(l_suppkey AS VARCHAR)) AS i, count(*) OVER () AS n FROM lineitem GROUP BY 1),
  f AS (SELECT site, i, least(w, 700, greatest(1, 50000 // n)) AS share, 50000 - least(w, 700, greatest(1, 50000 // n)) AS left_ FROM b WHERE i = 1
  UNION ALL SELECT b.site, b.i, least(b.w, 700, greatest(1, f.left_ // (b.n - b.i + 1))), f.left_ - least(b.w, 700, greatest(1, f.left_ // (b.n - b.i + 1))) FROM f JOIN b ON b.i = f.i + 1)
  SELECT CAST(site AS VARCHAR) AS site, CAST(share AS BIGINT) AS share FROM f"""
)
def budget_fair_share(spark, sf_dir):
    backlog = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("site")).agg(F.count(F.lit(1)).alias("waiting"))
    return reporting.fair_share(backlog, 50_000, 700)


@query("SELECT o_orderkey, (SELECT max(e.o_totalprice) FROM orders e WHERE e.o_custkey = o.o_custkey AND e.o_orderstatus = 'F' AND e.o_orderdate = (SELECT max(x.o_orderdate) FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'F' AND x.o_orderdate <= o.o_orderdate)) AS as_of_price FROM orders o WHERE o_orderstatus = 'O'")
def as_of_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    done = o.filter("o_orderstatus = 'F'").groupBy("o_custkey", "o_orderdate").agg(F.max("o_totalprice").alias("price"))
    return history.as_of(o.filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderdate"), done, "o_custkey", "o_orderdate", "o_orderdate", "price").select("o_orderkey", "as_of_price")


@query("WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS p FROM orders), e AS (SELECT o_custkey, d, sum(CASE WHEN d - p > 180 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY d) AS episode FROM o) SELECT o_custkey, CAST(episode AS BIGINT) AS episode, min(d) AS from_day, max(d) AS to_day, count(*) AS n FROM e GROUP BY 1, 2")
def market_episode(spark, sf_dir):
    return history.market_episodes(table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date")), "o_custkey", "d")


@query("SELECT * EXCLUDE rn FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def keyed_upsert(spark, sf_dir):
    return history.last_write_wins(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o.o_orderkey, o.o_totalprice FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'MACHINERY') AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_discount > 0.05)")
def multi_key_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    keys = {"o_custkey": table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey")), "o_orderkey": table(spark, sf_dir, "lineitem").filter("l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey"))}
    for key, other in keys.items():
        o = o.join(other, key, "left_anti")
    return o.select("o_orderkey", "o_totalprice")


@query("SELECT coalesce(a.k, b.k) AS k, n_orders, acctbal, n_name FROM (SELECT o_custkey AS k, count(*) AS n_orders FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k, c_acctbal AS acctbal, c_nationkey FROM customer WHERE c_custkey % 3 = 0) b ON a.k = b.k LEFT JOIN nation ON c_nationkey = n_nationkey")
def source_status_full_outer(spark, sf_dir):
    a = table(spark, sf_dir, "orders").filter("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("ka")).agg(F.count(F.lit(1)).alias("n_orders"))
    b = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("kb"), F.col("c_acctbal").alias("acctbal"), "c_nationkey")
    n = table(spark, sf_dir, "nation")
    return a.join(b, F.col("ka") == F.col("kb"), "full_outer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.coalesce("ka", "kb").alias("k"), "n_orders", "acctbal", "n_name")


@query("SELECT o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def newest_per_site(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("o_orderkey", "o_orderdate")


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000 EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_difference(spark, sf_dir):
    a = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("k"))
    return a.subtract(table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k")))


@query(with_listings(f"SELECT DISTINCT {URL_KEY_SQL} AS key_url FROM lv"))
def url_keys(spark, sf_dir):
    return listings(spark, sf_dir, "url").select(url_key(F.col("url")).alias("key_url")).distinct()
