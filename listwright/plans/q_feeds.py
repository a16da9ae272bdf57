"""Feeds and pages made of the driver's tables, read by the landed readers; the SQL states what was put in."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.config import City, MapArea
from listwright.operators import registry_ops
from listwright.plans.catalog import query, table
from listwright.sources import extract, feeds

NOW = "2026-03-04T05:06:07Z"
PARTS_A_CORE = 4
PRICE = "CAST(floor(o_totalprice) AS BIGINT)"


def made(spark, sf_dir, *columns: str):
    """Columns of orders by SQL expressions; their braces are text. Reading feeds is work by row, so rows are dealt evenly, however few the file's parts."""
    chosen = ", ".join(columns).replace("{", "{{").replace("}", "}}")
    return spark.sql(f"SELECT {chosen} FROM {{o}}", o=table(spark, sf_dir, "orders").repartition(spark.sparkContext.defaultParallelism * PARTS_A_CORE))


@query(f"""SELECT 'https://m.example/listings/' || o_orderkey AS url, CASE o_custkey % 3 WHEN 0 THEN 'land' WHEN 1 THEN 'maisonette' END AS type, CASE WHEN o_orderkey % 7 > 0 THEN CAST({PRICE} AS DOUBLE) END AS price_eur,
  CAST(50 + o_custkey % 50 AS DOUBLE) AS area_m2, CAST(20 + o_custkey % 6 AS DOUBLE) AS lon, CASE WHEN o_orderkey % 2 = 0 THEN 'auction' ELSE 'bank' END AS segment, CASE WHEN o_orderkey % 2 = 0 THEN '2' END AS auction_round,
  CAST(timezone('Europe/Athens', timezone('UTC', make_timestamp((1700000000 + o_orderkey * 3600) * 1000000))) AS DATE) AS date_published FROM orders WHERE o_orderkey % 5 > 0 AND o_custkey % 6 BETWEEN 2 AND 4""")
def market_feed(spark, sf_dir):
    """Marketplace items: public ones in the box, hidden prices unknown."""
    item = f"""'{{"id":"' || o_orderkey || '","status":"' || CASE WHEN o_orderkey % 5 = 0 THEN 'hidden' ELSE 'public' END || '","coordinates":[40.5,' || (20 + o_custkey % 6) || '],"price":' || {PRICE}
      || ',"price_upon_request":' || CASE WHEN o_orderkey % 7 = 0 THEN 'true' ELSE 'false' END || ',"size":' || (50 + o_custkey % 50) || ',"type":"' || CASE o_custkey % 3 WHEN 0 THEN 'field' WHEN 1 THEN 'maisonette' ELSE 'x' END
      || '","created_at":' || (1700000000 + o_orderkey * 3600) || ',"auction_round":2}}' AS item"""
    items = made(spark, sf_dir, "CASE WHEN o_orderkey % 2 = 0 THEN 'auction' ELSE 'bank' END AS segment", item)
    got = feeds.market_rows(items, feeds.Market("m.example", "M", "https://m.example"), (40.0, 41.0, 22.0, 24.0), NOW)
    return got.select("url", "type", "price_eur", "area_m2", "lon", "segment", "auction_round", "date_published")


@query(f"""SELECT 'https://p.example/el/auctions/' || o_orderkey AS url, 'Οικόπεδο, ' || (20 + o_custkey % 90) || ' τ.μ., Place ' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN ' (μερίδιο 33.5%)' ELSE '' END AS title,
  'land' AS type, CAST({PRICE} AS DOUBLE) AS price_eur, CAST(20 + o_custkey % 90 AS DOUBLE) AS area_m2, 'Place ' || o_custkey AS location, DATE '2027-02-03' AS auction_date, '2' AS auction_round FROM orders WHERE o_orderkey % 3 > 0""")
def platform_feed(spark, sf_dir):
    """Cards of list pages joined with the points of the map; cards without a point stay out."""
    html = f"""'<div class="listing-style1" data-property-id="' || o_orderkey || '"><h6 class="list-title"><span>Place ' || o_custkey || ',</span> Οικόπεδο ' || CASE WHEN o_orderkey % 2 = 0 THEN '<b>(33,5%)</b>' ELSE '' END || '</h6><p class=""> Οικόπεδο </p>' || (20 + o_custkey % 90)
      || ' <span>m<sup>2</sup></span><div class="list-price"><span> ' || {PRICE} || ' €</span></div><span title="Ημερομηνία Δημοπρασίας"> 03-02-2027 </span> 2ος γύρος' AS html"""
    points = made(spark, sf_dir, "o_orderkey AS id", "40.5 AS latitude", "22.5 AS longitude").filter("id % 3 > 0")
    site = feeds.CardSite("p.example", "P", "https://p.example/el", "auctions", "auction")
    return feeds.platform_rows(made(spark, sf_dir, html), points, site, (40.0, 41.0, 22.0, 24.0), NOW).select("url", "title", "type", "price_eur", "area_m2", "location", "auction_date", "auction_round")


@query(f"""SELECT 'u/' || o_orderkey AS url, 'T' || o_custkey AS title, CASE WHEN o_custkey % 2 = 0 THEN 'rent' ELSE 'sale' END AS transaction, 'house' AS type, CAST({PRICE} AS DOUBLE) AS price_eur,
  DATE '2026-03-04' - CAST(o_custkey % 9 AS INTEGER) * 7 AS date_published FROM orders""")
def profile_feed(spark, sf_dir):
    """Items that profiles hold as JSON in an attribute."""
    pairs = [("id", "o_orderkey"), ("url", "'u/' || o_orderkey"), ("title", "'T' || o_custkey"), ("transaction_type", "CASE WHEN o_custkey % 2 = 0 THEN 'RENT' ELSE 'SALE' END"), ("type", "'VILLA'"), ("price", f"{PRICE} || ' €'"), ("active_time_literal", "'Πριν ' || (o_custkey % 9) || ' εβδομάδες'")]
    body = " || ',' || ".join(f"'&quot;{k}&quot;:&quot;' || {v} || '&quot;'" for k, v in pairs)
    page = f"""'<i data-ads-data="[{{' || {body} || '}}]">' AS html"""
    return feeds.profile_rows(made(spark, sf_dir, page), NOW).select("url", "title", "transaction", "type", "price_eur", "date_published")


@query(f"""SELECT 'https://www.spitogatos.gr/aggelia/' || o_orderkey AS url, CAST({PRICE} AS DOUBLE) AS price_eur, CAST(20 + o_custkey % 90 AS DOUBLE) AS area_m2, 'Place ' || o_custkey AS location, 'sale' AS transaction,
  CASE WHEN o_custkey % 2 = 0 THEN '3' END AS floor, DATE '2026-02-03' AS date_updated FROM orders WHERE o_orderkey % 4 > 0""")
def alert_feed(spark, sf_dir):
    """Alerts of both sheet formats that link one listing."""
    card = f"'€' || {PRICE} || ' Place ' || o_custkey || ' Διαμέρισμα ' || (20 + o_custkey % 90) || ' τ.μ.' || CASE WHEN o_custkey % 2 = 0 THEN ' 3ος' ELSE '' END || ' πώληση'"
    context = f"CASE WHEN o_orderkey % 3 = 0 THEN 'Νέα αγγελία: ' || {card} ELSE 'old 1 x ⟦LINK⟧ ' || {card} || ' Δες την αγγελία' END AS context"
    url = "CASE WHEN o_orderkey % 4 > 0 THEN 'https://www.spitogatos.gr/aggelia/' || o_orderkey || '?utm_source=m' ELSE 'https://www.spitogatos.gr/unsubscribe' END AS url"
    alerts = made(spark, sf_dir, "'Spitogatos' AS portal", "'2/3/2026 10:00' AS received", "'x' AS subject", url, context)
    return feeds.alert_rows(alerts, NOW).select("url", "price_eur", "area_m2", "location", "transaction", "floor", "date_updated")


@query(f"""SELECT 'https://t.me/c/' || o_orderkey AS url, CASE WHEN o_custkey % 2 = 0 THEN 'rent' ELSE 'sale' END AS transaction, 'apartment' AS type, CAST(CASE WHEN o_custkey % 2 = 0 THEN 500 + o_custkey % 90 ELSE {PRICE} + 20000 END AS DOUBLE) AS price_eur,
  CAST(20 + o_custkey % 90 AS DOUBLE) AS area_m2, 'Toumba' AS location, DATE '2026-02-03' AS date_published FROM orders WHERE o_orderkey % 4 > 0""")
def post_feed(spark, sf_dir):
    """Channel posts that offer one object; done deals stay out."""
    block = f"""'<div data-post="c/' || o_orderkey || '"><time datetime="2026-02-03T10:00:00"></time><div class="tgme_widget_message_text">' || CASE WHEN o_orderkey % 4 = 0 THEN 'Продано! ' ELSE '' END || CASE WHEN o_custkey % 2 = 0 THEN 'Аренда' ELSE 'Продажа' END
      || ' квартира Тумба<br>' || (20 + o_custkey % 90) || ' м2<br>' || CASE WHEN o_custkey % 2 = 0 THEN 500 + o_custkey % 90 ELSE {PRICE} + 20000 END || ' евро</div>' AS block"""
    got = feeds.post_rows(made(spark, sf_dir, block, "'C' AS channel", "'' AS focus"), NOW, [("тумб", "Toumba")])
    return got.select("url", "transaction", "type", "price_eur", "area_m2", "location", "date_published")


@query(f"""SELECT 'https://a/' || o_orderkey AS url, CAST({PRICE} AS DOUBLE) AS price_eur, CAST(20 + o_custkey % 90 AS DOUBLE) AS area_m2, CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '2' END AS bedrooms,
  CASE WHEN o_orderkey % 2 = 0 THEN '1990' END AS year_built, CASE WHEN o_orderkey % 2 = 0 THEN 'apartment' ELSE 'studio' END AS type, CASE WHEN o_orderkey % 2 = 0 THEN 'sale' END AS transaction,
  CASE WHEN o_orderkey % 2 = 0 THEN DATE '2026-02-05' END AS date_published, CASE WHEN o_orderkey % 2 = 0 THEN 'text' END AS date_source, CASE WHEN o_orderkey % 2 = 1 THEN 40.6301::DOUBLE END AS lat FROM orders""")
def page_listing_feed(spark, sf_dir):
    """Listings of pages: structured data, then text, dates with their source, points in scripts."""
    ld = f"""'<title>Flat for sale</title><script type="application/ld+json">{{"x":[{{"offers":[{{"price":"' || {PRICE} || '"}}],"floorSize":{{"value":' || (20 + o_custkey % 90) || '}},"numberOfBedrooms":1}}]}}</script><p>built 1990 Published: 5/2/2026</p>'"""
    plain = f"""'<title>Studio</title><p>' || {PRICE} || ' € ' || (20 + o_custkey % 90) || ' τ.μ. 2 bedrooms</p><script>LatLng(40.6301, 22.9512)</script>'"""
    pages = made(spark, sf_dir, "'https://a/' || o_orderkey AS url", f"CASE WHEN o_orderkey % 2 = 0 THEN {ld} ELSE {plain} END AS html")
    got = extract.page_listings(pages, F.lit("2026-03-01").cast("date"))
    bedrooms = F.regexp_replace("bedrooms", r"\.0$", "")
    return got.select("url", "price_eur", "area_m2", bedrooms.alias("bedrooms"), "year_built", "type", "transaction", "date_published", "date_source", "lat")


CITY = City(key="c", generic="City", areas=(("North", "north"), ("South", "south")), other_regions="veria", box=(40.0, 41.0, 22.0, 24.0), map_areas=(MapArea("n1", "North", pattern="hill"),))


@query("""SELECT 'u' || o_orderkey AS url, CASE o_orderkey % 6 WHEN 0 THEN 'other' WHEN 1 THEN 'other' WHEN 4 THEN NULL ELSE 'c' END AS region, CASE o_orderkey % 6 WHEN 2 THEN 'North' WHEN 3 THEN 'South' WHEN 5 THEN 'North' END AS area,
  CASE o_orderkey % 6 WHEN 5 THEN 'n1' END AS neighbourhood, CASE o_orderkey % 6 WHEN 0 THEN 'place' WHEN 1 THEN 'map point' WHEN 2 THEN 'address' WHEN 3 THEN 'breadcrumb' WHEN 5 THEN 'text' END AS how FROM orders""")
def district_hint_feed(spark, sf_dir):
    """The district that a page tells, by the first stage that tells one."""
    pages = ["<p>Location:</p><b>Veria</b>", "LatLng(36.1234, 23.1234)", '<script type="application/ld+json">{"addressLocality": "North side"}</script>', "<ol class=breadcrumb><li>South</li></ol>", "<h1>x</h1><p>north and south</p>", "<nav>south</nav><h1>On the hill</h1><p>similar: south</p>"]
    html = F.get(F.array(*[F.lit(p) for p in pages]), (F.col("o_orderkey") % 6).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("url"), html.alias("html"))
    return extract.district_hints(rows, CITY, F.lit("2026-01-01").cast("date"))


@query("""SELECT 'A' || o_orderkey AS name, CASE o_orderkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'bot_check_cloudflare' WHEN 2 THEN 'no_site' WHEN 3 THEN 'error' ELSE 'http_404' END AS site_status,
  CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'explicit_no' ELSE 'yes' END END AS robots_ok, CASE WHEN o_orderkey % 5 = 0 THEN 'yes' END AS has_listings, CASE WHEN o_orderkey % 5 = 0 THEN 6 END AS listing_links FROM orders""")
def site_checks(spark, sf_dir):
    """Landed home pages judged: challenges, robots, listing links."""
    links = "".join(f"<a href='/property/{i}'></a>" for i in range(6))
    rows = made(
        spark, sf_dir, "'A' || o_orderkey AS name", "CASE WHEN o_orderkey % 5 <> 2 THEN 'a.example' END AS website", "CASE o_orderkey % 5 WHEN 0 THEN 200 WHEN 1 THEN 403 WHEN 4 THEN 404 END AS http_status", "'https://a.example/' AS final_url",
        f"CASE WHEN o_orderkey % 5 = 1 THEN '<title>Just a moment' ELSE '{links.replace(chr(39), chr(34))}' END AS html", "CASE WHEN o_custkey % 2 = 0 THEN 'User-agent: listwright' || chr(10) || 'Disallow: /' || chr(10) END AS robots", "'' AS sitemap", "'' AS section",
    )
    return registry_ops.check_sites(rows).select("name", "site_status", "robots_ok", "has_listings", "listing_links")


@query("""WITH c AS (SELECT o_orderkey AS ord, CASE WHEN o_custkey % 3 > 0 THEN 'agency k' || o_custkey % 40 ELSE 'x' || o_custkey % 40 END AS k, o_custkey % 40 AS d FROM orders)
  SELECT min(ord) AS ord FROM c WHERE NOT (k LIKE 'agency%' AND k IN (SELECT 'agency k' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0)) AND d <> 39 GROUP BY k""")
def new_agencies(spark, sf_dir):
    """Directory entries that are known under no name and no domain, the first of each name."""
    found = made(spark, sf_dir, "o_orderkey AS ord", "CASE WHEN o_custkey % 3 > 0 THEN 'Agency K' || (o_custkey % 40) || ' (office) Real Estate' ELSE 'X' || (o_custkey % 40) || ' ΙΚΕ' END AS name", "'https://www.d' || (o_custkey % 40) || '.example/' AS website")
    names = spark.sql("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'Agency-K' || n_nationkey ELSE 'none ' || n_nationkey END AS name, CASE WHEN n_nationkey = 1 THEN 'd39.example' END AS domain FROM {n}", n=table(spark, sf_dir, "nation"))
    return registry_ops.new_agencies(found, names).select("ord")
