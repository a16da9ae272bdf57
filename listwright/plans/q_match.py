"""Queries of saved filters, grouping, places and segment statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.functions import floors
from listwright.functions.geo import in_box, planar_km
from listwright.functions.numbers import close
from listwright.operators import grouping, matching, spatial
from listwright.operators.components import components
from listwright.plans.catalog import listings, query, table, with_listings

FILTERS = [
    # name, enabled, tx, region, types, areas, price_min, price_max, m2_min, m2_max, beds_min, floor_min, floor_max, keep, keep_floor, keep_unconfirmed
    ("cheap sale", None, "sale", "", None, None, None, 20000.0, None, None, None, None, None, None, None, None),
    ("big rent", True, "rent", "EUROPE", None, None, None, None, 40.0, None, None, None, None, None, None, True),
    ("typed", True, None, "", ["promo", "economy"], ["NATION_1", "NATION_2"], 5000.0, 60000.0, None, 30.0, 1.0, None, None, False, None, None),
    ("floors", True, None, "", None, None, 30000.0, None, None, None, None, 2.0, 6.0, True, False, None),
    ("home only", True, "sale", None, None, None, None, None, None, None, None, None, None, None, None, None),
    ("off", False, None, "", None, None, None, None, None, None, None, None, None, None, None, None),
]


def _sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, list):
        return "[" + ", ".join(map(_sql_value, v)) + "]"
    return f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"


COLUMNS = [c.split(" ")[0] for c in matching.FILTER_SCHEMA.split(", ")]
FILTERS_SQL = "f(" + ", ".join(COLUMNS) + ") AS (VALUES " + ", ".join("(" + ", ".join(map(_sql_value, f)) + ")" for f in FILTERS) + ")"
PROPERTIES_SQL = """, p AS (SELECT ord AS id, transaction, region, l_partkey % 3 > 0 AS region_ok, type, area, NULL::VARCHAR AS neighbourhood,
  CASE WHEN l_partkey % 11 > 0 THEN price_eur END AS price, CASE WHEN l_partkey % 13 > 0 THEN area_m2 END AS m2,
  CASE WHEN bedrooms > 0 THEN bedrooms::DOUBLE END AS bedrooms, CASE WHEN floor < 12 THEN floor::DOUBLE END AS floor FROM lv)"""
#: The home region of these queries.
HOME = "ASIA"
MATCH_SQL = with_listings(
    PROPERTIES_SQL
    + f", {FILTERS_SQL}, hit AS (SELECT f.name, p.* FROM p, f WHERE coalesce(f.enabled, TRUE)"
    + f""" AND (coalesce(f.transaction, '') = '' OR p.transaction = f.transaction)
  AND (coalesce(f.region, '{HOME}') = '' OR (p.region = coalesce(f.region, '{HOME}') AND (p.region_ok OR coalesce(f.keep_unconfirmed_region, FALSE))))
  AND (f.types IS NULL OR list_contains(f.types, p.type)) AND (f.areas IS NULL OR list_contains(f.areas, p.area))
  AND (f.price_min IS NULL OR p.price >= f.price_min) AND (f.price_max IS NULL OR p.price <= f.price_max)
  AND (f.m2_min IS NULL OR CASE WHEN p.m2 IS NULL THEN coalesce(f.keep_unknown, TRUE) ELSE p.m2 >= f.m2_min END)
  AND (f.m2_max IS NULL OR CASE WHEN p.m2 IS NULL THEN coalesce(f.keep_unknown, TRUE) ELSE p.m2 <= f.m2_max END)
  AND (f.bedrooms_min IS NULL OR CASE WHEN p.bedrooms IS NULL THEN coalesce(f.keep_unknown, TRUE) ELSE p.bedrooms >= f.bedrooms_min END)
  AND (f.floor_min IS NULL OR CASE WHEN p.floor IS NULL THEN coalesce(f.keep_unknown_floor, f.keep_unknown, TRUE) ELSE p.floor >= f.floor_min END)
  AND (f.floor_max IS NULL OR CASE WHEN p.floor IS NULL THEN coalesce(f.keep_unknown_floor, f.keep_unknown, TRUE) ELSE p.floor <= f.floor_max END))"""
)


def properties(spark, sf_dir):
    c = F.col
    return listings(spark, sf_dir).select(
        c("ord").alias("id"), "transaction", "region", (c("l_partkey") % 3 > 0).alias("region_ok"), "type", "area",
        F.lit(None).cast("string").alias("neighbourhood"),
        F.when(c("l_partkey") % 11 > 0, c("price_eur")).alias("price"), F.when(c("l_partkey") % 13 > 0, c("area_m2")).alias("m2"),
        F.when(c("bedrooms") > 0, c("bedrooms").cast("double")).alias("bedrooms"), F.when(c("floor") < 12, c("floor").cast("double")).alias("floor"),
    )


def matched(spark, sf_dir):
    return matching.match_filters(properties(spark, sf_dir), spark.createDataFrame(FILTERS, matching.FILTER_SCHEMA), HOME)


@query(MATCH_SQL + " SELECT name, id FROM hit")
def filters_theta_join(spark, sf_dir):
    return matched(spark, sf_dir).select("f.name", "p.id")


@query(MATCH_SQL + " SELECT name, id, CAST(rn AS INTEGER) AS rank, hits, greatest(hits - 25, 0) AS more FROM (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY coalesce(price, 1e12), id) AS rn, count(*) OVER (PARTITION BY name) AS hits FROM hit) WHERE rn <= 25")
def topk_per_filter(spark, sf_dir):
    return matching.top_hits(matched(spark, sf_dir)).select("f.name", "p.id", "rank", "hits", "more")


@query("SELECT o_custkey AS id FROM orders GROUP BY 1 HAVING NOT bool_or(o_orderkey % 10 = 3)")
def unsent_properties(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    props = o.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list("o_orderkey").alias("urls"))
    return matching.unsent(props, o.filter("o_orderkey % 10 = 3").select(F.col("o_orderkey").alias("url"))).select("id")


@query(
    with_listings(
        """, ref AS (SELECT n_name AS area, 900.0::DOUBLE + n_nationkey * 20 AS sale, 4.0::DOUBLE + n_nationkey AS rent FROM nation), d AS (SELECT ord, CASE l_partkey % 4 WHEN 0 THEN 'apartment' WHEN 1 THEN 'studio'
  WHEN 2 THEN 'land' END AS ty, round_even((price_eur / area_m2 / CASE transaction WHEN 'sale' THEN sale WHEN 'rent' THEN rent END - 1) * 100, 0) AS pct FROM lv JOIN ref USING (area))
  SELECT ord, CASE WHEN ty IN ('apartment', 'studio') AND abs(pct) BETWEEN 10 AND 60 THEN pct END AS delta FROM d"""
    )
)
def market_delta(spark, sf_dir):
    ref = table(spark, sf_dir, "nation").select(F.col("n_name").alias("area"), (900.0 + F.col("n_nationkey") * 20).alias("sale"), (4.0 + F.col("n_nationkey")).alias("rent"))
    k = F.col("l_partkey") % 4
    type_ = F.when(k == 0, "apartment").when(k == 1, "studio").when(k == 2, "land")
    got = listings(spark, sf_dir, "ord", "l_partkey", "transaction", "area", "price_eur", "area_m2").join(ref, "area")
    return got.select("ord", matching.market_delta(F.col("price_eur"), F.col("area_m2"), F.col("sale"), F.col("rent"), F.col("transaction"), type_).alias("delta"))


PAIRS_SQL = """, b AS (SELECT *, round_even(m, 0)::BIGINT AS bucket FROM (SELECT ord, transaction, type, bedrooms, source_domain, price_eur / area_m2 AS price_m2, price_eur / 100 AS m FROM lv WHERE transaction IS NOT NULL)),
  pairs AS (SELECT x.ord AS a_ord, y.ord AS b_ord, x.price_m2 AS pa, y.price_m2 AS pb, x.m AS ma, y.m AS mb FROM b x JOIN b y
    ON x.transaction = y.transaction AND x.type = y.type AND x.bedrooms = y.bedrooms AND y.bucket BETWEEN x.bucket AND x.bucket + greatest(2, floor(0.015 * x.bucket)::BIGINT) + 1
    AND (x.bucket < y.bucket OR x.ord < y.ord) AND x.source_domain <> y.source_domain)"""
BLOCKED = ["transaction", "type", "bedrooms"]


def band_base(spark, sf_dir):
    """All listings with a deal; pairs agree in deal, type and bedrooms."""
    df = listings(spark, sf_dir, "ord", "transaction", "type", "bedrooms", "source_domain", "price_eur", "area_m2").filter("transaction is not null")
    return df.select("ord", *BLOCKED, "source_domain", (F.col("price_eur") / F.col("area_m2")).alias("price_m2"), (F.col("price_eur") / 100).alias("m"))


@query(with_listings(PAIRS_SQL + " SELECT a_ord, b_ord FROM pairs"))
def band_join_pairs(spark, sf_dir):
    return grouping.band_pairs(band_base(spark, sf_dir), BLOCKED, "m", "source_domain").select(F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"))


@query(with_listings(PAIRS_SQL + " SELECT a_ord, b_ord FROM pairs WHERE abs(pa - pb) <= 0.015 * greatest(pa, pb) AND abs(ma - mb) <= greatest(1.0, 0.015 * greatest(ma, mb))"))
def band_join_close(spark, sf_dir):
    p = grouping.band_pairs(band_base(spark, sf_dir), BLOCKED, "m", "source_domain", price="price_m2")
    near = close(F.col("a.price_m2"), F.col("b.price_m2"), 0.015) & close(F.col("a.m"), F.col("b.m"), 0.015, 1.0)
    return p.filter(near).select(F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"))


_KM = "sqrt(power(x.lat - y.lat, 2) + power((x.lon - y.lon) * 0.76, 2)) * 111"
EVIDENCE_SQL = with_listings(
    f""", b AS (SELECT *, l_suppkey % 3 > 0 AS own, title || CASE WHEN l_suppkey % 2 = 0 THEN ' in the same words' ELSE '' END AS said, CASE WHEN l_suppkey % 4 > 0 THEN 'n' || (l_orderkey_ % 3) END AS nb,
    ['w' || (l_suppkey % 10), 'v' || (l_partkey % 7)] AS rare FROM (SELECT *, o_orderkey AS l_orderkey_ FROM lv) WHERE transaction IS NOT NULL)
  SELECT x.ord AS a_ord, y.ord AS b_ord,
   (CASE WHEN x.floor = y.floor THEN 2 ELSE 0 END + CASE WHEN x.bedrooms = y.bedrooms THEN 1 ELSE 0 END + CASE WHEN abs(x.year_built - y.year_built) <= 1 THEN 2 ELSE 0 END
   + CASE WHEN x.own AND y.own AND {_KM} <= 0.25 THEN 2 ELSE 0 END
   + CASE WHEN x.said = y.said AND length(x.said) >= 30 THEN 2 ELSE 0 END + CASE WHEN x.nb = y.nb THEN 1 ELSE 0 END + CASE WHEN list_has_any(x.rare, y.rare) THEN 1 ELSE 0 END
   + CASE WHEN x.price_eur = y.price_eur AND fmod(x.price_eur, CASE WHEN x.transaction = 'rent' THEN 10 ELSE 1000 END) <> 0 THEN 1 ELSE 0 END
   + CASE WHEN x.area_m2 = y.area_m2 AND fmod(x.area_m2, 5) <> 0 THEN 1 ELSE 0 END)::INTEGER AS points
  FROM b x JOIN b y ON x.l_partkey = y.l_partkey AND x.transaction = y.transaction AND x.source_domain <> y.source_domain
    AND y.area_m2 BETWEEN x.area_m2 AND x.area_m2 + 3 AND (x.area_m2 < y.area_m2 OR x.ord < y.ord)
  WHERE NOT coalesce(x.own AND y.own AND {_KM} > 2.5, FALSE)"""
)


@query(EVIDENCE_SQL)
def pair_evidence(spark, sf_dir):
    """All pairs of one part's listings with their points, unless their own points on the map contradict."""
    c = F.col
    df = listings(spark, sf_dir).filter("transaction is not null").withColumns(
        {
            "title": F.concat("title", F.when(c("l_suppkey") % 2 == 0, " in the same words").otherwise("")), "map_lat": c("lat"), "map_lon": c("lon"),
            "geo": F.when(c("l_suppkey") % 3 > 0, "site").otherwise("area"), "neighbourhood": F.when(c("l_suppkey") % 4 > 0, F.concat(F.lit("n"), c("o_orderkey") % 3)),
            "rare_words": F.array(F.concat(F.lit("w"), c("l_suppkey") % 10), F.concat(F.lit("v"), c("l_partkey") % 7)),
        }
    )
    df = grouping.prepared(df)
    pairs = grouping.band_pairs(df, ["l_partkey", "transaction"], "area_m2", "source_domain")
    a, b = F.col("a"), F.col("b")
    # One part's listings agree in floor, bedrooms and year; the map point is what can contradict.
    return pairs.filter(~grouping.contradicts(a, b)).select(F.col("a.ord").alias("a_ord"), F.col("b.ord").alias("b_ord"), grouping.evidence(a, b).alias("points"))


@query()
def constrained_groups(spark, sf_dir):
    df = listings(spark, sf_dir).withColumns({"neighbourhood": F.lit(None).cast("string"), "location_raw": F.col("location"), "map_lat": F.col("lat"), "map_lon": F.col("lon"), "geo": F.lit("site")})
    return grouping.grouped(df).select("ord", "property_id", "group_size")


@query("""WITH g AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS component, dense_rank() OVER (ORDER BY c_nationkey, c_mktsegment) AS i FROM customer)
  SELECT c_custkey AS node, component FROM g UNION ALL SELECT DISTINCT 20000000 + c_nationkey * 100 + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END, component FROM g JOIN customer USING (c_custkey)
  UNION ALL SELECT 10000000 + o_orderkey, component FROM orders JOIN g ON o_custkey = c_custkey""")
def connected_components(spark, sf_dir):
    """Orders hang on customers, customers on their nation's segment."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    segment = F.when(F.col("c_mktsegment") == "AUTOMOBILE", 1).when(F.col("c_mktsegment") == "BUILDING", 2).when(F.col("c_mktsegment") == "FURNITURE", 3).when(F.col("c_mktsegment") == "HOUSEHOLD", 4).otherwise(5)
    edges = o.select((10_000_000 + F.col("o_orderkey")).alias("a"), F.col("o_custkey").alias("b")).unionByName(
        c.select(F.col("c_custkey").alias("a"), (20_000_000 + F.col("c_nationkey") * 100 + segment).cast("long").alias("b"))
    )
    return components(edges).select("node", "component")


CENTRES = [("north", 38.08, 23.66), ("south", 38.01, 23.62), ("east", 38.05, 23.70)]
POINTS = "pts AS (SELECT c_custkey AS k, 38.0::DOUBLE + (c_custkey % 100) * 0.001::DOUBLE AS lat, 23.6::DOUBLE + (c_custkey % 83) * 0.0015::DOUBLE AS lon FROM customer)"
CENTRES_SQL = "c(district, lat, lon) AS (VALUES " + ", ".join(f"('{d}', {y}::DOUBLE, {x}::DOUBLE)" for d, y, x in CENTRES) + ")"


def points(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("k"), (38.0 + (k % 100) * 0.001).alias("lat"), (23.6 + (k % 83) * 0.0015).alias("lon"))


@query(f"WITH {POINTS}, {CENTRES_SQL}, d AS (SELECT k, district, sqrt(power(pts.lat - c.lat, 2) + power((pts.lon - c.lon) * 0.76, 2)) * 111 AS km FROM pts, c) SELECT k, arg_min(district, (km, district)) AS district FROM d WHERE km <= 4 GROUP BY k")
def nearest_centre(spark, sf_dir):
    centres = spark.createDataFrame(CENTRES, "district string, lat double, lon double")
    return spatial.nearest_centre(points(spark, sf_dir), centres, "k").select("k", "district")


@query(f"WITH {POINTS} SELECT k, round(sqrt(power(lat - 38.05, 2) + power((lon - 23.65) * 0.76, 2)) * 111, 6) AS km FROM pts")
def planar_distance(spark, sf_dir):
    return points(spark, sf_dir).select("k", F.round(planar_km(F.col("lat"), F.col("lon"), F.lit(38.05), F.lit(23.65)), 6).alias("km"))


@query(f"WITH {POINTS} SELECT k FROM pts WHERE lat BETWEEN 38.02 AND 38.08 AND lon BETWEEN 23.62 AND 23.70 AND NOT (lat BETWEEN 38.04 AND 38.05 AND lon BETWEEN 23.64 AND 23.66)")
def box_exclude(spark, sf_dir):
    return points(spark, sf_dir).filter(in_box(F.col("lat"), F.col("lon"), (38.02, 38.08, 23.62, 23.70), [(38.04, 38.05, 23.64, 23.66)])).select("k")


AREAS = [
    ("whole", True, [[(38.0003, 23.6003), (38.0003, 23.7203), (38.0953, 23.7203), (38.0953, 23.6003)]]),
    ("diamond", False, [[(38.0203, 23.6603), (38.0503, 23.7003), (38.0803, 23.6603), (38.0503, 23.6203)], [(38.0453, 23.6553), (38.0453, 23.6653), (38.0553, 23.6653), (38.0553, 23.6553)]]),
    ("corner", False, [[(38.0003, 23.6003), (38.0003, 23.6503), (38.0403, 23.6003)]]),
]


def _edges_sql() -> str:
    rows = []
    for name, official, rings in AREAS:
        for r, ring in enumerate(rings):
            for i, (y, x) in enumerate(ring):
                y2, x2 = ring[(i + 1) % len(ring)]
                rows.append(f"('{name}', {official}, {r}, {y}::DOUBLE, {x}::DOUBLE, {y2}::DOUBLE, {x2}::DOUBLE)")
    return "edges(id, official, ring, ay, ax, by_, bx) AS (VALUES " + ", ".join(rows) + ")"


@query(
    f"""WITH {POINTS}, {_edges_sql()}, size AS (SELECT id, abs(sum(ax * by_ - bx * ay)) AS size FROM edges WHERE ring = 0 GROUP BY 1),
  hits AS (SELECT k, id, official, ring, count_if((ay > lat) <> (by_ > lat) AND lon < ax + (lat - ay) / nullif(by_ - ay, 0) * (bx - ax)) % 2 = 1 AS inside FROM pts, edges GROUP BY ALL),
  held AS (SELECT k, id, official FROM hits GROUP BY ALL HAVING bool_or(inside AND ring = 0) AND NOT bool_or(inside AND ring > 0))
  SELECT k, arg_min(id, (official, size, id)) AS area_id FROM held JOIN size USING (id) GROUP BY k"""
)
def point_in_polygon(spark, sf_dir):
    rows = [(n, o, [[[{"lat": y, "lon": x} for y, x in ring] for ring in rings]]) for n, o, rings in AREAS]
    areas = spark.createDataFrame(rows, "id string, official boolean, polygons array<array<array<struct<lat: double, lon: double>>>>")
    return spatial.containing_area(points(spark, sf_dir), areas, "k")


@query(with_listings("SELECT transaction, area, count(price_eur) AS samples, round(quantile_cont(price_eur, 0.05), 4) AS p05, round(quantile_cont(price_eur, 0.5), 4) AS median, round(quantile_cont(price_eur, 0.95), 4) AS p95 FROM lv GROUP BY 1, 2 HAVING count(price_eur) >= 8"))
def segment_median(spark, sf_dir):
    got = spatial.segment_stats(listings(spark, sf_dir, "transaction", "area", "price_eur"), ["transaction", "area"], "price_eur")
    return got.select("transaction", "area", "samples", *[F.round(c, 4).alias(c) for c in ("p05", "median", "p95")])


@query(with_listings(", s AS (SELECT transaction, area, quantile_cont(price_eur, 0.05) AS p05, quantile_cont(price_eur, 0.95) AS p95 FROM lv WHERE transaction IS NOT NULL GROUP BY 1, 2 HAVING count(price_eur) >= 8) SELECT ord, price_eur FROM lv JOIN s USING (transaction, area) WHERE price_eur NOT BETWEEN p05 AND p95"))
def outlier_band(spark, sf_dir):
    df = listings(spark, sf_dir, "ord", "transaction", "area", "price_eur").filter("transaction is not null")
    bands = spatial.segment_stats(df, ["transaction", "area"], "price_eur").select("transaction", "area", "p05", "p95")
    return df.join(bands, ["transaction", "area"]).filter(~F.col("price_eur").between(F.col("p05"), F.col("p95"))).select("ord", "price_eur")


@query("SELECT x.p_partkey AS k, count(y.p_partkey) AS analogs FROM part x LEFT JOIN part y ON x.p_brand = y.p_brand AND x.p_partkey <> y.p_partkey AND abs(ln(x.p_size) - ln(y.p_size)) <= ln(1.3) WHERE x.p_size > 0 AND coalesce(y.p_size, 1) > 0 GROUP BY 1")
def analogs(spark, sf_dir):
    return spatial.analog_counts(table(spark, sf_dir, "part"), ["p_brand"], "p_partkey", "p_size").select(F.col("p_partkey").alias("k"), "analogs")


FLOORS = ("ημιυπόγειο", "Υπόγειο", "ημιόροφος", "υπερυψωμένο", "Ισόγειο", "3ος", "75", "-3", "", "x 4", "7")
FLOOR_VALUES = {"code": (-1, -2, 0.5, 0.5, 0, 3, None, -2, None, None, 7), "level": (-1, -2, 0.5, 0.5, 0, 3, None, -2, None, None, 7), "digits": ("-1", "-1", None, "0", "0", "3", "75", "-3", None, "4", "7")}


def _nth(values, kind: str) -> str:
    shown = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE p_partkey % 11 " + " ".join(f"WHEN {i} THEN {shown(v)}" for i, v in enumerate(values)) + f" END::{kind}"


@query(f"SELECT p_partkey, {_nth(FLOOR_VALUES['code'], 'DOUBLE')} AS code, {_nth(FLOOR_VALUES['level'], 'DOUBLE')} AS level, {_nth(FLOOR_VALUES['digits'], 'VARCHAR')} AS digits FROM part")
def floor_readings(spark, sf_dir):
    """Three readings of a floor, from words and numbers."""
    f = F.get(F.array(*[F.lit(x) for x in FLOORS]), (F.col("p_partkey") % 11).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", floors.floor_code(f).alias("code"), floors.floor_level(f).alias("level"), floors.floor_digits(f).alias("digits"))


@query()
def message_packing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("recipient"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("Filter "), F.col("o_orderstatus")).alias("title"), F.array("o_orderpriority", F.col("o_totalprice").cast("string")).alias("pieces"))
    return matching.pack_messages(o, 200)
