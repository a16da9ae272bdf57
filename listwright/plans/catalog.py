"""Where queries and their oracle SQL are registered, and the listing view they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The dimensions that a column of the view needs, besides the order lines.
NEEDS = {
    "listing_date": {"orders"}, "o_custkey": {"orders"}, "o_orderkey": {"orders"}, "title": {"part"}, "type": {"part"}, "bedrooms": {"part"}, "floor": {"part"}, "year_built": {"part"},
    "source_domain": {"supplier"}, "area": {"supplier", "nation"}, "region": {"supplier", "nation", "region"},
}
JOINED = (("orders", "l_orderkey", "o_orderkey"), ("part", "l_partkey", "p_partkey"), ("supplier", "l_suppkey", "s_suppkey"), ("nation", "s_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey"))


def order_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The order lines, and the type of their listings' ``ord``: a bigint, or decimal(38,0) where one is too large for that.

    ``ord`` is 10**12 times the order's key and more, so at nine million orders it leaves a bigint. The lines' order
    keys are decimals then, so that all of ``ord`` is reckoned in them. The largest keys tell; only if they
    don't fit together, the largest ``ord`` is asked for.
    """
    lines = table(spark, sf_dir, "lineitem")
    largest = lambda df: [v or 0 for v in df.agg(*[F.max(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]).first()]
    reckoned = lambda a, b, c, d: ((a * 1_000_000 + b) * 100_000 + c) * 10 + d
    if reckoned(*largest(lines)) < 1 << 63:
        return lines, "long"
    wide = lines.withColumn("l_orderkey", F.col("l_orderkey").cast("decimal(20,0)"))
    most = wide.agg(F.max(reckoned(*[F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]))).first()[0]
    return (lines, "long") if most < 1 << 63 else (wide, "decimal(38,0)")


def listings(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    """The driver's order lines as listings; of the view's columns those asked for, all by default.

    Every line finds its order, part and supplier, so a dimension that gives no column isn't joined. The
    small ones carry no hint: their files' sizes let Catalyst broadcast them while they are small, and
    shuffle them when they aren't.
    """
    df, kind = order_lines(spark, sf_dir) if not only or "ord" in only else (table(spark, sf_dir, "lineitem"), "long")
    order = (((F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).cast(kind)
    view = {
        "ord": order,
        "url": F.concat(
            F.lit("https://WWW.site.example/u"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"),
            F.when(F.col("l_suppkey") % 2 == 0, "?utm_source=a").otherwise(""),
            F.when(F.col("l_partkey") % 3 == 0, "#top").otherwise(""),
        ),
        "source_domain": F.col("s_name"),
        "title": F.concat_ws(" ", "p_name", "p_type"),
        "transaction": F.when(F.col("l_returnflag") == "A", "sale").when(F.col("l_returnflag") == "N", "rent"),
        "type": F.lower("p_type"),
        "price_eur": F.col("l_extendedprice"),
        "area_m2": F.col("l_quantity"),
        "bedrooms": F.col("p_size") % 5,
        "floor": F.col("p_size") % 14,
        "year_built": F.when(F.col("l_partkey") % 4 == 0, 1950 + F.col("p_size")),
        "area": F.col("n_name"),
        "region": F.col("r_name"),
        "location": F.concat(F.lit("Street "), F.col("l_partkey") % 7),
        "lat": 38.0 + (F.col("l_partkey") % 100) * 0.001,
        "lon": 23.6 + (F.col("l_suppkey") % 100) * 0.001,
        "listing_date": F.col("o_orderdate").cast("date"),
        "first_seen": F.col("l_shipdate").cast("date"),
        "source_kind": F.when(F.col("l_linestatus") == "F", "portal").otherwise("agency"),
        **{c: F.col(c) for c in ("l_partkey", "l_suppkey", "o_custkey", "o_orderkey")},
    }
    names = only or tuple(view)
    needed = set().union(*(NEEDS.get(n, set()) for n in names))
    for name, left, right in JOINED:
        if name in needed:
            df = df.join(table(spark, sf_dir, name), F.col(left) == F.col(right))
    return df.select(*[view[n].alias(n) for n in names])


LISTINGS_SQL = """lv AS (
  SELECT ((l_orderkey * 1000000 + l_partkey) * 100000 + l_suppkey) * 10 + l_linenumber AS ord,
    'https://WWW.site.example/u' || l_orderkey || '-' || l_linenumber
      || CASE WHEN l_suppkey % 2 = 0 THEN '?utm_source=a' ELSE '' END
      || CASE WHEN l_partkey % 3 = 0 THEN '#top' ELSE '' END AS url,
    s_name AS source_domain, p_name || ' ' || p_type AS title,
    CASE WHEN l_returnflag = 'A' THEN 'sale' WHEN l_returnflag = 'N' THEN 'rent' END AS transaction,
    lower(p_type) AS type, l_extendedprice AS price_eur, l_quantity AS area_m2,
    p_size % 5 AS bedrooms, p_size % 14 AS floor,
    CASE WHEN l_partkey % 4 = 0 THEN 1950 + p_size END AS year_built,
    n_name AS area, r_name AS region, 'Street ' || (l_partkey % 7) AS location,
    38.0::DOUBLE + (l_partkey % 100) * 0.001::DOUBLE AS lat, 23.6::DOUBLE + (l_suppkey % 100) * 0.001::DOUBLE AS lon,
    CAST(o_orderdate AS DATE) AS listing_date, CAST(l_shipdate AS DATE) AS first_seen,
    CASE WHEN l_linestatus = 'F' THEN 'portal' ELSE 'agency' END AS source_kind,
    l_partkey, l_suppkey, o_custkey, o_orderkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

URL_KEY_SQL = r"""regexp_replace(regexp_replace(regexp_replace(lower(url), '#.*$', ''), '([?&])(?:utm_\w+|fbclid|gclid|lang|sr)=[^&]*&?', '\1', 'g'), '[?&/]+$', '')"""


def with_listings(sql: str) -> str:
    return f"WITH {LISTINGS_SQL} {sql}"
