"""Properties from grouped listings, and the packed export of the search data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listwright.functions.text import words
from listwright.operators.ranges import ranked

FILLED = ("price_eur", "area_m2", "bedrooms", "floor", "year_built", "area")
PRECISION = {"site": 1, "area": 2, "district": 3}


def filled_fields(columns: tuple[str, ...] = FILLED) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNotNull().cast("int")
    return total


def main_rank(order: str = "ord") -> list[Column]:
    """The main listing comes first: an agency's own, dated, the latest, the most complete."""
    return [F.desc(F.col("source_kind") != "portal"), F.desc(F.col("listing_date").isNotNull()), F.desc_nulls_last("listing_date"), F.desc(filled_fields()), F.asc(order)]


def ranked_members(df: DataFrame) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy("property_id").orderBy(*main_rank())))


def rollup_properties(df: DataFrame) -> DataFrame:
    """One row per property: the main listing's fields, price span, dates, sources, best point.

    Groups hold one listing a site, so they are as small as the number of sites.
    """
    r = ranked_members(df)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    point = F.struct("lat", "lon", "geo")
    precision = F.coalesce(*[F.when(F.col("geo") == k, F.lit(v)) for k, v in PRECISION.items()])
    return r.groupBy("property_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.min("price_eur").alias("price_min"),
        F.max("price_eur").alias("price_max"),
        (F.count_distinct("price_eur") > 1).alias("prices_differ"),
        *[first(c) for c in ("url", "title", "transaction", "type", "area_m2", "bedrooms", "floor", "area", "region")],
        F.min("first_seen").alias("first_seen"),
        F.max("listing_date").alias("last_dated"),
        F.max_by("price_eur", F.struct("listing_date", -F.col("place"))).alias("newest_price"),
        F.array_sort(F.collect_set("source_domain")).alias("sources"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda x: x["url"]), F.lit(2), F.greatest(F.count(F.lit(1)).cast("int") - 1, F.lit(0))).alias("other_urls"),
        F.min_by(point, F.struct(precision, "place")).alias("point"),
        F.bool_or(F.coalesce(F.col("segment") == "auction", F.lit(False))).alias("auction"),
    )


# What sites add to titles, and words of a location that say nothing more than the title.
TITLE_TAIL = r"(?i)\s*[-|·–]\s*(?:Μεσιτικό Γραφείο|Real Estate|Κτηματομεσιτικό)[^-|·–]*$"
PLAIN_PLACES = ("θεσσαλονίκη", "θεσσαλονίκης", "ελλάδα", "greece")


def short_title(title: Column, agency: Column, most: int = 90) -> Column:
    """Without the agency's name (whole, and up to " - ") and what sites add, cut at a length."""
    out = title
    for name in (agency, F.get(F.split(agency, " - ", 2), F.lit(0))):
        out = F.when(F.length(name) >= 4, F.replace(out, name, F.lit(" "))).otherwise(out)
    out = F.regexp_replace(F.regexp_replace(out, TITLE_TAIL, ""), r"\s+", " ")
    return F.substring(F.regexp_replace(out, r"^[ \-|·–,]+|[ \-|·–,]+$", ""), 1, most)


def short_location(location: Column, title: Column, generic: str = "") -> Column:
    """The location's first 40 characters, where they hold a word that the title hasn't."""
    shown = F.substring(location, 1, 40)
    said = lambda c: words(F.lower(F.coalesce(c, F.lit(""))), 3)
    plain = F.array(*[F.lit(w) for w in (*PLAIN_PLACES, *([generic.lower()] if generic else []))])
    return F.when(F.size(F.array_except(F.array_except(said(shown), said(title)), plain)) > 0, shown)


# Names of the floors that have no number.
FLOOR_NAMES = {-2.0: "basement", -1.0: "semi-basement", 0.0: "ground floor", 0.5: "mezzanine"}


def floor_name(level: Column) -> Column:
    out = F.when(level.isNotNull(), F.concat(F.lit("floor "), level.cast("int").cast("string")))
    for value, name in FLOOR_NAMES.items():
        out = F.when(level == value, F.lit(name)).otherwise(out)
    return out


def display_line(place: Column, type_: Column, m2: Column, floor: Column, price: Column, sites: Column, rent: Column | None = None, delta: Column | None = None) -> Column:
    """One line of a message: place, what it is, its size and floor, the price with its market delta, how many sites."""
    what = F.concat_ws(" ", F.coalesce(type_, F.lit("object")), F.when(m2.isNotNull(), F.concat(F.floor(m2).cast("string"), F.lit(" m²"))))
    unit = F.when(rent, F.lit(" €/month")).otherwise(F.lit(" €")) if rent is not None else F.lit(" €")
    shown = F.when(price.isNotNull(), F.concat(F.replace(F.format_number(F.floor(price), 0), F.lit(","), F.lit(" ")), unit)).otherwise(F.lit("price on request"))
    if delta is not None:
        sign = F.when(delta > 0, F.lit("+")).otherwise(F.lit("−"))
        shown = F.concat(shown, F.when(delta.isNotNull(), F.concat(F.lit(" ("), sign, F.abs(delta).cast("int").cast("string"), F.lit("% to the district's mean)"))).otherwise(F.lit("")))
    more = F.when(sites > 1, F.concat(F.lit("on "), sites.cast("string"), F.lit(" sites")))
    return F.concat_ws(", ", place, what, floor, shown, more)


def dictionary(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, code): codes by first appearance; values are aggregated before they are ranked."""
    first = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("first"))
    return ranked(first, [F.col("first"), F.col(value)]).select(value, F.col("rank_").alias("code"))


def split_url(url: Column) -> Column:
    """struct<prefix, rest>: up to the last slash, and what follows."""
    return F.struct(F.regexp_extract(url, r"^(.*/)?", 0).alias("prefix"), F.regexp_replace(url, r"^.*/", "").alias("rest"))


def trim_nulls(values: Column) -> Column:
    """An array without its trailing nulls."""
    last = F.array_max(F.transform(values, lambda x, i: F.when(x.isNotNull(), i + 1).otherwise(F.lit(0))))
    return F.slice(values, F.lit(1), F.coalesce(last, F.lit(0)))


def drop_empty(fields: Column) -> Column:
    """A map without keys whose value is null or empty."""
    return F.map_filter(fields, lambda k, v: v.isNotNull() & (v != ""))


def packed_rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, row): the columns, fullest first, as one JSON array without its trailing nulls."""
    fill = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    order = sorted(columns, key=lambda c: (-fill[c], c))
    return df.select(key, F.to_json(trim_nulls(F.array(*[F.col(c).cast("string") for c in order])), {"ignoreNullFields": "false"}).alias("row"))
