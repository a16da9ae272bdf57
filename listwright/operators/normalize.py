"""Normalisation of raw listings, stage by stage; each stage is DataFrame -> DataFrame.

Input order is meaning here (the first copy wins), so every ordered stage takes the explicit ``ord``
column. Dropped rows keep a ``drop_reason``, so a histogram costs no second scan. ``normalize`` runs the
stages in their fixed order; unknown values are null throughout.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listwright.config import City
from listwright.functions.dates import listing_day
from listwright.functions.geo import in_box, in_country, planar_km
from listwright.functions.numbers import in_range, number, per_unit
from listwright.functions.text import fold, has_cyrillic, unquote, url_key
from listwright.operators.rules import OFFICE_STEM, finds, first_match, guarded_match, transaction_of, type_of
from listwright.sources.shared import written

# Thresholds of the validation rules.
AREA_RANGE = (5.0, 100_000.0)
LEAST_SALE, MOST_RENT, LEAST_SALE_PER_M2 = 3_000, 20_000, 250
TTL_DAYS = 30
OFFICE_COUNT, OFFICE_SHARE = 5, 0.2
POINT_COUNT, POINT_SHARE = 5, 0.5
AGENCY_COUNT, AGENCY_SHARE = 10, 0.9
NEAREST_KM = 4.0
# Folded titles and URLs of pages that aren't listings, and of translations.
NOT_LISTING = (
    r"^αποτελεσματα|^results|^αναζητηση|^search|blog|ιστορια|ανοικοδομηση|η εταιρεια|εταιρεια μασ|ποιοι ειμαστε|επικοινωνια|"
    r"^ακινητα - |ευκαιριεσ ακινητων|^ergebnisse|^print$|^rezultat|^risultati"
)
NOT_LISTING_URL = r"/listings/(areas/)?n/?\d+|/blog/|/news/|/print/|/insights?/|/articles?/|-guide-"
FOREIGN_URL = r"/(ru|bg|sr|tr|zh|de|he|it|fr|ro)/|[?&](language|lang)=(de|bg|ru|sr|tr|it|fr|ro|zh|he)\b"
# Words of land (cheap per metre), contacts in a location field, prices in a title.
LAND_WORDS = r"οικοπεδ|αγροτεμ|\bplot|\bland\b|agric|parcel|εκταση"
CONTACT = r"(?iU)\b2\d{9}\b|\b69\d{8}\b|@|info\b|τηλ\.?|tel\b"
TITLE_PRICE = r"€\s?(\d{1,3}(?:\.\d{3})+|\d+)(?![\d.,])|(?<![\d.,])(\d{1,3}(?:\.\d{3})+|\d+)\s?€"
# The agency's office with its city, and what follows a place's name in a street address.
OFFICE_OF_CITY = r"(?U)(κτηματο)?μεσιτικ\w*\s+γραφει\w*\s*θεσσαλονικ\w*"
HOUSE_NUMBER = r"[^\W\d]*\.?\s*\d"
# An alert's short link and a page record of one portal name the listing by the same id.
TWIN_SITE, TWIN_PAGE, TWIN_LINK = "xe.gr", r"/property/d/[^/]+/([0-9a-f-]{36})", r"xe\.gr/p/([0-9a-f-]{36})"


def with_order(df: DataFrame, *keys: str) -> DataFrame:
    """``ord`` as a struct of the given keys: a total order without a global sort."""
    return df.withColumn("ord", F.struct(*keys))


def _empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def drop_alert_twins(df: DataFrame, site: str = TWIN_SITE, page: str = TWIN_PAGE, link: str = TWIN_LINK) -> DataFrame:
    """Alert links go where the same listing was read from its page."""
    key = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    pages = df.filter(F.col("source_domain") == site).select(key(page).alias("_twin")).filter("_twin is not null").distinct()
    pages = written(pages, "page-records")
    linked = df.withColumn("_link", F.when(F.col("source_domain") == site, key(link)))
    return linked.join(pages, F.col("_link") == F.col("_twin"), "left_anti").drop("_link")


def drop_reason(run_date: Column, chat_source: str = "t.me", alert_source: str = "portal alert") -> Column:
    """Why a row is no listing, a translation, or an alert or post too old to be believed; else null."""
    title, url = fold(_empty("title")), fold(unquote(_empty("url")))
    chat = F.coalesce(F.col("source_domain") == chat_source, F.lit(False))
    kept_by_date = F.coalesce(F.col("date_source") == alert_source, F.lit(False)) | chat
    return (
        F.when(finds(title, NOT_LISTING) | url.rlike(NOT_LISTING_URL), F.lit("not a listing"))
        .when((has_cyrillic(_empty("title")) & ~chat) | url.rlike(FOREIGN_URL), F.lit("translated duplicate"))
        .when(kept_by_date & (F.col("date_published") < F.date_sub(run_date, TTL_DAYS)), F.lit("old portal alert"))
    )


def mark_drops(df: DataFrame, run_date: Column, chat_source: str = "t.me", alert_source: str = "portal alert") -> DataFrame:
    """``drop_reason`` of each row; a table without ``date_source`` has no alerts."""
    if "date_source" not in df.columns:
        df = df.withColumn("date_source", F.lit(None).cast("string"))
    return df.withColumn("drop_reason", drop_reason(run_date, chat_source, alert_source))


def mark_url_copies(df: DataFrame) -> DataFrame:
    """``key_url``, and the reason of later copies of a URL among rows that are still alive.

    Rows dropped before reserve no URL; each gets a key of its own, so they don't meet in one task.
    """
    df = df.withColumn("key_url", url_key(F.col("url")))
    alive = F.col("drop_reason").isNull()
    w = Window.partitionBy("_lone", "key_url").orderBy("ord")
    ranked = df.withColumn("_lone", F.when(~alive, F.col("ord"))).withColumn("_rn", F.row_number().over(w))
    late = F.when(alive & (F.col("_rn") > 1), F.lit("duplicate url"))
    return ranked.withColumn("drop_reason", F.coalesce("drop_reason", late)).drop("_lone", "_rn")


def first_by_url(df: DataFrame, key: Column | None = None) -> DataFrame:
    """The first row of each URL; rows already dropped reserve nothing."""
    key = url_key(F.col("url")) if key is None else key
    w = Window.partitionBy("_key").orderBy("ord")
    return df.withColumn("_key", key).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_key")


OBJECT_KEY = ("source_domain", "transaction", "type", "price_eur", "area_m2")


def _object_rank(df: DataFrame) -> DataFrame:
    """``_rn`` by (site, transaction, type, price, area), 1 where price or area is unknown.

    Rows without them get their own order as a key, so they neither meet in one task nor are compared.
    """
    whole = F.col("price_eur").isNotNull() & F.col("area_m2").isNotNull()
    w = Window.partitionBy("_lone", *OBJECT_KEY).orderBy("ord")
    ranked = df.withColumn("_lone", F.when(~whole, F.col("ord"))).withColumn("_rn", F.when(whole, F.row_number().over(w)).otherwise(F.lit(1)))
    return ranked.drop("_lone")


def first_by_object(df: DataFrame) -> DataFrame:
    """The first row of each (site, transaction, type, price, area); rows without price or area stay."""
    return _object_rank(df).filter("_rn = 1").drop("_rn")


def title_price(title: Column) -> Column:
    """The price that a title states ("..., €700", "1.200 €"); points part thousands."""
    found = [F.nullif(F.regexp_extract(title, TITLE_PRICE, g), F.lit("")) for g in (1, 2)]
    return F.replace(F.coalesce(*found), F.lit("."), F.lit("")).try_cast("double")


def sane_price(price: Column, area: Column, transaction: Column, words: Column) -> Column:
    """The price, or null where it can't be one of such a deal; no price of 0."""
    p = F.nullif(price, F.lit(0.0))
    land = finds(words, LAND_WORDS)
    bad = (
        ((transaction == "sale") & (p < LEAST_SALE))
        | ((transaction == "rent") & (p > MOST_RENT))
        | ((transaction == "sale") & (area > 0) & (p / area < LEAST_SALE_PER_M2) & ~F.coalesce(land, F.lit(False)))
    )
    return F.when(~F.coalesce(bad, F.lit(False)), p)


def _words() -> Column:
    return F.concat_ws(" ", fold(_empty("title")), fold(unquote(_empty("url"))))


def validate(df: DataFrame) -> DataFrame:
    """Casts, range checks and cross-field checks of price and area, in that order."""
    df = df.withColumns({"price_eur": number(F.col("price_eur")), "area_m2": in_range(number(F.col("area_m2")), *AREA_RANGE)})
    df = df.withColumn("price_eur", sane_price(F.col("price_eur"), F.col("area_m2"), F.col("transaction"), _words()))
    return df.withColumn("price_per_m2", per_unit(F.col("price_eur"), F.col("area_m2")))


def office_addresses(df: DataFrame, least: int = OFFICE_COUNT, share: float = OFFICE_SHARE) -> DataFrame:
    """(source_domain, location) that so many of a site's listings share that it is the office's."""
    by_place = df.groupBy("source_domain", "location").agg(F.count(F.lit(1)).alias("n"))
    by_site = by_place.groupBy("source_domain").agg(F.sum("n").alias("total"))
    return by_place.filter("location is not null").join(by_site, "source_domain").filter(
        (F.col("n") >= least) & (F.col("n") / F.col("total") >= share) & F.col("location").rlike("[0-9]")
    )


def mask_offices(df: DataFrame, offices: DataFrame | None = None) -> DataFrame:
    """Locations that are office addresses, phones or e-mails become null."""
    offices = office_addresses(df) if offices is None else offices
    marked = offices.select(F.col("source_domain").alias("_site"), F.col("location").alias("_place"))
    private = F.coalesce(F.col("location").rlike(CONTACT), F.lit(False))
    return (
        df.join(marked, (F.col("source_domain") == F.col("_site")) & (F.col("location") == F.col("_place")), "left")
        .withColumn("location", F.when(F.col("_place").isNull() & ~private, F.col("location")))
        .drop("_site", "_place")
    )


def office_points(df: DataFrame) -> DataFrame:
    """Sites whose most common point holds more than half of at least five points."""
    points = df.filter("lat is not null and lon is not null").groupBy("source_domain", "lat", "lon").count()
    return (
        points.groupBy("source_domain")
        .agg(F.sum("count").alias("points"), F.max("count").alias("most"))
        .filter((F.col("points") >= POINT_COUNT) & (F.col("most") > POINT_SHARE * F.col("points")))
    )


def is_other(text: Column, city: City) -> Column:
    """Whether a text names a place of another region; a name before a house number is a street."""
    return F.coalesce(guarded_match(text, city.other_regions, HOUSE_NUMBER), F.lit(False))


def place(own: tuple[Column, Column, Column], location: tuple[Column, Column, Column], city: City) -> Column:
    """struct<region, area, region_how> from two texts' (district, names another region, names the city).

    What title and URL say comes before what the location field says. Another region beats a district,
    and a bare name of the city in the location field is often the agency's own address.
    """
    no = F.lit(None).cast("string")

    def answer(region: str, area: Column, how: str | None) -> Column:
        return F.struct(F.lit(region).alias("region"), area.alias("area"), F.lit(how).cast("string").alias("region_how"))

    def said(hit: Column, other: Column, generic: Column, how: str) -> Column:
        return (
            F.when(other, answer("other", no, "listing"))
            .when(hit.isNotNull(), answer(city.key, hit, "listing"))
            .when(generic, answer(city.key, F.lit(city.generic), how))
        )

    return F.coalesce(said(*own, "listing"), said(*location, "location"), answer("unknown", no, None))


def _vague(area: Column, city: City) -> Column:
    return area.isNull() | (area == city.generic)


def named_area(text: Column, district: Column, city: City) -> Column:
    """The id of the first map area that a text names, of the district unless that is vague."""
    out = F.lit(None).cast("string")
    for a in reversed([a for a in city.map_areas if a.pattern]):
        out = F.when(finds(text, a.pattern) & (_vague(district, city) | (district == a.district)), F.lit(a.id)).otherwise(out)
    return out


def district_of(area_id: Column, city: City) -> Column:
    out = F.lit(None).cast("string")
    for a in city.map_areas:
        out = F.when(area_id == a.id, F.lit(a.district)).otherwise(out)
    return out


def _hinted(df: DataFrame, hints: DataFrame, generic: str, home: str | None) -> DataFrame:
    """Hints applied; what they say stays in _region, _area and _neighbourhood."""
    names = [c for c in ("url", "region", "area", "neighbourhood") if c in hints.columns]
    h = hints.select(*[F.nullif(F.col(c), F.lit("")).alias(f"_{c}") for c in names])
    joined = df.join(h, F.col("url") == F.col("_url"), "left").drop("_url")
    vague = F.col("area").isNull() | (F.col("area") == generic)
    takes = F.col("_region").isNotNull() & vague & (_empty("region") != "other")
    away = F.col("_region") == "other"
    used = takes & ~(away & (_empty("region_how") == "listing"))
    here = F.lit(home) if home else F.col("_region")
    return joined.withColumns(
        {
            "region": F.when(used & away, F.lit("other")).when(used, here).otherwise(F.col("region")),
            "area": F.when(used & away, F.lit(None)).when(used, F.coalesce("_area", "area", F.lit(generic))).otherwise(F.col("area")),
            "region_how": F.when(used, F.lit("page")).otherwise(F.col("region_how")),
        }
    )


def apply_hints(df: DataFrame, hints: DataFrame, generic: str, home: str | None = None) -> DataFrame:
    """Districts read from pages, where a listing's own is missing or generic.

    A page that names another region counts unless the listing itself named the place.
    """
    return _hinted(df, hints, generic, home).drop("_region", "_area", "_neighbourhood")


def fill_from_agency(df: DataFrame, home: str, generic: str | None = None, least: int = AGENCY_COUNT, share: float = AGENCY_SHARE) -> DataFrame:
    """Unplaced listings (region unknown or null) of sites whose placed ones, portals' aside, are nearly all at home."""
    placed = df.filter(F.col("region").isin(home, "other") & (_empty("source_kind") != "portal"))
    local = (
        placed.groupBy("source_domain")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("region") == home).alias("here"))
        .filter((F.col("n") >= least) & (F.col("here") / F.col("n") >= share))
        .select(F.col("source_domain").alias("_site"))
    )
    local = written(local, "local-sites")
    joined = df.join(local, F.col("source_domain") == F.col("_site"), "left")
    takes = F.col("_site").isNotNull() & (F.coalesce("region", F.lit("unknown")) == "unknown")
    filled = {"region": F.when(takes, F.lit(home)).otherwise(F.col("region"))}
    if generic is not None:
        filled |= {"area": F.when(takes, F.lit(generic)).otherwise(F.col("area")), "region_how": F.when(takes, F.lit("agency")).otherwise(F.col("region_how"))}
    return joined.withColumns(filled).drop("_site")


def nearest_of(lat: Column, lon: Column, centres: dict) -> Column:
    """struct<km, district> of the nearest of a configured few centres; the earlier of equals."""
    each = [F.struct(planar_km(lat, lon, F.lit(float(y)), F.lit(float(x))).alias("km"), F.lit(i).alias("i"), F.lit(name).alias("district")) for i, (name, (y, x)) in enumerate(centres.items())]
    return F.array_min(F.array(*each))


def with_offices(df: DataFrame) -> DataFrame:
    """``_office``: whether the row's site gives most of its listings one point. Sites are joined once."""
    sites = written(office_points(df).select(F.col("source_domain").alias("_office_site")), "office-sites")
    return df.join(sites, F.col("source_domain") == F.col("_office_site"), "left").withColumn("_office", F.col("_office_site").isNotNull()).drop("_office_site")


def fill_from_coordinates(df: DataFrame, city: City, inside: Column) -> DataFrame:
    """Regions and districts of listings whose own point says more than their text.

    ``inside`` is the map area that holds the point; rows need ``_office`` (see ``with_offices``).
    """
    lat, lon = number(F.col("lat")), number(F.col("lon"))
    region, area, how = F.col("region"), F.col("area"), F.col("region_how")
    usable = lat.isNotNull() & lon.isNotNull() & ~F.col("_office") & F.col("neighbourhood").isNull()
    outside = ~in_box(lat, lon, city.box, city.box_exclude)
    vague = _vague(area, city)
    unsure = (region == "unknown") | (vague & (_empty(how) != "listing"))
    away = usable & (region != "other") & outside & unsure & in_country(lat, lon)
    here = usable & (region != "other") & ~outside
    parent = district_of(inside, city)
    held = F.coalesce(here & inside.isNotNull() & (vague | (area == parent)), F.lit(False))
    near = here & ~held & vague
    centre = nearest_of(lat, lon, dict(city.centres)) if city.centres else F.lit(None).cast("struct<km:double,i:int,district:string>")
    close_by = F.when(centre["km"] <= NEAREST_KM, centre["district"])
    no = F.lit(None).cast("string")
    return df.withColumns(
        {
            "region": F.when(away, F.lit("other")).when(held | near, F.lit(city.key)).otherwise(region),
            "area": F.when(away, no).when(held, parent).when(near, F.coalesce(close_by, area, F.lit(city.generic))).otherwise(area),
            "neighbourhood": F.when(held, inside).otherwise(F.col("neighbourhood")),
            "region_how": F.when(away, F.lit("coordinates")).when(held | near, F.coalesce(how, F.lit("coordinates"))).otherwise(how),
        }
    )


def map_point(df: DataFrame, city: City) -> DataFrame:
    """map_lat, map_lon and geo, how precise they are: the site's own point, a map area's or a district's centre."""
    lat, lon = number(F.col("lat")), number(F.col("lon"))
    own = F.coalesce(~F.col("_office") & in_country(lat, lon), F.lit(False))
    point = lambda y, x: F.struct(y.cast("double").alias("y"), x.cast("double").alias("x"))
    by_area, by_district = (F.lit(None).cast("struct<y:double,x:double>") for _ in range(2))
    for a in city.map_areas:
        if a.centre:
            by_area = F.when(F.col("neighbourhood") == a.id, point(F.lit(a.centre[0]), F.lit(a.centre[1]))).otherwise(by_area)
    for name, (y, x) in city.centres.items():
        by_district = F.when((F.col("region") == city.key) & (F.col("area") == name), point(F.lit(y), F.lit(x))).otherwise(by_district)
    best = F.when(own, point(lat, lon)).otherwise(F.coalesce(by_area, by_district))
    geo = F.when(own, F.lit("site")).when(by_area.isNotNull(), F.lit("area")).when(by_district.isNotNull(), F.lit("district"))
    return df.withColumn("_p", best).withColumns({"map_lat": F.bround("_p.y", 5), "map_lon": F.bround("_p.x", 5), "geo": geo}).drop("_p")


class Normalized(NamedTuple):
    """``listings``: one row per kept listing; ``dropped``: ord and drop_reason; ``history``: url, first_seen, last_seen."""

    listings: DataFrame
    dropped: DataFrame
    history: DataFrame


#: Columns a raw row may lack; they are null then.
OPTIONAL = {
    "agency": "string", "date_source": "string", "date_published": "date", "date_updated": "date", "date_sitemap": "date", "scraped_at": "string", "checked_at": "string",
    "bedrooms": "string", "floor": "string", "year_built": "string", "lat": "string", "lon": "string", "image": "string", "segment": "string", "auction_date": "string", "auction_round": "string",
}


def placed_listings(df: DataFrame, city: City, hints: DataFrame | None) -> DataFrame:
    """Region, district and map area from text and hints."""
    title, url = fold(_empty("title")), fold(unquote(_empty("url")))
    df = df.drop("region", "area", "region_how", "neighbourhood")
    df = df.withColumns({"_own": F.concat(F.when(title.contains(OFFICE_STEM), F.regexp_replace(title, OFFICE_OF_CITY, " ")).otherwise(title), F.lit(" "), url), "_loc": fold(_empty("location"))})
    seen = {}
    for name in ("_own", "_loc"):  # each pattern runs once a text
        seen |= {f"{name}_hit": first_match(F.col(name), city.specific), f"{name}_other": is_other(F.col(name), city), f"{name}_city": finds(F.col(name), city.generic_re)}
    df = df.withColumns(seen)
    told = [tuple(F.col(f"{name}_{x}") for x in ("hit", "other", "city")) for name in ("_own", "_loc")]
    df = df.withColumn("_placed", place(*told, city)).select("*", "_placed.*").drop("_placed", *seen)
    hinted = F.lit(None).cast("string")
    if hints is not None:
        df = _hinted(df, hints, city.generic, city.key)
        renamed = F.col("_neighbourhood")
        for old, new in city.old_names.items():
            renamed = F.when(F.col("_neighbourhood") == old, F.lit(new)).otherwise(renamed)
        hinted = F.when(F.col("_area").eqNullSafe(F.col("area")) & (district_of(renamed, city) == F.col("area")), renamed)
    named = F.coalesce(named_area(F.col("_own"), F.col("area"), city), named_area(F.col("_loc"), F.col("area"), city), hinted)
    df = df.withColumn("neighbourhood", F.when(F.col("region") == city.key, named))
    parent = district_of(F.col("neighbourhood"), city)
    df = df.withColumn("area", F.when(F.col("neighbourhood").isNotNull() & _vague(F.col("area"), city), parent).otherwise(F.col("area")))
    return df.drop("_own", "_loc", "_region", "_area", "_neighbourhood")


def decided(raw: DataFrame, city: City, run_date: Column, hints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): what each row says alone, and copies marked; ``kept`` is written.

    Twins of alerts go; office addresses are found over what is left; drops and copies of a URL are
    marked; location, price, deal, type and place are decided row by row; copies of an object are marked.
    """
    missing = {c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in raw.columns}
    rows = drop_alert_twins(raw.withColumns(missing) if missing else raw)
    offices = written(office_addresses(rows), "offices")
    marked = mark_url_copies(mark_drops(rows, run_date, city.chat_source, city.alert_date_source))
    alive = mask_offices(marked.filter("drop_reason is null").drop("drop_reason"), offices)
    price = F.nullif(F.coalesce(title_price(F.col("title")), number(F.col("price_eur"))), F.lit(0.0))
    # Folded once a row: the rules below name these columns many times.
    alive = alive.withColumns({"_price": price, "area_m2": in_range(number(F.col("area_m2")), *AREA_RANGE), "_title": fold(_empty("title")), "_url": fold(unquote(_empty("url")))})
    alive = alive.withColumn("_words", F.concat_ws(" ", "_title", "_url"))
    words = F.col("_words")
    alive = alive.withColumns({"transaction": transaction_of(words, F.col("transaction"), F.col("_price")), "type": type_of(F.col("_title"), F.col("type"), F.col("_url"))})
    alive = alive.withColumn("price_eur", sane_price(F.col("_price"), F.col("area_m2"), F.col("transaction"), words)).drop("_price", "_title", "_url", "_words")
    # What was dropped and the passes over the whole table read it several times; it is computed once.
    ranked = written(_object_rank(placed_listings(alive, city, hints)), "decided")
    kept = ranked.filter("_rn = 1").drop("_rn")
    copies = ranked.filter("_rn > 1").select("ord", F.lit("duplicate object").alias("drop_reason"))
    dropped = marked.filter("drop_reason is not null").select("ord", "drop_reason").unionByName(copies)
    return kept, dropped


def normalize(
    raw: DataFrame, city: City, run_date: Column, hints: DataFrame | None = None, history: DataFrame | None = None, areas: DataFrame | None = None
) -> Normalized:
    """Raw listings (with ``ord``) as the silver table, in the fixed order of the stages.

    Rows are decided alone (``decided``); first and last days seen are merged; then come the three passes over the
    whole table: coordinates, the agency's profile, map points. ``areas`` (id, official, polygons) hold the map.
    """
    from listwright.operators.spatial import with_area

    kept, dropped = decided(raw, city, run_date, hints)
    seen_day = F.to_date(F.substring("scraped_at", 1, 10))
    kept = kept.withColumn("_day", seen_day)
    seen = kept.select(F.col("key_url").alias("url"), F.col("_day").alias("first_seen"), F.col("_day").alias("last_seen"))
    if history is not None:
        from listwright.operators.history import seen_merge

        merged = seen_merge(history, seen)
        before = history.groupBy("url").agg(F.min("first_seen").alias("_first")).withColumnRenamed("url", "_known")
        kept = kept.join(before, F.col("key_url") == F.col("_known"), "left").withColumn("first_seen", F.least("_first", "_day")).drop("_known", "_first")
    else:
        merged = seen
        kept = kept.withColumn("first_seen", F.col("_day"))
    day, kind = listing_day(F.col("date_published"), F.col("date_updated"), F.col("date_sitemap"))
    kept = kept.withColumns({"listing_date": day, "listing_date_kind": kind})

    kept = with_offices(kept)
    kept = with_area(kept, areas, number(F.col("lat")), number(F.col("lon"))) if areas is not None else kept.withColumn("area_id", F.lit(None).cast("string"))
    kept = fill_from_coordinates(kept, city, F.col("area_id")).drop("area_id")
    kind_of_source = F.when(F.col("source_domain").isin(*city.portals), F.lit("portal")).otherwise(F.lit("agency_site")) if city.portals else F.lit("agency_site")
    kept = fill_from_agency(kept.withColumn("source_kind", kind_of_source), city.key, city.generic)
    kept = map_point(kept, city).drop("_office", "_day")
    out = kept.select(
        "ord", "key_url", "source_domain", "agency", "url", "title", "source_kind", _empty("agency").startswith(city.private_prefix).alias("private_owner"),
        "transaction", "type", F.col("price_eur").cast("long").alias("price_eur"), F.bround("area_m2", 1).alias("area_m2"), per_unit(F.col("price_eur"), F.col("area_m2")).alias("price_per_m2"),
        "bedrooms", "floor", "year_built", "region", "area", "neighbourhood", F.col("location").alias("location_raw"), "region_how", "lat", "lon", "image",
        "listing_date", "listing_date_kind", "first_seen", "scraped_at", "checked_at", "segment", "auction_date", "auction_round", "map_lat", "map_lon", "geo",
    )
    return Normalized(out, dropped, merged)


def drop_reasons(df: DataFrame) -> DataFrame:
    return df.filter("drop_reason is not null").groupBy("drop_reason").count()


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, rate) of each column, one aggregate over one scan."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled")) for c in columns]))
    return counts.select("_n", pairs.alias("p")).select("p.column_name", "p.filled", F.round(100 * F.col("p.filled") / F.col("_n"), 1).alias("rate"))
