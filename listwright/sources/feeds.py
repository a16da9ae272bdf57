"""Landed feeds as raw listings: marketplace items, result cards, profiles, posts, alerts, directories.

Every reader gives the raw columns (``RAW``); what a source doesn't say is null. Formats of the sources
(class names, attributes, labels, patterns) are fixed values beside the reader that needs them.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions import numbers
from listwright.functions.dates import epoch_day, relative_day, sheet_day
from listwright.functions.geo import in_box
from listwright.functions.text import squeeze, strip_tags, unescape
from listwright.operators.rules import first_match, kind_by_word
from listwright.sources.shared import once

#: The raw listing's columns and types, in order.
RAW = {
    "source_domain": "string", "agency": "string", "url": "string", "title": "string", "transaction": "string", "type": "string", "price_eur": "double",
    "area_m2": "double", "bedrooms": "string", "floor": "string", "year_built": "string", "location": "string", "lat": "double", "lon": "double", "image": "string",
    "date_published": "date", "date_updated": "date", "date_sitemap": "date", "date_source": "string", "scraped_at": "string", "checked_at": "string",
    "segment": "string", "auction_date": "date", "auction_round": "string",
}


def raw_row(fields: dict[str, Column], extra: Sequence[str] = ()) -> list[Column]:
    """The raw columns from those that a source gives, and further ones by name."""
    return [*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in RAW.items()], *[fields[n].alias(n) for n in extra]]


def _none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """The first match's group, null where there is none."""
    return _none(F.regexp_extract(c, pattern, n))


def _text(c: Column, pattern: str) -> Column:
    return _none(strip_tags(F.regexp_extract(c, pattern, 1)))


def _from(parts: Column, first: int = 2) -> Column:
    return F.slice(parts, F.lit(first), F.greatest(F.size(parts) - (first - 1), F.lit(0)))


def _literal(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def today_of(now: str) -> Column:
    return F.lit(now[:10]).cast("date")


def localized(values: Column, locale: str = "el") -> Column:
    """The text of a locale, else the first."""
    own = F.get(F.filter(values, lambda v: v["locale"] == locale), F.lit(0))
    return F.coalesce(own["value"], F.get(values, F.lit(0))["value"])


# ---- marketplace items (JSON pages of an API, landed) ----

# The marketplaces' types, and what they call the two ways to sell.
MARKET_TYPES = {
    "apartment": "apartment", "studio": "studio", "maisonette": "maisonette", "residence": "house", "detachedHouse": "house", "complexOfVillasMaisonettes": "house",
    "plot": "land", "field": "land", "retail": "store", "officeUnit": "office", "storage": "warehouse", "industrialBuilding": "warehouse",
    "residentialBuilding": "building", "parking": "parking", "hotel": "hotel",
}
SEGMENTS = {"sale": "bank", "auction": "auction"}
PER_PAGE, MOST_PAGES = 100, 40
_LOCALIZED = "array<struct<locale: string, value: string>>"
MARKET_ITEM = (
    "id string, acquired boolean, status string, type string, coordinates array<double>, price double, price_upon_request boolean, price_is_reserved boolean, "
    f"size double, bedrooms string, build_year string, title {_LOCALIZED}, region {_LOCALIZED}, floor_label {_LOCALIZED}, "
    "created_at bigint, updated_at bigint, auction_date bigint, auction_date_to_be_announced boolean, auction_round string, "
    "images array<struct<sizes: struct<lg: string, md: string>>>"
)


class Market(NamedTuple):
    """A marketplace: its domain, shown name, and the base of its public pages."""

    domain: str
    name: str
    site: str


def corners(box: Sequence[float]) -> str:
    """A box (lat_min, lat_max, lon_min, lon_max) as the four corners that the search takes."""
    s, n, w, e = box
    return "(" + ", ".join(f"{v:.5f}" for v in (n, e, n, w, s, w, s, e)) + ")"


def search_query(commercialization: str, box: Sequence[float], page: int) -> str:
    """The server-side predicate of one page: segment and box, newest first."""
    from urllib.parse import urlencode

    return urlencode({"filter_by": f"commercialization:={commercialization}&&coordinates: {corners(box)}", "page": page, "sort_by": "created_at:desc", "per_page": PER_PAGE})


def wanted_pages(pages: DataFrame, part: Sequence[str], page: str = "page", items: str = "items", full: int = PER_PAGE, most: int = MOST_PAGES) -> DataFrame:
    """Landed pages up to each part's first short one, and no more than the limit."""
    from pyspark.sql.window import Window

    before = Window.partitionBy(*part).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    short = F.coalesce(F.max((F.size(items) < full).cast("int")).over(before), F.lit(0))
    return pages.withColumn("_short", short).filter((F.col("_short") == 0) & (F.col(page) <= most)).drop("_short")


def market_rows(items: DataFrame, market: Market, box: Sequence[float], now: str, exclude: Sequence[Sequence[float]] = ()) -> DataFrame:
    """Marketplace items (``item``: JSON text, ``segment``: bank or auction) as raw rows: public, on sale, in the box."""
    x = items.select("segment", F.from_json("item", MARKET_ITEM).alias("x")).select("segment", "x.*")
    lat, lon = F.get("coordinates", F.lit(0)), F.get("coordinates", F.lit(1))
    open_ = ~F.coalesce("acquired", F.lit(False)) & (F.coalesce("status", F.lit("public")) == "public") & lat.isNotNull() & lon.isNotNull()
    auction = F.col("segment") == "auction"
    hidden = F.coalesce("price_upon_request", F.lit(False)) | F.coalesce("price_is_reserved", F.lit(False))
    images = F.transform("images", lambda i: F.coalesce(_none(i["sizes"]["lg"]), _none(i["sizes"]["md"])))
    return x.filter(open_ & in_box(lat, lon, box, exclude)).select(
        *raw_row(
            {
                "source_domain": F.lit(market.domain), "agency": F.lit(market.name), "url": F.concat(F.lit(f"{market.site}/listings/"), F.col("id")),
                "title": localized(F.col("title")), "transaction": F.lit("sale"), "type": F.element_at(_literal(MARKET_TYPES), F.coalesce("type", F.lit(""))),
                "price_eur": F.when(~hidden, F.nullif("price", F.lit(0.0))), "area_m2": F.nullif("size", F.lit(0.0)), "bedrooms": _none(F.col("bedrooms")),
                "floor": _none(localized(F.col("floor_label"))), "year_built": _none(F.col("build_year")), "location": _none(localized(F.col("region"))), "lat": lat, "lon": lon,
                "image": F.get(images, F.lit(0)), "date_published": epoch_day(F.col("created_at")), "date_updated": epoch_day(F.col("updated_at")),
                "date_source": F.lit("marketplace api created_at / updated_at"), "scraped_at": F.lit(now), "checked_at": F.lit(now[:10]), "segment": F.col("segment"),
                "auction_date": F.when(auction & ~F.coalesce("auction_date_to_be_announced", F.lit(False)), epoch_day(F.col("auction_date"))),
                "auction_round": F.when(auction, _none(F.col("auction_round"))),
            }
        )
    )


# ---- HTML cards of two sites that share a platform, and the points of their map ----

# Greek words on the cards and the types they stand for, in order.
CARD_TYPES = (
    ("γκαρσονιέρα", "studio"), ("μεζονέτα", "maisonette"), ("διαμέρισμα", "apartment"), ("μονοκατοικία", "house"), ("βίλα", "house"), ("οικόπεδο", "land"),
    ("αγροτεμάχιο", "land"), ("κατάστημα", "store"), ("γραφείο", "office"), ("αποθήκη", "warehouse"), ("βιομηχαν", "warehouse"), ("βιοτεχν", "warehouse"),
    ("κτίριο", "building"), ("πολυκατοικία", "building"), ("θέση στάθμευσης", "parking"), ("parking", "parking"), ("ξενοδοχ", "hotel"),
)
CARD_PAGE = 50


class CardSite(NamedTuple):
    """A site of the platform: domain, shown name, base, path of a listing, segment."""

    domain: str
    name: str
    base: str
    path: str
    segment: str


def platform_cards(html: Column) -> Column:
    """array<struct> of the cards on a list page; cards without an id are left out."""

    def card(c: Column) -> Column:
        title = F.regexp_extract(c, r'(?s)<h6 class="list-title[^"]*">(.*?)</h6>', 1)
        spans = F.regexp_extract_all(title, F.lit(r"(?s)<span>(.*?)</span>"), F.lit(1))
        after = strip_tags(F.regexp_replace(title, r"(?s)<span>.*?</span>", " "))
        below = F.regexp_extract(c, r'<p class="">\s*([^<]+)', 1)
        date = F.regexp_extract(c, r'(?s)title="Ημερομηνία Δημοπρασίας">.*?(\d{2}-\d{2}-\d{4})', 1)
        return F.struct(
            group(c, r'data-property-id="(\d+)"').alias("id"),
            _none(F.regexp_replace(strip_tags(F.get(spans, F.lit(0))), "^[ ,]+|[ ,]+$", "")).alias("place"),
            _none(F.regexp_replace(F.when(below != "", below).otherwise(after), r"^[ |\n]+|[ |\n]+$", "")).alias("kind"),
            numbers.listed_number(F.regexp_extract(c, r"([\d.,]+)\s*(?:<span>)?\s*m<sup>2", 1)).alias("area"),
            numbers.listed_number(F.regexp_extract(c, r'(?s)<div class="list-price">.*?([\d.]+)\s*€', 1)).alias("price"),
            group(c, r"fa-bed-front[^>]*></i>\s*<span[^>]*>(\d+)").alias("bedrooms"),
            group(c, r'<img[^>]*src="([^"]+)"').alias("image"),
            F.try_to_date(date, "dd-MM-yyyy").alias("auction_date"),
            group(c, r"(\d+)\s*ος\s*γύρος").alias("round"),
            F.replace(group(title, r"\((\d+(?:[.,]\d+)?)%\)"), F.lit(","), F.lit(".")).alias("share"),
        )

    return F.filter(F.transform(_from(F.split(html, 'class="listing-style1"', -1)), card), lambda x: x["id"].isNotNull())


def platform_rows(pages: DataFrame, points: DataFrame, site: CardSite, box: Sequence[float], now: str, exclude: Sequence[Sequence[float]] = ()) -> DataFrame:
    """Cards of landed list pages (``html``) joined with the map's points (id, latitude, longitude): raw rows in the box."""
    cards = pages.select(F.explode(platform_cards(F.col("html"))).alias("c")).select("c.*")
    at = points.select(F.col("id").cast("string").alias("_id"), F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon"))
    shown = F.col("area")
    size = F.when(shown.isNotNull(), F.concat(F.when(shown == F.floor(shown), F.floor(shown).cast("string")).otherwise(shown.cast("string")), F.lit(" τ.μ.")))
    partial = F.when(F.col("share").cast("double") < 100, F.concat(F.lit(" (μερίδιο "), F.col("share"), F.lit("%)"))).otherwise(F.lit(""))
    auction = F.lit(site.segment == "auction")
    rows = cards.join(at, F.col("id") == F.col("_id")).filter(in_box(F.col("lat"), F.col("lon"), box, exclude))
    return rows.select(
        *raw_row(
            {
                "source_domain": F.lit(site.domain), "agency": F.lit(site.name), "url": F.concat(F.lit(f"{site.base}/{site.path}/"), F.col("id")),
                "title": F.concat(F.concat_ws(", ", "kind", size, "place"), partial), "transaction": F.lit("sale"), "type": kind_by_word(F.coalesce("kind", F.lit("")), CARD_TYPES),
                "price_eur": F.col("price"), "area_m2": F.col("area"), "bedrooms": F.col("bedrooms"), "location": F.col("place"), "lat": F.col("lat"), "lon": F.col("lon"),
                "image": F.col("image"), "scraped_at": F.lit(now), "checked_at": F.lit(now[:10]), "segment": F.lit(site.segment),
                "auction_date": F.when(auction, F.col("auction_date")), "auction_round": F.when(auction, F.col("round")),
            }
        )
    ).dropDuplicates(["url"])


# ---- cards of a network's result pages ----


def network_cards(html: Column, transaction: Column, base: str, domain: str, name: str, now: str) -> Column:
    """array<struct> of raw fields of a network's cards; a card begins at its block with id and photos."""

    def text(c: Column, cls: str) -> Column:
        return _text(c, rf'(?s)class="{cls}"[^>]*>(.*?)</div>')

    def feature(c: Column, cls: str) -> Column:
        return _text(c, rf'(?s)class="feature {cls}".*?class="label">(.*?)</span>')

    def card(c: Column) -> Column:
        path = group(c, r'href="(/property/\d+-[^"?#]+)"')
        place, path_text, price = _text(c, r'(?s)<h4 class="title">(.*?)</h4>'), text(c, "path"), text(c, "price")
        fields = {
            "source_domain": F.lit(domain), "agency": F.coalesce(_text(c, r'(?s)class="office-name">(.*?)</div>'), F.lit(name)), "url": F.concat(F.lit(base), path),
            "title": F.concat_ws(" · ", text(c, "category"), place, path_text), "transaction": transaction, "price_eur": numbers.card_number(price),
            "area_m2": numbers.card_number(F.regexp_replace(feature(c, "sqrMeters"), r"m\s*2.*", "")), "bedrooms": _none(F.regexp_replace(feature(c, "rooms"), r"\D", "")),
            "floor": feature(c, "floor"), "location": _none(F.concat_ws(", ", place, path_text)),
            "image": F.concat(F.lit(base), unescape(group(c, r'<img[^>]+src="(/assets/media/properties/[^"]+)"'))), "scraped_at": F.lit(now), "checked_at": F.lit(now[:10]),
        }
        return F.struct(*raw_row(fields), group(c, r'href="/property/(\d+)-[^"?#]+"').alias("network_id"))

    return F.filter(F.transform(_from(F.split(html, '<div class="property-miniature"', -1)), card), lambda x: x["url"].isNotNull())


def last_page(html: Column, category: str, area: str) -> Column:
    """The highest page number that a result page links to, 1 without any."""
    found = F.regexp_extract_all(html, F.lit(rf'href="/{category}/{area}(?:-[^"?]+)?\?Property_page=(\d+)"'), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda n: n.cast("int"))), F.lit(1))


# ---- cards of a portal's result pages ----


def portal_cards(html: Column, page_url: Column, now: str, domain: str = "xe.gr", private: str = "Ιδιώτης (XE.gr)") -> Column:
    """array<struct> of raw fields of a portal's cards: from the image before a card's body to its actions."""
    today = today_of(now)
    transaction = F.when(page_url.rlike("/enoikiase"), F.lit("rent")).otherwise(F.lit("sale"))
    mark = 'data-testid="property-ad-image-container"'

    def test_id(c: Column, name: str) -> Column:
        return _text(c, rf'(?s)data-testid="{name}"[^>]*>(.*?)</(?:div|h3|span)>')

    def card(c: Column) -> Column:
        c = F.substring_index(c, 'data-testid="property-ad-actions"', 1)
        title, address, price = test_id(c, "property_ad_title"), test_id(c, "property_ad_address"), test_id(c, "property_ad_price")
        owner = _text(c, r'(?s)data-testid="common-ad-owner-title"[^>]*>(.*?)</div>')
        owner_url = group(c, r'href="(https://www\.xe\.gr/property/s/[^"]+)"')
        footer = F.regexp_extract(c, r"(?s)(common_ad_body_footer.*)", 1)
        when = F.regexp_extract(footer, r">\s*(Πριν[^<]{2,30}|Μόλις[^<]{0,20}|Σήμερα[^<]{0,20}|\d{1,2}/\d{1,2}/\d{4})\s*<", 1)
        fields = {
            "source_domain": F.lit(domain), "agency": F.when(owner.isNotNull(), owner).when(owner_url.isNull(), F.lit(private)),
            "url": group(c, r'href="(https://www\.xe\.gr/property/d/[^"?]+)'), "title": F.concat_ws(" · ", title, address), "transaction": transaction,
            "price_eur": numbers.portal_number(price), "area_m2": numbers.portal_number(F.regexp_extract(title, r"([\d.,]+)\s*τ\.μ\.", 1)),
            "bedrooms": _none(F.regexp_replace(test_id(c, "property_ad_icon_bedroom"), r"\D", "")), "floor": test_id(c, "property_ad_icon_levels_new"),
            "year_built": _none(F.substring(F.regexp_replace(test_id(c, "property_ad_icon_house_construction"), r"\D", ""), 1, 4)), "location": address,
            "image": unescape(group(c, r'<img src="(https://blob\.cdn\.xe\.gr/[^"]+)"')), "date_updated": relative_day(when, today),
            "date_source": F.lit("xe card"), "scraped_at": F.lit(now),
        }
        return F.struct(*raw_row(fields), group(c, r'id="common_ad_body_([0-9a-f-]{36})"').alias("portal_id"), owner_url.alias("owner_url"))

    return F.filter(F.transform(_from(F.split(html, mark, -1)), card), lambda x: x["portal_id"].isNotNull())


# ---- agency profiles: JSON in an attribute ----

# The portal's types.
PROFILE_TYPES = {
    "APARTMENT": "apartment", "STUDIO": "studio", "MAISONETTE": "maisonette", "DETACHED_HOUSE": "house", "HOUSE": "house", "VILLA": "house", "BUILDING": "building",
    "APARTMENT_COMPLEX": "building", "PARCEL": "land", "PLOT": "land", "LAND": "land", "STORE": "store", "OFFICE": "office", "WAREHOUSE": "warehouse",
    "INDUSTRIAL_SPACE": "warehouse", "PARKING": "parking", "HOTEL": "hotel",
}
PROFILE_ITEM = (
    "id string, url string, title string, address string, company_title string, transaction_type string, type string, price string, size_with_square_meter string, "
    "bedrooms string, levels array<string>, construction_year string, geo_is_address_hidden boolean, geo_lat double, geo_lng double, active_time_literal string, date string"
)


def profile_items(html: Column) -> Column:
    """Items of all ``data-ads-data`` attributes of a profile; those without URL or id are left out."""
    blocks = F.regexp_extract_all(html, F.lit('data-ads-data="([^"]*)"'), F.lit(1))
    items = F.flatten(F.transform(blocks, lambda b: F.coalesce(F.from_json(unescape(b), f"array<struct<{_colons(PROFILE_ITEM)}>>"), F.array())))
    return F.filter(items, lambda x: (F.coalesce(x["url"], F.lit("")) != "") & (F.coalesce(x["id"], F.lit("")) != ""))


def _colons(ddl: str) -> str:
    return ", ".join(": ".join(x.strip().split(" ", 1)) for x in ddl.split(", "))


def profile_rows(pages: DataFrame, now: str, domain: str = "xe.gr") -> DataFrame:
    """Items of landed profiles (``html``) as raw rows; a hidden address gives no point."""
    x = pages.select(F.explode(profile_items(F.col("html"))).alias("x")).select("x.*")
    shown = ~F.coalesce("geo_is_address_hidden", F.lit(False))
    return x.select(
        *raw_row(
            {
                "source_domain": F.lit(domain), "agency": F.trim("company_title"), "url": F.col("url"), "title": F.concat_ws(" · ", _none(F.col("title")), _none(F.col("address"))),
                "transaction": F.element_at(_literal({"SALE": "sale", "RENT": "rent"}), F.coalesce("transaction_type", F.lit(""))),
                "type": F.element_at(_literal(PROFILE_TYPES), F.coalesce("type", F.lit(""))), "price_eur": numbers.profile_money(F.col("price")),
                "area_m2": F.replace(F.regexp_extract("size_with_square_meter", r"(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double"), "bedrooms": _none(F.col("bedrooms")),
                "floor": F.get("levels", F.lit(0)), "year_built": _none(F.col("construction_year")), "location": _none(F.col("address")),
                "lat": F.when(shown, F.col("geo_lat")), "lon": F.when(shown, F.col("geo_lng")),
                "date_published": relative_day(F.coalesce(_none(F.col("active_time_literal")), F.col("date")), today_of(now), whole_hours=False),
                "date_source": F.lit("xe.gr agency page"), "scraped_at": F.lit(now), "checked_at": F.lit(now[:10]),
            }
        ),
        F.col("id").alias("portal_id"),
    ).dropDuplicates(["portal_id"])


# ---- JSON-LD listings of a network's pages ----

LD_LISTING = (
    "`@type`: string, name: string, offers: struct<price: string>, floorSize: struct<value: string>, numberOfBedrooms: string, datePosted: string, "
    "address: struct<addressLocality: string, addressRegion: string>, image: array<struct<url: string>>"
)


def ld_listing(html: Column) -> Column:
    """The first JSON-LD block of a page that describes a listing, else null."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?s)<script type="application/ld\+json">(.*?)</script>'), F.lit(1))
    read = F.transform(blocks, lambda b: F.from_json(b, f"struct<{LD_LISTING}>"))
    return F.get(F.filter(read, lambda x: x["@type"] == "RealEstateListing"), F.lit(0))


def ld_rows(pages: DataFrame, now: str, domain: str, name: str, regions: Sequence[str]) -> DataFrame:
    """Landed listing pages (``url``, ``lastmod``, ``html``) of a network as raw rows of the given regions."""
    x = pages.select("url", F.col("lastmod").alias("_mod"), ld_listing(F.col("html")).alias("d")).filter("d is not null")
    region = F.lower(F.coalesce("d.address.addressRegion", F.lit("")))
    inside = F.lit(False)
    for r in regions:
        inside = inside | region.contains(r)
    title = unescape(F.coalesce("d.name", F.lit("")))
    rent = F.concat(title, F.col("url")).rlike(r"(?i)\bfor rent\b|-for-rent-")
    return x.filter(inside).select(
        *raw_row(
            {
                "source_domain": F.lit(domain), "agency": F.lit(name), "url": F.col("url"), "title": title, "transaction": F.when(rent, F.lit("rent")).otherwise(F.lit("sale")),
                "price_eur": F.col("d.offers.price").try_cast("double"), "area_m2": F.col("d.floorSize.value").try_cast("double"), "bedrooms": F.col("d.numberOfBedrooms"),
                "location": _none(F.concat_ws(", ", _none(unescape(F.col("d.address.addressLocality"))), _none(unescape(F.col("d.address.addressRegion"))))),
                "image": F.get("d.image", F.lit(0))["url"], "date_published": F.try_to_date(F.substring("d.datePosted", 1, 10), "yyyy-MM-dd"), "date_sitemap": F.col("_mod").cast("date"),
                "date_source": F.lit("json-ld datePosted; sitemap lastmod"), "scraped_at": F.lit(now), "checked_at": F.lit(now[:10]),
            }
        )
    )


# ---- channel posts ----

# Words of deals, digests and done deals; how posts write prices and areas; types.
POST_SALE = r"(?iu)прода[её]тся|продажа|продам|for sale|\bsale\b|πωλ[ηεί]|πώλ|купить|стоимость объекта"
POST_RENT = r"(?iu)аренд|сда[её]тся|сдам|сдаю|for rent|\brent\b|ενοικ|в месяц|/мес|per month|monthly"
POST_DIGEST = r"(?iU)подборк|дайджест|топ-?\s?\d|\bтоп\b|новост|проект[аов]{0,2}\b.*проект|asked questions|инвестиционн\w+ проект"
POST_DONE = r"(?iU)сдан[аоы]?\b|продан[аоы]?\b|\bsold\b|\brented\b|πουλήθηκε|νοικιάστηκε"
POST_PRICE = r"(?iu)(?:€|eur|евро)\s*(\d{1,3}(?:[’'., ]\d{3})+|\d+)(?![\d’'.,])|(?<![\d’'.,])(\d{1,3}(?:[’'., ]\d{3})+|\d+)\s*(?:€|eur\b|евро)"
POST_AREA = r"(?iu)(\d{2,5}(?:[.,]\d+)?)\s*(?:м²|м2|кв\.?\s?м|m²|m2|sq\.?\s?m|sqm|τ\.?μ\.?)"
POST_TYPES = (
    ("studio", "студи"), ("maisonette", "мезонет|таунхаус|дуплекс"), ("apartment", "квартир|апартамент|пентхаус"), ("house", r"\bдом\b|дома\b|вилл|коттедж"),
    ("land", "участ|земл"), ("store", "магазин|коммерческ"), ("office", "офис"), ("hotel", "гостиниц|отел"),
)
MOST_POST_PRICES, LEAST_POST_PRICE, MOST_POST_RENT = 3, 100.0, 20_000


def post_text(body: Column) -> Column:
    """A post's text; line breaks stay."""
    return F.trim(unescape(F.regexp_replace(F.regexp_replace(body, r"<br\s*/?>", "\n"), r"<[^>]+>", "")))


def post_prices(text: Column) -> Column:
    each = F.zip_with(
        F.regexp_extract_all(text, F.lit(POST_PRICE), F.lit(1)), F.regexp_extract_all(text, F.lit(POST_PRICE), F.lit(2)), lambda a, b: numbers.post_number(F.coalesce(_none(a), _none(b)))
    )
    return F.filter(each, lambda p: p >= LEAST_POST_PRICE)


def post_is_listing(text: Column) -> Column:
    """A post that offers one object: price, area and a deal; its beginning no digest and nothing done."""
    low = F.lower(text)
    head, prices = F.substring(low, 1, 300), post_prices(text)
    one = (F.size(prices) > 0) & (F.size(F.array_distinct(prices)) <= MOST_POST_PRICES)
    return one & text.rlike(POST_AREA) & (low.rlike(POST_RENT) | low.rlike(POST_SALE)) & ~head.rlike(POST_DONE) & ~head.rlike(POST_DIGEST)


def post_rows(posts: DataFrame, now: str, places: Sequence[tuple[str, str]] = (), homes: Sequence[tuple[str, str]] = (), city: str = "", domain: str = "t.me") -> DataFrame:
    """Blocks of landed channel pages (``block``, ``channel``, ``focus``) that are listings, as raw rows.

    ``places`` (pattern, name) are the places that posts name, ``homes`` the channel's own region by its
    focus. A channel of another region than ``city`` puts its region first, so a place's name alone
    doesn't move an object here.
    """
    b = F.col("block")
    found = posts.select(
        "channel", F.lower(F.coalesce("focus", F.lit(""))).alias("focus"), group(b, 'data-post="([^"]+)"').alias("post"), group(b, '<time datetime="([^"]+)"').alias("at"),
        group(b, r'(?s)<div class="tgme_widget_message_text[^>]*>(.*?)</div>').alias("raw"),
    ).filter("post is not null and at is not null and raw is not null")
    found = once(once(found, {"text": post_text(F.col("raw"))}).filter(post_is_listing(F.col("text"))), {"low": F.lower("text")})
    low = F.col("low")
    named = F.array_compact(F.array(*[F.when(low.rlike(f"(?U){p}"), F.lit(n)) for p, n in places])) if places else F.array().cast("array<string>")
    home = first_match(F.col("focus"), [(n, p) for p, n in homes]) if homes else F.lit(None).cast("string")
    held = (
        F.when(home.isNotNull() & (home != city), F.array_distinct(F.concat(F.array(home), named)))
        .when(home.isNotNull() & (F.size(named) == 0), F.array(home))
        .otherwise(F.array_distinct(named))
    )
    found = once(found, {"places": F.array_join(held, ", "), "price": F.get(post_prices(F.col("text")), F.lit(0))})
    where = lambda p: F.length(F.regexp_extract(low, rf"(?s)^(.*?)(?:{p.removeprefix('(?iu)')})", 1))
    rent, sale = low.rlike(POST_RENT), low.rlike(POST_SALE)
    deal = F.when(rent & (~sale | (where(POST_RENT) < where(POST_SALE))), F.lit("rent")).otherwise(F.lit("sale"))
    deal = F.when((deal == "rent") & (F.col("price") > MOST_POST_RENT), F.lit("sale")).otherwise(deal)
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 8)
    headline = F.substring(F.regexp_replace(F.get(lines, F.lit(0)), "^[ 🇬🇷‼️🔥🌊🏡📍]+|[ 🇬🇷‼️🔥🌊🏡📍]+$", ""), 1, 120)
    beds = F.coalesce(*[group(low, r"(\d)\s*(?:спальн|bedroom|υπνοδωμ)|спальн\w*\s*[-–:]\s*(\d)", g) for g in (1, 2)])
    level = F.coalesce(*[group(low, r"(\d{1,2})\s*-?(?:й|ой|ий)?\s*(?:греческий\s*)?этаж|(\d{1,2})(?:st|nd|rd|th)\s*floor", g) for g in (1, 2)])
    point = r"[?&@/](?:q=|ll=)?(4\d\.\d{3,}),\s*(2\d\.\d{3,})"
    return found.select(
        *raw_row(
            {
                "source_domain": F.lit(domain), "agency": F.col("channel"), "url": F.concat(F.lit(f"https://{domain}/"), F.col("post")),
                "title": F.concat_ws(" · ", F.coalesce(headline, F.lit("")), _none(F.col("places"))), "transaction": deal, "type": first_match(low, POST_TYPES), "price_eur": F.col("price"),
                "area_m2": F.replace(F.regexp_extract("text", POST_AREA, 1), F.lit(","), F.lit(".")).try_cast("double"), "bedrooms": beds,
                "floor": F.when(low.rlike("цокол|ground floor|ισόγει"), F.lit("0")).otherwise(level), "location": _none(F.col("places")),
                "lat": group(F.col("raw"), point, 1).try_cast("double"), "lon": group(F.col("raw"), point, 2).try_cast("double"),
                "date_published": F.to_date(F.substring("at", 1, 10)), "date_source": F.lit("telegram post"), "scraped_at": F.lit(now),
            }
        )
    )


def next_before(html: Column) -> Column:
    """The lowest message number of a channel page: the next page to read ends before it."""
    return F.array_min(F.transform(F.regexp_extract_all(html, F.lit(r'data-post="[^"/]+/(\d+)"'), F.lit(1)), lambda x: x.cast("long")))


def within_window(rows: DataFrame, today: Column, days: int = 120) -> DataFrame:
    """Posts that are no older than the window."""
    return rows.filter(F.col("date_published") >= F.date_sub(today, days))


# ---- e-mail alerts ----

# Portals and their domains; links that are one listing; how alerts write things.
ALERT_DOMAINS = {"Spitogatos": "spitogatos.gr", "Spiti24": "spiti24.gr", "Tospitimou": "tospitimou.gr", "Plot": "plot.gr", "Indomio": "indomio.gr", "XE": "xe.gr"}
LISTING_URL = (
    r"(?i)spitogatos\.gr/aggelia/\d+|spiti24\.gr/akinito/\d+|tospitimou\.gr/akinito/\d+|xe\.gr/p/[0-9a-f-]{20,}|xe\.gr/property/d/|"
    r"indomio\.gr/aggelies/\d+|plot\.gr/\d{6,}"
)
ALERT_PRICE = r"€\s?(\d{1,3}(?:[.,]\d{3})+|\d+)(?![\d.,])|(?<![\d.,])(\d{1,3}(?:[.,]\d{3})+|\d+)\s?€"
ALERT_AREA = r"(\d{1,6}(?:[.,]\d+)?)\s*(?:τ\.?μ\.?|m²|m2)(?!\s*\))"
ALERT_NEWS = r"(?:Νέα αγγελία|Νέες αγγελίες|Νέα τιμή|Μείωση τιμής|περίμενες!)\s*:?\s*"
ALERT_END = r"Αγγελιο|Δες την αγγελία|Δείτε την αγγελία|Δες όλες|Απενεργοποίηση"
ALERT_TYPE = (
    "Διαμέρισμα|Studio|Γκαρσονιέρα|Μεζονέτα|Μονοκατοικία|Μονοκατοικια|Κατοικία|Οροφοδιαμέρισμα|Loft|Βίλα|Πολυκατοικία|Κτίριο|Γραφείο|"
    "Κατάστημα|Αποθήκη|Επαγγελματικός|Οικόπεδο|Αγροτεμάχιο|Γη|Parking|Θέση στάθμευσης|Ξενοδοχείο"
)
ALERT_FLOOR = "(ισόγειο|ημιυπόγειο|υπόγειο|ημιώροφος|υπερυψωμένο)"
LINK_MARK, CAPTURE = "⟦LINK⟧", "Browser capture"


def is_listing_url(url: Column) -> Column:
    return url.rlike(LISTING_URL)


def alert_text(context: Column) -> Column:
    """The words around a link: entities, tags (also cut-off ones) and style declarations go."""
    s = unescape(F.coalesce(context, F.lit("")))
    s = F.when(s.rlike(r'^[^<>]*?(;|")[^<>]*>'), F.regexp_replace(s, r"^[^<>]*?>", " ")).otherwise(s)
    s = F.regexp_replace(s, r'(?U)<[^>]*>|<[^>]*$|[\w-]+:\s*[\w#%.\s-]+;|colspan="\d+"', " ")
    return F.trim(F.regexp_replace(s, "[\\s﻿]+", " "))


def alert_price(text: Column) -> Column:
    return numbers.card_number(F.coalesce(*[_none(F.regexp_extract(text, ALERT_PRICE, g)) for g in (1, 2)]))


def alert_card(context: Column) -> Column:
    """struct<card, all>: the listing's own words, and all words around its link.

    New alerts mark the link: the card follows it if a price does, else it stands right before it, after
    the last news heading. Old ones hold header and card in one; the card follows the first heading.
    """
    before, after = alert_text(F.substring_index(context, LINK_MARK, 1)), alert_text(F.substring(context, F.instr(context, LINK_MARK) + len(LINK_MARK), F.length(context)))
    marked = context.contains(LINK_MARK)
    last = F.element_at(F.split(before, ALERT_NEWS, -1), -1)
    whole = alert_text(context)
    old = F.coalesce(group(whole, ALERT_NEWS + "(.*)"), whole)
    card = F.when(marked, F.when(F.substring(after, 1, 300).rlike(ALERT_PRICE), after).otherwise(last)).otherwise(old)
    return F.struct(card.alias("card"), F.when(marked, F.concat_ws(" ", before, after)).otherwise(whole).alias("all"))


def alert_rows(alerts: DataFrame, now: str) -> DataFrame:
    """Rows of the alert sheet (portal, received, subject, url, context) that link one listing, as raw rows."""
    a = alerts.filter(is_listing_url(F.col("url"))).select("portal", "received", "subject", "url", "context")
    a = once(a, {"c": alert_card(F.col("context"))}).select("portal", "received", "subject", "url", "c.*")
    agency = group(F.col("card"), r"(?U)Αγγελιοδότ\w*\s*:\s*([^\W\d_].*?)(?=\s+(?:Δες|Δείτε|Νέα|Νέες|Απενεργοποίηση)|$)")
    ended = F.regexp_replace(F.trim(F.get(F.split("card", ALERT_END, 2), F.lit(0))), r"(?U)\s+Α(γ(γ\w*)?)?$", "")
    a = once(a, {"_agency": agency, "_card": ended}).drop("card").withColumnRenamed("_card", "card")
    card, portal = F.col("card"), F.col("portal")
    capture, indomio = F.col("subject").startswith(CAPTURE), portal == "Indomio"
    words = F.lower(F.concat_ws(" ", card, "subject", "all"))
    deal = F.when(words.rlike("ενοικ|μίσθ"), F.lit("rent")).when(words.rlike("πώλη|πωλ"), F.lit("sale"))
    by_bar = F.regexp_replace(F.trim(F.element_at(F.split(card, r"\|", -1), -1)), r"^(\d{4}\s+|\d+\s*(μπ|υ/δ)\.?\s*)+", "")
    after_price = F.regexp_extract(card, rf"(?s)(?:{ALERT_PRICE})(.*)$", 3)
    until_type = F.regexp_extract(after_price, rf"^\s*(.*?)\s*(?={ALERT_TYPE})", 1)
    by_price = F.when(after_price.rlike(rf"^\s*(.*?)\s*(?={ALERT_TYPE})"), until_type).otherwise(F.substring(after_price, 1, 80))
    trimmed = F.regexp_replace(by_price, "^[ \\-·,]+|[ \\-·,]+$", "")
    loc = F.when(card.contains("|"), by_bar).when(card.rlike(ALERT_PRICE), trimmed)
    loc = F.when(indomio, F.coalesce(group(F.col("all"), r"τοποθεσία\s+(.+?)\s*:"), loc)).otherwise(loc)
    published = F.when(indomio, F.try_to_date(F.regexp_extract(card, r"Δημοσιεύθηκε:?\s*(\d{1,2}/\d{1,2}/\d{4})", 1), "d/M/yyyy"))
    short = F.when(indomio, F.get(F.split(card, "Δημοσιεύθηκε", 2), F.lit(0))).otherwise(card)
    a = a.withColumns({"_loc": F.when(capture, F.trim(F.substring(F.regexp_replace(short, ALERT_PRICE, " "), 1, 160))).otherwise(loc), "_published": published, "_price": alert_price(card), "_area": numbers.card_number(F.regexp_extract(card, ALERT_AREA, 1)), "_deal": deal, "card": short})
    captured = F.coalesce(group(card, r"(?iu)(\d{1,2})ος\s+όροφος"), F.lower(group(card, f"(?iu){ALERT_FLOOR}")))
    mailed = F.coalesce(group(card, r"τ\.μ\.\s*(\d{1,2})ος"), F.lower(group(card, ALERT_FLOOR)))
    title = F.concat(F.get(F.split(card, r" \| ", 2), F.lit(0)), F.when(card.contains("|"), F.concat(F.lit(" · "), F.coalesce("_loc", F.lit("")))).otherwise(F.lit("")))
    day = sheet_day(F.col("received"))
    return a.select(
        *raw_row(
            {
                "source_domain": F.coalesce(F.element_at(_literal(ALERT_DOMAINS), portal), F.lower(portal)), "agency": F.coalesce(F.substring(F.trim("_agency"), 1, 80), portal),
                "url": F.regexp_replace(F.trim("url"), r"[?&]utm_[^#]*$", ""), "title": F.substring(F.regexp_replace(title, r"^€\s?[\d.,]+\s*", ""), 1, 160), "transaction": F.col("_deal"),
                "price_eur": F.col("_price"), "area_m2": F.col("_area"), "bedrooms": group(card, r"(\d+)\s*υ/δ"), "floor": F.when(capture, captured).otherwise(mailed),
                "location": _none(F.col("_loc")), "date_published": F.col("_published"), "date_updated": day, "date_source": F.lit("portal alert"),
                "scraped_at": F.when(day.isNotNull(), F.concat(day.cast("string"), F.lit("T00:00:00Z"))).otherwise(F.lit(now)),
            }
        )
    )


def merged_alerts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Alerts of all runs, one row a URL: of repeats the newest text, the first day as publication, the last as update."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    columns = [c for c in old.columns if c not in ("url", "date_published", "date_updated")]
    latest = F.max_by(F.struct(*columns), F.struct("_new", "date_updated", *[c for c in columns if c in ("title", "price_eur")])).alias("x")
    own = F.max_by("date_published", F.struct("_new", "date_updated"))
    first = F.min(F.coalesce("date_published", "date_updated"))
    times = F.count(F.lit(1))
    rows = both.groupBy("url").agg(latest, F.when(times > 1, first).otherwise(own).alias("date_published"), F.max("date_updated").alias("date_updated"))
    return rows.select("url", "x.*", "date_published", "date_updated").select(*old.columns)


def resolve_redirect(url: Column) -> Column:
    """The target that a click tracker carries in its query, else the link itself."""
    target = group(url, r"(?i)[?&](?:url|u|redirect|target|link)=([^&]+)")
    return F.coalesce(F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), url)


# ---- browser captures and agency directories ----

# Fixed value: links that a capture takes for listings.
CAPTURE_LINK = r"""(?i)(spitogatos|spiti24|tospitimou|plot|car|indomio|xe)\.gr/(?:[^\s"<>]*?(aggelia|aggelies|property/d/|akinito|listing|ad/|/\d{6,})|\d{6,}-)"""
MOST_CARD_TEXT = 800


def captured_cards(links: DataFrame) -> DataFrame:
    """Of captured links (``url``, ``text`` of an element around it) the longest text per URL, where it names a price."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), r"(?i)([?&])utm_[^=&]*=[^&]*&?", "$1"), r"[?&]$", "")
    cut = F.substring(squeeze(F.col("text")), 1, MOST_CARD_TEXT)
    kept = links.filter(F.col("url").rlike(CAPTURE_LINK)).select(bare.alias("url"), cut.alias("text"))
    return kept.groupBy("url").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text")).filter(F.col("text").contains("€"))


_LD_AGENCY = (
    "name: string, url: string, address: struct<streetAddress: string, addressLocality: string, postalCode: string>, telephone: array<string>, email: string, "
    "location: struct<geo: struct<latitude: string, longitude: string>>"
)


def directory_entries(html: Column) -> Column:
    """array<struct> of a directory page's agencies: JSON-LD entries with the site of their header, then headers alone."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?s)<script type="application/ld\+json">(.*?)</script>'), F.lit(1))
    node = f"struct<`@type`: string, itemListElement: array<struct<item: struct<{_LD_AGENCY}>>>>"
    read = F.flatten(F.transform(blocks, lambda b: F.coalesce(F.from_json(b, f"struct<`@graph`: array<{node}>>")["@graph"], F.array(F.from_json(b, node)))))
    items = F.flatten(F.transform(F.filter(read, lambda n: n["@type"] == "ItemList"), lambda n: F.transform(n["itemListElement"], lambda e: e["item"])))

    def header(c: Column) -> Column:
        nav = r'(?s)class="nav-company" href="([^"]+)"[^>]*>(.*?)</a>'
        return F.struct(group(c, nav).alias("url"), strip_tags(F.regexp_extract(c, nav, 2)).alias("name"), group(c, r"""<a\s[^>]*urlClickLoggingClass[^>]*?href=["'](http[^"']+)""").alias("site"))

    headers = F.filter(F.transform(_from(F.split(html, '<div[^>]*class="(?:Free|Adv)NameHeader"', -1)), header), lambda h: h["url"].isNotNull())

    def entry(i: Column) -> Column:
        site = F.get(F.filter(headers, lambda h: h["url"] == i["url"]), F.lit(0))["site"]
        return F.struct(
            F.trim(i["name"]).alias("name"), site.alias("website"), i["address"]["streetAddress"].alias("street"), i["address"]["addressLocality"].alias("locality"),
            i["address"]["postalCode"].alias("postal_code"), F.array_join(i["telephone"], ";").alias("phones"), i["email"].alias("email"),
            i["location"]["geo"]["latitude"].alias("lat"), i["location"]["geo"]["longitude"].alias("lon"), i["url"].alias("directory_url"),
        )

    none = F.lit(None).cast("string")
    alone = F.filter(headers, lambda h: ~F.exists(items, lambda i: F.coalesce(i["url"] == h["url"], F.lit(False))))
    bare = F.transform(alone, lambda h: F.struct(h["name"].alias("name"), h["site"].alias("website"), *[none.alias(n) for n in ("street", "locality", "postal_code", "phones", "email", "lat", "lon")], h["url"].alias("directory_url")))
    return F.concat(F.transform(items, entry), bare)


def directory_rows(pages: DataFrame) -> DataFrame:
    """Agencies of landed directory pages (``area``, ``page``, ``html``), the first of each directory URL."""
    rows = pages.select("area", "page", F.posexplode(directory_entries(F.col("html"))).alias("at", "e")).select("area", "page", "at", "e.*")
    names = [c for c in rows.columns if c not in ("directory_url", "page", "at")]
    return rows.groupBy("directory_url").agg(F.min_by(F.struct(*names), F.struct("area", "page", "at")).alias("x")).select("directory_url", "x.*")


def agency_profiles(pages: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Agencies of landed profile pages (``url``, ``html``) whose postal code begins with one of the prefixes."""
    html = F.col("html")
    address = F.trim(unescape(F.regexp_extract(html, r"Διεύθυνση:\s*</[^>]+>\s*(?:<[^>]+>\s*)*([^<]+)", 1)))
    code = F.concat(F.regexp_extract(address, r"\b(\d{3})\s?(\d{2})\b", 1), F.regexp_extract(address, r"\b(\d{3})\s?(\d{2})\b", 2))
    rows = pages.select(F.trim(unescape(F.regexp_extract(html, r"<title>([^<|]+)", 1))).alias("name"), address.alias("address"), code.alias("postal_code"), F.col("url").alias("xe_url"))
    keep = F.lit(False)
    for p in prefixes:
        keep = keep | F.col("postal_code").startswith(p)
    return rows.filter(keep)
