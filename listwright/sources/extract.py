"""Fields out of landed pages: JSON-LD, meta elements, labels and text, by native regular expressions.

What a page says in structured data comes first, then its meta elements, then its text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright.config import City
from listwright.functions.dates import page_days
from listwright.functions.geo import in_box, script_point
from listwright.functions.numbers import locale_number, page_number
from listwright.functions.text import cells, fold, meta, page_text, place_under_heading, squeeze, strip_tags, unescape, without_boilerplate
from listwright.operators.normalize import is_other
from listwright.operators.rules import all_matches, first_match
from listwright.sources.shared import once

# How pages label size, rooms, floor, year, deal and place; how URLs and titles name types.
PAGE_PRICE = r"(?i)(?:€|EUR)\s?(\d{1,3}(?:[.,]\d{3})+|\d+)(?![\d.,])|(\d{1,3}(?:[.,]\d{3})+|\d+)\s?(?:€|EUR|ευρώ)"
PAGE_AREA = r"(?i)(\d{1,5}(?:[.,]\d{1,2})?)\s*(?:τ\.?\s?μ\.?|m²|m2|sq\.?\s?m)"
PAGE_BEDROOMS = r"(?iU)(?:υπνοδωμάτι\w*|bedrooms?)\s*:?\s*(\d{1,2})|(\d{1,2})\s*(?:υ/δ|υπνοδωμάτι|bedrooms?)"
PAGE_FLOOR = r"(?iu)(?:όροφος|floor)\s*:?\s*(-?\d{1,2}|ισόγειο|υπόγειο|ημιυπόγειο|ground)|(\d{1,2})(?:ος|ο)\s*όροφ"
PAGE_YEAR = r"(?iu)(?:έτος κατασκευής|κατασκευή|year built|built)\s*:?\s*((?:19|20)\d{2})"
PAGE_TYPES = (
    ("apartment", "διαμέρισμα|apartment|flat"), ("studio", "γκαρσονιέρα|studio|στούντιο"), ("maisonette", "μεζονέτα|maisonette"),
    ("house", "μονοκατοικία|detached house|villa|βίλα|κατοικία"), ("land", "οικόπεδο|αγροτεμάχιο|plot|land"), ("store", "κατάστημα|store|shop"), ("office", "γραφείο|office"),
    ("parking", "θέση στάθμευσης|parking|γκαράζ"), ("building", "κτίριο|building"),
)
PAGE_RENT, PAGE_SALE = r"ενοικ|μίσθ|enoik|for[-_ ]rent|to[-_ ]rent|\brent\b", r"πώλη|πωλ|pwlis|polisi|poleitai|for[-_ ]sale|\bsale\b"
DEAL_CELL = r"(?iu)\|\s*(ΠΡΟΣ ΠΩΛΗΣΗ|ΠΡΟΣ ΕΝΟΙΚΙΑΣΗ|ΠΩΛΕΙΤΑΙ|ΕΝΟΙΚΙΑΖΕΤΑΙ|Προς πώληση|Προς ενοικίαση|For sale|For rent)\s*\|"
PLACE_CELL = r"(?iu)\|\s*(?:Περιοχή|Τοποθεσία|Location|Region|Νομός)\s*:?\s*(?:\|\s*)+([^|:€\d][^|:€]{2,60}?)\s*\|"
SOLD = r"(?iu)πωλήθηκε|πουλήθηκε|ενοικιάστηκε|νοικιάστηκε|μη διαθέσιμ|δεν είναι (πλέον )?διαθέσιμ|\bsold\b|\brented\b|no longer available|not available"
LEAST_PRICE, HEAD = 50.0, 6000
# URLs that aren't one listing, and marks of those that are.
SKIP_URL = (
    r"(?i)\.(jpg|jpeg|png|webp|gif|svg|pdf|css|js|ico|xml|zip)(\?|$)|"
    r"/(wp-content|wp-json|feed|tag|category|author|blog|news|contact|epikoinonia|about|profil|login|register|cart|privacy|terms|cookies?)\b|mailto:|tel:|javascript:|#"
)
DETAIL_QUERY = r"(?i)(?:^|&)(?:dios_code|code|id|pid|property_id|propertyid|listing_id|aid|ref|kodikos)=\d{3,}"
DETAIL_PAGE = r"(?i)detail|listing|property|estate|akinit|aggeli|ad\.php|view"
LISTING_HINT = (
    r"(?iu)/(property|properties|akinito|akinita|aggelia|aggelies|listing|listings|estate|ad|results?|pwlisi|polisi|poleitai|enoikiasi|sale|rent|"
    r"for-sale|for-rent|diamerisma|katoikia|monokatoikia|mezoneta|oikopedo|ακίνητ|πώληση|ενοικίαση)[/-]?"
)


def _none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _group(c: Column, pattern: str, n: int = 1) -> Column:
    return _none(F.regexp_extract(c, pattern, n))


def _either(c: Column, pattern: str) -> Column:
    return F.coalesce(_group(c, pattern, 1), _group(c, pattern, 2))


def price_in(text: Column) -> Column:
    """The leftmost amount beside a euro sign, on either side of it."""
    amount = r"([0-9][0-9.,]*[0-9]|[0-9])"
    pattern = rf"{amount}\s*(?:€|EUR|euro)|€\s*{amount}"
    return locale_number(_either(text, pattern))


def area_in(text: Column) -> Column:
    return locale_number(_group(text, r"([0-9][0-9.,]*)\s*(?:τ\.?μ\.?|m²|m2|sqm|sq\.? ?m)"))


def json_ld(html: Column) -> Column:
    """All JSON-LD blocks of a page, as variants; malformed ones are null."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"""), F.lit(1))
    return F.transform(blocks, lambda b: F.try_parse_json(unescape(b)))


_LD = ("price", "area", "bedrooms", "lat", "lon", "location")


def _ld_objects(block: str) -> Iterator[dict]:
    """All objects of a JSON text, the outermost and last first."""
    stack = [json.loads(block)]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            yield x
        stack += [v for v in (x.values() if isinstance(x, dict) else x) if isinstance(v, dict | list)] if isinstance(x, dict | list) else []


def _said(value: object) -> str | None:
    return None if value in (None, "", 0, False) or isinstance(value, dict | list) else str(value)


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in _LD]))
def ld_fields(blocks: pd.Series) -> pd.DataFrame:
    """What a page's JSON-LD says, at any depth, of price, size, rooms, point and place.

    A depth without bound is the one thing here that built-in expressions can't walk; blocks come in
    Arrow batches, and pages without a block cost nothing.
    """
    out = []
    for texts in blocks:
        got: dict[str, str | None] = dict.fromkeys(_LD)
        for text in texts if texts is not None else ():
            try:
                objects = list(_ld_objects(text))
            except (ValueError, RecursionError):
                continue
            for x in objects:
                offers = x.get("offers")
                offers = offers[0] if isinstance(offers, list) and offers else offers
                size, geo, address = x.get("floorSize"), x.get("geo"), x.get("address")
                rooms = next((x[k] for k in ("numberOfBedrooms", "numberOfRooms") if x.get(k)), None)
                place = ", ".join(str(address[k]) for k in ("addressLocality", "addressRegion") if address.get(k)) if isinstance(address, dict) else None
                found = {
                    "price": _said(offers.get("price")) if isinstance(offers, dict) else None,
                    "area": _said(size.get("value")) if isinstance(size, dict) else None,
                    "bedrooms": _said(rooms.get("value") if isinstance(rooms, dict) else rooms),
                    "lat": _said(geo.get("latitude")) if isinstance(geo, dict) else None,
                    "lon": _said(geo.get("longitude")) if isinstance(geo, dict) and geo.get("latitude") else None,
                    "location": place or None,
                }
                got = {k: got[k] if got[k] is not None else v for k, v in found.items()}
        out.append(got)
    return pd.DataFrame(out, columns=list(_LD), dtype=object)


def page_fields(html: Column) -> Column:
    """Title, description, first price and area of a page; meta elements first, then its text."""
    text = page_text(html)
    title = F.coalesce(meta(html, "og:title"), _none(strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))))
    return F.struct(
        title.alias("title"),
        F.coalesce(meta(html, "og:description"), meta(html, "description")).alias("description"),
        price_in(text).alias("price_eur"),
        area_in(text).alias("area_m2"),
    )


def page_listings(pages: DataFrame, today: Column) -> DataFrame:
    """Landed pages (``url``, ``html``) with the listing that each describes; other columns stay.

    Each field is the first that structured data, meta elements or the text's beginning gives.
    """
    html, url = F.col("html"), F.col("url")
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    p = once(pages, {"_text": page_text(html), "_cells": cells(html)}).withColumns({"_ld": ld_fields(F.transform(blocks, lambda b: F.trim(unescape(b))))})
    p = once(p, {"title": F.substring(F.coalesce(meta(html, "og:title"), F.trim(unescape(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]*)", 1)))), 1, 200)})
    p = once(p, {"_head": F.concat_ws(" ", "title", F.substring("_text", 1, HEAD)), "_days": page_days(html, F.col("_text"), today), "_point": script_point(html)})
    head = F.col("_head")
    stated = page_number(_either(head, PAGE_PRICE))
    price = F.coalesce(F.nullif(page_number(F.col("_ld.price")), F.lit(0.0)), F.when(stated >= LEAST_PRICE, stated))
    low = F.lower(F.concat_ws(" ", "title", url))
    said = _group(F.col("_cells"), DEAL_CELL)
    deal = F.when(said.rlike("(?iu)ενοικ|rent"), F.lit("rent")).when(said.isNotNull(), F.lit("sale")).when(low.rlike(PAGE_RENT), F.lit("rent")).when(low.rlike(PAGE_SALE), F.lit("sale"))
    point = F.col("_point")
    lat = F.coalesce(F.col("_ld.lat").try_cast("double"), meta(html, "place:location:latitude").try_cast("double"))
    lon = F.coalesce(F.col("_ld.lon").try_cast("double"), meta(html, "place:location:longitude").try_cast("double"))
    parts = F.array_compact(F.array(_none(F.col("_ld.location")), F.trim(_group(F.col("_cells"), PLACE_CELL)), place_under_heading(html, F.col("title"))))
    p = p.withColumns(
        {
            "price_eur": price, "area_m2": F.coalesce(F.nullif(page_number(F.col("_ld.area")), F.lit(0.0)), page_number(_group(head, PAGE_AREA))),
            "bedrooms": F.coalesce(_none(F.col("_ld.bedrooms")), _either(head, PAGE_BEDROOMS)), "floor": F.lower(_either(head, PAGE_FLOOR)), "year_built": _group(head, PAGE_YEAR),
            "type": F.coalesce(first_match(F.lower("title"), PAGE_TYPES), first_match(F.lower(url), PAGE_TYPES)), "transaction": deal, "location": _none(F.array_join(F.array_distinct(parts), " | ")),
            "lat": F.when(lat.isNotNull(), lat).otherwise(point["lat"]), "lon": F.when(lat.isNotNull(), lon).otherwise(point["lon"]), "image": meta(html, "og:image"),
        }
    )
    return p.select("*", F.col("_days.published").alias("date_published"), F.col("_days.updated").alias("date_updated"), F.col("_days.source").alias("date_source")).drop("_text", "_cells", "_ld", "_head", "_point", "_days")


def is_sold(title: Column) -> Column:
    return F.coalesce(title.rlike(SOLD), F.lit(False))


def looks_like_detail(url: Column) -> Column:
    """Whether a URL is one listing's page: an id in its query or path, and no section, article or file."""
    path, query = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"\?([^#]*)", 1)
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    by_query = query.rlike(DETAIL_QUERY) & path.rlike(DETAIL_PAGE)
    by_path = path.rlike(r"\d{3,}") & (path.rlike(LISTING_HINT) | (slashes <= 2))
    return ~url.rlike(SKIP_URL) & (F.length(path) >= 2) & ~path.rlike("(?i)blog|news|article|service") & (by_query | by_path)


def attribute_json(html: Column, attribute: str, schema: str) -> Column:
    """JSON that an attribute holds, entities unescaped."""
    return F.from_json(unescape(F.regexp_extract(html, rf"""{attribute}="([^"]*)\"""", 1)), schema)


def cards(html: Column, opening: str, fields: dict[str, str]) -> Column:
    """array<struct>: a page split at each card's opening, and a pattern's first group per field."""
    parts = F.split(html, opening, -1)
    body = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(body, lambda c: F.struct(*[_none(strip_tags(F.regexp_extract(c, p, 1))).alias(n) for n, p in fields.items()]))


# ---- the district of a page ----

# Labels before a place, and what begins a page's list of other listings.
PLACE_LABEL = r"(?iu)(?:Περιοχή|Τοποθεσία|Διεύθυνση|Location|Area|Address|Region|Neighbou?rhood)\s*:?\s*</?[^>]*>?\s*([^<\n]{3,80})"
OTHERS = r"(?iu)παρόμοια|παρομοια|σχετικά ακίνητα|σχετικα ακινητα|similar|related|you may also|δείτε επίσης|δειτε επισησ"
READ, SHOWN = 12_000, 2_500


def district_hints(pages: DataFrame, city: City, today: Column) -> DataFrame:
    """(url, region, area, neighbourhood, how) of landed pages, from the first of these that tells a place:

    the place line, the page's point, the address, the breadcrumb, the labels, the text from its heading
    on. A text names a district only when it names exactly one; nulls where nothing tells.
    """
    html = F.col("html")
    p = page_listings(pages.select("url", "html"), today)
    ld = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"), F.lit(1)), "\n")
    every = lambda c, pattern: F.array_join(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), " ")
    crumb_names = F.when(ld.contains("BreadcrumbList"), every(ld, r'"name"\s*:\s*"([^"]{2,80})"')).otherwise(F.lit(""))
    address = F.concat_ws(" ", *[every(ld, rf'"{k}"\s*:\s*"([^"]{{2,120}})"') for k in ("addressLocality", "streetAddress", "addressRegion")], crumb_names)
    crumbs = strip_tags(every(html, r"(?is)<(?:ol|ul|nav|div)[^>]*breadcrumb[^>]*>(.*?)</(?:ol|ul|nav|div)>"))
    body = without_boilerplate(html)
    start = F.greatest(F.instr(F.lower(body), "<h1"), F.lit(1))
    text = squeeze(F.regexp_replace(F.substring(body, start, F.lit(READ)), r"<[^>]+>", " "))
    text = F.substring(F.get(F.split(text, OTHERS, 2), F.lit(0)), 1, SHOWN)
    sources = {"address": address, "breadcrumb": crumbs, "label": every(html, PLACE_LABEL), "text": text}
    p = p.withColumns({f"_{how}": fold(c) for how, c in sources.items()} | {"_place": fold(F.coalesce("location", F.lit("")))})

    only = lambda xs: F.when(F.size(xs) == 1, F.get(xs, F.lit(0)))
    named = [(a.id, a.pattern) for a in city.map_areas if a.pattern]
    no = F.lit(None).cast("string")
    answer = lambda region, area, nb, how: F.struct(F.lit(region).alias("region"), area.alias("area"), nb.alias("neighbourhood"), F.lit(how).alias("how"))

    def parent_of(nb: Column) -> Column:
        out = no
        for a in city.map_areas:
            out = F.when(nb == a.id, F.lit(a.district)).otherwise(out)
        return out

    def by(how: str) -> Column:
        src = F.col(f"_{how}")
        area, nb = only(all_matches(src, city.specific)), only(all_matches(src, named)) if named else no
        parent = parent_of(nb)
        held = F.when(nb.isNotNull() & (area.isNull() | (area == parent)), nb)
        district = F.when(held.isNotNull(), parent).otherwise(area)
        away = is_other(src, city) & district.isNull()
        nothing = F.lit(None).cast("struct<region:string,area:string,neighbourhood:string,how:string>")
        return F.when(away, answer("other", no, no, how) if how != "text" else nothing).when(district.isNotNull(), answer(city.key, district, held, how))

    place = F.col("_place")
    stages = [
        F.when(is_other(place, city) & (F.size(all_matches(place, city.specific)) == 0), answer("other", no, no, "place")),
        F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~in_box(F.col("lat"), F.col("lon"), city.box, city.box_exclude), answer("other", no, no, "map point")),
        *[by(how) for how in sources],
    ]
    return p.select("url", F.coalesce(*stages).alias("x")).select("url", "x.*")
