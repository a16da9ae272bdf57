"""Landed files, page fields, and streams against their batch twins."""

import datetime as dt
import json

from listwright.config import City, MapArea, read_city
from listwright.operators import spatial
from listwright.sources import extract, feeds, landed
from listwright.streaming import jobs
from pyspark.sql import functions as F


def test_csv_union_keeps_order_and_missing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('url,title\nu1,"x ""q""\ny"\nu2,\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("url,price\nu3,5\n", encoding="utf-8")
    df = landed.read_existing_csv(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/none.csv", f"{tmp_path}/b.csv"])
    got = {r.url: (r.title, r.price, r.source_priority) for r in df.collect()}
    assert got == {"u1": ('x "q"\ny', None, 0), "u2": (None, None, 0), "u3": (None, "5", 1)}


def test_sitemap_and_index(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc> http://a/1 </loc><lastmod>2026-01-02T03:04</lastmod></url><url><loc>http://a/2</loc></url></urlset>")
    assert sorted((r.loc, str(r.lastmod)) for r in landed.read_sitemap(spark, str(tmp_path / "s.xml")).collect()) == [("http://a/1", "2026-01-02"), ("http://a/2", "None")]
    index = spark.createDataFrame([("s", f"http://s/property-{i}.xml") for i in range(5)] + [("s", "http://s/news.xml")], "site string, loc string")
    assert landed.property_sitemaps(index).count() == 3


def test_filters_and_areas(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"filters": [{"name": "a", "types": ["x"], "price_max": 5}, {"name": "b", "enabled": False, "region": ""}]}, indent=1))
    got = {r.name: (r.enabled, r.types, r.price_max, r.region) for r in landed.read_filters(spark, str(tmp_path / "f.json")).collect()}
    assert got == {"a": (True, ["x"], 5.0, None), "b": (False, None, None, "")}
    doc = {"features": [{"properties": {"id": "z"}, "geometry": {"type": "Polygon", "coordinates": [[[23.0, 40.0], [24.0, 40.0], [24.0, 41.0]]]}}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    row = landed.read_areas(spark, str(tmp_path / "g.json")).first()
    assert (row.id, row.official, row.polygons[0][0][1].lon, row.split) == ("z", False, 24.0, None)
    square = lambda x, y: [[[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1]]]
    doc = {"features": [{"properties": {"id": "m", "official": True}, "geometry": {"type": "MultiPolygon", "coordinates": [square(23, 40), square(25, 40)]}}, {"properties": {"split": ["p", "q"]}, "geometry": {"type": "Polygon", "coordinates": square(27, 40)}}], "areas_without_polygon": [{"id": "p", "gr": "P", "district": "D", "centre": [40.1, 27.1]}, {"id": "q", "centre": [40.9, 27.9]}]}
    (tmp_path / "h.json").write_text(json.dumps(doc))
    areas = landed.read_areas(spark, str(tmp_path / "h.json"))
    points = spark.createDataFrame([(1, 40.5, 23.5), (2, 40.5, 25.5), (3, 40.5, 24.5), (4, 40.2, 27.2), (5, 40.8, 27.8)], "k int, lat double, lon double")
    assert {r.k: r.area_id for r in spatial.containing_area(points, areas, "k").collect()} == {1: "m", 2: "m", 4: "p", 5: "q"}
    assert [(r.id, r.district, r.lat) for r in landed.read_places(spark, str(tmp_path / "h.json")).collect()] == [("p", "D", 40.1), ("q", None, 40.9)]


def test_city_document(tmp_path):
    (tmp_path / "city.json").write_text(json.dumps({"key": "k", "areas": [["A", "a"], ["G", "g"]], "generic": "G", "box": [1, 2, 3, 4], "centres": {"A": [1, 2]}, "xe_postal_prefixes": ["54"], "unknown": 1}))
    (tmp_path / "areas.json").write_text(json.dumps({"features": [{"properties": {"id": "x", "district": "A", "centre": [1.0, 2.0], "sale": 9}}, {"properties": {"split": ["y"]}}], "areas_without_polygon": [{"id": "y", "district": "A", "pattern": "yy"}]}))
    city = read_city(str(tmp_path / "city.json"), str(tmp_path / "areas.json"))
    assert (city.key, city.specific, city.box, city.postal_prefixes, city.zone) == ("k", (("A", "a"),), (1, 2, 3, 4), ("54",), "Europe/Athens")
    assert [(a.id, a.sale, a.pattern) for a in city.map_areas] == [("x", 9, ""), ("y", None, "yy")]


def test_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "source_domain string, k int"
    landed.replace_sources(spark, spark.createDataFrame([("a", 1), ("b", 2)], schema), path)
    landed.replace_sources(spark, spark.createDataFrame([("a", 9)], schema), path)
    assert sorted((r.source_domain, r.k) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]


MARKET = feeds.Market("market.example", "Market", "https://market.example")
NOW = "2026-03-04T05:06:07Z"


def market(**kw):
    base = {"id": "77", "acquired": False, "status": "public", "coordinates": [40.7, 22.8], "price": 98000, "size": 64, "type": "maisonette", "created_at": 1767225600, "updated_at": 1769904000,
            "auction_date": 1798754400, "auction_round": 2, "title": [{"locale": "en", "value": "E"}, {"locale": "el", "value": "G"}], "images": [{"sizes": {"md": "https://i/m.jpg"}}]}
    return json.dumps(base | kw)


def test_market_items(spark):
    items = [("auction", market()), ("bank", market(id="2", type="field")), ("auction", market(id="3", price_upon_request=True, auction_date_to_be_announced=True)), ("auction", market(id="4", acquired=True)),
             ("auction", market(id="5", coordinates=[30.0, 22.9])), ("auction", market(id="6", coordinates=None)), ("bank", market(id="7", status="hidden"))]
    got = {r.url.rsplit("/", 1)[1]: r for r in feeds.market_rows(spark.createDataFrame(items, "segment string, item string"), MARKET, (40.0, 41.0, 22.0, 24.0), NOW).collect()}
    assert set(got) == {"77", "2", "3"}
    r = got["77"]
    assert (r.url, r.title, r.type, r.price_eur, r.area_m2, r.image, str(r.date_published), r.checked_at) == ("https://market.example/listings/77", "G", "maisonette", 98000.0, 64.0, "https://i/m.jpg", "2026-01-01", "2026-03-04")
    assert (r.segment, str(r.auction_date), r.auction_round) == ("auction", "2027-01-01", "2")
    assert (got["2"].segment, got["2"].type, got["2"].auction_date, got["2"].auction_round) == ("bank", "land", None, None)
    assert (got["3"].price_eur, got["3"].auction_date, got["3"].auction_round) == (None, None, "2")
    assert "40.50000%2C+23.00000" in feeds.search_query("sale", (40.0, 40.5, 22.0, 23.0), 3) and "page=3" in feeds.search_query("sale", (40.0, 40.5, 22.0, 23.0), 3)
    pages = spark.createDataFrame([("s", 1, [0] * 100), ("s", 2, [0] * 4), ("s", 3, [0] * 100)], "seg string, page int, items array<int>")
    assert sorted(r.page for r in feeds.wanted_pages(pages, ["seg"]).collect()) == [1, 2]


BANK = """<div class="listing-style1" data-property-id="31"><img src="https://cdn/31.jpg"><div class="list-price"> <span>64.500 €</span></div><h6 class="list-title x"> <span>Κάτω Χωριό,</span> <span>&nbsp;</span></h6>
<p class=""> Μεζονέτα
 <span>88 m<sup>2</sup></span></p><i class="icon fa-bed-front c"></i> <span class="z">3</span></div>"""
AUCTION = """<div class="listing-style1" data-property-id="32"><h6 class="list-title y"><span>Άνω Χωριό</span><br> Οικόπεδο <span class="l">&nbsp;|&nbsp;</span><span>Κυριότητα</span> <span>(33,5%)</span></h6>
<div> 120,5 <span>m<sup>2</sup></span></div><div class="list-price"><span> 9.100 € </span></div><span title="Ημερομηνία Δημοπρασίας"><i></i> 03-02-2027 </span> 2ος γύρος</div>"""


def test_platform_cards(spark):
    sites = {s: feeds.CardSite(f"{s}.example", s, f"https://{s}.example/el", p, s) for s, p in (("bank", "properties"), ("auction", "auctions"))}
    points = spark.createDataFrame([(31, 40.5, 22.9), (32, 40.6, 22.9)], "id long, latitude double, longitude double")
    page = lambda h: spark.createDataFrame([(h,)], "html string")
    box = (40.0, 41.0, 22.0, 24.0)
    r = feeds.platform_rows(page("<p>" + BANK + '<div class="listing-style1">no id'), points, sites["bank"], box, NOW).collect()
    assert [(x.url, x.title, x.type, x.price_eur, x.area_m2, x.bedrooms, x.location, x.auction_date) for x in r] == [("https://bank.example/el/properties/31", "Μεζονέτα, 88 τ.μ., Κάτω Χωριό", "maisonette", 64500.0, 88.0, "3", "Κάτω Χωριό", None)]
    r = feeds.platform_rows(page(AUCTION), points, sites["auction"], box, NOW).first()
    assert (r.title, r.type, r.price_eur, r.area_m2, str(r.auction_date), r.auction_round, r.lat) == ("Οικόπεδο, 120.5 τ.μ., Άνω Χωριό (μερίδιο 33.5%)", "land", 9100.0, 120.5, "2027-02-03", "2", 40.6)
    assert feeds.platform_rows(page(BANK), points.limit(0), sites["bank"], box, NOW).count() == 0
    assert feeds.platform_rows(page(BANK), points, sites["bank"], (10.0, 11.0, 22.0, 24.0), NOW).count() == 0


def test_network_and_portal_cards(spark):
    card = '<div class="property-miniature"><a href="/property/55-flat-x"></a><img src="/assets/media/properties/5&amp;5.jpg"><div class="price">1.250 €</div><h4 class="title">Toumba</h4><div class="path">City</div><div class="category">Flat</div><div class="feature rooms"><span class="label">2 rooms</span></div><div class="feature sqrMeters"><span class="label">62,5 m 2</span></div><div class="office-name">Office <b>X</b></div>'
    df = spark.createDataFrame([(card + '<div class="property-miniature">no link' + '<a href="/rent/7-x?Property_page=12">',)], "html string")
    cards = df.select(F.explode(feeds.network_cards(F.col("html"), F.lit("rent"), "https://n.example", "n.example", "Network", NOW)).alias("c"), feeds.last_page(F.col("html"), "rent", "7").alias("n")).collect()
    c = cards[0].c
    assert len(cards) == 1 and cards[0].n == 12
    assert (c.url, c.title, c.price_eur, c.area_m2, c.bedrooms, c.agency, c.location, c.image, c.network_id) == ("https://n.example/property/55-flat-x", "Flat · Toumba · City", 1250.0, 62.5, "2", "Office X", "Toumba, City", "https://n.example/assets/media/properties/5&5.jpg", "55")
    uid = "0a1b2c3d-0000-0000-0000-000000000001"
    page = f'<div data-testid="property-ad-image-container"></div><div id="common_ad_body_{uid}"><a href="https://www.xe.gr/property/d/x/{uid}?a"></a><h3 data-testid="property_ad_title">Flat 45,5 τ.μ.</h3><span data-testid="property_ad_price">85.000 €</span><span data-testid="property_ad_address">Toumba</span><div data-testid="property_ad_icon_levels_new">3ος</div><div class="common_ad_body_footer"><span> Πριν 2 ημέρες </span></div></div><div data-testid="property-ad-actions">99 €</div>'
    p = spark.createDataFrame([(page,)], "html string").select(F.explode(feeds.portal_cards(F.col("html"), F.lit("/enoikiaseis"), NOW)).alias("c")).first().c
    assert (p.portal_id, p.transaction, p.price_eur, p.area_m2, p.title, p.floor, str(p.date_updated), p.agency) == (uid, "rent", 85000.0, 45.5, "Flat 45,5 τ.μ. · Toumba", "3ος", "2026-03-02", "Ιδιώτης (XE.gr)")


def test_profiles_and_structured_pages(spark):
    items = [{"id": "1", "url": "u1", "title": "T", "address": "A", "transaction_type": "RENT", "type": "PARCEL", "price": "1.200 €", "size_with_square_meter": "70,5 τ.μ.", "levels": ["2"], "geo_is_address_hidden": True, "geo_lat": 40.0, "geo_lng": 22.0, "active_time_literal": "πριν από 3 ημέρες"}, {"id": "2"}]
    page = '<div data-ads-data="' + json.dumps(items).replace('"', "&quot;") + '"></div><i data-ads-data="broken"></i>'
    got = feeds.profile_rows(spark.createDataFrame([(page,)], "html string"), NOW).collect()
    assert [(r.url, r.title, r.transaction, r.type, r.price_eur, r.area_m2, r.floor, r.lat, str(r.date_published)) for r in got] == [("u1", "T · A", "rent", "land", 1200.0, 70.5, "2", None, "2026-03-01")]
    ld = '<script type="application/ld+json">{"@type": "Thing"}</script><script type="application/ld+json">{"@type": "RealEstateListing", "name": "Villa &amp; pool", "offers": {"price": 5000}, "floorSize": {"value": 90}, "datePosted": "2026-01-05T00:00", "address": {"addressLocality": "L", "addressRegion": "Halkidiki"}, "image": [{"url": "i.jpg"}]}</script>'
    pages = spark.createDataFrame([("https://n/villa-for-rent-1", "2026-02-01", ld), ("https://n/2", None, ld.replace("Halkidiki", "Attica"))], "url string, lastmod string, html string")
    got = feeds.ld_rows(pages, NOW, "n.example", "N", ["halkidiki"]).collect()
    assert [(r.title, r.transaction, r.price_eur, r.area_m2, r.location, r.image, str(r.date_published), str(r.date_sitemap)) for r in got] == [("Villa & pool", "rent", 5000.0, 90.0, "L, Halkidiki", "i.jpg", "2026-01-05", "2026-02-01")]


def test_directories_and_captures(spark):
    page = '<script type="application/ld+json">{"@graph": [{"@type": "ItemList", "itemListElement": [{"item": {"name": " Alpha ", "url": "d/1", "address": {"streetAddress": "S 1", "postalCode": "54622"}, "telephone": ["1", "2"]}}]}]}</script><div class="FreeNameHeader"><a class="nav-company" href="d/1">Alpha</a><a x urlClickLoggingClass href="http://alpha.example"></a></div><div class="AdvNameHeader"><a class="nav-company" href="d/2"><b>Beta</b></a></div>'
    df = spark.createDataFrame([("a", 1, page), ("b", 1, page)], "area string, page int, html string")
    got = {r.directory_url: (r.name, r.website, r.postal_code, r.phones, r.area) for r in feeds.directory_rows(df).collect()}
    assert got == {"d/1": ("Alpha", "http://alpha.example", "54622", "1;2", "a"), "d/2": ("Beta", None, None, None, "a")}
    agency = lambda code: f"<title>Gamma | x</title><b>Διεύθυνση: </b><i>Street 5, {code} City</i>"
    pages = spark.createDataFrame([("u1", agency("546 22")), ("u2", agency("10552"))], "url string, html string")
    assert [(r.name, r.postal_code, r.xe_url) for r in feeds.agency_profiles(pages, ["54", "55"]).collect()] == [("Gamma", "54622", "u1")]
    links = [("https://plot.gr/123456-flat?utm_a=1#x", "short €"), ("https://plot.gr/123456-flat", "the longer   text 9 €"), ("https://xe.gr/help", "long text €"), ("https://indomio.gr/aggelies/9", "no price")]
    got = feeds.captured_cards(spark.createDataFrame(links, "url string, text string")).collect()
    assert [(r.url, r.text) for r in got] == [("https://plot.gr/123456-flat", "the longer text 9 €")]
    assert spark.range(1).select(feeds.resolve_redirect(F.lit("https://t/x?a=1&url=https%3A%2F%2Fa%2Bb")).alias("u")).first().u == "https://a+b"


def test_pages(spark):
    page = "<html><head><title>T</title><script type='application/ld+json'>{\"@type\": \"Offer\", \"price\": 5}</script></head><body>€ 1.250 for 62,5 m²</body></html>"
    df = spark.createDataFrame([(page,)], "html string")
    x = df.select(extract.page_fields(F.col("html")).alias("x"), F.variant_get(extract.json_ld(F.col("html"))[0], "$.price", "int").alias("p")).first()
    assert (x.x.title, x.x.price_eur, x.x.area_m2, x.p) == ("T", 1250.0, 62.5, 5)
    cards = "<li><a href='x'>One</a></li><li><b>no</b></li>"
    got = df.select(extract.cards(F.lit(cards), "<li>", {"href": "href='([^']*)'", "label": "<a[^>]*>(.*?)</a>"}).alias("c")).first().c
    assert [(c.href, c.label) for c in got] == [("x", "One"), (None, None)]
    attr = "<div data-items=\"[{&quot;id&quot;: 7}]\">"
    assert df.select(extract.attribute_json(F.lit(attr), "data-items", "array<struct<id: int>>").alias("a")).first().a[0].id == 7


def test_page_listings(spark):
    page = """<title>Studio for rent | Agency</title><script type="application/ld+json">{"@graph": [{"offers": [{"price": "450"}], "geo": {"latitude": 40.61, "longitude": 22.95}}]}</script>
<h1>Studio for rent</h1><p>Area 41,5 τ.μ. 2 bedrooms floor: 3 built 1998</p><p>Location:</p><b>Old Town</b><p>Date added: 5/2/2026</p>"""
    sold = "<title>Flat SOLD</title><p>€ 120.000 80 m2</p><script>LatLng(40.6301, 22.9512)</script>"
    df = spark.createDataFrame([("https://a/property/123", page), ("https://a/9", sold), ("https://a/0", None)], "url string, html string")
    got = {r.url: r for r in extract.page_listings(df, F.lit("2026-03-01").cast("date")).withColumn("sold", extract.is_sold(F.col("title"))).collect()}
    r = got["https://a/property/123"]
    assert (r.price_eur, r.area_m2, r.bedrooms, r.floor, r.year_built, r.type, r.transaction, r.lat, r.location, str(r.date_published), r.date_source, r.sold) == (450.0, 41.5, "2", "3", "1998", "studio", "rent", 40.61, "Old Town", "2026-02-05", "text", False)
    r = got["https://a/9"]
    assert (r.price_eur, r.area_m2, r.lat, r.sold) == (120000.0, 80.0, 40.6301, True)
    urls = {"https://a/property/x-123": True, "https://a/b/c/d/123": False, "https://a/x.php?id=4567": False, "https://a/detail.php?id=4567": True, "https://a/blog/1234": False, "https://a/p/123.jpg": False}
    seen = spark.createDataFrame([(u,) for u in urls], "u string").select("u", extract.looks_like_detail(F.col("u")).alias("y"))
    assert {r.u: r.y for r in seen.collect()} == urls


def test_district_of_pages(spark):
    city = City(key="c", generic="City", areas=(("North", "north"), ("South", "south")), other_regions="veria", box=(40.0, 41.0, 22.0, 24.0), map_areas=(MapArea("n1", "North", pattern="hill"),))
    pages = {
        "place": ("<p>Location:</p><b>Veria</b>", ("other", None, None, "place")), "point": ("LatLng(36.1234, 23.1234)", ("other", None, None, "map point")),
        "address": ('<script type="application/ld+json">{"addressLocality": "North side"}</script>', ("c", "North", None, "address")), "crumbs": ("<ol class='breadcrumb'><li>South</li></ol>", ("c", "South", None, "breadcrumb")),
        "two": ("<h1>x</h1><p>north and south</p>", (None, None, None, None)), "text": ("<nav>south</nav><h1>On the hill</h1><p>similar: south</p>", ("c", "North", "n1", "text")), "veria": ("<h1>veria</h1>", (None, None, None, None)),
    }
    df = spark.createDataFrame([(k, h) for k, (h, _) in pages.items()], "url string, html string")
    got = {r.url: (r.region, r.area, r.neighbourhood, r.how) for r in extract.district_hints(df, city, F.lit("2026-01-01").cast("date")).collect()}
    assert got == {k: v for k, (_, v) in pages.items()}


def test_posts(spark):
    texts = ["Rent flat 60 m2 500 €", "SOLD: flat 60 m2 500 € rent", "rent 60 m2 500 € 600 € 700 € 800 €", "flat 60 m2 500 €", "продажа 60 м2 90.000 €", "дайджест: аренда 60 м2 500 €"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(texts)], "i int, t string")
    assert [r.ok for r in df.select("i", feeds.post_is_listing(F.col("t")).alias("ok")).orderBy("i").collect()] == [True, False, False, False, True, False]
    block = '<div data-post="chan/17"><time datetime="2026-02-03T10:00:00+00:00"></time><div class="tgme_widget_message_text js">🏡 Сдается студия, Тумба<br>45 м², 2 спальни, 3 этаж<br>450 евро в месяц https://m/?q=40.6123,22.9512</div>'
    posts = spark.createDataFrame([(block, "Chan", "thessaloniki"), (block.replace("/17", "/18"), "Chan", "athens: all"), ("<div data-post='x'>", "Chan", "")], "block string, channel string, focus string")
    got = {r.url: r for r in feeds.post_rows(posts, NOW, [("тумб", "Toumba")], [("^athens|athens:", "Athens"), ("^thessaloniki", "Here")], "Here").collect()}
    r = got["https://t.me/chan/17"]
    assert (r.title, r.transaction, r.type, r.price_eur, r.area_m2, r.bedrooms, r.floor, r.location, r.lat, str(r.date_published)) == ("Сдается студия, Тумба · Toumba", "rent", "studio", 450.0, 45.0, "2", "3", "Toumba", 40.6123, "2026-02-03")
    assert got["https://t.me/chan/18"].location == "Athens, Toumba" and len(got) == 2
    assert posts.select(feeds.next_before(F.lit('data-post="c/9" data-post="c/5"')).alias("n")).first().n == 5


def test_alerts(spark):
    rows = [
        ("Spitogatos", "2/3/2026 10:00", "Νέα αγγελία", "https://www.spitogatos.gr/aggelia/123?utm_source=x", "Νέα αγγελία: old 9 € ⟦LINK⟧ €85.000 Τούμπα Διαμέρισμα 70 τ.μ. 3ος Αγγελιοδότης: Alpha Homes Δες την αγγελία"),
        ("XE", "2/4/2026", "x", "https://xe.gr/p/0a1b2c3d-0000-0000-0000-000000000001", "Νέες αγγελίες: Διαμέρισμα 37.0 τ.μ. 72.000 € | 1.946 € / τ.μ. Ισόγειο | 1 υ/δ | 1 μπ. | 1970 Συκιές για πώληση"),
        ("Indomio", "2/5/2026", "ενοικίαση", "https://www.indomio.gr/aggelies/9", "στην τοποθεσία Κέντρο: Νέα αγγελία Studio 36 τ.μ. 400 € Δημοσιεύθηκε: 27/01/2026"),
        ("Plot", "", "x", "https://plot.gr/unsubscribe", "x"),
    ]
    got = {r.source_domain: r for r in feeds.alert_rows(spark.createDataFrame(rows, "portal string, received string, subject string, url string, context string"), NOW).collect()}
    assert set(got) == {"spitogatos.gr", "xe.gr", "indomio.gr"}
    s, x, i = got["spitogatos.gr"], got["xe.gr"], got["indomio.gr"]
    assert (s.url, s.price_eur, s.area_m2, s.floor, s.agency, s.location, str(s.date_updated)) == ("https://www.spitogatos.gr/aggelia/123", 85000.0, 70.0, "3", "Alpha Homes", "Τούμπα", "2026-02-03")
    assert (x.price_eur, x.area_m2, x.bedrooms, x.transaction, x.title) == (72000.0, 37.0, "1", "sale", "Διαμέρισμα 37.0 τ.μ. 72.000 € · Συκιές για πώληση")
    assert (i.transaction, i.price_eur, i.location, str(i.date_published), i.date_source) == ("rent", 400.0, "Κέντρο", "2026-01-27", "portal alert")
    cols = "url string, title string, price_eur double, date_published date, date_updated date"
    d = dt.date
    old = spark.createDataFrame([("u", "old", 1.0, None, d(2026, 1, 5)), ("k", "k", 1.0, None, d(2026, 1, 1))], cols)
    new = spark.createDataFrame([("u", "new", 2.0, None, d(2026, 1, 2)), ("n", "n", 3.0, None, d(2026, 1, 9))], cols)
    merged = {r.url: (r.title, r.date_published, r.date_updated) for r in feeds.merged_alerts(old, new).collect()}
    assert merged == {"u": ("new", d(2026, 1, 2), d(2026, 1, 5)), "k": ("k", None, d(2026, 1, 1)), "n": ("n", None, d(2026, 1, 9))}


def test_delivery_is_all_or_nothing(spark, tmp_path):
    sent, feed, out = str(tmp_path / "sent"), str(tmp_path / "feed"), tmp_path / "out"
    out.mkdir()
    jobs.prime_sent(spark.createDataFrame([("old",)], "url string"), sent)
    spark.createDataFrame([("old",), ("new",), ("new",)], "url string").write.parquet(feed)
    stream = lambda: spark.readStream.schema("url string").parquet(feed)

    def deliver(rows, token):
        for r in rows:
            (out / r["url"]).write_text("x")
        return True

    try:
        jobs.deliver_once(spark, stream(), sent, str(tmp_path / "c"), lambda rows, token: not list(rows))
    except Exception:  # noqa: BLE001  the failed batch ends the stream
        pass
    assert spark.read.parquet(sent).count() == 1
    jobs.deliver_once(spark, stream(), sent, str(tmp_path / "c"), deliver)
    assert [p.name for p in out.iterdir()] == ["new"] and sorted(r.url for r in spark.read.parquet(sent).collect()) == ["new", "old"]


def test_rows_of_feeds_are_dealt_and_texts_are_made_once(spark):
    from listwright.plans import q_feeds

    assert q_feeds.made(spark, "/root/testdata/sf0.001", "o_orderkey").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    posts = spark.createDataFrame([("", "c", "")], "block string, channel string, focus string")
    assert plan(feeds.post_rows(posts, "2026-03-04T05:06:07Z")).count(r"<br\s*/?>") == 1
    pages = spark.createDataFrame([("", "")], "url string, html string")
    assert plan(extract.page_listings(pages, F.lit("2026-03-01").cast("date"))).count('meta[^>]+(?:property|name)=["\']og:title') == 1
