"""Listing operators on hand-made rows, and properties that must hold on random ones."""

import datetime as dt
import json
import math
import random

import pytest
from listwright.config import City, MapArea
from listwright.operators import gold, grouping, history, matching, normalize, registry_ops, reporting
from listwright.operators.components import components
from pyspark.sql import functions as F


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))


RAW = "ord long, source_domain string, url string, title string, transaction string, type string, price_eur string, area_m2 string, location string, date_published date"


def raw(spark, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], RAW)


def test_drop_reasons_come_before_first_wins(spark):
    old, run = dt.date(2026, 1, 1), F.lit("2026-05-01").cast("date")
    df = raw(
        spark,
        (1, "a", "http://a/1", "Our Blog", None, None, None, None, None, None),
        (2, "a", "http://a/1?utm_source=x", "Flat", None, None, None, None, None, None),
        (3, "a", "http://a/1#z", "Flat again", None, None, None, None, None, None),
        (4, "a", "http://a/bg/2", "Flat", None, None, None, None, None, None),
        (5, "b", "http://b/3", "Квартира", None, None, None, None, None, None),
        (6, "t.me", "http://t.me/3", "Квартира", None, None, None, None, None, None),
        (7, "a", "http://a/4", "Flat", None, None, None, None, None, old),
        (8, "t.me", "http://t.me/4", "Flat", None, None, None, None, None, old),
        (9, "a", "http://a/en/5", "Flat", None, None, None, None, None, None),
        (10, "a", "http://a/listings/n/12", "Flat", None, None, None, None, None, None),
    )
    marked = normalize.mark_drops(df.withColumn("date_source", F.when(F.col("ord") == 3, "portal alert")), run)
    assert {r.ord: r.drop_reason for r in marked.collect()} == {
        1: "not a listing", 2: None, 3: None, 4: "translated duplicate", 5: "translated duplicate", 6: None, 7: None, 8: "old portal alert", 9: None, 10: "not a listing",
    }
    copies = normalize.mark_url_copies(marked)
    assert sorted(r.ord for r in copies.filter("drop_reason is null").collect()) == [2, 6, 7, 9]
    assert {r.drop_reason: r["count"] for r in normalize.drop_reasons(copies).collect()} == {"not a listing": 2, "translated duplicate": 2, "old portal alert": 1, "duplicate url": 1}
    left = normalize.first_by_url(marked.filter("drop_reason is null"))
    assert sorted(r.ord for r in left.collect()) == [2, 6, 7, 9]


def test_alert_links_yield_to_page_records(spark):
    uuid = "0a1b2c3d-0000-0000-0000-000000000001"
    urls = [("xe.gr", f"https://www.xe.gr/property/d/flat/{uuid}/x"), ("xe.gr", f"https://xe.gr/p/{uuid}"), ("xe.gr", "https://xe.gr/p/0a1b2c3d-0000-0000-0000-000000000002"), ("b", f"https://xe.gr/p/{uuid}")]
    df = spark.createDataFrame([(i, s, u) for i, (s, u) in enumerate(urls)], "ord int, source_domain string, url string")
    assert sorted(r.ord for r in normalize.drop_alert_twins(df).collect()) == [0, 2, 3]


def test_normalisation_as_a_whole(spark):
    city = City(key="c", generic="City", generic_re="city", areas=(("North", "north"), ("City", "city")), other_regions="veria", centres={"North": (38.0, 23.5)}, box=(37.0, 39.0, 23.0, 24.0), map_areas=(MapArea("n1", "North", pattern="hill", centre=(38.01, 23.51)),))
    day = lambda d: {"date_published": dt.date(2026, 4, d), "scraped_at": f"2026-04-{d:02d}T00:00:00Z"}
    rows = [
        {"title": "Flat north, €120.000", "price_eur": "5", "area_m2": "80", "url": "http://a/1"} | day(1), {"title": "Flat hill city", "price_eur": "90000", "area_m2": "70", "url": "http://a/2"} | day(2),
        {"title": "Flat in Veria", "url": "http://a/3"} | day(3), {"title": "Flat Veria 12 city", "url": "http://a/4"} | day(4), {"title": "Flat", "url": "http://a/5", "lat": "38.001", "lon": "23.501"} | day(5),
        {"title": "Flat", "url": "http://a/6", "lat": "36.0", "lon": "23.5"} | day(6), {"title": "Flat", "url": "http://a/7", "location": "North"} | day(7), {"title": "Flat north for rent, 900 €", "url": "http://a/8"} | day(8),
        {"title": "Flat", "url": "http://a/9"} | day(9),
    ]
    names = ("title", "url", "transaction", "type", "price_eur", "area_m2", "location", "lat", "lon", "date_published", "scraped_at")
    schema = "ord long, source_domain string, " + ", ".join(f"{n} {'date' if n == 'date_published' else 'string'}" for n in names)
    df = spark.createDataFrame([(i, "a", *[r.get(n) for n in names]) for i, r in enumerate(rows, 1)], schema)
    history = spark.createDataFrame([("http://a/1", dt.date(2026, 1, 1), dt.date(2026, 3, 1)), ("http://gone", dt.date(2025, 1, 1), dt.date(2025, 1, 2))], "url string, first_seen date, last_seen date")
    hints = spark.createDataFrame([("http://a/9", "other", "", "")], "url string, region string, area string, neighbourhood string")
    got = normalize.normalize(df, city, F.lit("2026-05-01").cast("date"), hints, history)
    out = {r.ord: r for r in got.listings.collect()}
    assert (out[1].price_eur, out[1].transaction, out[1].area, out[1].price_per_m2, out[1].first_seen) == (120_000, "sale", "North", 1500, dt.date(2026, 1, 1))
    assert (out[2].area, out[2].neighbourhood, out[2].geo, out[2].map_lat) == ("North", "n1", "area", 38.01)
    assert (out[3].region, out[3].area, out[4].region, out[4].area) == ("other", None, "c", "City")
    assert (out[5].region, out[5].area, out[5].region_how, out[5].geo) == ("c", "North", "coordinates", "site")
    assert (out[6].region, out[6].region_how) == ("other", "coordinates")
    assert (out[7].region, out[7].area, out[7].geo, out[7].map_lon) == ("c", "North", "district", 23.5)
    assert (out[8].transaction, out[8].price_eur, out[9].region, out[9].region_how) == ("rent", 900, "other", "page")
    seen = {r.url: (r.first_seen, r.last_seen) for r in got.history.collect()}
    assert seen["http://a/1"] == (dt.date(2026, 1, 1), dt.date(2026, 4, 1)) and "http://gone" in seen and got.dropped.count() == 0


def test_objects_need_price_and_area(spark):
    df = raw(
        spark,
        (1, "a", "u1", "t", "sale", "x", "5", "6", None, None), (2, "a", "u2", "t", "sale", "x", "5", "6", None, None), (3, "b", "u3", "t", "sale", "x", "5", "6", None, None),
        (4, "a", "u4", "t", "sale", "x", None, "6", None, None), (5, "a", "u5", "t", "sale", "x", None, "6", None, None), (6, "a", "u6", "t", None, None, "5", "6", None, None), (7, "a", "u7", "t", None, None, "5", "6", None, None),
    )
    assert sorted(r.ord for r in normalize.first_by_object(df).collect()) == [1, 3, 4, 5, 6]


def test_validation(spark):
    df = raw(
        spark,
        (1, "a", "u", "flat", "sale", None, "1500", "50", None, None), (2, "a", "u", "flat", "rent", None, "90000", "50", None, None), (3, "a", "u", "flat", "sale", None, "4000", "115", None, None),
        (4, "a", "u", "plot of land", "sale", None, "4000", "115", None, None), (5, "a", "u", "flat", "sale", None, "90000", "3", None, None), (6, "a", "u", "flat", None, None, "x", "200000", None, None), (7, "a", "u", "flat", "sale", None, "0", "50", None, None),
        (8, "a", "u", "flat", "sale", None, "100001", "40", None, None),
    )
    got = {r.ord: (r.price_eur, r.area_m2, r.price_per_m2) for r in normalize.validate(df).collect()}
    assert got == {1: (None, 50, None), 2: (None, 50, None), 3: (None, 115, None), 4: (4000, 115, 35), 5: (90000, None, None), 6: (None, None, None), 7: (None, 50, None), 8: (100001, 40, 2500)}


def test_offices_and_phones_are_masked(spark):
    rows = [(i, "a", f"u{i}", "t", None, None, None, None, "Main St 5", None) for i in range(5)] + [(9, "a", "u9", "t", None, None, None, None, "Other St 7", None), (10, "b", "u10", "t", None, None, None, None, "call 2310123456", None)]
    got = {r.ord: r.location for r in normalize.mask_offices(raw(spark, *rows)).collect()}
    assert got == dict.fromkeys(range(5)) | {9: "Other St 7", 10: None}


def test_hints(spark):
    df = spark.createDataFrame([("u1", None, None, None), ("u2", "city", "Centre", "listing"), ("u3", "city", "generic", "listing"), ("u4", "city", None, "location")], "url string, region string, area string, region_how string")
    hints = spark.createDataFrame([("u1", "city", "North"), ("u2", "city", "North"), ("u3", "other", None), ("u4", "other", None)], "url string, region string, area string")
    got = {r.url: (r.region, r.area, r.region_how) for r in normalize.apply_hints(df, hints, "generic").collect()}
    assert got == {"u1": ("city", "North", "page"), "u2": ("city", "Centre", "listing"), "u3": ("city", "generic", "listing"), "u4": ("other", None, "page")}


GROUP = "ord long, source_domain string, title string, location_raw string, transaction string, type string, price_eur double, area_m2 double, floor string, bedrooms string, year_built string, region string, area string, neighbourhood string, map_lat double, map_lon double, geo string"


def flat(ord_, site, price=100_500.0, m2=81.0, **kw):
    base = {"title": "t", "location": None, "transaction": "sale", "type": "apartment", "floor": None, "bedrooms": None, "year_built": None, "region": "home", "area": "A", "neighbourhood": None, "lat": None, "lon": None, "geo": "site"} | kw
    return (ord_, site, base["title"], base["location"], base["transaction"], base["type"], price, m2, base["floor"], base["bedrooms"], base["year_built"], base["region"], base["area"], base["neighbourhood"], base["lat"], base["lon"], base["geo"])


def groups(spark, rows):
    got = grouping.grouped(spark.createDataFrame(rows, GROUP), generic="G").collect()
    return {r.ord: r.property_id for r in got}


@pytest.mark.parametrize(
    "b, together",
    [
        ({}, True), ({"price": 101_900.0, "floor": "3"}, True), ({"price": 102_100.0, "floor": "3"}, False), ({"area": 82.0, "floor": "3"}, True), ({"area": 84.0, "floor": "3"}, False),
        ({"floor": "2"}, False), ({"type": "studio"}, True), ({"type": "house"}, False), ({"area_": "B"}, False), ({"region": "other"}, False), ({"area_": "G"}, True), ({"area_": "G", "price": 100_600.0, "floor": "3"}, False),
        ({"transaction": "rent"}, False), ({"site": "a"}, False), ({"lat": 40.0, "lon": 23.0}, False), ({"lat": 40.0, "lon": 23.0, "geo": "area"}, True),
    ],
)
def test_pair_rules(spark, b, together):
    b = dict(b)
    site, price, area = b.pop("site", "b"), b.pop("price", 100_500.0), b.pop("area", 81.0)
    if "area_" in b:
        b["area"] = b.pop("area_")
    got = groups(spark, [flat(1, "a", floor="3", lat=41.0, lon=23.0), flat(2, site, price, area, **({"floor": "3"} | b))])
    assert (got[1] == got[2]) is together


def test_groups_keep_their_invariants(spark):
    rng = random.Random(4)
    rows = [flat(i, f"s{rng.randrange(6)}", 100_000.0 + rng.randrange(12) * 700, 80.0 + rng.randrange(5), floor=str(rng.choice([1, 2])), bedrooms=rng.choice([None, "2"]), area=rng.choice(["A", "G"])) for i in range(120)]
    got = groups(spark, rows)
    by = {}
    for r in rows:
        by.setdefault(got[r[0]], []).append(r)
    assert any(len(m) > 1 for m in by.values())
    for root, members in by.items():
        assert root == min(m[0] for m in members) or root in {m[0] for m in members}
        assert len({m[1] for m in members}) == len(members)
        for k, skip in ((8, {None}), (9, {None}), (12, {"G"})):
            assert len({m[k] for m in members} - skip) <= 1
        prices, areas = [m[6] for m in members], [m[7] for m in members]
        assert max(prices) - min(prices) <= 0.015 * max(prices) and max(areas) - min(areas) <= max(1.0, 0.015 * max(areas))
    assert groups(spark, rows[::-1]) == got


def brute_groups(rows):
    """The merging replayed over all pairs of one list, in the order of area buckets and rows."""
    close = lambda a, b, most: abs(a - b) <= max(most, 0.015 * max(a, b))
    bucket = {r[0]: round(r[7]) for r in rows}
    order = sorted(rows, key=lambda r: (bucket[r[0]], r[0]))
    pairs = []
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            vague = "G" in (a[12], b[12])
            near = bucket[b[0]] - bucket[a[0]] <= max(2, int(bucket[a[0]] * 0.015)) + (0 if bucket[b[0]] == bucket[a[0]] else 1)
            fits = near and a[1] != b[1] and close(a[6], b[6], 0) and close(a[7], b[7], 1) and (vague or a[12] == b[12]) and (not vague or (a[6], a[7]) == (b[6], b[7]))
            unlike = any(a[k] and b[k] and a[k] != b[k] for k in (8, 9))
            points = 2 * (a[8] == b[8] is not None) + (a[9] == b[9] and a[9] is not None) + (a[6] == b[6] and a[6] % 1000 != 0) + (a[7] == b[7] and a[7] % 5 != 0)
            if fits and not unlike and points >= 2:
                pairs.append((a[0], b[0]))
    members = {r[0]: (r[1], (None if r[12] == "G" else r[12], r[5], r[8], r[9]), r[6], r[7]) for r in rows}
    return grouping.merge_component(pairs, members)


def test_groups_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [flat(i, f"s{rng.randrange(5)}", 100_000.0 + rng.randrange(9) * 610, 80.0 + rng.randrange(6) * 0.5, floor=str(rng.choice([1, 2, 3])), bedrooms=rng.choice([None, "2"]), area=rng.choice("AABG")) for i in range(150)]
    assert groups(spark, rows) == brute_groups(rows)


def test_components_are_found(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[100], got[200], got[300]} == {100}


def test_price_history_compares_with_unreported_changes(spark):
    rows = [("u", 1, 100.0), ("u", 2, 100.0), ("u", 3, 40.0), ("u", 4, 38.0), ("v", 1, 5.0)]
    got = history.price_changes(spark.createDataFrame(rows, "url string, at int, price double"), "url", ["at"], "price")
    assert sorted((r.url, r.at, r.old_price, r.reportable) for r in got.collect()) == [("u", 1, None, False), ("u", 3, 100.0, False), ("u", 4, 40.0, True), ("v", 1, None, False)]
    days = got.withColumn("day", F.date_add(F.lit("2026-01-01").cast("date"), F.col("at")))
    drops = history.last_drops(days, "url", ["at"], "price", F.lit("2026-01-01").cast("date"), "day")
    assert [(r.url, r.price) for r in drops.collect()] == [("u", 38.0)]


def test_broken_sources_keep_what_was_known(spark):
    known = spark.createDataFrame([("a", i) for i in range(30)] + [("b", i) for i in range(30)], "site string, k int")
    got = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(29)], "site string, k int")
    left = history.keep_old_where_broken(known, got, "site")
    assert {r.site: r["count"] for r in left.groupBy("site").count().collect()} == {"a": 30, "b": 29}


def test_carry_over(spark):
    d = dt.date
    schema = "url string, price double, date_published date, date_updated date, lat double, lon double"
    old = spark.createDataFrame([("u", 1.0, d(2026, 1, 1), d(2026, 2, 1), 40.0, 23.0), ("gone", 2.0, None, None, None, None)], schema)
    new = spark.createDataFrame([("u", 3.0, d(2026, 1, 5), d(2026, 1, 9), 41.0, 24.0), ("new", 4.0, None, None, None, None)], schema)
    got = {r.url: tuple(r)[1:] for r in history.carry_over(old, new, "url").collect()}
    assert got["u"] == (3.0, d(2026, 1, 1), d(2026, 2, 1), 40.0, 23.0) and got["gone"][0] == 2.0 and got["new"][0] == 4.0


PROPERTY = "id long, transaction string, region string, region_ok boolean, type string, area string, neighbourhood string, price double, m2 double, bedrooms double, floor double"


def prop(**kw):
    base = {"id": 1, "transaction": "sale", "region": "home", "region_ok": True, "type": "apartment", "area": "A", "neighbourhood": None, "price": 1000.0, "m2": 50.0, "bedrooms": 2.0, "floor": 1.0} | kw
    return tuple(base.values())


@pytest.mark.parametrize(
    "p, f, hit",
    [
        ({}, {}, True), ({"transaction": "rent"}, {"transaction": "sale"}, False), ({"transaction": None}, {"transaction": "sale"}, False), ({"region": "other"}, {}, False), ({"region": "other"}, {"region": ""}, True),
        ({"region_ok": False}, {}, False), ({"region_ok": False}, {"keep_unconfirmed_region": True}, True), ({"type": None}, {"types": ["land"]}, False), ({"neighbourhood": "N"}, {"areas": ["N"]}, True), ({"area": None}, {"areas": ["A"]}, False),
        ({"price": None}, {"price_max": 5.0}, False), ({"price": None}, {"price_max": 5.0, "keep_unknown": True}, False), ({"m2": None}, {"m2_min": 5.0}, True), ({"m2": None}, {"m2_min": 5.0, "keep_unknown": False}, False),
        ({"floor": None}, {"floor_min": 1.0, "keep_unknown_floor": False}, False), ({"floor": None}, {"floor_min": 1.0, "keep_unknown": False, "keep_unknown_floor": True}, True), ({"floor": None}, {"floor_min": 1.0, "keep_unknown": False}, False),
        ({}, {"m2_min": 50.0, "m2_max": 50.0}, True), ({}, {"bedrooms_min": 3.0}, False), ({}, {"enabled": False}, False),
        ({"transaction": "auction"}, {}, True), ({"transaction": "auction"}, {"transaction": "auction"}, True), ({"transaction": None, "region": None}, {"region": ""}, True),
    ],
)
@pytest.mark.parametrize("few", [10_000, 1])
def test_filter_policy(spark, monkeypatch, p, f, hit, few):
    """Among filters that nothing passes; with one filter a salt, they are dealt to four."""
    monkeypatch.setattr(matching, "FEW_FILTERS", few)
    names = [c.split(" ")[0] for c in matching.FILTER_SCHEMA.split(", ")]
    others = [{"name": f"g{k}", "transaction": "none"} for k in range(3)]
    filters = spark.createDataFrame([tuple(x.get(n) for n in names) for x in ({"name": "f"} | f, *others)], matching.FILTER_SCHEMA)
    got = matching.match_filters(spark.createDataFrame([prop(**p)], PROPERTY), filters)
    assert got.count() == int(hit)


def test_messages_stay_within_the_limit(spark):
    blocks = spark.createDataFrame([("r", 1, "Title", ["a" * 30, "b" * 30, "😀" * 40]), ("r", 2, "Next", ["c"])], "recipient string, ord int, title string, pieces array<string>")
    got = [r.message for r in matching.pack_messages(blocks, 50).orderBy("part").collect()]
    assert all(len(m.encode("utf-16-le")) // 2 <= 50 for m in got)
    assert got[0] == "Title\n" + "a" * 30 and got[1].startswith("Title (cont.)\nb") and got[-1].endswith("Next\nc")
    assert matching.plain_cut("<b>" + "x" * 50 + "</b>&amp;", 20) == "x" * 19 + "…" and matching.plain_cut("a" * 10 + "&amp;" * 3, 13) == "a" * 10 + "…"


def test_first_run_and_sent_drops(spark):
    props = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "id long, urls array<string>")
    primed, urls = matching.first_run(None, props)
    assert primed and sorted(r.url for r in urls.collect()) == ["a", "b", "c"]
    known = spark.createDataFrame([("a",)], "url string")
    assert not matching.first_run(known, props)[0]
    hit = spark.createDataFrame([(("f",), (1,)), (("f",), (2,)), (("f",), (3,))], "f struct<name: string>, p struct<id: long>")
    drops = spark.createDataFrame([(1, "a", 10.0, 9.0), (1, "b", 10.0, 8.0), (2, "c", 5.0, 4.0), (3, "d", 5.0, 4.0)], "id long, url string, old_price double, price double")
    sent = spark.createDataFrame([("c", 4.0)], "url string, price double")
    got = matching.unsent_drops(hit, drops, sent, spark.createDataFrame([(3,)], "id long")).collect()
    assert [(r.p.id, r.url, r.price) for r in got] == [(1, "b", 8.0)]


def test_export_helpers(spark):
    df = spark.createDataFrame([(1, "x", None, "p"), (2, "y", None, None), (3, "x", "q", None)], "k int, a string, b string, c string")
    rows = {r.k: json.loads(r.row) for r in gold.packed_rows(df, "k", ["c", "b", "a"]).collect()}
    assert rows == {1: ["x", None, "p"], 2: ["y"], 3: ["x", "q"]}
    assert {r.a: r.code for r in gold.dictionary(df, "a", "k").collect()} == {"x": 0, "y": 1}


def test_schedule_and_shares(spark):
    one = spark.range(1)
    now = F.lit("2026-05-02 03:00:00").cast("timestamp")
    got = one.select(reporting.last_due_start([6, 18], now, 4).alias("s"), reporting.last_due_start([(10, 13), (18, 43)], now, 4, "Europe/Athens").alias("z")).first()
    assert (got.s, got.z) == (dt.datetime(2026, 5, 1, 18), dt.datetime(2026, 5, 1, 15, 43))
    runs = spark.createDataFrame([("2026-05-01T10:00Z", ""), ("2026-05-01T16:00Z", "normalize")], "at string, failed_steps string")
    notes = spark.createDataFrame([("2026-05-01T16:10Z", 3, 2)], "at string, messages int, delivered int")
    page = spark.createDataFrame([('x const ASOF = "30.04.2026";',)], "html string")
    dog = reporting.watchdog(runs, notes, page, F.lit("2026-05-01 23:00:00").cast("timestamp"), [(10, 13), (18, 43)], zone="Europe/Athens").first()
    assert (dog.stale, dog.failed, dog.undelivered, dog.not_shown) == (False, True, True, True)
    sites = spark.createDataFrame([("a", 2), ("b", 50), ("c", 900)], "site string, waiting long")
    assert {r.site: r.share for r in reporting.fair_share(sites, 100, 60).collect()} == {"a": 2, "b": 49, "c": 49}
    rng = random.Random(1)
    for budget, cap in ((50, 9), (300, 40), (5000, 30), (7, 3)):
        waiting = {f"s{i:02d}": rng.randrange(1, 80) for i in range(40)}
        left, expected = budget, {}
        for k, s in enumerate(sorted(waiting, key=lambda s: (waiting[s], s))):
            expected[s] = min(waiting[s], cap, max(1, left // (len(waiting) - k)))
            left -= expected[s]
        got = reporting.fair_share(spark.createDataFrame(list(waiting.items()), "site string, waiting long"), budget, cap)
        assert {r.site: r.share for r in got.collect()} == expected


def test_registry(spark):
    ok = "<a href='/property/1'></a>" * 1 + "".join(f"<a href='/property/{i}'></a>" for i in range(6)) + "wp-content"
    rows = [("A", "a.example", 200, "https://a.example/", ok, "User-agent: *\nDisallow: /private"), ("B", "b.example", 403, None, "Pardon Our Interruption", None), ("C", None, None, None, None, None), ("D", "d.example", None, None, None, None), ("E", "e.example", 200, "https://e.example/", "for sale", "User-agent: listwright\nDisallow: /\n"), ("F", "f.example", 500, None, "x", None)]
    df = spark.createDataFrame(rows, "name string, website string, http_status int, final_url string, html string, robots string").withColumns({"sitemap": F.lit("<loc>https://e.example/property/1</loc>" * 5), "section": F.lit("")})
    got = {r.name: (r.site_status, r.robots_ok, r.has_listings, r.platform) for r in registry_ops.check_sites(df).collect()}
    assert got == {"A": ("ok", "yes", "yes", "wordpress"), "B": ("bot_check_imperva", None, None, None), "C": ("no_site", None, None, None), "D": ("error", None, None, None), "E": ("ok", "explicit_no", "yes", ""), "F": ("http_500", None, None, None)}
    names = spark.createDataFrame([("Μεσιτικό Γραφείο Λίθος Άλφα", "…ΛΙΘΟΣ  ΑΛΦΑ…"), ("Home", "home"), ("Negas", "visit negas today")], "name string, page string")
    assert [r.y for r in names.coalesce(1).select(registry_ops.names_agency(F.col("page"), F.col("name")).alias("y")).collect()] == [True, False, True]
    guesses = names.filter("name = 'Negas'").select(registry_ops.site_guesses(F.col("name")).alias("g")).first().g
    assert guesses[0] == "https://negasrealestate.gr" and len(guesses) == 6
    schema = "ord int, name string, website string, domain string, xe_url string"
    registry = spark.createDataFrame([(1, "Alpha Real Estate", "https://www.alpha.gr/x", "alpha.gr", None), (2, "Beta", None, None, "xe/2")], schema)
    found = spark.createDataFrame([(1, "Gamma", None, None, None), (2, "GAMMA (new)", None, None, None), (3, "Other", "http://alpha.gr", None, "xe/9"), (4, "Beta Group", None, None, None), (5, "Delta", None, None, "xe/2")], schema)
    assert [r.ord for r in registry_ops.new_agencies(found, registry).collect()] == [1]
    assert {r.name: r.xe_url for r in registry_ops.linked_profiles(registry, found).collect()} == {"Alpha Real Estate": "xe/9", "Beta": "xe/2"}
    reg = spark.createDataFrame([("A", "http_500", None), ("B", "ok", "yes")], "name string, site_status string, has_listings string")
    checked = spark.createDataFrame([("A", "ok", "yes")], "name string, site_status string, has_listings string")
    new = registry_ops.updated_registry(reg, checked, spark.createDataFrame([("Z", "error", None)], "name string, site_status string, has_listings string"))
    assert {r.name: (r.site_status, r.came_back) for r in new.collect()} == {"A": ("ok", True), "B": ("ok", False), "Z": ("error", False)}
    assert [r.name for r in registry_ops.to_recheck(reg).collect()] == ["A"]


def test_titles_places_and_lines(spark):
    df = spark.createDataFrame([("Flat 80 m² | Alpha Homes - Real Estate", "Alpha Homes", "Θεσσαλονίκη, Greece"), ("Flat", "X", "Toumba, Greece")], "t string, a string, l string").coalesce(1)
    got = [(r.t, r.l) for r in df.select(gold.short_title(F.col("t"), F.col("a")).alias("t"), gold.short_location(F.col("l"), F.col("t")).alias("l")).collect()]
    assert got == [("Flat 80 m²", None), ("Flat", "Toumba, Greece")]
    line = gold.display_line(F.lit("Centre"), F.lit("studio"), F.lit(40.5), gold.floor_name(F.lit(0.5)), F.lit(1200.9), F.lit(2), F.lit(True), F.lit(-12.0))
    assert df.limit(1).select(line.alias("x")).first().x == "Centre, studio 40 m², mezzanine, 1 200 €/month (−12% to the district's mean), on 2 sites"
    members = spark.createDataFrame([(1, 38.0, 23.0, "district", "agency", 1), (1, 38.1, 23.1, "site", "portal", 2)], "property_id long, lat double, lon double, geo string, source_kind string, ord int")
    more = {c: F.lit(None).cast("string") for c in ("url", "title", "transaction", "type", "bedrooms", "floor", "area", "region", "source_domain", "segment", "year_built")} | {"price_eur": F.lit(1.0), "area_m2": F.lit(1.0), "listing_date": F.lit(None).cast("date"), "first_seen": F.lit(None).cast("date")}
    best = gold.rollup_properties(members.withColumns(more)).first()
    assert (best.point.lat, best.point.geo, best.auction) == (38.1, "site", False)


def test_a_band_join_sends_a_row_to_two_stretches_at_most(spark):
    rows = [(i, "k", float(v), f"s{i % 5}", "wide" * 5) for i, v in enumerate([-9, -4, -1, 0, 0.5, 1, 2.5, 3, 4, 40, 41, 99, 100, 1000, 1010, 1015, 1018, 1019, 9000, 9130, 9140])]
    df = spark.createDataFrame(rows, "ord long, key string, v double, site string, other string")
    pairs = grouping.band_pairs(df, ["key"], "v", "site").select(F.col("a.ord").alias("a"), F.col("b.ord").alias("b"))
    bucket = {i: round(v) for i, _, v, _, _ in rows}
    reach = lambda b: max(2, math.floor(0.015 * b)) + 1
    expected = {(i, j) for i in bucket for j in bucket if i % 5 != j % 5 and bucket[i] <= bucket[j] <= bucket[i] + reach(bucket[i]) and (bucket[i] < bucket[j] or i < j)}
    got = [tuple(r) for r in pairs.collect()]
    assert set(got) == expected and len(got) == len(expected)
    assert "other" not in pairs._jdf.queryExecution().optimizedPlan().toString().split("Join")[1].split("LogicalRDD")[0]


def test_recipients_messages_pass_one_by_one(spark):
    rows = [(r, o, f"t{o}", ["x" * 8]) for r in ("b", "a", None) for o in (2, 1, 3)]
    got = matching.pack_messages(spark.createDataFrame(rows, "recipient string, ord long, title string, pieces array<string>").repartition(3), 24)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    parts = [(0, "t1\nxxxxxxxx\n\nt2\nxxxxxxxx"), (1, "t3\nxxxxxxxx")]
    assert sorted((r.recipient or "", r.part, r.message) for r in got.collect()) == [(who, *p) for who in ("", "a", "b") for p in parts]


def test_listings_that_say_their_traits_only_meet_the_same(spark):
    rows = [flat(i, f"s{i}", 100_000.0, 80.0, floor=(None, "1", "2")[i % 3], bedrooms=(None, "2")[i % 2], type=("house", "studio")[i % 5 == 0]) for i in range(30)]
    base = grouping.prepared(spark.createDataFrame(rows, GROUP)).withColumns({"site": F.col("source_domain"), "rare_words": F.array().cast("array<string>")}).select(*grouping.PAIRED)
    got = [(r.a, r.b) for r in grouping.candidates(base).collect()]
    whole = lambda x: None not in (x.floor_key, x.bedrooms_key, x.kind)
    same = lambda x, y: (x.floor_key, x.bedrooms_key, x.kind) == (y.floor_key, y.bedrooms_key, y.kind)
    known = base.collect()
    expected = {(x.ord, y.ord) for x in known for y in known if x.ord < y.ord and (same(x, y) or not (whole(x) and whole(y)))}
    assert {(a.ord, b.ord) for a, b in got} == expected and len(got) == len(expected)
