"""Column functions against plain Python."""

import datetime as dt
import unicodedata

import pytest
from listwright.functions import dates, floors, geo, numbers, text
from listwright.operators import normalize, rules
from pyspark.sql import functions as F


def values(spark, inputs, column, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}").coalesce(1)
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def folded(s):
    s = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn")
    return s.replace("ς", "σ")


def test_fold(spark):
    inputs = ["ΔΙΑΜΈΡΙΣΜΑ στους Αγίους", "Éà ñ Å", "Ёлка Й", "é", "", "ΐΰ ϊ"]
    assert values(spark, inputs, text.fold) == [folded(x) for x in inputs]


def test_names_and_latin(spark):
    assert values(spark, ["Μεσιτικό Γραφείο ΑΘΗΝΑ (κέντρο) Real-Estate", None], text.name_key) == ["αθηνα", ""]
    assert values(spark, ["Θεσσαλονίκη ψυχή"], text.latin) == ["thessaloniki psychi"]


def test_urls(spark):
    urls = ["https://A.gr/x/?utm_source=a&b=1#c", "https://a.gr/x/?fbclid=9", "http://a.gr/x///", "http://a.gr/p?utm_x=a&id=5", "http://a.gr/p?id=5&LANG=el&sr=2", "http://a.gr/p?a=1&gclid=3&b=2"]
    assert values(spark, urls, text.url_key) == ["https://a.gr/x/?b=1", "https://a.gr/x", "http://a.gr/x", "http://a.gr/p?id=5", "http://a.gr/p?id=5&sr=2", "http://a.gr/p?a=1&b=2"]
    assert values(spark, ["https://www.A.gr:80/x", "//b.gr/", "c"], text.host) == ["a.gr", "b.gr", ""]
    assert values(spark, ["a+b%20c", "bad%zz"], text.unquote) == ["a+b c", "bad%zz"]


def test_html(spark):
    assert values(spark, ["<p>a &amp;lt; b</p>\n<i>c&nbsp;d</i>"], text.strip_tags) == ["a &lt; b c d"]
    assert values(spark, ["x<script>var a='</p>'</script><STYLE>p{}</STYLE>y"], text.page_text) == ["x y"]
    page = '<meta content="T &amp; U" property="og:title"><meta name="description" content="D">'
    assert values(spark, [page], lambda c: F.concat_ws("|", text.meta(c, "og:title"), text.meta(c, "description"))) == ["T & U|D"]
    assert values(spark, ["a😀"], text.utf16_length) == [3]
    assert values(spark, ["&alpha;&#8364;&amp;lt;", None, "x"], text.unescape_all) == ["α€&lt;", None, "x"]
    body = "<nav>a</nav>b<div class='side menu-x'>c</div>d<FORM>e</form>"
    assert values(spark, [body], lambda c: F.replace(text.without_boilerplate(c), F.lit(" "), F.lit(""))) == ["bd"]
    page = "<a href='/x#y'>1</a><a href=\"z?q=1&amp;r\">2</a><a href='//b.gr/'>3</a><a href='mailto:q'>4</a>"
    assert values(spark, [page], lambda c: text.links(c, F.lit("https://a.gr/d/e"))) == [["https://a.gr/x", "https://a.gr/d/z?q=1&r", "https://b.gr/"]]
    under = "<title>Nice flat, Centre | Agency</title><h1>Nice flat, Centre</h1><p>120.000 €</p><span>Region - Town, Quarter</span>"
    assert values(spark, [under], lambda c: text.place_under_heading(c, F.lit("Nice flat, Centre | Agency"))) == ["Region - Town, Quarter"]


def test_numbers(spark):
    inputs = ["1.234,5", "1,234.5", "37,5", "1.234", "12", "x", "", "€ 1.250.000", "-3,5"]
    assert values(spark, inputs, numbers.locale_number) == [1234.5, 1234.5, 37.5, 1234.0, 12.0, None, None, 1250000.0, -3.5]
    odd = ["72.000", "72,000", "37,5", "1.234,5", "€ 1.946 / τ.μ.", "90,68", "from 77.000 €", "1'250 000"]
    assert values(spark, odd, numbers.card_number) == [72000.0, 72000.0, 37.5, None, None, 90.68, 77000.0, 1250000.0]
    assert values(spark, odd, numbers.portal_number) == [72000.0, 72.0, 37.5, 1234.5, None, 90.68, 77000.0, 1250000.0]
    assert values(spark, odd, numbers.listed_number)[5:7] == [90.68, 77000.0]
    assert values(spark, odd, numbers.profile_money)[6] == 77000.0 and values(spark, odd, numbers.post_number)[7] == 1250000.0
    assert values(spark, ["1.234,5", "1,234.5", "37,5", "1 250", "x"], numbers.page_number) == [1234.5, 1234.5, 37.5, 1250.0, None]
    assert values(spark, [2.5, 3.5], lambda c: numbers.per_unit(c, F.lit(1.0)), "double") == [2, 4]
    assert values(spark, [1234567.9], numbers.money, "double") == ["1 234 567"]
    assert values(spark, [0, 139, 141, 99999], lambda c: numbers.recheck_budget(c, 500, 7), "int") == [10, 10, 11, 500]
    assert values(spark, [100.0, 101.5, 101.6], lambda c: numbers.close(c, F.lit(100.0), 0.015), "double") == [True, True, False]


def test_dates(spark):
    today = F.lit("2026-05-01").cast("date")
    inputs = ["2026-02-30", "2026-02-28T10:00", "3/4/2025", "03-04-25", "1/1/2009", "2026-05-03", "2026-05-02", ""]
    expected = [None, dt.date(2026, 2, 28), dt.date(2025, 4, 3), dt.date(2025, 4, 3), None, None, dt.date(2026, 5, 2), None]
    assert values(spark, inputs, lambda c: dates.parse_day(c, today)) == expected
    said = ["3 days ago", "2 Weeks ago", "5 hours ago", "30 hours ago", "Πριν 30 ώρες", "πριν από 2 μήνες", "Μόλις", "12/09/2025", "31/02/2026", "soon"]
    card = [dt.date(2026, 4, 28), dt.date(2026, 4, 17), dt.date(2026, 5, 1), dt.date(2026, 4, 30), dt.date(2026, 4, 30), dt.date(2026, 3, 2), dt.date(2026, 5, 1), dt.date(2025, 9, 12), None, None]
    assert values(spark, said, lambda c: dates.relative_day(c, today)) == card
    assert values(spark, said[3:6], lambda c: dates.relative_day(c, today, whole_hours=False)) == [dt.date(2026, 5, 1), dt.date(2026, 5, 1), dt.date(2026, 3, 2)]
    page = '<script type="application/ld+json">{"datePosted": "2026-01-02"}</script><meta property="og:updated_time" content="2026-02-03T04:05">'
    days = values(spark, [page], lambda c: dates.page_days(c, F.lit("Published: 1/1/2026 Last updated: 9/3/2026"), today))[0]
    assert (days.published, days.updated, days.source) == (dt.date(2026, 1, 2), dt.date(2026, 2, 3), "jsonld+meta+text")
    assert values(spark, [1802210400], dates.epoch_day, "long") == [dt.date(2027, 2, 10)]


@pytest.mark.parametrize(
    "floor, code, level, digits",
    [
        ("ημιυπόγειο", -1, -1, "-1"), ("Υπόγειο", -2, -2, "-1"), ("basement", -2, -2, "-1"), ("ημιόροφος", 0.5, 0.5, None), ("υπερυψωμένο", 0.5, 0.5, "0"),
        ("Ισόγειο", 0, 0, "0"), ("3ος", 3, 3, "3"), ("12", 12, 12, "12"), ("75", None, None, "75"), ("-3", -2, -2, "-3"), ("", None, None, None), ("x 4", None, None, "4"),
    ],
)
def test_floors_differ_on_purpose(spark, floor, code, level, digits):
    got = values(spark, [floor], lambda c: F.struct(floors.floor_code(c), floors.floor_level(c), floors.floor_digits(c)))[0]
    assert tuple(got) == (code, level, digits)


def test_floor_from_title(spark):
    assert values(spark, ["Ground floor flat", "5th"], lambda c: floors.floor_code(F.lit(""), c)) == [0, None]


def test_rules(spark):
    inputs = ["διαμερισμα με αποθηκη", "studio apartment", "land for sale", "islands", "οικοπεδο", "γη", "γηπεδο", "nothing"]
    assert values(spark, inputs, lambda c: rules.first_match(c, rules.TYPE_RULES)) == ["apartment", "studio", "land", None, "land", "land", None, None]
    assert values(spark, inputs[:2], lambda c: F.array_join(rules.all_matches(c, rules.TYPE_RULES), ",")) == ["apartment,warehouse", "studio,apartment"]
    guarded = lambda c: rules.guarded_match(c, "veria|kilkis", r"\w*\.? *\d")
    assert values(spark, ["flat in veria", "veria 12", "veria 12 and kilkis", "none"], guarded) == [True, False, True, False]
    words = lambda c: rules.guarded_match(c, "the|and|der", " [a-z]{1,2} [a-z]+")
    assert values(spark, ["the a the", "the a the der", "thethe a b", "the", ""], words) == [False, True, True, True, False]


def test_words_looked_up_as_bytes_find_what_their_pattern_finds(spark):
    texts = ["flat", "flats", "a flat b", "μισθωσ", "for-rent", "for_rent", "forrent", "rental", "x rent", "results x", "x results", "print", "prints", "γη", "γηπεδο", "", None]
    patterns = [rules.RENT_WORDS, rules.SALE_WORDS, normalize.NOT_LISTING, normalize.LAND_WORDS, *[p for _, p in rules.TYPE_RULES], "a|(b)", r"\balpha\b"]
    for p in patterns:
        assert values(spark, texts, lambda c: rules.finds(c, p)) == values(spark, texts, lambda c: c.rlike(f"(?U){p}"))  # noqa: B023
    mixed = ["ΑΘΉΝΑΣ É", "ABC +%41", "Σ", "", None]
    assert values(spark, mixed, text.fold) == ["αθηνασ e", "abc +%41", "σ", "", None]
    assert values(spark, ["a+b", "a+%41", "%zz", "", None], text.unquote) == ["a+b", "a+A", "%zz", "", None]


def test_deals_and_types(spark):
    words = ["flat for rent or for sale", "for sale", "προσ ενοικιαση", "x", "x"]
    rows = list(zip(words, [None, "rent", None, "sale", None], [50_000.0, 1.0, None, 5.0, 9_999.0], strict=True))
    df = spark.createDataFrame(rows, "w string, f string, p double").coalesce(1)
    assert [r.y for r in df.select(rules.transaction_of(F.col("w"), F.col("f"), F.col("p")).alias("y")).collect()] == ["rent", "sale", "rent", "sale", "rent"]
    titles = ["μεσιτικο γραφειο αλφα | σπιτι", "γραφειο 50 τμ", "x"]
    assert values(spark, titles, lambda c: rules.type_of(c, F.lit(None).cast("string"), F.lit("/oikopedo/"))) == ["land", "office", "land"]
    assert values(spark, ["x"], lambda c: rules.type_of(c, F.lit("anything"), F.lit("/oikopedo/"))) == ["anything"]


def test_points_in_scripts(spark):
    pages = ["new LatLng( 40.6301 , 22.9512 )", "var lat = 50.1234; lng: 8.1234; data-lat='40.5' data-lat=\"40.5111\" data-lng='22.9111'", "none"]
    got = values(spark, pages, geo.script_point)
    assert [(p.lat, p.lon) if p else None for p in got] == [(40.6301, 22.9512), (40.5111, 22.9111), None]


def test_geometry(spark):
    ring = F.array(*[F.struct(F.lit(float(y)).alias("lat"), F.lit(float(x)).alias("lon")) for y, x in ((0, 0), (0, 4), (4, 4), (4, 0))])
    hole = F.array(*[F.struct(F.lit(float(y)).alias("lat"), F.lit(float(x)).alias("lon")) for y, x in ((1, 1), (1, 2), (2, 2), (2, 1))])
    inside = lambda c: geo.in_polygon(c, F.lit(1.5), F.array(ring, hole))
    assert values(spark, [0.5, 1.5, 3.0, 5.0], inside, "double") == [True, False, True, False]
    assert values(spark, [0.0], lambda c: geo.ring_size(ring) + c, "double") == [32.0]
    assert values(spark, [40.0], lambda c: geo.planar_km(c, F.lit(23.0), F.lit(40.0), F.lit(24.0)), "double") == [pytest.approx(84.36)]
