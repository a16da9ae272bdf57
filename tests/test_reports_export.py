"""The packed export, the walk over links, reports and their plans, against brute force."""

import datetime as dt
import json
import math
import random

from listwright.functions.text import label_ok
from listwright.operators import crawling, gold, matching, packed, reporting, spatial
from listwright.sources import feeds
from pyspark.sql import functions as F


def walk(links, sections, most_pages, most_sections):
    """A queue, page by page."""
    out = {}
    for host in {h for h, *_ in sections}:
        queue = list(dict.fromkeys(u for h, u, _ in sorted(sections, key=lambda s: (s[2], s[1])) if h == host))[:most_sections]
        seen = []
        while queue and len(seen) < most_pages:
            url = queue.pop(0)
            if url in seen:
                continue
            seen.append(url)
            queue += [t for h, u, _, t in sorted(links, key=lambda x: x[2]) if h == host and u == url]
        out[host] = seen
    return out


def test_the_walk_is_that_of_a_queue(spark):
    rng = random.Random(2)
    links = [(f"h{h}", f"p{u}", place, f"p{rng.randrange(40)}") for h in range(6) for u in range(40) for place in range(rng.choice([0, 2, 3]))]
    sections = [(f"h{h}", f"p{rng.randrange(40)}", k) for h in range(6) for k in range(8)]
    rows = spark.createDataFrame([*links, links[0], (None, "p1", 0, "p2"), ("h0", None, 0, "p2"), ("h0", "p1", 9, None)], "host string, url string, place int, target string")
    begin = spark.createDataFrame([*sections, sections[0], (None, "p1", 0), ("h9", None, 1)], "host string, url string, place int")
    for most_pages, most_sections in ((12, 6), (3, 6), (40, 1)):
        got = crawling.walked(rows, begin, most_pages, most_sections).collect()
        by = {h: [r.url for r in sorted((r for r in got if r.host == h), key=lambda r: r.turn)] for h in {r.host for r in got}}
        assert by == walk(links, sections, most_pages, most_sections)
        assert all(sorted(r.turn for r in got if r.host == h) == list(range(len(by[h]))) for h in by)
    assert crawling.walked(rows, begin.limit(0)).count() == 0


def test_what_is_packed_is_unpacked(spark):
    rows = [
        (1, "x", "x", dt.date(2020, 1, 3), "https://a.example/1", 2.0, 'q"\\', None), (2, "y", "", None, "not a link", 2.5, "", None),
        (3, None, "y", dt.date(2019, 12, 31), "http://b.example", None, "é😀\n", None), (4, None, None, None, None, None, None, None), (5, "x", "z", None, "https://a.example/?q=[1,2]", -3.0, "[1]", None),
    ]
    schema = "k long, a string, b string, day date, link string, n double, t string, never string"
    got = packed.pack(spark.createDataFrame(rows, schema), "k", ["a", "b"], ["day"], ["link"], ["n", "t", "never"])
    assert got.keys == ["link", "a", "b", "n", "t", "day"]  # by fill, then as given; what is never filled is left out
    assert [r.value for r in got.strings.orderBy("code").collect()] == ["x", "https://a.example/", "y", "", "http://b.example", "z"]
    told = {r.k: json.loads(r.row) for r in got.rows.collect()}
    assert told[1] == [[1, "1"], 0, 0, 2, 'q"\\', 2] and told[2] == [[3, "not a link"], 2, None, 2.5] and told[3] == [[4, ""], None, 2, None, "é😀\n", -1] and told[4] == []
    back = {r.k: r for r in packed.unpacked(got, "k").collect()}
    for k, a, b, day, link, n, t, _ in rows:
        assert (back[k].a, back[k].b, back[k].day, back[k].link, back[k].n, back[k].t) == (a, b or None, day, link, n, t or None)
    docs = {r.name: (r.n, json.loads(r.body)) for r in packed.documents(got, 2).collect()}
    assert {k: n for k, (n, _) in docs.items()} == {"rows-000000.json": 2, "rows-000001.json": 2, "rows-000002.json": 1, "strings-000000.json": 2, "strings-000001.json": 2, "strings-000002.json": 2}
    assert [x for k in sorted(docs) if k.startswith("rows") for x in docs[k][1]] == [told[k] for k in sorted(told)]
    empty = packed.pack(spark.createDataFrame([], schema), "k", ["a"], ["day"], ["link"], ["n"])
    assert empty.keys == [] and packed.unpacked(empty, "k").count() == 0 and packed.documents(empty).count() == 0


def test_analogs_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([10.0, 13.0, 13.1, 20.0, 26.0, float(rng.randrange(1, 200))])) for i in range(400)] + [(900, "a", None), (901, "a", 0.0), (902, "a", -1.0)]
    got = {r.k: r.analogs for r in spatial.analog_counts(spark.createDataFrame(rows, "k long, s string, m double"), ["s"], "k", "m").collect()}
    good = [r for r in rows if r[2] and r[2] > 0]
    # As far apart in logarithms as the share says, in the order in which the window compares them.
    near = lambda x, y: math.log(x) - math.log1p(0.3) <= math.log(y) <= math.log(x) + math.log1p(0.3)
    assert got == {i: sum(near(m, n) for _, t, n in good if t == s) - 1 for i, s, m in good}


def test_top_hits_and_their_plan(spark):
    hits = [("f", i, float(p) if p else None) for i, p in enumerate([5, None, 3, 3, 9, 1])] + [("g", 1, None), (None, 2, 1.0)]
    rows = spark.createDataFrame([((n,), (i, p)) for n, i, p in hits], "f struct<name: string>, p struct<id: long, price: double>")
    top = matching.top_hits(rows, 3)
    got = sorted((r.f.name or "", r["rank"], r.p.id, r.hits, r.more) for r in top.collect())
    assert got == [("", 1, 2, 1, 0), ("f", 1, 5, 6, 3), ("f", 2, 2, 6, 3), ("f", 3, 3, 6, 3), ("g", 1, 1, 1, 0)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_reads_of_a_site_are_counted_over_its_order(spark):
    urls = spark.createDataFrame([("s", f"u{i}/", None, i) for i in range(30)] + [("t", f"t{i}", None, i) for i in range(3)] + [(None, "n", None, 1)], "source_domain string, url string, lastmod date, ord int")
    known = spark.createDataFrame([("u3", None), ("u5/", None)], "url string, date_sitemap date")
    got = {r.url: r.todo for r in reporting.to_fetch(urls, known, spark.createDataFrame([("u0",)], "url string"), 4).collect()}
    assert [got[f"u{i}/"] for i in range(9)] == ["skip", "fetch", "fetch", "keep", "fetch", "keep", "fetch", "skip", "skip"]
    assert [got[f"t{i}"] for i in range(3)] == ["fetch"] * 3 and got["n"] == "fetch" and len(got) == 34


def test_totals_tell_unknown_sources_from_sums(spark):
    rows = [("r", "a", "new"), ("r", None, "gone"), ("r", None, "down"), (None, "a", "up"), ("r", "a", "same")]
    got = {(r.region, r.source, r.level): (r.listings, r.new, r.removed, r.price_down, r.price_up) for r in reporting.totals(spark.createDataFrame(rows, "region string, source string, status string"), "region", "source").collect()}
    assert got == {
        ("r", "a", 2): (2, 1, 0, 0, 0), ("r", None, 2): (1, 0, 1, 1, 0), ("r", None, 1): (3, 1, 1, 1, 0), (None, "a", 2): (1, 0, 0, 0, 1), (None, None, 1): (1, 0, 0, 0, 1), (None, None, 0): (4, 1, 1, 1, 1),
    }


def test_eligible_and_busiest_sources(spark):
    rows = [("a", 2, "ok", "yes", None), ("a", 1, "ok", "true", "ok"), ("b", 1, "dead", "yes", None), ("c", 1, "ok", "no", None), ("d", 1, "ok", "yes", "explicit_no"), ("e", 1, "ok", "yes", "unknown"), ("f", 1, None, "yes", None)]
    registry = spark.createDataFrame(rows, "domain string, ord int, site_status string, has_listings string, robots_ok string")
    assert sorted((r.domain, r.ord) for r in reporting.eligible_sources(registry).collect()) == [("a", 1), ("e", 1)]
    assert [r.domain for r in reporting.eligible_sources(registry, ["e", "b"]).collect()] == ["e"]
    counters = spark.createDataFrame([("x", 5, 1, 0, 0, 0), ("y", 9, 0, 1, 0, 0), ("z", 1, 1, 1, 1, 1), ("a", 5, 0, 0, 1, 0)], "s string, listings int, new int, removed int, price_down int, price_up int")
    assert [r.s for r in reporting.busiest_first(counters, "s").collect()] == ["z", "y", "a", "x"]


def test_small_expressions(spark):
    df = spark.createDataFrame([("https://a.example/b/c?x", "ab-9"), ("none", "A"), ("", "x" * 41), (None, None)], "url string, label string")
    assert [tuple(r) for r in df.select(gold.split_url(F.col("url"))["prefix"], gold.split_url(F.col("url"))["rest"], label_ok(F.col("label"))).collect()] == [("https://a.example/b/", "c?x", True), ("", "none", False), ("", "", False), (None, None, None)]
    fields = spark.createDataFrame([({"a": "1", "b": None, "c": ""},), ({},)], "m map<string,string>")
    assert [r[0] for r in fields.select(gold.drop_empty(F.col("m"))).collect()] == [{"a": "1"}, {}]
    days = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 4, 30),), (None,)], "date_published date")
    assert [r[0] for r in feeds.within_window(days, F.lit("2024-04-30").cast("date"), 120).collect()] == [dt.date(2024, 1, 1), dt.date(2024, 4, 30)]
    assert feeds.within_window(days, F.lit("2024-05-01").cast("date"), 120).count() == 1


def test_a_runs_failed_steps(spark):
    steps = spark.createDataFrame([("b", 90, 1), ("a", 60, 2), ("c", 30, 0)], "name string, seconds int, code int")
    assert tuple(reporting.run_summary(steps).first()) == (3, 2, "a,b")
    assert tuple(reporting.run_summary(steps.filter("code = 0")).first()) == (0, 0, "")
    many = spark.range(1000).selectExpr("cast(id as string) as name", "1L as seconds", "1 as code")
    assert reporting.run_summary(many).first().failed == ",".join(sorted(str(i) for i in range(1000)))


def test_json_of_any_depth(spark):
    from listwright.functions import json_walk

    deep = json.loads('{"a":' * 60 + "1" + "}" * 60)
    docs = {1: deep, 2: {"offers": [{"price": "7"}, {"price": 8, "x": [[True, None], []]}], "e": {}, "o": {"price": "9"}}, 3: 5, 4: [], 5: "é \" \\"}

    def leaves(x, path):
        if isinstance(x, dict):
            return [y for k, v in x.items() for y in leaves(v, f"{path}.{k}")]
        if isinstance(x, list):
            return [y for i, v in enumerate(x) for y in leaves(v, f"{path}[{i}]")]
        return [(path, x)]

    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [(6, "{broken"), (7, None), (8, "")]
    found = json_walk.leaves(spark.createDataFrame(rows, "k long, j string"), "k", "j")
    said = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    assert sorted(((r.k, r.path, r.value) for r in found.collect()), key=str) == sorted(((k, p, said(v)) for k, d in docs.items() for p, v in leaves(d, "$")), key=str)
    assert {r.k: r.price for r in json_walk.first_of(found, "k", {"price": r"\.price"}).collect() if r.price} == {2: "9"}
