"""Paged search with pushed filters, and channels read backwards over restarts."""

import json
import os

import pytest
from listwright.sources import paged

PAGE = 3


@pytest.fixture
def search(spark, tmp_path):
    """Two sites of two segments, seven items each: two full pages and a short one; a fourth page must not be read."""
    paged.register(spark)
    for site in ("a.gr", "b.gr"):
        for segment in ("bank", "auction"):
            folder = tmp_path / site / segment
            os.makedirs(folder)
            for p in (1, 2, 3, 4):
                items = [{"id": f"{site}/{segment}/{p}/{k}", "coordinates": [40 + k, 22 + p]} for k in range(PAGE if p != 3 else 1)]
                (folder / f"{p}.json").write_text(json.dumps({"data": {"listings": items}}))
    return (lambda: paged.searched(spark, str(tmp_path), per_page=PAGE)), tmp_path


def ids(df):
    return sorted(json.loads(r.item)["id"] for r in df.collect() if r.item)


def test_pages_are_read_up_to_the_short_one(search):
    load, _ = search
    assert len(ids(load())) == 4 * 7 and load().filter("page > 3").count() == 0


def test_filters_go_to_the_source(search):
    load, _ = search
    only = load().filter("segment = 'bank' and source in ('a.gr') and lat >= 41 and lat <= 42 and lon <= 23.5")
    assert ids(only) == ["a.gr/bank/1/1", "a.gr/bank/1/2"]
    assert only.rdd.getNumPartitions() == 1 and load().rdd.getNumPartitions() == 4
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "bank" not in plan and "41" not in plan  # nothing of it is left to Spark
    reader = paged.SearchReader({"path": "x"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThanOrEqual

    left = list(reader.pushFilters([EqualTo(("segment",), "bank"), GreaterThanOrEqual(("lat",), 40.0), LessThanOrEqual(("lat",), 41.0), GreaterThan(("page",), 1), EqualTo(("item",), "x")]))
    assert [type(f).__name__ for f in left] == ["GreaterThan", "EqualTo"] and reader.bounds == {("lat", "low"): 40.0, ("lat", "high"): 41.0}


def test_a_failing_source_leaves_the_others(search):
    load, root = search
    (root / "b.gr" / "bank" / "2.json").write_text("{broken")
    (root / "b.gr" / "auction" / "1.json").write_text('{"data": null}')
    rows = load().collect()
    failed = [r for r in rows if r.error]
    assert [(r.source, r.segment, r.page) for r in failed] == [("b.gr", "bank", 2)] and failed[0].error.startswith("JSONDecodeError")
    assert len([r for r in rows if r.source == "a.gr"]) == 14
    assert load().filter("segment = 'bank' and lat >= 40 and lon >= 0").filter("error is not null").count() == 1  # also behind a box
    assert paged.SearchReader({"path": str(root), "pages": "1"}).partitions()[0].pages == 1


def test_no_search_fits(search):
    load, _ = search
    assert load().filter("segment = 'rent'").count() == 0


def test_each_post_is_read_once_over_restarts(spark, tmp_path):
    paged.register(spark)
    root, out = tmp_path / "channels", str(tmp_path / "out")
    for name, n in (("x", 95), ("y", 30), ("empty", 0)):
        os.makedirs(root / name)
        posts, before = list(range(n, 0, -1)), "newest"
        for k in range(0, max(n, 1), 10):
            page = posts[k : k + 10]
            (root / name / f"{before}.html").write_text("".join(f'<div data-post="{name}/{p}">text {p}</div>' for p in page))
            before = min(page, default=0)

    def run(pages):
        source = spark.readStream.format("channel_posts").options(batch_pages=2, pages=pages).load(str(root))
        stream = source.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").start(out)
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()
        got = [(r.channel, r.post) for r in spark.read.schema("channel string, post long, html string").parquet(out).collect()]
        assert len(got) == len(set(got))
        return {c: sorted(p for k, p in got if k == c) for c in ("x", "y", "empty")}

    assert run(3) == {"x": list(range(66, 96)), "y": list(range(1, 31)), "empty": []}
    assert run(7)["x"] == list(range(26, 96))
    assert run(50) == run(50) == {"x": list(range(1, 96)), "y": list(range(1, 31)), "empty": []}


def test_listed_pages_are_planned_unread_and_dealt_to_tasks(tmp_path, monkeypatch):
    os.makedirs(tmp_path / "x")
    for k in range(100):
        page = range(1000 - 10 * k, 990 - 10 * k, -1)
        (tmp_path / "x" / f"{page[0] + 1 if k else 'newest'}.html").write_text("".join(f'<div data-post="x/{p}">{p}</div>' for p in page))
    (tmp_path / "x" / "946.html").write_text("".join(f'<div data-post="x/{p}">{p}</div>' for p in range(945, 935, -1)))  # another run's
    reader = paged.ChannelReader({"path": str(tmp_path), "batch_pages": "3", "pages": "1000"})
    with monkeypatch.context() as m:
        m.setattr(paged, "landed_before", None)
        at, ranges, batches = reader.initialOffset(), [], 0
        while (following := reader.latestOffset()) != at:
            ranges += reader.partitions(at, following)
            at, batches = following, batches + 1
    assert at["x"][0] == -1 and batches == 6 and len(ranges) == 34  # of 101 pages in threes; batches of 3, 6, 12, 24, 48, 8
    posts = [[p for _, p, _ in reader.read(r)] for r in ranges]
    assert max(map(len, posts)) <= 30 and sorted(p for ps in posts for p in ps) == list(range(1, 1001))


def test_pages_that_cannot_be_listed_are_walked(tmp_path):
    os.makedirs(tmp_path / "x")
    for name, page in (("newest", (9, 8)), ("8", (7, 6)), ("6", (5,))):
        (tmp_path / "x" / f"{name}.html").write_text("".join(f'<div data-post="x/{p}">{p}</div>' for p in page))
    reader = paged.ChannelReader({"path": str(tmp_path), "fetcher": "listwright.sources.paged.landed_before", "batch_pages": "2"})
    at = reader.initialOffset()
    first = reader.latestOffset()
    assert first == {"x": [6, 2]} and [p for r in reader.partitions(at, first) for _, p, _ in reader.read(r)] == [9, 8, 7, 6]
