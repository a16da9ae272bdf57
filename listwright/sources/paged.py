"""Paged sources as Spark data sources: a search API read page by page, and a channel read backwards.

``PagedSearch`` is a batch source of one row per item. A partition is a source's segment, read page by page
until a short page. Filters on source, segment and box go to the source: the first two choose the
partitions, the box goes with each request. A source that fails gives one row that says so, and leaves the
others as they are.

``ChannelPosts`` is a streaming source of one row per post. A channel is read backwards from its newest page,
each page before the lowest number of the one before; its offset is that number, so a stream that stops goes
on from its checkpoint and reads each post once. Pages newer than those read are another run's. Where the
numbers that pages end before can be listed, as those of landed pages can, no page is read to plan a batch,
a batch's pages are read by many tasks, and batches double, so their number grows with the logarithm.

Both ask a ``fetcher`` for pages, by default that of landed files: a dotted name of a function, so that it
can be found where the tasks are.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module
from operator import neg

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual

# Items of a full page, and pages that are read of one search at most.
PER_PAGE, MOST_PAGES = 250, 40
#: Pages of a channel that one micro-batch reads, and of one run.
BATCH_PAGES, RUN_PAGES = 5, 15


def fetcher_of(name: str):
    module, _, function = name.rpartition(".")
    return getattr(import_module(module), function)


def _text(path: str) -> str | None:
    """A file by its path or address, on any file system that Arrow knows; None if there is none."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(at) as f:
        return f.read().decode()


def _names(path: str) -> list[str]:
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(at, allow_not_found=True)))


def landed_page(root: str, source: str, segment: str, box: list[float] | None, page: int) -> list[dict]:
    """The items of a page landed as ``root/source/segment/page.json``; none if it doesn't exist."""
    raw = _text(f"{root}/{source}/{segment}/{page}.json")
    return (json.loads(raw).get("data") or {}).get("listings") or [] if raw is not None else []


def landed_searches(root: str) -> list[tuple[str, str]]:
    """(source, segment) of all landed pages."""
    return [(s, g) for s in _names(root) for g in _names(f"{root}/{s}")]


def inside(point: list | None, box: list[float]) -> bool:
    return bool(point) and None not in point[:2] and box[0] <= point[0] <= box[1] and box[2] <= point[1] <= box[3]


@dataclass
class Search(InputPartition):
    """One source's segment, the box that is asked for, and the pages to read at most."""

    source: str
    segment: str
    box: list[float] | None
    pages: int


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.fetcher = options["path"], options.get("fetcher", f"{__name__}.landed_page")
        self.searches = options.get("searches", f"{__name__}.landed_searches")
        self.full, self.pages = int(options.get("per_page", PER_PAGE)), int(options.get("pages", MOST_PAGES))
        self.only: dict[str, set] = {}
        self.bounds: dict[tuple[str, str], float] = {}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  the interface's name
        """Takes equality of source and segment, and bounds of the point; gives the others back."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, EqualTo | In) and name in ("source", "segment"):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[name] = self.only[name] & wanted if name in self.only else wanted
            elif isinstance(f, GreaterThanOrEqual) and name in ("lat", "lon"):
                self.bounds[name, "low"] = max(f.value, self.bounds.get((name, "low"), f.value))
            elif isinstance(f, LessThanOrEqual) and name in ("lat", "lon"):
                self.bounds[name, "high"] = min(f.value, self.bounds.get((name, "high"), f.value))
            else:
                yield f

    def partitions(self) -> list[Search]:
        box = None
        if self.bounds:
            box = [self.bounds.get((c, e), v) for c in ("lat", "lon") for e, v in (("low", float("-inf")), ("high", float("inf")))]
        wanted = lambda name, v: name not in self.only or v in self.only[name]
        return [Search(s, g, box, self.pages) for s, g in fetcher_of(self.searches)(self.root) if wanted("source", s) and wanted("segment", g)] or [Search("", "", box, 0)]

    def read(self, partition: Search) -> Iterator[tuple]:
        fetch, page = fetcher_of(self.fetcher), 0
        try:
            for page in range(1, partition.pages + 1):
                items = fetch(self.root, partition.source, partition.segment, partition.box, page)
                for k, x in enumerate(items):
                    point = x.get("coordinates") or [None, None]
                    if partition.box is None or inside(point, partition.box):
                        yield partition.source, partition.segment, page, k, point[0], point[1], json.dumps(x, ensure_ascii=False), None
                if len(items) < self.full:
                    return
        except Exception as failure:  # noqa: BLE001  whatever a source does, the others go on
            at = (partition.box[0], partition.box[2]) if partition.box and float("-inf") not in partition.box else (None, None)
            yield partition.source, partition.segment, page, None, *at, None, f"{type(failure).__name__}: {failure}"


class PagedSearch(DataSource):
    """``spark.read.format("paged_search").load(root)``: source, segment, page, place, lat, lon, item (JSON), error."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "source string, segment string, page int, place int, lat double, lon double, item string, error string"

    def reader(self, schema) -> SearchReader:
        return SearchReader(self.options)


def landed_before(root: str, channel: str, before: int | None) -> tuple[str | None, int | None]:
    """A channel's page before a number (the newest without one), landed as ``root/channel/<before or newest>.html``; and the lowest post of it."""
    raw = _text(f"{root}/{channel}/{'newest' if before is None else before}.html")
    ids = [int(x) for x in re.findall(r'data-post="[^"/]+/(\d+)"', raw or "")]
    return raw, min(ids, default=None)


def landed_channels(root: str) -> list[str]:
    return _names(root)


def landed_marks(root: str, channel: str) -> list[int]:
    """The numbers that a channel's landed pages end before, by their names alone, highest first."""
    named = (n.removesuffix(".html") for n in _names(f"{root}/{channel}"))
    return sorted((int(n) for n in named if n.isdecimal()), reverse=True)


#: A batch of listed pages is at most so many times the first one.
MOST_GROWTH = 1024


@dataclass
class Pages(InputPartition):
    """A channel's posts before one number (the newest without one), down to another or its end (-1); the pages between, if listed."""

    channel: str
    before: int | None
    until: int
    marks: list[int] | None = None


class ChannelReader(DataSourceStreamReader):
    """Offsets are a number a channel: the lowest post that was read. Null is the newest page, -1 that nothing is left.

    ``batch_pages`` is what a task reads of a channel, and what a run's first batch does; each batch after
    it reads up to twice as much, where ``marks`` lists the numbers. Without, each page is looked at here.
    """

    def __init__(self, options: dict):
        self.root, self.fetcher = options["path"], options.get("fetcher", f"{__name__}.landed_before")
        self.channels = options.get("channels", f"{__name__}.landed_channels")
        self.lister = options.get("marks", "" if "fetcher" in options else f"{__name__}.landed_marks")
        self.batch, self.most = int(options.get("batch_pages", BATCH_PAGES)), int(options.get("pages", RUN_PAGES))
        self.at: dict | None = None
        self.growth, self.listed = 1, {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {c: [None, 0] for c in fetcher_of(self.channels)(self.root)}

    def marks(self, channel: str, before: int | None, until: int = -1) -> list[int]:
        """The listed numbers between two, highest first."""
        if channel not in self.listed:
            self.listed[channel] = fetcher_of(self.lister)(self.root, channel)
        found = self.listed[channel]
        first = 0 if before is None else bisect_right(found, -before, key=neg)
        return found[first : bisect_left(found, -until, key=neg)]

    def latestOffset(self) -> dict:  # noqa: N802
        """Some pages further down each channel."""
        self.at = self.at if self.at is not None else self.initialOffset()
        following = {}
        for channel, (before, pages) in self.at.items():
            if self.lister and before != -1 and pages < self.most:
                n, below = min(self.batch * self.growth, self.most - pages), self.marks(channel, before)
                before, pages = (below[n - 1], pages + n) if len(below) >= n else (-1, pages + len(below) + 1)
            for _ in range(0 if self.lister else self.batch):
                if before == -1 or pages >= self.most:
                    break
                raw, low = fetcher_of(self.fetcher)(self.root, channel, before)
                before, pages = (low, pages + 1) if raw is not None and low is not None and low != before else (-1, pages)
            following[channel] = [before, pages]
        if following != self.at:
            self.growth = min(2 * self.growth, MOST_GROWTH)
        return following

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        self.at = end  # a restarted stream asks for its last batch first
        found = []
        for c, (until, _) in end.items():
            before = start.get(c, [None, 0])[0]
            if before == until:
                continue
            if not self.lister:
                found.append(Pages(c, before, until))
                continue
            edges = [before, *self.marks(c, before, until)]
            for k in range(0, len(edges), self.batch):
                found.append(Pages(c, edges[k], [*edges, until][min(k + self.batch, len(edges))], edges[k + 1 : k + self.batch]))
        return found

    def read(self, partition: Pages) -> Iterator[tuple]:
        before, marks = partition.before, partition.marks
        following = [*marks, partition.until] if marks is not None else None
        while before != partition.until:
            raw, low = fetcher_of(self.fetcher)(self.root, partition.channel, before)
            if following is not None:
                low = following.pop(0)  # each listed page gives what the next one doesn't
            elif raw is None or low is None or low == before:
                return
            for block in re.split(r'(?=data-post=")', raw or "")[1:]:
                post = int(re.match(r'data-post="[^"/]+/(\d+)"', block)[1])
                if post >= low:
                    yield partition.channel, post, block
            before = low

    def commit(self, end: dict) -> None:
        self.at = end


class ChannelPosts(DataSource):
    """``spark.readStream.format("channel_posts").load(root)``: channel, post, html of each post."""

    @classmethod
    def name(cls) -> str:
        return "channel_posts"

    def schema(self) -> str:
        return "channel string, post long, html string"

    def streamReader(self, schema) -> ChannelReader:  # noqa: N802
        return ChannelReader(self.options)


def register(spark) -> None:
    """Both sources under their names; filters are pushed to Python sources only where that is switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSearch)
    spark.dataSource.register(ChannelPosts)


def searched(spark, root: str, **options):
    """The search's rows. Spark keeps what it pushed to a loaded source, so each query loads its own."""
    return spark.read.format("paged_search").options(**options).load(root)


def land(pages, root: str) -> None:
    """Writes rows (name, body) as files under a folder, each task its own."""
    import pyarrow as pa

    def run(batches):
        from pyarrow import fs

        made = set()
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{root}/{name}"
                system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                folder = at.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(at) as f:
                    f.write(body.encode())
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["name"])

    pages.select("name", "body").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()
