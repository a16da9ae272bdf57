"""Which pages of a site to read: a bounded walk over its links, breadth first, level by level.

A site's queue begins with its sections in their order; a page that is read adds the links on it, in theirs,
and a page is read once. What a queue gives first is what has the smallest (place of the page that added it,
place of the link on it), so a level of all sites is one join with the table of links, an anti join with what
was seen, and a rank under a limit. There are as many levels as the longest walk has, at most one a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listwright.sources.shared import removed, written

# Pages of a site that are read for links, and sections that a walk begins with.
MOST_PAGES, MOST_SECTIONS = 12, 6


def walked(links: DataFrame, sections: DataFrame, most_pages: int = MOST_PAGES, most_sections: int = MOST_SECTIONS) -> DataFrame:
    """(host, url, turn) of the pages that are read, in their turn from 0.

    ``sections(host, url, place)`` and ``links(host, url, place, target)``; a target of another host isn't in
    the table. Rows with a null host, page or target lead nowhere, repeated ones count once.
    """
    first = sections.filter("host is not null and url is not null").groupBy("host", "url").agg(F.min("place").alias("place"))
    by = Window.partitionBy("host").orderBy("place", "url")
    frontier = written(first.withColumn("turn", F.row_number().over(by) - 1).filter(F.col("turn") < min(most_sections, most_pages)).select("host", "url", "turn"), "walk")
    seen, level = frontier, links.filter("target is not null").select(F.col("host").alias("h_"), F.col("url").alias("u_"), "place", "target")
    while True:
        found = frontier.join(level, (F.col("host") == F.col("h_")) & (F.col("url") == F.col("u_"))).groupBy("host", F.col("target").alias("url")).agg(F.min(F.struct("turn", "place")).alias("by_"))
        new = found.join(seen.select("host", "url"), ["host", "url"], "left_anti")
        # How far each site is: all that was seen has a turn, so the next is their number.
        at = seen.groupBy("host").agg(F.count(F.lit(1)).alias("at_"))
        order = Window.partitionBy("host").orderBy("by_", "url")
        ranked = new.withColumn("rank_", F.row_number().over(order)).filter(F.col("rank_") <= most_pages).join(at, "host")
        following = written(ranked.withColumn("turn", (F.col("at_") + F.col("rank_") - 1).cast("int")).filter(F.col("turn") < most_pages).select("host", "url", "turn"), "walk")
        if following.isEmpty():
            return seen
        last, seen = seen, written(seen.unionByName(following), "walked")
        if last is not frontier:
            removed(last)
        frontier = following
