"""Reports of a run: counters per source, totals, histograms, budgets and rotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listwright.operators.ranges import ranked
from listwright.sources.shared import written

#: Rows that a report shows of each list.
TOP_ROWS = 300


def source_counters(diff: DataFrame, source: str, today: Column | None = None) -> DataFrame:
    """Per source, and in total (null source): listings, new, removed, down, up, checked today.

    ``checked_at`` of the diff says when a listing was last read; without it nothing was checked.
    """
    status = F.col("status")
    checked = (F.col("checked_at") == today) & (status != "gone") if today is not None else F.lit(False)
    return diff.rollup(source).agg(
        F.count_if(status != "gone").alias("listings"),
        *[F.count_if(status == s).alias(n) for s, n in (("new", "new"), ("gone", "removed"), ("down", "price_down"), ("up", "price_up"))],
        F.count_if(checked).alias("checked"),
    )


def totals(diff: DataFrame, *keys: str) -> DataFrame:
    """Counters at every level of ``keys`` in one pass: per row of all keys, per prefix of them, and over all.

    ``level`` says how many keys a row is for, so a key that is null is told from one that is summed over.
    """
    counts = [F.count_if(F.col("status") == s).alias(n) for s, n in (("new", "new"), ("gone", "removed"), ("down", "price_down"), ("up", "price_up"))]
    grouped = diff.rollup(*keys).agg(F.grouping_id().alias("_id"), F.count_if(F.col("status") != "gone").alias("listings"), *counts)
    return grouped.withColumn("level", F.lit(len(keys)) - F.bit_count("_id")).drop("_id")


def busiest_first(counters: DataFrame, source: str) -> DataFrame:
    moved = F.col("new") + F.col("removed") + F.col("price_down") + F.col("price_up")
    return counters.orderBy(F.desc(moved), F.desc("listings"), source)


def top_drops(changes: DataFrame, price: str = "new_value", old: str = "old_value", tie: str = "url", top: int = TOP_ROWS) -> DataFrame:
    return changes.filter(F.col(price) < F.col(old)).orderBy(F.col(price) / F.col(old), tie).limit(top)


def histogram_of_counts(df: DataFrame, key: str) -> DataFrame:
    """How many keys have how many rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def status_bucket(status: Column) -> Column:
    blocked = status.startswith("bot_check") | status.isin("403", "429", "http_403", "http_429")
    return F.when(blocked, F.lit("blocked")).otherwise(status)


def eligible_sources(registry: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Sources that may be read: working, with listings, not forbidden, one per domain; of a list, if given."""
    ok = (F.col("site_status") == "ok") & (F.col("has_listings").cast("string").isin("yes", "true")) & (F.coalesce("robots_ok", F.lit("")) != "explicit_no")
    if only:
        ok = ok & F.col("domain").isin(*only)
    w = Window.partitionBy("domain").orderBy("ord")
    return registry.filter(ok).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def due_for_recheck(df: DataFrame, today: Column, budget: int, site: str = "source_domain") -> DataFrame:
    """Each site's most overdue rows: unlinked after 2 days, linked after 7; unlinked and oldest first."""
    age = F.datediff(today, "checked_at")
    due = F.col("checked_at").isNull() | F.when(F.col("linked"), age >= 7).otherwise(age >= 2)
    w = Window.partitionBy(site).orderBy("linked", F.asc_nulls_first("checked_at"), "url")
    return df.filter(due).withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= budget)


def rotation(index: Column, day: Column, n: Column) -> Column:
    """A place in a cycle that moves on by one each day."""
    return F.pmod(index - F.datediff(day, F.lit("1970-01-01").cast("date")), n)


def fair_share(backlog: DataFrame, budget: int, cap: int, site: str = "site", waiting: str = "waiting") -> DataFrame:
    """Pages per site: ascending by backlog, each gets its share of what is left, at least one page.

    The fold over the sorted sites has a closed form. Up to the first site that wants more than its
    share, each gets what it wants; there the rest is dealt evenly, and the last sites get the pages
    that don't divide. Ranks and sums before a site run in ranges, so no task holds all sites.
    """
    wants = backlog.select(F.col(site).alias("s"), F.least(F.col(waiting), F.lit(cap)).cast("long").alias("c"), F.col(waiting).alias("w"))
    rows = written(ranked(wants, [F.col("w"), F.col("s")], ["c"]), "shares")
    n = rows.count()
    left, after = F.lit(budget) - F.col("c_before"), F.lit(n) - F.col("rank_")
    even = F.greatest(F.lit(1).cast("long"), F.floor(left / after).cast("long"))
    first = rows.filter(F.col("c") > even).orderBy("rank_").select("rank_", "c_before").first()
    if first is None:
        share = F.col("c")
    else:
        at, rest = first["rank_"], budget - first["c_before"]
        sites = n - at
        each, extra = (rest // sites, rest % sites) if rest >= sites else (1, 0)
        share = F.when(F.col("rank_") < at, F.col("c")).otherwise(F.when(after <= extra, F.lit(each + 1)).otherwise(F.lit(each)))
    return rows.select(F.col("s").alias(site), share.cast("long").alias("share"))


def last_due_start(slots: list[tuple[int, int] | int], now: Column, grace_hours: float, zone: str = "UTC") -> Column:
    """The latest scheduled start (hours, or hours and minutes in a zone) due before now less the grace, in UTC."""
    minutes = [s * 60 if isinstance(s, int) else s[0] * 60 + s[1] for s in slots]
    limit = now - F.make_dt_interval(mins=F.lit(int(grace_hours * 60)))
    midnight = F.date_trunc("DAY", F.from_utc_timestamp(limit, zone))
    starts = F.array(*[F.to_utc_timestamp(midnight + F.make_dt_interval(mins=F.lit(m - d * 1440)), zone) for m in minutes for d in (0, 1, 2)])
    return F.array_max(F.filter(starts, lambda s: s <= limit))


def last_row(log: DataFrame, at: str = "at") -> DataFrame:
    """The newest row of a log, by its own time."""
    return log.agg(F.max_by(F.struct(*log.columns), at).alias("r")).filter("r is not null").select("r.*")


def log_time(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm'Z'"))


def page_as_of(html: Column) -> Column:
    """The day that a published page says its data are of."""
    return F.try_to_date(F.regexp_extract(html, r'const ASOF = "(\d\d\.\d\d\.\d{4})"', 1), "dd.MM.yyyy")


def watchdog(runs: DataFrame, notes: DataFrame, page: DataFrame, now: Column, slots: list, grace_hours: float = 4, zone: str = "UTC") -> DataFrame:
    """One row: the last run, when it was due, and whether it is stale, failed steps, was not delivered, or isn't shown.

    ``runs(at, failed_steps)``, ``notes(at, messages, delivered)``, ``page(html)``: logs and the page as landed.
    """
    run = runs.agg(F.max_by(F.struct("at", "failed_steps"), "at").alias("run"))
    note = notes.agg(F.max_by(F.struct("at", "messages", "delivered"), "at").alias("note"))
    shown = page.agg(F.max(page_as_of(F.col("html"))).alias("shown"))
    at = log_time(F.col("run.at"))
    due = last_due_start(slots, now, grace_hours, zone)
    # Three single rows: aggregates without keys.
    return run.join(note).join(shown).select(
        F.col("run.at").alias("last_run"), due.alias("due"), (at.isNull() | (at < due)).alias("stale"),
        (F.coalesce("run.failed_steps", F.lit("")) != "").alias("failed"),
        F.coalesce((F.col("note.messages") != F.col("note.delivered")) & (log_time(F.col("note.at")) >= at), F.lit(False)).alias("undelivered"),
        F.coalesce(F.col("shown") < F.to_date(at), F.lit(False)).alias("not_shown"),
    )


def freshness(progress: DataFrame, now: Column, grace_hours: float) -> DataFrame:
    """Per stream, of its progress rows: batches with rows, rows, dropped rows, the newest event, whether that is young enough."""
    newest = F.max(F.try_to_timestamp("newest"))
    told = progress.groupBy("query").agg(F.count_if(F.col("rows") > 0).alias("batches"), F.sum("rows").alias("rows"), F.sum("dropped").alias("dropped"), newest.alias("newest"))
    return told.withColumn("fresh", F.coalesce(F.col("newest") >= now - F.make_dt_interval(mins=F.lit(int(grace_hours * 60))), F.lit(False)))


def run_summary(steps: DataFrame) -> DataFrame:
    """Minutes of a run, how many steps failed, and the names of all of them, in one cell."""
    failed = F.col("code") != 0
    names = F.collect_list(F.when(failed, F.col("name")))
    return steps.agg(F.bround(F.sum("seconds") / 60).cast("long").alias("minutes"), F.count_if(failed).alias("n_failed"), F.array_join(F.array_sort(names), ",").alias("failed"))


def sorted_rows(df: DataFrame, *order: str) -> DataFrame:
    """Rows in the order in which a sink writes them: by ranges, so files follow one another."""
    return df.orderBy(*order)


def language_prune(urls: DataFrame, site: str, url: str, local_share: float = 0.3) -> DataFrame:
    """Without URLs of translated paths, at sites where enough URLs are local."""
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    local = ~path.rlike(r"(?i)/(en|ru|de|bg|fr|it|zh|he|tr|sr|ro|uk|ar|nl|pl)(/|$)")
    marked = urls.withColumn("_local", local)
    shares = marked.groupBy(site).agg((F.count_if("_local") >= local_share * F.count(F.lit(1))).alias("_prune")).withColumnRenamed(site, "_site")
    kept = marked.join(shares, F.col(site) == F.col("_site")).filter(~F.col("_prune") | F.col("_local"))
    return kept.drop("_local", "_prune", "_site")


def to_fetch(urls: DataFrame, known: DataFrame, ignore: DataFrame, most_new: int, site: str = "source_domain") -> DataFrame:
    """Crawl URLs (site, url, lastmod, ord) with what to do: keep, refetch, fetch or skip.

    A known listing is read again only when the sitemap's day is later than the known one; new pages
    are read up to a budget per site in the crawl's order, pages known not to be listings never.
    """
    key = F.regexp_replace("url", "/+$", "")
    u = urls.withColumn("_key", key)
    k = known.select(F.regexp_replace("url", "/+$", "").alias("_known"), F.col("date_sitemap").alias("_had"))
    i = ignore.select(F.regexp_replace("url", "/+$", "").alias("_ignored")).distinct()
    joined = u.join(k, F.col("_key") == F.col("_known"), "left").join(i, F.col("_key") == F.col("_ignored"), "left")
    newer = F.col("lastmod").isNotNull() & (F.col("_had").isNull() | (F.col("lastmod") > F.col("_had")))
    reads = F.col("_known").isNotNull() & newer | F.col("_known").isNull() & F.col("_ignored").isNull()
    # A site's running count of reads, from ranges of all sites' order: no site is one task's.
    own = joined.columns
    placed = ranked(joined.withColumn("_reads", reads.cast("long")), [F.col(site), F.col("ord"), F.col("url")], ["_reads"]).drop("rank_")
    starts = placed.groupBy(F.col(site).alias("_site")).agg(F.min("_reads_before").alias("_start"))
    joined = placed.join(starts, F.col(site).eqNullSafe(F.col("_site")))
    turn = F.col("_reads_before") - F.col("_start") + F.col("_reads")
    todo = (
        F.when(F.col("_known").isNotNull() & ~newer, F.lit("keep"))
        .when(F.col("_known").isNotNull(), F.lit("refetch"))
        .when(F.col("_ignored").isNotNull() | (turn > most_new), F.lit("skip"))
        .otherwise(F.lit("fetch"))
    )
    return joined.withColumn("todo", todo).select(*own, "todo").drop("_key", "_known", "_had", "_ignored")


def report_document(counters: DataFrame, run_at: str) -> DataFrame:
    """One JSON document of a report (sources are few)."""
    return counters.agg(F.to_json(F.struct(F.lit(run_at).alias("at"), F.array_sort(F.collect_list(F.struct(*counters.columns))).alias("sources"))).alias("report"))
