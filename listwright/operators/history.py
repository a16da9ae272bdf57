"""What listings did over time: first and last seen, price changes, differences of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Bands of price changes that are reported or alerted.
MOST_REPORTED, LEAST_DROP, MOST_DROP, DROP_DAYS = 0.5, 0.01, 0.5, 3
BROKEN_KNOWN, BROKEN_SHARE = 20, 0.5
FORGET_DAYS = 45


def seen_merge(history: DataFrame, seen: DataFrame) -> DataFrame:
    """url, first_seen, last_seen of both; order of arrival doesn't matter."""
    cols = ("url", "first_seen", "last_seen")
    return history.select(*cols).unionByName(seen.select(*cols)).groupBy("url").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def price_changes(prices: DataFrame, key: str, order: list[str], price: str) -> DataFrame:
    """Rows whose price differs from the key's previous one, with it and a ``reportable`` flag.

    Changes above the band stay in the history, and the next one is compared with them.
    """
    w = Window.partitionBy(key).orderBy(*order)
    old = F.lag(price).over(w)
    df = prices.filter(F.col(price).isNotNull()).withColumn("old_price", old)
    df = df.filter(~F.col(price).eqNullSafe(F.col("old_price")))
    return df.withColumn("reportable", F.col("old_price").isNotNull() & (F.abs(F.col(price) - F.col("old_price")) <= MOST_REPORTED * F.col("old_price")))


def last_drops(changes: DataFrame, key: str, order: list[str], price: str, since: Column, day: str) -> DataFrame:
    """Keys whose last change, since a day, lowered the price within the alert band."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    last = changes.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    share = 1 - F.col(price) / F.col("old_price")
    return last.filter(F.col("old_price").isNotNull() & (F.col(day) >= since) & share.between(LEAST_DROP, MOST_DROP))


def group_drops(drops: DataFrame, members: DataFrame, key: str, price: str) -> DataFrame:
    """(property, key, old, new): of a property's members that dropped, the one with the lowest new price.

    ``members(property_id, key)`` say which listings are one property.
    """
    held = drops.join(members.select("property_id", F.col(key).alias("_member")), F.col(key) == F.col("_member"))
    best = F.min_by(F.struct(key, "old_price", F.col(price).alias("new_price")), F.struct(price, key))
    return held.groupBy("property_id").agg(best.alias("b")).select("property_id", "b.*")


def history_lists(history: DataFrame, key: str, day: str, price: str) -> DataFrame:
    """(key, history): a listing's [day, price] in order, where the price changed at least once."""
    lists = history.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(day, price))).alias("history"))
    return lists.filter(F.size("history") > 1)


def with_history(listings: DataFrame, history: DataFrame, key: str, day: str, price: str) -> DataFrame:
    """Listings with their price history, null where the price never changed."""
    lists = history_lists(history, key, day, price).withColumnRenamed(key, "_key")
    return listings.join(lists, F.col(key) == F.col("_key"), "left").drop("_key")


def removal_reasons(gone: DataFrame, log: DataFrame, key: str, month: Column) -> DataFrame:
    """Gone rows with the reason logged last in the month, null without one. ``log(key, date, reason)``."""
    last = log.filter(F.col("date") >= F.trunc(month, "month")).groupBy(F.col(key).alias("_key")).agg(F.max_by("reason", F.struct("date", "reason")).alias("reason"))
    return gone.join(last, F.col(key) == F.col("_key"), "left").drop("_key")


def completed_parts(progress: DataFrame, part: str, expected: str, read: str) -> DataFrame:
    """Parts whose pages were all read: the completeness table that ``removed`` needs."""
    return progress.groupBy(part).agg(F.max(expected).alias("pages"), F.count_distinct(read).alias("read")).filter(F.col("read") >= F.col("pages")).select(part)


def forgotten(df: DataFrame, seen: str, today: Column, days: int = FORGET_DAYS) -> DataFrame:
    """Without rows that weren't seen for so many days; rows never dated stay."""
    return df.filter(F.col(seen).isNull() | (F.col(seen) >= F.date_sub(today, days)))


def hint_due(listings: DataFrame, hints: DataFrame, today: Column, portals: list[str], generic: str, found_days: int = 60, empty_days: int = 7) -> DataFrame:
    """Listings whose page is to be read for a district: vague or guessed ones, not portals', not read lately."""
    vague = F.col("area").isNull() | (F.col("area") == generic) | (F.col("region_how") == "agency")
    asked = listings.filter(~F.col("source_domain").isin(*portals) & (F.coalesce("region", F.lit("")) != "other") & F.coalesce(vague, F.lit(True)))
    h = hints.select(F.col("url").alias("_url"), F.col("checked_at").alias("_at"), F.col("how").alias("_how"))
    wait = F.when(F.coalesce("_how", F.lit("")) != "", found_days).otherwise(empty_days)
    fresh = F.coalesce(F.col("_at") >= F.date_sub(today, wait), F.lit(False))
    return asked.join(h, F.col("url") == F.col("_url"), "left").filter(~fresh).drop("_url", "_at", "_how")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status, old, new) of two snapshots: new, gone, down, up or same."""
    a = before.select(F.col(key).alias("k_old"), F.col(value).alias("old_value"))
    b = after.select(F.col(key).alias("k_new"), F.col(value).alias("new_value"))
    joined = a.join(b, F.col("k_old") == F.col("k_new"), "full_outer")
    status = (
        F.when(F.col("k_old").isNull(), "new").when(F.col("k_new").isNull(), "gone").when(F.col("new_value") < F.col("old_value"), "down").when(F.col("new_value") > F.col("old_value"), "up").otherwise("same")
    )
    return joined.select(F.coalesce("k_new", "k_old").alias(key), status.alias("status"), "old_value", "new_value")


def removed(before: DataFrame, after: DataFrame, complete: DataFrame, key: str, part: str) -> DataFrame:
    """Rows that are gone from parts that were read completely; other parts' absence means nothing."""
    return before.join(after.select(key), key, "left_anti").join(complete.select(part), part, "left_semi")


def broken_sources(known: DataFrame, got: DataFrame, part: str) -> DataFrame:
    """Parts that returned less than half of at least twenty known rows: their old rows are kept."""
    old = known.groupBy(part).agg(F.count(F.lit(1)).alias("known"))
    new = got.groupBy(part).agg(F.count(F.lit(1)).alias("got"))
    both = old.join(new, part, "left").withColumn("got", F.coalesce("got", F.lit(0)))
    return both.filter((F.col("known") >= BROKEN_KNOWN) & (F.col("got") < BROKEN_SHARE * F.col("known")))


def keep_old_where_broken(known: DataFrame, got: DataFrame, part: str) -> DataFrame:
    bad = broken_sources(known, got, part).select(part)
    return got.join(bad, part, "left_anti").unionByName(known.join(bad, part, "left_semi"), allowMissingColumns=True)


def last_write_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def carry_over(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed merge: the first publication and the latest update survive, points stay once read."""
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns])
    both = new.join(o, F.col(key) == F.col(f"o_{key}"), "full_outer")
    special = {
        "date_published": F.least("date_published", "o_date_published"),
        "date_updated": F.greatest("date_updated", "o_date_updated"),
        "lat": F.coalesce("o_lat", "lat"),
        "lon": F.coalesce("o_lon", "lon"),
    }
    return both.select(*[special.get(c, F.coalesce(c, f"o_{c}")).alias(c) for c in new.columns])


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """The latest right value at or before each left row: a union and a running last value, no theta join."""
    a = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1))
    b = right.select(F.col(key), F.col(right_time).alias("_t"), F.col(value).alias("_value")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(f"as_of_{value}", F.last("_value", ignorenulls=True).over(w))
    return both.filter("_side = 1").drop("_t", "_side", "_value")


def market_episodes(df: DataFrame, key: str, day: str, gap_days: int = 180) -> DataFrame:
    """Runs of a key's days no further apart than the gap."""
    w = Window.partitionBy(key).orderBy(day)
    starts = (F.datediff(day, F.lag(day).over(w)) > gap_days).cast("int")
    numbered = df.withColumn("episode", F.sum(F.coalesce(starts, F.lit(0))).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "episode").agg(F.min(day).alias("from_day"), F.max(day).alias("to_day"), F.count(F.lit(1)).alias("n"))
