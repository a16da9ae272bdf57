"""The packed export: one table of strings for many columns, rows as short arrays, documents in shards.

Strings of coded columns, and what links have up to their host, get numbers in the order of their first use;
days count from a fixed one. A row is an array of its columns, those filled most often first, without what is
null at its end. Rows and strings go to documents of a bounded number of them, which a manifest lists; so no
document, and no task, holds all. ``unpacked`` gives the rows back.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.operators.gold import trim_nulls
from listwright.operators.ranges import ranked
from listwright.sources.shared import written

# The day from which days count, and where a link is cut.
FIRST_DAY, LINK = "2020-01-01", r"(?s)^(https?://[^/]+/?)(.*)$"
SHARD = 10_000


class Packed(NamedTuple):
    """Columns in the order of a row's array, strings(code, value), rows(key, rank_, row), and what each column is."""

    keys: list[str]
    strings: DataFrame
    rows: DataFrame
    kinds: dict[str, str]
    types: dict[str, str]


def link_parts(url: Column) -> Column:
    """struct<head, rest>: a link up to its host, and what follows; the head of anything else is empty."""
    found = F.regexp_extract(url, LINK, 1)
    return F.when(url.isNotNull(), F.struct(found.alias("head"), F.when(found == "", url).otherwise(F.regexp_extract(url, LINK, 2)).alias("rest")))


def _text(c: Column) -> Column:
    """A string as it stands in JSON."""
    shown = F.to_json(F.array(c))
    return F.substring(shown, F.lit(2), F.length(shown) - 2)


def pack(df: DataFrame, key: str, coded: Sequence[str] = (), days: Sequence[str] = (), links: Sequence[str] = (), plain: Sequence[str] = ()) -> Packed:
    """``df`` packed; empty strings count as null, and a column that is null everywhere is left out."""
    columns = [*coded, *days, *links, *plain]
    kinds = {**dict.fromkeys(coded, "coded"), **dict.fromkeys(days, "day"), **dict.fromkeys(links, "link"), **dict.fromkeys(plain, "plain")}
    types = dict(df.dtypes)
    rows = written(df.select(key, *[F.when(F.col(c) != "", F.col(c)).alias(c) if types[c] == "string" else F.col(c) for c in columns]), "to-pack")
    fill = rows.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    keys = sorted((c for c in columns if fill[c]), key=lambda c: (-fill[c], columns.index(c)))
    said = [F.struct(F.lit(columns.index(c)).alias("at"), (link_parts(F.col(c))["head"] if kinds[c] == "link" else F.col(c).cast("string")).alias("value")) for c in keys if kinds[c] in ("coded", "link")]
    uses = rows.select(key, F.explode(F.array(*said)).alias("u")).select(key, "u.at", "u.value").filter("value is not null") if said else rows.limit(0).select(key, F.lit(0).alias("at"), F.lit("").alias("value"))
    first = uses.groupBy("value").agg(F.min(F.struct(F.col(key).alias("key"), "at")).alias("first"))
    strings = written(ranked(first, [F.col("first"), F.col("value")]).select(F.col("rank_").alias("code"), "value"), "strings")
    named = uses.join(strings.withColumnRenamed("value", "v_"), F.col("value") == F.col("v_")).groupBy(F.col(key).alias("key_")).agg(F.map_from_entries(F.collect_list(F.struct("at", "code"))).alias("codes_"))
    joined = rows.join(named, F.col(key) == F.col("key_"), "left")

    def element(c: Column, name: str) -> Column:
        code = F.col("codes_")[F.lit(columns.index(name))].cast("string")
        if kinds[name] == "coded":
            return code
        if kinds[name] == "day":
            return F.datediff(c, F.lit(FIRST_DAY).cast("date")).cast("string")
        if kinds[name] == "link":
            return F.concat(F.lit("["), code, F.lit(","), _text(link_parts(c)["rest"]), F.lit("]"))
        if types[name] in ("double", "float"):
            return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
        return _text(c) if types[name] == "string" else c.cast("string")

    values = trim_nulls(F.array(*[F.when(F.col(c).isNotNull(), element(F.col(c), c)) for c in keys])) if keys else F.array()
    row = F.concat(F.lit("["), F.array_join(values, ",", "null"), F.lit("]"))
    return Packed(keys, strings, ranked(joined.select(key, row.alias("row")), [F.col(key)]), kinds, types)


def documents(packed: Packed, shard: int = SHARD) -> DataFrame:
    """(name, n, body): documents of so many rows or strings, and the manifest's entries are their names and sizes."""

    def shards(rows: DataFrame, at: str, item: Column, kind: str) -> DataFrame:
        part = rows.groupBy(F.floor(F.col(at) / shard).alias("part")).agg(F.array_sort(F.collect_list(F.struct(F.col(at), item.alias("x")))).alias("xs"))
        body = F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: x["x"]), ","), F.lit("]"))
        return part.select(F.format_string(f"{kind}-%06d.json", "part").alias("name"), F.size("xs").alias("n"), body.alias("body"))

    return shards(packed.rows, "rank_", F.col("row"), "rows").unionByName(shards(packed.strings, "code", _text(F.col("value")), "strings"))


def unpacked(packed: Packed, key: str) -> DataFrame:
    """The rows as they were packed."""
    elements = packed.rows.select(key, F.from_json("row", "array<string>").alias("e"))
    at = {c: F.get("e", F.lit(i)) for i, c in enumerate(packed.keys)}
    codes = [F.struct(F.lit(i).alias("at"), (at[c] if packed.kinds[c] == "coded" else F.get(F.from_json(at[c], "array<string>"), F.lit(0))).cast("long").alias("code")) for i, c in enumerate(packed.keys) if packed.kinds[c] in ("coded", "link")]
    if codes:
        uses = elements.select(key, F.explode(F.array(*codes)).alias("u")).select(key, "u.at", F.col("u.code").alias("c_")).filter("c_ is not null")
        said = uses.join(packed.strings, F.col("c_") == F.col("code")).groupBy(F.col(key).alias("key_")).agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("said"))
        elements = elements.join(said, F.col(key) == F.col("key_"), "left")

    def value(i: int, c: str) -> Column:
        if packed.kinds[c] == "coded":
            return F.col("said")[F.lit(i)].cast(packed.types[c])
        if packed.kinds[c] == "day":
            return F.date_add(F.lit(FIRST_DAY).cast("date"), at[c].cast("int"))
        if packed.kinds[c] == "link":
            return F.when(at[c].isNotNull(), F.concat(F.col("said")[F.lit(i)], F.get(F.from_json(at[c], "array<string>"), F.lit(1))))
        return at[c].cast(packed.types[c])

    return elements.select(key, *[value(i, c).alias(c) for i, c in enumerate(packed.keys)])
