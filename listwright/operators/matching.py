"""Saved filters against properties, with an explicit policy for unknown values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listwright.sources.shared import written

TOP, UNKNOWN_PRICE, HOME = 25, 1e12, "home"
#: Filters of one salt: so many, and each property meets those of its key in one row's comparison.
FEW_FILTERS = 10_000
ANY = "\u0000any"

FILTER_SCHEMA = (
    "name string, enabled boolean, transaction string, region string, types array<string>, areas array<string>, "
    "price_min double, price_max double, m2_min double, m2_max double, bedrooms_min double, floor_min double, floor_max double, "
    "keep_unknown boolean, keep_unknown_floor boolean, keep_unconfirmed_region boolean"
)


def _bound(limit: Column, value: Column, low: bool, unknown: Column) -> Column:
    passes = value >= limit if low else value <= limit
    return limit.isNull() | F.when(value.isNull(), unknown).otherwise(passes)


def matches(p: Column, f: Column, home: str = HOME) -> Column:
    """Whether property struct ``p`` passes filter struct ``f``.

    An absent region means the home region, an empty one disables the test. An unknown price fails
    any price bound; other unknown values pass if the filter keeps unknowns (as it does unless it
    says otherwise), floors by their own switch first.
    """
    keep = F.coalesce(f["keep_unknown"], F.lit(True))
    keep_floor = F.coalesce(f["keep_unknown_floor"], keep)
    never = F.lit(False)
    region = F.coalesce(f["region"], F.lit(home))
    confirmed = F.coalesce(p["region_ok"], never) | F.coalesce(f["keep_unconfirmed_region"], never)
    listed = lambda xs, x: F.coalesce(F.array_contains(xs, x), never)
    some = lambda xs: F.coalesce(F.size(xs), F.lit(0)) > 0
    return (
        ((F.coalesce(f["transaction"], F.lit("")) == "") | F.coalesce(p["transaction"] == f["transaction"], never))
        & ((region == "") | (F.coalesce(p["region"] == region, never) & confirmed))
        & (~some(f["types"]) | listed(f["types"], p["type"]))
        & (~some(f["areas"]) | listed(f["areas"], p["area"]) | listed(f["areas"], p["neighbourhood"]))
        & _bound(f["price_min"], p["price"], True, never)
        & _bound(f["price_max"], p["price"], False, never)
        & _bound(f["m2_min"], p["m2"], True, keep)
        & _bound(f["m2_max"], p["m2"], False, keep)
        & _bound(f["bedrooms_min"], p["bedrooms"], True, keep)
        & _bound(f["floor_min"], p["floor"], True, keep_floor)
        & _bound(f["floor_max"], p["floor"], False, keep_floor)
    )


def match_filters(properties: DataFrame, filters: DataFrame, home: str = HOME) -> DataFrame:
    """(filter columns as f, property columns as p) of every match; the same rows however many filters there are.

    Both sides meet by the deal and the region that a filter asks for. A property comes under its own values
    and under "any", so filters that ask for neither meet it too. Few filters are broadcast by their size,
    and no property moves. Many are shuffled: keys are few, so each is then spread by a salt over as many
    tasks as the filters are many times ``FEW_FILTERS``.
    """
    on = written(filters.filter(F.coalesce("enabled", F.lit(True))), "filters")
    spread = max(1, -(-on.count() // FEW_FILTERS))
    p = properties.select(F.struct(*properties.columns).alias("p"))
    f = on.select(F.struct(*on.columns).alias("f"))
    fits = matches(F.col("p"), F.col("f"), home)
    asked = lambda c, default: F.when(F.coalesce(c, F.lit(default)) == "", F.lit(ANY)).otherwise(F.coalesce(c, F.lit(default)))
    key = F.struct(asked(F.col("f.transaction"), "").alias("deal"), asked(F.col("f.region"), home).alias("region"))
    keyed = f.withColumns({"_k": key, "_salt": F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))})
    own = F.coalesce("p.region", F.lit(ANY))
    deals = F.array_distinct(F.array(F.coalesce("p.transaction", F.lit(ANY)), F.lit(ANY)))
    seen = p.withColumn("_deal", F.explode(deals)).withColumn("_region", F.explode(F.array_distinct(F.array(own, F.lit(ANY)))))
    salt = F.pmod(F.xxhash64("p.id"), F.lit(spread)).cast("int")
    seen = seen.select("p", F.struct(F.col("_deal").alias("deal"), F.col("_region").alias("region")).alias("_at"), salt.alias("_s"))
    return seen.join(keyed, (F.col("_at") == F.col("_k")) & (F.col("_s") == F.col("_salt")) & fits).select("p", "f")


def top_hits(matched: DataFrame, top: int = TOP) -> DataFrame:
    """Each filter's cheapest hits, unknown prices last, and how many more there are."""
    # The ranking window has no other function beside it, so Spark cuts each task's rows to the top before the shuffle.
    price = F.coalesce("p.price", F.lit(UNKNOWN_PRICE))
    ranked = matched.withColumn("rank", F.row_number().over(Window.partitionBy("f.name").orderBy(price, "p.id"))).filter(F.col("rank") <= top)
    hits = matched.groupBy(F.col("f.name").alias("_name")).agg(F.count(F.lit(1)).alias("hits"))
    both = ranked.join(hits, F.col("f.name").eqNullSafe(F.col("_name"))).drop("_name")
    return both.withColumn("more", F.greatest(F.col("hits") - top, F.lit(0)))


def unsent(properties: DataFrame, sent: DataFrame, member_urls: str = "urls") -> DataFrame:
    """Properties none of whose member URLs was sent before."""
    seen = properties.select("id", F.explode(member_urls).alias("url")).join(sent.select("url").distinct(), "url", "left_semi")
    return properties.join(seen.select("id").distinct(), "id", "left_anti")


#: Types whose price per metre compares with the district's.
COMPARED = ("apartment", "studio", "maisonette")


def market_delta(price: Column, m2: Column, sale: Column, rent: Column, transaction: Column, type_: Column) -> Column:
    """Percent above the map area's price per metre of that deal, shown between 10 and 60 either way."""
    reference = F.when(transaction == "sale", sale).when(transaction == "rent", rent)
    pct = F.bround((price / F.nullif(m2, F.lit(0.0)) / F.nullif(reference, F.lit(0.0)) - 1) * 100)
    return F.when(type_.isin(*COMPARED) & (price != 0) & F.abs(pct).between(10, 60), pct)


def plain_cut(piece: str, limit: int) -> str:
    """A piece too long for one message: its text without tags, cut to the limit, no entity broken."""
    import re

    text = re.sub(r"<[^>]+>", "", piece)
    while _units(text) > limit - 1:
        text = re.sub(r"&[a-z#0-9]*$", "", text[: -max(1, (_units(text) - limit + 1) // 2)])
    return text + "…"


def _units(s: str) -> int:
    return len(s.encode("utf-16-le")) // 2


def first_run(sent: DataFrame | None, properties: DataFrame) -> tuple[bool, DataFrame]:
    """Whether this run only primes the sent set, and the URLs that are sent after it: all there are."""
    urls = properties.select(F.explode("urls").alias("url")).distinct()
    return sent is None, urls if sent is None else urls.unionByName(sent.select("url")).distinct()


def unsent_drops(matched: DataFrame, drops: DataFrame, sent: DataFrame, new_ids: DataFrame) -> DataFrame:
    """Of matched properties that aren't new, the lowest recent drop of a member that wasn't sent yet.

    ``drops(id, url, old_price, price)`` are members' drops; ``sent(url, price)`` those sent before.
    """
    best = drops.groupBy("id").agg(F.min_by(F.struct("url", "old_price", "price"), F.struct("price", "url")).alias("drop"))
    known = matched.join(new_ids.select(F.col("id").alias("_new")), F.col("p.id") == F.col("_new"), "left_anti")
    found = known.join(best, F.col("p.id") == best["id"]).select("f", "p", "drop.*")
    told = sent.select(F.col("url").alias("_u"), F.col("price").alias("_p"))
    return found.join(told, (F.col("url") == F.col("_u")) & (F.col("price") == F.col("_p")), "left_anti")


def pack_messages(blocks: DataFrame, limit: int = 3900) -> DataFrame:
    """Next-fit packing of ``blocks(recipient, ord, title, pieces)`` into messages of bounded UTF-16 length.

    A recipient's blocks meet in one task, as its messages are one sequence. They come sorted and pass one by one:
    what is held of a recipient is its open message.
    """

    units = _units

    def run(frames):
        import pandas as pd

        who, part, open_, out = None, None, "", []
        for frame in frames:
            for row in frame.itertuples(index=False):
                if part is None or row.recipient != who:
                    if open_:
                        out.append((who, part, open_))
                    who, part, open_ = row.recipient, 0, ""
                lead = [row.title] if row.title else []
                for k, piece in enumerate([*lead, *row.pieces]):
                    if units(piece) > limit:
                        piece = plain_cut(piece, limit)
                    joint = "" if not open_ else "\n\n" if k == 0 else "\n"
                    if units(open_ + joint + piece) <= limit:
                        open_ += joint + piece
                        continue
                    if open_:
                        out.append((who, part, open_))
                        part += 1
                    again = f"{row.title} (cont.)\n{piece}" if row.title and k else piece
                    open_ = again if units(again) <= limit else piece
            yield pd.DataFrame(out, columns=["recipient", "part", "message"])
            out = []
        if open_:
            yield pd.DataFrame([(who, part, open_)], columns=["recipient", "part", "message"])

    sent = blocks.select("recipient", "ord", "title", "pieces").repartition("recipient").sortWithinPartitions("recipient", F.col("ord").asc_nulls_last())
    return sent.mapInPandas(run, "recipient string, part long, message string")
