"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The tokens that a mix may hold are so many whole blocks. They go to sources by highest quotient
target/(2k+1), and each source's quota to its shards by highest quotient of their tokens, nobody above what
it has: a shard may be read ``MOST_REPEATS`` times, so that many of its tokens are cut into its blocks. Then
a shard gives as many blocks as its quota says, in a seeded order: around its blocks from a seeded one on,
so most documents are taken whole. A source's words are a whole number of blocks, so they are within half a
block of its target, and within a block a shard where it is read out. Only a source whose target is less
than a block gives a part of one.

Highest quotients are found without dealing seats one by one: parties whose votes are divided by a common
divisor and rounded have them, so aggregates over the parties narrow the divisor, each trying ``TRIED`` at
once, till no party's quota differs by more than one between its bounds; the seats that are left then go by
the next quotients, in order. That holds for all sources' shards at once.

Sources are a table like any other: they are ranked by ranges and their targets found by a few
aggregates, so their number has no bound. A shard is a hash bucket of a source's rows that have words,
by doc_id and text, and by the row itself for rows that very many equal, so a source of any share of the
rows, or rows without an id, are spread over as many tasks as their tokens need; rows without words take
nothing and meet no one.

Defined results: a null text has no words; documents without words take nothing. A null source is a
source of its own and comes last. Very long texts are one row of one shard. Repeated rows are documents
each; equal ones are told apart by nothing and may be taken differently. Ties of quotients go to the earlier
source or shard, ties in the order of a shard's documents by doc_id, then size. An empty table (or one
without a word) gives every target 0. Only ``doc_id``, ``text`` and ``source`` are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listwright.llm.common import HOT_ROWS, MOST_HOT, WORD, fresh, split_join, text_or_empty, words_of, written
from listwright.operators.ranges import ranked

WEIGHTS = (3, 1, 2)
SHARE, MOST_REPEATS = 1.5, 2
BLOCK, SEED = 16, 20_240_501
#: Tokens of a shard.
SHARD_TOKENS = 65_536
#: Rows that a task repeats and cuts at once.
ROWS = 512
#: Divisors that one aggregate tries.
TRIED = 64


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotient votes/(2k+1), ties to the earlier; none above ``most``.

    Rounding by a common divisor gives an allotment in which no quotient is out of order; adding the
    highest or removing the lowest quotients then mends its sum and keeps that order.
    """
    votes = np.asarray(votes, float)
    caps = np.full(len(votes), np.iinfo(np.int64).max) if most is None else np.asarray(most, np.int64)
    caps = np.where(votes > 0, caps, 0)
    if not len(votes) or seats <= 0 or not caps.any():
        return [0] * len(votes)
    if most is not None:
        seats = min(seats, sum(int(c) for c in caps))

    def rounded(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(votes / divisor + 0.5), caps.astype(float)).astype(np.int64)

    low, high = 0.0, 4 * votes.max() + 1.0
    for _ in range(200):
        mid = (low + high) / 2
        if not low < mid < high:
            break
        if votes.max() / mid < 2**62 and rounded(mid).sum() <= seats:
            high = mid
        else:
            low = mid
    got = rounded(high)
    heap = [(-votes[i] / (2 * got[i] + 1), i) for i in range(len(votes)) if got[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(int(seats - got.sum())):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return [int(x) for x in got]


def _seats(votes: Column, divisor: Column, most: Column) -> Column:
    """What highest quotients give at a common divisor: the votes over it, to the nearest whole number."""
    return F.least(F.floor(votes / divisor + 0.5).cast("long"), most)


def _with_group(rows: DataFrame, groups: DataFrame, few: bool, total: int) -> DataFrame:
    """Rows with their group's row of ``groups(g_, rows_, ...)``: broadcast if groups are ``few``, else with hot groups split off."""
    if few:
        return rows.join(F.broadcast(groups), F.col("group") == F.col("g_"))
    return split_join(rows, "group", groups, "g_", "rows_", total)


def apportioned(parties: DataFrame, order: Sequence[str]) -> DataFrame:
    """``parties(group, votes, most, seats, ...)`` with quota: each group's seats by highest quotients.

    ``seats`` is the same in a group; ``order`` names columns that settle ties. Only parties with votes and
    a positive ``most`` get seats, and none more than ``most``. Groups may be of any size: their bounds are
    a table with a row each, and parties are ranked in ranges.
    """
    open_ = (F.col("votes") > 0) & (F.col("most") > 0)
    rows = written(parties, "parties")
    total, free = rows.count(), rows.filter(open_)
    of = free.groupBy(F.col("group").alias("g_")).agg(
        F.least(F.max("seats"), F.sum("most")).alias("left_"), F.sum("votes").alias("votes_"), F.max("votes").alias("top_"), F.min(F.col("votes") / F.col("most")).alias("least_"), F.count(F.lit(1)).alias("rows_")
    )
    # The votes over the seats, give or take half a seat a party, if nobody is full; beyond, from all full to nobody with a seat.
    half, low, high = F.col("rows_") / 2, F.col("least_") / 2, F.col("top_") * 4
    near = [F.col("votes_") / F.greatest(F.col("left_") + k * half, F.lit(0.5)) for k in (4, 1, -1)]
    points = [low, *[F.least(F.greatest(x, low), high) for x in near], high]
    bounds = written(of.select("g_", "left_", "rows_", F.array(*points).alias("grid_")), "divisors")
    few = bounds.limit(MOST_HOT + 1).count() <= MOST_HOT  # a row of some hundred bytes each
    while True:
        # At a grid's first divisor a group has its seats or more, at its last no more than them.
        tried = _with_group(free, bounds, few, total).select("group", "votes", "most", "left_", "rows_", "grid_", F.posexplode("grid_").alias("at_", "divisor_")).filter("at_ > 0")
        before = F.get("grid_", F.col("at_") - 1)
        seats = _seats(F.col("votes"), F.col("divisor_"), F.col("most"))
        sums = tried.groupBy("group", "at_").agg(*[F.first(c).alias(c) for c in ("left_", "rows_", "divisor_")], F.first(before).alias("before_"), F.sum(seats).alias("n"), F.max(_seats(F.col("votes"), before, F.col("most")) - seats).alias("apart"))
        enough = sums.filter(F.col("n") <= F.col("left_")).groupBy(F.col("group").alias("g_"))
        chosen = enough.agg(F.min_by(F.struct("left_", "rows_", "before_", "divisor_", "apart"), "at_").alias("x")).select("g_", "x.*")
        ratio = F.col("divisor_") / F.col("before_")
        grid = F.concat(F.array("before_"), F.transform(F.sequence(F.lit(1), F.lit(TRIED - 1)), lambda k: F.col("before_") * F.pow(ratio, k / TRIED)), F.array("divisor_"))
        bounds = written(chosen.select("g_", "left_", "rows_", F.array_sort(grid).alias("grid_"), ((F.col("apart") > 1) & (ratio > 1 + 1e-15)).alias("wide")), "divisors")
        if bounds.filter("wide").isEmpty():
            break
    held = _with_group(free, bounds, few, total)
    sure = held.withColumn("quota", _seats(F.col("votes"), F.array_max("grid_"), F.col("most")))
    sure = written(sure.drop("g_", "rows_", "grid_", "wide"), "quotas")
    rest = sure.groupBy(F.col("group").alias("g_")).agg((F.first("left_") - F.sum("quota")).alias("rest_"), F.count(F.lit(1)).alias("rows_"))
    more = _with_group(sure, written(rest, "rests"), few, total).filter((F.col("rest_") > 0) & (F.col("quota") < F.col("most")))
    placed = ranked(more.drop("g_", "rows_"), [F.col("group"), -F.col("votes") / (2 * F.col("quota") + 1), *[F.col(c) for c in order]])
    starts = placed.groupBy(F.col("group").alias("g_")).agg(F.min("rank_").alias("start_"), F.count(F.lit(1)).alias("rows_"))
    won = _with_group(placed, written(starts, "starts"), few, total).filter(F.col("rank_") - F.col("start_") < F.col("rest_"))
    keys = ["group", *order]
    extra = written(won.select(*keys).withColumn("extra_", F.lit(1)), "extras").withColumnsRenamed({k: f"{k}_x" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"{k}_x")) for k in keys]
    got = written(sure.join(extra, on, "left").select(*keys, (F.col("quota") + F.coalesce("extra_", F.lit(0))).alias("quota")), "quotas").withColumnsRenamed({k: f"{k}_x" for k in keys})
    return rows.join(got, on, "left").drop(*[f"{k}_x" for k in keys]).withColumn("quota", F.coalesce("quota", F.lit(0)).cast("long"))


def _source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """``sources(src, source, source_size)`` with target: ``share`` of all tokens by weight, none above ``most`` times its size.

    Weights go to sources by code point, null last, repeating. The excess of a full source is shared
    again by weight; a round is one aggregate, and finds all sources that are full at its rate.
    """
    order = [F.col("source").isNull(), F.coalesce("source", F.lit(""))]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank_") % len(weights) + 1).cast("int"))
    placed = written(ranked(sources, order).withColumns({"weight": weight, "most": F.col("source_size") * float(most)}), "sources")
    free = F.col("source_size") > 0
    all_ = placed.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    wanted, rate, full = min(share * all_, float(most) * all_), None, F.lit(False)
    while True:  # each round fills at least one more source, or is the last
        now = placed.agg(F.sum(F.when(free & full, F.col("most"))).alias("held"), F.sum(F.when(free & ~full, F.col("weight"))).alias("weights"), F.count_if(free & full).alias("n")).first()
        if not now["weights"]:
            break
        new = (wanted - (now["held"] or 0.0)) / now["weights"]
        if rate is not None and new <= rate:
            break
        rate, full = new, F.col("weight") * new >= F.col("most")
    target = F.when(~free, F.lit(0.0)).when(full, F.col("most")).otherwise(F.col("weight") * F.lit(float(rate or 0.0)))
    return placed.withColumn("target", target).drop("rank_", "weight", "most")


_SPANS = "array<struct<a:bigint,b:bigint>>"


def _picked() -> Column:
    """array<struct<a, b>>: the words (from, to) of a document that its shard's blocks take, a run each.

    The shard's tokens, read ``MOST_REPEATS`` times over, are cut into n_ blocks, of which quota are taken
    from shift_ on, around the end; block_ is their length.
    """
    block, first = F.col("block_"), F.col("shift_")
    ends = first + F.col("quota")
    taken = ((first * block, F.least(ends, F.col("n_")) * block), (F.lit(0).cast("long"), F.greatest(ends - F.col("n_"), F.lit(0)) * block))
    runs = []
    for copy in range(MOST_REPEATS):
        begin = F.col("cum") - F.col("size") + copy * F.col("tokens")
        for low, high in taken:
            runs.append(F.struct((F.greatest(low, begin) - begin).cast("long").alias("a"), (F.least(high, begin + F.col("size")) - begin).cast("long").alias("b")))
    return F.filter(F.array(*runs), lambda x: x["b"] > x["a"])


def shards_of(docs: DataFrame, weights: Sequence[float] = WEIGHTS, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with their source's target and their shard; and all shards with their quotas of blocks.

    ``row`` names a column that tells rows apart; it is passed on as row_.
    """
    sized = written(
        docs.select(
            (F.col(row) if row else F.monotonically_increasing_id()).cast("long").alias("row_"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.size(words_of(text_or_empty())).cast("long").alias("size"),
            F.xxhash64("doc_id", "text", F.lit(SEED)).alias("hash"),
        ).withColumn("src", _source_key()),
        "sizes",
    )
    total = sized.count()
    found = sized.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    plan = targets(found, weights).withColumn("shards", F.greatest(F.ceil(F.col("source_size") / SHARD_TOKENS), F.lit(1)).cast("long"))
    plan = written(plan.drop("source").withColumnRenamed("src", "src_"), "plan")
    # Equal rows that are many go by themselves; there can't be more than MOST_HOT such hashes.
    most = max(HOT_ROWS, 2 * total // MOST_HOT)
    many = sized.groupBy(F.col("hash").alias("hot_")).agg(F.count(F.lit(1)).alias("n_")).filter(F.col("n_") > most).select("hot_")
    placed = split_join(sized, "src", plan, "src_", "rows", total).drop("src_", "rows")
    placed = placed.join(F.broadcast(many), F.col("hash") == F.col("hot_"), "left")
    placed = placed.withColumn("hash", F.when(F.col("hot_").isNotNull(), F.xxhash64("hash", "row_")).otherwise(F.col("hash"))).drop("hot_")
    placed = written(placed.withColumn("shard", F.when(F.col("size") > 0, F.pmod("hash", "shards"))), "placed")
    tokens = placed.filter("size > 0").groupBy("src", "shard").agg(F.sum("size").alias("tokens"), F.first("target").alias("target"))
    tokens = tokens.withColumn("n_", F.floor(MOST_REPEATS * F.col("tokens") / BLOCK).cast("long"))
    return placed, apportioned_shards(written(tokens, "shards"))


def apportioned_shards(shards: DataFrame) -> DataFrame:
    """``shards(src, shard, tokens, target, n_)`` with quota and block_, the length of its blocks.

    Sources first: as many blocks as all their targets hold. A source whose target is less than a block
    has the part of a block that its target is, from its shard of the most tokens.
    """
    sources = shards.groupBy("src").agg(F.first("target").alias("votes"), F.sum("n_").alias("most"), F.max_by("shard", F.struct("tokens", -F.col("shard"))).alias("largest"))
    sources = written(sources, "mix-sources")
    whole = sources.filter(F.col("votes") >= BLOCK).select(F.lit("all").alias("group"), "src", "votes", "most")
    seats = whole.agg(F.floor(F.sum("votes") / BLOCK).cast("long").alias("n")).first()["n"] or 0
    of_source = apportioned(whole.withColumn("seats", F.lit(seats)), ["src"]).select(F.col("src").alias("src_"), F.col("quota").alias("seats"))
    parties = shards.join(written(of_source, "source-quotas"), F.col("src") == F.col("src_")).select(F.col("src").alias("group"), "shard", F.col("tokens").cast("double").alias("votes"), F.col("n_").alias("most"), "seats")
    of_shard = written(apportioned(parties, ["shard"]).select(F.col("group").alias("src_"), F.col("shard").alias("shard_"), "quota"), "shard-quotas")
    small = sources.filter(F.col("votes") < BLOCK).select(F.col("src").alias("small_"), F.col("largest").alias("largest_"))
    out = shards.join(of_shard, (F.col("src") == F.col("src_")) & (F.col("shard") == F.col("shard_")), "left").drop("src_", "shard_")
    out = out.join(written(small, "small-sources"), (F.col("src") == F.col("small_")) & (F.col("shard") == F.col("largest_")), "left")
    part = F.col("small_").isNotNull()
    return written(
        out.withColumns(
            {
                "quota": F.when(part, F.lit(1)).otherwise(F.coalesce("quota", F.lit(0))).cast("long"),
                "block_": F.when(part, F.bround("target")).otherwise(F.lit(BLOCK)).cast("long"),
                "n_": F.greatest(F.col("n_"), F.lit(1)),
            }
        ).drop("small_", "largest_", "target"),
        "shard-blocks",
    )


def _dealt(docs: DataFrame, weights: Sequence[float] = WEIGHTS, row: str | None = None) -> DataFrame:
    """One row per document: what ``mix`` gives, and picked, from which ``taken`` comes."""
    placed, shards = shards_of(docs, weights, row)
    out = ("row_", "doc_id", "size", "source_size", "target", "source", "picked")
    empty = placed.filter("size = 0").withColumn("picked", F.array().cast(_SPANS)).select(*out)
    window = Window.partitionBy("src", "shard").orderBy(F.xxhash64("hash", F.lit(SEED + 1)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    kept = placed.filter("size > 0").withColumn("cum", F.sum("size").over(window))
    quotas = shards.select(F.col("src").alias("src_"), F.col("shard").alias("shard_"), "tokens", "quota", "block_", "n_")
    kept = kept.join(quotas, (F.col("src") == F.col("src_")) & (F.col("shard") == F.col("shard_")))
    shift = F.when(F.col("block_") == BLOCK, F.pmod(F.xxhash64(F.lit(SEED), F.col("src"), F.col("shard")), F.col("n_"))).otherwise(F.lit(0))
    return kept.withColumn("shift_", shift).withColumn("picked", _picked()).select(*out).unionByName(empty)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source."""
    taken = F.aggregate("picked", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"]).alias("taken")
    return _dealt(docs, weights).select("doc_id", "size", "source_size", "target", taken, "source")


def _repeated(columns: list[str], plan_col: str):
    """A row for each run of words that the mix takes of a document: the document itself where it is whole."""
    import re

    words = re.compile(WORD)

    def run(batches):
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            rows, taken = batch.to_pylist(), []
            for row in rows:
                plan, spans = row.pop(plan_col), None
                for x in plan["picked"]:
                    if x["a"] == 0 and x["b"] == plan["size"]:
                        taken.append(row)
                        continue
                    spans = spans or [m.span() for m in words.finditer(row["text"])]
                    taken.append(row | {"text": row["text"][spans[x["a"]][0] : spans[x["b"] - 1][1]]})
            if taken:
                names = [n for n in batch.schema.names if n in columns]
                schema = pa.schema([batch.schema.field(n) for n in names])
                yield pa.RecordBatch.from_pylist(taken, schema=schema)

    return run


def apply_mix(docs: DataFrame) -> DataFrame:
    """The mix itself: documents repeated, cut or left out as it takes them; own columns only.

    A document that the blocks cover whole gives itself, as often as they do; where they begin or end
    inside of it, the words between. Rows follow their own numbers by a row key that is written with them:
    doc_ids may repeat or be null.
    """
    row, plan_row, plan_col = (fresh(docs, x) for x in ("mix_row", "mix_plan_row", "mix_plan"))
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    plan = _dealt(keyed, row=row).filter("size(picked) > 0").select(F.col("row_").alias(plan_row), F.struct("picked", "size").alias(plan_col))
    chosen = keyed.join(written(plan, "mix"), F.col(row) == F.col(plan_row)).drop(row, plan_row)
    return chosen.mapInArrow(_repeated(docs.columns, plan_col), docs.schema)
