"""What the corpus operators share: the word pattern, bindings, tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.operators.joins import HOT_ROWS, MOST_HOT, split_join
from listwright.sources.shared import shared_dir, written

__all__ = ["HOT_ROWS", "MOST_HOT", "shared_dir", "split_join", "written"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """All words of a text, in order, repeats included."""
    return F.array_remove(F.split(text, SPACE), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a lambda variable, so that it is computed once a row.

    An expression that is named inside a lambda would otherwise be inlined there
    and be computed again for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, amount: int, each: int) -> int:
    """Tasks for so much work, so that none grows with the input; not fewer than the session's partitions."""
    return max(partitions(spark), -(-amount // each), 1)


def before(lengths: Column, block: int = 256) -> Column:
    """For each element of an array of longs, the sum of those before it.

    Appending to an array copies it, so sums run within blocks and over blocks: near-linear cost.
    """
    zero = F.lit(0).cast("long")

    def sums(part: Column, start: Column) -> Column:
        """One more than the part's elements: the last is the whole sum."""
        return F.aggregate(part, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def in_blocks(all_: Column) -> Column:
        count = F.ceil(F.size(all_) / block).cast("int")
        parts = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(all_, b * block + 1, F.lit(block)))

        def of_parts(ps: Column) -> Column:
            totals = F.transform(ps, lambda p: F.aggregate(p, zero, lambda acc, x: acc + x))
            return let(
                sums(totals, zero),
                lambda starts: F.flatten(F.transform(ps, lambda p, b: F.slice(sums(p, F.get(starts, b)), F.lit(1), F.size(p)))),
            )

        return let(parts, of_parts)

    return let(lengths, lambda all_: F.when(F.size(all_) == 0, all_).otherwise(in_blocks(all_)))
