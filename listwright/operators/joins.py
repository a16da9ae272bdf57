"""Joins whose hot keys never meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more rows than this, or than its share of all rows below.
HOT_ROWS, MOST_HOT = 64, 10_000


def split_join(big: DataFrame, key: str, small: DataFrame, small_key: str, rows: str, total: int) -> DataFrame:
    """Inner join on a key that one row of ``small`` has; hot keys never meet in one task.

    ``rows`` counts ``big``'s rows of the key, ``total`` all of them. Keys with more than
    ``2 * total / MOST_HOT`` rows can't be more than ``MOST_HOT``: that bounds their table, which is
    broadcast, so their rows of ``big`` stay where they are. The others are joined by a shuffle, in which
    a key brings few rows.
    """
    most = max(HOT_ROWS, 2 * total // MOST_HOT)
    hot = small.filter(F.col(rows) > most).select(F.col(small_key).alias("hot_key_"))
    marked = big.join(F.broadcast(hot), F.col(key) == F.col("hot_key_"), "left")
    few = marked.filter("hot_key_ is null").drop("hot_key_").join(small.filter(F.col(rows) <= most), F.col(key) == F.col(small_key))
    many = marked.filter("hot_key_ is not null").drop("hot_key_").join(F.broadcast(small.filter(F.col(rows) > most)), F.col(key) == F.col(small_key))
    return few.unionByName(many)
