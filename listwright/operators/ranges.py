"""Ranks and running sums over a whole table without one sorting task.

Rows are dealt to ranges of the order; ranks and sums run inside a range, and what the ranges before it
hold is added. Only one row a range meets in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listwright.sources.shared import written


def ranked(df: DataFrame, order: Sequence[Column], sums: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``rank_`` (from 0, by a total order) and ``<name>_before``: each sum over all rows before."""
    keys = [f"_k{i}" for i in range(len(order))]
    held = df.withColumns(dict(zip(keys, order, strict=True)))
    dealt = written(held.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    per = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(F.col("_range").alias("_at"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_start") for c in ("_n", *[f"_s_{c}" for c in sums])])
    inside = Window.partitionBy("_range").orderBy(*keys)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_in", F.row_number().over(inside) - 1).withColumns({f"_b_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums})
    joined = out.join(starts, F.col("_range") == F.col("_at"))
    found = {"rank_": (F.col("_n_start") + F.col("_in")).cast("long")} | {f"{c}_before": F.col(f"_s_{c}_start") + F.col(f"_b_{c}") for c in sums}
    return joined.select(*df.columns, *[v.alias(k) for k, v in found.items()])
