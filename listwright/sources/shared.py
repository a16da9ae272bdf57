"""The folder that all executors share, where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local session may make its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='listwright-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and its size is known.

    Small tables are then broadcast by their file size, so the large side of a join isn't shuffled. The
    files go when the driver's JVM ends; until then lost executors can't lose them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/listwright-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at_ = path
    return table


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with further columns, each evaluated once a row: Catalyst writes none of them into what reads it."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def removed(table: DataFrame) -> None:
    """Deletes the files of a ``written`` table that no later step reads, not even after a lost executor."""
    context = table.sparkSession.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(table.written_at_)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
