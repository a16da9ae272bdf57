"""Landed files as DataFrames. The engine never fetches: pages, feeds and exports are files."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright.operators.matching import FILTER_SCHEMA


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",") -> DataFrame:
    """All-string CSV with a header; empty fields are null. A schema spares the scan that infers one."""
    reader = spark.read.options(header=True, multiLine=True, escape='"', encoding="UTF-8", sep=sep)
    return (reader.schema(strings(*columns)) if columns else reader).csv(path)


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.schema(strings(*columns)).csv(path, sep="\t")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All sources as one bag; ``source_priority`` keeps their order, missing columns are null."""
    marked = [df.withColumns({"source_file": F.lit(name), "source_priority": F.lit(k)}) for k, (name, df) in enumerate(sources.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def read_existing_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The union of those files that exist, in the given order."""
    return union_sources({p: read_csv(spark, p) for p in paths if exists(spark, p)})


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) of sitemap XML files."""
    schema = T.StructType([T.StructField("loc", T.StringType()), T.StructField("lastmod", T.StringType())])
    rows = spark.read.format("xml").option("rowTag", "url").schema(schema).load(path)
    return rows.select(F.trim("loc").alias("loc"), F.to_date(F.substring("lastmod", 1, 10)).alias("lastmod"))


def property_sitemaps(index: DataFrame, most: int = 3) -> DataFrame:
    """Of a sitemap index, the first few sub-sitemaps of each site that look like listings.

    Without a ``site`` column the site is the host.
    """
    from pyspark.sql.window import Window

    from listwright.functions.text import host

    if "site" not in index.columns:
        index = index.withColumn("site", host(F.col("loc")))
    wanted = F.lower("loc").rlike("propert|listing|estate|akinit|ads")
    w = Window.partitionBy("site").orderBy("loc")
    return index.filter(wanted).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most).drop("_rn")


def read_sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    """(loc) of the sitemaps that index files name."""
    rows = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path)
    return rows.select(F.trim("loc").alias("loc"))


def read_filters(spark: SparkSession, path: str) -> DataFrame:
    """Saved filters from a JSON document {"filters": [...]}; enabled unless they say otherwise."""
    doc = spark.read.schema(f"filters array<struct<{_struct_fields(FILTER_SCHEMA)}>>").json(path, multiLine=True)
    rows = doc.select(F.explode("filters").alias("f")).select("f.*")
    return rows.withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def _struct_fields(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (x.strip().split(" ", 1) for x in ddl.split(", ")))


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """Polygon and MultiPolygon features of GeoJSON: id, official, polygons (arrays of rings of lat, lon), split.

    ``split`` names areas that share the polygon, with the centres that the document gives them.
    """
    schema = (
        "features array<struct<properties: struct<id: string, official: boolean, split: array<string>, centre: array<double>>, geometry: struct<type: string, coordinates: string>>>, "
        "areas_without_polygon array<struct<id: string, centre: array<double>>>"
    )
    doc = spark.read.schema(schema).json(path, multiLine=True)
    centres = F.concat(
        F.transform(F.coalesce("areas_without_polygon", F.array()), lambda a: F.struct(a["id"].alias("id"), a["centre"].alias("centre"))),
        F.transform("features", lambda x: F.struct(x["properties"]["id"].alias("id"), x["properties"]["centre"].alias("centre"))),
    )
    feature = doc.select(centres.alias("centres"), F.explode("features").alias("x"))
    shape, kind = F.col("x.geometry.coordinates"), F.col("x.geometry.type")
    ring = lambda r: F.transform(r, lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))
    one = F.array(F.transform(F.from_json(shape, "array<array<array<double>>>"), ring))
    many = F.transform(F.from_json(shape, "array<array<array<array<double>>>>"), lambda rings: F.transform(rings, ring))
    shared = F.filter("centres", lambda c: F.array_contains("x.properties.split", c["id"]) & c["centre"].isNotNull())
    split = F.when(F.size("x.properties.split") > 0, F.transform(shared, lambda c: F.struct(c["id"].alias("id"), c["centre"][0].alias("lat"), c["centre"][1].alias("lon"))))
    return feature.select(
        "x.properties.id", F.coalesce("x.properties.official", F.lit(False)).alias("official"),
        F.when(kind == "MultiPolygon", many).otherwise(one).alias("polygons"), split.alias("split"),
    )


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Areas that the document describes without a polygon: id, name, district, centre, reference prices."""
    schema = "areas_without_polygon array<struct<id: string, gr: string, district: string, centre: array<double>, sale: double, rent: double, pattern: string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("areas_without_polygon").alias("a")).select("a.*")
    return rows.select("id", F.col("gr").alias("name"), "district", F.get("centre", F.lit(0)).alias("lat"), F.get("centre", F.lit(1)).alias("lon"), "sale", "rent", "pattern")


def pages_left(urls: DataFrame, done: DataFrame) -> DataFrame:
    """Result pages that earlier runs haven't read: a resumable scan."""
    return urls.join(done.select("url").distinct(), "url", "left_anti")


def write_listings(df: DataFrame, path: str, columns: list[str]) -> None:
    """A full overwrite of the given columns, committed as one job."""
    df.select(*columns).write.mode("overwrite").parquet(path)


def write_sorted(df: DataFrame, path: str, columns: list[str], *order: str) -> None:
    """A full overwrite in an order: ranges of it follow one another over the files."""
    df.select(*columns).orderBy(*order).write.mode("overwrite").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_sources(spark: SparkSession, df: DataFrame, path: str, part: str = "source_domain") -> None:
    """Only the sources in ``df`` are replaced; others' partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
