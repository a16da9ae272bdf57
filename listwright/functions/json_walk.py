"""JSON of any depth, walked level by level with variants: no schema, no Python, no bound on the depth.

A level is one pass that takes every container apart; what is a container again is the next level's. The
number of passes is the depth of the deepest document, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.sources.shared import removed, written

_TAKEN_APART = """SELECT id_, concat(path, CASE WHEN kind LIKE 'OBJECT%' THEN concat('.', e.key) ELSE concat('[', e.pos, ']') END) AS path, e.value AS v, schema_of_variant(e.value) AS kind
  FROM {level}, LATERAL variant_explode(v) AS e"""


def leaves(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, kind, value): every scalar of a JSON text, at any depth, with its path and the name of its type.

    Paths are like ``$.offers[0].price``; numbers come as Spark writes them, a JSON null has the type VOID
    and no value. Texts that aren't JSON, and empty containers, have no leaf.
    """
    first = df.select(F.col(key).alias("id_"), F.lit("$").alias("path"), F.try_parse_json(F.col(json)).alias("v")).filter("v is not null")
    level, out = first.withColumn("kind", F.schema_of_variant("v")), None
    box = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
    last = None
    while True:
        found = level.filter(~box).select(F.col("id_").alias(key), "path", "kind", F.expr("try_variant_get(v, '$', 'string')").alias("value"))
        kept = written(found, "json-leaves")
        out = kept if out is None else out.unionByName(kept)
        boxes = level.filter(box)
        if last is not None and boxes.isEmpty():
            removed(last)
            return out
        following = written(df.sparkSession.sql(_TAKEN_APART, level=boxes), "json-level")
        if last is not None:
            removed(last)
        level = last = following


def first_of(found: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """(key, ...): per name the value of the shallowest leaf whose path ends as the pattern says; the first path on ties."""
    deep = F.size(F.split("path", r"[.\[]"))
    return found.groupBy(key).agg(*[F.min_by(F.when(F.col("path").rlike(f"(?:{p})$"), F.col("value")), F.when(F.col("path").rlike(f"(?:{p})$") & F.col("value").isNotNull(), F.struct(deep.alias("deep"), F.col("path").alias("path")))).alias(n) for n, p in names.items()])
