"""Queries of the joins by place and size, photo code and text; their SQL compares all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.operators import similar
from listwright.plans.catalog import listings, query, table, with_listings

#: From rows r (x) and their pairs (a, b, m) to a row each: the first row alike, how many others, the nearest.
_ROWS = """c AS (SELECT x, min(x) OVER (PARTITION BY {same}) AS class_id FROM r), two AS (SELECT a AS x, b AS y, m FROM pairs UNION ALL SELECT b, a, m FROM pairs),
  n AS (SELECT x, count(*) AS n, min({{'m': m, 'y': y}}) AS near FROM two GROUP BY x)
SELECT c.x AS {key}, class_id, coalesce(n, 0) AS n_links, near.y AS nearest, round({at}, 6) AS nearest_at FROM c LEFT JOIN n ON c.x = n.x"""

_KM = "sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * 0.76::DOUBLE * (a.lon - b.lon) * 0.76::DOUBLE) * 111"


@query(
    with_listings(f""", r AS (SELECT ord AS x, transaction AS t, type AS k, lat, lon, area_m2 AS m2 FROM lv WHERE transaction IS NOT NULL AND area_m2 > 0),
  pairs AS (SELECT a.x AS a, b.x AS b, round({_KM}, 9) AS m FROM r a JOIN r b ON a.t = b.t AND a.k = b.k AND a.x < b.x AND abs(a.m2 - b.m2) <= 0.15 * greatest(a.m2, b.m2) AND {_KM} <= 3),
  """ + _ROWS.format(same="t, k, lat, lon, m2", key="ord", at="near.m"))
)
def radius_links(spark, sf_dir):
    """All listings of one deal and type within 3 km and 15 % of the size, whatever their district."""
    rows = listings(spark, sf_dir, "ord", "transaction", "type", "lat", "lon", "area_m2")
    got = similar.radius_links(rows, ["transaction", "type"])
    return got.withColumn("nearest_at", F.round("nearest_at", 6))


@query(
    """WITH r AS (SELECT vec_id AS x, list_sum(list_transform(embedding[1:32], lambda v, i: CASE WHEN v > 0 THEN (1::BIGINT << (i - 1)::INTEGER) ELSE 0 END))::BIGINT AS code FROM embeddings),
  pairs AS (SELECT a.x AS a, b.x AS b, bit_count(xor(a.code, b.code))::INTEGER AS m FROM r a JOIN r b ON a.x < b.x AND bit_count(xor(a.code, b.code)) <= 5),
  """ + _ROWS.format(same="code", key="vec_id", at="near.m")
)
def photo_links(spark, sf_dir):
    """Photos whose codes, the signs of 32 components, differ in at most five bits."""
    codes = table(spark, sf_dir, "embeddings").select("vec_id", similar.sign_code(F.col("embedding"), 32).alias("code"))
    return similar.code_links(codes, "vec_id", "code", bits=32, parts=2, most=5)


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
  r AS (SELECT doc_id AS x, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' ')))) AS s FROM w WHERE len(w) > 0),
  e AS (SELECT x, len(s) AS n, unnest(s) AS t FROM r), k AS (SELECT a.x AS a, b.x AS b, a.n AS na, b.n AS nb, count(*) AS i FROM e a JOIN e b ON a.t = b.t AND a.x < b.x GROUP BY ALL),
  pairs AS (SELECT a, b, round(1 - i / (na + nb - i), 9) AS m FROM k WHERE i / (na + nb - i) >= 0.8 - 1e-9),
  """ + _ROWS.format(same="s", key="doc_id", at="near.m")
)
def text_links(spark, sf_dir):
    """Descriptions whose runs of three words have a similarity of 0.8 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", similar.shingles(F.col("text")).alias("tokens"))
    return similar.set_links(docs, "doc_id", "tokens").withColumn("nearest_at", F.round("nearest_at", 6))
