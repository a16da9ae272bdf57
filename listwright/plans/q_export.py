"""Queries of the packed export, the walk over links, totals at all levels, and what reports read of the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.functions import text
from listwright.operators import crawling, gold, history, packed, reporting
from listwright.plans.catalog import query, table
from listwright.plans.q_listings import DIFF_SQL, snapshots
from listwright.sources import feeds

_LINK = "CASE WHEN o_custkey % 9 = 4 THEN 'no link ' || o_custkey WHEN o_custkey % 4 <> 1 THEN 'https://site' || (o_custkey % 7) || '.example/o/' || o_orderkey END"
_ORDERS = f"""SELECT o_orderkey, o_orderstatus, CASE WHEN o_custkey % 5 = 0 THEN o_orderpriority END AS o_orderpriority, CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority END AS again,
  CAST(o_orderdate AS DATE) AS day, {_LINK} AS link, CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice) ELSE o_totalprice END AS price, CASE WHEN o_custkey % 6 = 2 THEN 'say "' || o_orderkey || '", \\' END AS said FROM orders"""


def packed_orders(spark, sf_dir) -> packed.Packed:
    o, k = table(spark, sf_dir, "orders"), F.col("o_custkey")
    link = F.when(k % 9 == 4, F.concat(F.lit("no link "), k)).when(k % 4 != 1, F.concat(F.lit("https://site"), k % 7, F.lit(".example/o/"), "o_orderkey"))
    rows = o.select(
        "o_orderkey", "o_orderstatus", F.when(k % 5 == 0, F.col("o_orderpriority")).alias("o_orderpriority"), F.when(k % 3 == 0, F.col("o_orderpriority")).alias("again"),
        F.to_date("o_orderdate").alias("day"), link.alias("link"), F.when(F.col("o_orderkey") % 2 == 0, F.floor("o_totalprice").cast("double")).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(k % 6 == 2, F.concat(F.lit('say "'), "o_orderkey", F.lit('", \\'))).alias("said"),
    )
    return packed.pack(rows, "o_orderkey", ["o_orderstatus", "o_orderpriority", "again"], ["day"], ["link"], ["price", "said"])


@query(_ORDERS)
def packed_export(spark, sf_dir):
    """Rows packed and unpacked are the rows."""
    return packed.unpacked(packed_orders(spark, sf_dir), "o_orderkey")


@query(f"""WITH o AS ({_ORDERS}), u AS (SELECT unnest([o_orderstatus, o_orderpriority, again, CASE WHEN link LIKE 'https%' THEN regexp_extract(link, '^https?://[^/]+/?') WHEN link IS NOT NULL THEN '' END]) AS value, unnest([0, 1, 2, 4]) AS i, o_orderkey FROM o),
  f AS (SELECT value, min(o_orderkey * 10 + i) AS first FROM u WHERE value IS NOT NULL GROUP BY 1) SELECT row_number() OVER (ORDER BY first) - 1 AS code, value FROM f""")
def packed_strings(spark, sf_dir):
    """The one table of strings of four columns, numbered by first use."""
    return packed_orders(spark, sf_dir).strings.select(F.col("code").cast("long").alias("code"), "value")


@query(f"""WITH o AS ({_ORDERS}) SELECT 'rows-' || lpad(CAST(i // 1000 AS VARCHAR), 6, '0') || '.json' AS name, CAST(count(*) AS INTEGER) AS n FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM o) GROUP BY 1
  UNION ALL SELECT 'strings-000000.json', CAST(count(DISTINCT v) AS INTEGER) FROM (SELECT unnest([o_orderstatus, o_orderpriority, again, CASE WHEN link LIKE 'https%' THEN regexp_extract(link, '^https?://[^/]+/?') WHEN link IS NOT NULL THEN '' END]) AS v FROM o)""")
def packed_manifest(spark, sf_dir):
    """The documents of the export and how many rows or strings each has."""
    return packed.documents(packed_orders(spark, sf_dir), 1000).select("name", "n")


@query(DIFF_SQL + """ SELECT CAST(k % 3 AS BIGINT) AS region, CASE WHEN k % 7 > 0 THEN CAST(k % 7 AS BIGINT) END AS source, count_if(status <> 'gone')::BIGINT AS listings, count_if(status = 'new')::BIGINT AS "new", count_if(status = 'gone')::BIGINT AS removed,
  count_if(status = 'down')::BIGINT AS price_down, count_if(status = 'up')::BIGINT AS price_up, CAST(2 - bit_count(GROUPING(CAST(k % 3 AS BIGINT), CASE WHEN k % 7 > 0 THEN CAST(k % 7 AS BIGINT) END)) AS INTEGER) AS level
  FROM d GROUP BY ROLLUP (CAST(k % 3 AS BIGINT), CASE WHEN k % 7 > 0 THEN CAST(k % 7 AS BIGINT) END)""")
def totals_rollup(spark, sf_dir):
    """Counters by region and source, by region, and over all, in one pass; a source may be unknown."""
    diff = history.snapshot_diff(*snapshots(spark, sf_dir), "k", "v")
    return reporting.totals(diff.withColumns({"region": F.col("k") % 3, "source": F.when(F.col("k") % 7 > 0, F.col("k") % 7)}), "region", "source")


def _walk_sql(levels: int) -> str:
    steps = []
    for i in range(levels):
        steps.append(f"""n{i} AS MATERIALIZED (SELECT host, url, turn FROM (SELECT f.host, f.url, a.n + row_number() OVER (PARTITION BY f.host ORDER BY f.t, f.place, f.url) - 1 AS turn
    FROM (SELECT l.host, l.target AS url, min(n.turn * 10 + l.place) // 10 AS t, min(n.turn * 10 + l.place) % 10 AS place FROM {f'n{i - 1}' if i else 's'} n JOIN l ON n.host = l.host AND n.url = l.url GROUP BY 1, 2) f
    JOIN (SELECT host, count(*) AS n FROM v{i} GROUP BY 1) a ON a.host = f.host WHERE NOT EXISTS (SELECT 1 FROM v{i} v WHERE v.host = f.host AND v.url = f.url)) WHERE turn < 12),
  v{i + 1} AS MATERIALIZED (FROM v{i} UNION ALL FROM n{i})""")
    return ", ".join(steps)


_PAGES = """p AS (SELECT 'h' || (c_custkey % 150) AS host, 'p' || c_custkey AS url, row_number() OVER (PARTITION BY c_custkey % 150 ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY c_custkey % 150) AS n FROM customer),
  l AS (SELECT a.host, a.url, b.place, t.url AS target FROM p a, (SELECT unnest([0, 1, 2, 3]) AS place) b JOIN p t ON t.host = a.host AND t.i = (CASE b.place WHEN 0 THEN 2 * a.i WHEN 1 THEN 2 * a.i + 1 WHEN 2 THEN a.i // 2 + 1 ELSE (a.i * 7) % a.n + 1 END)),
  s AS MATERIALIZED (SELECT host, url, i - 1 AS turn FROM p WHERE i <= 2), v0 AS (FROM s)"""


@query(f"WITH {_PAGES}, {_walk_sql(8)} SELECT host, url, CAST(turn AS INTEGER) AS turn FROM v8")
def frontier_walk(spark, sf_dir):
    """Customers as pages of 150 sites that link to one another: what a walk of twelve pages a site reads."""
    from pyspark.sql.window import Window

    host = F.concat(F.lit("h"), F.col("c_custkey") % 150)
    by = Window.partitionBy("host")
    p = table(spark, sf_dir, "customer").select(host.alias("host"), F.concat(F.lit("p"), "c_custkey").alias("url"), "c_custkey")
    p = p.select("host", "url", F.row_number().over(by.orderBy("c_custkey")).alias("i"), F.count(F.lit(1)).over(by).alias("n"))
    i, n = F.col("i"), F.col("n")
    to = F.posexplode(F.array(2 * i, 2 * i + 1, F.floor(i / 2).cast("int") + 1, ((i * 7) % n + 1).cast("int"))).alias("place", "to")
    links = p.select("host", "url", to).join(p.select(F.col("host").alias("h"), F.col("url").alias("target"), F.col("i").alias("at")), (F.col("host") == F.col("h")) & (F.col("to") == F.col("at"))).select("host", "url", "place", "target")
    return crawling.walked(links, p.filter("i <= 2").select("host", "url", F.col("i").alias("place")))


@query("""SELECT domain, CAST(ord AS BIGINT) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ord) AS rn FROM (SELECT 'd' || (s_suppkey % 37) AS domain, s_suppkey AS ord, s_nationkey AS k FROM supplier)
  WHERE k % 5 <> 1 AND k % 3 <> 0 AND k % 7 <> 2) WHERE rn = 1""")
def eligible_sources(spark, sf_dir):
    """Sources that work, have listings and don't forbid reading, one a domain."""
    k = F.col("s_nationkey")
    registry = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("d"), F.col("s_suppkey") % 37).alias("domain"), F.col("s_suppkey").alias("ord"), F.when(k % 5 == 1, "dead").otherwise("ok").alias("site_status"),
        F.when(k % 3 == 0, "no").when(k % 2 == 0, "yes").otherwise("true").alias("has_listings"), F.when(k % 7 == 2, "explicit_no").when(k % 7 == 3, None).otherwise("ok").alias("robots_ok"),
    )
    return reporting.eligible_sources(registry).select("domain", F.col("ord").cast("long").alias("ord"))


@query(DIFF_SQL + """, c AS (SELECT CAST(k % 20 AS BIGINT) AS source, count_if(status <> 'gone') AS listings, count_if(status IN ('new', 'gone', 'down', 'up')) AS moved FROM d GROUP BY 1)
  SELECT source, listings::BIGINT AS listings, CAST(row_number() OVER (ORDER BY moved DESC, listings DESC, source) - 1 AS BIGINT) AS place FROM c""")
def busiest_sources(spark, sf_dir):
    """Sources by how much they moved, then by size."""
    diff = history.snapshot_diff(*snapshots(spark, sf_dir), "k", "v").withColumn("source", F.col("k") % 20)
    order = reporting.busiest_first(reporting.source_counters(diff, "source").filter("source is not null"), "source")
    return order.coalesce(1).select("source", "listings", F.monotonically_increasing_id().alias("place"))


@query(r"""SELECT page_id, regexp_extract(url, '^(.*/)?') AS prefix, regexp_replace(url, '^.*/', '') AS rest, regexp_full_match(regexp_extract(url, '([^/?#]*)([?#].*)?$', 1), '[a-z0-9-]{0,40}') AS label_ok FROM pages""")
def url_parts(spark, sf_dir):
    """Addresses cut at their last slash, and whether what follows is a plain label."""
    cut = gold.split_url(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", cut["prefix"].alias("prefix"), cut["rest"].alias("rest"), text.label_ok(F.regexp_extract("url", r"([^/?#]*)([?#].*)?$", 1)).alias("label_ok"))


@query("""SELECT o_orderkey, to_json(map_from_entries(list_filter([('a', nullif(o_orderstatus, 'F')), ('b', CASE WHEN o_custkey % 2 = 0 THEN '' ELSE o_orderpriority END), ('c', CAST(o_orderkey AS VARCHAR))], lambda e: e[2] IS NOT NULL AND e[2] <> ''))) AS fields FROM orders""")
def filled_fields(spark, sf_dir):
    """A row's fields without those that are null or empty."""
    o = table(spark, sf_dir, "orders")
    fields = F.create_map(F.lit("a"), F.nullif("o_orderstatus", F.lit("F")), F.lit("b"), F.when(F.col("o_custkey") % 2 == 0, "").otherwise(F.col("o_orderpriority")), F.lit("c"), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", F.to_json(gold.drop_empty(fields)).alias("fields"))


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-08-02' - 120")
def within_window(spark, sf_dir):
    """Rows no older than 120 days."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date_published"))
    return feeds.within_window(rows, F.lit("1998-08-02").cast("date"), 120).select("o_orderkey")


_DOC = """'{"id":' || o_orderkey || ',"offers":[{"price":"' || o_custkey || '","tags":["' || o_orderstatus || '","x, y"]},{"price":"9","at":[[1],[2,[' || (o_custkey % 7) || ']]]}],"none":null,"deep":'
  || repeat('{"in":[', CAST(o_custkey % 6 AS INTEGER)) || '"end"' || repeat(']}', CAST(o_custkey % 6 AS INTEGER)) || ',"empty":{}}'"""


@query(f"""WITH d AS (SELECT o_orderkey, {_DOC} AS doc FROM orders) SELECT o_orderkey, replace(t.fullkey, '"', '') AS path, CASE WHEN t.type = 'VARCHAR' THEN t.atom ->> '$' WHEN t.type <> 'NULL' THEN CAST(t.atom AS VARCHAR) END AS value
  FROM d, json_tree(d.doc) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')""")
def json_leaves(spark, sf_dir):
    """All scalars of documents of several depths, with their paths."""
    from listwright.functions import json_walk

    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_DOC).alias("doc"))
    return json_walk.leaves(docs, "o_orderkey", "doc").select("o_orderkey", "path", "value")


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS price, CASE WHEN o_custkey % 6 = 0 THEN 'end' END AS told, o_orderstatus AS tag FROM orders")
def json_first(spark, sf_dir):
    """The shallowest price, text and tag of each document."""
    from listwright.functions import json_walk

    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_DOC).alias("doc"))
    found = json_walk.leaves(docs, "o_orderkey", "doc")
    return json_walk.first_of(found, "o_orderkey", {"price": r"\.price", "told": r"\.deep", "tag": r"\.tags\[\d+\]"})
