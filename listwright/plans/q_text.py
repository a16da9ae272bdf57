"""Queries of text, rules, pages and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.functions import dates, numbers, text
from listwright.operators import registry_ops, reporting, rules
from listwright.plans.catalog import URL_KEY_SQL, query, table
from listwright.sources import extract

NAME_RULES = [("ring", "ring"), ("tool", "bolt|gear"), ("color", r"\b(red|blue)\b"), ("small", "small")]
NAME_CASE = "CASE " + " ".join(f"WHEN regexp_matches(lower(p_name), '{p}') THEN '{n}'" for n, p in NAME_RULES) + " END"


@query(f"SELECT p_partkey, {NAME_CASE} AS label FROM part")
def rule_first_match(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", rules.first_match(F.lower("p_name"), NAME_RULES).alias("label"))


@query("SELECT p_partkey, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(p_name), '{p}') THEN '{n}' END" for n, p in NAME_RULES) + ") AS labels FROM part")
def rule_all_matches(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(rules.all_matches(F.lower("p_name"), NAME_RULES), ",").alias("labels"))



@query("""SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'studio' WHEN 1 THEN 'villa' WHEN 2 THEN 'land' WHEN 3 THEN 'apartment' WHEN 4 THEN 'maisonette' WHEN 5 THEN 'store' WHEN 6 THEN 'office' WHEN 7 THEN 'store' END AS type FROM part""")
def type_cascade(spark, sf_dir):
    """Title before the field as it is before the URL; the agency's office is no office."""
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("p_partkey") % 9).cast("int"))
    title = pick("A garsoniera", "x", "x", "Ρετιρέ 5ου ορόφου", "Μεζονέτα ή διαμέρισμα", "κατάστημα | Μεσιτικό Γραφείο Άλφα", "Γραφείο στο κέντρο", "Επαγγελματικός χώρος", "Μεσιτικό Γραφείο Άλφα")
    field, url = pick("land", "villa", "", "house", "", "", "", "office", ""), pick("/", "/oikopedo/", "/oikopedo/", "/", "/", "/", "/", "/", "/x/")
    return table(spark, sf_dir, "part").select("p_partkey", rules.type_of(text.fold(title), field, url).alias("type"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(text, '(?:the|and|der)(?: [a-z]{1,2} [a-z]+)?'), lambda x: x IN ('the', 'and', 'der'))) > 0 AS hit FROM documents")
def guarded_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rules.guarded_match(F.col("text"), "the|and|der", " [a-z]{1,2} [a-z]+").alias("hit"))


FOLD = "replace(strip_accents(lower(text)), 'ς', 'σ')"


@query(f"SELECT doc_id, {FOLD} AS folded FROM documents")
def fold_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\\p{L}{5,}'))) AS n_words FROM documents")
def word_set(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.words(F.col("text"))).cast("long").alias("n_words"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), ' ') AS key FROM documents")
def alnum_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.alnum_key(F.col("text")).alias("key"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[\\x{0400}-\\x{04FF}]') OR lang = 'de'")
def char_class_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(text.has_cyrillic(F.col("text")) | (F.col("lang") == "de")).select("doc_id")


@query("SELECT o_orderkey, round(o_totalprice, 2) AS en, floor(o_totalprice) AS de, CAST(o_orderkey + 0.5 AS DOUBLE) AS comma FROM orders")
def locale_number(spark, sf_dir):
    p = F.col("o_totalprice")
    en = F.format_number(p, 2)
    de = F.translate(F.format_number(F.floor(p), 0), ",", ".")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", numbers.locale_number(en).alias("en"),
        F.when(p < 1000, F.floor(p).cast("double")).otherwise(numbers.locale_number(de)).alias("de"),
        numbers.locale_number(F.concat(F.col("o_orderkey").cast("string"), F.lit(",5"))).alias("comma"),
    )


@query("SELECT o_orderkey, replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', ' ') AS shown FROM orders")
def money_format(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.money(F.col("o_totalprice")).alias("shown"))


@query("SELECT o_orderkey, o_totalprice AS price, CAST(o_custkey AS DOUBLE) AS area FROM orders WHERE o_custkey > 0")
def price_from_text(spark, sf_dir):
    t = F.concat(F.lit("flat "), F.col("o_custkey").cast("string"), F.lit(" m² for "), F.format_number("o_totalprice", 2), F.lit(" € now"))
    return table(spark, sf_dir, "orders").filter("o_custkey > 0").select("o_orderkey", extract.price_in(t).alias("price"), extract.area_in(t).alias("area"))




TRACKED = "url || CASE page_id % 4 WHEN 0 THEN '?utm_source=a&id=5' WHEN 1 THEN '?id=5&lang=el&fbclid=1' WHEN 2 THEN '/?sr=9#top' ELSE '' END"


@query(f"SELECT page_id, {URL_KEY_SQL} AS key_url FROM (SELECT page_id, {TRACKED} AS url FROM pages)")
def url_key(spark, sf_dir):
    k = F.col("page_id") % 4
    tail = F.when(k == 0, "?utm_source=a&id=5").when(k == 1, "?id=5&lang=el&fbclid=1").when(k == 2, "/?sr=9#top").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", text.url_key(F.concat("url", tail)).alias("key_url"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(?:[a-zA-Z]+:)?//([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages")
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.host(F.col("url")).alias("host"))


@query("SELECT page_id, url || '+é' AS plain FROM pages")
def url_decode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.unquote(F.concat(F.col("url"), F.lit("+%C3%A9"))).alias("plain"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&euro;', '€'), '&amp;', '&'), '\s+', ' ', 'g')) AS plain FROM pages""")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))


@query("SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)<a[^>]+href=\"([^\"#]+)', 1)) AS link FROM pages")
def link_explode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(text.links(F.col("html"))).alias("link"))


def _without(tags: str) -> str:
    out = "html"
    for t in tags.split():
        out = f"regexp_replace({out}, '(?is)<{t}\\b.*?</{t}>', ' ', 'g')"
    return out


@query(f"SELECT page_id, length(replace({_without('script style nav header footer aside noscript form select')}, ' ', '')) AS n FROM pages")
def boilerplate(spark, sf_dir):
    """Letters of a page without its boilerplate (these pages have no block with a menu's class)."""
    bare = text.without_boilerplate(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(F.replace(bare, F.lit(" "), F.lit(""))).cast("long").alias("n"))


@query()
def page_fields(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", extract.page_fields(text.without_boilerplate(F.col("html"))).alias("x")).select("page_id", "x.*")


@query("SELECT page_id, 'd' || page_id AS meta_text FROM pages")
def meta_extract(spark, sf_dir):
    page = F.concat(F.lit('<meta content="d'), F.col("page_id").cast("string"), F.lit('" property="og:title">'), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", text.meta(page, "og:title").alias("meta_text"))


@query("""SELECT page_id, len(string_split(html, '<li>')) - 1 AS n_cards, array_to_string(list_transform(string_split(html, '<li>')[2:], lambda c: regexp_extract(c, 'href="([^"]*)"', 1)), '|') AS hrefs FROM pages""")
def html_cards(spark, sf_dir):
    found = extract.cards(F.col("html"), "<li>", {"href": 'href="([^"]*)"', "label": "<a[^>]*>(.*?)</a>"})
    hrefs = F.array_join(F.transform(found, lambda c: F.coalesce(c["href"], F.lit(""))), "|")
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n_cards"), hrefs.alias("hrefs"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_pick(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT user_id, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def json_array(spark, sf_dir):
    packed = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.collect_list(F.from_json("props", "k bigint"))).alias("doc"))
    item = packed.select("user_id", F.explode(F.from_json("doc", "array<struct<k: bigint>>")).alias("x"))
    return item.groupBy("user_id").agg(F.sum("x.k").alias("total"))


@query("SELECT word, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\p{L}{5,}'))) AS word FROM documents) GROUP BY 1")
def doc_frequency(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(text.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


@query("WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\p{L}{5,}'))) AS word FROM documents), r AS (SELECT word FROM w GROUP BY 1 HAVING count(*) BETWEEN 2 AND 25) SELECT doc_id, count(*) AS n_rare FROM w JOIN r USING (word) GROUP BY 1")
def rare_words(spark, sf_dir):
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.words(F.col("text"))).alias("word"))
    rare = each.groupBy("word").agg(F.count(F.lit(1)).alias("df")).filter("df between 2 and 25")
    return each.join(rare, "word").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rare"))


@query("SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS raw, CAST(l_shipdate AS DATE) AS d, CASE WHEN l_shipdate >= TIMESTAMP '2010-01-01' THEN CAST(l_shipdate AS DATE) END AS recent, date_diff('day', DATE '2020-01-01', CAST(l_shipdate AS DATE)) AS n FROM lineitem")
def parse_dates(spark, sf_dir):
    d = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("raw"), dates.sheet_day(F.date_format("l_shipdate", "M/d/yyyy")).alias("d"),
        dates.parse_day(F.date_format("l_shipdate", "dd/MM/yyyy"), F.lit("2030-01-01").cast("date")).alias("recent"), dates.day_number(d).cast("long").alias("n"),
    )


@query("""SELECT p_partkey, DATE '2024-03-31' - CAST(CASE p_partkey % 6 WHEN 0 THEN p_size * 7 WHEN 1 THEN p_size WHEN 2 THEN p_size // 24 WHEN 3 THEN p_size * 30 ELSE 0 END AS INTEGER) AS card,
  DATE '2024-03-31' - CAST(CASE p_partkey % 6 WHEN 0 THEN p_size * 7 WHEN 1 THEN p_size WHEN 3 THEN p_size * 30 ELSE 0 END AS INTEGER) AS profile FROM part""")
def relative_dates(spark, sf_dir):
    """Result cards count hours as parts of days, profiles as today."""
    k, n = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    said = F.when(k == 0, F.concat(F.lit("Πριν "), n, F.lit(" εβδομάδες"))).when(k == 1, F.concat(n, F.lit(" days ago"))).when(k == 2, F.concat(F.lit("Πριν "), n, F.lit(" ώρες")))
    said = said.when(k == 3, F.concat(F.lit("πριν από "), n, F.lit(" μήνες"))).when(k == 4, F.lit("Μόλις τώρα")).otherwise(F.lit("Σήμερα"))
    today = F.lit("2024-03-31").cast("date")
    return table(spark, sf_dir, "part").select("p_partkey", dates.relative_day(said, today).alias("card"), dates.relative_day(said, today, whole_hours=False).alias("profile"))


@query("SELECT event_id, CAST(timezone('Europe/Athens', timezone('UTC', to_timestamp(CAST(1700000000 + event_id * 3600 AS BIGINT))::TIMESTAMP)) AS DATE) AS d FROM events".replace("to_timestamp(CAST(1700000000 + event_id * 3600 AS BIGINT))::TIMESTAMP", "make_timestamp((1700000000 + event_id * 3600) * 1000000)"))
def epoch_days(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.epoch_day(1_700_000_000 + F.col("event_id") * 3600).alias("d"))


@query("SELECT doc_id, len(encode(text)) AS bytes, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents".replace("len(encode(text))", "octet_length(encode(text))"))
def escape_and_length(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), text.html_escape(F.col("text")).alias("escaped"))


@query("SELECT o_orderkey, CAST(least(500, greatest(10, ceil(o_orderkey / 14.0))) AS BIGINT) AS budget FROM orders")
def recheck_budget(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.recheck_budget(F.col("o_orderkey"), 500, 7).alias("budget"))


@query("""SELECT page_id, regexp_matches(path, '[0-9]{3,}') AND (len(path) - len(replace(path, '/', '')) <= 2 OR regexp_matches(path, '(?i)/(property|listing|estate)[/-]?')) AND length(path) >= 2
  AND NOT regexp_matches(path, '(?i)blog|news|article|service') AS detail FROM (SELECT page_id, '/' || CASE page_id % 5 WHEN 0 THEN 'property/a/b/c-' WHEN 1 THEN 'blog/' WHEN 2 THEN 'x/y/z/' ELSE '' END || (100 + page_id) AS path FROM pages)""")
def detail_urls(spark, sf_dir):
    """Which URLs are one listing's page."""
    k = F.col("page_id") % 5
    path = F.concat(F.lit("https://site.example/"), F.when(k == 0, "property/a/b/c-").when(k == 1, "blog/").when(k == 2, "x/y/z/").otherwise(""), (100 + F.col("page_id")).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", extract.looks_like_detail(path).alias("detail"))


@query("""WITH u AS (SELECT page_id, page_id % 7 AS site, CASE WHEN page_id % 3 = 0 OR (page_id % 7 = 2 AND page_id % 5 > 0) THEN '/en/' ELSE '/' END AS p FROM pages)
  SELECT page_id FROM u JOIN (SELECT site, count_if(p = '/') >= 0.3 * count(*) AS prune FROM u GROUP BY 1) USING (site) WHERE NOT prune OR p = '/'""")
def language_prune(spark, sf_dir):
    """Translated paths go at sites where enough URLs are local."""
    k = F.col("page_id")
    urls = table(spark, sf_dir, "pages").select("page_id", (k % 7).alias("site"), F.concat(F.lit("https://a.example"), F.when((k % 3 == 0) | ((k % 7 == 2) & (k % 5 > 0)), "/en/").otherwise("/"), k.cast("string")).alias("link"))
    return reporting.language_prune(urls, "site", F.col("link")).select("page_id")


@query("""WITH u AS (SELECT o_orderkey, o_custkey % 50 AS site, o_orderkey % 4 AS k, o_orderdate AS lastmod FROM orders), r AS (SELECT *, k = 0 AND lastmod > TIMESTAMP '1996-01-01' OR k IN (1, 3) AS reads FROM u),
  t AS (SELECT *, sum(reads::INT) OVER (PARTITION BY site ORDER BY o_orderkey) AS turn FROM r)
  SELECT o_orderkey, CASE WHEN k = 0 THEN CASE WHEN lastmod > TIMESTAMP '1996-01-01' THEN 'refetch' ELSE 'keep' END WHEN k = 2 OR turn > 40 THEN 'skip' ELSE 'fetch' END AS todo FROM t""")
def stale_urls(spark, sf_dir):
    """What a crawl does with each URL: keep, refetch, fetch or skip."""
    o = table(spark, sf_dir, "orders")
    url = F.concat(F.lit("http://a/"), F.col("o_orderkey").cast("string"))
    urls = o.select("o_orderkey", (F.col("o_custkey") % 50).alias("source_domain"), F.concat(url, F.lit("/")).alias("url"), F.col("o_orderdate").alias("lastmod"), F.col("o_orderkey").alias("ord"))
    known = o.filter("o_orderkey % 4 = 0").select(url.alias("url"), F.lit("1996-01-01").cast("timestamp").alias("date_sitemap"))
    return reporting.to_fetch(urls, known, o.filter("o_orderkey % 4 = 2").select(url.alias("url")), 40).select("o_orderkey", "todo")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1 HAVING count(*) = 1")
def sole_claims(spark, sf_dir):
    """Guessed sites that exactly one agency claims."""
    guesses = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("name"), "o_orderkey", "o_custkey", F.concat(F.lit("https://www.c"), F.col("o_custkey").cast("string"), F.lit(".example/")).alias("url"))
    registry = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string"), F.lit(".example")).alias("domain"))
    return registry_ops.sole_claims(guesses, registry).select("o_custkey", "o_orderkey")
