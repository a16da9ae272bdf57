"""The registry of agencies: landed home pages judged, directory entries compared, sites claimed and rechecked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listwright.functions.text import fold, host, latin, name_key

# Challenge pages, listing links, words of the trade, platforms' fingerprints.
CHALLENGES = (
    ("bot_check_imperva", "(?i)Pardon Our Interruption|_Incapsula_Resource"), ("bot_check_cloudflare", "(?i)<title>Just a moment|cf-chl"), ("bot_check_other", "(?i)Verifying your browser"),
)
LISTING_LINK = (
    r"""(?iu)href=["']([^"']*(?:/akinit|/aggeli|/property|/properties|/listing|/estate|/poliseis|/polisi|/pwlisi|/sale|/for-sale|/diamerism|/katoik|"""
    r"""/realestate|/ακίνητ|/αγγελ)[^"']*)["']"""
)
TRADE = r"(?iu)πώληση|πωλείται|ενοικίαση|τ\.μ\.|for sale|sq\.?m|€"
PLATFORMS = (
    ("wordpress", "(?i)wp-content|wordpress"), ("wix", r"(?i)wix\.com|wixstatic"), ("joomla", "(?i)/media/jui/|joomla"), ("realestate_crm_gr", r"(?i)realestatecrm|rencrm|crm\.gr"),
    ("houzez", "(?i)houzez"), ("wpresidence", "(?i)wpresidence"), ("estatik", "(?i)estatik"), ("real_homes", "(?i)realhomes|inspiry"),
)
DEEP_ITEM = r"""(?i)href=["']([^"'#]*?(?:\d{3,}|/akinito|/property/|/listing/|/estate/)[^"'#]*)["']"""
NOT_ITEM = r"(?i)\.(jpg|jpeg|png|webp|css|js|pdf)$|wp-content|tel:|mailto:"
SITEMAP_ITEM = "(?iu)<loc>[^<]*(?:akinit|property|properties|listing|aggeli|estate|ακίνητ)[^<]*</loc>"
ENOUGH_LINKS, CHALLENGE_READ = 5, 20_000
#: Statuses that are looked at again.
RECHECK = ("unreachable", "error", "bot_check", "http_")
# Words too common to tell an agency, and words of its kind.
COMMON_WORDS = """home homes house houses capital luxury property properties golden gold best smart city prime top new real
estate estates group invest investment investments greek greece hellenic hellas athens athina attica attiki global
international elite premium royal urban dream ideal perfect key keys one first star sun sea blue green white red alpha
omega delta meta pro plus max land lands living life build building buildings construction development developments
consulting consultants services service broker brokers agency agents realty realtor homefinders finders find space
spaces point center centre plaza world euro europe med mediterranean olympus olympic acropolis riviera south north
east west""".split()
KIND_WORDS = ("mesitiko", "grafeio", "real", "estate", "ike", "oe", "ee", "epe", "ae", "realestate", "properties", "property", "ltd", "group", "the")
NAME_READ = 300_000


def _challenge(html: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(CHALLENGES):
        out = F.when(F.substring(html, 1, CHALLENGE_READ).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _deep_links(html: Column, sitemap: Column, section: Column) -> Column:
    """Listing links one level deeper: on a section page of the same host, or in the sitemap."""
    own = F.filter(
        F.array_distinct(F.regexp_extract_all(section, F.lit(DEEP_ITEM), F.lit(1))),
        lambda x: (~x.rlike("^[a-zA-Z]+://") | (host(x) == host(F.col("final_url")))) & ~x.rlike(NOT_ITEM),
    )
    mapped = F.size(F.regexp_extract_all(sitemap, F.lit(SITEMAP_ITEM), F.lit(0)))
    return F.greatest(F.coalesce(F.size(own), F.lit(0)), F.coalesce(mapped, F.lit(0)))


def check_sites(rows: DataFrame, agent: str = "listwright") -> DataFrame:
    """Registry rows with landed answers, judged: site_status, robots_ok, has_listings, listing_links, platform.

    ``rows`` have website, http_status (null: no answer), final_url, html, robots, sitemap and section
    (a page of the site's own listings), each as landed or null.
    """
    html = F.coalesce("html", F.lit(""))
    no_site = F.coalesce(F.trim("website"), F.lit("")) == ""
    refused = F.col("http_status") >= 400
    status = (
        F.when(no_site, F.lit("no_site")).when(F.col("http_status").isNull(), F.lit("error")).when(refused, F.coalesce(_challenge(html), F.concat(F.lit("http_"), F.col("http_status"))))
        .otherwise(F.coalesce(_challenge(html), F.lit("ok")))
    )
    ok = F.col("site_status") == "ok"
    links = F.filter(F.array_distinct(F.regexp_extract_all(html, F.lit(LISTING_LINK), F.lit(1))), lambda x: ~x.rlike("^(mailto|tel):"))
    few, words = F.size(links), F.size(F.regexp_extract_all(html, F.lit(TRADE), F.lit(0)))
    deep = _deep_links(html, F.col("sitemap"), F.col("section"))
    shown = F.when(few >= ENOUGH_LINKS, "yes").when((few > 0) | (words >= ENOUGH_LINKS), "maybe").otherwise("no")
    platforms = F.array_join(F.array_compact(F.array(*[F.when(html.rlike(p), F.lit(n)) for n, p in PLATFORMS])), ";")
    barred = F.coalesce("robots", F.lit("")).rlike(r"(?is)user-agent:\s*\*.*?disallow:\s*/\s*(\n|$)")
    named = F.coalesce("robots", F.lit("")).rlike(rf"(?is)user-agent:\s*{agent}\b.*?disallow:\s*/\s*(\n|$)")
    judged = rows.withColumn("site_status", status)
    return judged.withColumns(
        {
            "robots_ok": F.when(ok, F.when(named, "explicit_no").when(barred, "no").otherwise("yes")),
            "has_listings": F.when(ok, F.when((shown != "yes") & (deep >= ENOUGH_LINKS), F.lit("yes")).otherwise(shown)),
            "listing_links": F.when(ok, F.when((shown != "yes") & (deep >= ENOUGH_LINKS), deep).otherwise(few)),
            "platform": F.when(ok, platforms),
        }
    ).drop("html", "robots", "sitemap", "section")


def name_words(name: Column) -> Column:
    """An agency's distinctive words in Latin letters, without those of its kind."""
    plain = latin(F.regexp_replace(F.coalesce(name, F.lit("")), r"\(.*?\)", " "))
    found = F.regexp_extract_all(plain, F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*KIND_WORDS))


def site_guesses(name: Column, most: int = 16) -> Column:
    """Addresses that an agency of the name may have; a word alone only with a word of the trade."""
    words = name_words(name)
    first = F.get(words, F.lit(0))
    joined = F.array(F.array_join(F.slice(words, 1, 3), ""), F.array_join(F.slice(words, 1, 3), "-"), F.array_join(F.slice(words, 1, 2), ""))
    stems = F.when(F.size(words) >= 2, joined).otherwise(F.array().cast("array<string>"))
    spelled = lambda xs: F.array_distinct(F.flatten(F.transform(xs, lambda x: F.array(F.replace(x, F.lit("oy"), F.lit("ou")), x))))
    urls = lambda xs, tails: F.flatten(F.transform(xs, lambda x: F.array(*[F.concat(F.lit("https://"), x, F.lit(t)) for t in tails])))
    many = urls(F.filter(spelled(stems), lambda x: F.length(x) >= 5), (".gr", ".com", "realestate.gr", "-realestate.gr", ".com.gr", "estate.gr"))
    single = F.when((F.length(first) >= 4) & ~first.isin(*COMMON_WORDS), F.array(first)).otherwise(F.array().cast("array<string>"))
    long_ = urls(F.filter(spelled(single), lambda x: F.length(x) >= 9), (".gr", ".com"))
    one = urls(spelled(single), ("realestate.gr", "-realestate.gr", "estate.gr", "properties.gr", "realestate.com", "homes.gr"))
    return F.slice(F.array_distinct(F.concat(many, long_, one)), 1, most)


def names_agency(page: Column, name: Column) -> Column:
    """Whether a page names the agency: its words next to each other, or its one word anywhere."""
    read = F.substring(page, 1, NAME_READ)
    low, lat = fold(read), latin(read)
    keys = F.filter(name_words(name), lambda w: F.length(w) >= 3)
    telling = F.exists(keys, lambda w: ~w.isin(*COMMON_WORDS))
    compact = F.concat_ws(" ", F.regexp_replace(low, "[^a-zα-ω0-9]", ""), F.regexp_replace(lat, "[^a-z0-9]", ""))
    phrase, key = F.array_join(F.slice(keys, 1, 3), ""), F.get(keys, F.lit(0))
    as_ou = lambda c: F.replace(c, F.lit("oy"), F.lit("ou"))
    together = compact.contains(phrase) | compact.contains(as_ou(phrase))
    alone = low.contains(key) | lat.contains(key) | lat.contains(as_ou(key))
    return F.coalesce(telling & F.when(F.size(keys) >= 2, together).otherwise(alone), F.lit(False))


def registry_keys(rows: DataFrame) -> DataFrame:
    """(kind, key) under which a registry row is known: domains, directory URLs, its name."""
    c = {n: F.col(n) if n in rows.columns else F.lit(None).cast("string") for n in ("domain", "website", "final_url", "vrisko_url", "xe_url", "name")}
    of = lambda url: host(F.when(url.contains("//"), url).otherwise(F.concat(F.lit("https://"), url)))
    pairs = [("domain", c["domain"]), ("domain", of(c["website"])), ("domain", of(c["final_url"])), ("vrisko", c["vrisko_url"]), ("xe", c["xe_url"]), ("name", name_key(c["name"]))]
    exploded = rows.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.nullif(v, F.lit("")).alias("key")) for k, v in pairs])).alias("k"))
    return exploded.select("*", "k.*").drop("k").filter("key is not null")


def new_agencies(candidates: DataFrame, registry: DataFrame, order: str = "ord") -> DataFrame:
    """Directory entries known under none of their domain, URLs and name; the first of each name."""
    known = registry_keys(registry).select("kind", "key").distinct()
    met = registry_keys(candidates).join(known, ["kind", "key"], "left_semi").select(order).distinct()
    fresh = candidates.join(met, order, "left_anti").withColumn("_name", name_key(F.col("name"))).filter("_name <> ''")
    first = Window.partitionBy("_name").orderBy(order)
    return fresh.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn", "_name")


def linked_profiles(registry: DataFrame, candidates: DataFrame) -> DataFrame:
    """Registry rows with the portal profile that a directory entry of their domain or name gives, where they had none."""
    entry = registry_keys(candidates.filter("xe_url is not null and xe_url <> ''")).filter("kind in ('domain', 'name')")
    offered = entry.groupBy("kind", "key").agg(F.min("xe_url").alias("_offer"))
    mine = registry_keys(registry).filter("kind in ('domain', 'name')").join(offered, ["kind", "key"])
    best = mine.groupBy(F.col("name").alias("_n")).agg(F.min_by("_offer", F.struct("kind", "_offer")).alias("_offer"))
    joined = registry.join(best, F.col("name") == F.col("_n"), "left")
    return joined.withColumn("xe_url", F.coalesce(F.nullif("xe_url", F.lit("")), "_offer")).drop("_n", "_offer")


def sole_claims(guesses: DataFrame, registry: DataFrame, agency: str = "name", url: str = "url") -> DataFrame:
    """Guessed sites that exactly one agency claims and that no registry row has; others belong to none."""
    taken = registry_keys(registry).filter("kind = 'domain'").select(F.col("key").alias("_domain")).distinct()
    claimed = guesses.filter(F.col(url).isNotNull() & (F.col(url) != "")).withColumn("_domain", host(F.col(url)))
    sole = claimed.groupBy("_domain").agg(F.count(F.lit(1)).alias("_claims")).filter("_claims = 1").select("_domain")
    return claimed.join(sole, "_domain", "left_semi").join(taken, "_domain", "left_anti").drop("_domain")


def to_recheck(registry: DataFrame, prefixes: Sequence[str] = RECHECK) -> DataFrame:
    """Rows whose site was broken when last looked at."""
    broken = F.lit(False)
    for p in prefixes:
        broken = broken | F.col("site_status").startswith(p)
    return registry.filter(broken)


def updated_registry(registry: DataFrame, checked: DataFrame, added: DataFrame, key: str = "name") -> DataFrame:
    """The registry after a run: checked rows' new verdicts, added rows, and which sites came back."""
    verdict = ("site_status", "final_url", "robots_ok", "has_listings", "listing_links", "platform")
    new = checked.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in verdict if c in checked.columns])
    joined = registry.join(new, F.col(key) == F.col("_key"), "left")
    back = (
        F.col("_key").isNotNull() & ~F.coalesce("site_status", F.lit("")).startswith("ok") & (F.col("_site_status") == "ok") & (F.col("_has_listings") == "yes")
    )
    took = {c: F.when(F.col("_key").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in verdict if c in registry.columns and f"_{c}" in new.columns}
    kept = joined.withColumn("came_back", F.coalesce(back, F.lit(False))).withColumns(took).select(*registry.columns, "came_back")
    return kept.unionByName(added.withColumn("came_back", F.lit(False)), allowMissingColumns=True)


def discovery_summary(added: DataFrame, checked: DataFrame, came_back: Column) -> DataFrame:
    """One row of the discovery log: added, with a site, collectable, rechecked, came back."""
    live = (F.col("site_status") == "ok") & (F.col("has_listings") == "yes")
    a = added.agg(F.count(F.lit(1)).alias("added"), F.count_if(F.coalesce("website", F.lit("")) != "").alias("added_with_site"), F.count_if(live).alias("added_collectable"))
    c = checked.agg(F.count(F.lit(1)).alias("rechecked"), F.count_if(came_back).alias("came_back"))
    return a.join(c)
