"""Secret scans: native patterns over whole texts, and linking of the parts of one credential.

Strong patterns (assignments, access keys, hex runs) are reported wherever they stand. Weak parts
(account names, short secrets, endpoints) are reported only when a complementary part starts within
``SCOPE`` characters of the same text: an identifier needs a secret, a secret an identifier or
endpoint, an endpoint both. Only texts with a weak part enter that interval join, which is a range
window over one text's sorted parts, so it emits no pairs; what travels is the row's number and one
span, so a crowded text costs the number of its spans times a logarithm. Spans count code points, ends
excluded.

A pattern's places come from splitting the text by it: what lies between the matches and the matches
themselves add up to their starts. Texts without the pattern are only tested for it.

Defined results: a null or empty text has no spans, and the digest of no spans is that of the empty
string. Very long texts are scanned whole, in one row. Repeated rows are scanned each, an empty table gives an empty table, ties in start go by
kind as listed. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listwright.llm.common import before, let, text_or_empty, written

#: Kinds in the order in which ties are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "weak_id": r"""(?i:user_?name|user_?id|client_?id|account|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    "weak_secret": r"""(?i:pwd|passphrase|credential|private_?key|auth)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}""",
    "endpoint": r"""(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+""",
}
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
LEAST_ASSIGNED = 6
SCOPE = 300
BASE = KINDS[:3]


def _spans(text: Column, kind: str) -> Column:
    """array<struct<s: long, k: int, e: long>> of one kind, by start."""
    pattern = PATTERNS[kind]
    none = F.array().cast("array<struct<s:bigint,k:int,e:bigint>>")

    def placed(hits: Column) -> Column:
        parts = F.split(text, pattern, -1)
        steps = F.zip_with(F.slice(parts, F.lit(1), F.size(hits)), hits, lambda p, h: (F.length(p) + F.length(h)).cast("long"))

        def of(steps: Column) -> Column:
            return F.zip_with(
                F.zip_with(before(steps), steps, lambda b, x: b + x),
                hits,
                lambda end, h: F.struct((end - F.length(h)).alias("s"), F.lit(KINDS.index(kind)).alias("k"), end.alias("e")),
            )

        return let(steps, of)

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = let(whole, placed)
    if kind == "assign":
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        found = let(values, lambda v: F.filter(let(whole, placed), lambda x, i: F.length(F.get(v, i)) >= LEAST_ASSIGNED))
    return F.when(text.rlike(pattern), found).otherwise(none)


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base and all (arrays of s, k, e: start, kind's index, end)."""
    text = text_or_empty()
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.sort_array(F.concat(*[_spans(text, k) for k in BASE])).alias("base"),
        F.concat(*[_spans(text, k) for k in KINDS[3:]]).alias("weak"),
    )
    found = written(found, "spans")
    plain = found.filter(F.size("weak") == 0).select("doc_id", "base", F.col("base").alias("all"))
    parts = found.filter(F.size("weak") > 0).select("doc_id", "row", F.explode(F.concat("base", "weak")).alias("x"))
    role = F.get(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("x.k"))
    near = Window.partitionBy("row").orderBy("x.s").rangeBetween(-SCOPE, SCOPE)

    def beside(name: str) -> Column:
        return F.max((role == name).cast("int")).over(near) > 0

    linked = (
        F.when(F.col("x.k") < len(BASE), F.lit(True))
        .when(role == "id", beside("secret"))
        .when(role == "secret", beside("id") | beside("endpoint"))
        .otherwise(beside("id") & beside("secret"))
    )
    joined = (
        parts.withColumn("linked", linked)
        .groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.when(F.col("linked"), F.col("x")))).alias("all"))
        .select("doc_id", F.filter("all", lambda x: x["k"] < len(BASE)).alias("base"), "all")
    )
    return plain.unionByName(joined)


def report(docs: DataFrame) -> DataFrame:
    """Counts, digests and spans per document."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return scan(docs).select(
        "doc_id", *[count(k) for k in BASE], F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.col("all")).alias("spans")
    )
