"""URL filters: allow and block rules, and a character language-model ratio for the rest.

URLs that a rule decides are the examples. Two smoothed Markov models of variable order are counted
from them, one of accepted and one of rejected URLs: a character follows the two before it where
these were seen, else the one before it, else none (Witten-Bell interpolation). Characters fall into
32 classes, so a model is a table of at most 32,768 log-ratios whatever the input. A URL's score is
its mean log-ratio per character; the threshold is the one that best separates held-out examples.
Everything is native; the log-ratios, a fixed number of them, and the threshold are constants of the
expression that scores a URL in its own row: nothing is exploded, sorted or shuffled after the model.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule and
scores 0. Very long URLs are scored whole. Where no example of one side exists, the method allows; a
score equal to the threshold is allowed. Repeated rows get equal verdicts,
an empty table gives an empty table. Only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from listwright.llm.common import ascii_lower, let, written

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Classes of characters: letters, any digit, three marks, anything else, the start.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-_^"
SYMBOLS, ORDER = len(ALPHABET), 2
#: One example in so many is held out for the threshold; scores are compared in such steps.
HELD_OUT, STEP = 5, 0.01


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def parts(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    return ascii_lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def first_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _windows(host: Column, path: Column) -> Column:
    """A number per character: its class and those of the two before it."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.concat(host, path)), "[0-9]", "0"), "[^a-z0./-]", "_")
    letters = F.filter(F.split(plain, ""), lambda c: c != "")
    codes = F.transform(letters, lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    start = SYMBOLS - 1

    def numbered(codes: Column) -> Column:
        def number(c: Column, i: Column) -> Column:
            one, two = F.coalesce(F.get(codes, i - 1), F.lit(start)), F.coalesce(F.get(codes, i - 2), F.lit(start))
            return two * SYMBOLS * SYMBOLS + one * SYMBOLS + c

        return F.transform(codes, number)

    return let(codes, numbered)


def _log_probability(count: Column, code: Column) -> Column:
    """Witten-Bell interpolated log-probability of a window's last class after those before it."""

    def total(*keys: Column) -> Column:
        return F.sum(count).over(Window.partitionBy(*keys))

    two, one, last = F.floor(code / SYMBOLS), F.pmod(F.floor(code / SYMBOLS), F.lit(SYMBOLS)), F.pmod(code, F.lit(SYMBOLS))
    pair = F.pmod(code, F.lit(SYMBOLS * SYMBOLS))
    all_ = F.lit(0)
    p1 = (total(last) + 1) / (total(all_) + SYMBOLS)
    kinds1 = F.size(F.collect_set(F.when(count > 0, last)).over(Window.partitionBy(one)))
    kinds2 = F.sum((count > 0).cast("int")).over(Window.partitionBy(two))
    p2 = F.when(total(one) > 0, (total(pair) + kinds1 * p1) / (total(one) + kinds1)).otherwise(p1)
    p3 = F.when(total(two) > 0, (count + kinds2 * p2) / (total(two) + kinds2)).otherwise(p2)
    return F.ln(p3)


def train(examples: DataFrame) -> DataFrame:
    """(code, ratio): the log-ratio of each window number, 32,768 rows.

    ``examples(windows, accepted)``; counts of windows are aggregated before they are shuffled.
    """
    seen = examples.select(F.explode("windows").alias("code"), F.col("accepted").cast("long").alias("a"))
    counts = written(seen.groupBy("code").agg(F.sum("a").alias("a"), F.sum(1 - F.col("a")).alias("r")), "url-counts")
    every = examples.sparkSession.range(SYMBOLS ** (ORDER + 1)).withColumnRenamed("id", "code")
    full = every.join(counts.withColumnRenamed("code", "c"), F.col("code") == F.col("c"), "left").select(
        "code", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("r", F.lit(0)).alias("r")
    )
    ratio = _log_probability(F.col("a"), F.col("code")) - _log_probability(F.col("r"), F.col("code"))
    return full.select(F.col("code").cast("int").alias("code"), ratio.alias("ratio"))


def constant(model: DataFrame) -> Column:
    """The log-ratios by window number as one constant array: their number is fixed by the alphabet."""
    ratios = [0.0] * SYMBOLS ** (ORDER + 1)
    for r in model.collect():
        ratios[r["code"]] = r["ratio"]
    return F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")


def score(windows: Column, ratios: Column) -> Column:
    """The mean log-ratio of a URL's windows, added up in order; 0 for none."""

    def mean(ws: Column) -> Column:
        total = F.aggregate(ws, F.lit(0.0), lambda acc, w: acc + F.get(ratios, w))
        return F.round(F.when(F.size(ws) > 0, total / F.size(ws)).otherwise(F.lit(0.0)), 9)

    return let(windows, mean)


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the score from which URLs are best accepted, by balanced accuracy on examples.

    ``scored(score, accepted)``; scores fall into bins of a fixed step, of which there are few.
    """
    bin_ = F.floor(F.least(F.greatest("score", F.lit(-20.0)), F.lit(20.0)) / STEP)
    bins = scored.groupBy(bin_.alias("bin")).agg(F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r"))
    below, all_ = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    right = (F.sum("a").over(all_) - F.coalesce(F.sum("a").over(below), F.lit(0))) / F.sum("a").over(all_)
    wrong = F.coalesce(F.sum("r").over(below), F.lit(0)) / F.sum("r").over(all_)
    both = (F.sum("a").over(all_) > 0) & (F.sum("r").over(all_) > 0)
    graded = bins.select("bin", F.when(both, right + wrong).alias("grade"))
    return graded.agg((F.max_by("bin", F.struct("grade", -F.col("bin"))) * STEP).alias("least"), F.max("grade").alias("grade"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score."""
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    split = split.withColumn("by_rule", first_rule(F.col("host"), F.col("path"), rules))
    known = split.filter("by_rule is not null").select(
        _windows(F.col("host"), F.col("path")).alias("windows"),
        (F.col("by_rule.verdict") == "allow").alias("accepted"),
        F.pmod(F.xxhash64("host", "path"), F.lit(HELD_OUT)).alias("fold"),
    )
    ratios = constant(written(train(known.filter("fold > 0")), "url-model"))
    held = known.filter("fold = 0").select(score(F.col("windows"), ratios).alias("score"), "accepted")
    best = threshold(held).first()
    # Without examples of both sides there is no grade, and the method allows.
    least = F.lit(best["least"] if best["grade"] is not None else float("-inf"))
    scored = split.withColumn("score", score(_windows(F.col("host"), F.col("path")), ratios))
    method = F.when(F.col("score") < least, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        "page_id", "host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce("by_rule.verdict", method).alias("verdict"), "score"
    )
