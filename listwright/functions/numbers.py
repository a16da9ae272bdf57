"""Number expressions: casts that never raise, locale numbers, tolerances, money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A double, or null where the text isn't one."""
    return c.try_cast("double")


def locale_number(c: Column) -> Column:
    """1.234,5 and 1,234.5 and 37,5 and 1.234 alike: the last mark before 1-2 digits is the decimal one."""
    t = F.regexp_replace(c, r"[^0-9.,-]", "")
    comma = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.replace(t, F.lit(","), F.lit(""))
    return (
        F.when(t.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?$"), comma)
        .when(t.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"), plain)
        .when(t.rlike(r"^-?[0-9]+,[0-9]+$"), comma)
        .otherwise(plain)
        .try_cast("double")
    )


def _grouped(t: Column, marks: str, decimals: str = "") -> Column:
    return t.rlike(rf"^[0-9]{{1,3}}([{marks}][0-9]{{3}})+{decimals}$")


def card_number(c: Column) -> Column:
    """Alerts and network cards: either mark parts thousands when groups of three follow, else it is the decimal one."""
    t = F.regexp_replace(c, r"[^\d.,]", "")
    return F.when(_grouped(t, ".,"), F.regexp_replace(t, "[.,]", "")).otherwise(F.replace(t, F.lit(","), F.lit("."))).try_cast("double")


def portal_number(c: Column) -> Column:
    """Portal cards: 1.234,5 only; any other comma is the decimal mark."""
    t = F.regexp_replace(c, r"[^\d.,]", "")
    point = F.replace(t, F.lit(","), F.lit("."))
    return F.when(_grouped(t, ".", "(,[0-9]+)?"), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(point).try_cast("double")


def listed_number(c: Column) -> Column:
    """Marketplace lists: the first number, points part thousands, a comma the decimals."""
    t = F.regexp_extract(c, r"(\d[\d.]*(?:,\d+)?)", 1)
    return F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def profile_money(c: Column) -> Column:
    """Profiles: the first amount, points part thousands, no decimals."""
    return F.replace(F.regexp_extract(F.replace(c, F.lit("\u00a0"), F.lit(" ")), r"(\d{1,3}(?:\.\d{3})+|\d+)", 1), F.lit("."), F.lit("")).try_cast("double")


def post_number(c: Column) -> Column:
    """Channel posts: every mark or blank parts thousands."""
    return F.regexp_replace(c, "[’'., ]", "").try_cast("double")


def page_number(c: Column) -> Column:
    """Pages: 1.234,5 or 1,234.5 by the groups of three; any other comma is the decimal mark; blanks don't count."""
    t = F.regexp_replace(c, "[\u00a0 ]", "")
    return (
        F.when(_grouped(t, ".", "(,[0-9]+)?"), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(_grouped(t, ",", r"(\.[0-9]+)?"), F.replace(t, F.lit(","), F.lit("")))
        .otherwise(F.replace(t, F.lit(","), F.lit(".")))
        .try_cast("double")
    )


def per_unit(price: Column, area: Column) -> Column:
    """Price per square metre, half to even; null without both."""
    return F.when(area > 0, F.bround(price / area)).cast("long")


def close(a: Column, b: Column, rel: float, absolute: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(absolute), rel * F.greatest(a, b))


def money(c: Column) -> Column:
    return F.replace(F.format_number(F.floor(c).cast("long"), 0), F.lit(","), F.lit(" "))


def recheck_budget(known: Column, cap: int, days: int) -> Column:
    return F.least(F.lit(cap), F.greatest(F.lit(10), F.ceil(known / (2 * days)))).cast("long")


def in_range(c: Column, low: float, high: float) -> Column:
    """The value, or null outside the range."""
    return F.when(c.between(low, high), c)
