"""Text expressions: folding, words, keys, tags, labels. All native, none row-at-a-time."""

from __future__ import annotations

import html
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Greek letters in Latin script, and words that don't tell agencies apart.
LATIN_ONE = ("αβγδεζηικλμνξοπρστυφω", "avgdeziiklmnxoprstyfo")
LATIN_MORE = {"θ": "th", "χ": "ch", "ψ": "ps"}
NAME_NOISE = (
    "μεσιτικο μεσιτικα γραφειο γραφεια κτηματομεσιτικο κτηματομεσιτικη real estate realestate properties property "
    "ακινητα ακινητων συμβουλοι ικε επε οε εε ae ike ltd group the"
).split()

# Parameters that don't identify a page, elements and classes that aren't a page's own text.
TRACKING = r"utm_\w+|fbclid|gclid|lang|sr"
BOILER_TAGS = "script|style|nav|header|footer|aside|noscript|form|select"
BOILER_CLASSES = "menu|footer|navbar|sidebar|widget|related|similar|recent|featured|breadcrumb-menu|cookie|mega"

ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&euro;": "€", "&amp;": "&"}


@cache
def fold_table() -> tuple[str, str]:
    """Letters whose decomposition is one base letter and marks, and those base letters."""
    src, dst = [], []
    for block in ((0xC0, 0x250), (0x370, 0x530), (0x1E00, 0x2000)):
        for c in map(chr, range(*block)):
            base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
            if len(base) == 1 and base != c and c == c.lower():
                src.append(c)
                dst.append(base)
    return "".join(src) + "ς", "".join(dst) + "σ"


def fold(c: Column) -> Column:
    """Lower case without marks, final sigma as sigma. A text of ASCII alone has neither."""
    src, dst = fold_table()
    ascii_only = F.octet_length(c) == F.length(c)
    return F.when(ascii_only, F.lower(c)).otherwise(F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}", ""), src, dst))


def latin(c: Column) -> Column:
    out = F.translate(fold(c), *LATIN_ONE)
    for greek, letters in LATIN_MORE.items():
        out = F.replace(out, F.lit(greek), F.lit(letters))
    return out


def words(c: Column, least: int = 5) -> Column:
    """Distinct runs of letters of a length at least, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(\p{{L}}{{{least},}})"), F.lit(1)))


def alnum_key(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), " ")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def name_key(c: Column) -> Column:
    """An agency's name without parentheses, punctuation and business words."""
    bare = F.regexp_replace(fold(F.regexp_replace(F.coalesce(c, F.lit("")), r"\(.*?\)", " ")), r"[^\p{L}\p{N}_\s]", " ")
    parts = F.filter(F.split(squeeze(bare), " "), lambda w: ~w.isin(*NAME_NOISE) & (w != ""))
    return F.array_join(parts, " ")


def unescape(c: Column) -> Column:
    """The common entities; the ampersand last, so nothing is unescaped twice."""
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


@F.pandas_udf(StringType())
def unescape_all(c: pd.Series) -> pd.Series:
    """Every HTML entity, in Arrow batches: for texts whose entities go beyond the common ones."""
    return c.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)


def strip_tags(c: Column) -> Column:
    return squeeze(unescape(F.regexp_replace(c, r"<[^>]*>", " ")))


def page_text(html: Column) -> Column:
    """Text of a page without scripts and styles."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
    return strip_tags(bare)


def without_boilerplate(html: Column) -> Column:
    """A page without scripts, navigation and the like, and without blocks whose class or id says so."""
    bare = F.regexp_replace(html, rf"(?is)<({BOILER_TAGS})\b.*?</\1>", " ")
    block = rf"""(?is)<(div|ul|section)\b[^>]*(?:class|id)=["'][^"']*(?:{BOILER_CLASSES})[^"']*["'][^>]*>.*?</\1>"""
    return F.regexp_replace(bare, block, " ")


def meta(html: Column, name: str) -> Column:
    """A meta element's content, whichever attribute comes first; null without one."""
    said = f"""(?:property|name)=["']{name}["']"""
    first = rf"""(?is)<meta[^>]+{said}[^>]+content=["']([^"']*)"""
    second = rf"""(?is)<meta[^>]+content=["']([^"']*)["'][^>]+{said}"""
    found = [F.nullif(F.trim(F.regexp_extract(html, p, 1)), F.lit("")) for p in (first, second)]
    return unescape(F.coalesce(*found))


def links(html: Column, base: Column | None = None) -> Column:
    """Distinct link targets, fragments dropped; with a base, relative ones are made whole and only http stays."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a[^>]+href="([^"#]+)"""), F.lit(1))
    if base is None:
        return F.array_distinct(found)
    scheme, root = F.regexp_extract(base, r"^([a-zA-Z]+:)", 1), F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+/(?:[^?#]*/)?)", 1), F.lit("")), F.concat(root, F.lit("/")))

    def whole(x: Column) -> Column:
        return (
            F.when(x.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), x)
            .when(x.startswith("//"), F.concat(scheme, x))
            .when(x.startswith("/"), F.concat(root, x))
            .otherwise(F.concat(folder, x))
        )

    every = F.transform(F.regexp_extract_all(html, F.lit(r"""href=["']([^"'<> ]+)["']"""), F.lit(1)), lambda x: F.regexp_replace(whole(unescape(x)), "#.*$", ""))
    return F.array_distinct(F.filter(every, lambda x: x.startswith("http")))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int")


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def url_key(url: Column) -> Column:
    """A URL's identity: lower case, without fragment, tracking and language parameters, trailing marks."""
    bare = F.regexp_replace(F.lower(url), "#.*$", "")
    bare = F.regexp_replace(bare, rf"(?U)([?&])(?:{TRACKING})=[^&]*&?", "$1")
    return F.regexp_replace(bare, r"[?&/]+$", "")


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z]+:)?//([^/?#:]*)", 1)), r"^www\.", "")


def unquote(c: Column) -> Column:
    """Percent-decoding that leaves plus signs and malformed input alone."""
    return F.when(c.contains("%"), F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)).otherwise(c)


def label_ok(c: Column) -> Column:
    return c.rlike("^[a-z0-9-]{0,40}$")


def has_cyrillic(c: Column) -> Column:
    return c.rlike(r"[\x{0400}-\x{04FF}]")


def words_of(c: Column, least: int = 5) -> Column:
    """All runs of letters of a length at least, in order, repeats included."""
    return F.regexp_extract_all(c, F.lit(rf"(\p{{L}}{{{least},}})"), F.lit(1))


def cells(html_: Column) -> Column:
    """A page's text with a bar at each tag: what stands between two tags is a cell."""
    bare = F.regexp_replace(F.regexp_replace(html_, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
    return F.regexp_replace(unescape(F.regexp_replace(bare, r"<[^>]+>", " | ")), r"\s+", " ")


def place_under_heading(html_: Column, title: Column) -> Column:
    """The first place-like cell after the heading: words parted by commas or dashes, no digits or prices.

    The heading is the title up to a separator, at most 40 characters; each place where it stands is
    tried, and of each the six cells that follow within 1,500 characters.
    """
    core = F.substring(F.get(F.split(F.trim(F.regexp_replace(title, r"\s+", " ")), r"\s+[-|–]\s+"), F.lit(0)), 1, 40)
    parts = F.split(cells(html_), F.concat(F.lit("\\Q"), core, F.lit("\\E")), -1)

    def place(after: Column) -> Column:
        near = F.split(F.substring(after, 1, 1500), r"\|", -1)
        shown = F.filter(F.transform(F.slice(near, F.lit(2), F.greatest(F.size(near) - 1, F.lit(0))), lambda c: F.trim(c)), lambda c: c != "")
        like = F.filter(F.slice(shown, 1, 6), lambda c: c.rlike(r"^[^\d€$:@/]{3,70}$") & c.rlike("[,–-]") & (F.size(F.split(c, r"\s+")) <= 8))
        return F.get(like, F.lit(0))

    found = F.filter(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), place), lambda c: c.isNotNull())
    return F.when(F.length(core) >= 8, F.get(found, F.lit(0)))
