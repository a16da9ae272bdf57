"""Quality rules: a table of thresholds compiled into one projection of native expressions.

Every measure is a Spark expression over the row's own text, so the operator needs no shuffle,
no Python and no state; a row's cost grows with its length (times its logarithm for repeats).

Defined results: a null or empty text has no words, so all counts are 0, all ratios are 0 and the
row fails the base rule. Rows are judged one by one: repeated rows and ties get equal verdicts, an
empty table gives an empty table. Only ``doc_id`` and ``text`` are read; other columns, whatever
their names, pass ``judge`` untouched and can't clash, as results sit in one struct.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import let, words_of

SYMBOLS = r"#*$%&|<>"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for was with be by on as at it are this "
    "le la les de des et un une en est que pour dans qui sur pas par au "
    "der die das und ist von mit zu den nicht ein eine für auf im dem sich auch "
    "el los las y del se un una por con para es al lo como su"
).split()

_STOP_FORMS = tuple(dict.fromkeys([*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]))


class Rule(NamedTuple):
    """Keeps a text whose ``measure`` lies within [low, high]; None leaves an end open."""

    measure: str
    low: float | None
    high: float | None


#: The thresholds; the base rule (words, repeats) comes before them.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.60),
    Rule("pipe_word_ratio", None, 0.20),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


#: Bits of a sorted window that hold its place; longer texts take the plain path.
PLACE_BITS = 20


def _same(words: Column, a: Column, b: Column) -> Column:
    """Whether the windows at two places hold the same three words."""
    parts = [F.get(words, a + k) == F.get(words, b + k) for k in range(3)]
    return parts[0] & parts[1] & parts[2]


def _covered(places: Column) -> Column:
    """Words in the windows that begin at these places."""
    return let(
        places,
        lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2)))),
    )


def _beside(runs: Column, test) -> Column:
    """The elements of a sorted array for which ``test(element, neighbour)`` holds on either side."""

    def hit(x: Column, k: Column) -> Column:
        before, after = test(x, F.get(runs, k - 1)), test(x, F.get(runs, k + 1))
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    return F.filter(runs, hit)


def _repeats_by_words(words: Column, starts: Column) -> Column:
    """The plain path: windows sorted by their words."""
    windows = F.transform(
        starts, lambda w, i: F.struct(w.alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"))
    )

    def equal(x: Column, y: Column) -> Column:
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    return let(F.sort_array(windows), lambda runs: _covered(F.transform(_beside(runs, equal), lambda x: x["i"])))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more, the first included.

    Windows are sorted as one number each, hash above and place below. Neighbours with one hash are
    compared word by word; if any two differ (a collision), the text takes the plain path instead.
    """
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    low = (1 << PLACE_BITS) - 1

    def by_hash(runs: Column) -> Column:
        def place(x: Column) -> Column:
            return x.bitwiseAND(F.lit(low)).cast("int")

        def one_hash(x: Column, y: Column) -> Column:
            return F.shiftright(x.bitwiseXOR(y), PLACE_BITS) == 0

        def count(hits: Column) -> Column:
            def clash(x: Column, k: Column) -> Column:
                y = F.get(hits, k - 1)
                return F.coalesce(one_hash(x, y) & ~_same(words, place(x), place(y)), F.lit(False))

            clashes = F.size(F.filter(hits, clash)) > 0
            return (
                F.when(F.size(hits) == 0, F.lit(0))
                .when(clashes, _repeats_by_words(words, starts))
                .otherwise(_covered(F.transform(hits, place)))
            )

        return let(_beside(runs, one_hash), count)

    windows = F.transform(
        starts,
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")),
    )
    hashed = let(F.sort_array(windows), by_hash)
    return F.when(F.size(words) > low, _repeats_by_words(words, starts)).otherwise(hashed)


def _measures(text: Column) -> Column:
    """All counts of a text as one struct."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def counts(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", ""))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(*_STOP_FORMS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(words, lambda w: w == "|")).cast("long").alias("n_pipe_words"),
        )

    return let(words_of(text), lambda w: let(lines, lambda ls: counts(w, ls)))


def _ratio(over: Column, under: Column) -> Column:
    return F.when(under > 0, over / under).otherwise(F.lit(0.0))


def _ratios(m: Column) -> dict[str, Column]:
    return {
        "mean_word_chars": _ratio(m["word_chars"], m["n_words"]),
        "symbol_ratio": _ratio(m["n_symbols"], m["word_chars"]),
        "stop_word_ratio": _ratio(m["n_stop_words"], m["n_words"]),
        "dup_line_ratio": _ratio(m["n_dup_lines"], m["n_lines"]),
        "pipe_word_ratio": _ratio(m["n_pipe_words"], m["n_words"]),
    }


def compile_rules(m: Column, rules=RULES) -> Column:
    """The rules a text breaks, as an array of their measures' names."""
    ratios = _ratios(m)
    broken = []
    for rule in rules:
        value, bad = ratios[rule.measure], F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        broken.append(F.when(bad, F.lit(rule.measure)))
    return F.array_compact(F.array(*broken))


def judge(docs: DataFrame, text_col: str = "text", rules=RULES, out: str = "quality") -> DataFrame:
    """``docs`` with the struct ``out``: counts, base_failed, broken rules and kept."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def verdict(m: Column) -> Column:
        base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
        names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_pipe_words")
        broken = compile_rules(m, rules)
        return F.struct(
            *[m[n].alias(n) for n in names],
            base.alias("base_failed"),
            broken.alias("broken"),
            (~base & (F.size(broken) == 0)).alias("kept"),
        )

    return docs.withColumn(out, let(_measures(text), verdict))
