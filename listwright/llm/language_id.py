"""Language identification: words first, then ever shorter character n-grams.

Training counts, in Spark, each language's words (runs of letters, lower-cased) in labelled texts, and from
the counted words their n-grams with borders, ``ORDERS`` long. A word that is known says, for each
language, the log of its smoothed share of that language's words. A word that isn't known falls back: its
longest n-grams are looked up first, and if none of them is known the next shorter ones; the mean of the
log shares of those found counts for the word, scaled down, as it tells less than a word. A text's
language is the one with the highest sum over its words, each occurrence counted, over ``TEMPER`` (words of
one text aren't independent), plus the log share of the language's texts; the score is its posterior.

Words (of up to ``LONG_WORD`` letters) and n-grams are known if they occur at least twice. Learning reads a bounded sample of labelled
rows (``SAMPLE`` expected, picked by a hash of the id, all of them if fewer), so the model that goes to
the tasks is bounded by it. ``held_out`` rows are never learnt from.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text if
nothing was learnt. Equal sums go to the language that comes first by code point. Rows with a null lang are judged but not learnt from; a null doc_id is crc32 of the empty
string, 0, so it is held out. Very long texts are read whole, repeated rows are rows each, an empty table
gives an empty table. Only ``doc_id``, ``text`` and ``lang`` are read, ``lang`` for learning alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import written

#: Labelled rows to learn from, at most (expected).
SAMPLE = 20_000
#: Lengths of n-grams, the longest first.
ORDERS = (5, 4, 3, 2, 1)
#: Occurrences from which a word or n-gram is known; what an unseen one counts as in a language.
LEAST, SMOOTH = 2, 0.1
#: What n-grams weigh next to a word, once for the longest and once more for each shorter length.
BACKOFF = 0.6
TEMPER = 4.0
FOLDS = 5
UNKNOWN = "und"
#: Distinct words whose log shares a worker remembers, and their length.
REMEMBERED, LONG_WORD = 200_000, 64
BORDER = "\x02"
_WORDS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def words_in(text: str) -> Counter:
    """How often each lower-cased word with a letter occurs."""
    found = Counter(_WORDS.findall(text.lower()))
    for word in [w for w in found if not w.isalpha() and not any(map(str.isalpha, w))]:
        del found[word]  # the pattern takes other numbers than digits for letters
    return found


def grams(word: str, order: int) -> list[str]:
    """The n-grams of a word between its borders; a shorter word has none of that length."""
    framed = f"{BORDER}{word}{BORDER}" if order > 1 else word
    return [framed[i : i + order] for i in range(len(framed) - order + 1)]


class Shares(NamedTuple):
    """Known strings in order, and each one's log share in each language."""

    known: list[str]
    logs: np.ndarray


class Model(NamedTuple):
    """Languages in order, the log shares of their texts, words' shares, and those of n-grams by length."""

    languages: list[str]
    prior: np.ndarray
    words: Shares
    orders: dict[int, Shares]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word occurs in a batch's texts, by language."""
    for batch in batches:
        by: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            of = by.setdefault(lang, Counter({"": 0}))
            of[""] += 1  # texts count under the empty word
            of.update(words_in(text.as_py() or ""))
        for lang, found in by.items():
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(list(found)), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for lang, word, n in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            for order in ORDERS:
                for g in grams(word, order):
                    found[lang, order, g] += n
        if found:
            langs, orders, texts = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(orders, pa.int32()), pa.array(texts), pa.array(list(found.values()), pa.int64())], names=["lang", "size", "word", "n"])


def shares(rows: pa.Table, totals: np.ndarray, languages: list[str]) -> Shares:
    """Log shares from (word, langs, counts); ``totals`` count all words, the unknown ones too."""
    place = {x: k for k, x in enumerate(languages)}
    known = rows["word"].to_pylist()
    logs = np.full((len(known), len(languages)), SMOOTH)
    lists = rows["langs"].to_pylist()
    at = np.repeat(np.arange(len(known)), [len(x) for x in lists]) if known else np.empty(0, np.int64)
    logs[at, [place[x] for y in lists for x in y]] += [n for y in rows["counts"].to_pylist() for n in y]
    return Shares(known, (np.log(logs) - np.log(totals + SMOOTH * len(known))).astype(np.float32))


def _known(counted: DataFrame, least: int = LEAST) -> pa.Table:
    """Strings that occur often enough, with their counts in each language that has them; of the sample."""
    each = counted.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("lang", "n"))).alias("in_"), F.sum("n").alias("all_")).filter(F.col("all_") >= least)
    return each.select("word", F.col("in_.lang").alias("langs"), F.col("in_.n").alias("counts")).toArrow()


def _totals(counted: DataFrame, languages: list[str]) -> np.ndarray:
    found = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    return np.array([found.get(x, 0) for x in languages], float)


def learn(docs: DataFrame, size: int = SAMPLE) -> Model:
    """The model of the labelled rows that aren't held out."""
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    total = max(1, labelled.count())
    parts = 1_000_000
    picked = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit(FOLDS)), F.lit(parts)) < int(parts * min(1.0, size / total)))
    texts = picked.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = written(texts.mapInArrow(_counted, "lang string, word string, n long"), "language-counts")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # the sample's languages
    n_texts = rows.filter("word = ''")
    prior = np.log(np.maximum(_totals(n_texts, languages), 1.0))
    words = written(rows.filter("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    pieces = words.mapInArrow(_gram_rows, "lang string, size int, word string, n long").groupBy("lang", "size", "word").agg(F.sum("n").alias("n"))
    pieces = written(pieces, "language-grams")
    by_order = {}
    for order in ORDERS:
        mine = pieces.filter(F.col("size") == order)
        by_order[order] = shares(_known(mine), _totals(mine, languages), languages)
    known = shares(_known(words.filter(F.length("word") <= LONG_WORD)), _totals(words, languages), languages)
    return Model(languages, prior - np.log(np.exp(prior).sum()) if len(prior) else prior, known, by_order)


class Scorer(dict):
    """The row of each word's log shares: known ones, then those made by falling back, when first asked for."""

    def __init__(self, model: Model):
        super().__init__(zip(model.words.known, range(len(model.words.known)), strict=True))
        self.model, self.fixed = model, len(model.words.known)
        self.orders = [(k, {g: i for i, g in enumerate(model.orders[k].known)}, model.orders[k].logs) for k in sorted(model.orders, reverse=True)]
        self.rows = np.concatenate([model.words.logs, np.zeros((1024, len(model.languages)), np.float32)])
        self.used = self.fixed

    def fallen_back(self, word: str) -> np.ndarray:
        """The log shares of a word that isn't known: of its longest n-grams of which any is."""
        weight = 1.0
        for order, numbers, logs in self.orders:
            weight *= BACKOFF
            at = [numbers[g] for g in grams(word, order) if g in numbers]
            if at:
                return weight * logs[at].mean(0)
        return np.zeros(len(self.model.languages), np.float32)

    def __missing__(self, word: str) -> int:
        if self.used == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows[: max(1024, self.used - self.fixed)])])
        self.rows[self.used] = self.fallen_back(word)
        self.used += 1
        if len(word) <= LONG_WORD:
            self[word] = self.used - 1
        return self.used - 1

    def __call__(self, text: str | None) -> tuple[str, float]:
        found = words_in(text or "")
        if not found or not self.model.languages:
            return UNKNOWN, 0.0
        if self.used > self.fixed + REMEMBERED:  # forgets what it made, and starts again
            for word in [w for w, k in self.items() if k >= self.fixed]:
                del self[word]
            self.used = self.fixed
        at = list(map(self.__getitem__, found))
        n = np.fromiter(found.values(), float, len(found))
        sums = self.model.prior + (n @ self.rows[at].astype(float)) / TEMPER
        best = int(np.argmax(sums))
        return self.model.languages[best], float(1 / np.exp(sums - sums[best]).sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            said = [scorer(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    return predict(docs, learn(docs, size))
