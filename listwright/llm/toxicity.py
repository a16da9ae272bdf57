"""Toxicity: a chain of linear classifiers, one per category.

Categories come in a fixed order: first the kinds of toxic text, then toxicity itself, whose link gives
the verdict. The labels only say toxic or not, so the kinds are found in the data: toxic labelled texts,
in whatever language, are clustered by the words that tell them from the others; a text belongs to the
kind of its cluster. Each fold's models are trained on kinds that are found without its texts; so that a
kind has one number, those are matched to the kinds of all texts by their words. Each category has a logistic model over the presence of hashed words and over the
probabilities of all earlier categories. In training, those probabilities are out-of-fold: for each fold
they come from models that haven't seen it (copies of a text are one example), so a later model learns
from earlier ones as wrong as they will be on new texts. Scoring runs the chain's full models, in order,
over whole texts.

Training uses a bounded sample of labelled documents (``SAMPLE`` rows expected, picked by hash, all of
them if fewer). Their words are counted in Spark by fold and label; only the ``CANDIDATES`` that tell the
label best outside some fold come to the driver, and for each sampled text which of them it holds. Each
model keeps the ``FEATURES`` that tell its category best; the threshold is the highest whose F1 on
out-of-fold probabilities of the last category is near the best.

Defined results: a null or empty text has no words and gets the models' base probabilities, which for a
rare category are below the threshold. Very long texts are read whole. A probability equal to the
threshold isn't toxic; of equally telling words the lower hash comes first. Without labelled rows of
both kinds a category's probability is 0, so nothing is rejected. Labels that are null, or of documents
that don't exist, are left out; a document labelled twice is toxic if one label says so. Repeated rows
get equal verdicts, an empty table gives an empty table. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import written

#: Labelled documents that the chain is fitted on, at most (expected), and words that come to the driver.
SAMPLE, CANDIDATES = 12_000, 2_048
FOLDS, FEATURES, HASH_BITS = 5, 512, 20
STEMS = (3, 4, 5)
F1_SLACK = 0.005
#: A word must be in so many texts to be a feature.
LEAST_TEXTS = 5
#: And tell its category by so many standard deviations; weights are penalised by their square.
LEAST_Z, PENALTY = 5.0, 3e-4
#: Kinds that toxic texts are parted into, and rounds of the clustering.
KINDS, CLUSTER_ROUNDS = 4, 25
#: Toxic texts that a kind is worth; fewer of them are parted into fewer kinds.
KIND_TEXTS = 25
#: In chain order; the last one is the table's own label and gives the verdict.
CATEGORIES = (*[f"kind_{k + 1}" for k in range(KINDS)], "toxic")
#: Words whose candidates a worker remembers.
REMEMBERED = 500_000
_WORDS = re.compile(r"[^\W\d_]+")
_MASK = (1 << HASH_BITS) - 1


def _hashes(word: str) -> tuple[int, ...]:
    """Hashes of a word, and of its first letters where it is longer (forms share a stem)."""
    stems = [b"^" + word[:n].encode() for n in STEMS if len(word) > n]
    return tuple(zlib.crc32(x) & _MASK for x in (word.encode(), *stems))


def word_hashes(text: str | None) -> set[int]:
    """Hashes of the distinct words and stems of a text."""
    return set(chain.from_iterable(map(_hashes, set(_WORDS.findall((text or "").lower())))))


class Linear(NamedTuple):
    """A logistic model: features (sorted), their weights, weights of earlier links, bias."""

    features: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    bias: float


class Chain(NamedTuple):
    """Candidates (their hashes, by number), the links over them in order, and the last one's threshold."""

    hashes: np.ndarray
    links: list[Linear]
    threshold: float


def logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return float(np.log(p / (1 - p)))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _z(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """How many standard deviations two proportions differ by."""
    share = (pos + neg) / max(n_pos + n_neg, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / max(n_pos, 1) + 1 / max(n_neg, 1)))
    return (pos / max(n_pos, 1) - neg / max(n_neg, 1)) / spread


def _choose(docs: np.ndarray, words: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The words whose presence tells y best."""
    size = int(words.max()) + 1 if len(words) else 0
    in_pos = np.bincount(words, weights=y[docs], minlength=size)
    total = np.bincount(words, minlength=size)
    z = np.abs(_z(in_pos, total - in_pos, y.sum(), len(y) - y.sum()))
    z[total < LEAST_TEXTS] = 0
    best = np.argsort(-z, kind="stable")[:FEATURES]
    return np.sort(best[z[best] > LEAST_Z])


def fit(docs: np.ndarray, words: np.ndarray, y: np.ndarray, earlier: np.ndarray, rows: np.ndarray) -> Linear:
    """A model of ``y`` from the pairs (docs, words) and earlier logits, on the given rows only."""
    position = np.full(len(y), -1)
    position[rows] = np.arange(len(rows))
    mine = position[docs] >= 0
    docs, words, y, earlier = position[docs[mine]], words[mine], y[rows].astype(float), earlier[rows]
    if not len(y) or not 0 < y.sum() < len(y):
        return Linear(np.empty(0, np.int64), np.empty(0), np.zeros(earlier.shape[1]), -30.0)
    features = _choose(docs, words, y)
    at = np.searchsorted(features, words)
    hit = (at < len(features)) & (features[np.minimum(at, len(features) - 1)] == words) if len(features) else np.zeros(len(words), bool)
    docs, at = docs[hit], at[hit]
    k = len(features)
    theta = np.zeros(k + earlier.shape[1] + 1)
    theta[-1] = np.log(y.mean() / (1 - y.mean()))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    penalty = np.r_[np.full(k + earlier.shape[1], PENALTY), 0.0]
    for step in range(1, 301):  # Adam on the whole sample
        z = np.bincount(docs, weights=theta[at], minlength=len(y)) + earlier @ theta[k:-1] + theta[-1]
        error = (sigmoid(z) - y) / len(y)
        slope = np.r_[np.bincount(at, weights=error[docs], minlength=k), earlier.T @ error, error.sum()] + penalty * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return Linear(features, theta[:k], theta[k:-1], float(theta[-1]))


def _all_logits(model: Linear, docs: np.ndarray, words: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    z = model.bias + earlier @ model.chain
    if len(model.features):
        at = np.minimum(np.searchsorted(model.features, words), len(model.features) - 1)
        hit = model.features[at] == words
        z = z + np.bincount(docs[hit], weights=model.weights[at[hit]], minlength=len(z))
    return z


def fit_chain(docs: np.ndarray, words: np.ndarray, labels: np.ndarray, folds: np.ndarray, without: Sequence[np.ndarray] | None = None) -> tuple[list[Linear], float]:
    """Models in chain order, and the last one's threshold; ``without`` has the labels as known without each fold."""
    n = len(labels)
    earlier, models = np.zeros((n, 0)), []
    out = np.zeros(n)
    for k, y in enumerate(labels.T):
        out = np.zeros(n)
        for fold in range(FOLDS):
            held = folds == fold
            if held.any():
                model = fit(docs, words, y if without is None else without[fold][:, k], earlier, np.flatnonzero(~held))
                out[held] = sigmoid(_all_logits(model, docs, words, earlier)[held])
        models.append(fit(docs, words, y, earlier, np.arange(n)))
        clipped = np.clip(out, 1e-4, 1 - 1e-4)
        earlier = np.column_stack([earlier, np.log(clipped / (1 - clipped))])
    return models, best_threshold(out, labels[:, -1] if n else np.empty(0))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The highest probability from which the verdict's F1 is within ``F1_SLACK`` of the best.

    F1 is flat around its best; the higher end leaves more clean documents alone. A model that tells
    nothing rejects nothing.
    """
    if not len(y) or not y.any():
        return 1.0
    order = np.argsort(-p, kind="stable")
    hits, said = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    f1 = 2 * hits / (said + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = 0  # a threshold can't part equals
    f1[2 * hits <= said] = 0  # nor reject more clean texts than toxic ones
    if not f1.any():
        return 1.0
    at = int(np.argmax(f1 >= f1.max() - F1_SLACK))
    below = p[order][at + 1] if at + 1 < len(y) else 0.0
    return float((p[order][at] + below) / 2)


def kinds_of(docs: np.ndarray, words: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
    """The kind of each toxic text, by size of the kinds; -1 for other texts and those without a telling word.

    Clusters of directions (spherical k-means) over the words that speak for toxicity, weighted by how
    much they tell; centres begin at the heaviest text and then at the one least like those chosen.
    """
    out = np.full(len(toxic), -1)
    if not len(words) or not 0 < toxic.sum() < len(toxic):
        return out
    pos = np.bincount(words, weights=toxic[docs], minlength=size)
    z = _z(pos, np.bincount(words, minlength=size) - pos, toxic.sum(), len(toxic) - toxic.sum())
    z[z < LEAST_Z] = 0
    rows = np.flatnonzero(toxic)
    place = np.full(len(toxic), -1)
    place[rows] = np.arange(len(rows))
    x = np.zeros((len(rows), size), np.float32)
    mine = place[docs] >= 0
    x[place[docs[mine]], words[mine]] = z[words[mine]]
    length = np.linalg.norm(x, axis=1)
    told = np.flatnonzero(length > 0)
    if not len(told):
        return out
    x = x[told] / length[told, None]
    centres, most = [x[int(np.argmax(length[told]))]], max(1, min(KINDS, int(toxic.sum()) // KIND_TEXTS))
    while len(centres) < most:
        centres.append(x[int(np.argmin(np.max(x @ np.stack(centres).T, axis=1)))])
    c = np.stack(centres)
    for _ in range(CLUSTER_ROUNDS):
        label = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[label == k].sum(0) if (label == k).any() else c[k] for k in range(most)])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    label = np.argmax(x @ c.T, axis=1)
    rank = np.argsort(np.argsort(-np.bincount(label, minlength=KINDS), kind="stable"), kind="stable")
    out[rows[told]] = rank[label]
    return out


def matched_kinds(docs: np.ndarray, words: np.ndarray, kinds: np.ndarray, other: np.ndarray, size: int) -> np.ndarray:
    """``other``'s kinds under the numbers of those of ``kinds`` whose words are most alike, the largest first."""

    def profiles(of: np.ndarray) -> np.ndarray:
        out = np.zeros((KINDS, size))
        mine = of[docs] >= 0
        np.add.at(out, (of[docs[mine]], words[mine]), 1.0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    alike, number, free = profiles(other) @ profiles(kinds).T, np.arange(KINDS), list(range(KINDS))
    for k in range(KINDS):
        number[k] = max(free, key=lambda j: (alike[k, j], -j))
        free.remove(number[k])
    return np.where(other >= 0, number[np.maximum(other, 0)], -1)


def kinds_without(docs: np.ndarray, words: np.ndarray, toxic: np.ndarray, folds: np.ndarray, kinds: np.ndarray, size: int) -> list[np.ndarray]:
    """The kinds of the texts outside each fold, found without its texts."""
    out = []
    for fold in range(FOLDS):
        rows = np.flatnonzero(folds != fold)
        place = np.full(len(toxic), -1)
        place[rows] = np.arange(len(rows))
        mine = place[docs] >= 0
        own = np.full(len(toxic), -1)
        own[rows] = kinds_of(place[docs[mine]], words[mine], toxic[rows], size)
        out.append(matched_kinds(docs, words, np.where(folds != fold, kinds, -1), own, size))
    return out


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """The labelled texts to fit on, each once: text, toxic, key (a hash of the text) and fold; a written table."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_doc")).agg(F.max("toxic").alias("label_toxic"))
    total = max(1, known.count())
    parts = 1_000_000
    picked = known.filter(F.pmod(F.xxhash64("label_doc"), F.lit(parts)) < int(parts * min(1.0, size / total)))
    picked = written(picked, "labels")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most ``size`` ids, so the side's size is bounded whatever the input.
    found = text.join(F.broadcast(picked), F.col("doc_id") == F.col("label_doc")).select(F.coalesce("text", F.lit("")).alias("text"), F.col("label_toxic").cast("int").alias("toxic"))
    once = found.groupBy(F.xxhash64("text").alias("key"), "text").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    return written(once.withColumn("fold", F.pmod("key", F.lit(FOLDS)).cast("int")), "labelled")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each hash occurs in a batch's texts, by fold and label."""
    for batch in batches:
        groups: dict[tuple[int, int], list] = {}
        for text, toxic, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            groups.setdefault((fold, toxic), []).append(np.fromiter(word_hashes(text.as_py()), np.int32))
        for (fold, toxic), lists in groups.items():
            words, n = np.unique(np.concatenate(lists), return_counts=True)
            if len(words):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words), pa.array([fold] * len(words), pa.int32()), pa.array([toxic] * len(words), pa.int32()), pa.array(n, pa.int64())], names=["hash", "fold", "toxic", "n"]
                )


def candidates(texts: DataFrame, most: int = CANDIDATES) -> np.ndarray:
    """Hashes that tell toxic from other texts, of all folds or outside one of them, the best first.

    Each fold's models choose among them by the texts outside of it alone (``fit``), so what all folds tell only
    adds to what the last models choose from."""
    totals = {(r["fold"], r["toxic"]): r["n"] for r in texts.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two a fold
    counts = texts.select("text", "toxic", "fold").mapInArrow(_counted, "hash int, fold int, toxic int, n long")
    of = lambda fold, toxic: F.coalesce(F.sum(F.when((F.col("fold") == fold) & (F.col("toxic") == toxic), F.col("n"))), F.lit(0))
    per = counts.groupBy("hash").agg(F.sum("n").alias("all_"), *[of(f, t).alias(f"n{f}_{t}") for f in range(FOLDS) for t in (0, 1)]).filter(F.col("all_") >= LEAST_TEXTS)

    def tells(without: int | None) -> Column:
        folds = [f for f in range(FOLDS) if f != without]
        n = [float(max(1, sum(totals.get((f, t), 0) for f in folds))) for t in (0, 1)]
        got = [sum((F.col(f"n{f}_{t}") for f in folds), F.lit(0)) for t in (0, 1)]
        share = (got[0] + got[1]) / sum(n)
        return F.abs(got[1] / n[1] - got[0] / n[0]) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n[0] + 1 / n[1]))

    best = F.greatest(*[tells(f) for f in (None, *range(FOLDS))])
    rows = per.select("hash", F.round(best, 6).alias("z")).filter(F.col("z") > LEAST_Z).orderBy(F.desc("z"), "hash").limit(most).collect()
    return np.array([r["hash"] for r in rows], np.int64)


class _Known(dict):
    """Candidates of words by number, made when first asked for."""

    def __init__(self, hashes: np.ndarray):
        super().__init__()
        self.numbers = {int(h): i for i, h in enumerate(hashes)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = tuple(self.numbers[h] for h in _hashes(word) if h in self.numbers)
        if len(self) < REMEMBERED and len(word) < 100:
            self[word] = got
        return got

    def __call__(self, text: str | None) -> list[int]:
        words = set(_WORDS.findall((text or "").lower()))
        return sorted(set(chain.from_iterable(map(self.__getitem__, words))))


def _held(hashes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(hashes)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), batch.column(3), pa.array([known(t.as_py()) for t in batch.column(0)], pa.list_(pa.int32()))], names=["toxic", "fold", "key", "words"]
            )

    return run


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Chain:
    texts = sample(docs, labels, size)
    hashes = candidates(texts)
    got = texts.select("text", "toxic", "fold", "key").mapInArrow(_held(hashes), "toxic int, fold int, key long, words array<int>").toArrow()
    got = got.sort_by([("key", "ascending"), ("toxic", "ascending")])
    toxic, folds = got["toxic"].to_numpy().astype(float), got["fold"].to_numpy()
    lists = got["words"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    lengths = np.array([len(x) for x in lists], np.int64) if len(toxic) else np.zeros(0, np.int64)
    words = np.concatenate([np.asarray(x.values, np.int64) for x in lists]) if lengths.sum() else np.zeros(0, np.int64)
    at = np.repeat(np.arange(len(toxic)), lengths)
    kinds = kinds_of(at, words, toxic, len(hashes))
    columns = lambda of: np.column_stack([*[(of == k).astype(float) for k in range(KINDS)], toxic])
    without = [columns(of) for of in kinds_without(at, words, toxic, folds, kinds, len(hashes))]
    links, threshold = fit_chain(at, words, columns(kinds), folds, without)
    return Chain(hashes, links, threshold)


def _scored(model: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = _Known(model.hashes), len(model.hashes)
        dense = np.zeros((len(model.links), size))
        for k, link in enumerate(model.links):
            dense[k, link.features] = link.weights
        for batch in batches:
            out = np.zeros((batch.num_rows, len(model.links)))
            for i, text in enumerate(batch.column(1)):
                hits, logits = known(text.as_py()), []
                sums = dense[:, hits].sum(1)
                for k, link in enumerate(model.links):
                    out[i, k] = p = float(sigmoid(link.bias + float(np.dot(link.chain, logits)) + sums[k]))
                    logits.append(logit(p))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[:, k]) for k in range(len(model.links))]], names=["doc_id", *[f"p_{c}" for c in CATEGORIES]])

    return run


def score(docs: DataFrame, model: Chain) -> DataFrame:
    """One row per document: doc_id, a probability per category, toxic, kept."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES)
    toxic = F.col(f"p_{CATEGORIES[-1]}") > F.lit(model.threshold)
    return narrow.mapInArrow(_scored(model), schema).withColumn("toxic", toxic).withColumn("kept", ~toxic)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't toxic, own columns only; each row is judged where it is read."""
    model = train(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scored = next(_scored(model)(iter([pa.RecordBatch.from_arrays([batch.column(0), batch.column(at)], names=["a", "b"])])))
            yield batch.filter(pa.array(scored.column(len(model.links)).to_numpy() <= model.threshold))

    return docs.mapInArrow(run, docs.schema)
