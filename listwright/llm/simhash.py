"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's bit is 1 when more than half of the text's shingle hashes set it. For radius r,
every bit position gets a vector of r+1 random bits, and each of the 2^(r+1)-1 non-zero vectors v
gives one table, whose mask holds the positions with an odd product with v. The vectors of at most r
differing positions span at most r dimensions, so some v is orthogonal to all of them: that table's
mask hides every difference, and the pair shares its bucket. No pair within the radius can be
missed (Pagh, "CoveringLSH").

``QUERY`` has one word of 64 bits, links at 3 bits, and is complete. ``STAGE``, which ``near_copies`` uses, has
384 bits, covered in twelve 32-bit parts with radius 2 each: complete up to 35 differing bits, as one part
then differs in two at most; beyond, a pair meets if one of 84 masks hides its differences. Behind the
fingerprint it stores 256 one-bit minima of the shingles' hashes, which tell the similarity of two sets
better than the fingerprint does: in a bucket those are compared, and link if few of them differ, and a
bucket gives the spanning forest of its nearest pairs.

Copies of a fingerprint are one class before any table is built. Buckets are dealt by key, scanned
in sorted order, and linked inside by blocks; each gives a spanning forest, not its pairs. A bucket
of more than ``BUCKET`` classes isn't compared there but dealt again by a further family of masks,
which has the same guarantee; what is still too large after the last family is compared block by
block, one block pair a task's row, so nothing is skipped.

Defined results: a null or wordless text has fingerprint zero and links like any other; texts of
fewer words than a shingle are one shingle. Very long texts are read whole. Of equal texts and of ties,
the smallest doc_id names the component. Rows with null doc_id get a fingerprint; their component is
that of the other rows of it, and null if there is none. Repeated rows share a component, an empty
table gives an empty table, and only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import LOWER, UPPER, WORD, parts_for, split_join, written
from listwright.operators.components import components

SEED = 42
#: Classes of one bucket that one task compares at once.
BUCKET = 2048
#: Rows of tables that one task sorts and scans.
SCANNED = 2_000_000
_ASCII = str.maketrans(UPPER, LOWER)
_WORDS = re.compile(WORD)


class Settings(NamedTuple):
    """Words of a shingle, 64-bit words of a fingerprint, bits of a part, its radius, families, and the bits that link."""

    shingle: int = 3
    words: int = 1
    width: int = 64
    radius: int = 3
    families: int = 3
    limit: int = 3
    #: 64-bit words of one-bit minima that follow the fingerprint, and are compared in its place.
    minima: int = 0

    @property
    def compared(self) -> int:
        """Words that a bucket's rows have."""
        return self.minima or self.words


QUERY = Settings()
STAGE = Settings(shingle=5, words=6, width=32, radius=2, families=1, limit=48, minima=4)


def hashes_of(text: str, size: int = 3) -> np.ndarray:
    words = _WORDS.findall(text.translate(_ASCII))
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        shingles = [" ".join(words)]
    else:
        shingles = map(" ".join, zip(*[words[i:] for i in range(size)], strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th word of a longer hash (the finisher of SplitMix64); the first is the hash itself."""
    if not k:
        return hashes
    x = hashes + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes set each bit; sums of 255 rows fit a byte, blocks of them stay in cache."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4080):
        bits = np.unpackbits(hashes[k : k + 4080].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            counts += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        counts += bits[whole:].sum(0, dtype=np.int64)
    return counts


def fingerprint(text: str | None, settings: Settings = QUERY) -> list[int]:
    """The unsigned 64-bit words of a text's fingerprint."""
    return marked(hashes_of(text or "", settings.shingle), settings)


def marked(hashes: np.ndarray, settings: Settings) -> list[int]:
    if not len(hashes):
        return [0] * settings.words
    out = []
    for k in range(settings.words):
        bits = np.packbits(2 * _bit_counts(_mixed(hashes, k)) > len(hashes), bitorder="little")
        out.append(int(bits.view(np.uint64)[0]))
    return out


def _fingerprints(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), settings) for t in batch.column(1)], np.uint64).reshape(-1, settings.words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(marks), pa.list_(pa.int64()))], names=["doc_id", "fp"])

    return run


def masks(family: int, radius: int = 3, width: int = 64, part: int = 0) -> list[int]:
    """The masks of one covering family over the bits of one part; every position is in most."""
    rng = np.random.default_rng(1000 + family + 100 * part)
    top = 2 ** (radius + 1)
    vectors = rng.permutation(np.arange(width) % (top - 1) + 1)  # non-zero and evenly used
    return [sum(1 << i for i in range(width) if bin(int(vectors[i]) & v).count("1") % 2) for v in range(1, top)]


def tables(family: int, settings: Settings) -> list[tuple[int, int]]:
    """(word, mask as a signed 64-bit integer) of all tables of a family: each part is covered."""
    out = []
    for part in range(64 * settings.words // settings.width):
        word, shift = divmod(part * settings.width, 64)
        for mask in masks(family, settings.radius, settings.width, part):
            bits = mask << shift
            out.append((word, bits - (1 << 64) if bits >> 63 else bits))
    return out


def _dealt(rows: DataFrame, family: int, settings: Settings) -> DataFrame:
    """Each row once a table: its bucket within (bucket) the one it was in."""
    each = [F.xxhash64("bucket", F.lit(family), F.lit(i), F.get("fp", F.lit(w)).bitwiseAND(F.lit(m))) for i, (w, m) in enumerate(tables(family, settings))]
    compared = F.slice("fp", settings.words + 1, settings.minima) if settings.minima else F.col("fp")
    return rows.select(F.explode(F.array(*each)).alias("bucket"), compared.alias("fp"), "node")


def _linked(fps: np.ndarray, nodes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among these rows (bits by words), as edges of nodes.

    A row is only compared with rows it isn't connected to yet, so a group of copies costs one pass.
    """
    label = np.arange(len(fps))
    a, b, groups = [], [], len(fps)
    for i in range(len(fps) - 1):
        if groups == 1:
            break
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        near = rest[np.bitwise_count(fps[rest] ^ fps[i]).sum(1) <= limit]
        if len(near):
            joined, first = np.unique(label[near], return_index=True)
            a += [nodes[i]] * len(first)
            b += list(nodes[near[first]])
            groups -= len(joined)
            label[np.isin(label, joined)] = label[i]
    return np.array(a, np.int64), np.array(b, np.int64)


def _nearest(fps: np.ndarray, nodes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The spanning forest of the links with the fewest bits (Prim's); ties go by node, so buckets agree on it."""
    order = np.argsort(nodes, kind="stable")
    fps, nodes = fps[order], nodes[order]
    left, at = np.arange(1, len(nodes)), 0
    bits, by = np.full(len(left), np.iinfo(np.int64).max), np.zeros(len(left), np.int64)
    a, b = [], []
    while len(left):
        now = np.bitwise_count(fps[left] ^ fps[at]).sum(1, dtype=np.int64)
        closer = now < bits
        bits[closer], by[closer] = now[closer], at
        k = int(np.argmin(bits))
        at = left[k]
        if bits[k] <= limit:
            a.append(nodes[by[k]])
            b.append(nodes[at])
        left, bits, by = (np.delete(x, k) for x in (left, bits, by))
    return np.array(a, np.int64), np.array(b, np.int64)


def _forest(fps: np.ndarray, nodes: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links; of the nearest ones where there are minima to tell."""
    a, b = _linked(fps, nodes, settings.limit)
    if not settings.minima or not len(a):
        return a, b
    some = np.isin(nodes, np.concatenate([a, b]))
    return _nearest(fps[some], nodes[some], settings.limit)


def _words_of(column: pa.Array, words: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, words)


def _scan(settings: Settings, limit: int):
    """Scans rows sorted by bucket: edges of small buckets, and the rows of large ones as they are."""

    def batch(bucket, a, b, fps, large):
        lists = pa.array(list(fps), pa.list_(pa.int64())) if fps is not None else pa.nulls(len(a), pa.list_(pa.int64()))
        names = ["bucket", "a", "b", "fp", "large"]
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists, pa.array([large] * len(a), pa.bool_())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        over = None  # the large bucket being passed on

        def passed_on(rows: np.ndarray):
            return batch(rows[:, 0], rows[:, 1], rows[:, 1], rows[:, 2:], True)

        def closed(rows: np.ndarray):
            cuts = np.flatnonzero(np.diff(rows[:, 0])) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(rows)]
            found_a, found_b = [], []
            for k in np.flatnonzero(ends - starts > 1):
                part = rows[starts[k] : ends[k]]
                if len(part) > limit:
                    yield passed_on(part)
                    continue
                a, b = _forest(np.ascontiguousarray(part[:, 2:]).view(np.uint64), part[:, 1], settings)
                if len(a):
                    found_a.append(a)
                    found_b.append(b)
            if found_a:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                yield batch(np.zeros(len(a), np.int64), a, b, None, False)

        for got in batches:
            if not got.num_rows:
                continue
            rows = np.column_stack([got.column(0).to_numpy(zero_copy_only=False), got.column(2).to_numpy(zero_copy_only=False), _words_of(got.column(1), settings.compared)])
            if over is not None:
                mine = rows[:, 0] == over
                if mine.any():
                    yield passed_on(rows[mine])
                rows = rows[~mine]
                if not len(rows):
                    continue
                over = None
            if held:
                rows = np.concatenate([*held, rows])
                held = []
            last = np.searchsorted(rows[:, 0], rows[-1, 0])
            yield from closed(rows[:last]) if last else ()
            rest = rows[last:]
            if len(rest) > limit:
                yield passed_on(rest)
                over = rest[0, 0]
            else:
                held = [rest]
        if held:
            yield from closed(np.concatenate(held))

    return run


def _blocks(rows: DataFrame, settings: Settings, bucket: int) -> DataFrame:
    """Links within buckets that no family of masks has split: block against block, each a group.

    A bucket has as many blocks as its rows need for two of them to be one task's comparison.
    """
    sizes = written(rows.groupBy(F.col("bucket").alias("b_")).agg(F.count(F.lit(1)).alias("n_")), "bucket-sizes")
    sized = split_join(rows, "bucket", sizes, "b_", "n_", rows.count())
    blocks = F.ceil(2 * F.col("n_") / F.lit(bucket)).cast("int")
    split = sized.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = split.select("*", other).select("bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "fp", "node")

    def compare(frame: pa.Table) -> pa.Table:
        frame = frame.combine_chunks()
        fps = np.ascontiguousarray(_words_of(frame["fp"].chunk(0), settings.compared)).view(np.uint64) if frame.num_rows else np.empty((0, settings.compared), np.uint64)
        a, b = _forest(fps, frame["node"].to_numpy(), settings)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return pairs.groupBy("bucket", "x", "y").applyInArrow(compare, "a long, b long")


def links(classes: DataFrame, settings: Settings = QUERY, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between nodes of ``classes(fp, node)`` that connect all pairs that link."""
    spark = classes.sparkSession
    rows = classes.select(F.lit(0).cast("long").alias("bucket"), "fp", "node")
    edges = None
    for family in range(settings.families):
        parts = parts_for(spark, rows.count() * len(tables(family, settings)), SCANNED)
        dealt = _dealt(rows, family, settings).repartition(parts, "bucket").sortWithinPartitions("bucket")
        scanned = written(dealt.mapInArrow(_scan(settings, bucket), "bucket long, a long, b long, fp array<long>, large boolean"), "links")
        found = scanned.filter("not large").select("a", "b")
        edges = found if edges is None else edges.unionByName(found)
        rows = scanned.filter("large").select("bucket", "fp", F.col("a").alias("node"))
        if rows.isEmpty():
            return edges
    return edges.unionByName(_blocks(rows, settings, bucket))


def fingerprints(docs: DataFrame, settings: Settings = QUERY) -> DataFrame:
    """(doc_id, fp) of all rows, as a written table; fp holds the fingerprint's words."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(narrow.mapInArrow(_fingerprints(settings), "doc_id long, fp array<long>"), "fingerprints")


def near_duplicates(docs: DataFrame, settings: Settings = QUERY, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    marks = fingerprints(docs, settings)
    classes = written(marks.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows_")), "classes")
    edges = links(classes.filter("node is not null"), settings, bucket)
    found = written(components(edges), "components").withColumnRenamed("node", "member")
    named = classes.join(found, classes["node"] == found["member"], "left").select(F.col("fp").alias("fp_"), F.coalesce("component", "node").alias("component_id"), "rows_")
    joined = split_join(marks, "fp", written(named, "classes"), "fp_", "rows_", marks.count())
    return joined.select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def hexed(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda w: F.lower(F.lpad(F.hex(w), 16, "0"))), "")
