"""Near-copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from ``simhash``'s covering tables, over fingerprints of the sets of shingles (a line that a
text repeats counts once, so boilerplate doesn't hide the rest). Texts with one set are one class before
that: its key is a digest of the sorted distinct hashes, so two texts with equal fingerprints are two
classes and are compared like any others. Each link is then checked by the hashes themselves: exactly for
texts of fewer than ``SKETCH`` distinct ones; by the smallest ``SKETCH`` of the union otherwise, whose
standard error is 0.0125; and exactly again, from all hashes, where that estimate is within ``BAND`` of the
threshold. Only texts that have a link are hashed for that.

Whether a pair of 0.8 or more is found is a matter of chance in three places: the pair must share a bucket,
differ in few enough bits, and, in a bucket, no nearer pair on its way may be below the threshold.

Groups are what links connect. Of a group the row with the smallest doc_id stays. Rows are told apart by a
key that is written with them, so rows that share a doc_id, or have none, are documents each.

Defined results: null, empty and wordless texts have the empty set, and are one class; a text of fewer words
than a shingle is one shingle. Very long texts are read whole. Ties of doc_id go to the row that comes
first in the table; rows without an id come last. Repeated rows are copies. An empty table gives an empty
table. Extra columns, whatever their names, are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import fresh, split_join, written
from listwright.llm.exact_dedup import _bit, _bitmap, _bits, _place
from listwright.llm.simhash import BUCKET, STAGE, Settings, hashes_of, links, marked
from listwright.operators.components import components

SIMILAR, SKETCH, BAND = 0.8, 1024, 0.08
#: A hair that keeps a ratio equal to the threshold above it.
HAIR = 1e-9
#: Rows whose sets of hashes a task holds at once.
ROWS = 512
_FACTORS = np.random.default_rng(77).integers(0, 1 << 32, 64 * STAGE.minima, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def set_of(text: str | None, settings: Settings = STAGE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(hashes_of(text or "", settings.shingle))


def minima(hashes: np.ndarray) -> list[int]:
    """One bit of the least hash under each of many orders: two sets agree in (1 + similarity) / 2 of them."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(_FACTORS), (1 << 32) - 1, np.uint32)
    for k in range(0, len(x), 2048):
        np.minimum(least, (x[k : k + 2048, None] * _FACTORS).min(axis=0), out=least)
    bits = np.packbits((least * np.uint32(0x9E3779B1)) >> np.uint32(31), bitorder="little")
    return bits.view(np.uint64).tolist()


def _marks(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys = [], []
            for text in batch.column(2):
                hashes = set_of(text.as_py(), settings)
                fps.append(np.array(marked(hashes, settings) + minima(hashes), np.uint64).view(np.int64))
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.list_(pa.int64())), pa.array(keys, pa.binary())], names=["row", "doc", "fp", "key"])

    return run


def _hashes(settings: Settings, most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            sets = [set_of(t.as_py(), settings).view(np.int64) for t in batch.column(1)]
            sets = sets if most is None else [np.sort(x)[:most] for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    return run


def estimate(x: Column, y: Column, most: int = SKETCH) -> Column:
    """Jaccard similarity of two sets by their ``most`` least members, exact where both have fewer."""
    both = F.array_union(x, y)
    seen = F.when((F.size(x) < most) & (F.size(y) < most), both).otherwise(F.slice(F.array_sort(both), 1, most))
    return F.when(F.size(both) > 0, F.size(F.array_intersect(F.array_intersect(seen, x), y)) / F.size(seen)).otherwise(F.lit(0.0))


def sifted(rows: DataFrame, row: str, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be one of ``keys``, and rows whose key isn't.

    A bit map of the keys, of bounded size, is broadcast, so that rows it clears aren't shuffled to be joined.
    """
    place, map_, no = (fresh(rows, x) for x in ("row_place", "row_map", "map_no"))
    bits = _bits(keys.count())
    maps = F.broadcast(_bitmap(keys.select(F.col(key).alias("_key")), bits).toDF(no, map_))
    placed = rows.withColumn(place, _place(F.col(row), bits)).join(maps, F.shiftright(place, 15) == F.col(no), "left")
    maybe = F.coalesce(_bit(F.col(map_), F.col(place)), F.lit(False))
    return placed.filter(maybe).select(*rows.columns), placed.filter(~maybe).select(*rows.columns)


def _texts_of(ends: DataFrame, rows: DataFrame, settings: Settings, most: int | None) -> DataFrame:
    """(node, hashes) of the nodes that ``ends(a, b)`` name; a written table."""
    named = written(ends.select(F.col("a").alias("end_")).unionByName(ends.select(F.col("b").alias("end_"))).distinct(), "near-named-ends")
    some, _ = sifted(rows.select("row", "text"), "row", named, "end_")
    return written(some.join(named, F.col("row") == F.col("end_"), "left_semi").mapInArrow(_hashes(settings, most), "node long, hashes array<long>"), "near-hashes")


def _exact(edges: DataFrame, rows: DataFrame, settings: Settings) -> DataFrame:
    """The edges whose ends have the similarity, by all their hashes."""
    full = _texts_of(edges, rows, settings, None)
    of = lambda side: full.select(F.col("node").alias(f"node_{side}"), F.col("hashes").alias(f"hashes_{side}"))
    both = edges.join(of("a"), F.col("a") == F.col("node_a")).join(of("b"), F.col("b") == F.col("node_b"))
    shared = F.size(F.array_intersect("hashes_a", "hashes_b"))
    return both.filter(shared / (F.size("hashes_a") + F.size("hashes_b") - shared) >= SIMILAR - HAIR).select("a", "b")


def checked(edges: DataFrame, rows: DataFrame, settings: Settings = STAGE) -> DataFrame:
    """The edges between nodes of ``rows(row, text)`` whose texts have the similarity.

    A hub's sketch isn't brought to its edges by a shuffle: hot hubs are at most ``MOST_HOT`` of some 8 KB.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-edges")
    sketches, total, out = _texts_of(edges, rows, settings, SKETCH), edges.count(), edges
    for side in ("a", "b"):
        degrees = edges.groupBy(F.col(side).alias("end_")).agg(F.count(F.lit(1)).alias("rows_"))
        small = sketches.join(degrees, F.col("node") == F.col("end_")).select("node", F.col("hashes").alias(f"sketch_{side}"), "rows_")
        out = split_join(out, side, written(small, "near-ends"), "node", "rows_", total).drop("node", "rows_")
    whole = (F.size("sketch_a") < SKETCH) & (F.size("sketch_b") < SKETCH)
    told = written(out.select("a", "b", whole.alias("whole"), estimate(F.col("sketch_a"), F.col("sketch_b")).alias("share")), "near-shares")
    sure = told.filter(F.when(F.col("whole"), F.col("share") >= SIMILAR - HAIR).otherwise(F.col("share") > SIMILAR + BAND)).select("a", "b")
    close = told.filter(~F.col("whole") & (F.abs(F.col("share") - SIMILAR) <= BAND)).select("a", "b")
    return sure.unionByName(_exact(close, rows, settings))


def groups(docs: DataFrame, row: str, settings: Settings = STAGE, bucket: int = BUCKET) -> DataFrame:
    """(row, kept): each row of ``docs``, by its key, with the row of its group that stays."""
    rows = docs.select(F.col(row).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    marks = written(rows.mapInArrow(_marks(settings), "row long, doc long, fp array<long>, key binary"), "near-marks")
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("first")
    classes = written(marks.groupBy("key").agg(F.min("fp").alias("fp"), first, F.count(F.lit(1)).alias("rows_")).withColumn("node", F.col("first.row")), "near-classes")
    found = written(components(checked(links(classes.select("fp", "node"), settings, bucket), rows, settings)), "near-components")
    linked = classes.select("node", "first").join(found.withColumnRenamed("node", "member"), F.col("node") == F.col("member"))
    least = written(linked.groupBy("component").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n_")).select(F.col("component").alias("of_"), F.col("least.row").alias("kept"), "n_"), "near-least")
    members = split_join(found, "component", least, "of_", "n_", found.count()).select(F.col("node").alias("member"), "kept")
    named = classes.join(written(members, "near-members"), F.col("node") == F.col("member"), "left").select(F.col("key").alias("key_"), F.coalesce("kept", "node").alias("kept"), "rows_")
    return split_join(marks.select("row", "key"), "key", written(named, "near-named"), "key_", "rows_", marks.count()).select("row", "kept")


def keep_smallest(docs: DataFrame, settings: Settings = STAGE) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; own columns only."""
    row, gone_row = fresh(docs, "near_row"), fresh(docs, "near_gone")
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    gone = written(groups(keyed, row, settings).filter("row <> kept").select(F.col("row").alias(gone_row)), "near-gone")
    some, others = sifted(keyed, row, gone, gone_row)
    return some.join(gone, F.col(row) == F.col(gone_row), "left_anti").unionByName(others).drop(row)
