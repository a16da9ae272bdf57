"""Exact de-duplication through a cuckoo-filter index of live digests.

Texts are digested (SHA-256) natively. Each scan task merges its own copies in a local index, which is
emptied when it is full, so a text that a third of all rows share leaves a task a few times; what is left is dealt by digest to shards,
and one index per shard merges it. An index holds short fingerprints in two-choice buckets of four;
a hit is verified against the full digest and text length that are stored under the same bucket, so
a false hit never merges two texts. When an insertion kicks too often, the table doubles and is
refilled from the stored keys. A row with a larger doc_id replaces the live entry by deletion and
insertion.

Defined results: a null text counts as empty; very long texts are digested whole; of equal texts the row with the largest doc_id stays
(null doc_ids rank lowest). Rows that repeat both doc_id and text are told apart by their place in
the table, and one of them stays. An empty table gives an empty table. Only ``doc_id`` and ``text``
are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import fresh, parts_for, split_join, text_or_empty, written

SLOTS = 4
MAX_KICKS = 200
#: Distinct digests that one shard's index is meant to hold, and that a scan task's local index holds at most.
SHARD_KEYS, LOCAL_KEYS = 400_000, 200_000


class CuckooIndex:
    """Live digests with one payload each; supports insertion, deletion and growth.

    ``prints`` has a 16-bit fingerprint per slot (0: free), ``keys`` the full key and payload of the
    same slot. A key's two buckets follow from its own bytes and its fingerprint, so an entry can
    move between them without the key's hash being computed again.
    """

    def __init__(self, buckets: int = 64):
        size = 1
        while size < buckets:
            size *= 2
        self._clear(size)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * SLOTS)
        self.keys: list = [None] * (buckets * SLOTS)
        self.live = 0

    @staticmethod
    def _print(key: bytes) -> int:
        return int.from_bytes(key[:2], "little") or 1

    def _first(self, key: bytes) -> int:
        return int.from_bytes(key[2:10], "little") & self.mask

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, key: bytes) -> int:
        """The slot that holds the key, or -1; a fingerprint's hit is verified against the key."""
        mark, bucket = self._print(key), self._first(key)
        for at in (bucket, self._other(bucket, mark)):
            for slot in range(at * SLOTS, at * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.keys[slot][0] == key:
                    return slot
        return -1

    def get(self, key: bytes):
        slot = self._slot(key)
        return None if slot < 0 else self.keys[slot][1]

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            return False
        self.prints[slot], self.keys[slot] = 0, None
        self.live -= 1
        return True

    def insert(self, key: bytes, payload) -> None:
        """Adds a key that isn't there."""
        entry = (key, payload)
        if self.live >= len(self.prints) * 9 // 10:
            self._grow()
        while (entry := self._place(entry)) is not None:
            self._grow()

    def _place(self, entry):
        """None, or the entry that found no slot (then not in the table)."""
        mark = self._print(entry[0])
        bucket = self._first(entry[0])
        for kick in range(MAX_KICKS):
            for at in (bucket, self._other(bucket, mark)):
                base = at * SLOTS
                for slot in range(base, base + SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.keys[slot] = mark, entry
                        self.live += 1
                        return None
            bucket = self._other(bucket, mark)
            slot = bucket * SLOTS + (kick * 7 + mark) % SLOTS
            evicted = self.keys[slot]
            self.prints[slot], self.keys[slot] = mark, entry
            entry, mark = evicted, self._print(evicted[0])
            bucket = self._other(bucket, mark)
        return entry

    def _grow(self) -> None:
        stored = [k for k in self.keys if k is not None]
        buckets = (self.mask + 1) * 2
        while True:
            self._clear(buckets)
            if all(self._place(entry) is None for entry in stored):
                return
            buckets *= 2

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        return (k for k in self.keys if k is not None)


def _rank(doc_id, row) -> tuple:
    return (doc_id is not None, doc_id or 0, row)


def merge(index: CuckooIndex, key: bytes, doc_id, row: int, count: int) -> None:
    """Counts rows of one text in the index; the entry of the row that stays is the live one."""
    held = index.get(key)
    if held is None:
        index.insert(key, (doc_id, row, count))
        return
    best = max((held[0], held[1]), (doc_id, row), key=lambda x: _rank(*x))
    index.delete(key)
    index.insert(key, (*best, held[2] + count))


def retract(index: CuckooIndex, key: bytes, count: int = 1) -> bool:
    """Takes rows of a text back; its digest is deleted with its last row. False: it isn't live."""
    held = index.get(key)
    if held is None:
        return False
    index.delete(key)
    if held[2] > count:
        index.insert(key, (held[0], held[1], held[2] - count))
    return True


_MERGED = "text_sha256 binary, n_bytes long, keep_id long, keep_row long, group_size long"


def _flushed(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = list(index.items())
    for k in range(0, len(rows), 20_000):
        part = rows[k : k + 20_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[0][:32] for x in part], pa.binary()),
                pa.array([int.from_bytes(x[0][32:], "little") for x in part], pa.int64()),
                pa.array([x[1][0] for x in part], pa.int64()),
                pa.array([x[1][1] for x in part], pa.int64()),
                pa.array([x[1][2] for x in part], pa.int64()),
            ],
            names=["text_sha256", "n_bytes", "keep_id", "keep_row", "group_size"],
        )


def _merged(most: int | None = None):
    """Merges rows of equal texts; with ``most``, whenever so many texts are live they are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for sha, n_bytes, doc_id, row, count in zip(*columns, strict=True):
                merge(index, sha + n_bytes.to_bytes(8, "little"), doc_id, row, count)
                if most and index.live >= most:
                    yield from _flushed(index)
                    index = CuckooIndex()
        yield from _flushed(index)

    return run


def decide(docs: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    text = text_or_empty()
    digests = written(
        docs.select(
            F.unhex(F.sha2(text, 256)).alias("text_sha256"),
            F.octet_length(text).cast("long").alias("n_bytes"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    ones = digests.withColumn("count", F.lit(1).cast("long"))
    local = ones.mapInArrow(_merged(LOCAL_KEYS), _MERGED)
    total = digests.count()
    index = local.repartition(parts_for(spark, total, shard_keys), "text_sha256").mapInArrow(_merged(), _MERGED)
    groups = written(index, "index").select(F.col("text_sha256").alias("sha"), "keep_id", "keep_row", "group_size")
    return split_join(digests, "text_sha256", groups, "sha", "group_size", total).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
        "row",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns only.

    Rows go by doc_id and digest. A bit map of the dropped rows' digests, of bounded size, lets all
    rows pass that it doesn't hold; only the rest, the dropped rows and few others, are shuffled to be
    joined with them (all rows, if there are so many that the map is full). Only where rows repeat both (then the table of such twins isn't
    empty) a second scan puts one of them back.
    """
    verdict = written(decide(docs), "verdict")
    pairs = verdict.groupBy("doc_id", "text_sha256").agg(
        F.count(F.lit(1)).alias("rows"), F.bool_or("kept").alias("stays")
    )
    pairs = pairs.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_key"), "rows", "stays")
    gone = written(pairs.filter("rows > 1 or not stays"), "gone")
    sha, place, map_, no = (fresh(docs, x) for x in ("text_sha", "text_place", "text_map", "map_no"))
    bits = _bits(gone.count())
    maps = F.broadcast(_bitmap(gone, bits).toDF(no, map_))
    keyed = docs.withColumn(sha, F.sha2(text_or_empty(), 256)).withColumn(place, _place(F.col(sha), bits))
    keyed = keyed.join(maps, F.shiftright(F.col(place), 15) == F.col(no), "left").drop(no)
    unsure = F.coalesce(_bit(F.col(map_), F.col(place)), F.lit(False))

    def matched(keys: DataFrame, how: str) -> DataFrame:
        side = keyed.filter(unsure)
        return side.join(keys, side["doc_id"].cast("long").eqNullSafe(keys["_id"]) & (side[sha] == keys["_key"]), how)

    left = keyed.filter(~unsure).select(*docs.columns).unionByName(matched(gone, "left_anti").select(*docs.columns))
    twins = gone.filter("rows > 1 and stays")
    if twins.isEmpty():
        return left
    back = matched(twins, "left_semi").dropDuplicates(["doc_id", sha]).select(*docs.columns)
    return left.unionByName(back)


def _bits(keys: int) -> int:
    """A power of two of some 16 bits a key, between 32 KB and 16 MB: what the map may grow to."""
    return 1 << min(27, max(18, (16 * keys).bit_length()))


def _place(sha: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(bits)).cast("long")


def _bitmap(gone: DataFrame, bits: int) -> DataFrame:
    """(map_no, bitmap): the places of all keys, 32,768 bits a row, ``bits`` in all."""
    places = gone.select(_place(F.col("_key"), bits).alias("p"))
    return places.groupBy(F.shiftright("p", 15).alias("map_no")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("bitmap"))


def _bit(bitmap: Column, place: Column) -> Column:
    at = place.bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1
