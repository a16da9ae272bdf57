"""Vector compression by product codes: Lloyd's rounds over integer parts, with Hamerly's bounds.

Components are scaled and floored to integers, vectors cut into equal parts, and each part position has a
codebook that begins with the parts of the smallest vec_ids. A round assigns every part to the nearest
entry and moves each entry to the floored mean of its parts. All distances are whole numbers, so equal
ones are known to be equal and go to the lower index.

What is kept per part from round to round, in a written table: its entry, an upper bound of its distance
to it, and a lower bound of its distance to the second nearest. After entries have moved, the upper bound
grows by its entry's way, the lower one shrinks by the longest way of the others. A part whose upper bound
is strictly below the lower one, or below half the way from its entry to the next entry, stays where it
is without a look at other entries; if not, its own distance is taken first, and only if the bounds still
don't part, all entries are scanned. Bounds are rounded outwards, so they only ever err to a scan.

The driver holds the codebooks (parts x entries x components, whatever the input) and adds up one row per
entry. A task's sums are per entry too, so no entry, and no vector that repeats, is a hot key; totals by
label come back by a join that splits hot labels.

Defined results: rows whose vector is null, empty, or holds null or non-finite components are dropped, and
so are those of another length than the kept vector of the smallest vec_id. Components whose scaled value
is beyond ``limit_for(length)`` (2^28 for parts of 16) count as that bound, so that no distance leaves 64
bits. A length that isn't a multiple of the parts is filled up with zeros. Fewer kept rows than entries
give fewer entries. Equal vec_ids are ordered by vector; a null vec_id comes last and is coded like any
other. Repeated rows get equal codes, an empty table (or one without a kept row) gives an empty table.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import split_join, written
from listwright.sources.shared import removed

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Distances that one scan holds at once.
SCANNED = 1 << 21
#: Whole numbers below this are exact as doubles.
EXACT = 1 << 53


def limit_for(width: int) -> int:
    """The largest component of parts this wide whose squared distances surely fit 64 bits."""
    return int(2 ** np.floor(np.log2(np.sqrt(2.0**62 / max(width, 1)) / 2)))


class Bounds(NamedTuple):
    """Per part: its entry, an upper bound of the distance to it, a lower one of that to the second nearest."""

    entry: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def _up(x):
    return np.nextafter(x * (1 + 1e-12), np.inf)


def _down(x):
    return np.maximum(np.nextafter(x * (1 - 1e-12), -np.inf), 0.0)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, whole numbers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < EXACT:  # so that every sum below is exact
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        step = x[:, k, None] - entries[None, :, k]
        out += step * step
    return out


def scanned(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row, lower index on ties, its squared distance and the second nearest's."""
    best, first = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    second = np.full(len(x), np.iinfo(np.int64).max)
    step = max(1, SCANNED // len(entries))
    for k in range(0, len(x), step):
        d = squared(x[k : k + step], entries)
        rows = np.arange(len(d))
        at = np.argmin(d, axis=1)
        best[k : k + step], first[k : k + step] = at, d[rows, at]
        if len(entries) > 1:
            d[rows, at] = np.iinfo(np.int64).max
            second[k : k + step] = d.min(1)
    return best, first, second


def own_squared(x: np.ndarray, entries: np.ndarray, at: np.ndarray) -> np.ndarray:
    step = x - entries[at]
    return (step * step).sum(1)


class Moves(NamedTuple):
    """What a round's moves mean for bounds: each entry's way, the longest way of the others, half the way to the next entry."""

    own: np.ndarray
    others: np.ndarray
    half: np.ndarray


def moves(old: np.ndarray, new: np.ndarray) -> Moves:
    way = _up(np.sqrt(((new - old) ** 2).sum(1).astype(float)))
    top = int(np.argmax(way))
    others = np.full(len(way), way[top])
    others[top] = np.delete(way, top).max(initial=0.0)
    between = squared(new, new).astype(float)
    np.fill_diagonal(between, np.inf)
    return Moves(way, others, _down(np.sqrt(between.min(1)) / 2))


def reassigned(x: np.ndarray, entries: np.ndarray, held: Bounds | None, moved: Moves | None) -> tuple[Bounds, int]:
    """Each row's nearest entry with new bounds, and how many rows were scanned."""
    if held is None:
        at, first, second = scanned(x, entries)
        return Bounds(at, _up(np.sqrt(first.astype(float))), _down(np.sqrt(second.astype(float)))), len(x)
    at = held.entry.copy()
    upper = _up(held.upper + moved.own[at])
    lower = _down(held.lower - moved.others[at])
    clear = np.maximum(lower, moved.half[at])
    open_ = np.flatnonzero(~(upper < clear))
    upper[open_] = _up(np.sqrt(own_squared(x[open_], entries, at[open_]).astype(float)))
    open_ = open_[~(upper[open_] < clear[open_])]
    if len(open_):
        best, first, second = scanned(x[open_], entries)
        at[open_], upper[open_], lower[open_] = best, _up(np.sqrt(first.astype(float))), _down(np.sqrt(second.astype(float)))
    return Bounds(at, upper, lower), len(open_)


class Shape(NamedTuple):
    """Parts, components of a part, and the bytes that one component takes in the kept table."""

    parts: int
    width: int
    size: int

    @property
    def kind(self) -> str:
        return f"<i{self.size}"


def usable(vector: str, scale: int = SCALE) -> Column:
    """The scaled and floored components as doubles; null for a vector that isn't kept."""
    fine = F.forall(F.col(vector), lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.when((F.size(vector) > 0) & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double")))


def kept_rows(vectors: DataFrame, id_: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    return vectors.select(F.col(id_).cast("long").alias("vec_id"), F.col(label).alias("label"), usable(vector, scale).alias("x")).filter("x is not null")


def _whole(batch: pa.RecordBatch, shape: Shape) -> np.ndarray:
    """rows x parts x width of a batch's scaled components, filled up and kept within the limit."""
    x = batch.column(batch.schema.get_field_index("x"))
    flat = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
    out = np.zeros((len(x), shape.parts * shape.width), np.int64)
    limit = limit_for(shape.width)
    out[:, : flat.shape[1]] = np.clip(flat, -limit, limit)
    return out.reshape(-1, shape.parts, shape.width)


def _from_kept(batch: pa.RecordBatch, shape: Shape) -> np.ndarray:
    raw = b"".join(batch.column(batch.schema.get_field_index("parts")).to_pylist())
    return np.frombuffer(raw, shape.kind).astype(np.int64).reshape(-1, shape.parts, shape.width)


def _kept_bounds(batch: pa.RecordBatch, shape: Shape) -> list[Bounds]:
    of = lambda name, kind: np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(name)).to_pylist()), kind).reshape(-1, shape.parts)
    entry, upper, lower = of("code", "<u2").astype(np.int64), of("upper", "<f8"), of("lower", "<f8")
    return [Bounds(entry[:, p], upper[:, p], lower[:, p]) for p in range(shape.parts)]


def _rows(values: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def _assigned(shape: Shape, books: np.ndarray, moved: list[Moves] | None):
    """One round over all rows: parts, entries and bounds as the next round's table holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _whole(batch, shape) if moved is None else _from_kept(batch, shape)
            held = [None] * shape.parts if moved is None else _kept_bounds(batch, shape)
            new, scans = [], 0
            for p in range(shape.parts):
                found, n = reassigned(x[:, p], books[p], held[p], None if moved is None else moved[p])
                new.append(found)
                scans += n
            stack = [np.stack([getattr(b, f) for b in new], axis=1).astype(k) for f, k in (("entry", "<u2"), ("upper", "<f8"), ("lower", "<f8"))]
            counts = np.zeros(len(x), np.int32)
            counts[:1] = scans
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _rows(x.astype(shape.kind)), *[_rows(s) for s in stack], pa.array(counts)],
                names=["vec_id", "label", "parts", "code", "upper", "lower", "scans"],
            )

    return run


def _summed(shape: Shape, entries: int):
    """A task's sums by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(shape.parts * entries, np.int64)
        sums = np.zeros((shape.parts * entries, shape.width), np.int64)
        for batch in batches:
            x, held = _from_kept(batch, shape), _kept_bounds(batch, shape)
            for p in range(shape.parts):
                slot = held[p].entry + p * entries
                n += np.bincount(slot, minlength=len(n))
                np.add.at(sums, slot, x[:, p])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))], names=["slot", "n", "sums"])

    return run


def _moved_books(state: DataFrame, shape: Shape, books: np.ndarray) -> np.ndarray:
    entries = books.shape[1]
    tasks = state.select("parts", "code", "upper", "lower").mapInArrow(_summed(shape, entries), "slot long, n long, sums array<long>")
    # Sums of hundreds of billions of components at the limit could leave 64 bits: decimals don't.
    totals = [F.sum(F.get("sums", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(shape.width)]
    new = books.copy()
    for r in tasks.groupBy("slot").agg(F.sum("n").alias("n"), *totals).collect():  # one row per entry
        p, e = divmod(r["slot"], entries)
        new[p, e] = [int(r[f"s{k}"]) // r["n"] for k in range(shape.width)]
    return new


def _final(shape: Shape, books: np.ndarray):
    """Codes in hex and the squared distance to them, from the last round's table."""
    digits = max(2, -(-(books.shape[1] - 1).bit_length() // 4)) if books.shape[1] else 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, held = _from_kept(batch, shape), _kept_bounds(batch, shape)
            error = sum(own_squared(x[:, p], books[p], held[p].entry) for p in range(shape.parts))
            codes = ["".join(f"{e:0{digits}x}" for e in row) for row in np.stack([h.entry for h in held], axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


class Coded(NamedTuple):
    """(vec_id, label, code, error) of the kept rows, the codebooks, and the parts scanned in each round."""

    rows: DataFrame
    books: np.ndarray
    scans: list[int]


def encode(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Coded:
    if not 1 <= entries <= 1 << 16:
        raise ValueError("a codebook has 1 to 65536 entries")
    spark = vectors.sparkSession
    rows = kept_rows(vectors, id_, vector, label, scale)
    order = (F.col("vec_id").asc_nulls_last(), "x")
    first = rows.select("vec_id", "x").orderBy(*order).limit(1).collect()
    label_type = rows.schema["label"].dataType.simpleString()
    if not first:
        empty = spark.createDataFrame([], f"vec_id long, label {label_type}, code string, error long")
        return Coded(empty, np.zeros((parts, 0, 0), np.int64), [])
    length = len(first[0]["x"])
    width = -(-length // parts)
    rows = rows.filter(F.size("x") == length)
    seeds = rows.select("vec_id", "x").orderBy(*order).limit(entries).select("x").toArrow()  # ``entries`` vectors
    largest = rows.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()[0]
    shape = Shape(parts, width, 2 if largest < (1 << 15) - 1 else 4)
    books = np.ascontiguousarray(np.concatenate([_whole(b, shape) for b in seeds.to_batches()]).transpose(1, 0, 2))
    schema = f"vec_id long, label {label_type}, parts binary, code binary, upper binary, lower binary, scans int"
    state, moved, scans = None, None, []
    for k in range(rounds + 1):
        source = rows if state is None else state
        found = written(source.mapInArrow(_assigned(shape, books, moved), schema), f"codes-{k}")
        if state is not None:
            removed(state)
        state = found
        scans.append(state.agg(F.sum("scans")).first()[0] or 0)
        if k < rounds:
            new = _moved_books(state, shape, books)
            moved = [moves(books[p], new[p]) for p in range(parts)]
            books = new
    return Coded(state.select("vec_id", "label", "parts", "code", "upper", "lower").mapInArrow(_final(shape, books), f"vec_id long, label {label_type}, code string, error long"), books, scans)


def books_sha256(books: np.ndarray) -> str:
    """Of all components in decimal by part, entry and place, parted by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decode(code: str, books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for; a component is the middle of what floors to the entry's."""
    digits = len(code) // books.shape[0]
    return np.concatenate([(books[p, int(code[p * digits : (p + 1) * digits], 16)] + 0.5) / scale for p in range(books.shape[0])])


def report(vectors: DataFrame, **options) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    coded = encode(vectors, **options)
    key = F.when(F.col("label").isNull(), F.lit("n")).otherwise(F.concat(F.lit("l"), F.col("label").cast("string")))
    rows = written(coded.rows.select("vec_id", "code", "error", key.alias("label_key")), "codes")
    totals = rows.groupBy(F.col("label_key").alias("key_")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows_"))
    joined = split_join(rows, "label_key", written(totals, "label-errors"), "key_", "rows_", rows.count())
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(coded.books)).alias("codebooks_sha256"))
