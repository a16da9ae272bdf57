"""Listings that may be one property although their districts differ: by place and size, by photo, by text.

Each join blocks on what two links must share, so no theta join is planned, and no link is lost: a cell of
the radius and its neighbours, one of the parts of a code that must be nearly equal, one of the rare tokens
that two similar sets can't both lack. Rows alike in all that is compared are one class before any join, and
pairs of classes are added up where they are found, so what comes out is a row per listing: how many others
it links to, and the nearest. Rows with a null in what is compared link to nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from pyspark.sql.window import Window

from listwright.functions.geo import KM_DEGREE, LON_SCALE
from listwright.sources.shared import once, written

# Candidates lie within the radius, their sizes within the share, their texts share so much.
RADIUS_KM, AREA_SHARE, TEXT_SHARE = 3.0, 0.15, 0.8


def _both_ways(pairs: DataFrame, measure: str) -> DataFrame:
    """(class_, links, nearest): pairs of classes (a, n_a, b, n_b, measure), each seen from both ends."""
    one = lambda x, y: F.struct(F.col(x).alias("class_"), F.col(f"n_{y}").alias("n"), F.struct(F.col(measure).alias("m"), F.col(y).alias("other")).alias("near"))
    ends = pairs.select(F.explode(F.array(one("a", "b"), one("b", "a"))).alias("e")).select("e.*")
    return ends.groupBy("class_").agg(F.sum("n").alias("links"), F.min("near").alias("nearest"))


def _for_rows(rows: DataFrame, on: Sequence[str], key: str, classes: DataFrame, found: DataFrame, zero: Column, again: str | None = None, first: str = "id_") -> DataFrame:
    """Each row with its class, its links (of its own class too) and the nearest other row, the smaller key on ties.

    Where ``again`` is filled, a class' rows share one key and don't link to each other; ``first`` names the class.
    """
    apart = F.col(again).isNotNull() if again else F.lit(False)
    named = classes.join(found, classes["id_"] == found["class_"], "left").select(
        *[F.col(c).alias(f"{c}_k") for c in on], "id_", F.col(first).alias("class_id"), (F.when(apart, 0).otherwise(F.col("n_") - 1) + F.coalesce("links", F.lit(0))).alias("n_links"), "second_", "nearest"
    )
    joined = rows.join(written(named, "link-classes"), [F.col(c).eqNullSafe(F.col(f"{c}_k")) for c in on])
    own = F.when(~apart, F.when(F.col(key) != F.col("id_"), F.col("id_")).otherwise(F.col("second_")))
    near = F.array_min(F.array(F.when(own.isNotNull(), F.struct(zero.alias("m"), own.alias("other"))), F.col("nearest")))
    return joined.select(key, "class_id", "n_links", near["other"].alias("nearest"), near["m"].alias("nearest_at"))


def _classes(rows: DataFrame, on: Sequence[str], key: str, *more: Column) -> DataFrame:
    """Rows alike in ``on`` as one: the smallest key, the smallest after it, and how many there are."""
    least = F.min(key).alias("id_")
    first = written(rows.groupBy(*on).agg(least, F.count(F.lit(1)).alias("n_"), *more), "classes")
    several = first.filter("n_ > 1").select(*[F.col(c).alias(f"{c}_k") for c in on], F.col("id_").alias("least_"))
    others = rows.join(several, [F.col(c).eqNullSafe(F.col(f"{c}_k")) for c in on]).filter(F.col(key) != F.col("least_"))
    second = others.groupBy("least_").agg(F.min(key).alias("second_"))
    return first.join(second, first["id_"] == second["least_"], "left").drop("least_")


#: So many pairs of classes, or of places, are compared at once in a task.
BLOCK_PAIRS = 2_000_000
#: Classes around a cell are counted in a table of places by sizes if it has so many fields at most, and so many a class.
TABLE, TABLE_SHARE = 4_000_000, 64
#: So many of the nearest places are looked through before a class is compared with all others.
FIRST_PLACES = 64
#: Classes of one place travel as lists of so many.
LISTED = 512


def _around(km: float, share: float):
    """Per class of a cell's own: links and the nearest of all classes in the cell and around it.

    Places and sizes that recur are counted as tables: the places within the radius times the counts of a place's
    sizes times the sizes within the share are the links of all classes at once. Other cells' classes are compared
    one by one, in blocks of sizes within the share. Rows of one key (``again_``) are no links of each other.
    """
    import numpy as np
    import pyarrow as pa

    most = np.iinfo(np.int64).max
    fits = lambda x, y: np.abs(x - y) <= share * np.maximum(x, y)

    def apart(y, x):
        return np.sqrt(y * y + x * LON_SCALE * x * LON_SCALE) * KM_DEGREE

    # Equal distances differ by the last digits of their points: they count to the micrometre.
    digits = lambda far: np.floor(far * 1e9 + 0.5)

    def compared(own, ids, n, again, lat, lon, area):
        links, far, other, i = np.zeros(len(own), np.int64), np.full(len(own), np.inf), np.full(len(own), most), 0
        while i < len(own):
            # Sizes within the share of the block's first and last, a hair wider: the exact test follows.
            first = np.searchsorted(area, area[own[i]] * (1 - share) * (1 - 1e-9))
            reach = lambda k: np.searchsorted(area, area[own[k]] / (1 - share) * (1 + 1e-9), "right") - first
            j = min(len(own), i + max(1, BLOCK_PAIRS // reach(i)))
            while j - i > 1 and (j - i) * reach(j - 1) > 2 * BLOCK_PAIRS:
                j = i + (j - i) // 2
            a, b = own[i:j, None], np.arange(first, first + reach(j - 1))[None]
            between = apart(lat[a] - lat[b], lon[a] - lon[b])
            linked = (between <= km) & fits(area[a], area[b]) & (a != b) & ~(again[a] & again[b] & (ids[a] == ids[b]))
            at = np.where(linked, digits(between), np.inf)
            links[i:j], far[i:j] = np.where(linked, n[b], 0).sum(axis=1), at.min(axis=1)
            other[i:j] = np.where(linked & (at == far[i:j, None]), ids[b], most).min(axis=1)
            i = j
        return links, far, other

    def counted(own, ids, n, again, at, sizes, places, ys, xs):
        """The same by tables, of classes that aren't ``again``; and which of them must be compared."""
        size = np.unique(sizes)
        of = np.searchsorted(size, sizes)
        field, whole = at * len(size) + of, places * len(size)
        table = np.bincount(field, weights=n, minlength=whole).reshape(places, -1)
        within = fits(size[:, None], size[None])
        least, twice = np.full(whole, most), np.full(whole, most)
        np.minimum.at(least, field, ids)
        np.minimum.at(twice, field[again], ids[again])
        least, twice = least.reshape(places, -1), twice.reshape(places, -1)
        others = np.stack([least[:, within[:, k] & (np.arange(len(size)) != k)].min(axis=1, initial=most) for k in range(len(size))], axis=1)
        any_ = np.minimum(least, others)
        links, far, other, left = np.zeros(len(own), np.int64), np.full(len(own), np.inf), np.full(len(own), most), np.zeros(len(own), bool)
        order = np.argsort(at[own], kind="stable")
        here, starts = np.unique(at[own][order], return_index=True)
        starts = np.r_[starts, len(own)]
        step, nearby = max(1, BLOCK_PAIRS // places), min(FIRST_PLACES, places)
        for lo in range(0, len(here), step):
            block = here[lo : lo + step]
            mine = order[starts[lo] : starts[min(lo + step, len(here))]]
            row, k = np.searchsorted(block, at[own[mine]]), of[own[mine]]
            between = apart(ys[block, None] - ys[None], xs[block, None] - xs[None])
            inside = between <= km
            links[mine] = ((inside.astype(float) @ table) @ within)[row, k] - n[own[mine]]
            steps = np.where(inside, digits(between), np.inf)
            steps[np.arange(len(block)), block] = -1  # its own place comes first
            near = np.argpartition(steps, nearby - 1, axis=1)[:, :nearby]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(steps, near, axis=1), axis=1), axis=1)
            distance = np.take_along_axis(steps, near, axis=1)
            best = np.minimum(others[block[row], k], twice[block[row], k])
            reached = np.where(best < most, 0.0, np.inf)
            going = np.flatnonzero(links[mine] > 0)
            for i in range(1, nearby):
                going = going[distance[row[going], i] <= reached[going]]
                going = going[distance[row[going], i] < np.inf]
                if not len(going):
                    break
                found, to = any_[near[row[going], i], k[going]], distance[row[going], i]
                hit = found < most
                best[going[hit]] = np.minimum(best[going[hit]], found[hit])
                reached[going[hit]] = to[hit]
            far[mine], other[mine] = reached, best
            if nearby < places:  # as far as the last one looked at, there may be more
                left[mine[going]] = True
        return links, far, other, left

    def run(rows):
        lists, numbers = rows["listed_"].combine_chunks(), {}
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        values = lists.flatten()
        for c in ("area_", "id_", "n_", "again_"):
            numbers[c] = values.field(c).to_numpy(zero_copy_only=False)
        order = np.argsort(numbers["area_"], kind="stable")
        area, ids, n, again = (numbers[c][order] for c in ("area_", "id_", "n_", "again_"))
        owner = owner[order]
        lat, lon = (rows[c].to_numpy() for c in ("lat_", "lon_"))
        own = np.flatnonzero(rows["own_"].to_numpy()[owner])
        links, far, other, left = np.zeros(len(own), np.int64), np.full(len(own), np.inf), np.full(len(own), most), np.ones(len(own), bool)
        if len(own):
            points, at = np.unique(np.stack([lat, lon], axis=1), axis=0, return_inverse=True)
            fields, sizes = len(points) * len(np.unique(area)), len(np.unique(area))
            if fields <= min(TABLE, TABLE_SHARE * len(ids)) and sizes * sizes <= TABLE:
                plain = np.flatnonzero(~again[own])
                links[plain], far[plain], other[plain], left[plain] = counted(own[plain], ids, n, again, at.ravel()[owner], area, len(points), points[:, 0], points[:, 1])
            if left.any():
                links[left], far[left], other[left] = compared(own[left], ids, n, again, lat[owner], lon[owner], area)
        # Rows of one key count together: each brings its class' links.
        links = np.where(again[own], links * n[own], links)
        some = links > 0
        return pa.table({"class_": ids[own[some]], "links": links[some], "m": far[some] / 1e9, "other": other[some]})

    return run


def radius_links(df: DataFrame, keys: Sequence[str], key: str = "ord", lat: str = "lat", lon: str = "lon", area: str = "area_m2", km: float = RADIUS_KM, share: float = AREA_SHARE) -> DataFrame:
    """(key, class_id, n_links, nearest, nearest_at): rows alike in ``keys``, within the radius, sizes within the share; the key is a long.

    A place's classes are in one cell of the radius' size and sent to the eight around it, so a cell's own classes
    meet all that they link to in one place. Pairs are added up there and are never rows: what leaves a cell is a
    row a class. Rows that share a key are one end of links, which has the links of all of them.
    """
    on = [*keys, lat, lon, area]
    rows = written(df.select(key, *on).dropna().filter(F.col(area) > 0), "link-rows")
    again = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(key).alias("again_")), "keys-again")
    some = bool(again.head(1))
    rows = rows.join(again, F.col(key) == F.col("again_"), "left")
    dy, dx = (km * (1 + 1e-9) / degree for degree in (KM_DEGREE, KM_DEGREE * LON_SCALE))
    at = lambda v, step: F.floor(v / step).cast("long")
    classes = written(_classes(rows, [*on, "again_"], key), "places")
    offsets = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in product((-1, 0, 1), repeat=2)])
    kinds = [f"k{i}_" for i in range(len(keys))]
    cell = [*kinds, "cy_", "cx_"]
    values = classes.select(
        *[F.col(k).alias(n) for k, n in zip(keys, kinds, strict=True)], *[F.col(c).cast("double").alias(n) for c, n in ((lat, "lat_"), (lon, "lon_"))],
        F.struct(F.col(area).cast("double").alias("area_"), F.col("id_"), F.col("n_"), F.col("again_").isNotNull().alias("again_")).alias("v_"),
    )
    point = [*kinds, "lat_", "lon_"]
    dealt = values.withColumn("part_", F.floor((F.row_number().over(Window.partitionBy(*point).orderBy("v_.area_")) - 1) / LISTED))
    lists = dealt.groupBy(*point, "part_").agg(F.collect_list("v_").alias("listed_"))
    sent = lists.select("*", F.explode(offsets).alias("o")).select(
        *kinds, "lat_", "lon_", "listed_", (at(F.col("lat_"), dy) + F.col("o.y")).alias("cy_"), (at(F.col("lon_"), dx) + F.col("o.x")).alias("cx_"), ((F.col("o.y") == 0) & (F.col("o.x") == 0)).alias("own_")
    )
    near = sent.groupBy(*cell).applyInArrow(_around(km, share), "class_ long, links long, m double, other long")
    found = near.select("class_", "links", F.struct("m", "other").alias("nearest"))
    if not some:
        return _for_rows(rows, on, key, classes, found, F.lit(0.0))
    found = found.groupBy("class_").agg(F.sum("links").alias("links"), F.min("nearest").alias("nearest"))
    least = F.min("id_").over(Window.partitionBy(*on))
    return _for_rows(rows, [*on, "again_"], key, classes.withColumn("first_", least), found, F.lit(0.0), again="again_", first="first_")


def near_masks(width: int, most: int) -> list[int]:
    """All numbers of so many bits of which at most ``most`` are set."""
    return [sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(width), n)]


def code_links(df: DataFrame, key: str, code: str, bits: int = 64, parts: int = 4, most: int = 7) -> DataFrame:
    """(key, class_id, n_links, nearest, nearest_at): rows whose codes differ in at most ``most`` bits.

    Of codes that near one of the parts differs in at most ``most / parts`` bits: a code is listed under the
    value of each part, and looks up all values that near to its own.
    """
    width = bits // parts
    rows = df.select(key, code).dropna()
    classes = written(_classes(rows, [code], key), "codes")
    part = lambda i: F.shiftrightunsigned(code, i * width).bitwiseAND((1 << width) - 1)
    listed = F.array(*[F.struct(F.lit(i).alias("i"), part(i).alias("v")) for i in range(parts)])
    masks = F.array(*[F.lit(m).cast("long") for m in near_masks(width, most // parts)])
    looked = F.flatten(F.transform(listed, lambda p: F.transform(masks, lambda m: F.struct(p["i"].alias("i"), p["v"].bitwiseXOR(m).alias("v")))))
    a = classes.select(F.col("id_").alias("a"), F.col("n_").alias("n_a"), F.col(code).alias("code_a"), F.explode(looked).alias("p"))
    b = classes.select(F.col("id_").alias("b"), F.col("n_").alias("n_b"), F.col(code).alias("code_b"), F.explode(listed).alias("q"))
    far = F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b")))
    pairs = a.join(b, (F.col("p.i") == F.col("q.i")) & (F.col("p.v") == F.col("q.v")) & (F.col("a") < F.col("b")) & (far <= most)).select("a", "n_a", "b", "n_b", far.alias("bits")).distinct()
    return _for_rows(rows, [code], key, classes, _both_ways(pairs, "bits"), F.lit(0))


def sign_code(vector: Column, bits: int = 64) -> Column:
    """A vector's code: bit i is set if component i is positive."""
    sign = F.transform(F.slice(vector, 1, bits), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(sign, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


#: Rows of a chunk by number (a power of two), and tokens that one task counts.
CHUNK_BITS, COUNTED = 10, 1 << 22
#: Counts fall into so many bins to a doubling; a token's place in the order is its bin, its part and its print.
COUNT_BINS, PART_SHIFT, BIN_SHIFT = 8, 32, 48


def _dealt(parts: int):
    """Each chunk's tokens by the part that counts them: their prints, the lower 32 bits, and whose they are."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows, sets = batch.column(0).to_numpy(), batch.column(1)
            tokens = sets.flatten().to_numpy().view(np.uint64)
            owner = np.repeat(rows, sets.value_lengths().to_numpy())
            part = ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((part, owner >> CHUNK_BITS))
            part, owner, prints = part[order], owner[order], tokens[order].astype("<u4")
            chunk, local = owner >> CHUNK_BITS, (owner & ((1 << CHUNK_BITS) - 1)).astype("<u2")
            cuts = np.r_[0, np.flatnonzero((np.diff(part) != 0) | (np.diff(chunk) != 0)) + 1, len(part)] if len(part) else np.zeros(1, int)
            runs = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[cuts[:-1]].astype(np.int32)), pa.array(chunk[cuts[:-1]]),
                    pa.array([local[a:b].tobytes() for a, b in runs], pa.binary()), pa.array([prints[a:b].tobytes() for a, b in runs], pa.binary()),
                ],
                names=["part", "chunk", "locals", "prints"],
            )

    return run


def _repeated(rows):
    """A part's tokens that several rows have, each with its count's bin; those of one row link to nothing."""
    import numpy as np
    import pyarrow as pa

    each = [np.frombuffer(x.as_buffer(), "<u4") for x in rows["prints"]]
    _, places, n = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    bins = np.minimum(np.floor(np.log2(n) * COUNT_BINS + 1e-9), 255).astype(np.uint8)[places]
    out, at = [], 0
    for part, chunk, local, prints in zip(rows["part"].to_pylist(), rows["chunk"].to_pylist(), rows["locals"], each, strict=True):
        own = bins[at : at + len(prints)]
        at += len(prints)
        kept = np.flatnonzero(own)
        if len(kept):
            out.append((part, chunk, np.frombuffer(local.as_buffer(), "<u2")[kept].tobytes(), prints[kept].tobytes(), own[kept].tobytes()))
    kinds = {"part": pa.int32(), "chunk": pa.int64(), "locals": pa.binary(), "prints": pa.binary(), "bins": pa.binary()}
    return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(kinds.items())})


def _prefixed(least: float):
    """A chunk's rows with ``prefix_``: of each set's rarest tokens the repeated ones; ``last_``: the last one's place.

    ``alone_`` tokens, which no other row has, come before them.
    """
    import numpy as np
    import pyarrow as pa

    def run(rows, repeated):
        number = rows["row_"].to_numpy() & ((1 << CHUNK_BITS) - 1)
        sizes = rows["size_"].to_numpy().astype(np.int64)
        of = np.full(1 << CHUNK_BITS, -1)
        of[number] = np.arange(len(number))
        owners, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for part, local, prints, bins in zip(repeated["part"].to_pylist(), repeated["locals"], repeated["prints"], repeated["bins"], strict=True):
            owners.append(of[np.frombuffer(local.as_buffer(), "<u2")])
            places.append((np.frombuffer(bins.as_buffer(), np.uint8).astype(np.int64) << BIN_SHIFT) | (part << PART_SHIFT) | np.frombuffer(prints.as_buffer(), "<u4"))
        owner, place = np.concatenate(owners), np.concatenate(places)
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        n = np.bincount(owner, minlength=len(sizes))
        # Tokens of this row alone come first in the order; what is left of the prefix are repeated ones.
        lacks = sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1
        left = np.maximum(lacks - (sizes - n), 0)
        last = np.full(len(sizes), -1)
        some = np.flatnonzero(left)
        last[some] = place[(np.cumsum(n) - n)[some] + left[some] - 1]
        kept = place <= last[owner]
        offsets = np.r_[0, np.cumsum(np.bincount(owner[kept], minlength=len(sizes)))].astype(np.int32)
        columns = {"alone_": pa.array(sizes - n), "last_": pa.array(last)}
        for name, values in columns.items():
            rows = rows.append_column(name, values)
        return rows.append_column("prefix_", pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[kept])))

    return run


def _prefixes(sets: DataFrame, least: float) -> DataFrame:
    """``sets`` without its sets, with the prefix of each and its last place in the order of all tokens.

    Tokens are ordered by how many rows have them, in bins, and by hash. They are counted by their prints, in parts
    of the hashes; what comes back to a chunk are the repeated ones. A print that two tokens of a part share
    only brings more candidates, as does a count that copies raise.
    """
    total = sets.agg(F.sum("size_")).first()[0] or 0
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // COUNTED))
    assert parts < 1 << (BIN_SHIFT - PART_SHIFT)
    dealt = sets.select("row_", "set_").mapInArrow(_dealt(parts), "part int, chunk long, locals binary, prints binary")
    repeated = dealt.repartition(parts, "part").groupBy("part").applyInArrow(_repeated, "part int, chunk long, locals binary, prints binary, bins binary")
    rows = sets.drop("set_")
    schema = StructType([*rows.schema.fields, StructField("alone_", LongType()), StructField("last_", LongType()), StructField("prefix_", ArrayType(LongType()))])
    chunk = F.shiftright("row_", CHUNK_BITS).alias("chunk_")
    return rows.groupBy(chunk).cogroup(repeated.groupBy(F.col("chunk").alias("chunk_"))).applyInArrow(_prefixed(least), schema)


def _candidates(classes: DataFrame, least: float) -> DataFrame:
    """(a, b): classes whose prefixes share as many tokens as two sets of the similarity must.

    What the prefix that ends first shares with the other set is all in both prefixes. So no more can be
    shared than that and the rest of its set, or what either set has behind the last token they share there.
    """
    listed = classes.filter("last_ >= 0").select("at_", "size_", "last_", "alone_", F.posexplode("prefix_").alias("i", "token")).withColumn("left_", F.col("size_") - F.col("alone_") - F.col("i") - 1)
    a, b = (listed.select(F.col("at_").alias(s), *[F.col(c).alias(f"{c}{s}") for c in ("size_", "last_", "left_", "token")]) for s in "ab")
    fits = (F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b") - 1e-9) & (F.col("a") < F.col("b"))
    shared = a.join(b, (F.col("tokena") == F.col("tokenb")) & fits).groupBy("a", "size_a", "last_a", "b", "size_b", "last_b")
    shared = shared.agg(F.count(F.lit(1)).alias("c"), F.min("left_a").alias("left_a"), F.min("left_b").alias("left_b"))
    rest_a, rest_b = (F.ceil(least * F.col(f"size_{s}") - 1e-9) - 1 for s in "ab")
    rest = F.when(F.col("last_a") < F.col("last_b"), rest_a).when(F.col("last_a") > F.col("last_b"), rest_b).otherwise(F.greatest(rest_a, rest_b))
    return shared.filter(F.col("c") + F.least(rest, "left_a", "left_b") >= least / (1 + least) * (F.col("size_a") + F.col("size_b")) - 1e-3).select("a", "b")


#: Sets that link to one set are compared in squares of so many by so many.
TILE = 512


def _overlaps(pairs, members):
    """How alike a square's pairs are; each of its sets came once."""
    import numpy as np
    import pyarrow as pa

    sets = members["set_"].combine_chunks()
    ids, lengths = members["row_"].to_numpy(), sets.value_lengths().to_numpy()
    _, tokens = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    ends = np.cumsum(lengths)
    each = [tokens[e - n : e] for e, n in zip(ends, lengths, strict=True)]
    by_id = np.argsort(ids)
    at = lambda c: by_id[np.searchsorted(ids[by_id], pairs[c].to_numpy())]
    order = np.argsort(at("a"), kind="stable")
    a, b = at("a")[order], at("b")[order]
    shared, has = np.zeros(len(a), np.int64), np.zeros(len(tokens), bool)
    cuts = np.r_[0, np.flatnonzero(np.diff(a)) + 1, len(a)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        has[each[a[lo]]] = True
        starts = np.cumsum(lengths[b[lo:hi]]) - lengths[b[lo:hi]]
        shared[lo:hi] = np.add.reduceat(has[np.concatenate([each[k] for k in b[lo:hi]])], starts, dtype=np.int64)
        has[each[a[lo]]] = False
    return pa.table({"a": pa.array(ids[a]), "b": pa.array(ids[b]), "alike": pa.array(shared / (lengths[a] + lengths[b] - shared))})


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, alike): the pairs with their similarity.

    Of many copies most have the same first neighbour: those are numbered together, so that a square of pairs
    needs each of its sets once and no pair brings sets of its own.
    """
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("row_"), F.col("b").alias("other_")), F.struct(F.col("b").alias("row_"), F.col("a").alias("other_")))).alias("e")).select("e.*")
    first = ends.groupBy("row_").agg(F.least(F.first("row_"), F.min("other_")).alias("first_"))
    number = F.floor((F.row_number().over(Window.partitionBy("first_").orderBy("row_")) - 1) / TILE)
    wanted = written(first.select("row_", F.struct("first_", number.alias("no_")).alias("block_")), "wanted")
    held = written(sets.select("row_", "set_").join(wanted.select("row_"), "row_"), "wanted-sets")
    block = lambda s: wanted.select(F.col("row_").alias(s), F.col("block_").alias(f"block_{s}"))
    square = F.xxhash64(F.least("block_a", "block_b"), F.greatest("block_a", "block_b")).alias("square_")
    dealt = written(pairs.join(block("a"), "a").join(block("b"), "b").select(square, "a", "b"), "squares")
    members = dealt.select(F.col("square_").alias("in_"), F.explode(F.array("a", "b")).alias("row_")).distinct().join(held, "row_")
    return dealt.groupBy("square_").cogroup(members.groupBy("in_")).applyInArrow(_overlaps, "a long, b long, alike double")


def set_links(df: DataFrame, key: str, tokens: str, least: float = TEXT_SHARE) -> DataFrame:
    """(key, class_id, n_links, nearest, nearest_at): rows whose sets of tokens have the Jaccard similarity; nearest_at is 1 less it.

    Sets so similar share one of their rarest tokens: as many as a set may lack of the other, and one more.
    Sets are written once and stay there: what is shuffled are short prints of tokens to be counted, those that
    several rows have, digests, and the whole sets of classes that are compared at last, in squares.
    """
    hashed = F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t))))
    kept = once(df.select(key, tokens), {"set_": hashed}).filter("size(set_) > 0")
    numbered = kept.select(key, F.monotonically_increasing_id().alias("row_"), F.unhex(F.sha2(F.array_join("set_", ","), 256)).alias("digest_"), F.size("set_").alias("size_"), "set_")
    sets = written(numbered, "token-sets")
    rows = written(_prefixes(sets, least), "prefixes")
    classes = written(_classes(rows, ["digest_"], key, F.min("row_").alias("at_"), *[F.any_value(c).alias(c) for c in ("size_", "alone_", "last_", "prefix_")]), "set-classes")
    pairs = written(_candidates(classes, least), "set-pairs")
    linked = _compared(pairs, sets).filter(F.col("alike") >= least - 1e-9)
    named = lambda s: classes.select(F.col("at_").alias(f"at_{s}"), F.col("id_").alias(f"id_{s}"), F.col("n_").alias(f"n_{s}"))
    ends = linked.join(named("a"), F.col("a") == F.col("at_a")).join(named("b"), F.col("b") == F.col("at_b"))
    found = _both_ways(ends.select(F.col("id_a").alias("a"), "n_a", F.col("id_b").alias("b"), "n_b", (1 - F.col("alike")).alias("apart")), "apart")
    return _for_rows(rows, ["digest_"], key, classes, found, F.lit(0.0))


def shingles(text: Column, size: int = 3) -> Column:
    """The runs of so many words of a text; of fewer words, all of them."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def runs(ws: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, size), " "))
        return F.when(F.size(ws) > 0, each)

    # Bound to a lambda's variable, so that a text is split once and not for each run.
    return F.get(F.transform(F.array(words), runs), F.lit(0))
