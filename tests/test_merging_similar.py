"""Constrained merging in rounds, and the similarity joins, against brute force."""

import math
import random
from collections import Counter

import pytest
from listwright.operators import grouping, merging, similar
from pyspark.sql import functions as F


def by_one(spark, n, m, sites, tail, chain=False, seed=1):
    """Roots by rounds and by taking pairs one by one."""
    rng = random.Random(seed)
    trait = lambda: rng.choice("xy") if rng.random() < 0.1 else None
    member = {i: (f"s{rng.randrange(sites)}", tuple(trait() for _ in range(4)), 100_000 * (1 + rng.random() * 0.02), 100 * (1 + rng.random() * 0.02)) for i in range(n)}
    pairs = [(i, i + 1) for i in range(n - 1)] if chain else [tuple(rng.sample(range(n), 2)) for _ in range(m)]
    pairs += [(0, 0), pairs[0]]  # itself, and one pair twice
    schema = "node long, sites array<string>, area string, kind string, floor_key string, bedrooms_key string, price_low double, price_high double, size_low double, size_high double"
    members = spark.createDataFrame([(i, [s], *t, p, p, a, a) for i, (s, t, p, a) in member.items()], schema)
    edges = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "o long, a long, b long")
    got = {r.node: r.root for r in merging.merged(members, edges, [F.col("o")], grouping.TRAITS, grouping.BANDS, tail).collect()}
    expected = grouping.merge_component(pairs, member)
    return {i: got.get(i, i) for i in member}, expected


@pytest.mark.parametrize("tail", [0, 5, 4096])
def test_rounds_give_what_pairs_one_by_one_give(spark, tail):
    got, expected = by_one(spark, 40, 90, 9, tail)
    assert got == expected and len(set(expected.values())) < 30


def test_one_component_of_a_hundred_thousand_pairs(spark):
    got, expected = by_one(spark, 3000, 100_000, 15, 0)
    assert got == expected


def test_a_long_chain_ends_in_the_tail(spark):
    """Each pair waits for the one before it."""
    got, expected = by_one(spark, 3000, 0, 15, 4096, chain=True)
    assert got == expected


def brute(rows, linked, alike):
    """Per row: the first row alike, how many others, the nearest and how far."""
    out = {}
    for i, x in rows.items():
        near = sorted((round(m, 6), j) for j, y in rows.items() if j != i and (m := linked(x, y)) is not None)
        out[i] = (min(j for j, y in rows.items() if alike(x, y)), len(near), near[0][1] if near else None, near[0][0] if near else None)
    return out


def found(df, key):
    return {r[key]: (r.class_id, r.n_links, r.nearest, None if r.nearest_at is None else round(r.nearest_at, 6)) for r in df.collect()}


def test_places_within_the_radius(spark):
    rng = random.Random(3)
    rows = {i: ("ab"[i % 2], 40 + rng.randrange(40) * 0.01, 23 + rng.randrange(40) * 0.01, rng.choice([50.0, 57.0, 58.0, 60.0, 200.0])) for i in range(300)}
    odd = [(900, None, 40.0, 23.0, 50.0), (901, "a", None, 23.0, 50.0), (902, "a", 40.0, 23.0, None), (903, "a", 40.0, 23.0, 0.0)]

    def linked(x, y):
        km = 111 * ((x[1] - y[1]) ** 2 + (0.76 * (x[2] - y[2])) ** 2) ** 0.5
        return km if x[0] == y[0] and km <= 3 and abs(x[3] - y[3]) <= 0.15 * max(x[3], y[3]) else None

    df = spark.createDataFrame([*[(i, *r) for i, r in rows.items()], *odd], "ord long, kind string, lat double, lon double, area_m2 double").withColumn("a", F.lit(1))
    assert found(similar.radius_links(df, ["kind"]), "ord") == brute(rows, linked, lambda x, y: x == y)
    assert similar.radius_links(df.limit(0), ["kind"]).count() == 0


def test_pairs_by_radius_are_added_up_where_they_meet(spark, monkeypatch):
    rng = random.Random(9)
    rows = {i: (i % 2, 38 + rng.randrange(60) / 1000, 23 + rng.randrange(60) / 1000, float(rng.randrange(20, 60))) for i in range(300)}
    df = spark.createDataFrame([(i, *r) for i, r in rows.items()], "ord long, kind int, lat double, lon double, area_m2 double")

    def linked(x, y):
        km = math.hypot(x[1] - y[1], (x[2] - y[2]) * 0.76) * 111
        return km if x[0] == y[0] and km <= 3 and abs(x[3] - y[3]) <= 0.15 * max(x[3], y[3]) else None

    monkeypatch.setattr(similar, "BLOCK_PAIRS", 50)
    got = similar.radius_links(df, ["kind"])
    assert found(got, "ord") == brute(rows, linked, lambda x, y: x == y)


@pytest.mark.parametrize(("bits", "parts", "most"), [(64, 4, 7), (32, 2, 5), (64, 8, 3)])
def test_codes_within_so_many_bits(spark, bits, parts, most):
    rng = random.Random(4)
    codes = [rng.getrandbits(bits) for _ in range(40)]
    for c in list(codes):
        for n in (0, most, most + 1):
            flipped = c
            for b in rng.sample(range(bits), n):
                flipped ^= 1 << b
            codes.append(flipped)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    rows = dict(enumerate(signed))
    far = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    df = spark.createDataFrame([*rows.items(), (999, None)], "id long, code long")
    got = found(similar.code_links(df, "id", "code", bits, parts, most), "id")
    assert got == brute(rows, lambda x, y: far(x, y) if far(x, y) <= most else None, lambda x, y: x == y)


def test_sets_of_the_similarity(spark):
    rng = random.Random(5)
    rows = {i: frozenset(f"t{rng.randrange(300)}" for _ in range(rng.choice([1, 5, 20, 40]))) for i in range(60)}
    for i in range(60):
        for c in range(3):
            some = set(rows[i])
            for t in rng.sample(sorted(some), min(len(some) - 1, c * 2)):
                some.remove(t)
            rows[100 + 10 * i + c] = frozenset(some | {f"n{i}"} if c == 1 else some)
    jaccard = lambda x, y: len(x & y) / len(x | y)
    df = spark.createDataFrame([*[(i, [*r, *sorted(r)[:1]]) for i, r in rows.items()], (9000, []), (9001, None)], "id long, tokens array<string>")
    got = found(similar.set_links(df, "id", "tokens"), "id")
    assert got == brute(rows, lambda x, y: 1 - jaccard(x, y) if jaccard(x, y) >= 0.8 else None, lambda x, y: x == y)


def test_sets_stay_where_they_are_unless_they_may_link(spark, monkeypatch):
    """Each set shares rare tokens with others, yet few can link; tokens are shuffled as prints, and few of them twice."""
    rng = random.Random(6)
    rows = {i: frozenset([*(f"u{i}_{k}" for k in range(88)), *(f"r{x}" for x in rng.sample(range(3000), 12))]) for i in range(600)}
    for i in range(0, 600, 20):
        rows[1000 + i] = frozenset([*sorted(rows[i])[: 84 + i % 14], *(f"n{i}_{k}" for k in range(6))])
        rows[2000 + i] = rows[i]
    rows |= {3000 + i: frozenset(f"s{x}" for x in rng.sample(range(8), rng.choice([1, 2, 5, 6]))) for i in range(60)}
    df = spark.createDataFrame([(i, sorted(r)) for i, r in rows.items()], "id long, tokens array<string>").repartition(3)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    df.count()
    jaccard = lambda x, y: len(x & y) / len(x | y)
    monkeypatch.setattr(similar, "COUNTED", 5000, raising=False)
    monkeypatch.setattr(similar, "TILE", 2, raising=False)
    before = written()
    got = found(similar.set_links(df, "id", "tokens"), "id")
    moved = written() - before
    assert got == brute(rows, lambda x, y: 1 - jaccard(x, y) if jaccard(x, y) >= 0.8 else None, lambda x, y: x == y)
    assert sum(n > 0 for _, n, _, _ in got.values()) > 80
    assert moved < 16 * sum(map(len, rows.values()))


def test_many_near_copies_bring_each_set_once(spark):
    """All of 300 sets link: 44,850 pairs, for which 300 sets are moved."""
    rows = {i: frozenset([*(f"t{k}" for k in range(100)), *(f"u{i}_{k}" for k in range(1 + i % 10))]) for i in range(300)}
    df = spark.createDataFrame([(i, sorted(r)) for i, r in rows.items()], "id long, tokens array<string>").repartition(3)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    df.count()
    before = written()
    got = found(similar.set_links(df, "id", "tokens"), "id")
    moved = written() - before
    jaccard = lambda x, y: len(x & y) / len(x | y)
    assert got == brute(rows, lambda x, y: 1 - jaccard(x, y) if jaccard(x, y) >= 0.8 else None, lambda x, y: x == y)
    assert moved < 300 * 299 / 2 * 200


def test_codes_and_runs_of_words(spark):
    df = spark.createDataFrame([([0.5, -1.0, 0.0, 2.0], "A b  c\nd"), (None, None), ([], " x "), ([1.0], "")], "v array<double>, t string")
    assert [r[0] for r in df.select(similar.sign_code(F.col("v"), 4)).collect()] == [9, None, 0, 1]
    assert [r[0] for r in df.select(similar.shingles(F.col("t"))).collect()] == [["a b c", "b c d"], None, ["x"], None]
    assert Counter(bin(m).count("1") for m in similar.near_masks(16, 2)) == {0: 1, 1: 16, 2: 120}


@pytest.mark.parametrize("table", [similar.TABLE, 0])
def test_rows_of_one_key_are_one_end_of_links(spark, monkeypatch, table):
    """Some keys have several rows, at one place or at several; what can be counted by tables, and what can't."""
    monkeypatch.setattr(similar, "TABLE", table)
    monkeypatch.setattr(similar, "FIRST_PLACES", 3)
    rng = random.Random(11)
    rows = [(i if i % 7 else i // 14 * 14, i % 2, 38 + rng.randrange(40) / 500, 23 + rng.randrange(40) / 500, float(rng.choice((20, 22, 25, 40, 44, 60)))) for i in range(400)]
    rows += [rows[0], (rows[7][0], *rows[8][1:])]
    km = lambda x, y: math.hypot(x[2] - y[2], (x[3] - y[3]) * 0.76) * 111
    ends = {}
    for x in rows:
        for y in rows:
            if x[0] != y[0] and x[1] == y[1] and km(x, y) <= 3 and abs(x[4] - y[4]) <= 0.15 * max(x[4], y[4]):
                ends.setdefault(x[0], []).append((round(km(x, y), 6), y[0]))
    expected = []
    for x in rows:
        near = sorted(ends.get(x[0], []))
        expected.append((x[0], min(y[0] for y in rows if y[1:] == x[1:]), len(near), *((near[0][1], near[0][0]) if near else (-1, -1.0))))
    df = spark.createDataFrame(rows, "ord long, kind int, lat double, lon double, area_m2 double")
    got = [(r.ord, r.class_id, r.n_links, *((r.nearest, round(r.nearest_at, 6)) if r.nearest is not None else (-1, -1.0))) for r in similar.radius_links(df, ["kind"]).collect()]
    assert sorted(got) == sorted(expected)
