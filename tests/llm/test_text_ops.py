"""The text operators against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from listwright.llm import exact_dedup, mixing, packing, quality_rules, secret_scan, simhash
from listwright.operators.components import components
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(params=["odd_docs", "sample_docs"])
def docs(request):
    return request.getfixturevalue(request.param)


def quality_of(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_quality_counts(docs):
    got = quality_rules.judge(docs.select("doc_id", "text")).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in got:
        expected = quality_of(r.text)
        assert tuple(r.quality[n] for n in names) == expected
        assert r.quality.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (r.quality.base_failed and r.quality.kept)


def test_kept_texts_are_the_labels_good_ones(spark):
    """The verdict against the table's own quality labels."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    both = quality_rules.judge(docs.select("doc_id", "text")).select("doc_id", "quality.kept").join(labels, "doc_id").toPandas()
    good, bad = both[both.quality == 1], both[both.quality == 0]
    assert good.kept.mean() > 0.9 and bad.kept.mean() < 0.35


def test_quality_plain_path_agrees(spark, docs, monkeypatch):
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 4)  # nearly all texts take the plain path or collide less
    got = quality_rules.judge(docs.select("doc_id", "text")).collect()
    assert [r.quality.n_repeat_words for r in got] == [quality_of(r.text)[4] for r in got]


def test_exact_dedup(docs):
    got = rows_of(exact_dedup.decide(docs))
    groups = defaultdict(list)
    for r in docs.collect():
        groups[hashlib.sha256((r.text or "").encode()).hexdigest()].append(r.doc_id)
    assert len(got) == docs.count()
    for r in got:
        ids = groups[r["text_sha256"]]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (keep, len(ids))
        assert not r["kept"] or r["doc_id"] == keep
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert kept == Counter(dict.fromkeys(groups, 1))
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in left.collect()) == sorted(groups)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 400)), max_size=1500))
def test_cuckoo_index_follows_a_dict(steps):
    index, model = exact_dedup.CuckooIndex(1), {}
    for insert, n in steps:
        key = hashlib.sha256(b"%d" % n).digest()
        if insert:
            exact_dedup.merge(index, key, n, 0, 1)
            model[key] = model.get(key, 0) + 1
        else:
            assert exact_dedup.retract(index, key) == (key in model)
            if key in model:
                model[key] -= 1
                if not model[key]:
                    del model[key]
    assert {k: v[2] for k, v in index.items()} == model and index.live == len(model)


def test_cuckoo_verifies_hits_against_content():
    index = exact_dedup.CuckooIndex(1)
    a, b = b"\x01\x00" + bytes(38), b"\x01\x00" + bytes(37) + b"\x01"  # one fingerprint, one bucket
    index.insert(a, 1)
    assert index.get(b) is None and not index.delete(b)
    index.insert(b, 2)
    assert (index.get(a), index.get(b)) == (1, 2)


def reference_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(items, linked):
    """Smallest id reachable, by repeated search."""
    ids = sorted(items)
    label = {}
    for i in ids:
        if i in label:
            continue
        stack, label[i] = [i], i
        while stack:
            x = stack.pop()
            for y in ids:
                if y not in label and linked(items[x], items[y]):
                    label[y] = i
                    stack.append(y)
    return label


def test_simhash(docs):
    got = rows_of(simhash.near_duplicates(docs))
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {i: reference_fingerprint(t) for i, t in texts.items()}
    assert simhash.hashes_of("a", 3).dtype == np.uint64
    named = {i: m for i, m in marks.items() if i is not None}
    label = reach(named, lambda a, b: bin(a ^ b).count("1") <= 3)
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{marks[r['doc_id']]:016x}"
            assert r["component_id"] == label[r["doc_id"]]


@pytest.mark.parametrize("bucket", [2048, 6])
def test_covering_tables_miss_no_pair(spark, bucket):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 20)]
    marks = set(base)
    for b in base[:8]:
        for _ in range(40):
            marks.add(b ^ sum(1 << int(i) for i in rng.choice(64, 3, replace=False)))
    items = dict(enumerate(sorted(marks)))
    signed = [(m - (1 << 64) if m >> 63 else m, i) for i, m in items.items()]
    classes = spark.createDataFrame(signed, "fp long, node long").select(F.array("fp").alias("fp"), "node")
    edges = simhash.links(classes, bucket=bucket)
    got = {r.node: r.component for r in components(edges).collect()}
    expected = reach(items, lambda a, b: bin(a ^ b).count("1") <= 3)
    assert {i: got.get(i, i) for i in items} == expected


def test_every_triple_of_positions_is_hidden_by_a_mask():
    for family in range(simhash.QUERY.families):
        hidden = [~m & (2**64 - 1) for m in simhash.masks(family)]
        assert all(
            any(h >> a & h >> b & h >> c & 1 for h in hidden) for a in range(64) for b in range(a, 64) for c in range(b, 64)
        )


def test_every_pair_of_positions_of_a_part_is_hidden():
    found = simhash.tables(0, simhash.STAGE)
    assert len(found) == 84
    for part in range(12):
        word, shift = divmod(32 * part, 64)
        mine = [~(m & (2**64 - 1)) for w, m in found if w == word and (m & (2**64 - 1)) >> shift & 0xFFFFFFFF]
        assert all(any(h >> shift + a & h >> shift + b & 1 for h in mine) for a in range(32) for b in range(a, 32))


def test_buckets_that_no_mask_splits_are_compared_in_blocks(spark):
    """A group of near copies larger than a bucket is linked whole; strangers stay apart."""
    rng = np.random.default_rng(6)
    n = simhash.STAGE.words + simhash.STAGE.minima
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    rows = []
    for i in range(60):
        fp = base.copy()
        for at in rng.choice(64 * n, 6, replace=False):
            fp[at // 64] ^= np.uint64(1) << np.uint64(at % 64)
        rows.append(fp)
    rows += [rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(20)]
    classes = spark.createDataFrame([([int(x) for x in r.view(np.int64)], i) for i, r in enumerate(rows)], "fp array<long>, node long")
    got = {r.node: r.component for r in components(simhash.links(classes, simhash.STAGE, bucket=8)).collect()}
    assert {got.get(i, i) for i in range(60)} == {0} and all(i not in got for i in range(60, 80))


def test_fingerprints_hold_the_querys_word(sample_docs):
    for r in sample_docs.limit(20).collect():
        long = simhash.fingerprint(r.text, simhash.Settings(words=4))
        assert long[0] == simhash.fingerprint(r.text)[0] == reference_fingerprint(r.text)


def test_hot_keys_join_as_any_other(spark, monkeypatch):
    from listwright.operators import joins as common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    big = spark.createDataFrame([(k % 7 if k < 50 else 100, k) for k in range(300)], "a long, v long")
    small = big.groupBy("a").agg(F.count(F.lit(1)).alias("rows_"), F.min("v").alias("m")).withColumnRenamed("a", "n_")
    got = common.split_join(big, "a", small, "n_", "rows_", 300).select("a", "v", "m")
    expected = big.join(small, big["a"] == small["n_"]).select("a", "v", "m")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())) and got.count() == 300


@pytest.mark.parametrize("most", [1, 5, None])
def test_local_indexes_pass_on_when_full(spark, most):
    rows = [(hashlib.sha256(b"%d" % (k % 9)).digest(), 5, k, k, 1) for k in range(60)]
    df = spark.createDataFrame(rows, "text_sha256 binary, n_bytes long, doc_id long, row long, count long").coalesce(1)
    once = df.mapInArrow(exact_dedup._merged(most), exact_dedup._MERGED)
    again = once.coalesce(1).mapInArrow(exact_dedup._merged(), exact_dedup._MERGED).collect()
    assert {(r.keep_id, r.group_size) for r in again} == {(max(k for k in range(60) if k % 9 == m), len([k for k in range(60) if k % 9 == m])) for m in range(9)}


def test_weak_spans_against_brute_force(docs):
    """Weak parts by comparing all pairs of a text's spans."""
    for r in docs.collect():
        text = r.text or ""
        spans = base_spans(text)
        weak = [(m.start(), k, m.end()) for k, name in enumerate(secret_scan.KINDS) if k > 2 for m in re.finditer(secret_scan.PATTERNS[name], text, re.A)]
        role = lambda x: secret_scan.ROLE[secret_scan.KINDS[x[1]]]
        every = spans + weak
        near = lambda x, what: any(role(y) == what and abs(y[0] - x[0]) <= secret_scan.SCOPE for y in every)
        needs = {"id": lambda x: near(x, "secret"), "secret": lambda x: near(x, "id") or near(x, "endpoint"), "endpoint": lambda x: near(x, "id") and near(x, "secret")}
        WEAK[r.doc_id, text] = shown(sorted(spans + [x for x in weak if needs[role(x)](x)]))
    got = {(r["doc_id"], r["spans"]) for r in rows_of(secret_scan.report(docs))}
    assert got == {(doc, spans) for (doc, _), spans in WEAK.items()}
    WEAK.clear()


WEAK: dict = {}


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 2000), (2000, 1500)] + [(5000, x) for x in range(5001, 5300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[2000] == got[1500] == 1000 and got[5299] == 5000


def wanted_by_source(sizes, weights=(3, 1, 2)):
    """Targets by filling: every source grows by its weight until it holds twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0)
    open_ = {s for s in order if sizes[s]}
    while open_ and left > 1e-9:
        step = min(left / sum(weight[s] for s in open_), min((2 * sizes[s] - out[s]) / weight[s] for s in open_))
        for s in open_:
            out[s] += step * weight[s]
        left -= step * sum(weight[s] for s in open_)
        open_ = {s for s in open_ if out[s] < 2 * sizes[s] - 1e-9}
    return out


def test_mixing(docs):
    got = rows_of(mixing.mix(docs))
    assert len(got) == docs.count()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    wanted = wanted_by_source(sizes)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= (0.5 if wanted[s] < mixing.BLOCK else mixing.BLOCK)
    again = rows_of(mixing.mix(docs.repartition(3)))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(got, key=key) == sorted(again, key=key)


@pytest.mark.parametrize("shard", [65_536, 50])
def test_tiny_and_many_sources_meet_their_targets(spark, monkeypatch, shard):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", shard)
    rows = [(k, " ".join(["w"] * (1 + k % 23)), f"s{k % 140:03d}") for k in range(900)]
    rows += [(None, "a b c", None), (None, "a b c d", None), (5, None, "none"), (6, "", "none"), (7, "one", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    wanted, taken = wanted_by_source(sizes), Counter()
    for r in rows_of(mixing.mix(docs)):
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(wanted[r["source"]])
    for s, w in wanted.items():
        full = -(-sizes[s] // shard)  # a shard that is read out may leave a part of a block
        assert abs(taken[s] - w) <= (0.5 if w < mixing.BLOCK else mixing.BLOCK * (1 + full))


def plan_of(docs):
    """Rows, and shards, of a mix."""
    placed, shards = mixing.shards_of(docs)
    return rows_of(placed), rows_of(shards)


@pytest.mark.parametrize("block", [16, 50])
def test_quotas_are_the_highest_quotients_at_both_levels(spark, sample_docs, monkeypatch, block):
    """Sources and shards have what highest quotients dealt one by one give, and the mix takes those blocks."""
    monkeypatch.setattr(mixing, "BLOCK", block)
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 2000)
    rows, shards = plan_of(sample_docs)
    targets = {r["src"]: r["target"] for r in rows}
    sources = sorted(s for s, t in targets.items() if t >= block)
    of = {s: sorted((r for r in shards if r["src"] == s), key=lambda r: r["shard"]) for s in sources}
    caps = [sum(2 * r["tokens"] // block for r in of[s]) for s in sources]
    quotas = mixing.sainte_lague([targets[s] for s in sources], int(sum(targets[s] for s in sources) / block), caps)
    for s, quota in zip(sources, quotas, strict=True):
        assert [r["quota"] for r in of[s]] == mixing.sainte_lague([r["tokens"] for r in of[s]], quota, [2 * r["tokens"] // block for r in of[s]])
    taken = Counter()
    for r in rows_of(mixing.mix(sample_docs)):
        taken["n" if r["source"] is None else "s" + r["source"]] += r["taken"]
    assert {s: taken[s] for s in sources} == {s: block * q for s, q in zip(sources, quotas, strict=True)}


def test_other_blocks_give_another_mix(spark, sample_docs, monkeypatch):
    first = Counter((r["doc_id"], r["taken"]) for r in rows_of(mixing.mix(sample_docs)))
    monkeypatch.setattr(mixing, "BLOCK", 100)
    assert first != Counter((r["doc_id"], r["taken"]) for r in rows_of(mixing.mix(sample_docs)))


def test_apportionment_in_groups(spark):
    """Ties, full parties, parties without votes, more seats than room, and great ranges of votes."""
    rng = np.random.default_rng(4)
    groups = {f"g{i}": [int(rng.choice([0, 1, 5, 5, 5, 100, rng.integers(1, 10**6)])) for _ in range(n)] for i, n in enumerate((1, 2, 30, 30, 12))}
    caps = {g: [int(rng.choice([0, 1, 3, 10**6, 10**9])) for _ in v] for g, v in groups.items()}
    seats = dict(zip(groups, (7, 0, 100, 12345, 3), strict=True))
    rows = [(g, i, float(v), caps[g][i], seats[g]) for g, vs in groups.items() for i, v in enumerate(vs)]
    got = {(r.group, r.i): r.quota for r in mixing.apportioned(spark.createDataFrame(rows, "group string, i int, votes double, most long, seats long"), ["i"]).collect()}
    for g, vs in groups.items():
        assert [got[g, i] for i in range(len(vs))] == mixing.sainte_lague(vs, seats[g], caps[g]), g


def test_rows_that_repeat_in_number_are_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 200)
    docs = spark.createDataFrame([(None, "one two three four five", "s")] * 1000 + [(k, "a b c", "t") for k in range(50)], "doc_id long, text string, source string")
    rows, shards = plan_of(docs)
    assert max(r["tokens"] for r in shards) < 1000 and sum(r["tokens"] for r in shards) == 5150
    assert all(r["taken"] <= 2 * r["size"] for r in rows_of(mixing.mix(docs)))


def test_the_mix_emits_the_picked_blocks(spark):
    rows = [(i, " ".join(f"{i}_{k}" for k in range(400)), "abc"[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r["doc_id"]: r for r in rows_of(mixing.mix(docs))}
    got = defaultdict(Counter)
    for r in mixing.apply_mix(docs).collect():
        got[r.doc_id].update(r.text.split())
    cut = 0
    for i, text, source in rows:
        assert sum(got[i].values()) == plan[i]["taken"]
        assert set(got[i]) <= set(text.split())
        if source == "b":  # taken 0.83 times
            assert plan[i]["target"] < plan[i]["source_size"] and max(got[i].values(), default=0) <= 1
            cut += 0 < plan[i]["taken"] < 400
    assert 0 < cut <= 2  # blocks follow one another, so most documents are whole


def test_the_mix_tells_rows_of_one_id_apart(spark, odd_docs):
    rows = [(i % 3 if i < 30 else None, " ".join(f"{i}_{k}" for k in range(10 + 90 * (i % 2))), "s" if i % 5 else None) for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, None, "s"), (1, "", "s")], "doc_id long, text string, source string")
    for given_docs in (docs, odd_docs):
        got = mixing.apply_mix(given_docs)
        assert got.columns == given_docs.columns
        got = got.collect()
        assert all(r.text and r.text.strip() for r in got)
        expected, found = Counter(), Counter()
        for r in rows_of(mixing.mix(given_docs)):
            expected[r["doc_id"], r["source"]] += r["taken"]
        for r in got:
            found[r.doc_id, r.source] += len(WORD.findall(r.text))
        assert found == +expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=12), st.integers(0, 400))
def test_sainte_lague_is_the_highest_quotients(votes, seats):
    got = mixing.sainte_lague(votes, seats)
    slow = [0] * len(votes)
    for _ in range(seats if any(votes) else 0):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * slow[i] + 1), -i))
        slow[best] += 1
    assert sum(got) == sum(slow)
    quotients = lambda seats_: sorted(v / (2 * k + 1) for v, s in zip(votes, seats_, strict=True) for k in range(s))
    assert quotients(got) == quotients(slow)


def test_targets_stop_at_twice_the_size(spark):
    def of(*sizes):
        df = spark.createDataFrame([(f"s{i}", f"{i}", n, 1) for i, n in enumerate(sizes)], "src string, source string, source_size long, rows long")
        return [r.target for r in mixing.targets(df).orderBy("source").collect()]

    assert of(100, 1000, 10) == pytest.approx([200, 1665 - 200 - 20, 20])
    assert of(0, 0) == [0, 0] and of(7) == [pytest.approx(10.5)]


def packed(docs):
    return rows_of(packing.pack(docs, TOKENIZER))


def test_packing(docs):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(TOKENIZER).encode
    expected = Counter()
    ids_of = {}
    for r in docs.collect():
        ids = np.array([*encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        ids_of[r.doc_id] = ids
        expected[r.doc_id, len(ids)] += 1
    got = packed(docs)
    covered, lanes = defaultdict(list), defaultdict(list)
    for p in got:
        lanes[p["sequence_id"]].append((p["offset"], p["length"]))
        covered[p["doc_id"]].append((p["start"], p["length"], p["doc_tokens"]))
        ids = ids_of[p["doc_id"]]
        if p["doc_tokens"] == len(ids) and p["doc_id"] is not None:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    assert {d for d, _ in expected} == set(covered)
    for doc, pieces in covered.items():
        total = sum(n * c for (d, n), c in expected.items() if d == doc)
        assert sum(n for _, n, _ in pieces) == total
        if sum(c for (d, _), c in expected.items() if d == doc) == 1:
            at = 0
            for start, length, _ in sorted(pieces):
                assert start == at
                at += length
    waste = 0
    for pieces in lanes.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        waste += 2048 - at
    assert waste <= 2048 + 16 * len(lanes)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 2047), st.integers(1, 50), max_size=40))
def test_patterns_hold_every_length_once(histogram):
    patterns = packing.fill_gaps(packing.pack_histogram(histogram))
    held = defaultdict(list)
    for p in patterns:
        assert p.count > 0 and sum(n for _, _, n, _ in p.slots) + p.room == 2048 and p.room >= 0
        for origin, start, n, rank in p.slots:
            for k in range(p.count):
                held[origin, rank + k].append((start, n))
    assert set(held) == {(n, k) for n, c in histogram.items() for k in range(c)}
    for (origin, _), parts in held.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == origin


def base_spans(text):
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(?ai:", "(?i:"), re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def shown(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_secret_scan(docs):
    got = rows_of(secret_scan.report(docs))
    expected = Counter()
    for r in docs.collect():
        spans = base_spans(r.text or "")
        digest = hashlib.sha256(shown(spans).encode()).hexdigest()
        expected[(r.doc_id, *[sum(k == j for _, k, _ in spans) for j in range(3)], digest)] += 1
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == expected


def test_weak_parts_need_company(spark):
    texts = {
        1: "user_name: bob99 alone",
        2: "user_name: bob99 and pwd=abcdefgh1",
        3: "see https://a.example.org/x only",
        4: "user_name: bob99 pwd=abcdefgh1 at https://a.example.org/x",
        5: "user_name: bob99 " + "x" * 400 + " pwd=abcdefgh1",
        6: "password=verylong1 user_name=bob99 " * 3000,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.report(docs).collect()}
    assert got[1] == got[3] == got[5] == ""
    assert got[2] == "weak_id:0:16,weak_secret:21:34"
    assert [x.split(":")[0] for x in got[4].split(",")] == ["weak_id", "weak_secret", "endpoint"]
    assert len(got[6].split(",")) == 6000


def test_empty_tables(no_docs):
    assert quality_rules.judge(no_docs.select("doc_id", "text")).count() == 0
    assert exact_dedup.decide(no_docs).count() == 0
    assert exact_dedup.drop_copies(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0
    assert packing.pack(no_docs, TOKENIZER).count() == 0
    assert secret_scan.report(no_docs).count() == 0


def test_tokens_by_word_are_the_tokenizers_own(sample_docs):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(TOKENIZER).encode
    mine = packing.Tokens(TOKENIZER)
    odd = ["", "it's DON'T 'tis", "İstanbul ΣΑΣ Σ", "été K Å ﬁ ½ ÷×", "<|endoftext|>a <|startoftext|>", "a b c\x1cd", "x,—y naïve?! ``'' ßÿ", "日本語 한국어 😀👍", "1,234.5€ a1b2", "tab\tnl\r\n\x0b\x0cend"]
    for text in odd + [r.text for r in sample_docs.limit(60).collect()]:
        assert mine(text).tolist() == [*encode(text, add_special_tokens=False).ids, packing.END_ID]


@pytest.mark.parametrize("bits", [1 << 15, 1 << 18])
def test_the_bit_map_holds_every_dropped_digest(spark, sample_docs, monkeypatch, bits):
    monkeypatch.setattr(exact_dedup, "_bits", lambda keys: bits)
    got = exact_dedup.drop_copies(sample_docs.unionByName(sample_docs.filter("doc_id % 3 = 0")))
    groups = defaultdict(list)
    for r in sample_docs.collect():
        groups[r.text].append(r.doc_id)
    assert sorted(r.doc_id for r in got.collect()) == sorted(max(ids) for ids in groups.values())
    keys = spark.createDataFrame([(f"{i:064x}",) for i in range(500)], "_key string")
    maps = exact_dedup._bitmap(keys, bits)
    place = exact_dedup._place(F.col("_key"), bits)
    held = keys.join(maps, F.shiftright(place, 15) == F.col("map_no")).filter(exact_dedup._bit(F.col("bitmap"), place))
    assert held.count() == 500
