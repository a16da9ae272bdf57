"""Trained operators by held-out accuracy, the pipeline against brute force, and oracle SQL."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
import xxhash
from listwright.llm import lm_score, near_copies, registry, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    big = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet")
    model = toxicity.train(big, labels.filter("doc_id % 4 <> 0"))
    assert len(model.hashes) <= toxicity.CANDIDATES and len(model.links) == len(toxicity.CATEGORIES)
    said = toxicity.score(big, model)
    both = said.join(labels.filter("doc_id % 4 = 0").withColumnRenamed("toxic", "label"), "doc_id").join(big.select("doc_id", "lang", "text"), "doc_id").toPandas()
    precision = ((both.label == 1) & both.toxic).sum() / max(1, both.toxic.sum())
    recall = ((both.label == 1) & both.toxic).sum() / (both.label == 1).sum()
    assert precision > 0.95 and recall > 0.85
    for lang, part in both[both.label == 1].groupby("lang"):
        assert part.toxic.mean() > 0.5, lang
    assert docs.count() == toxicity.score(docs, model).count()
    # The scores again, by the plain formula over sets of hashes.
    numbers = {int(h): i for i, h in enumerate(model.hashes)}
    for r in both.head(60).itertuples():
        held, logits = {numbers[h] for h in toxicity.word_hashes(r.text) if h in numbers}, []
        for name, link in zip(toxicity.CATEGORIES, model.links, strict=True):
            z = link.bias + sum(w * x for w, x in zip(link.chain, logits, strict=True)) + sum(w for f, w in zip(link.features, link.weights, strict=True) if f in held)
            chance = 1 / (1 + np.exp(-min(max(z, -30), 30)))
            assert abs(getattr(r, f"p_{name}") - chance) < 1e-9
            logits.append(toxicity.logit(chance))
        assert r.toxic == (chance > model.threshold)


def test_kinds_are_found_in_the_data_and_earlier_links_are_used(monkeypatch):
    """Three vocabularies give three kinds; a kind's probability speaks for toxicity."""
    monkeypatch.setattr(toxicity, "KINDS", 3)
    rng = np.random.default_rng(4)
    n, lists, kind = 3000, [], rng.choice([-1, 0, 1, 2], 3000, p=[0.7, 0.15, 0.1, 0.05])
    for k in kind:
        own = rng.choice(20, 4, replace=False) + 20 * k if k >= 0 else np.empty(0, int)
        lists.append(np.unique(np.r_[own, rng.integers(60, 400, 12)]).astype(int))
    docs, words = np.repeat(np.arange(n), [len(x) for x in lists]), np.concatenate(lists)
    toxic = (kind >= 0).astype(float)
    found = toxicity.kinds_of(docs, words, toxic, 400)
    assert (found[kind < 0] == -1).all()
    assert all((found[kind == k] == k).mean() > 0.98 for k in range(3))
    labels = np.column_stack([*[(found == k).astype(float) for k in range(3)], toxic])
    models, threshold = toxicity.fit_chain(docs, words, labels, np.arange(n) % 5)
    assert [len(m.chain) for m in models] == [0, 1, 2, 3] and (models[3].chain > 0.1).all() and 0 < threshold < 1


def test_a_folds_kinds_are_found_without_its_texts():
    """Labels inside a fold change nothing of the kinds outside of it but their numbers; numbers follow the words."""
    rng = np.random.default_rng(12)
    n, kinds = 600, rng.integers(0, 4, 600)
    toxic = (rng.random(n) < 0.4).astype(float)
    docs, words = [], []
    for i in range(n):
        mine = rng.integers(0, 200, 10).tolist() + (list(rng.choice(range(200 + 10 * kinds[i], 210 + 10 * kinds[i]), 6)) if toxic[i] else [])
        docs += [i] * len(set(mine))
        words += sorted(set(mine))
    docs, words, folds = np.array(docs), np.array(words), rng.integers(0, toxicity.FOLDS, n)
    found = toxicity.kinds_of(docs, words, toxic, 240)
    without = toxicity.kinds_without(docs, words, toxic, folds, found, 240)
    other = np.where(folds == 0, 1 - toxic, toxic)
    again = toxicity.kinds_without(docs, words, other, folds, toxicity.kinds_of(docs, words, other, 240), 240)
    outside = folds != 0
    pairs = set(zip(without[0][outside].tolist(), again[0][outside].tolist(), strict=True))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and (without[0][~outside] == -1).all()
    told = outside & (toxic > 0) & (found >= 0)
    assert (without[0][told] == found[told]).mean() > 0.95


def test_chain_uses_earlier_probabilities():
    rng = np.random.default_rng(1)
    n = 3000
    first = rng.random(n) < 0.3
    words = [[1] * bool(f) + [int(x) for x in rng.integers(100, 400, 5)] for f in first]
    second = first & (rng.random(n) < 0.95)
    docs = np.repeat(np.arange(n), [len(w) for w in words])
    models, threshold = toxicity.fit_chain(docs, np.concatenate(words), np.column_stack([first, second]).astype(float), np.arange(n) % 5)
    assert len(models[0].chain) == 0 and models[1].chain[0] > 0 and 0 < threshold < 1


def test_toxicity_without_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.judge(odd_docs, none)
    assert got.filter("kept").count() == odd_docs.count()
    one = spark.createDataFrame([(1, 1), (1, 1)], "doc_id long, toxic int")
    assert toxicity.judge(odd_docs, one).count() == odd_docs.count()
    assert toxicity.judge(no_docs, none).count() == 0
    left = toxicity.drop_toxic(odd_docs, none)
    assert left.columns == odd_docs.columns and sorted(map(str, left.collect())) == sorted(map(str, odd_docs.collect()))


def test_toxic_rows_go_from_odd_documents(spark, odd_docs, sample_docs):
    """Rows that the query calls toxic are the ones the stage drops, also beside odd rows."""
    labels = spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    big = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet").limit(4000)
    docs = big.unionByName(odd_docs.select(*big.columns)).withColumn("kept", F.lit("x"))
    said = toxicity.judge(docs, labels)
    left = toxicity.drop_toxic(docs, labels)
    kept = Counter(r.doc_id for r in said.filter("kept").collect())
    assert 0 < said.filter("toxic").count() and Counter(r.doc_id for r in left.collect()) == kept


def fitted(docs, rounds=1):
    rows = lm_score.chunks(docs)
    counts = lm_score.word_counts(rows)
    words = lm_score.vocabulary(rows, counts)
    return rows, counts, words, lm_score.train(rows, words, rounds)


def test_lm_learns(spark, sample_docs):
    rows, _, words, flat = fitted(sample_docs, 3)

    def mean(weights):
        net, logs = lm_score.Network(weights, words.class_bias, words.member_bias), []
        for r in rows.collect():
            hashes = np.frombuffer(bytes(r.words), "<u8")
            places = np.frombuffer(bytes(r.places), "<u2" if len(hashes) <= 1 << 16 else "<u4")
            logs.append(lm_score.line_logs(net, lm_score.lined(words.tokens(hashes)[places], np.frombuffer(bytes(r.lengths), "<u4").astype(int))))
        return np.concatenate(logs).mean()

    assert mean(flat) > mean(lm_score.Network().flat) + 0.1
    assert fitted(sample_docs, 1)[3].tobytes() == fitted(sample_docs, 1)[3].tobytes()  # reruns agree


@pytest.mark.parametrize("named", [lm_score.NAMED, 40])
def test_lm_scores_equal_the_formula(spark, sample_docs, odd_docs, monkeypatch, named):
    """Every score again, word by word, from Python counts and plain sums over the network's weights."""
    monkeypatch.setattr(lm_score, "LEAST_PARTS", 7)
    real = lm_score.named_words
    monkeypatch.setattr(lm_score, "named_words", lambda counts: real(counts, named))
    docs = sample_docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text").limit(40).unionByName(odd_docs.select("doc_id", "text")).unionByName(spark.createDataFrame([(-1, "unheard " * 9), (-2, "unheard"), (-3, None)], "doc_id long, text string"))
    rows, counts, words, flat = fitted(docs)
    net = lm_score.Network(flat, words.class_bias, words.member_bias)
    texts = [(r.doc_id, lm_score._WORDS.findall(r.text or "")) for r in docs.collect()]
    n = Counter(w for _, ws in texts for w in ws)
    code = {w: int(words.tokens(np.array([xxhash.xxh64_intdigest(w.encode())], np.uint64))[0]) for w in n}
    shared = Counter()
    for w, k in n.items():
        shared[code[w]] += k
    held = {int(x) for x in words.numbers}
    assert len(held) <= named and all(shared[t] == next(k for w, k in n.items() if code[w] == t) for t in held)
    p, score_of = net.parts, {}

    def chance(around, t):
        h = np.tanh(p["shift"] + sum(p["embed"][x] * m for x, m in zip(around, p["mix"], strict=True)))
        c, m = divmod(t, lm_score.MEMBERS)
        a, b = p["to_class"] @ h + net.class_bias, p["to_member"][c] @ h + net.member_bias[c]
        return a[c] - np.log(np.exp(a).sum()) + b[m] - np.log(np.exp(b).sum())

    got = Counter((r.doc_id, r.n_tokens, round(r.log_likelihood, 1)) for r in lm_score.score(docs).collect())
    assert sum(got.values()) == len(texts)
    by_id = {r.doc_id: r for r in lm_score.score(docs).collect()}
    for doc, ws in texts:
        if doc is None or doc == 2 or len(ws) > 800:
            continue
        line = [lm_score.BORDER] * 2 + [code[w] for w in ws] + [lm_score.BORDER] * 2
        total = sum(chance([line[i], line[i + 1], line[i + 3], line[i + 4]], line[i + 2]) + (0 if line[i + 2] in held else np.log(n[w] / shared[line[i + 2]])) for i, w in enumerate(ws))
        assert by_id[doc].n_tokens == len(ws) and abs(by_id[doc].log_likelihood - total) < 1e-3 * (1 + len(ws)), doc
        score_of[doc] = total
    assert score_of[-3] == 0 and score_of[-2] < 0


def test_lm_tells_texts_that_occur_twice(spark, sample_docs):
    """Invented words score by how often the whole corpus has them."""
    rng = np.random.default_rng(5)
    made = [" ".join(f"q{x:x}" for x in rng.integers(0, 1 << 40, 120)) for _ in range(60)]
    rows = [(10_000_000 + i, t) for i, t in enumerate(made)] + [(20_000_000 + i, t) for i, t in enumerate(made[:30])]
    docs = sample_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.per_token for r in lm_score.score(docs).filter("doc_id >= 10000000").collect()}
    twice, once = [got[10_000_000 + i] for i in range(30)], [got[10_000_000 + i] for i in range(30, 60)]
    assert min(twice) > max(once)


def test_lm_of_an_empty_table_and_extra_columns(spark, odd_docs, no_docs):
    assert lm_score.score(no_docs).count() == 0
    assert lm_score.score(odd_docs.withColumn("chunk", F.lit(1)).withColumn("words", F.lit("x"))).count() == odd_docs.count()


def test_lm_is_normalised_and_gradients_are_right():
    rng = np.random.default_rng(2)
    bias = np.log(rng.random(lm_score.CLASSES).astype(np.float32)), np.log(rng.random((lm_score.CLASSES, lm_score.MEMBERS)).astype(np.float32))
    net = lm_score.Network(lm_score.Network().flat + rng.normal(0, 0.1, lm_score.Network.SIZE).astype(np.float32), *bias)
    around = rng.integers(0, lm_score.TOKENS + 1, 4)
    total = 0.0
    for t in range(0, lm_score.TOKENS, 4096):
        lines = np.array([[around[0], around[1], x, around[2], around[3]] for x in range(t, t + 4096)])
        logs, _ = net.forward(lines.reshape(-1).astype(np.int32))
        total += np.exp(logs[::5].astype(float)).sum()
    assert abs(total - 1) < 1e-3
    line = rng.integers(0, 300, 70).astype(np.int32)
    line[[30, 31]] = lm_score.BORDER
    moved = lm_score.Network(net.flat, *bias)
    squares = {k: np.zeros_like(v) for k, v in moved.parts.items()}
    moved.step(line, squares, rate=0.0)
    mean = lambda n: -n.forward(line)[0].astype(float).sum() / 64  # noqa: E731  the borders score 0
    for name, sq in squares.items():
        slope = np.sqrt(sq).reshape(-1)
        for at in rng.choice(np.flatnonzero(slope > slope.max() * 0.2), 4, replace=False):
            up, down = lm_score.Network(net.flat, *bias), lm_score.Network(net.flat, *bias)
            up.parts[name].reshape(-1)[at] += 1e-2
            down.parts[name].reshape(-1)[at] -= 1e-2
            assert abs(abs((mean(up) - mean(down)) / 2e-2) - slope[at]) < 0.08 * slope[at] + 2e-5, name


def near_brute(docs):
    """Smallest id that each document reaches over pairs of the similarity."""
    ids, label = sorted(docs), {}
    sets = {i: shingles(docs[i]) for i in ids}
    for i in ids:
        if i in label:
            continue
        stack, label[i] = [i], i
        while stack:
            x = stack.pop()
            for y in ids:
                if y not in label and jaccard(sets[x], sets[y]) >= 0.8:
                    label[y] = i
                    stack.append(y)
    return label


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def kept_ids(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in near_copies.keep_smallest(docs).collect()))


def words_at(rng, n, stem="v"):
    return [f"{stem}{x}" for x in rng.integers(0, 20_000, n)]


def test_near_copies_are_found_and_nothing_else(spark):
    """Pairs from 0.7 to 0.95, short texts and long ones: none below the threshold, nearly all above it."""
    rng = np.random.default_rng(9)
    texts, above, below = {}, [], []
    for i in range(160):
        ws = words_at(rng, 300 if i < 140 else 4000)
        other = list(ws)
        for at in rng.choice(len(ws), int(len(ws) * rng.uniform(0.005, 0.04)), replace=False):
            other[at] = f"new{i}_{at}"
        texts[10 * i], texts[10 * i + 1] = " ".join(ws), " ".join(other)
        (above if jaccard(shingles(texts[10 * i]), shingles(texts[10 * i + 1])) >= 0.8 else below).append(10 * i + 1)
    got = {i for _, i, _ in kept_ids(spark, list(texts.items()))}
    assert len(above) > 50 < len(below)
    assert all(10 * i in got for i in range(160)) and all(x in got for x in below)
    assert sum(x not in got for x in above) >= 0.97 * len(above)


def test_texts_that_share_a_repeated_line_stay(spark):
    """Boilerplate many times over and own words: similarity is far below, whatever their fingerprints."""
    rng = np.random.default_rng(5)
    shared = "all rights reserved by us\n" * 60
    rows = [(i, shared + " ".join(words_at(rng, 100, f"own{i}_"))) for i in range(40)]
    assert [i for _, i, _ in kept_ids(spark, rows)] == list(range(40))
    own = " ".join(words_at(rng, 200))
    assert [i for _, i, _ in kept_ids(spark, [*rows, (50, shared + own), (51, shared + own + " tail")])] == [*range(40), 50]


def test_rows_of_one_id_are_documents_each(spark):
    rng = np.random.default_rng(6)
    a, b = (" ".join(words_at(rng, 200)) for _ in "ab")
    kept = kept_ids(spark, [(1, a), (5, a + " tail"), (5, b), (None, b + " tail"), (None, a), (None, "x y z"), (7, None), (8, ""), (None, " ")])
    assert kept == sorted([(False, 1, a), (False, 5, b), (True, 0, "x y z"), (False, 7, "")])
    assert kept_ids(spark, [(3, a), (3, a), (2, a + " tail"), (2, a + " tail")]) == [(False, 2, a + " tail")]


def test_long_texts_near_the_threshold_are_compared_whole(spark, monkeypatch):
    """With a sketch of few hashes all is decided by the exact step."""
    monkeypatch.setattr(near_copies, "SKETCH", 16)
    monkeypatch.setattr(near_copies, "BAND", 1.0)
    rng = np.random.default_rng(7)
    rows, expected = [], []
    for i in range(30):
        ws = words_at(rng, 300)
        other = list(ws)
        for at in rng.choice(300, 7, replace=False):
            other[at] = f"new{i}_{at}"
        rows += [(2 * i, " ".join(ws)), (2 * i + 1, " ".join(other))]
        expected += [2 * i] + [2 * i + 1] * (jaccard(shingles(rows[-2][1]), shingles(rows[-1][1])) < 0.8)
    got = [i for _, i, _ in kept_ids(spark, rows)]
    assert set(expected) <= set(got) and len(got) - len(expected) <= 2


def test_minima_tell_the_similarity():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.5, 0.9):
        both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (int(2000 * share), 2000 - int(2000 * share), 2000 - int(2000 * share)))
        x, y = (np.array(near_copies.minima(np.unique(np.r_[both, z])), np.uint64) for z in (a, b))
        true = len(both) / (len(both) + len(a) + len(b))
        assert abs(np.bitwise_count(x ^ y).sum() / 256 - (1 - true) / 2) < 0.1


def test_no_near_stage_removal_is_wrong(spark):
    """Each text that goes from sf0.1 has a text of the similarity that stays or goes with it; nearly all such go."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    kept = {r.doc_id for r in near_copies.keep_smallest(docs).select("doc_id").collect()}
    sets = {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        sets.setdefault(near_copies.set_of(r.text).tobytes(), r.doc_id)
    first = {i: np.frombuffer(k, np.uint64).tolist() for k, i in sets.items()}
    inverted, pairs = defaultdict(list), []
    for i, hashes in first.items():
        seen = Counter()
        for h in hashes:
            seen.update(inverted[h])
            inverted[h].append(i)
        pairs += [(j, i) for j, n in seen.items() if n / (len(hashes) + len(first[j]) - n) >= 0.8]
    root = {i: i for i in first}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    should = {i for i in first if find(i) == i}
    assert not should - kept
    assert len(kept - should) <= 0.05 * len(pairs)


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).withColumn("_taken", F.lit(1))
    (_, toxic), (_, exact), (_, near), (_, mix), (_, pack) = corpus_pipeline.STAGES
    clean = toxic(spark, docs, SF)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()
    once = exact(spark, clean, SF)
    groups = defaultdict(list)
    for r in clean.collect():
        groups[r.text].append(r.doc_id)
    assert sorted(r.doc_id for r in once.collect()) == sorted(max(ids) for ids in groups.values())
    left = near(spark, once, SF)
    label = near_brute({r.doc_id: r.text for r in once.collect()})
    stays = {r.doc_id for r in left.collect()}
    should = {i for i, c in label.items() if i == c}
    assert should <= stays and len(stays - should) <= 1
    mixed = mix(spark, left, SF)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert set(words) <= stays
    packed = pack(spark, mixed, SF)
    assert {r.doc_id for r in packed.collect()} == set(words)


def test_pipeline_stages_on_odd_and_empty_documents(spark, odd_docs, no_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, no_docs, SF)
        assert empty.count() == 0, name
        docs, before = stage(spark, docs, SF), docs
        if name != "packing":
            assert docs.columns == odd_docs.columns == empty.columns, name
        if name == "exact_dedup":
            texts = Counter(r.text or "" for r in before.collect())
            assert Counter(r.text or "" for r in docs.collect()) == Counter(dict.fromkeys(texts, 1))
        if name == "simhash":
            sets = {frozenset(shingles(r.text)) for r in before.collect()}
            assert {frozenset(shingles(r.text)) for r in docs.collect()} <= sets and docs.count() == len(sets)
    assert docs.count() > 0


def test_run_on_written_tables(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(1, 0, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    for name, table in (("odd", odd_docs), ("none", no_docs)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/odd").count() > 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_oracle_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in registry.ORACLES.items():
        got, expected = registry.QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(expected.columns), name
        key = sorted(got.columns)
        a, b = (x[key].sort_values(key).reset_index(drop=True).astype(str) for x in (got, expected))
        pd.testing.assert_frame_equal(a, b)


def test_queries_cover_whole_tables(spark):
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for name in ("op1_toxicity", "op2_mixing", "op3_quality_rules", "op4_exact_dedup", "op5_lm_score", "op6_simhash", "op10_secret_scan"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() == n, name
    assert hashlib.sha256(b"").hexdigest() in {r.base_sha256 for r in registry.op10_secret_scan(spark, "/root/testdata/sf0.001").collect()}


def test_lm_writes_to_kept_arrays_and_splits_bytes_as_the_pattern_does(monkeypatch):
    rng = np.random.default_rng(4)
    line = rng.integers(0, 300, 500).astype(np.int32)
    net, fresh = lm_score.Network(), lm_score.Network()
    first = net.forward(line)
    logs, kept = first[0].copy(), first[1][0]
    assert net.forward(line[:90])[1][0].base is kept.base  # a shorter line takes part of the same memory
    assert (net.forward(line)[0] == logs).all() and (fresh.forward(line)[0] == logs).all()
    monkeypatch.setattr(lm_score, "PIECE", 20)
    text = "a\x0bb\x1cc \x85d e f\r\n\x0cgé 😀" * 9
    assert [w for ws in lm_score._lists(text.encode()) for w in ws] == [w.encode() for w in lm_score._WORDS.findall(text)]


@pytest.mark.parametrize("size", [0.1, 3.0])
def test_lm_holds_no_logits_of_a_whole_line(size):
    """Logits are made a tile at a time: one class with more rows than a tile, others with few or none, and cut ones."""
    rng = np.random.default_rng(6)
    bias = np.log(rng.random(lm_score.CLASSES).astype(np.float32)), np.log(rng.random((lm_score.CLASSES, lm_score.MEMBERS)).astype(np.float32))
    net = lm_score.Network(lm_score.Network().flat + rng.normal(0, size, lm_score.Network.SIZE).astype(np.float32), *bias)
    line = np.r_[rng.integers(0, lm_score.MEMBERS, 3_000), rng.integers(0, lm_score.TOKENS + 1, 9_000), [lm_score.BORDER] * 2].astype(np.int32)
    logs, p = net.forward(line)[0], net.parts
    for at in [*range(0, 3_000, 500), *range(3_000, len(logs), 700)]:
        t = line[at + 2]
        if t == lm_score.BORDER:
            continue
        h = np.tanh(p["shift"] + sum(p["embed"][line[at + 2 + d]] * w for d, w in zip((-2, -1, 1, 2), p["mix"], strict=True)))
        a, b = p["to_class"] @ h + bias[0], p["to_member"][t // 128] @ h + bias[1][t // 128]
        a, b = (np.clip(x, -lm_score.LOGIT, lm_score.LOGIT).astype(float) for x in (a, b))
        assert abs(logs[at] - (a[t // 128] - np.log(np.exp(a).sum()) + b[t % 128] - np.log(np.exp(b).sum()))) < 1e-3
    net.step(line, {k: np.full_like(v, 1e-6) for k, v in net.parts.items()})
    assert np.isfinite(net.flat).all()
    assert max(x.size for x in net.spaces.values()) < len(logs) * lm_score.CLASSES / 2


def test_lm_chunks_number_words_as_python_does(monkeypatch):
    monkeypatch.setattr(lm_score, "_lists", None)  # short texts aren't split in Python
    texts = [None, "", " \t", "a b", "\x0bb\x1cc \x85d ", "é 😀\r\n\x0cb b", "a" * 9]
    batch = pa.array(texts, pa.string())
    got = []
    for n, places, hashes in lm_score._worded(batch):
        got += [list(x) for x in np.split(hashes[places], np.cumsum(n)[:-1])]
    assert got == [[xxhash.xxh64_intdigest(w) for w in lm_score._WORDS.findall(t or "")] for t in texts]
