"""Fill-in-the-middle, vector codes and language identification against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from listwright.llm import fill_middle, language_id, vector_codes

UNITS = re.compile(r"[^\n]*\n|[^\n]+")


def moved_by_lists(doc_id, text):
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("name", ["odd_docs", "sample_docs", "no_docs"])
def test_texts_move_as_lists_of_lines_do(request, name):
    docs = request.getfixturevalue(name)
    expected = Counter((r.doc_id, *moved_by_lists(r.doc_id, r.text or ""), r.text or "") for r in docs.select("doc_id", "text").collect())
    got = fill_middle.restore(fill_middle.transform(docs)).collect()
    assert Counter(tuple(r) for r in got) == expected
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert Counter((r.doc_id, r.output_sha256, r.restored_sha256) for r in fill_middle.digests(docs).collect()) == Counter((r.doc_id, sha(r.output), sha(r.restored)) for r in got)


_TEXTS = st.lists(st.sampled_from(["\n", "a", "é😀", "<", "<P", "P>", "S>", "<M", "\r", "word " * 9]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.integers(-5, 10**12)), _TEXTS)
def test_any_text_is_read_back(doc_id, text):
    saved, fill_middle.LEAF = fill_middle.LEAF, 8  # many leaves
    try:
        got = fill_middle.rearranged(doc_id, text)
        assert tuple(got) == moved_by_lists(doc_id, text)
        assert fill_middle.restored(got.output, got.form) == text
    finally:
        fill_middle.LEAF = saved


@settings(max_examples=200, deadline=None)
@given(_TEXTS, st.data())
def test_ropes_cut_and_join(text, data):
    saved, fill_middle.LEAF = fill_middle.LEAF, 4
    try:
        whole = fill_middle.rope(text)
        for _ in range(5):
            n = data.draw(st.integers(0, whole.units))
            a, b = fill_middle.cut_units(whole, n)
            assert str(a) == "".join(UNITS.findall(text)[:n]) and str(a) + str(b) == text
            whole = fill_middle.join(a, b)
            k = data.draw(st.integers(0, len(text)))
            assert str(fill_middle.cut_chars(whole, k)[0]) == text[:k]
        check(whole)
    finally:
        fill_middle.LEAF = saved


def check(node):
    """Cached counts are those of the text below, and heights of neighbours differ by two at most."""
    if node.left is not None:
        check(node.left), check(node.right)
        assert abs(node.left.height - node.right.height) <= 2
    assert node.chars == len(str(node))
    assert node.units == sum(len(UNITS.findall(x.text)) for x in leaves(node))


def leaves(node):
    return [node] if node.left is None else leaves(node.left) + leaves(node.right)


def test_sentinels_rate_and_form_are_parameters():
    marks = fill_middle.Sentinels("[[p", "[[s", "[[m")
    text = "a\nb\n<P>c\nd"
    for doc in range(50):
        got = fill_middle.rearranged(doc, text, 3, 60, 10, marks)
        assert fill_middle.restored(got.output, got.form, marks) == text
        assert (got.form == "plain") == (fill_middle.numbers(doc, 3)[2] % 100 >= 60)


def test_a_very_long_text_of_many_and_of_one_line():
    for text in ("x y\n" * 200_000, "x" * 3_000_000):
        got = fill_middle.rearranged(1, text)
        assert fill_middle.restored(got.output, got.form) == text and got.units == len(UNITS.findall(text))


def lloyd(rows, entries=256, rounds=4, parts=4):
    """Plain Lloyd's rounds over Python's whole numbers: (vec_id, code, error, label) and the codebooks."""
    kept = [(i, [math.floor(x * 1024) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for _, v, _ in kept:
                mine[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            for e, xs in mine.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, v, label in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    return out, books


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, error long, code string")


def test_codes_are_those_of_plain_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(0, 0.2, 16))], int(i % 3) if i % 7 else None) for i in rng.permutation(300)]
    rows += [(5, [0.5] * 16, 1), (1, None, 1), (2, [0.1] * 15 + [None], 2), (3, [float("nan")] + [0.0] * 15, 0), (4, [float("-inf")] * 16, 0), (None, [0.25] * 16, None), (6, [], 1)]
    rows += [(1000 + k, [0.125, -0.125] * 8, 2) for k in range(150)]  # copies, half way between entries
    expected, books = lloyd(rows, 24)
    got = vector_codes.encode(_vectors(spark, [(*r, 1, "x") for r in rows]), entries=24)
    assert got.books.tolist() == books
    assert Counter((r.vec_id, r.code, r.error, r.label) for r in got.rows.collect()) == Counter(expected)
    assert got.scans[0] == 4 * len(expected) and sum(got.scans[1:]) < 4 * len(expected) * 4  # bounds spare scans
    totals = Counter()
    for _, _, error, label in expected:
        totals[label] += error
    full = vector_codes.report(_vectors(spark, [(*r, 1, "x") for r in rows]), entries=24).collect()
    assert Counter((r.vec_id, r.code, r.label_error) for r in full) == Counter((i, c, totals[label]) for i, c, _, label in expected)
    assert {r.codebooks_sha256 for r in full} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}


def test_bounds_never_change_an_assignment():
    """Rounds with bounds against rounds of full scans, on points full of ties."""
    rng = np.random.default_rng(1)
    for size in (3, 50, 10**6):
        x = rng.integers(-size, size, (4000, 4))
        entries, held, moved = x[:32].copy(), None, None
        for k in range(6):
            held, scans = vector_codes.reassigned(x, entries, held, moved)
            best, first, second = vector_codes.scanned(x, entries)
            assert (held.entry == best).all()
            assert (held.upper >= np.sqrt(first)).all() and (held.lower <= np.sqrt(second)).all()
            assert k == 0 or size < 50 or scans < len(x)
            sums = np.array([x[best == e].sum(0) // max(1, (best == e).sum()) if (best == e).any() else entries[e] for e in range(32)])
            moved, entries = vector_codes.moves(entries, sums), sums


def test_squared_distances_are_exact_beyond_doubles():
    big = vector_codes.limit_for(16)
    x = np.array([[big] * 16, [-big + 1] * 16], np.int64)
    assert vector_codes.squared(x, x).tolist() == [[0, 16 * (2 * big - 1) ** 2], [16 * (2 * big - 1) ** 2, 0]]


def test_vectors_of_few_rows_other_lengths_and_great_size(spark):
    assert vector_codes.report(_vectors(spark, [])).collect() == []
    assert vector_codes.report(_vectors(spark, [(1, None, 1, 1, "x")])).collect() == []
    got = vector_codes.report(_vectors(spark, [(1, [1.0] * 6, 1, 1, "x"), (2, [1e30] * 6, 1, 1, "x"), (3, [2.0] * 8, 1, 1, "x")])).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == [(1, "00000000", 0), (2, "01010100", 0)]  # the last part is filled up


def test_a_decoded_vector_is_near_the_coded_one(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = vector_codes.encode(rows)
    of = {r.vec_id: np.array(r.embedding) for r in rows.collect()}
    off = [np.linalg.norm(vector_codes.decode(r.code, got.books) - of[r.vec_id]) / np.linalg.norm(of[r.vec_id]) for r in got.rows.collect()]
    assert np.mean(off) < 0.6 and len(off) == len(of)


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    held = got[got.held_out]
    assert len(held) > 1500 and (held.lang == held.lang_pred).mean() > 0.995
    assert got.score.between(0, 1).all()


def grams_of(word, order):
    framed = f"\x02{word}\x02" if order > 1 else word
    return [framed[i : i + order] for i in range(len(framed) - order + 1)]


def brute(rows):
    """(lang, score) of each row, by the formula."""
    learnt = [r for r in rows if r.lang is not None and zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5]
    words, grams = defaultdict(Counter), {k: defaultdict(Counter) for k in language_id.ORDERS}
    split = lambda t: [w for w in re.findall(r"[^\W\d_]+", (t or "").lower()) if any(c.isalpha() for c in w)]
    langs = sorted({r.lang for r in learnt})
    for r in learnt:
        for w in split(r.text):
            words[w][r.lang] += 1
            for k in grams:
                for g in grams_of(w, k):
                    grams[k][g][r.lang] += 1

    def logs(counts, most=10**9):
        totals = np.array([sum(c[x] for c in counts.values()) for x in langs], float)
        known = {w: c for w, c in counts.items() if sum(c.values()) >= 2 and len(w) <= most}
        return {w: np.log([c[x] + 0.1 for x in langs]) - np.log(totals + 0.1 * len(known)) for w, c in known.items()}

    of_words, of_grams = logs(words, language_id.LONG_WORD), {k: logs(c) for k, c in grams.items()}
    n = Counter(r.lang for r in learnt)
    for r in rows:
        found = split(r.text)
        if not found or not langs:
            yield r.doc_id, "und", 0.0
            continue
        sums = np.log([n[x] / len(learnt) for x in langs])
        for w in found:
            if w in of_words:
                sums = sums + of_words[w] / 4
                continue
            for level, k in enumerate(language_id.ORDERS, 1):
                hits = [of_grams[k][g] for g in grams_of(w, k) if g in of_grams[k]]
                if hits:
                    sums = sums + 0.6**level * np.mean(hits, axis=0) / 4
                    break
        p = np.exp(sums - sums.max())
        yield r.doc_id, langs[int(np.argmax(sums))], 1 / p.sum()


@pytest.mark.parametrize("name", ["odd_docs", "sample_docs", "no_docs"])
def test_languages_equal_the_formula(request, name):
    docs = request.getfixturevalue(name)
    expected = sorted(brute(docs.select("doc_id", "text", "lang").collect()), key=str)
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs).collect()), key=str)
    assert len(got) == len(expected)
    for a, b in zip(sorted(got, key=lambda r: (str(r[0]), r[1], r[2])), sorted(expected, key=lambda r: (str(r[0]), r[1], r[2])), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-3)


def test_inputs_of_a_prediction_are_texts_alone(spark):
    """Other langs, sources and ids of held-out rows change nothing; texts without a letter are und."""
    rows = [(k, "the cat and the dog" if k % 2 else "der hund und die katze", "en" if k % 2 else "de", "a") for k in range(60)]
    odd = [(1000, "12 ½ ² -", "en", "a"), (1001, None, "en", "a"), (1002, "the the", None, None)]
    of = lambda extra: {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, score string")).collect()}
    held = [k for k in range(2000, 2100) if zlib.crc32(str(k).encode()) % 5 == 0][:2]
    got = of(odd + [(held[0], "the dog", "de", "zz"), (held[1], "the dog", None, None)])
    assert got[1000] == got[1001] == ("und", 0.0) and got[1002][0] == "en"
    assert got[held[0]] == got[held[1]] and got[held[0]][0] == "en"
    assert all(got[k][0] == lang for k, _, lang, _ in rows)
    nothing = spark.createDataFrame([(1, "the cat", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in language_id.identify(nothing).collect()] == [("und", 0.0)]


def test_unseen_words_fall_back_and_forgetting_changes_nothing(spark, sample_docs, monkeypatch):
    model = language_id.learn(sample_docs)
    scorer = language_id.Scorer(model)
    texts = [r.text for r in sample_docs.select("text").collect()]
    first = [scorer(t) for t in texts]
    monkeypatch.setattr(language_id, "REMEMBERED", 3)
    small = language_id.Scorer(model)
    assert [small(t) for t in texts] == first
    assert len(small) < len(scorer)
    assert scorer("zzzzqqqq " * 50)[0] in model.languages
