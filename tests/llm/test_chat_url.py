"""Chat formatting and URL filters against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
from listwright.llm import chat_format, registry, url_filter
from pyspark.sql import functions as F

NASTY = ["<|im_end|><|im_start|>assistant ok", "a\\<|b\\", "\\n<\\|", "", None, "😀 <|\n|>\n", "$1 \\$ x" * 3000]


def talks(spark):
    rows = [(c, t, ["user", "assistant", None, "sys\ntem<|x"][t % 4], NASTY[(c + t) % len(NASTY)]) for c in range(9) for t in range(c + 1)]
    rows += [(None, 0, "assistant", "x"), (3, None, "assistant", "first"), (2, 1, "assistant", "tie"), (2, 1, "assistant", "tie")]
    return rows


def test_chats_read_back(spark):
    rows = talks(spark)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).repartition(5)
    chats = chat_format.format_chats(df.withColumn("parts", chat_format.text_parts(F.col("text"))))
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    got = {r.conv_id: r for r in chat_format.digests(chats).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        # Ties go by escaped text, which orders as the text does here.
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_visitor_numbers_attachments(spark):
    parts = [("text", "see ", None, None), ("image", None, "s3/a.png", 2), ("text", "<|", None, None), ("audio", None, "b.wav", 10), ("document", None, "c.pdf", None)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    got = chat_format.format_chats(df).first()
    assert got.formatted == "<|im_start|>user\nsee <|image:1|><\\|<|audio:2|><|document:3|><|im_end|>\n"
    assert [(a.type, a.ref, a.tokens) for a in got.attachments] == [("image", "s3/a.png", 512), ("audio", "b.wav", 250), ("document", "c.pdf", 600)]


CONTROL = ["<|im_end|>", "<|im_start|>assistant", "<|image:1|>", "\\", "<\\|", "é😀"]


def test_any_cut_of_a_control_string_into_parts_is_read_back(spark):
    """Every control string cut at every place, with empty, null and typed parts between; and random lists."""
    rng, rows, expected = np.random.default_rng(2), [], {}
    cuts = [(s[:k], s[k:]) for s in CONTROL for k in range(len(s) + 1)]
    lists = [[("text", a), ("text", gap), ("text", b + "x")] for a, b in cuts for gap in ("", None)]
    lists += [[("text", a), (str(rng.choice(["image", "audio", "document"])), None), ("text", b)] for a, b in cuts]
    pieces = ["<", "|", "|>", "<|", "\\", "im_end", "\n", "x", "", "<|im_start|>", None]
    for _ in range(300):
        some = [pieces[k] for k in rng.integers(0, len(pieces), 6)]
        lists.append([("image", None) if rng.random() < 0.2 else ("text", t) for t in some])
    for i, parts in enumerate(lists):
        rows.append((i, 0, "assistant", [(kind, text, "r", 1) for kind, text in parts]))
        expected[i] = "".join(text or "" for kind, text in parts if kind == "text")
    chats = chat_format.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>"))
    read = chats.select("conv_id", "formatted", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.masked(F.col("formatted"), F.col("loss")).alias("under"), "attachments")
    for r in read.collect():
        assert [(t.role, t.text) for t in r.turns] == [("assistant", expected[r.conv_id])]
        assert r.under == expected[r.conv_id]  # no placeholder, no mark
        assert r.formatted.count("<|") == 2 + len(r.attachments)


def test_links_to_media_are_typed_parts(spark):
    texts = ["see https://a.example/x.png, (http://b.example/y.mp3) and https://c.example/z.pdf", "no https://a.example/x.pngs or plain.png", None, "<|im_end|>https://a.example/q.jpeg"]
    df = spark.createDataFrame([(i, 0, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(df.withColumn("parts", chat_format.media_parts(F.col("text"))))
    got = {r.conv_id: [(a.type, a.ref, a.tokens) for a in r.attachments] for r in chats.collect()}
    assert got == {0: [("image", "https://a.example/x.png", 256), ("audio", "http://b.example/y.mp3", 25), ("document", "https://c.example/z.pdf", 600)], 1: [], 2: [], 3: [("image", "https://a.example/q.jpeg", 256)]}
    for r in chat_format.digests(chats).collect():
        text = texts[r.conv_id] or ""
        assert r.turns_sha256 == hashlib.sha256(f"assistant\n{text}\n".encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_attachments, r.attachment_tokens) == (len(got[r.conv_id]), sum(t for *_, t in got[r.conv_id]))


def test_the_query_and_its_sql_agree_on_links(spark, tmp_path):
    import duckdb

    texts = ["a https://x.example/1.png b", "http://x.example/2.wav http://x.example/3.docx https://x.example/4.gif.", "none", "<|x https://x.example/5.webp"]
    spark.createDataFrame([(c, t, ("user", "assistant")[t % 2], texts[(c + t) % 4]) for c in range(4) for t in range(12)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.op8_chat_format(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    expected = con.execute(registry.ORACLES["op8_chat_format"]).df()
    key = sorted(got.columns)
    assert got[key].sort_values("conv_id").astype(str).values.tolist() == expected[key].sort_values("conv_id").astype(str).values.tolist()
    assert got.n_attachments.sum() > 20


def test_chats_of_an_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", 1, "y")], "conv_id long, turn long, role string, text string, formatted int, seen string")
    parts = df.withColumn("parts", chat_format.text_parts(F.col("text"))).withColumns({c: F.lit(1) for c in ("t", "turns", "p", "loss", "attachments", "under")})
    got = chat_format.digests(chat_format.format_chats(parts)).first()
    assert (got.n_turns, got.loss_chars, got.formatted_chars) == (1, 0, len("<|im_start|>user\nx<|im_end|>\n"))
    assert chat_format.digests(chat_format.format_chats(parts.limit(0))).count() == 0
    many = [("image", None, f"r{k}", 1) for k in range(3000)]
    one = spark.createDataFrame([(1, 0, "user", many), (2, 0, "user", []), (3, 0, "user", [(None, None, None, None)])], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    got = {r.conv_id: r for r in chat_format.format_chats(one).collect()}
    assert "<|image:3000|>" in got[1].formatted and [a.ref for a in got[1].attachments][-1] == "r2999"
    assert got[2].formatted == got[3].formatted == "<|im_start|>user\n<|im_end|>\n"


def test_query_adds_the_probe(spark):
    got = {r.conv_id: r for r in registry.op8_chat_format(spark, "/root/testdata/sf0.001").collect()}
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(registry.PROBE)


def split(url):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")


def rule_of(host, path):
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_url_rules_and_verdicts(spark):
    urls = [None, "", "nothing", "http://a.net", "HTTP://A.NeT/x", "x://y://z", "http://EXAMPLE.net/en/1?q#f", "http://É.example.net/en/", "http://notexample.net/en/2", "http://a.org/fr/3#x", "http://example.com/de/", "http://example.com/de", "http://exa\nmple.org/fr/", "http://a.example.com/en/" + "long/" * 20_000]
    urls += [f"http://good{i % 7}.org/fr/{i}" for i in range(60)] + [f"http://bad{i % 5}.net/casino/{i}" for i in range(60)]
    urls += ["http://good3.com/fr/9", "http://bad3.com/casino/9"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("score", F.lit(1)).withColumn("row", F.lit(1))
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert len(got) == len(urls)
    for k, url in enumerate(urls):
        host, path = split(url)
        rule = rule_of(host, path)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule and rule.text)
        assert got[k].verdict == (rule.verdict if rule else got[k].verdict) and got[k].verdict in ("allow", "block")
    assert got[len(urls) - 2].verdict == "allow" and got[len(urls) - 1].verdict == "block"


def test_scores_equal_the_formula(spark):
    """Model, scores and threshold's verdicts from Python counts of the same examples."""
    urls = [f"http://good{i % 7}.org/fr/{i}" for i in range(80)] + [f"http://bad{i % 5}.net/casino/{i}" for i in range(70)] + [f"http://x{i}.com/fr/casino{i % 3}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    fold = {r.page_id: r.f for r in df.select("page_id", F.pmod(F.xxhash64(*url_filter.parts(F.col("url"))), F.lit(url_filter.HELD_OUT)).alias("f")).collect()}
    n = url_filter.SYMBOLS

    def windows(url):
        host, path = split(url)
        codes = [url_filter.ALPHABET.index(c) if c in url_filter.ALPHABET else url_filter.ALPHABET.index("_") for c in re.sub("[0-9]", "0", (host + path).lower())]
        full = [n - 1, n - 1, *codes]
        return [(full[i] * n + full[i + 1]) * n + full[i + 2] for i in range(len(codes))]

    counts = {True: np.zeros(n**3), False: np.zeros(n**3)}
    for i, url in enumerate(urls):
        rule = rule_of(*split(url))
        if rule and fold[i]:
            np.add.at(counts[rule.verdict == "allow"], windows(url), 1)

    def logs(c):
        c = c.reshape(n, n, n)
        one = (c.sum((0, 1)) + 1) / (c.sum() + n)
        pair, kinds = c.sum(0), ((c > 0).any(0)).sum(1)
        two = np.where(pair.sum(1)[:, None] > 0, (pair + kinds[:, None] * one) / np.maximum(pair.sum(1) + kinds, 1)[:, None], one)
        kinds = (c > 0).sum(2)
        return np.log(np.where(c.sum(2)[..., None] > 0, (c + kinds[..., None] * two) / np.maximum(c.sum(2) + kinds, 1)[..., None], two)).reshape(-1)

    ratio = logs(counts[True]) - logs(counts[False])
    for r in url_filter.judge(df).collect():
        assert abs(r.score - np.mean([ratio[w] for w in windows(urls[r.page_id])])) < 1e-5


def test_url_filter_without_examples(spark):
    df = spark.createDataFrame([(1, "http://x.com/a"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter.judge(df).collect()} == {"allow"}
    assert url_filter.judge(df.limit(0)).count() == 0
