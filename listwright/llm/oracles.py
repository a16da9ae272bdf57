"""Oracle SQL (DuckDB) of the corpus queries that SQL can express.

The others are tested against brute force: fingerprints and seeded block choices need XXH64, packing
and scoring a tokenizer or trained models, secret spans the places of matches.
"""

from __future__ import annotations

from listwright.llm.chat_format import EXPANSION, MEDIA, MEDIA_LINK
from listwright.llm.quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS

EXACT_DEDUP = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

FILL_MIDDLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
  k AS (SELECT *, len(l) AS n, ('0x' || h[1:8])::BIGINT % (len(l) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(l) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
  p AS (SELECT *, array_to_string(l[1:least(a, b)], '') AS pre, array_to_string(l[least(a, b) + 1:greatest(a, b)], '') AS mid,
    array_to_string(l[greatest(a, b) + 1:], '') AS suf FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd's rounds without bounds: all distances, then floored means, one pair of steps a round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, p, any_value(v) AS v, min(d * {entries} + e) AS m FROM (
    SELECT r, x.p, x.v, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM x JOIN c{k} c ON x.p = c.p) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT p, e, list(s ORDER BY i) AS v FROM (
    SELECT p, (m % {entries})::BIGINT AS e, i, floor(sum(w)::DOUBLE / count(*))::BIGINT AS s
    FROM (SELECT p, m, unnest(v) AS w, unnest(range(len(v))) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e) n ON c.p = n.p AND c.e = n.e)""")
    last = rounds
    return f"""WITH q AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r,
    list_transform(embedding, lambda y: floor(y::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
  x AS MATERIALIZED (SELECT r, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM q, (SELECT unnest(range({parts})) AS p)),
  c0 AS MATERIALIZED (SELECT p, r AS e, v FROM x WHERE r < {entries}),
  {", ".join(steps)},
  b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{last}),
  f AS (SELECT r, string_agg(printf('%02x', (m % {entries})::INTEGER), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a{last} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM q JOIN f USING (r), b"""


def chat_format(probe: str) -> str:
    escaped = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
    role = r"replace(" + escaped.format("role") + r", chr(10), '\' || chr(10))"
    link, quote = MEDIA_LINK.replace("'", "''"), "'"
    kind = f"CASE WHEN regexp_matches(x, '\\.({MEDIA['image']})$') THEN 'image' WHEN regexp_matches(x, '\\.({MEDIA['audio']})$') THEN 'audio' ELSE 'document' END"
    each = "CASE " + " ".join(f"WHEN k = {quote}{name}{quote} THEN {n}" for name, n in EXPANSION.items()) + " END"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{probe}'), (-1, 1, 'assistant', '{probe}')),
  m AS (SELECT *, list_transform(regexp_extract_all(text, '{link}'), lambda x: {kind}) AS kinds FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length({role}) + 1 + length({escaped.format("text")}) + length('<|im_end|>') + 1
    + coalesce(list_sum(list_transform(kinds, lambda k, i: length('<|' || k || ':' || i || '|>'))), 0))::BIGINT AS formatted_chars,
  sum(len(kinds))::BIGINT AS n_attachments, coalesce(sum(list_sum(list_transform(kinds, lambda k: {each}))), 0)::BIGINT AS attachment_tokens
FROM m GROUP BY conv_id"""


def quality() -> str:
    """Counts per document, repeats by unnested windows, then the same threshold table."""
    ratio = {
        "mean_word_chars": ("word_chars", "n_words"),
        "symbol_ratio": ("n_symbols", "word_chars"),
        "stop_word_ratio": ("n_stop_words", "n_words"),
        "dup_line_ratio": ("n_dup_lines", "n_lines"),
        "pipe_word_ratio": ("n_pipe_words", "n_words"),
    }
    tests = []
    for rule in RULES:
        over, under = ratio[rule.measure]
        value = f"(CASE WHEN {under} > 0 THEN {over}::DOUBLE / {under} ELSE 0 END)"
        tests += [f"{value} >= {rule.low}"] * (rule.low is not None) + [f"{value} <= {rule.high}"] * (rule.high is not None)
    stop = ", ".join(f"'{w}', '{w.capitalize()}'" for w in dict.fromkeys(STOP_WORDS))
    word = r"[^\x20\x09-\x0D]+"
    return rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
  w AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM d WHERE len(words) >= 3),
  g AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS c FROM w),
  rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY r),
  m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines) AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda x: x IN ({stop}))) AS n_stop_words, len(list_filter(words, lambda x: x = '|')) AS n_pipe_words
    FROM d LEFT JOIN rep USING (r)),
  b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(tests)} AS kept FROM b"""
