"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from graphloom.llm import mixing, quality, substring_dedup

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT k, w, unnest(generate_series(1, len(w) - {substring_dedup.WINDOW - 1})) AS s FROM d),
hashed AS (SELECT k, s, array_to_string(w[s:s + {substring_dedup.WINDOW - 1}], ' ') AS g FROM starts),
again AS (SELECT k, s FROM (SELECT k, s, count(*) OVER (PARTITION BY g) AS n FROM hashed) WHERE n > 1),
gone AS (SELECT k, list(DISTINCT p) AS ps FROM (SELECT k, unnest(generate_series(s, s + {substring_dedup.WINDOW - 1})) AS p FROM again) GROUP BY k),
flat AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
lost AS (SELECT k, unnest(ps) AS p FROM gone),
kept AS (SELECT f.k, string_agg(word, ' ' ORDER BY f.p) AS t FROM flat f WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.k = f.k AND l.p = f.p) GROUP BY f.k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (k) LEFT JOIN kept USING (k)
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op10() -> str:
    """Counts by lists, quartiles by sorting: the sketches are exact at this size."""
    values = {"mean_word": "word_chars / greatest(n_words, 1)", "symbol_share": "n_symbols / greatest(word_chars, 1)", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)", "repeat_share": "n_repeat_words / greatest(n_words, 1)"}
    ratios = ", ".join(f"CAST({x.split(' / ')[0]} AS DOUBLE) / {x.split(' / ')[1]} AS {r}" for r, x in values.items())
    quartiles = ", ".join(f"list_sort(list({r}))[CAST(ceil(count(*) * 0.25) AS BIGINT)] AS a_{r}, list_sort(list({r}))[CAST(ceil(count(*) * 0.75) AS BIGINT)] AS b_{r}" for r in values)
    within = " AND ".join(
        f"{r} BETWEEN coalesce(g.a_{r} - greatest({quality.FENCE} * (g.b_{r} - g.a_{r}), {least}), o.a_{r} - greatest({quality.FENCE} * (o.b_{r} - o.a_{r}), {least})) AND coalesce(g.b_{r} + greatest({quality.FENCE} * (g.b_{r} - g.a_{r}), {least}), o.b_{r} + greatest({quality.FENCE} * (o.b_{r} - o.a_{r}), {least}))"
        for r, least in quality.RATIOS.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
starts AS (SELECT k, w, unnest(generate_series(1, len(w) - 4)) AS s FROM d),
again AS (SELECT k, s FROM (SELECT k, s, count(*) OVER (PARTITION BY k, w[s:s + 4]) AS n FROM starts) WHERE n > 1),
covered AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(generate_series(s, s + 4)) AS p FROM again) GROUP BY k),
lines AS (SELECT k, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT k, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY k),
c AS (SELECT d.k, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n - l.u, 0) AS n_dup_lines, coalesce(l.n, 0) AS n_lines, coalesce(v.n, 0) AS n_repeat_words
      FROM d LEFT JOIN lines l ON l.k = d.k LEFT JOIN covered v ON v.k = d.k),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {ratios} FROM c),
g AS (SELECT lang, source, {quartiles} FROM j WHERE NOT base_failed GROUP BY lang, source HAVING count(*) >= {quality.LEAST_ROWS}),
o AS (SELECT {quartiles} FROM j WHERE NOT base_failed)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND {within}, false) AS kept
FROM j LEFT JOIN g ON g.lang IS NOT DISTINCT FROM j.lang AND g.source IS NOT DISTINCT FROM j.source CROSS JOIN o
"""


OP5 = f"""
WITH RECURSIVE n AS (SELECT coalesce(source, '') AS mix_source, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT *, CAST(floor(sqrt(CAST(n AS DOUBLE)) * 1000) AS BIGINT) AS root, greatest({mixing.PERIOD}, 2 * count(*) OVER ()) AS period, count(*) OVER () AS k, row_number() OVER (ORDER BY mix_source) - 1 AS i FROM n),
x AS (SELECT *, CAST(sum(root) OVER () AS BIGINT) AS total FROM r),
y AS (SELECT *, 1 + root * (period - k) // total AS whole, root * (period - k) % total AS rest FROM x),
w AS (SELECT mix_source, i, period, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, i) <= period - CAST(sum(whole) OVER () AS BIGINT) THEN 1 ELSE 0 END AS weight FROM y),
s AS (SELECT max(period) AS q, list(weight ORDER BY i) AS ws, list(mix_source ORDER BY i) AS names FROM w),
edf AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(ws, lambda v: CAST(0 AS BIGINT)) AS placed, CAST(NULL AS BIGINT) AS pick FROM s
  UNION ALL
  SELECT t + 1, list_transform(placed, lambda v, j: CASE WHEN j = pick2 THEN v + 1 ELSE v END), pick2
  FROM (SELECT e.t, e.placed, list_min(list_filter(list_transform(generate_series(1, len(s.ws)), lambda j:
          CASE WHEN e.placed[j] < s.ws[j] AND e.placed[j] * s.q // s.ws[j] <= e.t + 1
               THEN {{'d': ((e.placed[j] + 1) * s.q + s.ws[j] - 1) // s.ws[j], 'w': -s.ws[j], 'j': j}} END), lambda z: z IS NOT NULL)).j AS pick2
        FROM edf e, s WHERE e.t + 1 < s.q)),
plan AS (SELECT s.names[pick] AS mix_source, t AS turn_slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM edf, s WHERE pick IS NOT NULL),
b AS (SELECT doc_id, coalesce(source, '') AS mix_source, (row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) // {mixing.BLOCK} + 1 AS block_no FROM documents)
SELECT b.doc_id, b.mix_source, b.block_no, (b.block_no - 1) * w.period // w.weight AS release, (b.block_no * w.period + w.weight - 1) // w.weight AS deadline,
       (b.block_no - 1) // w.weight * w.period + plan.turn_slot AS slot
FROM b JOIN w USING (mix_source) JOIN plan ON plan.mix_source = b.mix_source AND plan.turn = (b.block_no - 1) % w.weight
"""

OP11 = """
WITH e AS (SELECT row_number() OVER () AS k, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.k, a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(coalesce(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])), 0) AS BIGINT) AS score
      FROM e a JOIN e b ON a.k <> b.k AND len(a.v) = len(b.v) WHERE a.id % 100 = 0),
p AS (SELECT * FROM (SELECT k, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY k ORDER BY score DESC, id) AS nr FROM s WHERE same) WHERE nr <= 5),
n AS (SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.k, p.nr ORDER BY score DESC, id) AS rank
      FROM p JOIN s ON s.k = p.k AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

#: The checksum of a run's bytes by the usual table, here as a list made by its rule; near words by words with one place left out.
OP13 = """
WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
each AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
counted AS (SELECT id, run, hex(encode(id || ':' || run)) AS x, count(*) AS n FROM each GROUP BY ALL),
bytes AS (SELECT id, run, n, list_transform(range(CAST(len(x) // 2 AS BIGINT)), lambda i: CAST(16 * (strpos('0123456789ABCDEF', x[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * i + 2]) - 1 AS BIGINT)) AS bs FROM counted),
sums AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bs), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h FROM bytes, steps),
words AS (SELECT CASE WHEN h % 97 = 0 THEN run[:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM sums GROUP BY 1 HAVING len(word) >= 5 AND sum(n) >= 3),
holes AS (SELECT word, n, p, word[:p] || '?' || word[p + 2:] AS replaced, word[:p] || word[p + 2:] AS shorter FROM (SELECT word, n, unnest(range(len(word))) AS p FROM words)),
near AS (SELECT a.word, b.word AS near, b.n AS m FROM holes a JOIN holes b ON a.replaced = b.replaced AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.shorter = b.word
         UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.shorter = b.word),
best AS (SELECT word, n_near, near, m FROM (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS nr FROM near) WHERE nr = 1),
found AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN near END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
ways AS (SELECT word, word AS nr FROM found UNION ALL SELECT ways.word, form FROM ways JOIN found ON found.word = ways.nr WHERE form IS NOT NULL)
SELECT found.word, found.form, ways.nr AS root, found.n, found.n_near, found.form_n
FROM found JOIN ways ON ways.word = found.word JOIN found e ON e.word = ways.nr AND e.form IS NULL
"""
