"""SQL for the queries that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, (VALUES (0), (1), (2)) AS v(k) WHERE c > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (length(t) - length(replace(t, '!', ''))) AS n_exclaims,
    length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS n_letters, len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
f AS (SELECT *, (
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines THEN 4 ELSE 0 END + CASE WHEN 100 * n_symbols > 20 * n_words THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 16 ELSE 0 END + CASE WHEN 100 * n_letters < 50 * word_chars THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_exclaims > 30 * n_words THEN 64 ELSE 0 END)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures, 'v2' AS policy,
  CASE failures WHEN 1 THEN 'too_short' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'repeated_lines' WHEN 8 THEN 'symbols' WHEN 16 THEN 'word_length' WHEN 32 THEN 'too_few_letters' WHEN 64 THEN 'shouting' END AS only_failure
FROM f
"""

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20))),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM windows, (SELECT unnest(range(20)) AS k) WHERE r > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM shared JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.v FROM reached r JOIN both_ways l ON r.b = l.u WHERE l.v < r.a OR l.v > r.a),
least AS (SELECT a, min(b) AS m FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m AS component_id FROM d JOIN least ON a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED_SEARCH = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
lengths AS (SELECT doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term, docs),
adds AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS a FROM tf JOIN weights USING (term) JOIN lengths USING (doc_id), whole),
scores AS (SELECT item_id, doc_id, sum(a)::BIGINT AS score FROM q JOIN adds USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""

#: In hex, a whole character as UTF-8 has them, or else one byte.
_CHARACTER = "[0-7].|(?:C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|(?:E[1-9A-CEF])[89AB].[89AB].|ED[89].[89AB].|F0[9AB].[89AB].[89AB].|F[1-3][89AB].[89AB].[89AB].|F48.[89AB].[89AB].|.."

SUFFIX_DEDUP = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 800)) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800))),
edges AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS step FROM windows WHERE c > 1),
numbered AS (SELECT doc_id, i, sum(CASE WHEN step > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY doc_id, run),
cuts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
parts AS (SELECT doc_id, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS t, sum(b - a) AS n, count(*) AS k, max(b) AS z FROM cuts JOIN d USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, length(h) // 2 AS size, n, k, coalesce(t, '') || substring(h, 2 * coalesce(z, 0) + 1) AS r FROM d LEFT JOIN parts USING (doc_id))
SELECT doc_id, size::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(unhex(r)) AS kept_sha256,
  decode(unhex(array_to_string(list_filter(regexp_extract_all(r, '{_CHARACTER}'), lambda x: length(x) > 2 OR x < '8'), ''))) AS text
FROM kept
"""
