"""SQL for the operators whose results SQL can express exactly, for DuckDB."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP9 = rf"""
WITH words AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
lengths AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, length(unnest(w)) AS c FROM words),
sizes AS (SELECT unnest([5, 8, 13, 20]) AS k, unnest([0.4, 0.3, 0.25, 0.2]) AS most),
wins AS MATERIALIZED (
  SELECT doc_id, k, i, md5(array_to_string(list_slice(w, i, i + k - 1), ' ')) AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, sizes WHERE len(w) >= k)),
twice AS (SELECT doc_id, k, s FROM wins GROUP BY ALL HAVING count(*) > 1),
inside AS (SELECT DISTINCT doc_id, k, unnest(range(i, i + k)) AS p FROM wins JOIN twice USING (doc_id, k, s)),
cov AS (SELECT doc_id, k, count(*) AS n, sum(c) AS chars FROM inside JOIN lengths USING (doc_id, p) GROUP BY ALL),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM words),
dup AS (
  SELECT doc_id, sum(n - 1) AS n, sum((n - 1) * length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g'))) AS chars
  FROM (SELECT doc_id, l, count(*) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY ALL)
  GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w) AS nw, length(array_to_string(w, '')) AS chars, text,
    coalesce((SELECT n FROM cov WHERE cov.doc_id = words.doc_id AND k = 8), 0) AS rep
  FROM words),
failed AS (
  SELECT DISTINCT doc_id FROM cov JOIN sizes USING (k) JOIN base USING (doc_id)
  WHERE CAST(cov.chars AS DOUBLE) / greatest(base.chars, 1) > most
  UNION SELECT doc_id FROM dup JOIN base USING (doc_id) WHERE CAST(dup.chars AS DOUBLE) / greatest(base.chars, 1) > 0.3
  UNION SELECT doc_id FROM base WHERE nw < 20 OR 100 * rep > 30 * nw)
SELECT doc_id, CAST(nw AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce((SELECT n FROM dup WHERE dup.doc_id = base.doc_id), 0) AS BIGINT) AS n_dup_lines,
  CAST(rep AS BIGINT) AS n_repeat_words,
  nw < 20 OR 100 * rep > 30 * nw AS base_failed,
  doc_id NOT IN (SELECT doc_id FROM failed) AS kept
FROM base
"""

_ITEM_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP2 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
wins AS MATERIALIZED (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
dw AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS MATERIALIZED (SELECT dw.doc_id, dw.i, dw.n, wins.item_id FROM dw JOIN wins ON dw.n = wins.n AND dw.s = wins.s),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
wins AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT s, min(doc_id) AS f FROM wins GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
  FROM wins JOIN firsts USING (s) WHERE f < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n
  FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP6 = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
tok AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 3), ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
freq AS (SELECT s, count(*) AS c FROM tok GROUP BY s),
ranked AS (
  SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY c, s) AS r
  FROM tok JOIN freq USING (s) JOIN sizes USING (doc_id)),
pre AS MATERIALIZED (SELECT doc_id, s FROM ranked WHERE r <= n - CAST(ceil(85 * n / 100.0) AS BIGINT) + 1),
cand AS MATERIALIZED (
  SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM pre a JOIN pre b ON a.s = b.s AND a.doc_id < b.doc_id),
inter AS (
  SELECT x, y, count(*) AS c FROM cand JOIN tok a ON a.doc_id = x JOIN tok b ON b.doc_id = y AND b.s = a.s GROUP BY x, y),
links AS MATERIALIZED (
  SELECT x, y FROM inter JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x AS a, y AS b FROM both_ways UNION SELECT a, y FROM reach JOIN both_ways ON b = x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles,
  least(d.doc_id, coalesce((SELECT min(b) FROM reach WHERE a = d.doc_id), d.doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id)
"""

# crc32 over the bytes of a distinct word: the table of 256 remainders, then one step a byte.
OP11 = r"""
WITH remainders AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) AS c
        FROM range(256) r(i))),
words AS MATERIALIZED (
  SELECT 0 AS kind, doc_id, {WORDS} AS w FROM documents
  UNION ALL SELECT 1, NULL, {WORDS} FROM benchmark),
used AS MATERIALIZED (SELECT kind, doc_id, unnest(w) AS word FROM words),
types AS MATERIALIZED (SELECT DISTINCT word, hex(encode(word)) AS h FROM used),
buckets AS MATERIALIZED (
  SELECT word, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(0, CAST(length(h) // 2 AS BIGINT)),
      lambda j: CAST('0x' || substr(h, CAST(2 * j + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
  FROM types, remainders),
counts AS MATERIALIZED (
  SELECT b, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t
  FROM used JOIN buckets USING (word) GROUP BY b),
gains AS MATERIALIZED (
  SELECT b, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM counts) + 10000 AS DOUBLE)
    / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM counts) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM counts),
weights AS (
  SELECT doc_id, count(*) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM used JOIN buckets USING (word) JOIN gains USING (b) WHERE kind = 0 GROUP BY doc_id),
scored AS MATERIALIZED (
  SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
      (CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE
    ))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (doc_id) WHERE kind = 0),
ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS all_n
  FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * all_n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranks ON scored.doc_id = ranks.doc_id
""".replace("{WORDS}", _ITEM_WORDS)

OP13 = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
found AS (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT same
    AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM found WHERE rank <= 3
"""

ORACLES = {"op2_decontaminate": OP2, "op5_substring_dedup": OP5, "op6_ngram_jaccard": OP6, "op9_quality_rules": OP9}
ORACLES |= {"op11_importance_resampling": OP11, "op13_hard_negatives": OP13}
