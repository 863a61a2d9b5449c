"""The SQL each query must agree with, for DuckDB over the same tables."""

from __future__ import annotations

from lexiframe.registry.queries import CHAT_WINDOW, L, MAX_SAMPLES, MODEL_TOP_K, N_GIVEN, SCORED_TOP_K, SEED

ORACLES: dict[str, str] = {}

DIM = 64
STRIP = r"regexp_replace({0}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"


def words(text: str = "text") -> str:
    return (
        f"list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9'']+', ' ', 'g'), ' '), lambda x: x <> '')"
    )


def digest(*parts: str) -> str:
    """The checksum of the queries: first 32 bits of an md5, summed."""
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(sum(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)) AS BIGINT) AS checksum"


def ctes(top_k: str | int | None = 5000, length: int = L, min_freq: int = 5) -> str:
    """Tokens, counts, vocabulary, encoded documents and windows."""
    keep = "" if top_k is None else f"WHERE rk <= {top_k}"
    return f"""
WITH toks AS (SELECT doc_id, {words()} AS w FROM documents),
tokens AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM toks),
counts AS MATERIALIZED (SELECT token, count(*) AS count FROM tokens GROUP BY token),
ranked AS (SELECT token, count, row_number() OVER (ORDER BY count DESC, token) AS rk FROM counts WHERE count >= {min_freq}),
kept AS MATERIALIZED (SELECT CAST(rk + 3 AS INTEGER) AS id, token, count FROM ranked {keep}),
vocab AS (
  SELECT * FROM (VALUES (0, '<PAD>', CAST(NULL AS BIGINT)), (1, '<UNK>', NULL), (2, '<BOS>', NULL), (3, '<EOS>', NULL))
    AS s(id, token, count)
  UNION ALL SELECT id, token, count FROM kept),
found AS (SELECT t.doc_id, t.pos, coalesce(v.id, 1) AS id FROM tokens t LEFT JOIN kept v USING (token)),
lists AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM found GROUP BY doc_id),
encoded AS (
  SELECT d.doc_id, list_concat([2], coalesce(l.ids, []), [3]) AS ids
  FROM documents d LEFT JOIN lists l USING (doc_id)),
padded AS (SELECT doc_id, len(ids) AS n, list_concat(list_transform(range({length}), lambda x: 0), ids) AS p FROM encoded),
places AS (SELECT doc_id, p, unnest(range(1, n)) AS pos FROM padded),
wins AS (
  SELECT doc_id, CAST(pos AS INTEGER) AS pos, list_slice(p, pos + 1, pos + {length}) AS ctx, p[pos + {length} + 1] AS y
  FROM places)
"""


ROW_SUM = digest("doc_id", "pos", "y", "array_to_string(ctx, ' ')")
HASH = f"md5('{SEED}:' || doc_id || ':' || pos)"


# --- sources and sinks -------------------------------------------------------------

PARAGRAPHS = rf"""
WITH parts AS (SELECT lang, source, unnest(regexp_split_to_array(text, '\n\s*\n+')) AS part FROM documents),
paras AS (SELECT lang, source, {STRIP.format("part")} AS text FROM parts),
long AS (SELECT * FROM paras WHERE length(text) > 10)
"""

ORACLES["read_paragraphs"] = f"""{PARAGRAPHS}
SELECT md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n_chars, count(*) AS n_copies FROM long GROUP BY ALL"""

ORACLES["paragraphs_or_lines"] = rf"""{PARAGRAPHS},
enough AS (SELECT lang, source FROM long GROUP BY ALL HAVING count(*) >= 10),
lines AS (SELECT lang, source, unnest(string_split(text, chr(10))) AS line FROM documents),
docs AS (
  SELECT lang, source, text FROM long SEMI JOIN enough USING (lang, source)
  UNION ALL
  SELECT lang, source, t FROM (SELECT lang, source, {STRIP.format("line")} AS t FROM lines ANTI JOIN enough USING (lang, source))
  WHERE length(t) > 10)
SELECT lang, source, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars, {digest("text")} FROM docs GROUP BY ALL"""

ORACLES["read_lines"] = rf"""
WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
stripped AS (SELECT {STRIP.format("line")} AS t FROM lines)
SELECT md5(t) AS text_md5, count(*) AS n_copies FROM stripped WHERE length(t) >= 10 GROUP BY ALL"""

ORACLES["read_csv_texts"] = "SELECT md5(text) AS text_md5, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY ALL"

ORACLES["limit_docs"] = "SELECT doc_id, md5(text) AS text_md5 FROM documents ORDER BY doc_id LIMIT 100"

ORACLES["corpus_profile"] = """
SELECT count(text) AS n_docs, round_even(avg(length(text)), 0) AS avg_chars,
  CAST(min(length(text)) AS INTEGER) AS min_chars, CAST(max(length(text)) AS INTEGER) AS max_chars FROM documents"""

ORACLES["write_read_vocab"] = ctes() + "SELECT id, token, count FROM vocab"

ORACLES["write_read_tokenizer"] = (
    ctes() + "SELECT id, token, 0 AS pad_id, 1 AS unk_id, 2 AS bos_id, 3 AS eos_id, true AS lowercase FROM vocab"
)

SPLIT = f"""
, placed AS (SELECT *, row_number() OVER (ORDER BY {HASH}) AS place, count(*) OVER () AS total FROM wins),
split_rows AS (
  SELECT *, CASE WHEN place <= total - CAST(floor(total * 0.1) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM placed)
"""

ORACLES["dataset_metadata"] = f"""{ctes()}{SPLIT}
SELECT split, count(*) AS n_samples, CAST(max(len(ctx)) AS INTEGER) AS context_length,
  count(DISTINCT y) AS n_unique_targets, {ROW_SUM} FROM split_rows GROUP BY split"""

ORACLES["stored_metadata"] = f"""{ctes()}
SELECT count(*) AS n_samples, CAST(max(len(ctx)) AS BIGINT) AS context_length, count(DISTINCT y) AS n_unique_targets FROM wins"""

ORACLES["import_vocab_json"] = ORACLES["write_read_vocab"]

ORACLES["write_read_generations"] = f"""
WITH texts AS (SELECT text, lower(text) AS generated, unnest(range(2)) AS sample_idx FROM benchmark)
SELECT md5(text) AS prompt_md5, 'top_k' AS sampling, CAST(10 AS BIGINT) AS top_k, count(*) AS n_samples,
  {digest("sample_idx", "generated")}, (SELECT count(*) FROM texts) AS n_texts FROM texts GROUP BY text"""

WEIGHTED = "list_sum(list_transform(range(1, {d} + 1), lambda i: CAST({v}[i] AS DOUBLE) * i))"

ORACLES["read_text_embeddings"] = f"""
SELECT 'w' || vec_id AS token, CAST(len(embedding) AS INTEGER) AS dim,
  round({WEIGHTED.format(d=DIM, v="embedding")}, 4) AS weighted FROM embeddings"""

ORACLES["read_prompts"] = rf"""
WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark),
stripped AS (SELECT {STRIP.format("line")} AS prompt FROM lines)
SELECT prompt, count(*) AS n_copies FROM stripped WHERE length(prompt) > 0 GROUP BY prompt"""


def oov(source: str) -> str:
    return f"""SELECT CAST(sum(c.count) AS BIGINT) AS total_tokens,
  CAST(coalesce(sum(c.count) FILTER (WHERE k.id IS NULL), 0) AS BIGINT) AS oov_tokens,
  count(*) FILTER (WHERE k.id IS NULL) AS oov_types
FROM {source} c LEFT JOIN kept k USING (token)"""


FIRST_COUNTS = """
, first_docs AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100),
first_counts AS (SELECT token, count(*) AS count FROM tokens SEMI JOIN first_docs USING (doc_id) GROUP BY token)
"""

ORACLES["build_stats"] = f"""{ctes()}{FIRST_COUNTS}, o AS ({oov("first_counts")})
SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM kept) AS vocab_size,
  (SELECT CAST(sum(count) AS BIGINT) FROM counts) AS total_tokens, (SELECT count(*) FROM counts) AS unique_tokens,
  o.total_tokens AS oov_check_tokens, o.oov_tokens, round(o.oov_tokens / o.total_tokens * 100, 6) AS oov_rate, o.oov_types,
  5 AS min_freq, 5000 AS top_k, '<PAD> <UNK> <BOS> <EOS>' AS special_tokens,
  (SELECT string_agg(token, ' ' ORDER BY count DESC, token) FROM (
     SELECT c.token, c.count FROM first_counts c LEFT JOIN kept k USING (token) WHERE k.id IS NULL
     ORDER BY c.count DESC, c.token LIMIT 20)) AS sample_oov_words
FROM o"""

PROFILE = f"""
SELECT count(*) AS n_samples, CAST(max(len(ctx)) AS INTEGER) AS context_length,
  round(sum(len(list_filter(ctx, lambda x: x = 0))) / sum(len(ctx)), 8) AS padding_ratio,
  round(sum(len(list_filter(ctx, lambda x: x = 1))) / sum(len(ctx)), 8) AS unk_ratio_x,
  round(avg(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END), 8) AS unk_ratio_y,
  (SELECT count(*) FROM vocab) AS vocab_size,
  (SELECT count(*) FROM (SELECT DISTINCT ctx FROM wins)) AS n_unique_contexts,
  count(DISTINCT y) AS n_unique_targets,
  (SELECT string_agg(t.y || ':' || v.token || ':' || t.n, ' ' ORDER BY t.n DESC, t.y)
   FROM (SELECT y, count(*) AS n FROM wins GROUP BY y ORDER BY n DESC, y LIMIT 10) t JOIN vocab v ON v.id = t.y) AS top_targets
FROM wins"""

ORACLES["dataset_profile"] = ctes() + PROFILE

ORACLES["dataset_stats"] = f"""{ctes()}, profile AS ({PROFILE})
SELECT *, (SELECT count(*) FROM documents) AS n_documents, 5 AS min_freq, 5000 AS top_k, {SEED} AS seed FROM profile"""

# --- text and token IDs ------------------------------------------------------------

ORACLES["tokenize_text"] = ctes() + """
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM toks"""

ORACLES["tokenize_cased"] = """
WITH toks AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(text, '[^a-z0-9'']+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM documents)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM toks"""

ORACLES["chunk_text"] = """
WITH starts AS (
  SELECT doc_id, text, list_filter(range(0, greatest(length(text), 1), 900),
    lambda x: x = 0 OR (length(text) > 1000 AND length(text) - x >= 100)) AS s FROM documents),
rows AS (SELECT doc_id, text, unnest(s) AS start, generate_subscripts(s, 1) - 1 AS chunk FROM starts)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(start AS INTEGER) AS start,
  md5(substring(text, start + 1, 1000)) AS text_md5 FROM rows"""


def ids_summary(expression: str) -> str:
    return f"""{ctes()}, shaped AS (SELECT doc_id, {expression} AS s FROM encoded)
SELECT doc_id, CAST(len(s) AS INTEGER) AS n_ids, md5(array_to_string(s, ' ')) AS ids_md5 FROM shaped"""


ORACLES["encode"] = ids_summary("ids")
ORACLES["truncate"] = ids_summary("CASE WHEN len(ids) > 64 THEN list_concat(list_slice(ids, 1, 63), [3]) ELSE ids END")
ORACLES["pad"] = ids_summary("list_slice(list_concat(ids, list_transform(range(256), lambda x: 0)), 1, 256)")
ORACLES["left_pad"] = ids_summary(
    "list_slice(list_concat(list_transform(range(256), lambda x: 0), ids), len(ids) + 1, len(ids) + 256)"
)
ORACLES["decode"] = f"""{ctes()},
known AS (
  SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS t FROM tokens SEMI JOIN kept USING (token) GROUP BY doc_id),
texts AS (SELECT d.doc_id, coalesce(t, '') AS t FROM documents d LEFT JOIN known USING (doc_id))
SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5 FROM texts"""

# --- vocabulary --------------------------------------------------------------------

ORACLES["count_vocab"] = ctes() + "SELECT token, count FROM counts"
ORACLES["count_vocab_custom"] = """
WITH t AS (SELECT unnest(string_split(text, ' ')) AS token FROM documents)
SELECT token, count(*) AS count FROM t WHERE token <> '' GROUP BY token"""
ORACLES["build_vocab"] = ctes() + "SELECT token, count FROM kept"
ORACLES["assign_ids"] = ctes() + "SELECT id, token, count FROM vocab"
ORACLES["assign_ids_unlimited"] = ctes(None, min_freq=1) + "SELECT id, token, count FROM vocab"
COUNTS = f"""
WITH toks AS (SELECT {words()} AS w FROM documents),
counts AS MATERIALIZED (SELECT token, count(*) AS count FROM (SELECT unnest(w) AS token FROM toks) GROUP BY token),
kept AS MATERIALIZED (SELECT token, count FROM counts WHERE count >= 5 ORDER BY count DESC, token LIMIT 5000)
"""
ORACLES["in_vocab"] = COUNTS + "SELECT token, count FROM kept"
ORACLES["not_in_vocab"] = COUNTS + "SELECT c.token, c.count FROM counts c LEFT JOIN kept k USING (token) WHERE k.token IS NULL"
ORACLES["oov_stats"] = f"""{ctes()}, o AS ({oov("counts")})
SELECT total_tokens, oov_tokens, round(oov_tokens / total_tokens * 100, 6) AS oov_rate, oov_types FROM o"""
ORACLES["sample_oov_words"] = (
    ctes() + "SELECT token, count FROM counts ANTI JOIN kept USING (token) ORDER BY count DESC, token LIMIT 20"
)
ORACLES["oov_sample_docs"] = f"""{ctes()}{FIRST_COUNTS},
some_docs AS (SELECT doc_id FROM documents ORDER BY md5('{SEED}:' || doc_id) LIMIT 200),
some_counts AS (SELECT token, count(*) AS count FROM tokens SEMI JOIN some_docs USING (doc_id) GROUP BY token),
both_samples AS (
  SELECT 'first' AS sample, * FROM ({oov("first_counts")}) UNION ALL SELECT 'random', * FROM ({oov("some_counts")}))
SELECT sample, total_tokens, oov_tokens, round(oov_tokens / total_tokens * 100, 6) AS oov_rate, oov_types FROM both_samples"""

COVERAGE = """
, running AS (
  SELECT token, count, sum(count) OVER (ORDER BY count DESC, token) AS cum,
    row_number() OVER (ORDER BY count DESC, token) AS place, sum(count) OVER () AS total FROM counts),
cutoffs AS (
  SELECT target, min(place) AS place FROM running, (VALUES (50.0::DOUBLE), (80.0), (95.0), (100.0)) AS t(target)
  WHERE cum >= total * (target / 100.0) GROUP BY target),
cutoff AS (
  SELECT target, place AS vocab_size, r.count AS min_freq, round(cum / total * 100, 6) AS coverage,
    (SELECT count(*) FROM counts) AS total_types, CAST(total AS BIGINT) AS total_tokens
  FROM cutoffs JOIN running r USING (place))
"""
ORACLES["coverage_cutoff"] = f"{ctes()}{COVERAGE} SELECT * FROM cutoff"
ORACLES["coverage_vocab"] = f"""{ctes(None, min_freq=1)}{COVERAGE}
SELECT id, token, count FROM vocab WHERE id < 4 OR count >= (SELECT min_freq FROM cutoff WHERE target = 80.0)"""
ORACLES["coverage_stats"] = f"""{ctes()}{COVERAGE}
SELECT vocab_size, min_freq, coverage, total_types, total_tokens,
  (SELECT count(*) FROM counts WHERE count >= min_freq) AS final_size,
  round((SELECT sum(count) FROM counts WHERE count >= min_freq) / total_tokens * 100, 6) AS final_coverage
FROM cutoff WHERE target = 80.0"""
ORACLES["frequency_histogram"] = f"""{ctes()}
SELECT count AS frequency, count(*) AS n_types, round(count * count(*) / (SELECT sum(count) FROM counts) * 100, 6) AS coverage
FROM counts GROUP BY count ORDER BY count DESC LIMIT 20"""

# --- training rows -----------------------------------------------------------------

ORACLES["context_windows"] = f"""{ctes()}
SELECT doc_id, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS y_sum, {ROW_SUM} FROM wins GROUP BY doc_id"""

ORACLES["shuffle_rows"] = f"""{ctes()}, shuffled AS (SELECT doc_id, pos, y, row_number() OVER (ORDER BY {HASH}) AS place FROM wins)
SELECT doc_id, CAST(sum(place) AS BIGINT) AS place_sum, min(place) AS place_min, max(place) AS place_max,
  {digest("pos", "place", "y")} FROM shuffled GROUP BY doc_id"""

ORACLES["limit_samples"] = f"""{ctes()}, picked AS (SELECT * FROM wins ORDER BY {HASH} LIMIT {MAX_SAMPLES})
SELECT doc_id, count(*) AS n_rows, {ROW_SUM} FROM picked GROUP BY doc_id"""

ORACLES["limit_samples_in_order"] = f"""{ctes()}, picked AS (SELECT * FROM wins ORDER BY doc_id, pos LIMIT {MAX_SAMPLES})
SELECT doc_id, count(*) AS n_rows, {ROW_SUM} FROM picked GROUP BY doc_id"""

ORACLES["train_val_split"] = f"""{ctes()}{SPLIT}
SELECT doc_id, split, count(*) AS n_rows, {ROW_SUM} FROM split_rows GROUP BY doc_id, split"""

ORACLES["ordered_split"] = f"""{ctes()},
placed AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS place, count(*) OVER () AS total FROM wins)
SELECT doc_id, CASE WHEN place <= total - CAST(ceil(total * 0.1) AS BIGINT) THEN 'train' ELSE 'val' END AS split,
  count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS y_sum FROM placed GROUP BY ALL"""

ORACLES["stratified_split"] = f"""{ctes()},
classes AS (SELECT y, count(*) AS n FROM wins GROUP BY y),
sizes AS (SELECT y, n, CAST(sum(n) OVER () AS BIGINT) AS total, count(*) OVER () AS n_classes, min(n) OVER () AS rarest FROM classes),
shares AS (SELECT *, total - CAST(ceil(total * 0.1) AS BIGINT) AS n_train FROM sizes),
bases AS (SELECT *, (n * n_train) // total AS base, (n * n_train) % total AS rest FROM shares),
quotas AS (
  SELECT y, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, y) <= n_train - sum(base) OVER () THEN 1 ELSE 0 END AS quota,
    rarest >= 2 AND least(n_train, total - n_train) >= n_classes AS by_class, n_train
  FROM bases),
placed AS (
  SELECT doc_id, pos, y, row_number() OVER (PARTITION BY y ORDER BY {HASH}) AS place,
    row_number() OVER (ORDER BY {HASH}) AS global_place FROM wins),
labelled AS (
  SELECT doc_id, pos, y,
    CASE WHEN (by_class AND place <= quota) OR (NOT by_class AND global_place <= n_train) THEN 'train' ELSE 'val' END AS split
  FROM placed JOIN quotas USING (y))
SELECT y, split, count(*) AS n_rows, {digest("doc_id", "pos")} FROM labelled GROUP BY y, split"""

ORACLES["n_unique"] = f"""{ctes()}
SELECT (SELECT count(*) FROM (SELECT DISTINCT ctx FROM wins)) AS n_unique_contexts,
  (SELECT count(DISTINCT y) FROM wins) AS n_unique_targets"""

ORACLES["merged_unique"] = f"""{ctes()}
SELECT (SELECT count(*) FROM (SELECT DISTINCT ctx FROM wins)) AS n_unique_contexts,
  (SELECT count(DISTINCT y) FROM wins) AS n_unique_targets, true AS n_unique_contexts_merge, true AS n_unique_targets_merge,
  true AS n_unique_contexts_near, true AS n_unique_targets_near"""

ORACLES["top_targets"] = f"""{ctes()}, t AS (SELECT y, count(*) AS count FROM wins GROUP BY y)
SELECT y, coalesce(token, 'ID_' || y) AS token, t.count, round(t.count / (SELECT sum(count) FROM t), 8) AS frequency
FROM t LEFT JOIN vocab v ON v.id = t.y ORDER BY t.count DESC, y LIMIT 10"""

ORACLES["padding_ratio"] = f"""{ctes()}
SELECT round(sum(len(list_filter(ctx, lambda x: x = 0))) / sum(len(ctx)), 8) AS padding_ratio FROM wins"""

ORACLES["unk_ratios"] = f"""{ctes()}
SELECT round(sum(len(list_filter(ctx, lambda x: x = 1))) / sum(len(ctx)), 8) AS unk_ratio_x,
  round(avg(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END), 8) AS unk_ratio_y FROM wins"""

ORACLES["feature_columns"] = f"""{ctes()}
SELECT doc_id, {", ".join(f"CAST(sum(ctx[{i + 1}]) AS BIGINT) AS token_t_{L - i}" for i in range(L))} FROM wins GROUP BY doc_id"""

# --- features ----------------------------------------------------------------------


def per_doc(source: str, value: str) -> str:
    return f"""SELECT doc_id, round(avg({value}), 5) AS avg_value, round(min({value}), 5) AS min_value,
  round(max({value}), 5) AS max_value FROM {source} GROUP BY doc_id"""


def per_doc_int(value: str) -> str:
    return f"""SELECT doc_id, round(avg({value}), 5) AS avg_value, CAST(min({value}) AS INTEGER) AS min_value,
  CAST(max({value}) AS INTEGER) AS max_value FROM wins GROUP BY doc_id"""


REAL = "list_filter(ctx, lambda x: x <> 0)"
ORACLES["context_length_feature"] = ctes() + per_doc_int(f"len({REAL})")
ORACLES["unk_count_feature"] = ctes() + per_doc_int("len(list_filter(ctx, lambda x: x = 1))")
ORACLES["type_token_ratio_feature"] = ctes() + per_doc(
    "wins", f"CASE WHEN len({REAL}) > 0 THEN len(list_distinct({REAL})) / len({REAL}) ELSE 0.0 END"
)

VECTORS = """
, vecs AS (SELECT token, embedding AS vec FROM vocab JOIN embeddings ON vec_id = id)
"""

ORACLES["align_embeddings"] = f"""{ctes()}{VECTORS},
dims AS (SELECT unnest(vec) AS v, generate_subscripts(vec, 1) AS d FROM vecs),
means AS (SELECT d, CAST(avg(CAST(v AS DOUBLE)) AS FLOAT) AS m FROM dims GROUP BY d),
shared AS (SELECT list(m ORDER BY d) AS vec FROM means),
aligned AS (
  SELECT v.id, v.token, w.vec IS NOT NULL AS found,
    CASE WHEN v.id = 0 THEN list_transform(range({DIM}), lambda x: CAST(0 AS FLOAT))
         WHEN v.id IN (1, 3) OR w.vec IS NULL THEN (SELECT vec FROM shared) ELSE w.vec END AS vec
  FROM vocab v LEFT JOIN vecs w USING (token))
SELECT id, token, found, round({WEIGHTED.format(d=DIM, v="vec")}, 3) AS weighted FROM aligned"""

ORACLES["embedding_coverage"] = f"""{ctes()}{VECTORS}
SELECT count(*) AS vocab_size, count(w.token) AS n_found, round(count(w.token) / count(*) * 100, 6) AS coverage
FROM vocab v LEFT JOIN vecs w USING (token)"""

ORACLES["embedding_size_check"] = f"""{ctes()} SELECT count(*) AS n_vectors, {DIM} AS dim FROM vocab"""

# One column per dimension, so that pooling is a plain aggregate.
EMB_TOP_K = "(SELECT count(*) - 4 FROM embeddings)"
WIDE = ", ".join(f"CAST(embedding[{d}] AS DOUBLE) AS v{d}" for d in range(1, DIM + 1))
CELLS = f"""
, wide AS (SELECT vec_id AS id, {WIDE} FROM embeddings),
cells AS (
  SELECT doc_id, pos, id, j, exp(j / {L}.0) AS wt
  FROM (SELECT doc_id, pos, unnest(ctx) AS id, generate_subscripts(ctx, 1) - 1 AS j FROM wins) WHERE id <> 0)
"""


def pooled(per_dim: str) -> str:
    total = " + ".join(f"{d} * {per_dim.format(v=f'v{d}')}" for d in range(1, DIM + 1))
    return f"{CELLS}, pooled AS (SELECT doc_id, pos, {total} AS s FROM cells JOIN wide USING (id) GROUP BY doc_id, pos)"


ORACLES["mean_pool"] = f"{ctes(EMB_TOP_K)}{pooled('avg({v})')} {per_doc('pooled', 's')}"
MEANS = ", ".join(f"avg(v{d}) AS v{d}" for d in range(1, DIM + 1))
POOLED = f"{ctes(EMB_TOP_K)}{CELLS}, means AS MATERIALIZED (SELECT doc_id, pos, {MEANS} FROM cells JOIN wide USING (id) GROUP BY doc_id, pos)"
COSINES = " + ".join(
    f"""{i + 1} * coalesce(({" + ".join(f"m.v{d} * p{i}.v{d}" for d in range(1, DIM + 1))})
      / nullif(sqrt({" + ".join(f"m.v{d} * m.v{d}" for d in range(1, DIM + 1))})
        * sqrt({" + ".join(f"p{i}.v{d} * p{i}.v{d}" for d in range(1, DIM + 1))}), 0), 0)"""
    for i in range(N_GIVEN)
)
GIVEN = " ".join(f"CROSS JOIN (SELECT * FROM wide WHERE id = {i}) p{i}" for i in range(N_GIVEN))
ORACLES["given_prototypes"] = f"{POOLED}, sims AS (SELECT m.doc_id, {COSINES} AS s FROM means m {GIVEN}) {per_doc('sims', 's')}"
CENTRES = ", ".join(f"avg(v{d}) AS c{d}" for d in range(1, DIM + 1))
SQUARES = " + ".join(f"(v{d} - c{d}) * (v{d} - c{d})" for d in range(1, DIM + 1))
ORACLES["pca_lengths"] = f"""{POOLED}, centre AS (SELECT {CENTRES} FROM means),
lengths AS (SELECT doc_id, {SQUARES} AS s FROM means CROSS JOIN centre) {per_doc("lengths", "s")}"""
ORACLES["max_pool"] = f"{ctes(EMB_TOP_K)}{pooled('max({v})')} {per_doc('pooled', 's')}"
ORACLES["position_weighted_pool"] = f"{ctes(EMB_TOP_K)}{pooled('(sum({v} * wt) / sum(wt))')} {per_doc('pooled', 's')}"

NEAREST = """
dbl AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
sims AS (
  SELECT a.id, list_cosine_similarity(a.v, b.v) AS sim FROM dbl a JOIN dbl b ON a.id <> b.id),
nearest AS (
  SELECT id, sim, row_number() OVER (PARTITION BY id ORDER BY sim DESC) AS place FROM sims QUALIFY place <= 20)
"""
ORACLES["nearest_tokens"] = f"""WITH {NEAREST}
SELECT CAST(id AS INTEGER) AS id, CAST(place - 1 AS INTEGER) AS place, round(sim, 6) AS sim FROM nearest"""
TOKEN_SIM = f", {NEAREST}, token_sim AS (SELECT id, sum(place * sim) AS s FROM nearest GROUP BY id)"
ORACLES["last_token_similarity"] = f"""{ctes(EMB_TOP_K)}{TOKEN_SIM},
valued AS (SELECT doc_id, s FROM wins JOIN token_sim ON id = ctx[{L}]) {per_doc("valued", "s")}"""

ORACLES["feature_model"] = f"""{ctes(EMB_TOP_K)}{SPLIT}
SELECT doc_id, count(*) AS n_rows, {L + 3 + 8 + 50 + 8} AS n_features FROM split_rows WHERE split = 'val' GROUP BY doc_id"""

# Features in order: L ids, 3 statistics, mean, 20 similarities, position pool, max pool.
N_IDS, N_STATS, N_SIMS = L, 3, 20
MEAN_AT = N_IDS + N_STATS
SIMS_AT = MEAN_AT + DIM
POSITION_AT = SIMS_AT + N_SIMS
MAX_AT = POSITION_AT + DIM
FEATURE_SUM = " + ".join(
    f"{MEAN_AT + d} * avg(v{d}) + {POSITION_AT + d} * (sum(v{d} * wt) / sum(wt)) + {MAX_AT + d} * max(v{d})"
    for d in range(1, DIM + 1)
)
ORACLES["assemble_features"] = f"""{ctes(EMB_TOP_K)}{CELLS}{TOKEN_SIM.replace("sum(place * sim)", f"sum((place + {SIMS_AT}) * sim)")},
pools AS (SELECT doc_id, pos, {FEATURE_SUM} AS f FROM cells JOIN wide USING (id) GROUP BY doc_id, pos),
stats AS (
  SELECT doc_id, pos, ctx[{L}] AS last, {" + ".join(f"{i} * ctx[{i}]" for i in range(1, L + 1))}
    + {L + 1} * len({REAL}) + {L + 2} * len(list_filter(ctx, lambda x: x = 1))
    + {L + 3} * (len(list_distinct({REAL})) / len({REAL})) AS f FROM wins)
SELECT doc_id, {MAX_AT + DIM} AS n_features, {L} AS n_categorical, round(avg(p.f + q.f + t.s), 3) AS avg_weighted
FROM pools p JOIN stats q USING (doc_id, pos) JOIN token_sim t ON t.id = q.last GROUP BY doc_id"""

# --- scored tables and metrics -----------------------------------------------------

SCORED = f"""{ctes(SCORED_TOP_K, 1)},
pairs AS (SELECT ctx[1] AS ctx_id, y AS token_id, count(*) AS n FROM wins GROUP BY ALL),
scored AS (SELECT ctx_id, token_id, n / sum(n) OVER (PARTITION BY ctx_id) AS p FROM pairs)
"""
HOT = f"""{SCORED},
logits AS (SELECT ctx_id, token_id, ln(p + 1e-10) / 0.7 AS g FROM scored),
raised AS (SELECT ctx_id, token_id, exp(g - max(g) OVER (PARTITION BY ctx_id)) AS e FROM logits),
hot AS (SELECT ctx_id, token_id, e / sum(e) OVER (PARTITION BY ctx_id) AS p FROM raised)
"""
ORACLES["apply_temperature"] = HOT + "SELECT ctx_id, token_id, round(p, 8) AS p FROM hot"
BEST = "row_number() OVER (PARTITION BY ctx_id ORDER BY p DESC, token_id)"
ORACLES["pick_greedy"] = f"{SCORED} SELECT ctx_id, token_id, round(p, 8) AS p FROM scored QUALIFY {BEST} = 1"
TOP = f"""{SCORED},
best AS (SELECT * FROM scored QUALIFY {BEST} <= 10),
top AS (SELECT ctx_id, token_id, p / sum(p) OVER (PARTITION BY ctx_id) AS p FROM best)
"""
ORACLES["filter_top_k"] = TOP + "SELECT ctx_id, token_id, round(p, 8) AS p FROM top"
# The running sum is folded in order, term by term, as the boundary may hang on the last bit.
ORACLES["filter_top_p"] = f"""{SCORED},
placed AS (SELECT *, {BEST} AS place FROM scored),
folded AS (SELECT ctx_id, list(p ORDER BY place) AS ps FROM placed GROUP BY ctx_id),
cums AS (
  SELECT ctx_id, ps, list_reduce(ps, lambda a, x: a + x) AS total,
    list_reduce(list_transform(ps, lambda x: [x]), lambda a, x: list_append(a, a[len(a)] + x[1])) AS cum FROM folded),
sizes AS (SELECT ctx_id, greatest(1, len(list_filter(cum, lambda x: x <= 0.9::DOUBLE))) AS n FROM cums),
nucleus AS (SELECT s.* FROM placed s JOIN sizes USING (ctx_id) WHERE place <= n)
SELECT ctx_id, token_id, round(p / sum(p) OVER (PARTITION BY ctx_id), 8) AS p FROM nucleus"""


def drawn(source: str, samples: int) -> str:
    return f"""
, cums AS (
  SELECT ctx_id, token_id, sum(p) OVER (PARTITION BY ctx_id ORDER BY token_id) / sum(p) OVER (PARTITION BY ctx_id) AS cum
  FROM {source}),
tries AS (SELECT *, unnest(range({samples})) AS sample_idx FROM cums),
draws AS (
  SELECT *, CAST('0x' || substr(md5('{SEED}:' || ctx_id || ':0:' || sample_idx), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM tries)
"""


PICK = "coalesce(min(token_id) FILTER (WHERE cum > u), max(token_id)) AS token_id"
ORACLES["draw"] = f"""{TOP}{drawn("top", 3)}
SELECT ctx_id, CAST(sample_idx AS INTEGER) AS sample_idx, {PICK} FROM draws GROUP BY ctx_id, sample_idx"""
ORACLES["sample_temperature"] = f"{HOT}{drawn('hot', 1)} SELECT ctx_id, {PICK} FROM draws GROUP BY ctx_id, sample_idx"
ORACLES["samples_per_prompt"] = """
SELECT item_id AS prompt_id, md5(text) AS prompt_md5, CAST(unnest(range(3)) AS INTEGER) AS sample_idx FROM benchmark"""



# A context of the last two tokens, of the last one, and the empty one, as text.
SUFFIXES = "[ctx[1] || ' ' || ctx[2], ctx[2] || '', '']"


def predicted(learnt: str) -> str:
    """Prediction and loss of all windows by the rows ``learnt``, by the longest context these know."""
    clip = "least(greatest({0}, 1e-15::DOUBLE), 1.0::DOUBLE - 1e-15::DOUBLE)"
    return f"""
, learnt AS MATERIALIZED (SELECT unnest({SUFFIXES}) AS ctx_id, y AS token_id FROM {learnt}),
seen_pairs AS (SELECT ctx_id, token_id, count(*) AS n FROM learnt GROUP BY ALL),
model AS MATERIALIZED (SELECT ctx_id, token_id, n / sum(n) OVER (PARTITION BY ctx_id) AS p FROM seen_pairs),
sums AS MATERIALIZED (SELECT ctx_id, count(*) AS seen, sum({clip.format("p")}) AS mass FROM model GROUP BY ctx_id),
firsts AS (SELECT ctx_id, token_id AS y_pred FROM model QUALIFY {BEST} = 1),
asked AS (
  SELECT doc_id, pos, y, coalesce(two.ctx_id, one.ctx_id, '') AS ctx_id
  FROM (SELECT *, {SUFFIXES} AS s FROM wins) LEFT JOIN sums two ON two.ctx_id = s[1] LEFT JOIN sums one ON one.ctx_id = s[2]),
losses AS (
  SELECT a.doc_id, a.pos, a.y, f.y_pred, CASE WHEN a.y = f.y_pred THEN 1.0 ELSE 0.0 END AS hit,
    -ln({clip.format("coalesce(m.p, 0)")} / (s.mass + ((SELECT count(*) FROM vocab) - s.seen) * 1e-15::DOUBLE)) AS loss
  FROM asked a JOIN sums s USING (ctx_id) JOIN firsts f USING (ctx_id)
  LEFT JOIN model m ON m.ctx_id = a.ctx_id AND m.token_id = a.y)
"""


PREDICTED = ctes(MODEL_TOP_K, 2) + predicted("wins")
ORACLES["argmax_class"] = f"""{PREDICTED}
SELECT doc_id, CAST(y_pred AS INTEGER) AS y_pred, count(*) AS n_rows FROM losses GROUP BY ALL"""
ORACLES["accuracy"] = PREDICTED + "SELECT round(avg(hit), 8) AS accuracy FROM losses"
ORACLES["label_accuracy"] = "SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 8) AS accuracy FROM labels"
ORACLES["multi_logloss"] = PREDICTED + "SELECT round(avg(loss), 8) AS logloss FROM losses"
ORACLES["perplexity"] = PREDICTED + "SELECT round(exp(avg(loss)), 7) AS perplexity FROM losses"
ORACLES["metrics_report"] = f"""{ctes(MODEL_TOP_K, 2)}{SPLIT}{predicted("split_rows WHERE split = 'train'")}
SELECT split, count(*) AS n_rows,
  round(avg(hit), 7) AS accuracy, round(avg(loss), 7) AS logloss, round(exp(avg(loss)), 7) AS perplexity
FROM losses JOIN split_rows USING (doc_id, pos) GROUP BY split"""

ORACLES["class_metrics"] = """
WITH docs AS (SELECT lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS y FROM (SELECT DISTINCT lang FROM docs)),
grid AS (
  SELECT s.source, l.lang, l.y, (SELECT count(*) FROM docs d WHERE d.source = s.source AND d.lang = l.lang) AS n
  FROM (SELECT DISTINCT source FROM docs) s, langs l),
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY source) AS p FROM grid),
clipped AS (SELECT *, least(greatest(p, 1e-15::DOUBLE), 1.0::DOUBLE - 1e-15::DOUBLE) AS c FROM shares),
scored AS (SELECT *, -ln(c / sum(c) OVER (PARTITION BY source)) AS loss FROM clipped),
best AS (SELECT source, y AS y_pred FROM shares QUALIFY row_number() OVER (PARTITION BY source ORDER BY p DESC, y) = 1)
SELECT source, CAST(sum(n) AS BIGINT) AS n_rows, CAST(y_pred AS INTEGER) AS y_pred,
  round(sum(CASE WHEN y = y_pred THEN n ELSE 0 END) / sum(n), 8) AS accuracy, round(sum(n * loss) / sum(n), 8) AS report_logloss,
  round(sum(n * loss) / sum(n), 8) AS logloss, round(exp(sum(n * loss) / sum(n)), 8) AS perplexity
FROM scored JOIN best USING (source) GROUP BY source, y_pred"""

# --- conversations -----------------------------------------------------------------

SESSIONS = rf"""
marked AS (
  SELECT *, lower({STRIP.format("text")}) IN ('exit', 'quit', ':q') AS leave, role = 'system' AS restart,
    {STRIP.format("text")} <> '' AS said FROM conversations),
numbered AS (
  SELECT *, sum(CASE WHEN restart AND NOT leave THEN 1 ELSE 0 END) OVER w AS session_id,
    sum(CASE WHEN leave THEN 1 ELSE 0 END) OVER w AS exits
  FROM marked WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
sessions AS (
  SELECT conv_id, turn, role, text, CAST(session_id AS BIGINT) AS session_id FROM numbered
  WHERE exits = 0 AND NOT leave AND NOT restart AND said)
"""
ORACLES["conversation_sessions"] = f"""WITH {SESSIONS}
SELECT conv_id, turn, role, session_id, md5(text) AS text_md5 FROM sessions"""

CHAT = f"""{ctes()}, {SESSIONS},
turn_tokens AS (
  SELECT conv_id, turn, unnest(w) AS token, generate_subscripts(w, 1) AS pos
  FROM (SELECT conv_id, turn, {words()} AS w FROM sessions)),
turn_ids AS (
  SELECT conv_id, turn, list(coalesce(id, 1) ORDER BY pos) AS ids FROM turn_tokens LEFT JOIN kept USING (token) GROUP BY ALL),
spoken AS (
  SELECT s.conv_id, s.session_id, s.turn, s.role,
    list_concat(coalesce(ids, []), CASE WHEN role = 'assistant' THEN [3] ELSE [] END) AS ids
  FROM sessions s LEFT JOIN turn_ids USING (conv_id, turn)),
history AS (
  SELECT conv_id, session_id, turn, role,
    list_concat([2], flatten(list(ids) OVER (PARTITION BY conv_id, session_id ORDER BY turn))) AS h FROM spoken),
chat AS (
  SELECT conv_id, session_id, turn, role, array_to_string(list_slice(h, greatest(len(h) - {CHAT_WINDOW - 1}, 1), len(h)), ' ') AS ctx,
    len(h) AS total_tokens, {CHAT_WINDOW} AS context_window, least(len(h), {CHAT_WINDOW}) AS effective_context,
    len(h) > {CHAT_WINDOW} AS truncated FROM history)
"""
ORACLES["rolling_context"] = CHAT + "SELECT * FROM chat"
ORACLES["streaming_rolling_context"] = ORACLES["rolling_context"]
ORACLES["stateful_rolling_context"] = ORACLES["rolling_context"]
ORACLES["conversation_stats"] = CHAT + "SELECT * EXCLUDE (ctx) FROM chat"

# --- generation --------------------------------------------------------------------


ORACLES["fit_next_token_model"] = f"""{ctes(MODEL_TOP_K, 2)},
places_of AS (SELECT ctx, y, unnest(range(3)) AS n FROM wins),
grams AS (SELECT CASE n WHEN 0 THEN '' WHEN 1 THEN ctx[2] || '' ELSE ctx[1] || ' ' || ctx[2] END AS ctx, y FROM places_of),
gram_counts AS (SELECT ctx, y, count(*) AS n FROM grams GROUP BY ALL)
SELECT ctx, count(*) AS n_tokens, CAST(sum(n) AS BIGINT) AS total, {digest("y", "n")} FROM gram_counts GROUP BY ctx"""

ORACLES["save_load_model"] = f"""{ctes(MODEL_TOP_K, 2)},
grams AS (SELECT unnest({SUFFIXES}) AS ctx_id, y AS token_id FROM wins),
gram_counts AS (SELECT ctx_id, token_id, count(*) AS p FROM grams GROUP BY ALL),
sums AS (SELECT ctx_id, count(*) AS n_tokens, CAST(sum(p) AS BIGINT) AS total FROM gram_counts GROUP BY ctx_id),
firsts AS (SELECT ctx_id, token_id AS best FROM gram_counts QUALIFY {BEST} = 1)
SELECT ctx_id AS ctx, n_tokens, total, best, n_tokens AS seen, 2 AS order FROM sums JOIN firsts USING (ctx_id)"""

PROMPTS = f"""
prompt_tokens AS (
  SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos
  FROM (SELECT item_id, {words()} AS w FROM benchmark)),
prompt_ids AS (
  SELECT item_id, list(coalesce(id, 1) ORDER BY pos) AS ids FROM prompt_tokens LEFT JOIN kept USING (token) GROUP BY ALL),
opened AS (SELECT b.item_id AS doc_id, list_concat([2], coalesce(ids, [])) AS ids FROM benchmark b LEFT JOIN prompt_ids USING (item_id))
"""

# Step by step: the token whose share of [0, 1) holds the number drawn, after the longest known context.
ORACLES["generate_batch"] = f"""{ctes(SCORED_TOP_K, 2).replace("WITH toks", "WITH RECURSIVE toks")},
grams AS (SELECT unnest({SUFFIXES}) AS ctx_id, y AS token_id FROM wins),
gram_counts AS MATERIALIZED (SELECT ctx_id, token_id, count(*) AS n FROM grams GROUP BY ALL),
scored AS (SELECT ctx_id, token_id, n / sum(n) OVER (PARTITION BY ctx_id) AS p FROM gram_counts),
best AS (SELECT * FROM scored QUALIFY {BEST} <= 10),
top AS (SELECT ctx_id, token_id, p / sum(p) OVER (PARTITION BY ctx_id) AS p FROM best),
ends AS (
  SELECT ctx_id, token_id, sum(p) OVER (PARTITION BY ctx_id ORDER BY token_id) / sum(p) OVER (PARTITION BY ctx_id) AS hi FROM top),
ranges AS MATERIALIZED (
  SELECT ctx_id, token_id, hi, lag(hi, 1, 0.0) OVER w AS lo, lead(token_id) OVER w IS NULL AS final
  FROM ends WINDOW w AS (PARTITION BY ctx_id ORDER BY token_id)),
contexts AS MATERIALIZED (SELECT DISTINCT ctx_id FROM ranges),
{PROMPTS},
said AS (
  SELECT doc_id AS prompt_id, s.sample_idx, 0 AS step, ids[len(ids)] AS last, CASE WHEN len(ids) > 1 THEN ids[len(ids) - 1] ELSE 0 END AS prior
  FROM opened, (VALUES (0), (1)) AS s(sample_idx)
  UNION ALL
  SELECT g.prompt_id, g.sample_idx, g.step + 1, r.token_id, g.last
  FROM (
    SELECT said.*, coalesce(two.ctx_id, one.ctx_id, '') AS ctx_id,
      CAST('0x' || substr(md5('{SEED}:' || prompt_id || ':' || sample_idx || ':' || step || ':0'), 1, 8) AS BIGINT)
      / 4294967296.0::DOUBLE AS u
    FROM said LEFT JOIN contexts two ON two.ctx_id = prior || ' ' || last LEFT JOIN contexts one ON one.ctx_id = last || ''
    WHERE step < 50 AND (step = 0 OR last <> 3)) g
  JOIN ranges r ON r.ctx_id = g.ctx_id AND g.u >= r.lo AND (g.u < r.hi OR r.final)),
spoken AS (
  SELECT doc_id AS prompt_id, s.sample_idx, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos
  FROM opened, (VALUES (0), (1)) AS s(sample_idx)
  UNION ALL
  SELECT prompt_id, sample_idx, last, len(ids) + step FROM said JOIN opened ON doc_id = prompt_id WHERE step > 0),
texts AS (
  SELECT prompt_id, sample_idx, string_agg(token, ' ' ORDER BY pos) AS t FROM spoken JOIN kept USING (id) GROUP BY ALL)
SELECT doc_id AS prompt_id, s.sample_idx, coalesce(t, '') AS generated
FROM opened CROSS JOIN (VALUES (0), (1)) AS s(sample_idx)
LEFT JOIN texts ON texts.prompt_id = doc_id AND texts.sample_idx = s.sample_idx"""

# Greedily, up to 50 tokens; nothing follows EOS (3) or an unknown last token.
ORACLES["generate_by_bigrams"] = f"""{SCORED.replace("WITH toks", "WITH RECURSIVE toks")},
best AS MATERIALIZED (SELECT ctx_id, token_id FROM scored QUALIFY {BEST} = 1),
{PROMPTS},
said AS (
  SELECT doc_id AS prompt_id, 0 AS step, ids[len(ids)] AS last FROM opened
  UNION ALL
  SELECT prompt_id, step + 1, b.token_id FROM said JOIN best b ON b.ctx_id = last WHERE step < 50 AND (step = 0 OR last <> 3)),
spoken AS (
  SELECT doc_id AS prompt_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM opened
  UNION ALL SELECT prompt_id, last, len(ids) + step FROM said JOIN opened ON doc_id = prompt_id WHERE step > 0),
texts AS (SELECT prompt_id, string_agg(token, ' ' ORDER BY pos) AS t FROM spoken JOIN kept USING (id) GROUP BY prompt_id)
SELECT o.doc_id AS prompt_id, 0 AS sample_idx, coalesce(t, '') AS generated FROM opened o LEFT JOIN texts ON prompt_id = o.doc_id"""
