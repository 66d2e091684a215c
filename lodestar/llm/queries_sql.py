"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT"

OP1 = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, contains(text, '</s>') OR contains(role, '</s>') OR contains(role, '[/INST]') OR starts_with(role, '\') AS esc,
    replace(replace(replace(replace(replace(text, '\', '\e'), '<s>', '\s'), '</s>', '\z'), '[INST]', '\i'), '[/INST]', '\j') AS text_esc,
    replace(replace(replace(replace(replace(role, '\', '\e'), '<s>', '\s'), '</s>', '\z'), '[INST]', '\i'), '[/INST]', '\j') AS role_esc
  FROM r
), g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(20 + CASE WHEN esc THEN 1 + length(role_esc) + length(text_esc) ELSE length(role) + length(text) END)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, true AS identical FROM g
"""

OP5 = rf"""
WITH d AS (
  SELECT doc_id, source, {WORDS} AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 7))::BIGINT AS h1, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 8, 7))::BIGINT AS h2 FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM s
), w AS (
  SELECT *, [5, 2, 1][(pos - 1) % 3 + 1]::BIGINT AS weight FROM o
), c AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT * 3 / 2 AS total,
    coalesce((sum(source_size * 2) OVER (ORDER BY source_size / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS capped,
    ((sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY source_size / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS weights
  FROM w
), l AS (
  SELECT *, (total::DOUBLE - capped) / weights AS own_level FROM c
), t AS (
  SELECT *, (SELECT own_level FROM l WHERE own_level * weight <= source_size * 2 ORDER BY source_size / weight, pos LIMIT 1) AS level FROM l
), x AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR level * weight > (source_size * 2)::DOUBLE THEN (source_size * 2)::DOUBLE ELSE level * weight END AS target FROM t
), y AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM x
), j AS (
  SELECT d.doc_id, d.source, d.size, h1, h2, source_size, target, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source
), e AS (
  SELECT source, seed, abs(first(whole) * first(source_size) + sum(CASE WHEN ((h1 + seed * h2) % 268435456) / 268435456.0::DOUBLE < part THEN size ELSE 0 END) - first(target)) AS gap
  FROM j CROSS JOIN range(32) AS seeds(seed) GROUP BY source, seed
), k AS (
  SELECT source, seed FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY gap, seed) AS r FROM e) WHERE r = 1
)
SELECT j.doc_id, j.size, j.source_size, j.target, (whole + CASE WHEN ((h1 + seed * h2) % 268435456) / 268435456.0::DOUBLE < part THEN 1 ELSE 0 END) * j.size AS taken
FROM j JOIN k ON j.source IS NOT DISTINCT FROM k.source
"""

OP6 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP9 = """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP10 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, unnest([array_to_string(ws[i:i + 12], ' ') FOR i IN range(1, len(ws) - 11)]) AS g, unnest(range(1, len(ws) - 11)) AS pos FROM w WHERE len(ws) >= 13
), f AS (
  SELECT g, min(doc_id) AS least FROM p GROUP BY g
), c AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM p JOIN f USING (g) CROSS JOIN range(13) AS r(k) WHERE least < doc_id
), u AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w
), k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM u ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1, "op5_mixing": OP5, "op6_exact_dedup": OP6, "op9_exact_topk": OP9, "op10_substring_dedup": OP10}
