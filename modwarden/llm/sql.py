"""DuckDB SQL for those corpus queries that SQL can express on the small tables.

Token counts, SentencePiece ids, signature rules, suffix arrays, bucket bounds and CRC-32 have no plain SQL; tests/llm
holds brute-force versions of those.
"""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Closure of the table links(a, b) (both directions) to comp(id, component_id) over the ids of all_ids(id).
_CLOSURE = """reach(id, other) AS (SELECT id, id FROM all_ids UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

ORACLES = {
    "op2_chat_rotation": """WITH r AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker <> 'system'),
s AS (SELECT r.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS as_role FROM r JOIN p USING (conv_id)),
h AS (SELECT *, '<|turn|>' || as_role || CASE WHEN as_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM s),
g AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, speaker, md5(text) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seg_start FROM g)
SELECT conv_id, perspective, turn, speaker, as_role, segment, seg_start, seg_start + length(segment) AS seg_end, CASE WHEN as_role = 'assistant' THEN seg_start + length(head) END AS learn_start, CASE WHEN as_role = 'assistant' THEN seg_start + length(segment) END AS learn_end FROM o""",
    "op4_quality_cascade": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] AS k FROM (SELECT doc_id, ws, unnest(range(len(ws) - 2)) AS i FROM d WHERE len(ws) > 2)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
f AS (SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines, coalesce(rep.n, 0) AS n_repeat_words, len(list_filter(ws, lambda w: regexp_matches(w, '[A-Za-z]|[^\\x00-\\x7F]'))) AS lettered,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^a-z]', '', 'g')) AS low, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS beyond, length(regexp_replace(text, '[^!]', '', 'g')) AS bang FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
g AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 100 * n_symbols <= 10 * n_words AND 100 * n_dup_lines <= 30 * len(lines) AND 100 * lettered >= 70 * n_words AND up <= low + beyond AND 100 * bang <= 30 * n_words AS kept FROM g""",
    "op5_lattice_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), all_ids AS (SELECT id FROM v),
links AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id AND list_cosine_similarity(x.e, y.e) >= 0.95), {_CLOSURE}, n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM comp LEFT JOIN n ON comp.id = n.a""",
    "op9_odd_minhash": f"""WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_extract_all({_LOW}, '{_WORD}') AS ws FROM documents), all_ids AS (SELECT id FROM d),
s AS (SELECT DISTINCT id, array_to_string(ws[i + 1 : i + least(4, len(ws))], ' ') AS k FROM (SELECT id, ws, unnest(range(greatest(len(ws) - 3, 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
both_ AS (SELECT x.id AS a, y.id AS b, count(*) AS m FROM s x JOIN s y ON x.k = y.k AND x.id <> y.id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * m >= 80 * (p.n + q.n - m)), {_CLOSURE}
SELECT comp.id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, comp.id = component_id AS kept FROM comp LEFT JOIN n ON comp.id = n.id""",
}
