"""DuckDB SQL for the queries of modwarden.source_queries, written from their definitions."""

from __future__ import annotations

from modwarden import lexicon as L
from modwarden import oracles as O
from modwarden.plans.corpora import SPECS
from modwarden.plans.mining import TOXIC_PHRASES

_FNV64 = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split({t}, ''), lambda c: ord(c)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::VARCHAR"


def fnv64(t: str) -> str:
    return _FNV64.format(t=t)


def values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(O.q(v) if isinstance(v, str) else str(v) for v in r) + ')' for r in rows)}) AS t({names})"


def grams(source: str, dim: int) -> str:
    """id, d, v: the hashed trigrams of a table (id, t)."""
    return f"""SELECT id, h % {dim} AS d, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM (SELECT id, ('0x' || substr(md5(substr(p, i, 3)), 1, 8))::BIGINT AS h FROM (SELECT id, p, unnest(range(1, length(p) - 1)) AS i FROM (SELECT id, ' ' || lower(t) || ' ' AS p FROM {source}))) GROUP BY id, h % {dim}"""


_DB = """n AS (SELECT *, n_nationkey AS k FROM nation), e AS (SELECT *, CASE WHEN k % 5 = 4 THEN 3 ELSE k % 5 END AS severity FROM n),
v AS (SELECT k, unnest([n_name, lower(n_name) || 's'] || CASE WHEN k % 2 = 0 THEN [n_name || 'x', substr(n_name, 1, 3)] ELSE [substr(n_name, 1, 2)] END) AS w FROM e WHERE severity >= 2),
w AS (SELECT k, regexp_replace(lower(trim(w)), '[^a-z0-9]', '', 'g') AS word FROM v),
db AS (SELECT DISTINCT 'bad' AS kind, word FROM w WHERE length(word) >= 4 UNION SELECT 'bad', x FROM (SELECT regexp_replace(lower(substr(n_name, 1, 4) || 'q'), '[^a-z0-9]', '', 'g') AS x FROM n) WHERE length(x) >= 4
  UNION SELECT 'short', word FROM w WHERE length(word) BETWEEN 2 AND 3 AND k % 3 < 2 UNION SELECT 'aggressive', word FROM w WHERE length(word) BETWEEN 2 AND 3 AND k % 3 = 0 UNION SELECT 'whitelist', lower(n_name) FROM n)"""
_OVERLAY = f"""m AS (SELECT r_regionkey, CASE WHEN r_regionkey < 4 THEN least(greatest(r_regionkey * 0.5 - 0.2, 0.0), 1.0)::DOUBLE ELSE {L.REVIEW_THRESHOLD}::DOUBLE END AS a, CASE WHEN r_regionkey < 3 THEN 0.3::DOUBLE ELSE {L.BLOCK_THRESHOLD}::DOUBLE END AS b FROM region),
f AS (SELECT * FROM {values(list(L.WEIGHTS.items()), 'feature, weight')})"""
_LABELLED = """l AS (SELECT doc_id AS d, quality AS q, toxic AS x, 'doc ' || doc_id AS name, (doc_id % 10) / 10.0::DOUBLE AS tenth FROM labels),
j AS (SELECT 'jigsaw' AS kind, name AS text, greatest(x * 0.9::DOUBLE, q * 0.95::DOUBLE, tenth) AS score FROM l WHERE greatest(x * 0.9::DOUBLE, tenth) >= 0.5
UNION ALL SELECT 'real_toxicity', CASE WHEN d % 3 > 0 THEN name ELSE name || ' on' END, greatest((d % 7) / 6.0::DOUBLE, (d % 5) / 4.0::DOUBLE) FROM l WHERE greatest((d % 7) / 6.0::DOUBLE, (d % 5) / 4.0::DOUBLE) >= 0.8
UNION ALL SELECT 'civil_comments', name, greatest(tenth, CASE WHEN d % 4 = 0 THEN 0.7 ELSE 0 END) FROM l WHERE greatest(tenth, CASE WHEN d % 4 = 0 THEN 0.7 ELSE 0 END) >= 0.5
UNION ALL SELECT 'berkeley_hate_score', name, greatest(tenth - 0.3::DOUBLE, 0) FROM l WHERE tenth - 0.3::DOUBLE >= 0.5
UNION ALL SELECT 'tdavidson', name, CASE WHEN c = 0 THEN 1.0 ELSE 0.95 END FROM (SELECT *, CASE WHEN d % 11 > 0 THEN d % 3 ELSE d % 4 END AS c FROM l) WHERE c <> 2
UNION ALL SELECT 'tdavidson_setfit', name, 0.95 FROM l WHERE d % 4 = 0 OR (d % 4 IN (2, 3) AND d % 3 < 2)
UNION ALL SELECT 'binary_label_setfit', name, 0.95 FROM l WHERE d % 4 IN (0, 1) OR (d % 4 = 3 AND x = 1)
UNION ALL SELECT 'binary_label_tweets', name, 0.95 FROM l WHERE d % 3 <> 0
UNION ALL SELECT 'tweet_eval_binary', name, 0.95 FROM l WHERE d % 3 = 1
UNION ALL SELECT 'paradetox_pairs', name, 0.98 FROM l WHERE d % 2 = 0)"""
_LAST = [(k, *next((i, s.source) for i, s in reversed(list(enumerate(SPECS))) if s.kind == k)) for k in sorted({s.kind for s in SPECS})]
_CAPPED = """capped AS (SELECT *, row_number() OVER (ORDER BY source, doc_id) - 1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM mined) WHERE rn <= 3)"""
_WORDS = f"list_sort(list_distinct(list_filter({O.words('t')}, lambda w: length(w) >= 3 AND NOT list_contains({O.lst(L.WHITELIST)}, w))))"
_KNOWN = O._TERMS.replace("context", "t")
_TOXIC = f"""r AS (SELECT conv_id, turn, {O._SPEAKER} AS role, {O.clean("substr(coalesce(text, ''), 1, 60) || (CASE (conv_id + turn) % 5 WHEN 0 THEN ' you idiot and scum' WHEN 1 THEN ' so trashy' WHEN 2 THEN ' now get lost' WHEN 3 THEN '' ELSE ' indeed' END)")} AS t FROM conversations),
k AS (SELECT *, {_KNOWN} AS known, {_WORDS} AS words FROM r),
f AS (SELECT *, CASE WHEN len(known) = 0 AND regexp_matches(t, {O.q('|'.join(TOXIC_PHRASES))}) THEN CASE WHEN len(words) > 0 THEN words ELSE ['toxic_phrase'] END ELSE known END AS terms FROM k),
g AS (SELECT *, role = 'user' AND length(t) >= 12 AND len(terms) > 0 AS toxic, role = 'user' AND length(t) >= 12 AND len(terms) = 0 AS clean FROM f),
p AS (SELECT g.*, (SELECT max(h.turn) FROM g h WHERE h.conv_id = g.conv_id AND h.turn < g.turn AND h.clean) AS back, (SELECT min(h.turn) FROM g h WHERE h.conv_id = g.conv_id AND h.turn > g.turn AND h.role IN ('user', 'assistant')) AS ahead FROM g WHERE toxic),
j AS (SELECT p.conv_id, p.turn, p.t AS anchor, p.terms, n.t AS answer, coalesce(c.t, '') AS clean_user FROM p JOIN g n ON n.conv_id = p.conv_id AND n.turn = p.ahead AND n.role = 'assistant' AND length(n.t) >= 12 LEFT JOIN g c ON c.conv_id = p.conv_id AND c.turn = p.back)"""
_TRIPLETS = O.ORACLES["triplets"].replace("FROM conversations)", "FROM conversations WHERE conv_id % 3 <> 1)").rpartition("SELECT conv_id, turn, md5(anchor)")[0]
_PROBES = f"""few AS (SELECT *, len({O.CHUNKS}) <= 8 OR leet OR hard_separator AS few FROM reasons WHERE reason = 'no_lexical_or_semantic_hit'),
probes AS (SELECT doc_id, txt AS probe, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS pos FROM merged m JOIN few USING (doc_id)
  WHERE few AND m.pos < 32 AND length(txt) BETWEEN 4 AND 24 AND txt NOT IN {O.BAD_IN} AND txt NOT IN {O.WHITE_IN} AND txt NOT IN {O.CLEAN_IN} AND (m.obf OR leet OR hard_separator OR digit) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 8)"""


def _search(name: str, source: str, least: float) -> str:
    """ids of `source` (id, t) with an index vector at `least`."""
    return f"""{name}_g AS ({grams(source, 64)}), {name}_n AS (SELECT id, sum(v * v)::DOUBLE AS n FROM {name}_g GROUP BY id),
{name} AS (SELECT DISTINCT g.id FROM {name}_g g JOIN ix_g x ON g.d = x.d JOIN {name}_n p ON p.id = g.id JOIN ix_n q ON q.id = x.id GROUP BY g.id, x.id, p.n, q.n HAVING sum(g.v * x.v) / sqrt(p.n * q.n) >= {least})"""


_SEEDS = [w for w in L.BAD_WORDS if 4 <= len(w) <= 24]
_SEMANTIC = f"""WITH {O.SCORED}, {_PROBES}, ix AS (SELECT unnest({O.lst(_SEEDS)}) AS id, unnest({O.lst(_SEEDS)}) AS t), ix_g AS ({grams('ix', 64)}), ix_n AS (SELECT id, sum(v * v)::DOUBLE AS n FROM ix_g GROUP BY id),
pw AS (SELECT DISTINCT probe AS id, probe AS t FROM probes), {_search('near', 'pw', 0.487)}, hit AS (SELECT DISTINCT doc_id FROM probes WHERE probe IN (SELECT id FROM near)),
s1 AS (SELECT v.*, h.doc_id IS NOT NULL AS hit FROM verdicts v LEFT JOIN hit h USING (doc_id)),
open_ AS (SELECT doc_id AS id, text AS t FROM s1 JOIN docs USING (doc_id) WHERE needs_semantic AND NOT hit), {_search('close_', 'open_', 0.237)}
SELECT doc_id, CASE WHEN hit OR doc_id IN (SELECT id FROM close_) THEN 'block' ELSE verdict END AS verdict, CASE WHEN hit THEN 'semantic_profanity' WHEN needs_semantic THEN 'semantic_fallback' ELSE reason END AS reason, decision, score, needs_semantic AND NOT hit AS needs_semantic FROM s1"""
_VECTOR16 = "list_transform(range(16), lambda k: coalesce(list_extract(map_extract(m, k), 1), 0)::INT)"

SOURCE_ORACLES = {
    "semantic_verdicts": _SEMANTIC,
    "vector_probes": f"WITH {O.SCORED}, {_PROBES} SELECT doc_id, pos, probe FROM probes",
    "word_file_scan": "SELECT DISTINCT trim(p_type) AS line, length(trim(p_type))::INT AS n FROM part",
    "whitelist_scan": f"WITH w AS (SELECT trim(c_mktsegment || (c_custkey % 7)) AS t FROM customer WHERE c_custkey % 3 = 1) SELECT DISTINCT {O.compact('t')} AS word FROM w",
    "context_phrase_scan": f"WITH s AS (SELECT DISTINCT unnest(string_split(text, '.')) AS t FROM benchmark), l AS (SELECT unnest(string_split(t, chr(10))) AS t FROM s), k AS (SELECT {O.tokens('t')} AS k FROM l WHERE trim(t) <> '') SELECT DISTINCT array_to_string(k, ' ') AS phrase FROM k WHERE len(k) BETWEEN 2 AND 24",
    "moderation_db_words": f"WITH {_DB} SELECT kind, word FROM db",
    "scanned_lexicon": f"""WITH {_DB}, f AS (SELECT word, bool_or(kind = 'bad') AS bad, bool_or(kind = 'whitelist') AS white, bool_or(kind = 'short') AS short, bool_or(kind = 'aggressive') AS aggressive, regexp_replace(word, '[aeiou]', '', 'g') AS bone FROM db GROUP BY word)
SELECT word, bad, white, short, aggressive, CASE WHEN bad THEN CASE WHEN length(bone) >= 2 THEN bone ELSE word END END AS skeleton, CASE WHEN bad THEN CASE WHEN length(bone) >= 2 THEN length(bone) ELSE length(word) END END::INT AS sk_len FROM f""",
    "legacy_words": """WITH a AS (SELECT lower(trim(n_name)) AS word FROM nation WHERE n_nationkey % 4 <> 2 AND (n_nationkey % 5 = 0 OR n_nationkey % 5 >= 2) AND length(trim(n_name)) >= 4), b AS (SELECT lower(r_name) AS word FROM region)
SELECT 'union' AS kind, word FROM (SELECT word FROM a UNION SELECT word FROM b) UNION ALL SELECT DISTINCT 'fallback', word FROM b""",
    "decision_overlay": f"WITH {_OVERLAY} SELECT r_regionkey, round(least(a, b), 6) AS review, round(greatest(a, b), 6) AS block, feature, CASE WHEN feature = 'fuzzy_strong' AND r_regionkey < 4 THEN r_regionkey::DOUBLE ELSE weight::DOUBLE END AS weight FROM m, f",
    "labelled_corpora": f"WITH {_LABELLED} SELECT rank, source, text, round(score::DOUBLE, 4) AS score FROM j JOIN {values(_LAST, 'kind, rank, source')} USING (kind)",
    "labelled_texts": "WITH t AS (SELECT trim(coalesce(text, ''), ' ') AS t FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) SELECT md5(t) AS text, length(t)::INT AS n FROM t UNION ALL SELECT md5(t), length(t)::INT FROM t",
    "literal_messages": f"SELECT * FROM {values([(t, 'nitro_scam') for t in L.SCAM_EXAMPLES], 'text, category')}",
    "mined_file": f"WITH {O.MINED}, {_CAPPED} SELECT pos::INT AS pos, source, toxicity_score, array_to_string(profane_terms, ',') AS terms, md5(context) AS context_md5 FROM capped WHERE pos < 20",
    "mined_items": f"""WITH {O.MINED}, b AS (SELECT DISTINCT regexp_replace(unnest(profane_terms), '[^\\p{{L}}]', '', 'g') AS text, 'live_trained_profanity' AS category FROM mined UNION SELECT substr(context, 1, 512), 'mined_toxicity_context' FROM mined WHERE length(context) >= 16),
h AS (SELECT category, text, sha1('mined::' || text) AS s FROM b WHERE length(text) >= 4) SELECT category, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-' || substr(s, 13, 4) || '-' || substr(s, 17, 4) || '-' || substr(s, 21, 12) AS id, length(text)::INT AS n FROM h""",
    "jsonl_triplets": _TRIPLETS + "SELECT conv_id, turn, md5(anchor) AS anchor, length(clean_user)::INT AS clean_len FROM (SELECT *, row_number() OVER (PARTITION BY anchor, answer ORDER BY conv_id, turn) AS rn FROM j) WHERE rn = 1",
    "toxic_triplets": f"WITH {_TOXIC} SELECT conv_id, turn, array_to_string(terms, ',') AS terms, md5(answer) AS answer, md5(clean_user) AS clean_user FROM (SELECT *, row_number() OVER (PARTITION BY anchor, answer ORDER BY conv_id, turn) AS rn FROM j) WHERE rn = 1",
    "conversation_shapes": f"WITH c AS (SELECT conv_id, turn, {O._SPEAKER} AS speaker, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM conversations), s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM c WHERE t <> '') SELECT conv_id, n::INT AS turn, CASE WHEN conv_id % 4 <> 3 AND speaker NOT IN ('user', 'assistant') THEN 'the ' || speaker ELSE speaker END AS speaker, md5(t) AS text FROM s",
    "seed_words": f"WITH {O.DOCS}, w AS (SELECT DISTINCT lower(trim(unnest(string_split(text, ' ')))) AS text FROM docs) SELECT {fnv64('text')} AS id, text, 'seed_profanity' AS category FROM w WHERE regexp_full_match(text, '[a-z]{{4,24}}')",
    "vector_table": f"""WITH n AS (SELECT lower(n_name) AS text, n_nationkey < 5 AS again FROM nation), r AS (SELECT lower(r_name) AS text FROM region), t AS (SELECT text, bool_or(again) AS again FROM (SELECT * FROM n UNION ALL SELECT text, true FROM r) GROUP BY text)
SELECT {fnv64('text')} AS id, text, CASE WHEN again THEN 'seed_profanity' ELSE 'live_trained_profanity' END AS category, (CASE WHEN again THEN 2 ELSE 1 END)::INT AS version, 8 AS dims FROM t UNION ALL SELECT '1', 'placeholder', 'bootstrap', 1, 8""",
    "text_vectors": f"WITH s AS (SELECT c_custkey AS id, c_name AS t FROM customer), g AS ({grams('s', 16)}), m AS (SELECT id, map_from_entries(list((d, v))) AS m FROM g GROUP BY id) SELECT id AS c_custkey, array_to_string({_VECTOR16}, ',') AS v FROM m",
    "text_forms": r"""WITH p AS (SELECT page_id, regexp_replace(lower(url), '[^\p{L}]', '', 'g') AS term, md5(trim(regexp_replace(regexp_replace(html, '[\n\t]', '  ', 'g'), '\s+', ' ', 'g'))) AS s FROM pages), c AS (SELECT conv_id, min(coalesce(text, '')) AS t FROM conversations WHERE turn = 0 GROUP BY conv_id)
SELECT 'order' AS kind, o_orderkey AS id, strftime(o_orderdate, '%Y%m%d')::INT AS n, '' AS form FROM orders UNION ALL SELECT 'sentence', conv_id, length(regexp_extract(t, '^ *([^.;!?]*)', 1))::INT, '' FROM c UNION ALL SELECT 'page', page_id, length(term)::INT, term || ' ' || s FROM p""",
    "safe_casts": """WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN value::VARCHAR WHEN 1 THEN event_type WHEN 2 THEN '12.75' WHEN 4 THEN '' END AS t FROM events), n AS (SELECT event_id, TRY_CAST(t AS DOUBLE) AS d FROM e)
SELECT event_id, round(coalesce(d, 0.0), 6) AS number, floor(d)::INT AS whole, round(least(greatest(coalesce(d, 0.0), 0.0), 10.0), 6) AS clamped FROM n""",
    "bloom_known_words": f"""WITH b AS (SELECT DISTINCT unnest({O.words("coalesce(text, '')")}) AS word FROM benchmark), c AS (SELECT DISTINCT unnest({O.words("coalesce(text, '')")}) AS word FROM conversations), a AS (SELECT word FROM b UNION SELECT word FROM c),
h AS (SELECT word, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(word, ''), lambda c: ord(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS f, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(word, ''), lambda c: ord(c)::BIGINT)), lambda h, b: (h * 33 + b) & 4294967295) AS j FROM a),
i AS (SELECT word, list_transform(range(7), lambda i: ((f + i * ((j | 1) + i)) & 4294967295) % 40000000) AS bits FROM h), set_ AS (SELECT DISTINCT unnest(bits) AS bit FROM i JOIN b USING (word)), u AS (SELECT DISTINCT word, unnest(bits) AS bit FROM i JOIN c USING (word) WHERE length(word) >= 4)
SELECT word FROM u LEFT JOIN set_ s ON u.bit = s.bit GROUP BY word HAVING count(*) = count(s.bit)""",
    "frequent_phrases": f"""WITH {O.DOCS}, k AS (SELECT word FROM (SELECT DISTINCT doc_id, unnest({O.words('text')}) AS word FROM docs) GROUP BY word HAVING count(*) >= 5), l AS (SELECT unnest(string_split_regex(text, '[.,\\n]')) AS text FROM docs), c AS (SELECT {O.clean('text')} AS cleaned FROM l),
t AS (SELECT DISTINCT list_filter({O.words('cleaned')}, lambda w: length(w) >= 2) AS toks FROM c WHERE length(cleaned) >= 8), s AS (SELECT toks, array_to_string(toks, ' ') AS phrase FROM t WHERE len(toks) BETWEEN 2 AND 24 AND list_has_any(toks, {O.lst(L.TRIGGER_TOKENS)}) AND length(array_to_string(toks, ' ')) BETWEEN 8 AND 180),
u AS (SELECT phrase, unnest(toks) AS word FROM s) SELECT phrase FROM u LEFT JOIN k ON u.word = k.word GROUP BY phrase HAVING count(*) = count(k.word)""",
    "repeated_texts": f"""WITH verdicts(k, verdict, reason, decision, score) AS (VALUES (0, 'block', 'lexical_match', 'block', round(1.0 / (1.0 + exp(-({L.WEIGHTS['bias']} + {L.WEIGHTS['native_exact']} + {L.WEIGHTS['exact']} + {L.WEIGHTS['short_token']}))), 6)), (1, 'allow', 'no_lexical_or_semantic_hit', 'allow', round(1.0 / (1.0 + exp(-({L.WEIGHTS['bias']} + {L.WEIGHTS['digit']} + {L.WEIGHTS['hyphen_only']} * 0 + {L.WEIGHTS['obfuscated']} + {L.WEIGHTS['long_token']}))), 6)), (2, 'block', 'lexical_match', 'block', 1.0))
SELECT conv_id * 1000 + turn AS doc_id, verdict, reason, decision, score::DOUBLE AS score FROM conversations JOIN verdicts ON turn % 3 = k""",
    "message_stream": f"WITH {O.SCORED} SELECT verdict, reason, count(*) AS n FROM verdicts WHERE doc_id % 10 <> 0 AND doc_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL) GROUP BY ALL",
    "training_commands": "SELECT 'train' AS kind, trim(c_name) AS text FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'plain', c_name FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 5 <> 0",
    "live_training": f"SELECT * FROM {values([(1, 'allow', 'no_lexical_or_semantic_hit'), (2, 'allow', 'no_lexical_or_semantic_hit'), (4, 'block', 'semantic_profanity'), (5, 'allow', 'no_lexical_or_semantic_hit')], 'doc_id, verdict, reason')}",
    "violation_counters": "SELECT user_id, count(*) AS violations FROM events WHERE event_type = 'error' GROUP BY user_id",
    "platform_totals": f"WITH {O.MSG} SELECT CASE WHEN channel_id % 2 = 0 THEN 'telegram' ELSE 'discord' END AS platform, count(DISTINCT channel_id) AS channels, count(*) AS scanned, count(*) FILTER (blocked AND word <> '') AS blocked FROM m GROUP BY 1",
    "pipe_fields": "WITH b AS (SELECT p_brand AS value FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10) SELECT 0 AS part, 0 AS line, 'brands' AS value UNION ALL SELECT 0, row_number() OVER (ORDER BY value)::INT, value FROM b UNION ALL SELECT 1, 0, 'regions' UNION ALL SELECT 1, row_number() OVER (ORDER BY r_name)::INT, r_name FROM region",
}
