"""DuckDB SQL for the queries of modwarden.queries, written from their definitions."""

from __future__ import annotations

from modwarden import lexicon as L
from modwarden.plans.mining import STEMS
from modwarden.plans.reports import CHANNELS

ALNUM = "abcdefghijklmnopqrstuvwxyz0123456789"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def ins(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def mapped(s: str) -> str:
    return f"translate(CASE WHEN regexp_matches({s}, '[a-z@$!|+]') THEN translate({s}, '4310578269', 'aeiostbzgg') ELSE {s} END, '@$!|+', 'asiit')"


def norm(t: str) -> str:
    return f"trim(regexp_replace({mapped(f'lower({t})')}, '[^a-z0-9]+', ' ', 'g'))"


def compact(t: str) -> str:
    return f"regexp_replace({mapped(f'lower({t})')}, '[^a-z0-9]+', '', 'g')"


def runs(w: str, least: int, keep: int) -> str:
    for c in ALNUM:
        w = f"regexp_replace({w}, '{c}{{{least},}}', '{c * keep}', 'g')"
    return w


def clean(t: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({t}), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '[^a-z0-9\\s.,!?''-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def alower(t: str) -> str:
    return f"translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tokens(t: str) -> str:
    return f"regexp_extract_all({alower(t)}, '[a-z0-9_]+')"


def words(t: str) -> str:
    return f"regexp_extract_all(lower({t}), '[a-z]+')"


DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
DIGIT, LEET = "regexp_matches(text, '[0-9]')", "regexp_matches(text, '[@$!|+]')"
HARD = "(regexp_matches(text, '[#@$_]') OR regexp_matches(text, '[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}]') OR (regexp_matches(text, '[./\\\\]') AND regexp_matches(text, '[A-Za-z]')))"
HYPHEN = f"(contains(text, '-') AND NOT {DIGIT} AND NOT {LEET} AND NOT {HARD})"
APOSTROPHE, ALPHA = "regexp_matches(text, '[''\\x{2019}]')", "regexp_full_match(text, '[A-Za-z]+')"
HIGH = "(" + " OR ".join(f"contains(' ' || {alower('text')} || ' ', {q(' ' + p + ' ')})" for p in L.HIGH_RISK_PHRASES) + ")"
TRIGGER = f"(list_has_any({tokens('text')}, {lst(L.TRIGGER_TOKENS)}) OR {HIGH})"
LINK = "(" + f"regexp_matches({alower('text')}, '@[a-z0-9_]{{4,}}') OR " + " OR ".join(f"contains({alower('text')}, {q(m)})" for m in L.LINK_MARKS) + ")"
MONEY = f"(regexp_matches(text, '[$€£₽₴]') OR list_has_any({tokens('text')}, {lst(L.MONEY_TOKENS)}))"
URGENCY = f"list_has_any({tokens('text')}, {lst(L.URGENCY_TOKENS)})"
CHUNKS = "list_filter(string_split_regex(text, '\\s+'), lambda c: c <> '')"
GATE = f"({TRIGGER} OR (octet_length(encode(text)) >= 16 AND len({CHUNKS}) >= 3 AND NOT {LEET} AND NOT {HARD} AND ({LINK} OR {MONEY} OR {URGENCY} OR len({CHUNKS}) >= 5)))"
DATE = "regexp_full_match(text, '[0-9]{1,4}([./-][0-9]{1,4}){1,3}')"
_D, _A = "length(regexp_replace(text, '[^0-9]', '', 'g'))", "length(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
NOISE = f"(({_D} >= 3 AND {_A} = 0) OR ({_D} >= 4 AND {_D} >= 2 * {_A}))"
CODE = "(octet_length(encode(text)) >= 4 AND regexp_matches(text, '[0-9]') AND regexp_matches(text, '[._:/-]') AND regexp_full_match(text, '[A-Za-z0-9._:/-]+'))"
MATH = f"(regexp_matches({alower('text')}, '(^|[^a-z])(sin|cos|tan|cot|sec|csc|log|ln|sqrt)([^a-z]|$)') OR (regexp_full_match(text, '[0-9+*/^().,=\\s-]+') AND regexp_matches(text, '[+*/^=-]')))"
RAW = "(" + " OR ".join(f"contains({alower('text')}, {q(w)}) OR contains({norm('text')}, {q(w)})" for w in L.BAD_WORDS) + ")"


def _stream(name: str, w: str) -> str:
    """Candidates of one stream from the table pieces, as tables <name>_p, <name>_c and <name>."""
    canon2 = runs("w", 3, 2)
    heavy = "CASE WHEN length(w) < 3 THEN false WHEN length(w) <= 4 THEN length(regexp_replace(w, '[^aeiou]', '', 'g')) = 0 ELSE length(regexp_replace(w, '[^aeiou]', '', 'g')) / length(w) <= 0.22 END"
    triple = "len(list_filter(range(1, greatest(length(raw) - 1, 1)), lambda i: substr(lower(raw), i, 1) = substr(lower(raw), i + 1, 1) AND substr(lower(raw), i, 1) = substr(lower(raw), i + 2, 1) AND i + 2 <= length(raw))) > 0"
    merges = []
    for n in range(1, 5):
        parts = ["w", *[f"w{k}" for k in range(1, n + 1)]]
        word = " || ".join(parts)
        small = " AND ".join(f"length({p}) <= 3" for p in parts)
        singles = " + ".join(f"(length({p}) = 1)::int" for p in parts)
        flags = " OR ".join(["obf", *[f"o{k}" for k in range(1, n + 1)]])
        merges.append(f"SELECT doc_id, 1 AS ph, p AS a, {n} AS b, {word} AS txt, true AS obf FROM {name}_l WHERE w{n} IS NOT NULL AND {small} AND length({word}) >= 3 AND (({flags}) OR ({singles}) >= 2)")
    leads = ", ".join(f"lead(w, {k}) OVER x AS w{k}, lead(obf, {k}) OVER x AS o{k}" for k in range(1, 5))
    return f"""
{name}_p AS (SELECT doc_id, pos, raw, w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p,
    (regexp_matches(raw, '[^A-Za-z]') OR regexp_matches(lower(raw), 'zz|xx|qq|vv|jj|kk') OR {triple} OR {heavy}) AS obf,
    CASE WHEN length({canon2}) >= 5 THEN regexp_replace({canon2}, 'ie$', 'y') ELSE {canon2} END AS canon
  FROM (SELECT doc_id, pos, raw, {w} AS w FROM pieces) WHERE length(w) BETWEEN 1 AND 24),
{name}_l AS (SELECT *, {leads} FROM {name}_p WINDOW x AS (PARTITION BY doc_id ORDER BY p)),
{name}_c AS (SELECT doc_id, 0 AS ph, p AS a, 0 AS b, w AS txt, obf FROM {name}_p WHERE length(w) >= 2
  UNION ALL SELECT doc_id, 0, p, 1, canon, true FROM {name}_p WHERE obf AND canon <> w
  UNION ALL {' UNION ALL '.join(merges)}),
{name} AS (SELECT doc_id, txt, obf, r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ph, a, b) AS r FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id, txt ORDER BY ph, a, b) AS k FROM {name}_c) WHERE k = 1) WHERE r <= 128)"""


PIECES = f"{DOCS}, pieces AS MATERIALIZED (SELECT doc_id, raw, pos, {compact('raw')} AS c FROM (SELECT doc_id, unnest(l) AS raw, unnest(range(len(l))) AS pos FROM (SELECT doc_id, {CHUNKS} AS l FROM docs)))"
STRICT = f"{PIECES}, {_stream('strict', 'c')}"
MERGED = f"""{STRICT}, {_stream('coll', runs('c', 2, 1))},
both_ AS (SELECT doc_id, txt, obf, r AS o FROM strict UNION ALL SELECT doc_id, txt, obf, 1000 + r FROM coll),
firsts AS (SELECT *, min(o) OVER (PARTITION BY doc_id, txt) AS fo FROM both_),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY fo) AS dr FROM firsts),
cuts AS (SELECT doc_id, min(fo) AS cut FROM ranked WHERE dr = 129 GROUP BY doc_id),
merged AS (SELECT r.doc_id, r.txt, min(dr) - 1 AS pos, bool_or(r.obf) AS obf FROM ranked r LEFT JOIN cuts c ON r.doc_id = c.doc_id
  WHERE dr <= 128 AND (c.cut IS NULL OR r.o < c.cut) GROUP BY r.doc_id, r.txt)"""
BAD_IN, WHITE_IN, CLEAN_IN = ins(L.BAD_WORDS), ins(L.WHITELIST), ins(L.CLEAN_SET)
BAD_TABLE = "bad(word, skeleton) AS (VALUES " + ", ".join(f"({q(w)}, {q(L.skeleton(w))})" for w in L.BAD_WORDS) + ")"
OWN = "CASE WHEN length(regexp_replace(txt, '[aeiou]', '', 'g')) >= 2 THEN regexp_replace(txt, '[aeiou]', '', 'g') ELSE txt END"
CAND = f"""cand AS MATERIALIZED (SELECT doc_id, txt, obf, txt IN {BAD_IN} AS bad, txt IN {WHITE_IN} AS white, (txt IN {CLEAN_IN}) AS clean, {OWN} AS own,
  CASE WHEN obf AND length(txt) > 5 THEN 2 ELSE 1 END AS far FROM merged WHERE length(txt) >= 4)"""
FUZZY = """fuzzy AS (SELECT c.doc_id, c.txt, c.far, c.clean, c.obf, b.word, damerau_levenshtein(c.txt, b.word) AS d FROM cand c JOIN bad b ON substr(c.txt, 1, 1) = substr(b.word, 1, 1) AND right(c.txt, 1) = right(b.word, 1)
  AND length(b.word) BETWEEN greatest(4, length(c.txt) - c.far) AND length(c.txt) + c.far WHERE length(c.txt) <= 24 AND NOT c.white AND NOT (c.clean AND NOT c.obf) AND (c.obf OR length(c.txt) <= 6))"""
SKELETON = """skel AS (SELECT DISTINCT c.doc_id, c.txt, b.skeleton FROM cand c JOIN bad b ON substr(c.own, 1, 1) = substr(b.skeleton, 1, 1) AND length(b.skeleton) BETWEEN greatest(3, length(c.own) - 1) AND length(c.own) + 1
  WHERE length(c.txt) <= 24 AND c.obf AND NOT c.white AND NOT c.clean AND length(c.own) >= 3 AND damerau_levenshtein(c.own, b.skeleton) <= 1)"""
_PHRASE = "CASE " + " ".join(f"WHEN contains(padded, {q(' ' + p + ' ')}) THEN {q(p)}" for p in sorted(L.PHRASES)) + " END"
_LINEAR = " + ".join([str(L.WEIGHTS["bias"]), *[f"(CASE WHEN {k} THEN {v} ELSE 0 END)" for k, v in L.WEIGHTS.items() if k != "bias"]])
SCORED = f"""{MERGED}, {BAD_TABLE}, {CAND}, {FUZZY}, {SKELETON},
strict_agg AS (SELECT doc_id, count(*) AS n, min(txt) AS one, bool_or(obf) AS any_obf,
    bool_or(length(txt) >= 4 AND txt IN {BAD_IN} AND txt NOT IN {WHITE_IN}) AS native_s,
    bool_or(length(txt) BETWEEN 2 AND 3 AND txt IN {ins(L.SHORT_WORDS)} AND txt NOT IN {WHITE_IN} AND txt IN {ins(L.AGGRESSIVE_SHORT)}) AS acro_always,
    bool_or(length(txt) = 3 AND txt IN {ins(L.SHORT_WORDS)} AND txt NOT IN {WHITE_IN}) AS acro_signal,
    bool_and(NOT obf AND length(txt) >= 4 AND txt IN {CLEAN_IN}) AS all_clean FROM strict GROUP BY doc_id),
coll_agg AS (SELECT doc_id, bool_or(length(txt) >= 4 AND obf AND txt IN {BAD_IN} AND txt NOT IN {WHITE_IN}) AS native_c FROM coll GROUP BY doc_id),
ev AS (SELECT doc_id, min(length(txt)) AS min_len, bool_or(obf) AS obfuscated, bool_or(bad AND NOT white) AS exact, bool_or(clean) AS likely FROM cand GROUP BY doc_id),
fz AS (SELECT doc_id, bool_or(d <= 1) AS strong, bool_or(d = 2 AND far = 2 AND obf AND NOT clean) AS weak FROM fuzzy GROUP BY doc_id),
sk AS (SELECT DISTINCT doc_id FROM skel),
base AS (SELECT d.doc_id, d.text, {DIGIT} AS digit, {LEET} AS leet, {HARD} AS hard_separator, {HYPHEN} AS hyphen_only, {APOSTROPHE} AS apostrophe, {ALPHA} AS alpha_only, {HIGH} AS high_risk, {RAW} AS raw_hit, {GATE} AS gate,
    {DATE} AS date_like, {NOISE} AS noise, {CODE} AS code_like, {MATH} AS math_like, {tokens('text')} AS toks, ' ' || array_to_string({tokens('text')}, ' ') || ' ' AS padded FROM docs d),
b1 AS (SELECT b.*, coalesce(s.n, 0) AS n_strict, coalesce(s.n = 1 AND s.one NOT IN {ins(L.TRIGGER_TOKENS)} AND length(s.one) BETWEEN 4 AND 24 AND (s.one IN {WHITE_IN} OR (s.one NOT IN {BAD_IN} AND NOT s.any_obf AND s.one IN {CLEAN_IN})), false) AS skip,
    coalesce(s.acro_always OR (s.acro_signal AND (b.hard_separator OR b.leet)), false) AS acronym, b.raw_hit AND (coalesce(s.native_s, false) OR coalesce(c.native_c, false)) AS native_exact, coalesce(s.all_clean, false) AS all_clean
  FROM base b LEFT JOIN strict_agg s USING (doc_id) LEFT JOIN coll_agg c USING (doc_id)),
b2 AS (SELECT b1.*, (NOT native_exact AND NOT acronym AND alpha_only AND n_strict > 0 AND all_clean) AS no_heuristic,
    CASE WHEN len(toks) BETWEEN 2 AND 48 AND n_strict > 0 AND list_has_any(toks, {lst(L.TRIGGER_TOKENS)}) AND NOT list_has_any(toks, {lst(L.BAD_WORDS)}) AND len(list_filter(toks, lambda t: NOT list_contains({lst(L.WHITELIST + L.CLEAN_SET)}, t))) = 0 THEN {_PHRASE} END AS phrase FROM b1),
b3 AS (SELECT b2.*, coalesce(NOT no_heuristic AND ev.exact, false) AS exact0, coalesce(NOT no_heuristic AND NOT ev.exact AND fz.strong, false) AS strong0, coalesce(NOT no_heuristic AND NOT ev.exact AND fz.weak, false) AS weak0,
    coalesce(NOT no_heuristic AND NOT ev.exact AND sk.doc_id IS NOT NULL, false) AS skel0, coalesce(NOT no_heuristic AND ev.obfuscated, false) AS obfuscated, coalesce(NOT no_heuristic AND NOT ev.exact AND ev.likely, false) AND NOT native_exact AS likely_clean,
    coalesce(NOT no_heuristic AND ev.min_len <= 5, false) AS short_token, coalesce(NOT no_heuristic AND ev.min_len BETWEEN 8 AND 98, false) AS long_token
  FROM b2 LEFT JOIN ev USING (doc_id) LEFT JOIN fz USING (doc_id) LEFT JOIN sk ON b2.doc_id = sk.doc_id),
b4 AS (SELECT *, (NOT native_exact AND NOT acronym AND (exact0 OR strong0 OR weak0 OR skel0) AND (date_like OR noise OR code_like OR (math_like AND NOT exact0 AND NOT strong0))) AS guarded FROM b3),
b5 AS (SELECT *, exact0 AND NOT guarded AS exact, strong0 AND NOT guarded AS fuzzy_strong, weak0 AND NOT guarded AS fuzzy_weak, skel0 AND NOT guarded AS skeleton FROM b4),
b6 AS (SELECT *, CASE WHEN high_risk THEN 8.0::DOUBLE ELSE ({_LINEAR})::DOUBLE END AS linear, (high_risk OR acronym OR native_exact OR exact OR fuzzy_strong OR fuzzy_weak OR skeleton) AS matched FROM b5),
b7 AS (SELECT *, CASE WHEN high_risk THEN 1.0::DOUBLE ELSE 1.0 / (1.0 + exp(-linear)) END AS score FROM b6),
scored AS (SELECT *, CASE WHEN NOT matched THEN 'allow' WHEN high_risk OR acronym OR score >= {L.BLOCK_THRESHOLD} THEN 'block' WHEN score >= {L.REVIEW_THRESHOLD} THEN 'review' ELSE 'allow' END AS decision FROM b7),
reasons AS (SELECT *, CASE WHEN skip THEN 'lexical_skip' WHEN matched THEN 'lexical_match' WHEN phrase IS NOT NULL THEN 'contextual_whitelist_phrase' ELSE 'no_lexical_or_semantic_hit' END AS reason FROM scored),
verdicts AS (SELECT doc_id, CASE WHEN (reason = 'lexical_match' AND decision = 'block') OR reason = 'contextual_whitelist_phrase' THEN 'block' ELSE 'allow' END AS verdict, reason, decision, round(score, 6) AS score, reason = 'no_lexical_or_semantic_hit' AND gate AS needs_semantic FROM reasons)"""

_VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _knn(where: str, least: float) -> str:
    return f"""{_VEC}, near AS (SELECT a.vec_id, b.vec_id AS match, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id {where}),
top AS (SELECT vec_id, match, s FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, match) AS rn FROM near) WHERE rn = 1 AND s >= {least})"""


_BYTES = "list_transform(string_split(c_name, ''), lambda c: ord(c)::BIGINT)"
_TERMS = f"""CASE WHEN len(list_intersect({words('context')}, {lst(L.BAD_WORDS)})) > 0 THEN list_sort(list_distinct(list_intersect({words('context')}, {lst(L.BAD_WORDS)})))
  ELSE list_sort(list_distinct(list_filter({words('context')}, lambda w: regexp_matches(w, {q('|'.join(STEMS))}) AND NOT list_contains({lst(L.WHITELIST)}, w)))) END"""
MINED = f"""c AS (SELECT d.doc_id, d.source, {clean("coalesce(text, '')")} AS context FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
t AS (SELECT *, {_TERMS} AS profane_terms FROM c WHERE length(context) >= 12),
mined AS (SELECT doc_id, source, 1.0::DOUBLE AS toxicity_score, profane_terms, context FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY source, doc_id) AS rn FROM t WHERE len(profane_terms) > 0) WHERE rn = 1)"""
MSG = f"m AS (SELECT event_id, ts, user_id, user_id % {CHANNELS} AS channel_id, event_type AS word, event_type = 'error' AS blocked FROM events)"
OFFENDERS = f"""{MSG}, bad AS (SELECT channel_id, user_id, count(*) AS violations, strftime(max(ts), '%Y-%m-%d') AS last_day FROM m WHERE blocked GROUP BY ALL),
w AS (SELECT channel_id, user_id, word, count(*) AS n FROM m GROUP BY ALL),
top AS (SELECT channel_id, user_id, word AS top_word FROM (SELECT *, row_number() OVER (PARTITION BY channel_id, user_id ORDER BY n DESC, word) AS rn FROM w) WHERE rn = 1),
o AS (SELECT channel_id, user_id, violations, last_day, top_word, left(top_word, 1) || repeat('•', 8) AS masked_word FROM bad JOIN top USING (channel_id, user_id))"""
_DAILY = "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS scanned, count(*) FILTER (event_type = 'error') AS blocked FROM events GROUP BY 1"
_LETTER_WORDS = f"(SELECT doc_id, unnest({words('text')}) AS word FROM docs)"
_SPEAKER = "CASE WHEN regexp_matches(lower(role), 'user|human|prompter') THEN 'user' WHEN regexp_matches(lower(role), 'assistant|bot|model|gpt') THEN 'assistant' ELSE lower(trim(role)) END"
_CLEANED = clean("coalesce(text, '')")

ORACLES = {
    "normalize_documents": f"WITH {DOCS} SELECT doc_id, {norm('text')} AS normalized, length({compact('text')})::INT AS compact_len FROM docs",
    "collapse_repeats": f"WITH {DOCS}, c AS (SELECT doc_id, {compact('text')} AS c FROM docs) SELECT doc_id, md5({runs('c', 2, 1)}) AS collapsed_md5 FROM c",
    "surface_signals": f"WITH {DOCS} SELECT doc_id, {DIGIT} AS digit, {LEET} AS leet, {HARD} AS hard_separator, {HYPHEN} AS hyphen_only, {APOSTROPHE} AS apostrophe, {ALPHA} AS alpha_only FROM docs",
    "risk_signals": f'WITH {DOCS} SELECT doc_id, {HIGH} AS high_risk, {TRIGGER} AS "trigger", {LINK} AS link, {MONEY} AS money, {URGENCY} AS urgency FROM docs',
    "page_signals": f"WITH p AS (SELECT page_id, html AS text FROM pages) SELECT page_id, {LINK} AS link, length({clean('text')})::INT AS cleaned_len FROM p",
    "context_guards": f"""WITH mixed AS (SELECT 'date' AS kind, o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS text FROM orders UNION ALL SELECT 'priority', o_orderkey, o_orderpriority FROM orders
  UNION ALL SELECT 'number', o_orderkey, o_custkey::VARCHAR FROM orders UNION ALL SELECT 'name', c_custkey, c_name FROM customer UNION ALL SELECT 'sum', c_custkey, c_nationkey || '+' || c_custkey FROM customer
  UNION ALL SELECT 'prose', doc_id, coalesce(text, '') FROM documents) SELECT kind, id, {DATE} AS date_like, {NOISE} AS numeric_noise, {CODE} AS code_like, {MATH} AS math_like FROM mixed""",
    "fallback_gate": f"WITH {DOCS} SELECT doc_id, {GATE} AS gate FROM docs",
    "strict_candidates": f"WITH {STRICT} SELECT doc_id, (r - 1)::INT AS pos, txt AS token, obf AS obfuscated FROM strict",
    "merged_candidates": f"WITH {MERGED} SELECT doc_id, pos::INT AS pos, txt AS token, obf AS obfuscated FROM merged",
    "exact_hits": f"WITH {STRICT} SELECT doc_id, txt AS token, obf AS obfuscated FROM strict WHERE length(txt) >= 4 AND txt IN {BAD_IN} AND txt NOT IN {WHITE_IN}",
    "substring_scan": f"WITH {SCORED} SELECT doc_id, native_exact AS valid FROM b1 WHERE raw_hit",
    "fuzzy_strong": f"WITH {MERGED}, {BAD_TABLE}, {CAND}, {FUZZY} SELECT DISTINCT doc_id, txt AS token, word AS bad_word FROM fuzzy WHERE d <= 1",
    "fuzzy_weak": f"WITH {MERGED}, {BAD_TABLE}, {CAND}, {FUZZY} SELECT DISTINCT doc_id, txt AS token, word AS bad_word FROM fuzzy WHERE d = 2 AND far = 2 AND NOT clean",
    "skeleton_hits": f"WITH {MERGED}, {BAD_TABLE}, {CAND}, {SKELETON} SELECT doc_id, txt AS token, skeleton FROM skel",
    "decision_scores": f"WITH {SCORED} SELECT doc_id, matched, decision = 'block' AS is_profane, decision, round(linear, 6) AS linear, round(score, 6) AS score FROM scored",
    "moderation_verdicts": f"WITH {SCORED} SELECT * FROM verdicts",
    "verdict_summary": f"WITH {SCORED} SELECT verdict, reason, count(*) AS n FROM verdicts GROUP BY ALL",
    "verdict_rollup": f"WITH {SCORED} SELECT source, lang, count(*) AS n, count(*) FILTER (verdict = 'block') AS blocked FROM verdicts JOIN documents USING (doc_id) GROUP BY ROLLUP (source, lang)",
    "label_confusion": f"""WITH {SCORED}, j AS (SELECT verdict = 'block' AS hit, toxic = 1 AS bad FROM verdicts JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (hit AND bad) AS tp, count(*) FILTER (hit AND NOT bad) AS fp, count(*) FILTER (NOT hit AND bad) AS fn, count(*) FILTER (NOT hit AND NOT bad) AS tn FROM j),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM c)
SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1, round(CASE WHEN 0.25 * p + r = 0 THEN 0.0 ELSE 1.25 * p * r / (0.25 * p + r) END, 6) AS f05 FROM p""",
    "knn_top1": f"WITH {_knn('', 0.40)} SELECT vec_id, match, round(s, 6) AS score FROM top",
    "knn_filtered": f"WITH {_knn('WHERE b.label IN (0, 1)', 0.30)} SELECT vec_id, match, round(s, 6) AS score FROM top",
    "knn_label_counts": f"WITH {_knn('', 0.40)} SELECT a.label, count(*) AS n, count(*) FILTER (a.label = b.label) AS agree FROM top JOIN v a ON top.vec_id = a.vec_id JOIN v b ON top.match = b.vec_id GROUP BY a.label",
    "seed_terms_round_robin": f"""WITH {DOCS}, w AS (SELECT DISTINCT word FROM {_LETTER_WORDS} WHERE length(word) BETWEEN 4 AND 24 AND word NOT IN {WHITE_IN}),
t AS (SELECT word, substr(word, 1, 1) AS b, row_number() OVER (PARTITION BY substr(word, 1, 1) ORDER BY word) AS turn FROM w) SELECT word, turn FROM t ORDER BY turn, b LIMIT 200""",
    "clean_lexicon_top": f"""WITH {DOCS}, w AS (SELECT word, min(doc_id) AS line FROM {_LETTER_WORDS} WHERE length(word) BETWEEN 3 AND 24 GROUP BY word),
t AS (SELECT word, substr(word, 1, 1) AS b, row_number() OVER (PARTITION BY substr(word, 1, 1) ORDER BY line, word) AS turn FROM w),
f AS (SELECT word, turn FROM t WHERE turn <= {(500 + 25) // 26 + 512} ORDER BY turn, b LIMIT 500) SELECT * FROM f WHERE word NOT IN {BAD_IN} AND word NOT IN {WHITE_IN}""",
    "fnv1a32_bloom_index": f"""WITH h AS (SELECT c_custkey, list_reduce(list_prepend(2166136261::BIGINT, {_BYTES}), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS fnv,
  list_reduce(list_prepend(5381::BIGINT, {_BYTES}), lambda h, b: (h * 33 + b) & 4294967295) AS djb FROM customer)
SELECT c_custkey, fnv, djb, array_to_string(list_transform(range(7), lambda i: ((fnv + i * ((djb | 1) + i)) & 4294967295) % 40000000), ',') AS bits FROM h""",
    "stable_ids": f"""WITH h AS (SELECT c_custkey, c_name, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(c_name, ''), lambda c: ord(c)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS f, sha1('general_scam::' || c_name) AS s FROM customer)
SELECT c_custkey, f::VARCHAR AS fnv64, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-' || substr(s, 13, 4) || '-' || substr(s, 17, 4) || '-' || substr(s, 21, 12) AS uuid FROM h""",
    "upsert_latest": "SELECT user_id AS id, max(event_id) AS version, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "mined_contexts": f"WITH {MINED} SELECT doc_id, source, toxicity_score, array_to_string(profane_terms, ',') AS terms, md5(context) AS context_md5 FROM mined",
    "mined_sources": f"WITH {MINED} SELECT source, count(*) AS n FROM mined GROUP BY source",
    "mined_terms": f"WITH {MINED}, u AS (SELECT doc_id, source, toxicity_score, unnest(profane_terms) AS term FROM mined) SELECT term, max(toxicity_score) AS score, min_by(source, doc_id) AS source, count(*) AS n FROM u GROUP BY term",
    "triplets": f"""WITH r AS (SELECT conv_id, turn, {_SPEAKER} AS role, {_CLEANED} AS t FROM conversations),
f AS (SELECT *, role = 'user' AND length(t) >= 12 AND list_has_any({words('t')}, ['la', 'die']) AS toxic, role = 'user' AND length(t) >= 12 AND NOT list_has_any({words('t')}, ['la', 'die']) AS clean FROM r),
p AS (SELECT f.*, (SELECT max(g.turn) FROM f g WHERE g.conv_id = f.conv_id AND g.turn < f.turn AND g.clean) AS back, (SELECT min(g.turn) FROM f g WHERE g.conv_id = f.conv_id AND g.turn > f.turn AND g.role IN ('user', 'assistant')) AS ahead FROM f WHERE toxic),
j AS (SELECT p.conv_id, p.turn, p.t AS anchor, n.t AS answer, coalesce(c.t, '') AS clean_user FROM p JOIN f n ON n.conv_id = p.conv_id AND n.turn = p.ahead AND n.role = 'assistant' AND length(n.t) >= 12 LEFT JOIN f c ON c.conv_id = p.conv_id AND c.turn = p.back)
SELECT conv_id, turn, md5(anchor) AS anchor, md5(answer) AS answer, md5(clean_user) AS clean_user FROM (SELECT *, row_number() OVER (PARTITION BY anchor, answer ORDER BY conv_id, turn) AS rn FROM j) WHERE rn = 1""",
    "dictionary_build": f"""WITH s AS (SELECT p_type AS w FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT ' ' || x || '* ' FROM (SELECT unnest({lst(L.BAD_WORDS)}) AS x)), n AS (SELECT lower(trim(replace(w, '*', ''))) AS word FROM s)
SELECT DISTINCT word FROM n WHERE length(word) >= 2""",
    "toxic_rows": "WITH s AS (SELECT greatest(0.0, coalesce(l_discount * 10, 0), coalesce(l_tax * 10, 0), coalesce(l_quantity / 50, 0)) AS score, greatest(0.0, l_discount * 10, l_tax * 10) >= 0.5 AS toxic FROM lineitem) SELECT toxic, count(*) AS n, round(max(score), 4) AS top, round(min(score), 4) AS low FROM s GROUP BY toxic",
    "label_states": """WITH l AS (SELECT p_partkey, (['toxic', 'Non-toxic', '0', '1', 'neutral', 'maybe', 'offensive', 'not hate'])[p_size % 8 + 1] AS label FROM part)
SELECT p_partkey, label, CASE WHEN label IN ('Non-toxic', 'not hate', '0') THEN false WHEN label IN ('toxic', 'offensive', '1') THEN true END AS state FROM l""",
    "phrase_containment": "SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "question_sentences": "SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '[^.!;?]{2,}\\?'))::INT AS questions, CASE WHEN length(text) > 40 THEN 41 ELSE length(text) END::INT AS shown FROM conversations",
    "streaming_daily_activity": _DAILY,
    "daily_activity": _DAILY,
    "admin_channels": f"WITH {MSG} SELECT channel_id, count(*) AS scanned, count(*) FILTER (blocked) AS blocked FROM m WHERE channel_id IN (2, 5) GROUP BY channel_id",
    "channel_rollup": f"WITH {MSG} SELECT channel_id, count(*) AS scanned, count(*) FILTER (blocked) AS blocked, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_event, round(count(*) FILTER (blocked) * 100.0::DOUBLE / count(*), 6) AS block_rate FROM m GROUP BY channel_id",
    "overview_totals": f"WITH {MSG} SELECT greatest(count(DISTINCT channel_id), 1) AS channels, count(*) AS scanned, count(*) FILTER (blocked) AS blocked, round(count(*) FILTER (blocked)::DOUBLE / count(*) * 100.0, 6) AS block_rate FROM m",
    "offender_rollup": f"WITH {OFFENDERS} SELECT * FROM o",
    "top_offenders": f"WITH {OFFENDERS} SELECT *, row_number() OVER (ORDER BY violations DESC, channel_id, user_id)::INT AS rank FROM o ORDER BY violations DESC, channel_id, user_id LIMIT 50",
    "top_words": f"WITH {MSG}, w AS (SELECT word, count(*) AS n FROM m WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 10) SELECT word, n, floor(n * 100 / max(n) OVER ())::BIGINT AS percent FROM w",
    "recent_events": f"WITH {MSG} SELECT event_id, channel_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM m WHERE blocked ORDER BY ts DESC, event_id DESC LIMIT 8",
    "distinct_offenders": f"WITH {MSG} SELECT count(DISTINCT user_id) AS offenders FROM m WHERE blocked",
}
