"""SQL counterparts of the remaining queries."""

from __future__ import annotations

from .lexicon import BENCH, FUNCTION_NAMES, RECODED, REPERTOIRE, ROLE_STOPWORDS
from .oracles import _N, _SEGMENTS, GATE, NARRATIVE, NODE, PAIR, SCORE, TAG, _list, _with
from .oracles_logs import _U
from .queries_logs import ACTIONS

_OK = "work_id % 11 <> 0"
_AFRO = "lang IN ('fr', 'es')"
_RECODE = "CASE code " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RECODED.items()) + " ELSE code END"
_TRAD = f"CASE WHEN {_AFRO} THEN code ELSE {_RECODE} END"
_REP = "rep(family_id, code, name, ord) AS (VALUES " + ", ".join(f"('{f}', '{c}', '{FUNCTION_NAMES[c].replace(chr(39), chr(39) * 2)}', {k})" for k, (f, c) in enumerate((f, c) for f, cs in REPERTOIRE for c in cs.split())) + ")"
_PARTIAL = f"""
w AS (SELECT source || '/' || lang || '/' || (doc_id // 100) AS book, doc_id AS chunk, length(text) % 3 <> 0 AS ok, length(text) AS n, md5(text) AS summary FROM documents WHERE {GATE} >= 200),
p AS (SELECT *, 'g' || (n % 3) AS genre, CASE WHEN n % 4 <> 0 THEN 't' || (n % 2) END AS tradition, row_number() OVER (PARTITION BY book, ok ORDER BY chunk) AS part, count(*) OVER (PARTITION BY book, ok) AS parts FROM w),
g AS (SELECT book, genre FROM (SELECT book, genre, row_number() OVER (PARTITION BY book ORDER BY count(*) DESC, min(chunk)) AS r FROM p WHERE ok GROUP BY book, genre) WHERE r = 1),
t AS (SELECT book, tradition FROM (SELECT book, tradition, row_number() OVER (PARTITION BY book ORDER BY count(*) DESC, min(chunk)) AS r FROM p WHERE ok AND tradition IS NOT NULL GROUP BY book, tradition) WHERE r = 1),
k0 AS (SELECT book, part * 2 AS z, 'k' || (n % 7) AS k FROM p WHERE ok UNION ALL SELECT book, part * 2 + 1, 'k' || (n % 30) FROM p WHERE ok),
k1 AS (SELECT book, k, row_number() OVER (PARTITION BY book ORDER BY min(z)) AS r FROM k0 GROUP BY book, k),
ks AS (SELECT book, string_agg(k, ',' ORDER BY r) AS keywords FROM k1 WHERE r <= 20 GROUP BY book),
s AS (SELECT book, md5(string_agg('Partie ' || part || '/' || parts || ' : ' || summary, chr(10) ORDER BY part)) AS summary_md5 FROM p WHERE ok GROUP BY book),
e AS (SELECT book, string_agg('length ' || n, '|' ORDER BY chunk) AS messages FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY chunk) AS r, bool_or(ok) OVER (PARTITION BY book) AS good FROM w) WHERE r <= 3 AND NOT good GROUP BY book),
b AS (SELECT book, count(*) AS n_chunks, count(*) FILTER (NOT ok) AS n_failed, CAST(coalesce(sum(n // 4) FILTER (ok), 0) AS BIGINT) AS tokens FROM p GROUP BY book)
"""


def _html() -> str:
    """Blocks of markup; entities are those that the pages hold."""
    out = "html"
    for pattern, by in [*((rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "''") for t in ("script", "style", "nav", "header", "footer")), (r"(?s)<!--.*?-->", "''"), (r"(?i)<br\b[^>]*>", "chr(10)"), (r"(?i)</?(p|div|h[1-6]|li|blockquote|pre)\b[^>]*>", "chr(1)"), (r"<[a-zA-Z/!?][^>]*>", "''")]:
        out = f"regexp_replace({out}, '{pattern}', {by}, 'g')"
    for name, char in (("quot", '"'), ("middot", "·"), ("copy", "©"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{char}')"
    parts = rf"list_filter(list_transform(string_split({out}, chr(1)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')"
    return f"SELECT page_id, length(t) AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, array_to_string({parts}, chr(10) || chr(10)) AS t FROM pages)"


_HTML = _html()


def _paragraphs(limit: int) -> str:
    """CTEs up to para(doc_id, first, stop, text): lines with offsets, those above the limit as groups of sentences or blocks."""
    capital = "[A-ZÉÈÀÂÎÔÛÜŒÆ]"
    return rf"""
li AS (SELECT doc_id, p, coalesce(sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS beg FROM (SELECT doc_id, unnest(ls) AS p, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
pa AS (SELECT doc_id, beg + length(p) - length(ltrim(p)) AS first, beg + length(p) AS stop, trim(p) AS text FROM li WHERE trim(p) <> ''),
cut AS (SELECT doc_id, first AS base, unnest(ss) AS s, generate_subscripts(ss, 1) AS k FROM (SELECT doc_id, first, string_split(regexp_replace(text, '([.!?])(\s+)({capital})', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), chr(1)) AS ss FROM pa WHERE stop - first > {limit})),
gap AS (SELECT *, greatest(strpos(s, chr(2)) - 1, 0) AS g, substr(s, strpos(s, chr(2)) + 1) AS body FROM cut),
sen AS (SELECT *, base + sum(g + length(body)) OVER (PARTITION BY doc_id, base ORDER BY k) AS stop FROM gap),
grp AS (SELECT doc_id, base, k, 1 AS n, length(body) AS size FROM sen WHERE k = 1 UNION ALL SELECT sen.doc_id, sen.base, sen.k, CASE WHEN size + length(body) > {limit} THEN n + 1 ELSE n END, CASE WHEN size + length(body) > {limit} THEN length(body) ELSE size + length(body) END
  FROM grp JOIN sen ON sen.doc_id = grp.doc_id AND sen.base = grp.base AND sen.k = grp.k + 1),
made AS (SELECT sen.doc_id, sen.base, n, min(stop - length(body)) AS first, max(stop) AS stop, string_agg(trim(body), ' ' ORDER BY sen.k) AS text, count(*) AS m FROM sen JOIN grp ON grp.doc_id = sen.doc_id AND grp.base = sen.base AND grp.k = sen.k GROUP BY ALL),
fit AS (SELECT doc_id, base FROM made GROUP BY ALL HAVING sum(m) >= 3 AND max(stop - first) <= {limit} * 1.2),
blk AS (SELECT doc_id, first AS base, text, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM pa WHERE stop - first > {limit} AND NOT EXISTS (SELECT 1 FROM fit WHERE fit.doc_id = pa.doc_id AND fit.base = pa.first)
  UNION ALL SELECT doc_id, base, text, b, CASE WHEN b + {limit} >= length(text) THEN length(text) WHEN regexp_matches(tail, '[ .!?]') THEN low + 1 + length(tail) - length(regexp_replace(tail, '(?s)^.*[ .!?]', '')) ELSE b + {limit} END
  FROM (SELECT *, greatest(b + {limit} - 200, b + 1) AS low, substr(text, greatest(b + {limit} - 200, b + 1) + 2, b + {limit} - greatest(b + {limit} - 200, b + 1)) AS tail FROM blk WHERE b < length(text))),
para AS (SELECT doc_id, first, stop, text FROM pa WHERE stop - first <= {limit} UNION ALL SELECT doc_id, first, stop, text FROM made WHERE EXISTS (SELECT 1 FROM fit WHERE fit.doc_id = made.doc_id AND fit.base = made.base)
  UNION ALL SELECT doc_id, base + a, base + b, trim(substr(text, a + 1, b - a)) FROM blk WHERE b > 0)
"""


_CHUNKS = """
long AS (SELECT para.*, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS i FROM para WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = para.doc_id AND CAST(trunc(length(d.text) / 4.0 * 1.2) AS INT) > 375)),
seq AS (SELECT doc_id, list(stop - first ORDER BY i) AS sz, list_prepend(0, list(upto ORDER BY i)) AS pre FROM (SELECT *, CAST(sum(stop - first) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto FROM long) GROUP BY doc_id),
walk AS (SELECT doc_id, sz, pre, 0 AS i, 0 AS f, CAST([] AS STRUCT(a INT, b INT)[]) AS done FROM seq
  UNION ALL SELECT doc_id, sz, pre, i + 1, CASE WHEN size > 1500 THEN 0 WHEN f = 0 THEN i + 1 WHEN pre[i + 2] - pre[f] <= 1500 THEN f WHEN pre[i + 2] - pre[t] <= 1500 THEN t ELSE i + 1 END,
    CASE WHEN size > 1500 THEN list_concat(CASE WHEN f > 0 THEN list_append(done, {'a': f, 'b': i}) ELSE done END, [{'a': i + 1, 'b': i + 1}]) WHEN f = 0 OR pre[i + 2] - pre[f] <= 1500 THEN done
      WHEN pre[i + 2] - pre[t] <= 1500 THEN list_append(done, {'a': f, 'b': i}) ELSE list_concat(done, [{'a': f, 'b': i}, {'a': t, 'b': i}]) END
  FROM (SELECT *, sz[i + 1] AS size, CASE WHEN f > 0 THEN greatest(f, least(i, coalesce(list_min(list_filter(range(f, i + 1), lambda j: pre[i + 1] - pre[j] <= 300)), i))) END AS t FROM walk WHERE i < len(sz))),
ends AS (SELECT doc_id, CASE WHEN f > 0 THEN list_append(done, {'a': f, 'b': i}) ELSE done END AS done FROM walk WHERE i = len(sz)),
rng AS (SELECT doc_id, unnest(done) AS r, generate_subscripts(done, 1) - 1 AS chunk FROM ends),
chs AS (SELECT doc_id, 0 AS chunk, CAST(0 AS BIGINT) AS char_start, length(text) AS char_end, md5(text) AS text_md5 FROM documents WHERE trim(text, chr(10) || ' ') <> '' AND CAST(trunc(length(text) / 4.0 * 1.2) AS INT) <= 375
  UNION ALL SELECT rng.doc_id, chunk, min(first), max(stop), md5(string_agg(text, chr(10) || chr(10) ORDER BY long.i)) FROM rng JOIN long ON long.doc_id = rng.doc_id AND long.i BETWEEN rng.r.a AND rng.r.b GROUP BY rng.doc_id, chunk)
"""
_ROLE = rf"list_distinct(list_filter(regexp_extract_all(lower(x), '[a-zàâäéèêëïîôöùûüç]{{3,}}'), lambda w: NOT list_contains({_list(ROLE_STOPWORDS.split())}, w)))"
_WORDS = r"list_distinct(regexp_extract_all(lower(x), '[a-zàâäéèêëïîôöùûüç]{3,}'))"
_J = lambda a, b: f"len(list_intersect({a}, {b})) / CAST(greatest(len(list_distinct(list_concat({a}, {b}))), 1) AS DOUBLE)"
_EV = "ev AS (SELECT event_id AS id, ts, user_id, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ACTIONS.items()) + " END AS action, value / 100 AS score FROM events), late AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM ev)"

MORE = {
    "paragraph_spans": _with(_paragraphs(400)) + "SELECT doc_id, CAST(first AS BIGINT) AS first, CAST(stop AS BIGINT) AS \"end\", md5(text) AS text_md5 FROM para",
    "chunk_overlap": _with(_paragraphs(1500), _CHUNKS) + "SELECT doc_id, chunk, 'Bloc ' || (chunk + 1) || '/' || count(*) OVER w AS label, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, text_md5, chunk > 0 AS has_overlap_before, chunk < count(*) OVER w - 1 AS has_overlap_after FROM chs WINDOW w AS (PARTITION BY doc_id)",
    "token_estimates": "SELECT doc_id, CAST(floor(length(text) / 4 * CAST(1.20 AS DOUBLE)) AS INT) AS tokens, floor(length(text) / 4 * CAST(1.20 AS DOUBLE)) > 140000 AS split FROM documents",
    "cost_forecast": "SELECT doc_id, i AS tokens_in, o AS tokens_out, round((i * 3.0 + o * CAST(15.0 AS DOUBLE)) / 1000000, 9) AS cost_usd, round((i * 3.0 + o * CAST(15.0 AS DOUBLE)) / 1000000 * CAST(0.93 AS DOUBLE), 9) AS cost_eur FROM (SELECT doc_id, length(text) // 4 + 2000 AS i, least(16000, greatest(2000, length(text) // 20)) AS o FROM documents)",
    "parse_responses": _with(_SEGMENTS) + f"SELECT work_id, CASE WHEN {_OK} THEN 'ok' ELSE 'error' END AS status, CASE WHEN {_OK} THEN source END AS genre, CASE WHEN {_OK} THEN len(chunks) END AS n_nodes, CASE WHEN {_OK} AND work_id % 3 = 1 THEN 'hero' END AS lead_v2 FROM folded",
    "cultural_recode": _with(*TAG) + f"SELECT low.work_id, low.pos, code AS given_code, {_TRAD} AS function_code FROM low LEFT JOIN tags ON tags.work_id = low.work_id AND tags.pos = low.pos WHERE low.{_OK}",
    "response_nodes": _with(*NODE) + f"SELECT nodes.work_id, 'n' || lpad(CAST(nodes.pos + 1 AS VARCHAR), 3, '0') AS node_id, len(actants) AS n_actants, [0.4, 1.0, 0.5, 0.5, 0.0][CAST(nodes.pos % 5 + 1 AS INT)] AS tension, 0.3 AS vouloir, 0.0 AS devoir, least(150, length(seg.text)) + CASE WHEN nodes.pos % 2 = 0 THEN 10 ELSE 0 END AS excerpt_chars FROM nodes JOIN seg ON seg.work_id = nodes.work_id AND seg.pos = nodes.pos WHERE nodes.{_OK}",
    "response_edges_distant": _with(*NODE) + f"SELECT a.work_id, a.pos AS src_pos, min(b.pos) AS dst_pos FROM nodes a JOIN nodes b ON a.work_id = b.work_id AND b.pos BETWEEN a.pos + 2 AND a.pos + 4 WHERE len(list_intersect(list_transform(a.actants, lambda x: lower(trim(x))), list_transform(b.actants, lambda x: lower(trim(x))))) >= 2 AND {_OK.replace('work_id', 'a.work_id')} GROUP BY a.work_id, a.pos",
    "recurring_lines_removed": r"WITH h AS (SELECT doc_id, list(line) AS heads FROM (" + NARRATIVE["recurring_lines"] + r") GROUP BY doc_id) SELECT d.doc_id, md5(CASE WHEN heads IS NULL OR lang NOT IN ('fr', 'de') THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(heads, regexp_replace(x, '^\s+|\s+$', '', 'g'))), chr(10)) END) AS text_md5 FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id",
    "scan_flags": rf"SELECT doc_id, array_to_string(list_filter([CASE WHEN {GATE} = 0 THEN 'empty' END, CASE WHEN {_N('text')} < 30 THEN 'short' END, CASE WHEN p >= 3 AND {GATE} < 50 * p THEN 'scanned' END], lambda x: x IS NOT NULL), ',') AS flags FROM (SELECT *, len(string_split(text, chr(10))) AS p FROM documents)",
    "html_text": _HTML,
    "read_works": "SELECT lang, 'txt' AS format, 'ok' AS status, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY lang UNION ALL SELECT DISTINCT lang, 'json', 'unsupported', CAST(0 AS BIGINT) FROM documents",
    "decoded_texts": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "response_edges": _with(*NODE) + f"SELECT work_id, transition_type, count(*) AS n FROM (SELECT work_id, CASE WHEN list_has_any(list_transform(actants, lambda a: lower(a)), list_transform(a2, lambda a: lower(a))) THEN 'causal' WHEN phase <> p2 THEN 'temporal' ELSE 'sequential' END AS transition_type FROM (SELECT *, lead(actants) OVER w AS a2, lead(phase) OVER w AS p2 FROM nodes WINDOW w AS (PARTITION BY work_id ORDER BY pos)) WHERE p2 IS NOT NULL AND {_OK}) GROUP BY ALL",
    "merge_majority": "WITH " + _PARTIAL.strip() + " SELECT b.book, n_chunks, n_failed, CASE WHEN n_failed = n_chunks THEN 'error' WHEN n_failed > 0 THEN 'partial' ELSE 'ok' END AS status, genre, tradition, tokens, keywords, summary_md5, coalesce(messages, '') AS messages FROM b LEFT JOIN e ON e.book = b.book LEFT JOIN g ON g.book = b.book LEFT JOIN t ON t.book = b.book LEFT JOIN ks ON ks.book = b.book LEFT JOIN s ON s.book = b.book",
    "graph_metadata": _with(_SEGMENTS) + f"SELECT work_id, CASE WHEN {_OK} THEN 'llm' ELSE 'error' END AS mode, {_OK} AND {_AFRO} AS african, CASE WHEN {_OK} AND work_id % 3 < 2 THEN 'hero' END AS lead FROM folded",
    "analyses_with_graphs": _with(_SEGMENTS) + "SELECT event_id AS id, user_id AS graph_id, len(chunks) AS n_nodes FROM events LEFT JOIN folded ON work_id = user_id WHERE event_type IN ('click', 'view')",
    "replace_messages": "SELECT conv_id, count(*) AS n, max(turn) AS last_turn FROM conversations WHERE role <> 'system' GROUP BY conv_id",
    "merge_dedup": _with(*TAG) + r""", rw AS (SELECT low.work_id, low.pos, t.code, list_distinct(regexp_extract_all(lo, '[\p{L}\p{N}_]{4,}')) AS ws FROM low LEFT JOIN tags t ON t.work_id = low.work_id AND t.pos = low.pos),
o AS (SELECT work_id, pos // 2 AS chunk, pos, code, ws FROM rw UNION ALL SELECT work_id, pos // 2 + 1, pos, code, ws FROM rw WHERE pos % 2 = 1),
per AS (SELECT work_id, list({'chunk': chunk, 'pos': pos, 'code': code, 'ws': ws, 'keep': true} ORDER BY chunk, pos) AS ns FROM o GROUP BY work_id),
folds AS (SELECT work_id, list_reduce(list_transform(ns, lambda n: [n]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.chunk = x[1].chunk - 1 AND coalesce(k.code = x[1].code, true) AND least(len(k.ws), len(x[1].ws)) > 0 AND len(list_intersect(k.ws, x[1].ws)) / CAST(greatest(least(len(k.ws), len(x[1].ws)), 1) AS DOUBLE) > 0.5)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM per)
SELECT work_id, n.chunk AS chunk, n.pos AS pos FROM (SELECT work_id, unnest(kept) AS n FROM folds)""",
    "greimas_alignment": _with(*NODE) + f""", ends AS (SELECT work_id, array_to_string(arg_min(actants, pos), ' ') AS hero, array_to_string(arg_max(actants, pos), ' ') AS foe FROM nodes GROUP BY work_id),
e AS (SELECT work_id, hero, foe, {_ROLE.replace('lower(x)', 'lower(hero)')} AS hw, {_ROLE.replace('lower(x)', 'lower(foe)')} AS fw, {_WORDS.replace('lower(x)', 'lower(hero)')} AS aw FROM ends),
j AS (SELECT a.work_id AS ref_id, b.work_id AS cand_id, CASE WHEN a.hero = '' AND b.hero = '' THEN 0.5 WHEN len(a.hw) > 0 AND len(b.hw) > 0 THEN {_J('a.hw', 'b.hw')} END AS h, CASE WHEN a.foe = '' AND b.foe = '' THEN 0.5 WHEN len(a.fw) > 0 AND len(b.fw) > 0 THEN {_J('a.fw', 'b.fw')} END AS f, CASE WHEN len(a.aw) = 0 OR len(b.aw) = 0 THEN 0.5 ELSE 1 - {_J('a.aw', 'b.aw')} END AS d FROM e a JOIN e b ON a.work_id <> b.work_id WHERE a.work_id % 100 = 0)
SELECT ref_id, cand_id, round((2.0 + coalesce(h, 0) + coalesce(f, 0)) / (4 + CAST(h IS NOT NULL AS INT) + CAST(f IS NOT NULL AS INT)), 6) AS s_greimas, 'v1↔v1' AS label, round(d, 6) AS focus_delta FROM j""",
    "repertoire_usage": _with(*TAG, _REP) + "SELECT tags.code AS function_code, name AS function_name, family_id, family_id = 'FN' AS african, count(*) AS n FROM tags JOIN rep ON rep.code = tags.code GROUP BY ALL",
    "repertoire_search": "WITH " + _REP + ", described AS (SELECT rep.*, d FROM rep LEFT JOIN (VALUES " + ", ".join(f"('{c}', '{' '.join(ws)}')" for c, _, ws in BENCH.patterns) + r") v(c, d) ON c = code), terms AS (SELECT DISTINCT unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS term FROM documents) SELECT term, count(*) AS total, string_agg(code, ',' ORDER BY ord) FILTER (r <= 20) AS codes FROM (SELECT term, code, ord, row_number() OVER (PARTITION BY term ORDER BY ord) AS r FROM terms JOIN described ON code = upper(term) OR contains(lower(name), term) OR contains(lower(coalesce(d, '')), term)) GROUP BY term",
    "graph_documents": _with(*NODE) + """, seq AS (SELECT work_id, count(*) - 1 AS n FROM nodes GROUP BY work_id), far AS (SELECT a.work_id, a.pos FROM nodes a JOIN nodes b ON a.work_id = b.work_id AND b.pos BETWEEN a.pos + 2 AND a.pos + 4 WHERE len(list_intersect(a.actants, b.actants)) >= 2 GROUP BY a.work_id, a.pos), fars AS (SELECT work_id, count(*) AS n FROM far GROUP BY work_id)
SELECT p.work_id, n_nodes, peak, CASE WHEN seq.n + coalesce(fars.n, 0) > 0 THEN seq.n + coalesce(fars.n, 0) END AS n_edges, CASE WHEN seq.n + coalesce(fars.n, 0) > 0 THEN round(seq.n + coalesce(fars.n, 0) * CAST(0.6 AS DOUBLE), 6) END AS weight FROM (SELECT work_id, count(*) AS n_nodes, round(max(tension), 6) AS peak FROM nodes GROUP BY work_id) p JOIN seq ON seq.work_id = p.work_id LEFT JOIN fars ON fars.work_id = p.work_id""",
    "store_summary": _with(_SEGMENTS) + "SELECT work_id, source AS author, lang, len(chunks) AS n_nodes FROM folded",
    "report_rows": _with(*SCORE) + ", r AS (SELECT scores.*, CASE WHEN srj < 0.25 THEN 'Faible' WHEN srj < 0.55 THEN 'Modéré' WHEN srj < 0.80 THEN 'Élevé' ELSE 'Critique' END AS srj_level, p.ref_t, p.cand_t FROM scores JOIN pairs p ON p.ref_id = scores.ref_id AND p.cand_id = scores.cand_id) SELECT ref_id, cand_id, srj_level, CASE srj_level WHEN 'Faible' THEN 'green' WHEN 'Modéré' THEN 'orange' WHEN 'Élevé' THEN 'red' ELSE 'darkred' END AS colour, array_to_string(list_transform(ref_t, lambda t: CASE WHEN list_max(ref_t) > 0 THEN CAST(floor(t / list_max(ref_t) * 50) AS INT) ELSE 0 END), ',') AS ref_bars, array_to_string(list_transform(cand_t, lambda t: CASE WHEN list_max(cand_t) > 0 THEN CAST(floor(t / list_max(cand_t) * 50) AS INT) ELSE 0 END), ',') AS cand_bars FROM r",
    "markdown_export": _with(*PAIR) + "SELECT work_id, md5('# Work ' || work_id || chr(10) || chr(10) || '- nodes: ' || n || chr(10) || '- functions: ' || array_to_string(codes, ' → ') || chr(10)) AS markdown_md5 FROM profiles",
    "stream_usage_windows": "WITH " + _EV + ", wn AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01 00:00:00') - INTERVAL 6 HOUR * k AS start FROM ev, (SELECT unnest(range(4)) AS k) WHERE action IN ('analyze_llm', 'comparison')) SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM wn, (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM ev WHERE action IN ('analyze_llm', 'comparison')) late WHERE start + INTERVAL 24 HOUR <= mark GROUP BY ALL",
    "stream_quota": "WITH " + _EV + ", b AS (SELECT *, count(*) OVER day AS used_24h, count(*) OVER month AS used_30d, min(ts) OVER day AS earliest FROM ev WHERE action IN ('analyze_llm', 'comparison') WINDOW day AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW), month AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW)) SELECT user_id, id, used_24h, used_30d, (epoch_us(earliest) + 86400000000 - epoch_us(ts)) // 3600000000 AS hours FROM b WHERE ts <= (SELECT max(ts) - INTERVAL 1 HOUR FROM b)",
    "stream_usage_log": "WITH " + _EV + " SELECT user_id, action, count(*) AS n, round(sum(score), 4) AS cost, CAST(0 AS BIGINT) AS tokens FROM ev GROUP BY user_id, action",
    "stream_rate_limits": "WITH " + _EV + " SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM ev, late WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark GROUP BY 1, 2 HAVING count(*) > 1",
    "stream_sessions": "WITH " + _EV + ", g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, id) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM r, late GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= any_value(mark)",
    "stream_notifications": "WITH " + _EV + " SELECT id, CASE WHEN score >= 0.55 THEN 'ip' ELSE 'comparison' END AS notice, CAST(round(score * 100) AS INT) AS value FROM ev WHERE action = 'comparison'",
    "stream_analysis": _with(*NODE) + "SELECT work_id, pos, code AS function_code, phase FROM nodes",
    "node_table": _with(*NODE) + f"SELECT nodes.work_id, nodes.pos + 1 AS sequence, code AS function_code, phase, CAST(round(CAST(round(tension, 9) AS DECIMAL(18, 9)), 2) AS DOUBLE) AS tension, {_N('seg.text')} AS word_count FROM nodes JOIN seg ON seg.work_id = nodes.work_id AND seg.pos = nodes.pos",
    "majority_actants": f"""WITH w AS (SELECT concat_ws('/', lang, source, left(text, 1)) AS book, doc_id AS chunk, length(text) AS n FROM documents WHERE {GATE} >= 200),
r AS (SELECT book, chunk, 'protagoniste' AS role, 'p' || (n % 5) AS actant FROM w UNION ALL SELECT book, chunk, 'objet', 'o' || (n % 2) FROM w WHERE n % 3 <> 0 UNION ALL SELECT book, chunk, 'opposant', 'r' || (n % 7) FROM w WHERE n % 2 = 0)
SELECT book, role, actant FROM (SELECT book, role, actant, row_number() OVER (PARTITION BY book, role ORDER BY count(*) DESC, min(chunk)) AS k FROM r GROUP BY book, role, actant) WHERE k = 1""",
    "append_analyses": _U + """SELECT id, graph_id, strftime(ts, '%d/%m/%Y à %H:%M') AS date_human, mode, coalesce(title, 'Sans titre') AS title, CASE WHEN tokens % 3 <> 0 THEN tokens ELSE 0 END AS n_nodes,
CASE WHEN mode = 'llm' THEN round(coalesce(cost_usd, 0), 4) END AS cost_usd, CASE WHEN mode = 'llm' THEN coalesce(tokens, 0) END AS tokens_total FROM analyses""",
    "append_usage": _U + "SELECT user_id, action, count(*) AS n, round(sum(coalesce(cost_usd, 0)), 4) AS cost, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens FROM usage GROUP BY user_id, action",
}
