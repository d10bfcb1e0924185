"""SQL counterparts of the queries, for an independent engine on the same tables."""

from __future__ import annotations

from .lexicon import BENCH, STOP_NAMES

GATE = r"length(regexp_replace(text, '^\s+|\s+$', '', 'g'))"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B-\x1F\x7F]', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_N = lambda s: rf"len(regexp_extract_all({s}, '\S+'))"

_SEGMENTS = rf"""
works AS (SELECT doc_id AS work_id, lang, source, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents WHERE {GATE} >= 200),
sized AS (SELECT *, {_N('body')} AS words FROM works),
aimed AS (SELECT *, CASE WHEN words < 200 THEN 40 WHEN words < 500 THEN 80 WHEN words < 1500 THEN 150 ELSE 180 END AS target FROM sized),
cut AS (SELECT *, CASE WHEN words > 2 * target THEN list_transform(string_split(regexp_replace(body, '([.!?])\s+([A-ZÉÀÊÎÔ])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: {{'done': CAST([] AS VARCHAR[]), 'cur': s, 'n': CAST({_N('s')} AS BIGINT)}}) END AS sents FROM aimed),
folded AS (SELECT *, CASE WHEN sents IS NULL THEN [body] ELSE list_transform([list_reduce(sents, lambda a, x: CASE WHEN a.n + x.n > target THEN {{'done': list_append(a.done, a.cur), 'cur': x.cur, 'n': x.n}} ELSE {{'done': a.done, 'cur': a.cur || ' ' || x.cur, 'n': a.n + x.n}} END)], lambda r: list_append(r.done, r.cur))[1] END AS chunks FROM cut),
seg AS (SELECT work_id, lang, source, len(chunks) AS total, unnest(chunks) AS text, unnest(range(len(chunks))) AS pos FROM folded),
low AS (SELECT *, lower(text) AS lo, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS toks, pos / CAST(greatest(total - 1, 1) AS DOUBLE) AS ratio FROM seg)
"""

_LEXICON = "lexicon(ord, code, family, kw) AS (VALUES " + ", ".join(f"({k}, '{c}', '{f}', '{w}')" for k, (c, f, ws) in enumerate(BENCH.patterns) for w in ws) + ")"
_TAGS = """
hits AS (SELECT work_id, pos, ord, code, family, count(*) AS n FROM (SELECT work_id, pos, unnest(toks) AS tok FROM low) JOIN lexicon ON kw = tok GROUP BY ALL),
tags AS (SELECT work_id, pos, code, family FROM (SELECT *, row_number() OVER (PARTITION BY work_id, pos ORDER BY n DESC, ord) AS r FROM hits) WHERE r = 1)
"""
_PHASE = "CASE " + " ".join(f"WHEN list_has_any(toks, {_list(ws)}) THEN '{p}'" for p, ws in BENCH.phases) + " WHEN ratio < 0.20 THEN 'Exposition' WHEN ratio < 0.55 THEN 'Complication' WHEN ratio < 0.80 THEN 'Climax' ELSE 'Résolution' END"


def _count(words) -> str:
    return "(" + " + ".join(f"CAST(contains(lo, '{w}') AS INT)" for w in words) + ")"


_TENSION = f"greatest(0.0, least(1.0, CAST(0.3 AS DOUBLE) + CAST(0.5 AS DOUBLE) * (1 - abs(ratio - CAST(0.7 AS DOUBLE))) + CAST(0.08 AS DOUBLE) * {_count(BENCH.high)} - CAST(0.05 AS DOUBLE) * {_count(BENCH.low)}))"


def _modality(words) -> str:
    return "least(1.0, " + " + ".join(["CAST(0 AS DOUBLE)"] + [f"CASE WHEN contains(lo, '{w}') THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END" for w in words]) + ")"


_NAMES = rf"""
marked AS (SELECT work_id, pos, regexp_replace(text, '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(2), 'g') AS m FROM seg),
names AS (SELECT work_id, pos, list_transform(regexp_extract_all(m, '\x01[A-Z][a-zà-ÿ]+(?:\x02\s+(?:\x01de\x02 |\x01d\x02'')?\x01[A-Z][a-zà-ÿ]+)?\x02'), lambda s: replace(replace(s, chr(1), ''), chr(2), '')) AS ns FROM marked),
each_name AS (SELECT work_id, pos, unnest(ns) AS name, unnest(range(len(ns))) AS loc FROM names),
counted AS (SELECT work_id, pos, name, count(*) AS n, min(loc) AS seen FROM each_name GROUP BY ALL),
top20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY work_id, pos ORDER BY n DESC, seen) AS r FROM counted) WHERE r <= 20 AND length(name) >= 3 AND NOT list_contains({_list(STOP_NAMES.split())}, name)),
kept AS (SELECT *, row_number() OVER (PARTITION BY work_id, pos ORDER BY r) AS k FROM top20),
ents AS (SELECT work_id, pos, list(name ORDER BY k) AS es FROM (SELECT *, row_number() OVER (PARTITION BY work_id, pos ORDER BY k) AS z FROM kept WHERE n >= 2 OR k <= 3) WHERE z <= 10 GROUP BY work_id, pos)
"""
_NODES = f"""
nodes AS (SELECT low.work_id, low.pos, low.total, low.lang, low.source, t.code, t.family, coalesce(e.es, CAST([] AS VARCHAR[]))[1:6] AS actants, {_PHASE} AS phase, {_TENSION} AS tension,
  {', '.join(f'{_modality(ws)} AS {n}' for n, ws in BENCH.modalities)}
  FROM low LEFT JOIN tags t ON t.work_id = low.work_id AND t.pos = low.pos LEFT JOIN ents e ON e.work_id = low.work_id AND e.pos = low.pos)
"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(p.strip() for p in parts) + " "


SEG = (_SEGMENTS,)
TAG = (*SEG, _LEXICON, _TAGS)
NODE = (*TAG, _NAMES, _NODES)
_PROFILES = """
per AS (SELECT work_id, any_value(source) AS source, count(*) AS n, list(code ORDER BY pos) FILTER (code IS NOT NULL) AS codes0, list(tension ORDER BY pos) AS tensions, flatten(list(actants ORDER BY pos)) AS actants FROM nodes GROUP BY work_id),
profiles AS (SELECT *, coalesce(codes0, CAST([] AS VARCHAR[])) AS codes FROM per),
pairs AS (SELECT a.work_id AS ref_id, b.work_id AS cand_id, a.n AS n_ref, b.n AS n_cand, a.codes AS ref_codes, b.codes AS cand_codes, a.tensions AS ref_t, b.tensions AS cand_t, a.actants AS ref_a, b.actants AS cand_a
  FROM profiles a JOIN profiles b ON a.work_id <> b.work_id WHERE a.work_id % 100 = 0)
"""
PAIR = (*NODE, _PROFILES)
_SIMS = """
sims AS (SELECT r.work_id AS ref_id, c.work_id AS cand_id, c.pos AS cand_pos, r.pos AS ref_pos, c.code AS cand_code, r.code AS ref_code, r.actants AS ra, c.actants AS ca,
  CASE WHEN r.phase = c.phase THEN CAST(0.10 AS DOUBLE) ELSE 0 END AS ph, CASE WHEN abs(r.tension - c.tension) < CAST(0.15 AS DOUBLE) THEN CAST(0.05 AS DOUBLE) ELSE 0 END AS te,
  CASE WHEN len(r.actants) > 0 AND len(c.actants) > 0 THEN CAST(0.20 AS DOUBLE) * (len(list_intersect(list_transform(r.actants, lambda x: lower(trim(x))), list_transform(c.actants, lambda x: lower(trim(x))))) / CAST(len(list_distinct(list_transform(list_concat(r.actants, c.actants), lambda x: lower(trim(x))))) AS DOUBLE)) ELSE 0 END AS ac,
  sqrt(r.vouloir * r.vouloir + r.devoir * r.devoir + r.pouvoir * r.pouvoir + r.savoir * r.savoir) AS nr, sqrt(c.vouloir * c.vouloir + c.devoir * c.devoir + c.pouvoir * c.pouvoir + c.savoir * c.savoir) AS nc,
  r.vouloir * c.vouloir + r.devoir * c.devoir + r.pouvoir * c.pouvoir + r.savoir * c.savoir AS dot,
  CASE WHEN r.code = c.code THEN CAST(0.60 AS DOUBLE) WHEN r.family = c.family THEN CAST(0.15 AS DOUBLE) END AS kin
  FROM nodes r JOIN nodes c ON r.work_id <> c.work_id WHERE r.work_id % 100 = 0),
simmed AS (SELECT *, CASE WHEN kin IS NULL THEN ph + te ELSE kin + ac + ph + te + CAST(0.05 AS DOUBLE) * CASE WHEN nr > 0 AND nc > 0 THEN dot / (nr * nc) ELSE 0 END END AS sim FROM sims),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_id, cand_id, cand_pos ORDER BY sim DESC, ref_pos) AS r FROM simmed) WHERE r = 1),
weighed AS (SELECT *, CASE WHEN cand_code IS NULL THEN 1.0 ELSE 1.0 / sqrt(CAST(count(*) OVER (PARTITION BY ref_id, cand_id, cand_code) AS DOUBLE)) END AS w FROM best),
iso AS (SELECT ref_id, cand_id, coalesce(sum(w) FILTER (sim >= CAST(0.40 AS DOUBLE)), 0) / sum(w) AS s_iso FROM weighed GROUP BY ref_id, cand_id)
"""
_LCS = "CASE WHEN len(pa) = 0 OR len(pb) = 0 THEN 0 ELSE list_reduce(pa, lambda prev, x: list_reduce(range(len(pb)), lambda acc, j: list_append(acc, CASE WHEN pb[j + 1] = x THEN (CASE WHEN j > 0 THEN prev[j] ELSE 0 END) + 1 ELSE greatest(prev[j + 1], coalesce(acc[j], 0)) END), CAST([] AS BIGINT[])), list_transform(pb, lambda y: CAST(0 AS BIGINT)))[len(pb)] END"
_PARTS = f"""
plain AS (SELECT *, list_filter(ref_codes, lambda x: NOT starts_with(x, 'FN')) AS pa, list_filter(cand_codes, lambda x: NOT starts_with(x, 'FN')) AS pb,
  len(list_intersect(ref_codes, cand_codes)) AS common, len(list_distinct(list_concat(ref_codes, cand_codes))) AS either,
  least(len(ref_t), len(cand_t), 20) AS L,
  list_reverse_sort(list_transform(list_distinct(ref_a), lambda x: len(list_filter(ref_a, lambda y: y = x)))) AS rc, list_reverse_sort(list_transform(list_distinct(cand_a), lambda x: len(list_filter(cand_a, lambda y: y = x)))) AS cc FROM pairs),
curves AS (SELECT *, least(3, len(rc), len(cc)) AS k, {_LCS} AS lcs,
  CASE WHEN len(ref_t) = L THEN ref_t ELSE list_transform(range(L), lambda i: list_transform([i * (len(ref_t) - 1) / CAST(greatest(L - 1, 1) AS DOUBLE)], lambda p: ref_t[CAST(floor(p) AS INT) + 1] * (1 - (p - floor(p))) + ref_t[least(CAST(floor(p) AS INT) + 1, len(ref_t) - 1) + 1] * (p - floor(p)))[1]) END AS ta,
  CASE WHEN len(cand_t) = L THEN cand_t ELSE list_transform(range(L), lambda i: list_transform([i * (len(cand_t) - 1) / CAST(greatest(L - 1, 1) AS DOUBLE)], lambda p: cand_t[CAST(floor(p) AS INT) + 1] * (1 - (p - floor(p))) + cand_t[least(CAST(floor(p) AS INT) + 1, len(cand_t) - 1) + 1] * (p - floor(p)))[1]) END AS tb FROM plain),
centred AS (SELECT *, list_transform(ta, lambda x: x - list_sum(ta) / len(ta)) AS ca, list_transform(tb, lambda x: x - list_sum(tb) / len(tb)) AS cb FROM curves),
moments AS (SELECT *, list_sum(list_transform(range(len(ca)), lambda i: ca[i + 1] * cb[i + 1])) AS num, sqrt(list_sum(list_transform(ca, lambda x: x * x))) AS da, sqrt(list_sum(list_transform(cb, lambda x: x * x))) AS db FROM centred),
parts AS (SELECT ref_id, cand_id, n_ref, n_cand, ref_codes, cand_codes, lcs, ta, tb,
  CASE WHEN len(ref_codes) = 0 AND len(cand_codes) = 0 THEN 0.5 WHEN len(ref_codes) = 0 OR len(cand_codes) = 0 THEN 0 ELSE (common / CAST(either AS DOUBLE)) * (1 - CAST(0.3 AS DOUBLE) * abs(n_ref - n_cand) / greatest(n_ref, n_cand)) END AS s_ged,
  CASE WHEN len(ref_codes) = 0 OR len(cand_codes) = 0 THEN 0 WHEN len(pa) = 0 OR len(pb) = 0 THEN 0.5 ELSE sqrt(lcs / CAST(greatest(len(pa), len(pb)) AS DOUBLE)) END AS s_func,
  CASE WHEN k > 0 THEN least(list_sum(rc[1:k]), list_sum(cc[1:k])) / CAST(greatest(list_sum(rc[1:k]), list_sum(cc[1:k])) AS DOUBLE) ELSE 0 END AS s_chain,
  CASE WHEN L = 0 THEN 0 WHEN L < 3 OR da = 0 OR db = 0 THEN 0.5 ELSE (num / (da * db) + 1) / 2 END AS s_tens FROM moments)
"""
_SCORES = """
joined AS (SELECT parts.*, iso.s_iso, (s_chain + 0.5) / 2 AS s_act, n_cand / CAST(greatest(n_ref, 1) AS DOUBLE) AS ratio FROM parts JOIN iso ON iso.ref_id = parts.ref_id AND iso.cand_id = parts.cand_id),
summed AS (SELECT *, CAST(0.25 AS DOUBLE) * s_iso + CAST(0.20 AS DOUBLE) * s_ged + CAST(0.25 AS DOUBLE) * s_func + CAST(0.15 AS DOUBLE) * s_act + CAST(0.15 AS DOUBLE) * s_tens AS sns,
  (CASE WHEN list_contains(ref_codes, 'F49') = list_contains(cand_codes, 'F49') THEN 0 ELSE 0.5 END) AS moral FROM joined),
classed AS (SELECT *, greatest(0, (sns - CAST(0.4 AS DOUBLE)) / CAST(0.6 AS DOUBLE)) AS ss, greatest(0, least(1, ((1 - s_iso) + 0 + 0.5 + 0.5 + moral) / 5)) AS st,
  CASE WHEN NOT (s_iso >= 0.45 AND s_func >= 0.35) THEN CASE WHEN s_iso < 0.25 THEN 'none' ELSE 'partial' END
    WHEN ratio > 1.4 AND s_func > 0.45 THEN 'amplification' WHEN ratio < 0.7 AND s_func > 0.45 THEN 'condensation' WHEN s_tens < 0.3 AND s_iso > 0.45 THEN 'inversion'
    WHEN s_iso >= 0.55 AND s_func >= 0.45 AND ratio > 0.8 AND ratio < 1.3 THEN 'transposition' WHEN s_iso < 0.55 OR s_func < 0.45 THEN 'hybridation' ELSE 'partial' END AS modality FROM summed),
scores AS (SELECT *, CAST(0.4 AS DOUBLE) * sns + CAST(0.4 AS DOUBLE) * ss + CASE WHEN modality = 'none' THEN 0 ELSE CAST(0.1 AS DOUBLE) END AS srj FROM classed)
"""
SCORE = (*PAIR, _SIMS, _PARTS, _SCORES)

NARRATIVE = {
    "clean_text": f"SELECT doc_id, length(c) AS n_chars, {_N('c')} AS n_words, md5(c) AS text_md5 FROM (SELECT doc_id, {_CLEAN} AS c FROM documents)",
    "word_counts": rf"SELECT doc_id, length(text) AS char_count, {_N('text')} AS word_count FROM documents",
    "quality_flags": rf"SELECT doc_id, array_to_string(list_filter([CASE WHEN {GATE} = 0 THEN 'empty' END, CASE WHEN {_N('text')} < 30 THEN 'short' END], lambda x: x IS NOT NULL), ',') AS flags FROM documents",
    "admission": f"SELECT doc_id, {GATE} >= 50 AS can_segment, {GATE} >= 200 AS can_analyse FROM documents",
    "page_number_lines": r"SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(trim(x), '\d{1,4}|[\-\s]*\d{1,4}[\-\s.]*')), chr(10))) AS text_md5 FROM documents",
    "recurring_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents), t AS (SELECT doc_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM l)
SELECT doc_id, line, count(*) AS n FROM t WHERE length(line) BETWEEN 1 AND 79 AND NOT regexp_matches(line, '^\p{Ll}') GROUP BY ALL HAVING count(*) >= 3""",
    "segments": _with(*SEG) + f"SELECT work_id, pos, total, {_N('text')} AS word_count, md5(text) AS text_md5 FROM seg",
    "segment_offsets": _with(*SEG) + """, walk AS (SELECT folded.work_id, folded.text, 0 AS pos, chunks, CASE WHEN length(chunks[1]) < 50 THEN 0 ELSE strpos(text, left(chunks[1], 50)) - 1 END AS f, 0 AS prev FROM folded
UNION ALL SELECT work_id, text, pos + 1, chunks, CASE WHEN length(chunks[pos + 2]) < 50 THEN e ELSE CASE WHEN strpos(substr(text, e + 1), left(chunks[pos + 2], 50)) = 0 THEN -1 ELSE strpos(substr(text, e + 1), left(chunks[pos + 2], 50)) - 1 + e END END, e
FROM (SELECT *, CASE WHEN f >= 0 THEN f ELSE prev END + length(chunks[pos + 1]) AS e FROM walk) WHERE pos + 1 < len(chunks))
SELECT work_id, pos, greatest(f, 0) AS start_char, CASE WHEN f >= 0 THEN f ELSE prev END + length(chunks[pos + 1]) AS end_char FROM walk""",
    "entities": _with(*SEG, _NAMES) + "SELECT seg.work_id, seg.pos, coalesce(array_to_string(es, '|'), '') AS entities FROM seg LEFT JOIN ents ON ents.work_id = seg.work_id AND ents.pos = seg.pos",
    "actions": _with(*SEG) + f"SELECT work_id, pos, array_to_string(list_filter({_list(BENCH.verbs)}, lambda v: list_contains(toks, v))[1:8], '|') AS actions FROM low",
    "function_tags": _with(*TAG) + "SELECT low.work_id, low.pos, code AS function_code, family AS function_family FROM low LEFT JOIN tags ON tags.work_id = low.work_id AND tags.pos = low.pos",
    "phases": _with(*SEG) + f"SELECT work_id, pos, {_PHASE} AS phase FROM low",
    "tension": _with(*SEG) + f"SELECT work_id, pos, round({_TENSION}, 6) AS tension FROM low",
    "modalities": _with(*SEG) + f"SELECT work_id, pos, {', '.join(f'round({_modality(ws)}, 6) AS {n}' for n, ws in BENCH.modalities)} FROM low",
    "nodes": _with(*NODE) + "SELECT work_id, 'n' || lpad(CAST(pos + 1 AS VARCHAR), 3, '0') AS node_id, code AS function_code, array_to_string(actants, '|') AS actants, phase, round(tension, 6) AS tension FROM nodes",
    "dictionary_nodes": _with(*NODE) + "SELECT work_id, 'n' || lpad(CAST(pos + 1 AS VARCHAR), 3, '0') AS node_id, code AS function_code, array_to_string(actants, '|') AS actants, phase, round(tension, 6) AS tension, round(vouloir, 6) AS vouloir, round(devoir, 6) AS devoir, round(pouvoir, 6) AS pouvoir, round(savoir, 6) AS savoir FROM nodes",
    "edges_sequential": _with(*NODE) + "SELECT work_id, pos AS src_pos, CASE WHEN list_has_any(actants, a2) THEN 'causal' WHEN phase <> p2 THEN 'temporal' ELSE 'sequential' END AS transition_type FROM (SELECT *, lead(actants) OVER w AS a2, lead(phase) OVER w AS p2 FROM nodes WINDOW w AS (PARTITION BY work_id ORDER BY pos)) WHERE p2 IS NOT NULL",
    "edges_distant": _with(*NODE) + "SELECT a.work_id, a.pos AS src_pos, min(b.pos) AS dst_pos FROM nodes a JOIN nodes b ON a.work_id = b.work_id AND b.pos BETWEEN a.pos + 2 AND a.pos + 4 WHERE len(list_intersect(a.actants, b.actants)) >= 2 GROUP BY a.work_id, a.pos",
    "work_rollup": _with(*NODE) + "SELECT work_id, count(*) AS n_nodes, coalesce(string_agg(code, ' ' ORDER BY pos), '') AS function_sequence, len(list_distinct(flatten(list(actants)))) AS n_actants, round(max(tension), 6) AS peak_tension FROM nodes GROUP BY work_id",
    "function_histogram": _with(*TAG) + "SELECT low.lang, code AS function_code, count(*) AS n, count(DISTINCT low.work_id) AS n_works FROM low JOIN tags ON tags.work_id = low.work_id AND tags.pos = low.pos GROUP BY ALL",
    "node_similarity": _with(*NODE, _SIMS) + "SELECT ref_id, cand_id, cand_pos, ref_pos, round(sim, 6) AS similarity FROM best",
    "correspondences_topk": _with(*NODE, _SIMS) + "SELECT ref_id, cand_id, rank, cand_pos, ref_pos, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY ref_id, cand_id ORDER BY sim DESC, cand_pos) AS rank FROM best WHERE sim >= CAST(0.40 AS DOUBLE)) WHERE rank <= 15",
    "s_iso": _with(*NODE, _SIMS) + "SELECT ref_id, cand_id, round(s_iso, 6) AS s_iso FROM iso",
    "s_ged": _with(*PAIR, _PARTS) + "SELECT ref_id, cand_id, round(s_ged, 6) AS s_ged FROM parts",
    "s_func_lcs": _with(*PAIR, _PARTS) + "SELECT ref_id, cand_id, lcs, round(s_func, 6) AS s_func FROM parts",
    "actant_persistence": _with(*PAIR, _PARTS) + "SELECT ref_id, cand_id, round(s_chain, 6) AS persistence FROM parts",
    "tension_resample": _with(*PAIR, _PARTS) + "SELECT ref_id, cand_id, len(ta) AS n_points, round(list_sum(ta), 6) AS ref_sum, round(list_sum(tb), 6) AS cand_sum FROM parts",
    "s_tens": _with(*PAIR, _PARTS) + "SELECT ref_id, cand_id, round(s_tens, 6) AS s_tens FROM parts",
    "pair_scores": _with(*SCORE) + "SELECT ref_id, cand_id, round(sns, 6) AS sns, round(least(1, sns * CAST(1.15 AS DOUBLE)), 6) AS sns_normalized, round(ss, 6) AS ss, round(st, 6) AS st, round(srj, 6) AS srj FROM scores",
    "modality_class": _with(*SCORE) + "SELECT ref_id, cand_id, modality FROM scores",
    "risk_level": _with(*SCORE) + "SELECT ref_id, cand_id, CASE WHEN srj < 0.25 THEN 'Faible' WHEN srj < 0.55 THEN 'Modéré' WHEN srj < 0.80 THEN 'Élevé' ELSE 'Critique' END AS srj_level, CASE WHEN sns < 0.30 THEN 'different' WHEN sns < 0.50 THEN 'conventional' WHEN sns < 0.70 THEN 'notable' ELSE 'close' END AS verdict FROM scores",
    "warnings": _with(*SCORE) + "SELECT ref_id, cand_id, 'decision_support' || CASE WHEN sns > 0.70 THEN ',high_score' ELSE '' END || CASE WHEN n_ref < 5 OR n_cand < 5 THEN ',short_text' ELSE '' END || CASE WHEN len(ref_codes) / CAST(n_ref AS DOUBLE) < 0.4 THEN ',few_functions' ELSE '' END AS warnings FROM scores",
    "transformation": _with(*SCORE) + "SELECT ref_id, cand_id, round(1 - s_iso, 6) AS structure_delta, moral AS moral_delta, round(st, 6) AS st FROM scores",
    "topk_similar": _with(*SCORE) + "SELECT ref_id, rank, cand_id, round(sns, 6) AS sns FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY round(sns, 9) DESC, cand_id) AS rank FROM scores) WHERE rank <= 10",
    "score_percentile": _with(*SCORE) + "SELECT ref_id, cand_id, round(percent_rank() OVER (PARTITION BY ref_id ORDER BY round(sns, 9)), 6) AS percentile FROM scores",
    "candidate_pairs": _with(*PAIR) + "SELECT ref_id, cand_id FROM pairs WHERE list_has_any(ref_codes, cand_codes) OR (len(ref_codes) > 0 AND len(cand_codes) > 0 AND (len(list_filter(ref_codes, lambda x: NOT starts_with(x, 'FN'))) = 0 OR len(list_filter(cand_codes, lambda x: NOT starts_with(x, 'FN'))) = 0))",
}
