"""SQL counterparts of the queries on reports, exports, forms, roles, merges and service tables."""

from __future__ import annotations

from .lexicon import LENGTH_CATEGORIES, REGISTER_DISTANCE
from .operators.compare import VERDICTS, WEIGHTS
from .oracles import _CLEAN, _N, _PARTS, _SCORES, _SIMS, GATE, NODE, PAIR, SCORE, SEG, TAG, _list, _with
from .oracles_logs import _NOW, _U, LOGS
from .oracles_more import _REP, _ROLE, _WORDS, MORE
from .queries_reports import LENGTHS, NAMES, REGISTERS

_FORMS = f"""WITH w AS (SELECT doc_id AS work_id, lang AS form, length(text) AS n FROM documents WHERE {GATE} >= 200),
f AS (SELECT *, CASE WHEN n % 6 <> 0 THEN {_list(REGISTERS)}[n % {len(REGISTERS)} + 1] END AS reg, CASE WHEN n % 7 <> 0 THEN n % 5 + 1 ELSE {LENGTH_CATEGORIES["moyen"]} END AS size,
  CASE WHEN n % 3 <> 0 THEN n % 2 = 0 ELSE n % 5 = 0 END AS moral, CASE WHEN n % 4 <> 0 THEN n % 8 < 4 END AS told FROM w),
near(a, b, d) AS (VALUES {", ".join(f"('{x}', '{y}', {d})" for a, b, d in REGISTER_DISTANCE for x, y in ((a, b), (b, a)))}) """
_ROLES = f"""WITH w AS (SELECT doc_id AS work_id, length(text) AS n, {_list(NAMES)} AS names FROM documents WHERE {GATE} >= 200),
v AS (SELECT work_id, n % 11 <> 0 OR n % 3 = 0 AS has1, n % 11 <> 0 OR n % 3 = 1 AS has2,
  CASE WHEN n % 3 = 0 THEN names[n % 5 + 1] || ' ' || names[n % 4 + 1] WHEN n % 11 <> 0 THEN names[n % 6 + 1] END AS l1, CASE WHEN n % 3 = 0 THEN '' WHEN n % 11 <> 0 THEN 'lion' END AS o1,
  CASE WHEN n % 3 = 1 THEN names[n % 2 + 1] WHEN n % 11 <> 0 THEN names[n % 6 + 1] END AS l2, CASE WHEN n % 3 = 1 THEN names[n % 5 + 1] WHEN n % 11 <> 0 THEN 'lion' END AS o2 FROM w),
t AS (SELECT *, {", ".join(f"list_distinct(list_filter(string_split(coalesce({c}, ''), ' '), lambda x: length(x) >= 3 AND x <> 'les')) AS w{c}" for c in ("l1", "o1", "l2", "o2"))} FROM v)
"""


def _role(c: str, d: str) -> str:
    """Jaccard of one role of two versions; null if it is left out."""
    shared = f"len(list_intersect(a.w{c}, b.w{d})) / CAST(len(list_distinct(list_concat(a.w{c}, b.w{d}))) AS DOUBLE)"
    return f"CASE WHEN coalesce(a.{c}, '') = '' AND coalesce(b.{d}, '') = '' THEN 0.5 WHEN len(a.w{c}) > 0 AND len(b.w{d}) > 0 THEN {shared} END"


def _version(i: int, j: int) -> str:
    lead, foe = _role(f"l{i}", f"l{j}"), _role(f"o{i}", f"o{j}")
    mean = f"(2.0 + coalesce({lead}, 0) + coalesce({foe}, 0)) / (4 + CAST(({lead}) IS NOT NULL AS INT) + CAST(({foe}) IS NOT NULL AS INT))"
    return f"CASE WHEN a.has{i} AND b.has{j} THEN {mean} ELSE 0 END AS s{i}{j}"


_FULL = f"""
shape AS (SELECT n.work_id, count(*) AS n, list(actants ORDER BY pos) AS who, list(code ORDER BY pos) AS cs, list(actants ORDER BY round(tension, 9) DESC, pos)[1] AS top, max(round(tension, 9)) AS peak FROM nodes n GROUP BY n.work_id),
told AS (SELECT shape.*, CASE WHEN len(string_split(text, chr(10))) > 3 THEN 'vers' ELSE 'prose' END AS form, CASE WHEN n > 1 THEN {_list(REGISTERS)}[CAST(least({len(REGISTERS) - 1}, floor(peak * {len(REGISTERS)})) AS INT) + 1] END AS reg,
  CASE {" ".join(f"WHEN {_N('text')} < {most} THEN {LENGTH_CATEGORIES[name]}" for name, most in LENGTHS)} ELSE {LENGTH_CATEGORIES["tres_long"]} END AS size, CASE WHEN lang = 'fr' THEN coalesce(cs[n] = 'F49', false) ELSE list_contains(cs, 'F49') END AS moral, CASE WHEN lang <> 'de' THEN contains(text, '?') END AS asks,
  array_to_string(who[1], ' ') AS l1, array_to_string(who[n], ' ') AS o1, array_to_string(top, ' ') AS l2, array_to_string(who[n // 2 + 1], ' ') AS b2, true AS has1, n >= 3 AS has2 FROM shape JOIN documents ON doc_id = work_id),
cast_ AS (SELECT work_id, form, reg, size, moral, asks, has1, has2, {", ".join(f"trim({c}) AS {c}, list_transform([{c}], lambda x: {_ROLE})[1] AS w{c}" for c in ("l1", "o1", "l2", "b2"))}, list_transform([l1], lambda x: {_WORDS})[1] AS lead FROM told),
near(a, b, d) AS (VALUES {", ".join(f"('{x}', '{y}', {d})" for a, b, d in REGISTER_DISTANCE for x, y in ((a, b), (b, a)))})
"""


def _alignment(i: int, j: int) -> str:
    """Mean of the roles that two versions fill; two of six are filled in each, others in both are empty."""
    filled = {1: {"p": "l1", "o": "o1"}, 2: {"p": "l2", "b": "b2"}}
    none = lambda x: f"coalesce({x}, '') = ''"
    parts, empty = [], 6 - len(filled[i].keys() | filled[j].keys())
    for role in sorted(filled[i].keys() | filled[j].keys()):
        c, d = filled[i].get(role), filled[j].get(role)
        if c and d:
            parts.append(f"CASE WHEN {none('a.' + c)} AND {none('b.' + d)} THEN 0.5 WHEN len(a.w{c}) > 0 AND len(b.w{d}) > 0 THEN len(list_intersect(a.w{c}, b.w{d})) / CAST(len(list_distinct(list_concat(a.w{c}, b.w{d}))) AS DOUBLE) END")
        else:
            parts.append(f"CASE WHEN {none('a.' + c if c else 'b.' + d)} THEN 0.5 END")
    mean = f"({empty * 0.5} + {' + '.join(f'coalesce({x}, 0)' for x in parts)}) / ({empty} + {' + '.join(f'CAST(({x}) IS NOT NULL AS INT)' for x in parts)})"
    return f"CASE WHEN a.has{i} AND b.has{j} THEN {mean} ELSE 0 END AS s{i}{j}"


_FULL_SCORES = f"""
combos AS (SELECT a.work_id AS ref_id, b.work_id AS cand_id, (CASE WHEN a.form = b.form THEN 0 ELSE 1 END + abs(a.size - b.size) / CAST(4 AS DOUBLE)) / 2 AS form_delta,
  CASE WHEN a.reg IS NULL OR b.reg IS NULL THEN 0.5 WHEN a.reg = b.reg THEN 0 ELSE coalesce(CAST(d AS DOUBLE), CAST(0.7 AS DOUBLE)) END AS register_delta,
  CASE WHEN len(a.lead) = 0 OR len(b.lead) = 0 THEN 0.5 ELSE 1 - len(list_intersect(a.lead, b.lead)) / CAST(len(list_distinct(list_concat(a.lead, b.lead))) AS DOUBLE) END AS focus_delta,
  (CASE WHEN a.moral = b.moral THEN 0 ELSE 1 END + CASE WHEN a.asks IS NULL OR b.asks IS NULL OR a.asks = b.asks THEN 0 ELSE 1 END) / CAST(2 AS DOUBLE) AS moral_delta, {", ".join(_alignment(i, j) for i in (1, 2) for j in (1, 2))}
  FROM cast_ a JOIN cast_ b ON a.work_id <> b.work_id LEFT JOIN near ON near.a = a.reg AND near.b = b.reg WHERE a.work_id % 100 = 0),
""" + _SCORES.replace("joined AS (SELECT parts.*,", "joined AS (SELECT parts.*, combos.* EXCLUDE (ref_id, cand_id), greatest(s11, s12, s21, s22) AS s_greimas,", 1).replace("(s_chain + 0.5) / 2", "(s_chain + greatest(s11, s12, s21, s22)) / 2", 1).replace("iso.cand_id = parts.cand_id)", "iso.cand_id = parts.cand_id JOIN combos ON combos.ref_id = parts.ref_id AND combos.cand_id = parts.cand_id)", 1).replace("((1 - s_iso) + 0 + 0.5 + 0.5 + moral) / 5", "((1 - s_iso) + form_delta + register_delta + focus_delta + moral_delta) / 5", 1).strip()
_REPORT = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY ref_id, cand_id ORDER BY sim DESC, cand_pos) AS z FROM best WHERE sim >= CAST(0.40 AS DOUBLE)),
found AS (SELECT ref_id, cand_id, count(*) AS n, string_agg(concat_ws(':', ref_pos, cand_pos, ref_code, cand_code), ',' ORDER BY z) AS best, string_agg('- ' || (ref_pos + 1) || ' → ' || (cand_pos + 1), ',' ORDER BY z) AS marks FROM ranked WHERE z <= 15 GROUP BY ref_id, cand_id),
shown AS (SELECT s.*, coalesce(f.n, 0) AS n, coalesce(best, '') AS best, coalesce(marks, '') AS marks, CASE WHEN srj < 0.25 THEN 'Faible' WHEN srj < 0.55 THEN 'Modéré' WHEN srj < 0.80 THEN 'Élevé' ELSE 'Critique' END AS srj_level FROM scores s LEFT JOIN found f ON f.ref_id = s.ref_id AND f.cand_id = s.cand_id) """
_MODE = lambda c: f"CASE WHEN {c} % 3 = 0 THEN 'llm' ELSE 'heuristic' END"
_SHOWN = lambda c: f"CAST(round(CAST(round({c}, 9) AS DECIMAL(18, 9)), 3) AS DOUBLE)"
_DEDUP = MORE["merge_dedup"]
_CUT = _DEDUP.rindex("SELECT work_id, n.chunk")

_DEC = lambda c, n=2: f"CAST(CAST(CAST(round({c}, 9) AS DECIMAL(28, 9)) AS DECIMAL(28, {n})) AS VARCHAR)"
_VERDICT = f"CASE WHEN sns < 0.30 THEN $${VERDICTS[0][1]}$$ WHEN sns < 0.50 THEN printf($${VERDICTS[1][1]}$$, round(round(ss, 9), 2)) WHEN sns < 0.70 THEN printf($${VERDICTS[2][1]}$$, modality) ELSE printf($${VERDICTS[3][1]}$$, modality) END"
_NL = "chr(10)"

REPORTS = {
    "analysis_documents": _with(*NODE, _REP) + f""", e AS (SELECT work_id, pos, concat_ws({_NL}, '### ' || (pos + 1) || '. ' || coalesce(rep.name, nodes.code, 'Nœud ' || (pos + 1)), '- Code : ' || nodes.code, '- Famille : ' || family, CASE WHEN len(actants) > 0 THEN '- Actants : ' || array_to_string(actants, ', ') END,
  '- Modalités : ' || {" || ', ' || ".join(f"'{m}=' || {_DEC(m)}" for m in ("vouloir", "devoir", "pouvoir", "savoir"))}, '- Tension : ' || {_DEC("tension")} || ', phase ' || phase, '- Extrait : ' || replace(left(nodes.text, 150), chr(10), ' ')) AS entry FROM (SELECT nodes.* EXCLUDE (text), seg.text FROM (SELECT *, '' AS text FROM nodes) nodes JOIN seg ON seg.work_id = nodes.work_id AND seg.pos = nodes.pos) nodes LEFT JOIN rep ON rep.code = nodes.code),
g AS (SELECT work_id, count(*) AS n, string_agg(entry, chr(10) || chr(10) ORDER BY pos) AS entries FROM e GROUP BY work_id),
r AS (SELECT work_id, array_to_string(arg_min(actants, pos), ' ') AS lead, array_to_string(arg_max(actants, pos), ' ') AS foe FROM nodes GROUP BY work_id),
t AS (SELECT g.work_id, concat_ws({_NL}, '# ' || source || ' ' || g.work_id || {_NL}, '- Auteur : ' || source, '- Mode : ' || CASE WHEN g.work_id % 3 = 0 THEN 'llm' ELSE 'heuristic' END, {_NL} || '## Résumé' || {_NL} || {_NL} || left(text, 200),
  CASE WHEN g.work_id % 3 = 0 THEN {_NL} || '## Caractérisation' || {_NL} || {_NL} || '- Genre : ' || lang END, CASE WHEN lead <> '' OR foe <> '' THEN {_NL} || '## Rôles' || {_NL} || {_NL} || concat_ws({_NL}, CASE WHEN lead <> '' THEN '- Protagoniste : ' || lead END, CASE WHEN foe <> '' THEN '- Opposant : ' || foe END) END,
  {_NL} || '## Nœuds' || {_NL} || {_NL} || n || {_NL} || {_NL} || entries, CASE WHEN g.work_id % 3 = 0 THEN {_NL} || '---' || {_NL} || {_NL} || 'Coût : ' || {_DEC("length(text) / CAST(1000 AS DOUBLE)", 4)} || ' USD, ' || (length(text) // 4) || ' tokens' END) AS md FROM g JOIN r ON r.work_id = g.work_id JOIN documents ON doc_id = g.work_id)
SELECT work_id, length(md) AS n_chars, md5(md) AS markdown_md5 FROM t""",
    "comparison_texts": _with(*SCORE) + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY ref_id, cand_id ORDER BY sim DESC, cand_pos) AS z FROM best WHERE sim >= CAST(0.40 AS DOUBLE)),
found AS (SELECT ref_id, cand_id, string_agg('- ' || (ref_pos + 1) || ' ' || coalesce(ref_code, '—') || ' → ' || (cand_pos + 1) || ' ' || coalesce(cand_code, '—') || ' : ' || {_DEC("sim", 3)}, {_NL} ORDER BY z) AS marks FROM ranked WHERE z <= 15 GROUP BY ref_id, cand_id),
t AS (SELECT s.ref_id, s.cand_id, concat_ws({_NL}, '# œuvre ' || s.ref_id || ' / œuvre ' || s.cand_id, {_NL} || '## Scores' || {_NL} || {_NL} || concat_ws({_NL}, '| Mesure | Valeur |', '|-|-|', {", ".join(f"'| {n.upper()} | ' || {_DEC(n, 3)} || ' |'" for n in ("sns", "ss", "st", "srj"))}, {", ".join(f"'| {n} ({w}) | ' || {_DEC(n, 3)} || ' |'" for n, w in WEIGHTS)}),
  {_NL} || '## Classes' || {_NL} || {_NL} || '- Niveau : ' || CASE WHEN srj < 0.25 THEN 'Faible' WHEN srj < 0.55 THEN 'Modéré' WHEN srj < 0.80 THEN 'Élevé' ELSE 'Critique' END || {_NL} || '- Modalité : ' || modality, {_NL} || '## Verdict' || {_NL} || {_NL} || {_VERDICT}, {_NL} || '## Correspondances' || {_NL} || {_NL} || marks) AS md FROM scores s LEFT JOIN found f ON f.ref_id = s.ref_id AND f.cand_id = s.cand_id)
SELECT ref_id, cand_id, length(md) AS n_chars, md5(md) AS markdown_md5 FROM t""",
    "sql_clean": f"SELECT doc_id, md5(c) AS text_md5, {_N('c')} AS n_words, CAST(trunc(length(c) / 4.0 * 1.2) AS INT) AS tokens, round(len(list_intersect(string_split(c, ' '), ['de', 'the', 'und'])) / CAST(len(list_distinct(list_concat(string_split(c, ' '), ['de', 'the', 'und']))) AS DOUBLE), 6) AS overlap, 200 AS quota FROM (SELECT doc_id, {_CLEAN} AS c FROM documents)",
    "sql_top": _with(*SCORE) + "SELECT ref_id, place, cand_id, round(sns, 6) AS sns, CASE WHEN 0.8 * sns < 0.25 THEN 'Faible' WHEN 0.8 * sns < 0.55 THEN 'Modéré' WHEN 0.8 * sns < 0.80 THEN 'Élevé' ELSE 'Critique' END AS level FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ref_id ORDER BY round(sns, 9) DESC, cand_id) AS INT) AS place FROM scores) WHERE place <= 5",
    "full_comparison": _with(*PAIR, _SIMS, _PARTS, _FULL, _FULL_SCORES) + f"""SELECT ref_id, cand_id, {", ".join(f"round({n}, 6) AS {n}" for n in ("s_iso", "s_ged", "s_func", "s_act", "s_tens", "s_greimas", "sns", "ss", "st", "srj", "form_delta", "register_delta", "focus_delta", "moral_delta"))}, round(1 - s_iso, 6) AS structure_delta,
CASE WHEN s11 = s_greimas THEN 'v1↔v1' WHEN s12 = s_greimas THEN 'v1↔v2' WHEN s21 = s_greimas THEN 'v2↔v1' ELSE 'v2↔v2' END AS alignment, modality, CASE WHEN srj < 0.25 THEN 'Faible' WHEN srj < 0.55 THEN 'Modéré' WHEN srj < 0.80 THEN 'Élevé' ELSE 'Critique' END AS srj_level,
CASE WHEN sns < 0.30 THEN $${VERDICTS[0][1]}$$ WHEN sns < 0.50 THEN printf($${VERDICTS[1][1]}$$, round(round(ss, 9), 2)) WHEN sns < 0.70 THEN printf($${VERDICTS[2][1]}$$, modality) ELSE printf($${VERDICTS[3][1]}$$, modality) END AS verdict FROM scores""",
    "form_deltas": _FORMS + """SELECT a.work_id AS ref_id, b.work_id AS cand_id, round((CASE WHEN a.form = b.form THEN 0 ELSE 1 END + abs(a.size - b.size) / CAST(4 AS DOUBLE)) / 2, 6) AS form_delta,
round(CASE WHEN a.reg IS NULL OR b.reg IS NULL THEN 0.5 WHEN a.reg = b.reg THEN 0 ELSE coalesce(CAST(d AS DOUBLE), CAST(0.7 AS DOUBLE)) END, 6) AS register_delta,
(CASE WHEN a.moral = b.moral THEN 0 ELSE 1 END + CASE WHEN a.told IS NULL OR b.told IS NULL OR a.told = b.told THEN 0 ELSE 1 END) / CAST(2 AS DOUBLE) AS moral_delta
FROM f a JOIN f b ON a.work_id <> b.work_id LEFT JOIN near ON near.a = a.reg AND near.b = b.reg WHERE a.work_id % 100 = 0""",
    "role_alignment": _ROLES + f""", j AS (SELECT a.work_id AS ref_id, b.work_id AS cand_id, (a.has1 OR a.has2) AND (b.has1 OR b.has2) AS there, {", ".join(_version(i, j) for i in (1, 2) for j in (1, 2))} FROM t a JOIN t b ON a.work_id <> b.work_id WHERE a.work_id % 100 = 0),
g AS (SELECT *, greatest(s11, s12, s21, s22) AS best FROM j)
SELECT ref_id, cand_id, round(CASE WHEN there THEN best ELSE 0.5 END, 6) AS s_greimas, CASE WHEN NOT there THEN 'indisponible' WHEN s11 = best THEN 'v1↔v1' WHEN s12 = best THEN 'v1↔v2' WHEN s21 = best THEN 'v2↔v1' ELSE 'v2↔v2' END AS label FROM g""",
    "report_dataset": _with(*SCORE) + _REPORT + f"""SELECT ref_id, cand_id, srj_level, '{",".join(f"{n}:{w}" for n, w in WEIGHTS)}' AS components, round({" + ".join(_SHOWN(n) for n, _ in WEIGHTS)}, 6) AS score_sum, best AS correspondences,
CASE WHEN ref_id % 3 = 0 OR cand_id % 3 = 0 THEN {_MODE('ref_id')} || '/' || {_MODE('cand_id')} ELSE '' END AS models FROM shown""",
    "comparison_markdown": _with(*SCORE) + _REPORT + "SELECT ref_id, cand_id, '# ' || ref_id || ' / ' || cand_id AS title, '- level: ' || srj_level AS level, '- modality: ' || modality AS modality, marks AS pairs FROM shown",
    "comparison_json": _with(*SCORE) + _REPORT + f"SELECT ref_id, cand_id, {_SHOWN('sns')} AS sns, srj_level, n FROM shown",
    "analysis_text": _with(*NODE) + "SELECT work_id, md5(string_agg((pos + 1) || '. ' || coalesce(code, '—') || ' (' || phase || ')', chr(10) ORDER BY pos)) AS text_md5 FROM nodes GROUP BY work_id",
    "recode_notes": "SELECT work_id, n_corrected, CASE WHEN n_corrected > 0 THEN 'recoded functions: ' || n_corrected END AS note FROM (SELECT work_id, count(*) FILTER (coalesce(given_code <> function_code, false)) AS n_corrected FROM (" + MORE["cultural_recode"] + ") GROUP BY work_id)",
    "merge_counts": _DEDUP[:_CUT] + "SELECT work_id, len(ns) AS n_before, len(kept) AS n_after FROM folds JOIN per USING (work_id)",
    "merge_renumbered": _DEDUP[:_CUT] + "SELECT work_id, row_number() OVER (PARTITION BY work_id ORDER BY n.chunk, n.pos) AS sequence, n.chunk AS chunk, n.pos AS pos FROM (SELECT work_id, unnest(kept) AS n FROM folds)",
    "split_forecast": _with(*SEG) + ", c AS (SELECT work_id, length(text) // 4 + 2000 AS i, least(16000, greatest(2000, length(text) // 20)) AS o FROM seg) SELECT work_id, count(*) AS n_chunks, CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out, round(sum(i * 3 + o * 15) / CAST(1000000 AS DOUBLE), 6) AS cost_usd, round(sum(i * 3 + o * 15) * CAST(0.93 AS DOUBLE) / CAST(1000000 AS DOUBLE), 6) AS cost_eur FROM c GROUP BY work_id",
    "repertoire_totals": _with(*TAG, _REP) + "SELECT count(*) AS nodes, count(DISTINCT tags.code) AS functions, count(DISTINCT family_id) AS families, count(DISTINCT tags.code) FILTER (family_id = 'FN') AS african FROM tags JOIN rep ON rep.code = tags.code",
    "store_totals": _with(*TAG) + "SELECT count(*) AS works, CAST(sum(n) AS BIGINT) AS nodes, CAST(sum(coded) AS BIGINT) AS coded, max(n) AS largest FROM (SELECT low.work_id, count(*) AS n, count(tags.code) AS coded FROM low LEFT JOIN tags ON tags.work_id = low.work_id AND tags.pos = low.pos GROUP BY low.work_id)",
    "graph_store": "SELECT work_id, n_nodes, coalesce(n_edges, 0) AS n_edges FROM (" + MORE["graph_documents"] + ") WHERE n_nodes >= 3",
    "list_documents": "SELECT doc_id, coalesce(CASE WHEN n_chars % 5 <> 0 THEN source || ' ' || lang END, CAST(doc_id AS VARCHAR)) AS title FROM documents",
    "fetch_document": "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id = 100",
    "user_overview": _U + f""", c AS (SELECT *, {_NOW} - to_days(CAST(user_id % 60 AS INT)) AS created FROM users)
SELECT (SELECT count(*) FROM c) AS users, (SELECT count(*) FROM c WHERE user_id % 50 = 0) AS admins, (SELECT count(*) FROM c WHERE user_id % 4 <> 0) AS verified, (SELECT count(*) FROM c WHERE plan IN ('pro', 'enterprise')) AS paying,
(SELECT count(*) FROM c WHERE created >= {_NOW} - INTERVAL 7 DAY) AS new_7d, (SELECT count(*) FROM c WHERE created >= {_NOW} - INTERVAL 30 DAY) AS new_30d, count(DISTINCT user_id) FILTER (ts >= {_NOW} - INTERVAL 30 DAY) AS active,
count(*) FILTER (action LIKE 'analyze%') AS analyses, count(*) FILTER (action LIKE 'analyze%' AND ts >= {_NOW} - INTERVAL 7 DAY) AS analyses_7d, count(*) FILTER (action = 'comparison') AS comparisons,
count(*) FILTER (action = 'comparison' AND ts >= {_NOW} - INTERVAL 7 DAY) AS comparisons_7d, count(*) FILTER (action = 'login' AND ts >= {_NOW} - INTERVAL 1 DAY) AS logins_24h, count(*) FILTER (action = 'login_failed' AND ts >= {_NOW} - INTERVAL 7 DAY) AS failed_7d FROM usage""",
    "user_detail_totals": _U + ", s AS (SELECT user_id, count(*) AS requests, round(coalesce(sum(cost_usd), 0), 4) AS cost, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens FROM usage GROUP BY user_id) SELECT r.user_id, action, rank, id, requests, s.cost, s.tokens FROM (SELECT *, row_number() OVER (PARTITION BY user_id, action ORDER BY ts DESC, id) AS rank FROM usage) r JOIN s ON s.user_id = r.user_id WHERE rank <= 25",
    "quota_costs": LOGS["quota_decision"].replace("SELECT user_id, quota_daily, quota_monthly, used_24h, used_30d,", "SELECT user_id,", 1).replace(", CASE WHEN used_24h >= quota_daily THEN 'daily' WHEN used_30d >= quota_monthly THEN 'monthly' ELSE 'allowed' END AS decision", f", round(coalesce((SELECT sum(cost_usd) FROM usage x WHERE x.user_id = q.user_id AND ts >= {_NOW} - INTERVAL 30 DAY), 0), 4) AS cost") + " q",
    "mark_read": _U + "SELECT user_id, count(*) AS n, count(*) FILTER (tokens % 2 <> 0 AND user_id <> 7 AND NOT (user_id = 8 AND id = 1234)) AS unread FROM usage GROUP BY user_id",
    "newest_conversations": "SELECT conv_id, max(turn) AS last_message_at, count(*) AS n FROM conversations GROUP BY conv_id ORDER BY 2 DESC, conv_id DESC LIMIT 8",
    "clear_counts": _U + "SELECT 'analyses' AS \"table\", count(*) AS deleted FROM analyses UNION ALL SELECT 'comparisons', count(*) FROM comparisons UNION ALL SELECT 'usage', count(*) FROM usage",
    "append_comparisons": LOGS["comparison_titles"].replace("AS cand_title FROM", "AS cand_title, round(score, 6) AS score FROM"),
}
