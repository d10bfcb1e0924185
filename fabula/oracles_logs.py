"""SQL counterparts of the log queries."""

_U = """WITH usage AS (SELECT event_id AS id, ts, user_id, CASE event_type WHEN 'click' THEN 'analyze_llm' WHEN 'view' THEN 'analyze_local' WHEN 'purchase' THEN 'comparison' WHEN 'signup' THEN 'login' WHEN 'error' THEN 'login_failed' END AS action, value AS cost_usd, k AS tokens,
  CASE WHEN k % 5 <> 0 THEN ['standard', 'large', 'small', 'other'][CAST(k % 4 + 1 AS INT)] END AS model FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
users AS (SELECT c_custkey AS user_id, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'pro' WHEN 'MACHINERY' THEN 'enterprise' ELSE lower(c_mktsegment) END AS plan FROM customer),
planned AS (SELECT *, CASE plan WHEN 'pro' THEN 120 WHEN 'enterprise' THEN 1000 ELSE 20 END AS qd, CASE plan WHEN 'pro' THEN 2000 WHEN 'enterprise' THEN 20000 ELSE 200 END AS qm FROM users),
analyses AS (SELECT id, ts, user_id, user_id AS graph_id, CASE WHEN action = 'analyze_llm' THEN 'llm' ELSE 'heuristic' END AS mode, CASE WHEN tokens % 7 <> 0 THEN 'work ' || tokens END AS title, cost_usd, tokens FROM usage WHERE action IN ('analyze_llm', 'analyze_local')),
comparisons AS (SELECT id, ts, user_id, user_id AS ref_graph_id, tokens * 3 AS cand_graph_id, 'pair ' || tokens AS title, cost_usd / 100 AS score FROM usage WHERE action = 'comparison'),
bill AS (SELECT * FROM usage WHERE action IN ('analyze_llm', 'comparison')) """
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_TOTALS = f"(SELECT user_id, count(*) AS total, count(*) FILTER (action = 'analyze_llm') AS llm, count(*) FILTER (action = 'analyze_local') AS local, count(*) FILTER (action = 'comparison') AS comparisons, sum(cost_usd) AS cost, CAST(sum(tokens) AS BIGINT) AS tokens FROM usage WHERE ts >= {_NOW} - INTERVAL 30 DAY GROUP BY user_id)"
_SPANS = (("all", "TRUE"), ("30d", f"ts >= {_NOW} - INTERVAL 720 HOUR"), ("7d", f"ts >= {_NOW} - INTERVAL 168 HOUR"), ("24h", f"ts >= {_NOW} - INTERVAL 24 HOUR"))

_PLAN = "CASE WHEN p.user_id IS NULL THEN 'none' WHEN p.plan IN ('pro', 'enterprise') THEN p.plan ELSE 'starter' END"
LOGS = {
    "usage_24h_30d": _U + f"SELECT user_id, count(*) FILTER (action IN ('analyze_llm', 'comparison') AND ts >= {_NOW} - INTERVAL 24 HOUR) AS used_24h, count(*) FILTER (action IN ('analyze_llm', 'comparison') AND ts >= {_NOW} - INTERVAL 30 DAY) AS used_30d FROM usage GROUP BY user_id",
    "usage_cost": _U + f"SELECT user_id, round(coalesce(sum(cost_usd) FILTER (ts >= {_NOW} - INTERVAL 10 DAY), 0), 4) AS cost FROM usage GROUP BY user_id",
    "rolling_usage_frame": _U + "SELECT id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS used FROM bill",
    "quota_decision": _U + f"SELECT user_id, quota_daily, quota_monthly, used_24h, used_30d, greatest(0, quota_daily - used_24h) AS left_daily, greatest(0, quota_monthly - used_30d) AS left_monthly, CASE WHEN used_24h >= quota_daily THEN 'daily' WHEN used_30d >= quota_monthly THEN 'monthly' ELSE 'allowed' END AS decision FROM (SELECT p.user_id, qd AS quota_daily, qm AS quota_monthly, count(b.id) FILTER (b.ts >= {_NOW} - INTERVAL 24 HOUR) AS used_24h, count(b.id) FILTER (b.ts >= {_NOW} - INTERVAL 30 DAY) AS used_30d FROM planned p LEFT JOIN bill b ON b.user_id = p.user_id GROUP BY ALL)",
    "hours_to_reset": _U + f"SELECT u.user_id, coalesce(greatest(0, CAST(floor((epoch(m) + 86400 - epoch({_NOW})) / 3600) AS INT)), 0) AS hours FROM (SELECT DISTINCT user_id FROM usage) u LEFT JOIN (SELECT user_id, min(ts) AS m FROM bill WHERE ts >= {_NOW} - INTERVAL 24 HOUR GROUP BY user_id) b ON b.user_id = u.user_id",
    "usage_summary": _U + f"SELECT user_id, total, llm, local, comparisons, round(cost, 4) AS cost, tokens FROM {_TOTALS}",
    "admin_users": _U + f", t AS {_TOTALS} SELECT users.user_id, name, coalesce(total, 0) AS total, round(coalesce(cost, 0), 4) AS cost, round((SELECT sum(cost) FROM t), 4) AS grand_cost FROM users LEFT JOIN t ON t.user_id = users.user_id",
    "plan_quotas": _U + "SELECT CASE WHEN plan IN ('pro', 'enterprise') THEN plan ELSE 'starter' END AS plan_id, qd AS quota_daily, qm AS quota_monthly, count(*) AS n FROM planned GROUP BY ALL",
    "request_cost": _U + ", p(model, a, b, c) AS (VALUES ('standard', 3.0, 15.0, 0.3), ('large', 15.0, 75.0, 1.5), ('small', 1.0, 5.0, 0.1)) SELECT id, usage.model, round(CASE WHEN usage.model IS NULL THEN 0 ELSE (greatest(0, tokens * 100 - tokens * 30) * CAST(coalesce(a, 3.0) AS DOUBLE) + tokens * 30 * CAST(coalesce(c, 0.3) AS DOUBLE) + tokens * 10 * CAST(coalesce(b, 15.0) AS DOUBLE)) / 1000000 END, 6) AS cost FROM usage LEFT JOIN p ON p.model = usage.model",
    "overview_counters": _U + f"SELECT (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM users WHERE plan IN ('pro', 'enterprise')) AS paying, count(*) FILTER (action LIKE 'analyze%') AS analyses, count(*) FILTER (action LIKE 'analyze%' AND ts >= {_NOW} - INTERVAL 7 DAY) AS analyses_7d, count(*) FILTER (action = 'comparison') AS comparisons, count(*) FILTER (action = 'comparison' AND ts >= {_NOW} - INTERVAL 7 DAY) AS comparisons_7d, count(*) FILTER (action = 'login' AND ts >= {_NOW} - INTERVAL 1 DAY) AS logins_24h, count(*) FILTER (action = 'login_failed' AND ts >= {_NOW} - INTERVAL 7 DAY) AS failed_7d FROM usage",
    "daily_series_zero_fill": _U + ", r AS (SELECT user_id, action, CAST(ts AS DATE) AS day FROM usage), s AS (SELECT DISTINCT user_id, action, d.i AS back FROM r, (SELECT unnest(range(14)) AS i) d), g AS (SELECT user_id, action, day, count(*) AS n FROM r GROUP BY ALL) SELECT s.user_id, s.action, CAST(CAST(DATE '2024-01-31' - CAST(s.back AS INT) AS DATE) AS VARCHAR) AS day, coalesce(g.n, 0) AS n FROM s LEFT JOIN g ON g.user_id = s.user_id AND g.action = s.action AND g.day = DATE '2024-01-31' - CAST(s.back AS INT)",
    "route_totals": _U + "SELECT model, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost_usd), 4) AS cost FROM usage WHERE action = 'analyze_llm' GROUP BY model",
    "activity_feed": _U + ", r AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY ts DESC, id) AS k FROM usage WHERE action IN ('analyze_llm', 'comparison', 'login', 'login_failed')), f AS (SELECT *, row_number() OVER (ORDER BY ts DESC, id) AS z FROM r WHERE k <= 30) SELECT action AS kind, id, f.user_id, coalesce(name, '—') AS name FROM f LEFT JOIN users ON users.user_id = f.user_id WHERE z <= 60",
    "user_rollup": _U + ", n AS (SELECT user_id FROM users ORDER BY user_id DESC LIMIT 500) SELECT n.user_id, count(u.id) FILTER (action LIKE 'analyze%') AS analyses, count(u.id) FILTER (action = 'comparison') AS comparisons, count(u.id) AS requests, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, round(coalesce(sum(cost_usd), 0), 4) AS cost FROM n LEFT JOIN usage u ON u.user_id = n.user_id GROUP BY n.user_id",
    "user_detail": _U + "SELECT user_id, action, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, action ORDER BY ts DESC, id) AS rank FROM usage) WHERE rank <= 25",
    "spend_windows": _U + "SELECT " + ", ".join(f"count(*) FILTER ({c}) AS requests_{n}, CAST(coalesce(sum(tokens) FILTER ({c}), 0) AS BIGINT) AS tokens_{n}, round(coalesce(sum(cost_usd) FILTER ({c}), 0), 4) AS cost_{n}" for n, c in _SPANS) + " FROM usage",
    "spend_by_model": _U + "SELECT coalesce(model, '—') AS model, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost_usd), 4) AS cost FROM usage GROUP BY 1",
    "latest_requests": _U + "SELECT id, r.user_id, coalesce(name, '—') AS name FROM (SELECT * FROM usage ORDER BY ts DESC, id LIMIT 40) r LEFT JOIN users ON users.user_id = r.user_id",
    "owner_history": _U + "SELECT user_id, kind, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY ts DESC, id) AS rank FROM (SELECT user_id, 'analysis' AS kind, id, ts FROM analyses UNION ALL SELECT user_id, 'comparison', id, ts FROM comparisons)) WHERE rank <= 50",
    "notification_inbox": _U + "SELECT user_id, count(*) AS shown, count(*) FILTER (tokens % 2 <> 0) AS unread, min(id) AS lowest_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id) AS rank FROM usage) WHERE rank <= 100 GROUP BY user_id",
    "notification_rules": _U + "SELECT id, CASE WHEN score >= 0.55 THEN 'ip' ELSE 'comparison' END AS notice, CAST(round(score * 100) AS INT) AS value FROM comparisons UNION ALL SELECT id, 'analysis', CAST(tokens AS INT) FROM analyses",
    "conversation_titles": r"SELECT conv_id, CASE WHEN flat = '' THEN 'Nouvelle conversation' WHEN length(flat) > 48 THEN rtrim(substr(flat, 1, 48)) || '…' ELSE flat END AS title FROM (SELECT conv_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM conversations WHERE role = 'user') WHERE r = 1)",
    "conversation_documents": "SELECT conv_id, count(*) AS n_messages, md5(string_agg(role || ':' || text, '|' ORDER BY turn, role, text)) AS messages_md5 FROM conversations GROUP BY conv_id",
    "cascade_delete": _U + ", gone AS (SELECT user_id FROM users WHERE plan = 'pro') SELECT t AS \"table\", user_id, count(*) AS n FROM (SELECT 'analyses' AS t, user_id FROM analyses UNION ALL SELECT 'comparisons', user_id FROM comparisons UNION ALL SELECT 'usage', user_id FROM usage) WHERE user_id NOT IN (SELECT user_id FROM gone) GROUP BY ALL",
    "rate_limit_windows": _U + "SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM usage GROUP BY 1, 2 HAVING count(*) > 2",
    "login_counters": _U + "SELECT user_id, epoch_us(max(ts)) AS last_login_us, count(*) AS logins FROM usage WHERE action = 'login' GROUP BY user_id",
    "list_analyses": _U + "SELECT id, mode, title FROM analyses ORDER BY id DESC LIMIT 200",
    "list_comparisons": _U + "SELECT id, title FROM comparisons",
    "latest_analysis": _U + "SELECT graph_id, max(id) AS id, arg_max(mode, id) AS mode FROM analyses GROUP BY graph_id",
    "comparison_titles": _U + ", l AS (SELECT graph_id, coalesce(title, 'Inconnu') AS title FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY id DESC) AS r FROM analyses) WHERE r = 1) SELECT c.id, coalesce(a.title, '?') AS ref_title, coalesce(b.title, '?') AS cand_title FROM comparisons c LEFT JOIN l a ON a.graph_id = ref_graph_id LEFT JOIN l b ON b.graph_id = cand_graph_id",
    "delete_analyses": _U + "SELECT id, graph_id, mode FROM analyses a WHERE NOT EXISTS (SELECT 1 FROM analyses b WHERE b.graph_id = a.graph_id AND b.mode = a.mode AND b.cost_usd > 50)",
    "history_stats": _U + "SELECT count(*) AS analyses, count(*) FILTER (mode = 'llm') AS llm, count(*) FILTER (mode = 'heuristic') AS heuristic, round(sum(cost_usd), 4) AS cost, CAST(sum(tokens) AS BIGINT) AS tokens, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, (SELECT count(*) FROM comparisons) AS comparisons FROM analyses",
    "history_index": _U + "SELECT 'analysis' AS kind, id, coalesce(title, '?') AS title FROM analyses UNION ALL SELECT 'comparison', id, title FROM comparisons",
    "usage_rollup": _U + f", d AS (SELECT {_PLAN} AS plan, coalesce(model, 'none') AS model, strftime(ts, '%Y-%m-%d') AS day, u.user_id, cost_usd FROM usage u LEFT JOIN users p ON p.user_id = u.user_id) SELECT plan, model, day, CAST(GROUPING(plan) + GROUPING(model) + GROUPING(day) AS INT) AS level, count(*) AS n, round(sum(cost_usd), 4) AS cost, count(DISTINCT user_id) AS users FROM d GROUP BY ROLLUP (plan, model, day)",
    "sketch_windows": _U + f", d AS (SELECT {_PLAN} AS plan, CAST(ts AS DATE) AS day, u.user_id, cost_usd FROM usage u LEFT JOIN users p ON p.user_id = u.user_id), w(span, days) AS (VALUES ('24h', 1), ('7d', 7), ('30d', 30), ('all', NULL)) SELECT span, plan, count(*) AS n, round(sum(cost_usd), 4) AS cost, count(DISTINCT user_id) AS users, count(*) AS costs FROM d JOIN w ON days IS NULL OR (day > CAST({_NOW} AS DATE) - days AND day <= CAST({_NOW} AS DATE)) GROUP BY span, plan",
}
