"""Queries on history, usage and admin tables. The events table stands for the logs, customer for users and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import title_of
from .operators import history as H
from .queries import Query, table

QUERIES: dict[str, Query] = {}
ACTIONS = {"click": "analyze_llm", "view": "analyze_local", "purchase": "comparison", "signup": "login", "error": "login_failed"}
MODELS = ("standard", "large", "small", "other")


def now():
    """The reports' clock."""
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """usage_log(id, ts, user_id, action, cost_usd, tokens, model, ...)."""
    names = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    k = F.get_json_object("props", "$.k").cast("long")
    model = F.when(k % 5 != 0, F.element_at(F.array(*map(F.lit, MODELS)), (k % 4 + 1).cast("int")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", F.element_at(names, F.col("event_type")).alias("action"), F.col("value").alias("cost_usd"), k.alias("tokens"), model.alias("model"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = F.when(F.col("c_mktsegment") == "BUILDING", "pro").when(F.col("c_mktsegment") == "MACHINERY", "enterprise").otherwise(F.lower("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), plan.alias("plan"), F.col("c_nationkey").alias("nation"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage(spark, sf_dir).where("action in ('analyze_llm', 'analyze_local')")
    title = F.when(F.col("tokens") % 7 != 0, F.concat(F.lit("work "), F.col("tokens").cast("string")))
    return rows.select("id", "ts", "user_id", F.col("user_id").alias("graph_id"), F.when(F.col("action") == "analyze_llm", "llm").otherwise("heuristic").alias("mode"), title.alias("title"), "cost_usd", "tokens")


def comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage(spark, sf_dir).where("action = 'comparison'")
    return rows.select("id", "ts", "user_id", F.col("user_id").alias("ref_graph_id"), (F.col("tokens") * 3).alias("cand_graph_id"), F.concat(F.lit("pair "), F.col("tokens").cast("string")).alias("title"), (F.col("cost_usd") / 100).alias("score"))


def _money(*names):
    return [F.round(n, 4).alias(n) for n in names]


@query
def usage_24h_30d(spark, sf_dir):
    return H.usage_windows(usage(spark, sf_dir), now())


@query
def usage_cost(spark, sf_dir):
    return H.usage_cost(usage(spark, sf_dir), now(), 10).select("user_id", *_money("cost"))


@query
def rolling_usage_frame(spark, sf_dir):
    return H.rolling_usage(usage(spark, sf_dir)).select("id", "user_id", "used")


@query
def quota_decision(spark, sf_dir):
    return H.quota_status(users(spark, sf_dir), usage(spark, sf_dir), now()).select("user_id", "quota_daily", "quota_monthly", "used_24h", "used_30d", "left_daily", "left_monthly", "decision")


@query
def hours_to_reset(spark, sf_dir):
    return H.hours_until_reset(usage(spark, sf_dir), now())


@query
def usage_summary(spark, sf_dir):
    return H.usage_summary(usage(spark, sf_dir), now(), 30).select("user_id", "total", "llm", "local", "comparisons", *_money("cost"), "tokens")


@query
def admin_users(spark, sf_dir):
    per = H.usage_summary(usage(spark, sf_dir), now(), 30)
    rows = users(spark, sf_dir).join(per, "user_id", "left").select("user_id", "name", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("cost", F.lit(0.0)).alias("cost"))
    grand = per.agg(F.sum("cost").alias("grand_cost"))
    return rows.crossJoin(F.broadcast(grand)).select("user_id", "name", "total", *_money("cost", "grand_cost"))  # one row of totals


@query
def plan_quotas(spark, sf_dir):
    u = users(spark, sf_dir)
    return u.groupBy(H.normal_plan(F.col("plan")).alias("plan_id"), H.plan_quota(F.col("plan"), 0).alias("quota_daily"), H.plan_quota(F.col("plan"), 1).alias("quota_monthly")).agg(F.count("*").alias("n"))


@query
def request_cost(spark, sf_dir):
    cost = H.request_cost(F.col("model"), F.col("tokens") * 100, F.col("tokens") * 10, F.col("tokens") * 30)
    return usage(spark, sf_dir).select("id", "model", F.round(cost, 6).alias("cost"))


@query
def overview_counters(spark, sf_dir):
    u = usage(spark, sf_dir)
    seen = lambda a, h: F.count_if((F.col("action") == a) & H.since(F.col("ts"), now(), h))
    one = u.agg(F.count_if(F.col("action").startswith("analyze")).alias("analyses"), F.count_if(F.col("action").startswith("analyze") & H.since(F.col("ts"), now(), 168)).alias("analyses_7d"), F.count_if(F.col("action") == "comparison").alias("comparisons"), seen("comparison", 168).alias("comparisons_7d"), seen("login", 24).alias("logins_24h"), seen("login_failed", 168).alias("failed_7d"))
    return users(spark, sf_dir).agg(F.count("*").alias("users"), F.count_if(F.col("plan").isin("pro", "enterprise")).alias("paying")).crossJoin(one)  # two rows of totals


@query
def daily_series_zero_fill(spark, sf_dir):
    return H.daily_series(usage(spark, sf_dir), "2024-01-31", 14, "user_id", "action").select("user_id", "action", F.col("day").cast("string").alias("day"), "n")


@query
def route_totals(spark, sf_dir):
    return usage(spark, sf_dir).where("action = 'analyze_llm'").groupBy("model").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost_usd"), 4).alias("cost"))


@query
def activity_feed(spark, sf_dir):
    u = usage(spark, sf_dir)
    logs = [u.where(F.col("action") == a).select(F.col("action").alias("kind"), "id", "user_id", "ts") for a in ("analyze_llm", "comparison", "login", "login_failed")]
    return H.activity_feed(logs, users(spark, sf_dir)).select("kind", "id", "user_id", "name")


@query
def user_rollup(spark, sf_dir):
    u, base = usage(spark, sf_dir), users(spark, sf_dir)
    per = u.groupBy("user_id").agg(F.count_if(F.col("action").startswith("analyze")).alias("analyses"), F.count_if(F.col("action") == "comparison").alias("comparisons"), F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost"))
    rows = base.orderBy(F.desc("user_id")).limit(500).join(per, "user_id", "left")
    return rows.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("analyses", "comparisons", "requests", "tokens")], F.round(F.coalesce("cost", F.lit(0.0)), 4).alias("cost"))


@query
def user_detail(spark, sf_dir):
    return H.latest(usage(spark, sf_dir), ["user_id", "action"], [F.col("ts").desc(), F.col("id")], 25).select("user_id", "action", "rank", "id")


@query
def spend_windows(spark, sf_dir):
    out = H.spend_windows(usage(spark, sf_dir), now())
    return out.select(*[F.round(c, 4).alias(c) if c.startswith("cost") else c for c in out.columns])


@query
def spend_by_model(spark, sf_dir):
    return H.spend_by(usage(spark, sf_dir), "model").select("model", "requests", "tokens", *_money("cost"))


@query
def latest_requests(spark, sf_dir):
    rows = H.newest(usage(spark, sf_dir), 40, "id").join(users(spark, sf_dir), "user_id", "left")
    return rows.select("id", "user_id", F.coalesce("name", F.lit("—")).alias("name"))


@query
def owner_history(spark, sf_dir):
    both = H.compact_index(analyses(spark, sf_dir), comparisons(spark, sf_dir)).join(usage(spark, sf_dir).select("id", "user_id"), "id")
    return H.latest(both, ["user_id", "kind"], [F.col("ts").desc(), F.col("id")], 50).select("user_id", "kind", "rank", "id")


@query
def notification_inbox(spark, sf_dir):
    notes = usage(spark, sf_dir).select("user_id", "id", "ts", (F.col("tokens") % 2 == 0).alias("read"))
    top = H.latest(notes, ["user_id"], [F.col("ts").desc(), F.col("id")], 100)
    return top.groupBy("user_id").agg(F.count("*").alias("shown"), F.count_if(~F.col("read")).alias("unread"), F.min("id").alias("lowest_id"))


@query
def notification_rules(spark, sf_dir):
    level = F.when(F.col("score") < 0.25, "Faible").when(F.col("score") < 0.55, "Modéré").when(F.col("score") < 0.80, "Élevé").otherwise("Critique")
    c = comparisons(spark, sf_dir).select("id", F.lit("comparison").alias("kind"), level.alias("level"), "score", F.lit(None).cast("int").alias("n_nodes"))
    a = analyses(spark, sf_dir).select("id", F.lit("analysis").alias("kind"), F.lit(None).cast("string").alias("level"), F.lit(None).cast("double").alias("score"), F.col("tokens").cast("int").alias("n_nodes"))
    return H.notifications(c.unionByName(a)).select("id", "notice", "value")


@query
def conversation_titles(spark, sf_dir):
    first = H.latest(table(spark, sf_dir, "conversations").where("role = 'user'"), ["conv_id"], [F.col("turn"), F.col("text")], 1)
    return first.select("conv_id", title_of(F.col("text")).alias("title"))


@query
def conversation_documents(spark, sf_dir):
    c = H.conversations(table(spark, sf_dir, "conversations"))
    return c.select("conv_id", F.size("messages").alias("n_messages"), F.md5(F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["text"])), "|")).alias("messages_md5"))


@query
def cascade_delete(spark, sf_dir):
    gone = users(spark, sf_dir).where("plan = 'pro'")
    left = H.cascade_delete({"analyses": analyses(spark, sf_dir), "comparisons": comparisons(spark, sf_dir), "usage": usage(spark, sf_dir)}, gone)
    parts = [t.groupBy("user_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "user_id", "n") for name, t in left.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query
def rate_limit_windows(spark, sf_dir):
    return H.rate_limit_breaches(usage(spark, sf_dir), "user_id", 2).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query
def login_counters(spark, sf_dir):
    rows = usage(spark, sf_dir).where("action in ('login', 'login_failed')").withColumn("success", F.col("action") == "login")
    return H.login_counters(rows).select("user_id", F.unix_micros("last_login").alias("last_login_us"), "logins")


@query
def list_analyses(spark, sf_dir):
    return analyses(spark, sf_dir).orderBy(F.desc("id")).limit(200).select("id", "mode", "title")


@query
def list_comparisons(spark, sf_dir):
    return comparisons(spark, sf_dir).select("id", "title")


@query
def latest_analysis(spark, sf_dir):
    return H.latest(analyses(spark, sf_dir), ["graph_id"], [F.col("id").desc()], 1).select("graph_id", "id", "mode")


@query
def comparison_titles(spark, sf_dir):
    return H.with_titles(comparisons(spark, sf_dir), analyses(spark, sf_dir)).select("id", "ref_title", "cand_title")


@query
def delete_analyses(spark, sf_dir):
    a = analyses(spark, sf_dir)
    return H.delete_keys(a, a.where("cost_usd > 50"), "graph_id", "mode").select("id", "graph_id", "mode")


@query
def history_stats(spark, sf_dir):
    out = H.statistics(analyses(spark, sf_dir), comparisons(spark, sf_dir))
    return out.withColumns({c: F.unix_micros(c) for c in ("first", "last")}).withColumnsRenamed({"first": "first_us", "last": "last_us"})


@query
def history_index(spark, sf_dir):
    return H.compact_index(analyses(spark, sf_dir), comparisons(spark, sf_dir)).select("kind", "id", "title")


def _daily(spark, sf_dir):
    rows = usage(spark, sf_dir).join(users(spark, sf_dir).select("user_id", H.normal_plan(F.col("plan")).alias("plan")), "user_id", "left")
    return H.daily_sketches(rows.withColumns({"plan": F.coalesce("plan", F.lit("none")), "model": F.coalesce("model", F.lit("none"))}), "plan", "model")


@query
def usage_rollup(spark, sf_dir):
    """Requests, cost and users by plan, model and day with their subtotals, merged from a day's sketches."""
    r = H.usage_rollup(_daily(spark, sf_dir), "plan", "model", "day")
    return r.select("plan", "model", F.date_format("day", "yyyy-MM-dd").alias("day"), "level", "n", F.round("cost", 4).alias("cost"), "users")


@query
def sketch_windows(spark, sf_dir):
    """Requests, cost and users of the last day, 7 days, 30 days and of all by plan, and how many costs its sketch holds."""
    r = H.sketch_windows(_daily(spark, sf_dir), now(), "plan")
    return r.select("span", "plan", "n", F.round("cost", 4).alias("cost"), "users", F.kll_sketch_get_n_double("costs").alias("costs"))
