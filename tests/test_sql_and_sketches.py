"""SQL functions against the Column builders; error of merged sketches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fabula import sql
from fabula.functions import text as T
from fabula.operators import history as H


def test_sql_functions(spark):
    sql.register(spark)
    odd = ["a\r\nb\rc", "a\x00\x0bb\tc", "a \t b", "a\n\n\n\nb", " x\n", "", None, "été où"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string")
    df.createOrReplaceTempView("odd_texts")
    got = spark.sql("SELECT k, narrative_clean(t) c, narrative_words(t) n, narrative_tokens(t) m FROM odd_texts").collect()
    want = df.select("k", T.clean(F.col("t")).alias("c"), T.n_words(F.col("t")).alias("n"), T.token_estimate(F.col("t")).alias("m")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    one = spark.sql("SELECT narrative_jaccard(array('a', 'b'), array('b', 'c')) a, narrative_jaccard(array(), array()) b, narrative_quota('pro', 1) c, narrative_quota('x', 2) d, narrative_quota(NULL, 1) e, narrative_level(0.25) f, narrative_score(1, 1, 1, 1, 1) g").first()
    assert (one.a, one.b, one.c, one.d, one.e, one.f) == (pytest.approx(1 / 3), 0.0, 120, 200, 20, "Modéré") and one.g == pytest.approx(1)


def test_top_in_sql(spark):
    rows = [(1, c, *[(c % 4) / 4] * 5) for c in range(2, 12)]
    sql.publish(spark.createDataFrame(rows, "ref_id long, cand_id long, s_iso double, s_ged double, s_func double, s_act double, s_tens double"))
    assert [(r.place, r.cand_id) for r in spark.sql("SELECT * FROM narrative_top(3) ORDER BY place").collect()] == [(1, 3), (2, 7), (3, 11)]


def test_merged_sketches(spark):
    """Users within four standard errors, quantiles within 2 % of rank, sums exact; merged over any days as over the whole."""
    rng, now = random.Random(2), datetime(2024, 3, 1)
    rows = [(rng.randint(1, 20_000), rng.choice(["pro", "starter"]), now - timedelta(minutes=rng.randint(0, 60 * 24 * 60)), rng.random() * 10) for _ in range(60_000)]
    usage = spark.createDataFrame(rows, "user_id long, plan string, ts timestamp, cost_usd double")
    daily = H.daily_sketches(usage, "plan").cache()
    assert daily.count() <= 2 * 62
    out = {(r.span, r.plan): r for r in H.sketch_windows(daily, F.lit(now), "plan").withColumn("median", F.kll_sketch_get_quantile_double("costs", F.lit(0.5))).collect()}
    for (span, plan), r in out.items():
        days = {"24h": 1, "7d": 7, "30d": 30, "all": 10_000}[span]
        mine = [x for x in rows if x[1] == plan and now.date() - timedelta(days=days) < x[2].date() <= now.date()] if span != "all" else [x for x in rows if x[1] == plan]
        users, costs = len({x[0] for x in mine}), sorted(x[3] for x in mine)
        assert r.n == len(mine) and r.cost == pytest.approx(sum(costs))
        assert abs(r.users - users) <= 4 * 1.04 / 2 ** (H.SKETCH_BITS / 2) * users
        assert abs(sum(c <= r.median for c in costs) / len(costs) - 0.5) < 0.02 + 1 / len(costs)
    assert {s for s, _ in out} == {"24h", "7d", "30d", "all"}
    rolled = {r.plan: (r.level, r.n) for r in H.usage_rollup(daily, "plan").collect()}
    assert rolled[None] == (1, 60_000) and sum(n for p, (_, n) in rolled.items() if p) == 60_000


def test_merged_users_are_exact(spark):
    """Users of merged days, counted twice or not: over several buckets of ids, ids at their edges, negative ids and null."""
    ids = [0, 1, 32_768, 32_769, 65_536, -1, -32_768, None, *range(40_000, 46_000)]
    rows = [(u, plan, datetime(2024, 2, d), 1.0) for k, u in enumerate(ids) for plan, d in (("pro", 1 + k % 20), ("pro" if k % 2 else "starter", 3 + k % 20))]
    daily = H.daily_sketches(spark.createDataFrame(rows, "user_id long, plan string, ts timestamp, cost_usd double"), "plan")
    got = {r.plan: (r.level, r.n, r.users) for r in H.usage_rollup(daily, "plan").collect()}
    of = lambda plan: {r[0] for r in rows if plan in (None, r[1])} - {None}
    assert got == {p: (p is None, sum(p in (None, r[1]) for r in rows), len(of(p))) for p in (None, "pro", "starter")}
    spans = {r.plan: r.users for r in H.sketch_windows(daily, F.lit(datetime(2024, 3, 1)), "plan").where("span = 'all'").collect()}
    assert spans == {p: len(of(p)) for p in ("pro", "starter")}
