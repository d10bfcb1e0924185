"""Bounded search against scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from fabula.operators import blocks, compare, extract, report, search

CODES = ["F01", "F02", "F10", "F11", "F20", "F21", "FNANC", "FNCOMM", None]
NODES = "work_id long, pos int, function_code string, function_family string, actants array<string>, vouloir double, devoir double, pouvoir double, savoir double, tension double, phase string"


@pytest.fixture(scope="module")
def profiles(spark):
    rng = random.Random(21)
    rows = []
    for work in range(60):
        pool = rng.sample(CODES, rng.choice([1, 2, 4])) if work % 9 else ["FNANC", "FNCOMM"] if work % 2 else [None]
        for pos in range(rng.choice([1, 2, 3, 6, 15])):
            code = rng.choice(pool)
            rows.append((work, pos, code, code and code[:2], [rng.choice("ABCDE") for _ in range(rng.randint(0, 3))], rng.choice([0.0, 0.3]), 0.0, rng.choice([0.0, 0.3]), 0.0, rng.random(), rng.choice(["Exposition", "Climax"])))
    return extract.profiles(spark.createDataFrame(rows, NODES)).cache()


def keep(df, name):
    return df.cache()


def everything(profiles):
    return compare.with_scores(compare.search_pairs(profiles.where("work_id % 10 = 0"), profiles)).select(F.col("ref_work_id").alias("ref_id"), F.col("cand_work_id").alias("cand_id"), "sns").cache()


@pytest.mark.parametrize("k", [1, 5, 40])
def test_same_rows_as_all_pairs(profiles, k):
    want = {(r.ref_id, r.rank, r.cand_id): r.sns for r in compare.top_k(everything(profiles), k).collect()}
    got, counts = search.bounded_top_k(profiles, F.col("work_id") % 10 == 0, k, keep, first=2 * k)
    assert {(r.ref_id, r.rank, r.cand_id): r.sns for r in got.collect()} == pytest.approx(want)
    counts = counts.collect()
    assert len(counts) <= 6 and (k > 1 or sum(r.scored for r in counts) < 0.5 * 6 * 59)


def test_bounds_hold(profiles):
    works = search.summaries(profiles)
    queries = works.where("work_id % 10 = 0")
    score = {(r.ref_id, r.cand_id): r.sns for r in everything(profiles).collect()}
    every = {(r.ref_id, r.cand_id): r.bound for r in search.all_pairs(queries, works, 0.5).collect()}
    assert set(every) == set(score) and all(every[p] + 1e-9 >= score[p] for p in score)
    sharing = {(r.ref_id, r.cand_id): r.bound for r in search.sharing_pairs(queries, works, 0.5).collect()}
    assert all(sharing[p] == pytest.approx(every[p]) for p in sharing)
    assert all(score[p] <= search.APART for p in score if p not in sharing)


def test_no_pair_before_the_equality_join(profiles):
    works = search.summaries(profiles)
    plan = search.sharing_pairs(works.where("work_id % 10 = 0"), works, 0.75)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 3 and "Cross" not in plan and all(" = " in j for j in joins) and "code" in joins[-1]


def test_search_pairs_copies_stay_off_the_driver(spark, profiles):
    """The query works' copies, one for each block, are dealt out with the works; broadcast, they went through the driver."""
    p = compare.prepared(profiles)
    pairs = compare.search_pairs(p.where("work_id % 10 = 0"), p).select("ref_work_id", "cand_work_id", "ref_curves", "cand_curves")
    n, q = profiles.count(), profiles.where("work_id % 10 = 0").count()
    assert len(set(map(tuple, pairs.select("ref_work_id", "cand_work_id").collect()))) == q * (n - 1)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "CartesianProduct" not in plan and "ShuffledHashJoin" in plan


def test_prepared_scores_are_those_of_the_arrays(spark, profiles):
    p = compare.prepared(profiles)
    c = F.col
    n = F.least(F.size("ref_tensions"), F.size("cand_tensions"), F.lit(compare.MAX_CURVE))
    total = lambda x: F.aggregate(compare.resample(c(x), n), F.lit(0.0), lambda s, y: s + y)
    both = compare.search_pairs(p.where("work_id % 10 = 0"), p).select(
        (compare.tension_score(c("ref_curves"), c("cand_curves")) == compare.tension_profile(c("ref_tensions"), c("cand_tensions"))).alias("tens"),
        (compare.persistence_of(c("ref_actant_sums"), c("cand_actant_sums")) == compare.persistence(c("ref_actants"), c("cand_actants"))).alias("chain"),
        (F.get("ref_curve_totals", F.least(F.size("ref_curve_totals"), F.size("cand_curve_totals")) - 1) == total("ref_tensions")).alias("sum"),
    )
    assert [tuple(r) for r in both.distinct().collect()] == [(True, True, True)]


@pytest.mark.parametrize("works_at_once", [7, 2000])
def test_compared_blocks_are_equal_to_expressions(spark, profiles, monkeypatch, works_at_once):
    """s_iso, lcs, s_tens and matches from numpy, over several chunks of a block and in one, against the expressions, to the last bit; one work has 150 nodes, names repeat in other letters."""
    monkeypatch.setattr(blocks, "WORKS", works_at_once)
    rng = random.Random(4)
    long = [(w, pos, rng.choice(CODES), rng.choice([None, "F1", "FN"]), rng.sample(["A", "a ", "B", "É", "c"], rng.randint(0, 4)), 0.3, rng.random(), rng.choice([0.0, 0.3]), 0.0, rng.random() / 3, "Climax") for w, n in ((100, 150), (101, 70), (102, 1)) for pos in range(n)]
    p = compare.prepared(profiles.unionByName(extract.profiles(spark.createDataFrame(long, NODES)))).cache()
    asked = p.where("work_id % 10 = 0")
    shown = lambda df, s_iso, lcs, tens, matches: sorted(map(repr, df.select("ref_work_id", "cand_work_id", s_iso.alias("s_iso"), lcs.alias("lcs"), tens.alias("s_tens"), matches.alias("matches"), "ref_codes", "cand_n_nodes").collect()))
    c = F.col
    want = compare.search_pairs(asked, p).withColumn("matches", compare.best_matches(c("ref_nodes"), c("cand_nodes")))
    got = blocks.compared(asked, p, ["codes", "n_nodes"], True, 3)
    assert shown(got, c("s_iso"), c("lcs"), c("s_tens"), c("matches")) == shown(want, compare.isomorphism(c("matches")), compare.lcs_length(c("ref_plain"), c("cand_plain"), c("ref_masks")), compare.tension_score(c("ref_curves"), c("cand_curves")), c("matches"))


def test_best_matches_are_ranked_in_the_block(spark, profiles):
    """The column best is correspondences() of all matches, of works with more than 15 of them and with ties; a report made of it is the same."""
    rng = random.Random(5)
    long = [(w, pos, rng.choice(CODES[:2]), "F1", ["A"], 0.3, 0.0, 0.0, 0.0, rng.choice([0.1, 0.9]), "Climax") for w, n in ((100, 40), (101, 25), (102, 3)) for pos in range(n)]
    p = compare.prepared(profiles.unionByName(extract.profiles(spark.createDataFrame(long, NODES)))).cache()
    asked, keep = p.where("work_id % 10 = 0"), ["n_nodes", "codes", "plain", "actant_sums", "tensions"]
    every, found = (compare.with_scores(blocks.compared(asked, p, keep, how, 3)).withColumnsRenamed({"ref_work_id": "ref_id", "cand_work_id": "cand_id"}) for how in (True, "best"))
    shown = lambda df: sorted(map(repr, df.select("ref_id", "cand_id", compare.best_of(df).alias("best")).collect()))
    assert "matches" not in found.columns and shown(found) == shown(every)
    assert max(map(len, (r.best for r in found.select("best").collect()))) == compare.BEST
    rows = lambda df: sorted(map(repr, report.comparison_markdown(report.report_rows(df)).collect()))
    assert rows(found) == rows(every)


def test_role_sets_of_a_work_score_as_its_roles(spark, profiles):
    """Roles read once for a work (role_sets, lead) give the scores that roles read for each pair give; missing, blank and wordless ones among them."""
    pick = lambda k, *xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("work_id") % k).cast("int"))
    role = lambda lead, foe: F.struct(*[(lead if r == "protagoniste" else foe if r == "opposant" else F.lit(None).cast("string")).alias(r) for r in compare.ROLES])
    p = compare.prepared(profiles.withColumns({"roles": F.when(F.col("work_id") % 4 != 0, role(pick(3, "le Lion", "hyène", " "), pick(2, "...", "lion"))), "roles_v2": F.when(F.col("work_id") % 6 != 0, role(pick(5, "lion roi", "", "reine", "la", "roi"), F.lit("hyène")))}))
    sets = compare.with_role_sets(p)
    shown = lambda rows: sorted(map(repr, compare.with_scores(rows).select("ref_work_id", "cand_work_id", "s_greimas", "alignment", "focus_delta", "sns", "st").collect()))
    asked = "work_id % 10 = 0"
    want = shown(compare.search_pairs(p.where(asked), p))
    assert shown(blocks.compared(sets.where(asked), sets, ["n_nodes", "codes", "plain", "actant_sums", "role_sets", "role_sets_v2", "lead"])) == want
    assert shown(compare.search_pairs(sets.where(asked), sets)) == want


def test_search_writes_no_pairs(spark, profiles):
    """What a search writes grows with works and query works times k; the pairs that met were written before. Copies without number don't stay either."""
    copies = spark.range(1000, 1400).withColumnRenamed("id", "work_id").crossJoin(profiles.where("work_id = 20").drop("work_id")).select(profiles.columns)
    every, written, blocks_ = profiles.unionByName(copies).cache(), {}, int(spark.conf.get("spark.sql.shuffle.partitions"))

    def kept(df, name):
        written[name] = df.cache()
        return written[name]

    asked = F.col("work_id").isin(0, 10, 20, 30)
    got, counts = search.bounded_top_k(every, asked, 3, kept, first=6)
    p = compare.prepared(every)
    want = compare.with_scores(compare.search_pairs(p.where(asked), p)).select(F.col("ref_work_id").alias("ref_id"), F.col("cand_work_id").alias("cand_id"), "sns")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, compare.top_k(want, 3).collect()))
    assert sum(r.found for r in counts.collect()) == 4 * (every.count() - 1)
    pairs = {n: t.count() for n, t in written.items() if "ref_id" in t.columns or "cand_id" in t.columns}
    assert pairs and all(n <= 4 * 3 * blocks_ * 3 for n in pairs.values())


def test_candidate_pairs_stay_in_their_task(profiles):
    """The pairs of the join on codes, made without a join or a shuffle of pairs."""
    works, asked = search.summaries(profiles), "work_id % 10 = 0"
    got = search.candidate_pairs(profiles.where(asked), profiles)
    want = search.met_pairs(works.where(asked), works).select("ref_id", "cand_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.splitlines()[0].startswith("MapInArrow")
