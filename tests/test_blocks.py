"""Columns of pairs made in blocks against the expressions on a pair's row."""

import random

import __spark_entry__ as entry
import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula import queries_reports
from fabula.lexicon import REGISTER_DISTANCE
from fabula.operators import blocks, compare, extract, report

from .conftest import SF
from .test_search import CODES, NODES

NUMBERS = [n for n, _ in compare.WEIGHTS] + ["s_chain", "s_greimas", "sns", "sns_normalized", "ss", "st", "srj"] + [f"{d}_delta" for d in ("structure", "form", "register", "focus", "moral")]
TEXTS = ["alignment", "modality", "srj_level", "verdict", "warnings"]
FORM = "struct<form:string,register:string,narrative_length_category:string,has_explicit_morality:boolean,has_narrator_intervention:boolean>"


@pytest.fixture(scope="module")
def works(spark):
    """Works of 1 to 150 nodes with forms and roles, some missing; copies; codes of one kind only."""
    rng = random.Random(8)
    rows, more = [], []
    registers = [None, "", "epique", "Comique", *sorted({a for a, _, _ in REGISTER_DISTANCE})]
    for work in range(90):
        pool = rng.sample(CODES, rng.choice([1, 2, 4])) if work % 9 else ["FNANC", "FNCOMM"] if work % 2 else [None]
        pool = [*pool, "F49"] if work % 5 == 0 else pool
        for pos in range({7: 150, 10: 70}.get(work) or rng.choice([1, 2, 3, 6, 15])):
            code = rng.choice(pool)
            rows.append((work, pos, code, code and code[:2], [rng.choice(["A", "a ", "B", "É", "c"]) for _ in range(rng.randint(0, 3))], rng.choice([0.0, 0.3]), 0.0, rng.choice([0.0, 0.3, 0.6]), 0.0, rng.choice([0.3, 0.45, rng.random()]), rng.choice(["Exposition", "Climax", None])))
        roles = lambda: rng.choice([None, tuple(rng.choice([None, " ", "le Lion", "lion roi", "...", "Reine reine"]) for _ in compare.ROLES)])  # noqa: B023, E731
        form = rng.choice([None, (rng.choice([None, "Vers", "prose"]), rng.choice(registers), rng.choice([None, "court", "LONG", "x"]), rng.choice([None, True, False]), rng.choice([None, True, False]))])
        more.append((work, form, roles(), roles()))
    names = ",".join(f"{r}:string" for r in compare.ROLES)
    forms = spark.createDataFrame(more, f"work_id long, form {FORM}, roles struct<{names}>, roles_v2 struct<{names}>")
    return compare.prepared(extract.profiles(spark.createDataFrame(rows, NODES)).join(forms, "work_id")).cache()


def _shown(df):
    return sorted(map(repr, df.select("ref_work_id", "cand_work_id", *NUMBERS, *TEXTS, "verdict_text").collect()))


@pytest.mark.parametrize(("at_once", "leave"), [(7, ()), (8000, ()), (8000, ("roles_v2",)), (8000, ("form", "roles", "roles_v2"))])
def test_every_column_is_that_of_the_expressions(works, monkeypatch, at_once, leave):
    monkeypatch.setattr(blocks, "WORKS", at_once)
    rows, asked = works.drop(*leave), "work_id % 10 = 0"
    want = compare.with_scores(compare.search_pairs(rows.where(asked), rows)).withColumn("warnings", F.array_join("warnings", ","))
    want = want.withColumn("verdict_text", compare.verdict_text(F.col("sns"), F.col("ss"), F.col("modality")))
    keyed = compare.with_role_sets(rows) if "roles" in rows.columns else rows
    keyed = keyed.withColumn("form", compare.form_keys(F.col("form"))) if "form" in rows.columns else keyed
    assert _shown(blocks.scored(keyed.where(asked), keyed, [*NUMBERS, *TEXTS, "verdict_text"], blocks=3)) == _shown(want)


def test_rounded_as_spark_rounds(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 1.0, 0.0078125, 0.5, 2.675, 1.005, -0.0000005, 0.1234565, 0.12345649999999999, *(rng.random() for _ in range(3000)), *(k / 2**10 for k in range(1024)), *((2 * k + 1) / 2e6 for k in range(500)), *(-rng.random() * 30 for _ in range(500))]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    for digits in (2, 3, 6, 9):
        want = [r.y for r in rows.orderBy("i").select(F.round("x", digits).alias("y")).collect()]
        assert blocks.rounded(np.array(values), digits).tolist() == want


PAIRS = ["s_iso", "s_ged", "s_func_lcs", "actant_persistence", "tension_resample", "s_tens", "pair_scores", "modality_class", "risk_level", "warnings", "transformation", "node_similarity", "correspondences_topk", "form_deltas", "role_alignment", "greimas_alignment", "full_comparison"]


@pytest.mark.parametrize("name", PAIRS)
def test_pairs_leave_their_block_as_the_columns_asked_for(spark, name):
    """No work's arrays go with each pair, and no expression is worked out on each pair's row: what the query returns comes out of the block."""
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        assert all(x.nodeName() in ("AttributeReference", "Alias") for x in [plan.projectList().apply(i) for i in range(plan.projectList().size())])
        plan = plan.children().head()
    assert plan.nodeName() == "MapInArrow"
    assert not any(kind.startswith(("array", "struct", "map")) for _, kind in df.dtypes)


def test_node_rows_are_the_matches(works):
    asked = "work_id % 10 = 0"
    rows = compare.search_pairs(works.where(asked), works).withColumn("matches", compare.best_matches(F.col("ref_nodes"), F.col("cand_nodes")))
    ids = ["ref_work_id", "cand_work_id"]
    every = rows.select(*ids, F.explode("matches").alias("m")).select(*ids, "m.cand_pos", "m.ref_pos", F.round("m.similarity", 6).alias("similarity"))
    best = rows.withColumn("best", compare.correspondences(F.col("matches"), 4)).select(*ids, F.posexplode("best").alias("k", "m")).select(*ids, (F.col("k") + 1).alias("rank"), "m.cand_pos", "m.ref_pos", F.round(-F.col("m.down"), 6).alias("similarity"))
    shown = lambda df: sorted(map(tuple, df.collect()))
    assert shown(blocks.node_rows(works.where(asked), works, blocks=3).drop("rank")) == shown(every)
    assert shown(blocks.node_rows(works.where(asked), works, 4, blocks=3)) == shown(best)


def test_sql_top_writes_no_pair_that_is_not_among_the_best(spark, works, monkeypatch):
    """What is written for the SQL search grows with works and query works times five, and gives the five best of all pairs."""
    kept = []
    keep = queries_reports.written
    monkeypatch.setattr(queries_reports, "written", lambda df, name: (kept.append(keep(df, name)), kept[-1])[1])
    got = {(r.ref_id, r.place, r.cand_id) for r in entry.queries()["sql_top"](spark, SF).collect()}
    every = entry.queries()["pair_scores"](spark, SF).count()
    refs = kept[0].select("ref_id").distinct().count()
    assert kept[0].count() <= refs * 5 * compare.BLOCKS and kept[0].count() < every
    want = compare.top_k(queries_reports.scores(spark, SF, ["sns"]), 5)
    assert got == {(r.ref_id, r.rank, r.cand_id) for r in want.collect()}
    some = blocks.scored(works.where("work_id % 10 = 0"), works, ["sns"], top=3, blocks=2)
    whole = blocks.scored(works.where("work_id % 10 = 0"), works, ["sns"], blocks=2)
    assert some.count() == 9 * 3 * 2
    ranked = lambda df: {tuple(r) for r in compare.top_k(df.withColumnsRenamed({"ref_work_id": "ref_id", "cand_work_id": "cand_id"}), 3).collect()}
    assert ranked(some) == ranked(whole)


def test_reports_show_numbers_rounded_in_the_block(works):
    """Rows of a report made of numbers that the block has rounded are those that expressions round, and no expression rounds a pair's numbers again."""
    asked, named = "work_id % 10 = 0", {"ref_work_id": "ref_id", "cand_work_id": "cand_id"}
    rows = works.drop("form", "roles", "roles_v2")
    every = compare.with_scores(compare.search_pairs(rows.where(asked), rows)).withColumnsRenamed(named)
    found = blocks.scored(rows.where(asked), rows, queries_reports.REPORTED, ["tensions"], "best", (9, 3), blocks=3).withColumnsRenamed(named)
    shown = lambda df: sorted(map(repr, report.report_rows(df).collect()))
    assert shown(found) == shown(every)
    assert "round(" not in report.comparison_markdown(report.report_rows(found))._jdf.queryExecution().optimizedPlan().toString()
