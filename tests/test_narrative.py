import math
import random

import pytest
from pyspark.sql import functions as F

from fabula.functions import sequences
from fabula.functions import text as T
from fabula.lexicon import FRENCH
from fabula.operators import clean, compare, extract, ingest, segment


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>" if v and isinstance(v[0], str) else "array<double>").alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("a\r\nb\rc", "a\nb\nc"), ("a\x00\x0bb\tc", "ab c"), ("a \t b", "a b"), ("a\n\n\n\nb", "a\n\nb"), ("  x\n", "x"), ("", ""), (None, None)])
def test_clean(spark, raw, want):
    assert one(spark, T.clean(F.col("t")), t=raw) == want


def test_page_numbers(spark):
    assert one(spark, T.drop_page_numbers(F.col("t")), t="a\n12\n- 12 -\n12.\n12345\nb 3") == "a\n12345\nb 3"


def test_recurring_lines_need_three(spark):
    docs = spark.createDataFrame([(1, "Head\na\nHead\nb\n Head \nc"), (2, "Head\na\nHead"), (3, "low\nlow\nlow"), (4, None)], "doc_id long, text string")
    assert [tuple(r) for r in clean.recurring_lines(docs, "doc_id").collect()] == [(1, "Head", 3)]
    kept = {r.doc_id: r.text for r in clean.drop_recurring_lines(docs, "doc_id").collect()}
    assert kept == {1: "a\nb\nc", 2: "Head\na\nHead", 3: "low\nlow\nlow", 4: None}


def test_titles(spark):
    assert one(spark, T.title_of(F.col("t")), t="  a \n b ") == "a b"
    assert one(spark, T.title_of(F.col("t")), t=None) == "Nouvelle conversation"
    assert one(spark, T.title_of(F.col("t")), t="x" * 47 + " yz") == "x" * 47 + "…"


def _greedy(parts, target, joint):
    out, cur, n = [], [], 0
    for p in parts:
        w = len(p.split())
        if n + w > target and cur:
            out.append(joint.join(cur))
            cur, n = [], 0
        cur.append(p)
        n += w
    return out + ([joint.join(cur)] if cur else [])


def _chunks(text):
    import re

    ps = [p.strip() for p in re.split(r"\n\s*\n+", text.replace("\r\n", "\n")) if p.strip()]
    total = sum(len(p.split()) for p in ps)
    target = 40 if total < 200 else 80 if total < 500 else 150 if total < 1500 else 180
    out, short = [], []
    for p in ps:
        if len(p.split()) > 2 * target:
            out += _greedy(short, target, "\n\n") + _greedy(re.split(r"(?<=[.!?])\s+(?=[A-ZÉÀÊÎÔ])", p), target, " ")
            short = []
        else:
            short.append(p)
    return out + _greedy(short, target, "\n\n")


def test_segments_match_a_plain_loop(spark):
    rng = random.Random(3)
    texts = []
    for k in range(30):
        paras = [" ".join(rng.choice(["Il part.", "Alors Marie", "le roi", "Été fini !", "et puis"]) for _ in range(rng.choice([3, 30, 130]))) for _ in range(rng.randint(1, 9))]
        texts.append((k, "\n\n".join(paras)))
    works = spark.createDataFrame([*texts, (98, ""), (99, None), (97, "x" * 49)], "work_id long, text string")
    got = {}
    for r in segment.segments(works).orderBy("work_id", "pos").collect():
        got.setdefault(r.work_id, []).append(r.text)
    assert got == {k: _chunks(t) for k, t in texts if len(t.strip()) >= 50}


def test_function_ties_and_phase(spark):
    assert FRENCH.patterns[one(spark, extract.pattern_of(F.col("t")), t="il part et rencontre")][0] == "F01"
    assert one(spark, extract.pattern_of(F.col("t")), t="le départ") is None
    assert one(spark, extract.phase_of(F.col("t"), F.lit(0), F.lit(1)), t="à la fin") == "Résolution"
    assert one(spark, extract.modality_of(F.col("t"), dict(FRENCH.modalities)["devoir"]), t="il doit") == 0.6


@pytest.mark.parametrize("a,b", [("", ""), ("ABCBDAB", "BDCABA"), ("AAAA", "AA"), ("XYZ", "XYZ")])
def test_lcs(spark, a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    got = spark.range(1).select(compare.lcs_length(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>"))).first()[0]
    assert got == table[-1][-1]


def test_lcs_of_long_sequences(spark):
    """Several words of bits, with carries between them; with masks made before and with none; time grows with the length of one side only."""
    rng = random.Random(3)
    rows = [tuple([f"F{rng.randint(1, n):02}" for _ in range(rng.choice([0, 1, 61, 62, 63, 124, 125, 300]))] for _ in "ab") for n in (1, 2, 5, 30) for _ in range(12)]
    rows += [(["F01"] * 200, ["F01"] * 70), (["F01", "F02"] * 100, ["F02", "F01"] * 100)]

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before, row = row, [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
        return row[-1]

    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], "id int, a array<string>, b array<string>").withColumn("masks", sequences.code_masks(F.col("a"))).cache()
    got = df.select("id", sequences.lcs_length(F.col("a"), F.col("b")).alias("x"), sequences.lcs_length(F.col("a"), F.col("b"), F.col("masks")).alias("y")).collect()
    assert {r.id: (r.x, r.y) for r in got} == {k: (n, n) for k, n in enumerate(plain(a, b) for a, b in rows)}


def _node(code, family, actants, tension=0.5, phase="Climax", pos=0, v=0.0):
    return (pos, code, family, actants, v, 0.0, 0.0, 0.0, tension, phase, [a.strip().lower() for a in actants], abs(v))


NODE = "struct<pos:int,code:string,family:string,actants:array<string>,vouloir:double,devoir:double,pouvoir:double,savoir:double,tension:double,phase:string,names:array<string>,norm:double>"


def test_match_bound_follows_binary_rounding(spark):
    rows = [(_node("A", "f", ["x"], phase="Climax"), _node("B", "f", ["x"], phase="Exposition"), 0.15 + 0.20 + 0.05), (_node("A", "f", ["x", "y"]), _node("B", "f", ["x"]), 0.15 + 0.20 * 0.5 + 0.10 + 0.05), (_node(None, None, []), _node(None, None, []), 0.10 + 0.05)]
    df = spark.createDataFrame(rows, f"a {NODE}, b {NODE}, want double")
    got = df.select(compare.node_similarity(F.col("a"), F.col("b")).alias("s"), "want").collect()
    assert [r.s for r in got] == [r.want for r in got]
    assert not any(r.s >= compare.MATCH for r in got)


def test_self_comparison_and_flat_curves(spark):
    nodes = [_node("F01", "q", ["a"], 0.1 * k, pos=k) for k in range(5)]
    df = spark.createDataFrame([(nodes, nodes, [0.5] * 4, [0.1, 0.2, 0.3, 0.4], [0.1, 0.2])], f"a array<{NODE}>, b array<{NODE}>, flat array<double>, up array<double>, two array<double>")
    r = df.select(compare.isomorphism(compare.best_matches(F.col("a"), F.col("b"))).alias("iso"), *[compare.tension_profile(F.col(x), F.col(y)).alias(x + y) for x, y in (("flat", "up"), ("up", "up"), ("two", "up"))]).first()
    assert math.isclose(r.iso, 1) and r.flatup == 0.5 and math.isclose(r.upup, 1) and r.twoup == 0.5


def test_roles_and_deltas(spark):
    role = "struct<" + ",".join(f"{r}:string" for r in compare.ROLES) + ">"
    form = "struct<form:string,register:string,narrative_length_category:string,has_explicit_morality:boolean,has_narrator_intervention:boolean>"
    df = spark.createDataFrame([(("Le roi juste", "la paix", None, None, None, None), ("un roi", "la paix", "x", None, None, None), None, ("conte", "Poetique", "court", True, None), ("fable", "lyrique", "long", False, True))], f"a {role}, b {role}, none {role}, f {form}, g {form}")
    s, label = compare.role_alignment((F.col("a"), F.col("none")), (F.col("b"), F.col("none")))
    r = df.select(s.alias("s"), label.alias("l"), compare.role_alignment((F.col("none"),) * 2, (F.col("b"),) * 2)[0].alias("n"), compare.form_delta(F.col("f"), F.col("g")).alias("form"), compare.register_delta(F.col("f"), F.col("g")).alias("reg"), compare.moral_delta(F.col("f"), F.col("g"), F.array(F.lit("F49")), F.array(F.lit("F01"))).alias("moral")).first()
    assert math.isclose(r.s, (0.5 + 1 + 0.5 + 0.5 + 0.5) / 5) and r.l == "v1↔v1" and r.n == 0.5
    assert r.form == 0.75 and r.reg == 0.2 and r.moral == 0.5


def test_parse_cases(spark):
    rows = ['```json\n{"genre": "conte", "nodes": [{"tension": "0.4", "actants": "x"}]}\n```', "no json", "{broken", None, 'x {"main_actants": {"objet": "or"}} y', '{"nodes": [{"tension": "1.5", "function_code": "FNGR", "actants": ["a (b)"]}], "tradition": "grecque"}']
    df = spark.createDataFrame(list(enumerate(rows)), "k int, response string")
    p = ingest.parse_responses(df)
    got = {r.k: r for r in p.collect()}
    assert [got[k].status for k in range(6)] == ["ok", "error", "error", "error", "ok", "ok"]
    assert got[4].main_actants_v1.objet == got[4].main_actants_v2.objet == "or"
    nodes = {r.k: r for r in ingest.response_nodes(p, "k").collect()}
    assert nodes[0].tension == 0.4 and nodes[0].actants == [] and nodes[5].tension == 1.0 and nodes[5].function_code == "F32"


def test_pruning_keeps_high_scores(spark):
    from fabula import queries

    from .conftest import SF

    high = {(r.ref_id, r.cand_id) for r in queries.scores(spark, SF).where("sns > 0.55").select("ref_id", "cand_id").collect()}
    kept = {tuple(r) for r in queries.candidate_pairs(spark, SF).collect()}
    assert high <= kept
