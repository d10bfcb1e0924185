"""Steps that many queries share are done once: words of a text, nodes of a corpus."""

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from fabula import queries_more, queries_reports
from fabula.functions import text as T
from fabula.lexicon import FRENCH
from fabula.operators import extract, ingest, segment

from .conftest import SF


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_has_length(spark):
    blank = "  \n\t "
    texts = ["", blank, "x", "xy", "x" * 49, "é" * 50, "\U0001d11e" * 50, f"{blank}{'a' * 24}{blank * 5}b{blank}", f"{blank}{'a' * 24}{blank * 5}{blank}", "a\n" + " " * 47 + "b", "a\n" + " " * 48 + "b", " " * 300, None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    t = F.col("t")
    got = {r.k: (r.a, r.b) for r in rows.select("k", T.has_length(t, 50).alias("a"), (F.length(T.strip(t)) >= 50).alias("b")).collect()}
    assert all(a == b for a, b in got.values()) and {a for a, _ in got.values()} == {True, False, None}


def test_nodes_read_no_offsets_and_cut_words_once(spark):
    works = spark.createDataFrame([(1, "Le roi part. Soudain Marie rencontra le Griot. Depuis lors, à la fin. " * 40), (2, "Alors il tua. " * 9)], "work_id long, text string")
    light, full = (extract.nodes(segment.segments(works, FRENCH, offsets), FRENCH) for offsets in (False, True))
    assert sorted(map(str, light.collect())) == sorted(map(str, full.collect()))
    asked = light.select("work_id", "function_code", "phase", "tension")
    assert "locate(" not in _plan(asked) and _plan(asked).count("(?U)\\w+") == 1


@pytest.mark.parametrize("name", ["graph_documents", "merge_dedup", "merge_counts", "merge_renumbered"])
def test_corpus_is_cut_once(spark, name):
    """What is used several times is read back from a written table, not made from the documents again."""
    assert not any("documents.parquet" in f for f in entry.queries()[name](spark, SF).inputFiles())


def test_graph_store_makes_nodes_once(spark, monkeypatch):
    """Nodes and edges are saved from a written table of nodes."""
    saved = []
    keep = queries_reports.files.save_graphs
    monkeypatch.setattr(queries_reports.files, "save_graphs", lambda nodes, edges, path: (saved.append((nodes.inputFiles(), edges.inputFiles())), keep(nodes, edges, path)))
    assert entry.queries()["graph_store"](spark, SF).count()
    assert saved and not any("documents.parquet" in f for side in saved[0] for f in side)


def test_responses_read_the_texts_once(spark):
    """Language and source of a work go with its nodes: no join with the documents again, one shuffle."""
    plan = _plan(queries_more.responses(spark, SF))
    assert "Join" not in plan and plan.count("Relation [") + plan.count("Relation[") == 1


def test_parsed_responses_are_objects(spark):
    rows = spark.createDataFrame([(1, '{"genre": "g"}'), (2, '[{"genre": "g"}]'), (3, "[1]"), (4, "talk"), (5, '{"genre": '), (6, '{"genre": }'), (7, None), (8, '```json\n{"nodes": []}\n``` }'), (9, "{}"), (10, '"{x}"')], "work_id int, response string")
    got = {r.work_id: r.status for r in ingest.parse_responses(rows).collect()}
    body = ingest.json_body(F.col("response"))
    want = {r.work_id: r.kind for r in rows.select("work_id", F.schema_of_variant(F.try_parse_json(body)).alias("kind")).collect()}
    assert got == {k: "ok" if (v or "").startswith("OBJECT") else "error" for k, v in want.items()} and set(got.values()) == {"ok", "error"}
