import zlib

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from fabula.llm import decontam, quality, simhash
from fabula.llm.queries import tokenizer_path
from tests.conftest import SF


def test_pipeline_does_what_its_stages_say(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(stage(spark, tables[-1], SF).cache())
        assert tables[-1].columns == docs.columns
    good, alone, clean, mixed = ([r.doc_id for r in t.collect()] for t in tables[1:])
    assert sorted(good) == sorted(r.doc_id for r in quality.quality(docs).where("keep").collect())
    prints = {d: simhash.text_fingerprint(texts[d].encode()) for d in good}
    close = lambda a, b: ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 2
    assert all(any(close(d, k) or d in alone for k in good if k != d) or d in alone for d in good)
    assert not any(close(a, b) for a in alone for b in alone if a < b)
    hit = {r.doc_id for r in decontam.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    assert sorted(clean) == sorted(d for d in alone if d not in hit)
    assert set(mixed) <= set(clean) and all(mixed.count(d) <= 3 for d in set(mixed))
    t = Tokenizer.from_file(tokenizer_path())
    out = corpus_pipeline.run(spark, SF).collect()
    want = sorted((d, zlib.crc32(np.array(t.encode(texts[d], add_special_tokens=False).ids + [0], "<u4").tobytes())) for d in mixed)
    assert sorted((r.doc_id, r.ids_crc32) for r in out) == want


def test_stages_decide_on_each_row(spark, tmp_path):
    text = lambda a: " ".join(f"{a}word{i}" for i in range(40))
    item, copy = text("item"), text("copy")
    rows = [(1, text("a")), (1, item), (None, text("b")), (None, item), (None, copy), (None, copy), (7, copy), (7, copy), (8, text("c")), (8, text("d")), (None, text("e")), (None, text("e"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    alone = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    got = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert got(alone) == sorted([(1, text("a")), (1, item), (None, text("b")), (7, copy), (8, text("c")), (8, text("d")), (None, text("e"))], key=repr)
    clean = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert got(clean) == sorted((r for r in rows if r[1] != item), key=repr)


def test_stages_with_clashing_names_nulls_and_empty_tables(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    text = lambda a: " ".join(f"{a}word{i}" for i in range(40))
    item = text("item")
    odd = ["_id", "_times", "_source", "_place", "row", "doc", "h", "all", "k", "s", "times", "place", "size", "rid", "key", "component", "posterior", "score", "keep", "votes", "start"]
    bodies = [(1, text("a"), "x"), (1, item, "x"), (2, text("a"), "y"), (None, None, None), (None, "", "x"), (None, None, None), (3, text("c"), None), (3, text("c"), None), (4, text("d") * 400, "y"), (5, text("e"), "z")]
    rows = [(*b, *[k] * len(odd)) for k, b in enumerate(bodies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` long" for c in odd))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table, n in ((docs, len(rows)), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            got = out.collect()
            assert name == "token_ids" or out.columns == docs.columns
            assert {"near_duplicates": 6, "decontamination": 9, "token_ids": 10}.get(name, len(got)) * bool(n) == len(got)
            if name in ("near_duplicates", "decontamination"):
                assert {tuple(r) for r in got} <= {tuple(r) for r in rows}
            if name == "mixing":
                assert all(tuple(r) in rows for r in got) and all(got.count(r) <= 3 for r in got)
    texts = {r.text for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert texts >= {text("a"), item, text("c"), text("e")} and len(texts & {None, ""}) == 1
