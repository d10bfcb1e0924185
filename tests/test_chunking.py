"""Chunks of long texts and chains of repeated nodes against plain loops."""

import random
import re

from fabula.operators import chunking, ingest


def _windows(sizes, limit, overlap):
    out, cur = [], []
    total = lambda xs: sum(sizes[x] for x in xs)
    for i, n in enumerate(sizes):
        if n > limit:
            out += ([cur] if cur else []) + [[i]]
            cur = []
            continue
        if cur and total(cur) + n > limit:
            out.append(cur)
            tail = [cur[-1]]
            for x in reversed(cur[:-1]):
                if total([x, *tail]) > overlap:
                    break
                tail.insert(0, x)
            cur = tail
            if total(cur) + n > limit:
                out.append(cur)
                cur = []
        cur = [*cur, i]
    return [tuple(c) for c in out + ([cur] if cur else [])]


def test_windows():
    rng = random.Random(5)
    for _ in range(300):
        sizes = [rng.choice([5, 20, 60, 130]) for _ in range(rng.randint(0, 25))]
        made = {}
        for chunk, place in chunking.windows(120, 50)(enumerate(sizes)):
            made.setdefault(chunk, []).append(place)
        assert [tuple(made[k]) for k in sorted(made)] == _windows(sizes, 120, 50), sizes


def test_paragraphs(spark):
    text = "  one\n\n two two \n \n\n" + "Abc def. " * 30 + "\n\n" + "x" * 500 + "\n\n" + "One two. " + "y" * 200 + ".  End."
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, " \n\n ")], "doc_id long, text string")
    got = sorted((r["first"], r["end"], r["text"]) for r in chunking.paragraphs(docs, "doc_id", 100).collect())
    assert [g[2] for g in got[:2]] == ["one", "two two"] and all(" ".join(text[a:b].split()) == t for a, b, t in got)
    assert "".join(t.replace(" ", "") for *_, t in got) == "".join(text.split()) and all(b - a <= 120 for a, b, _ in got)


def test_chunks_of_whole_texts(spark):
    rng = random.Random(8)
    body = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    texts = [(k, "\n\n".join(body(rng.choice([1, 6, 18])) for _ in range(rng.randint(1, 20)))) for k in range(20)] + [(50, "short"), (51, " "), (52, None), (53, "word " * 40_000)]
    got = {}
    for r in chunking.chunks(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", 30, 12).collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, text in texts[:20]:
        rows = sorted(got[k], key=lambda r: r.chunk)
        if int(len(text) / 4 * 1.2) <= 30:
            assert [(r.text, r.char_start, r.char_end) for r in rows] == [(text, 0, len(text))]
            continue
        spans = [m.span() for m in re.finditer(r"[^\n]+", text)]
        want = [(spans[w[0]][0], spans[w[-1]][1]) for w in _windows([b - a for a, b in spans], 120, 48)]
        assert [(r.char_start, r.char_end) for r in rows] == want and all(text[r.char_start : r.char_end] == r.text for r in rows)
        assert [r.label for r in rows] == [f"Bloc {n + 1}/{len(rows)}" for n in range(len(rows))]
        assert [(r.has_overlap_before, r.has_overlap_after) for r in rows] == [(n > 0, n < len(rows) - 1) for n in range(len(rows))]
    assert 51 not in got and 52 not in got and got[50][0].text == "short"
    assert "".join("".join(r.text.split()) for r in sorted(got[53], key=lambda r: r.chunk)) >= "word" * 40_000 and all(len(r.text) <= 120 for r in got[53])


def _kept(rows):
    out = []
    for chunk, pos, code, text in sorted(rows, key=lambda r: r[:2]):
        words = set(re.findall(r"\w{4,}", text.lower()))

        def repeats(k, words=words, chunk=chunk, code=code):
            small = min(len(k[3]), len(words))
            return k[0] == chunk - 1 and (not k[2] or not code or k[2] == code) and small > 0 and len(k[3] & words) / small > 0.5

        if not any(map(repeats, out)):
            out.append((chunk, pos, code, words))
    return {(c, p) for c, p, *_ in out}


def test_overlap_chain(spark):
    rows = [(1, 0, 0, None, "alpha beta gamma"), (1, 1, 1, "F01", "alpha beta gamma"), (1, 2, 2, "F01", "alpha beta gamma"), (1, 3, 3, "F02", "delta alpha"), (1, 4, 4, "F03", "delta alpha")]
    df = spark.createDataFrame(rows, "work_id int, chunk int, pos int, code string, text string")
    assert sorted(r.pos for r in ingest.drop_overlap_nodes(df, "work_id").collect()) == [0, 2, 3, 4]
    rng = random.Random(6)
    rows = [(w, c, 10 * c + p, rng.choice(["F01", "F02", None, ""]), " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "of"], k=rng.randint(0, 4)))) for w in range(12) for c in sorted(rng.sample(range(14), 9)) for p in range(3)]
    df = spark.createDataFrame(rows, "work_id int, chunk int, pos int, code string, text string")
    got = {(r.work_id, r.chunk, r.pos) for r in ingest.drop_overlap_nodes(df, "work_id").collect()}
    assert got == {(w, *x) for w in range(12) for x in _kept([r[1:] for r in rows if r[0] == w])}


def test_overlap_chain_of_ten_thousand_chunks(spark):
    """One event told in every chunk of a work: every other telling stays, however long the chain."""
    rows = [(7, c, 2 * c + p, "F01", ["the same event told again", f"only{c} here{c} this{c}"][p]) for c in range(10_000) for p in range(2)]
    kept = ingest.drop_overlap_nodes(spark.createDataFrame(rows, "work_id int, chunk int, pos int, code string, text string"), "work_id").collect()
    assert {(r.chunk, r.pos) for r in kept} == {(c, 2 * c) for c in range(0, 10_000, 2)} | {(c, 2 * c + 1) for c in range(10_000)}


def test_overlap_is_one_scan(spark):
    """A node's words go through one shuffle, not a row for each word through three; rows without a key or chunk, or without words, stay."""
    rows = [(1, 0, 0, "F01", "alpha beta"), (1, 1, 1, "F01", "beta alpha"), (None, 0, 0, "F01", "alpha beta"), (None, 1, 1, "F01", "alpha beta"), (2, None, 0, "F01", "alpha"), (2, 0, 1, "F01", "alpha"), (3, 0, 0, None, None), (3, 1, 1, None, "of")]
    kept = ingest.drop_overlap_nodes(spark.createDataFrame(rows, "work_id int, chunk int, pos int, code string, text string"), "work_id")
    assert sorted(map(repr, (tuple(r) for r in kept.collect()))) == sorted(repr(r[:4]) for r in rows if r[:2] != (1, 1))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1 and "explode" not in plan
