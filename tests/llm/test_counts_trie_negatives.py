"""Token counts, prefix trie and hard negatives against brute force, with nulls, ties, repeated and empty rows, long texts and clashing names."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from fabula.llm import negatives, prefix_trie, token_counts


@pytest.fixture(scope="module")
def vocabularies():
    return pytest.importorskip("public_tokenizers").path


ODD = ["", " ", "  ", "a ", " a", "a  b\n\n c", "▁a", "a▁▁b ", "<s> </s> <unk>", "<0x0A>", "日本 l'été ²3 don't", "x<|endoftext|>y", "<|startoftext|>", "\x00 \t", "🙂🙂", None]


def texts():
    rng = random.Random(3)
    parts = ["the", "ing", "a", " ", " ", "  ", "▁", "\n", "é", "日", "<s>", "<|endoftext|>", "Zq", "0x", "🙂"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    return [*ODD, *made, "word " * 300_000, "x" * 100_000, "the cat " * 3 + "antidisestablishmentarianism " * 2]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts(spark, vocabularies, name):
    path = vocabularies(name)
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    else:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rows = [(k, t, "n", 1) for k, t in enumerate(texts())] + [(None, "the cat", "n", 1), (0, "again", "n", 1), (0, "again", "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, n_tokens int")
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, path).collect()]
    want = [(d, len((t or "").encode()), n, n > 4096) for d, t, *_ in rows for n in [count(t or "")]]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[3] for r in got)
    assert token_counts.token_counts(docs.limit(0), path).count() == 0


def test_whole_tokens_are_counted_at_once(spark, vocabularies):
    path = vocabularies("piece_bpe_32k.model")
    c = token_counts.counter(path)
    assert c.cuts and len(c.whole) > 10_000 and all(len(c.library.encode(w)) == 1 for w in c.whole if w)
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "zxqv the")], "doc_id long, text string")
    n = {r.doc_id: (r.n_tokens, r.n_whole) for r in token_counts.token_counts(docs, path).collect()}
    assert n[1] == (len(c.library.encode("the cat sat on the mat")), sum(w in c.whole for w in "the cat sat on the mat".split())) and n[2][1] == 1


def expected_trie(messages):
    turns = defaultdict(list)
    for conv, turn, role, text in messages:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0][0], t[0][1] or 0, t[1]))] for c, ts in turns.items()}
    members = defaultdict(set)
    path = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
        for d in range(len(path[c]) + 1):
            members[path[c][:d]].add(c)
    out = []
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = lambda q: sum(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)
        ends = ",".join(map(str, sorted(c for c in who if len(path[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), children(p), sum(children(q) == 0 for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def chats():
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 60), 100, 101, 103, 250, 251, 300]:
        n = rng.choice([1, 2, 3, 5, 7, 12])
        rows += [(c, k if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["hello", "é🙂", "", None, f"t{rng.randint(0, 3)}"])) for k in range(n)]
    rows += [(c, k, "user", "same") for c in range(400, 440) for k in range(4)]  # one conversation in forty copies
    rows += [(500, k, "user", f"turn {k}") for k in range(30)] + [(501, k, "user", f"turn {min(k, 25)}") for k in range(30)]
    rows += [(7, 1, "user", "tie"), (7, 1, "assistant", "tie"), (7, 1, "user", "tie"), (None, 1, "user", "lost"), (600, 0, "user", "long " * 50_000), (601, 0, "user", "long " * 50_000)]
    return rows


@pytest.mark.parametrize(("band", "shallow"), [(0, 4), (60, 1), (100_000, 4), (100_000, 0)])
def test_prefix_trie(spark, band, shallow):
    rows = chats()
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, depth int, key string, ends string").repartition(5)
    got = [tuple(r) for r in prefix_trie.prefix_trie(table, band, shallow).collect()]
    assert sorted(got, key=repr) == sorted(expected_trie(rows), key=repr)


def test_prefix_trie_without_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = prefix_trie.prefix_trie(none)
    assert out.count() == 0 and out.columns[-1] == "ends_sha256"
    lost = spark.createDataFrame([(None, 1, "user", "x")], none.schema)
    assert prefix_trie.prefix_trie(lost).count() == 0


def test_bands_cover_every_level_once():
    lengths = {0: 3, 2: 500, 5: 40, 9: 3, 300: 1}
    for band in (0, 50, 400, 10_000):
        found = prefix_trie.bands(lengths, band, 4)
        assert [d for top, foot in found for d in range(top, foot, -1)] == list(range(300, -1, -1))
        assert all(top - foot == 1 or foot >= 4 for top, foot in found)


def test_members_of_a_hot_node_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    ids = list(range(1, 100, 3))
    paths = spark.createDataFrame([(c, [b"k"], [1]) for c in ids], "conv_id long, keys array<binary>, sizes array<int>").repartition(4)
    one = prefix_trie.ended(paths).collect()
    assert len(one) == 1 and one[0].n_convs == len(ids) and one[0].ends == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def expected_negatives(rows, k=5):
    import math

    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    for a in {(i, tuple(v), lab) for i, v, lab in kept if i is not None and i % 100 == 0}:
        score = lambda r: sum(x * y for x, y in zip(a[1], r[1]))
        order = sorted(((-score(r), r[0] is None, r[0] or 0, r) for r in kept), key=lambda x: x[:3])
        for s, _, _, p in [x for x in order if x[3][2] == a[2] and x[3][0] != a[0]][:k]:
            near = [x for x in order if x[3][2] != a[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a[0], p[0], rank, n[3][0], -s, -n[0]) for rank, n in enumerate(near, 1)]
    return out


def vectors():
    rng = random.Random(5)
    rows = [(k, [round(rng.gauss(0, 0.2), 2) for _ in range(6)], rng.randint(0, 3)) for k in range(320)]
    rows += [(1000 + k, rows[3][1], k % 2) for k in range(40)]  # many ties
    rows += [(400, [0.0] * 6, 1), (500, [0.1, 0.2], 2), (501, [], 2), (None, rows[100][1], 1), (None, rows[100][1], 2), rows[9], rows[9], rows[100], rows[200]]
    return [*rows, (600, None, 1), (601, [0.1] * 6, None), (602, [0.1, None], 1), (603, [float("nan")] * 6, 1), (604, [float("inf")] * 6, 1), (700, [-5.0] * 6, 2)]


@pytest.mark.parametrize(("block", "anchors"), [(16_384, 2_048), (10, 2)])
def test_hard_negatives(spark, block, anchors):
    rows = vectors()
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label int, v int, n int, score int").repartition(3)
    got = [tuple(r) for r in negatives.hard_negatives(table, block=block, anchor_block=anchors).collect()]
    assert sorted(got, key=repr) == sorted(expected_negatives(rows), key=repr)
    assert negatives.hard_negatives(table.limit(0)).count() == 0


def test_walks_stop_before_their_lists_end():
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.integers(-100, 100, (5000, 3))
    v[:50] = np.abs(v[:50]) + 400
    lists, met = negatives.Lists(v), 0
    top = negatives.Top(5, None, None)
    for new, scores, threshold in lists.walk(np.array([3, 2, 1])):
        met += len(new)
        top.add(new, scores, np.ones(len(new), np.int64))
        if top.ends(threshold):
            break
    want = np.lexsort((np.arange(5000), -(v @ np.array([3, 2, 1]))))[:5]
    assert top.rows.tolist() == want.tolist() and met < 500
