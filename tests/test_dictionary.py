"""The one-pass dictionary against the expressions of extract, and with ten thousand words."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from fabula.lexicon import BENCH, FRENCH
from fabula.operators import dictionary, extract, segment

from .conftest import SF


def test_same_nodes(spark):
    works = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) >= 200").withColumnRenamed("doc_id", "work_id")
    for lexicon in (BENCH, FRENCH):
        segments = segment.segments(works, lexicon).cache()
        got, want = dictionary.nodes(segments, lexicon), extract.nodes(segments, lexicon)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_ten_thousand_words(spark):
    rng = random.Random(9)
    made = list({"".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(12_000)})[:10_000]
    rng.shuffle(made)
    lexicon = replace(FRENCH, patterns=tuple((f"F{k:02}", "f", tuple(made[k * 300 : k * 300 + 300])) for k in range(30)), high=tuple(made[9000:9300]), low=tuple(made[9300:9600]), modalities=(("vouloir", tuple(made[9600:9700])), ("devoir", tuple(made[9700:9800])), ("pouvoir", ()), ("savoir", (made[0], made[0]))))
    texts = [" ".join(rng.choice(made) if rng.random() < 0.3 else "Zz9" for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["", None, made[0] * 5, f"{made[0].upper()} é"]
    rows = [(k, 0, 4, f"s{k}", t, ["A"]) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "work_id long, pos int, total int, segment_id string, text string, entities array<string>")
    got = {r.work_id: r for r in dictionary.nodes(df, lexicon).collect()}
    for k, text in enumerate(texts):
        lower = (text or "").lower()
        words, r = set(lower.split()), got[k]
        n = [len(words & set(ws)) for _, _, ws in lexicon.patterns]
        assert r.function_code == (f"F{n.index(max(n)):02}" if max(n) else None)
        high, low = (sum(w in lower for w in ws) for ws in (lexicon.high, lexicon.low))
        assert abs(r.tension - min(1, max(0, 0.3 + 0.5 * (1 - abs(0 / 3 - 0.7)) + 0.08 * high - 0.05 * low))) < 1e-9
        assert abs(r.vouloir - min(1, 0.3 * sum(w in lower for w in lexicon.modalities[0][1]))) < 1e-9 and abs(r.savoir - min(1, 0.6 * (made[0] in lower))) < 1e-9 and r.pouvoir == 0
    assert df.select(F.lit(1)).count() == len(got)
