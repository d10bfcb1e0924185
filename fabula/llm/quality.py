"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every whole text. Expectation-maximisation over
the counts of vote patterns (at most 3 ** labellers of them, counted over all documents) estimates
the share of good documents and, for each labeller, how often it votes either way on good and on bad ones. A
pattern's posterior is the soft label of its documents. A linear scorer on hashed words and word
shapes is then fitted to soft labels of a bounded sample (`fit_rows` documents, in the order of a
seeded hash) and scores every document; documents below `threshold` are rejected.

Texts are measured in Arrow batches, some hundred thousand characters at a time (a longer text alone), as arrays over their code points and words; votes and scores need
a pass each, as the scorer is fitted on what the votes say of all documents. Capitals and small letters are those of Unicode, in any script; words are lowered
letter by letter (where lower case has as many letters).

Defined results: a null or blank text gets no votes and no features, so the intercept is its score; repeated rows
each get a row; a table with too few documents to fit (none, or one soft label throughout) is scored by its posteriors; ties in the order of the sample fall on rows with equal text and id, of which one is fitted; other columns,
whatever their names, are carried along.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import cache
from unicodedata import category

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .arrays import Segments, mixed
from .common import materialize

FIT_ROWS = 5_000
BUCKETS = 1 << 13
#: Frequent function words of the four languages.
COMMON = "the of and to in is that it for on with as are this be at by an or le la les de des et un une en que qui dans pour du est au avec sur par der die und das von ist mit den des ein eine auf für nicht im dem el los del las por con para una su al se no es y".split()
LABELLERS = ("symbols", "upper", "word_length", "marks", "repeats", "common", "sentences", "lines")
_SYMBOLS, _MARKS, _CLOSING = b"#$%*&|!<>{}=~^_@\\/", b"|-*=>", b"\"')"


class Measured:
    """Words of several texts and what labellers look at, each measure an array over the texts."""

    def __init__(self, texts: list[str]) -> None:
        import numpy as np

        values, kinds = letters()
        data = codes("\n".join([*texts, ""]))
        ends = np.cumsum([len(t) + 1 for t in texts])
        begins = ends - [len(t) + 1 for t in texts]
        among = lambda chars: np.isin(np.arange(257), list(chars))[np.minimum(data, 256)]

        def per_text(mask):
            total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
            return total[ends] - total[begins]

        # Words, and their shapes: classes of letters and digits, runs cut to one.
        each = values[data]
        edges = np.flatnonzero(np.diff(each != 0, prepend=False, append=False))
        first, stop = edges[::2], edges[1::2]
        self.words = mixed(Segments(each)(first, stop - first), 9)
        kind = kinds[data]
        kept = np.concatenate([[True], kind[1:] != kind[:-1]]) | ~np.isin(kind, (65, 97, 48))
        place = np.concatenate([[0], np.cumsum(kept)])
        self.shapes = mixed(Segments(mixed(kind[kept].astype(np.uint64), 6))(place[first], place[stop] - place[first]), 10)
        bounds = np.searchsorted(first, np.append(begins, len(data)))
        self.text = np.repeat(np.arange(len(texts)), np.diff(bounds))

        def per_word(mask):
            return np.bincount(self.text[mask], minlength=len(texts))

        self.n_words = np.diff(bounds)
        n, chars = np.maximum(self.n_words, 1), np.maximum(ends - begins - 1, 1)
        last = data[stop - 1]
        closed = np.isin(last, list(_CLOSING)) & (stop - first > 1)
        self.symbols, self.upper = per_text(among(_SYMBOLS)) / chars, per_text(kind == 65) / chars
        self.mean_word = chars / n
        self.marks = per_word((stop - first == 1) & np.isin(data[first], list(_MARKS))) / n
        _, once = np.unique(self.words + mixed(self.text.astype(np.uint64), 14), return_index=True)
        self.distinct = np.bincount(self.text[once], minlength=len(texts)) / n
        self.common = per_word(np.isin(self.words, common_hashes())) / n
        self.ends = per_word(np.isin(np.where(closed, data[np.maximum(stop - 2, 0)], last), list(b".?"))) / n
        edges = np.flatnonzero(np.diff(data != 10, prepend=False, append=False))
        first, stop = edges[::2], edges[1::2]
        line = mixed(Segments(mixed(data.astype(np.uint64), 8))(first, stop - first), 12)
        owner = np.searchsorted(begins, first, "right") - 1
        self.n_lines = np.bincount(owner, minlength=len(texts))
        _, once = np.unique(line + mixed(owner.astype(np.uint64), 14), return_index=True)
        self.distinct_lines = np.bincount(owner[once], minlength=len(texts)) / np.maximum(self.n_lines, 1)

    def votes(self) -> list[str]:
        """For each text its votes, comma-joined: 1 good, -1 bad, 0 none; texts of fewer than eight words get none."""
        import numpy as np

        no = np.zeros(len(self.n_words), bool)
        table = [
            (self.symbols > 0.10, no),
            (self.upper > 0.35, no),
            ((self.mean_word < 2.5) | (self.mean_word > 14), no),
            (self.marks > 0.15, no),
            ((self.distinct < 0.25) & (self.n_words > 30), no),
            (self.common < 0.03, self.common > 0.10),
            ((self.ends < 0.004) & (self.n_words > 30), (self.ends >= 0.02) & (self.ends <= 0.30)),
            ((self.distinct_lines < 0.4) & (self.n_lines > 5), no),
        ]
        rows = np.stack([np.where(self.n_words < 8, 0, np.where(bad, -1, good.astype(int))) for bad, good in table], 1)
        return [",".join(map(str, r)) for r in rows.tolist()]

    def features(self) -> tuple:
        """(text, bucket, value) of the counts of words and shapes by bucket, each text's of length 1."""
        import numpy as np

        tokens = np.concatenate([self.words, self.shapes]) >> np.uint64(64 - BUCKETS.bit_length() + 1)
        key, n = np.unique(np.concatenate([self.text, self.text]) * BUCKETS + tokens.astype(np.int64), return_counts=True)
        text = key // BUCKETS
        return text, key % BUCKETS, n / np.sqrt(np.bincount(text, n * n.astype(float), len(self.n_words)))[text]


def codes(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


@cache
def letters() -> tuple:
    """For each code point a random-looking odd number, the same for a letter and its small one (white space: zero), and its kind: 65 for capitals, 97 for small letters, 48 for 0-9, else itself."""
    import numpy as np

    every = [chr(c) for c in range(sys.maxunicode + 1)]
    small = [x.lower() for x in every]
    values = mixed(np.array([ord(s if len(s) == 1 else x) for x, s in zip(every, small, strict=True)], np.uint64), 5) | np.uint64(1)
    values[[9, 10, 11, 12, 13, 32]] = 0
    kinds = np.arange(len(every), dtype=np.int32)
    names = np.array([category(x) for x in every])
    kinds[names == "Lu"], kinds[names == "Ll"], kinds[48:58] = 65, 97, 48
    return values, kinds


@cache
def common_hashes():
    import numpy as np

    values = letters()[0]
    return np.concatenate([mixed(Segments(values[codes(w)])(np.array([0]), np.array([len(w)])), 9) for w in COMMON])


def _parts(batches: Iterator[pa.RecordBatch], least: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, Measured]]:
    """Rows whose last column is a text, some texts at a time, with their measures."""
    for batch in batches:
        texts, at = batch.column(batch.num_columns - 1), 0
        while at < batch.num_rows:
            kept, n, first = [], 0, at
            while at < batch.num_rows and n < least:
                kept.append(texts[at].as_py() or "")
                n += len(kept[-1]) + 1
                at += 1
            yield batch.slice(first, at - first), Measured(kept)


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, found in _parts(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.votes())], ["doc_id", "h", "votes"])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch, found in _parts(batches):
        text, bucket, value = found.features()
        cut = np.searchsorted(text, np.arange(1, batch.num_rows))
        lists = [pa.array([x.tolist() for x in np.split(c, cut)], pa.list_(k)) for c, k in ((bucket, pa.int32()), (value, pa.float64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["posterior", "at", "value"])


def _score_rows(weights: bytes, intercept: float) -> Callable:
    """(row, votes, score) of rows (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        w = np.frombuffer(weights)
        for batch, found in _parts(batches):
            text, bucket, value = found.features()
            score = 1 / (1 + np.exp(-np.bincount(text, w[bucket] * value, batch.num_rows) - intercept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.votes()), pa.array(score)], ["row", "votes", "score"])

    return run


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list, dict]:
    """EM on (votes, count): the share of good documents, each labeller's {class: {vote: probability}}, and posteriors by pattern."""
    import numpy as np

    if not patterns:
        return 0.5, [], {}
    votes, n = np.array([p for p, _ in patterns]), np.array([c for _, c in patterns], float)
    good = 1 / (1 + np.exp(-1.5 * votes.sum(1) - 0.5))  # start: the majority, a tie is good
    for _ in range(rounds):
        share = float(np.clip((n * good).sum() / n.sum(), 1e-3, 1 - 1e-3))
        odds = np.full(len(n), np.log(share / (1 - share)))
        tables = []
        for j in range(votes.shape[1]):
            table = {}
            for v in (-1, 0, 1):
                hit = votes[:, j] == v
                table[v] = tuple(((n * w)[hit].sum() + 0.5) / ((n * w).sum() + 1.5) for w in (good, 1 - good))
            if table[1][0] * table[-1][1] < table[1][1] * table[-1][0] and (votes[:, j] != 0).any():
                table = dict.fromkeys((-1, 0, 1), (1 / 3, 1 / 3))  # worse than chance: it is not listened to
            tables.append(table)
            odds += np.array([np.log(table[v][0] / table[v][1]) if v else 0.0 for v in votes[:, j].tolist()])
        good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return share, tables, {tuple(p): float(g) for (p, _), g in zip(patterns, good, strict=True)}


def quality(docs: DataFrame, **options) -> DataFrame:
    """docs with posterior (of its votes), score (of the linear scorer, 0 to 1) and keep, which take the place of columns so named."""
    new = ("posterior", "score", "keep")
    return judged(docs, **options).select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in new], *new)


def judged(docs: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = 0.5, seed: int = 42) -> DataFrame:
    """(row, posterior, score, keep): row is the struct of a document's own columns."""
    base = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("h"), docs["text"].alias("text"))
    kind = StructType([base.schema["doc_id"], base.schema["h"], StructField("votes", StringType())])
    voted = materialize(base.mapInArrow(_vote_rows, kind), "quality-votes")
    counts = [(tuple(map(int, r["votes"].split(","))), r["n"]) for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()]  # at most 3 ** labellers rows
    assert len(counts) <= 3 ** len(LABELLERS)
    _, _, posterior = estimate(sorted(counts))
    spark = docs.sparkSession
    soft = spark.createDataFrame([(",".join(map(str, p)), g) for p, g in posterior.items()], "votes string, posterior double")
    sample = voted.select("doc_id", "h", "votes", F.xxhash64(F.lit(seed), "doc_id", "h").alias("order")).orderBy("order").limit(fit_rows)
    sample = sample.join(F.broadcast(soft), "votes").groupBy("doc_id", "h").agg(F.first("posterior").alias("posterior"))
    picked = base.join(F.broadcast(sample.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "posterior")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    table = picked.dropDuplicates(["doc_id", "h"]).select("posterior", "text").mapInArrow(_feature_rows, "posterior double, at array<int>, value array<double>")
    table = materialize(table, "quality-fit")  # fit_rows rows at most
    vector = F.udf(lambda at, value: Vectors.sparse(BUCKETS, at, value), VectorUDT())
    rows = table.select(vector("at", "value").alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("w")))).alias("e"))
    rows = rows.select("features", "e.label", "e.w").where("w > 1e-6").persist()
    whole = docs.select(F.struct("*").alias("row"), docs["text"].alias("text"))
    fits = rows.select("label").distinct().count() == 2
    weights, intercept = bytes(8 * BUCKETS), 0.0
    if fits:
        model = LogisticRegression(weightCol="w", regParam=1e-4, maxIter=25).fit(rows)
        weights, intercept = model.coefficients.toArray().tobytes(), float(model.intercept)
    rows.unpersist()
    out = whole.mapInArrow(_score_rows(weights, intercept), StructType([whole.schema["row"], StructField("votes", StringType()), StructField("score", DoubleType())]))
    out = out.join(F.broadcast(soft), "votes", "left").select("row", "posterior", "score" if fits else F.col("posterior").alias("score"))
    return out.withColumn("keep", F.col("score") >= threshold)
