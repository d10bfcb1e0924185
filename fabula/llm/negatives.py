"""Hard negatives by Fagin's threshold algorithm.

Rows are dealt into blocks. A block keeps, for each dimension, the list of its rows in the order of that component: per-dimension sorted candidate lists. An
anchor walks down all lists at once, from the end that the sign of its own component names, so that the products it meets never grow. Each row met for the
first time is scored whole (random access, integers only). The products at the present depth add up to the threshold, which no row still unmet can exceed:
once it is strictly below the k-th score of every window the block is done; strictly, for ties go to the smaller vec_id. What the blocks find is merged by rank.

Two passes: positives (one window: the same label), then negatives (a window between 80% and 100% of each positive's score: other labels). Anchors, a stated set,
meet all rows in blocks: (block, anchor block) is the key of a shuffle, so neither side is ever whole in one task, whatever labels or vectors repeat.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; shorter vectors count as filled up with zeros; a row with a null
vec_id is no anchor, its label stays, and it ranks after all others of its score; rows that are equal count each as candidates (they are counted before they are dealt) and
once as anchors; a row is no positive of another with its vec_id; scores are exact within 64 bits. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

POSITIVES = NEGATIVES = 5
#: Rows of a block and anchors of an anchor block at most, on average.
BLOCK, ANCHORS = 16_384, 2_048
FOUND = "anchor long, hi long, id long, score long"


class Lists:
    """The sorted lists of a block of vectors."""

    def __init__(self, vectors) -> None:
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T
        self.values = np.take_along_axis(vectors.T, self.order, axis=1)

    def walk(self, anchor):
        """(rows met for the first time, their scores, threshold: the most that any unmet row can score), to ever greater depth."""
        n, depth, met = len(self.vectors), 0, np.zeros(len(self.vectors), bool)
        dims = np.flatnonzero(anchor)
        weights = anchor[dims]
        if not len(dims):
            yield np.arange(n), np.zeros(n, np.int64), 0
            return
        while depth < n:
            upto = min(n, 2 * depth or 8)
            places = np.where((weights > 0)[:, None], np.arange(n - 1 - depth, n - 1 - upto, -1), np.arange(depth, upto))
            new = np.zeros(n, bool)
            new[self.order[dims[:, None], places]] = True
            new = np.flatnonzero(new & ~met)
            met[new] = True
            yield new, self.vectors[new] @ anchor, int(self.values[dims, places[:, -1]] @ weights)
            depth = upto


class Top:
    """The first k of a window of scores: lo (None: no end) to hi. Rows of a block stand in the order that ties take."""

    def __init__(self, k: int, lo: int | None, hi: int | None) -> None:
        self.k, self.lo, self.hi = k, lo, hi
        self.rows = self.scores = np.zeros(0, np.int64)

    def add(self, rows, scores, times) -> None:
        fits = np.ones(len(rows), bool)
        if self.lo is not None:
            fits &= scores >= self.lo
        if self.hi is not None:
            fits &= scores <= self.hi
        if fits.any():
            rows, scores = np.concatenate([self.rows, np.repeat(rows[fits], times[fits])]), np.concatenate([self.scores, np.repeat(scores[fits], times[fits])])
            best = np.lexsort((rows, -scores))[: self.k]
            self.rows, self.scores = rows[best], scores[best]

    def ends(self, threshold: int) -> bool:
        """Nothing that is still unmet can enter."""
        least = int(self.scores[-1]) if len(self.rows) == self.k else self.lo
        return least is not None and threshold < least


def quantised(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v, n): floor(256 * x) of each component, the changed label, and how many rows are equal; only rows that take part."""
    x = rows["embedding"]
    broken = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    label = rows["label"].cast("long")
    label = F.when(rows["vec_id"] % 7 == 0, (label + 1) % 10).otherwise(label)
    v = F.transform(x, lambda e: F.floor(e.cast("double") * 256))
    kept = rows.where(rows["label"].isNotNull() & x.isNotNull() & ~broken).select(rows["vec_id"].cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))
    return kept.groupBy("vec_id", "label", "v").agg(F.count("*").alias("n"))


def _finder(dims: int, k: int, positives: bool):
    """Of a block of rows and a block of anchors: the first k of each anchor's windows."""

    def vectors(table):
        return table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(table.num_rows, dims)

    def found(rows, anchors):
        import pyarrow as pa
        import pyarrow.compute as pc

        out = {c: [] for c in ("anchor", "hi", "id", "score")}
        if rows.num_rows and anchors.num_rows:
            rows = rows.take(pc.sort_indices(rows["vec_id"], null_placement="at_end"))
            ids, labels, times = rows["vec_id"].combine_chunks(), rows["label"].to_numpy(), np.minimum(rows["n"].to_numpy(), k)
            lists = Lists(vectors(rows))
            for anchor, vec_id, label, v, highs in zip(anchors["anchor"].to_pylist(), anchors["vec_id"].to_pylist(), anchors["label"].to_pylist(), vectors(anchors), anchors["highs"].to_pylist()):
                right = (labels == label) & pc.fill_null(pc.not_equal(ids, vec_id), True).to_numpy(zero_copy_only=False) if positives else labels != label
                tops = [Top(k, None, None)] if positives else [Top(k, -(-4 * hi // 5), hi) for hi in highs if hi >= 0]
                if not tops:
                    continue
                for new, scores, threshold in lists.walk(v):
                    use = right[new]
                    for top in tops:
                        top.add(new[use], scores[use], times[new[use]])
                    if all(top.ends(threshold) for top in tops):
                        break
                for top in tops:
                    out["anchor"] += [anchor] * len(top.rows)
                    out["hi"] += [top.hi] * len(top.rows)
                    out["id"] += ids.take(pa.array(top.rows)).to_pylist()
                    out["score"] += top.scores.tolist()
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    return found


def _meet(rows: DataFrame, anchors: DataFrame, blocks: int, anchor_blocks: int, found) -> DataFrame:
    """Every block of rows with every block of anchors."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    here = rows.select("vec_id", "label", "v", "n", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks)).cast("int").alias("block"), every(anchor_blocks).alias("part"))
    there = anchors.select("anchor", "vec_id", "label", "v", "highs", F.pmod(F.xxhash64("anchor"), F.lit(anchor_blocks)).cast("int").alias("part"), every(blocks).alias("block"))
    return here.groupBy("block", "part").cogroup(there.groupBy("block", "part")).applyInArrow(found, FOUND)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k by score, then id: rank."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, anchor_block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows(vec_id, embedding, label). Anchors: vec_id divisible by 100."""
    spark = rows.sparkSession
    rows = materialize(quantised(rows), "negatives-rows")
    dims, n = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v"))).alias("v")
    rows = rows.select("vec_id", "label", filled, "n")
    anchors = rows.where(F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor)
    anchors = materialize(anchors.select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "v"), "negatives-anchors")
    blocks, parts = max(shuffle_partitions(spark), -(-n // block)), max(1, -(-anchors.count() // anchor_block))
    no_highs = anchors.withColumn("highs", F.array().cast("array<bigint>"))
    near = _first(_meet(rows, no_highs, blocks, parts, _finder(dims, positives, True)), ["anchor"], positives)
    near = materialize(near.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    highs = near.groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("highs"))
    far = _first(_meet(rows, anchors.join(highs, "anchor"), blocks, parts, _finder(dims, negatives, False)), ["anchor", "hi"], negatives)
    far = far.select("anchor", F.col("hi").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    return near.join(far, ["anchor", "positive_score"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
