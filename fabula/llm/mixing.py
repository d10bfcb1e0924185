"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Targets: each source is weighted, its target stops at `epochs` times its size, and what it cannot take is shared out
among the others by weight until no source is above its cap. Sorting sources by cap / weight makes this one
pass of running sums: sources up to some rank are capped, the rest share what is left.

Sampling: ratio = target / size. Every document is repeated floor(ratio) times whole; the fractional
repetition goes to whole documents in the order of a seeded hash while they fit the source's remainder,
then to single documents whose size is nearest to what is left, one after the other: a document is taken once more (at most `epochs` times in all) or, if
the sum has gone beyond the target, once less. Each of these ROUNDS leaves less than before, so a source of few long documents ends near its target, too. The hash splits every source into 4,096 bins; bins are summed before the shuffle,
and only the one bin in which the remainder ends is ranked row by row, so a source with
a third of all rows puts one row in 4,096 of its rows into one task.

Defined results: null text has size 0; a null source is a source of its own, last in order; an empty table gives an empty result; rows that
repeat a doc_id and a text fall together (all of them get the fractional repetition, or none); other columns are ignored. The number of
sources is a dimension of the corpus: their table is ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

EPOCHS = 3
BIN_BITS = 12
SALT = 64
ROUNDS = 4


def place(doc_id: Column, text: Column, seed: int = 42) -> Column:
    """A document's place in the seeded order, 0 to 2 ** 60."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 4)


def sizes(docs: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, size, place): words in the whole text, and the document's place in the seeded order."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), place(docs["doc_id"], docs["text"], seed).alias("place"))


def cyclic_weights(rank: Column) -> Column:
    """Weights 1, 2, 3, 1, ... by rank from 1."""
    return (rank - 1) % 3 + 1


def targets(sized: DataFrame, weights=cyclic_weights, epochs: int = EPOCHS, total: Column | None = None) -> DataFrame:
    """(source, source_size, target): water-filled targets that sum to `total` (all sizes), each at most epochs * source_size."""
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", weights(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("total", (total if total is not None else F.sum("source_size").over(everyone)).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = ranked.withColumn("rank", F.row_number().over(order)).withColumn("capped", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    upto = upto.withColumn("open_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("total") - F.coalesce("capped", F.lit(0.0))) / F.col("open_w")  # share for each weight if all before are capped and none from here
    level = F.when(level * F.col("w") <= F.col("cap"), level)
    filled = upto.withColumn("level", F.min_by(level, F.when(level.isNotNull(), F.col("rank"))).over(everyone))
    target = F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap"))
    return filled.select("source", "source_size", target.alias("target"))


def mix(sized: DataFrame, goal: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """sized with source_size, target and times (whole repetitions that the mix takes)."""
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = materialize(goal.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-goal")
    bin_ = F.shiftright("place", 60 - BIN_BITS).alias("bin")
    bins = sized.groupBy("source", bin_).agg(F.sum("size").alias("bin_size"))
    run = Window.partitionBy("source").orderBy("bin")
    bins = bins.withColumn("above", F.sum("bin_size").over(run)).withColumn("below", F.col("above") - F.col("bin_size"))
    g = goal.select(F.col("source").alias("s"), "rest")
    edge = bins.join(g, F.col("source").eqNullSafe(F.col("s"))).where("below <= rest and rest < above").select("s", "bin", "below", "rest")
    edge = materialize(edge, "mix-edge")
    inside = sized.withColumn("bin", bin_).join(edge.withColumnRenamed("bin", "b"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    inside = inside.groupBy("s", "place", "below", "rest").agg(F.sum("size").alias("size"))
    step = Window.partitionBy("s").orderBy("place")
    inside = inside.withColumn("sum", F.col("below") + F.sum("size").over(step)).withColumn("was", F.col("sum") - F.col("size"))
    last = inside.where("sum <= rest").groupBy("s").agg(F.max("place").alias("last"), F.max("sum").alias("upto"))
    first = edge.select("s", F.shiftleft(F.col("bin"), 60 - BIN_BITS).alias("start"), "below", "rest")
    bound = first.join(last, first.s.eqNullSafe(last.s), "left")
    bound = bound.select(first.s.alias("s"), F.coalesce(last.last, F.col("start") - 1).alias("bound"), (F.col("rest") - F.coalesce("upto", "below")).alias("gap"))
    plan = goal.join(bound, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("src"), "source_size", "target", "whole", "rest", "bound", "gap")
    # Sources are few and may be hot: their rows meet the plan by source and salt.
    plan = materialize(plan, "mix-plan")
    salted = lambda p: p.withColumn("grain", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    sized = sized.withColumn("salt", F.pmod("place", F.lit(SALT)).cast("int"))
    meets = F.col("source").eqNullSafe(F.col("src")) & (F.col("salt") == F.col("grain"))
    one = F.coalesce(F.when(F.col("bound").isNotNull(), F.col("place") <= F.col("bound")).otherwise(F.col("rest") > 0), F.lit(False)).cast("long")
    picked = F.aggregate(F.filter("picks", lambda p: p["place"] == F.col("place")), F.lit(0).cast("long"), lambda t, p: t + p["by"])
    times = F.col("whole") + one + picked
    plan = plan.withColumns({"gap": F.coalesce(F.col("gap").cast("double"), F.lit(0.0)), "picks": F.array().cast("array<struct<place:bigint,by:bigint>>")})
    for k in range(ROUNDS):
        off, more = F.abs(F.col("size") - F.abs("gap")), F.col("gap") > 0
        near = sized.join(salted(plan.where("gap <> 0")), meets).where(off < F.abs("gap")).where(F.when(more, times < epochs).otherwise(times > 0))
        near = near.groupBy(F.col("src").alias("f")).agg(F.min(F.struct(off.alias("off"), "place", "size")).alias("pick"))
        plan = plan.join(near, F.col("src").eqNullSafe(F.col("f")), "left")
        by = F.when(F.col("gap") > 0, 1).otherwise(-1).cast("long")
        grown = F.when(F.col("pick").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array(F.struct("pick.place", by.alias("by")))))
        plan = plan.withColumns({"picks": grown, "gap": F.when(F.col("pick").isNull(), 0.0).otherwise(F.col("gap") - by * F.col("pick.size"))}).drop("f", "pick")
        plan = materialize(plan, f"mix-plan-{k}")
    out = sized.join(salted(plan), meets)
    return out.withColumn("times", times.cast("long")).drop("src", "whole", "rest", "bound", "gap", "picks", "salt", "grain")


def mixture(docs: DataFrame, epochs: int = EPOCHS, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and place and source besides."""
    sized = materialize(sizes(docs, seed), "mix-sizes")
    out = mix(sized, targets(sized, epochs=epochs), epochs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", "source", "place")
