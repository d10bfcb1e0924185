"""Operators on lines of whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_recurring_candidate, strip

RECURRING = 3


def recurring_lines(docs: DataFrame, key: str) -> DataFrame:
    """(key, line, n) of trimmed lines that a document holds three times or more, such as running heads."""
    lines = docs.select(key, F.explode(F.transform(F.split("text", "\n"), strip)).alias("line"))
    return lines.where(is_recurring_candidate(F.col("line"))).groupBy(key, "line").agg(F.count("*").alias("n")).where(F.col("n") >= RECURRING)


def drop_recurring_lines(docs: DataFrame, key: str, paged: Column | None = None) -> DataFrame:
    """docs with text without its recurring lines, the other lines in order; `paged`: which documents come from pages, others stay as they are."""
    heads = recurring_lines(docs if paged is None else docs.where(paged), key).groupBy(key).agg(F.collect_list("line").alias("_heads"))
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_heads", strip(x)))
    return docs.join(heads, key, "left").withColumn("text", F.when(F.col("_heads").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("_heads")
