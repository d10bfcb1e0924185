"""The table of narrative functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lexicon import FUNCTION_NAMES, REPERTOIRE


def repertoire(spark: SparkSession) -> DataFrame:
    """(family_id, code, name, african, ord): 53 rows."""
    rows = [(fam, c, FUNCTION_NAMES[c], fam == "FN") for fam, codes in REPERTOIRE for c in codes.split()]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "family_id string, code string, name string, african boolean, ord int")


def search(functions: DataFrame, terms: DataFrame, limit: int = 20) -> DataFrame:
    """terms(term) with the functions whose code is the term (upper case) or whose name, or description if there is one, contains it; total and the first `limit`."""
    words = F.concat_ws("\n", *[F.lower(c) for c in ("name", "description") if c in functions.columns])
    hit = terms.join(F.broadcast(functions.withColumn("_words", words)), (F.col("code") == F.upper("term")) | F.col("_words").contains(F.lower("term")))  # 53 rows
    per = hit.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("ord", "code"))).alias("found"))
    return per.select("term", F.size("found").alias("total"), F.transform(F.slice("found", 1, limit), lambda x: x["code"]).alias("codes"))


def totals(tagged_nodes: DataFrame) -> DataFrame:
    """One row: nodes with a function, and the different functions, families and African functions among them. Counts are made for each code first."""
    per = tagged_nodes.where("family_id is not null").groupBy("function_code", "family_id", "african").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.count("*").alias("functions"), F.count_distinct("family_id").alias("families"), F.count_if("african").alias("african"))


def tagged(nodes: DataFrame, functions: DataFrame) -> DataFrame:
    """nodes with the repertoire's name and family of their code."""
    return nodes.join(F.broadcast(functions.select(F.col("code").alias("function_code"), F.col("name").alias("function_name"), "family_id", "african")), "function_code", "left")
