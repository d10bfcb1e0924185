"""A corpus from documents to token shards: five stages, each written as Parquet and read again as the next one's input.

All stages but the last return the columns of documents. A document that the mix repeats is a row for each repetition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm import decontam, mixing, quality, simhash, token_store
from fabula.llm.common import materialize
from fabula.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _wrapped(docs: DataFrame) -> DataFrame:
    """(row, doc_id, h, all): a document's own columns in a struct, so that none clashes with a stage's, and its keys: id, text hash, hash of all columns."""
    return docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("h"), F.xxhash64(*[docs[c] for c in docs.columns]).alias("all"))


def _plain(docs: DataFrame) -> DataFrame:
    """The columns that operators read."""
    return docs.select(*[docs[c].alias(c) for c in ("doc_id", "text", "source") if c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Each row is judged by its own text, of any length; null and blank ones by the classifier's intercept; repeated rows are judged alike and all stay or go;
    there are no ties; an empty table stays empty; all columns are carried along, whatever their names.
    """
    return quality.judged(docs).where("keep").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group.

    It is that of the smallest doc_id (null last), of repeated ids that of the smallest text hash, then of the smallest hash of all columns; of equal rows one.
    Null and empty texts have fingerprint zero and are one group; texts of any length count whole; an empty table stays empty; columns may have any name.
    """
    rows = _wrapped(docs).select("doc_id", F.col("row.text").alias("text"), "h", "all")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "all")
    kept = simhash.components(rows).groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("n"))
    kept = materialize(kept.select("best.doc_id", "best.all", (F.col("n") > 1).alias("several")), "pipeline-kept")

    def pick(keys: DataFrame) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("k"), F.col("all").alias("k_all"))
        return _wrapped(docs).join(keys, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("all") == F.col("k_all")), "left_semi").select("row")

    # Only groups of several rows can hold equal rows.
    return pick(kept.where("not several")).union(pick(kept.where("several")).dropDuplicates(["row"])).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark.

    Each is decided by its own id and text: rows that share the id of a hit one, or have none, stay if their text is clean; equal rows all stay or go. Null
    and empty texts are clean; texts of any length count whole; there are no ties; an empty table stays empty; columns may have any name.
    """
    spans = decontam.hits(_plain(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))[1]
    hit = materialize(spans.select(F.col("id").alias("k"), "rid").distinct(), "pipeline-hit")
    rows = _wrapped(docs).withColumn("key", decontam.row_id(F.col("doc_id"), F.col("row.text")))
    return rows.join(hit, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("key") == F.col("rid")), "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them.

    Null sources are a source of their own; null and empty texts have no words and are taken with the whole repetitions of their source; rows with equal id and
    text have one place in the seeded order and are taken alike; an empty table stays empty; texts of any length count whole; columns may have any name.
    """
    plan = mixing.mixture(_plain(docs)).where("times > 0").select(F.col("doc_id").alias("k"), F.col("source").alias("s"), "place", "times").distinct()
    rows = _wrapped(docs).withColumn("at", mixing.place(F.col("doc_id"), F.col("row.text")))
    same = F.col("doc_id").eqNullSafe(F.col("k")) & F.col("row.source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("place"))
    return rows.join(plan, same).select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, read back by key: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are the end id alone; repeated rows are stored each, in the order of doc_id (null first), then text hash; texts of any length count
    whole; an empty table writes no shard and gives no row.
    """
    return token_store.token_store(_plain(docs), tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_ids", tokenize),
]

#: Training a classifier, components and tokenizing are beyond SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
