"""Queries on the narrative operators: whole tables, bench lexicon; pair queries take every work whose id is divisible by 100 against all works."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .lexicon import BENCH
from .operators import blocks, clean, compare, dictionary, extract, search, segment

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where(T.has_length(F.col("text"), 200)).withColumnRenamed("doc_id", "work_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, lang, pos, total, text) without the columns that a query doesn't need."""
    return segment.chunk_rows(works(spark, sf_dir), "work_id", "lang")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.nodes(segment.segments(works(spark, sf_dir), BENCH, False), BENCH)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.profiles(nodes(spark, sf_dir))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors both can write: under spark.checkpoint.dir, a temporary one only for a session on one machine that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


IDS = ["ref_id", "cand_id"]


#: Columns of a pair that scores() gives if none are named.
SCORES = [n for n, _ in compare.WEIGHTS] + ["sns", "sns_normalized", "ss", "st", "modality", "srj", "srj_level", "verdict", "warnings"]


def scored(rows: DataFrame, wanted: list[str], **how) -> DataFrame:
    """blocks.scored() of the query works among the rows against all; rows: a work's profile, or the columns of it that are needed."""
    return blocks.scored(rows.where("work_id % 100 = 0"), rows, wanted, **how).withColumnsRenamed({"ref_work_id": "ref_id", "cand_work_id": "cand_id"})


def scores(spark: SparkSession, sf_dir: str, wanted: list[str] | None = None, more: dict[str, Column] | None = None, **how) -> DataFrame:
    """The wanted scores of the query works against all; more: columns of a work to keep besides, made once for it."""
    rows = compare.prepared(profiles(spark, sf_dir).withColumns(more or {}))
    return scored(rows, wanted or SCORES, keep=list(more or ()), **how)


def _r(c, name: str):
    return F.round(c, 6).alias(name)


@query
def clean_text(spark, sf_dir):
    c = T.clean(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.length(c).alias("n_chars"), T.n_words(c).alias("n_words"), F.md5(c).alias("text_md5"))


@query
def word_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.length("text").alias("char_count"), T.n_words(F.col("text")).alias("word_count"))


@query
def quality_flags(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.quality_flags(F.col("text"), T.n_words(F.col("text"))), ",").alias("flags"))


@query
def admission(spark, sf_dir):
    n = F.length(T.strip(F.col("text")))
    return documents(spark, sf_dir).select("doc_id", (n >= 50).alias("can_segment"), (n >= 200).alias("can_analyse"))


@query
def page_number_lines(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(T.drop_page_numbers(F.col("text"))).alias("text_md5"))


@query
def recurring_lines(spark, sf_dir):
    return clean.recurring_lines(documents(spark, sf_dir), "doc_id")


@query
def segments(spark, sf_dir):
    return chunks(spark, sf_dir).select("work_id", "pos", "total", T.n_words(F.col("text")).alias("word_count"), F.md5("text").alias("text_md5"))


@query
def segment_offsets(spark, sf_dir):
    return segment.segments(works(spark, sf_dir), BENCH).select("work_id", "pos", "start_char", "end_char")


@query
def entities(spark, sf_dir):
    return chunks(spark, sf_dir).select("work_id", "pos", F.array_join(segment.entities(F.col("text"), BENCH), "|").alias("entities"))


@query
def actions(spark, sf_dir):
    return chunks(spark, sf_dir).select("work_id", "pos", F.array_join(segment.actions(F.col("text"), BENCH), "|").alias("actions"))


@query
def function_tags(spark, sf_dir):
    return nodes(spark, sf_dir).select("work_id", "pos", "function_code", "function_family")


@query
def phases(spark, sf_dir):
    return chunks(spark, sf_dir).select("work_id", "pos", extract.phase_of(F.col("text"), F.col("pos"), F.col("total"), BENCH).alias("phase"))


@query
def tension(spark, sf_dir):
    return chunks(spark, sf_dir).select("work_id", "pos", _r(extract.tension_of(F.col("text"), F.col("pos"), F.col("total"), BENCH), "tension"))


@query
def modalities(spark, sf_dir):
    return chunks(spark, sf_dir).select("work_id", "pos", *[_r(extract.modality_of(F.col("text"), ws), n) for n, ws in BENCH.modalities])


def _nodes(spark, sf_dir):
    return nodes(spark, sf_dir).select("work_id", "node_id", "function_code", F.array_join("actants", "|").alias("actants"), "phase", _r("tension", "tension"))


QUERIES["nodes"] = _nodes


@query
def dictionary_nodes(spark, sf_dir):
    """The nodes again, by one pass over each text."""
    n = dictionary.nodes(segment.segments(works(spark, sf_dir), BENCH, False), BENCH)
    return n.select("work_id", "node_id", "function_code", F.array_join("actants", "|").alias("actants"), "phase", _r("tension", "tension"), *[_r(m, m) for m in extract.MODALITIES])


@query
def edges_sequential(spark, sf_dir):
    return extract.sequential_edges(nodes(spark, sf_dir)).select("work_id", "src_pos", "transition_type")


@query
def edges_distant(spark, sf_dir):
    return extract.distant_edges(nodes(spark, sf_dir)).select("work_id", "src_pos", "dst_pos")


@query
def work_rollup(spark, sf_dir):
    p = profiles(spark, sf_dir)
    return p.select("work_id", "n_nodes", F.array_join("codes", " ").alias("function_sequence"), F.size(F.array_distinct("actants")).alias("n_actants"), _r(F.array_max("tensions"), "peak_tension"))


@query
def function_histogram(spark, sf_dir):
    tagged = chunks(spark, sf_dir).select("work_id", "lang", extract.pattern_of(F.col("text"), BENCH).alias("p")).where("p is not null")
    code = F.get(F.array(*[F.lit(p[0]) for p in BENCH.patterns]), F.col("p")).alias("function_code")
    return tagged.groupBy("lang", code).agg(F.count("*").alias("n"), F.count_distinct("work_id").alias("n_works"))


def _node_rows(spark, sf_dir, top: int | None = None):
    p = profiles(spark, sf_dir)
    return blocks.node_rows(p.where("work_id % 100 = 0"), p, top).withColumnsRenamed({"ref_work_id": "ref_id", "cand_work_id": "cand_id"})


@query
def node_similarity(spark, sf_dir):
    return _node_rows(spark, sf_dir).drop("rank")


@query
def correspondences_topk(spark, sf_dir):
    return _node_rows(spark, sf_dir, compare.BEST)


@query
def s_iso(spark, sf_dir):
    return scores(spark, sf_dir, ["s_iso"], digits=6)


@query
def s_ged(spark, sf_dir):
    return scores(spark, sf_dir, ["s_ged"], digits=6)


@query
def s_func_lcs(spark, sf_dir):
    return scores(spark, sf_dir, ["lcs", "s_func"], digits=6)


@query
def actant_persistence(spark, sf_dir):
    return scores(spark, sf_dir, ["s_chain"], digits=6).withColumnRenamed("s_chain", "persistence")


@query
def tension_resample(spark, sf_dir):
    return scores(spark, sf_dir, ["n_points", "ref_sum", "cand_sum"], digits=6)


@query
def s_tens(spark, sf_dir):
    return scores(spark, sf_dir, ["s_tens"], digits=6)


@query
def pair_scores(spark, sf_dir):
    return scores(spark, sf_dir, ["sns", "sns_normalized", "ss", "st", "srj"], digits=6)


@query
def modality_class(spark, sf_dir):
    return scores(spark, sf_dir, ["modality"])


@query
def risk_level(spark, sf_dir):
    return scores(spark, sf_dir, ["srj_level", "verdict"])


@query
def warnings(spark, sf_dir):
    return scores(spark, sf_dir, ["warnings"])


@query
def transformation(spark, sf_dir):
    return scores(spark, sf_dir, ["structure_delta", "moral_delta", "st"], digits=6)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, read as often as needed."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bounded(spark, sf_dir):
    return search.bounded_top_k(written(profiles(spark, sf_dir), "profiles"), F.col("work_id") % 100 == 0, 10, written)


@query
def topk_similar(spark, sf_dir):
    return _bounded(spark, sf_dir)[0].select("ref_id", "rank", "cand_id", _r("sns", "sns"))


@query
def score_percentile(spark, sf_dir):
    path = shared_path(spark, "scores")
    scores(spark, sf_dir, ["sns"]).write.parquet(path)
    return compare.percentiles(spark.read.parquet(path)).select(*IDS, _r("percentile", "percentile"))


@query
def candidate_pairs(spark, sf_dir):
    p = written(profiles(spark, sf_dir), "profiles")
    return search.candidate_pairs(p.where("work_id % 100 = 0"), p)
