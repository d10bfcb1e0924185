"""Files to works, and graphs to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import block_text

TEXT_FORMATS = ("txt",)
KNOWN_FORMATS = ("txt", "docx", "pdf", "odt", "epub")


def decoded(content: Column) -> Column:
    """UTF-8, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, status, text) of the files under a folder; formats other than text are kept as rejects."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    status = F.when(kind.isin(*TEXT_FORMATS), "ok").when(kind.isin(*KNOWN_FORMATS), "needs_decoder").otherwise("unsupported")
    return files.select("path", kind.alias("format"), status.alias("status"), F.when(status == "ok", decoded(F.col("content"))).alias("text"))


def read_json_works(spark: SparkSession, path: str) -> DataFrame:
    """Works of JSON documents(id, title, author, summary, text); a missing title is the id."""
    rows = spark.read.schema("id string, title string, author string, summary string, text string").json(path, multiLine=True)
    return rows.select(F.col("id").alias("work_id"), F.coalesce("title", "id").alias("title"), "author", "summary", "text")


def html_text(pages: DataFrame, key: str, column: str = "html") -> DataFrame:
    """(key, text) of markup."""
    return pages.select(F.col(key).cast("long").alias(key), block_text(F.col(column)).alias("text"))


#: Columns of a stored graph, as extract.nodes and extract.edges make them; a store of other columns is read by its own schemas.
STORED = {
    "nodes": "work_id bigint, pos int, total int, node_id string, segment_id string, function_code string, function_family string, actants array<string>, vouloir double, devoir double, pouvoir double, savoir double, tension double, phase string, text_excerpt string",
    "edges": "work_id bigint, edge_id string, src_pos int, dst_pos int, transition_type string, weight double",
}
BUCKETS = 64


def _bucket(work_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(work_id), F.lit(buckets)).cast("int")


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _hadoop(spark, path)
    return fs.exists(place)


def save_graphs(nodes: DataFrame, edges: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Appends graphs to a store partitioned by a bucket of work_id."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.withColumn("bucket", _bucket(F.col("work_id"), buckets)).write.mode("append").partitionBy("bucket").parquet(f"{path}/{name}")


def load_graphs(spark: SparkSession, path: str, work_id: int | None = None, buckets: int = BUCKETS, stored: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the store; of one work only from its bucket. A store that holds nothing, or isn't there yet, gives empty tables."""
    out = []
    for name, schema in (stored or STORED).items():
        df = spark.createDataFrame([], schema)
        if exists(spark, f"{path}/{name}"):
            df = spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/{name}")
            if work_id is not None:
                df = df.where((F.col("bucket") == _bucket(F.lit(work_id).cast("long"), buckets)) & (F.col("work_id") == work_id))
        out.append(df.drop("bucket"))
    return out[0], out[1]


def list_graphs(spark: SparkSession, path: str, stored: dict[str, str] | None = None) -> DataFrame:
    """(work_id, n_nodes, n_edges) of the graphs of a store."""
    n, e = (df.groupBy("work_id").agg(F.count("*").alias(f"n_{name}")) for name, df in zip(("nodes", "edges"), load_graphs(spark, path, stored=stored), strict=True))
    return n.join(e, "work_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def delete_graphs(spark: SparkSession, path: str, gone: DataFrame, scratch: str, buckets: int = BUCKETS, stored: dict[str, str] | None = None) -> None:
    """Deletes the works of gone(work_id) from the store, by rewriting the buckets that may hold them and no others.

    What stays of those buckets is written to the new folder `scratch` first and then takes their place (Spark's dynamic partition overwrite); a
    bucket of which nothing stays is removed. A job that fails on the way leaves every bucket as it was or as it will be: run it again.
    """
    keys = gone.select("work_id").distinct().withColumn("bucket", _bucket(F.col("work_id"), buckets))
    keys.write.parquet(f"{scratch}/keys")
    keys = spark.read.schema(keys.schema).parquet(f"{scratch}/keys")
    touched = [r.bucket for r in keys.select("bucket").distinct().collect()]  # as many as there are buckets, at most
    for name, schema in (stored or STORED).items():
        at = f"{path}/{name}"
        if not touched or not exists(spark, at):
            continue
        rows = spark.read.schema(f"{schema}, bucket int").parquet(at).where(F.col("bucket").isin(touched))
        rows.join(keys.select("work_id"), "work_id", "left_anti").write.partitionBy("bucket").parquet(f"{scratch}/{name}")
        kept = spark.read.schema(f"{schema}, bucket int").parquet(f"{scratch}/{name}")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(at)
        left = {r.bucket for r in kept.select("bucket").distinct().collect()}
        for bucket in set(touched) - left:
            fs, place = _hadoop(spark, f"{at}/bucket={bucket}")
            fs.delete(place, True)


def list_documents(docs: DataFrame, key: str, title: str) -> DataFrame:
    """(key, title) of a corpus, without texts; a missing title is the key."""
    return docs.select(key, F.coalesce(title, F.col(key).cast("string")).alias("title"))


def fetch(docs: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one key: the filter reaches the scan."""
    return docs.where(F.col(key) == F.lit(value))


def export(df: DataFrame, path: str, column: str | None = None) -> None:
    """As JSON lines, or one column as text."""
    if column is None:
        df.write.json(path)
    else:
        df.select(column).write.text(path)
