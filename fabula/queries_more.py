"""Queries on ingestion, repertoire, reports, sources and streams. Responses and chunk results are derived from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.text import token_estimate
from .lexicon import BENCH
from .operators import chunking, clean, compare, extract, history, ingest, repertoire, report, segment
from .queries import Query, documents, nodes, profiles, scored, scores, shared_path, table, works, written
from .queries_logs import ACTIONS, analyses, usage
from .sources import files
from .streaming import live

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, response): analyses of works as a model would write them, every eleventh broken, some fenced or with talk around."""
    # Language and source go with the nodes, so that the texts are read once and nodes are shuffled once.
    n = extract.nodes(segment.segments(works(spark, sf_dir).where("work_id is not null"), BENCH, False, "lang", "source"), BENCH, "lang", "source")
    tension = F.element_at(F.array(F.lit("0.4"), F.lit("1.7"), F.lit("high"), F.lit(None), F.lit("-2")), (F.col("pos") % 5 + 1).cast("int"))
    node = F.struct((F.col("pos") + 1).alias("sequence"), "function_code", F.to_json("actants").alias("actants"), F.struct(F.lit("0.3").alias("vouloir"), F.lit("x").alias("devoir")).alias("modalities"), tension.alias("tension"), "phase", "text_excerpt", F.when(F.col("pos") % 2 == 0, "because").alias("justification"))
    tradition = F.when(F.col("lang") == "fr", "Africaine de l'Ouest").when(F.col("lang") == "es", " Caribéenne").when(F.col("lang") == "de", "Européenne")
    per = n.groupBy("work_id", "source", tradition.alias("tradition")).agg(F.sort_array(F.collect_list(F.struct("pos", node.alias("n")))).alias("ns"))
    role = F.struct(F.lit("hero").alias("protagoniste"))
    body = F.to_json(F.struct(F.col("source").alias("genre"), "tradition", F.transform("ns", lambda x: x["n"]).alias("nodes"), F.when(F.col("work_id") % 3 == 0, role).alias("main_actants_v1"), F.when(F.col("work_id") % 3 == 1, role).alias("main_actants")))
    broken = F.when(F.col("work_id") % 11 == 0, F.substring(body, F.lit(1), F.length(body) - 3)).otherwise(body)
    text = F.when(F.col("work_id") % 4 == 0, F.concat(F.lit("```json\n"), broken, F.lit("\n```"))).when(F.col("work_id") % 4 == 1, F.concat(F.lit("Voici : "), broken, F.lit(" fin"))).otherwise(broken)
    return per.select("work_id", text.alias("response"))


def partial_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, chunk, ok, genre, tradition, summary, keywords, tokens, message): works as chunks of books, a book for each source, language and range of
    100 ids, so that no book grows with the corpus."""
    w = works(spark, sf_dir)
    n = F.length("text")
    return w.select(F.concat_ws("/", "source", "lang", F.floor(F.col("work_id") / 100).cast("string")).alias("book"), F.col("work_id").alias("chunk"), (n % 3 != 0).alias("ok"), F.concat(F.lit("g"), (n % 3).cast("string")).alias("genre"), F.when(n % 4 != 0, F.concat(F.lit("t"), (n % 2).cast("string"))).alias("tradition"), F.md5("text").alias("summary"), F.array(F.concat(F.lit("k"), (n % 7).cast("string")), F.concat(F.lit("k"), (n % 30).cast("string"))).alias("keywords"), F.floor(n / 4).alias("tokens"), F.concat(F.lit("length "), n.cast("string")).alias("message"))


def role_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """profiles with roles: the first node's actants lead, the last one's oppose."""
    who = lambda n: F.array_join(n["actants"], " ")
    roles = F.struct(*[(who(F.col("nodes")[0]) if r == "protagoniste" else who(F.element_at("nodes", -1)) if r == "opposant" else F.lit(None).cast("string")).alias(r) for r in compare.ROLES])
    return profiles(spark, sf_dir).select("work_id", roles.alias("roles"))


@query
def token_estimates(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", token_estimate(F.col("text")).alias("tokens"), ingest.needs_chunking(F.col("text")).alias("split"))


@query
def cost_forecast(spark, sf_dir):
    return ingest.cost_forecast(documents(spark, sf_dir), "doc_id", 9)


@query
def parse_responses(spark, sf_dir):
    p = ingest.parse_responses(responses(spark, sf_dir))
    return p.select("work_id", "status", F.col("parsed.genre").alias("genre"), F.size("parsed.nodes").alias("n_nodes"), F.col("main_actants_v2.protagoniste").alias("lead_v2"))


@query
def cultural_recode(spark, sf_dir):
    n = ingest.response_nodes(ingest.parse_responses(responses(spark, sf_dir)), "work_id")
    return n.select("work_id", "pos", "given_code", "function_code")


@query
def response_nodes(spark, sf_dir):
    n = ingest.response_nodes(ingest.parse_responses(responses(spark, sf_dir)), "work_id")
    return n.select("work_id", "node_id", F.size("actants").alias("n_actants"), "tension", "vouloir", "devoir", F.length("text_excerpt").alias("excerpt_chars"))


@query
def response_edges(spark, sf_dir):
    n = ingest.response_nodes(ingest.parse_responses(responses(spark, sf_dir)), "work_id").withColumn("actants", ingest.bare_names(F.col("actants")))
    return extract.sequential_edges(n).groupBy("work_id", "transition_type").agg(F.count("*").alias("n"))


@query
def response_edges_distant(spark, sf_dir):
    n = ingest.response_nodes(ingest.parse_responses(responses(spark, sf_dir)), "work_id").withColumn("actants", ingest.bare_names(F.col("actants")))
    return extract.distant_edges(n).select("work_id", "src_pos", "dst_pos")


@query
def recurring_lines_removed(spark, sf_dir):
    """Texts without running heads, where the source has pages: here the French and the German ones."""
    return clean.drop_recurring_lines(documents(spark, sf_dir), "doc_id", F.col("lang").isin("fr", "de")).select("doc_id", F.md5("text").alias("text_md5"))


@query
def scan_flags(spark, sf_dir):
    """Quality flags with a page count; a line is a page."""
    text = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.quality_flags(text, T.n_words(text), F.size(F.split(text, "\n"))), ",").alias("flags"))


@query
def merge_majority(spark, sf_dir):
    m = ingest.merge_chunks(partial_results(spark, sf_dir))
    return m.select("book", "n_chunks", "n_failed", "status", "genre", "tradition", "tokens", F.array_join("keywords", ",").alias("keywords"), F.md5("summary").alias("summary_md5"), F.array_join("messages", "|").alias("messages"))


@query
def merge_dedup(spark, sf_dir):
    seg = written(segment.chunk_rows(works(spark, sf_dir), "work_id").withColumn("code", extract.pattern_of(F.col("text"), BENCH).cast("string")), "segments")
    half = F.floor(F.col("pos") / 2)
    twice = F.when(F.col("pos") % 2 == 1, F.array(half, half + 1)).otherwise(F.array(half))
    rows = seg.select("work_id", "pos", "code", "text", F.explode(twice).alias("chunk"))
    return ingest.drop_overlap_nodes(rows, "work_id").select("work_id", "chunk", "pos")


@query
def chunk_overlap(spark, sf_dir):
    """Chunks of 375 tokens; lines are the paragraphs, as the documents have no blank ones."""
    c = chunking.chunks(documents(spark, sf_dir), "doc_id", 375, 75, r"\n")
    return c.select("doc_id", "chunk", "label", "char_start", "char_end", F.md5("text").alias("text_md5"), "has_overlap_before", "has_overlap_after")


@query
def paragraph_spans(spark, sf_dir):
    return chunking.paragraphs(documents(spark, sf_dir), "doc_id", 400, r"\n").select("doc_id", "first", "end", F.md5("text").alias("text_md5"))


@query
def graph_metadata(spark, sf_dir):
    p = ingest.parse_responses(responses(spark, sf_dir))
    mode = F.when(F.col("status") == "ok", "llm").otherwise("error")
    return p.select("work_id", mode.alias("mode"), ingest.is_african(F.col("parsed.tradition")).alias("african"), F.col("main_actants.protagoniste").alias("lead"))


@query
def analyses_with_graphs(spark, sf_dir):
    graphs = segment.chunk_rows(works(spark, sf_dir), "work_id").groupBy(F.col("work_id").alias("graph_id")).agg(F.count("*").alias("n_nodes"))
    return history.with_graphs(analyses(spark, sf_dir), graphs).select("id", "graph_id", "n_nodes")


@query
def replace_messages(spark, sf_dir):
    """The lists of all conversations with a system turn are replaced by their turns without it."""
    old = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    changed = old.where("role = 'system'").select("conv_id").distinct()
    out = history.replace_messages(old, old.where("role <> 'system'").join(changed, "conv_id", "left_semi"))
    return out.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"))


@query
def greimas_alignment(spark, sf_dir):
    p = compare.with_role_sets(role_profiles(spark, sf_dir)).select("work_id", "role_sets", "lead")
    return scored(p, ["s_greimas", "alignment", "focus_delta"], digits=6).withColumnRenamed("alignment", "label")


@query
def repertoire_usage(spark, sf_dir):
    t = repertoire.tagged(nodes(spark, sf_dir).where("function_code is not null"), repertoire.repertoire(spark))
    return t.groupBy("function_code", "function_name", "family_id", "african").agg(F.count("*").alias("n"))


@query
def repertoire_search(spark, sf_dir):
    """Every word of the documents as a term; a function's description is its keywords."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))))
    described = F.element_at(F.create_map(*[F.lit(x) for code, _, ws in BENCH.patterns for x in (code, " ".join(ws))]), F.col("code"))
    functions = repertoire.repertoire(spark).withColumn("description", described)
    return repertoire.search(functions, documents(spark, sf_dir).select(words.alias("term")).distinct()).select("term", "total", F.array_join("codes", ",").alias("codes"))


@query
def graph_documents(spark, sf_dir):
    n = written(nodes(spark, sf_dir), "nodes")
    back, edges = report.from_documents(written(report.to_documents(n, extract.edges(n)), "documents"))
    return back.groupBy("work_id").agg(F.count("*").alias("n_nodes"), F.round(F.max("tension"), 6).alias("peak")).join(edges.groupBy("work_id").agg(F.count("*").alias("n_edges"), F.round(F.sum("weight"), 6).alias("weight")), "work_id", "left")


@query
def store_summary(spark, sf_dir):
    n = nodes(spark, sf_dir).groupBy("work_id").agg(F.count("*").alias("n_nodes"))
    return works(spark, sf_dir).select("work_id", F.col("source").alias("author"), "lang").join(n, "work_id", "left")


@query
def report_rows(spark, sf_dir):
    # Bars are written out once for a work, not for a pair.
    bars = F.array_join(F.transform(report.bars(F.col("tensions")), lambda x: x.cast("string")), ",")
    rows = scores(spark, sf_dir, None, {"bars": bars}, with_matches="best")
    return report.report_rows(rows).select("ref_id", "cand_id", "srj_level", "colour", "ref_bars", "cand_bars")


@query
def markdown_export(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return report.markdown(extract.rollup(n, extract.edges(n))).select("work_id", F.md5("markdown").alias("markdown_md5"))


@query
def read_works(spark, sf_dir):
    """Text files and files of another format, written from the documents and read back: characters by language, format and status."""
    path, rows = shared_path(spark, "works"), documents(spark, sf_dir).select("text", "lang")
    rows.write.option("maxRecordsPerFile", 1000).partitionBy("lang").text(f"{path}/a")
    rows.write.option("maxRecordsPerFile", 1000).partitionBy("lang").json(f"{path}/b")
    back = files.read_works(spark, path).withColumn("lang", F.regexp_extract("path", "lang=([^/]+)", 1))
    return back.groupBy("lang", "format", "status").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))


@query
def decoded_texts(spark, sf_dir):
    """Texts through bytes in Latin-1 where they fit, else in UTF-8, and back without being told which."""
    text = F.coalesce("text", F.lit(""))
    content = F.when(text.rlike(r"^[\x00-\xFF]*$"), F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    return documents(spark, sf_dir).select("doc_id", F.md5(files.decoded(content)).alias("text_md5"))


@query
def html_text(spark, sf_dir):
    return files.html_text(table(spark, sf_dir, "pages"), "page_id").select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def _stream(spark, sf_dir):
    rows = live.stream_table(spark, sf_dir, "events")
    names = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return rows.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", F.element_at(names, F.col("event_type")).alias("action"), (F.col("value") / 100).alias("score"))


def _minute(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("start")


@query
def stream_usage_windows(spark, sf_dir):
    return live.run_available(live.usage_windows(_stream(spark, sf_dir), "24 hours", "6 hours"), shared_path(spark, "usage-windows")).select("user_id", _minute("start"), "n")


@query
def stream_rate_limits(spark, sf_dir):
    return live.run_available(live.rate_limits(_stream(spark, sf_dir), "user_id", 1), shared_path(spark, "rate-limits")).select("user_id", _minute("start"), "n")


@query
def stream_sessions(spark, sf_dir):
    return live.run_available(live.sessions(_stream(spark, sf_dir)), shared_path(spark, "sessions")).select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query
def stream_notifications(spark, sf_dir):
    level = F.when(F.col("score") < 0.25, "Faible").when(F.col("score") < 0.55, "Modéré").when(F.col("score") < 0.80, "Élevé").otherwise("Critique")
    rows = _stream(spark, sf_dir).where("action = 'comparison'").select("id", "ts", F.lit("comparison").alias("kind"), level.alias("level"), "score", F.lit(None).cast("int").alias("n_nodes"))
    return live.run_available(live.live_notifications(rows).select("id", "notice", "value"), shared_path(spark, "notices"))


@query
def stream_analysis(spark, sf_dir):
    def analyse(batch: DataFrame) -> DataFrame:
        ready = batch.where(F.length(F.trim("text")) >= 200).withColumnRenamed("doc_id", "work_id")
        return extract.nodes(segment.segments(ready, BENCH, False), BENCH).select("work_id", "pos", "function_code", "phase")

    return live.per_batch(live.stream_table(spark, sf_dir, "documents"), shared_path(spark, "analysis"), analyse)


@query
def stream_quota(spark, sf_dir):
    return live.run_available(live.live_quota(_stream(spark, sf_dir)), shared_path(spark, "quota"))


@query
def stream_usage_log(spark, sf_dir):
    """The usage log written by batches of a stream, each once."""
    log = live.per_batch(_stream(spark, sf_dir), shared_path(spark, "usage-log"), lambda batch: history.usage_records(batch.withColumns({"cost_usd": F.col("score"), "tokens": F.lit(None)})))
    return log.groupBy("user_id", "action").agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 4).alias("cost"), F.sum("tokens").alias("tokens"))


@query
def node_table(spark, sf_dir):
    return extract.node_table(segment.segments(works(spark, sf_dir), BENCH, False), BENCH)


@query
def majority_actants(spark, sf_dir):
    """Works are chunks of a book for each language, source and first letter; their roles are derived from their lengths."""
    n = F.length("text")
    role = F.struct(F.concat(F.lit("p"), (n % 5).cast("string")).alias("protagoniste"), F.when(n % 3 != 0, F.concat(F.lit(" o"), (n % 2).cast("string"))).otherwise(F.lit(" ")).alias("objet"), F.when(n % 2 == 0, F.concat(F.lit("r"), (n % 7).cast("string"))).alias("opposant"))
    rows = works(spark, sf_dir).select(F.concat_ws("/", "lang", "source", F.substring("text", 1, 1)).alias("book"), F.col("work_id").alias("chunk"), role.alias("main_actants"))
    return ingest.merge_roles(rows, "book", "chunk")


def _appended(spark: SparkSession, records: DataFrame, name: str) -> DataFrame:
    """The records after two appends to a new table, read back."""
    path, half = shared_path(spark, name), F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    for part in (records.where(half), records.where(~half)):
        history.append(part, path)
    return spark.read.schema(records.schema).parquet(path)


@query
def append_analyses(spark, sf_dir):
    rows = analyses(spark, sf_dir).withColumn("n_nodes", F.when(F.col("tokens") % 3 != 0, F.col("tokens")))
    return _appended(spark, history.analysis_records(rows), "analyses").select("id", "graph_id", "date_human", "mode", "title", "n_nodes", F.round("cost_usd", 4).alias("cost_usd"), "tokens_total")


@query
def append_usage(spark, sf_dir):
    log = _appended(spark, history.usage_records(usage(spark, sf_dir)), "usage")
    return log.groupBy("user_id", "action").agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 4).alias("cost"), F.sum("tokens").alias("tokens"))
