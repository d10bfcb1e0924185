"""Queries on reports, exports, forms, roles, merges, the graph store and service tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql as narrative_sql
from .functions import text as T
from .lexicon import BENCH, REGISTER_DISTANCE
from .operators import compare, extract, ingest, repertoire, report, segment
from .operators import history as H
from .queries import IDS, Query, documents, nodes, profiles, scored, scores, shared_path, table, works, written
from .queries_logs import analyses, comparisons, now, usage, users
from .queries_more import responses
from .sources import files

QUERIES: dict[str, Query] = {}
REGISTERS = sorted({r for a, b, _ in REGISTER_DISTANCE for r in (a, b)})
NAMES = ("griot", "lion", "hyène", "reine", "chasseur", "les deux rois")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, form, codes): the form of a work, derived from its language and length."""
    n = F.length("text")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    form = F.struct(
        F.col("lang").alias("form"), F.when(n % 6 != 0, pick(REGISTERS, n % len(REGISTERS))).alias("register"), F.when(n % 7 != 0, pick(("tres_court", "court", "moyen", "long", "tres_long"), n % 5)).alias("narrative_length_category"),
        F.when(n % 3 != 0, n % 2 == 0).alias("has_explicit_morality"), F.when(n % 4 != 0, n % 8 < 4).alias("has_narrator_intervention"),
    )
    return works(spark, sf_dir).select("work_id", form.alias("form"), F.when(n % 5 == 0, F.array(F.lit("F49"))).otherwise(F.array(F.lit("F01"))).alias("codes"))


def role_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, v1, v2): two versions of a work's roles, a missing one taken from the main roles; some works have none."""
    n = F.length("text")
    pick = lambda at: F.get(F.array(*map(F.lit, NAMES)), at.cast("int"))
    roles = lambda lead, foe: F.struct(*[(lead if r == "protagoniste" else foe if r == "opposant" else F.lit(None).cast("string")).alias(r) for r in compare.ROLES])
    main = F.when(n % 11 != 0, roles(pick(n % 6), F.lit("lion")))
    v1, v2 = F.when(n % 3 == 0, roles(F.concat(pick(n % 5), F.lit(" "), pick(n % 4)), F.lit(""))), F.when(n % 3 == 1, roles(pick(n % 2), pick(n % 5)))
    return works(spark, sf_dir).select("work_id", F.coalesce(v1, main).alias("v1"), F.coalesce(v2, main).alias("v2"))


#: What report.report_rows() shows of a pair, with the share of each score.
REPORTED = [x for n, _ in compare.WEIGHTS for x in (n, f"{n}_share")] + ["sns", "ss", "st", "srj", "modality", "srj_level", "verdict"]


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir, REPORTED, {"bars": report.bars(F.col("tensions"))}, with_matches="best", digits=(9, 3))
    mode = lambda c: F.when(F.col(c) % 3 == 0, "llm").otherwise("heuristic")
    return report.report_rows(rows.withColumn("ref_mode", mode("ref_id")).withColumn("cand_mode", mode("cand_id")))


@query
def form_deltas(spark, sf_dir):
    rows = forms(spark, sf_dir).withColumn("form", compare.form_keys(F.col("form")))
    return scored(rows, ["form_delta", "register_delta", "moral_delta"], digits=6)


@query
def role_alignment(spark, sf_dir):
    rows = role_versions(spark, sf_dir).select("work_id", *[compare.role_sets(F.col(v)).alias(name) for v, name in (("v1", "role_sets"), ("v2", "role_sets_v2"))])
    return scored(rows, ["s_greimas", "alignment"], digits=6).withColumnRenamed("alignment", "label")


LENGTHS = (("tres_court", 50), ("court", 150), ("moyen", 400), ("long", 1500))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with form and two versions of the roles, all read from the texts: layout, words, questions, the highest tension, codes, and who acts first, last, in the middle and at the peak."""
    names = lambda n: F.array_join(n["actants"], " ")
    peak = F.array_max(F.transform("nodes", lambda n: F.struct(F.round(n["tension"], 9).alias("t"), (-n["pos"]).alias("back"))))
    at = lambda k: F.get("nodes", k.cast("int"))
    role = lambda **who: F.struct(*[who.get(r, F.lit(None).cast("string")).alias(r) for r in compare.ROLES])
    p = profiles(spark, sf_dir).withColumn("peak", peak)
    words = T.n_words(F.col("text"))
    length = reduce(lambda out, x: F.when(words < x[1], x[0]).otherwise(out), reversed(LENGTHS), F.lit("tres_long"))
    register = F.get(F.array(*map(F.lit, REGISTERS)), F.least(F.lit(len(REGISTERS) - 1), F.floor(F.col("peak.t") * len(REGISTERS))).cast("int"))
    form = F.struct(
        F.when(F.size(F.split("text", "\n")) > 3, "vers").otherwise("prose").alias("form"), F.when(F.col("n_nodes") > 1, register).alias("register"), length.alias("narrative_length_category"),
        F.when(F.col("lang") == "fr", F.coalesce(F.element_at("nodes", -1)["code"] == "F49", F.lit(False))).alias("has_explicit_morality"), F.when(F.col("lang") != "de", F.col("text").contains("?")).alias("has_narrator_intervention"),
    )
    v1 = role(protagoniste=names(at(F.lit(0))), opposant=names(F.element_at("nodes", -1)))
    v2 = F.when(F.col("n_nodes") >= 3, role(protagoniste=names(at(-F.col("peak.back"))), objet=names(at(F.floor(F.col("n_nodes") / 2)))))
    rows = p.join(works(spark, sf_dir).select("work_id", "text", "lang"), "work_id")
    return rows.select(*[c for c in p.columns if c != "peak"], form.alias("form"), v1.alias("roles"), v2.alias("roles_v2"))


@query
def full_comparison(spark, sf_dir):
    """Every score of a pair with forms and both versions of the roles."""
    rows = compare.prepared(compare.with_role_sets(described(spark, sf_dir))).withColumn("form", compare.form_keys(F.col("form")))
    numbers = [n for n, _ in compare.WEIGHTS] + ["s_greimas", "sns", "ss", "st", "srj"] + [f"{d}_delta" for d in ("structure", "form", "register", "focus", "moral")]
    return scored(rows, [*numbers, "alignment", "modality", "srj_level", "verdict_text"], digits=6).withColumnRenamed("verdict_text", "verdict")


@query
def report_dataset(spark, sf_dir):
    shares = F.array_join(F.transform("components", lambda c: F.concat(c["component"], F.lit(":"), c["weight"].cast("string"))), ",")
    best = F.array_join(F.transform("correspondences", lambda m: F.concat_ws(":", m["ref_pos"], m["cand_pos"], m["ref_code"], m["cand_code"])), ",")
    total = F.aggregate("components", F.lit(0.0), lambda t, c: t + c["score"])
    return reports(spark, sf_dir).select(*IDS, "srj_level", shares.alias("components"), F.round(total, 6).alias("score_sum"), best.alias("correspondences"), F.concat_ws("/", "models.ref_mode", "models.cand_mode").alias("models"))


@query
def comparison_markdown(spark, sf_dir):
    md = report.comparison_markdown(reports(spark, sf_dir)).withColumn("lines", F.split("markdown", "\n"))
    return md.select(*IDS, F.get("lines", F.lit(0)).alias("title"), F.get("lines", F.lit(2)).alias("level"), F.get("lines", F.lit(3)).alias("modality"), F.array_join(F.filter("lines", lambda x: x.startswith("- ") & x.contains("→")), ",").alias("pairs"))


@query
def analysis_documents(spark, sf_dir):
    """Whole documents of analyses: a work's first 200 characters are its summary."""
    w = works(spark, sf_dir)
    d = described(spark, sf_dir).select("work_id", "roles")
    llm = F.col("work_id") % 3 == 0
    rows = w.select("work_id", F.concat_ws(" ", "source", F.col("work_id").cast("string")).alias("title"), F.col("source").alias("author"), F.when(llm, "llm").otherwise("heuristic").alias("mode"), F.substring("text", 1, 200).alias("summary"), F.when(llm, F.col("lang")).alias("genre"), F.lit(None).cast("string").alias("tradition"), F.when(llm, F.length("text") / 1000).alias("cost_usd"), F.floor(F.length("text") / 4).alias("tokens"))
    names = repertoire.repertoire(spark).select(F.col("code").alias("function_code"), F.col("name").alias("function_name"))
    out = report.analysis_documents(rows.join(d, "work_id"), report.node_entries(nodes(spark, sf_dir), F.broadcast(names)))  # 53 functions
    return out.select("work_id", F.length("markdown").alias("n_chars"), F.md5("markdown").alias("markdown_md5"))


@query
def comparison_texts(spark, sf_dir):
    """Whole documents of comparisons."""
    rows = scores(spark, sf_dir, [n for n, _ in compare.WEIGHTS] + ["sns", "ss", "st", "srj", "modality", "srj_level", "verdict_text"], with_matches="best")
    rows = rows.withColumns({f"{s}_title": F.concat(F.lit("œuvre "), F.col(f"{s}_id").cast("string")) for s in ("ref", "cand")})
    return report.comparison_texts(rows).select(*IDS, F.length("markdown").alias("n_chars"), F.md5("markdown").alias("markdown_md5"))


@query
def comparison_json(spark, sf_dir):
    docs = report.comparison_documents(reports(spark, sf_dir))
    read = F.from_json("document", "ref_id bigint, cand_id bigint, sns double, srj_level string, correspondences array<struct<cand_pos:int>>")
    return docs.select(read.alias("d")).select("d.ref_id", "d.cand_id", "d.sns", "d.srj_level", F.size("d.correspondences").alias("n"))


@query
def analysis_text(spark, sf_dir):
    return report.analysis_text(nodes(spark, sf_dir)).select("work_id", F.md5("text").alias("text_md5"))


@query
def recode_notes(spark, sf_dir):
    return ingest.recode_notes(ingest.response_nodes(ingest.parse_responses(responses(spark, sf_dir)), "work_id"), "work_id")


def _overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, pos, code, text, chunk): segments in chunks of two; every odd one is in the next chunk, too."""
    seg = written(segment.chunk_rows(works(spark, sf_dir), "work_id").withColumn("code", extract.pattern_of(F.col("text"), BENCH).cast("string")), "segments")
    half = F.floor(F.col("pos") / 2)
    twice = F.when(F.col("pos") % 2 == 1, F.array(half, half + 1)).otherwise(F.array(half))
    return seg.select("work_id", "pos", "code", "text", F.explode(twice).alias("chunk"))


@query
def merge_counts(spark, sf_dir):
    rows = _overlapping(spark, sf_dir)
    return ingest.merge_counts(rows, ingest.drop_overlap_nodes(rows, "work_id"), "work_id")


@query
def merge_renumbered(spark, sf_dir):
    kept = ingest.drop_overlap_nodes(_overlapping(spark, sf_dir), "work_id")
    return ingest.renumbered(kept, "work_id").select("work_id", "sequence", "chunk", "pos")


@query
def split_forecast(spark, sf_dir):
    return ingest.split_forecast(segment.chunk_rows(works(spark, sf_dir), "work_id"), "work_id", 6)


@query
def repertoire_totals(spark, sf_dir):
    return repertoire.totals(repertoire.tagged(nodes(spark, sf_dir), repertoire.repertoire(spark)))


@query
def store_totals(spark, sf_dir):
    per = nodes(spark, sf_dir).groupBy("work_id").agg(F.count("*").alias("n"), F.count("function_code").alias("coded"))
    return per.agg(F.count("*").alias("works"), F.sum("n").alias("nodes"), F.sum("coded").alias("coded"), F.max("n").alias("largest"))


@query
def graph_store(spark, sf_dir):
    """Graphs saved, those of short works deleted, the rest listed."""
    n = written(nodes(spark, sf_dir), "nodes")
    store = shared_path(spark, "graphs")
    files.save_graphs(n, extract.edges(n), store)
    files.delete_graphs(spark, store, files.list_graphs(spark, store).where("n_nodes < 3"), shared_path(spark, "deletes"))
    return files.list_graphs(spark, store)


@query
def list_documents(spark, sf_dir):
    title = F.when(F.col("n_chars") % 5 != 0, F.concat("source", F.lit(" "), "lang"))
    return files.list_documents(documents(spark, sf_dir).withColumn("title", title), "doc_id", "title")


@query
def fetch_document(spark, sf_dir):
    return files.fetch(documents(spark, sf_dir), "doc_id", 100).select("doc_id", F.md5("text").alias("text_md5"))


@query
def user_overview(spark, sf_dir):
    u = users(spark, sf_dir).withColumn("admin", F.col("user_id") % 50 == 0).withColumn("verified", F.col("user_id") % 4 != 0)
    return H.overview(u.withColumn("created", now() - F.make_interval(days=(F.col("user_id") % 60).cast("int"))), usage(spark, sf_dir), now())


@query
def user_detail_totals(spark, sf_dir):
    return H.user_detail(usage(spark, sf_dir)).select("user_id", "action", "rank", "id", "requests", F.round("cost", 4).alias("cost"), F.col("all_tokens").alias("tokens"))


@query
def quota_costs(spark, sf_dir):
    status = H.quota_status(users(spark, sf_dir), usage(spark, sf_dir), now()).join(H.usage_cost(usage(spark, sf_dir), now(), 30), "user_id", "left")
    return status.select("user_id", "left_daily", "left_monthly", F.round(F.coalesce("cost", F.lit(0.0)), 4).alias("cost"))


@query
def mark_read(spark, sf_dir):
    """Unread notices after one user read all and another one a single notice."""
    notes = usage(spark, sf_dir).select("user_id", "id", (F.col("tokens") % 2 == 0).alias("read"))
    after = H.mark_read(H.mark_read(notes, F.lit(7)), F.lit(8), F.lit(1234))
    return after.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(~F.col("read")).alias("unread"))


@query
def newest_conversations(spark, sf_dir):
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_message_at"), F.count("*").alias("n"))
    return H.newest_conversations(per)


@query
def clear_counts(spark, sf_dir):
    return H.clear_counts({"analyses": analyses(spark, sf_dir), "comparisons": comparisons(spark, sf_dir), "usage": usage(spark, sf_dir)})


@query
def append_comparisons(spark, sf_dir):
    """Comparison records with both works' titles after two appends to a new table."""
    rows = H.with_titles(comparisons(spark, sf_dir), analyses(spark, sf_dir)).select("id", "ts", "ref_title", "cand_title", "score")
    path = shared_path(spark, "comparisons")
    for part in (rows.where("id % 2 = 0"), rows.where("id % 2 <> 0")):
        H.append(part, path)
    return spark.read.schema(rows.schema).parquet(path).select("id", "ref_title", "cand_title", F.round("score", 6).alias("score"))


@query
def sql_clean(spark, sf_dir):
    """Cleaned texts, sizes and overlaps with the source's name, in SQL alone."""
    narrative_sql.register(spark)
    documents(spark, sf_dir).createOrReplaceTempView("narrative_documents")
    return spark.sql("""SELECT doc_id, md5(c) AS text_md5, narrative_words(c) AS n_words, narrative_tokens(c) AS tokens, round(narrative_jaccard(split(c, ' '), array('de', 'the', 'und')), 6) AS overlap, narrative_quota(lang, 2) AS quota
        FROM (SELECT doc_id, lang, narrative_clean(text) AS c FROM narrative_documents)""")


@query
def sql_top(spark, sf_dir):
    """The most similar works of each query work and their level, in SQL over component scores."""
    # Five works of each query work are asked for, so no pair that is not among the five best of its part of a block is written.
    narrative_sql.publish(written(scores(spark, sf_dir, [n for n, _ in compare.WEIGHTS], top=5), "parts"))
    return spark.sql("SELECT ref_id, place, cand_id, round(sns, 6) AS sns, narrative_level(0.8 * sns) AS level FROM narrative_top(5)")
