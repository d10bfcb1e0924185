"""Externally produced analyses to tables: parse, repair, normalise, merge and price them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scans import scan
from ..functions.text import token_estimate
from ..lexicon import RECODED, RECODED_DEFAULT, ROLES

# When a text is split, and rates.
SPLIT_TOKENS = 140_000
USD_IN, USD_OUT, EUR = 3.0, 15.0, 0.93

_ROLES = "struct<" + ",".join(f"{r}:string" for r in ROLES) + ">"
NODE = "struct<sequence:int,function_code:string,function_name:string,function_family:string,actants:string,modalities:struct<vouloir:string,devoir:string,pouvoir:string,savoir:string>,tension:string,phase:string,text_excerpt:string,justification:string>"
RESPONSE = f"struct<summary:string,genre:string,tradition:string,nodes:array<{NODE}>,main_actants:{_ROLES},main_actants_v1:{_ROLES},main_actants_v2:{_ROLES},thematic_keywords:array<string>>"


def json_body(response: Column) -> Column:
    """From the first { to the last } of a response, code fences and talk around it dropped; null without one."""
    body = F.regexp_extract(response, r"(?s)(\{.*\})", 1)
    return F.when(body != "", body)


def parse_responses(rows: DataFrame) -> DataFrame:
    """rows with status ("ok", "error") and parsed, the response as a struct; missing roles are filled in from the other version."""
    body = json_body(F.col("response"))
    # A body begins with {, so what parses is an object.
    out = rows.withColumn("status", F.when(F.try_parse_json(body).isNotNull(), "ok").otherwise("error")).withColumn("parsed", F.when(F.col("status") == "ok", F.from_json(body, RESPONSE)))
    main, one, two = (F.col(f"parsed.{n}") for n in ("main_actants", "main_actants_v1", "main_actants_v2"))
    return out.withColumn("main_actants", F.coalesce(main, one)).withColumn("main_actants_v1", F.coalesce(one, main)).withColumn("main_actants_v2", F.coalesce(two, F.when(one.isNull(), main)))


def is_african(tradition: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(tradition, F.lit(""))))
    hit = t.startswith("africain") | t.startswith("afro")
    for part in ("afrique", "caribéen", "afrodescendant"):
        hit = hit | t.contains(part)
    return hit


def recoded(code: Column, tradition: Column) -> Column:
    """The code, or the western one for an African code on a work of another tradition."""
    western = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RECODED.items() for x in kv]), code), F.lit(RECODED_DEFAULT))
    return F.when(~is_african(tradition) & code.startswith("FN"), western).otherwise(code)


def unit_number(text: Column, default: float) -> Column:
    """A number read from text, kept within 0 and 1; the default if it isn't one."""
    x = text.try_cast("double")
    return F.when(x.isNull(), F.lit(default)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def response_nodes(parsed: DataFrame, key: str) -> DataFrame:
    """One row for each node of the parsed responses, recoded and normalised."""
    rows = parsed.where("status = 'ok'").select(key, F.col("parsed.tradition").alias("tradition"), F.posexplode("parsed.nodes").alias("pos", "n"))
    actants = F.coalesce(F.slice(F.from_json("n.actants", "array<string>"), 1, 8), F.array().cast("array<string>"))
    excerpt = F.concat(F.coalesce("n.text_excerpt", F.lit("")), F.when(F.coalesce("n.justification", F.lit("")) != "", F.concat(F.lit("\n— "), F.col("n.justification"))).otherwise(""))
    return rows.select(
        key, "pos", F.format_string("n%03d", F.coalesce("n.sequence", F.col("pos") + 1)).alias("node_id"), F.col("n.function_code").alias("given_code"), recoded(F.col("n.function_code"), F.col("tradition")).alias("function_code"),
        actants.alias("actants"), unit_number(F.col("n.tension"), 0.5).alias("tension"), *[unit_number(F.col(f"n.modalities.{m}"), 0.0).alias(m) for m in ("vouloir", "devoir", "pouvoir", "savoir")],
        F.col("n.phase").alias("phase"), F.substring(excerpt, 1, 400).alias("text_excerpt"),
    )


def bare_names(actants: Column) -> Column:
    """Names without "(role)", lower case."""
    return F.transform(actants, lambda a: F.lower(F.trim(F.split_part(a, F.lit("("), F.lit(1)))))


def majority(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value): the most frequent non-null value of each key, ties to the first seen. Counts are combined before the shuffle."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def merge_roles(rows: DataFrame, key: str, order: str, roles: str = "main_actants") -> DataFrame:
    """(key, role, actant): for each role of a struct the most frequent actant over a text's chunks, ties to the first seen; blank ones don't count. Counts are combined before the shuffle."""
    names = [f.name for f in rows.schema[roles].dataType.fields]
    each = rows.select(key, order, F.explode(F.array(*[F.struct(F.lit(n).alias("role"), F.trim(F.col(f"{roles}.{n}")).alias("actant")) for n in names])).alias("r")).select(key, order, "r.*")
    counts = each.where("actant <> ''").groupBy(key, "role", "actant").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(key, "role").agg(F.max_by("actant", F.struct("n", -F.col("first"))).alias("actant"))


def merge_chunks(rows: DataFrame, key: str = "book", order: str = "chunk") -> DataFrame:
    """Chunk results (key, order, ok, genre, tradition, summary, keywords, tokens, message) to one row per text.

    The summary names every good chunk as "Partie i/n"; keywords are the first 20 in order; messages the first three of failed chunks if none
    is good. A row holds the summaries of its text's chunks; keywords are combined before the shuffle.
    """
    good = rows.where("ok")
    failed = F.when(~F.col("ok"), F.struct(F.col(order), F.col("message")))
    base = rows.groupBy(key).agg(F.count("*").alias("n_chunks"), F.count_if(~F.col("ok")).alias("n_failed"), F.sum(F.when(F.col("ok"), F.col("tokens")).otherwise(0)).alias("tokens"), F.sort_array(F.collect_list(failed)).alias("failed"))
    texts = good.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "summary"))).alias("s"))
    n = F.size("s").cast("string")
    label = F.array_join(F.transform("s", lambda x, i: F.concat(F.lit("Partie "), (i + 1).cast("string"), F.lit("/"), n, F.lit(" : "), F.coalesce(x["summary"], F.lit("")))), "\n")
    words = good.select(key, order, F.posexplode("keywords").alias("at", "word")).groupBy(key, "word").agg(F.min(F.struct(order, "at")).alias("seen"))
    first = words.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("seen"))).where("rank <= 20")
    keywords = first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords"))
    out = base.join(texts.select(key, label.alias("summary")), key, "left").join(keywords, key, "left").join(majority(good, key, order, "genre"), key, "left").join(majority(good, key, order, "tradition"), key, "left")
    lost = F.col("n_failed") == F.col("n_chunks")
    messages = F.when(lost, F.transform(F.slice("failed", 1, 3), lambda x: x["message"])).otherwise(F.array().cast("array<string>"))
    return out.withColumn("status", F.when(lost, "error").when(F.col("n_failed") > 0, "partial").otherwise("ok")).withColumn("messages", messages).drop("failed")


def recode_notes(nodes: DataFrame, key: str) -> DataFrame:
    """(key, n_corrected, note) of response_nodes(): how many codes were recoded for the work's tradition; the note is null without any."""
    n = F.count_if(F.coalesce(F.col("given_code") != F.col("function_code"), F.lit(False)))
    note = F.when(F.col("n_corrected") > 0, F.concat(F.lit("recoded functions: "), F.col("n_corrected").cast("string")))
    return nodes.groupBy(key).agg(n.alias("n_corrected")).withColumn("note", note)


def renumbered(kept: DataFrame, key: str) -> DataFrame:
    """Nodes that a merge kept, with their new sequence in the work, from 1."""
    return kept.withColumn("sequence", F.row_number().over(Window.partitionBy(key).orderBy("chunk", "pos")))


def merge_counts(before: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """(key, n_before, n_after): nodes of a work before and after its overlaps were dropped."""
    one = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    return one(before, "n_before").join(one(kept, "n_after"), key, "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)))


def _kept(bound: float) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """Of nodes (chunk, pos, code, words) in order, the (chunk, pos, code) of those that repeat no kept node of the chunk before; it remembers one chunk."""

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        last, kept = None, []
        for chunk, group in groupby(rows, lambda t: t[0]):
            nodes, held, shared, gone = list(group), {}, Counter(), set()
            for before in kept if last is not None and chunk == last + 1 else ():
                for word in before[3]:
                    held.setdefault(word, []).append(before)
            for _, pos, code, words in nodes if held else ():
                for word in words:
                    for _, prev, prev_code, prev_words in held.get(word, ()):
                        if not code or not prev_code or code == prev_code:
                            shared[pos, prev, min(len(words), len(prev_words))] += 1
            gone = {pos for (pos, _, least), n in shared.items() if pos is not None and n / least > bound}
            last, kept = chunk, [t for t in nodes if t[1] not in gone]
            yield from (t[:3] for t in kept)

    return walk


def drop_overlap_nodes(rows: DataFrame, key: str, bound: float = 0.5) -> DataFrame:
    """(key, chunk, pos, code) of rows(key, chunk, pos, code, text) without nodes that repeat a kept node of the chunk before: codes don't differ and over half of the smaller word set is shared.

    Only kept nodes drop others, so chunks depend on each other in a chain: an ordered scan, one shuffle of a node's distinct words. Nodes meet by a word of theirs, so a chunk's nodes are
    never paired with all of the next one's. Rows without a key or chunk repeat nothing.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w{4,}"), F.lit(0)))
    apart = F.when(F.col(key).isNull() | F.col("chunk").isNull(), F.monotonically_increasing_id())
    nodes = rows.select(key, apart.alias("apart"), F.col("chunk").cast("int").alias("chunk"), F.col("pos").cast("int").alias("pos"), "code", F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    return scan(nodes, [key, "apart"], ["chunk", "pos"], _kept(bound), f"chunk int, pos int, code {rows.schema['code'].dataType.simpleString()}").drop("apart")


def cost_forecast(docs: DataFrame, key: str, digits: int = 4) -> DataFrame:
    """(key, tokens_in, tokens_out, cost_usd, cost_eur) of analysing a text."""
    n = F.length("text")
    t_in = F.floor(n / 4) + 2000
    t_out = F.least(F.lit(16000), F.greatest(F.lit(2000), F.floor(n / 20)))
    usd = (t_in * USD_IN + t_out * USD_OUT) / 1_000_000
    return docs.select(key, t_in.alias("tokens_in"), t_out.alias("tokens_out"), F.round(usd, digits).alias("cost_usd"), F.round(usd * EUR, digits).alias("cost_eur"))


def split_forecast(chunks: DataFrame, key: str, digits: int = 4) -> DataFrame:
    """(key, n_chunks, tokens_in, tokens_out, cost_usd, cost_eur): the forecast of chunks(key, text) of split texts, summed over a text's chunks."""
    per = cost_forecast(chunks, key, 12).groupBy(key).agg(F.count("*").alias("n_chunks"), *[F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "cost_usd", "cost_eur")])
    return per.withColumns({c: F.round(c, digits) for c in ("cost_usd", "cost_eur")})


def needs_chunking(text: Column) -> Column:
    return token_estimate(text) > SPLIT_TOKENS
