"""Long texts to overlapping chunks.

Paragraphs are rows; their offsets are running sums over a document's paragraphs. Chunks come from one ordered scan over paragraph sizes (two
numbers a row) that keeps a window of them, and texts meet their chunks by a join. So no array of a text is folded in a row, and time
and memory are linear in the text. A paragraph that is too long is cut into sentences, which are rows again, grouped by the same scan; what has no
sentences to cut at is cut into blocks, text by text.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scans import scan
from ..functions.text import strip, token_estimate

# Characters of a token, tokens of a chunk and of an overlap; a blank line; where sentences end; how much longer than a chunk a group of sentences may be; how far back a block looks for its end.
TOKEN_CHARS, CHUNK_TOKENS, OVERLAP_TOKENS = 4, 90_000, 6_000
BLANK = r"(?U)\n\s*\n"
SENTENCE = r"(?U)(?<=[.!?])\s+(?=[A-ZÉÈÀÂÎÔÛÜŒÆ])"
SENTENCES, LONGER, BACK = 3, 1.2, 200


def windows(limit: int, overlap: int | None) -> Callable[[Iterator[tuple]], Iterator[tuple]]:
    """A walk over (place, size) that yields (chunk, place) for each member of each chunk.

    A chunk takes what fits into `limit`. The next one begins with the last members of the one before, as many as `overlap` holds and one at
    least (overlap None: none); if those leave no room for what comes next they are a chunk of their own. A member above the limit is one alone.
    """

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: deque[tuple] = deque()
        n = total = 0

        def closed() -> list[tuple]:
            nonlocal n
            n += 1
            return [(n - 1, place) for place, _ in held]

        for place, size in rows:
            if held and total + size > limit:
                yield from closed()
                while held and (overlap is None or size > limit or (total > overlap and len(held) > 1)):
                    total -= held.popleft()[1]
                if held and total + size > limit:
                    yield from closed()
                    held.clear()
                    total = 0
            held.append((place, size))
            total += size
            if size > limit and overlap is not None:
                yield from closed()
                held.clear()
                total = 0
        if held:
            yield from closed()

    return walk


def placed(docs: DataFrame, keys: list[str], text: Column, cut: str, base: Column) -> DataFrame:
    """(keys, first, end, text) of the parts of a text, which `cut` parts: offsets from `base`, the text without white space around it; blank parts are left out."""
    parts = F.arrays_zip(F.split(text, cut).alias("p"), F.transform(F.regexp_extract_all(text, F.lit(cut), F.lit(0)), F.length).alias("gap"))
    rows = docs.select(*keys, base.alias("base"), F.posexplode(parts).alias("pos", "x"))
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("base") + F.coalesce(F.sum(F.length("x.p") + F.coalesce("x.gap", F.lit(0))).over(before), F.lit(0))
    lead = F.length("x.p") - F.length(F.regexp_replace("x.p", r"(?U)^\s+", ""))
    rows = rows.select(*keys, (at + lead).alias("first"), (at + F.length("x.p")).alias("end"), strip(F.col("x.p")).alias("text"))
    return rows.where("text <> ''")


def blocks(text: str, limit: int) -> list[tuple[int, int]]:
    """Spans of `limit` characters that end, if possible, just after a blank or a mark among their last ones."""
    out, at = [], 0
    while at < len(text):
        end = min(at + limit, len(text))
        if end < len(text):
            end = next((k + 1 for k in range(end, max(end - BACK, at + 1), -1) if text[k] in " .!?"), end)
        out.append((at, end))
        at = end
    return out


def _block_rows(key: str, limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, first + s, first + e, t[s:e].strip()) for k, first, t in zip(b[key], b["first"], b["text"], strict=True) for s, e in blocks(t, limit)]
            yield pd.DataFrame(rows, columns=[key, "first", "end", "text"])

    return run


def refined(long: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, first, end, text) of paragraphs(key, first, text) above the limit: groups of sentences, or blocks."""
    names = [key, "para"]
    long = long.withColumnRenamed("first", "para")
    cut = placed(long, names, F.col("text"), SENTENCE, F.col("para"))
    groups = scan(cut.select(*names, "first", (F.col("end") - F.col("first")).alias("size")), names, ["first"], windows(limit, None), "group int, first bigint")
    whole = cut.join(groups, [*names, "first"]).groupBy(*names, "group").agg(F.min("first").alias("first"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("first", "text"))).alias("parts"), F.count("*").alias("n"))
    fit = whole.groupBy(*names).agg(F.sum("n").alias("n"), F.max(F.col("end") - F.col("first")).alias("longest")).where((F.col("n") >= SENTENCES) & (F.col("longest") <= limit * LONGER))
    grouped = whole.join(fit.select(*names), names, "left_semi").select(key, "first", "end", F.array_join(F.transform("parts", lambda x: x["text"]), " ").alias("text"))
    rest = long.join(fit.select(*names), names, "left_anti").select(key, F.col("para").alias("first"), "text")
    return grouped.union(rest.mapInPandas(_block_rows(key, limit), grouped.schema))


def paragraphs(docs: DataFrame, key: str, limit: int = CHUNK_TOKENS * TOKEN_CHARS, blank: str = BLANK) -> DataFrame:
    """(key, first, end, text): paragraphs of docs(key, text) with character offsets; those over `limit` characters are refined. Keys are unique."""
    rows = placed(docs, [key], F.col("text"), blank, F.lit(0).cast("long"))
    fits = F.col("end") - F.col("first") <= limit
    return rows.where(fits).union(refined(rows.where(~fits).select(key, "first", "text"), key, limit))


def chunks(docs: DataFrame, key: str, tokens: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, blank: str = BLANK) -> DataFrame:
    """(key, chunk, n_chunks, label, char_start, char_end, text, has_overlap_before, has_overlap_after) of docs(key, text).

    A text of at most `tokens` estimated tokens is one chunk; a blank or null one is none.
    """
    docs = docs.select(key, "text").where(strip(F.col("text")) != "")
    short = token_estimate(F.col("text")) <= tokens
    whole = docs.where(short).select(key, F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("char_start"), F.length("text").cast("long").alias("char_end"), "text")
    rows = paragraphs(docs.where(~short), key, tokens * TOKEN_CHARS, blank)
    members = scan(rows.select(key, "first", (F.col("end") - F.col("first")).alias("size")), [key], ["first"], windows(tokens * TOKEN_CHARS, overlap * TOKEN_CHARS), "chunk int, first bigint")
    joined = members.join(rows, [key, "first"]).groupBy(key, "chunk").agg(F.min("first").alias("char_start"), F.max("end").alias("char_end"), F.sort_array(F.collect_list(F.struct("first", "text"))).alias("ps"))
    out = whole.union(joined.select(key, "chunk", "char_start", "char_end", F.array_join(F.transform("ps", lambda p: p["text"]), "\n\n").alias("text")))
    out = out.withColumn("n_chunks", F.count("*").over(Window.partitionBy(key)))
    label = F.concat(F.lit("Bloc "), (F.col("chunk") + 1).cast("string"), F.lit("/"), F.col("n_chunks").cast("string"))
    return out.select(key, "chunk", "n_chunks", label.alias("label"), "char_start", "char_end", "text", (F.col("chunk") > 0).alias("has_overlap_before"), (F.col("chunk") < F.col("n_chunks") - 1).alias("has_overlap_after"))
