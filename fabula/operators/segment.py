"""Works to segments: paragraphs, an adaptive size, greedy folds, names and actions. No shuffle: a work is cut within its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_newlines, has_length, n_words, strip, tokens
from ..lexicon import FRENCH, Lexicon

MIN_CHARS = 50
NAME = r"(?U)\b([A-Z][a-zà-ÿ]+(?:\s+(?:de |d')?[A-Z][a-zà-ÿ]+)?)\b"
_ACC = "struct<done:array<string>,cur:array<string>,n:int>"


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(clean_newlines(text), r"(?U)\n\s*\n+"), strip), lambda p: p != "")


def target_words(total: Column) -> Column:
    return F.when(total < 200, 40).when(total < 500, 80).when(total < 1500, 150).otherwise(180)


def _empty() -> Column:
    return F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n")).cast(_ACC)


def _flush(acc: Column, joint: str) -> Column:
    return F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["cur"], joint)))).otherwise(acc["done"])


def _add(acc: Column, unit: Column, target: Column, joint: str) -> Column:
    full = (acc["n"] + unit["n"] > target) & (F.size(acc["cur"]) > 0)
    return F.when(full, F.struct(_flush(acc, joint).alias("done"), F.array(unit["s"]).alias("cur"), unit["n"].alias("n")).cast(_ACC)).otherwise(
        F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.array(unit["s"])).alias("cur"), (acc["n"] + unit["n"]).alias("n")).cast(_ACC)
    )


def _counted(parts: Column) -> Column:
    return F.transform(parts, lambda s: F.struct(s.alias("s"), n_words(s).alias("n")))


def let(value: Column, use) -> Column:
    """use(value) with value computed once for a row, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_long(paragraph: Column, target: Column) -> Column:
    """Sentences of a long paragraph in groups of about `target` words."""
    sentences = F.split(paragraph, r"(?U)(?<=[.!?])\s+(?=[A-ZÉÀÊÎÔ])")
    return F.aggregate(_counted(sentences), _empty(), lambda acc, s: _add(acc, s, target, " "), lambda acc: _flush(acc, " "))


def group_chunks(units: Column, target: Column) -> Column:
    """Counted paragraphs in groups of about `target` words; one of over twice that is cut by itself."""

    def step(acc: Column, p: Column) -> Column:
        long = F.struct(F.concat(_flush(acc, "\n\n"), split_long(p["s"], target)).alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n")).cast(_ACC)
        return F.when(p["n"] > target * 2, long).otherwise(_add(acc, p, target, "\n\n"))

    return F.aggregate(units, _empty(), step, lambda acc: _flush(acc, "\n\n"))


def chunks(text: Column) -> Column:
    """Texts of a work's segments."""

    def cut(units: Column) -> Column:
        total = F.aggregate(units, F.lit(0), lambda n, u: n + u["n"])
        return let(target_words(total), lambda target: group_chunks(units, target))

    return let(_counted(paragraphs(text)), cut)


def admitted(works: DataFrame) -> DataFrame:
    return works.where(has_length(F.col("text"), MIN_CHARS))


def chunk_rows(works: DataFrame, *columns: str) -> DataFrame:
    """(columns, pos, total, text): a row for each segment of works(text) of 50 characters or more."""
    numbered = let(chunks(F.col("text")), lambda c: F.transform(c, lambda s, i: F.struct(i.alias("pos"), F.size(c).alias("total"), s.alias("text"))))
    return admitted(works).select(*columns, F.explode(numbered).alias("s")).select(*columns, "s.*")


def offsets(text: Column, chunks: Column) -> Column:
    """Array of {start, end}: each chunk is looked for, by its first 50 characters, from where the one before ends."""
    kind = "struct<next:int,out:array<struct<start:int,end:int>>>"
    start = F.struct(F.lit(0).alias("next"), F.array().alias("out")).cast(kind)

    def step(acc: Column, c: Column) -> Column:
        found = F.when(F.length(c) < 50, acc["next"]).otherwise(F.position(F.substring(c, 1, 50), text, acc["next"] + 1) - 1)
        end = F.when(found >= 0, found).otherwise(acc["next"]) + F.length(c)
        return F.struct(end.alias("next"), F.concat(acc["out"], F.array(F.struct(F.greatest(found, F.lit(0)).alias("start"), end.alias("end")))).alias("out")).cast(kind)

    return F.aggregate(chunks, start, step, lambda acc: acc["out"])


def entities(text: Column, lexicon: Lexicon = FRENCH) -> Column:
    """Up to 10 names: the 20 most frequent (ties: first seen), without stop names, kept if seen twice or among the first three."""
    counted = F.transform(
        F.array(F.regexp_extract_all(text, F.lit(NAME), F.lit(1))),
        lambda names: F.array_sort(F.transform(F.array_distinct(names), lambda x: F.struct((-F.size(F.filter(names, lambda y: y == x))).alias("n"), F.array_position(names, x).alias("at"), x.alias("name")))),
    )
    top = F.slice(F.element_at(counted, 1), 1, 20)
    left = F.filter(top, lambda e: ~e["name"].isin(*lexicon.stop_names) & (F.length(e["name"]) >= 3))
    kept = F.filter(left, lambda e, i: (e["n"] <= -2) | (i < 3))
    return F.slice(F.transform(kept, lambda e: e["name"]), 1, 10)


def actions(text: Column, lexicon: Lexicon = FRENCH) -> Column:
    """Up to 8 of the lexicon's verbs, in its order, that stand in the text."""
    return F.slice(F.array_intersect(F.array(*map(F.lit, lexicon.verbs)), tokens(text)), 1, 8)


def segments(works: DataFrame, lexicon: Lexicon = FRENCH, with_offsets: bool = True, *keep: str) -> DataFrame:
    """(work_id, pos, total, segment_id, text, start_char, end_char, word_count, entities, actions), pos from 0, and the columns of a work to keep.

    Nodes don't read start_char and end_char, and looking for them adds about three quarters of the time of cutting: without offsets they are left out.
    """
    if not with_offsets:
        return _described(chunk_rows(works, "work_id", *keep), lexicon, *keep)
    placed = let(chunks(F.col("text")), lambda c: let(offsets(F.col("text"), c), lambda o: F.transform(c, lambda s, i: F.struct(i.alias("pos"), F.size(c).alias("total"), s.alias("text"), F.get(o, i).alias("at")))))
    rows = admitted(works).select("work_id", *keep, F.explode(placed).alias("s")).select("work_id", *keep, "s.pos", "s.total", "s.text", F.col("s.at.start").alias("start_char"), F.col("s.at.end").alias("end_char"))
    return _described(rows, lexicon, "start_char", "end_char", *keep)


def _described(rows: DataFrame, lexicon: Lexicon, *more: str) -> DataFrame:
    return rows.select("work_id", "pos", "total", F.format_string("s%03d", F.col("pos") + 1).alias("segment_id"), "text", *more, n_words(F.col("text")).alias("word_count"), entities(F.col("text"), lexicon).alias("entities"), actions(F.col("text"), lexicon).alias("actions"))
