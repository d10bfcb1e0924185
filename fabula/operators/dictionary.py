"""Nodes with a lexicon of any size: one pass over each text finds every word and every substring of it.

extract.nodes names each list word in an expression, which is right for some hundred words and hopeless for ten thousand. Here a text's tokens are looked up
in a hash table, and an automaton over all list strings (Aho-Corasick) reads the lower text once, whatever their number. The lexicon is the caller's
object on the driver; it reaches the workers once, as a broadcast variable, and each builds its tables once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.text import tokens
from ..lexicon import FRENCH, Lexicon
from . import extract


class Tables:
    """A lexicon's hash table and automaton."""

    def __init__(self, lexicon: Lexicon) -> None:
        import ahocorasick

        self.patterns = lexicon.codes()
        self.lists = [lexicon.high, lexicon.low, *[words for _, words in lexicon.modalities]]
        self.automaton = ahocorasick.Automaton()
        for word in {w for words in self.lists for w in words}:
            self.automaton.add_word(word, word)
        self.automaton.make_automaton()

    def pattern(self, words: list[str]) -> int | None:
        """The pattern with most of its keywords among the tokens (ties: the earliest)."""
        n = Counter(at for w in words for at in self.patterns.get(w, ()))
        return min(n, key=lambda at: (-n[at], at), default=None)

    def contained(self, text: str) -> list[int]:
        """How many entries of each list the text contains."""
        found = {word for _, word in self.automaton.iter(text)} if len(self.automaton) else set()
        return [sum(w in found for w in words) for words in self.lists]


@cache
def _tables(lexicon: Lexicon) -> Tables:
    return Tables(lexicon)


def hits(segments: DataFrame, lexicon: Lexicon) -> DataFrame:
    """segments with _pattern (its position, null without one) and _counts: of the strings of high and low tension and of each modality, in that order."""
    shared = segments.sparkSession.sparkContext.broadcast(lexicon)
    rows = segments.withColumns({"_tokens": tokens(F.col("text")), "_lower": F.lower("text")})
    schema = StructType([*segments.schema.fields, StructField("_pattern", IntegerType()), StructField("_counts", ArrayType(IntegerType()))])
    n = len(segments.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(shared.value)
        for b in batches:
            found = [tables.pattern(ws or []) for ws in b["_tokens"].to_pylist()]
            counts = [tables.contained(t or "") for t in b["_lower"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(found, pa.int32()), pa.array(counts, pa.list_(pa.int32()))], names=[*b.schema.names[:n], "_pattern", "_counts"])

    return rows.mapInArrow(run, schema)


def nodes(segments: DataFrame, lexicon: Lexicon = FRENCH, *keep: str) -> DataFrame:
    """What extract.nodes gives, row for row."""
    rows = hits(segments.select(*dict.fromkeys(["work_id", "pos", "total", "segment_id", "text", "entities", *keep])), lexicon)
    codes, families = (F.array(*[F.lit(p[i]) for p in lexicon.patterns]) for i in (0, 1))
    high, low = (F.get("_counts", F.lit(k)) for k in (0, 1))
    # Added one by one, as binary rounding decides comparisons later on.
    summed = lambda n: F.least(F.lit(1.0), F.aggregate(F.array_repeat(F.lit(0.3), n), F.lit(0.0), lambda t, x: t + x))
    return rows.select(
        "work_id", "pos", "total", F.format_string("n%03d", F.col("pos") + 1).alias("node_id"), "segment_id",
        F.get(codes, "_pattern").alias("function_code"), F.get(families, "_pattern").alias("function_family"), F.slice("entities", 1, 6).alias("actants"),
        *[summed(F.get("_counts", F.lit(k + 2))).alias(name) for k, (name, _) in enumerate(lexicon.modalities)],
        extract.tension_from(high, low, F.col("pos"), F.col("total")).alias("tension"), extract.phase_of(F.col("text"), F.col("pos"), F.col("total"), lexicon).alias("phase"), F.substring("text", 1, 150).alias("text_excerpt"), *keep,
    )
