"""Sequences of codes as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a word: an addition of two words stays a long.
WORD_BITS = 62


def code_masks(codes: Column) -> Column:
    """For each code of a sequence where it stands: bits in words of 62, the first place lowest. Made once for a work, not for a pair."""
    words = lambda n: F.sequence(F.lit(0), F.greatest(F.ceil(n / WORD_BITS).cast("int") - 1, F.lit(0)))
    bit = lambda c: lambda t, x: F.struct((t["bits"] + F.when(x == c, t["at"]).otherwise(0)).alias("bits"), (t["at"] * 2).alias("at"))
    start = F.struct(F.lit(0).cast("long").alias("bits"), F.lit(1).cast("long").alias("at"))
    row = lambda c: F.transform(words(F.size(codes)), lambda w: F.aggregate(F.slice(codes, w * WORD_BITS + 1, F.lit(WORD_BITS)), start, bit(c), lambda t: t["bits"]))
    return F.map_from_entries(F.transform(F.array_distinct(codes), lambda c: F.struct(c, row(c))))


def lcs_length(a: Column, b: Column, masks: Column | None = None) -> Column:
    """Length of the longest common subsequence of two arrays; masks: code_masks(a).

    Bit-parallel: a row of the usual table is one bit for each place of a (set: no step up there), and an element of b moves the whole row at once by an
    addition, word by word with the carry. So the time is the length of b times the words of a.
    """
    full = (1 << WORD_BITS) - 1
    words = F.greatest(F.ceil(F.size(a) / WORD_BITS).cast("int"), F.lit(1))
    made = F.array(code_masks(a) if masks is None else masks)
    hits = F.flatten(F.transform(made, lambda known: F.filter(F.transform(b, lambda x: F.element_at(known, x)), lambda m: m.isNotNull())))
    one = F.aggregate(hits, F.lit(full), lambda v, m: ((v + v.bitwiseAND(m[0])).bitwiseOR(v.bitwiseAND(F.bitwise_not(m[0])))).bitwiseAND(F.lit(full)))
    kind = "struct<carry:bigint,out:array<bigint>>"

    def move(row: Column, m: Column) -> Column:
        def word(t: Column, w: Column) -> Column:
            v, u = F.get(row, w), F.get(row, w).bitwiseAND(F.get(m, w))
            total = v + u + t["carry"]
            moved = total.bitwiseAND(F.lit(full)).bitwiseOR(v.bitwiseAND(F.bitwise_not(u)))
            return F.struct(F.shiftright(total, WORD_BITS).alias("carry"), F.concat(t["out"], F.array(moved)).alias("out")).cast(kind)

        return F.aggregate(F.sequence(F.lit(0), words - 1), F.struct(F.lit(0).alias("carry"), F.array().alias("out")).cast(kind), word, lambda t: t["out"])

    many = F.aggregate(hits, F.array_repeat(F.lit(full), words), move, lambda row: F.aggregate(row, F.lit(0), lambda s, v: s + F.bit_count(v)))
    ones = F.when(words == 1, F.bit_count(one)).otherwise(many)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(words * WORD_BITS - ones)


def plain_codes(codes: Column) -> Column:
    """Codes outside the African family."""
    return F.filter(codes, lambda x: ~x.startswith("FN"))
