"""Scalar rules as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as the word rules of the texts' origin count it.
SPACES = r"(?U)\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def has_length(c: Column, n: int) -> Column:
    """Whether length(strip(c)) >= n, n from 2, without stripping: white space, n - 1 characters from the first other one on, and one more that is none."""
    return c.rlike(rf"(?Us)^\s*+\S.{{{n - 2}}}.*?\S")


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def clean_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def clean_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F\x7F]", "")


def clean_blanks(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def clean(c: Column) -> Column:
    """Line ends, control characters, runs of blanks and empty lines."""
    return clean_blanks(clean_controls(clean_newlines(c)))


def drop_page_numbers(c: Column) -> Column:
    """Without lines that hold only a page number."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda line: ~strip(line).rlike(r"^(?:\d{1,4}|[\-\s]*\d{1,4}[\-\s.]*)$")), "\n")


def is_recurring_candidate(line: Column) -> Column:
    return F.length(line).between(1, 79) & ~line.rlike(r"(?U)^\p{Ll}")


def quality_flags(text: Column, words: Column, pages: Column | None = None) -> Column:
    """Codes of what is doubtful about an extracted text."""
    stripped = F.length(strip(text))
    flags = [F.when(stripped == 0, F.lit("empty")), F.when(words < 30, F.lit("short"))]
    if pages is not None:
        flags.append(F.when((pages >= 3) & (stripped < 50 * pages), F.lit("scanned")))
    return F.array_compact(F.array(*flags))


def title_of(c: Column, default: str = "Nouvelle conversation", limit: int = 48) -> Column:
    """A conversation's title from its first message."""
    flat = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    cut = F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit("…"))
    return F.when(flat == "", F.lit(default)).when(F.length(flat) > limit, cut).otherwise(flat)


def tokens(c: Column) -> Column:
    """Distinct words of letters, digits and underscores, lower case."""
    return F.array_distinct(word_list(c))


def word_list(c: Column) -> Column:
    """tokens() with repeats."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))


def has_any(words: Column, lower: Column, wanted: tuple[str, ...]) -> Column:
    """Whether one of the wanted words stands in the text (words: its tokens; a wanted one of several words is matched in lower)."""
    single = [w for w in wanted if w.isalnum()]
    hit = F.arrays_overlap(words, F.array(*map(F.lit, single))) if single else F.lit(False)
    for phrase in (w for w in wanted if not w.isalnum()):
        hit = hit | lower.rlike(rf"(?U)\b{phrase}\b")
    return hit


def count_contained(lower: Column, wanted: tuple[str, ...]) -> Column:
    """How many of the wanted strings the text contains, as substrings."""
    total = F.lit(0)
    for w in wanted:
        total = total + lower.contains(w).cast("int")
    return total


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(0.0)


def token_estimate(c: Column) -> Column:
    return (F.length(c) / 4 * 1.20).cast("int")
