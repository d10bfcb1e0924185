"""Segments to nodes and edges. Nodes are made row by row; edges look at a work's next four nodes, so only small columns are shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import code_masks, plain_codes
from ..functions.text import count_contained, has_any, tokens, word_list
from ..lexicon import FRENCH, Lexicon

MODALITIES = ("vouloir", "devoir", "pouvoir", "savoir")


def pattern_of(text: Column, lexicon: Lexicon = FRENCH) -> Column:
    """Position of the lexicon's pattern with most of its keywords in the text (ties: the earliest); null if none has one."""
    return _pattern(tokens(text), lexicon)


def _pattern(found: Column, lexicon: Lexicon) -> Column:
    codes = lexicon.codes()
    words = F.array(*map(F.lit, codes))
    ords = F.create_map(*[x for w, at in codes.items() for x in (F.lit(w), F.array(*map(F.lit, at)))])
    hits = F.flatten(F.transform(F.array_intersect(words, found), lambda w: F.element_at(ords, w)))
    best = F.transform(F.array(hits), lambda h: F.array_max(F.transform(F.array_distinct(h), lambda k: F.struct(F.size(F.filter(h, lambda j: j == k)).alias("n"), (-k).alias("at")))))
    return -F.element_at(best, 1)["at"]


def phase_of(text: Column, pos: Column, total: Column, lexicon: Lexicon = FRENCH) -> Column:
    """Phase by the first indicator word, else by place in the work."""
    return _phase(tokens(text), F.lower(text), pos, total, lexicon)


def _phase(found: Column, lower: Column, pos: Column, total: Column, lexicon: Lexicon) -> Column:
    ratio = pos / F.greatest(total - 1, F.lit(1))
    place = F.when(ratio < 0.20, "Exposition").when(ratio < 0.55, "Complication").when(ratio < 0.80, "Climax").otherwise("Résolution")
    return reduce(lambda out, p: F.when(has_any(found, lower, p[1]), p[0]).otherwise(out), reversed(lexicon.phases), place)


def tension_from(high: Column, low: Column, pos: Column, total: Column) -> Column:
    """Tension of a place in a work, raised and lowered by how many strings of either list the text contains."""
    base = F.lit(0.3) + F.lit(0.5) * (F.lit(1) - F.abs(pos / F.greatest(total - 1, F.lit(1)) - F.lit(0.7)))
    raw = base + F.lit(0.08) * high - F.lit(0.05) * low
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def tension_of(text: Column, pos: Column, total: Column, lexicon: Lexicon = FRENCH) -> Column:
    lower = F.lower(text)
    return tension_from(count_contained(lower, lexicon.high), count_contained(lower, lexicon.low), pos, total)


def modality_of(text: Column, words: tuple[str, ...]) -> Column:
    lower, total = F.lower(text), F.lit(0.0)
    for w in words:
        total = total + F.when(lower.contains(w), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), total)


def nodes(segments: DataFrame, lexicon: Lexicon = FRENCH, *keep: str) -> DataFrame:
    """(work_id, pos, total, node_id, segment_id, function_code, function_family, actants, vouloir, devoir, pouvoir, savoir, tension, phase, text_excerpt), and the columns to keep."""
    text, pos, total = F.col("text"), F.col("pos"), F.col("total")
    names, families = (F.array(*[F.lit(p[i]) for p in lexicon.patterns]) for i in (0, 1))
    asked = F.array(*map(F.lit, dict.fromkeys([*lexicon.codes(), *[w for _, words in lexicon.phases for w in words]])))
    # A column of its own, as patterns and phases read it: the text is cut into words once.
    out = segments.withColumn("_found", F.array_intersect(asked, word_list(text))).withColumn("_p", _pattern(F.col("_found"), lexicon))
    return out.select(
        "work_id", "pos", "total", F.format_string("n%03d", pos + 1).alias("node_id"), "segment_id",
        F.get(names, F.col("_p")).alias("function_code"), F.get(families, F.col("_p")).alias("function_family"), F.slice("entities", 1, 6).alias("actants"),
        *[modality_of(text, words).alias(name) for name, words in lexicon.modalities],
        tension_of(text, pos, total, lexicon).alias("tension"), _phase(F.col("_found"), F.lower(text), pos, total, lexicon).alias("phase"), F.substring(text, 1, 150).alias("text_excerpt"), *keep,
    )


def sequential_edges(nodes: DataFrame) -> DataFrame:
    """Edges between consecutive nodes: causal if they share an actant, temporal if the phase changes, else sequential."""
    w = Window.partitionBy("work_id").orderBy("pos")
    nxt = nodes.select("work_id", "pos", "actants", "phase", F.lead("actants").over(w).alias("a2"), F.lead("phase").over(w).alias("p2")).where("p2 is not null")
    kind = F.when(F.arrays_overlap("actants", "a2"), "causal").when(F.col("phase") != F.col("p2"), "temporal").otherwise("sequential")
    return nxt.select("work_id", F.format_string("e%03d", F.col("pos") + 1).alias("edge_id"), F.col("pos").alias("src_pos"), (F.col("pos") + 1).alias("dst_pos"), kind.alias("transition_type"), F.lit(1.0).alias("weight"))


def distant_edges(nodes: DataFrame) -> DataFrame:
    """Causal edges of weight 0.6 from a node to the first of the nodes 2 to 4 further on that shares two actants or more."""
    w = Window.partitionBy("work_id").orderBy("pos")
    ahead = nodes.select("work_id", "pos", "actants", *[F.lead("actants", k).over(w).alias(f"a{k}") for k in (2, 3, 4)])
    far = reduce(lambda out, k: F.when(F.size(F.array_intersect("actants", f"a{k}")) >= 2, k).otherwise(out), (4, 3, 2), F.lit(None).cast("int"))
    found = ahead.withColumn("k", far).where("k is not null")
    return found.select("work_id", F.format_string("ec_%03d_%03d", F.col("pos") + 1, F.col("pos") + F.col("k") + 1).alias("edge_id"), F.col("pos").alias("src_pos"), (F.col("pos") + F.col("k")).alias("dst_pos"), F.lit("causal").alias("transition_type"), F.lit(0.6).alias("weight"))


def edges(nodes: DataFrame) -> DataFrame:
    return sequential_edges(nodes).unionByName(distant_edges(nodes))


def profiles(nodes: DataFrame) -> DataFrame:
    """One row per work: nodes (array in order; with what pairs compare: lower names, length of the modality vector), and codes, tensions and actants derived
    from it; the codes outside the African family and their bit masks."""
    names = F.transform("actants", lambda x: F.lower(F.trim(x))).alias("names")
    norm = F.sqrt(reduce(lambda t, m: t + F.col(m) * F.col(m), MODALITIES, F.lit(0.0))).alias("norm")
    parts = F.struct("pos", F.col("function_code").alias("code"), F.col("function_family").alias("family"), "actants", *MODALITIES, "tension", "phase", names, norm)
    out = nodes.groupBy("work_id").agg(F.sort_array(F.collect_list(parts)).alias("nodes"))
    out = out.select(
        "work_id",
        "nodes",
        F.size("nodes").alias("n_nodes"),
        F.filter(F.transform("nodes", lambda n: n["code"]), lambda c: c.isNotNull()).alias("codes"),
        F.transform("nodes", lambda n: n["tension"]).alias("tensions"),
        F.flatten(F.transform("nodes", lambda n: n["actants"])).alias("actants"),
    )
    return out.withColumn("plain", plain_codes(F.col("codes"))).withColumn("masks", code_masks(F.col("plain")))


def rollup(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per work: function sequence, distinct actants, tension profile and sizes."""
    per = profiles(nodes).join(edges.groupBy("work_id").agg(F.count("*").alias("n_edges")), "work_id", "left")
    return per.select("work_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.col("codes").alias("function_sequence"), F.array_distinct("actants").alias("distinct_actants"), F.col("tensions").alias("tension_profile"))


def node_table(segments: DataFrame, lexicon: Lexicon = FRENCH) -> DataFrame:
    """(work_id, sequence, function_code, phase, tension, word_count): nodes as a reader's table shows them, tension to two decimals."""
    return nodes(segments, lexicon, "word_count").select("work_id", (F.col("pos") + 1).alias("sequence"), "function_code", "phase", F.round(F.round("tension", 9), 2).alias("tension"), "word_count")
