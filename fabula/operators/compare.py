"""Pairs of works to scores.

A pair row carries both works' node arrays, so every score is an expression on one row: the nodes of a pair are never
exploded, and pairs are shuffled once, by the works they name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import lcs_length, plain_codes
from ..functions.text import jaccard
from ..lexicon import LENGTH_CATEGORIES, REGISTER_DISTANCE, ROLE_STOPWORDS, ROLE_WORD, ROLES
from .extract import MODALITIES

# Weights and bounds of the scores.
WEIGHTS = (("s_iso", 0.25), ("s_ged", 0.20), ("s_func", 0.25), ("s_act", 0.15), ("s_tens", 0.15))
MATCH = 0.40
BEST = 15
MAX_CURVE = 20


#: Blocks of a search, at the least: each is one task.
BLOCKS = 24


def search_pairs(queries: DataFrame, works: DataFrame, blocks: int | None = None) -> DataFrame:
    """Every query work against all works, block by block: each work sits in one block and the few query works go to all of them.

    Blocks: one for each shuffle partition, and BLOCKS at the least, unless given. Both sides are dealt out by block, so nothing goes through the driver (the copies of the query works
    are as many as blocks: too many to broadcast, though the few before the copying look small), pairs are made where they are scored, and a task holds the works of its blocks.
    """
    blocks = blocks or max(BLOCKS, int(works.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    w = works.select([F.col(c).alias(f"cand_{c}") for c in works.columns]).withColumn("block", F.pmod(F.xxhash64("cand_work_id"), F.lit(blocks)).cast("int"))
    q = queries.select([F.col(c).alias(f"ref_{c}") for c in queries.columns]).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = q.repartition(blocks, "block").join(w.repartition(blocks, "block").hint("shuffle_hash"), "block")
    return pairs.where("ref_work_id <> cand_work_id").drop("block")


def attach(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """pairs(ref_id, cand_id) with both works' profiles."""
    side = lambda s: profiles.select([F.col(c).alias(f"{s}_{c}") for c in profiles.columns])
    out = pairs.join(side("ref"), pairs.ref_id == F.col("ref_work_id")).join(side("cand"), pairs.cand_id == F.col("cand_work_id"))
    return out.drop("ref_id", "cand_id")


def modality_cosine(a: Column, b: Column) -> Column:
    dot = reduce(lambda x, m: x + a[m] * b[m], MODALITIES, F.lit(0.0))
    return F.when((a["norm"] > 0) & (b["norm"] > 0), dot / (a["norm"] * b["norm"])).otherwise(0.0)


def node_similarity(a: Column, b: Column) -> Column:
    """Of two node structs of profiles(). Parts are added in a fixed order: the match bound depends on binary rounding."""
    phase = F.when(a["phase"] == b["phase"], 0.10).otherwise(0.0)
    tension = F.when(F.abs(a["tension"] - b["tension"]) < 0.15, 0.05).otherwise(0.0)
    actants = F.when((F.size(a["actants"]) > 0) & (F.size(b["actants"]) > 0), F.lit(0.20) * jaccard(a["names"], b["names"])).otherwise(0.0)
    same = F.coalesce(a["code"] == b["code"], F.lit(False))
    kin = F.coalesce(a["family"] == b["family"], F.lit(False))
    full = F.when(same, 0.60).otherwise(0.15) + actants + phase + tension + F.lit(0.05) * modality_cosine(a, b)
    return F.when(same | kin, full).otherwise(phase + tension)


def best_matches(ref: Column, cand: Column) -> Column:
    """For each candidate node {cand_pos, cand_code, ref_pos, ref_code, similarity} of its best reference node (ties: the earliest)."""

    def best(c: Column) -> Column:
        every = F.transform(ref, lambda r: F.struct(node_similarity(r, c).alias("similarity"), (-r["pos"]).alias("back"), r["code"].alias("ref_code")))
        return F.array_max(every)

    def row(c: Column) -> Column:
        return F.transform(F.array(best(c)), lambda m: F.struct(c["pos"].alias("cand_pos"), c["code"].alias("cand_code"), (-m["back"]).alias("ref_pos"), m["ref_code"].alias("ref_code"), m["similarity"].alias("similarity")))[0]

    return F.transform(cand, row)


def isomorphism(matches: Column) -> Column:
    """Weighted share of candidate nodes with a match; a code seen n times weighs 1 / sqrt(n) each time."""
    weighted = F.transform(
        F.array(matches),
        lambda ms: F.transform(ms, lambda m: F.struct(F.when(m["similarity"] >= MATCH, 1.0).otherwise(0.0).alias("hit"), F.when(m["cand_code"].isNull(), 1.0).otherwise(1.0 / F.sqrt(F.size(F.filter(ms, lambda x: x["cand_code"] == m["cand_code"])).cast("double"))).alias("w"))),
    )
    zero = F.struct(F.lit(0.0).alias("hit"), F.lit(0.0).alias("all"))
    return F.aggregate(F.element_at(weighted, 1), zero, lambda t, m: F.struct((t["hit"] + m["hit"] * m["w"]).alias("hit"), (t["all"] + m["w"]).alias("all")), lambda t: F.when(t["all"] > 0, t["hit"] / t["all"]).otherwise(0.0))


def correspondences(matches: Column, k: int = BEST) -> Column:
    """The k best matches at or above the bound, by similarity, then candidate order."""
    hits = F.filter(matches, lambda m: m["similarity"] >= MATCH)
    ranked = F.array_sort(F.transform(hits, lambda m: F.struct((-m["similarity"]).alias("down"), m["cand_pos"].alias("cand_pos"), m["cand_code"].alias("cand_code"), m["ref_pos"].alias("ref_pos"), m["ref_code"].alias("ref_code"))))
    return F.slice(ranked, 1, k)


def best_of(rows: DataFrame) -> Column:
    """correspondences() of pair rows as {cand_pos, cand_code, ref_pos, ref_code, similarity}: those that blocks.compared() found, or from the matches."""
    if "best" in rows.columns:
        return F.col("best")
    return F.transform(correspondences(F.col("matches")), lambda m: F.struct(*[m[c].alias(c) for c in ("cand_pos", "cand_code", "ref_pos", "ref_code")], (-m["down"]).alias("similarity")))


def ged(ref_codes: Column, cand_codes: Column, n_ref: Column, n_cand: Column) -> Column:
    shared = jaccard(ref_codes, cand_codes)
    size = F.greatest(n_ref, n_cand)
    neither, one = (F.size(ref_codes) == 0) & (F.size(cand_codes) == 0), (F.size(ref_codes) == 0) | (F.size(cand_codes) == 0)
    return F.when((n_ref == 0) | (n_cand == 0), 0.0).when(neither, 0.5).when(one, 0.0).otherwise(shared * (1 - F.lit(0.3) * F.abs(n_ref - n_cand) / F.greatest(size, F.lit(1))))


def sequence_score(lcs: Column, ref_codes: Column, cand_codes: Column, ref_plain: Column, cand_plain: Column) -> Column:
    """sqrt(LCS / longer) of the plain codes; 0.5 if only the others are left on a side, 0 without codes."""
    empty = (F.size(ref_codes) == 0) | (F.size(cand_codes) == 0)
    score = F.sqrt(lcs / F.greatest(F.size(ref_plain), F.size(cand_plain), F.lit(1)))
    return F.when(empty, 0.0).when((F.size(ref_plain) == 0) | (F.size(cand_plain) == 0), 0.5).otherwise(score)


def function_sequence(ref_codes: Column, cand_codes: Column) -> Column:
    """The score of two sequences of codes."""
    a, b = plain_codes(ref_codes), plain_codes(cand_codes)
    return sequence_score(lcs_length(a, b), ref_codes, cand_codes, a, b)


def actant_sums(actants: Column) -> Column:
    """Sums of the highest, the two and the three highest actant counts (fewer, if there are fewer actants). Made once for a work, not for a pair."""
    counts = F.transform(F.array(actants), lambda a: F.reverse(F.array_sort(F.transform(F.array_distinct(a), lambda x: F.size(F.filter(a, lambda y: y == x))))))
    return F.transform(counts, lambda c: F.transform(F.slice(c, 1, 3), lambda _, i: F.aggregate(F.slice(c, F.lit(1), i + 1), F.lit(0), lambda s, n: s + n)))[0]


def persistence_of(ref_sums: Column, cand_sums: Column) -> Column:
    """Ratio of two works' actant_sums, of as many counts as both have."""
    k = F.least(F.size(ref_sums), F.size(cand_sums))
    a, b = F.get(ref_sums, k - 1), F.get(cand_sums, k - 1)
    return F.when(k > 0, F.least(a, b) / F.greatest(a, b, F.lit(1))).otherwise(0.0)


def persistence(ref_actants: Column, cand_actants: Column) -> Column:
    """Ratio of the sums of the three highest actant counts."""
    return persistence_of(actant_sums(ref_actants), actant_sums(cand_actants))


def resample(curve: Column, n: Column) -> Column:
    """Linear resampling to n points."""

    def at(i: Column) -> Column:
        where = F.when(n > 1, i * (F.size(curve) - 1) / F.greatest(n - 1, F.lit(1))).otherwise(0.0)
        low = F.floor(where).cast("int")
        frac = where - low
        return F.get(curve, low) * (1 - frac) + F.get(curve, F.least(low + 1, F.size(curve) - 1)) * frac

    return F.when(F.size(curve) == n, curve).otherwise(F.transform(F.sequence(F.lit(0), n - 1), at))


def curves(tensions: Column) -> Column:
    """A work's curve resampled to 1, 2, ... points, up to its own length and 20: {total, centred, norm} of each. Made once for a work, not for a pair."""
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))
    sizes = F.filter(F.sequence(F.lit(0), F.least(F.size(tensions), F.lit(MAX_CURVE))), lambda n: n > 0)
    summed = F.transform(sizes, lambda n: F.transform(F.array(resample(tensions, n)), lambda a: F.struct(total(a, lambda x: x).alias("total"), a.alias("a")))[0])
    centred = F.transform(summed, lambda t: F.struct(t["total"].alias("total"), F.transform(t["a"], lambda x: x - t["total"] / F.size(t["a"])).alias("centred")))
    return F.transform(centred, lambda t: F.struct(t["total"].alias("total"), t["centred"].alias("centred"), F.sqrt(total(t["centred"], lambda x: x * x)).alias("norm")))


def tension_score(ref: Column, cand: Column) -> Column:
    """(Pearson + 1) / 2 of two works' curves() of as many points as both have; 0.5 if too short or flat, 0 if empty."""
    n = F.least(F.size(ref), F.size(cand))
    a, b = F.get(ref, n - 1), F.get(cand, n - 1)
    num = F.aggregate(F.zip_with(a["centred"], b["centred"], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    flat = (a["norm"] == 0) | (b["norm"] == 0)
    return F.when(n == 0, 0.0).when(n < 3, 0.5).when(flat, 0.5).otherwise((num / (a["norm"] * b["norm"]) + 1) / 2)


def tension_profile(ref: Column, cand: Column) -> Column:
    """(Pearson + 1) / 2 of the resampled curves; 0.5 if too short or flat, 0 if empty."""
    return F.transform(F.array(F.struct(curves(ref).alias("a"), curves(cand).alias("b"))), lambda t: tension_score(t["a"], t["b"]))[0]


def prepared(profiles: DataFrame) -> DataFrame:
    """profiles with what pairs need of one work alone: curves, their totals and actant_sums."""
    return profiles.withColumns({"curves": curves(F.col("tensions")), "actant_sums": actant_sums(F.col("actants"))}).withColumn("curve_totals", F.transform("curves", lambda c: c["total"]))


def role_words(value: Column, stopwords: str = ROLE_STOPWORDS) -> Column:
    return F.array_except(F.regexp_extract_all(F.lower(F.trim(F.coalesce(value, F.lit("")))), F.lit(ROLE_WORD), F.lit(0)), F.array(*map(F.lit, stopwords.split())).cast("array<string>"))


def role_sets(roles: Column) -> Column:
    """Of a role struct, for each of the six roles whether it is blank, and its words; null for null. Made once for a work, not for a pair."""
    side = lambda role: F.struct((F.trim(F.coalesce(roles[role], F.lit(""))) == "").alias("blank"), role_words(roles[role]).alias("words"))
    return F.when(roles.isNotNull(), F.array(*map(side, ROLES)))


def role_similarity(a: Column, b: Column) -> Column:
    """Mean Jaccard over the six roles of two role_sets(): both empty 0.5, one empty or wordless left out; 0 if a work has none."""
    scores = F.zip_with(a, b, lambda x, y: F.when(x["blank"] & y["blank"], 0.5).when((F.size(x["words"]) > 0) & (F.size(y["words"]) > 0), jaccard(x["words"], y["words"])))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    add = lambda t, x: F.when(x.isNull(), t).otherwise(F.struct((t["sum"] + F.coalesce(x, F.lit(0.0))).alias("sum"), (t["n"] + 1).alias("n")))
    mean = F.aggregate(scores, start, add, lambda t: t["sum"] / F.greatest(t["n"], F.lit(1)))
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(mean)


def role_match(ref: tuple[Column, Column], cand: tuple[Column, Column]) -> Column:
    """{score, label} of the best of the four pairs of versions, role_sets() (ties: the first); 0.5 if a work has no roles."""
    pairs = [(i, j) for i in (0, 1) for j in (0, 1)]
    labels = F.array(*[F.lit(f"v{i + 1}↔v{j + 1}") for i, j in pairs])
    made = F.array(*[F.coalesce(role_similarity(ref[i], cand[j]), F.lit(0.0)) for i, j in pairs])
    missing = (ref[0].isNull() & ref[1].isNull()) | (cand[0].isNull() & cand[1].isNull())
    best = lambda v: F.struct(F.array_max(v).alias("score"), F.element_at(labels, F.array_position(v, F.array_max(v)).cast("int")).alias("label"))
    return F.when(missing, F.struct(F.lit(0.5).alias("score"), F.lit("indisponible").alias("label"))).otherwise(F.transform(F.array(made), best)[0])


def role_alignment(ref: tuple[Column, Column], cand: tuple[Column, Column]) -> tuple[Column, Column]:
    """Score and label of role_match for the role structs of both works' versions."""
    match = role_match(*[(role_sets(v[0]), role_sets(v[1])) for v in (ref, cand)])
    return match["score"], match["label"]


def form_delta(ref: Column, cand: Column) -> Column:
    cats = F.create_map(*[F.lit(x) for kv in LENGTH_CATEGORIES.items() for x in kv])
    size = lambda s: F.coalesce(F.element_at(cats, F.lower(F.coalesce(s["narrative_length_category"], F.lit("moyen")))), F.lit(3))
    form = lambda s: F.lower(F.coalesce(s["form"], F.lit("")))
    return (F.when(form(ref) == form(cand), 0.0).otherwise(1.0) + F.abs(size(ref) - size(cand)) / 4) / 2


def register_delta(ref: Column, cand: Column) -> Column:
    near = F.create_map(*[x for a, b, d in REGISTER_DISTANCE for x in (F.lit("|".join(sorted((a, b)))), F.lit(d))])
    a, b = (F.lower(F.coalesce(s["register"], F.lit(""))) for s in (ref, cand))
    return F.when((a == "") | (b == ""), 0.5).when(a == b, 0.0).otherwise(F.coalesce(F.element_at(near, F.concat_ws("|", F.least(a, b), F.greatest(a, b))), F.lit(0.7)))


def form_keys(form: Column) -> Column:
    """What form_delta, register_delta and moral_delta read of a form struct. Made once for a work, not for a pair."""
    cats = F.create_map(*[F.lit(x) for kv in LENGTH_CATEGORIES.items() for x in kv])
    text = lambda name: F.lower(F.coalesce(form[name], F.lit("")))
    size = F.coalesce(F.element_at(cats, F.lower(F.coalesce(form["narrative_length_category"], F.lit("moyen")))), F.lit(3))
    return F.struct(text("form").alias("form_key"), size.alias("size"), text("register").alias("register_key"), form["has_narrator_intervention"].alias("told"), form["has_explicit_morality"].alias("moral"))


def lead_words(roles: Column) -> Column:
    """Words of a role struct's lead. Made once for a work, not for a pair."""
    return F.regexp_extract_all(F.lower(F.trim(F.coalesce(roles["protagoniste"], F.lit("")))), F.lit(ROLE_WORD), F.lit(0))


def focus_of(a: Column, b: Column) -> Column:
    """Of two works' lead_words()."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.5).otherwise(1 - jaccard(a, b))


def focus_delta(ref: Column, cand: Column) -> Column:
    return focus_of(lead_words(ref), lead_words(cand))


def with_role_sets(works: DataFrame) -> DataFrame:
    """works with roles, and roles_v2 if there, and what pairs need of them: role_sets, role_sets_v2, lead."""
    more = {"role_sets_v2": role_sets(F.col("roles_v2"))} if "roles_v2" in works.columns else {}
    return works.withColumns({"role_sets": role_sets(F.col("roles")), **more, "lead": lead_words(F.col("roles"))})


def moral_delta(ref: Column, cand: Column, ref_codes: Column, cand_codes: Column) -> Column:
    moral = lambda s, codes: F.coalesce(s["has_explicit_morality"], F.array_contains(codes, "F49"), F.lit(False))
    told = lambda s: s["has_narrator_intervention"]
    narrator = F.when(told(ref).isNull() | told(cand).isNull() | (told(ref) == told(cand)), 0.0).otherwise(1.0)
    return (F.when(moral(ref, ref_codes) == moral(cand, cand_codes), 0.0).otherwise(1.0) + narrator) / 2


def modality_class(s_iso: Column, s_func: Column, s_tens: Column, n_ref: Column, n_cand: Column) -> Column:
    ratio = n_cand / F.greatest(n_ref, F.lit(1))
    return (
        F.when(~((s_iso >= 0.45) & (s_func >= 0.35)), F.when(s_iso < 0.25, "none").otherwise("partial"))
        .when((ratio > 1.4) & (s_func > 0.45), "amplification")
        .when((ratio < 0.7) & (s_func > 0.45), "condensation")
        .when((s_tens < 0.3) & (s_iso > 0.45), "inversion")
        .when((s_iso >= 0.55) & (s_func >= 0.45) & (ratio > 0.8) & (ratio < 1.3), "transposition")
        .when((s_iso < 0.55) | (s_func < 0.45), "hybridation")
        .otherwise("partial")
    )


#: What a reader is told, by the SNS below which it holds; SS and the modality go in.
VERDICTS = (
    (0.30, "Structures nettement différentes ; un emprunt de surface reste possible."),
    (0.50, "Ressemblance sans doute de genre (spécificité %.2f) ; à faire lire."),
    (0.70, "Correspondances notables (modalité %s) ; avis d'un narratologue conseillé."),
    (float("inf"), "Structure profonde très proche (modalité %s) ; expertise nécessaire, ce n'est pas une preuve."),
)


def verdict_text(sns: Column, ss: Column, modality: Column) -> Column:
    """The verdict with the numbers it rests on."""
    told = [F.lit(VERDICTS[0][1]), F.format_string(VERDICTS[1][1], F.round(F.round(ss, 9), 2)), *[F.format_string(t, modality) for _, t in VERDICTS[2:]]]
    return reduce(lambda out, x: F.when(sns < x[0][0], x[1]).otherwise(out), reversed(list(zip(VERDICTS[:3], told[:3], strict=True))), told[3])


def with_scores(rows: DataFrame) -> DataFrame:
    """Pair rows (ref_*, cand_* profiles, prepared() ones for speed, or those of blocks.compared(), and ref_form, cand_form, ref_roles, cand_roles, ref_roles_v2, cand_roles_v2 structs if there) with all scores and classes."""
    c, have = F.col, set(rows.columns)
    known = "s_iso" in have
    out = rows if known else rows.withColumn("matches", best_matches(c("ref_nodes"), c("cand_nodes"))).withColumn("s_iso", isomorphism(F.col("matches")))
    out = out.withColumn("s_ged", ged(c("ref_codes"), c("cand_codes"), c("ref_n_nodes"), c("cand_n_nodes")))
    lcs = c("lcs") if known else lcs_length(c("ref_plain"), c("cand_plain"), c("ref_masks"))
    both = lambda name: (c(f"ref_{name}"), c(f"cand_{name}"))
    ready = "ref_actant_sums" in have
    chain = persistence_of(*both("actant_sums")) if ready else persistence(*both("actants"))
    tens = c("s_tens") if known else tension_score(*both("curves")) if ready else tension_profile(*both("tensions"))
    out = out.withColumn("s_func", sequence_score(lcs, c("ref_codes"), c("cand_codes"), c("ref_plain"), c("cand_plain"))).withColumn("s_chain", chain)
    def versions(side: str) -> tuple[Column, Column]:
        one, two = (f"{side}_role_sets", f"{side}_role_sets_v2") if ready_roles else (f"{side}_roles", f"{side}_roles_v2")
        found = [c(n) if ready_roles else role_sets(c(n)) for n in (one, two if two in have else one)]
        return found[0], found[1]

    ready_roles = "ref_role_sets" in have
    with_roles = ready_roles or {"ref_roles", "cand_roles"} <= have
    match = role_match(versions("ref"), versions("cand")) if with_roles else F.struct(F.lit(0.5).alias("score"), F.lit("indisponible").alias("label"))
    out = out.withColumn("roles_match", match).withColumn("s_greimas", c("roles_match.score")).withColumn("alignment", c("roles_match.label"))
    out = out.withColumn("s_act", (c("s_chain") + c("s_greimas")) / 2).withColumn("s_tens", tens)
    out = out.withColumn("sns", reduce(lambda a, b: a + b, [F.lit(w) * c(n) for n, w in WEIGHTS]))
    out = out.withColumn("sns_normalized", F.least(F.lit(1.0), c("sns") * 1.15)).withColumn("ss", F.greatest(F.lit(0.0), (c("sns") - 0.4) / 0.6))
    form = {"ref_form", "cand_form"} <= have
    missing = F.lit(None).cast("struct<form:string,register:string,narrative_length_category:string,has_explicit_morality:boolean,has_narrator_intervention:boolean>")
    f, g = (c("ref_form"), c("cand_form")) if form else (missing, missing)
    focus = focus_of(*both("lead")) if ready_roles else focus_delta(c("ref_roles"), c("cand_roles")) if with_roles else F.lit(0.5)
    deltas = {"structure": 1 - c("s_iso"), "form": form_delta(f, g), "register": register_delta(f, g), "focus": focus, "moral": moral_delta(f, g, c("ref_codes"), c("cand_codes"))}
    out = out.withColumns({f"{name}_delta": x for name, x in deltas.items()})
    mean = reduce(lambda x, y: x + y, [c(f"{name}_delta") for name in deltas]) / 5
    out = out.withColumn("st", F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))).withColumn("modality", modality_class(c("s_iso"), c("s_func"), c("s_tens"), c("ref_n_nodes"), c("cand_n_nodes")))
    out = out.withColumn("srj", F.lit(0.4) * c("sns") + F.lit(0.4) * c("ss") + F.when(c("modality") == "none", 0.0).otherwise(0.1))
    level = F.when(c("srj") < 0.25, "Faible").when(c("srj") < 0.55, "Modéré").when(c("srj") < 0.80, "Élevé").otherwise("Critique")
    verdict = F.when(c("sns") < 0.30, "different").when(c("sns") < 0.50, "conventional").when(c("sns") < 0.70, "notable").otherwise("close")
    coded = F.size(c("ref_codes")) / F.greatest(c("ref_n_nodes"), F.lit(1))
    notes = F.array_compact(F.array(F.lit("decision_support"), F.when(c("sns") > 0.70, "high_score"), F.when((c("ref_n_nodes") < 5) | (c("cand_n_nodes") < 5), "short_text"), F.when((c("ref_n_nodes") > 0) & (coded < 0.4), "few_functions")))
    return out.withColumn("srj_level", level).withColumn("verdict", verdict).withColumn("warnings", notes)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k works most similar to each reference (ties: smallest id) with their rank."""
    w = Window.partitionBy("ref_id").orderBy(F.round("sns", 9).desc(), "cand_id")
    return scored.select("ref_id", "cand_id", "sns").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def percentiles(scored: DataFrame, group: str = "ref_id", steps: int = 1000) -> DataFrame:
    """Rank of each pair's SNS within its group, 0 to 1 (0 if it is alone).

    Ranks come from two levels, so that no group is sorted whole: pairs below a pair's step are counted from a histogram of `steps` steps
    for each group, and only the pairs of one step are ranked with each other. `scored` is read twice: hand in a written table.
    """
    rows = scored.withColumn("_s", F.round("sns", 9)).withColumn("_step", F.floor(F.col("_s") * steps))
    counts = rows.groupBy(group, "_step").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    below = counts.withColumn("_all", F.sum("_n").over(w)).withColumn("_below", F.sum("_n").over(w.orderBy("_step")) - F.col("_n")).drop("_n")
    inside = F.rank().over(Window.partitionBy(group, "_step").orderBy("_s")) - 1
    out = rows.withColumn("_in", inside).join(below, [group, "_step"])
    share = F.when(F.col("_all") > 1, (F.col("_below") + F.col("_in")) / (F.col("_all") - 1)).otherwise(0.0)
    return out.withColumn("percentile", share).select(*scored.columns, "percentile")
