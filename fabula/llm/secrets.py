"""Secret scan: a random forest takes false positives out of candidate strings, in DataFrame functions and spark.ml only.

Every run of 16 or more characters of [A-Za-z0-9+/_=-] in a whole text is a candidate, and every one of 4 or more right behind a credential
word with an assignment sign or behind an authorization scheme. A run with assignment signs inside (KEY=value) is cut at them: its parts are candidates
by the same rule, numbered within the run, and what stands before a part belongs to its neighbourhood. Features are length, transitions between character
classes, distinct characters, coverage by the corpus's own dictionary, whether it looks like a path, and the neighbouring words: whether they are in the dictionary, and
their hashes. A forest is trained on labelled findings, at most `fit_rows` of either label in the order of a seeded hash, and scores every candidate.

The query labels its findings from the table itself, by what no feature reads: the name of a value, its syntax and its format. Behind a credential word and an assignment sign a candidate that holds
digits and letters is a secret, and so is one in a known format; a candidate without digits, or one of digits alone without assignment sign before it, is none; the others, such as bare
mixed strings, stay unlabelled, and the forest decides on them from their letters and neighbours. Credential words aren't neighbouring words.

Defined results: null and empty texts have no candidates; texts of any length are read whole; repeated rows have rows each; findings that tie in the seeded order have equal features; if the findings carry one label or
none, no forest can be fitted and the score is the label's rule (1 or 0, unlabelled 0); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

FIT_ROWS = 5_000
DICTIONARY = 1_000
BUCKETS = 8
CANDIDATE = r"[A-Za-z0-9+/_=\-]{16,}"
SHORT = r"[A-Za-z0-9+/_=\-]{4,}"
CREDENTIAL = r"(?i:token|secret|password|passwd|pwd|credential|api[_-]?key|access[_-]?key|auth|key)"
#: Ends of what stands before a value: an assignment sign behind a credential word, an authorization scheme.
NAMED = CREDENTIAL + r"[\"']?\s{0,4}[=:]\s{0,4}[\"']?"
SCHEME = r"(?i:bearer|authorization[\"']?\s{0,4}[=:]\s{0,4}[\"']?[a-z]{1,12})\s{1,4}[\"']?"
#: Cut points of a run: assignment signs with a value after them (not the padding at its end).
CUT = r"=+(?=[^=])"
#: Formats of well-known keys (fixed values).
KNOWN = r"^(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{16,})$"
SIDES = ("before", "after")
FEATURES = ["length", "transitions", "distinct", "covered", "path"] + [f"{s}_{k}" for s in SIDES for k in ("known", *range(BUCKETS))]
_ACCENTS, _PLAIN = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿß", "aaaaaaceeeeiiiinooooouuuuyys"


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The corpus's most frequent words of 2 to 12 letters, accents taken off, over all texts."""
    words = F.split(F.translate(F.lower(F.coalesce(docs["text"], F.lit(""))), _ACCENTS, _PLAIN), r"[^a-z]+")
    counts = docs.select(F.explode(words).alias("word")).where(F.length("word").between(2, 12)).groupBy("word").count()
    return [r["word"] for r in counts.orderBy(F.desc("count"), "word").limit(size).collect()]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, candidate, before, after): all candidates with 40 characters before and 8 after them."""
    text = F.translate(F.coalesce(docs["text"], F.lit("")), "\x01\x02\x03", "   ")
    named = F.regexp_replace(text, f"({NAMED}|{SCHEME})(?={SHORT})", "$1\x03")  # a mark before values behind a credential word
    parts = F.split(F.regexp_replace(named, f"\x03?({CANDIDATE})|\x03({SHORT})", "\x01$1$2\x02"), "\x01")
    found = F.transform(
        F.array(parts),
        lambda p: F.transform(
            F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))),
            lambda x, i: F.struct((i + 1).alias("ordinal"), F.substring_index(x, "\x02", 1).alias("candidate"), F.right(F.element_at(p, i + 1), F.lit(40)).alias("before"), F.substring(F.substring_index(x, "\x02", -1), 1, 16).alias("after")),
        ),
    )
    return docs.select(docs["doc_id"].alias("doc_id"), F.explode(F.element_at(found, 1)).alias("c")).select("doc_id", "c.*").withColumn("before", F.regexp_replace("before", "[\x02\x03]", ""))


def split_runs(found: DataFrame) -> DataFrame:
    """Candidates cut at assignment signs: the same columns, and part (1 for an uncut one)."""
    pieces = F.split(F.regexp_replace("candidate", CUT, "=\x01"), "\x01")
    last = F.size("pieces")
    parts = F.transform(
        "pieces",
        lambda x, i: F.struct(
            (i + 1).cast("int").alias("part"),
            F.when(i + 1 < last, F.regexp_replace(x, "=$", "")).otherwise(x).alias("candidate"),
            F.right(F.concat("before", F.array_join(F.slice("pieces", 1, i), "")), F.lit(40)).alias("before"),
            F.when(i + 1 < last, F.lit("=")).otherwise(F.col("after")).alias("after"),
        ),
    )
    each = found.withColumn("pieces", pieces).select("doc_id", "ordinal", F.explode(parts).alias("p")).select("doc_id", "ordinal", "p.*")
    named = F.col("before").rlike(f"(?:{NAMED}|{SCHEME})$")
    return each.where((F.length("candidate") >= 16) | ((F.length("candidate") >= 4) & named))


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    c, n = F.col("candidate"), F.length("candidate")
    known = "|".join(sorted((w for w in words if w.isalpha()), key=lambda w: (-len(w), w)))
    letters = F.regexp_replace(F.lower(c), "[^a-z]", "")
    return found.select(
        "*",
        n.cast("double").alias("length"),
        (F.regexp_count(c, F.lit("[0-9]")) / n).alias("digits"),
        (F.regexp_count(c, F.lit("[a-z](?=[0-9A-Z])|[A-Z](?=[0-9a-z])|[0-9](?=[A-Za-z])")) / n).alias("transitions"),
        (F.size(F.array_distinct(F.split(c, ""))) / n).alias("distinct"),
        ((n - (F.length(F.regexp_replace(letters, known, "")) if known else F.length(letters)) - (n - F.length(letters))) / n).alias("covered"),
        (c.contains("/") | F.col("before").rlike(r"[/\\.]$")).cast("double").alias("path"),
        F.col("before").rlike(f"(?:[=:]\\s*[\"']?|{SCHEME})$").cast("double").alias("assigned"),
        F.col("before").rlike(f"(?:{CREDENTIAL}[\"']?\\s*[=:]\\s*[\"']?|{SCHEME})$").cast("double").alias("credential"),
        (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double").alias("quoted"),
        *neighbours(words),
    )


def neighbours(words: list[str]) -> list:
    """For the word before (credential words left out) and the one after: whether the dictionary holds it, and its hash's bucket, a column for each."""
    plain = lambda c: F.translate(F.lower(c), _ACCENTS, _PLAIN)
    said = {"before": F.regexp_extract(plain(F.regexp_replace("before", CREDENTIAL, " ")), r"([a-z]+)[^a-z]*$", 1), "after": F.regexp_extract(plain(F.col("after")), "([a-z]+)", 1)}
    out = []
    for side in SIDES:
        word = said[side]
        out.append(F.array_contains(F.array(*[F.lit(w) for w in words]).cast("array<string>"), word).cast("double").alias(f"{side}_known"))
        out += [((F.pmod(F.xxhash64(word), F.lit(BUCKETS)) == k) & (word != "")).cast("double").alias(f"{side}_{k}") for k in range(BUCKETS)]
    return out


def rule_label(df: DataFrame) -> DataFrame:
    """df with label 1.0, 0.0 or null."""
    mixed = (F.col("digits") > 0) & (F.col("digits") < 1)
    return df.withColumn("label", F.when(((F.col("credential") == 1) & mixed) | F.col("candidate").rlike(KNOWN), 1.0).when((F.col("digits") == 0) | ((F.col("assigned") == 0) & ~mixed), 0.0))


def scan(docs: DataFrame, labelled: DataFrame | None = None, fit_rows: int = FIT_ROWS, seed: int = 42, threshold: float = 0.5) -> DataFrame:
    """Candidates with features, score and is_secret. labelled: findings with FEATURES and label; None: labelled by rule."""
    found = materialize(rule_label(with_features(split_runs(candidates(docs)), dictionary(docs))), "secret-candidates")
    known = labelled if labelled is not None else found
    pick = lambda y: known.where(F.col("label") == y).orderBy(F.xxhash64(F.lit(seed), *FEATURES)).limit(fit_rows).select(*FEATURES, "label")
    sample = materialize(pick(1.0).union(pick(0.0)), "secret-fit")
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}  # two labels at most
    if len(n) < 2:
        return found.withColumn("score", F.coalesce("label", F.lit(0.0))).withColumn("is_secret", F.col("score") >= threshold)
    # Findings of either label weigh the same in all: how rare secrets are among names isn't how rare they are among unnamed strings.
    weighed = sample.withColumn("weight", F.when(F.col("label") == 1, 1 / n[1.0]).otherwise(1 / n[0.0]) * sum(n.values()) / 2)
    vector = VectorAssembler(inputCols=FEATURES, outputCol="vector")
    forest = RandomForestClassifier(featuresCol="vector", weightCol="weight", numTrees=40, maxDepth=6, seed=seed, probabilityCol="p", rawPredictionCol="raw", predictionCol="hard")
    out = forest.fit(vector.transform(weighed)).transform(vector.transform(found)).withColumn("score", vector_to_array("p")[1]).drop("vector", "p", "raw", "hard")
    return out.withColumn("is_secret", F.col("score") >= threshold)


