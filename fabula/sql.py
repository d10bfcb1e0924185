"""The library's rules as SQL functions and table functions of a session.

    register(spark)
    spark.sql("SELECT doc_id, narrative_clean(text) FROM documents")
    spark.sql("SELECT * FROM narrative_top(10)")       -- after publish(scored)

They are expressions that Catalyst inlines, as the Column builders are: no Python runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .lexicon import PLANS
from .operators.compare import WEIGHTS

#: The view that narrative_top reads.
PARTS = "narrative_parts"

_QUOTA = "CASE plan " + " ".join(f"WHEN '{name}' THEN element_at(array({day}, {month}), which)" for name, (day, month) in PLANS.items()) + f" ELSE element_at(array({PLANS['starter'][0]}, {PLANS['starter'][1]}), which) END"

#: which: 1 a day, 2 a month.
SCALAR = {
    "narrative_clean(t STRING) RETURNS STRING": r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, r'\r\n?', '\n'), r'[\x00-\x08\x0B-\x1F\x7F]', ''), r'[ \t]+', ' '), r'\n{3,}', '\n\n'), r'(?U)^\s+|\s+$', '')""",
    "narrative_words(t STRING) RETURNS INT": r"regexp_count(t, r'(?U)\S+')",
    "narrative_tokens(t STRING) RETURNS INT": "CAST(length(t) / 4 * 1.20 AS INT)",
    "narrative_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "coalesce(size(array_intersect(a, b)) / nullif(size(array_union(a, b)), 0), 0D)",
    "narrative_score(s_iso DOUBLE, s_ged DOUBLE, s_func DOUBLE, s_act DOUBLE, s_tens DOUBLE) RETURNS DOUBLE": " + ".join(f"{w}D * {n}" for n, w in WEIGHTS),
    "narrative_level(srj DOUBLE) RETURNS STRING": "CASE WHEN srj < 0.25 THEN 'Faible' WHEN srj < 0.55 THEN 'Modéré' WHEN srj < 0.80 THEN 'Élevé' ELSE 'Critique' END",
    "narrative_quota(plan STRING, which INT) RETURNS INT": _QUOTA,
}
TABLE = {
    "narrative_top(k INT) RETURNS TABLE (ref_id BIGINT, place INT, cand_id BIGINT, sns DOUBLE)": f"""SELECT ref_id, place, cand_id, sns FROM (
        SELECT ref_id, cand_id, sns, CAST(row_number() OVER (PARTITION BY ref_id ORDER BY round(sns, 9) DESC, cand_id) AS INT) AS place
        FROM (SELECT ref_id, cand_id, narrative_score({", ".join(n for n, _ in WEIGHTS)}) AS sns FROM {PARTS})) WHERE place <= narrative_top.k""",
}


def register(spark: SparkSession) -> None:
    """Makes the scalar functions of the session."""
    for head, body in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def publish(scored: DataFrame) -> None:
    """Makes the table functions over pairs with their component scores (ref_id, cand_id, s_iso, ...)."""
    register(scored.sparkSession)
    scored.select("ref_id", "cand_id", *[n for n, _ in WEIGHTS]).createOrReplaceTempView(PARTS)
    for head, body in TABLE.items():
        scored.sparkSession.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
