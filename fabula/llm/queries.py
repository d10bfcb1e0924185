"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, mixing, negatives, passages, prefix_trie, quality, secrets, simhash, sketch, token_counts, token_store, toolcalls, warc

TOKENIZER = "byte_bpe_50k.json"
COUNTED = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents")).select("doc_id", "posterior", "score", "keep")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(_table(spark, sf_dir, "pages")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.chat_calls(_table(spark, sf_dir, "conversations"))
    linked = toolcalls.link_calls(calls, results, toolcalls.CHAT_TOOLS)
    digest = F.sha2("arguments", 256).alias("arguments_sha256")
    return linked.select("conv_id", "call_id", "name", F.col("level").cast("long").alias("level"), "call_turn", "result_turn", "status", "valid", digest, F.sha2("record", 256).alias("record_sha256"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "ordinal", F.sha2("candidate", 256).alias("candidate_sha256"), F.col("length").cast("long").alias("length"), F.round("score", 6).alias("score"), "is_secret")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edit_checks(_table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path(COUNTED))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_store": op2_token_store,
    "op3_simhash": op3_simhash,
    "op4_warc_derivatives": op4_warc_derivatives,
    "op5_mixing": op5_mixing,
    "op6_tool_calls": op6_tool_calls,
    "op7_passages": op7_passages,
    "op8_secrets": op8_secrets,
    "op9_winnowing": op9_winnowing,
    "op10_sketch": op10_sketch,
    "op11_token_counts": op11_token_counts,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}

_FOLD = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: CRC-32 of a decimal id, byte by byte and bit by bit.
_CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END))"

#: Hashes that the independent engine lacks (XXH64), trained models and tokenizers keep the others to tests against brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_tool_calls": r"""WITH RECURSIVE m AS (SELECT *, len(regexp_extract_all(text, '\S+')) AS n FROM conversations WHERE role IN ('user', 'system')),
c AS (SELECT conv_id, turn, CASE WHEN n > 150 THEN 'lookup' WHEN role = 'user' THEN 'reply' ELSE 'configure' END AS name, greatest(turn - 2, 0) AS up,
  '{' || CASE WHEN suffix(text, '?') THEN '"note":"asks",' ELSE '' END || '"text":' || CAST(to_json(text) AS VARCHAR) || CASE WHEN contains(text, chr(10)) THEN '' ELSE ',"turn":' || turn END || ',"words":' || CASE WHEN contains(text, ',') THEN '"' || n || '"' ELSE CAST(n AS VARCHAR) END || '}' AS args FROM m),
a AS (SELECT conv_id, turn - 1 AS turn, turn AS result_turn, CAST(to_json(coalesce(text, '')) AS VARCHAR) AS content FROM conversations WHERE role = 'assistant'),
d AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS level FROM c WHERE turn = 0 OR NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.up) UNION ALL SELECT c.conv_id, c.turn, d.level + 1 FROM c JOIN d ON d.conv_id = c.conv_id AND d.turn = c.up AND c.turn > 0)
SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, 'turn-' || coalesce(c.turn, a.turn) AS call_id, name, level, c.turn AS call_turn, result_turn, CASE WHEN name IS NULL THEN 'orphan' WHEN result_turn IS NULL THEN 'open' ELSE 'answered' END AS status, coalesce(name IN ('reply', 'configure') AND json_type(args, '$.text') = 'VARCHAR' AND json_type(args, '$.turn') IN ('UBIGINT', 'BIGINT') AND json_type(args, '$.words') IN ('UBIGINT', 'BIGINT') AND len(list_filter(json_keys(args), lambda k: k NOT IN ('text', 'turn', 'words'))) = 0, false) AS valid, sha256(args) AS arguments_sha256,
sha256('{' || CASE WHEN args IS NULL THEN '' ELSE '"arguments":' || args || ',' END || '"id":"turn-' || coalesce(c.turn, a.turn) || '"' || CASE WHEN name IS NULL THEN '' ELSE ',"name":"' || name || '"' END || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || content END || '}') AS record_sha256
FROM c FULL JOIN a ON a.conv_id = c.conv_id AND a.turn = c.turn LEFT JOIN d ON d.conv_id = c.conv_id AND d.turn = c.turn""",
    "op9_winnowing": f"""WITH b AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM (SELECT item_id, {_WORDS.format('text')} AS ws FROM benchmark) WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i + 1:i + n], ' ') AS win FROM (SELECT item_id, ws, n, unnest(range(len(ws) - n + 1)) AS i FROM b)),
k AS (SELECT DISTINCT n FROM b), d AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i + 1:i + n], ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(greatest(len(ws) - n + 1, 0))) AS i FROM d, k)),
h AS (SELECT doc_id, item_id, dw.n AS n, i FROM dw JOIN bw ON bw.n = dw.n AND bw.win = dw.win),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op12_prefix_trie": f"""WITH t AS (SELECT conv_id, text, sha256(length(role) || ':' || role || text) AS digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos
FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
h AS (SELECT conv_id, xor({_CRC}, CAST(4294967295 AS BIGINT)) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT h.conv_id, pos, digest, length(text) AS n FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 100 AND pos <= h UNION ALL SELECT h.conv_id, pos, digest, length(text) FROM h JOIN t ON t.conv_id = h.conv_id AND pos > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS key, n FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos) UNION ALL SELECT conv_id, 0, '', 0 FROM h),
v AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS own FROM p GROUP BY key, depth),
e AS (SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM p WHERE depth = (SELECT max(depth) FROM p q WHERE q.conv_id = p.conv_id) GROUP BY key),
c AS (SELECT v.key, count(u.key) AS n_children FROM v LEFT JOIN v u ON u.depth = v.depth + 1 AND starts_with(u.key, v.key) GROUP BY v.key),
s AS (SELECT v.key, count(*) FILTER (u.n_children = 0) AS n_leaves, sum(u.own) AS saved FROM v JOIN (SELECT v.key, own, n_children FROM v JOIN c ON c.key = v.key) u ON starts_with(u.key, v.key) GROUP BY v.key)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN c ON c.key = v.key JOIN s ON s.key = v.key LEFT JOIN e ON e.key = v.key LEFT JOIN v u ON u.depth = v.depth - 1 AND starts_with(v.key, u.key)""",
    "op13_hard_negatives": """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a, r b WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, score FROM s WHERE same AND a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) QUALIFY row_number() OVER w <= 5""",
}
