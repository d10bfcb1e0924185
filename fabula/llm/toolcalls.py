"""Tool-call linking in chats, in DataFrame functions only.

Calls and results meet in a hash join on (conv_id, call_id). A call may name the call whose result it
builds on; its level, the length of that chain, is found by pointer doubling (as many joins as the
logarithm of the longest chain), and (level, call_turn, call_id) is a topological order. Arguments are checked against a
schema for each tool, and records are serialised as canonical JSON: keys sorted, no blanks, numbers as written shortest.

Defined results: calls that repeat an identifier count once (the first by turn, then name and arguments; n_calls tells how many),
results likewise; a call without result is "open", a result without call "orphan"; a parent that isn't a call makes a
root; calls in a cycle, or behind one, have no level and are invalid; null or broken arguments are invalid; rows with a null
conv_id or identifier never meet. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

KEY = ["conv_id", "call_id"]
#: What schema_of_variant starts with, for JSON types.
_KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


def schema_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Messages about arguments against {tool: {field: (type, required)}}; fields beyond a tool's are errors."""
    value = F.try_parse_json(arguments)
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null"))))
    for tool, fields in schemas.items():
        checks = []
        for field, (kind, required) in fields.items():
            part = F.try_variant_get(value, f"$.{field}", "variant")
            fits = [F.schema_of_variant(part).startswith(k) for k in _KINDS[kind]]
            right = fits[0]
            for x in fits[1:]:
                right = right | x
            checks.append(F.when(part.isNull(), F.lit(f"missing {field}") if required else None).when(~right, F.lit(f"{field} is no {kind}")))
        beyond = F.transform(F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*[F.lit(f) for f in fields]).cast("array<string>")), lambda k: F.concat(F.lit("unknown field "), k))
        out = F.when(name == tool, F.concat(F.array_compact(F.array(*checks)).cast("array<string>"), beyond)).otherwise(out)
    broken = value.isNull() | ~F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return F.when(broken, F.array(F.lit("arguments are no JSON object"))).otherwise(out)


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and without blanks; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) for calls(conv_id, call_id, parent_id) with unique keys; level null in or behind a cycle."""
    shared_dir(calls.sparkSession)
    known = calls.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("known"))
    at = calls.join(known, ["conv_id", "parent_id"], "left").select(*KEY, F.when(F.col("known"), F.col("parent_id")).alias("ptr"), F.when(F.col("known"), 1).otherwise(0).alias("level")).checkpoint()
    n, open_ = at.agg(F.count("*"), F.count("ptr")).first()
    for _ in range(n.bit_length() + 1):
        if not open_:
            break
        to = at.select("conv_id", F.col("call_id").alias("ptr"), F.col("ptr").alias("next"), F.col("level").alias("more"))
        moved = at.where("ptr is not null").join(to, ["conv_id", "ptr"]).select(*KEY, F.col("next").alias("ptr"), (F.col("level") + F.col("more")).alias("level"))
        at = at.where("ptr is null").union(moved.select(*at.columns)).checkpoint()
        open_ = at.where("ptr is not null").count()
    return at.select(*KEY, F.when(F.col("ptr").isNull(), F.col("level")).alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """calls(conv_id, call_id, parent_id, turn, name, arguments) with results(conv_id, call_id, turn, content): one row for each identifier."""
    first = lambda df, *c: F.min(F.struct(*c)).alias("one")
    ask = calls.groupBy(*KEY).agg(first(calls, "turn", "name", "arguments", "parent_id"), F.count("*").alias("n_calls"))
    ask = ask.select(*KEY, F.col("one.turn").alias("call_turn"), "one.name", "one.arguments", "one.parent_id", "n_calls")
    answer = results.groupBy(*KEY).agg(first(results, "turn", "content"), F.count("*").alias("n_results")).select(*KEY, F.col("one.turn").alias("result_turn"), "one.content", "n_results")
    depth = levels(ask.select(*KEY, "parent_id").where("conv_id is not null and call_id is not null"))
    met = ask.join(answer, KEY, "full").join(depth, KEY, "left")
    errors = F.when(F.col("call_turn").isNull() & F.col("n_calls").isNull(), F.array(F.lit("no call"))).otherwise(
        F.concat(schema_errors(F.col("name"), F.col("arguments"), schemas), F.when(F.col("level").isNull(), F.array(F.lit("cyclic"))).otherwise(F.array().cast("array<string>")))
    )
    met = met.withColumn("errors", errors).withColumn("status", F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "open").otherwise("answered"))
    record = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), F.col("name"), F.col("content").alias("result")))
    return met.select(*KEY, "name", "level", "call_turn", "result_turn", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "status", (F.size("errors") == 0).alias("valid"), "errors", canonical(F.col("arguments")).alias("arguments"), record.alias("record"))


#: The tools of chat_calls.
CHAT_TOOLS = {"reply": {"text": ("string", True), "turn": ("integer", True), "words": ("integer", True)}, "configure": {"text": ("string", True), "turn": ("integer", True), "words": ("integer", True)}}


def chat_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a plain chat(conv_id, turn, role, text): a user's turn calls "reply", a system turn "configure", turns of over 150 words "lookup", which no
    schema knows; an assistant's turn is the result for the turn before it; a call builds on the call two turns before (turn 1: on turn 0).

    Arguments are as careless as a model's, by what the text holds: with a comma the number of words is a string, with a line break the turn is missing, a
    question adds a field "note"; a null text has no arguments.
    """
    name = lambda t: F.concat(F.lit("turn-"), t.cast("string"))
    turn = F.col("turn").cast("long")
    words = F.regexp_count("text", F.lit(r"\S+"))
    fields = lambda n: F.to_json(F.struct(F.when(F.col("text").endswith("?"), "asks").alias("note"), "text", F.when(~F.col("text").contains("\n"), turn).alias("turn"), n.alias("words")))
    arguments = F.when(F.col("text").contains(","), fields(words.cast("string"))).when(F.col("text").isNotNull(), fields(words))
    tool = F.when(words > 150, "lookup").when(F.col("role") == "user", "reply").when(F.col("role") == "system", "configure")
    calls = messages.where("role in ('user', 'system')").select("conv_id", name(turn).alias("call_id"), name(F.greatest(turn - 2, F.lit(0))).alias("parent_id"), turn.alias("turn"), tool.alias("name"), arguments.alias("arguments"))
    calls = calls.withColumn("parent_id", F.when(F.col("parent_id") != F.col("call_id"), F.col("parent_id")))
    results = messages.where("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), turn.alias("turn"), F.coalesce("text", F.lit("")).alias("content"))
    return calls, results
