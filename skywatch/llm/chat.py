"""Operator 6: linking tool calls and results into canonical chat lines.

Calls and results are hash-joined by identifier, calls are ordered
topologically by the call each builds on, arguments are validated against the
tools' schemas, and every linked call is written as one canonical JSON line
(keys sorted, no white space, duplicates of keys refused by the parser).

Everything is DataFrame functions. No window or list is taken over a
conversation (one may hold a third of all rows): identifiers are made unique
by a partial aggregate, so the join is one to one; depths come from pointer
jumping along ``after`` links, log2(longest chain) rounds of an equi-join on
identifiers, each round written to the checkpoint folder.

Messages: (conv_id, turn, kind, call_id, tool, after, payload); ``kind`` is
``call`` (payload: JSON arguments, ``after``: the call whose result it uses)
or ``result`` (payload: content). Result: one row per identifier of a
conversation, plus one per message without identifier:

* ``status``: ``ok``; ``invalid`` (see ``errors``); ``dangling`` (no result);
  ``orphan`` (no call); ``cycle`` (its chain of calls never ends);
  ``unlinked`` (no identifier, or a kind that is neither). The first that
  holds of unlinked, orphan, cycle, invalid, dangling, ok.
* ``level``: number of calls before it in its chain; a link to an unknown
  call counts as none; null for cycles, orphans and unlinked messages.
  Ordering a conversation by (level, turn) puts every call after those it
  builds on.
* ``copies``: number of messages dropped as repeats of its identifier
  (of several calls or results the one of the smallest turn, then smallest
  payload, is used; null turns count as last).

Cases: null conv_id is a conversation of its own; null payloads are null
arguments (not JSON) or an absent result text; an unknown tool is an error;
empty tables give an empty result; texts of any
length stay in the JVM; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skywatch.llm.common import materialize, table

# JSON type -> how a variant's schema prints it (prefix)
_PRINTED = {"integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "string": ("STRING",), "boolean": ("BOOLEAN",),
            "array": ("ARRAY",), "object": ("OBJECT",)}

# The tools of the registered query: field -> (JSON type, required)
TOOLS = {
    "lookup": {"limit": ("integer", True), "query": ("string", True)},
    "measure": {"chars": ("integer", True), "query": ("string", True), "unit": ("string", False)},
    "translate": {"query": ("string", True), "to": ("string", True)},
}


def _errors(tool: Column, args: Column, raw: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """The array of what is wrong with the arguments, in a fixed order."""
    per_tool = F.array(F.lit("unknown tool")).cast("array<string>")
    keys = F.json_object_keys(raw)
    for name, fields in schemas.items():
        checks = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(args, f"$['{field}']", "variant")
            printed = F.schema_of_variant(value)
            right = F.lit(False)
            for p in _PRINTED[kind]:
                right = right | printed.startswith(p)
            absent = value.isNull() | (printed == "VOID")
            checks.append(F.when(absent, F.lit(f"{field}: missing") if required else F.lit(None)).when(~right, F.lit(f"{field}: not {kind}")))
        extra = F.transform(F.array_sort(F.array_except(keys, F.array(*[F.lit(f) for f in sorted(fields)]))), lambda k: F.concat(k, F.lit(": unknown field")))
        found = F.concat(F.array_compact(F.array(*checks)), extra) if checks else extra
        per_tool = F.when(tool == name, found).otherwise(per_tool)
    broken = args.isNull() | ~F.schema_of_variant(args).startswith("OBJECT")
    return F.when(broken, F.array(F.lit("not a JSON object"))).otherwise(per_tool)


def levels(calls: DataFrame) -> DataFrame:
    """(key, level, cycle) from (key, parent): depth in the forest of parents, by pointer jumping."""
    known = calls.select(F.col("key").alias("k2"))
    state = calls.join(known, F.col("parent") == F.col("k2"), "left") \
        .select("key", F.col("k2").alias("up"), F.when(F.col("k2").isNull(), 0).otherwise(1).cast("long").alias("level"))
    state = materialize(state, "chat-levels")
    rounds, n = 0, None
    while True:
        left, total = state.agg(F.count("up"), F.count(F.lit(1))).first()
        n = total if n is None else n
        if not left or rounds > math.ceil(math.log2(max(n, 2))):
            break
        # the few still climbing look up where their ancestor has got to
        upper = state.select(F.col("key").alias("k2"), F.col("up").alias("up2"), F.col("level").alias("level2"))
        state = materialize(state.join(upper, F.col("up") == F.col("k2"), "left").select(
            "key", F.col("up2").alias("up"), (F.col("level") + F.coalesce("level2", F.lit(0))).alias("level")), "chat-levels")
        rounds += 1
    return state.select("key", F.when(F.col("up").isNull(), F.col("level")).alias("level"), F.col("up").isNotNull().alias("cycle"))


def link_tool_calls(messages: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] | None = None) -> DataFrame:
    """conv_id, call_id, turn, result_turn, name, level, status, errors, copies, line."""
    schemas = TOOLS if schemas is None else schemas
    m = messages.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), "kind", F.col("call_id").cast("string").alias("call_id"),
                        "tool", F.col("after").cast("string").alias("after"), "payload")
    linkable = F.col("call_id").isNotNull() & F.coalesce(F.col("kind").isin("call", "result"), F.lit(False))
    key = F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null")), F.col("call_id"))
    good = m.where(linkable).withColumn("key", key)
    order = F.struct(F.col("turn").isNull().alias("late"), "turn", F.coalesce("payload", F.lit("")).alias("p"), "payload", "tool", "after")
    calls = good.where("kind = 'call'").groupBy("key", "conv_id", "call_id").agg(F.min(order).alias("call"), F.count(F.lit(1)).alias("n_calls"))
    results = good.where("kind = 'result'").groupBy("key", "conv_id", "call_id").agg(F.min(order).alias("result"), F.count(F.lit(1)).alias("n_results"))
    calls, results = materialize(calls, "chat-calls"), materialize(results, "chat-results")
    parent = F.concat_ws("\x1f", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null")), F.col("call.after"))
    depth = levels(calls.select("key", F.when(F.col("call.after").isNotNull(), parent).alias("parent"))).withColumnRenamed("key", "d_key")
    r = results.select(F.col("key").alias("r_key"), F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), "result", "n_results")
    both = calls.join(depth, F.col("key") == F.col("d_key"), "left").hint("shuffle_hash") \
        .join(r.hint("shuffle_hash"), F.col("key") == F.col("r_key"), "full")
    both = both.withColumn("args", F.try_parse_json("call.payload"))
    errors = F.when(F.col("key").isNotNull(), _errors(F.coalesce("call.tool", F.lit("")), F.col("args"), F.col("call.payload"), schemas))
    both = both.withColumn("errors", F.coalesce(errors, F.array().cast("array<string>")))
    status = F.when(F.col("key").isNull(), "orphan").when(F.col("cycle"), "cycle").when(F.size("errors") > 0, "invalid") \
        .when(F.col("r_key").isNull(), "dangling").otherwise("ok")
    call_id = F.coalesce("call_id", "r_call")
    args = F.coalesce(F.concat(F.lit('"arguments":'), F.to_json("args")), _member("arguments", F.col("call.payload")))
    line = F.concat(
        F.lit("{"), F.concat_ws(",", args, _member("id", call_id), _member("name", F.col("call.tool")), _member("result", F.col("result.payload"))), F.lit("}"))
    linked = both.select(
        F.coalesce("conv_id", "r_conv").alias("conv_id"), call_id.alias("call_id"), F.col("call.turn").alias("turn"),
        F.col("result.turn").alias("result_turn"), F.col("call.tool").alias("name"), F.col("level"), status.alias("status"), "errors",
        (F.greatest(F.coalesce("n_calls", F.lit(1)) - 1, F.lit(0)) + F.greatest(F.coalesce("n_results", F.lit(1)) - 1, F.lit(0))).cast("long").alias("copies"),
        line.alias("line"))
    rest = m.where(~linkable).select(
        "conv_id", "call_id", "turn", F.lit(None).cast("long").alias("result_turn"), F.col("tool").alias("name"), F.lit(None).cast("long").alias("level"),
        F.lit("unlinked").alias("status"), F.array().cast("array<string>").alias("errors"), F.lit(0).cast("long").alias("copies"),
        F.concat(F.lit("{"), F.concat_ws(",", _member("id", F.col("call_id")), _member("name", F.col("tool")), _member("text", F.col("payload"))), F.lit("}")).alias("line"))
    return linked.unionByName(rest)


def _member(name: str, value: Column) -> Column:
    """``"name":value`` with JSON escapes; null (left out) for null."""
    whole = F.to_json(F.struct(value.alias(name)))
    return F.when(value.isNotNull(), whole.substr(F.lit(2), F.length(whole) - 2))


def tool_messages(conversations: DataFrame) -> DataFrame:
    """Tool traffic out of plain conversations (which hold none): each assistant turn is a call that builds on
    the call two turns before; every other turn is the result of the call of the turn before."""
    is_call = F.coalesce(F.col("role") == "assistant", F.lit(False))
    n = F.length("text")
    args = F.when(F.pmod("turn", F.lit(3)) == 0, F.to_json(F.struct(F.col("text").alias("query"), n.alias("limit")))) \
        .when(F.pmod("turn", F.lit(3)) == 1, F.to_json(F.struct(F.col("text").alias("query"), F.when(n % 2 == 0, n.cast("string")).otherwise(F.lit("many")).alias("unit"), n.alias("chars")))) \
        .otherwise(F.to_json(F.struct(F.when(n % 5 != 0, F.lit("en")).alias("to"), F.col("text").alias("query"))))
    tool = F.element_at(F.array(F.lit("lookup"), F.lit("measure"), F.lit("translate")), (F.pmod("turn", F.lit(3)) + 1).cast("int"))
    return conversations.select(
        "conv_id", "turn", F.when(is_call, "call").otherwise("result").alias("kind"),
        F.concat(F.lit("t"), F.when(is_call, F.col("turn")).otherwise(F.col("turn") - 1).cast("string")).alias("call_id"),
        F.when(is_call, tool).alias("tool"), F.when(is_call, F.concat(F.lit("t"), (F.col("turn") - 2).cast("string"))).alias("after"),
        F.when(is_call, args).otherwise(F.col("text")).alias("payload"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_tool_calls(tool_messages(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "call_id", "turn", "result_turn", "name", "level", "status", F.concat_ws("; ", "errors").alias("errors"), "copies", "line")


ORACLE_OP6 = """
WITH c AS (SELECT conv_id, turn, text, len(text) AS n, ((turn % 3) + 3) % 3 AS t3 FROM conversations WHERE role = 'assistant'),
isl AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM c),
calls AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level,
   CASE t3 WHEN 0 THEN 'lookup' WHEN 1 THEN 'measure' ELSE 'translate' END AS name,
   CASE t3 WHEN 0 THEN '{"limit":' || n || ',"query":' || to_json(text) || '}'
           WHEN 1 THEN '{"chars":' || n || ',"query":' || to_json(text) || ',"unit":"' || CASE WHEN n % 2 = 0 THEN n::VARCHAR ELSE 'many' END || '"}'
           ELSE '{"query":' || to_json(text) || CASE WHEN n % 5 <> 0 THEN ',"to":"en"' ELSE '' END || '}' END AS args,
   CASE WHEN t3 = 2 AND n % 5 = 0 THEN 'to: missing' ELSE '' END AS errors FROM isl),
r AS (SELECT conv_id, turn, text FROM conversations WHERE role IS DISTINCT FROM 'assistant')
SELECT coalesce(calls.conv_id, r.conv_id) AS conv_id, 't' || coalesce(calls.turn, r.turn - 1) AS call_id, calls.turn AS turn, r.turn AS result_turn,
  name, level, CASE WHEN calls.turn IS NULL THEN 'orphan' WHEN errors <> '' THEN 'invalid' WHEN r.turn IS NULL THEN 'dangling' ELSE 'ok' END AS status,
  coalesce(errors, '') AS errors, 0::BIGINT AS copies,
  '{' || concat_ws(',', '"arguments":' || args, '"id":"t' || coalesce(calls.turn, r.turn - 1) || '"', '"name":"' || name || '"', '"result":' || to_json(r.text)) || '}' AS line
FROM calls FULL JOIN r ON calls.conv_id = r.conv_id AND r.turn = calls.turn + 1
"""
