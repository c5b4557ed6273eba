"""Chat formatting by tool-call linking, in DataFrame operations only.

link() joins calls and results by identifier, orders the calls topologically along the calls they depend on, validates
their arguments against a schema and serialises each exchange as canonical JSON (keys sorted at all depths, no white space,
shortest escapes; numbers as the variant type writes them). The order of a call is its number of ancestors; it is found by pointer doubling, so a chain of n calls takes
log2(n) joins, and a call that never reaches a first call is part of, or hangs on, a cycle.

Defined results: calls that share an identifier are one call (its least turn, then its least name, parent and arguments;
n_calls says how many); results that share one are one result (the least text; n_results); with variants, as the query
has them, all that differ stay (see link()); a result without its call and a
call without its result stay, as "orphan" and "pending"; a row without identifier is "unlinked"; a parent that does not exist
makes a call a first call; null arguments fail validation; arguments that are no JSON fail it too and are written as a JSON
string of their text; null texts are JSON null; texts of any length are kept whole; an empty table stays empty; other columns,
whatever their names, are not carried. Joins are by identifier, never by conversation, so a conversation that holds a third of
all rows is not one task's.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Fixed values of JSON's short escapes; other control characters are written \\u00xx.
SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def json_string(text: Column) -> Column:
    """A JSON string, or null."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    plain = out
    for c in range(32):
        out = F.replace(out, F.lit(chr(c)), F.lit(SHORT.get(c, f"\\u{c:04x}")))
    out = F.when(text.rlike("[\\x00-\\x1f]"), out).otherwise(plain)
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def json_object(fields: dict[str, Column]) -> Column:
    """Canonical JSON of JSON texts by key."""
    parts = [F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


#: Control characters whose \\u escape has a letter; to_json() writes them in upper case.
LETTERED = [c for c in range(32) if c not in SHORT and f"{c:02x}"[1] in "abcdef"]


def canonical(text: Column) -> Column:
    """JSON of a JSON text with its keys sorted at all depths (by UTF-16 units), without white space; of a text that is no JSON, a JSON string."""
    out = F.to_json(F.try_parse_json(text))
    plain = out
    for c in LETTERED:
        out = F.regexp_replace(out, rf"((?<!\\)(?:\\\\)*+)\\u{c:04X}", rf"$1\\u{c:04x}")
    return F.coalesce(F.when(plain.rlike(r"\\u00[01][A-F]"), out).otherwise(plain), json_string(text))


#: Names of variant types that satisfy each schema type; an integer is any number without a fraction.
TYPES = {"string": "^STRING$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT.*", "array": "^ARRAY.*", "null": "^VOID$"}


def _is(kind: Column, number: Column, wanted: str) -> Column:
    if wanted == "integer":
        return kind.rlike(TYPES["number"]) & (number % F.lit(1.0) == 0)
    return kind.rlike(TYPES[wanted])


def _step(key: str) -> str:
    return f'$["{key}"]' if "'" in key else f"$['{key}']"


def _faults(value: Column, rule: dict, path: str) -> list[Column]:
    """One text or null for each demand of the rule on a variant; a value that is not there has no faults."""
    name, kind = path or "arguments", F.schema_of_variant(value)
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    fits = _is(kind, number, rule["type"]) if "type" in rule else F.lit(True)
    good, out = value.isNotNull() & fits, [F.when(value.isNotNull() & ~fits, F.lit(f"{name}: not {rule.get('type')}"))]

    def demand(key: str, fails, message: str, types: str) -> None:
        if key in rule:
            out.append(F.when(good & kind.rlike(types) & fails(rule[key]), F.lit(f"{name}: {message}")))

    demand("minLength", lambda n: F.length(text) < n, "too short", TYPES["string"])
    demand("maxLength", lambda n: F.length(text) > n, "too long", TYPES["string"])
    demand("minimum", lambda n: number < n, "too small", TYPES["number"])
    demand("maximum", lambda n: number > n, "too large", TYPES["number"])
    demand("enum", lambda xs: ~F.to_json(value).isin(*[json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in xs]), "not allowed", ".")
    properties = rule.get("properties", {})
    for key in sorted({*properties, *rule.get("required", ())}):
        below = f"{path}.{key}" if path else key
        child = F.try_variant_get(value, _step(key), "variant")
        if key in rule.get("required", ()):
            out.append(F.when(good & child.isNull(), F.lit(f"{below}: missing")))
        out += _faults(child, properties.get(key, {}), below)
    if rule.get("additionalProperties") is False:
        known = F.array(*map(F.lit, sorted(properties))).cast("array<string>")
        extra = F.array_sort(F.array_except(F.json_object_keys(F.to_json(value)), known))
        out.append(F.when(good & kind.rlike(TYPES["object"]) & (F.size(extra) > 0), F.concat(F.lit(f"{path}: " if path else ""), F.array_join(extra, ","), F.lit(": unknown"))))
    if "items" in rule:
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.concat_ws(";", *_faults(x, rule["items"], f"{path}[]")))
        bad = F.filter(each, lambda x: x != "")
        out.append(F.when(good & (F.size(bad) > 0), F.array_join(bad, ";")))
    return out


def violations(arguments: Column, schema: dict) -> Column:
    """The faults of JSON arguments under a schema, joined by ';'; nested objects and the items of arrays are validated too.

    Of JSON Schema: type, properties, required, additionalProperties (false), items, enum, minLength, maxLength, minimum, maximum.
    """
    v = F.try_parse_json(arguments)
    return F.when(v.isNull(), F.lit("no JSON object")).otherwise(F.concat_ws(";", *_faults(v, schema, "")))


def order(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """topo_order (number of ancestors; null on a cycle) of calls (call_id, parent_id), by pointer doubling."""
    known = calls.select(F.col("call_id").alias("parent_id"))
    now = calls.join(known, "parent_id", "left_semi").select("call_id", F.col("parent_id").alias("jump"), F.lit(1).cast("long").alias("far"))
    first = calls.join(now.select("call_id"), "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("topo_order"))
    done, now = [scratch.table(first, "first")], scratch.table(now, "jumps")
    n, rounds = now.count(), 0
    most = (n + 1).bit_length() + 1  # no chain is longer than n + 1: what is left after so many doublings hangs on a cycle
    while n and rounds < most:
        at = reduce(DataFrame.unionByName, done).select(F.col("call_id").alias("jump"), "topo_order")
        hit = now.join(at, "jump").select("call_id", (F.col("far") + F.col("topo_order")).alias("topo_order"))
        on = now.select(F.col("call_id").alias("jump"), F.col("jump").alias("next"), F.col("far").alias("more"))
        rest = now.join(on, "jump").select("call_id", F.col("next").alias("jump"), (F.col("far") + F.col("more")).alias("far"))
        found, new = scratch.table(hit, "ordered"), scratch.table(rest, "jumps")
        done.append(found)
        scratch.drop(now)
        now, n, rounds = new, new.count(), rounds + 1
    return reduce(DataFrame.unionByName, done).unionByName(now.select("call_id", F.lit(None).cast("long").alias("topo_order")))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], variants: bool = False) -> DataFrame:
    """calls: call_id, parent_id, conv_id, turn, name, arguments (JSON). results: call_id, conv_id, turn, text. Other columns are not carried.

    One row per call, orphan result or unlinked row: call_id, conv_id, call_turn, result_turn, name, status, topo_order, valid,
    violations, n_calls, n_results, json. With variants, only equal calls, and equal results, of one identifier are one; if
    several are left, each has a row of its own of status "conflict": beside the other side's if that is one, else alone.
    n_calls and n_results then count the equal ones.
    """
    scratch = Scratch(calls.sparkSession, "chat")
    least = F.min(F.struct("turn", "conv_id", "name", "parent_id", "arguments")).alias("c")
    one = calls.where("call_id is not null").groupBy("call_id").agg(least, F.count("*").alias("n_calls"))
    one = one.select("call_id", "n_calls", F.col("c.turn").alias("call_turn"), F.col("c.conv_id").alias("call_conv"), F.col("c.name").alias("name"), F.col("c.parent_id").alias("parent_id"), F.col("c.arguments").alias("arguments"))
    one = scratch.table(one, "calls")
    answer = results.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("text", "turn", "conv_id")).alias("r"), F.count("*").alias("n_results"))
    answer = answer.select("call_id", "n_results", F.col("r.text").alias("result"), F.col("r.turn").alias("result_turn"), F.col("r.conv_id").alias("result_conv"))
    ordered = order(one.select("call_id", "parent_id"), scratch)
    if variants:
        every = calls.where("call_id is not null").groupBy("call_id", F.col("turn").alias("call_turn"), F.col("conv_id").alias("call_conv"), "name", "parent_id", "arguments").agg(F.count("*").alias("n_calls"))
        every = scratch.table(every, "each_call")
        replies = results.where("call_id is not null").groupBy("call_id", F.col("text").alias("result"), F.col("turn").alias("result_turn"), F.col("conv_id").alias("result_conv")).agg(F.count("*").alias("n_results"))
        replies = scratch.table(replies, "each_result")
        many = every.groupBy("call_id").agg(F.count("*").alias("of_calls")).join(replies.groupBy("call_id").agg(F.count("*").alias("of_results")), "call_id", "full")
        many = many.where("of_calls > 1 or of_results > 1").select("call_id", F.coalesce((F.col("of_calls") > 1) & (F.col("of_results") > 1), F.lit(False)).alias("apart"), F.lit(True).alias("conflict"))
        many = scratch.table(many, "conflicts")
        # several calls and several results of one identifier are not multiplied: each side keeps to itself
        left = every.join(ordered, "call_id").join(many, "call_id", "left").withColumn("side", F.when(F.col("apart"), "call").otherwise("both")).drop("apart")
        right = replies.join(many, "call_id", "left").withColumn("side", F.when(F.col("apart"), "result").otherwise("both")).drop("apart").withColumnRenamed("conflict", "conflict_")
        both = left.join(right, ["call_id", "side"], "full").withColumn("conflict", F.coalesce("conflict", "conflict_")).drop("side", "conflict_")
    else:
        both = one.join(ordered, "call_id").join(answer, "call_id", "full").withColumn("conflict", F.lit(False))
    loose = calls.where("call_id is null").select(F.col("conv_id").alias("call_conv"), F.col("turn").alias("call_turn"), "name", "arguments")
    lone = results.where("call_id is null").select(F.col("conv_id").alias("result_conv"), F.col("turn").alias("result_turn"), F.col("text").alias("result"))
    both = both.unionByName(loose, allowMissingColumns=True).unionByName(lone, allowMissingColumns=True)
    is_call = F.col("call_turn").isNotNull() | F.col("name").isNotNull() | F.col("arguments").isNotNull() | F.col("n_calls").isNotNull()
    fault, rules = F.lit("no schema"), {}
    for name, schema in schemas.items():  # names of equal schemas are validated by one expression
        rules.setdefault(json.dumps(schema, sort_keys=True), (schema, []))[1].append(name)
    for schema, names in rules.values():
        fault = F.when(F.col("name").isin(*names), violations(F.col("arguments"), schema)).otherwise(fault)
    status = F.when(F.col("call_id").isNull(), "unlinked").when(F.col("conflict"), "conflict").when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "pending").otherwise("linked")
    body = json_object({"id": json_string(F.col("call_id")), "name": json_string(F.col("name")), "arguments": canonical(F.col("arguments")), "result": json_string(F.col("result"))})
    return both.withColumn("faults", F.when(is_call, fault)).select(
        "call_id",
        F.coalesce("call_conv", "result_conv").alias("conv_id"),
        "call_turn",
        "result_turn",
        "name",
        status.alias("status"),
        "topo_order",
        (F.col("faults") == "").alias("valid"),
        F.col("faults").alias("violations"),
        F.coalesce("n_calls", F.lit(0).cast("long")).alias("n_calls"),
        F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"),
        body.alias("json"),
    )


#: The schema of the exchanges of a conversation: a prompt of 1 to 2000 characters at a turn from 0 on.
PROMPT_SCHEMA = {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 2000}, "turn": {"type": "integer", "minimum": 0}, "system": {"type": "string"}}}


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A conversation as calls and results: each turn that is not the assistant's calls for the assistant's next turn.

    A user turn t is a call "reply" of identifier conv:t, depending on conv:t-2; a system turn is a call "setup" that nothing
    answers; an assistant turn t is the result of conv:t-1. Roles beside these are calls of their own name.
    """
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    role = F.coalesce("role", F.lit("none"))
    name = F.when(role == "user", "reply").when(role == "system", "setup").otherwise(role)
    arguments = json_object({"prompt": json_string(F.col("text")), "turn": json_number(turn)})
    said = conversations.where(role != "assistant").select(F.concat(conv, F.lit(":"), turn).alias("call_id"), F.when(role == "user", F.concat(conv, F.lit(":"), turn - 2)).alias("parent_id"), "conv_id", "turn", name.alias("name"), arguments.alias("arguments"))
    answered = conversations.where(role == "assistant").select(F.concat(conv, F.lit(":"), turn - 1).alias("call_id"), "conv_id", "turn", "text")
    return said, answered


def format_conversations(conversations: DataFrame, variants: bool = False) -> DataFrame:
    """The exchanges of conversations, linked. As the table has no tool calls, its turns are taken as such (see exchanges())."""
    said, answered = exchanges(conversations)
    return link(said, answered, {"reply": PROMPT_SCHEMA, "setup": PROMPT_SCHEMA}, variants)


def _sql_string(text: str) -> str:
    out = f"replace(replace({text}, '\\', '\\\\'), '\"', '\\\"')"
    for c in range(1, 32):
        out = f"replace({out}, chr({c}), '{SHORT.get(c, f'\\u{c:04x}')}')"
    return f"coalesce('\"' || {out} || '\"', 'null')"


#: format_conversations() with variants in DuckDB. Calls depend on the turn before last, so a chain is a run of turns two apart.
SQL = f"""
WITH c AS (
  SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 'reply' WHEN 'system' THEN 'setup' ELSE coalesce(role, 'none') END AS name, coalesce(role, '') = 'assistant' AS answers FROM conversations
), each_call AS (
  SELECT conv_id || ':' || turn AS call_id, turn AS call_turn, conv_id, name, text, count(*) AS n_calls
  FROM c WHERE NOT answers AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), each_result AS (
  SELECT conv_id || ':' || (turn - 1) AS call_id, turn AS result_turn, conv_id AS result_conv, text AS result, count(*) AS n_results
  FROM c WHERE answers AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), said AS (
  SELECT call_id, any_value(call_turn) AS call_turn, any_value(conv_id) AS conv_id, min(name) AS name, count(*) AS of_calls FROM each_call GROUP BY call_id
), marked AS (
  SELECT *, CASE WHEN name = 'reply' AND lag(call_turn) OVER w = call_turn - 2 THEN 0 ELSE 1 END AS starts
  FROM said WINDOW w AS (PARTITION BY conv_id, call_turn % 2 ORDER BY call_turn)
), runs AS (
  SELECT *, sum(starts) OVER (PARTITION BY conv_id, call_turn % 2 ORDER BY call_turn) AS run FROM marked
), ordered AS (
  SELECT call_id, of_calls, row_number() OVER (PARTITION BY conv_id, call_turn % 2, run ORDER BY call_turn) - 1 AS topo_order FROM runs
), many AS (
  SELECT coalesce(o.call_id, r.call_id) AS call_id, coalesce(of_calls, 0) > 1 OR coalesce(of_results, 0) > 1 AS conflict, coalesce(of_calls, 0) > 1 AND coalesce(of_results, 0) > 1 AS apart
  FROM ordered o FULL JOIN (SELECT call_id, count(*) AS of_results FROM each_result GROUP BY call_id) r ON o.call_id = r.call_id
), calls AS (
  SELECT e.*, topo_order, conflict, CASE WHEN apart THEN 'call' ELSE 'both' END AS side FROM each_call e JOIN ordered USING (call_id) JOIN many USING (call_id)
), results AS (
  SELECT e.*, conflict, CASE WHEN apart THEN 'result' ELSE 'both' END AS side FROM each_result e JOIN many USING (call_id)
), joined AS (
  SELECT coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.conv_id, r.result_conv) AS conv_id, call_turn, result_turn, name,
         CASE WHEN coalesce(c.conflict, r.conflict) THEN 'conflict' WHEN n_calls IS NULL THEN 'orphan' WHEN n_results IS NULL THEN 'pending' ELSE 'linked' END AS status,
         topo_order, n_calls IS NOT NULL AS is_call, text, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results, result
  FROM calls c FULL JOIN results r ON c.call_id = r.call_id AND c.side = r.side
  UNION ALL
  SELECT NULL, conv_id, CASE WHEN NOT answers THEN turn END, CASE WHEN answers THEN turn END, CASE WHEN NOT answers THEN name END, 'unlinked', NULL, NOT answers,
         CASE WHEN NOT answers THEN text END, 0, 0, CASE WHEN answers THEN text END
  FROM c WHERE conv_id IS NULL OR turn IS NULL
), both_ AS (
  SELECT *, CASE WHEN NOT is_call THEN NULL WHEN name NOT IN ('reply', 'setup') THEN 'no schema'
                 ELSE concat_ws(';', CASE WHEN text IS NULL THEN 'prompt: not string' WHEN length(text) < 1 THEN 'prompt: too short' WHEN length(text) > 2000 THEN 'prompt: too long' END,
                                     CASE WHEN call_turn IS NULL THEN 'turn: not integer' WHEN call_turn < 0 THEN 'turn: too small' END) END AS violations,
         CASE WHEN NOT is_call THEN 'null' ELSE '{{"prompt":' || {_sql_string("text")} || ',"turn":' || coalesce(call_turn::VARCHAR, 'null') || '}}' END AS arguments
  FROM joined
)
SELECT call_id, conv_id, call_turn, result_turn, name, status, topo_order, violations = '' AS valid, violations, n_calls, n_results,
       '{{"arguments":' || arguments || ',"id":' || {_sql_string("call_id")} || ',"name":' || {_sql_string("name")} || ',"result":' || {_sql_string("result")} || '}}' AS json
FROM both_
"""
