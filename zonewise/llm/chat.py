"""Chat formatting with tool calls, in DataFrame functions only.

An assistant's message whose text is a JSON object with calls
(``{"content": ..., "tool_calls": [{"id", "name", "arguments"}]}``, or with name and
arguments under ``function``) carries tool calls, and a tool's message with
``{"tool_call_id": ..., "content": ...}`` a result; any other text, whoever wrote it, is
the content itself. Calls and results are linked by a hash join on conversation and call id.

Messages are put in topological order: a result stands after its call, and a call
whose arguments mention ``${id}`` stands after the result of call ``id``. The order
is a key, (anchor, depth): anchor is the latest turn that the message has to wait
for, its own included, and depth counts the steps that wait within that turn. So a
conversation in order keeps its order, and no conversation has to be gathered to
be ranked, however long it is. A conversation whose links all point forward in
time needs nothing else: its keys are (turn, 0). In the others keys are settled in rounds
from the messages that wait for nothing, as many as their longest chain has links.

Arguments are checked against the tools' JSON Schemas (type, required, properties,
additionalProperties, items, enum, minimum, maximum, pattern, at any depth). Each message becomes one line of
canonical JSON: keys sorted at every level, no spare blanks. Further fields of a message or
a call with tools are kept under ``extra``.

Defined cases: null text is null content; null turns stand first; null conversations
are one conversation; equal rows each come back; a call id that is used twice in a
conversation belongs to its first call, the later ones are ``duplicate_id``;
results without a call are ``unlinked``; calls without a result are ``unanswered``;
messages in a cycle, and those that wait for one, keep their own turn and are ``cyclic``; JSON that
can't be read, or has equal keys in an object, is content. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _object(required: tuple[str, ...] = (), **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(required), "additionalProperties": False}


#: JSON Schemas of the tools' arguments, by name.
TOOLS = {
    "search": _object(("query",), query={"type": "string"}, limit={"type": "integer", "minimum": 1}, sort={"enum": ["date", "rank"]}),
    "calculator": _object(("expression",), expression={"type": "string"}),
    "weather": _object(("city",), city={"type": "string"}, days={"type": "integer", "minimum": 1, "maximum": 14}, metric={"type": "boolean"}),
    "fetch": _object(("url",), url={"type": "string"}, headers={"type": "object"}),
    "run_code": _object(("language", "code"), language={"type": "string"}, code={"type": "string"}, args={"type": "array", "items": {"type": "string"}}),
}
#: Tools of a schema table; their checks become one expression.
MAX_TOOLS = 1000
#: How schema_of_variant writes the JSON types.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID"}
NONE = "array<string>"
#: The turn by which null turns are compared: they stand first.
FIRST = -(1 << 63)


def canonical(text: F.Column) -> F.Column:
    """JSON text with sorted keys and no spare blanks; null if it can't be read. Variant objects hold their keys sorted."""
    return F.to_json(F.try_parse_json(text))


def tools_of(table: DataFrame) -> dict:
    """Schemas by name from a table (name, schema as JSON text) of at most MAX_TOOLS rows; of rows with one name the least text counts."""
    rows = table.where("name IS NOT NULL AND schema IS NOT NULL").groupBy("name").agg(F.min("schema").alias("schema")).orderBy("name").limit(MAX_TOOLS + 1).collect()
    if len(rows) > MAX_TOOLS:
        raise ValueError(f"more than {MAX_TOOLS} tools")
    return {r["name"]: json.loads(r["schema"]) for r in rows}


def _strings(values: list[str]) -> F.Column:
    return F.array(*map(F.lit, values)).cast(NONE)


def violations(value: F.Column, schema: dict, path: str = "") -> F.Column:
    """Error texts of a variant: an array of strings like missing:a.b, extra:c, type:d[], enum:e, range:f, pattern:g."""
    none, at = F.array().cast(NONE), path or "."
    error = lambda name, bad: F.when(F.coalesce(bad, F.lit(False)), F.array(F.lit(f"{name}:{at}"))).otherwise(none)
    below = lambda key: f"{path}.{key}" if path else key
    checks = []
    if "enum" in schema:
        known = [json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in schema["enum"]]
        checks.append(error("enum", ~F.coalesce(F.to_json(value), F.lit("null")).isin(known)))
    number = F.try_variant_get(value, "$", "double")
    if "minimum" in schema or "maximum" in schema:
        checks.append(error("range", (number < F.lit(float(schema.get("minimum", "-inf")))) | (number > F.lit(float(schema.get("maximum", "inf"))))))
    if "pattern" in schema:
        checks.append(error("pattern", ~F.try_variant_get(value, "$", "string").rlike(schema["pattern"])))
    properties, required = schema.get("properties", {}), schema.get("required", [])
    if properties or required or schema.get("additionalProperties") is False:
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        keys = F.coalesce(F.map_keys(fields), none)
        is_object = F.schema_of_variant(value).rlike("^OBJECT")
        own = [F.transform(F.array_except(_strings(required), keys), lambda k: F.concat(F.lit("missing:" + below("")), k))]
        if schema.get("additionalProperties") is False:
            own.append(F.transform(F.array_except(keys, _strings(list(properties))), lambda k: F.concat(F.lit("extra:" + below("")), k)))
        own += [F.when(F.array_contains(keys, key), violations(F.element_at(fields, key), inner, below(key))).otherwise(none) for key, inner in properties.items()]
        checks.append(F.when(is_object, F.concat(*own)).otherwise(none))
    if "items" in schema:
        items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
        checks.append(F.when(F.schema_of_variant(value).rlike("^ARRAY"), F.array_distinct(F.flatten(F.transform(items, lambda x: violations(x, schema["items"], f"{path}[]"))))).otherwise(none))
    found = F.concat(none, *checks)
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        fits = F.coalesce(F.schema_of_variant(value).rlike("^(" + "|".join(KINDS[k] for k in kinds) + ")$"), F.lit("null" in kinds))
        found = F.when(fits, found).otherwise(F.array(F.lit(f"type:{at}")))
    return found


def argument_errors(name: F.Column, value: F.Column, tools: dict = TOOLS) -> F.Column:
    """Sorted error texts of a call's arguments, a variant: an array of strings. Null is text that can't be read."""
    out = F.array(F.lit("unknown_tool"))
    for tool, schema in tools.items():
        out = F.when(name == tool, F.array_sort(violations(value, schema))).otherwise(out)
    return F.when(value.isNull(), F.array(F.lit("not_json"))).when(~F.schema_of_variant(value).rlike("^OBJECT"), F.array(F.lit("not_object"))).otherwise(out)


def _rest(fields: F.Column, *known: str) -> F.Column:
    """What a map of variants holds beside these keys; null if nothing."""
    rest = F.map_filter(fields, lambda k, v: ~k.isin(*known))
    return F.when(F.size(rest) > 0, rest)


CALL = "struct<id:string,name:string,arguments:variant,raw:string,errors:array<string>,extra:map<string,variant>>"


def parsed(messages: DataFrame, tools: dict = TOOLS) -> tuple[DataFrame, DataFrame]:
    """The plain messages, and those with calls or results: conv_id, turn, role, key, content, tool_call_id, calls, extra."""
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    may = F.col("text").rlike(r"^\s*\{") & F.col("role").isin("assistant", "tool")
    body = F.when(F.coalesce(may, F.lit(False)), F.try_parse_json("text"))
    got = lambda path, kind: F.try_variant_get(body, path, kind)
    is_call = F.coalesce((F.col("role") == "assistant") & (F.size(F.filter(got("$.tool_calls", "array<variant>"), lambda c: c.isNotNull())) > 0), F.lit(False))
    is_result = F.coalesce((F.col("role") == "tool") & got("$.tool_call_id", "string").isNotNull(), F.lit(False))
    plain = rows.where(~(is_call | is_result))
    tooled = rows.where(is_call | is_result).withColumn("body", body)
    got = lambda path, kind: F.try_variant_get("body", path, kind)

    def call(c: F.Column) -> F.Column:
        name = F.coalesce(F.try_variant_get(c, "$.name", "string"), F.try_variant_get(c, "$.function.name", "string"))
        given = F.coalesce(F.try_variant_get(c, "$.arguments", "variant"), F.try_variant_get(c, "$.function.arguments", "variant"), F.parse_json(F.lit("{}")))
        said = F.when(F.schema_of_variant(given) == "STRING", F.try_variant_get(given, "$", "string"))
        value = F.when(said.isNull(), given).otherwise(F.try_parse_json(said))
        extra = _rest(F.try_variant_get(c, "$", "map<string,variant>"), "id", "name", "arguments", "function")
        return F.struct(
            F.try_variant_get(c, "$.id", "string").alias("id"), name.alias("name"), value.alias("arguments"), said.alias("raw"), argument_errors(F.coalesce(name, F.lit("")), value, tools).alias("errors"), extra.alias("extra")
        ).cast(CALL)

    called = F.when(F.col("role") == "assistant", F.transform(F.filter(got("$.tool_calls", "array<variant>"), lambda c: c.isNotNull()), call))
    tooled = tooled.select(
        "conv_id",
        "turn",
        "role",
        # equal rows have equal keys, others don't: absent fields leave their name out too
        F.sha2(F.to_json(F.struct("conv_id", "turn", "role", "text")), 256).alias("key"),
        got("$.content", "variant").alias("content"),
        F.when(F.col("role") == "tool", got("$.tool_call_id", "string")).alias("tool_call_id"),
        F.coalesce(called, F.array().cast(f"array<{CALL}>")).alias("calls"),
        _rest(got("$", "map<string,variant>"), "content", "tool_call_id", "tool_calls").alias("extra"),
    )
    return plain, cut_lineage(tooled)


def linked(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(owners, answers, edges): the first call of each id, the ids that have a result, and who waits for whom."""
    turn = F.coalesce("turn", F.lit(FIRST)).alias("turn")
    calls = rows.where(F.size("calls") > 0).select("conv_id", turn, "key", F.posexplode("calls").alias("at", "call"))
    calls = calls.select("conv_id", F.col("call.id").alias("id"), "turn", "at", "key", F.coalesce(F.to_json("call.arguments"), "call.raw").alias("arguments"))
    owners = calls.where("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "at", "key")).alias("first")).select("conv_id", "id", F.col("first.key").alias("call_key"), F.col("first.at").alias("call_at"), F.col("first.turn").alias("call_turn"))
    results = rows.where("tool_call_id is not null").select("conv_id", F.col("tool_call_id").alias("id"), "key", turn)
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["id"] == b["id"])
    edges = results.join(owners.hint("shuffle_hash"), same(results, owners))
    edges = edges.select(results["conv_id"], owners["call_key"].alias("before"), owners["call_turn"].alias("before_turn"), results["key"].alias("after"), results["turn"].alias("after_turn"))
    answers = results.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "key")).alias("first")).select("conv_id", "id", F.col("first.key").alias("result_key"), F.col("first.turn").alias("result_turn"))
    asked = calls.select("conv_id", "key", "turn", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r"\$\{([^}]+)\}"), 1))).alias("id"))
    waits = asked.join(answers.hint("shuffle_hash"), same(asked, answers))
    waits = waits.select(asked["conv_id"], answers["result_key"].alias("before"), answers["result_turn"].alias("before_turn"), asked["key"].alias("after"), asked["turn"].alias("after_turn"))
    return owners, answers, edges.unionByName(waits).where("before <> after").distinct()


#: Rounds whose settled messages are kept apart before they are written together.
ROUNDS = 16


def order_keys(edges: DataFrame) -> DataFrame:
    """key, anchor, depth, cyclic of the messages that wait for others, in conversations with a link that doesn't point forward."""
    edges = cut_lineage(edges)
    backward = edges.where("before_turn >= after_turn").select(F.col("conv_id").alias("late")).distinct()
    edges = cut_lineage(edges.join(backward, edges["conv_id"].eqNullSafe(backward["late"]), "left_semi"))
    state = "key string, turn long, open long, last struct<anchor: long, depth: int>"
    waiting = cut_lineage(edges.groupBy(F.col("after").alias("key"), F.col("after_turn").alias("turn")).agg(F.count("*").alias("open")).withColumn("last", F.lit(None).cast("struct<anchor: long, depth: int>")))
    sources = edges.select(F.col("before").alias("key"), F.col("before_turn").alias("anchor")).distinct().join(waiting, "key", "left_anti")
    settled = sources.select("key", "anchor", F.lit(0).alias("depth"))
    done = [settled.limit(0).withColumn("cyclic", F.lit(False))]
    while not waiting.isEmpty():
        told = edges.join(settled.select(F.col("key").alias("before"), "anchor", "depth"), "before").groupBy(F.col("after").alias("key"))
        told = told.agg(F.count("*").alias("n"), F.max(F.struct("anchor", "depth")).alias("new"))
        newest = F.greatest(F.col("last"), F.col("new"))
        waiting = cut_lineage(waiting.join(told, "key", "left").select("key", "turn", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), newest.alias("last")).to(_schema(state)))
        ready = waiting.where("open = 0")
        if ready.isEmpty():  # what is left waits for itself
            done.append(waiting.select("key", F.col("turn").alias("anchor"), F.lit(0).alias("depth"), F.lit(True).alias("cyclic")))
            break
        ahead = F.col("turn") > F.col("last.anchor")
        settled = ready.select("key", F.greatest("turn", "last.anchor").alias("anchor"), F.when(ahead, 0).otherwise(F.col("last.depth") + 1).alias("depth"))
        done.append(settled.withColumn("cyclic", F.lit(False)))
        waiting = waiting.where("open > 0")
        if len(done) > ROUNDS:
            done = [cut_lineage(_union(done))]
    return _union(done).withColumn("anchor", F.when(F.col("anchor") > FIRST, F.col("anchor")))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def format_chat(messages: DataFrame, tools: dict = TOOLS) -> DataFrame:
    """One row per message: conv_id, turn, role, anchor, depth, n_calls, status, json.

    Sorting a conversation by (anchor, depth, turn) gives its topological order.
    status holds the sorted findings about its calls, results and arguments; empty if all is well.
    """
    # only messages with calls or results take part in the joins below
    plain, tooled = parsed(messages, tools)
    owners, answers, edges = linked(tooled)
    each = tooled.where("size(calls) > 0").select("conv_id", "key", F.posexplode("calls").alias("at", "call")).select("conv_id", "key", "at", F.col("call.id").alias("id"), F.col("call.errors").alias("errors"))
    each = each.join(owners.withColumnRenamed("conv_id", "c1").withColumnRenamed("id", "i1").hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("c1")) & (F.col("id") == F.col("i1")), "left")
    each = each.join(answers.withColumnRenamed("conv_id", "c2").withColumnRenamed("id", "i2").hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("id") == F.col("i2")), "left")
    tag = F.concat(F.coalesce("id", F.lit("?")), F.lit(":"))
    notes = F.concat(
        F.transform("errors", lambda e: F.concat(tag, e)),
        F.when(F.col("id").isNull(), F.array(F.concat(tag, F.lit("no_id")))).when((F.col("call_key") != F.col("key")) | (F.col("call_at") != F.col("at")), F.array(F.concat(tag, F.lit("duplicate_id")))).when(F.col("result_key").isNull(), F.array(F.concat(tag, F.lit("unanswered")))).otherwise(F.array().cast(NONE)),
    )
    per_call = each.select("key", F.explode(notes).alias("note"))
    lost = tooled.where("tool_call_id is not null").select("conv_id", "key", F.col("tool_call_id").alias("id"))
    lost = lost.join(owners, lost["conv_id"].eqNullSafe(owners["conv_id"]) & (lost["id"] == owners["id"]), "left_anti").select("key", F.concat("id", F.lit(":unlinked")).alias("note"))
    found = per_call.unionByName(lost).distinct().groupBy("key").agg(F.sort_array(F.collect_list("note")).alias("found"))
    rows = tooled.join(found, "key", "left").join(order_keys(edges), "key", "left")
    said = F.transform("calls", lambda c: F.struct(F.coalesce(c["arguments"], F.try_variant_get(F.parse_json(F.to_json(F.array(c["raw"]))), "$[0]", "variant")).alias("arguments"), c["extra"].alias("extra"), c["id"].alias("id"), c["name"].alias("name")))
    line = F.struct("content", "extra", "role", "tool_call_id", F.when(F.size("calls") > 0, said).alias("tool_calls"))
    status = F.concat(F.coalesce("found", F.array().cast(NONE)), F.when(F.coalesce("cyclic", F.lit(False)), F.array(F.lit("cyclic"))).otherwise(F.array().cast(NONE)))
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        F.when(F.col("depth").isNull(), F.col("turn")).otherwise(F.col("anchor")).alias("anchor"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.size("calls").cast("long").alias("n_calls"),
        F.array_join(status, ",").alias("status"),
        F.to_json(line).alias("json"),
    )
    line = F.struct(F.col("text").alias("content"), "role")
    plain = plain.select("conv_id", "turn", "role", F.col("turn").alias("anchor"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("n_calls"), F.lit("").alias("status"), F.to_json(line).alias("json"))
    return plain.unionByName(rows)
