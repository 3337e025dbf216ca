"""Tool calls: identities, kept fields, schemas and long chains."""

import json
import random

from pyspark.sql import functions as F

from zonewise.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def call(i, name, args):
    return {"id": i, "name": name, "arguments": args}


def calls(*which, **more):
    return json.dumps({"tool_calls": list(which), **more})


def result(i, content="x", **more):
    return json.dumps({"tool_call_id": i, "content": content, **more})


def status(spark, rows, **options):
    got = chat.format_chat(spark.createDataFrame(rows, SCHEMA), **options).collect()
    return {(r["conv_id"], r["turn"]): r["status"] for r in got}


def test_null_keys_do_not_mix_messages(spark):
    own = calls(call("a", "nope", {}))
    alone = status(spark, [(1, None, "assistant", own)])
    both = status(spark, [(1, None, "assistant", own), (None, 1, "assistant", own), (None, 2, "tool", result("a"))])
    assert alone[1, None] == both[1, None] == "a:unanswered,a:unknown_tool" and both[None, 1] == "a:unknown_tool"


def test_nothing_is_dropped(spark):
    texts = [("user", '{"tool_call_id":"x","note":"keep me","content":"c"}'), ("system", calls(call("a", "search", {"query": "q"}))), ("assistant", '{"tool_calls":[],"note":1}'), ("tool", '{"note": 5}')]
    rows = [(1, k, role, text) for k, (role, text) in enumerate(texts)]
    rows += [(1, 8, "assistant", calls({"id": "b", "type": "function", "function": {"name": "search", "arguments": '{"query": "q"}'}, "index": 2}, content=["part"], reason={"z": 1, "a": None}))]
    rows += [(1, 9, "tool", result("b", {"z": 1, "a": 2}, took=1.5))]
    got = {r["turn"]: r for r in chat.format_chat(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [json.loads(got[k]["json"])["content"] for k in range(4)] == [t for _, t in texts]
    assert json.loads(got[8]["json"]) == {"content": ["part"], "extra": {"reason": {"a": None, "z": 1}}, "role": "assistant", "tool_calls": [{"arguments": {"query": "q"}, "extra": {"index": 2, "type": "function"}, "id": "b", "name": "search"}]}
    assert got[9]["json"] == '{"content":{"a":2,"z":1},"extra":{"took":1.5},"role":"tool","tool_call_id":"b"}'
    assert got[8]["status"] == got[9]["status"] == ""


ARGUMENTS = [
    ({"where": {"city": "x", "grid": [{"x": 1}, {"x": 2}]}, "unit": "C"}, ""),
    ({"where": {"grid": [{"x": "1"}, {}, {"x": 3, "y": 0}, {"x": 200}]}, "unit": "K"}, "a:enum:unit,a:extra:where.grid[].y,a:missing:where.city,a:missing:where.grid[].x,a:range:where.grid[].x,a:type:where.grid[].x"),
    ({"where": [], "unit": None}, "a:type:where"),
    ({"where": {"city": 5}, "code": "ab"}, "a:missing:unit,a:pattern:code,a:type:where.city"),
    ("not json", "a:not_json"),
    ("[1]", "a:not_object"),
]


def test_nested_schemas(spark):
    point = {"type": "object", "properties": {"x": {"type": "number", "minimum": 0, "maximum": 100}}, "required": ["x"], "additionalProperties": False}
    schema = {"type": "object", "required": ["where", "unit"], "properties": {"where": {"type": "object", "required": ["city"], "properties": {"city": {"type": "string"}, "grid": {"type": "array", "items": point}}}, "unit": {"enum": ["C", "F", None]}, "code": {"pattern": "^[0-9]+$"}}}
    table = spark.createDataFrame([("t", json.dumps(schema)), (None, "{}"), ("u", None)], "name string, schema string")
    rows = [row for k, (given, _) in enumerate(ARGUMENTS) for row in ((k, 0, "assistant", calls(call("a", "t", given))), (k, 1, "tool", result("a")))]
    got = {r["conv_id"]: r for r in chat.format_chat(spark.createDataFrame(rows, SCHEMA), tools=chat.tools_of(table)).where("turn = 0").collect()}
    assert [got[k]["status"] for k in range(len(ARGUMENTS))] == [want for _, want in ARGUMENTS]
    assert json.loads(got[4]["json"])["tool_calls"][0]["arguments"] == "not json"


def test_long_chains_in_order_need_no_rounds(spark, monkeypatch):
    rows = []
    for k in range(200):
        rows += [(1, 2 * k, "assistant", calls(call(f"c{k}", "fetch", {"url": f"${{c{k - 1}}}" if k else "u"}))), (1, 2 * k + 1, "tool", result(f"c{k}"))]
    times = []
    kept = chat.cut_lineage
    monkeypatch.setattr(chat, "cut_lineage", lambda df: times.append(1) or kept(df))
    got = chat.format_chat(spark.createDataFrame(rows, SCHEMA))
    assert got.where("anchor <> turn OR depth <> 0 OR status <> ''").count() == 0
    assert len(times) < 8


def brute_order(edges, turns):
    """Keys by walking the messages that wait for nothing; the rest is cyclic."""
    left = {m: {b for b, a in edges if a == m} for m in turns}
    keys = {}
    while ready := [m for m, w in left.items() if w <= keys.keys()]:
        for m in ready:
            last = max((keys[b] for b in left[m]), default=None)
            keys[m] = (turns[m], 0) if last is None or turns[m] > last[0] else (last[0], last[1] + 1)
            del left[m]
    return keys, set(left)


def test_order_equals_brute_force(spark):
    r = random.Random(1)
    rows, edges, turns = [], set(), {}
    for conv in range(36):
        ids = [f"i{k}" for k in range(6)]
        order = list(range(12))
        r.shuffle(order)
        place = {}
        for k, i in enumerate(ids):
            asked = r.choice([None, None, *ids[:k], *([r.choice(ids)] if conv % 3 == 0 else [])])
            place["call", i], place["result", i] = order[2 * k], order[2 * k + 1]
            rows += [(conv, order[2 * k], "assistant", calls(call(i, "fetch", {"url": f"${{{asked}}}" if asked else "u"}))), (conv, order[2 * k + 1], "tool", result(i))]
            edges.add(((conv, "call", i), (conv, "result", i)))
            if asked:
                edges.add(((conv, "result", asked), (conv, "call", i)))
        turns |= {(conv, *m): t for m, t in place.items()}
    got = {(x["conv_id"], x["turn"]): x for x in chat.format_chat(spark.createDataFrame(rows, SCHEMA)).collect()}
    keys, cyclic = brute_order(edges, turns)
    for m, turn in turns.items():
        x = got[m[0], turn]
        assert (x["status"] == "cyclic") == (m in cyclic)
        assert (x["anchor"], x["depth"]) == ((turn, 0) if m in cyclic else keys[m])


def test_clashing_columns_and_empty(spark):
    rows = [(1, 0, "assistant", calls(call("a", "search", {"query": "x"}))), (1, 1, "tool", result("a"))]
    df = spark.createDataFrame(rows, SCHEMA)
    odd = df.select("*", *[F.lit(1).alias(c) for c in ("body", "late", "open", "last", "before", "after", "extra", "content", "json")])
    assert sorted(map(str, chat.format_chat(odd).collect())) == sorted(map(str, chat.format_chat(df).collect()))
    assert chat.format_chat(df.limit(0)).count() == 0
