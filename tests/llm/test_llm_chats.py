"""Tool calls: linking, order, validation and canonical JSON."""

import json

import pytest
from skysift.llm import chats

CALLS = "conv_id long, call_id string, position long, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, position long, content string"
TOOLS = [("find", json.dumps({"type": "object", "required": ["q"], "properties": {"q": {"type": "string"}, "n": {"type": "integer", "minimum": 1}}}))]


def linked(spark, calls, results, tools=TOOLS):
    rows = chats.link(
        spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(tools, "name string, schema string")
    ).collect()
    return {(r["conv_id"], r["call_id"]): r for r in rows}, rows


def test_every_kind_of_call(spark):
    calls = [
        (1, "a", 0, "find", '{"q": "x", "n": 2}', []), (1, "b", 1, "find", '{"n": 0}', ["a"]), (1, "c", 2, "find", "{", ["a", "b", "zz"]),
        (1, "d", 3, "other", None, None), (2, "a", 0, "find", '{"q": "y"}', ["b"]), (2, "b", 1, "find", '{"q": "y"}', ["a"]),
        (2, "c", 2, "find", '{"q": "z"}', ["b"]), (3, "a", 4, "find", '{"q": "later"}', []), (3, "a", 1, "find", '{"q": "first"}', []),
        (None, "a", 0, "find", '{"q": "n"}', []), (None, "a", 0, "find", '{"q": "n"}', []), (4, None, 0, "find", '{"q": "n"}', ["a"]),
        (5, "self", 0, "find", '{"q": "s"}', ["self"]),
    ]
    results = [(1, "a", 5, "late"), (1, "a", 1, "early"), (1, "x", 2, "lost"), (3, "a", 2, None), (None, "a", 0, "r"), (6, None, 1, "r")]
    by, rows = linked(spark, calls, results)
    assert by["1", "a"]["status"] == "linked" and by["1", "a"]["n_results"] == 2 and by["1", "a"]["level"] == 0
    assert by["1", "a"]["json"] == '{"arguments":{"n":2,"q":"x"},"depends_on":[],"id":"a","name":"find","result":"early"}'
    assert (by["1", "b"]["level"], by["1", "b"]["status"]) == (1, "unanswered")
    assert by["1", "b"]["errors"] == ["$.q: required", "$.n: minimum"]
    assert by["1", "c"]["level"] == 2 and by["1", "c"]["json"] is None
    assert by["1", "c"]["errors"] == ["$: not JSON (JSONDecodeError)", "depends_on: unknown"]
    assert by["1", "d"]["errors"] == ["$: unknown tool"] and by["1", "x"]["status"] == "orphan"
    assert {by["2", c]["status"] for c in "abc"} | {by["5", "self"]["status"]} == {"cycle"}
    assert by["3", "a"]["copies"] == 2 and json.loads(by["3", "a"]["json"])["arguments"] == {"q": "first"}
    assert sum(r["status"] == "unidentified" for r in rows) == 5 and len(rows) == 15


def test_empty_tables(spark):
    assert linked(spark, [], [], [])[1] == []


def test_order_of_a_dense_conversation(spark):
    # Half of all calls stand in one conversation, each depending on two before it.
    calls = [(1, str(i), i, "find", '{"q": ""}', [str(i // 2), str(i // 3)] if i else []) for i in range(60)]
    calls += [(c, "0", 0, "find", '{"q": ""}', []) for c in range(2, 62)]
    by, _ = linked(spark, calls, [])
    for i in range(1, 60):
        assert by["1", str(i)]["level"] == 1 + max(by["1", str(i // 2)]["level"], by["1", str(i // 3)]["level"])


def test_order_of_a_long_chain_and_of_chains_between(spark):
    calls = [(1, f"c{i}", i, "find", "{}", [f"c{i - 1}"] if i else []) for i in range(100)]
    # Two chains that meet, a chain behind them, and a chain behind a cycle.
    calls += [(2, "r", 0, "find", "{}", []), (2, "a1", 1, "find", "{}", ["r"]), (2, "a2", 2, "find", "{}", ["a1"]), (2, "b1", 3, "find", "{}", ["r"]),
              (2, "m", 4, "find", "{}", ["a2", "b1"]), (2, "d1", 5, "find", "{}", ["m"]), (2, "m2", 6, "find", "{}", ["d1", "b1", "r"]),
              (2, "x", 7, "find", "{}", ["y"]), (2, "y", 8, "find", "{}", ["x"]), (2, "z", 9, "find", "{}", ["y"]), (2, "w", 10, "find", "{}", ["z", "r"]),
              (2, "v", 11, "find", "{}", ["w"])]
    by, _ = linked(spark, calls, [])
    assert [by["1", f"c{i}"]["level"] for i in range(100)] == list(range(100))
    want = {"r": 0, "a1": 1, "a2": 2, "b1": 1, "m": 3, "d1": 4, "m2": 5, "x": None, "y": None, "z": None, "w": None, "v": None}
    assert {c: by["2", c]["level"] for c in want} == want


def test_given_turns(spark, folder):
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = [r.asDict() for r in turns.collect()]
    got = {(r["conv_id"], r["call_id"]): r for r in chats.link(*chats.from_turns(turns)).collect()}
    said = {(r["conv_id"], r["turn"]): r for r in rows}
    schemas = dict(chats.TURN_TOOLS)
    want = {}
    for (conv, turn), r in said.items():
        if r["role"] == "user":
            level, t = 0, turn
            while t >= 2 and said.get((conv, t - 2), {}).get("role") == "user":
                level, t = level + 1, t - 2
            name = "open" if turn < 2 else "follow"
            answer = said.get((conv, turn + 1))
            answered = answer is not None and answer["role"] == "assistant"
            arguments = {"turn": turn} | ({"text": r["text"]} if r["text"] is not None else {})
            whole = {"arguments": arguments, "depends_on": [f"call-{turn - 2}"] if turn >= 2 else [], "id": f"call-{turn}", "name": name,
                     "result": answer["text"] if answered else None}
            text = json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            errors = chats.violations(arguments, schemas[name])
            want[str(conv), f"call-{turn}"] = (level, "linked" if answered else "unanswered", errors, text)
    calls = {k: v for k, v in got.items() if v["status"] != "orphan"}
    assert {k: (v["level"], v["status"], v["errors"], v["json"]) for k, v in calls.items()} == want


def test_turns_of_all_roles(spark, folder):
    """Rows and results account for every turn, whatever its role."""
    given = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = [(7001, 0, "system", "be \"brief\""), (7001, 0, "system", "be \"brief\""), (7001, 1, "user", "x"), (7001, 2, "assistant", "y"),
           (7001, 3, None, "who"), (7001, 4, "tool", None), (None, 5, "system", "z"), (7001, None, "user", "u")]
    turns = given.union(spark.createDataFrame(odd, given.schema))
    rows = chats.linked_turns(turns).collect()
    others = [r for r in rows if r["copies"] == r["n_results"] == 0]
    assert sum(r["copies"] + r["n_results"] for r in rows) + len(others) == turns.count()
    want = [(None if r["conv_id"] is None else str(r["conv_id"]), r["turn"], "message" if r["role"] else "unidentified",
             json.dumps({"role": r["role"], "text": r["text"], "turn": r["turn"]}, separators=(",", ":"), ensure_ascii=False))
            for r in turns.collect() if r["role"] not in ("user", "assistant")]
    assert sorted(((r["conv_id"], r["position"], r["status"], r["json"]) for r in others), key=str) == sorted(want, key=str)
    assert len(want) > 6 and all(r["call_id"] is None and r["level"] is None and r["errors"] == [] for r in others)


@pytest.mark.parametrize(
    "value,text",
    [
        ({"b": 1, "a": [1.0, 2.5, True, None]}, '{"a":[1,2.5,true,null],"b":1}'),
        ({"é": "ü\n\"", "z": {}}, '{"z":{},"é":"ü\\n\\""}'),
        (1e300, "1e+300"),
    ],
)
def test_canonical(value, text):
    assert chats.canonical(value) == text and chats.parse(text) == value


@pytest.mark.parametrize("text", ['{"a": 1, "a": 2}', "NaN", "[Infinity]", "1e999", "nope", ""])
def test_refused(text):
    assert chats.check(text, "{}")[1]


def test_keywords():
    schema = {
        "type": "object", "additionalProperties": False,
        "properties": {"k": {"enum": [1, "x"]}, "c": {"const": 2}, "l": {"type": "array", "items": {"type": "integer"}, "maxItems": 2},
                       "s": {"type": ["string", "null"], "maxLength": 2}, "f": {"type": "number", "maximum": 1}},
    }
    assert chats.violations({"k": 1, "c": 2, "l": [1, 2], "s": None, "f": 0.5}, schema) == []
    bad = {"k": 3, "c": 3, "l": [1, "2", 3.0], "s": "abc", "f": True, "z": 1}
    assert chats.violations(bad, schema) == [
        "$.c: const", "$.f: type", "$.k: enum", "$.l: maxItems", "$.l[1]: type", "$.s: maxLength", "$.z: additionalProperties",
    ]


@pytest.mark.parametrize(
    "number, text",
    [(1e-7, "1e-7"), (1e-5, "0.00001"), (1e-6, "0.000001"), (-1.5e-9, "-1.5e-9"), (-0.0, "0"), (1e20, "100000000000000000000"), (1e21, "1e+21"),
     (1.25e30, "1.25e+30"), (123456.789, "123456.789"), (5e-324, "5e-324"), (2**70, "1180591620717411303424")],
)
def test_numbers(number, text):
    assert chats.canonical(number) == text and json.loads(text) == number


@pytest.mark.parametrize(
    "schema, errors",
    [("true", []), ("false", ["$: false"]), ("[1]", ["$: bad schema"]), ("3", ["$: bad schema"]), ("{", ["$: schema not JSON (JSONDecodeError)"]),
     ('{"minimum": 1e999}', ["$: schema not JSON (ValueError)"]), ('"\\ud800"', ["$: schema not JSON (UnicodeEncodeError)"]),
     ('{"required": "n", "type": 7}', ["$: bad type", "$: bad required"]), ('{"required": [["n"]]}', ["$: bad required"]),
     ('{"properties": {"n": {"minimum": "2"}, "q": true}}', ["$.n: bad minimum"]), ('{"properties": {"n": false}}', ["$.n: false"]),
     ('{"properties": [], "enum": {}}', ["$: bad enum", "$: bad properties"]), ('{"additionalProperties": {"type": "integer"}}', ["$.q: type"]),
     ('{"properties": {"l": {"items": false}}, "additionalProperties": 1}', ["$: bad additionalProperties", "$.l[0]: false"])],
)
def test_schemas_of_any_kind(schema, errors):
    value, found = chats.check('{"n": 1, "q": "x", "l": [0]}', schema)
    assert value == {"n": 1, "q": "x", "l": [0]} and [e for e in found if e != "$.l: type"] == errors


def test_bad_rows_do_not_end_the_job(spark):
    deep = "[" * 100_000
    arguments = ['{"q": "\\ud800"}', deep, "null", '{"q": 1e999}', '{"q": "\\ud83d\\ude00"}']
    calls = [(1, str(i), i, "find", a, []) for i, a in enumerate(arguments)]
    calls += [(2, "a", 0, "broken", "{}", []), (2, "b", 1, "deep", "{}", []), (2, "c", 2, "list", "{}", [])]
    by, rows = linked(spark, calls, [], [*TOOLS, ("broken", "{"), ("deep", deep), ("list", "[]")])
    assert [by["1", str(i)]["errors"] for i in range(5)] == [
        ["$: not JSON (UnicodeEncodeError)"], ["$: not JSON (RecursionError)"], ["$: type"], ["$: not JSON (ValueError)"], []
    ]
    assert [by["1", str(i)]["json"] is None for i in range(5)] == [True, True, False, True, False]
    assert json.loads(by["1", "2"]["json"])["arguments"] is None and "\U0001f600" in by["1", "4"]["json"]
    assert [by["2", c]["errors"] for c in "abc"] == [
        ["$: schema not JSON (JSONDecodeError)"], ["$: schema not JSON (RecursionError)"], ["$: bad schema"]
    ]
    assert all(by["2", c]["json"] for c in "abc") and len(rows) == 8
