import json
import random

from tessera.llm import tool_calls as T

SCHEMAS = {"add": {"a": ("number", True), "b": ("number", True), "note": ("string", False)}, "find": {"where": ("object", True), "tags": ("array", False), "deep": ("boolean", False), "n": ("integer", False)}}
CALLS = "conv_id long, call_id string, position long, name string, arguments string, parent_id string"
RESULTS = "conv_id long, call_id string, position long, content string"


def test_links_levels_and_validation(spark):
    calls = [
        (1, "a", 0, "add", '{"b": 2, "a": 1.5}', None),
        (1, "b", 1, "add", '{"a": "1", "b": null, "c": 3}', "a"),
        (1, "c", 2, "find", ' {"where": {"z": 1, "y": [true, null]}, "tags": []} ', "b"),
        (1, "c", 9, "find", "{}", "b"),
        (1, "d", 3, "nope", "{}", "zzz"),
        (1, "e", 4, "add", "[1]", "c"),
        (1, "x", 5, "add", '{"a": 1, "b": 2}', "y"),
        (1, "y", 6, "add", '{"a": 1, "b": 2}', "x"),
        (1, "w", 7, "add", '{"a": 1, "b": 2}', "y"),
        (2, "a", 0, None, None, None),
        (2, None, 1, "add", '{"a": 1, "b": 2, "note": "é\\u00e9\\n"}', None),
        (None, "q", 1, "find", '{"where": {}, "deep": 1, "n": 1.5}', None),
    ]
    results = [(1, "a", 1, "3.5"), (1, "a", 2, "later"), (1, "c", 3, None), (1, "o", 4, "orphan"), (2, None, 1, "lost")]
    got = {(r.conv_id, r.call_id, r.n_calls): r for r in T.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()}
    assert len(got) == 13
    one = lambda c, i, n=1: got[c, i, n]
    assert (one(1, "a").status, one(1, "a").level, one(1, "a").valid, one(1, "a").n_results) == ("linked", 0, True, 2)
    assert one(1, "a").canonical_json == '{"arguments":{"a":1.5,"b":2},"id":"a","name":"add","result":"3.5"}'
    assert one(1, "b").errors == ["not number: a", "not number: b", "unexpected c"] and one(1, "b").level == 1 and one(1, "b").status == "unanswered"
    assert one(1, "c", 2).canonical_json.startswith('{"arguments":{"tags":[],"where":{"y":[true,null],"z":1}},"id":"c"') and one(1, "c", 2).valid and one(1, "c", 2).level == 2
    assert one(1, "d").errors == ["unknown tool nope", "unknown parent"] and one(1, "d").level == 0
    assert one(1, "e").errors == ["arguments are no object"] and one(1, "e").level == 3
    assert [one(1, x).level for x in "xyw"] == [None] * 3 and one(1, "w").errors == ["cyclic parents"]
    assert one(1, "o", 0).status == "orphan" and not one(1, "o", 0).valid
    assert one(2, "a").errors == ["arguments are no object"]
    assert json.loads(one(2, None).canonical_json)["arguments"]["note"] == "éé\n" and one(2, None).status == "unidentified"
    assert one(None, "q").errors == ["not boolean: deep", "not integer: n"] and got[2, None, 0].status == "unidentified"


def test_long_chains(spark):
    rng = random.Random(1)
    calls = [(7, f"c{k}", k, "add", '{"a":1,"b":1}', f"c{k - 1}" if k % 50 else None) for k in range(200)]
    calls += [(8, f"s{k}", k, "add", '{"a":1,"b":1}', "s0" if k else None) for k in range(100)]
    rng.shuffle(calls)
    out = T.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), SCHEMAS)
    for r in out.collect():
        k = int(r.call_id[1:])
        assert r.level == (k % 50 if r.conv_id == 7 else int(k > 0)) and r.valid and r.status == "unanswered"


def test_turns_and_plan(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (1, 3, "user", None), (2, 0, "user", ""), (3, 5, "assistant", "?"), (None, 0, "user", "u"), (4, None, "user", "v")]
    calls, results = T.from_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    out = T.link(calls, results, {"reply": T.REPLY})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = {(r.conv_id, r.call_id): r for r in out.collect()}
    assert (got[1, "turn-1"].status, got[1, "turn-1"].level, got[1, "turn-1"].valid) == ("linked", 0, True)
    assert (got[1, "turn-3"].status, got[1, "turn-3"].level, got[1, "turn-3"].errors) == ("unanswered", 1, ["missing n_chars", "missing text"])
    assert got[2, "turn-0"].valid and got[3, "turn-4"].status == "orphan"
    assert got[None, "turn-0"].status == got[4, None].status == "unidentified" and len(got) == 6
    empty = spark.createDataFrame([], CALLS)
    assert T.link(empty, spark.createDataFrame([], RESULTS), SCHEMAS).collect() == []


def test_numbers_have_one_spelling(spark):
    one = {"1": ["1", "1.0", "1e0", "100e-2", "10E-1", "0.1e+1"], "0": ["0", "-0", "0.0e5", "-0.00"], "1e+400": ["1E400", "10e399"], "-12.5": ["-12.50", "-1.25e1", "-125E-1"], "1e-7": ["0.0000001", "0.1e-6"], "0.000001": ["1e-6", "0.0000010"], "100000000000000000000": ["1e20"], "1e+21": ["1000000000000000000000"], "1.1111111111111111111111111": ["1.11111111111111111111111110"]}
    rows = [(1, f"c{k}-{j}", 0, "f", f'{{"a": {t}}}', None) for k, ts in enumerate(one.values()) for j, t in enumerate(ts)]
    got = {r.call_id: r for r in T.link(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), {"f": {"a": ("integer", True)}}).collect()}
    for k, (spelling, ts) in enumerate(one.items()):
        for j in range(len(ts)):
            r = got[f"c{k}-{j}"]
            assert r.canonical_json.startswith(f'{{"arguments":{{"a":{spelling}}},')
            assert r.valid == ("e-" not in spelling and "." not in spelling), spelling


def test_marks_do_not_show(spark):
    odd = {
        '{"b":"x\\"n5\\" \\\\","c":["n1","s",{"s":"n","n":[]}],"d":"\\u0023 , \\"s"}': True,
        '{"k\\"n":"","":{}}': True,
        '{"a":"' + 'q\\n, "'[:-1] * 30_000 + '"}': True,
        '{"a":01}': False,
        '{"a":1,"a":2}': False,
        '{"a":1e9999999999999}': False,
        '{"a" 1}': False,
        "": False,
        "[" * 300 + "]" * 300: False,
    }
    rows = [(1, f"c{k}", 0, "f", t, None) for k, t in enumerate(odd)]
    got = {r.call_id: r for r in T.link(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), {"f": {}}).collect()}
    for k, (t, fine) in enumerate(odd.items()):
        r = got[f"c{k}"]
        assert (r.errors != ["arguments are no object"]) == fine, t[:50]
        if fine:
            own = json.loads(r.canonical_json)
            assert own["arguments"] == json.loads(t) and own["id"] == f"c{k}" and own["name"] == "f"
            assert r.canonical_json == json.dumps(own, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_deep_and_large_arguments(spark):
    deep = "1.0"
    for k in range(60):
        deep = f'{{"k{k}": [{deep}, {k}e0]}}'
    large = json.dumps({f"key{k:05}": {"n": k, "s": "x\\y\n" * 5} for k in range(20_000)}, indent=1)
    rows = [(1, "deep", 0, "f", deep, None), (1, "large", 1, "g", large, None)]
    schemas = {"f": {"k59": ("array", True)}, "g": {f"key{k:05}": ("object", True) for k in range(3)}}
    got = {r.call_id: r for r in T.link(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), schemas).collect()}
    assert got["deep"].valid and json.loads(got["deep"].canonical_json)["arguments"] == json.loads(deep)
    assert len(got["large"].errors) == 20_000 - 3 and json.loads(got["large"].canonical_json)["arguments"] == json.loads(large)
