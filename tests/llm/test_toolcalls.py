import json

from lucerna.llm import toolcalls

SCHEMAS = {"f": {"x": {"type": "integer", "required": True, "minimum": 1, "maximum": 9}, "s": {"type": "string", "min_length": 2, "max_length": 4}, "n": {"type": "number"}, "b": {"type": "boolean"}, "o": {"type": "object"}, "a": {"type": "array"}}}
CALLS = "conv_id long, turn long, id string, after_id string, name string, arguments string, depth string"
RESULTS = "turn long, id string, content string, name string"


def linked(spark, calls, results):
    return {r.call_id: r for r in toolcalls.link(spark.createDataFrame([(*c, "q") for c in calls], CALLS), spark.createDataFrame([(*r, "q") for r in results], RESULTS), SCHEMAS).collect()}


def test_links_order_and_json(spark):
    calls = [(1, 0, "a", None, "f", '{"x": 3, "s":"hé\\"", "n":1.5}'), (1, 2, "b", "a", "f", '{"s": "ok", "x":9}'), (1, 4, "c", "b", "f", '{"x":1}'), (1, 6, "d", "gone", "f", '{"x":1}')]
    got = linked(spark, calls, [(1, "a", 'r "1"\n'), (5, "c", None), (9, "zz", "orphan"), (3, "b", "later"), (2, "b", "first")])
    assert {k: (r.depth, r.n_results, r.status) for k, r in got.items()} == {"a": (0, 1, "ok"), "b": (1, 2, "ok"), "c": (2, 1, "ok"), "d": (0, 0, "unanswered")}
    assert got["a"].line == '{"arguments":{"n":1.5,"s":"hé\\"","x":3},"id":"a","name":"f","result":"r \\"1\\"\\n"}'
    for r in got.values():
        assert json.dumps(json.loads(r.line), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.line
    assert json.loads(got["b"].line)["result"] == "first" and json.loads(got["c"].line)["result"] is None


def test_arguments(spark):
    cases = {
        '{"x":1}': "", '{"x":"1"}': "x:type", '{"x":1.5}': "x:type", '{"x":0}': "x:minimum", '{"x":10}': "x:maximum", "{}": "x:missing", '{"x":null}': "x:missing", "[1]": "x:missing", "not json": "not_json", None: "not_json",
        '{"x":2,"s":"a"}': "s:min_length", '{"x":2,"s":"abcde"}': "s:max_length", '{"x":2,"s":5}': "s:type", '{"x":2,"n":3,"b":true,"o":{"k":[]},"a":[1]}': "", '{"x":2,"n":"3","b":1,"o":[],"a":{}}': "a:type,b:type,n:type,o:type",
    }
    got = linked(spark, [(1, k, f"c{k}", None, "f", a) for k, a in enumerate(cases)], [])
    got = {k: set(filter(None, got[f"c{n}"].errors.split(","))) for n, k in enumerate(cases)}
    assert got == {k: set(filter(None, v.split(","))) for k, v in cases.items()}
    assert linked(spark, [(1, 1, "u", None, "g", "{}"), (1, 1, "v", None, None, "{}")], [])["u"].errors == "unknown_tool"


def test_odd_rows(spark):
    ok = '{"x":1}'
    calls = [(1, 0, None, None, "f", ok), (1, 5, "a", "b", "f", ok), (1, 6, "b", "a", "f", ok), (1, 7, "c", "b", "f", ok), (2, 3, "d", None, "f", ok), (2, 1, "d", None, "f", '{"x":2}'), (None, None, "e", "e", None, None)]
    rows = toolcalls.link(spark.createDataFrame([(*c, "q") for c in calls], CALLS), spark.createDataFrame([(1, "d", "x", "q"), (1, None, "y", "q"), (1, "a", "z", "q"), (1, "zz", "w", "q")], RESULTS), SCHEMAS).collect()
    got = {r.call_id: (r.depth, r.n_calls, r.status) for r in rows}
    assert got == {None: (-1, 1, "no_id"), "a": (-1, 1, "cyclic"), "b": (-1, 1, "unanswered"), "c": (-1, 1, "unanswered"), "d": (0, 2, "ok"), "e": (-1, 1, "invalid")}
    lost = toolcalls.orphans(spark.createDataFrame([(*c, "q") for c in calls], CALLS), spark.createDataFrame([(1, "d", "x", "q"), (1, None, "y", "q"), (1, "zz", "w", "q")], RESULTS))
    assert sorted(r.content for r in lost.collect()) == ["w", "y"]


def test_long_chain_and_empty(spark):
    chain = [(1, k, f"k{k}", f"k{k - 1}", "f", '{"x":1}') for k in range(700)]
    assert {int(k[1:]): r.depth for k, r in linked(spark, chain, []).items()} == {k: k for k in range(700)}
    assert linked(spark, [], []) == {}


def test_plan_has_no_python(spark):
    from lucerna.llm import queries

    plan = queries.op2_toolcalls(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_numbers_have_one_form(spark):
    from pyspark.sql import functions as F

    same = [["100", "1e2", "100.0", "1E+2", "10000e-2"], ["1e-7", "0.0000001", "1.0E-7"], ["0", "-0", "-0.0", "0e5"], ["1.5", "15e-1", "1.50"], ["1e300", "1.0E300"], ["-2.25", "-225e-2"], ["12345678901234567890"], ["true"], ['"1e2"'], ['"a 1.0 \\"2e5\\" b"']]
    rows = [(k, f'{{"b": [1, {x}], "a": {x}}}') for k, xs in enumerate(same) for x in xs]
    got = {}
    for r in spark.createDataFrame(rows, "k int, j string").select("k", "j", toolcalls.canonical_json(F.col("j")).alias("c")).collect():
        got.setdefault(r.k, set()).add(r.c)
        assert json.loads(r.c) == json.loads(r.j)
    assert all(len(x) == 1 for x in got.values())
    assert got[0] == {'{"a":100,"b":[1,100]}'} and got[1] == {'{"a":1e-7,"b":[1,1e-7]}'}
    for bad in ('{"x": 1e400}', "[-1E999]"):
        assert linked(spark, [(1, 0, "a", None, "f", bad)], [])["a"].errors == "not_json"
    assert linked(spark, [(1, 0, "a", None, "f", '{"x": 1, "s": "1e400"}')], [])["a"].errors == "s:max_length"


def test_fuller_schemas(spark):
    from pyspark.sql import functions as F

    schemas = {"g": {"*": False, "e": {"type": "string", "enum": ["x", "y"]}, "p": {"type": "string", "pattern": "^[a-z]+$"}, "l": {"type": "array", "items": "integer"}, "o": {"type": "object", "fields": {"*": False, "k": {"type": "integer", "required": True, "minimum": 2}, "a b": {"type": "string"}}}}}
    cases = {'{"e":"x","p":"abc","l":[1,2],"o":{"k":2,"a b":"c"}}': "", '{"e":"z"}': "e:enum", '{"p":"a1"}': "p:pattern", '{"l":[1,"2"]}': "l:items", '{"l":[null]}': "l:items", '{"o":{}}': "o.k:missing", '{"o":{"k":1}}': "o.k:minimum", '{"o":{"k":3,"q":1}}': "o.*:unknown", '{"q":1}': "*:unknown", "{}": ""}
    df = spark.createDataFrame([(j,) for j in cases], "j string")
    assert {r.j: r.e for r in df.select("j", toolcalls.argument_errors(F.col("j"), F.lit("g"), schemas).alias("e")).collect()} == cases
