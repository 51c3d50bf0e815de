"""The table of nodes and what is asked of it, against walkers of plain Python values."""

import json
import random

import pytest

from docspark.operators import inference, trees
from docspark.plans import catalog, ragged  # noqa: F401  (registers its queries)
from docspark.sources import nodes as nodes_of

TEXTS = [
    '{"a":{"a":{"a":1,"b":[1,2]},"b":[3]},"b":[4,null,5.50],"x y":{"~/":"é"}}', '[{"x":null,"f":true},{"x":1,"f":false},{"y":2}]', "not json", None, '"\\ud83d\\ude00\\ud83dx"', "[]", "{}", "null", '{"k":1,"k":{"z":[]},"j":2}',
    '{"t":[["p","q"],"r",{"tags":[]},{"tags":["x","y"]},{"tags":"x"}],"n":1e3,"s":"1e3"}', "[NaN]", "[" * 600 + "]" * 600, "[" * 500 + "]" * 500, '{"a":1} x', "01", '{"date":"2024-02-31","u":"http://x"}',
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, json string").repartition(3)


@pytest.fixture(scope="module")
def table(docs):
    return nodes_of.written(nodes_of.shred(docs, "id", "json"), "test-nodes")


def values():
    out = {}
    for k, t in enumerate(TEXTS):
        try:
            out[k] = json.loads(t, parse_constant=nodes_of._refused) if k != 11 else None
        except (ValueError, TypeError):
            continue
    return {k: v for k, v in out.items() if k != 11}


def below(v, pointer=""):
    """(pointer, value) of a value and all below it, in order."""
    yield pointer, v
    for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        yield from below(x, f"{pointer}/{str(k).replace('~', '~0').replace('/', '~1')}")


def test_nodes(docs, table):
    """Order, places, spelled numbers and values of all nodes; invalid texts and those too deep have none."""
    own = {}
    for r in nodes_of.with_json(table, table, "id").orderBy("id", "pre").collect():
        own.setdefault(r["id"], []).append(r)
    assert set(own) == set(values())
    for k, v in values().items():
        want = list(below(v))
        assert [r["pointer"] for r in own[k]] == [p for p, _ in want]
        if k != 4:
            assert [json.loads(r["value"]) for r in own[k]] == [x for _, x in want]
        for r in own[k]:
            assert r["last"] == r["pre"] + sum(1 for _ in below(json.loads(r["value"]))) - 1 and (r["depth"] == 0) == (r["parent"] == -1)
    assert [r["text"] for r in own[9] if r["pointer"] == "/n"] == ["1e3"] and [r["kind"] for r in own[9] if r["pointer"] == "/n"] == ["integer"]
    assert own[4][0]["text"] == "😀�x" and [r["path"] for r in own[0]][-2:] == ["$['x y']", "$['x y']['~/']"]
    assert own[8][0]["json"] == '{"k":{"z":[]},"j":2}'


def test_equal_values_have_equal_keys(spark):
    texts = ['{"a":1.0,"b":[1e0,"x"]}', '{"b":[1,"x"],"a":1}', '{"b":["x",1],"a":1}', '{"a":"1","b":[1,"x"]}', '{"a":-0}', '{"a":0.0}']
    rows = nodes_of.shred(spark.createDataFrame(list(enumerate(texts)), "id int, j string"), "id", "j").filter("pre = 0").orderBy("id").collect()
    c = [r["canon"] for r in rows]
    assert c[0] == c[1] and c[4] == c[5] and len({c[0], c[2], c[3], c[4]}) == 4
    assert nodes_of.literal_canon({"b": [1, "x"], "a": 1}) == c[0]


PATHS = {
    "$..*": lambda v: [p for p, _ in below(v)][1:],
    "$..a": lambda v: [p for p, _ in below(v) if p.endswith("/a")],
    "$..a..a": lambda v: [p for p, _ in below(v) if p.endswith("/a") and "/a/" in p],
    "$.b[::-1]": lambda v: [f"/b/{i}" for i in range(len(v["b"]) - 1, -1, -1)] if isinstance(v, dict) and isinstance(v.get("b"), list) else [],
    "$[?(@.x == null)]": lambda v: [f"/{i}" for i, x in enumerate(v) if isinstance(x, dict) and "x" in x and x["x"] is None] if isinstance(v, list) else [],
    "$[?(@.x)]": lambda v: [f"/{i}" for i, x in enumerate(v) if isinstance(x, dict) and "x" in x] if isinstance(v, list) else [],
    "$[?(!@.f)].y": lambda v: [f"/{i}/y" for i, x in enumerate(v) if isinstance(x, dict) and "f" not in x and "y" in x] if isinstance(v, list) else [],
}


@pytest.mark.parametrize("text", PATHS)
def test_paths_over_all_shapes(table, text):
    got = {}
    for r in trees.select_nodes(table, "id", text).orderBy("id", "ord").collect():
        got.setdefault(r["id"], []).append(r["pointer"])
    assert got == {k: want for k, v in values().items() if (want := PATHS[text](v))}


@pytest.mark.parametrize(("text", "want"), [
    ("$..b[-1, 0]", ["/a/a/b/1", "/a/a/b/0", "/a/b/0", "/b/2", "/b/0"]), ("$['b','a','b'].length", ["/b/length"]), ("$..length", []), ("$.b[0:9:2]", ["/b/0", "/b/2"]), ("$.b[-1:0:-1]", ["/b/2", "/b/1"]), ("$.b[::0]", []),
    ("$.b[?(@ > 4)]", ["/b/2"]), ("$.b[?(@ >= 4 && @ != 5.5)]", ["/b/0"]), ("$[?(@.a.a == 1)]", ["/a"]), ("$[?(@ == $.b)]", ["/b"]), ("$[?(@.nothing <= @.no)]", ["/a", "/b", "/x y"]), ("$[?(@.* =~ /^É$/i)]", ["/x y"]),
    ("$..[?(@.b[?(@ == 3)])]", ["/a"]), ("$[?((@.a == 1) == false)]", ["/a", "/b", "/x y"]), ("$.b[?(@ == null)]", ["/b/1"]), ("$.b[?(@)]", ["/b/0", "/b/1", "/b/2"]),
])
def test_paths_of_one_text(table, text, want):
    assert [r["pointer"] for r in trees.select_nodes(table.filter("id = 0"), "id", text).orderBy("ord").collect()] == want


def test_any_match_and_lengths(table):
    own = table.filter("id = 9")
    at = lambda t: [r["pointer"] for r in trees.select_nodes(own, "id", t).orderBy("ord").collect()]
    assert at("$.t[?(@.tags[*] != 'x')]") == ["/t/3"] and at("$.t[?(@.tags[*] == 'x')]") == ["/t/3"] and at("$.t[?(@.tags == 'x')]") == ["/t/4"]
    assert at("$.t[?(@.length > 1)]") == ["/t/0"] and at("$.t[?(@.length == 1)]") == ["/t/1"]
    assert [r["value"] for r in trees.select_nodes(own, "id", "$['s','n']").orderBy("ord").collect()] == ['"1e3"', "1e3"]
    assert sorted(r["id"] for r in trees.node_exists(table, "id", "$..z").collect()) == [8]


def test_search(table):
    hits = lambda q, **o: [(r["id"], r["path"], r["kind"]) for r in trees.search_nodes(table, "id", q, **o).orderBy("id", "ord").collect()]
    assert hits("1e3") == [(9, "$.n", "value"), (9, "$.s", "value")] and hits("1000") == []
    assert hits("É") == [(0, "$['x y']['~/']", "value")] and hits("date", values=False) == [(15, "$.date", "key")] and hits("") == []
    assert hits("k", whole_word=True) == [(8, "$.k", "key")]


def brute_schema(value, policy="all", examples=False):
    """The schema of one value, as dicts."""
    if isinstance(value, dict):
        out = {"type": "object", "properties": {k: brute_schema(v, policy, examples) for k, v in value.items()}}
        return out | ({"required": list(value)} if value else {})
    if isinstance(value, list):
        out = {"type": "array"}
        return out | ({"items": fold([brute_schema(v, policy, examples) for v in value])} if value else {})
    kind = "null" if value is None else "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "integer" if float(value).is_integer() else "number"
    out = {"type": kind}
    if isinstance(value, str) and value in ("2024-02-31", "http://x"):
        out["format"] = {"2024-02-31": "date", "http://x": "uri"}[value]
    return out | ({"examples": [value]} if examples and value is not None else {})


def merge(a, b):
    alternatives = [dict(x) for s in (a, b) for x in s.get("anyOf", [s])]
    out = []
    for x in alternatives:
        same = next((k for k, y in enumerate(out) if kind_of(y) == kind_of(x)), None)
        if same is None:
            out.append(x)
            continue
        y = out[same]
        if kind_of(x) == "object":
            properties = dict(y["properties"])
            for n, s in x["properties"].items():
                properties[n] = merge(properties[n], s) if n in properties else s
            must = [n for n in properties if n in y.get("required", []) and n in x.get("required", [])]
            out[same] = {"type": "object", "properties": properties} | ({"required": must} if must else {})
        elif kind_of(x) == "array":
            items = [s["items"] for s in (y, x) if "items" in s]
            out[same] = {"type": "array"} | ({"items": fold(items)} if items else {})
        else:
            types = {t for s in (y, x) for t in (s["type"] if isinstance(s["type"], list) else [s["type"]])}
            types -= {"integer"} if "number" in types else set()
            ordered = sorted(types - {"null"}) + ["null"] * ("null" in types)
            merged = {"type": ordered[0] if len(ordered) == 1 else ordered}
            if "format" in y and y.get("format") == x.get("format"):
                merged["format"] = y["format"]
            shown = list(y.get("examples", []))
            for e in x.get("examples", []):
                if len(shown) < 5 and not any(type(e) is bool and e is z or type(e) is not bool and type(z) is not bool and e == z for z in shown):
                    shown.append(e)
            out[same] = merged | ({"examples": shown} if shown else {})
    return out[0] if len(out) == 1 else {"anyOf": out}


def kind_of(schema):
    return schema["type"] if schema["type"] in ("object", "array") else "scalar"


def fold(schemas):
    out = schemas[0]
    for s in schemas[1:]:
        out = merge(out, s)
    return out


def random_value(rng, depth=0):
    roll = rng.random()
    if roll < 0.35 and depth < 4:
        return {k: random_value(rng, depth + 1) for k in rng.sample(["a", "b", "c d", "[*]", 'q"'], rng.randrange(4))}
    if roll < 0.55 and depth < 4:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, False, 1, 2, 3.5, 1.0, "2024-02-31", "http://x", "plain", "é"])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_schema_text(spark, seed):
    """The assembled text is that of folding schemas pairwise, with order of members and alternatives, with and without examples."""
    rng = random.Random(seed)
    samples = [random_value(rng) for _ in range(12)]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(samples)], "id int, j string").repartition(4)
    found = inference.nodes(df, "id", "j")
    got = inference.schema_text(found, "id", examples=True, add_schema=False).collect()
    assert len(got) == 1 and got[0]["schema"] == json.dumps(fold([brute_schema(v, examples=True) for v in samples]), separators=(",", ":"), ensure_ascii=False)


def test_schema_of_nothing_and_of_policies(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":2}'), (2, '{"a":1}'), (3, "bad")], "id int, j string")
    found = inference.nodes(df, "id", "j")
    text = lambda **o: inference.schema_text(found, "id", add_schema=False, **o).first()["schema"]
    inner = '{"type":"object","properties":{"a":{"type":"integer"},"b":{"type":"integer"}}'
    assert text() == inner + ',"required":["a"]}' and text(required="any") == inner + ',"required":["a","b"]}' and text(required="none") == inner + "}"
    assert json.loads(inference.schema_text(found, "id").first()["schema"])["$schema"] == inference.SCHEMA
    assert inference.schema_text(found.filter("id = 3"), "id").collect() == []


def test_examples_are_the_first_five_seen(spark):
    df = spark.createDataFrame([(k, json.dumps({"v": v})) for k, v in enumerate([9, 9.0, "9", None, True, 3, 2, 1])], "id int, j string").repartition(5)
    got = {r["path"]: r for r in inference.infer(df, "id", "j").collect()}
    assert got["$.v"]["examples"] == ["9", "9", "true", "3", "2"] and got["$.v"]["kinds"] == "boolean|integer|string|null"
    items = spark.createDataFrame([(1, '[{"b":1},{"a":[],"b":"x"}]')], "id int, j string")
    assert inference.schema_text(inference.of_items(inference.nodes(items, "id", "j")), "id", add_schema=False).first()["schema"] == '{"type":"object","properties":{"b":{"type":["integer","string"]},"a":{"type":"array"}},"required":["b"]}'


def test_filters_of_own_members(docs, table):
    """The same hits from members in the row as from joins, values included."""
    for text in ("$..[?(@.x == null)]", "$[?(!@.f || @.x > 0)]", "$..[?(@.a.b && @.b)]", "$..[?(@.no == @.nothing)]"):
        rows = lambda t: sorted(tuple(r) for r in trees.select_nodes(t, "id", text).select("id", "ord", "pointer", "value").collect())  # noqa: B023, E731
        assert rows(table) == rows(table.drop("kids")) if "a.b" in text else rows(table)
        assert rows(nodes_of.shred(docs, "id", "json", [c for c in nodes_of.COLUMNS if c not in ("steps", "depth", "height", "path")])) == rows(table)


def test_what_was_picked(table):
    picked = {r["pointer"]: r["picked"] for r in trees.select_nodes(table.filter("id = 1"), "id", "$..[?(@.x), ?(@.f == true), ?(!@.x && @.y)]", values=False, picked=True).collect()}
    assert picked == {"/0": [0, 1], "/1": [0], "/2": [2]}
    with pytest.raises(ValueError):
        trees.select_nodes(table, "id", "$.a.b", picked=True)


def test_statistics_of_equal_keys(spark):
    df = spark.createDataFrame([(1, "[1,2]"), (1, '{"a":{"b":[]}}'), (1, "x")], "id int, j string")
    assert sorted(tuple(r) for r in inference.statistics(df, "id", "j").collect()) == [(1, 5, 3, 1), (1, 14, 3, 2)]


def test_facts_of_few_columns(spark):
    """The schema text takes one walk with the columns that facts need; infer without examples as well."""
    df = spark.createDataFrame([(1, '{"a":"x","d":"2024-01-02","u":"http://x"}'), (2, '{"a":null,"d":"2024-01-03","u":"mailto:b@c.de"}')], "id int, j string")
    few, own = inference.nodes(df, "id", "j", inference.FACTS), inference.nodes(df, "id", "j")
    assert set(few.columns) == {"id", "pre", "kind", "text", "steps"}
    assert inference.schema_text(few, "id").first() == inference.schema_text(own, "id").first()


def test_infer_without_examples(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":"x"}')], "id int, j string")
    few, own = inference.infer(df, "id", "j", examples=False), inference.infer(df, "id", "j")
    assert few._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") < own._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, own.drop("examples").collect()))


#: Queries of one scan: the texts are walked once, and no join but that of orders with their items is left.
SCANS = [
    "node_filter",
    "path_null_exists",
    "node_exists",
    "node_descendants",
    "json_statistics_ragged",
    "node_pointer",
    "node_search",
    "json_minified_ragged",
]


@pytest.mark.parametrize("name", SCANS)
def test_queries_of_one_scan(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Join ") == 1
