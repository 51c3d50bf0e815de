"""Validation over the table of nodes: against the validation of typed rows, and against plain Python for schemas that refer to themselves."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import tree_validation, validation
from docspark.operators.validation import SchemaError
from docspark.plans import catalog, ragged  # noqa: F401  (registers its queries)
from docspark.sources.nodes import shred, written

KIND = "id int, d struct<name:string,age:int,score:double,tags:array<string>,pet:struct<name:string,legs:int>,m:map<string,int>>"
ROWS = [
    (1, ("Ann", 5, 2.5, ["a", "b", "a", "b"], ("Rex", 4), {"x-a": 1, "y": 9})), (2, (None, -1, 1.0, [], None, {})), (3, ("x-y", None, None, ["c"], (None, 3), None)), (4, ("é", 50, 0.3, ["a"] * 7, ("Q", None), {"x-b": 70, "p/q~r": 1})), (5, (None,) * 6),
]
SCHEMAS = [
    {"required": ["name", "pet"], "properties": {"name": {"minLength": 2, "pattern": "^[A-Z]", "maxLength": 2}, "age": {"minimum": 0, "exclusiveMaximum": 50, "multipleOf": 5}, "score": {"multipleOf": 0.1, "type": "integer"}}},
    {"properties": {"tags": {"uniqueItems": True, "minItems": 1, "maxItems": 4, "items": {"enum": ["a", "c"]}, "contains": {"const": "a"}, "minContains": 2, "maxContains": 3}}},
    {"properties": {"tags": {"prefixItems": [{"const": "a"}, {"maxLength": 0}], "items": False}}},
    {"properties": {"tags": {"items": [{"const": "b"}], "additionalItems": {"const": "b"}}}},
    {"properties": {"m": {"patternProperties": {"^x-": {"maximum": 5}}, "properties": {"y": True}, "additionalProperties": False, "propertyNames": {"maxLength": 3}, "maxProperties": 1, "minProperties": 1, "dependentRequired": {"y": ["z"]}}}},
    {"anyOf": [{"required": ["zz"]}, {"properties": {"age": {"minimum": 10}, "name": {"const": "q"}}}, {"type": "array"}], "oneOf": [{"required": ["age"]}, {"required": ["name"]}]},
    {"properties": {"pet": {"oneOf": [{"required": ["legs", "name"]}, {"properties": {"legs": {"minimum": 4}}}, {"type": "string"}]}, "age": {"not": {"minimum": 5}}}},
    {"if": {"required": ["age"]}, "then": {"properties": {"score": {"maximum": 1}}}, "else": {"required": ["zz"]}, "allOf": [{"properties": {"age": {"anyOf": [{"anyOf": [{"maximum": -5}, {"minimum": 60}]}, {"type": "string"}]}}}]},
    {"dependentSchemas": {"age": {"required": ["zz"]}, "never": False}, "dependencies": {"name": ["age"], "pet": {"properties": {"pet": {"required": ["legs"]}}}}, "$defs": {"n": {"$anchor": "n", "format": "email"}}, "properties": {"name": {"$ref": "#n"}, "pet": {"properties": {"name": {"$ref": "#/$defs/n"}}}}},
    {"properties": {"score": {"enum": [2.5, 1, "x"]}, "pet": {"const": {"legs": 4, "name": "Rex"}}, "tags": {"const": ["c"]}, "name": False}},
]


@pytest.mark.parametrize("k", range(len(SCHEMAS)))
def test_agrees_with_typed_rows(spark, k):
    df = spark.createDataFrame(ROWS, KIND)
    place = lambda path: path.removeprefix("/d")
    typed = sorted((r["id"], place(r["instance_path"]), r["keyword"], r["message"]) for r in validation.validate(df, "id", {"$defs": SCHEMAS[k].get("$defs", {}), "properties": {"d": SCHEMAS[k]}}).collect())
    texts = df.select("id", F.to_json("d").alias("j"))
    tree = sorted((r["id"], r["instance_path"], r["keyword"], r["message"]) for r in tree_validation.validate_nodes(written(shred(texts, "id", "j"), "t"), "id", SCHEMAS[k]).collect())
    assert tree == typed and typed


def comments(rng, depth):
    out = {"text": rng.choice(["ok", "", 5, None])} if rng.random() < 0.9 else {}
    if depth and rng.random() < 0.9:
        out["replies"] = [comments(rng, depth - 1) for _ in range(rng.randrange(3))] if rng.random() < 0.9 else "none"
    return out


def brute(v, at=""):
    """Violations of a comment: its text is a text with a character or absent, replies are a list of comments, one of the two is there."""
    if "text" in v and not isinstance(v["text"], str):
        yield at + "/text", "type"
    if v.get("text") == "":
        yield at + "/text", "minLength"
    if "text" not in v and "replies" not in v:
        yield at, "minProperties"
    if isinstance(v.get("replies", []), list):
        for i, x in enumerate(v.get("replies", [])):
            yield from brute(x, f"{at}/replies/{i}")
    else:
        yield at + "/replies", "type"


def test_schema_that_refers_to_itself(spark):
    rng = random.Random(6)
    docs = [(k, comments(rng, 6)) for k in range(40)]
    schema = {"minProperties": 1, "properties": {"text": {"type": "string", "minLength": 1}, "replies": {"type": "array", "items": {"$ref": "#"}}}}
    nodes = written(shred(spark.createDataFrame([(k, json.dumps(v)) for k, v in docs], "id int, j string").repartition(3), "id", "j"), "t")
    got = tree_validation.validate_nodes(nodes, "id", schema).collect()
    assert sorted((r["id"], r["instance_path"], r["keyword"]) for r in got) == sorted((k, *x) for k, v in docs for x in brute(v))
    assert sorted(r["ord"] for r in got if r["id"] == got[0]["id"]) == list(range(sum(r["id"] == got[0]["id"] for r in got)))


def test_null_is_a_member_and_shapes_differ(spark):
    texts = ["null", "7", '{"a":null}', "[]", '{"a":1,"b":[{"a":null}]}', "bad"]
    nodes = written(shred(spark.createDataFrame(list(enumerate(texts)), "id int, j string"), "id", "j"), "t")
    schema = {"type": ["object", "null"], "required": ["a"], "additionalProperties": {"items": {"$ref": "#"}}, "properties": {"a": {"type": "integer"}}}
    got = sorted((r["id"], r["instance_path"], r["keyword"]) for r in tree_validation.validate_nodes(nodes, "id", schema).collect())
    assert got == [(1, "", "type"), (2, "/a", "type"), (3, "", "type"), (4, "/b/0/a", "type")]
    assert tree_validation.validate_nodes(nodes, "id", True).collect() == [] and tree_validation.validate_nodes(nodes.limit(0), "id", schema).collect() == []
    for bad in ({"$ref": "#"}, {"allOf": [{"$ref": "#"}]}, {"$ref": "#/nowhere"}, {"properties": {"a": 3}}, {"items": {"pattern": "("}}):
        with pytest.raises(SchemaError):
            tree_validation.validate_nodes(nodes, "id", bad).collect()


def test_branch_that_refers_to_itself(spark):
    """Lists of lists of numbers, or of objects that hold such: verdicts go up by depth."""

    def errors(v):
        """Whether a value is an integer, or a list of such values, or an object whose ``in`` is one."""
        if isinstance(v, list):
            return any(errors(x) for x in v)
        return errors(v["in"]) if isinstance(v, dict) and set(v) == {"in"} else not (isinstance(v, int) and not isinstance(v, bool))

    docs = [1, "x", [1, [2, []]], [1, ["x"]], {"in": [{"in": 1}]}, {"in": [{"in": "x"}, 3]}, {"no": 1}, [[[[{"in": [7]}]]]], [[[[{"in": [7.5]}]]]]]
    schema = {"anyOf": [{"type": "integer"}, {"type": "array", "items": {"$ref": "#"}}, {"type": "object", "required": ["in"], "additionalProperties": False, "properties": {"in": {"$ref": "#"}}}]}
    nodes = written(shred(spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(docs)], "id int, j string"), "id", "j"), "t")
    got = tree_validation.validate_nodes(nodes, "id", schema).collect()
    assert {r["id"] for r in got} == {k for k, v in enumerate(docs) if errors(v)}
    # The best branch is followed down to what is wrong.
    assert sorted((r["instance_path"], r["keyword"]) for r in got if r["id"] == 3) == [("", "anyOf"), ("/1", "anyOf"), ("/1/0", "anyOf"), ("/1/0", "type")]


def test_branches_in_the_row(spark):
    """Shapes are told apart by names, patterns and places in tuples; branches that look at nothing below take no join but with the shapes, and write nothing."""
    docs = [{"t": [1, "x", 12]}, {"t": ["y", 3, 3]}, {"x-a": 1, "n": 11}, {"x-b": "s", "other": 3}, {"deep": {"t": [0, 0]}}]
    schema = {
        "patternProperties": {"^x-": {"type": "integer"}}, "additionalProperties": {"$ref": "#/$defs/low"}, "$defs": {"low": {"anyOf": [{"maximum": 10}, {"multipleOf": 5}]}},
        "properties": {"t": {"prefixItems": [{"type": "integer"}, {"type": "string"}], "items": {"$ref": "#/$defs/low"}}, "deep": {"$ref": "#"}},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(docs)], "id int, j string")
    found = tree_validation.validate(df, "id", "j", schema)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    want = [(0, "/t/2", "anyOf"), (0, "/t/2", "maximum"), (1, "/t/0", "type"), (1, "/t/1", "type"), (2, "/n", "anyOf"), (2, "/n", "maximum"), (3, "/x-b", "type"), (4, "/deep/t/1", "type")]
    assert sorted((r["id"], r["instance_path"], r["keyword"]) for r in found.collect()) == want


FLAT = [
    {"anyOf": [{"required": ["a"]}, {"type": "array"}, {"anyOf": [{"type": "null"}, {"minProperties": 2}]}], "properties": {"a": {"oneOf": [{"maximum": 3}, {"multipleOf": 2}, {"type": "string"}]}, "b": {"items": {"$ref": "#"}}}},
    {"type": "object", "if": {"required": ["a"]}, "then": {"minProperties": 2}, "else": {"not": {"required": ["b"]}}, "additionalProperties": {"not": {"type": "null"}, "items": [{"const": 1}, {"type": "integer", "multipleOf": 2.5}], "additionalItems": {"enum": [2, "x"]}}},
    {"dependentSchemas": {"a": {"required": ["b", "b"], "maxProperties": 1}}, "dependentRequired": {"b": ["a"]}, "propertyNames": {"maxLength": 1, "type": "string"}, "allOf": [{"$ref": "#/$defs/one"}], "anyOf": [{"$ref": "#/$defs/one"}, {"required": ["zz"]}], "$defs": {"one": {"minProperties": 3, "uniqueItems": True, "minItems": 3}}},
    {"properties": {"b": {"items": {"properties": {"a": {"type": "string"}}, "additionalProperties": False}}, "a": False}, "additionalProperties": {"$ref": "#"}},
    {"oneOf": [True, {"type": ["object", "array"]}, {"not": {"multipleOf": 5}}], "items": {"$ref": "#"}},
]


@pytest.mark.parametrize("k", range(len(FLAT)))
def test_states_of_the_walk(spark, k):
    """Without patterns the walk tells which places a node has: texts are walked once, no shapes are collected and joined; the violations are those of the table of nodes."""
    docs = [{"a": 4, "b": [{"a": 3}, {"a": "x", "c": None}]}, [1, 5, 2, "x", 1], {"b": [[{"a": 1.5}], 7]}, {"a": None, "long": [1, 2.5, 3]}, None, {}, 10, [], {"x": {"a": 6, "b": []}, "y": None}, {"a": 9007199254740993}]
    texts = spark.createDataFrame([*((i, json.dumps(v)) for i, v in enumerate(docs)), (98, None), (99, "bad")], "id int, j string")
    found = tree_validation.validate(texts, "id", "j", FLAT[k])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Join ") == 0
    want = tree_validation.validate_nodes(written(shred(texts, "id", "j"), "t"), "id", FLAT[k])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) != []


def test_validate_tree_takes_one_walk(spark):
    """Rows without violations go before any are made, by plain tests; the only join left is that of orders with their items."""
    plan = catalog.QUERIES["validate_tree"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Join ") == 1
    assert "lambda" not in plan[: plan.index("MapInArrow")]


def test_whole_multiples(spark):
    """Large numbers and long fractions are compared by their digits."""
    texts = ["5", "7", "10.0", "2.5", "1e1", "9007199254740995", "9007199254740993", "4503599627370500", "4503599627370501", "-15", "-0.0", "10.00000000000000000001", "1e-400", '"x"']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    bad = {texts[r["id"]] for r in tree_validation.validate(df, "id", "j", {"multipleOf": 5}).collect()}
    assert bad == {"7", "2.5", "9007199254740993", "4503599627370501"}
