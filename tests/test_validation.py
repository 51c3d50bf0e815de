"""Validation: open objects, dates, exact numbers, formats, best branches, messages."""

import datetime
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docspark.functions import formats
from docspark.operators import validation


def found(df, schema, *more):
    return sorted((r["id"], r["instance_path"], r["keyword"], *(r[m] for m in more)) for r in validation.validate(df, "id", schema).collect())


def test_open_objects(spark):
    rows = [(1, {"name": 3, "x-a": 1, "other": 9}), (2, {"x-b": -1, "gone": None}), (3, {}), (4, None), (5, {"a/b~c": 7, "x-c": 5})]
    df = spark.createDataFrame(rows, "id int, d map<string,int>")
    check = lambda s: found(df, {"properties": {"d": s}})
    assert check({"properties": {"name": {"maximum": 2}}, "patternProperties": {"^x-": {"minimum": 0, "maximum": 4}}, "additionalProperties": False}) == [
        (1, "/d/name", "maximum"), (1, "/d/other", "false"), (2, "/d/x-b", "minimum"), (5, "/d/a~1b~0c", "false"), (5, "/d/x-c", "maximum"),
    ]
    assert check({"required": ["name"]}) == [(2, "/d", "required"), (3, "/d", "required"), (5, "/d", "required")]
    assert check({"minProperties": 1, "maxProperties": 2}) == [(1, "/d", "maxProperties"), (3, "/d", "minProperties")]
    assert check({"propertyNames": {"maxLength": 4}}) == [(1, "/d/other", "maxLength"), (5, "/d/a~1b~0c", "maxLength")]
    assert check({"dependentRequired": {"x-a": ["name", "x-b"]}}) == [(1, "/d", "dependentRequired")]
    assert check({"dependentSchemas": {"name": {"maxProperties": 2}}, "dependencies": {"gone": ["never"]}}) == [(1, "/d", "maxProperties")]
    assert check({"additionalProperties": {"exclusiveMaximum": 7}}) == [(1, "/d/other", "exclusiveMaximum"), (5, "/d/a~1b~0c", "exclusiveMaximum")]
    assert check({"type": "object", "const": {"x-b": -1}}) == [(1, "/d", "const"), (3, "/d", "const"), (5, "/d", "const")]
    assert check({"type": "string"})[0] == (1, "/d", "type")
    nested = spark.createDataFrame([(1, {"k": [{"v": "aa"}, {"v": "b"}]})], "id int, m map<string,array<map<string,string>>>")
    schema = {"properties": {"m": {"additionalProperties": {"items": {"additionalProperties": {"minLength": 2}}}}}}
    assert found(nested, schema) == [(1, "/m/k/1/v", "minLength")]


def test_dates_are_texts(spark):
    df = spark.createDataFrame([(1, datetime.date(2024, 1, 2), datetime.datetime(1999, 5, 6, 7, 8, 9), b"\x00\x01")], "id int, d date, t timestamp, b binary")
    assert found(df, {"properties": {"d": {"pattern": "^1999"}}}) == [(1, "/d", "pattern")]
    assert found(df, {"properties": {"d": {"format": "date", "type": "string", "enum": ["2024-01-02"], "minLength": 10}, "t": {"format": "date-time", "pattern": "^1999-05-06T07"}, "b": {"const": "AAE="}}}) == []
    assert found(df, {"properties": {"d": {"type": "number"}}}, "message") == [(1, "/d", "type", "Expected number, got string")]


def test_numbers_are_exact(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(1, big, Decimal("0.30"), 0.3), (2, big - 1, Decimal("0.31"), 1e21), (3, 7, Decimal("-1.00"), 1e-19), (4, -(2**63), None, float("inf"))], "id int, n bigint, c decimal(10,2), d double")
    check = lambda name, s: [k for k, _, _ in found(df, {"properties": {name: s}})]
    assert check("n", {"enum": [big - 1]}) == [1, 3, 4] and check("n", {"const": big}) == [2, 3, 4] and check("n", {"enum": [7.0, "7", 2**70]}) == [1, 2, 4]
    assert check("c", {"enum": [0.3, -1]}) == [2] and check("c", {"multipleOf": 0.1}) == [2]
    assert check("d", {"multipleOf": 0.1}) == [3, 4] and check("d", {"multipleOf": 7}) == [1, 2, 3, 4] and check("d", {"multipleOf": 0.5}) == [1, 3, 4]
    assert check("n", {"multipleOf": 0.5}) == [] and check("n", {"multipleOf": 7}) == [k for k, n in ((1, big), (2, big - 1), (3, 7), (4, 2**63)) if n % 7]
    assert check("n", {"minimum": big}) == [2, 3, 4] and check("n", {"maximum": 2**70}) == [] and check("n", {"exclusiveMaximum": big}) == [1]
    assert check("n", {"minimum": 7, "exclusiveMinimum": True}) == [3, 4]


FORMATS = {
    "date-time": (["2024-02-29T12:30:00Z", "2024-01-01t23:59:60.123+05:30", "2000-02-29T00:00:00z"], ["2023-02-29T12:30:00Z", "2024-01-01 12:30:00Z", "2024-01-01T25:00:00Z", "2024-01-01T00:00:00", "2024-01-01T00:00:00.Z", "2024-01-01T00:00:00+24:00", "1900-02-29T00:00:00Z"]),
    "date": (["2024-12-31", "2024-04-30"], ["2024-13-01", "2024-04-31", "2024-1-01", "2024-01-00", "", "2024-01-01 "]),
    "time": (["08:30:06Z", "23:59:60.5-00:30"], ["08:30:06", "24:00:00Z", "08:60:00Z", "08:30:06+1:00", "08:30:06.5x"]),
    "email": (["joe.bloggs@example.com", "a@localhost", "x+y'z@b-c.d"], ["joe.bloggs", "joe@", "a..b@c.d", ".a@b.c", "a.@b.c", "a@-b.c", "a@b@c.d", "a b@c.d", "@c.d", "é@c.d", "a@" + "b" * 64, "a@" + "b." * 130 + "c"]),
    "uuid": (["2EB8AA08-AA98-11EA-B4AA-73B441D16380"], ["2eb8aa08aa9811eab4aa73b441d16380", "2EB8AA08-AA98-11EA-B4AA-73B441D1638", "gEB8AA08-AA98-11EA-B4AA-73B441D16380"]),
    "ipv4": (["192.168.0.1", "0.0.0.0", "255.255.255.255"], ["256.1.1.1", "1.1.1", "01.1.1.1", "1.1.1.1.", "1.1.1.-1", "1.1.1.1.1", "", "1..1.1"]),
    "ipv6": (["::1", "::", "2001:db8::ff00:42:8329", "::ffff:192.168.0.1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "1::"], ["12345::", "1:2:3:4:5:6:7:8:9", "1:::2", "1::2::3", "1:2:3", "1:2:3:4:5:6:7::8", "::1.2.3.256", "1.2.3.4", "::1.2.3.4:5", "", "::g"]),
    "hostname": (["www.example.com", "localhost", "example.com.", "a" * 63], ["-bad.example.com", "under_score.example", "bad-.x", "a..b", ".", "", "a" * 64, ".".join(["a" * 50] * 6)]),
    "uri": (["https://example.com/a?b=c#d", "urn:isbn:0451450523", "a+b-c.1:"], ["/relative/path", "http://example.com/has space", ":x", "1a:b", "a:#b#c", "http://a/%zz"]),
    "uri-reference": (["/relative/path", "#frag", "", "a%20b"], ["\\\\WINDOWS\\share", "a#b#c", "%zz", "%2", "ä", "<a>"]),
    "regex": (["^a+$", r"^\p{L}+$", ""], ["([a-z", "*", "(?P<a>x)"]),
    "made-up": (["anything", ""], []),
}


@pytest.mark.parametrize("name", FORMATS)
def test_formats(spark, name):
    good, bad = FORMATS[name]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(good + bad)] + [(99, None)], "id int, t string")
    got = found(df, {"properties": {"t": {"format": name}}}, "message")
    assert [k for k, *_ in got] == list(range(len(good), len(good + bad)))
    assert name not in formats.ASSERTED or {m for *_, m in got} == {f"Not a valid {formats.ASSERTED[name][1]}"}


def test_detected_formats(spark):
    want = {
        "2024-02-31T10:00:00Z": "date-time", "2024-01-01 10:00:00+01:00": "date-time", "2024-02-31": "date", "2024-13-01": None, "2024-00-10": None, "10:00:00": None, "99:00:00Z": "time", "10:00:00.25-09:00": "time",
        "a.b+c@d-e.f": "email", "a@b": None, "a@b..c": None, "2eb8aa08-aa98-11ea-b4aa-73b441d16380": "uuid", "10.0.0.255": "ipv4", "10.0.0.256": None, "http://x": "uri", "x-1://y z": None, "tel:1": "uri", "tel:": None, "9x://y": None,
        "javascript:x": None, "": None, "plain": None,
    }
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", formats.detected(F.col("t")).alias("f")).collect()
    assert {r["t"]: r["f"] for r in rows} == want


def test_best_branch(spark):
    df = spark.createDataFrame([(1, 5, "abc"), (2, 50, "x"), (3, None, None)], "id int, n int, t string")
    both = {"anyOf": [{"type": "string"}, {"minimum": 10, "multipleOf": 3}, {"maximum": 4}]}
    assert found(df, {"properties": {"n": both}}, "message") == [
        (1, "/n", "anyOf", "Does not match any of 3 schemas"), (1, "/n", "maximum", "Value 5 exceeds maximum 4"),
        (2, "/n", "anyOf", "Does not match any of 3 schemas"), (2, "/n", "multipleOf", "Value 50 is not a multiple of 3"),
    ]
    one = {"oneOf": [{"minLength": 2}, {"maxLength": 3}]}
    assert found(df, {"properties": {"t": one}}, "message") == [(1, "/t", "oneOf", "Matches 2 of 2 schemas, expected exactly one")]
    none = {"oneOf": [{"type": "number"}, {"minLength": 9, "pattern": "q"}]}
    assert [(k, w) for k, _, w in found(df, {"properties": {"t": none}})] == [(1, "minLength"), (1, "oneOf"), (1, "pattern"), (2, "minLength"), (2, "oneOf"), (2, "pattern")]
    paths = {r["schema_path"] for r in validation.validate(df, "id", {"properties": {"n": both}}).collect()}
    assert paths == {"#/properties/n/anyOf", "#/properties/n/anyOf/1/multipleOf", "#/properties/n/anyOf/2/maximum"}


def test_messages(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "b"], 2.5, "héllo", {"x": 1})], "id int, a array<string>, n double, t string, m map<string,int>")
    schema = {
        "required": ["zz"], "not": {"required": ["n"]},
        "properties": {
            "a": {"uniqueItems": True, "maxItems": 1, "contains": {"const": "q"}, "items": {"enum": ["a", "c"]}}, "n": {"type": "integer", "exclusiveMinimum": 2.5, "const": {"k": [1, "é"]}},
            "t": {"maxLength": 4, "pattern": "^H", "if": {"minLength": 5}, "then": {"const": "x"}, "else": False}, "m": {"minProperties": 2, "dependentRequired": {"x": ["y"]}},
        },
    }
    assert [m for *_, m in found(df, schema, "message")] == sorted([m for *_, m in found(df, schema, "message")], key=[m for *_, m in found(df, schema, "message")].index)
    assert {m for *_, m in found(df, schema, "message")} == {
        "Missing required property 'zz'", "Must not match schema", "Array has duplicate items at indices 0 and 2", "Array has duplicate items at indices 1 and 3", "Array has 4 items, expected at most 1", "No items match 'contains' schema",
        'Must be one of: "a", "c"', "Expected integer, got number", "Value 2.5 must be greater than 2.5", 'Must be equal to {"k":[1,"é"]}', "String length 5 exceeds maximum 4", "Does not match pattern '^H'", 'Must be equal to "x"',
        "Object has 1 property, expected at least 2", "Property 'y' is required when 'x' is present",
    }


def test_depth_and_unicode_patterns(spark):
    df = spark.createDataFrame([(1, [[[[[[[[1, 9]]]]]]]], "éa")], "id int, a array<array<array<array<array<array<array<array<int>>>>>>>>, t string")
    schema = {"maximum": 5}
    for _ in range(8):
        schema = {"items": schema}
    began = time.time()
    plan = validation.validate(df, "id", {"properties": {"a": schema, "t": {"pattern": r"^\p{L}+$"}}})
    plan.schema  # noqa: B018
    assert time.time() - began < 2
    assert [(r["instance_path"], r["keyword"]) for r in plan.collect()] == [("/a/0/0/0/0/0/0/0/1", "maximum")]


def test_states_and_reported_schemas(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id int, n int")
    got = lambda s: [(r["state"], r["errors"]) for r in validation.states(df, "id", s).orderBy("id").collect()]
    assert got({"properties": {"n": {"minimum": 0, "multipleOf": 5}}}) == [("valid", 0), ("invalid", 2), ("noDocument", 0)]
    assert got(None)[0] == ("noSchema", 0) and got({"$ref": "#/x"})[0] == ("schemaError", 0)
    assert [(r["id"], r["keyword"]) for r in validation.validate_or_report(df, "id", {"$ref": "#/x"}).collect()] == [(1, "schema"), (2, "schema"), (3, "schema")]
