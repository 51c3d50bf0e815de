import json

import pytest
from pyspark.sql import functions as F

from docspark.functions import formats
from docspark.operators import collections as coll
from docspark.operators import inference, search, validation
from docspark.plans.steps import Context, Flatten, ForEach, Pipeline, SetVariable, Step, SubPipeline, Template
from docspark.sources import documents as sources


@pytest.fixture(scope="module")
def people(spark):
    rows = [(0, "b", 2.0, "5"), (1, "a", None, "x"), (2, None, 1.0, None), (3, "b", 3.0, "2")]
    return spark.createDataFrame(rows, "_pos long, k string, v double, t string").cache()


def test_collection_helpers(people):
    assert [r["_pos"] for r in coll.sort_by(people, "k").collect()] == [1, 0, 3, 2]
    assert [r["_pos"] for r in coll.sort_by(people, "v", descending=True).collect()] == [3, 0, 2, 1]
    assert {r["key"]: r["n"] for r in coll.count_by(people, "k").collect()} == {"a": 1, "b": 2, None: 1}
    assert {r["key"]: [x["v"] for x in r["items"]] for r in coll.group_by(people, "k").collect()}["b"] == [2.0, 3.0]
    assert sorted(r["_pos"] for r in coll.uniq_by(people, "k").collect()) == [0, 1, 2]
    assert coll.total(people, "t").first()["value"] == 7.0
    assert coll.total(people.limit(0), "t").first()["value"] == 0.0
    assert coll.least(people, "v").first()["value"] == 0.0
    assert coll.greatest(people.limit(0), "v").first()["value"] is None
    assert coll.compact(people, "k").count() == 3
    assert [len(r["items"]) for r in coll.chunk(people, 3).orderBy("chunk").collect()] == [3, 1]
    with pytest.raises(ValueError):
        coll.chunk(people, 0)
    assert coll.rename(people, {"k": "v"}).columns == ["_pos", "v", "t"]
    assert coll.pick(people, "t", "k", "zz").columns == ["t", "k", "_pos"]


def test_flatten(spark):
    df = spark.createDataFrame([([[[1], [2]], [[3]]],)], "a array<array<array<int>>>")
    assert coll.flatten(df, "a").first()["a"] == [[1], [2], [3]]
    assert coll.flatten(df, "a", None).first()["a"] == [1, 2, 3]
    assert coll.flatten(df, "a", 0).first()["a"] == [[[1], [2]], [[3]]]


def test_search(spark):
    df = spark.createDataFrame([(1, ("Élan", [1, 12], None))], "id int, d struct<name:string,ns:array<int>,no:string>")
    hit = lambda q, **o: [(r["path"], r["kind"]) for r in search.search(df, "id", q, **o).orderBy("ord").collect()]
    assert hit("n") == [("$.d.name", "key"), ("$.d.name", "value"), ("$.d.ns", "key"), ("$.d.no", "key"), ("$.d.no", "value")]
    assert hit("éLAN", keys=False) == [("$.d.name", "value")]
    assert hit("1", whole_word=True) == [("$.d.ns[0]", "value")]
    assert hit("^1.$", regex=True) == [("$.d.ns[1]", "value")]
    assert hit("(", regex=True) == [] and hit("") == []


def test_inference(spark):
    texts = ['{"a":1,"b":{"c":"2024-01-31"}}', '{"a":2.5,"b":{"c":"2024-02-01","d":null},"e":[1,"x",null]}', "not json"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    got = {r["path"]: (r["kinds"], r["required"], r["format"]) for r in inference.infer(df, "id", "j").collect()}
    assert got["$"][0] == "object"
    assert got["$.a"] == ("number", True, None)
    assert got["$.b.c"] == ("string", True, "date")
    assert got["$.b.d"] == ("null", False, None)
    assert got["$.e[*]"][0] == "integer|string|null"
    assert {r["id"]: (r["nodes"], r["depth"]) for r in inference.statistics(df, "id", "j").collect()} == {0: (4, 2), 1: (9, 2)}


def test_inference_of_paths_formats_and_alternatives(spark):
    texts = ['{"a":{"x.y":1},"m":[{"k":1},"t",null]}', '{"a":{"x":{"y":"z"}},"m":7}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    got = {tuple(r["steps"]): r for r in inference.infer(df, "id", "j").collect()}
    assert got[".a", ".x.y"]["kinds"] == "integer" and got[".a", ".x", ".y"]["kinds"] == "string"
    assert got[(".m",)]["alternatives"] == ["array", "scalar"] and got[".m", "[*]"]["alternatives"] == ["object", "scalar"] and got[(".a",)]["alternatives"] == []
    assert got[".m", "[*]", ".k"]["examples"] == ["1"] and got[".m", "[*]", ".k"]["required"] and not got[".a", ".x.y"]["required"]
    few = spark.createDataFrame([(1, '{"a":' * 9 + "1" + "}" * 9)], "id int, j string")
    assert inference.statistics(few, "id", "j").first()["depth"] == 9
    items = spark.createDataFrame([(1, '[{"id":1},{"id":2.5,"n":"x"}]')], "id int, j string")
    assert {r["path"]: (r["kinds"], r["required"]) for r in inference.infer_items(items, "id", "j").collect()} == {"$": ("object", False), "$.id": ("number", True), "$.n": ("string", False)}
    shapes = {
        "2024-13-01T00:00:00Z": "date-time", "2024-13-01": None, "10:00:00": None, "10:00:00Z": "time", "a@b.c": "email", "1.2.3.4": "ipv4", "01.02.03.04": None, "1.2.3": None, "1.2.3.4.": None,
        "mailto:x": "uri", "urn:a:b": "uri", "http://a": "uri", "x:y": None, "": None,
    }
    shown = spark.createDataFrame([(k,) for k in shapes], "t string").select("t", formats.detected(F.col("t")).alias("f")).collect()
    assert {r["t"]: r["f"] for r in shown} == shapes


def test_validation(spark):
    df = spark.createDataFrame([(1, "Ann", 5, ["a", "a"]), (2, None, -1, ["b"]), (3, "x-y", None, None)], "id int, name string, age int, tags array<string>")
    schema = {"required": ["name"], "properties": {"name": {"minLength": 3, "pattern": "^[A-Z]"}, "age": {"minimum": 0}, "tags": {"uniqueItems": True, "contains": {"const": "a"}}}}
    got = sorted((r["id"], r["instance_path"], r["keyword"]) for r in validation.validate(df, "id", schema).collect())
    assert got == [(1, "/tags", "uniqueItems"), (2, "", "required"), (2, "/age", "minimum"), (2, "/tags", "contains"), (3, "/name", "pattern")]
    with pytest.raises(validation.SchemaError):
        validation.validate(df, "id", {"properties": {"age": {"multipleOf": 0}}})


def found(df, schema):
    return sorted((r["id"], r["instance_path"], r["keyword"]) for r in validation.validate(df, "id", schema).collect())


def test_validation_of_members(spark):
    rows = [(1, ("a", 1, None, None)), (2, ("b", None, 2, "z")), (3, (None, 1, None, "q")), (4, None)]
    df = spark.createDataFrame(rows, "id int, d struct<name:string,x_a:int,`x-b`:int,other:string>")
    check = lambda s: found(df, {"properties": {"d": s}})
    assert check({"minProperties": 3}) == [(1, "/d", "minProperties"), (3, "/d", "minProperties")]
    assert check({"maxProperties": 2}) == [(2, "/d", "maxProperties")]
    assert check({"properties": {"name": True}, "patternProperties": {"^x-": {"maximum": 1}}, "additionalProperties": False}) == [
        (1, "/d/x_a", "false"), (2, "/d/other", "false"), (2, "/d/x-b", "maximum"), (3, "/d/other", "false"), (3, "/d/x_a", "false"),
    ]
    assert check({"propertyNames": {"pattern": "^[a-z_]+$"}}) == [(2, "/d/x-b", "pattern")]
    assert check({"dependentRequired": {"other": ["name", "x_a"]}}) == [(2, "/d", "dependentRequired"), (3, "/d", "dependentRequired")]
    assert check({"dependentSchemas": {"other": {"required": ["name"]}}}) == [(3, "/d", "required")]
    assert check({"dependencies": {"x_a": ["other"], "x-b": {"properties": {"other": {"const": "y"}}}}}) == [(1, "/d", "dependencies"), (2, "/d/other", "const")]
    assert check({"const": {"name": "a", "x_a": 1}}) == [(2, "/d", "const"), (3, "/d", "const")]


def test_validation_of_elements(spark):
    df = spark.createDataFrame([(1, [1, 5, 1, 1]), (2, []), (3, [9]), (4, None)], "id int, ns array<int>")
    check = lambda s: found(df, {"properties": {"ns": s}})
    assert check({"items": {"maximum": 4}}) == [(1, "/ns/1", "maximum"), (3, "/ns/0", "maximum")]
    assert check({"uniqueItems": True}) == [(1, "/ns", "uniqueItems")] * 2
    assert check({"prefixItems": [{"minimum": 2}, {"maximum": 3}], "items": False}) == [(1, "/ns/0", "minimum"), (1, "/ns/1", "maximum"), (1, "/ns/2", "false"), (1, "/ns/3", "false")]
    assert check({"items": [{"enum": [1, "x", None]}], "additionalItems": {"const": 5}}) == [(1, "/ns/2", "const"), (1, "/ns/3", "const"), (3, "/ns/0", "enum")]
    places = validation.by_place(validation.validate(df, "id", {"properties": {"ns": {"minItems": 2, "contains": {"const": 1}}}}), "id")
    assert {(r["id"], r["instance_path"]): r["keywords"] for r in places.collect()} == {(2, "/ns"): ["minItems", "contains"], (3, "/ns"): ["minItems", "contains"]}


def test_validation_of_references_and_numbers(spark):
    df = spark.createDataFrame([(1, 0.5, "a"), (2, 0.5000000001, "abc"), (3, 1e10, None)], "id int, v double, t string")
    schema = {"$defs": {"step": {"multipleOf": 0.25}, "short": {"$anchor": "short", "maxLength": 2}}, "properties": {"v": {"$ref": "#/$defs/step"}, "t": {"$ref": "#short"}}}
    assert found(df, schema) == [(2, "/t", "maxLength"), (2, "/v", "multipleOf")]
    assert found(df, {"properties": {"v": {"enum": [0.5, "x", None]}}}) == [(2, "/v", "enum"), (3, "/v", "enum")]
    assert found(df, {}) == [] and validation.validate(df, "id", {}).columns == ["id", "ord", "instance_path", "schema_path", "keyword", "message"]
    for bad in ({"$ref": "#/nowhere"}, {"$ref": "http://else.where/x"}, {"$ref": "#"}, {"properties": {"t": {"pattern": "("}}}):
        with pytest.raises(validation.SchemaError):
            validation.validate(df, "id", bad)


def test_validation_formats(spark):
    good = {"date-time": ["2024-02-29T10:00:00Z", "2024-01-01T23:59:60+01:00"], "ipv6": ["::1", "2001:db8::8:800", "1:2:3:4:5:6:7:8"], "uri-reference": ["a/b?c", "#x"], "date": ["2024-02-29"]}
    bad = {"date-time": ["2023-02-29T10:00:00Z", "2024-01-01T10:00:00", "2024-01-01 23:59:60+01:00"], "ipv6": ["1:2:3", "1::2::3", "12345::", ":::"], "uri-reference": ["a b"], "date": ["2023-02-29", "2024-13-01"]}
    for name in good:
        values = [(k, x) for k, x in enumerate(good[name] + bad[name])]
        df = spark.createDataFrame(values, "id int, t string")
        assert [k for k, _, _ in found(df, {"properties": {"t": {"format": name}}})] == list(range(len(good[name]), len(values))), name


def test_pipeline(spark, people):
    inner = Pipeline((Step("count", SetVariable("n", aggregate=F.count("*"))),))
    label = Pipeline((Step("sub", SubPipeline("c")), Step("label", Template("{{k}}/{{ vars.n }}/{{zz}}", "d", "label"))))
    df = people.select("_pos", F.struct("k").alias("d"))
    assert [r["label"] for r in label.run(df, Context(df, library={"c": inner})).orderBy("_pos").collect()] == ["b/4/", "a/4/", "/4/", "b/4/"]
    loop = Pipeline((Step("again", SubPipeline("again")),))
    with pytest.raises(ValueError):
        loop.run(df, Context(df, library={"again": loop}))
    body = ForEach(lambda d: F.col("v") + 1, ok=lambda d: F.col("v").isNotNull(), policy="skip")
    assert Pipeline((Step("f", body), Step("off", Flatten("zz"), enabled=False))).run(people).count() == 3
    with pytest.raises(Exception, match="item 1"):
        ForEach(lambda d: F.col("v"), ok=lambda d: F.col("v").isNotNull()).apply(people, Context(people)).collect()


def test_clean(spark):
    texts = ["```json\n{'a': 1,}\n```", ")]}',\n{\"a\":2}", json.dumps(json.dumps({"a": 3})), "{a: 4, /* c */}", "nonsense", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    assert [r["value"] and r["value"]["a"] for r in sources.clean(df, "t", "a int").orderBy("id").collect()] == [1, 2, 3, 4, None, None]


def test_group_rows(spark):
    """A hot group spreads over parts; null keys are a group; places run through each group in order."""
    from docspark.operators import collections as coll

    rows = [(k, None if k % 7 == 0 else "hot" if k % 3 else "cold") for k in range(0, 200, 2)]
    got = coll.group_rows(spark.createDataFrame(rows, "_pos long, kind string"), "kind", part=16).collect()
    want = []
    for kind in (None, "hot", "cold"):
        want += [(str(kind), n, pos) for n, pos in enumerate(k for k, x in rows if x == kind)]
    assert sorted((str(r["key"]), r["n"], r["item"]["_pos"]) for r in got) == sorted(want)


def test_whole_queries(spark, tmp_path):
    """All rows are sorted and cleaned, and texts are searched as they are."""
    import re

    from docspark.plans import catalog

    at = str(tmp_path)
    prices = [(k, float(k % 5)) for k in range(40)]
    spark.createDataFrame(prices, "p_partkey long, p_retailprice double").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame([(k, f'{{"k": {k}}}') for k in range(9)], "event_id long, props string").write.parquet(f"{at}/events.parquet")
    texts = list(enumerate(["see the end", "éthe", "theé", "The—end", "the", "不the", "other", "Vive «the» fin", None, ""]))
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    got = [tuple(r) for r in catalog.QUERIES["helper_sort_by_all"](spark, at).collect()]
    assert got == sorted(prices, key=lambda x: (-x[1], x[0]))
    assert sorted(map(tuple, catalog.QUERIES["clean_lenient_all"](spark, at).collect())) == [(k, k) for k in range(9)]
    found = sorted(r["doc_id"] for r in catalog.QUERIES["search_whole_word_unicode"](spark, at).collect())
    assert found == [k for k, t in texts if re.search(r"(?i)(?<!\w)the(?!\w)", t or "")]
