import pytest
from pyspark.sql import functions as F

from docspark.operators import edits
from docspark.sources import documents as sources

KIND = "id int, d struct<a:int,`x.y`:string,list:array<struct<n:int,t:string>>,grid:array<array<int>>>"


@pytest.fixture(scope="module")
def df(spark):
    rows = [(1, (5, "p", [(1, "u"), (2, "v")], [[1, 2], [3]])), (2, (None, None, [], None)), (3, None)]
    return spark.createDataFrame(rows, KIND).cache()


def values(df):
    return {r["id"]: r["d"].asDict(recursive=True) if r["d"] else None for r in df.collect()}


def test_at(df):
    got = df.select("id", *(edits.at(df, "d", p).alias(str(k)) for k, p in enumerate(("/a", "/x.y", "/list/1/t", "/grid/0/1", "/list/7", "/zz/0", "/list/-"))))
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, 5, "p", "v", 2, None, None, None), (2, *[None] * 7), (3, *[None] * 7)]
    with pytest.raises(edits.EditError):
        edits.at(df, "d", "a")


def test_put(df):
    got = values(edits.put(df, "d", "/x.y", F.lit(True)))
    assert got[1]["x.y"] is True and list(got[1]) == ["a", "x.y", "list", "grid"] and got[3] is None
    got = values(edits.put(df, "d", "/more", F.col("id")))
    assert list(got[1])[-1] == "more" and got[2]["more"] == 2 and got[3] is None
    got = values(edits.put(df, "d", "/list/1/t", F.lit("w")))
    assert got[1]["list"] == [{"n": 1, "t": "u"}, {"n": 2, "t": "w"}] and got[2]["list"] == []
    got = values(edits.put(df, "d", "/grid/1/0", F.lit(9)))
    assert got[1]["grid"] == [[1, 2], [9]] and got[2]["grid"] is None
    assert values(edits.put(df, "d", "/grid/5/0", F.lit(9))) == values(df)
    assert [r["d"] for r in edits.put(df, "d", "", F.lit(1)).collect()] == [1, 1, 1]
    for bad in ("/zz/a", "/a/b", "/list/x/n"):
        with pytest.raises(edits.EditError):
            edits.put(df, "d", bad, F.lit(1))


def test_remove(df):
    assert list(values(edits.remove(df, "d", "/x.y"))[1]) == ["a", "list", "grid"]
    assert values(edits.remove(df, "d", "/list/0"))[1]["list"] == [{"n": 2, "t": "v"}]
    assert values(edits.remove(df, "d", "/list/0/t"))[1]["list"] == [{"n": 1, "t": None}, {"n": 2, "t": "v"}]
    assert values(edits.remove(df, "d", "/grid/0/0"))[1]["grid"] == [[2], [3]]
    assert values(edits.remove(df, "d", "/list/9")) == values(df)
    for bad in ("", "/zz"):
        with pytest.raises(edits.EditError):
            edits.remove(df, "d", bad)
    with pytest.raises(edits.EditError):
        edits.remove(df.select(F.struct("id").alias("d")), "d", "/id")


def test_insert(df):
    item = F.struct(F.lit(0).alias("n"), F.lit("z").alias("t"))
    assert [x["n"] for x in values(edits.insert_item(df, "d", "/list", item))[1]["list"]] == [1, 2, 0]
    got = values(edits.insert_item(df, "d", "/list", item, 1))
    assert [x["n"] for x in got[1]["list"]] == [1, 0, 2] and got[2]["list"] == []
    assert values(edits.insert_item(df, "d", "/list", item, 0))[2]["list"] == [{"n": 0, "t": "z"}]
    assert values(edits.insert_item(df, "d", "/grid/1", F.lit(7), 0))[1]["grid"] == [[1, 2], [7, 3]]
    got = values(edits.insert_member(df, "d", "", "a", F.lit("new"), 2))
    assert list(got[1]) == ["x.y", "list", "a", "grid"] and got[1]["a"] == "new" and got[3] is None
    assert list(values(edits.insert_member(df, "d", "", "b", F.lit(1), 99))[1])[-1] == "b"
    for call in (lambda: edits.insert_item(df, "d", "/a", item), lambda: edits.insert_item(df, "d", "/list", item, -1), lambda: edits.insert_member(df, "d", "/list/0", "m", item)):
        with pytest.raises(edits.EditError):
            call()


def test_rename(df):
    got = values(edits.rename_member(df, "d", "/x.y", "z"))
    assert list(got[1]) == ["a", "z", "list", "grid"] and got[1]["z"] == "p" and got[3] is None
    assert values(edits.rename_member(df, "d", "/a", "list")) == values(df)
    with pytest.raises(edits.EditError):
        edits.rename_member(df, "d", "/zz", "z")


def test_preview(df):
    kind = df.schema["d"].dataType
    got = df.select(edits.preview(F.col("d"), kind).alias("d"), edits.preview(F.col("d.list"), kind["list"].dataType).alias("l"), edits.preview(F.col("d")["x.y"], kind["x.y"].dataType, 2).alias("s"), "id")
    assert [tuple(r)[:3] for r in got.orderBy("id").collect()] == [("{ 4 keys }", "[ 2 items ]", '"…'), ("{ 1 key }", "[]", "n…"), ("null", "null", "n…")]


def test_read_files_of_other_encodings(spark, tmp_path):
    (tmp_path / "a.json").write_bytes('{"k": "é"}'.encode())
    (tmp_path / "b.json").write_bytes('{"k": "é"}'.encode("latin-1"))
    assert [r["json"] for r in sources.read_files(spark, str(tmp_path)).orderBy("path").collect()] == ['{"k": "é"}'] * 2


def test_clean_notes_and_numbers(spark):
    texts = {
        '{"k": 1}': (1.0, []),
        "```json\n{'k': +.5}\n```": (0.5, ["fence", "repaired"]),
        ")]}'\n{\"k\": 5.}": (5.0, ["guard", "repaired"]),
        '"{\\"k\\": 2}"': (2.0, ["unwrapped"]),
        "{k: -.25e1, s: '+.5 and 5.'}": (-2.5, ["repaired"]),
        "nothing": (None, []),
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: (r["value"]["k"] if r["value"] else None, r["notes"]) for r in sources.clean(df, "t", "k double, s string", notes="notes").collect()}
    assert got == texts
    assert sources.clean(df, "t", "k double, s string").filter("t like '{k%'").first()["value"]["s"] == "+.5 and 5."
