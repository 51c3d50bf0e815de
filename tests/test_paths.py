"""Paths over a nested column against a walker of plain Python values, which shares no code with them."""

import json

import pytest
from pyspark.sql import functions as F

from docspark.functions.paths import PathSyntaxError, exists, matches, nodes, parse, path

FLEET = {
    "depot": {"city": "Turku", "lanes": 3},
    "trams": [
        {"line": "A", "seats": 41, "stops": [{"at": "Quay", "wait": 2}, {"at": "Mill", "wait": 5}], "crew": {"line": "night", "size": 2}},
        {"line": "B", "seats": 17, "stops": [], "note": "old"},
        {"line": "C", "seats": 66, "stops": [{"at": "Mill", "wait": 1}], "crew": {"line": "day", "size": 1}},
    ],
    "odd key": 7,
}
KIND = (
    "depot struct<city:string,lanes:int>, trams array<struct<line:string,seats:int,stops:array<struct<at:string,wait:int>>,crew:struct<line:string,size:int>,note:string>>, `odd key` int"
)


@pytest.fixture(scope="module")
def fleet(spark):
    return spark.createDataFrame([(json.dumps(FLEET),)], "j string").select(F.from_json("j", KIND).alias("d")).cache()


def children(v):
    return list(v.items()) if isinstance(v, dict) else list(enumerate(v)) if isinstance(v, list) else []


def picked(v, selector):
    """(step, value) pairs that a selector picks of a value: a name, an index, a slice, "*" or a function as filter."""
    own = children(v)
    if callable(selector):
        return [(k, x) for k, x in own if selector(x)]
    if isinstance(selector, slice):
        return own[selector] if isinstance(v, list) else []
    if selector == "*":
        return own
    if isinstance(selector, int):
        return [own[selector]] if isinstance(v, list) and -len(own) <= selector < len(own) else []
    return [(k, x) for k, x in own if isinstance(v, dict) and k == selector]


def brute(doc, *steps):
    """(steps, value) of what the steps reach. A step is a list of selectors, below the first ".." of every node, in document order."""
    at = [((), doc)]
    for step in steps:
        out = []
        for p, v in at:
            if step[0] != "..":
                out += [((*p, k), x) for s in step for k, x in picked(v, s)]
                continue
            wanted = set()

            def visit(q, w, wanted=wanted, step=step):
                wanted |= {(*q, k) for s in step[1:] for k, _ in picked(w, s)}
                for k, x in children(w):
                    visit((*q, k), x)

            visit(p, v)

            def collect(q, w, wanted=wanted, out=out):
                for k, x in children(w):
                    if (*q, k) in wanted:
                        out.append(((*q, k), x))
                    collect((*q, k), x)

            collect(p, v)
        first = {}
        for p, v in out:
            first.setdefault(p, v)
        at = list(first.items())
    return at


CASES = {
    "$.trams[*].line": [["trams"], ["*"], ["line"]],
    "$.trams[*]['seats','line']": [["trams"], ["*"], ["seats", "line"]],
    "$.trams[*]['line','line']": [["trams"], ["*"], ["line", "line"]],
    "$['depot','depot'].city": [["depot", "depot"], ["city"]],
    "$.trams[2,0,2].line": [["trams"], [2, 0, 2], ["line"]],
    "$.trams[::-1].line": [["trams"], [slice(None, None, -1)], ["line"]],
    "$.trams[1:,0].seats": [["trams"], [slice(1, None), 0], ["seats"]],
    "$.trams[-1].crew.size": [["trams"], [-1], ["crew"], ["size"]],
    "$.trams[7].line": [["trams"], [7], ["line"]],
    "$..line": [["..", "line"]],
    "$..['wait','at']": [["..", "wait", "at"]],
    "$..*": [["..", "*"]],
    "$..*..at": [["..", "*"], ["..", "at"]],
    "$..[0]": [["..", 0]],
    "$..[::-1].line": [["..", slice(None, None, -1)], ["line"]],
    "$.trams[*].*": [["trams"], ["*"], ["*"]],
    "$.trams[*].*.size": [["trams"], ["*"], ["*"], ["size"]],
    "$.trams[?(@.seats > 20)].line": [["trams"], [lambda x: x["seats"] > 20], ["line"]],
    "$.trams[?(@.crew)]['note','seats']": [["trams"], [lambda x: "crew" in x], ["note", "seats"]],
    "$.trams[?(@..wait > 4)].line": [["trams"], [lambda x: any(s["wait"] > 4 for s in x["stops"])], ["line"]],
    "$.trams[?(@.stops[*].at == 'Mill' && !(@.line == 'A'))].line": [["trams"], [lambda x: any(s["at"] == "Mill" for s in x["stops"]) and x["line"] != "A"], ["line"]],
    "$.trams[?(@.line =~ /^[ac]$/i || @.note)].seats": [["trams"], [lambda x: x["line"] in "AC" or "note" in x], ["seats"]],
    "$.trams[?(@.seats > $.depot.lanes)].seats": [["trams"], [lambda x: x["seats"] > 3], ["seats"]],
    "$.trams[?(@.* == 41)].line": [["trams"], [lambda x: 41 in x.values()], ["line"]],
    "$[?(@[?(@.seats > 50)])]..at": [[lambda x: isinstance(x, list) and any(y["seats"] > 50 for y in x)], ["..", "at"]],
    "$.trams[*][?(@ == 'B' || @ > 60)]": [["trams"], ["*"], [lambda x: x == "B" or isinstance(x, int) and x > 60]],
    "$['odd key']": [["odd key"]],
    "$.nothing..line": [["nothing"], ["..", "line"]],
}


def shown(steps):
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else f".{k}" if k.isidentifier() else f"['{k}']" for k in steps)


@pytest.mark.parametrize("text", CASES)
def test_nodes(fleet, text):
    """Values, order, paths and pointers are those of the walker."""
    want = brute(FLEET, *CASES[text])
    got = fleet.select(nodes(fleet, "d", text).alias("n")).first()["n"]
    assert [r["path"] for r in got] == [shown(p) for p, _ in want]
    assert [r["pointer"] for r in got] == ["".join(f"/{k}" for k in p) for p, _ in want]
    values = fleet.select(F.transform(F.array(F.to_json(F.struct(matches(fleet, "d", text).alias("m")))), lambda x: x)[0].alias("m")).first()["m"]
    found = json.loads(values)["m"]
    mixed = any(isinstance(x, str) and not isinstance(v, str) for x, (_, v) in zip(found, want, strict=True))
    assert ([json.loads(x) for x in found] if mixed else found) == [v for _, v in want]


@pytest.mark.parametrize(("text", "value"), [("$.trams.length", 3), ("$.depot.city.length", 5), ("$.depot.lanes.length", None), ("$..length", []), ("depot.city", "Turku"), ("$.trams[1:1:0]", [])])
def test_path(fleet, text, value):
    found = fleet.select(path(fleet, "d", text).alias("m")).first()["m"]
    assert found == value or (not found and not value)


@pytest.mark.parametrize("text", ["$.a[", "$.a[]", "$.", "$.a b c", "$[?(@.a ==)]", "$[1.5]", "$[?(foo)]", "$.a]"])
def test_errors(text):
    with pytest.raises(PathSyntaxError):
        parse(text)


def test_maps_on_the_way_and_in_descent(spark):
    """Maps have no order among values; their nodes are found all the same."""
    df = spark.sql("SELECT named_struct('m', map('k', 1), 'a', array(named_struct('x', 2))) AS doc")
    assert [n["path"] for n in df.select(F.explode(nodes(df, "doc", "$..*")).alias("n")).select("n.*").collect()][:1] == ["$.m"]


@pytest.mark.parametrize("text", ["$[?(@ =~ /(/)]", "$[?(@ =~ '(?P<a>x)')]", "$[99999999999999999999]", "$[?(@ > 1e999)]", "$[?(" + "(" * 70 + "1" + ")" * 70 + ")]"])
def test_refused(spark, text):
    with pytest.raises(PathSyntaxError):
        parse(text)


def test_escapes_of_pairs(spark):
    assert parse(r"$['😀']")[0].selectors[0].value == "😀" and parse(r"$['\ud83d']")[0].selectors[0].value == "�"
    assert parse(r"$[?(@ =~ /\p{L}/)]")


def test_exists_needs_no_order(spark):
    df = spark.sql("SELECT named_struct('a', array(1, 2), 'b', cast(null AS int)) AS doc")
    assert [df.select(exists(df, "doc", t)).first()[0] for t in ("$.a[?(@ > 1)]", "$.b", "$..b", "$.a[5]", "$.zz")] == [True, False, False, False, False]


def test_selectors_given_twice(fleet):
    """They cost what one costs: nothing is sorted by path; equal numbers and truths are not the same selector."""
    twice, once = (fleet.select(nodes(fleet, "d", text).alias("n")) for text in ("$['trams','trams'][*]['line','line']", "$.trams[*].line"))
    assert "array_sort" not in twice._jdf.queryExecution().optimizedPlan().toString()
    assert twice.first() == once.first() and [n["pointer"] for n in twice.first()["n"]] == ["/trams/0/line", "/trams/1/line", "/trams/2/line"]
    assert [n["pointer"] for n in fleet.select(nodes(fleet, "d", "$[?(@ == true), ?(@ == 7), ?(@ == true)]").alias("n")).first()["n"]] == ["/odd key"]
