"""Queries over ragged texts, which take one of several shapes by row, with SQL on the flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators import inference, tree_validation, trees
from docspark.plans.catalog import query, table
from docspark.sources.nodes import shred

#: Line items in the order that the texts have them.
_NTH = (
    "(SELECT l_orderkey AS k, l_quantity::BIGINT AS q, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag) - 1 AS i"
    " FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"
)
#: Where the items of an order stand.
_AT = "CASE k % 3 WHEN 0 THEN '/items' WHEN 1 THEN '' ELSE '/order/items' END"


def _item() -> Column:
    """An item: its flag is null for N, missing for A."""
    flag = F.when(F.col("l_returnflag") == "N", F.lit(',"f":null')).when(F.col("l_returnflag") == "A", F.lit("")).otherwise(F.concat(F.lit(',"f":"'), F.col("l_returnflag"), F.lit('"')))
    return F.concat(F.lit('{"q":'), F.col("l_quantity").cast("bigint").cast("string"), flag, F.lit("}"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, price, items): an order with the texts of its items in order."""
    own = F.struct("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", _item().alias("text"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(own)).alias("items"))
    o = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select("o_orderkey", F.floor("o_totalprice").cast("string").alias("price"), F.transform("items", lambda x: x["text"]).alias("items"))


def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, json): an object with its items, an array of items, or an object within an object, by turns."""
    items = F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))
    turn = F.col("o_orderkey") % 3
    text = (
        F.when(turn == 0, F.concat(F.lit('{"key":'), F.col("o_orderkey").cast("string"), F.lit(',"note":null,"items":'), items, F.lit("}")))
        .when(turn == 1, items)
        .otherwise(F.concat(F.lit('{"order":{"price":'), F.col("price"), F.lit('.50,"items":'), items, F.lit("}}")))
    )
    return _items(spark, sf_dir).select("o_orderkey", text.alias("json"))


def _nodes(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Nodes with the columns that a query of one scan needs; nothing is written."""
    return shred(ragged(spark, sf_dir), "o_orderkey", "json", columns or None)


@query(f"SELECT k AS o_orderkey, i AS ord, {_AT} || '/' || i || '/q' AS pointer, q::VARCHAR AS value FROM {_NTH}")
def node_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name at any depth of texts of several shapes, in order."""
    found = trees.select_nodes(_nodes(spark, sf_dir, "pre", "name", "text", "pointer", "start", "length", "json"), "o_orderkey", "$..q")
    return found.select("o_orderkey", F.col("ord").cast("bigint").alias("ord"), "pointer", "value")


@query(f"SELECT k AS o_orderkey, {_AT} || '/' || i AS pointer, '{{\"q\":' || q || ',\"f\":null}}' AS value FROM {_NTH} WHERE f = 'N' AND q > 20")
def node_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose flag is there and null, with a number to compare; the node's text as it is."""
    nodes = _nodes(spark, sf_dir, "pre", "sib", "text", "pointer", "start", "length", "json", "kids")
    return trees.select_nodes(nodes, "o_orderkey", "$..[?(@.f == null && @.q > 20)]").select("o_orderkey", "pointer", "value")


@query(
    f"SELECT k AS o_orderkey, {_AT} || '/' || i AS pointer, 'exists' AS test FROM {_NTH} WHERE f <> 'A'"
    f" UNION ALL SELECT k, {_AT} || '/' || i, 'missing' FROM {_NTH} WHERE f = 'A' UNION ALL SELECT k, {_AT} || '/' || i, 'both missing' FROM {_NTH}"
    f" UNION ALL SELECT k, {_AT} || '/' || i, 'not R' FROM {_NTH} WHERE f <> 'R'"
)
def path_null_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null against missing: a null member exists, a missing one doesn't; two missing ones are equal; a missing one is unequal to a text."""
    tests = {"exists": "@.q && @.f", "missing": "@.q && !@.f", "both missing": "@.q && @.no == @.nothing", "not R": "@.q && @.f != 'R'"}
    path = f"$..[{','.join(f'?({test})' for test in tests.values())}]"
    found = trees.select_nodes(_nodes(spark, sf_dir, "pre", "sib", "pointer", "kids"), "o_orderkey", path, values=False, picked=True)
    names = F.array(*(F.lit(name) for name in tests))
    return found.select("o_orderkey", "pointer", F.explode(F.transform("picked", lambda k: F.get(names, k))).alias("test"))


@query(f"SELECT DISTINCT k AS o_orderkey FROM {_NTH} WHERE q = 50")
def node_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in which a path matches."""
    return trees.node_exists(_nodes(spark, sf_dir, "pre", "sib", "kids"), "o_orderkey", "$..[?(@.q == 50)]")


@query(
    f"SELECT k AS o_orderkey, {_AT} || '/' || i || '/q' AS path, 'value' AS kind FROM {_NTH} WHERE q::VARCHAR LIKE '%50%'"
    " UNION ALL SELECT o_orderkey, '/key', 'value' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey::VARCHAR LIKE '%50%' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)"
    " UNION ALL SELECT o_orderkey, '/order/price', 'value' FROM orders WHERE o_orderkey % 3 = 2 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)"
)
def node_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers are found by the digits they are written with."""
    found = trees.search_nodes(_nodes(spark, sf_dir, "pre", "name", "text", "path"), "o_orderkey", "50")
    pointer = F.regexp_replace(F.regexp_replace(F.expr("substring(path, 2)"), r"\[(\d+)\]", "/$1"), r"\.", "/")
    return found.select("o_orderkey", pointer.alias("path"), "kind")


@query(
    "WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),"
    " first AS (SELECT min(k) FILTER (WHERE k % 3 <> 1) < min(k) FILTER (WHERE k % 3 = 1) AS object, min(k) FILTER (WHERE k % 3 = 0) < min(k) FILTER (WHERE k % 3 = 2) AS flat FROM o),"
    " part AS (SELECT flat, object, '{\"type\":\"array\",\"items\":{\"type\":\"object\",\"properties\":{\"q\":{\"type\":\"integer\"},\"f\":{\"type\":[\"string\",\"null\"]}},\"required\":[\"q\"]}}' AS items FROM first),"
    " item AS (SELECT l_orderkey % 3 AS t, l_returnflag AS f FROM lineitem),"
    " whole AS (SELECT object, items, '\"key\":{\"type\":\"integer\"},\"note\":{\"type\":\"null\"},\"items\":' || items AS a, '\"order\":{\"type\":\"object\",\"properties\":{\"price\":{\"type\":\"number\"},\"items\":' || items || '},\"required\":[\"price\",\"items\"]}' AS b, flat FROM part),"
    " one AS (SELECT object, items, '{\"type\":\"object\",\"properties\":{' || CASE WHEN flat THEN a || ',' || b ELSE b || ',' || a END || '}}' AS o FROM whole)"
    " SELECT '{\"$schema\":\"https://json-schema.org/draft/2020-12/schema\",\"anyOf\":[' || CASE WHEN object THEN o || ',' || items ELSE items || ',' || o END || ']}' AS schema FROM one"
)
def infer_schema_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One schema for texts of all shapes: alternatives and members in order of first appearance, required members, a type with null."""
    return inference.schema_text(inference.nodes(ragged(spark, sf_dir), "o_orderkey", "json", inference.FACTS), "o_orderkey")


@query(
    "WITH v AS (SELECT event_id, json_extract_string(props, '$.k') AS t, min(event_id) OVER (PARTITION BY json_extract_string(props, '$.k')) AS first FROM events),"
    " r AS (SELECT t, row_number() OVER (ORDER BY first) AS n FROM (SELECT DISTINCT t, first FROM v))"
    " SELECT '$.k' AS path, n, t AS example FROM r WHERE n <= 5"
)
def infer_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five values seen, in order."""
    found = inference.infer(table(spark, sf_dir, "events"), "event_id", "props").filter("path = '$.k'")
    return found.select("path", F.posexplode("examples").alias("n", "example")).select("path", (F.col("n") + 1).cast("bigint").alias("n"), "example")


_REPLY = "(SELECT k, q, f, repeat('/replies/0', i::INTEGER) AS place FROM " + _NTH + ")"


@query(
    f"SELECT k AS o_orderkey, place || '/q' AS instance_path, 'anyOf' AS keyword, 'Does not match any of 2 schemas' AS message FROM {_REPLY} WHERE q > 10 AND q % 5 <> 0"
    f" UNION ALL SELECT k, place || '/q', 'maximum', 'Value ' || q || ' exceeds maximum 10' FROM {_REPLY} WHERE q > 10 AND q % 5 <> 0"
    f" UNION ALL SELECT k, place || '/f', 'type', 'Expected string, got null' FROM {_REPLY} WHERE f = 'N'"
    f" UNION ALL SELECT k, place, 'required', 'Missing required property ''f''' FROM {_REPLY} WHERE f = 'A'"
)
def validate_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments within comments, as deep as an order has items, by a schema that refers to itself."""
    inner = F.aggregate(F.reverse("items"), F.lit(""), lambda below, x: F.concat(x.substr(F.lit(1), F.char_length(x) - 1), F.lit(',"replies":['), below, F.lit("]}")))
    texts = _items(spark, sf_dir).select("o_orderkey", inner.alias("json"))
    comment = {
        "type": "object", "required": ["q", "f"],
        "properties": {"q": {"type": "integer", "anyOf": [{"maximum": 10}, {"multipleOf": 5}]}, "f": {"type": "string"}, "replies": {"type": "array", "items": {"$ref": "#/$defs/comment"}}},
    }
    found = tree_validation.validate(texts, "o_orderkey", "json", {"$defs": {"comment": comment}, "$ref": "#/$defs/comment"})
    return found.select("o_orderkey", "instance_path", "keyword", "message")


#: The texts as SQL builds them, and what they hold.
_TEXTS = (
    "(WITH i AS (SELECT k, string_agg('{\"q\":' || q || CASE f WHEN 'N' THEN ',\"f\":null' WHEN 'A' THEN '' ELSE ',\"f\":\"' || f || '\"' END || '}', ',' ORDER BY i) AS items, sum(CASE f WHEN 'A' THEN 2 ELSE 3 END)::BIGINT AS inner_nodes FROM "
    + _NTH
    + " GROUP BY k) SELECT k, inner_nodes, CASE k % 3 WHEN 0 THEN '{\"key\":' || k || ',\"note\":null,\"items\":[' || items || ']}' WHEN 1 THEN '[' || items || ']'"
    " ELSE '{\"order\":{\"price\":' || floor(o_totalprice)::BIGINT || '.50,\"items\":[' || items || ']}}' END AS text FROM i JOIN orders ON o_orderkey = k)"
)


@query(f"SELECT k AS o_orderkey, inner_nodes + CASE k % 3 WHEN 1 THEN 1 ELSE 4 END AS nodes, strlen(text)::BIGINT AS bytes, (CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 4 END)::BIGINT AS depth FROM {_TEXTS}")
def json_statistics_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, bytes and depth of texts of several shapes."""
    return inference.statistics(ragged(spark, sf_dir), "o_orderkey", "json")


@query(f"SELECT k AS o_orderkey, text AS json FROM {_TEXTS}")
def json_minified_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with spaces, line feeds and a name given twice, minified: numbers as written, members in their order, the last value of a name."""
    spaced = F.regexp_replace(F.regexp_replace("json", ":", " :\n"), ",", " ,\t")
    twice = F.regexp_replace(spaced, '"key"', '"key":0,"key"')
    return shred(ragged(spark, sf_dir).select("o_orderkey", twice.alias("json")), "o_orderkey", "json", ["json"], roots=True)


@query(f"SELECT k AS o_orderkey, CASE k % 3 WHEN 1 THEN '/0' ELSE CASE k % 3 WHEN 0 THEN '/items/0' ELSE '/order/items/0' END END AS pointer, q::VARCHAR AS q, CASE f WHEN 'A' THEN 'missing' WHEN 'N' THEN 'null' ELSE f END AS flag FROM {_NTH} WHERE i = 0")
def node_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by pointer, whatever stands around them; a null member apart from a missing one."""
    first = _nodes(spark, sf_dir, "pointer", "kids").filter(F.col("pointer").isin("/0", "/items/0", "/order/items/0"))
    member = lambda name: F.get(F.filter("kids", lambda k: k["name"] == name), 0)["text"]
    return first.filter(F.exists("kids", lambda k: k["name"] == "q")).select("o_orderkey", "pointer", member("q").alias("q"), F.coalesce(member("f"), F.lit("missing")).alias("flag"))
