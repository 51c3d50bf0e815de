"""Inference of a JSON Schema over a column of JSON texts, as distributed aggregates over the table of nodes.

Positions in arrays are one step, ``[*]``. For each generalised path an aggregate gathers kinds, presence, formats and where it was first seen, which is
all that merging schemas pairwise would give: types unite, ``required`` is what every object has, a format stays only if all scalars have it, objects,
arrays and scalars at one path are alternatives. Samples are in order of the key, then of the text. Texts are walked once for each aggregate
that is asked for, examples being the second one; only columns that it needs are made, and nothing is cached.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.formats import detected
from docspark.sources.nodes import ELEMENT, dropped, is_scalar, shred, written

#: Examples kept of a path.
MOST = 5
SCHEMA = "https://json-schema.org/draft/2020-12/schema"
NOTHING = "array<string>"


def kind_of(v: Column) -> Column:
    """object, array, string, integer, number, boolean or null."""
    s = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(s == "VOID", "null")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(number == F.floor(number), "integer")
        .otherwise("number")
    )


#: Columns of nodes that facts need, and those that examples need.
FACTS = ("pre", "kind", "text", "steps")
EXAMPLES = (*FACTS, "canon")


def nodes(docs: DataFrame, key: str, json: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The nodes of every valid text, however deep up to the limit of the walk, all columns by default; see ``docspark.sources.nodes``."""
    return shred(docs, key, json, columns)


def statistics(docs: DataFrame, key: str, json: str) -> DataFrame:
    """(key, nodes, bytes, depth) of each valid text."""
    own = docs.select(key, json, F.octet_length(json).cast("bigint").alias("bytes"))
    found = shred(own, key, json, ["last", "height"], roots=True, beside=["bytes"])
    return found.select(key, "bytes", (F.col("last") + 1).cast("bigint").alias("nodes"), F.col("height").cast("bigint").alias("depth"))


def facts(found: DataFrame, key: str, required: str = "all") -> DataFrame:
    """What all nodes say of each generalised path: (steps, first, object, array, scalar, kinds, present, required, format).

    ``first`` is the place of the path's first node and ``object``, ``array``, ``scalar`` those of its first node of each class, null if there is none;
    ``kinds`` unites all kinds, integer being part of number, in order with null last; ``format`` is that of all scalars.
    """
    at = F.col("at")
    of = lambda test: F.min(F.when(test, at))
    format_ = F.when(is_scalar(F.col("kind")), F.coalesce(F.when(F.col("kind") == "string", detected(F.col("text"))), F.lit("-")))
    own = found.select("steps", "kind", F.struct(F.col(key).alias("doc"), "pre").alias("at"), format_.alias("_format"))
    per = own.groupBy("steps").agg(
        F.min(at).alias("first"), of(F.col("kind") == "object").alias("object"), of(F.col("kind") == "array").alias("array"), of(is_scalar(F.col("kind"))).alias("scalar"),
        F.collect_set("kind").alias("kinds"), F.count("*").alias("present"), F.count_if(F.col("kind") == "object").alias("objects"), F.min("_format").alias("_lo"), F.max("_format").alias("_hi"),
    )
    parents = per.select(F.col("steps").alias("_parent"), F.col("objects").alias("_of"))
    last = F.try_element_at("steps", F.lit(-1))
    parent = F.when(last != ELEMENT, F.slice("steps", F.lit(1), F.size("steps") - 1))
    merged = F.when(F.array_contains("kinds", "number"), F.array_remove("kinds", "integer")).otherwise(F.col("kinds"))
    ordered = F.concat(F.array_sort(F.array_remove(merged, "null")), F.when(F.array_contains("kinds", "null"), F.array(F.lit("null"))).otherwise(F.array().cast(NOTHING)))
    must = {"all": F.coalesce(F.col("present") == F.col("_of"), F.lit(False)), "none": F.lit(False), "any": F.col("_of").isNotNull()}[required]
    format_ = F.when((F.col("_lo") == F.col("_hi")) & (F.col("_lo") != "-"), F.col("_lo"))
    out = per.withColumn("_steps", parent).join(parents, F.col("_steps") == F.col("_parent"), "left")
    return out.select("steps", "first", "object", "array", "scalar", ordered.alias("kinds"), "present", must.alias("required"), format_.alias("format"))


def first_examples(found: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """(steps, examples): at each path the first ``most`` scalars other than null that differ in value, as (kind, text) in order of appearance.

    Values are made distinct, each with its first place, before places are ranked, so no list grows with the data.
    """
    at = F.struct(F.col(key).alias("doc"), "pre")
    some = found.filter(is_scalar(F.col("kind")) & (F.col("kind") != "null"))
    distinct = some.groupBy("steps", "canon").agg(F.min(F.struct(at.alias("at"), "kind", "text")).alias("e"))
    nth = F.row_number().over(Window.partitionBy("steps").orderBy("e"))
    kept = distinct.withColumn("nth", nth).filter(F.col("nth") <= most).groupBy("steps").agg(F.array_sort(F.collect_list(F.struct("nth", "e.kind", "e.text"))).alias("examples"))
    return kept.select("steps", F.transform("examples", lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"))).alias("examples"))


def infer(docs: DataFrame, key: str, json: str, required: str = "all", examples: bool = True) -> DataFrame:
    """``infer_nodes`` of the texts."""
    return infer_nodes(nodes(docs, key, json, EXAMPLES if examples else FACTS), key, required, examples)


def infer_nodes(found: DataFrame, key: str, required: str = "all", examples: bool = True) -> DataFrame:
    """(steps, path, kinds, present, required, format, examples, alternatives): what all texts say about each generalised path.

    ``required`` is whether every object that could have the member has it, or by policy "none" or "any" no or every member. ``examples``
    are the texts of the first five scalars, or left out, as they take a pass of their own. ``alternatives`` names object, array and scalar where several of them stand at one path, else it is empty.
    """
    per = facts(found, key, required)
    if examples:
        per = per.join(first_examples(found, key), "steps", "left")
    only_null = F.array_join("kinds", "|") == "null"
    classes = F.array_compact(F.array(F.when(F.col("array").isNotNull(), "array"), F.when(F.col("object").isNotNull(), "object"), F.when(F.exists("kinds", lambda k: ~k.isin("object", "array", "null")), "scalar")))
    nothing = F.array().cast(NOTHING)
    return per.select(
        "steps",
        F.concat(F.lit("$"), F.array_join("steps", "")).alias("path"),
        F.array_join("kinds", "|").alias("kinds"),
        "present",
        "required",
        F.when(F.array_join("kinds", "|") == "string", F.col("format")).alias("format"),
        *([F.coalesce(F.transform("examples", lambda x: x["text"]), nothing).alias("examples")] if examples else []),
        F.when((F.size(classes) > 1) & ~only_null, classes).otherwise(nothing).alias("alternatives"),
    )


def of_items(found: DataFrame) -> DataFrame:
    """The nodes of the elements of each text's outermost array, each element as a text of its own."""
    return found.filter(F.get("steps", 0) == ELEMENT).withColumn("steps", F.slice("steps", F.lit(2), F.size("steps")))


def infer_items(docs: DataFrame, key: str, json: str) -> DataFrame:
    """``infer`` with the elements of each text's outermost array as samples."""
    return infer_nodes(of_items(nodes(docs, key, json, EXAMPLES)), key)


def _quoted(text: Column) -> Column:
    """A text as JSON."""
    one = F.to_json(F.array(text))
    return F.substring(one, 2, 2**31 - 1).substr(F.lit(1), F.char_length(one) - 2)


def schema_text(found: DataFrame, key: str, required: str = "all", examples: bool = False, add_schema: bool = True) -> DataFrame:
    """(schema): the schema of all nodes as one JSON text, no row if there are none.

    Built from the deepest paths up, a join and a group by parent for each depth: members in order of first appearance, an alternative for each class in
    order of first appearance, keywords in the order type, format, properties, required, items, examples. What meets in a group is the
    members of one path of the schema, never the data. Each depth is written, so rounds don't pile up in one plan.
    """
    per = facts(found, key, required)
    if examples:
        as_json = lambda x: F.when(x["kind"] == "string", _quoted(x["text"])).otherwise(x["text"])
        per = per.join(first_examples(found, key), "steps", "left").withColumn("_examples", F.transform("examples", as_json))
    else:
        per = per.withColumn("_examples", F.lit(None).cast(NOTHING))
    per = written(per.withColumn("depth", F.size("steps")), "schema-facts")
    kids = None
    for depth in range(per.agg(F.max("depth")).first()[0] or 0, -1, -1):
        level = per.filter(F.col("depth") == depth)
        if kids is None:
            level = level.withColumns({"members": F.lit(None).cast("array<struct<first:int,name:string,text:string,required:boolean>>"), "item": F.lit(None).cast("string")})
        else:
            named = F.col("last") != ELEMENT
            below = kids.groupBy("parent").agg(
                F.array_sort(F.collect_list(F.when(named, F.struct("first", F.expr("substring(last, 2)").alias("name"), "text", "required")))).alias("members"), F.max(F.when(~named, F.col("text"))).alias("item")
            )
            level = level.join(below.withColumnRenamed("parent", "_steps"), F.col("steps") == F.col("_steps"), "left")
        last = F.coalesce(F.try_element_at("steps", F.lit(-1)), F.lit(""))
        above = level.select(F.slice("steps", F.lit(1), F.greatest(F.size("steps") - 1, F.lit(0))).alias("parent"), last.alias("last"), "first", _schema_of().alias("text"), "required")
        done = written(above, "schema-level")
        if kids is not None:
            dropped(kids)
        kids = done
    dropped(per)
    head = F.concat(F.lit(f'{{"$schema":"{SCHEMA}"'), F.when(F.col("text") == "{}", "").otherwise(","), F.expr("substring(text, 2)")) if add_schema else F.col("text")
    return kids.select(head.alias("schema"))


def _schema_of() -> Column:
    """The schema text of a path from its facts, its members and its items."""
    joined = lambda parts: F.array_join(parts, ",")
    optional = lambda test, *parts: F.when(test, F.concat(*parts)).otherwise("")
    members = F.col("members")
    must = F.filter(members, lambda m: m["required"])
    object_ = F.concat(
        F.lit('{"type":"object","properties":{'), F.coalesce(joined(F.transform(members, lambda m: F.concat(_quoted(m["name"]), F.lit(":"), m["text"]))), F.lit("")), F.lit("}"),
        F.coalesce(optional(F.size(must) > 0, F.lit(',"required":['), joined(F.transform(must, lambda m: _quoted(m["name"]))), F.lit("]")), F.lit("")), F.lit("}"),
    )
    array_ = F.concat(F.lit('{"type":"array"'), optional(F.col("item").isNotNull(), F.lit(',"items":'), F.col("item")), F.lit("}"))
    types = F.filter("kinds", lambda k: ~k.isin("object", "array"))
    one = F.concat(F.lit('"'), F.get(types, 0), F.lit('"'))
    type_ = F.when(F.size(types) == 1, one).otherwise(F.concat(F.lit("["), joined(F.transform(types, lambda t: F.concat(F.lit('"'), t, F.lit('"')))), F.lit("]")))
    scalar_ = F.concat(
        F.lit('{"type":'), type_, optional(F.col("format").isNotNull(), F.lit(',"format":"'), F.col("format"), F.lit('"')), F.coalesce(optional(F.size("_examples") > 0, F.lit(',"examples":['), joined(F.col("_examples")), F.lit("]")), F.lit("")), F.lit("}")
    )
    found = F.array_sort(F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("at"), t.alias("text"))) for c, t in (("object", object_), ("array", array_), ("scalar", scalar_))))))
    texts = F.transform(found, lambda x: x["text"])
    return F.when(F.size(texts) == 1, F.get(texts, 0)).otherwise(F.concat(F.lit('{"anyOf":['), joined(texts), F.lit("]}")))


def canonical(json: Column) -> Column:
    """A text equal for values that are equal: sorted members, numbers by value, no spaces; null for invalid texts."""
    return F.to_json(F.try_parse_json(json))
