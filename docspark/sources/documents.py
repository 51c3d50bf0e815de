"""Reading, repairing and writing collections of JSON texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, json): one row for each file, read as UTF-8 or, where it isn't that, as Latin-1."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1")).alias("json"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(json): one row for each line that isn't blank."""
    return spark.read.text(path).select(F.col("value").alias("json")).filter(F.trim("json") != "")


def write_lines(df: DataFrame, path: str) -> None:
    """The rows of ``df`` as JSON, one on each line."""
    df.write.mode("overwrite").json(path)


FENCE = r"(?s)^```[A-Za-z0-9]*\s*\n(.*?)\n?```\s*$"


def unwrap(text: Column) -> Column:
    """A text without byte-order mark, code fence and guard against script inclusion."""
    t = F.trim(F.regexp_replace(text, "^﻿", ""))
    t = F.regexp_replace(t, FENCE, "$1")
    return F.trim(F.regexp_replace(t, r"^\)\]\}',?\s*", ""))


LENIENT = {"allowComments": "true", "allowSingleQuotes": "true", "allowUnquotedFieldNames": "true", "allowNonNumericNumbers": "true", "mode": "PERMISSIVE"}


#: Texts and comments, which repairs pass over.
KEPT = r"""/\*.*?\*/|//[^\n]*|"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'"""


def _plain_numbers(text: Column) -> Column:
    """Numbers such as ``+1``, ``.5`` and ``5.`` as JSON writes them, outside texts and comments."""

    def mended(token: Column) -> Column:
        t = F.regexp_replace(token, r"(?<![\w.])\+(?=[\d.IN])", "")
        return F.regexp_replace(F.regexp_replace(t, r"(?<![\w.])\.(?=\d)", "0."), r"(?<=\d)\.(?!\d)", "")

    tokens = F.regexp_extract_all(text, F.lit(rf"(?s){KEPT}|[^\"'/]++|."), F.lit(0))
    return F.array_join(F.transform(tokens, lambda x: F.when(x.rlike("^[\"'/]"), x).otherwise(mended(x))), "")


def clean(df: DataFrame, text: str, schema: T.StructType | str, into: str = "value", notes: str | None = None) -> DataFrame:
    """Add ``into``: the text read as ``schema``, strictly if that goes, else leniently, after unwrapping and up to five levels of
    string encoding; null if nothing helps. Trailing commas before a closing bracket are taken out for the lenient reading, and numbers
    without a digit before or after the point or with a plus sign are written out.

    ``notes`` adds what was done to a text that could be read: ``fence``, ``guard``, ``unwrapped``, ``repaired``.
    """
    wrapped = F.col(text)

    def inner(t: Column) -> Column:
        own = F.from_json(F.concat(F.lit('{"v":'), t, F.lit("}")), "v string")["v"]
        return F.when(t.startswith('"'), F.coalesce(unwrap(own), t)).otherwise(t)

    t = F.aggregate(F.sequence(F.lit(1), F.lit(5)), unwrap(wrapped), lambda acc, _: inner(acc))
    df = df.select("*", F.explode(F.array(t)).alias("_unwrapped"))
    t = F.col("_unwrapped")
    # Texts and comments are matched first and kept, so that only commas between values go.
    lenient = F.regexp_replace(_plain_numbers(t), rf"(?s)({KEPT})|,(\s*(?:(?:/\*.*?\*/|//[^\n]*\n)\s*)*[\]}}])", "$1$2")
    valid = F.try_parse_json(t).isNotNull()
    df = df.withColumn(into, F.coalesce(F.when(valid, F.from_json(t, schema)), F.from_json(lenient, schema, LENIENT)))
    if notes is not None:
        bare = F.trim(F.regexp_replace(wrapped, "^\ufeff", ""))
        unfenced = F.trim(F.regexp_replace(bare, FENCE, "$1"))
        # A text that isn't JSON is read leniently into a row of nulls.
        read = valid | F.exists(F.array(*(F.col(into)[n].isNotNull() for n in df.schema[into].dataType.names)), lambda x: x)
        done = ((bare.startswith("```"), "fence"), (unfenced.startswith(")]}"), "guard"), (unwrap(wrapped) != t, "unwrapped"), (~valid, "repaired"))
        df = df.withColumn(notes, F.when(read, F.array_compact(F.array(*(F.when(w, n) for w, n in done)))).otherwise(F.array().cast("array<string>")))
    return df.drop("_unwrapped")


def typed(df: DataFrame, json: str, schema: T.StructType | str) -> DataFrame:
    """The members of a JSON column as columns, beside the others."""
    return df.withColumn("_v", F.from_json(json, schema)).select("*", "_v.*").drop("_v", json)


def minified(json: Column) -> Column:
    """The text without spaces and with sorted members; null if it isn't valid."""
    return F.to_json(F.try_parse_json(json))


def infer_type(df: DataFrame, json: str) -> str:
    """The Spark type, as DDL, that fits all texts of a column."""
    return df.agg(F.expr(f"schema_of_variant_agg(try_parse_json(`{json}`))")).first()[0].replace("OBJECT<", "STRUCT<")
