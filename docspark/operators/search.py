"""Search for a text in the keys and values of nested rows.

The keys and scalar values of a typed row are known from its type: an array of (path, kind, text) is built in one
expression, filtered there, and only hits become rows. Values search as they are written: texts by content, numbers and booleans by
their literal, null as ``null``. Patterns are Java's with Unicode classes; one that the JVM can't compile finds nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions import patterns


def _step(name: str) -> str:
    return f".{name}" if re.fullmatch(r"[^\W\d]\w*", name) else "['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _hit(path: Column, kind: str, text: Column) -> Column:
    return F.struct(path.alias("path"), F.lit(kind).alias("kind"), text.alias("text"))


def searchable(value: Column, kind: T.DataType, path: Column, keys: bool, values: bool) -> Column:
    """An array of (path, kind, text) of a value and what is below it, in document order."""
    found: list[Column] = []
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            at = F.concat(path, F.lit(_step(f.name)))
            if keys:
                found.append(F.array(_hit(at, "key", F.lit(f.name))))
            found.append(searchable(value[f.name], f.dataType, at, keys, values))
    elif isinstance(kind, T.ArrayType):
        below = F.transform(value, lambda x, i: searchable(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), keys, values))
        found.append(F.coalesce(F.flatten(below), F.array().cast("array<struct<path:string,kind:string,text:string>>")))
    elif values:
        found.append(F.array(_hit(path, "value", F.coalesce(value.cast("string"), F.lit("null")))))
    return F.concat(*found) if found else F.array().cast("array<struct<path:string,kind:string,text:string>>")


def matcher(query: str, case_sensitive: bool = False, whole_word: bool = False, regex: bool = False):  # noqa: ANN201
    """A function from a text column to whether it matches. A pattern that can't be compiled matches nothing."""
    if not whole_word and not regex:
        return (lambda t: t.contains(query)) if case_sensitive else (lambda t: F.contains(F.lower(t), F.lit(query.lower())))
    inner = query if regex else re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", query)
    pattern = patterns.unicode(rf"(?<!\w)(?:{inner})(?!\w)" if whole_word else inner, "" if case_sensitive else "i")
    if patterns.compiled(pattern) is None:
        return lambda t: F.lit(False)
    return lambda t: t.rlike(pattern)


def search(df: DataFrame, key: str, query: str, *, case_sensitive: bool = False, whole_word: bool = False, regex: bool = False, keys: bool = True, values: bool = True) -> DataFrame:
    """(key, ord, path, kind, text): the hits in each row's other columns, in document order. An empty query finds nothing."""
    whole = T.StructType([f for f in df.schema.fields if f.name != key])
    fit = matcher(query, case_sensitive, whole_word, regex) if query else lambda t: F.lit(False)
    body = F.struct(*(F.col(f"`{n}`") for n in whole.names))
    found = F.filter(searchable(body, whole, F.lit("$"), keys, values), lambda x: fit(x["text"]))
    return df.select(key, F.posexplode(found).alias("ord", "hit")).select(key, "ord", "hit.path", "hit.kind", "hit.text")
