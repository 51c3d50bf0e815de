"""Validation of typed rows against a JSON Schema whose constraints become column expressions.

Each keyword of each property gives the array of its violations, which elements of arrays and entries of maps fill with their own paths; a schema
holds where the array is empty. Branches are built once and looked at through a lambda, so work grows with the depth of the schema and no
faster. Only violations become rows. Reading is strict about the schema: unfit values, references that lead nowhere or in a circle, and
patterns that the JVM can't compile are refused when the plan is built. Annotations and unknown keywords are passed over.

* Null is a missing member, also as a map's value. A map's keys are members known only at run time; keys that are no texts count as written.
* Dates are texts (yyyy-MM-dd), timestamps RFC 3339 texts, binaries base64 texts; keywords for texts apply to them as such.
* Numbers are compared exactly where the column is exact: whole numbers and decimals with the schema's digits, doubles by value. A double is a multiple
  by the digits it is written with; one too large for 38 digits is a multiple if its quotient is whole.
* A failed ``anyOf`` or ``oneOf`` also reports the errors of its best branch: one that accepts the type comes first, then fewer errors, then
  the earlier branch.
"""

from __future__ import annotations

import json
from decimal import Decimal
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions import formats, patterns

VIOLATION = "array<struct<instance_path:string,schema_path:string,keyword:string,message:string>>"


class SchemaError(ValueError):
    """A schema that can't be compiled, with the place in it."""


def _kinds(kind: T.DataType) -> set[str]:
    if isinstance(kind, (T.StructType, T.MapType)):
        return {"object"}
    if isinstance(kind, T.ArrayType):
        return {"array"}
    if isinstance(kind, T.BooleanType):
        return {"boolean"}
    if isinstance(kind, T.IntegralType):
        return {"integer", "number"}
    return {"number"} if isinstance(kind, T.NumericType) else {"string"}


def _as_text(value: Column, kind: T.DataType) -> Column:
    """What a scalar that is neither text, number nor truth value is as a JSON text."""
    if isinstance(kind, T.TimestampType):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return F.base64(value) if isinstance(kind, T.BinaryType) else value.cast("string")


def _none() -> Column:
    return F.array().cast(VIOLATION)


def _row(at: Column, where: str, keyword: str, message: str | Column) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(at.alias("instance_path"), F.lit(where).alias("schema_path"), F.lit(keyword).alias("keyword"), text.alias("message"))


def _one(at: Column, where: str, keyword: str, bad: Column, message: str | Column) -> Column:
    """The violation of a keyword, if it is one."""
    return F.when(F.coalesce(bad, F.lit(False)), F.array(_row(at, where, keyword, message))).otherwise(_none())


def _rows(found: list[Column]) -> Column:
    return F.concat(*found) if len(found) > 1 else found[0] if found else _none()


def _holds(found: Column) -> Column:
    return F.size(found) == 0


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _only(when: Column, found: list[Column]) -> list[Column]:
    return [F.when(when, _rows(found)).otherwise(_none())] if found else []


def _shown(value: Column, kind: T.DataType) -> Column:
    """A number as JSON would write it: whole ones without a point."""
    whole = (value == F.rint(value)) & (F.abs(value) < 1e15)
    return value.cast("string") if isinstance(kind, (T.IntegralType, T.DecimalType)) else F.when(whole, value.try_cast("bigint").cast("string")).otherwise(value.cast("string"))


def _literal(v: float) -> Column:
    """A number of the schema; whole ones beyond 64 bits as decimals, beyond 38 digits as doubles."""
    if isinstance(v, int) and not -(2**63) <= v < 2**63:
        return F.lit(Decimal(v)) if abs(v) < 10**38 else F.lit(float(v))
    return F.lit(v)


def _among(value: Column, kind: T.DataType, literals: list) -> Column:
    """Whether a value equals one of the literals of its own kind."""
    if isinstance(kind, T.MapType):
        pairs = lambda m: F.array_sort(F.filter(F.map_entries(m), lambda e: e["value"].isNotNull()))
        same = [pairs(value) == pairs(F.from_json(F.lit(json.dumps(x)), kind.json())) for x in literals if isinstance(x, dict)]
        return F.coalesce(*(F.when(x, True) for x in same), F.lit(False))
    if isinstance(kind, (T.StructType, T.ArrayType)):
        own = [x for x in literals if isinstance(x, dict if isinstance(kind, T.StructType) else list)]
        return F.coalesce(*(F.when(value.eqNullSafe(F.from_json(F.lit(json.dumps(x)), kind.json())), True) for x in own), F.lit(False))
    if isinstance(kind, T.BooleanType):
        own = [x for x in literals if isinstance(x, bool)]
    elif isinstance(kind, T.NumericType):
        numbers = [x for x in literals if isinstance(x, (int, float)) and not isinstance(x, bool)]
        if isinstance(kind, (T.IntegralType, T.DecimalType)):
            own = [Decimal(str(x)) for x in numbers if Decimal(str(x)).adjusted() < 38 and -Decimal(str(x)).as_tuple().exponent <= 18]
            whole = isinstance(kind, T.IntegralType)
            own = [int(x) for x in own if x == int(x) and -(2**63) <= x < 2**63] if whole else own
        else:
            own = [float(x) for x in numbers]
    else:
        own = [x for x in literals if isinstance(x, str)]
    return value.isin(*own) if own else F.lit(False)


def _multiple(value: Column, kind: T.DataType, divisor: Decimal) -> Column:
    """Whether a number is a whole multiple of the divisor."""
    digits = max(0, -divisor.normalize().as_tuple().exponent)
    by = F.lit(divisor.quantize(Decimal(1).scaleb(-digits)))
    if isinstance(kind, T.IntegralType):
        return value.cast(f"decimal({19 + digits},{digits})") % by == 0
    if isinstance(kind, T.DecimalType):
        return value % by == 0
    # A multiple has no more digits behind the point than the divisor, so a number that changes when cut to them is none.
    exact = value.cast("string").try_cast(f"decimal(38,{digits})")
    quotient = value / float(divisor)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), False).when(exact.isNotNull(), (exact.cast(kind) == value) & (exact % by == 0)).otherwise(F.abs(quotient - F.rint(quotient)) < 1e-9)


def _count(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(f"1 {one}")).otherwise(F.concat(n.cast("string"), F.lit(f" {many}")))


def _counted(n: int, one: str, many: str) -> str:
    return f"1 {one}" if n == 1 else f"{n} {many}"


def escaped(name: Column) -> Column:
    """A name as a step of a pointer."""
    return F.concat(F.lit("/"), F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def step_of(name: str) -> str:
    return "/" + name.replace("~", "~0").replace("/", "~1")


def _anchored(schema: object, name: str) -> object | None:
    """The part of a schema with this ``$anchor`` or ``$id``."""
    if isinstance(schema, dict):
        if name and name in (schema.get("$anchor"), schema.get("$id"), schema.get("$dynamicAnchor")):
            return schema
        return next((y for x in schema.values() if (y := _anchored(x, name)) is not None), None)
    return next((y for x in schema if (y := _anchored(x, name)) is not None), None) if isinstance(schema, list) else None


def resolved(root: dict | bool, ref: str) -> dict | bool:
    """What a reference within the schema ``root`` means: ``#``, a pointer, an anchor or an ``$id``."""
    base, _, part = ref.partition("#")
    at = root if not base or (isinstance(root, dict) and root.get("$id") == base) else _anchored(root, base)
    part = unquote(part)
    if at is not None and part and not part.startswith("/"):
        at = _anchored(at, part)
    for step in part.split("/")[1:] if part.startswith("/") else ():
        step = step.replace("~1", "/").replace("~0", "~")
        at = at.get(step) if isinstance(at, dict) else at[int(step)] if isinstance(at, list) and step.isdigit() and int(step) < len(at) else None
    if not isinstance(at, (dict, bool)):
        raise SchemaError(f"no schema at {ref!r}")
    return at


def checked_pattern(pattern: str, where: str) -> str:
    """A pattern of the schema as ``rlike`` takes it."""
    if patterns.compiled(patterns.unicode(pattern)) is None:
        raise SchemaError(f"bad pattern {pattern!r} at {where}")
    return patterns.unicode(pattern)


class _Members:
    """The members of an object: fields of a struct, known by name, or entries of a map, known at run time."""

    def __init__(self, value: Column, kind: T.DataType) -> None:
        self.value, self.kind, self.open = value, kind, isinstance(kind, T.MapType)
        self.names = [] if self.open else kind.names
        if self.open:
            self.entries = F.transform(F.filter(F.map_entries(value), lambda e: e["value"].isNotNull()), lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].alias("value")))

    def size(self) -> Column:
        return F.size(self.entries) if self.open else sum((self.value[x].isNotNull().cast("int") for x in self.names), F.lit(0))

    def get(self, name: str) -> tuple[Column, T.DataType] | None:
        """A member's value, null where it is missing, and its type; None if no row can have it."""
        if self.open:
            return F.get(F.filter(self.entries, lambda e: e["key"] == name), 0)["value"], self.kind.valueType
        return (self.value[name], self.kind[name].dataType) if name in self.names else None

    def has(self, name: str) -> Column:
        own = self.get(name)
        return F.lit(False) if own is None else F.exists(self.entries, lambda e: e["key"] == name) if self.open else own[0].isNotNull()

    def each(self, fits, body) -> list[Column]:  # noqa: ANN001
        """``body`` (name, value, type) of the members whose name fits: ``fits`` tells it of a Column and of a text."""
        if self.open:
            kept = F.filter(self.entries, lambda e: fits(e["key"]))
            return [F.flatten(F.transform(kept, lambda e: _rows(body(e["key"], e["value"], self.kind.valueType))))]
        out = []
        for n in self.names:
            if fits(n):
                out += _only(self.value[n].isNotNull(), body(F.lit(n), self.value[n], self.kind[n].dataType))
        return out


def tests(value: Column, kind: T.DataType, schema: dict | bool, at: Column, where: str, root: dict | bool, refs: tuple[str, ...] = ()) -> list[Column]:
    """The violations of a value at the path ``at``, keyword by keyword. ``refs`` are the references followed since the last step down into the value."""
    if isinstance(schema, bool):
        return [] if schema else [_one(at, where, "false", value.isNotNull(), "Not allowed")]
    if not isinstance(schema, dict):
        raise SchemaError(f"no schema at {where}")
    if not isinstance(kind, (T.StructType, T.MapType, T.ArrayType, T.BooleanType, T.NumericType, T.StringType)):
        value, kind = _as_text(value, kind), T.StringType()
    there = value.isNotNull()
    out: list[Column] = []
    number, text, items, members = isinstance(kind, T.NumericType), isinstance(kind, T.StringType), isinstance(kind, T.ArrayType), isinstance(kind, (T.StructType, T.MapType))
    object_ = _Members(value, kind) if members else None

    def add(keyword: str, bad: Column, message: str | Column) -> None:
        out.append(_one(at, f"{where}/{keyword}", keyword, there & bad, message))

    def same(inner: dict | bool, sub: str) -> list[Column]:
        return tests(value, kind, inner, at, f"{where}/{sub}", root, refs)

    def member(name: Column, own: Column, inner_kind: T.DataType, inner: dict | bool, sub: str) -> list[Column]:
        return tests(own, inner_kind, inner, F.concat(at, escaped(name)), f"{where}/{sub}", root)

    def elements(first: int, inner: dict | bool, sub: str) -> None:
        """Every element from ``first`` on, with its index in the path."""
        rest = F.when(F.size(value) > first, F.slice(value, first + 1, F.size(value))).otherwise(F.slice(value, 1, 0))
        own = lambda x, i: _rows(tests(x, kind.elementType, inner, F.concat(at, F.lit("/"), (i + first).cast("string")), f"{where}/{sub}", root))
        out.append(F.coalesce(F.flatten(F.transform(rest, own)), _none()))

    known = set(schema.get("properties", {}))
    named = [checked_pattern(p, where) for p in schema.get("patternProperties", {})]

    def fits(pattern: str, name: Column | str) -> Column | bool:
        return patterns.found(pattern, name) if isinstance(name, str) else name.rlike(pattern)

    def additional(name: Column | str) -> Column | bool:
        if isinstance(name, str):
            return name not in known and not any(fits(p, name) for p in named)
        bad = ~name.isin(*known) if known else F.lit(True)
        for p in named:
            bad = bad & ~fits(p, name)
        return bad

    def branches(keyword: str, inner: list) -> None:
        """One row for the keyword and those of the best branch, which is looked for among branches built once."""
        def verdict(b: Column) -> Column:
            passed = F.size(F.filter(b, _holds))
            ranked = F.transform(b, lambda x, i: F.struct(F.exists(x, lambda v: (v["keyword"] == "type") & (v["instance_path"] == at)).alias("type"), F.size(x).alias("n"), i.alias("i"), x.alias("rows")))
            best = F.coalesce(F.array_min(ranked)["rows"], _none())
            none = F.concat(F.array(_row(at, f"{where}/{keyword}", keyword, f"Does not match any of {_counted(len(inner), 'schema', 'schemas')}")), best)
            if keyword == "anyOf":
                return F.when(passed == 0, none).otherwise(_none())
            several = _row(at, f"{where}/{keyword}", keyword, F.concat(F.lit("Matches "), passed.cast("string"), F.lit(f" of {_counted(len(inner), 'schema', 'schemas')}, expected exactly one")))
            return F.when(passed == 0, none).when(passed > 1, F.array(several)).otherwise(_none())

        found = F.array(*(_rows(same(x, f"{keyword}/{i}")) for i, x in enumerate(inner)))
        out.append(F.when(there, _let(found, verdict)).otherwise(_none()))

    tuple_ = schema.get("prefixItems") or (schema.get("items") if isinstance(schema.get("items"), list) else [])
    for keyword, v in schema.items():
        if keyword in ("$ref", "$dynamicRef", "$recursiveRef"):
            if v in refs:
                raise SchemaError(f"{v!r} refers to itself at {where}")
            out += tests(value, kind, resolved(root, v), at, f"{where}/{keyword}", root, (*refs, v))
        elif keyword == "type":
            allowed = v if isinstance(v, list) else [v]
            if not set(allowed) & (_kinds(kind) | {"any"}):
                bad = value != F.floor(value) if number and "integer" in allowed else F.lit(True)
                add("type", bad, f"Expected {' or '.join(allowed)}, got {min(_kinds(kind) - {'integer'})}")
        elif keyword in ("enum", "const"):
            shown = [json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in (v if keyword == "enum" else [v])]
            add(keyword, ~_among(value, kind, v if keyword == "enum" else [v]), ("Must be one of: " if keyword == "enum" else "Must be equal to ") + ", ".join(shown))
        elif number and keyword in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum") and not isinstance(v, bool):
            low, bound = keyword in ("minimum", "exclusiveMinimum"), _literal(v)
            strict = keyword.startswith("exclusive") or schema.get("exclusive" + keyword.capitalize()) is True
            says = ("must be greater than" if strict else "is less than minimum") if low else ("must be less than" if strict else "exceeds maximum")
            bad = (value <= bound if strict else value < bound) if low else (value >= bound if strict else value > bound)
            add(keyword, bad, F.concat(F.lit("Value "), _shown(value, kind), F.lit(f" {says} {json.dumps(v)}")))
        elif number and keyword == "multipleOf":
            if not v > 0:
                raise SchemaError(f"multipleOf must be positive at {where}")
            add(keyword, ~_multiple(value, kind, Decimal(str(v))), F.concat(F.lit("Value "), _shown(value, kind), F.lit(f" is not a multiple of {json.dumps(v)}")))
        elif text and keyword in ("minLength", "maxLength"):
            n = F.char_length(value)
            says = "is less than minimum" if keyword == "minLength" else "exceeds maximum"
            add(keyword, n < v if keyword == "minLength" else n > v, F.concat(F.lit("String length "), n.cast("string"), F.lit(f" {says} {v}")))
        elif text and keyword == "pattern":
            add(keyword, ~value.rlike(checked_pattern(v, where)), f"Does not match pattern '{v}'")
        elif text and keyword == "format" and v in formats.ASSERTED:
            add(keyword, ~formats.asserted(v, value), f"Not a valid {formats.ASSERTED[v][1]}")
        elif items and keyword in ("minItems", "maxItems"):
            n = F.size(value)
            says = f"expected at {'least' if keyword == 'minItems' else 'most'} {v}"
            add(keyword, n < v if keyword == "minItems" else n > v, F.concat(F.lit("Array has "), _count(n, "item", "items"), F.lit(f", {says}")))
        elif items and keyword == "uniqueItems" and v:
            first = F.transform(value, lambda x, j: F.struct((F.array_position(F.transform(value, lambda y: F.coalesce(y.eqNullSafe(x), F.lit(False))), True) - 1).alias("i"), j.alias("j")))
            again = F.filter(first, lambda p: p["i"] < p["j"])
            message = lambda p: F.concat(F.lit("Array has duplicate items at indices "), p["i"].cast("string"), F.lit(" and "), p["j"].cast("string"))
            double = there & (F.size(value) > F.size(F.array_distinct(value)))
            out.append(F.when(double, F.transform(again, lambda p: _row(at, f"{where}/uniqueItems", keyword, message(p)))).otherwise(_none()))
        elif items and keyword == "prefixItems" or (items and keyword == "items" and isinstance(v, list)):
            for i, inner in enumerate(tuple_):
                out += tests(F.get(value, i), kind.elementType, inner, F.concat(at, F.lit(f"/{i}")), f"{where}/{keyword}/{i}", root)
        elif items and (keyword == "items" or (keyword == "additionalItems" and isinstance(schema.get("items"), list))):
            elements(len(tuple_), v, keyword)
        elif items and keyword == "contains":
            least, most = schema.get("minContains", 1), schema.get("maxContains")
            inner = v
            hits = F.size(F.filter(value, lambda x: _holds(_rows(tests(x, kind.elementType, inner, at, f"{where}/contains", root)))))
            found = lambda n: F.concat(F.lit("Found "), _count(n, "item", "items"), F.lit(" matching 'contains'"))
            says = F.lit("No items match 'contains' schema") if "minContains" not in schema else F.concat(found(hits), F.lit(f", expected at least {least}"))
            add(keyword, hits < least, says)
            if most is not None:
                add(keyword, hits > most, F.concat(found(hits), F.lit(f", expected at most {most}")))
        elif members and keyword == "required":
            for name in v:
                add(keyword, ~object_.has(name), f"Missing required property '{name}'")
        elif members and keyword in ("minProperties", "maxProperties"):
            n = object_.size()
            says = f"expected at {'least' if keyword == 'minProperties' else 'most'} {v}"
            add(keyword, n < v if keyword == "minProperties" else n > v, F.concat(F.lit("Object has "), _count(n, "property", "properties"), F.lit(f", {says}")))
        elif members and keyword in ("dependentRequired", "dependentSchemas", "dependencies"):
            for name, inner in v.items():
                if isinstance(inner, list):
                    for other in inner:
                        add(keyword, object_.has(name) & ~object_.has(other), f"Property '{other}' is required when '{name}' is present")
                elif object_.get(name) is not None:
                    out += _only(F.coalesce(object_.has(name), F.lit(False)), same(inner, f"{keyword}{step_of(name)}"))
        elif members and keyword == "propertyNames":
            out += object_.each(lambda n: F.lit(True) if isinstance(n, Column) else True, lambda n, _, __, inner=v: tests(n, T.StringType(), inner, F.concat(at, escaped(n)), f"{where}/propertyNames", root))
        elif members and keyword == "properties":
            for name, inner in v.items():
                if (own := object_.get(name)) is not None:
                    out += member(F.lit(name), own[0], own[1], inner, f"properties{step_of(name)}")
        elif members and keyword == "patternProperties":
            for pattern, inner in v.items():
                p = checked_pattern(pattern, where)
                out += object_.each(lambda n, p=p: fits(p, n), lambda n, own, k, inner=inner, sub=f"patternProperties{step_of(pattern)}": member(n, own, k, inner, sub))
        elif members and keyword == "additionalProperties":
            out += object_.each(additional, lambda n, own, k, inner=v: member(n, own, k, inner, "additionalProperties"))
        elif keyword == "allOf":
            for i, inner in enumerate(v):
                out += same(inner, f"allOf/{i}")
        elif keyword in ("anyOf", "oneOf"):
            branches(keyword, v)
        elif keyword == "not":
            add(keyword, _holds(_rows(same(v, "not"))), "Must not match schema")
        elif keyword == "if" and ("then" in schema or "else" in schema):
            yes, no = (_rows(same(schema.get(b, True), b)) for b in ("then", "else"))
            out.append(F.when(there, _let(_rows(same(v, "if")), lambda c: F.when(_holds(c), yes).otherwise(no))).otherwise(_none()))
    return [F.when(there, _rows(out)).otherwise(_none())] if members or items else out


def validate(df: DataFrame, key: str, schema: dict | bool) -> DataFrame:
    """(key, ord, instance_path, schema_path, keyword, message): a row for each violation in a row's other columns, ``ord`` numbering those of a row."""
    whole = T.StructType([f for f in df.schema.fields if f.name != key])
    body = F.struct(*(F.col(f"`{n}`") for n in whole.names))
    found = F.array_distinct(_rows(tests(body, whole, schema, F.lit(""), "#", schema)))
    return df.select(key, F.posexplode(found).alias("ord", "_violation")).select(key, "ord", "_violation.*")


def validate_or_report(df: DataFrame, key: str, schema: dict | bool) -> DataFrame:
    """Like ``validate``; a schema that can't be compiled is one violation of each row, with the keyword ``schema``."""
    try:
        return validate(df, key, schema)
    except SchemaError as e:
        return df.select(key, F.lit(0).alias("ord"), F.lit("").alias("instance_path"), F.lit("#").alias("schema_path"), F.lit("schema").alias("keyword"), F.lit(str(e)).alias("message"))


def by_place(violations: DataFrame, key: str) -> DataFrame:
    """(key, instance_path, keywords): the violated keywords of each place of each row, in order."""
    own = F.array_sort(F.collect_list(F.struct("ord", "keyword")))
    return violations.groupBy(key, "instance_path").agg(F.transform(own, lambda x: x["keyword"]).alias("keywords"))


def states(df: DataFrame, key: str, schema: dict | bool | None) -> DataFrame:
    """(key, state, errors) of each row: noSchema, schemaError, noDocument where all other columns are null, valid or invalid, and how many violations."""
    missing = F.forall(F.array(*(F.col(f"`{n}`").isNull() for n in df.columns if n != key)), lambda x: x)
    if schema is None:
        return df.select(key, F.lit("noSchema").alias("state"), F.lit(0).alias("errors"))
    try:
        whole = T.StructType([f for f in df.schema.fields if f.name != key])
        n = F.size(F.array_distinct(_rows(tests(F.struct(*(F.col(f"`{c}`") for c in whole.names)), whole, schema, F.lit(""), "#", schema))))
    except SchemaError:
        return df.select(key, F.lit("schemaError").alias("state"), F.lit(0).alias("errors"))
    return df.select(key, F.when(missing, "noDocument").when(n == 0, "valid").otherwise("invalid").alias("state"), F.when(missing, 0).otherwise(n).alias("errors"))
