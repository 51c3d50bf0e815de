"""Validation of ragged documents: a JSON Schema over the table of nodes, recursive references included.

Which places of the schema apply to a node follows from the steps that lead to it, however deep a recursive reference goes. They are found once for each shape
of path, that is its steps as far as the schema tells them apart, and each node looks up those of its own; shapes are few, and broadcast. Places reached by ``properties``, ``items``, ``allOf`` and references apply for sure, and their violations are
the result. Only places under branches (``anyOf`` and its kin, ``contains``) need a verdict first: what fails at a node and below. Verdicts
go up by the height of a branch in the schema, or by depth where a branch refers to itself; then the branches that report, such as the best one of a failed ``anyOf``,
are followed down until none has places below. Each of these rounds is written. Where branches look at nothing below, all of it is in the node's own row:
one scan, no join but with the shapes, and nothing written.

Members of a node are in its row. A document's nodes meet by document and parent only, so work spreads over the nodes of a large document too. Nodes tell null from missing, so a
null member is there. Numbers are compared by their doubles, multiples by their digits. A false schema reports the keyword ``false`` at its node.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions import formats
from docspark.operators import validation as typed
from docspark.operators.validation import VIOLATION, SchemaError
from docspark.sources.nodes import ELEMENT, dropped, literal_canon, shred, written

KIDS = "array<struct<sib:int,name:string,canon:string>>"
#: Sets of places that nodes can have, at most, for the walk to tell them; with more, or with patterns, they are looked up by shape.
MOST_STATES = 1000
#: The columns of nodes that keywords ask for.
ASKED = {
    "text": {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "format"},
    "num": {"minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"},
    "n": {"minItems", "maxItems", "minProperties", "maxProperties", "uniqueItems"},
    "canon": {"enum", "const"},
    "kids": {"uniqueItems", "propertyNames"},
    "names": {"required", "dependentRequired", "dependencies", "dependentSchemas"},
}


@dataclass
class Place:
    """A schema at its pointer, and the places that apply to the same node."""

    at: str
    schema: dict | bool
    every: list[str] = field(default_factory=list)
    any_of: list[str] = field(default_factory=list)
    one_of: list[str] = field(default_factory=list)
    not_: str | None = None
    if_: tuple[str, str | None, str | None] | None = None
    dependent: dict[str, str] = field(default_factory=dict)

    def same(self) -> list[str]:
        """All places that its verdict at a node needs there."""
        return [*self.every, *self.any_of, *self.one_of, *filter(None, [self.not_, *(self.if_ or ())]), *self.dependent.values()]


class Places:
    """The places of a schema, found from the root on."""

    def __init__(self, root: dict | bool) -> None:
        self.root, self.found, self._at, self.below = root, {}, {}, {}
        #: The names of a node's members.
        self.names = F.col("kids")["name"]
        self._index(root, "#")
        self._visit("#", root)
        for p in self.found.values():
            self.closure(p.at)  # a reference that leads back without a step down is refused here
            self.below[p.at] = {at for _, _, at in self.ways(p)}

    def _index(self, schema: object, at: str) -> None:
        if isinstance(schema, dict):
            self._at.setdefault(id(schema), at)
        for k, x in schema.items() if isinstance(schema, dict) else enumerate(schema) if isinstance(schema, list) else ():
            self._index(x, at + typed.step_of(str(k)))

    def _visit(self, at: str, schema: object) -> str:
        if at in self.found:
            return at
        if not isinstance(schema, (dict, bool)):
            raise SchemaError(f"no schema at {at}")
        p = self.found[at] = Place(at, schema)
        if isinstance(schema, bool):
            return at
        sub = lambda k, x: self._visit(f"{at}/{k}", x)
        for keyword, v in schema.items():
            if keyword in ("$ref", "$dynamicRef", "$recursiveRef"):
                target = typed.resolved(self.root, v)
                p.every.append(self._visit(self._at.get(id(target), at + "/" + keyword) if isinstance(target, dict) else at + "/" + keyword, target))
            elif keyword in ("allOf", "anyOf", "oneOf"):
                {"allOf": p.every, "anyOf": p.any_of, "oneOf": p.one_of}[keyword].extend(sub(f"{keyword}/{i}", x) for i, x in enumerate(v))
            elif keyword == "not":
                p.not_ = sub("not", v)
            elif keyword == "if":
                p.if_ = (sub("if", v), *(sub(b, schema[b]) if b in schema else None for b in ("then", "else")))
            elif keyword in ("dependentSchemas", "dependencies"):
                p.dependent |= {n: sub(keyword + typed.step_of(n), x) for n, x in v.items() if not isinstance(x, list)}
            elif keyword in ("properties", "patternProperties"):
                for n, x in v.items():
                    sub(keyword + typed.step_of(n), x)
            elif keyword in ("prefixItems", "items", "additionalItems", "contains", "additionalProperties"):
                for i, x in enumerate(v) if isinstance(v, list) else ((None, v),):
                    sub(keyword if i is None else f"{keyword}/{i}", x)
        return at

    def closure(self, at: str, above: tuple[str, ...] = ()) -> list[str]:
        """A place and all others at the same node, those that are needed first."""
        if at in above:
            raise SchemaError(f"{at} refers to itself")
        out: list[str] = []
        for x in self.found[at].same():
            out += [y for y in self.closure(x, (*above, at)) if y not in out]
        return [*out, at]

    def sure(self, at: str) -> set[str]:
        """A place and those that apply wherever it does."""
        return {at}.union(*(self.sure(x) for x in self.found[at].every))

    def branched(self) -> set[str]:
        """The places that a branch can lead to."""
        todo = [x for p in self.found.values() for x in p.same() if x not in p.every]
        todo += [f"{p.at}/contains" for p in self.found.values() if isinstance(p.schema, dict) and "contains" in p.schema]
        out: set[str] = set()
        while todo:
            x = todo.pop()
            if x not in out:
                out.add(x)
                todo += [*self.found[x].same(), *self.below.get(x, ())]
        return out

    def height(self, at: str, above: tuple[str, ...] = ()) -> float:
        """Steps down that a verdict at a place can need; infinite where it refers to itself."""
        if at in above:
            return float("inf")
        return max((1 + self.height(y, (*above, at)) for x in self.closure(at) for y in self.below.get(x, ())), default=0)

    def flat(self) -> bool:
        """Whether verdicts need nothing from below a node."""
        return not any(isinstance(p.schema, dict) and "contains" in p.schema for p in self.found.values()) and not any(self.height(x) for x in self.branched())

    def alphabet(self) -> tuple[list[str], list[str], int]:
        """What tells steps apart: the names of properties, the patterns of others, and the length of the longest tuple."""
        dicts = [p.schema for p in self.found.values() if isinstance(p.schema, dict)]
        names, patterns = ({x: None for s in dicts for x in s.get(k, {})} for k in ("properties", "patternProperties"))
        tuples = [s[k] for s in dicts for k in ("prefixItems", "items") if isinstance(s.get(k), list)]
        return list(names), [typed.checked_pattern(x, "#") for x in patterns], max(map(len, tuples), default=0)

    def asks(self, column: str) -> bool:
        """Whether a keyword of the schema asks for a column of nodes."""
        return any(isinstance(p.schema, dict) and ASKED[column] & set(p.schema) for p in self.found.values())

    def ways(self, p: Place) -> list[tuple[str, object, str]]:
        """Where steps lead from a place, as (test, value, place): a ``name``, a ``pattern`` of names, ``other`` names, an ``index``, or ``from`` one on; ``contains`` is of all elements."""
        s, out = p.schema, []
        if isinstance(s, bool):
            return out
        out += [("name", n, f"{p.at}/properties{typed.step_of(n)}") for n in s.get("properties", {})]
        out += [("pattern", typed.checked_pattern(x, p.at), f"{p.at}/patternProperties{typed.step_of(x)}") for x in s.get("patternProperties", {})]
        if "additionalProperties" in s:
            out.append(("other", None, f"{p.at}/additionalProperties"))
        tuple_ = s.get("prefixItems") or (s.get("items") if isinstance(s.get("items"), list) else [])
        keyword = "prefixItems" if "prefixItems" in s else "items"
        out += [("index", i, f"{p.at}/{keyword}/{i}") for i in range(len(tuple_))]
        rest = "additionalItems" if isinstance(s.get("items"), list) and "prefixItems" not in s else "items"
        if rest in s and not isinstance(s[rest], list):
            out.append(("from", len(tuple_), f"{p.at}/{rest}"))
        if "contains" in s:
            out.append(("contains", 0, f"{p.at}/contains"))
        return out

    def children(self, p: Place, name: Column, idx: Column) -> Column | None:
        """The places of a child of a node at this place, as an array of (entry, contains)."""
        ways, found = self.ways(p), []
        named = [name == v if test == "name" else name.rlike(v) for test, v, _ in ways if test in ("name", "pattern")]
        other = name.isNotNull()
        for x in named:
            other = other & ~x
        for test, v, at in ways:
            when = {"name": lambda: name == v, "pattern": lambda: name.rlike(v), "other": lambda: other, "index": lambda: idx == v}.get(test, lambda: idx >= v)()  # noqa: B023
            if self.found[at].schema is not True or test == "contains":
                found.append(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(at).alias("entry"), F.lit(test == "contains").alias("contains"))))
        return F.array_compact(F.array(*found)) if found else None

    def states(self) -> tuple[list[tuple[dict[str, int], int, list[int]]], list[dict[str, bool]]] | None:
        """The sets of places that nodes can have, each place with whether it is there for sure, and where steps lead from them, as ``shred`` takes it: by name, by another name, by
        index. None if they are told by patterns, or too many."""
        names, patterns, most = self.alphabet()
        if patterns:
            return None

        def closed(entries: dict[str, bool]) -> dict[str, bool]:
            out: dict[str, bool] = {}
            for at, sure in entries.items():
                for x in self.closure(at):
                    out[x] = out.get(x, False) or (sure and x in self.sure(at))
            return out

        def led(state: dict[str, bool], name: str | None, idx: int | None) -> dict[str, bool]:
            entries: dict[str, bool] = {}
            for place, sure in state.items():
                ways = self.ways(self.found[place])
                known = {v for test, v, _ in ways if test == "name"}
                for test, v, at in ways:
                    if idx is None:
                        there = name == v if test == "name" else test == "other" and name not in known
                    else:
                        there = idx == v if test == "index" else test == "from" and idx >= v
                    if there and self.found[at].schema is not True:
                        entries[at] = entries.get(at, False) or sure
            return closed(entries)

        found, numbers, steps = [closed({"#": True})], {}, []
        numbers[frozenset(found[0].items())] = 0

        def number(state: dict[str, bool]) -> int:
            if not state:
                return -1
            own = frozenset(state.items())
            if own not in numbers:
                numbers[own] = len(found)
                found.append(state)
            return numbers[own]

        while len(steps) < len(found) <= MOST_STATES:
            state = found[len(steps)]
            steps.append(({x: number(led(state, x, None)) for x in names}, number(led(state, None, None)), [number(led(state, None, i)) for i in range(most + 1)]))
        return (steps, found) if len(found) <= MOST_STATES else None

    def local(self, p: Place) -> Column:
        """The violations of the node itself, without its branches."""
        return typed._rows([rows for _, _, rows in self.tests(p)])

    def tests(self, p: Place) -> list[tuple[str, Column, Column]]:
        """(keyword, whether it is violated, its violations) of the node itself, without its branches."""
        s, out = p.schema, []
        here = F.col("pointer")
        if isinstance(s, bool):
            return [] if s else [("false", F.lit(True), F.array(typed._row(here, p.at, "false", "Not allowed")))]
        kind, text, num, n, kids = (F.col(c) for c in ("kind", "text", "num", "n", "kids"))

        def add(keyword: str, bad: Column, message: str | Column) -> None:
            out.append((keyword, F.coalesce(bad, F.lit(False)), typed._one(here, f"{p.at}/{keyword}", keyword, bad, message)))

        number, string, array, object_ = kind.isin("integer", "number"), kind == "string", kind == "array", kind == "object"
        has = self._has
        for keyword, v in s.items():
            if keyword == "type":
                names = v if isinstance(v, list) else [v]
                if "any" not in names:
                    fits = [*names, *(["integer"] if "number" in names else [])]
                    add("type", ~kind.isin(*fits), F.concat(F.lit(f"Expected {' or '.join(names)}, got "), F.when(kind == "integer", "number").otherwise(kind)))
            elif keyword in ("enum", "const"):
                values = v if keyword == "enum" else [v]
                shown = ", ".join(json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in values)
                add(keyword, ~F.col("canon").isin(*(literal_canon(x) for x in values)), ("Must be one of: " if keyword == "enum" else "Must be equal to ") + shown)
            elif keyword in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum") and not isinstance(v, bool):
                low, bound = keyword in ("minimum", "exclusiveMinimum"), F.lit(float(v))
                strict = keyword.startswith("exclusive") or s.get("exclusive" + keyword.capitalize()) is True
                says = ("must be greater than" if strict else "is less than minimum") if low else ("must be less than" if strict else "exceeds maximum")
                bad = (num <= bound if strict else num < bound) if low else (num >= bound if strict else num > bound)
                add(keyword, number & bad, F.concat(F.lit("Value "), text, F.lit(f" {says} {json.dumps(v)}")))
            elif keyword == "multipleOf":
                if not v > 0:
                    raise SchemaError(f"multipleOf must be positive at {p.at}")
                divisor = Decimal(str(v))
                digits = max(0, -divisor.normalize().as_tuple().exponent)
                exact = text.try_cast(f"decimal(38,{digits})")
                whole = F.when(exact.isNotNull(), (exact.cast("double") == num) & (exact % F.lit(divisor.quantize(Decimal(1).scaleb(-digits))) == 0)).otherwise(F.abs(num / float(v) - F.rint(num / float(v))) < 1e-9)
                if digits == 0 and v < 2**52:
                    # Whole numbers this small are exact as doubles.
                    whole = F.when(F.abs(num) < 2.0**52, num % float(v) == 0).otherwise(whole)
                add(keyword, number & ~whole, F.concat(F.lit("Value "), text, F.lit(f" is not a multiple of {json.dumps(v)}")))
            elif keyword in ("minLength", "maxLength"):
                size = F.char_length(text)
                add(keyword, string & (size < v if keyword == "minLength" else size > v), F.concat(F.lit("String length "), size.cast("string"), F.lit(f" {'is less than minimum' if keyword == 'minLength' else 'exceeds maximum'} {v}")))
            elif keyword == "pattern":
                add(keyword, string & ~text.rlike(typed.checked_pattern(v, p.at)), f"Does not match pattern '{v}'")
            elif keyword == "format" and v in formats.ASSERTED:
                add(keyword, string & ~formats.asserted(v, text), f"Not a valid {formats.ASSERTED[v][1]}")
            elif keyword in ("minItems", "maxItems"):
                add(keyword, array & (n < v if keyword == "minItems" else n > v), F.concat(F.lit("Array has "), typed._count(n, "item", "items"), F.lit(f", expected at {'least' if keyword == 'minItems' else 'most'} {v}")))
            elif keyword in ("minProperties", "maxProperties"):
                add(keyword, object_ & (n < v if keyword == "minProperties" else n > v), F.concat(F.lit("Object has "), typed._count(n, "property", "properties"), F.lit(f", expected at {'least' if keyword == 'minProperties' else 'most'} {v}")))
            elif keyword == "uniqueItems" and v:
                firsts = F.transform(kids, lambda x: F.struct((F.array_position(F.transform(kids, lambda y: y["canon"]), x["canon"]) - 1).alias("i"), x["sib"].alias("j")))
                says = lambda t: F.concat(F.lit("Array has duplicate items at indices "), t["i"].cast("string"), F.lit(" and "), t["j"].cast("string"))
                double = array & (F.size(F.array_distinct(F.transform(kids, lambda y: y["canon"]))) < n)
                each = F.transform(F.filter(firsts, lambda t: t["i"] < t["j"]), lambda t: typed._row(here, f"{p.at}/uniqueItems", "uniqueItems", says(t)))
                out.append((keyword, F.coalesce(double, F.lit(False)), F.when(double, each).otherwise(typed._none())))
            elif keyword == "required":
                for name in dict.fromkeys(v):
                    add(keyword, object_ & ~has(name), f"Missing required property '{name}'")
            elif keyword in ("dependentRequired", "dependencies"):
                for name, others in v.items():
                    for other in dict.fromkeys(others if isinstance(others, list) else ()):
                        add(keyword, object_ & has(name) & ~has(other), f"Property '{other}' is required when '{name}' is present")
            elif keyword == "propertyNames":
                names = F.filter(kids, lambda k: k["name"].isNotNull())
                each = lambda k, inner=v: typed._rows(typed.tests(k["name"], T.StringType(), inner, F.concat(here, typed.escaped(k["name"])), f"{p.at}/propertyNames", self.root))
                found = F.when(object_, F.flatten(F.transform(names, lambda k: each(k)))).otherwise(typed._none())
                out.append((keyword, F.size(found) > 0, found))
        return out

    def fails(self, at: str, every: bool = True) -> Column:
        """Whether anything is violated at a place, what is below left out: a plain test, for rows to be passed over before their violations are made."""
        p, no = self.found[at], F.lit(False)
        bad = [x for _, x, _ in self.tests(p)] + [self.fails(x) for x in p.every if every]
        if p.any_of:
            bad.append(reduce(Column.__and__, map(self.fails, p.any_of)))
        if p.one_of:
            bad.append(reduce(Column.__add__, (F.when(self.fails(x), 0).otherwise(1) for x in p.one_of)) != 1)
        if p.not_:
            bad.append(~self.fails(p.not_))
        if p.if_:
            yes, other = (no if x is None else self.fails(x) for x in p.if_[1:])
            bad.append(F.when(self.fails(p.if_[0]), other).otherwise(yes))
        bad += [self._has(name) & self.fails(x) for name, x in p.dependent.items()]
        return reduce(Column.__or__, bad, no)

    def contained(self, p: Place) -> Column:
        """The violations of ``contains``, from ``hits``, the number of items that match."""
        s, rows, hits = p.schema, [], F.col("hits")
        least, most = s.get("minContains", 1), s.get("maxContains")
        found = F.concat(F.lit("Found "), typed._count(hits, "item", "items"), F.lit(" matching 'contains'"))
        says = F.lit("No items match 'contains' schema") if "minContains" not in s else F.concat(found, F.lit(f", expected at least {least}"))
        for bad, message in ((hits < least, says), *([(hits > most, F.concat(found, F.lit(f", expected at most {most}")))] if most is not None else [])):
            rows.append(typed._one(F.col("pointer"), f"{p.at}/contains", "contains", (F.col("kind") == "array") & bad, message))
        return typed._rows(rows)

    # Verdicts from ``m``, a map of places to (errors, type): the violations of a place itself and below, and whether the node's own type is one of them.

    def verdict(self, at: str, m: Column) -> Column:
        """(errors, type) of a place with its branches."""
        p = self.found[at]
        own = m[at]
        parts = [self.verdict(x, m) for x in p.every]
        none = F.struct(F.lit(0).cast("bigint").alias("errors"), F.lit(False).alias("type"))
        for branches, one in ((p.any_of, False), (p.one_of, True)):
            if branches:
                parts.append(self._decided(branches, m, one))
        if p.not_:
            parts.append(F.struct((self.verdict(p.not_, m)["errors"] == 0).cast("bigint").alias("errors"), F.lit(False).alias("type")))
        if p.if_:
            yes, no = (none if x is None else self.verdict(x, m) for x in p.if_[1:])
            parts.append(F.when(self.verdict(p.if_[0], m)["errors"] == 0, yes).otherwise(no))
        for name, x in p.dependent.items():
            parts.append(F.when(self._has(name), self.verdict(x, m)).otherwise(none))
        errors, type_ = own["errors"], own["type"]
        for x in parts:
            errors, type_ = errors + x["errors"], type_ | x["type"]
        return F.struct(errors.alias("errors"), type_.alias("type"))

    def _has(self, name: str) -> Column:
        return F.coalesce(F.array_contains(self.names, name), F.lit(False))

    def _branches(self, branches: list[str], m: Column) -> Column:
        """The verdicts of branches, each with its rank, (type, errors, position)."""
        return F.array(*(self._ranked(x, i, m) for i, x in enumerate(branches)))

    def _ranked(self, at: str, i: int, m: Column) -> Column:
        return typed._let(self.verdict(at, m), lambda v: F.struct(v["type"].alias("type"), v["errors"].alias("errors"), F.lit(i).alias("i")))

    def _decided(self, branches: list[str], m: Column, one: bool) -> Column:
        def decide(b: Column) -> Column:
            passed, best = F.size(F.filter(b, lambda x: x["errors"] == 0)), F.array_min(b)
            failed = F.struct((best["errors"] + 1).alias("errors"), best["type"].alias("type"))
            plain = lambda n: F.struct(F.lit(n).cast("bigint").alias("errors"), F.lit(False).alias("type"))
            return F.when(passed == 0, failed).when((passed > 1) & F.lit(one), plain(1)).otherwise(plain(0))

        return typed._let(self._branches(branches, m), decide)

    @staticmethod
    def undecided(at: str, keyword: str, passed: Column, branches: int) -> list[Column]:
        """What a place reports of its branches, of which some pass."""
        here, count = F.col("pointer"), typed._counted(branches, "schema", "schemas")
        rows = [typed._one(here, f"{at}/{keyword}", keyword, passed == 0, f"Does not match any of {count}")]
        if keyword == "oneOf":
            rows.append(typed._one(here, f"{at}/{keyword}", keyword, passed > 1, F.concat(F.lit("Matches "), passed.cast("string"), F.lit(f" of {count}, expected exactly one"))))
        return rows

    @staticmethod
    def negated(at: str, passes: Column) -> Column:
        return typed._one(F.col("pointer"), f"{at}/not", "not", passes, "Must not match schema")

    def active(self, at: str, m: Column, every: bool = True) -> Column:
        """The places that report where this one does, as an array of (place, rows), with the violations of their branches."""
        p = self.found[at]
        rows, more = [], [self.active(x, m) for x in p.every] if every else []
        for keyword, branches in (("anyOf", p.any_of), ("oneOf", p.one_of)):
            if branches:
                b = self._branches(branches, m)
                passed, best = F.size(F.filter(b, lambda x: x["errors"] == 0)), F.array_min(b)["i"]
                rows += self.undecided(at, keyword, passed, len(branches))
                for i, x in enumerate(branches):
                    more.append(F.when((passed == 0) & (best == i), self.active(x, m)))
        if p.not_:
            rows.append(self.negated(at, self.verdict(p.not_, m)["errors"] == 0))
        if p.if_:
            holds = self.verdict(p.if_[0], m)["errors"] == 0
            more += [F.when(test, self.active(x, m)) for test, x in ((holds, p.if_[1]), (~holds, p.if_[2])) if x]
        more += [F.when(self._has(name), self.active(x, m)) for name, x in p.dependent.items()]
        own = F.array(F.struct(F.lit(at).alias("place"), typed._rows(rows).alias("rows")))
        none = F.array().cast(f"array<struct<place:string,rows:{VIOLATION}>>")
        return F.concat(own, *(F.coalesce(x, none) for x in more)) if more else own


def _switch(places: list[tuple[str, Column]], default: Column, on: str | Column = "place") -> Column:
    out, on = None, F.col(on) if isinstance(on, str) else on
    for at, value in places:
        out = F.when(on == at, value) if out is None else out.when(on == at, value)
    return default if out is None else out.otherwise(default)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def columns(places: Places) -> list[str]:
    """The columns of the table of nodes that a schema asks for, its branches looking at nothing below."""
    return ["pre", "pointer", "kind", *(c for c in ASKED if places.asks(c))]


def validate(docs: DataFrame, key: str, json: str, schema: dict | bool) -> DataFrame:
    """``validate_nodes`` of the texts. They are walked once, into a written table if branches look below; where the schema has patterns and no such branches, once more for the shapes."""
    places = Places(schema)
    if not places.flat():
        kids = ["kids"] if places.asks("kids") or places.asks("names") else []
        return validate_nodes(written(shred(docs, key, json, ["pre", "pointer", "kind", "text", "num", "n", "canon", "steps", "parent", "depth", *kids]), "tree-nodes"), key, schema)
    places.names = F.col("names")
    own, states = columns(places), places.states()
    if states is None:
        nodes = _at_shapes(places, shred(docs, key, json, [*own, "steps", "pointer"]), _shapes(places, shred(docs, key, json, ["pointer", "steps"])))
        flags = None
    else:
        nodes = shred(docs, key, json, own, states=states[0])
        of = lambda test: F.col("state").isin([i for i, state in enumerate(states[1]) if test(state)])
        flags = {at: of(lambda state: at in state) for at in places.found}, {at: of(lambda state: state.get(at, False)) for at in places.found}  # noqa: B023
    return _ordered(_in_row(places, nodes.withColumnRenamed(key, "_doc"), flags), key)


def validate_nodes(nodes: DataFrame, key: str, schema: dict | bool) -> DataFrame:
    """(key, ord, instance_path, schema_path, keyword, message): the violations of each document, in order of the nodes. ``nodes`` is best a written table."""
    places = Places(schema)
    branched, kept = places.branched(), []
    shapes = _shapes(places, nodes)
    nodes = nodes.withColumnRenamed(key, "_doc")

    def keep(df: DataFrame, name: str) -> DataFrame:
        kept.append(written(df, name))
        return kept[-1]

    if places.flat():
        out = _in_row(places, _at_shapes(places, nodes, shapes))
    else:
        states = keep(_states(nodes.withColumn("_shape", _shape(places)), shapes), "tree-states")
        base = keep(_base(places, states), "tree-base")
        out = written(_with_branches(places, branched, states, base, keep).distinct(), "tree-violations")
        dropped(*kept)
    return _ordered(out, key)


def _ordered(out: DataFrame, key: str) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("_doc").orderBy("pre", "instance_path", "schema_path", "message")) - 1
    return out.select(F.col("_doc").alias(key), order.alias("ord"), "instance_path", "schema_path", "keyword", "message")


def _reached(places: Places, state: Column, step: Column) -> Column:
    """Where a step leads from a state, an array of (place, sure): an array of (place, from_sure, entry, contains)."""
    spread = F.create_map(*(x for p in places.found for x in (F.lit(p), F.array(*(F.struct(F.lit(y).alias("place"), F.lit(y in places.sure(p)).alias("sure")) for y in places.closure(p))))))
    below = [(p.at, c) for p in places.found.values() if (c := places.children(p, step["name"], step["idx"])) is not None]
    none = F.array().cast("array<struct<entry:string,contains:boolean>>")

    def of(place: Column) -> Column:
        out = None
        for at, value in below:
            out = F.when(place == at, value) if out is None else out.when(place == at, value)
        return none if out is None else out.otherwise(none)

    each = lambda st, q: F.transform(of(q["place"]), lambda e: F.struct(q["place"].alias("place"), (st["sure"] & q["sure"]).alias("from_sure"), e["entry"].alias("entry"), e["contains"].alias("contains")))
    return F.flatten(F.transform(state, lambda st: F.flatten(F.transform(spread[st["place"]], lambda q: each(st, q)))))


def _trail() -> Column:
    """The steps to a node as an array of (name, idx)."""
    at = F.split("pointer", "/")
    return F.transform("steps", lambda x, i: F.struct(F.when(x != ELEMENT, x.substr(F.lit(2), F.char_length(x))).alias("name"), F.when(x == ELEMENT, F.get(at, i + 1)).try_cast("int").alias("idx")))


def _shape(places: Places) -> Column:
    """The steps to a node as far as the schema tells them apart: names of its properties, what patterns another name matches, positions up to the longest tuple."""
    known, patterns, most = places.alphabet()
    own = lambda name: F.concat(F.lit("?"), *(F.when(name.rlike(x), "1").otherwise("0") for x in patterns))
    names = ["." + x for x in known]
    if most:
        return F.transform(_trail(), lambda x: F.when(x["name"].isNull(), F.least(x["idx"], F.lit(most)).cast("string")).when(F.concat(F.lit("."), x["name"]).isin(*names), F.concat(F.lit("."), x["name"])).otherwise(own(x["name"])))
    return F.transform("steps", lambda x: F.when(x.isin(ELEMENT, *names), x).otherwise(own(x.substr(F.lit(2), F.char_length(x)))))


def _shapes(places: Places, paths: DataFrame) -> DataFrame:
    """(_at, led, at): where the last step leads from the places of the parent, null for roots, and all (place, sure) of a node, for each shape."""
    start = F.array(F.struct(F.lit("#").alias("place"), F.lit(True).alias("sure")))
    entered = lambda led: F.array_distinct(F.transform(led, lambda e: F.struct(e["entry"].alias("place"), (e["from_sure"] & ~e["contains"]).alias("sure"))))
    up = F.aggregate(F.slice(F.col("trail"), F.lit(1), F.greatest(F.size("trail") - 1, F.lit(0))), start, lambda state, x: entered(_reached(places, state, x)))
    led = F.when(F.size("trail") > 0, F.transform(F.array(up), lambda state: _reached(places, state, F.element_at("trail", F.lit(-1))))[0])
    spread = F.create_map(*(x for p in places.found for x in (F.lit(p), F.array(*(F.struct(F.lit(y).alias("place"), F.lit(y in places.sure(p)).alias("sure")) for y in places.closure(p))))))
    pairs = F.flatten(F.transform("state", lambda st: F.transform(spread[st["place"]], lambda q: F.struct(q["place"].alias("place"), (st["sure"] & q["sure"]).alias("sure")))))
    # Of a place that is there twice, the sure one.
    once = F.filter(F.array_distinct("pairs"), lambda x: x["sure"] | ~F.exists("pairs", lambda y: (y["place"] == x["place"]) & y["sure"]))
    # One path stands for all of its shape.
    one = paths.select(_shape(places).alias("_at"), "steps", "pointer").groupBy("_at").agg(F.first(F.struct("steps", "pointer")).alias("p")).select("_at", "p.*")
    found = one.withColumn("trail", _trail()).withColumn("led", led).withColumn("state", F.when(F.col("led").isNull(), start).otherwise(entered(F.col("led")))).withColumn("pairs", pairs)
    return F.broadcast(found.select("_at", "led", once.alias("at")).filter(F.size("at") > 0))


def _states(nodes: DataFrame, shapes: DataFrame) -> DataFrame:
    """Nodes at places, with ``led`` and ``at`` of their shapes. Written by the caller, as it is read twice."""
    kids = F.transform("kids", lambda k: F.struct(k["sib"].alias("sib"), k["name"].alias("name"), k["canon"].alias("canon")))
    own = nodes.withColumn("kids", kids if "kids" in nodes.columns else F.array().cast(KIDS))
    return own.join(shapes, F.col("_shape") == F.col("_at")).select("_doc", "pre", "parent", "depth", "pointer", "kind", "text", "num", "n", "canon", "kids", "led", "at")


def _base(places: Places, states: DataFrame) -> DataFrame:
    """(_doc, pre, depth, pointer, kind, kids, place, sure, rows): the violations of each node at each of its places, without branches."""
    local = [(p.at, places.local(p)) for p in places.found.values()]
    own = states.drop("led", "parent").select("*", F.explode("at").alias("x")).select("*", "x.place", "x.sure")
    return own.select("_doc", "pre", "depth", "pointer", "kind", "kids", "place", "sure", _switch(local, typed._none()).alias("rows"))


def _at_shapes(places: Places, nodes: DataFrame, shapes: DataFrame) -> DataFrame:
    """Nodes with a flag for each place, whether it is there (``_h``) and whether for sure (``_s``), as known of their shapes."""
    flags = {f"_h{i}": F.exists("at", lambda x: x["place"] == at) for i, at in enumerate(places.found)} | {f"_s{i}": F.exists("at", lambda x: (x["place"] == at) & x["sure"]) for i, at in enumerate(places.found)}
    shapes = F.broadcast(shapes.select("_at", *(f.alias(c) for c, f in flags.items())))
    return nodes.withColumn("_shape", _shape(places)).join(shapes, F.col("_shape") == F.col("_at"))


def _levels(needs: dict[str, list[str]]) -> list[list[str]]:
    """Places by level, each above all that it needs."""
    level: dict[str, int] = {}

    def of(at: str) -> int:
        if at not in level:
            level[at] = max((1 + of(x) for x in needs[at]), default=0)
        return level[at]

    out: list[list[str]] = [[] for _ in range(max(map(of, needs), default=-1) + 1)]
    for at, k in level.items():
        out[k].append(at)
    return out


def _in_row(places: Places, nodes: DataFrame, flags: tuple[dict[str, Column], dict[str, Column]] | None = None) -> DataFrame:
    """The violations (_doc, pre, ...) where no branch looks below: verdicts, and which places report, are plain columns of each node's row, made level by level.
    ``flags`` tell of each place whether it is there, and whether for sure, by default the columns of ``_at_shapes``.

    Functions of elements are avoided here, since Spark doesn't compile what has them. So are columns that are equal to a part of the filter, such as the flags or a test alone: the
    optimizer would note what the filter says once for each choice of parts to put such columns for.
    """
    found, branched, no, zero = places.found, places.branched(), F.lit(False), F.lit(0).cast("bigint")
    at = {x: i for i, x in enumerate(found)}
    here, sure = flags or ({x: F.col(f"_{k}{i}") for x, i in at.items()} for k in "hs")
    errors, wrong = ({x: F.col(f"_{k}{i}") for x, i in at.items()} for k in "et")
    typing = {x: c == 1 for x, c in wrong.items()}
    tests = {x: places.tests(p) for x, p in found.items()}
    any_, sum_ = (lambda xs: reduce(Column.__or__, xs, no)), (lambda xs: reduce(Column.__add__, xs, zero))
    # Most nodes have no violation: they go before anything is made of them.
    own = nodes.filter(any_(sure[x] & places.fails(x, every=False) for x in found))
    passed = lambda branches: sum_(F.when(errors[x] == 0, 1).otherwise(0) for x in branches)
    best = lambda branches: F.array_min(F.array(*(F.struct(wrong[x].alias("type"), errors[x].alias("errors"), F.lit(i).alias("i")) for i, x in enumerate(branches))))

    def verdict(x: str) -> tuple[Column, Column]:
        """How much is violated at a place with its branches, and whether the node's own type is."""
        p = found[x]
        several = ("uniqueItems", "propertyNames")
        e = [F.size(rows) if keyword in several else F.when(bad, 1).otherwise(0) for keyword, bad, rows in tests[x]] + [errors[y] for y in p.every]
        t = [bad for keyword, bad, _ in tests[x] if keyword == "type"] + [typing[y] for y in p.every]
        t += [F.exists(rows, lambda r: r["keyword"] == "type") for keyword, _, rows in tests[x] if keyword == "propertyNames"]
        for branches in filter(None, (p.any_of, p.one_of)):
            failed = F.when(passed(branches) == 0, best(branches)["errors"] + 1)
            e.append((failed.when(passed(branches) > 1, 1) if branches is p.one_of else failed).otherwise(0))
            t.append((passed(branches) == 0) & (best(branches)["type"] == 1))
        if p.not_:
            e.append(F.when(errors[p.not_] == 0, 1).otherwise(0))
        if p.if_:
            holds, (yes, other) = errors[p.if_[0]] == 0, p.if_[1:]
            e.append(F.when(holds, errors[yes] if yes else zero).otherwise(errors[other] if other else zero))
            t.append(F.when(holds, typing[yes] if yes else no).otherwise(typing[other] if other else no))
        for name, y in p.dependent.items():
            e.append(F.when(places._has(name), errors[y]).otherwise(0))
            t.append(places._has(name) & typing[y])
        return F.when(here[x], sum_(e)).otherwise(zero), F.when(here[x] & any_(t), 1).otherwise(0)

    for level in _levels({x: found[x].same() for x in branched}):
        own = own.withColumns({f"_{k}{at[x]}": c for x in level for k, c in zip("et", verdict(x))})
    above: dict[str, list[tuple[str, Column]]] = {x: [] for x in found}
    for x, p in found.items():
        ways = [(y, F.lit(True)) for y in p.every if x in branched] + [(y, places._has(name)) for name, y in p.dependent.items()]
        ways += [(y, (passed(branches) == 0) & (best(branches)["i"] == i)) for branches in (p.any_of, p.one_of) for i, y in enumerate(branches)]
        if p.if_:
            ways += [(y, (errors[p.if_[0]] == 0) == holds) for y, holds in zip(p.if_[1:], (True, False)) if y]
        for y, when in ways:
            above[y].append((x, when))
    active = {x: F.col(f"_a{i}") if above[x] else sure[x] for x, i in at.items()}
    for level in _levels({x: [y for y, _ in ways] for x, ways in above.items()}):
        own = own.withColumns({f"_a{at[x]}": any_([sure[x], *(active[y] & when for y, when in above[x])]) for x in level if above[x]})
    parts = []
    for x, p in found.items():
        rows = [r for _, _, r in tests[x]]
        for keyword, branches in (("anyOf", p.any_of), ("oneOf", p.one_of)):
            rows += places.undecided(x, keyword, passed(branches), len(branches)) if branches else []
        rows += [places.negated(x, errors[p.not_] == 0)] if p.not_ else []
        if rows:
            parts.append(F.when(active[x], typed._rows(rows)).otherwise(typed._none()))
    rows = typed._rows(parts)
    if places.asks("kids"):
        rows = F.array_distinct(rows)  # a name can violate the same twice
    # Without "outer" the optimizer asks for the size first, and computes all of it twice.
    return own.select("_doc", "pre", F.explode_outer(rows).alias("r")).filter(F.col("r").isNotNull()).select("_doc", "pre", "r.*")


def _with_branches(places: Places, branched: set[str], states: DataFrame, base: DataFrame, keep) -> DataFrame:  # noqa: ANN001
    """The violations (_doc, pre, ...) of sure places and of the branches that report."""
    ways = states.filter("depth > 0").select("_doc", F.col("parent"), F.col("pre").alias("child"), F.explode("led").alias("e")).select("_doc", "parent", "child", "e.*")
    ways = keep(ways.filter(F.col("place").isin(*branched) | F.col("contains")) if branched else ways.filter("contains"), "tree-ways")
    heights = {x: places.height(x) for x in branched}
    by_depth = float("inf") in heights.values()
    own = base.filter(F.col("place").isin(*branched)) if branched else base.filter("false")
    rounds = range(own.agg(F.max("depth")).first()[0] or 0, -1, -1) if by_depth else range(int(max(heights.values(), default=0)) + 1)
    verdicts = [(p, places.verdict(p, F.col("m"))) for p in branched]
    done = None
    for k in rounds:
        here = own.filter(F.col("depth") == k) if by_depth else own.filter(F.col("place").isin(*(x for x, h in heights.items() if h == k)))
        here = _summed(places, here, ways, done)
        here = here.withColumn("own", F.struct((F.size("rows") + F.col("below")).alias("errors"), F.exists("rows", lambda r: r["keyword"] == "type").alias("type")))
        mine = here.select("_doc", "pre", "pointer", "kids", "place", "own", F.lit(True).alias("now"))
        if done is not None and not by_depth:
            mine = mine.unionByName(done.select("_doc", "pre", "pointer", "kids", "place", "own", F.lit(False).alias("now")))
        by_node = mine.groupBy("_doc", "pre").agg(F.collect_list(F.struct("place", "own", "now")).alias("all"), F.first("pointer").alias("pointer"), F.first("kids").alias("kids"))
        by_node = by_node.withColumn("m", F.map_from_entries(F.transform("all", lambda x: F.struct(x["place"], x["own"])))).withColumn("all", F.filter("all", lambda x: x["now"]))
        found = by_node.select("_doc", "pre", "pointer", "kids", "m", F.explode("all").alias("a")).select("_doc", "pre", "pointer", "kids", "m", "a.place", "a.own")
        found = keep(found.select("_doc", "pre", "pointer", "kids", "place", "own", _switch(verdicts, F.lit(None).cast("struct<errors:bigint,type:boolean>")).alias("v")), "tree-verdicts")
        done = found if done is None else done.unionByName(found)

    told = _summed(places, base, ways, done).select("_doc", "pre", "pointer", "kids", "place", "sure", "rows")
    out = told.filter("sure").select("_doc", "pre", F.explode("rows").alias("r")).select("_doc", "pre", "r.*")
    deciding = [p.at for p in places.found.values() if set(p.same()) - set(p.every)]
    if not deciding:
        return out
    m = done.groupBy(F.col("_doc").alias("_md"), F.col("pre").alias("_mp")).agg(F.map_from_entries(F.collect_list(F.struct("place", "own"))).alias("m"))
    m = keep(m, "tree-own")
    own = told.select(F.col("_doc").alias("_od"), F.col("pre").alias("_op"), F.col("place").alias("_oat"), "rows")
    none = F.array().cast(f"array<struct<place:string,rows:{VIOLATION}>>")
    first = [(p, places.active(p, F.col("m"), every=False)) for p in deciding]
    later = [(p, places.active(p, F.col("m"))) for p in branched]
    asked = told.filter(F.col("sure") & F.col("place").isin(*deciding)).select("_doc", "pre", "pointer", "kids", "place")
    reports, goes_on = first, any(places.below.get(x) for x in branched)
    while True:
        both = asked.join(m, _same("_doc", "_md") & (F.col("pre") == F.col("_mp")))
        some = both.select("_doc", "pre", F.col("place").alias("from"), F.explode(_switch(reports, none)).alias("a")).select("_doc", "pre", "from", "a.*")
        some = keep(some, "tree-told")
        out = out.unionByName(some.select("_doc", "pre", F.explode("rows").alias("r")).select("_doc", "pre", "r.*"))
        fresh = some.filter(F.col("place") != F.col("from")) if reports is first else some
        fresh = fresh.select("_doc", "pre", "place").distinct()
        out = out.unionByName(fresh.join(own, _same("_doc", "_od") & (F.col("pre") == F.col("_op")) & (F.col("place") == F.col("_oat"))).select("_doc", "pre", F.explode("rows").alias("r")).select("_doc", "pre", "r.*"))
        if not goes_on:
            return out
        on = fresh.select(F.col("_doc").alias("_td"), F.col("pre").alias("_tp"), F.col("place").alias("_tat"))
        entries = ways.filter("not contains").join(on, _same("_doc", "_td") & (F.col("parent") == F.col("_tp")) & (F.col("place") == F.col("_tat")), "left_semi").select(F.col("_doc").alias("_ed"), F.col("child").alias("_ep"), "entry").distinct()
        at = told.join(entries, _same("_doc", "_ed") & (F.col("pre") == F.col("_ep")) & (F.col("place") == F.col("entry")))
        asked = keep(at.select("_doc", "pre", "pointer", "kids", "place"), "tree-asked")
        if asked.isEmpty():
            return out
        reports = later


def _summed(places: Places, pairs: DataFrame, ways: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    """Pairs with ``below``, the violations under them, and those of ``contains`` among their rows."""
    if verdicts is None:
        pairs = pairs.withColumns({"below": F.lit(0).cast("bigint"), "hits": F.lit(0).cast("bigint")})
    else:
        lower = verdicts.select(F.col("_doc").alias("_ld"), F.col("pre").alias("_lp"), F.col("place").alias("_le"), F.col("v.errors").alias("errors"))
        joined = ways.join(lower, _same("_doc", "_ld") & (F.col("child") == F.col("_lp")) & (F.col("entry") == F.col("_le")))
        sums = joined.groupBy(F.col("_doc").alias("_sd"), F.col("parent").alias("_sp"), F.col("place").alias("_sat")).agg(
            F.sum(F.when(~F.col("contains"), F.col("errors")).otherwise(0)).alias("below"), F.count_if(F.col("contains") & (F.col("errors") == 0)).alias("hits")
        )
        pairs = pairs.join(sums, _same("_doc", "_sd") & (F.col("pre") == F.col("_sp")) & (F.col("place") == F.col("_sat")), "left").drop("_sd", "_sp", "_sat")
        pairs = pairs.withColumns({"below": F.coalesce("below", F.lit(0)), "hits": F.coalesce("hits", F.lit(0))})
    contains = [(p.at, places.contained(p)) for p in places.found.values() if isinstance(p.schema, dict) and "contains" in p.schema]
    return pairs.withColumn("rows", F.concat("rows", _switch(contains, typed._none()))) if contains else pairs
