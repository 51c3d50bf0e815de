"""JSONPath over typed columns: a path text becomes one Spark column expression.

``$.store.book[?(@.price < 10)].title`` on a nested column turns into struct access, ``filter`` and
``transform``, so Catalyst prunes nested fields, pushes filters and generates code. A path that can match more than one node
gives an array: children in written order of the selectors, descendants in document order, each node once. Any other gives the value itself, null
where nothing matches. Branches of a path keep their types to the end; only a result of several types meets as JSON text.

A typed column can't tell a missing member from a null one; both count as missing here. Truth is two-valued: a comparison with a
missing side is false but for ``!=``, and two missing sides are equal. Comparisons over many nodes hold if any pair does. Order is defined
for two numbers or two texts only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions import patterns


class PathSyntaxError(ValueError):
    """A path text that can't be read; ``position`` counts characters from 0."""

    def __init__(self, message: str, position: int) -> None:
        super().__init__(f"{message} at {position}")
        self.position = position


@dataclass(frozen=True)
class Selector:
    """One way to go down: name, index, slice, wildcard ("all") or filter."""

    kind: str
    value: object = None


@dataclass(frozen=True)
class Segment:
    """Selectors of one step; ``deep`` if the step starts with two dots."""

    selectors: tuple[Selector, ...]
    deep: bool = False


@dataclass(frozen=True)
class Expression:
    """A filter: op is and, or, not, exists, value, a comparison or match."""

    op: str
    args: tuple = field(default=())


_TOKEN = re.compile(
    r"""\s*(?:(?P<num>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w])|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<re>/(?:[^/\\]|\\.)+/[imsx]*)"""
    r"""|(?P<op>&&|\|\||==|!=|<=|>=|=~|\.\.|[-!<>()\[\].,:?*@$])|(?P<name>(?:[\w]|[^\x00-\x7F\s])[\w-]*))"""
)
#: Parentheses within one another.
DEEPEST = 64
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}


def _text(token: str) -> str:
    raw = re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), token[1:-1])
    return raw.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # two halves of a pair are one character, a half alone is U+FFFD


class _Reader:
    """Reads a path text token by token."""

    def __init__(self, text: str) -> None:
        self.text, self.tokens, at = text, [], 0
        end = len(text.rstrip())
        while at < end:
            regex_ok = bool(self.tokens) and self.tokens[-1][1] == "=~"
            m = _TOKEN.match(text, at)
            if not m or (m.lastgroup == "re" and not regex_ok):
                raise PathSyntaxError(f"Unexpected {text[at:].lstrip()[:1]!r}", at)
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
            at = m.end()
        self.k = self.depth = 0

    def peek(self, *values: str) -> bool:
        return self.k < len(self.tokens) and self.tokens[self.k][0] == "op" and self.tokens[self.k][1] in values

    def kind(self) -> str | None:
        return self.tokens[self.k][0] if self.k < len(self.tokens) else None

    def take(self) -> str:
        if self.k >= len(self.tokens):
            raise PathSyntaxError("Unexpected end", len(self.text))
        self.k += 1
        return self.tokens[self.k - 1][1]

    def expect(self, value: str) -> None:
        if not self.peek(value):
            at = self.tokens[self.k][2] if self.k < len(self.tokens) else len(self.text)
            raise PathSyntaxError(f"Expected {value!r}", at)
        self.k += 1

    def segments(self, inner: bool = False) -> tuple[Segment, ...]:
        found = []
        while self.peek(".", "..", "["):
            deep = self.peek("..")
            if self.peek(".", ".."):
                self.take()
                if self.peek("["):
                    if not deep:
                        raise PathSyntaxError("Expected a name", self.tokens[self.k][2])
                    found.append(Segment(self.brackets(), True))
                elif self.peek("*"):
                    self.take()
                    found.append(Segment((Selector("all"),), deep))
                elif self.kind() in ("name", "num"):
                    found.append(Segment((Selector("name", self.take()),), deep))
                else:
                    raise PathSyntaxError("Expected a name", self.tokens[self.k][2] if self.k < len(self.tokens) else len(self.text))
            else:
                found.append(Segment(self.brackets()))
        if not inner and self.k < len(self.tokens):
            raise PathSyntaxError(f"Unexpected {self.tokens[self.k][1]!r}", self.tokens[self.k][2])
        return tuple(found)

    def brackets(self) -> tuple[Selector, ...]:
        self.expect("[")
        found = [self.selector()]
        while self.peek(","):
            self.take()
            found.append(self.selector())
        self.expect("]")
        return tuple(found)

    def integer(self) -> int | None:
        if self.kind() != "num":
            return None
        at, raw = self.tokens[self.k][2], self.take()
        if not re.fullmatch(r"-?\d+", raw):
            raise PathSyntaxError("Invalid integer", at)
        if abs(int(raw)) >= 2**63:
            raise PathSyntaxError("Invalid integer", at)
        return int(raw)

    def selector(self) -> Selector:
        if self.peek("*"):
            self.take()
            return Selector("all")
        if self.peek("?"):
            self.take()
            return Selector("filter", self.either())
        if self.kind() == "str":
            return Selector("name", _text(self.take()))
        first = self.integer()
        if not self.peek(":"):
            if first is None:
                raise PathSyntaxError("Expected a selector", self.tokens[self.k][2] if self.k < len(self.tokens) else len(self.text))
            return Selector("index", first)
        self.take()
        last, step = self.integer(), None
        if self.peek(":"):
            self.take()
            step = self.integer()
        return Selector("slice", (first, last, 1 if step is None else step))

    def either(self) -> Expression:
        left = self.both()
        while self.peek("||"):
            self.take()
            left = Expression("or", (left, self.both()))
        return left

    def both(self) -> Expression:
        left = self.negated()
        while self.peek("&&"):
            self.take()
            left = Expression("and", (left, self.negated()))
        return left

    def negated(self) -> Expression:
        if self.peek("!"):
            self.take()
            return Expression("not", (self.negated(),))
        left = self.operand()
        if self.peek("==", "!=", "<", "<=", ">", ">="):
            return Expression(self.take(), (left, self.operand()))
        if self.peek("=~"):
            self.take()
            at, raw = self.tokens[self.k][2] if self.k < len(self.tokens) else len(self.text), self.take()
            pattern, flags = (raw[1 : raw.rindex("/")].replace("\\/", "/"), raw[raw.rindex("/") + 1 :]) if raw[0] == "/" else (_text(raw), "")
            if patterns.compiled(patterns.unicode(pattern, flags)) is None:
                raise PathSyntaxError("Invalid regular expression", at)
            return Expression("match", (left, patterns.unicode(pattern, flags)))
        return left

    def operand(self) -> Expression:
        if self.peek("("):
            self.depth += 1
            if self.depth > DEEPEST:
                raise PathSyntaxError("Expression nested too deeply", self.tokens[self.k][2])
            self.take()
            inner = self.either()
            self.depth -= 1
            self.expect(")")
            return inner
        if self.peek("@", "$"):
            return Expression("path", (self.take(), self.segments(inner=True)))
        kind, raw = self.kind(), self.take()
        if kind == "num":
            value = float(raw) if re.search(r"[.eE]", raw) or abs(int(raw)) >= 2**63 else int(raw)
            if value in (float("inf"), float("-inf")):
                raise PathSyntaxError("Invalid number", self.tokens[self.k - 1][2])
            return Expression("value", (value,))
        if kind == "str":
            return Expression("value", (_text(raw),))
        if raw in ("true", "false", "null"):
            return Expression("value", ({"true": True, "false": False, "null": None}[raw],))
        raise PathSyntaxError(f"Unknown identifier {raw!r}", self.tokens[self.k - 1][2])


def parse(path: str) -> tuple[Segment, ...]:
    """The segments of a path. The leading ``$`` may be left out."""
    text = path.strip()
    if text and text[0] not in "$.[":
        text = "." + text
    reader = _Reader(text[1:] if text.startswith("$") else text)
    return reader.segments()


@dataclass(frozen=True)
class Nodes:
    """What a path has reached: a value or an array of values, and the type of a value; None: nothing can match."""

    column: Column | None
    kind: T.DataType | None
    many: bool = False

    def each(self) -> Column:
        """The nodes as an array without missing ones."""
        return F.coalesce(F.array_compact(self.column if self.many else F.array(self.column)), F.array().cast(T.ArrayType(self.kind)))


_NONE = Nodes(None, None)


def _member(at: Nodes, name: str) -> Nodes:
    kind = at.kind
    if isinstance(kind, T.StructType) and name in kind.names:
        inner = kind[name].dataType
        if not at.many:
            return Nodes(at.column[name], inner)
        return Nodes(F.array_compact(F.transform(at.column, lambda x: x[name])), inner, True)
    if name == "length" and isinstance(kind, (T.ArrayType, T.StringType)):
        size = (lambda x: F.size(x)) if isinstance(kind, T.ArrayType) else (lambda x: F.regexp_count(x, F.lit(r"\X")))
        if not at.many:
            return Nodes(F.when(at.column.isNotNull(), size(at.column)), T.IntegerType())
        return Nodes(F.transform(at.column, size), T.IntegerType(), True)
    return _NONE


def _positions(array: Column, start: int | None, stop: int | None, step: int) -> Column:
    """The zero-based positions of a slice as an array; negative bounds count from the end."""
    n = F.size(array)
    bound = lambda v: F.lit(v) if v >= 0 else n + v
    if step > 0:
        lo = F.greatest(F.lit(0), bound(start or 0))
        hi = F.least(n, n if stop is None else bound(stop)) - 1
        return F.when(lo <= hi, F.sequence(lo, F.greatest(hi, lo), F.lit(step))).otherwise(F.array().cast("array<int>"))
    hi = F.least(n - 1, n - 1 if start is None else bound(start))
    lo = F.lit(0) if stop is None else F.greatest(F.lit(0), bound(stop) + 1)
    return F.when(hi >= lo, F.sequence(hi, F.least(lo, hi), F.lit(step))).otherwise(F.array().cast("array<int>"))


def _elements(at: Nodes, pick) -> Nodes:  # noqa: ANN001
    """Apply ``pick`` (array -> array) to the arrays reached."""
    if not isinstance(at.kind, T.ArrayType):
        return _NONE
    empty = F.array().cast(at.kind)
    if not at.many:
        return Nodes(F.coalesce(F.array_compact(pick(at.column)), empty), at.kind.elementType, True)
    return Nodes(F.array_compact(F.flatten(F.transform(at.column, pick))), at.kind.elementType, True)


def _select(at: Nodes, selector: Selector, root: Nodes) -> list[Nodes]:
    kind, value = selector.kind, selector.value
    if kind == "name":
        return [_member(at, value)]
    if isinstance(at.kind, T.StructType) and kind in ("all", "filter"):
        found = [_member(at, n) for n in at.kind.names]
        if kind == "all":
            return found
        kept = []
        for x in found:
            if not x.many:
                kept.append(Nodes(F.when(_truth(value, x, root), x.column), x.kind))
            else:
                kept.append(Nodes(_kept(x, value, root), x.kind, True))
        return kept
    if kind == "all":
        return [_elements(at, lambda a: a)]
    if kind == "index":
        if not isinstance(at.kind, T.ArrayType):
            return [_NONE]
        get = lambda a: F.try_element_at(a, F.lit(value + 1 if value >= 0 else value))
        if not at.many:
            return [Nodes(get(at.column), at.kind.elementType)]
        return [Nodes(F.array_compact(F.transform(at.column, get)), at.kind.elementType, True)]
    if kind == "slice":
        start, stop, step = value
        if step == 0:
            return [_NONE]
        return [_elements(at, lambda a: F.transform(_positions(a, start, stop, step), lambda i: F.get(a, i)))]
    return [_elements(at, lambda a: F.filter(a, lambda x: _truth(value, Nodes(x, at.kind.elementType), root)))]


def _kept(x: Nodes, test: Expression, root: Nodes) -> Column:
    return F.filter(x.column, lambda v: _truth(test, Nodes(v, x.kind), root))


def _below(at: Nodes) -> list[Nodes]:
    """``at`` and everything below it that its type knows of, parents first."""
    found = [at]
    if isinstance(at.kind, T.StructType):
        for n in at.kind.names:
            found += _below(_member(at, n))
    elif isinstance(at.kind, T.ArrayType):
        found += _below(_elements(at, lambda a: a))
    return found


def walk(at: Nodes, segments: tuple[Segment, ...], root: Nodes) -> list[Nodes]:
    """Follow ``segments`` from ``at``: what is reached, a list for each type location, in no order between them."""
    found = [at]
    for s in segments:
        starts = [y for x in found for y in (_below(x) if s.deep else [x])]
        found = [y for x in starts for sel in s.selectors if not _virtual(s, sel, x.kind) for y in _select(x, sel, root) if y.column is not None]
    return found


def _virtual(s: Segment, sel: Selector, kind: T.DataType) -> bool:
    """Whether this would be the length of something, which descendants don't have."""
    return s.deep and sel.value == "length" and not isinstance(kind, T.StructType)


def _operand(e: Expression, here: Nodes, root: Nodes) -> list[Nodes]:
    if e.op == "path":
        return walk(here if e.args[0] == "@" else root, e.args[1], root)
    if e.op == "value":
        v = e.args[0]
        kind = T.NullType() if v is None else T.BooleanType() if isinstance(v, bool) else T.DoubleType() if isinstance(v, (int, float)) else T.StringType()
        return [Nodes(F.lit(v), kind)]
    return [Nodes(_truth(e, here, root), T.BooleanType())]


def _pair(op: str, a: Column, ka: T.DataType, b: Column, kb: T.DataType) -> Column:
    numbers = isinstance(ka, T.NumericType) and isinstance(kb, T.NumericType)
    texts = isinstance(ka, T.StringType) and isinstance(kb, T.StringType)
    flags = isinstance(ka, T.BooleanType) and isinstance(kb, T.BooleanType)
    nothing = a.isNull() & b.isNull()
    same = F.coalesce(a == b, F.lit(False)) if numbers or texts or flags or (ka == kb and not isinstance(ka, T.NullType)) else F.lit(False)
    same = same | nothing
    if op == "==":
        return same
    if op == "!=":
        return ~same
    if not (numbers or texts):
        return nothing if op in ("<=", ">=") else F.lit(False)
    less = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return F.coalesce(less, F.lit(False)) | (nothing if op in ("<=", ">=") else F.lit(False))


def _truth(e: Expression, here: Nodes, root: Nodes) -> Column:
    if e.op in ("and", "or"):
        a, b = (_truth(x, here, root) for x in e.args)
        return a & b if e.op == "and" else a | b
    if e.op == "not":
        return ~_truth(e.args[0], here, root)
    if e.op == "value":
        v = e.args[0]
        return F.lit(v if isinstance(v, bool) else v is not None)
    if e.op == "path":
        return _any(F.size(x.each()) > 0 if x.many else x.column.isNotNull() for x in _operand(e, here, root))
    if e.op == "match":
        texts = [x for x in _operand(e.args[0], here, root) if isinstance(x.kind, T.StringType)]
        return _any(F.exists(x.each(), lambda v: v.rlike(e.args[1])) if x.many else F.coalesce(x.column.rlike(e.args[1]), F.lit(False)) for x in texts)
    left, right = (_operand(x, here, root) or [Nodes(F.lit(None), T.NullType())] for x in e.args)
    # One node on either side may be missing; of many, those that are there take part.
    left, right = ([Nodes(F.array(x.column), x.kind, True) if len(side) > 1 and not x.many else x for x in side] for side in (left, right))
    return _any(_compared(e.op, a, b) for a in left for b in right)


def _any(tests) -> Column:  # noqa: ANN001
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _compared(op: str, a: Nodes, b: Nodes) -> Column:
    if a.many:
        return F.exists(a.each(), lambda x: F.exists(b.each(), lambda y: _pair(op, x, a.kind, y, b.kind)) if b.many else _pair(op, x, a.kind, b.column, b.kind))
    if b.many:
        return F.exists(b.each(), lambda y: _pair(op, a.column, a.kind, y, b.kind))
    return _pair(op, a.column, a.kind, b.column, b.kind)


@dataclass(frozen=True)
class Located:
    """Nodes of one type location: an array of (ord, path, pointer, value)."""

    column: Column
    kind: T.DataType


def _step_name(name: str) -> str:
    return f".{name}" if re.fullmatch(r"[A-Za-z_]\w*", name, re.ASCII) else "['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _node(x: Column, order: tuple[Column, ...], path_: Column, pointer: Column, value: Column) -> Column:
    return F.struct(
        F.concat(x["ord"], F.array(*(o.cast("int") for o in order))).alias("ord"), F.concat(x["path"], path_).alias("path"), F.concat(x["pointer"], pointer).alias("pointer"), value.alias("value")
    )


def _present(nodes: Column) -> Column:
    return F.filter(nodes, lambda x: x["value"].isNotNull())


def _located_member(at: Located, name: str, order) -> list[Located]:  # noqa: ANN001
    """The member of a name; ``order`` makes the order key of its place among the members."""
    value = _member(Nodes(F.lit(None), at.kind), name)
    if value.column is None:
        return []
    place = at.kind.names.index(name) if isinstance(at.kind, T.StructType) and name in at.kind.names else 0
    pointer = "/" + name.replace("~", "~0").replace("/", "~1")
    return [Located(_present(F.transform(at.column, lambda x: _node(x, order(F.lit(place)), F.lit(_step_name(name)), F.lit(pointer), _member(Nodes(x["value"], at.kind), name).column))), value.kind)]


def _located_elements(at: Located, picked, order) -> list[Located]:  # noqa: ANN001
    """Elements at the positions that ``picked`` gives for an array."""
    each = lambda x: F.transform(
        picked(x["value"]), lambda i, k: _node(x, order(i, k), F.concat(F.lit("["), i.cast("string"), F.lit("]")), F.concat(F.lit("/"), i.cast("string")), F.get(x["value"], i))
    )
    return [Located(_present(F.flatten(F.transform(at.column, each))), at.kind.elementType)]


def _located_select(at: Located, selector: Selector, root: Nodes, number: int, deep: bool) -> list[Located]:
    """What one selector picks. Children are ordered by selector and place in it, descendants by place in the document."""
    kind, value = selector.kind, selector.value
    order = (lambda i, k=None: (i,)) if deep else (lambda i, k=None: (F.lit(number), i if k is None else k))
    if kind == "name":
        return [] if deep and value == "length" and not isinstance(at.kind, T.StructType) else _located_member(at, value, order)
    if isinstance(at.kind, T.StructType) and kind in ("all", "filter"):
        found = [y for n in at.kind.names for y in _located_member(at, n, order)]
        passing = lambda y: F.filter(y.column, lambda x: _truth(value, Nodes(x["value"], y.kind), root))
        return found if kind == "all" else [Located(passing(y), y.kind) for y in found]
    if not isinstance(at.kind, T.ArrayType):
        return []
    none = F.array().cast("array<int>")
    every = lambda a: F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(none)
    if kind == "all":
        return _located_elements(at, every, order)
    if kind == "index":
        return _located_elements(at, lambda a: F.filter(F.array(F.lit(value) if value >= 0 else F.size(a) + value), lambda i: (i >= 0) & (i < F.size(a))), order)
    if kind == "slice":
        return _located_elements(at, (lambda a: _positions(a, *value)) if value[2] else (lambda a: none), order)
    return _located_elements(at, lambda a: F.filter(every(a), lambda i: _truth(value, Nodes(F.get(a, i), at.kind.elementType), root)), order)


def _located_below(at: Located) -> list[Located]:
    """``at`` and everything below it, ordered by place in the document."""
    found = [at]
    if isinstance(at.kind, (T.StructType, T.ArrayType)):
        for y in _located_select(at, Selector("all"), _NONE, 0, True):
            found += _located_below(y)
    return found


def located(root: Nodes, segments: tuple[Segment, ...]) -> list[Located]:
    """Follow ``segments`` from the root with orders and paths."""
    start = F.filter(F.array(F.struct(F.array().cast("array<int>").alias("ord"), F.lit("$").alias("path"), F.lit("").alias("pointer"), root.column.alias("value"))), lambda x: x["value"].isNotNull())
    found = [Located(start, root.kind)]
    for s in segments:
        starts = [y for x in found for y in (_located_below(x) if s.deep else [x])]
        found = [y for x in starts for k, sel in enumerate(s.selectors) for y in _located_select(x, sel, root, k, s.deep)]
    return found


def _in_order(found: list[Located]) -> tuple[Column, T.DataType] | None:
    """All nodes in order, each path once, with the type of their values: their own, or JSON text if there are several."""
    if not found:
        return None
    kind = found[0].kind
    columns = [x.column for x in found]
    if len({x.kind.simpleString() for x in found}) > 1:
        as_text = lambda v: F.to_json(F.struct(v.alias("v"))).substr(F.lit(6), F.char_length(F.to_json(F.struct(v.alias("v")))) - 6)
        columns = [F.transform(x.column, lambda n: F.struct(n["ord"], n["path"], n["pointer"], as_text(n["value"]).alias("value"))) for x in found]
        kind = T.StringType()
    # Keys sort without the values, which may have no order, and lead back to the nodes by their place. One-element detours: each array is computed once.
    by_path = lambda nodes: F.array_sort(F.transform(nodes, lambda n, i: F.struct(n["path"].alias("path"), n["ord"].alias("ord"), i.alias("i"))))
    once = lambda keys: F.filter(keys, lambda x, i: (i == 0) | (x["path"] != F.get(keys, i - 1)["path"]))
    each = lambda nodes: F.transform(F.array(by_path(nodes)), once)[0]
    ordered = lambda nodes: F.transform(F.array_sort(F.transform(each(nodes), lambda k: F.struct(k["ord"], k["i"]))), lambda k: F.get(nodes, k["i"]))
    return F.transform(F.array(F.concat(*columns)), ordered)[0], kind


def _plain(segments: tuple[Segment, ...], found: list[Nodes]) -> bool:
    """Whether nodes come in order and once each anyway: one type location, and one selector a step, a name where it is deep."""
    return len(found) <= 1 and all(len(s.selectors) == 1 and (not s.deep or s.selectors[0].kind == "name") for s in segments)


def _distinct(segments: tuple[Segment, ...]) -> tuple[Segment, ...]:
    """Segments without selectors that a segment has twice: what they pick is there once, at its first place."""
    return tuple(replace(s, selectors=tuple({repr(x): x for x in reversed(s.selectors)}[r] for r in dict.fromkeys(map(repr, s.selectors)))) for s in segments)


def _root(df, column: str) -> Nodes:  # noqa: ANN001
    return Nodes(F.col(column), df.schema[column].dataType)


def path(df, column: str, text: str) -> Column:  # noqa: ANN001
    """The nodes that ``text`` matches in the nested ``column`` of ``df``: an array if it can match many, else a value."""
    root, segments = _root(df, column), parse(text)
    found = walk(root, segments, root)
    return (found[0].column if found else F.lit(None)) if _plain(segments, found) else matches(df, column, text)


def matches(df, column: str, text: str) -> Column:  # noqa: ANN001
    """Like ``path``, but always an array, empty where nothing matches."""
    root, segments = _root(df, column), _distinct(parse(text))
    found = walk(root, segments, root)
    if _plain(segments, found):
        return found[0].each() if found else F.array()
    ordered = _in_order(located(root, segments))
    return F.array() if ordered is None else F.transform(ordered[0], lambda x: x["value"])


def exists(df, column: str, text: str) -> Column:  # noqa: ANN001
    """Whether ``text`` matches anything, without putting nodes in order."""
    root = _root(df, column)
    return _any(F.size(x.each()) > 0 if x.many else x.column.isNotNull() for x in walk(root, parse(text), root))


def nodes(df, column: str, text: str) -> Column:  # noqa: ANN001
    """What ``text`` matches, in order, as an array of (path, pointer, value)."""
    root, segments = _root(df, column), _distinct(parse(text))
    found = located(root, segments)
    ordered = (found[0].column, found[0].kind) if found and _plain(segments, found) else _in_order(found)
    return F.array() if ordered is None else F.transform(ordered[0], lambda x: F.struct(x["path"].alias("path"), x["pointer"].alias("pointer"), x["value"].alias("value")))
