"""Edits of nested columns at JSON pointers: ``/items/0/price`` steps into members by name and into arrays by index.

An edit is one Column. Names are settled when the plan is built: a member that the type doesn't have is an ``EditError``. What only
a row can tell (an index out of range, a null on the way) leaves that row as it is; ``at(...).isNotNull()`` finds such rows beforehand.

All elements of an array share one type, so below an index a removed member becomes null, which is a missing member, a new value is cast to the
member's type, and edits that would give one element a type of its own are refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: change(value, its type, whether this is the place; None: always) -> the new value.
Change = Callable[[Column, T.DataType, Column | None], Column]


class EditError(ValueError):
    """An edit that the column's type doesn't allow."""


def steps_of(pointer: str) -> list[str]:
    """The steps of a JSON pointer; none for the root."""
    if pointer and not pointer.startswith("/"):
        raise EditError(f"a pointer starts with a slash: {pointer!r}")
    return [s.replace("~1", "/").replace("~0", "~") for s in pointer.split("/")[1:]]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _index(step: str) -> int:
    if not step.isascii() or not step.isdigit():
        raise EditError(f"{step!r} is no index")
    return int(step)


def _member(kind: T.DataType, name: str) -> T.DataType:
    if not isinstance(kind, T.StructType) or name not in kind.names:
        raise EditError(f"no member {name!r} in {kind.simpleString()}")
    return kind[name].dataType


def _if(on: Column | None, new: Column, old: Column) -> Column:
    return new if on is None else F.when(on, new).otherwise(old)


def _below(value: Column, kind: T.DataType, steps: list[str], change: Change, on: Column | None = None) -> Column:
    if not steps:
        return change(value, kind, on)
    step, rest = steps[0], steps[1:]
    if isinstance(kind, T.ArrayType):
        k = _index(step)
        here = lambda i: i == k if on is None else on & (i == k)
        return F.transform(value, lambda x, i: _below(x, kind.elementType, rest, change, here(i)))
    return value.withField(_quoted(step), _below(value[step], _member(kind, step), rest, change, on))


def _edited(df: DataFrame, column: str, steps: list[str], change: Change) -> DataFrame:
    return df.withColumn(column, _below(F.col(_quoted(column)), df.schema[column].dataType, steps, change))


def at(df: DataFrame, column: str, pointer: str) -> Column:
    """The value at a pointer; null where a row has none, and where the type has none."""
    value, kind = F.col(_quoted(column)), df.schema[column].dataType
    for step in steps_of(pointer):
        if isinstance(kind, T.ArrayType) and step.isascii() and step.isdigit():
            value, kind = F.get(value, int(step)), kind.elementType
        elif isinstance(kind, T.StructType) and step in kind.names:
            value, kind = value[step], kind[step].dataType
        else:
            return F.lit(None)
    return value


def put(df: DataFrame, column: str, pointer: str, new: Column) -> DataFrame:
    """``new`` at the pointer: the root, an element within the array, or a member; a new member comes last."""
    steps = steps_of(pointer)
    if not steps:
        return df.withColumn(column, new)

    def change(value: Column, kind: T.DataType, on: Column | None) -> Column:
        name = steps[-1]
        if isinstance(kind, T.ArrayType):
            k = _index(name)
            return F.transform(value, lambda x, i: F.when(i == k if on is None else on & (i == k), new.cast(kind.elementType)).otherwise(x))
        if not isinstance(kind, T.StructType):
            raise EditError(f"{kind.simpleString()} has no members")
        if on is None:
            return value.withField(_quoted(name), new)
        return value.withField(_quoted(name), F.when(on, new.cast(kind[name].dataType)).otherwise(value[name]) if name in kind.names else F.when(on, new))

    return _edited(df, column, steps[:-1], change)


def remove(df: DataFrame, column: str, pointer: str) -> DataFrame:
    """Without the element or member at the pointer. The root stays, and so does the last member of a struct: both are an ``EditError``."""
    steps = steps_of(pointer)
    if not steps:
        raise EditError("the root can't be removed")

    def change(value: Column, kind: T.DataType, on: Column | None) -> Column:
        name = steps[-1]
        if isinstance(kind, T.ArrayType):
            k = _index(name)
            return F.filter(value, lambda x, i: ~(i == k if on is None else on & (i == k)))
        gone = _member(kind, name)
        if on is not None:
            return value.withField(_quoted(name), F.when(on, F.lit(None).cast(gone)).otherwise(value[name]))
        if len(kind.names) == 1:
            raise EditError(f"{name!r} is the only member")
        return value.dropFields(_quoted(name))

    return _edited(df, column, steps[:-1], change)


def insert_item(df: DataFrame, column: str, pointer: str, new: Column, index: int | None = None) -> DataFrame:
    """``new`` in the array at the pointer, before the item at ``index``, from 0 to the number of items; None: at the end."""
    if index is not None and index < 0:
        raise EditError("an index is 0 or more")

    def change(value: Column, kind: T.DataType, on: Column | None) -> Column:
        if not isinstance(kind, T.ArrayType):
            raise EditError(f"{kind.simpleString()} is no array")
        item = new.cast(kind.elementType)
        if index is None:
            return _if(on, F.array_append(value, item), value)
        fits = F.size(value) >= index
        return F.when(fits if on is None else on & fits, F.array_insert(value, index + 1, item)).otherwise(value)

    return _edited(df, column, steps_of(pointer), change)


def _rebuilt(value: Column, members: list[tuple[str, Column]]) -> Column:
    return F.when(value.isNotNull(), F.struct(*(c.alias(n) for n, c in members)))


def _no_index(on: Column | None) -> None:
    if on is not None:
        raise EditError("one element of an array can't have members of its own")


def insert_member(df: DataFrame, column: str, pointer: str, name: str, new: Column, index: int | None = None) -> DataFrame:
    """A member of the struct at the pointer, as the ``index``-th (bounded by the number of members) or last; one of that name moves."""

    def change(value: Column, kind: T.DataType, on: Column | None) -> Column:
        if not isinstance(kind, T.StructType):
            raise EditError(f"{kind.simpleString()} has no members")
        _no_index(on)
        others = [(n, value[n]) for n in kind.names if n != name]
        place = len(others) if index is None else min(max(index, 0), len(others))
        return _rebuilt(value, [*others[:place], (name, new), *others[place:]])

    return _edited(df, column, steps_of(pointer), change)


def rename_member(df: DataFrame, column: str, pointer: str, name: str) -> DataFrame:
    """The member at the pointer under another name, in its place; unchanged if its struct has that name already."""
    steps = steps_of(pointer)
    if not steps:
        raise EditError("the root has no name")

    def change(value: Column, kind: T.DataType, on: Column | None) -> Column:
        _member(kind, steps[-1])
        _no_index(on)
        return value if name in kind.names else _rebuilt(value, [(name if n == steps[-1] else n, value[n]) for n in kind.names])

    return _edited(df, column, steps[:-1], change)


def preview(value: Column, kind: T.DataType, width: int = 80) -> Column:
    """A line about a value: how many members (those that aren't null) or items it has, or its JSON text, cut to ``width`` characters."""
    if isinstance(kind, (T.StructType, T.ArrayType)):
        struct = isinstance(kind, T.StructType)
        n = sum((value[x].isNotNull().cast("int") for x in kind.names), F.lit(0)) if struct else F.size(value)
        unit, left, right = ("key", "{", "}") if struct else ("item", "[", "]")
        some = F.concat(F.lit(f"{left} "), n.cast("string"), F.when(n == 1, F.lit(f" {unit} {right}")).otherwise(F.lit(f" {unit}s {right}")))
        return F.when(value.isNull(), "null").when(n == 0, left + right).otherwise(some)
    whole = F.to_json(F.struct(value.alias("v")))
    text = F.when(value.isNull(), "null").otherwise(F.substring(whole, F.lit(6), F.char_length(whole) - 6))
    return F.when(F.char_length(text) > width, F.concat(F.left(text, F.lit(width - 1)), F.lit("…"))).otherwise(text)
