"""Helpers on collections: a DataFrame whose rows are the elements of one array, in the order of ``_pos``.

Keys are column names, dotted paths or Columns. Nulls sort last in both directions; sums take what is not a
number as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POS = "_pos"
#: Positions in a part of a group.
PART = 100_000


def key_of(key: str | Column) -> Column:
    """A key given by name, dotted path or Column."""
    return F.col(key) if isinstance(key, str) else key


def _row(c: DataFrame) -> Column:
    return F.struct(*(x for x in c.columns if x != POS))


def group_by(c: DataFrame, key: str | Column) -> DataFrame:
    """(key, items): the items of each key in order. A group is one array in one row: where no bound on groups is known take ``group_rows``."""
    return c.groupBy(key_of(key).alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct(POS, _row(c).alias("item")))), lambda x: x["item"]).alias("items"))


def group_rows(c: DataFrame, key: str | Column, part: int = PART) -> DataFrame:
    """The items with ``key`` and ``n``, their place in their group from 0: groups as rows, of any size.

    A group is dealt by stretches of ``part`` positions, which are counted and summed before items are numbered within each.
    """
    rows = c.select(F.struct(*c.columns).alias("_item"), key_of(key).alias("key"), F.floor(F.col(POS) / part).alias("_part"))
    counts = rows.groupBy("key", "_part").agg(F.count("*").alias("_count"))
    before = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("key").alias("_k"), F.col("_part").alias("_p"), F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_base"))
    within = rows.withColumn("_in", F.row_number().over(Window.partitionBy("key", "_part").orderBy(F.col("_item")[POS])) - 1)
    both = within.join(bases, F.col("key").eqNullSafe(F.col("_k")) & F.col("_part").eqNullSafe(F.col("_p")))
    return both.select("key", (F.col("_base") + F.col("_in")).alias("n"), F.col("_item").alias("item"))


def count_by(c: DataFrame, key: str | Column) -> DataFrame:
    """(key, n): how many items each key has."""
    return c.groupBy(key_of(key).alias("key")).agg(F.count("*").alias("n"))


def sort_by(c: DataFrame, key: str | Column, descending: bool = False) -> DataFrame:
    """Items by key, nulls last, equal keys in order."""
    k = key_of(key)
    return c.orderBy(k.desc_nulls_last() if descending else k.asc_nulls_last(), POS)


def uniq_by(c: DataFrame, *keys: str | Column) -> DataFrame:
    """The first item of each key."""
    named = {f"_k{i}": key_of(k) for i, k in enumerate(keys)}
    first = c.select(POS, *(v.alias(k) for k, v in named.items())).groupBy(*named).agg(F.min(POS).alias(POS)).select(POS)
    return c.join(first, POS, "left_semi")


def number(x: Column) -> Column:
    """A value as a number: texts are read, what can't be read or is null is 0."""
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def total_of(key: str | Column) -> Column:
    """The sum as an aggregate; 0 for no items."""
    return F.coalesce(F.sum(number(key_of(key))), F.lit(0.0))


def least_of(key: str | Column) -> Column:
    """The least number as an aggregate, what is no number counting as 0; null for no items."""
    return F.min(number(key_of(key)))


def greatest_of(key: str | Column) -> Column:
    """The greatest number as an aggregate, what is no number counting as 0; null for no items."""
    return F.max(number(key_of(key)))


def total(c: DataFrame, key: str | Column) -> DataFrame:
    """(value): the sum; 0 for no items."""
    return c.agg(total_of(key).alias("value"))


def least(c: DataFrame, key: str | Column) -> DataFrame:
    """(value): the least number; null for no items."""
    return c.agg(least_of(key).alias("value"))


def greatest(c: DataFrame, key: str | Column) -> DataFrame:
    """(value): the greatest number; null for no items."""
    return c.agg(greatest_of(key).alias("value"))


def compact(c: DataFrame, key: str | Column) -> DataFrame:
    """Items whose key is not null."""
    return c.filter(key_of(key).isNotNull())


def chunk(c: DataFrame, size: int) -> DataFrame:
    """(chunk, items): runs of ``size`` items; the last may be shorter."""
    if size <= 0:
        raise ValueError("size must be positive")
    return c.groupBy(F.floor(F.col(POS) / size).cast("bigint").alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct(POS, _row(c).alias("item")))), lambda x: x["item"]).alias("items"))


def pick(c: DataFrame, *names: str) -> DataFrame:
    """Only these members, in this order; names that are missing are passed over."""
    return c.select(*(n for n in names if n in c.columns), *([POS] if POS in c.columns else []))


def omit(c: DataFrame, *names: str) -> DataFrame:
    """All but these members."""
    return c.drop(*names)


def rename(c: DataFrame, names: dict[str, str]) -> DataFrame:
    """Members under new names, in place; of clashing names the later wins."""
    out = [(names.get(n, n), n) for n in c.columns]
    last = {new: k for k, (new, _) in enumerate(out)}
    return c.select(*(F.col(old).alias(new) for k, (new, old) in enumerate(out) if last[new] == k))


def map_values(c: DataFrame, change) -> DataFrame:  # noqa: ANN001
    """Every member through ``change(column, name)``."""
    return c.select(*(change(F.col(n), n).alias(n) if n != POS else F.col(n) for n in c.columns))


def flat_names(kind: T.StructType, separator: str = ".", before: tuple[str, ...] = ()) -> list[tuple[str, tuple[str, ...]]]:
    """The leaves of a struct type: joined name and path."""
    found: list[tuple[str, tuple[str, ...]]] = []
    for f in kind.fields:
        at = (*before, f.name)
        found += flat_names(f.dataType, separator, at) if isinstance(f.dataType, T.StructType) and f.dataType.fields else [(separator.join(at), at)]
    return found


def flatten_object(c: DataFrame, separator: str = ".") -> DataFrame:
    """Nested members as columns with joined names."""

    def at(steps: tuple[str, ...]) -> Column:
        out = F.col(f"`{steps[0]}`")
        for s in steps[1:]:
            out = out[s]
        return out

    return c.select(*(at(steps).alias(name) for name, steps in flat_names(c.schema, separator)))


def entries(c: DataFrame, *names: str) -> DataFrame:
    """(_pos, key, value): a row for each member of each item, values as text."""
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names))
    return c.select(POS, F.inline(pairs))


def flatten(c: DataFrame, column: str, depth: int | None = 1) -> DataFrame:
    """Arrays of arrays in ``column`` with ``depth`` levels fewer; None: all levels; 0 or less: unchanged."""
    kind, out = c.schema[column].dataType, F.col(column)
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType) and (depth is None or depth > 0):
        out, kind, depth = F.flatten(out), kind.elementType, None if depth is None else depth - 1
    return c.withColumn(column, out)
