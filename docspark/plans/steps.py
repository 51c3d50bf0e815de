"""Pipelines of steps, each a DataFrame in and a DataFrame out, composed into one lazy plan.

A step is a small object with ``apply(frame, context)``. Nothing runs until the result is asked for: a variable that is read from the data is a
scalar subquery of the plan, a failing item is a value with an error, and what steps did is observed while the one action runs.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.paths import matches, path
from docspark.operators import collections as coll


@dataclass
class Context:
    """What steps see: variables, earlier results by name and position, the document, the library of pipelines."""

    document: DataFrame
    variables: dict[str, object] = field(default_factory=dict)
    results: list[tuple[str, DataFrame]] = field(default_factory=list)
    library: dict[str, Pipeline] = field(default_factory=dict)
    running: tuple[str, ...] = ()
    saved: dict[str, object] = field(default_factory=dict)

    def step(self, ref: str | int) -> DataFrame:
        """An earlier result by name, or by position from 0 (negative from the end)."""
        if isinstance(ref, int):
            return self.results[ref][1]
        return next(df for name, df in self.results if name == ref)


@dataclass(frozen=True)
class Path:
    """The matches of a path in a column, a row for each, in order; or the first one of each row, null if none."""

    column: str
    expression: str
    into: str = "value"
    first_only: bool = False

    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        found = matches(df, self.column, self.expression)
        rest = [c for c in df.columns if c not in (self.column, coll.POS)]
        if self.first_only:
            return df.select(*rest, F.try_element_at(found, F.lit(1)).alias(self.into))
        return df.select(*rest, F.posexplode(found).alias(coll.POS, self.into))


@dataclass(frozen=True)
class Flatten:
    """Arrays of arrays in a column with fewer levels; 0 or None for all."""

    column: str
    depth: int | None = None

    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        return coll.flatten(df, self.column, self.depth or None)


@dataclass(frozen=True)
class Script:
    """Any function of DataFrame and context."""

    run: Callable[[DataFrame, Context], DataFrame]

    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        return self.run(df, context)


@dataclass(frozen=True)
class Lazy:
    """A variable that the data has: a scalar subquery and its type."""

    value: Column
    kind: T.DataType


def lazy(df: DataFrame, aggregate: Column) -> Lazy:
    """The single value of an aggregate of ``df`` as a part of later plans; no job runs here."""
    one = df.agg(aggregate.alias("v"))
    return Lazy(one.scalar(), one.schema["v"].dataType)


def first_by_position(df: DataFrame, value: Column) -> Column:
    """The aggregate that takes a value from the first row, by position where there is one."""
    return F.min_by(F.struct(value.alias("v")), coll.POS)["v"] if coll.POS in df.columns else F.first(F.struct(value.alias("v")))["v"]


@dataclass(frozen=True)
class SetVariable:
    """Keep under a name a value, the single value of an aggregate of the input, what a path matches first in a column of the first row, or a template
    expanded over the first row. The input passes through. ``save`` also keeps it among the saved variables, which leave loops and sub-pipelines."""

    name: str
    value: object = None
    aggregate: Column | None = None
    path: tuple[str, str] | None = None
    template: tuple[str, str] | None = None
    save: bool = False

    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        if not re.fullmatch(r"[^\W\d]\w*", self.name):
            raise ValueError(f"invalid variable name {self.name!r}")
        value = self.value
        if self.aggregate is not None:
            value = lazy(df, self.aggregate)
        elif self.path is not None:
            value = lazy(df, first_by_position(df, F.try_element_at(matches(df, *self.path), F.lit(1))))
        elif self.template is not None:
            column, text = self.template
            shown = Template(text, column, "_v").apply(df, context)
            value = lazy(shown, first_by_position(shown, F.col("_v")))
        context.variables[self.name] = value
        if self.save:
            context.saved[self.name] = value
        return df


def rendered(value: object) -> str:
    """A value of the driver as a template shows it: texts as they are, nothing for None, all else as JSON."""
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, separators=(",", ":"), ensure_ascii=False, default=str)


def rendered_column(value: Column, kind: T.DataType) -> Column:
    """The same for a column."""
    if isinstance(kind, T.StringType):
        return F.coalesce(value, F.lit(""))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.coalesce(F.to_json(value), F.lit(""))
    whole = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), "").otherwise(whole.substr(F.lit(6), F.char_length(whole) - 6))


@dataclass(frozen=True)
class Template:
    """Add a text column from a template of ``{{ root.path }}``; what is missing is empty, an open ``{{`` stays as it is.

    Roots are ``input`` or ``$`` (the input column, also without a root), ``vars`` or ``env`` (variables), ``steps.name`` (the column of that
    name that an earlier step added), ``document`` (the column of that name), ``loop.index`` (the position), ``loop.count`` (the number of rows) and ``loop.item`` (the input column).
    """

    text: str
    column: str
    into: str

    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        parts: list[Column] = []
        for k, piece in enumerate(re.split(r"\{\{\s*(.+?)\s*\}\}", self.text)):
            parts.append(F.lit(piece) if k % 2 == 0 else self._value(df, context, piece))
        return df.withColumn(self.into, F.concat(*parts))

    def _value(self, df: DataFrame, context: Context, piece: str) -> Column:
        root, _, rest = piece.partition(".")
        if root in ("vars", "env"):
            name, _, inner = rest.partition(".")
            value = context.variables.get(name)
            if isinstance(value, Lazy):
                return _inside(value, inner)
            for step in inner.split(".") if inner else ():
                value = value.get(step) if isinstance(value, dict) else None
            return F.lit(rendered(value))
        if piece == "loop.index":
            return rendered_column(F.col(coll.POS), T.LongType())
        if piece == "loop.count":
            return rendered_column(lazy(df, F.count("*")).value, T.LongType())
        column, path_ = self.column, re.sub(r"^(input|loop\.item)(?=[.\[]|$)", "$", piece)
        if root in ("steps", "document"):
            column, _, path_ = (rest if root == "steps" else piece).partition(".")
            path_ = "$." + path_ if path_ else "$"
            if column not in df.columns:
                raise ValueError(f"{{{{ {piece} }}}}: no earlier step has added a column {column!r}")
        elif root == "loop" and column not in df.columns:
            raise ValueError(f"{{{{ {piece} }}}}: no loop")
        found = df.select(path(df, column, path_).alias("v"))
        return rendered_column(path(df, column, path_), found.schema["v"].dataType)


def _inside(variable: Lazy, steps: str) -> Column:
    """A member of a lazy variable as text; empty where there is none."""
    value, kind = variable.value, variable.kind
    for step in steps.split(".") if steps else ():
        if isinstance(kind, T.StructType) and step in kind.names:
            value, kind = value[step], kind[step].dataType
        elif isinstance(kind, T.ArrayType) and step.isdigit():
            value, kind = F.get(value, int(step)), kind.elementType
        elif isinstance(kind, T.MapType):
            value, kind = F.try_element_at(value, F.lit(step)), kind.valueType
        else:
            return F.lit("")
    return rendered_column(value, kind)


@dataclass(frozen=True)
class Attempt:
    """What a body makes of an item: a value, or an error where ``error`` isn't null. Nothing is raised on the way."""

    value: Column
    error: Column

    def then(self, step: Callable[[Column], Attempt | Column]) -> Attempt:
        """A further step on the value; the first error stays."""
        after = step(self.value)
        value, error = (after.value, after.error) if isinstance(after, Attempt) else (after, F.lit(None).cast("string"))
        return Attempt(F.when(self.error.isNull(), value), F.coalesce(self.error, error))


def attempt_cast(value: Column, kind: str) -> Attempt:
    """A value read as another type; what can't be read is an error."""
    read = value.try_cast(kind)
    return Attempt(read, F.when(value.isNotNull() & read.isNull(), F.concat(F.lit("can't read "), value.cast("string"), F.lit(f" as {kind}"))))


def attempt_if(value: Column, good: Column, message: str | Column) -> Attempt:
    """A value on a condition, else an error; ``failed`` where its message is null."""
    text = F.lit(message) if isinstance(message, str) else message
    return Attempt(value, F.when(~F.coalesce(good, F.lit(False)), F.coalesce(text, F.lit("failed"))))


@dataclass(frozen=True)
class ForEach:
    """A body for every row: ``body(row columns)`` gives the result column, or an ``Attempt`` with an error where the item fails; ``ok`` tells rows that succeed.

    Policies for the others: "skip" leaves them out, "null" keeps null, "fail" fails the action with the error at the least position, which a subquery of
    the plan finds. Merging adds the result's members to the row's; a result without members becomes ``into``. ``errors`` names a column
    that keeps the errors under "null". ``saves`` are variables from items that succeed; the one at the last position stays.
    """

    body: Callable[[DataFrame], Column | Attempt]
    ok: Callable[[DataFrame], Column] | None = None
    policy: str = "fail"
    merge: bool = False
    into: str = "result"
    errors: str | None = None
    saves: dict[str, Callable[[DataFrame], Column]] = field(default_factory=dict)

    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        made = self.body(df)
        attempt = made if isinstance(made, Attempt) else Attempt(made, F.lit(None).cast("string"))
        if self.ok:
            attempt = Attempt(attempt.value, F.when(~F.coalesce(self.ok(df), F.lit(False)), F.coalesce(attempt.error, F.lit("failed"))).otherwise(attempt.error))
        never = self.ok is None and not isinstance(made, Attempt)
        for name, value in self.saves.items():
            at = F.col(coll.POS) if coll.POS in df.columns else F.monotonically_increasing_id()
            context.variables[name] = context.saved[name] = lazy(df.filter(attempt.error.isNull()), F.max_by(F.struct(value(df).alias("v")), at)["v"])
        if never:
            out = df.withColumn(self.into, attempt.value)
        elif self.policy == "fail":
            failed = df.filter(attempt.error.isNotNull()).agg(F.min(F.struct(F.col(coll.POS).alias("at"), attempt.error.alias("error"))).alias("f")).scalar()
            stop = F.raise_error(F.concat(F.lit("item "), failed["at"].cast("string"), F.lit(" failed: "), failed["error"]))
            out = df.withColumn(self.into, F.when(failed.isNotNull(), stop.cast(df.select(attempt.value.alias("v")).schema["v"].dataType)).otherwise(attempt.value))
        elif self.policy == "skip":
            out = df.filter(attempt.error.isNull()).withColumn(self.into, attempt.value)
        else:
            both = {self.into: F.when(attempt.error.isNull(), attempt.value)} | ({self.errors: attempt.error} if self.errors else {})
            out = df.withColumns(both)
        kind = out.schema[self.into].dataType
        if not self.merge or not hasattr(kind, "fields"):
            return out
        return out.withColumns({n: F.col(self.into)[n] for n in kind.names}).drop(self.into)


@dataclass(frozen=True)
class SubPipeline:
    """A pipeline of the library. Its variables flow in and out; a pipeline can't run within itself."""

    name: str

    def apply(self, df: DataFrame, context: Context) -> DataFrame:
        if self.name in context.running:
            raise ValueError(f"pipeline {self.name!r} runs itself")
        inner = Context(context.document, context.variables, [], context.library, (*context.running, self.name), context.saved)
        return context.library[self.name].run(df, inner)


@dataclass(frozen=True)
class Step:
    """A named step; one that is switched off passes its input through."""

    name: str
    action: object
    enabled: bool = True


@dataclass
class StepResult:
    """What became of a step: whether it was skipped, why it failed, how long its plan took to build, and rows and failures as observed by the action."""

    name: str
    skipped: bool = False
    error: str | None = None
    seconds: float = 0.0
    seen: Observation | None = None

    @property
    def observed(self) -> dict[str, int]:
        """Rows that the step gave and how many of them hold an error; to be read after an action on the output, which this waits for."""
        return self.seen.get if self.seen is not None else {}


@dataclass
class RunResult:
    """The last step's output, None if a step failed, with the results of all steps and the variables at the end."""

    output: DataFrame | None
    steps: list[StepResult]
    variables: dict[str, object]
    saved: dict[str, object]

    @property
    def failed(self) -> str | None:
        """The name of the step that failed."""
        return next((s.name for s in self.steps if s.error is not None), None)

    def step(self, ref: str | int) -> StepResult:
        """A step's result by name, or by position from 0."""
        return self.steps[ref] if isinstance(ref, int) else next(s for s in self.steps if s.name == ref)


@dataclass(frozen=True)
class Pipeline:
    """Steps in order."""

    steps: tuple[Step, ...]

    def run(self, df: DataFrame, context: Context | None = None) -> DataFrame:
        """The last step's result. The first step that fails stops the run."""
        context = context or Context(df)
        for s in self.steps:
            if s.enabled:
                df = s.action.apply(df, context)
            context.results.append((s.name, df))
        return df

    def watched(self, df: DataFrame, context: Context | None = None) -> RunResult:
        """Run and keep what each step did. A step whose plan can't be built fails, those after it are skipped, and there is no output.

        Rows are counted by observations, one for each step, which cost no job: one action on the output fills them. An item's error is counted
        where the step keeps it in a column (``ForEach.errors``).
        """
        context, results, alive = context or Context(df), [], True
        for s in self.steps:
            result = StepResult(s.name, skipped=not (alive and s.enabled))
            results.append(result)
            if not result.skipped:
                began = time.monotonic()
                try:
                    df = s.action.apply(df, context)
                    errors = getattr(s.action, "errors", None)
                    result.seen = Observation(f"{len(results)} {s.name}")
                    df = df.observe(result.seen, F.count(F.lit(1)).alias("rows"), (F.count(F.col(errors)) if errors else F.count_if(F.lit(False))).alias("failures"))
                except (ValueError, LookupError, AnalysisException) as e:
                    result.error, alive = str(e), False
                result.seconds = time.monotonic() - began
            context.results.append((s.name, df))
        return RunResult(df if alive else None, results, context.variables, context.saved)
