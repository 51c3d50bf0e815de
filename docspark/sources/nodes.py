"""Ragged JSON texts as a table of nodes, and back.

``shred`` walks each text once and gives a row for each node, in the order of the text: its place (``pre``, and ``last``, the place of its last
descendant, so that "below" is an interval), its parent, name or index, kind, scalar text as written, number, and a key that is equal for equal
values. VARIANT can't do this: it sorts members and rewrites numbers. The walk is a small function in Arrow batches; all that
is asked of nodes is joins, groups and windows over the table.

* Null is a node of kind ``null``; a missing member has no node. A name given twice has its first place and its last value.
* Invalid texts, nulls and texts nested deeper than ``DEEPEST`` have no nodes. ``NaN`` and infinities are invalid; half a surrogate pair is U+FFFD.
* ``text`` of a number is its literal; ``canon`` tells numbers by their double, members in any order.
* ``height`` is the depth of the deepest node below; ``kids`` are the children in order and ``names`` the names of members, so that tests of members need no join.
* Only the root's row has ``json``, the minified text; a node's own is ``substring(json, start, length)``, so no text is kept twice.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEEPEST = 512
#: The step of a generalised path into an array; steps into members are their names after a dot, so that no name is taken for two steps.
ELEMENT = "[*]"
COLUMNS = {
    "pre": "int", "last": "int", "parent": "int", "depth": "int", "name": "string", "idx": "int", "sib": "int", "pn": "int", "kind": "string", "text": "string", "num": "double", "n": "int", "canon": "string",
    "start": "int", "length": "int", "path": "string", "pointer": "string", "steps": "array<string>", "json": "string", "height": "int", "kids": "array<struct<sib:int,name:string,kind:string,text:string,num:double,canon:string>>",
    "names": "array<string>",
}
#: What a node tells of each of its children in ``kids``.
KID = ("sib", "name", "kind", "text", "num", "canon")
ARROW = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
#: What nodes are, by number: containers first, then constants; texts and numbers follow as they are met.
OBJECT, ARRAY = 0, 1
CONSTANTS = {None: 2, True: 3, False: 4}
#: Nodes of a batch that is passed on, about, and the memory that tables of places and scalars may take from one batch to the next.
BATCH, HELD = 20000, 1 << 21


def _refused(name: str) -> None:
    raise ValueError(name)


def step_name(name: str) -> str:
    """A name as a step of a path."""
    return f".{name}" if re.fullmatch(r"[^\W\d]\w*", name) else "['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


class _Made(dict):
    """Values by key, made when they are first asked for."""

    def __init__(self, make: Callable[[str], int]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> int:
        made = self[key] = self.make(key)
        return made


class _Walk:
    """Values as nodes in pre-order. Of each node it notes the row of its parent, its place (the steps to it) and what it is, as numbers.

    Places and scalars are kept in tables, once each; the parser gives a number as its number in the table. ``states`` has, for each state, the
    states of members by name, of other members and of elements, the last one for all that follow; -1 is that of no interest.
    """

    def __init__(self, wanted: set[str], states: list[tuple[dict[str, int], int, list[int]]] | None = None) -> None:
        self.wanted, self.states = wanted, states
        self.spelled = bool(wanted & {"start", "length", "json"})
        self.numbers, self.strings = _Made(self._number), _Made(self._string)
        self.decode = json.JSONDecoder(parse_float=self.numbers.__getitem__, parse_int=self.numbers.__getitem__, parse_constant=_refused).decode
        self._forget()
        self.clear()

    def _forget(self) -> None:
        self.numbers.clear()
        self.strings.clear()
        self.held = 0
        self.scalars = {"kind": ["object", "array", "null", "boolean", "boolean"], "text": [None, None, "null", "true", "false"], "num": [None] * 5, "canon": [None, None, "z", "t", "f"], "shown": ["{", "[", "null", "true", "false"]}
        self.below: list[dict[str | int, int]] = [{}]
        self.places = {"depth": [0], "name": [None], "idx": [None], "path": ["$"], "pointer": [""], "trail": [0], "shown": [""], "state": [0]}
        self.trails, self.trail_of = [[]], {}

    def clear(self) -> None:
        if self.held > HELD:
            self._forget()
        self.up, self.at, self.of, self.firsts = [], [], [], []

    def _scalar(self, kind: str, text: str, num: float | None, canon: str, shown: str) -> int:
        for c, x in zip(self.scalars, (kind, text, num, canon, shown)):
            self.scalars[c].append(x)
        self.held += len(text) + 200
        return len(self.scalars["kind"]) - 1

    def _number(self, text: str) -> int:
        number = float(text) + 0.0
        return self._scalar("integer" if number.is_integer() else "number", text, number, f"n{number!r}", text)

    def _string(self, text: str) -> int:
        return self._scalar("string", text, None, "s" + text, json.dumps(text, ensure_ascii=False) if self.spelled else "")

    def _place(self, above: int, step: str | int) -> int:
        """The place one step below another, met for the first time."""
        own = self.below[above][step] = len(self.below)
        self.below.append({})
        self.held += 500
        places, named = self.places, type(step) is str
        places["depth"].append(places["depth"][above] + 1)
        places["name"].append(step if named else None)
        places["idx"].append(None if named else step)
        if "path" in self.wanted:
            places["path"].append(places["path"][above] + (step_name(step) if named else f"[{step}]"))
            self.held += len(places["path"][own])
        if "pointer" in self.wanted:
            places["pointer"].append(places["pointer"][above] + "/" + (step.replace("~", "~0").replace("/", "~1") if named else str(step)))
            self.held += len(places["pointer"][own])
        if "steps" in self.wanted:
            way = places["trail"][above], "." + step if named else ELEMENT
            if way not in self.trail_of:
                self.trail_of[way] = len(self.trails)
                self.trails.append([*self.trails[way[0]], way[1]])
            places["trail"].append(self.trail_of[way])
        places["shown"].append(json.dumps(step, ensure_ascii=False) + ":" if named else "")
        if self.states:
            state = places["state"][above]
            if state >= 0:
                names, other, items = self.states[state]
                state = names.get(step, other) if named else items[min(step, len(items) - 1)]
            places["state"].append(state)
        return own

    def add(self, text: str) -> None:
        """Append the nodes of a text; nothing of it stays if it is invalid or nested too deeply."""
        value = self.decode(text)
        if "\\u" in text:
            value = _without_halves(value)
        first = len(self.up)
        try:
            self._enter([value], -1, [0], 0)
        except (ValueError, RecursionError):
            for x in (self.up, self.at, self.of):
                del x[first:]
            raise
        self.firsts.append(first)

    def _enter(self, value: dict | list, own: int, there: dict | list, depth: int) -> None:
        """Append what is below a container, whose row and places below are given; the root is below none."""
        up, at, of, strings, below = self.up, self.at, self.of, self.strings, self.below
        if depth > DEEPEST:
            raise ValueError("nested too deeply")
        above = at[own] if own >= 0 else 0
        for step, x in value.items() if type(value) is dict else enumerate(value):
            place = (there.get(step) or self._place(above, step)) if depth else 0
            up.append(own)
            at.append(place)
            kind = type(x)
            if kind is int:
                of.append(x)
            elif kind is str:
                of.append(strings[x])
            elif kind is dict or kind is list:
                of.append(OBJECT if kind is dict else ARRAY)
                if x:
                    self._enter(x, len(up) - 1, below[place], depth + 1)
            else:
                of.append(CONSTANTS[x])


class _Nodes:
    """The columns of a batch of walked nodes."""

    def __init__(self, walk: _Walk) -> None:
        self.walk = walk
        self.up, self.at, self.of = (np.array(x, np.int64) for x in (walk.up, walk.at, walk.of))
        self.firsts = np.array(walk.firsts, np.int64)
        self.counts = np.diff(self.firsts, append=len(self.up))
        #: The row of the root of each node's document.
        self.first = np.repeat(self.firsts, self.counts)
        self.row, self.inner = np.arange(len(self.up)), np.flatnonzero(self.up >= 0)

    @cached_property
    def depth(self) -> np.ndarray:
        return np.array(self.walk.places["depth"])[self.at]

    @cached_property
    def n(self) -> np.ndarray:
        return np.bincount(self.up[self.inner], minlength=len(self.up))

    @cached_property
    def below(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all children by parent, and where those of each row begin and end."""
        return self.inner[np.argsort(self.up[self.inner], kind="stable")], np.concatenate([[0], np.cumsum(self.n)])

    @cached_property
    def sib(self) -> np.ndarray:
        order, ends = self.below
        out = np.zeros(len(self.up), np.int64)
        out[order] = np.arange(len(order)) - ends[self.up[order]]
        return out

    def _greatest(self, own: np.ndarray) -> np.ndarray:
        """The greatest value of a node and all below it."""
        out = own.copy()
        for d in range(self.depth.max(initial=0), 0, -1):
            rows = np.flatnonzero(self.depth == d)
            np.maximum.at(out, self.up[rows], out[rows])
        return out

    @cached_property
    def last(self) -> np.ndarray:
        return self._greatest(self.row)

    @cached_property
    def canon(self) -> list[str]:
        own, shown = self.walk.scalars["canon"], self.walk.places["shown"]
        out, (order, ends) = [own[x] for x in self.of], self.below
        for row in np.flatnonzero(self.of <= ARRAY)[::-1].tolist():
            kids = order[ends[row] : ends[row + 1]].tolist()
            named = self.of[row] == OBJECT
            all_ = sorted(shown[self.at[k]] + out[k] for k in kids) if named else [out[k] for k in kids]
            out[row] = ("o" if named else "a") + hashlib.md5("\x00".join(all_).encode()).hexdigest()
        return out

    @cached_property
    def before(self) -> np.ndarray:
        """The length of what stands before a node's own text: a comma, its name."""
        return (self.sib > 0) + np.array([len(x) for x in self.walk.places["shown"]])[self.at]

    @cached_property
    def opened(self) -> np.ndarray:
        """The length of all texts before each row, brackets that close left out; one more than there are rows."""
        return np.concatenate([[0], np.cumsum(self.before + np.array([len(x) for x in self.walk.scalars["shown"]])[self.of])])

    @cached_property
    def containers(self) -> np.ndarray:
        """The number of containers before each row; one more than there are rows."""
        return np.concatenate([[0], np.cumsum(self.of <= ARRAY)])

    def _start(self) -> np.ndarray:
        # Of the containers before a node, all are closed but those that it is in.
        return 1 + self.opened[:-1] - self.opened[self.first] + self.before + self.containers[:-1] - self.containers[self.first] - self.depth

    def _length(self) -> np.ndarray:
        return self.opened[self.last + 1] - self.opened[:-1] - self.before + self.containers[self.last + 1] - self.containers[:-1]

    def _json(self) -> list[str | None]:
        """The minified texts of roots."""
        out: list[str | None] = [None] * len(self.up)
        names, shown, last, pieces, open_ = self.walk.places["shown"], self.walk.scalars["shown"], self.last.tolist(), [], []
        for row, (at, of, sib) in enumerate(zip(self.walk.at, self.walk.of, self.sib.tolist())):
            pieces.append(f",{names[at]}{shown[of]}" if sib else names[at] + shown[of])
            if of <= ARRAY:
                open_.append(row)
            while open_ and last[open_[-1]] == row:
                pieces.append("}" if self.walk.of[open_.pop()] == OBJECT else "]")
            if not open_:
                out[int(self.first[row])] = "".join(pieces)
                pieces = []
        return out

    def _kids(self) -> pa.Array:
        order, ends = self.below
        own = [self.column(c).take(pa.array(order)) for c in KID]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(own, names=list(KID)))

    def _names(self) -> pa.Array:
        """The names of members; elements have none."""
        order, _ = self.below
        order = order[self.of[self.up[order]] == OBJECT]
        ends = np.concatenate([[0], np.cumsum(np.where(self.of == OBJECT, self.n, 0))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.column("name").take(pa.array(order)))

    def column(self, c: str) -> pa.Array:
        """A column of all nodes."""
        places, scalars, up, own = self.walk.places, self.walk.scalars, self.up, ARROW.get(COLUMNS.get(c, "int"))
        if c == "kids":
            return self._kids()
        if c == "names":
            return self._names()
        if c == "steps":
            return pa.array(self.walk.trails, own).take(pa.array(np.array(places["trail"])[self.at]))
        if c in ("name", "idx", "path", "pointer", "state"):
            return pa.array(places[c], own).take(pa.array(self.at))
        if c in ("kind", "text", "num"):
            return pa.array(scalars[c], own).take(pa.array(self.of))
        if c == "canon":
            return pa.array(self.canon, own)
        if c == "json":
            return pa.array(self._json(), own)
        values = {
            "pre": lambda: self.row - self.first, "last": lambda: self.last - self.first, "parent": lambda: np.where(up < 0, -1, up - self.first), "depth": lambda: self.depth, "sib": lambda: self.sib,
            "pn": lambda: np.where(up < 0, 0, self.n[up]), "n": lambda: self.n, "start": self._start, "length": self._length, "height": lambda: self._greatest(self.depth),
        }
        return pa.array(values[c]().astype(np.int32), own)


def _mended(text: str) -> str:
    """A text in which halves of surrogate pairs meet, and a half alone is U+FFFD."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def shred(docs: DataFrame, key: str, json: str, columns: Iterable[str] | None = None, roots: bool = False, beside: Iterable[str] = (), states: list | None = None) -> DataFrame:
    """(key, ``beside``, then ``COLUMNS``): the nodes of every valid text, in one pass and without a shuffle. Rows of one document are told apart by ``key`` only.

    Only the ``columns`` that are asked for are made, all by default; ``roots`` gives the roots alone, each with what is known of its whole text. ``beside`` are columns
    of ``docs`` that each node keeps. ``states``, as ``_Walk`` has them, add a column ``state``: where the steps from the root lead, from 0 on; nodes of no interest are left out.
    """
    names = [c for c in COLUMNS if columns is None or c in set(columns)] + (["state"] if states else [])
    carried = [key, *beside]
    kinds = {c: docs.schema[c].dataType.simpleString() for c in carried}

    def shredded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(set(names), states)
        for batch in batches:
            own: list[int] = []
            for k, text in enumerate(batch.column("_text").to_pylist()):
                if text is None:
                    continue
                try:
                    walk.add(text)
                except (ValueError, RecursionError):
                    continue
                own.append(k)
                if len(walk.up) > BATCH:
                    yield table(batch, own, walk)
                    own = []
            if own:
                yield table(batch, own, walk)
            else:
                walk.clear()

    def table(batch: pa.RecordBatch, own: list[int], walk: _Walk) -> pa.RecordBatch:
        nodes = _Nodes(walk)
        of, made = np.repeat(own, nodes.counts), [nodes.column(c) for c in names]
        if roots or states:
            rows = nodes.firsts if roots else np.flatnonzero(np.array(walk.places["state"])[nodes.at] >= 0)
            of, made = of[rows], [x.take(pa.array(rows)) for x in made]
        out = pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(of)) for c in carried), *made], names=[*carried, *names])
        walk.clear()
        return out

    # Nulls are passed over by the walk: a filter would have the texts made twice.
    texts = docs.select(*carried, F.col(json).alias("_text"))
    return texts.mapInArrow(shredded, ", ".join([*(f"`{c}` {t}" for c, t in kinds.items()), *(f"{c} {COLUMNS.get(c, 'int')}" for c in names)]))


def _without_halves(value: object) -> object:
    """A value whose texts and names have no half surrogate pairs. Depth is that of the parser's own recursion."""
    if not isinstance(value, (str, list, dict)):
        return value
    if isinstance(value, str):
        return _mended(value)
    return [_without_halves(x) for x in value] if isinstance(value, list) else {_mended(k): _without_halves(x) for k, x in value.items()}


def with_json(found: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """``found`` (key, start, length, ...) with the ``value`` of each node as minified text."""
    texts = nodes.filter("pre = 0").select(F.col(key).alias("_key"), F.col("json").alias("_json"))
    return found.join(texts, F.col(key).eqNullSafe(F.col("_key"))).withColumn("value", F.col("_json").substr(F.col("start"), F.col("length"))).drop("_key", "_json")


def literal_canon(value: object) -> str:
    """The ``canon`` of a value of the driver, as ``json.loads`` gives it."""
    walk = _Walk({"canon"})
    walk.add(json.dumps(value))
    return _Nodes(walk).canon[0]


def is_scalar(kind: Column) -> Column:
    return ~kind.isin("object", "array")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the folder that executors share (``spark.checkpoint.dir``) and read back, so that later joins don't walk the texts again."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-docspark-")
        spark.sparkContext.setCheckpointDir(root)
    at = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    back = spark.read.schema(df.schema).parquet(at)
    back._written_at = at
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` wrote and nothing reads any more."""
    for df in tables:
        at = df.__dict__.pop("_written_at", None)
        if at:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
