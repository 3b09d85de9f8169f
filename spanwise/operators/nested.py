"""Deeply nested records as related flat tables.

A record is read as a stream, token by token, in the task that has it. Every scalar becomes a triple
(path, value, ordinal) and is gathered under its repeated ancestor, the array element it lies in,
whose row is given out when the element ends: its scalar members in a map, its ordinal, its path and
that of its parent. A group's table is a projection of that map (the pivot), and no step shuffles.

No tree is built and nothing recurses, so neither depth nor size of a record is limited.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = r"[ \t\n\r]*"
_STRING = r'"((?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*)"'
_VALUE = rf"(?:{_STRING}|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null)|([{{\[]))"
# a value with what follows it; an opened object or array has its own members to come first
_ITEM = re.compile(rf"{_SPACE}{_VALUE}{_SPACE}([,\]}}]?)").match
_MEMBER = re.compile(rf"{_SPACE}{_STRING}{_SPACE}:{_SPACE}{_VALUE}{_SPACE}([,\]}}]?)").match
# an element that is an object of scalars without escapes, as most are: read whole, its members in one go
_FLAT_STRING = r'"[^"\\\x00-\x1f]*"'
_SCALAR = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null"
_PAIR = rf"{_SPACE}{_FLAT_STRING}{_SPACE}:{_SPACE}(?:{_FLAT_STRING}|{_SCALAR}){_SPACE}"
_FLAT = re.compile(rf"{_SPACE}\{{({_PAIR}(?:,{_PAIR})*|{_SPACE})\}}{_SPACE}([,\]}}]?)").match
_PAIRS = re.compile(rf'"([^"]*)"{_SPACE}:{_SPACE}(?:"([^"]*)"|([^\s,]+))').findall
_CLOSE = re.compile(rf"{_SPACE}([\]}}])").match
_AFTER = re.compile(rf"{_SPACE}([,\]}}]?)").match
_END = re.compile(rf"{_SPACE}\Z").match
_LONE = re.compile("[\ud800-\udfff]")


class NotJson(ValueError):
    """The text is not JSON."""


def _plain(text: str) -> str:
    """A string's content; half surrogate pairs, which no table can hold, become U+FFFD."""
    return _LONE.sub("�", json.loads(f'"{text}"')) if "\\" in text else text


class _Element:
    """An array element, or the record itself, with the scalars found in it so far."""

    __slots__ = ("above", "members", "ordinal")

    def __init__(self, above: _Array | None, ordinal: int, members: dict | None) -> None:
        self.above, self.ordinal, self.members = above, ordinal, members


class _Object:
    """An open object: the element it belongs to, and its name within the object around it (None if
    it is the element itself)."""

    __slots__ = ("around", "element", "name", "names", "places")

    def __init__(self, element: _Element, around: _Object | None, name: str | None) -> None:
        self.element, self.around, self.name = element, around, name
        self.names: dict[str, int] = {}  # where in the output each name's rows begin
        self.places: dict[str, str] = {}

    def prefix(self) -> str:
        """What its members' names begin with, within the element."""
        known = self.places.get("prefix")
        if known is None:
            within, at = [], self
            while at.name is not None:
                within.append(at.name + ".")
                at = at.around
            known = self.places["prefix"] = "".join(reversed(within))
        return known


class _Array:
    """An open array: its name and the object that holds it, or else the array element that it is."""

    __slots__ = ("count", "element", "name", "object", "places", "shown")

    def __init__(self, name: str, holder: _Object | None, element: _Element | None) -> None:
        self.name, self.object, self.element, self.count = name, holder, element, 0
        self.places: dict[str, str] = {}
        self.shown: tuple[str, str, str] | None = None  # group, path and parent of its elements, once asked for

    def holder(self) -> _Object | None:
        """The object that holds it; of an array within an array, that of the outer one."""
        at = self
        while at is not None and at.object is None:
            at = at.element.above
        return at and at.object


def _place(of: _Object | _Array | None, ordinals: bool) -> str:
    """Where an object or array is, names led by dots, ordinals in brackets (or left out); "" at the
    root. It is put together on demand and kept for the next time only where it was asked for."""
    kind, parts, at = "path" if ordinals else "group", [], of
    while at is not None:
        known = at.places.get(kind)
        if known is not None:
            parts.append(known)
            break
        if type(at) is _Array and at.object is not None:
            parts.append("." + at.name)
            at = at.object
        elif type(at) is _Object and at.name is not None:
            parts.append("." + at.name)
            at = at.around
        else:
            element = at.element
            if element.above is not None:
                parts.append(f"[{element.ordinal}]" if ordinals else "[]")
            at = element.above
    if of is None:
        return ""
    of.places[kind] = text = "".join(reversed(parts))
    return text


def _shown(place: str) -> str:
    return place.removeprefix(".") or "$"


Row = tuple[str, str, str, str, int, str, list[tuple[str, "str | None"]]]


def _forget(top: _Object, name: str, out: list[Row | None]) -> None:
    """Takes back what an earlier member of that name has given: of repeated names the last one holds."""
    starts = list(top.names.items())
    at = next(i for i, (n, _) in enumerate(starts) if n == name)
    end = starts[at + 1][1] if at + 1 < len(starts) else len(out)
    out[starts[at][1] : end] = [None] * (end - starts[at][1])
    del top.names[name]
    members = top.element.members
    if members:
        rel = name if top.name is None else top.prefix() + name
        for k in [k for k in members if k == rel or k.startswith(rel + ".")]:
            del members[k]


def stream(body: str, wanted: Callable[[str | None, str], bool] = lambda array, kind: True) -> list[Row | None]:
    """(group, array, path, parent path, ordinal, kind, members) of each array element, and lastly of
    the record, with path ``$``, in the order in which they end; None for what a repeated name undid.

    ``kind`` is object, array or scalar. Only what ``wanted`` asks for, by the name of the array
    (None for the record) and the kind, is given. Raises NotJson if the text is not JSON.
    """
    out: list[Row | None] = []

    def start(above: _Array | None, opened: str | None) -> _Element:
        kind = "object" if opened == "{" else "array" if opened == "[" else "scalar"
        return _Element(above, above.count if above else 0, {} if wanted(above and above.name, kind) else None)

    def give(above: _Array, ordinal: int, kind: str, members: dict) -> None:
        if above.shown is None:
            above.shown = _shown(_place(above, False) + "[]"), _place(above, True).removeprefix("."), _shown(_place(above.holder(), True))
        group, path, parent = above.shown
        out.append((group, above.name, f"{path}[{ordinal}]", parent, ordinal, kind, list(members.items())))

    def end(e: _Element, kind: str) -> None:
        if e.members is not None:
            if e.above is None:
                out.append(("$", "", "$", "", 0, kind, list(e.members.items())))
            else:
                give(e.above, e.ordinal, kind, e.members)

    def scalar(text: str | None, other: str) -> str | None:
        return _plain(text) if text is not None else None if other == "null" else other

    m = _ITEM(body, 0)
    if m is None:
        raise NotJson
    opened, pos, stack = m[3], m.end(3) if m[3] else m.end(), []
    root = start(None, opened)
    if opened:
        stack.append(_Object(root, None, None) if opened == "{" else _Array("", None, root))
    elif m[4] or pos != len(body):
        raise NotJson
    elif root.members is not None:
        root.members["$value"] = scalar(m[1], m[2])
        end(root, "scalar")
    fresh = True  # nothing has been read in the innermost object or array
    while stack:
        top = stack[-1]
        if type(top) is _Object:
            m = _MEMBER(body, pos)
            if m is not None:
                name, text, other, opened, after = m.groups()
                if "\\" in name:
                    name = _plain(name)
                if name in top.names:
                    _forget(top, name, out)
                top.names[name] = len(out)
                if opened:
                    stack.append(_Object(top.element, top, name) if opened == "{" else _Array(name, top, None))
                    fresh, pos = True, m.end(4)
                    continue
                if top.element.members is not None:
                    top.element.members[name if top.name is None else top.prefix() + name] = scalar(text, other)
                pos = m.end()
        elif (m := _FLAT(body, pos)) is not None:
            if wanted(top.name, "object"):
                give(top, top.count, "object", {k: t if not x else None if x == "null" else x for k, t, x in _PAIRS(m[1])})
            top.count += 1
            after, pos = m[2], m.end()
        else:
            m = _ITEM(body, pos)
            if m is not None:
                text, other, opened, after = m.groups()
                element = start(top, opened)
                top.count += 1
                if opened:
                    stack.append(_Object(element, None, None) if opened == "{" else _Array("", None, element))
                    fresh, pos = True, m.end(3)
                    continue
                if element.members is not None:
                    element.members["$value"] = scalar(text, other)
                    end(element, "scalar")
                pos = m.end()
        if m is None:
            m = _CLOSE(body, pos)
            if m is None or not fresh:
                raise NotJson
            after, pos = m[1], m.end()
        fresh = False
        # what has ended was a value of the innermost object or array: more of it follows, or its end
        while after != ",":
            top = stack.pop()
            if after != ("}" if type(top) is _Object else "]"):
                raise NotJson
            if type(top) is _Object:
                if top.name is None:
                    end(top.element, "object")
            elif top.object is None:
                end(top.element, "array")
            if not stack:
                break
            m = _AFTER(body, pos)
            after, pos = m[1], m.end()
    if pos != len(body) and not _END(body, pos):
        raise NotJson
    return out


def elements(body: str | None, wanted: Callable[[str | None, str], bool] = lambda array, kind: True) -> list[Row] | None:
    """What :func:`stream` gives; None for a body that is null or not JSON."""
    if body is None:
        return None
    try:
        return [r for r in stream(body, wanted) if r is not None]
    except NotJson:
        return None


def nested_nodes(df: DataFrame, id_col: str, body_col: str, arrays: Iterable[str] | None = None, record: bool = False) -> DataFrame:
    """One row per array element of every JSON text in ``body_col``.

    Columns: the id, ``node_group`` (the path with ordinals left out), ``array_name``,
    ``child_path``, ``parent_path``, ``ordinal``, ``kind`` (object, array or scalar), ``members``
    (map of relative path to text: strings as they are, other scalars as written, null as null;
    objects inside the element flattened with dots). ``arrays`` keeps only object elements of arrays
    of these names and, with ``record``, the record's own row (path ``$``, kind of the root), which
    is always there without ``arrays``.

    A body that is null, empty or not JSON gives no row (see :func:`unparsed`). Repeated names of one
    object: the last holds. Repeated input rows give repeated output rows. Ordinals count all
    elements, objects or not. An array directly in an array has no name; its elements have the parent
    of the outer one. Extra columns of ``df`` are not carried, so their names cannot clash.
    """
    names = frozenset(arrays) if arrays is not None else None
    schema = T.StructType(
        [
            df.schema[id_col],
            *(T.StructField(c, T.StringType()) for c in ("node_group", "array_name", "child_path", "parent_path")),
            T.StructField("ordinal", T.IntegerType()),
            T.StructField("kind", T.StringType()),
            T.StructField("members", T.MapType(T.StringType(), T.StringType())),
        ]
    )

    def wanted(array: str | None, kind: str) -> bool:
        return names is None or (record if array is None else kind == "object" and array in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 4 + [pa.int32(), pa.string(), pa.map_(pa.string(), pa.string())]
        for batch in batches:
            ids, rows, found = batch.column(0), [], []

            def flush() -> pa.RecordBatch:
                cols = [ids.take(pa.array(rows, pa.int32())), *map(pa.array, zip(*found, strict=True), types)]
                rows.clear()
                found.clear()
                return pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

            for row, body in enumerate(batch.column(1).to_pylist()):
                own = elements(body, wanted)
                if own:
                    found += own
                    rows += [row] * len(own)
                    if len(rows) >= 20_000:
                        yield flush()
            if rows:
                yield flush()

    return df.select(F.col(id_col), F.col(body_col).cast("string")).mapInArrow(run, schema)


def flat_table(nodes: DataFrame, id_col: str, array: str, columns: dict[str, str]) -> DataFrame:
    """The table of one repeated group: a row per object element, ``columns`` maps member to SQL type.

    A member that is absent or cannot be cast is null. Each row names its parent by ``parent_path``.
    """
    typed: list[Column] = [F.expr(f"try_cast(members[{json.dumps(m)}] AS {t})").alias(m.replace(".", "_")) for m, t in columns.items()]
    own = nodes.filter((F.col("array_name") == array) & (F.col("kind") == "object"))
    return own.select(id_col, "child_path", "parent_path", "ordinal", *typed)


def record_table(nodes: DataFrame, id_col: str, columns: dict[str, str]) -> DataFrame:
    """The table of the records themselves (path ``$``), one row per body that parses."""
    typed = [F.expr(f"try_cast(members[{json.dumps(m)}] AS {t})").alias(m.replace(".", "_")) for m, t in columns.items()]
    return nodes.filter(F.col("child_path") == "$").select(id_col, *typed)


def unparsed(df: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """Ids of the bodies that give no rows because they are null or not JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([elements(b, lambda *_: False) is None for b in batch.column(1).to_pylist()], pa.bool_())
            yield batch.select([0]).filter(keep)

    return df.select(F.col(id_col), F.col(body_col).cast("string")).mapInArrow(run, T.StructType([df.schema[id_col]]))
