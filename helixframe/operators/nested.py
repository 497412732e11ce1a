"""Deeply nested records to related flat tables (problem 2).

A `Level` names an array of objects inside its parent. From a list of levels one flat table per level comes out, each row
with its place (`node_path`, the positions from the outermost array joined with dots) and its parent's place.

Typed nesting is flattened with generators, on the JVM, reading only the nested fields asked for. JSON text is read token by
token, with a stack of the parser's own, into path-value-ordinal triples; triples are grouped by their nearest repeated
ancestor, which is any array of objects, and each group is pivoted into the row of that node. All triples of a node come
from one record, so the pivot needs no shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship


@dataclass(frozen=True)
class Level:
    name: str
    #: Keys of the parent that may hold the array: the first that is neither absent, null nor empty counts.
    keys: tuple[str, ...]
    #: Scalar fields of a node's table; dots lead into plain objects.
    fields: tuple[str, ...] = field(default=())


# Typed nesting


def first_filled(*arrays: Column) -> Column:
    """The first array that is neither null nor empty; null if none is."""
    out = F.lit(None)
    for a in reversed(arrays):
        out = F.when(F.size(a) > 0, a).otherwise(out)
    return out


def pruned(schema: T.StructType, columns: list[str], levels: list[Level]) -> T.StructType:
    """The part of a nested schema that the levels' fields need; a level without fields keeps one small leaf, so that null
    elements can still be told from objects."""

    def node(s: T.StructType, i: int) -> T.StructType:
        keep: list[T.StructField] = []
        for f in s.fields:
            if i + 1 < len(levels) and f.name in levels[i + 1].keys:
                keep.append(T.StructField(f.name, T.ArrayType(node(f.dataType.elementType, i + 1))))
            elif any(x.split(".")[0] == f.name for x in levels[i].fields):
                keep.append(f)
        if not keep:
            size = {"integer": 0, "long": 1, "double": 1, "string": 3}
            keep = [min(s.fields, key=lambda f: size.get(f.dataType.typeName(), 2 if isinstance(f.dataType, T.AtomicType) else 9))]
        return T.StructType(keep)

    return T.StructType([T.StructField(f.name, T.ArrayType(node(f.dataType.elementType, 0))) if f.name in levels[0].keys else f for f in schema.fields if f.name in columns or f.name in levels[0].keys])


def read_levels(spark: SparkSession, path: str, columns: list[str], levels: list[Level]) -> DataFrame:
    """The parquet table with only the leaves that flattening these levels needs."""
    return spark.read.schema(pruned(spark.read.parquet(path).schema, columns, levels)).parquet(path)


def flatten_levels(df: DataFrame, keys: list[str], levels: list[Level]) -> dict[str, DataFrame]:
    """One DataFrame per level: keys, node_path, parent_path (null at the outermost level), ordinal, and the level's fields.

    Null elements are no rows but keep their position; null and empty arrays have no rows; every input row counts, repeated
    ones too. Fields whose names clash with keys, or with each other, are named by their dotted path with underscores; the
    place columns are computed under reserved names, so that the input may have columns of any name."""
    out: dict[str, DataFrame] = {}
    # only named columns go on; they sit in structs, where they can't clash
    now = df.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("__k"), first_filled(*[F.col(f"`{k}`") for k in levels[0].keys]).alias("__a"), F.lit(None).cast("string").alias("__up"))
    for i, level in enumerate(levels):
        now = now.select("__k", "__up", F.posexplode("__a").alias("__i", "__n")).filter("__n is not null")
        now = now.withColumn("__path", F.concat_ws(".", "__up", F.col("__i").cast("string")))
        taken = {*keys, "node_path", "parent_path", "ordinal"}
        names = [(f, f.replace(".", "_") if f.replace(".", "_") not in taken else f"{level.name}_{f.replace('.', '_')}") for f in level.fields]
        out[level.name] = now.select(*[F.col("__k")[k].alias(k) for k in keys], F.col("__path").alias("node_path"), F.col("__up").alias("parent_path"), F.col("__i").alias("ordinal"), *[F.col(f"__n.{f}").alias(n) for f, n in names])
        if i + 1 < len(levels):
            now = now.select("__k", F.col("__path").alias("__up"), first_filled(*[F.col("__n")[k] for k in levels[i + 1].keys]).alias("__a"))
    return out


def node_paths(df: DataFrame, key: str, levels: list[Level]) -> DataFrame:
    """key, node_level, node_path of every node of every level, in one pass over the table."""
    row = lambda name, path: F.struct(F.lit(name).alias("node_level"), path.alias("node_path"))

    def under(array: Column, i: int, path: Column | None) -> Column:
        def one(x: Column, pos: Column) -> Column:
            at = pos.cast("string") if path is None else F.concat_ws(".", path, pos.cast("string"))
            mine = F.array(row(levels[i].name, at))
            if i + 1 < len(levels):
                mine = F.concat(mine, under(first_filled(*[x[k] for k in levels[i + 1].keys]), i + 1, at))
            return F.when(x.isNotNull(), mine).otherwise(F.array().cast("array<struct<node_level:string,node_path:string>>"))

        return F.coalesce(F.flatten(F.transform(array, one)), F.array().cast("array<struct<node_level:string,node_path:string>>"))

    nodes = under(first_filled(*[F.col(f"`{k}`") for k in levels[0].keys]), 0, None)
    return df.select(F.col(f"`{key}`").alias("__k"), F.explode(nodes).alias("__x")).select(F.col("__k").alias(key), "__x.node_level", "__x.node_path")


# JSON text

NODE = "row_id long, node_level string, node_path string, parent_path string, ordinal int, fields map<string,string>"
TRIPLE = "row_id long, node_level string, node_path string, field_path string, ordinal int, value string"
ROOTS = ("operons", "data", "records", "items")

_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")


class NotJson(ValueError):
    pass


class Node:
    """An object or an array on the parser's stack, and after: its members in order. A scalar is its source text, a string is
    a Python str wrapped in a 1-tuple."""

    __slots__ = ("keys", "start", "end", "values")

    def __init__(self, is_object: bool, start: int):
        self.keys: dict[str, int] | None = {} if is_object else None
        self.values: list = []
        self.start, self.end = start, start

    def get(self, key: str):
        i = self.keys.get(key) if self.keys is not None else None
        return None if i is None else self.values[i]


def stream_parse(text: str):
    """The root of one complete JSON text, read token by token with a stack of its own, so that no depth is too deep. Of a key
    given twice the last counts, in the place of the first. Raises NotJson."""
    at, n = _SPACE.match(text, 0).end(), len(text)
    stack: list[Node] = []
    root, key, state = None, None, "value"  # value, first (value or end), next (comma or end), key, keys (key or end)
    while True:
        c = text[at : at + 1]
        if state == "done":
            if at != n:
                raise NotJson("text after the value")
            return root
        if state in ("key", "keys"):
            if c == "}" and state == "keys":
                state = "close"
            else:
                if c != '"':
                    raise NotJson("a key was expected")
                try:
                    key, at = scanstring(text, at + 1, True)
                except ValueError as e:
                    raise NotJson(str(e)) from None
                at = _SPACE.match(text, at).end()
                if text[at : at + 1] != ":":
                    raise NotJson("a colon was expected")
                at, state = _SPACE.match(text, at + 1).end(), "value"
                continue
        elif state == "next":
            if c == ",":
                at = _SPACE.match(text, at + 1).end()
                state = "key" if stack[-1].keys is not None else "value"
                continue
            if c != ("}" if stack[-1].keys is not None else "]") or not c:
                raise NotJson("a comma or the end was expected")
            state = "close"
        elif state == "first" and c == "]":
            state = "close"
        if state == "close":
            done = stack.pop()
            done.end = at + 1
            at = _SPACE.match(text, at + 1).end()
            state = "next" if stack else "done"
            continue
        # a value
        if c == "{" or c == "[":
            value = Node(c == "{", at)
            at += 1
        elif c == '"':
            try:
                value, at = scanstring(text, at + 1, True)
            except ValueError as e:
                raise NotJson(str(e)) from None
            value = (value,)
        else:
            m = _SCALAR.match(text, at)
            if not m:
                raise NotJson("a value was expected")
            value, at = m[0], m.end()
        if stack:
            top = stack[-1]
            if top.keys is None:
                top.values.append(value)
            elif key in top.keys:
                top.values[top.keys[key]] = value
            else:
                top.keys[key] = len(top.values)
                top.values.append(value)
        else:
            root = value
        if isinstance(value, Node):
            stack.append(value)
            state = "keys" if value.keys is not None else "first"
        else:
            state = "next" if stack else "done"
        at = _SPACE.match(text, at).end()


def parse(text: str | None):
    """(True, root) of one complete JSON text, else (False, None)."""
    if text is None:
        return False, None
    try:
        return True, stream_parse(text)
    except NotJson:
        return False, None


def _is_array(v) -> bool:
    return isinstance(v, Node) and v.keys is None


def _is_object(v) -> bool:
    return isinstance(v, Node) and v.keys is not None


def _text(v, source: str) -> str | None:
    """A leaf as text: null is null, a string itself, other scalars and arrays as they are written."""
    if isinstance(v, tuple):
        return v[0]
    if not isinstance(v, Node):
        return None if v == "null" else v
    return source[v.start : v.end]


def roots(value, wrappers: tuple[str, ...] = ROOTS) -> tuple[str, list]:
    """(group, outermost values): a root array's elements; those of the first wrapper that holds an array; or the root object."""
    if _is_array(value):
        return "[]", value.values
    if not _is_object(value) or not value.values:
        return "", []
    return next(((f"{k}[]", value.get(k).values) for k in wrappers if _is_array(value.get(k))), ("", [value]))


def triples(root, source: str, levels: list[Level]) -> Iterator[tuple[int | None, str, tuple[int, ...], str, str | None]]:
    """(level, group, node path, field path, value) of the leaves of a payload, each under its nearest repeated ancestor.

    Every array of objects repeats: its objects are nodes of the group that its path names, at the positions that lead to
    them. Groups that a level declares have the level's number; other groups have none, and their path tells them. Of a
    level's keys only the first filled one repeats; what is no object has no node. A node always yields a triple with an
    empty field path, so that nodes without leaves exist too."""
    group, found = roots(root)
    todo = [(0, group, (pos,), x) for pos, x in reversed(list(enumerate(found))) if _is_object(x)]
    while todo:
        i, group, path, node = todo.pop()
        yield i, group, path, "", None
        below = levels[i + 1].keys if i is not None and i + 1 < len(levels) else ()
        chosen = None
        if below:
            filled = lambda v: not (v is None or v == "null" or v == ("",) or isinstance(v, Node) and not v.values)
            chosen = next((k for k in below[:-1] if filled(node.get(k))), below[-1])
        stack, children = [("", node)], []
        while stack:
            prefix, obj = stack.pop()
            for k, at in obj.keys.items():
                v = obj.values[at]
                if not prefix and k in below:
                    if k == chosen and _is_array(v):
                        children += [(i + 1, f"{group}.{k}[]", (*path, pos), x) for pos, x in enumerate(v.values) if _is_object(x)]
                elif _is_object(v):
                    stack.append((f"{prefix}{k}.", v))
                elif _is_array(v) and any(map(_is_object, v.values)):
                    children += [(None, f"{group}.{prefix}{k}[]", (*path, pos), x) for pos, x in enumerate(v.values) if _is_object(x)]
                else:
                    yield i, group, path, prefix + k, _text(v, source)
        todo += reversed(children)


def _each(payload: str | None, levels: list[Level]):
    ok, root = parse(payload)
    if ok:
        yield from triples(root, payload, levels)


def rejects(df: DataFrame, key: str, payload: str) -> DataFrame:
    """key of the rows whose payload is null or not one complete JSON text, and so has no rows in any table; with the reason."""
    ship(df.sparkSession)

    def why(text: str | None) -> str | None:
        if text is None:
            return "null"
        try:
            stream_parse(text)
        except NotJson:
            return "not one complete JSON text"
        return None

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = [(k, r) for k, t in zip(b["k"], b["t"]) if (r := why(t))]
            yield pd.DataFrame(out, columns=["row_id", "reason"], dtype=object)

    return df.select(F.col(key).cast("long").alias("k"), F.col(payload).alias("t")).mapInPandas(run, "row_id long, reason string")


def json_triples(df: DataFrame, key: str, payload: str, levels: list[Level]) -> DataFrame:
    """See TRIPLE: the leaves of all payloads, with the ordinal of each triple in its record. A declared group goes by its
    level's name."""
    ship(df.sparkSession)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = [(k, g if i is None else levels[i].name, ".".join(map(str, p)), f, n, v) for k, t in zip(b["k"], b["t"]) for n, (i, g, p, f, v) in enumerate(_each(t, levels)) if f]
            yield pd.DataFrame(out, columns=["row_id", "node_level", "node_path", "field_path", "ordinal", "value"], dtype=object)

    return df.select(F.col(key).cast("long").alias("k"), F.col(payload).alias("t")).mapInPandas(run, TRIPLE)


def json_nodes(df: DataFrame, key: str, payload: str, levels: list[Level], with_fields: bool = True, undeclared: bool = False) -> DataFrame:
    """One row per object of every level (see NODE); fields maps all its field paths to texts, null where the value is null.

    A payload that is null or not one complete JSON text yields nothing (see rejects); elements that are no objects yield
    nothing but keep their position. A chosen value that is no array has no children. Every row counts, repeated content and
    keys too. Of a key given twice in one object the last counts. With undeclared, objects of arrays that no level declares
    are nodes too, whose level is their path."""
    ship(df.sparkSession)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out: list[tuple] = []
            for k, t in zip(b["k"], b["t"]):
                nodes: dict[tuple[str, tuple[int, ...]], dict] = {}
                for i, g, p, f, v in _each(t, levels):
                    if i is None and not undeclared:
                        continue
                    at = (g if i is None else levels[i].name, p)
                    if not f:
                        nodes[at] = {}
                    elif with_fields:
                        nodes[at][f] = v
                for (name, p), fields in nodes.items():
                    up = ".".join(map(str, p[:-1])) if len(p) > 1 else None
                    out.append((k, name, ".".join(map(str, p)), up, p[-1], fields))
            yield pd.DataFrame(out, columns=["row_id", "node_level", "node_path", "parent_path", "ordinal", "fields"], dtype=object)

    return df.select(F.col(key).cast("long").alias("k"), F.col(payload).alias("t")).mapInPandas(run, NODE)


def json_level(nodes: DataFrame, level: Level, types: dict[str, str] | None = None, rest: str | None = None) -> DataFrame:
    """One level's table from json_nodes: its fields as columns, cast where a type is given (texts that don't fit give null).
    rest names a map column for the fields that the level doesn't list."""
    types = types or {}
    one = lambda f: F.col("fields")[f].try_cast(types[f]) if f in types else F.col("fields")[f]
    other = [F.map_filter("fields", lambda k, _: ~k.isin(*level.fields)).alias(rest)] if rest else []
    return nodes.filter(F.col("node_level") == level.name).select("row_id", "node_path", "parent_path", "ordinal", *[one(f).alias(f.replace(".", "_")) for f in level.fields], *other)
