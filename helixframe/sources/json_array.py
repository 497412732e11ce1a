"""JSON documents as rows: arrays, wrapped arrays, objects of objects, and an incremental reader for huge arrays.

`json_array` is a Python data source that reads one file's root array piece by piece in constant memory and yields its
elements as JSON text with their place, so that a file of any size can be turned into a splittable table once."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import open_text

WRAPPERS = ("operons", "data", "records", "items")  # fixed value: order of the wrapper keys
CHUNK = 1 << 20


_MARK = re.compile(r'["\\\\{}\[\]]')
_END = re.compile(r"[\s,\]]")


def elements(chunks: Iterator[str]) -> Iterator[str]:
    """The JSON texts of a root array's elements, from its text in pieces. Raises ValueError if the root is no array, an element
    is malformed, or the text ends before the array does; whatever follows the array is ignored.

    Each character is looked at once: what is held is the element at hand and a piece, however the pieces fall."""
    buf, at, state, ended = "", 0, "start", False
    pos, depth, quoted = 0, 0, False  # how far the element at `at` has been searched for its end
    while True:
        if pos <= at:
            while at < len(buf) and buf[at] in " \t\r\n\ufeff":
                at += 1
            pos = at
        if at < len(buf):
            c, end = buf[at], -1
            if state == "start":
                if c != "[":
                    raise ValueError("the root is no array")
                at, state = at + 1, "first"
                continue
            if state in ("first", "next") and c == "]":
                return
            if state == "next":
                if c != ",":
                    raise ValueError(f"expected a comma or the array's end, not {c!r}")
                at, state = at + 1, "element"
                continue
            if c in '{["':
                while end < 0 and (m := _MARK.search(buf, pos)):
                    pos = m.end()
                    if quoted and m[0] == "\\":
                        if pos == len(buf) and not ended:
                            pos -= 1
                            break  # what is escaped comes with the next piece
                        pos += 1
                    elif m[0] == '"':
                        quoted = not quoted
                        end = pos if not quoted and not depth else -1
                    elif not quoted and m[0] in "{[":
                        depth += 1
                    elif not quoted and m[0] in "}]":
                        depth -= 1
                        end = pos if not depth else -1
                else:
                    pos = pos if end >= 0 else len(buf)
            elif m := _END.search(buf, pos):
                end = m.start()
            else:
                pos = len(buf)
            if end >= 0:
                text = buf[at:end]
                try:
                    json.loads(text)
                except RecursionError:
                    pass  # its brackets are balanced
                yield text
                at = pos = end
                depth, quoted, state = 0, False, "next"
                continue
            if ended:
                raise ValueError("the text ends inside an element")
        elif ended:
            raise ValueError("the text ends inside the array" if state != "start" else "no JSON value")
        more = next(chunks, "")
        ended = not more
        buf, at, pos = buf[at:] + more, 0, max(0, pos - at)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], chunk: int):
        self.paths, self.chunk = paths, chunk

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        with open_text(partition.path) as f:
            for n, text in enumerate(elements(iter(lambda: f.read(self.chunk), ""))):
                yield (partition.path, n, text)


class JsonArraySource(DataSource):
    """spark.read.format("json_array").option("paths", json list of files or URIs every executor can open).load()"""

    @classmethod
    def name(cls):
        return "json_array"

    def schema(self):
        return "path string, ord bigint, value string"

    def reader(self, schema):
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return _Reader(paths, int(self.options.get("chunk", CHUNK)))


def read_array_incrementally(spark: SparkSession, paths: list[str], chunk: int = CHUNK) -> DataFrame:
    """path, ord, value (JSON text) of the elements; one task a file."""
    spark.dataSource.register(JsonArraySource)
    return spark.read.format("json_array").option("paths", json.dumps(paths)).option("chunk", chunk).load()


def read_array(spark: SparkSession, path: str, schema) -> DataFrame:
    """Moderate files whose root is an array (or one object) of the given schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def root_kind(text: str) -> str:
    """array or object, by the first character that isn't white space; ValueError for anything else."""
    head = text.lstrip(" \t\r\n﻿")[:1]
    if head not in ("[", "{"):
        raise ValueError(f"the root begins with {head!r}")
    return "array" if head == "[" else "object"


def sniff(spark: SparkSession, path: str) -> str:
    """root_kind of a file, from its first characters."""
    head = spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()
    return root_kind(head[0].value if head else "")


def root_kinds(payload: Column) -> Column:
    """root_kind by row: array, object, or null for anything else."""
    head = F.regexp_extract(payload, r"^[\s\x{feff}]*(.)", 1)
    return F.when(head == "[", "array").when(head == "{", "object")


def documents_to_operons(docs: DataFrame, key: str, payload: str, wrappers: tuple[str, ...] = WRAPPERS) -> DataFrame:
    """key, ord, value (variant) of the root objects of JSON texts, on the JVM: a root array's elements, those of the first
    wrapper key that holds an array, else the object values of a root object. Elements that are no objects are dropped but
    keep their place. Texts that can't be parsed have no rows."""
    v = docs.select(F.col(key), F.try_parse_json(payload).alias("v"), F.json_object_keys(payload).alias("names")).filter("v is not null")
    kind = lambda c: F.schema_of_variant(c)
    arr = F.when(kind("v").startswith("ARRAY"), F.col("v"))
    for w in wrappers:
        inner = F.try_variant_get("v", f"$.{w}", "variant")
        arr = F.coalesce(arr, F.when(kind("v").startswith("OBJECT") & kind(inner).startswith("ARRAY"), inner))
    v = v.withColumn("a", arr)
    lists = v.filter("a is not null").select(key, F.posexplode(F.expr("try_cast(a as array<variant>)")).alias("ord", "value"))
    named = v.filter("a is null").select(key, F.expr("try_cast(v as map<string, variant>)").alias("m"), F.posexplode("names").alias("ord", "name"))
    maps = named.select(key, "ord", F.element_at("m", F.col("name")).alias("value"))  # a variant doesn't keep the order of its keys
    return lists.unionByName(maps).filter(F.schema_of_variant("value").startswith("OBJECT"))
