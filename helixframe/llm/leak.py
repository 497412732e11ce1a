"""Problem 7: evaluation passages inside documents.

Method: one Aho-Corasick automaton over the normalised test items. Normalising lower-cases a text and takes its words,
the maximal runs of letters and digits. Every run of n words of an item is a pattern. Each word of the items is coded by two
letters of its own, so that the automaton works on words, and a document is translated and scanned once; word offsets lead
back to the characters of the original text. Items beyond ITEM_CHARS are scanned for in blocks, with an automaton and a pass
over the documents for each."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import scratch, ship
from . import kernels as K

WORD = re.compile(r"[^\W_]+")
#: Characters of the items that are held in one automaton, about: some 100 MB in each Python worker.
ITEM_CHARS = 2_000_000
_BUILT: dict[str, Scanner] = {}  # the automaton of the block at hand, one per worker


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Scanner:
    def __init__(self, items: list[tuple[int, str]], n: int):
        import ahocorasick

        self.n = n
        self.code: dict[str, str] = {}
        runs: dict[str, set[int]] = {}
        for item, text in items:
            w = [self._letters(x) for x in words(text)]
            for i in range(len(w) - n + 1):
                runs.setdefault("".join(w[i : i + n]), set()).add(item)
        self.auto = ahocorasick.Automaton()
        for r, ids in runs.items():
            self.auto.add_word(r, tuple(sorted(ids)))
        if runs:
            self.auto.make_automaton()
        self.any = bool(runs)

    def _letters(self, w: str) -> str:
        """First letters and second letters are of different ranges, so that matches can only begin with a word."""
        c = self.code.get(w)
        if c is None:
            k = len(self.code)
            c = self.code[w] = chr(0x100 + (k >> 19)) + chr(0x10000 + (k & 0x7FFFF))
        return c

    def hits(self, found: list[str]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(number of the last word, items) of every run of n words of an item."""
        if not self.any or len(found) < self.n:
            return iter(())
        get = self.code.get
        return ((end >> 1, ids) for end, ids in self.auto.iter("".join([get(w, "\0\0") for w in found])))


def _scanner(name: str, items: list[tuple[int, str]], n: int) -> Scanner:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Scanner(items, n)
    return _BUILT[name]


def _origin(text: str, low: str) -> np.ndarray | None:
    """Where each character of the lower-cased text comes from; None if they correspond one to one."""
    if len(low) == len(text):
        return None
    return np.append(np.repeat(np.arange(len(text)), [len(c.lower()) for c in text]), len(text))


def _scanned(docs: DataFrame, items: DataFrame, n: int, cols: tuple[str, str, str, str], each: Callable[[Scanner, str], list[tuple]], fields: str) -> DataFrame:
    """(doc_id, item_id, fields) of all documents against all items: each(scanner, text) gives (item_id, ...) for one text."""
    spark = docs.sparkSession
    ship(spark)
    doc_id, doc_text, item_id, item_text = cols
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).filter("doc_id is not null and text is not null")
    i = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null and text is not null").distinct()
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, item_id {i.schema['item_id'].dataType.simpleString()}{fields}"
    names = [x.split()[0] for x in schema.split(", ")]
    chars, count = i.agg(F.sum(F.length("text")), F.count("*")).first()
    blocks = min(count, -(-(chars or 0) // max(1, ITEM_CHARS)))

    def scan(k: int) -> DataFrame:
        mine = i if blocks <= 1 else i.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        shared, name = spark.sparkContext.broadcast([(r.item_id, r.text) for r in mine.collect()]), uuid.uuid4().hex

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scanner = _scanner(name, shared.value, n)
            for b in it:
                out = [(doc, *x) for doc, t in zip(b["doc_id"], b["text"]) for x in each(scanner, t)]
                yield pd.DataFrame(dict(zip(names, map(K.obj, zip(*out) if out else [()] * len(names)))))

        return d.mapInPandas(run, schema).distinct()

    if blocks <= 1:
        return scan(0)
    out = scratch(spark)
    for k in range(blocks):
        scan(k).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def leaked_items(docs: DataFrame, items: DataFrame, n: int = 12, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Distinct (doc_id, item_id): the document contains n or more consecutive words of the item's text.

    Null ids and null texts are in no pair; empty texts and items of fewer than n words match nothing. Rows repeated under
    one id count once. Texts are scanned whole, by the same method however many items there are. No shuffle but that of the
    few results. Other columns aren't read."""

    def each(scan: Scanner, text: str) -> list[tuple]:
        return [(i,) for i in {i for _, ids in scan.hits(words(text)) for i in ids}]

    return _scanned(docs, items, n, (doc_id, doc_text, item_id, item_text), each, "")


def leaked_passages(docs: DataFrame, items: DataFrame, n: int = 12, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, char_start, char_end, n_words: the maximal stretches of matches that overlap or touch, in characters
    of the original text. Nulls, blocks and repeated rows as in leaked_items."""

    def each(scan: Scanner, text: str) -> list[tuple]:
        low = text.lower()
        at = [m.span() for m in WORD.finditer(low)]
        spans: dict[int, list[list[int]]] = {}
        for end, ids in scan.hits([low[x:y] for x, y in at]):
            for i in ids:
                s = spans.setdefault(i, [])
                if s and end - n + 1 <= s[-1][1] + 1:
                    s[-1][1] = end
                else:
                    s.append([end - n + 1, end])
        if not spans:
            return []
        back = _origin(text, low)
        place = (lambda c: c) if back is None else (lambda c: int(back[c]))
        return [(i, place(at[x][0]), place(at[y][1]), y - x + 1) for i, s in spans.items() for x, y in s]

    return _scanned(docs, items, n, (doc_id, doc_text, item_id, item_text), each, ", char_start int, char_end int, n_words int")
