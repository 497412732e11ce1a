"""Problem 1: long exact spans shared between records.

Method: Rabin-Karp hashes of every fixed-length window, counted in Spark; repeated windows merge into maximal intervals.
Counting all n-windows would shuffle some forty bytes per character. Two levels count the same windows with less:

1. The windows of k characters are hashed (k < n) and every n-window keeps the least of its hashes as its anchor. Equal
   n-windows have equal anchors, so a window can only recur where its anchor recurs. Anchors, about 2 / (n - k + 2) of
   the positions, are counted by min and max of the record: an aggregation, with map-side combine, never a list.
2. Around recurring anchors the n-windows themselves are hashed and counted in the same way, within groups keyed by the
   anchor and n/2 characters more; equal surroundings are combined before the shuffle. Windows decide, not anchors.

At the ends of a passage held by very many records each record has surroundings of its own, so that a group would grow with
the records. Anchors with more than HOT occurrences therefore form no groups: the n-windows around them are counted one by
one, as rows of an aggregation by min and max of the record. No pairs of records are formed at any time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Stored, ship
from . import kernels as K

OUT = "rec_id string, span_start int, span_len int"
#: A group of level 2 has at most this many surroundings; some 50 MB in a worker.
HOT = 20_000


def _anchor_rows(n: int, k: int, most: int = 2_000_000):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            texts, row, begin = K.pieces(b["text"].tolist(), most, n - 1)
            rec = b["rec"].to_numpy()[row]
            for lo, hi in K.chunks(texts, most):
                codes, off = K.concat(texts[lo:hi])
                at, h = K.anchors(codes, off, n, k)
                p = np.searchsorted(off, at, side="right") - 1
                yield pd.DataFrame({"h": h.view(np.int64), "rec": rec[lo + p], "pos": (at - off[p] + begin[lo + p]).astype(np.int32)})

    return run


def _contexts(n: int, k: int, combined: bool):
    """Per recurring anchor at p: the n-windows that hold it, as two stretches, each with its group key.

    Windows that start at or before p - half share the half characters before the anchor, the others those after it.
    combined: (key, ctx, lo, hi), equal stretches of a batch in one row with the least and the greatest record; else
    (id, at, key, ch), where the stretch lies in its record and the hash of its text."""
    half = (n - k + 1) // 2

    def stretches(text: str, places) -> Iterator[tuple[int, str, str]]:
        last = len(text) - n
        for p in {int(x) for x in places}:
            if p + k > len(text):
                continue  # a place of another record with the same short hash
            lo, hi = max(0, p + k - n), min(p - half, last)
            if lo <= hi:
                yield lo, "<" + text[p - half : p + k], text[lo : hi + n]
            lo, hi = max(0, p + k - n, p - half + 1), min(p, last)
            if lo <= hi:
                yield lo, ">" + text[p : p + k + half], text[lo : hi + n]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            b = b.drop_duplicates(["id", "text"])
            seen: dict[tuple[str, str], list[int]] = {}
            ids, at, keys, ctx = [], [], [], []
            for rid, rec, text, places in zip(b["id"], b["rec"], b["text"], b["places"]):
                for lo, key, c in stretches(text, places):
                    if combined:
                        both = seen.setdefault((key, c), [rec, rec])
                        both[0], both[1] = min(both[0], rec), max(both[1], rec)
                    else:
                        ids.append(rid)
                        at.append(lo)
                        keys.append(key)
                        ctx.append(c)
            if combined:
                keys, ctx = [x for x, _ in seen], [x for _, x in seen]
                both = np.array(list(seen.values()), dtype=np.int64).reshape(-1, 2)
                yield pd.DataFrame({"key": _hash(keys), "ctx": K.obj(ctx), "lo": both[:, 0], "hi": both[:, 1]})
            else:
                yield pd.DataFrame({"id": K.obj(ids), "at": np.array(at, dtype=np.int32), "key": _hash(keys), "ch": _hash(ctx)})

    return run


def _hash(texts: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(texts, dtype=object), categorize=False).view(np.int64)


def _shared_starts(n: int):
    """Over stretches sorted by key: which windows of n occur in more than one record. Keys may run over several batches."""

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        p = p.groupby(["key", "ctx"], sort=False, as_index=False).agg({"lo": "min", "hi": "max"})
        texts = p["ctx"].tolist()
        codes, off = K.concat(texts)
        h = K.rolling(codes, n)
        ok = np.flatnonzero(K.inside(off, n))
        row = np.searchsorted(off, ok, side="right") - 1
        h = K.mix(h[ok] ^ p["key"].to_numpy().view(np.uint64)[row])
        order = np.argsort(h, kind="stable")
        hs, lo, hi = h[order], p["lo"].to_numpy()[row][order], p["hi"].to_numpy()[row][order]
        first = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
        many = np.minimum.reduceat(lo, first) != np.maximum.reduceat(hi, first)
        good = np.empty(len(hs), dtype=bool)
        good[order] = np.repeat(many, np.diff(np.concatenate([first, [len(hs)]])))
        row, start = row[good], (ok - off[row])[good]
        rows, at = np.unique(row, return_index=True)
        starts = [x.astype(np.int32) for x in np.split(start, at[1:])] if len(rows) else []
        return pd.DataFrame({"key": p["key"].to_numpy()[rows], "ch": _hash([texts[i] for i in rows]), "starts": K.obj(starts)})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in it:
            if not len(b):
                continue
            last = b["key"].iloc[-1]
            cut = int(np.argmax(b["key"].to_numpy() == last))
            if cut:
                yield solve(pd.concat([*held, b.iloc[:cut]], ignore_index=True))
                held = [b.iloc[cut:]]
            elif held and held[0]["key"].iloc[0] != last:
                yield solve(pd.concat(held, ignore_index=True))
                held = [b]
            else:
                held.append(b)
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return run


def _windows(n: int, k: int, combined: bool, most: int = 2_000_000):
    """The n-windows that hold a hot anchor: (w, lo, hi), equal ones of a batch combined, or (id, s, w) with their starts."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for r_lo, r_hi in K.chunks(b["text"].tolist(), most):
                part = b.iloc[r_lo:r_hi]
                codes, off = K.concat(part["text"].tolist())
                h = K.rolling(codes, n)
                starts = []
                for x, y, places in zip(off, off[1:], part["hot"]):
                    near = np.unique((np.asarray(places, dtype=np.int64)[:, None] + np.arange(k - n, 1)[None, :]).ravel())
                    starts.append(near[(near >= 0) & (near <= y - x - n)])
                row = np.repeat(np.arange(len(part)), [len(x) for x in starts])
                at = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
                w = h[off[row] + at] if len(at) else h[:0]
                if combined:
                    rec = part["rec"].to_numpy()[row]
                    got = pd.DataFrame({"w": w.view(np.int64), "lo": rec, "hi": rec})
                    yield got.groupby("w", as_index=False).agg({"lo": "min", "hi": "max"})[["w", "lo", "hi"]]
                else:
                    yield pd.DataFrame({"id": K.obj(part["id"].to_numpy()[row].tolist()), "s": at.astype(np.int32), "w": w.view(np.int64)})

    return run


def _merge(n: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rid, at, size = [], [], []
            for i, starts in zip(b["id"], b["starts"]):
                s = np.unique(np.asarray(starts, dtype=np.int64))
                gap = np.flatnonzero(np.diff(s) > n)
                first, last = s[np.concatenate([[0], gap + 1])], s[np.concatenate([gap, [len(s) - 1]])]
                rid += [i] * len(first)
                at += first.tolist()
                size += (last + n - first).tolist()
            yield pd.DataFrame({"rec_id": K.obj(rid), "span_start": np.array(at, dtype=np.int32), "span_len": np.array(size, dtype=np.int32)})

    return run


def shared_spans(records: DataFrame, id_col: str = "id", text_col: str = "text", min_len: int = 50, k: int = 12) -> DataFrame:
    """Maximal runs of positions that lie in a window of min_len characters also held by a record with another id.

    records: any columns; only id_col and text_col are read. Result: rec_id, span_start (from 0), span_len; the sum of
    span_len per record is its shared amount. Rows with a null id or text, and texts shorter than min_len, share nothing.
    Rows repeated under one id are one record; if its texts differ, its runs are those of all its texts together. An empty
    table gives an empty result. Characters are code points, compared as they are."""
    spark = records.sparkSession
    ship(spark)
    n, k = min_len, max(1, min(k, min_len // 2))
    base = records.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & (F.length("text") >= n))
    rec = F.xxhash64("id")
    occ = base.select(rec.alias("rec"), "text").mapInPandas(_anchor_rows(n, k), "h long, rec long, pos int")
    again = Stored(occ.groupBy("h").agg(F.min("rec").alias("a"), F.max("rec").alias("b"), F.count("*").alias("n")).filter("a <> b").select("h", (F.col("n") > HOT).alias("hot"))).df
    places = occ.join(again, "h").groupBy("rec").agg(F.collect_set(F.expr("if(not hot, pos, null)")).alias("places"), F.collect_set(F.expr("if(hot, pos, null)")).alias("hot"))
    around = base.withColumn("rec", rec).join(places, "rec").select("id", "rec", "text", "places", "hot")
    cold = around.filter(F.size("places") > 0)
    distinct = cold.mapInPandas(_contexts(n, k, True), "key long, ctx string, lo long, hi long")
    found = distinct.repartition("key").sortWithinPartitions("key").mapInPandas(_shared_starts(n), "key long, ch long, starts array<int>")
    mine = cold.mapInPandas(_contexts(n, k, False), "id string, at int, key long, ch long")
    starts = mine.join(found, ["key", "ch"]).select("id", F.explode(F.transform("starts", lambda x: x + F.col("at"))).alias("s"))
    if not again.filter("hot").isEmpty():
        hot = around.filter(F.size("hot") > 0)
        shared = hot.mapInPandas(_windows(n, k, True), "w long, lo long, hi long").groupBy("w").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("w")
        starts = starts.unionByName(hot.mapInPandas(_windows(n, k, False), "id string, s int, w long").join(shared, "w", "left_semi").select("id", "s"))
    return starts.groupBy("id").agg(F.collect_set("s").alias("starts")).mapInPandas(_merge(n), OUT)
