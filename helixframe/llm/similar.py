"""Set-similarity joins over distinct q-letter substrings (Jaccard), shared by problems 3 and 4.

Both work on classes of equal texts, find pairs of classes through inverted lists and verify every pair on its texts.

Problem 3 is a size-aware join. Small sets enumerate fixed-size subsets, which finds all their pairs: two sets that share at
least t of the larger's n elements share two among the first n - ceil(t n) + 2 elements of each, in any common order. How far
that goes is decided by its cost in rows. Large sets can't enumerate all subsets; they give a fixed number of subsets of r
elements, those least under r random orders, which two sets of similarity s share with probability s^r each. Their inverted
lists are scanned: light ones give their pairs; the members of heavy ones are joined by larger subsets.

Problem 4 gives each text a bit code whose segments are joined across splits within a Hamming radius."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Stored, ship
from . import kernels as K

#: Groups of exact copies, and pairs of such groups, are written out as all pairs up to this many; beyond it as pairs with
#: the group's least id, which keeps every link between different texts and every membership.
ALL_PAIRS = 1_000_000


#: Characters of the texts whose sets a task keeps while it verifies; some 130 MB.
HELD = 1_000_000


def _sets(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed q-letter substrings of each text, in a row, and their offsets; texts shorter than q have one."""
    codes, off = K.concat([t if len(t) >= q else t + "\0" * (q - len(t)) for t in texts])
    return K.rolling(codes, q)[K.inside(off, q)], off - np.arange(len(off)) * (q - 1)


def subset_rows(q: int, r: int, b: int, salt: int, t: float = 0.0, small: int = 0):
    """mapInPandas function: (c, t) to rows (band, c): b subsets of r elements of every set of more than `small` elements,
    and of sets of up to small / t elements all pairs of the first ones (see the module's text)."""
    chosen = K.seeds(r * b, salt)

    def pairs(e: np.ndarray) -> np.ndarray:
        p = min(len(e), len(e) - math.ceil(t * len(e) - 1e-9) + 2)
        i, j = np.triu_indices(p, 1) if p > 1 else (np.zeros(1, dtype=int), np.zeros(1, dtype=int))
        return K.hash_rows(np.stack([e[i], e[j]], axis=1), salt * 1000 + 999)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            for lo, hi in K.chunks(batch["t"].tolist(), 350_000):
                part = batch.iloc[lo:hi]
                elements, off = _sets(part["t"].tolist(), q)
                c = part["c"].to_numpy()
                if small:
                    distinct = [np.unique(elements[x:y]) for x, y in zip(off, off[1:])]
                    size = np.array([len(x) for x in distinct])
                    few = [(k, pairs(distinct[k])) for k in np.flatnonzero(size * t <= small)]
                    if few:
                        yield pd.DataFrame({"band": np.concatenate([x for _, x in few]).view(np.int64), "c": np.repeat(c[[k for k, _ in few]], [len(x) for _, x in few])})
                    large = np.flatnonzero(size > small)
                    if not len(large):
                        continue
                    c, elements = c[large], np.concatenate([distinct[k] for k in large])
                    off = np.concatenate([[0], np.cumsum(size[large])])
                m = K.minima(elements, off, chosen)
                bands = np.stack([K.hash_rows(m[:, j * r : j * r + r], salt * 1000 + j) for j in range(b)], axis=1)
                yield pd.DataFrame({"band": bands.reshape(-1).view(np.int64), "c": np.repeat(c, b)})

    return run


def code_rows(q: int, r: int, b: int, salt: int):
    """mapInPandas function: (c, t) to b rows (band, c, f1, f2). A text's code has 16 bits for each of r * b min-wise values,
    so that the bits of one value agree with the similarity's probability. Its b segments of 16 r bits are the blocks (with
    their number; longer ones than a number holds are hashed); f1 and f2 hold one bit of each of the first 120 values."""
    chosen = K.seeds(r * b, salt)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            for lo, hi in K.chunks(batch["t"].tolist(), 350_000):
                part = batch.iloc[lo:hi]
                code = K.mix(K.minima(*_sets(part["t"].tolist(), q), chosen)) >> np.uint64(48)
                if r == 3:
                    s = code.reshape(len(code), b, 3)
                    bands = np.arange(b, dtype=np.uint64) << np.uint64(48) | s[:, :, 0] << np.uint64(32) | s[:, :, 1] << np.uint64(16) | s[:, :, 2]
                else:
                    bands = np.stack([K.hash_rows(code[:, j * r : j * r + r], salt * 1000 + j) for j in range(b)], axis=1)
                bits = (code[:, :120] & np.uint64(1)).astype(np.uint8)
                words = np.packbits(np.pad(bits, ((0, 0), (0, 128 - bits.shape[1]))), axis=1).view(np.int64)
                yield pd.DataFrame({"band": bands.reshape(-1).view(np.int64), "c": np.repeat(part["c"].to_numpy(), b), "f1": np.repeat(words[:, 0], b), "f2": np.repeat(words[:, 1], b)})

    return run


#: Lists longer than this are joined in blocks of about this many members, each pair of blocks by a group of its own.
BLOCK = 1000


def paired(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """Pairs of rows with the same band, each at least once: a.* and b.*, structs of the other columns. Without right, left is
    joined with itself and a row is not paired with its equals. No group is asked for more than some BLOCK * BLOCK pairs."""
    cols = [x for x in left.columns if x != "band"]
    both = left if right is None else left.unionByName(right, allowMissingColumns=True)
    long = both.groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("k"))
    long = Stored(long).df
    block = F.pmod(F.xxhash64("band", *cols), F.col("k")).cast("int")
    as_rows = lambda d, name: d.select("band", F.struct(*[F.col(x) for x in d.columns if x not in ("band", "k", "i")]).alias(name), *[x for x in ("k", "i") if x in d.columns])
    other = left if right is None else right
    light = as_rows(left.join(long, "band", "left_anti"), "a").join(as_rows(other.join(long, "band", "left_anti"), "b"), "band")
    grid = lambda d, name: as_rows(d.join(long, "band").withColumn("i", block), name)
    every = F.sequence(F.lit(0), F.col("k") - 1)
    a = grid(left, "a").select("band", "a", "i", F.explode(F.filter(every, lambda j: j >= F.col("i")) if right is None else every).alias("j"))
    b = grid(other, "b").select("band", "b", F.col("i").alias("j"), F.explode(F.filter(every, lambda j: j <= F.col("i")) if right is None else every).alias("i"))
    out = light.select("a", "b").unionByName(a.join(b, ["band", "i", "j"]).select("a", "b"))
    return out.filter("a <> b") if right is None else out


def _verify(q: int, t: float):
    """Keeps pairs whose texts are equal or have a Jaccard similarity of t or more over distinct q-letter substrings."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[str, set[str]] = {}
        held = 0

        def of(x: str) -> set[str]:
            nonlocal held
            s = sets.get(x)
            if s is None:
                held += len(x)
                if held > HELD:
                    sets.clear()
                    held = len(x)
                s = sets[x] = {x[i : i + q] for i in range(len(x) - q + 1)}
            return s

        for b in it:
            good = []
            for x, y in zip(b["t1"], b["t2"]):
                u, v = of(x), of(y)
                both = len(u & v)
                good.append(x == y or (both > 0 and both >= t * (len(u) + len(v) - both)))
            yield b.loc[np.array(good, dtype=bool), ["r1", "r2"]]

    return run


def classes(records: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, t, c: usable records and the 64-bit name of their text. A clash of names only adds work: texts are compared later."""
    return records.select(F.col(id_col).cast("string").alias("id"), text.alias("t")).filter("id is not null and t is not null and t <> ''").withColumn("c", F.xxhash64("t"))


def membership(base: DataFrame) -> DataFrame:
    """id, rep, m for every record: rep is the least id with the same text (compared by 128 hash bits), m the group's size."""
    mem = base.select("id", "c", F.xxhash64(F.lit("second"), "t").alias("c2")).distinct()
    return mem.join(mem.groupBy("c", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("m")), ["c", "c2"]).select("id", "rep", "m")


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, q: int, t: float) -> DataFrame:
    """Pairs (c1, c2) to pairs of representatives (r1, r2). left and right: c, t, rep."""
    a = left.select(F.col("c").alias("c1"), F.col("t").alias("t1"), F.col("rep").alias("r1"))
    b = right.select(F.col("c").alias("c2"), F.col("t").alias("t2"), F.col("rep").alias("r2"))
    return pairs.join(a, "c1").join(b, "c2").select("t1", "t2", "r1", "r2").mapInPandas(_verify(q, t), "r1 string, r2 string")


def expand(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of representatives to pairs of records (x, y); left and right: id, rep, m of groups with more than one member."""
    size = lambda d, k: d.select(F.col("rep").alias(f"r{k}"), F.col("m").alias(f"m{k}")).distinct()
    p = pairs.join(size(left, 1), "r1", "left").join(size(right, 2), "r2", "left").fillna(1, ["m1", "m2"])
    a = left.select(F.col("rep").alias("r1"), F.col("id").alias("x"))
    b = right.select(F.col("rep").alias("r2"), F.col("id").alias("y"))
    every = F.col("m1").cast("double") * F.col("m2") <= ALL_PAIRS
    full = p.filter(every).join(a, "r1", "left").join(b, "r2", "left").select(F.coalesce("x", "r1").alias("x"), F.coalesce("y", "r2").alias("y"))
    big = p.filter(~every)
    star = (
        big.join(a, "r1", "left").select(F.coalesce("x", "r1").alias("x"), F.col("r2").alias("y"))
        .unionByName(big.join(b, "r2", "left").select(F.col("r1").alias("x"), F.coalesce("y", "r2").alias("y")))
    )
    return full.unionByName(star.distinct())


def copies(groups: DataFrame) -> DataFrame:
    """Pairs (x < y) within groups of equal texts: all of them up to ALL_PAIRS a group, else each member with the least id."""
    every = F.col("m").cast("double") * F.col("m") / 2 <= ALL_PAIRS
    few = groups.filter(every)
    full = few.select(F.col("id").alias("x"), "rep").join(few.select(F.col("id").alias("y"), "rep"), "rep").filter("x < y").select("x", "y")
    return full.unionByName(groups.filter(~every & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("id").alias("y")))


# Problem 3

#: (r, b) of the subsets by level: sizes for which a pair of similarity 0.72, or 0.62, is missed with probability 2e-5 at most.
LEVELS_72 = ((3, 24), (6, 72), (12, 560))
LEVELS_62 = ((3, 40), (6, 185), (9, 800))


def boundary(base: DataFrame, t: float, q: int, b: int, share: float = 0.25, most: int = 200) -> int:
    """The size up to which sets enumerate all their subsets: the greatest at which these are no more than `share` of the rows
    that large sets give. Sizes are estimated by lengths; the choice has no bearing on the result but on what finds it."""
    lengths = dict(base.filter(F.length("t") < most / t + q).groupBy(F.length("t").alias("l")).agg(F.count("*").alias("n")).collect())  # most / t + q rows at most
    budget, spent, best = share * b * base.count(), 0.0, 1
    sized = sorted((max(1, k - q + 1), n) for k, n in lengths.items())
    for x in range(1, most + 1):
        while sized and sized[0][0] * t <= x:
            k, n = sized.pop(0)
            spent += n * math.comb(k - math.ceil(t * k - 1e-9) + 2, 2)
        if spent > budget:
            break
        best = x
    return best


def class_pairs(base: DataFrame, t: float, q: int, levels: tuple[tuple[int, int], ...]) -> DataFrame:
    """Verified pairs (r1, r2) of representatives of different texts, in no particular order within a pair."""
    small = boundary(base, t, q, levels[0][1])
    occ = Stored(base.select("c", "t").mapInPandas(subset_rows(q, *levels[0], 1, t, small), "band long, c long")).df  # read twice
    again = occ.groupBy("band").agg(F.min("c").alias("a"), F.max("c").alias("z")).filter("a <> z").select("band")
    lists = Stored(occ.join(again, "band", "left_semi").distinct()).df
    texts = Stored(base.join(lists.select("c").distinct(), "c", "left_semi").groupBy("c", "t").agg(F.min("id").alias("rep"))).df
    light = []
    for k, (r, b) in enumerate(levels[1:], 2):
        # n (n - 1) / 2 pairs of a light list cost no more than the n * b rows of a heavy one's members at the next level
        sizes = lists.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
        sized = lists.join(sizes, "band")
        heavy = sizes.filter(F.col("n") > 2 * b + 1)
        if heavy.isEmpty():
            break
        light.append(sized.filter(F.col("n") <= 2 * b + 1).select("band", "c"))
        members = sized.filter(F.col("n") > 2 * b + 1).select("c").distinct()
        # small sets keep their exact subsets, whose lists are then scanned to the end; large ones give larger subsets
        lists = Stored(texts.join(members, "c", "left_semi").select("c", "t").mapInPandas(subset_rows(q, r, b, k, t, small), "band long, c long").distinct()).df
    pairs = paired(reduce(DataFrame.unionByName, [*light, lists])).select(F.least("a.c", "b.c").alias("c1"), F.greatest("a.c", "b.c").alias("c2")).distinct()
    return verified(pairs, texts, texts, q, t)


def near_duplicates(records: DataFrame, id_col: str, text: Column, t: float = 0.7, q: int = 5, levels: tuple[tuple[int, int], ...] = LEVELS_72) -> DataFrame:
    """Pairs id_a < id_b of records whose texts share t or more of their distinct q-letter substrings.

    Size-aware heavy-light join: small sets enumerate all the subsets that matter, so that none of their pairs is missed; the
    boundary is chosen by cost. Large sets give 24 subsets of three elements; the inverted lists of subsets held by one text
    only fall away in an aggregation. Light lists give their pairs. Lists so long that their pairs would cost more than
    enumerating larger subsets are heavy: they are never paired, their members are joined by 72 subsets of six elements,
    and where those lists are heavy again by 560 of twelve, which only similar texts share. A pair of large sets of
    similarity 0.72 is missed with probability 5e-5 at most. Other thresholds need other levels: (1 - t^r)^b. However long a
    list is at the end (a family of similar texts), it is paired in blocks, by tasks of bounded size.

    Null and empty texts, and null ids, are in no pair. Rows repeated under one id are one record. Equal texts are paired
    (see ALL_PAIRS for giant groups). Texts shorter than q letters pair only with their copies. An empty table gives none."""
    ship(records.sparkSession)
    base = classes(records, id_col, text)
    groups = membership(base).filter("m > 1")
    found = expand(class_pairs(base, t, q, levels), groups, groups)
    both = found.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).unionByName(copies(groups).toDF("id_a", "id_b"))
    return both.filter("id_a < id_b").distinct()


def similarity_classes(records: DataFrame, id_col: str, text: Column, t: float = 0.7, q: int = 5, levels: tuple[tuple[int, int], ...] = LEVELS_72) -> DataFrame:
    """One row per record: id, class_id (least id with an equal text), n_copies, and n_links (other texts it is similar to).

    Records without a usable text are classes of their own without links."""
    ship(records.sparkSession)
    base = classes(records, id_col, text)
    found = class_pairs(base, t, q, levels)
    links = found.select(F.explode(F.array("r1", "r2")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    everyone = records.select(F.col(id_col).cast("string").alias("id")).filter("id is not null").distinct()
    return (
        everyone.join(membership(base), "id", "left").join(links, "rep", "left")
        .select("id", F.coalesce("rep", "id").alias("class_id"), F.coalesce("m", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )


# Problem 4


def cross_split(
    evaluation: DataFrame, train: DataFrame, id_col: str, text: Column, t: float = 0.6, q: int = 5, levels: tuple[tuple[int, int], ...] = LEVELS_62, radius: int = 45, split: Column | None = None
) -> DataFrame:
    """Pairs (eval_id, train_id), and split_name before them where a split is given, of records whose texts are equal or share
    t or more of their distinct q-letter substrings. A record of the evaluation is named by its split and id together.

    Similarity-hash fingerprints: a code of 120 values of 16 bits, each value from a min-wise hash. Its 40 segments of 48 bits
    are the code blocks. Train blocks are reduced to those that occur in the evaluation splits, blocks are joined across
    splits, pairs beyond the Hamming radius (on 120 bits, one of each value, which differ with probability (1 - s) / 2)
    dropped, the rest verified on their texts. A block held by so many records of both sides that its pairs would cost more
    than longer segments is not joined: its records get 185 segments of 96 bits, and then 800 of 144. A pair of similarity
    0.62 is missed with probability 6e-5 at most (blocks) + 1e-7 (radius, 5 deviations).

    Null ids and null or empty texts are in no pair; a null split is a split; texts shorter than q letters pair only if
    equal; repeated rows count once. Only id_col and the columns of text and split are read. Either table empty gives none."""
    ship(train.sparkSession)
    if split is not None:
        named = F.when(F.col(id_col).isNotNull(), F.struct(split.cast("string").alias("s"), F.col(id_col).cast("string").alias("i")))
        evaluation = evaluation.select(F.to_json(named, {"ignoreNullFields": "false"}).alias("__id"), text.alias("__t"))
        found = cross_split(evaluation.withColumnRenamed("__id", id_col), train.select(F.col(id_col), text.alias("__t")), id_col, F.col("__t"), t, q, levels, radius)
        at = F.from_json("eval_id", "s string, i string")
        return found.select(at["s"].alias("split_name"), at["i"].alias("eval_id"), "train_id")
    e, n = classes(evaluation, id_col, text), classes(train, id_col, text)
    rows = lambda d, k: d.select("c", "t").mapInPandas(code_rows(q, *levels[k], 10 + k), "band long, c long, f1 long, f2 long")
    apart = F.bit_count(F.col("a.f1").bitwiseXOR(F.col("b.f1"))) + F.bit_count(F.col("a.f2").bitwiseXOR(F.col("b.f2")))
    across = lambda x, y: paired(x, y).filter(apart <= radius).select(F.col("a.c").alias("c1"), F.col("b.c").alias("c2"))
    found, ex, nx = [], e, n
    for k in range(len(levels)):
        eb = Stored(rows(ex, k).distinct()).df
        hit = Stored(rows(nx, k).join(eb.select("band").distinct(), "band", "left_semi").distinct()).df
        heavy = None
        if k + 1 < len(levels):
            size = lambda d, name: d.groupBy("band").agg(F.count("*").alias(name))
            heavy = size(eb, "ne").join(size(hit, "nt"), "band").filter(F.col("ne") * F.col("nt") > levels[k + 1][1] * (F.col("ne") + F.col("nt"))).select("band")
            heavy = Stored(heavy).df
            heavy = None if heavy.isEmpty() else heavy
        if heavy is None:
            found.append(across(eb, hit))
            break
        found.append(across(eb.join(heavy, "band", "left_anti"), hit.join(heavy, "band", "left_anti")))
        of = lambda d, b: d.join(b.join(heavy, "band", "left_semi").select("c").distinct(), "c", "left_semi")
        ex, nx = of(e, eb), of(n, hit)
    pairs = Stored(reduce(DataFrame.unionByName, found).distinct()).df
    texts = lambda d, k: d.join(pairs.select(F.col(k).alias("c")).distinct(), "c", "left_semi").groupBy("c", "t").agg(F.min("id").alias("rep"))
    good = verified(pairs, texts(e, "c1"), texts(n, "c2"), q, t)
    return expand(good, membership(e).filter("m > 1"), membership(n).filter("m > 1")).select(F.col("x").alias("eval_id"), F.col("y").alias("train_id"))
