"""Problem 5: splits that keep related records together.

Method: grouped iterative stratification. Records that share a key, directly or through others, are components; components
are placed by label, the rarest outstanding label first, into the split that needs that label most."""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Stored

#: Texts that stand for a missing key.
NO_KEY = ["", "-", "--", "?", ".", "na", "n/a", "n.a.", "nan", "null", "nil", "none", "unknown", "undefined", "unassigned", "missing", "not available", "not assigned", "tbd", "tba"]


def key(c: str, named: str | None = None, trim: bool = True) -> Column:
    """A key without letter case (and, with trim, without surrounding white space); null where it is blank, a word for
    'missing', or doesn't match named."""
    bare = F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))
    good = ~bare.isin(*NO_KEY)
    return F.when(good & bare.rlike(named) if named else good, bare if trim else F.lower(F.col(c)))


def links(records: DataFrame, id_col: str, keys: list[Column]) -> DataFrame:
    """Edges (u, v), v < u: each record with the least id that has one of its keys. Linear in the rows, whatever a key holds."""
    rec = records.select(F.col(id_col).cast("string").alias("u"), *[k.alias(f"k{i}") for i, k in enumerate(keys)]).filter("u is not null")
    parts = []
    for i in range(len(keys)):
        rows = rec.select("u", F.col(f"k{i}").alias("k")).filter("k is not null").distinct()
        least = rows.groupBy("k").agg(F.min("u").alias("v"), F.max("u").alias("w")).filter("v <> w").select("k", "v")
        parts.append(rows.join(least, "k").filter("u <> v").select("u", "v"))
    return reduce(DataFrame.unionByName, parts).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, group_id) of every node of an undirected graph (u, v); group_id is the least node of its component.

    Large-star and small-star steps in turn: each node hands its larger, then its smaller, neighbours to its least
    neighbour. The rounds grow with the logarithm of the component size; a hub's rows are joined with one row, which skew
    handling splits. Every round ends in a table in the shared folder."""
    now = Stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = _state(now.df)
    for _ in range(max_rounds):
        e = now.df
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        nxt = Stored(small)
        after = _state(nxt.df)
        now.drop()
        now = nxt
        if after == before:
            stars = now.df
            return stars.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(stars.select("v", "v").toDF("id", "group_id").distinct())
        before = after
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def related_groups(records: DataFrame, id_col: str, keys: list[Column]) -> DataFrame:
    """(id, group_id) of the records whose group has more than one record; group_id is the group's least id.

    Records are linked by equal values of any key column expression; a null key links nothing, a null id is no record. Rows
    repeated under one id are one record with the keys of all of them. An empty table gives none."""
    return components(links(records, id_col, keys))


#: Label counts of large groups that the driver holds at most; a label with more values is no stratification label.
VECTORS = 2_000_000


def _place(vectors: dict[str, dict[str, int]], totals: dict[str, int], fractions: dict[str, float]) -> dict[str, str]:
    """Iterative stratification of whole groups: those with the rarest outstanding label first, larger before smaller, each
    into the split whose outstanding need of that label is greatest."""
    names = list(fractions)
    need = {s: {x: fractions[s] * n for x, n in totals.items()} for s in names}
    room = {s: sum(need[s].values()) for s in names}
    outstanding: dict[str, int] = {}
    holders: dict[str, list[str]] = {}
    for g, v in vectors.items():
        for x, n in v.items():
            outstanding[x] = outstanding.get(x, 0) + n
            holders.setdefault(x, []).append(g)
    heap = [(n, x) for x, n in outstanding.items()]
    heapq.heapify(heap)
    placed: dict[str, str] = {}
    while heap:
        n, x = heapq.heappop(heap)
        if n != outstanding[x]:
            continue  # it has become rarer since and stands in the heap again
        for g in sorted((g for g in holders[x] if g not in placed), key=lambda g: (-sum(vectors[g].values()), g)):
            size = sum(vectors[g].values())
            s = max(names, key=lambda s: (need[s][x] >= vectors[g][x], need[s][x], room[s] >= size, -names.index(s)))
            placed[g] = s
            room[s] -= size
            for y, k in vectors[g].items():
                need[s][y] -= k
                outstanding[y] -= k
                if y != x and outstanding[y]:
                    heapq.heappush(heap, (outstanding[y], y))
    return placed


def grouped_split(records: DataFrame, id_col: str, keys: list[Column], label: Column, fractions: dict[str, float], large: float = 1e-4, buckets: int = 1024) -> DataFrame:
    """id, group_id, label, split for every record; no group is divided, and splits hold their fractions of the records, and
    of each label, as nearly as the groups allow. Deterministic.

    Groups of at least `large` of all records, of which there are 1 / large at most, are placed one by one (see _place). The
    other groups are placed by their rarest label too, all those of a label at once: ordered by hash, they are cut where the
    splits' outstanding needs of that label end. Cuts are found from sums over hash buckets, so that no label's groups are
    ordered in one task. Every value of the label counts, however rare; ValueError if the large groups alone hold more than
    VECTORS different (group, label) pairs.

    A null label is a label of its own. Records without keys are groups of one. A record whose rows have several labels
    counts under each of them, and is given out with the least."""
    names = list(fractions)
    if abs(sum(fractions.values()) - 1) > 1e-6 or min(fractions.values()) < 0:
        raise ValueError(f"fractions must be at least 0 and sum to 1: {fractions}")
    rec = records.select(F.col(id_col).cast("string").alias("id"), F.coalesce(label.cast("string"), F.lit("(null)")).alias("l")).filter("id is not null").distinct()
    base = Stored(rec.join(related_groups(records, id_col, keys), "id", "left").select("id", "l", F.coalesce("group_id", "id").alias("group_id"))).df
    spark = base.sparkSession
    parts = base.groupBy("group_id", "l").agg(F.count("*").alias("n"))
    totals = Stored(base.groupBy("l").agg(F.count("*").alias("total"))).df
    rarest = parts.join(totals, "l").groupBy("group_id").agg(F.sum("n").alias("size"), F.min(F.struct("total", "l"))["l"].alias("l"))
    sized = Stored(rarest.withColumn("h", F.xxhash64("group_id"))).df
    cut = max(2.0, large * base.count())
    big = sized.filter(F.col("size") >= cut).select("group_id")  # 1 / large groups at most
    held = parts.join(big, "group_id").join(totals, "l")
    rows = held.limit(VECTORS + 1).collect()
    if len(rows) > VECTORS:
        raise ValueError(f"more than {VECTORS} pairs of a large group and a label: the label has too many values to stratify by")
    vectors: dict[str, dict[str, int]] = {}
    for r in rows:
        vectors.setdefault(r.group_id, {})[r.l] = r.n
    placed = spark.createDataFrame(list(_place(vectors, {r.l: r.total for r in rows}, fractions).items()), "group_id string, split string")
    # what the large groups leave of each label's needs
    taken = parts.join(F.broadcast(placed), "group_id").groupBy("l").agg(*[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(f"t{i}") for i, s in enumerate(names)])
    wants = totals.join(taken, "l", "left").select("l", F.array(*[F.greatest(F.lit(0.0), F.lit(fractions[s]) * F.col("total") - F.coalesce(f"t{i}", F.lit(0))) for i, s in enumerate(names)]).alias("want"))
    rest = sized.filter(F.col("size") < cut).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    sums = rest.groupBy("l", "bucket").agg(F.sum("size").alias("n"))
    to_here = Window.partitionBy("l").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # `buckets` rows a label
    sums = sums.select("l", "bucket", (F.sum("n").over(to_here) - F.col("n")).cast("double").alias("before"), F.sum("n").over(Window.partitionBy("l")).alias("here"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    even = F.array(*[F.lit(float(fractions[s])) for s in names])
    plan = sums.join(wants, "l").withColumn("want", F.when(add(F.col("want")) > 0, F.col("want")).otherwise(even))
    edges = F.transform(F.sequence(F.lit(1), F.lit(len(names) - 1)), lambda i: add(F.slice("want", 1, i)) / add(F.col("want")) * F.col("here")) if len(names) > 1 else F.array().cast("array<double>")
    plan = plan.select("l", "bucket", "before", edges.alias("edges"))
    w = Window.partitionBy("l", "bucket").orderBy("h", "group_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mid = F.col("before") + F.sum("size").over(w) - F.col("size") / 2  # a group goes where its middle lies
    number = F.size(F.filter("edges", lambda e: e <= F.col("mid")))
    small = rest.join(plan, ["l", "bucket"]).withColumn("mid", mid).select("group_id", F.element_at(F.array(*[F.lit(s) for s in names]), number + 1).alias("split"))
    one = base.groupBy("id", "group_id").agg(F.min("l").alias("label"))
    return one.join(small.unionByName(placed), "group_id").select("id", "group_id", "label", "split")
