"""Position-wise comparisons of sequences with many others, without forming pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship


#: Places of a sequence that go together; and rows of one length that a task adds up.
PLACES, TOGETHER = 256, 20_000


def _profiles(most: int = 400):
    """mapInPandas function: pieces (b, m, piece) to counts (b, x, m, at, n): how often each letter stands at each place of
    block b among the sequences of length m. Counted in the task over all its batches; `most` blocks are held at a time."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}

        def out() -> pd.DataFrame:
            rows = []
            for (b, m), parts in held.items():
                code, n = np.unique(np.concatenate(parts), return_counts=True)
                letter = code // PLACES
                cuts = np.flatnonzero(np.diff(letter)) + 1
                for x, at, k in zip(letter[np.concatenate([[0], cuts])], np.split(code % PLACES, cuts), np.split(n, cuts)):
                    rows.append((b, int(x), m, at.astype(np.int16), k.astype(np.int64)))
            held.clear()
            return pd.DataFrame(rows, columns=["b", "x", "m", "at", "n"])

        chars = 0
        for batch in it:
            for b, m, piece in zip(batch["b"], batch["m"], batch["piece"]):
                held.setdefault((b, m), []).append(_codes(piece).astype(np.int64) * PLACES + np.arange(len(piece)))
                chars += len(piece)
                if chars > 4_000_000 or len(held) > most:
                    yield out()
                    chars = 0
        if held:
            yield out()

    return run


def _gains(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts sorted by (b, x) to (b, x, m, gain): what a sequence of length m gains from letter x at each place of block b.
    What is held is one profile for each length that occurs with a letter."""
    at, held = None, {}

    def out() -> pd.DataFrame:
        ms = np.array(sorted(held))
        c = np.stack([held[m] for m in ms]).astype(float)
        upto, each = np.cumsum(c, axis=0), c / ms[:, None]
        beyond = np.cumsum(each[::-1], axis=0)[::-1] - each
        gain = upto / ms[:, None] + beyond
        return pd.DataFrame({"b": at[0], "x": at[1], "m": ms, "gain": list(gain)})

    for batch in it:
        for b, x, m, places, n in zip(batch["b"], batch["x"], batch["m"], batch["at"], batch["n"]):
            if at != (b, x):
                if held:
                    yield out()
                at, held = (b, x), {}
            held.setdefault(m, np.zeros(PLACES, dtype=np.int64))[places] += n
    if held:
        yield out()


def _added(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (b, m, part), gains before pieces, to (id, total): what each piece gains."""
    at, gains = None, {}
    for batch in it:
        ids, totals = [], []
        for b, m, part, x, gain, k, piece in zip(*[batch[c] for c in ("b", "m", "part", "x", "gain", "id", "piece")]):
            if at != (b, m, part):
                at, gains = (b, m, part), {}
            if piece is None:
                gains[int(x)] = gain
            else:
                codes = _codes(piece)
                letters, which = np.unique(codes, return_inverse=True)
                ids.append(k)
                totals.append(float(np.stack([gains[int(c)] for c in letters])[which, np.arange(len(codes))].sum()))
        yield pd.DataFrame({"id": pd.Series(ids, dtype=object), "total": np.array(totals, dtype=float)})


def mean_identity_sums(df: DataFrame, id_col: str, seq: Column) -> DataFrame:
    """id, s, total: total is the sum over all rows (itself included) of positional identity with the row.

    identity(a, b) = equal characters at equal places / max(length a, length b). With c(p, x, l) rows of length l that have
    character x at place p, a row of length m gains, for each of its (p, x), sum over l <= m of c / m + sum over l > m of
    c / l. The work is linear in all characters. Sequences go in pieces of PLACES characters: letters are counted in the
    tasks that read them, so that profiles by block, letter and length are shuffled, then the pieces themselves, once, to the
    gains of their block and length. A length that very many rows have is added up in parts. Null ids keep a total of 0."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), seq.alias("s")).withColumn("m", F.length("s"))
    kind = rows.schema["id"].dataType.simpleString()
    pieces = rows.filter("m > 0 and id is not null").select("id", "m", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / PLACES).cast("int"))).alias("b"), "s")
    pieces = pieces.select("id", "m", "b", F.substring(F.col("s"), F.col("b") * PLACES + 1, F.lit(PLACES)).alias("piece"))
    counts = rows.filter("m > 0").select("m", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / PLACES).cast("int"))).alias("b"), "s")
    counts = counts.select("b", "m", F.substring(F.col("s"), F.col("b") * PLACES + 1, F.lit(PLACES)).alias("piece")).mapInPandas(_profiles(), "b int, x int, m int, at array<smallint>, n array<bigint>")
    gains = counts.repartition("b", "x").sortWithinPartitions("b", "x").mapInPandas(_gains, "b int, x int, m int, gain array<double>")
    parts = rows.filter("m > 0").groupBy("m").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("k"))  # one row a length
    mine = pieces.join(parts, "m").select("b", "m", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("part"), F.lit(1).alias("o"), F.lit(0).alias("x"), F.lit(None).cast("array<double>").alias("gain"), "id", "piece")
    theirs = gains.join(parts, "m").select("b", "m", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"), F.lit(0).alias("o"), "x", "gain", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("string").alias("piece"))
    both = mine.unionByName(theirs).repartition("b", "m", "part").sortWithinPartitions("b", "m", "part", "o")
    total = both.mapInPandas(_added, f"id {kind}, total double").groupBy("id").agg(F.sum("total").alias("total"))
    return rows.join(total, "id", "left").select("id", "s", F.coalesce("total", F.lit(0.0)).alias("total"))


def diversity_by_index(df: DataFrame, id_col: str, seq: Column) -> DataFrame:
    """id, diversity: mean over all other rows of 1 - identity; 0 if there is no other row. Ids must be unique."""
    sums = mean_identity_sums(df, id_col, seq)
    n = sums.agg(F.count("*").alias("n"))
    own = F.when(F.length("s") > 0, 1.0).otherwise(0.0)
    value = F.when(F.col("n") > 1, 1 - (F.col("total") - own) / (F.col("n") - 1)).otherwise(0.0)
    return sums.join(F.broadcast(n)).select("id", value.alias("diversity"))  # one row


def diversity_by_value(df: DataFrame, id_col: str, seq: Column, eps: float = 1e-6) -> DataFrame:
    """id, diversity: as above over the rows with another sequence; 1 if there is none or the sequence is empty; clamped."""
    sums = mean_identity_sums(df, id_col, seq)
    n = sums.agg(F.count("*").alias("n"))
    copies = sums.groupBy(F.sha2("s", 256).alias("k")).agg(F.count("*").alias("copies"))
    both = sums.withColumn("k", F.sha2("s", 256)).join(copies, "k").join(F.broadcast(n))  # one row
    others = F.col("n") - F.col("copies")
    value = F.when((F.length("s") == 0) | (others == 0), 1.0).otherwise(1 - (F.col("total") - F.col("copies")) / F.greatest(others, F.lit(1)))
    return both.select("id", F.greatest(F.lit(eps), F.least(F.lit(1.0), value)).alias("diversity"))


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)


def nearest_identity(queries: DataFrame, reference: DataFrame, id_col: str, seq_col: str, block: int = 512) -> DataFrame:
    """id, nearest: the largest positional identity with any reference sequence; 0 if there is none, or for empty queries.

    A stated query set against all rows: queries are collected in blocks of `block` (a bound on what is broadcast), each
    block is compared with every reference row in one map-side pass, and only a block's maxima are shuffled. A reference
    row whose length bounds the identity below what is already found is passed over, which is exact."""
    spark = queries.sparkSession
    ship(spark)
    q = queries.select(F.col(id_col).alias("id"), F.coalesce(F.col(seq_col), F.lit("")).alias("s")).orderBy("id")
    out = None
    pending: list[tuple] = []
    ref = reference.select(F.col(seq_col).alias("s")).filter("s is not null and s <> ''")
    kind = q.schema["id"].dataType.simpleString()

    def one(rows: list[tuple]) -> DataFrame:
        held = spark.sparkContext.broadcast(rows)

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mine = [(i, _codes(s)) for i, s in held.value]
            best = np.zeros(len(mine))
            for b in it:
                for s in b["s"]:
                    r = _codes(s)
                    for k, (_, c) in enumerate(mine):
                        n = min(len(c), len(r))
                        if n and n / max(len(c), len(r)) > best[k]:
                            best[k] = max(best[k], np.count_nonzero(c[:n] == r[:n]) / max(len(c), len(r)))
            yield pd.DataFrame({"id": [i for i, _ in mine], "nearest": best})

        found = ref.mapInPandas(run, f"id {kind}, nearest double").groupBy("id").agg(F.max("nearest").alias("nearest"))
        return spark.createDataFrame([(i,) for i, _ in rows], f"id {kind}").join(found, "id", "left").select("id", F.coalesce("nearest", F.lit(0.0)).alias("nearest"))

    for r in q.toLocalIterator():
        pending.append((r.id, r.s))
        if len(pending) == block:
            part, pending = one(pending), []
            out = part if out is None else out.unionByName(part)
    if pending or out is None:
        part = one(pending)
        out = part if out is None else out.unionByName(part)
    return out


def round_robin(rows: DataFrame, ordinal: str, prompts: DataFrame, position: str) -> DataFrame:
    """Each row with the prompt whose position is its ordinal modulo the number of prompts."""
    n = prompts.agg(F.count("*").alias("__n"))
    keyed = rows.join(F.broadcast(n)).withColumn("__k", F.pmod(F.col(ordinal), F.col("__n")))  # one row
    return keyed.join(prompts, keyed["__k"] == prompts[position]).drop("__k", "__n", position)
