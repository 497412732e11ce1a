"""Exact summaries: percentiles, bins, frequencies, rates and audits. Each is one aggregation with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S

#: Bins of lengths, half-open, the last without an end.
BINS = [("0-200", 0, 200), ("200-500", 200, 500), ("500-850", 500, 850), ("850-1000", 850, 1000), ("1000-1300", 1000, 1300), ("1300-1500", 1300, 1500), ("1500+", 1500, None)]


def share(flag: Column) -> Column:
    """Part of the rows for which the flag holds; 0 without rows."""
    return F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))


def length_summary(n: Column, prefix: str = "len_") -> list[Column]:
    """min, 5 linearly interpolated percentiles, mean and max; 0 without rows. Exact: percentile keeps counts per value."""
    out = [F.min(n).cast("double").alias(f"{prefix}min")]
    for name, p in (("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95)):
        out.append(F.percentile(n, F.lit(p)).alias(f"{prefix}{name}"))
    out += [F.avg(n).alias(f"{prefix}mean"), F.max(n).cast("double").alias(f"{prefix}max")]
    return [F.coalesce(c, F.lit(0.0)).alias(f"{prefix}{k}") for c, k in zip(out, ["min", "p05", "p25", "median", "p75", "p95", "mean", "max"])]


def bin_of(n: Column) -> Column:
    out = F.lit(BINS[-1][0])
    for name, _, hi in reversed(BINS[:-1]):
        out = F.when(n < hi, name).otherwise(out)
    return out


def length_bins(spark: SparkSession, df: DataFrame, n: Column) -> DataFrame:
    """All bins with their counts, 0 included."""
    names = spark.createDataFrame([(i, b[0]) for i, b in enumerate(BINS)], "bin_ord int, bin string")
    counts = df.groupBy(bin_of(n).alias("bin")).agg(F.count("*").alias("n"))
    return names.join(F.broadcast(counts), "bin", "left").select("bin_ord", "bin", F.coalesce("n", F.lit(0)).alias("n"))  # 7 rows


def top_values(df: DataFrame, value: Column, order: list[str], k: int = 20) -> DataFrame:
    """The k most frequent values (null is one), ties by first appearance."""
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("__o")).orderBy(F.desc("n"), "__o").limit(k).drop("__o")


def nearest_rank(df: DataFrame, value: Column, q: float, groups: list[str] | None = None) -> DataFrame:
    """The sorted value number round-half-even((n - 1) * q) of each group; 0 for no values at all (without groups).

    Counts of distinct values are put in one global order by range partitions, so that no group has to fit into a task; a
    group's ranks are its running totals less those of the groups before it. Null groups are a group."""
    from .corpus import with_running_total

    g = groups or []
    counts = df.select(*g, value.cast("double").alias("v")).filter("v is not null").groupBy(*g, "v").agg(F.count("*").alias("n"))
    t = with_running_total(counts, [*g, "v"], "n")
    per = t.groupBy(*[F.col(c).alias(f"__{c}") for c in g]).agg(F.sum("n").alias("total"), F.min("before").alias("first"))
    if g:
        t = t.join(per, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in g])
    else:
        t = t.join(F.broadcast(per))  # one row
    at, lo = F.rint((F.col("total") - 1) * F.lit(q)), F.col("before") - F.col("first")
    hit = t.filter((at >= lo) & (at < lo + F.col("n")))
    return hit.groupBy(*g).agg(F.max("v").alias("value")) if g else hit.agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("value"))


def metric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, mean, min, max of numeric columns, by name; null values are skipped."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in sorted(columns)])).alias("x")).select("x.*").filter("v is not null")
    return rows.groupBy("name").agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))


def numeric_columns(df: DataFrame) -> list[str]:
    from pyspark.sql import types as T

    return sorted(f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType))


def corpus_counters(rows: DataFrame) -> DataFrame:
    """Counters of a keyword corpus: raw, with protein, after cleaning, unique, removed as copies, changed by cleaning."""
    has, cleaned = S.text("protein") != "", F.col("sequence") != ""
    n = lambda c: F.count_if(c)
    return rows.agg(
        F.count("*").alias("raw_entries"), n(has).alias("nonempty_protein"), n(cleaned).alias("post_clean"),
        F.count_distinct(F.when(cleaned, F.col("sha256"))).alias("unique_sequences"),
        n(cleaned & S.changed_by_cleaning("protein")).alias("changed_by_cleaning"),
    ).withColumn("duplicates_removed", F.col("post_clean") - F.col("unique_sequences"))
