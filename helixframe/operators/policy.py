"""Batch arithmetic of a reward loop: normalisation, advantages, divergence and the clipped surrogate, per step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _moments(df: DataFrame, group: str, x: Column) -> DataFrame:
    """Mean, population deviation and count of each group, joined back: an aggregation with map-side combine instead of a
    window, so that a group as large as the table stays split."""
    m = df.groupBy(F.col(group).alias("__g")).agg(F.avg(x).alias("__mu"), F.stddev_pop(x).alias("__sd"), F.count("*").alias("__n"))
    return df.join(m, df[group].eqNullSafe(m["__g"]))


def z_scores(df: DataFrame, group: str, x: str, name: str = "z") -> DataFrame:
    """(x - mean) / deviation within the group; 0 where the deviation is below 1e-8."""
    z = F.when(F.col("__sd") < 1e-8, 0.0).otherwise((F.col(x) - F.col("__mu")) / F.col("__sd"))
    return _moments(df, group, F.col(x)).withColumn(name, z).drop("__g", "__mu", "__sd", "__n")


def advantages(df: DataFrame, group: str, x: str, name: str = "advantage") -> DataFrame:
    """x less the group's mean, divided by its deviation if the group has more than one row and a deviation above 1e-8."""
    c = F.col(x) - F.col("__mu")
    a = F.when((F.col("__n") > 1) & (F.col("__sd") > 1e-8), c / F.col("__sd")).otherwise(c)
    return _moments(df, group, F.col(x)).withColumn(name, a).drop("__g", "__mu", "__sd", "__n")


def token_kl(logprob: Column, reference: Column, tokens: Column) -> Column:
    return (logprob - reference) / F.greatest(tokens, F.lit(1))


def surrogate(new: Column, old: Column, advantage: Column, clip: float = 0.2) -> Column:
    """Row term of the clipped objective; its negated mean is the loss. The log ratio is kept within 20."""
    ratio = F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), new - old)))
    return F.least(ratio * advantage, F.greatest(F.lit(1 - clip), F.least(F.lit(1 + clip), ratio)) * advantage)


def resume_step(metrics: DataFrame, step: str = "step") -> int:
    """The step to go on from: the last one logged, 0 if none."""
    return metrics.agg(F.max(step)).first()[0] or 0
