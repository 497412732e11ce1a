"""Candidate scoring: scorer registry, score cache, gate and scatter, and the two complete scoring pipelines."""

from __future__ import annotations

import hashlib
import json
import subprocess
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rewards as R
from ..functions import sequence as S
from ..runtime import ship

#: Built-in scorers by kind and mode: formulas over the text.
SCORERS: dict[tuple[str, str], Callable[[Column], Column]] = {
    ("structure", "mock"): R.mock_structure_fold,
    ("structure", "basic"): R.mock_structure_basic,
    ("structure", "probe"): R.mock_structure_probe,
    ("likelihood", "mock"): R.mock_likelihood_natural,
    ("likelihood", "basic"): R.mock_likelihood_basic,
    ("likelihood", "probe"): R.mock_likelihood_probe,
    ("likelihood", "aromatic"): R.mock_likelihood_aromatic,
    ("combined", "mock"): R.mock_combined,
    ("identity", "mock"): R.mock_identity,
}


def scorer(kind: str, mode: str) -> Callable[[Column], Column]:
    """The built-in scorer; 'disabled' gives null."""
    if mode == "disabled":
        return lambda _: F.lit(None)
    try:
        return SCORERS[kind, mode]
    except KeyError:
        raise ValueError(f"unsupported {kind} mode: {mode!r}") from None


def config_hash(config: dict) -> str:
    """Names a configuration: equal settings in any order give the same hash."""
    canonical = json.dumps(config, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(canonical.encode()).hexdigest()


def external_scores(df: DataFrame, seq_col: str, score: Callable[[list[str]], list[dict]], fields: str, batch: int = 64) -> DataFrame:
    """df with the fields a model gives for each text, and `error`.

    score gets lists of texts and is called in batches; a batch that raises is scored text by text, so that one failure
    costs one row. Results belong to their text by construction: what comes back short gets an error."""
    ship(df.sparkSession)
    names = [f.split()[0] for f in fields.split(",")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [fields, "error string"])

    def attempt(texts: list[str]) -> list[dict]:
        try:
            rows = list(score(texts))
            return [dict(r or {}) | {"error": (r or {}).get("error")} for r in rows] + [{"error": "no result"}] * (len(texts) - len(rows))
        except Exception as e:  # noqa: BLE001 - isolated by row below
            if len(texts) == 1:
                return [{"error": f"{type(e).__name__}: {e}"}]
            return [r for t in texts for r in attempt([t])]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            texts = [t if isinstance(t, str) else "" for t in b[seq_col]]
            rows = [r for i in range(0, len(texts), batch) for r in attempt(texts[i : i + batch])]
            for n in [*names, "error"]:
                b[n] = pd.Series([r.get(n) for r in rows], index=b.index, dtype=object)
            yield b

    return df.mapInPandas(run, schema)


def command_scorer(argv: list[str], timeout: int = 3600) -> Callable[[list[str]], list[dict]]:
    """A scorer that runs a program: JSON lines with sequence in, JSON lines with sequence out; no shell is involved.
    Results are matched by sequence, so the program may drop or reorder rows."""

    def score(texts: list[str]) -> list[dict]:
        data = "".join(json.dumps({"sequence": t}) + "\n" for t in texts)
        out = subprocess.run(argv, input=data, capture_output=True, text=True, timeout=timeout, check=True).stdout
        by = {}
        for line in out.splitlines():
            if line.strip():
                r = json.loads(line)
                by[r.get("sequence")] = r
        return [by.get(t) or {"error": "no result"} for t in texts]

    return score


def linear_classifier(features: Column, weights: list[float], bias: float) -> Column:
    """Probability of a logistic model over a feature array."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    z = F.aggregate(F.zip_with(features, w, lambda a, b: a * b), F.lit(float(bias)), lambda s, x: s + x)
    return 1 / (1 + F.exp(-z))


def fit_logistic(df: DataFrame, features: str, label: str, max_rows: int = 20_000, rounds: int = 300, rate: float = 0.5, seed: int = 7) -> tuple[list[float], float]:
    """Weights and bias fitted by gradient descent on at most max_rows labelled rows (a documented bound, by hash rank)."""
    rows = df.select(F.col(features).alias("x"), F.col(label).cast("double").alias("y")).filter("x is not null and y is not null")
    rows = rows.orderBy(F.xxhash64(F.lit(seed), "x")).limit(max_rows).toPandas()
    x, y = np.array(rows["x"].tolist(), dtype=float), rows["y"].to_numpy()
    if not len(y):
        return [], 0.0
    mu, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1
    z, w, b = (x - mu) / sd, np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(z @ w + b))) - y
        w -= rate * (z.T @ g) / len(y)
        b -= rate * g.mean()
    return (w / sd).tolist(), float(b - (w / sd) @ mu)


# Cache


def latest(cache: DataFrame, key: str = "key", at: str = "created_at") -> DataFrame:
    """Upsert semantics of an append-only cache table: the last row of each key."""
    cols = cache.columns
    rest = [c for c in cols if c not in (key, at)]
    w = Window.partitionBy(key).orderBy(F.desc(at), *rest)
    return cache.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(*cols)


def cached_scores(df: DataFrame, key: str, cache: DataFrame, cache_key: str, fields: list[str], score: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(scored, fresh): df with its fields, from the cache where the key is there, else from score; fresh are the new rows
    (cache_key and fields) to append. Input order is a column's business; distinct misses are scored once."""
    held = cache.select(F.col(cache_key).alias("__k"), *fields, F.lit(True).alias("cache_hit")).dropDuplicates(["__k"])
    keyed = df.withColumn("__k", F.col(key))
    missing = keyed.join(held, "__k", "left_anti").dropDuplicates(["__k"])
    fresh = score(missing).select(F.col("__k"), *fields)
    every = held.unionByName(fresh.withColumn("cache_hit", F.lit(False)))
    return keyed.join(every, "__k", "left").drop("__k"), fresh.withColumnRenamed("__k", cache_key)


# Pipelines


def score_candidates(df: DataFrame, seq: Column, diversity: Column, naturalness_stats: tuple[float | None, float | None] = (None, None), hard: dict | None = None, weights: dict | None = None) -> DataFrame:
    """Hard filters, three scorers on what passes, z-values and the weighted-sum reward, as columns beside df's."""
    s = F.upper(S.text(seq))
    out = df.withColumn("hard", S.hard_filter(s, **(hard or {}))).withColumn("__s", s)
    ok = F.col("hard.passed")
    out = out.withColumn("naturalness_score", F.when(ok, R.mock_likelihood_natural(F.col("__s"))["mean_log_likelihood"]))
    out = out.withColumn("cas13_identity_score", F.when(ok, R.mock_identity(F.col("__s"))))
    fold = R.mock_structure_fold(F.col("__s"))
    out = out.withColumn("plddt_mean", F.when(ok, fold["plddt_mean"])).withColumn("ptm", F.when(ok, fold["ptm"]))
    sz, _ = R.structure_z(F.col("plddt_mean"), F.col("ptm"), F.lit(None).cast("double"))
    out = out.withColumn("naturalness_z", F.when(ok, R.z_value(F.col("naturalness_score"), *naturalness_stats)))
    out = out.withColumn("cas13_identity_z", F.when(ok, R.z_value(F.col("cas13_identity_score"), 0.5, 0.25))).withColumn("structure_z", F.when(ok, sz))
    out = out.withColumn("hepn_position_score", S.motif_position_score(F.size("hard.motif_positions")))
    out = out.withColumn("penalty", F.when(ok & F.col("hard.low_complexity.is_low_complexity"), 0.25).otherwise(0.0))
    terms = {"naturalness": F.col("naturalness_z"), "cas13_identity": F.col("cas13_identity_z"), "structure": F.col("structure_z"), "hepn_position": F.col("hepn_position_score"), "diversity": F.coalesce(diversity, F.lit(0.0))}
    return out.withColumn("final_reward", R.weighted_sum(ok, terms, F.col("penalty"), weights)).drop("__s")


def compose_rewards(df: DataFrame, seq: Column, structure: Column, likelihood: Column, diversity: Column, min_len: int = 200, max_len: int = 1500, weights: dict[str, float] | None = None, scale: float = 1.0, invalid: float = -1.0, disabled_is_missing: bool = True, calibration: dict | None = None, center: int = 900, tolerance: int = 700) -> DataFrame:
    """Raw values, scores, the geometric-mean proportion and the reward, as columns beside df's.

    structure: struct with mean_plddt, ptm, mean_pae, valid, error; likelihood: struct with mean_logprob, perplexity, valid,
    error. Either may be null (missing). With disabled_is_missing a missing likelihood gets weight 0 instead of spoiling
    every row; without it, errors of a switched-off scorer make rows invalid."""
    w = R.checked_weights(weights or {})
    s = F.upper(S.text(seq))
    out = df.withColumn("sequence_length", F.length(s)).withColumn("__s", s).withColumn("__e", structure).withColumn("__l", likelihood)
    out = out.withColumn("invalid_reason", S.first_problem("__s", min_len, max_len))
    errors = S.joined(F.col("__e.error"), F.col("__l.error"))
    sc = R.reward_scores(F.col("__s"), F.col("__l.mean_logprob"), F.col("__e.mean_plddt"), F.col("__e.ptm"), F.col("__e.mean_pae"), diversity, calibration, center, tolerance)
    for k, v in sc.items():
        out = out.withColumn(f"score_{k}", v)
    named = {k: F.col(f"score_{k}") for k in sc}
    g = R.geometric_mean(named, w)
    if disabled_is_missing:
        g = F.when(F.col("__l").isNull(), R.geometric_mean(named, w | {"lm": 0.0})).otherwise(g)
    good = F.col("invalid_reason").isNull() & errors.isNull()
    out = out.withColumn("r_prop", F.when(good, g).otherwise(0.0)).withColumn("reward_for_rl", F.when(good, scale * (2 * F.col("r_prop") - 1)).otherwise(invalid))
    out = out.withColumn("valid", good & F.coalesce(F.col("__e.valid"), F.lit(True)) & F.coalesce(F.col("__l.valid"), F.lit(True)))
    return out.withColumn("error", S.joined(F.col("invalid_reason"), errors)).withColumn("raw_hepn_count", S.motif_count("__s")).drop("__s", "__e", "__l")


def gated(seq: Column, score: Callable[[Column], Column], lo: int = 200, hi: int = 1500) -> Column:
    """The scorer's struct for valid sequences; for others nulls, valid false and the reason. score's struct must have
    valid and error."""
    reason = S.first_problem(seq, lo, hi)
    row = score(F.when(reason.isNull(), F.upper(seq)))
    return F.when(reason.isNull(), row).otherwise(row.withField("valid", F.lit(False)).withField("error", reason))
