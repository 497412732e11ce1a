"""Scoring queries: hard filters, scorers, rewards, cache, gating, rankings and loop arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rewards as R
from ..functions import sequence as S
from ..operators import pairs as P
from ..operators import policy as L
from ..operators import scoring as O
from ..runtime import table
from .base import AA, SQL_CANDIDATES, SQL_FRACTION, SQL_PROBLEM, SQL_RECORDS, SQL_RUN, candidates, query, records, splits, sql_canonical, sql_count, sql_motifs, sql_validity

POSITIONS = "list_transform(range(len(parts) - 1), lambda i: (list_sum(list_transform(parts[1:i + 1], lambda x: length(x))) + 6 * i)::int)"
SQL_HARD = f"""{SQL_CANDIDATES}, m as (select *, length(s)::int as n, {sql_canonical('s')} as ok, string_split_regex(s, 'R[A-Z]{{4}}H') as parts, {SQL_FRACTION} as frac, {SQL_RUN} as run,
 array_to_string(list_sort(list_distinct(string_split(regexp_replace(s, '[{AA}]', '', 'g'), ''))), '') as bad from cand),
 m2 as (select *, case when s <> '' and ok then len(parts) - 1 else 0 end::int as motifs, case when s <> '' and ok then {POSITIONS} else [] end as starts from m),
 hard as (select *, list_filter([case when s = '' then 'empty_sequence' end, case when regexp_matches(s, '\\s') then 'contains_whitespace' end, case when bad <> '' then 'invalid_alphabet:' || bad end,
 case when not n between 800 and 1400 then 'length_out_of_range:' || n || ' not in [800,1400]' end, case when motifs <> 2 then 'hepn_count:' || motifs end,
 case when frac > 0.2::double then 'low_complexity:max_aa_fraction>0.2' end, case when run >= 8 then 'low_complexity:max_run>=8' end], lambda x: x is not null) as reasons from m2)"""


@query(f"with {SQL_HARD} select id, len(reasons) = 0 as passed, array_to_string(reasons, '|') as reasons, array_to_string(starts, ',') as positions, n as length, round(frac, 9) as fraction, run from hard")
def hard_filter(spark: SparkSession, d: str) -> DataFrame:
    """All failing reasons, motif positions and complexity measures."""
    t = candidates(spark, d).select("id", S.hard_filter("s").alias("h"))
    return t.select("id", F.col("h.passed").alias("passed"), F.array_join("h.reasons", "|").alias("reasons"), F.array_join("h.motif_positions", ",").alias("positions"), F.col("h.length").alias("length"), F.round("h.low_complexity.max_aa_fraction", 9).alias("fraction"), F.col("h.low_complexity.max_run").alias("run"))


@query(f"with {SQL_HARD}, e as (select unnest(reasons) as reason from hard) select reason, count(*) as n from e group by reason")
def reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select(F.explode(S.hard_filter("s")["reasons"]).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""with {SQL_CANDIDATES} select id, round(frac, 9) as fraction, run, motifs, motif_score, position_score, round(validity, 9) as validity from (select id, {SQL_FRACTION} as frac, {SQL_RUN} as run, {sql_motifs('s')}::int as motifs,
 case when {sql_motifs('s')} >= 2 then 1.0 when {sql_motifs('s')} = 1 then 0.5 else 0.0 end::double as motif_score, case when {sql_motifs('s')} = 2 then 1.0 when {sql_motifs('s')} = 1 then -0.5 else -1.0 end::double as position_score,
 {sql_validity('s')} as validity from cand)""")
def sequence_measures(spark: SparkSession, d: str) -> DataFrame:
    n = S.motif_count("s")
    return candidates(spark, d).select("id", F.round(S.max_fraction(F.col("s")), 9).alias("fraction"), S.max_run(F.col("s")).alias("run"), n.alias("motifs"), S.motif_score(n).alias("motif_score"), S.motif_position_score(n).alias("position_score"), F.round(S.validity_score("s"), 9).alias("validity"))


FREQ = ", ".join(f"{sql_count('s', x)} / greatest(length(s), 1)::double" for x in AA)


@query(f"""with {SQL_CANDIDATES}, f as (select id, [length(s)::double, (case when {sql_canonical('s')} then {sql_motifs('s')} else 0 end)::double, {FREQ}, {SQL_FRACTION}, {SQL_RUN}::double] as x from cand),
 e as (select id, unnest(range(24))::int as k, unnest(x) as v from f) select id, k, round(v, 9) as v from e""")
def feature_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The 24 features of each candidate, one row a feature."""
    return candidates(spark, d).select("id", F.posexplode(S.features("s")).alias("k", "v")).select("id", "k", F.round("v", 9).alias("v"))


WEIGHTS = [((i * 37) % 11 - 5) / 10 for i in range(24)]
SQL_W = "[" + ", ".join(f"{w}::double" for w in WEIGHTS) + "]"


@query(f"""with {SQL_CANDIDATES}, f as (select id, [length(s) / 1000.0::double, (case when {sql_canonical('s')} then {sql_motifs('s')} else 0 end)::double, {FREQ}, {SQL_FRACTION}, {SQL_RUN} / 10.0::double] as x from cand)
 select id, round(1 / (1 + exp(-(list_sum(list_transform(range(24), lambda i: x[i + 1] * {SQL_W}[i + 1])) + 0.25::double))), 6) as p from f""")
def identity_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Probability of a logistic model over the features (length and run scaled)."""
    x = F.transform(S.features("s"), lambda v, i: F.when(i == 0, v / 1000).when(i == 23, v / 10).otherwise(v))
    return candidates(spark, d).select("id", F.round(O.linear_classifier(x, WEIGHTS, 0.25), 6).alias("p"))


@query(f"""with {SQL_CANDIDATES}, b as (select *, length(s) as n, case when contains(s, 'R') and contains(s, 'H') then 8.0 else 0.0 end::double as b1, case when {sql_count('s', 'R')} >= 2 and {sql_count('s', 'H')} >= 2 then 0.08 else 0.0 end::double as b2,
 greatest(0, 1 - abs(length(s) - 1000) / 1000.0::double) as near2, greatest(0, 1 - abs(length(s) - 950) / 950.0::double) as near3, s <> '' and {sql_canonical('s')} as ok,
 case when contains(s, 'RAAAAH') and contains(s, 'RCCCCH') then 8.0 else 0.0 end::double as b3 from cand), p as (select *, greatest(1, least(95, 62 + b1 - least(20, abs(n - 900) / 50.0::double))) as pl from b)
 select id, round(pl, 6) as basic_plddt, round(greatest(0.05::double, least(0.9::double, pl / 100 - 0.08::double)), 6) as basic_ptm, round(greatest(2, 30 - pl / 4), 6) as basic_pae,
 round(least(95, 55 + 30 * near2 + b2 * 50), 6) as fold_plddt, round(least(0.9::double, 0.35::double + 0.45::double * near2 + b2), 6) as fold_ptm,
 case when ok then round(55 + 25 * near3 + b3, 6) end as probe_plddt, case when ok then round(least(0.9::double, 0.25::double + 0.55::double * near3), 6) end as probe_ptm, case when ok then round(greatest(4, 24 - 16 * near3), 6) end as probe_pae from p""")
def mock_structure(spark: SparkSession, d: str) -> DataFrame:
    """The three built-in structure scorers."""
    t = candidates(spark, d).select("id", *[O.scorer("structure", m)(F.col("s")).alias(m) for m in ("basic", "mock", "probe")])
    r = lambda c, n: F.round(c, 6).alias(n)
    return t.select("id", r("basic.mean_plddt", "basic_plddt"), r("basic.ptm", "basic_ptm"), r("basic.mean_pae", "basic_pae"), r("mock.plddt_mean", "fold_plddt"), r("mock.ptm", "fold_ptm"), r("probe.mean_plddt", "probe_plddt"), r("probe.ptm", "probe_ptm"), r("probe.mean_pae", "probe_pae"))


@query(f"""with {SQL_CANDIDATES}, b as (select *, length(s) as n, {sql_count('s', 'WCM')} / greatest(1, length(s))::double as rare, {sql_count('s', 'FWY')} / greatest(1, length(s))::double as arom, s <> '' and {sql_canonical('s')} as ok from cand)
 select id, round(-1.8::double - rare, 6) as basic_logprob, round(exp(1.8::double + rare), 6) as basic_ppl, round(-2.0::double - rare - abs(n - 1000) / 5000.0::double, 6) as natural_ll,
 round(pow(2.718281828::double, 2.0::double + rare + abs(n - 1000) / 5000.0::double), 6) as natural_ppl, case when ok then round(-1.4::double - rare, 6) end as probe_logprob,
 case when ok then round(pow(2.718281828::double, 1.4::double + rare), 6) end as probe_ppl, round(-2.0::double + arom - abs(n - 1000) / 5000.0::double, 6) as aromatic from b""")
def mock_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """The four built-in likelihood scorers."""
    t = candidates(spark, d).select("id", *[O.scorer("likelihood", m)(F.col("s")).alias(m) for m in ("basic", "mock", "probe", "aromatic")])
    r = lambda c, n: F.round(c, 6).alias(n)
    return t.select("id", r("basic.mean_logprob", "basic_logprob"), r("basic.perplexity", "basic_ppl"), r("mock.mean_log_likelihood", "natural_ll"), r("mock.ppl", "natural_ppl"), r("probe.mean_logprob", "probe_logprob"), r("probe.perplexity", "probe_ppl"), r("aromatic", "aromatic"))


@query(f"""with {SQL_CANDIDATES}, b as (select id, s, length(s) as n, {sql_validity('s')} as v, case when {sql_motifs('s')} >= 2 then 1.0 when {sql_motifs('s')} = 1 then 0.5 else 0.0 end::double as m,
 (case when {sql_canonical('s')} then {sql_motifs('s')} else 0 end) as k from cand) select id, round(greatest(1, n / 100.0::double) - m, 6) as nll, round(50 + 30 * v + 10 * m, 6) as plddt,
 case when k = 2 and n between 800 and 1400 then 0.9 when k = 1 then 0.45 when k = 2 then 0.65 else 0.1 end::double as identity from b""")
def mock_combined(spark: SparkSession, d: str) -> DataFrame:
    """The combined scorer and the identity tiers."""
    t = candidates(spark, d).select("id", O.scorer("combined", "mock")(F.col("s")).alias("c"), O.scorer("identity", "mock")(F.col("s")).alias("identity"))
    return t.select("id", F.round("c.progen3_nll", 6).alias("nll"), F.round("c.mean_plddt", 6).alias("plddt"), "identity")


def _ramp(x: str, lo: float, hi: float, down: bool = False) -> str:
    top = f"({hi}::double - {x})" if down else f"({x} - {lo}::double)"
    return f"coalesce(greatest(1e-6::double, least(1::double, {top} / {hi - lo}::double)), 1e-6::double)"


@query(f"""select event_id, round({_ramp('value', 0.0, 50.0)}, 9) as up, round({_ramp('value', 5.0, 25.0, True)}, 9) as down, round(greatest(1e-6::double, least(1::double, 1 - abs(user_id - 900) / 700.0::double)), 9) as centered,
 round(greatest(-3::double, least(3::double, coalesce((value - 70.0::double) / 10.0::double, 0))), 9) as z from events""")
def reward_transforms(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    r = lambda c: F.round(c, 9)
    return table(spark, d, "events").select("event_id", r(R.ramp_up(v, 0.0, 50.0)).alias("up"), r(R.ramp_down(v, 5.0, 25.0)).alias("down"), r(R.centered_length(F.col("user_id"), 900, 700)).alias("centered"), r(R.z_value(v, 70.0, 10.0)).alias("z"))


SQL_GEO = f"""{SQL_CANDIDATES}, b as (select *, length(s) as n, {SQL_PROBLEM} as reason, {sql_count('s', 'WCM')} / greatest(1, length(s))::double as rare, case when contains(s, 'R') and contains(s, 'H') then 8.0 else 0.0 end::double as b1,
 case when {sql_motifs('s')} >= 2 then 1.0 when {sql_motifs('s')} = 1 then 0.5 else 1e-6 end::double as hepn from cand), p as (select *, -1.8::double - rare as lm, greatest(1, least(95, 62 + b1 - least(20, abs(n - 900) / 50.0::double))) as pl from b),
 q as (select *, greatest(0.05::double, least(0.9::double, pl / 100 - 0.08::double)) as ptm from p),
 sc as (select *, {_ramp('lm', -5.0, -0.5)} as s_lm, {_ramp('pl', 50.0, 90.0)} as s_pl, {_ramp('ptm', 0.2, 0.8)} as s_ptm, greatest(1e-6::double, least(1::double, 1 - abs(n - 900) / 700.0::double)) as s_len from q),
 geo as (select *, case when reason is null then greatest(1e-6::double, least(1::double, exp((ln(s_lm) + ln(s_pl) + ln(s_ptm) + 0.5::double * ln(hepn) + 0.5::double * ln(s_len)) / 4.0::double))) else 0.0 end as r_prop from sc)"""


def _composed(spark: SparkSession, d: str) -> DataFrame:
    t = candidates(spark, d)
    none = F.lit(None).cast("string")  # the scorers' own complaint about empty texts is the gate's already
    t = t.withColumn("e", R.mock_structure_basic(F.col("s")).withField("error", none)).withColumn("l", R.mock_likelihood_basic(F.col("s")).withField("error", none))
    return O.compose_rewards(t, F.col("s"), F.col("e"), F.col("l"), F.lit(1.0))


@query(f"with {SQL_GEO} select id, reason as invalid_reason, round(s_lm, 6) as score_lm, round(s_pl, 6) as score_plddt, round(s_ptm, 6) as score_ptm, round(hepn, 6) as score_hepn, round(s_len, 6) as score_length, round(r_prop, 6) as r_prop, round(case when reason is null then 2 * r_prop - 1 else -1.0 end, 6) as reward, reason is null as valid from geo")
def reward_geomean(spark: SparkSession, d: str) -> DataFrame:
    """The geometric-mean reward over the basic scorers."""
    r = lambda c: F.round(c, 6).alias(c)
    return _composed(spark, d).select("id", "invalid_reason", *[r(f"score_{k}") for k in ("lm", "plddt", "ptm", "hepn", "length")], r("r_prop"), F.round("reward_for_rl", 6).alias("reward"), "valid")


@query(f"""with {SQL_GEO} select id, round(case when reason is null then 2 * greatest(1e-6::double, least(1::double, exp((ln(s_pl) + ln(hepn) + 0.5::double * ln(s_len)) / 2.5::double))) - 1 else -1.0 end, 6) as reward from geo""")
def reward_old_weights(spark: SparkSession, d: str) -> DataFrame:
    """The same reward under the older weight names, likelihood switched off."""
    t = candidates(spark, d).withColumn("e", R.mock_structure_basic(F.col("s")).withField("error", F.lit(None).cast("string")))
    w = R.from_old_weights({"w_pg3": 0.0, "w_struct": 1.0, "w_motif": 1.0, "w_valid": 0.5})
    none = F.lit(None).cast("struct<mean_logprob:double,perplexity:double,valid:boolean,error:string>")
    return O.compose_rewards(t, F.col("s"), F.col("e"), none, F.lit(1.0), weights=w).select("id", F.round("reward_for_rl", 6).alias("reward"))


SQL_DIV_PAIRS = """pr as (select a.id, 1 - list_sum(list_transform(range(least(length(a.s), length(b.s))), lambda i: (a.s[i + 1] = b.s[i + 1])::int)) / greatest(length(a.s), length(b.s), 1)::double as v, a.s <> b.s as differ from cand a join cand b on a.id <> b.id),
 dv as (select cand.id, coalesce(avg(coalesce(v, 1)), 0) as diversity, avg(coalesce(v, 1)) filter (where differ) as by_value from cand left join pr using (id) group by cand.id)"""

SQL_SCORED = f"""{SQL_HARD}, {SQL_DIV_PAIRS}, sc as (select hard.*, dv.diversity, len(reasons) = 0 as passed, -2.0::double - {sql_count('s', 'WCM')} / greatest(1, n)::double - abs(n - 1000) / 5000.0::double as nat,
 case when motifs = 2 and n between 800 and 1400 then 0.9 when motifs = 1 then 0.45 when motifs = 2 then 0.65 else 0.1 end::double as ident, greatest(0, 1 - abs(n - 1000) / 1000.0::double) as near,
 case when {sql_count('s', 'R')} >= 2 and {sql_count('s', 'H')} >= 2 then 0.08 else 0.0 end::double as b2 from hard join dv using (id)),
 z as (select *, least(95, 55 + 30 * near + b2 * 50) as pl, least(0.9::double, 0.35::double + 0.45::double * near + b2) as ptm from sc),
 zz as (select *, greatest(-3::double, least(3::double, (ident - 0.5::double) / 0.25::double)) as iz, (greatest(-3::double, least(3::double, (pl - 70) / 10.0::double)) + greatest(-3::double, least(3::double, (ptm - 0.5::double) / 0.15::double))) / 2 as sz from z),
 scored as (select *, case when passed then greatest(-5::double, least(5::double, 0.25::double * iz + 0.25::double * sz + 0.15::double * (case when motifs = 2 then 1.0 when motifs = 1 then -0.5 else -1.0 end::double) + 0.15::double * diversity)) else -10.0 end as final_reward from zz)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    t = candidates(spark, d)
    div = P.diversity_by_index(t, "id", F.col("s"))
    return O.score_candidates(t.join(div, "id"), F.col("s"), F.col("diversity"))


@query(f"with {SQL_SCORED} select id, passed, case when passed then round(nat, 6) end as naturalness, case when passed then ident end as identity, case when passed then round(iz, 6) end as identity_z, case when passed then round(sz, 6) end as structure_z, round(diversity, 6) as diversity, round(final_reward, 6) as final_reward from scored")
def reward_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Hard filters, scorers, diversity and the weighted-sum reward."""
    r = lambda c, n: F.round(c, 6).alias(n)
    return _scored(spark, d).select("id", F.col("hard.passed").alias("passed"), r("naturalness_score", "naturalness"), F.col("cas13_identity_score").alias("identity"), r("cas13_identity_z", "identity_z"), r("structure_z", "structure_z"), r("diversity", "diversity"), r("final_reward", "final_reward"))


@query(f"with {SQL_SCORED} select count(*) as total, count(*) filter (where passed) as passed, count(*) filter (where not passed) as failed, round(avg(final_reward), 6) as mean_reward from scored")
def filter_totals(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("hard.passed")
    return _scored(spark, d).agg(F.count("*").alias("total"), F.count_if(p).alias("passed"), F.count_if(~p).alias("failed"), F.round(F.avg("final_reward"), 6).alias("mean_reward"))


@query(f"with {SQL_GEO}, w as (select id, round(case when reason is null then 2 * r_prop - 1 else -1.0 end, 6) as reward from geo) select id, reward from w order by reward desc, id limit 10")
def top10_by_reward(spark: SparkSession, d: str) -> DataFrame:
    """The 10 best (a top-k report), ties by id."""
    return reward_geomean(spark, d).select("id", "reward").orderBy(F.desc("reward"), "id").limit(10)


@query(f"with {SQL_GEO}, r as (select step, case when reason is null then 2 * r_prop - 1 else -1.0 end as reward, reason is null as valid from geo) select step, round(avg(reward), 6) as reward_mean, round(avg(valid::int), 9) as valid_rate, count(*) as batch_size from r group by step")
def reward_step_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _composed(spark, d).groupBy("step").agg(F.round(F.avg("reward_for_rl"), 6).alias("reward_mean"), F.round(F.avg(F.col("valid").cast("double")), 9).alias("valid_rate"), F.count("*").alias("batch_size"))


# Cache, gate, zip

SQL_CACHE = f"cache as (select distinct upper(sequence) as seq, sha256(upper(sequence)) as k, length(sequence)::double / 1000 as cached from train_seqs where sequence is not null), w as (select id, s, sha256(s) as k from cand)"


def _cache(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "train_seqs").filter("sequence is not null").select(F.upper("sequence").alias("s")).distinct()
    return t.select(S.content_hash("s").alias("key"), (F.length("s") / 1000).alias("score"))


def _cached(spark: SparkSession, d: str):
    t = candidates(spark, d).withColumn("k", S.content_hash("s"))
    return O.cached_scores(t, "k", _cache(spark, d), "key", ["score"], lambda m: m.withColumn("score", F.length("s") / F.lit(1000.0)))


@query(f"with {SQL_CANDIDATES}, {SQL_CACHE} select id, round(cached, 6) as score from w join cache using (k)")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    return _cached(spark, d)[0].filter("cache_hit").select("id", F.round("score", 6).alias("score"))


@query(f"with {SQL_CANDIDATES}, {SQL_CACHE} select distinct k as key, round(length(s) / 1000.0::double, 6) as score from w where k not in (select k from cache)")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """The new rows for the cache: each missing key once."""
    return _cached(spark, d)[1].select("key", F.round("score", 6).alias("score"))


@query(f"with {SQL_CANDIDATES}, {SQL_CACHE} select id, round(coalesce(cached, length(s) / 1000.0::double), 6) as score, cached is not null as cache_hit from w left join cache using (k)")
def cache_fill(spark: SparkSession, d: str) -> DataFrame:
    return _cached(spark, d)[0].select("id", F.round("score", 6).alias("score"), "cache_hit")


@query(f"with {SQL_RECORDS} select id, sha256(sha256(s) || '|likelihood:mock|v1|' || '{O.config_hash({'scorer': 'mock'})}') as key from recs")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("id", S.cache_key("s", "likelihood:mock", "v1", O.config_hash({"scorer": "mock"})).alias("key"))


@query("with l as (select sequence as s, max_by(id, struct_pack(a := loaded_at, b := id)) as id from train_seqs where sequence is not null and id is not null group by 1) select sha256(s) as key, id from l")
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Append-only writes, read as the latest row of each key."""
    t = table(spark, d, "train_seqs").filter("sequence is not null and id is not null")
    log = t.select(S.content_hash("sequence").alias("key"), F.struct("loaded_at", "id").alias("created_at"), "id")
    return O.latest(log).select("key", "id")


@query(f"with {SQL_CANDIDATES}, b as (select id, s, {SQL_PROBLEM} as reason, {sql_count('s', 'WCM')} / greatest(1, length(s))::double as rare from cand) select id, reason is null as valid, reason as error, case when reason is null then round(-1.8::double - rare, 6) end as mean_logprob from b")
def gate_scatter(spark: SparkSession, d: str) -> DataFrame:
    """Only valid sequences are scored; the others get the reason."""
    t = candidates(spark, d).select("id", O.gated(F.col("s"), R.mock_likelihood_basic).alias("l"))
    return t.select("id", F.col("l.valid").alias("valid"), F.col("l.error").alias("error"), F.round("l.mean_logprob", 6).alias("mean_logprob"))


@query(f"""with {SQL_CANDIDATES}, o as (select id, row_number() over (order by id) - 1 as ord from cand), k as (select row_number() over (order by id) - 1 as ord, length(seq) as n from (select id, coalesce(sequence, '') as seq,
 row_number() over (partition by id order by loaded_at) as rn from valid_seqs where id is not null) where rn = 1) select id, coalesce(n, 0)::int as n from o left join k using (ord)""")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """Candidates zipped by ordinal with the validation records; what the shorter side lacks is 0."""
    from ..operators.corpus import with_ordinal

    o = with_ordinal(candidates(spark, d).select("id"), ["id"])
    k = with_ordinal(splits(spark, d).filter("split = 'valid'").select("id", F.length("seq").alias("n")), ["id"]).select("ord", "n")
    return o.join(k, "ord", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


COUNTER = """import sys, json
rows = [json.loads(x) for x in sys.stdin]
for r in reversed(rows):
    if len(r["sequence"]) > 2:
        print(json.dumps({"sequence": r["sequence"], "score": len(r["sequence"]), "cysteines": r["sequence"].count("C")}))
"""


@query(f"with {SQL_CANDIDATES} select id, case when length(s) > 2 then length(s)::double end as score, case when length(s) > 2 then {sql_count('s', 'C')}::int end as cysteines, case when length(s) <= 2 then 'no result' end as error from cand")
def command_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a program that reverses its rows and drops the short ones; results are matched by sequence."""
    out = O.external_scores(candidates(spark, d).select("id", "s"), "s", O.command_scorer(["python3", "-c", COUNTER]), "score double, cysteines int")
    return out.select("id", "score", "cysteines", "error")


def _strict(texts: list[str]) -> list[dict]:
    if any(len(x) % 7 == 3 for x in texts):
        raise ValueError("a length of the kind that fails")
    return [{"score": float(len(x))} for x in texts]


@query(f"with {SQL_CANDIDATES} select id, case when length(s) % 7 <> 3 then length(s)::double end as score, case when length(s) % 7 = 3 then 'ValueError: a length of the kind that fails' end as error from cand")
def isolated_scores(spark: SparkSession, d: str) -> DataFrame:
    """A model that fails on some texts costs those rows alone, whatever batch they are in."""
    return O.external_scores(candidates(spark, d).select("id", "s"), "s", _strict, "score double", batch=16).select("id", "score", "error")


@query("select coalesce(max(step), 0)::int as step from candidates")
def resume_cursor(spark: SparkSession, d: str) -> DataFrame:
    """The step a loop goes on from: the last one logged."""
    return spark.createDataFrame([(L.resume_step(table(spark, d, "candidates")),)], "step int")


# Loop arithmetic


@query("with m as (select *, avg(value) over (partition by event_type) as mu, stddev_pop(value) over (partition by event_type) as sd, count(*) over (partition by event_type) as n from events) select event_id, round(case when sd < 1e-8 then 0.0 else (value - mu) / sd end, 6) as z from m")
def batch_zscore(spark: SparkSession, d: str) -> DataFrame:
    return L.z_scores(table(spark, d, "events"), "event_type", "value").select("event_id", F.round("z", 6).alias("z"))


@query("with m as (select *, avg(value) over (partition by user_id) as mu, stddev_pop(value) over (partition by user_id) as sd, count(*) over (partition by user_id) as n from events) select event_id, round(case when n > 1 and sd > 1e-8 then (value - mu) / sd else value - mu end, 6) as advantage from m")
def advantage(spark: SparkSession, d: str) -> DataFrame:
    return L.advantages(table(spark, d, "events"), "user_id", "value").select("event_id", F.round("advantage", 6).alias("advantage"))


@query("""with e as (select event_id, event_type, value, sin(event_id)::double as old, sin(event_id) + value / 1000 as new, cos(event_id) as ref, (event_id % 50 + 1)::int as tokens from events),
 a as (select *, (new - ref) / greatest(tokens, 1) as kl, value - avg(value) over (partition by event_type) as adv, exp(greatest(-20, least(20, new - old))) as ratio from e)
 select event_type, round(-avg(least(ratio * adv, greatest(0.8::double, least(1.2::double, ratio)) * adv)), 4) as policy_loss, round(avg(kl), 6) as kl, round(avg(value - 0.02::double * kl), 4) as reward from a group by 1""")
def clipped_surrogate(spark: SparkSession, d: str) -> DataFrame:
    """Divergence per token, rewards less divergence, and the clipped loss."""
    e = table(spark, d, "events").select("event_id", "event_type", "value", F.sin("event_id").alias("old"), (F.sin("event_id") + F.col("value") / 1000).alias("new"), F.cos("event_id").alias("ref"), (F.col("event_id") % 50 + 1).alias("tokens"))
    mean = e.groupBy("event_type").agg(F.avg("value").alias("mu"))
    a = e.join(F.broadcast(mean), "event_type").withColumn("kl", L.token_kl(F.col("new"), F.col("ref"), F.col("tokens")))  # one row a type
    term = L.surrogate(F.col("new"), F.col("old"), F.col("value") - F.col("mu"))
    return a.groupBy("event_type").agg(F.round(-F.avg(term), 4).alias("policy_loss"), F.round(F.avg("kl"), 6).alias("kl"), F.round(F.avg(F.col("value") - 0.02 * F.col("kl")), 4).alias("reward"))


@query(f"with {SQL_RECORDS}, n as (select count(*) as n from recs) select n, ceil(n * 2 / 8.0)::bigint as steps, round(exp(1.5::double), 6) as ppl, 'inf'::double as ppl_beyond from n")
def training_steps(spark: SparkSession, d: str) -> DataFrame:
    n = records(spark, d).agg(F.count("*").alias("n"))
    return n.select("n", R.steps(F.col("n"), 2, 1, 8, 1).alias("steps"), F.round(R.perplexity(F.lit(1.5)), 6).alias("ppl"), R.perplexity(F.lit(20.0)).alias("ppl_beyond"))


@query(f"""with {SQL_CANDIDATES} select id, case when {sql_count('s', 'K')} > 60 then 'eos' when length(s) >= 900 then 'max_new_tokens' else 'other' end as stop_reason from cand""")
def stop_reasons(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("id", S.stop_reason(S.letter_count(F.col("s"), "K") > 60, F.length("s"), 900).alias("stop_reason"))
