"""Summary queries: percentiles, bins, frequencies, rates, audits and metric summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import tokens as T
from ..operators import stats as A
from ..runtime import table
from .base import SQL_CANDIDATES, SQL_KEYWORD, SQL_RECORDS, SQL_SPLITS, candidates, keyword, query, records, splits, sql_canonical, sql_clean
from .corpus import SUMMARY_SQL


@query("""with o as (select row_id, case when len(cas) > 0 then cas else cas_genes end as g from crispr_cas_atlas), e as (select unnest(g) as x from o)
 select (select count(*) from o) as operons, (select coalesce(sum(len(g)), 0)::bigint from o) as total_entries, (select count(*) from e where x is not null) as gene_objects,
 (select count(*) from e where x is not null and coalesce(x.protein, '') <> '') as with_protein""")
def operon_counters(spark: SparkSession, d: str) -> DataFrame:
    """Operons, array entries, gene objects, gene objects with a protein: sizes and filters within the row, no explode."""
    from ..operators.nested import first_filled

    t = table(spark, d, "crispr_cas_atlas").select(first_filled(F.col("cas"), F.col("cas_genes")).alias("g"))
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("bigint")
    size = lambda c: F.when(c.isNotNull(), F.size(c))
    return t.agg(
        F.count("*").alias("operons"), n(size(F.col("g"))).alias("total_entries"), n(size(F.filter("g", lambda x: x.isNotNull()))).alias("gene_objects"),
        n(size(F.filter("g", lambda x: x.isNotNull() & (S.text(x["protein"]) != "")))).alias("with_protein"),
    )


@query("select summary.subtype as value, count(*) as n from crispr_cas_atlas group by 1 order by n desc, min(row_id) limit 20")
def top_subtypes(spark: SparkSession, d: str) -> DataFrame:
    """The 20 most frequent subtypes; null is a value; ties by first appearance (a top-k report)."""
    return A.top_values(table(spark, d, "crispr_cas_atlas").select("row_id", F.col("summary.subtype").alias("v")), F.col("v"), ["row_id"])


@query("""with p as (select payload from atlas_raw where json_valid(payload) and json_type(payload) = 'OBJECT'), k as (select unnest(json_keys(payload)) as key from p)
 select key, count(*) as n from k group by key""")
def key_frequency(spark: SparkSession, d: str) -> DataFrame:
    """How often each key occurs at the root of the payloads that are objects."""
    v = table(spark, d, "atlas_raw").select(F.try_parse_json("payload").alias("v"), F.json_object_keys("payload").alias("k")).filter("v is not null and startswith(schema_of_variant(v), 'OBJECT')")
    return v.select(F.explode("k").alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query(f"with {SQL_KEYWORD} select gene_name as value, count(*) as n from (select coalesce(gene_name, '') as gene_name, row_id, gene_index from kw where sequence <> '') group by 1 order by n desc, min(struct_pack(a := row_id, b := gene_index)) limit 20")
def top_gene_names(spark: SparkSession, d: str) -> DataFrame:
    rows = keyword(spark, d).filter("sequence <> ''").select(S.text("gene_name").alias("g"), "row_id", "gene_index")
    return A.top_values(rows, F.col("g"), ["row_id", "gene_index"])


@query(f"with {SQL_SPLITS}, x as (select split, length(seq) as length from splits) select split, count(*) as n, {SUMMARY_SQL} from x group by split")
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = splits(spark, d).groupBy("split").agg(F.count("*").alias("n"), *A.length_summary(F.length("seq")))
    return out.withColumn("len_mean", F.round("len_mean", 6))


BIN_SQL = "case when n < 200 then '0-200' when n < 500 then '200-500' when n < 850 then '500-850' when n < 1000 then '850-1000' when n < 1300 then '1000-1300' when n < 1500 then '1300-1500' else '1500+' end"


@query(f"""with {SQL_RECORDS}, c as (select {BIN_SQL} as bin, count(*) as n from (select length(s) as n from recs) group by 1), b(bin_ord, bin) as (values (0, '0-200'), (1, '200-500'), (2, '500-850'),
 (3, '850-1000'), (4, '1000-1300'), (5, '1300-1500'), (6, '1500+')) select b.bin_ord, b.bin, coalesce(c.n, 0) as n from b left join c using (bin)""")
def length_bins(spark: SparkSession, d: str) -> DataFrame:
    return A.length_bins(spark, records(spark, d).select("s"), F.length("s"))


@query(f"""with {SQL_CANDIDATES}, c as (select *, {sql_clean('raw')} as cleaned from cand) select count(*) as n, round(avg((raw <> '' and {sql_canonical('s')})::int), 9) as valid_rate,
 round(avg((length(cleaned) between 200 and 1500)::int), 9) as accepted_rate, count(*) filter (where length(cleaned) < 200) as too_short, count(*) filter (where length(cleaned) > 1500) as too_long,
 round(1 - count(distinct raw) / count(*), 9) as duplicate_rate, round(avg(starts_with(cleaned, {sql_clean('prompt')})::int), 9) as prompt_rate from c""")
def generation_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates over generated sequences, 0 without rows."""
    c = candidates(spark, d).withColumn("cleaned", S.clean("raw")).withColumn("n", F.length("cleaned"))
    r = lambda x: F.round(A.share(x), 9)
    return c.agg(
        F.count("*").alias("n"), r((F.col("raw") != "") & S.is_canonical("s")).alias("valid_rate"), r(F.col("n").between(200, 1500)).alias("accepted_rate"),
        F.count_if(F.col("n") < 200).alias("too_short"), F.count_if(F.col("n") > 1500).alias("too_long"),
        F.round(F.coalesce(1 - F.try_divide(F.count_distinct("raw"), F.count("*")), F.lit(0.0)), 9).alias("duplicate_rate"),
        r(F.col("cleaned").startswith(S.clean("prompt"))).alias("prompt_rate"),
    )


@query("select event_type as name, round(avg(value), 6) as mean, min(value) as min, max(value) as max from events where value is not null group by 1")
def metric_by_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))


@query("""with u as (select * from (select l_quantity::double as l_quantity, l_extendedprice::double as l_extendedprice, l_discount::double as l_discount, l_tax::double as l_tax, l_linenumber::double as l_linenumber,
 l_orderkey::double as l_orderkey, l_partkey::double as l_partkey, l_suppkey::double as l_suppkey from lineitem) unpivot (v for name in (l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, l_orderkey, l_partkey, l_suppkey)))
 select name, round(avg(v), 4) as mean, min(v) as min, max(v) as max from u group by name""")
def metric_min_mean_max(spark: SparkSession, d: str) -> DataFrame:
    """Mean, min and max of every numeric column."""
    t = table(spark, d, "lineitem")
    return A.metric_summary(t, A.numeric_columns(t)).withColumn("mean", F.round("mean", 4))


@query("""with s as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as k, count(*) over (partition by event_type) as n from events where value is not null)
 select event_type, max(case when k = round_even((n - 1) * 0.1::double, 0) then value end) as low, max(case when k = round_even((n - 1) * 0.9::double, 0) then value end) as high from s group by 1""")
def calibration_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank quantiles, ranks rounded half to even."""
    t = table(spark, d, "events")
    low, high = (A.nearest_rank(t, F.col("value"), q, ["event_type"]).withColumnRenamed("value", n) for q, n in ((0.1, "low"), (0.9, "high")))
    return low.join(high, "event_type")


@query("select round(avg(coalesce(value, 0)), 6) as mean, round(stddev_pop(coalesce(value, 0)), 6) as sd, round(var_pop(coalesce(value, 0)), 4) as var, count(*) as n from events")
def mean_std(spark: SparkSession, d: str) -> DataFrame:
    v = F.coalesce("value", F.lit(0.0))
    return table(spark, d, "events").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("sd"), F.round(F.var_pop(v), 4).alias("var"), F.count("*").alias("n"))


@query("select user_id as step, round(coalesce(sum(value), 0) / greatest(1, count(*)), 6) as value_mean, round(count(*) filter (where value > 0) / greatest(1, count(*)), 9) as positive_rate, count(*) as batch_size from events group by 1")
def step_metrics(spark: SparkSession, d: str) -> DataFrame:
    n = F.greatest(F.lit(1), F.count("*"))
    return table(spark, d, "events").groupBy(F.col("user_id").alias("step")).agg(
        F.round(F.coalesce(F.sum("value"), F.lit(0.0)) / n, 6).alias("value_mean"), F.round(F.count_if(F.col("value") > 0) / n, 9).alias("positive_rate"), F.count("*").alias("batch_size")
    )


TOKENS = "list_transform(case when seq = '' then [] else string_split(seq, '') end, lambda c: (case when instr('ACDEFGHIKLMNPQRSTVWY', c) > 0 then instr('ACDEFGHIKLMNPQRSTVWY', c) + 2 else 2 end)::int)"


@query(f"""with {SQL_SPLITS}, x as (select split, length(seq) as n, length(seq) + 1 as raw, least(length(seq) + 1, 512) as tok from splits)
 select split, count(*) as n, min(tok)::double as tok_min, quantile_cont(tok, 0.5) as tok_median, round(avg(tok), 6) as tok_mean, max(tok)::double as tok_max, count(*) filter (where raw > 512) as truncated,
 round(avg((raw > 512)::int), 9) as truncated_ratio, count(*) as eos_in_ids, count(*) as eos_in_labels, count(*) filter (where n between 850 and 1500) as in_target from x group by split""")
def split_audit(spark: SparkSession, d: str) -> DataFrame:
    """Token lengths, truncation, end tokens in ids and labels, and lengths in the target range, per split."""
    t = splits(spark, d).withColumn("e", T.example(F.col("seq"), 512))
    tok = F.col("e.tokenized_length")
    return t.groupBy("split").agg(
        F.count("*").alias("n"), F.min(tok).cast("double").alias("tok_min"), F.percentile(tok, F.lit(0.5)).alias("tok_median"), F.round(F.avg(tok), 6).alias("tok_mean"), F.max(tok).cast("double").alias("tok_max"),
        F.count_if(F.col("e.truncated")).alias("truncated"), F.round(A.share(F.col("e.truncated")), 9).alias("truncated_ratio"),
        F.count_if(F.col("e.has_eos")).alias("eos_in_ids"), F.count_if(F.array_contains("e.input_ids", T.EOS)).alias("eos_in_labels"), F.count_if(F.col("e.original_length").between(850, 1500)).alias("in_target"),
    )


@query(f"""with {SQL_SPLITS}, t as (select split, id, {TOKENS} as c, length(seq) as n from splits) select split, id, array_to_string(case when n + 1 > 512 then list_concat(c[1:511], [1]) else list_concat(c, [1]) end, ',') as ids,
 (n + 1)::int as raw_length, least(n + 1, 512)::int as n_tokens, n + 1 > 512 as truncated from t""")
def token_examples(spark: SparkSession, d: str) -> DataFrame:
    """Ids cut to 512 with the end token last."""
    t = splits(spark, d).withColumn("e", T.example(F.col("seq"), 512))
    return t.select("split", "id", F.array_join("e.input_ids", ",").alias("ids"), F.col("e.raw_tokenized_length").alias("raw_length"), F.col("e.tokenized_length").alias("n_tokens"), F.col("e.truncated").alias("truncated"))


@query(f"with {SQL_SPLITS} select split, id, regexp_replace(seq, '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') as decoded from splits")
def token_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Decoding skips what was unknown."""
    return splits(spark, d).select("split", "id", T.decode(T.encode(F.col("seq"))).alias("decoded"))


@query(f"""with {SQL_CANDIDATES}, t as (select id, step, length(s) + 1 as n, max(length(s) + 1) over (partition by step) as m from cand)
 select id, n::int as tokens, m::int as padded_to, (m - n)::int as n_ignored, n::int as attended from t""")
def pad_batch(spark: SparkSession, d: str) -> DataFrame:
    """Padding to the longest of the step; mask and labels agree with it."""
    t = candidates(spark, d).withColumn("e", T.encode(F.col("s")))
    ids, mask, labels = T.padded(F.col("e"), F.col("step"))
    t = t.select("id", F.size("e").alias("tokens"), ids.alias("ids"), mask.alias("mask"), labels.alias("labels"))
    return t.select("id", "tokens", F.size("ids").alias("padded_to"), F.size(F.filter("labels", lambda x: x == T.IGNORED)).alias("n_ignored"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("attended"))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: -abs(x::double)) as lp, list_transform(range(len(embedding)), lambda i: i >= vec_id % 60) as m from embeddings),
 r as (select vec_id, list_sum(list_transform(range(len(lp)), lambda i: case when m[i + 1] then lp[i + 1] else 0.0 end)) as total, greatest(1, len(list_filter(m, lambda x: x)))::int as tokens from e)
 select vec_id, round(total, 6) as total, tokens, round(-total / tokens, 6) as nll, round(case when -total / tokens < 20 then exp(-total / tokens) else 'inf'::double end, 6) as ppl from r""")
def masked_logprob(spark: SparkSession, d: str) -> DataFrame:
    """Masked sums over arrays of token values, mean and perplexity."""
    from ..functions.rewards import perplexity

    t = table(spark, d, "embeddings").withColumn("lp", F.transform("embedding", lambda x: -F.abs(x.cast("double")))).withColumn("m", F.transform("embedding", lambda _, i: i >= F.col("vec_id") % 60))
    t = t.withColumn("total", T.masked_sum(F.col("lp"), F.col("m"))).withColumn("tokens", T.masked_count(F.col("m")))
    nll = -F.col("total") / F.col("tokens")
    return t.select("vec_id", F.round("total", 6).alias("total"), "tokens", F.round(nll, 6).alias("nll"), F.round(perplexity(nll), 6).alias("ppl"))
