"""Queries that compare sequences position by position, and prompt assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import pairs as P
from ..operators.corpus import with_ordinal
from ..runtime import table
from ..sources.records import prompts
from .base import SQL_CANDIDATES, SQL_SPLITS, candidates, query, splits
from .scoring import SQL_DIV_PAIRS


@query(f"with {SQL_CANDIDATES}, {SQL_DIV_PAIRS} select id, round(diversity, 6) as diversity from dv")
def diversity_by_index(spark: SparkSession, d: str) -> DataFrame:
    return P.diversity_by_index(candidates(spark, d), "id", F.col("s")).select("id", F.round("diversity", 6).alias("diversity"))


@query(f"with {SQL_CANDIDATES}, {SQL_DIV_PAIRS} select dv.id, round(case when s = '' or by_value is null then 1.0 else greatest(1e-6::double, least(1::double, by_value)) end, 6) as diversity from dv join cand using (id)")
def diversity_by_value(spark: SparkSession, d: str) -> DataFrame:
    return P.diversity_by_value(candidates(spark, d), "id", F.col("s")).select("id", F.round("diversity", 6).alias("diversity"))


@query(f"""with {SQL_CANDIDATES}, q as (select id, s from cand where try_cast(regexp_extract(id, '[0-9]+$') as bigint) % 100 = 0), t as (select distinct upper(sequence) as t from train_seqs where sequence <> ''),
 p as (select q.id, coalesce(list_sum(list_transform(range(least(length(q.s), length(t.t))), lambda i: (q.s[i + 1] = t.t[i + 1])::int)) / greatest(length(q.s), length(t.t))::double, 0) as v from q cross join t)
 select q.id, round(coalesce(max(v), 0), 6) as nearest from q left join p using (id) group by q.id""")
def nearest_identity(spark: SparkSession, d: str) -> DataFrame:
    """Largest positional identity with any training sequence; queries are the candidates whose number is divisible by 100."""
    q = candidates(spark, d).filter(F.regexp_extract("id", "[0-9]+$", 0).try_cast("bigint") % 100 == 0)
    ref = table(spark, d, "train_seqs").select(F.upper("sequence").alias("s"))
    return P.nearest_identity(q, ref, "id", "s").select("id", F.round("nearest", 6).alias("nearest"))


@query(f"""with {SQL_CANDIDATES} select id, round(case when s = '' or prompt is null or prompt = '' then 0.0 else list_sum(list_transform(range(least(length(s), length(prompt))), lambda i: (s[i + 1] = prompt[i + 1])::int)) / greatest(length(s), length(prompt))::double end, 9) as identity from cand""")
def identity_with_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Positional identity of two columns."""
    return candidates(spark, d).select("id", F.round(S.positional_identity(S.letters(F.col("s")), S.letters(S.text("prompt"))), 9).alias("identity"))


@query(f"""with {SQL_CANDIDATES}, {SQL_SPLITS}, p as (select left(seq, 64) as prompt_text, row_number() over (order by id) - 1 as pos from splits where split = 'valid' and seq <> ''), c as (select id, row_number() over (order by id) - 1 as ord from cand)
 select c.id, p.prompt_text from c join p on p.pos = c.ord % (select count(*) from p)""")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Prompts assigned in turn."""
    v = splits(spark, d).filter("split = 'valid'").select("id", F.col("seq").alias("sequence"))
    p = with_ordinal(prompts(v, 64, ["id"]), ["id"], "pos").select("pos", F.col("prompt").alias("prompt_text"))
    return P.round_robin(with_ordinal(candidates(spark, d).select("id"), ["id"]), "ord", p, "pos").select("id", "prompt_text")


@query(f"with {SQL_SPLITS} select left(seq, 16) as prompt, id from splits where split = 'train' and seq <> '' order by id limit 25")
def prompt_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 prompts (a head report)."""
    t = splits(spark, d).filter("split = 'train'").select("id", F.col("seq").alias("sequence"))
    return prompts(t, 16, ["id"], 25)


@query(f"with {SQL_CANDIDATES} select id, starts_with(regexp_replace(s, '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g'), regexp_replace(upper(coalesce(prompt, '')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')) as has_prompt from cand")
def prompt_containment(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("id", S.clean("s").startswith(S.clean("prompt")).alias("has_prompt"))
