"""Corpus queries: filters over genes and operons, deduplication, groups of copies, ordinals, splits, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import corpus as C
from ..operators import stats as A
from ..runtime import table
from .base import AA, KEYWORD_FIELDS, SQL_GENES, SQL_KEYWORD, SQL_PROBLEM, SQL_RECORDS, SQL_SPLITS, genes, keyword, operons, query, records, splits, sql_canonical, sql_clean, sql_validity

SUMMARY_SQL = """coalesce(min(length), 0)::double as len_min, coalesce(quantile_cont(length, 0.05), 0)::double as len_p05, coalesce(quantile_cont(length, 0.25), 0)::double as len_p25,
 coalesce(quantile_cont(length, 0.5), 0)::double as len_median, coalesce(quantile_cont(length, 0.75), 0)::double as len_p75, coalesce(quantile_cont(length, 0.95), 0)::double as len_p95,
 round(coalesce(avg(length), 0), 6) as len_mean, coalesce(max(length), 0)::double as len_max"""


def _summary(df: DataFrame, n) -> DataFrame:
    return df.agg(F.count("*").alias("n"), *A.length_summary(n)).withColumn("len_mean", F.round("len_mean", 6))


@query(f"""with {SQL_RECORDS}, one as (select length(s) as length from (select s, row_number() over (partition by h order by loaded_at, id) as k from recs
 where length(s) between 200 and 1500) where k = 1) select count(*) as n, {SUMMARY_SQL} from one""")
def clean_dedup_summary(spark: SparkSession, d: str) -> DataFrame:
    """Clean, hash, keep 200 to 1500, first of each hash, summary of lengths."""
    kept = records(spark, d).withColumn("n", F.length("s")).filter(F.col("n").between(200, 1500)).select("h", "n", "loaded_at", "id")
    return _summary(C.first_wins(kept, ["h"], ["loaded_at", "id"]), F.col("n"))


@query(f"with {SQL_KEYWORD} select row_id, gene_index, gene_name, hmm_name from kw")
def keyword_filter(spark: SparkSession, d: str) -> DataFrame:
    return keyword(spark, d).select("row_id", "gene_index", "gene_name", "hmm_name")


@query("""select row_id, summary.subtype as subtype, summary.subtype_score as subtype_score from crispr_cas_atlas
 where starts_with(upper(trim(coalesce(summary.subtype, ''), chr(9) || chr(10) || chr(13) || ' ')), 'VI') or starts_with(upper(trim(coalesce(summary.subtype_score, ''), chr(9) || chr(10) || chr(13) || ' ')), 'VI')""")
def prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "crispr_cas_atlas").select("row_id", F.col("summary.subtype").alias("subtype"), F.col("summary.subtype_score").alias("subtype_score"))
    return t.filter(S.starts_with_type("subtype", "subtype_score"))


ANNOTATIONS = ("gene_name", "hmm_name", "product", "annotation")
ANY9 = " or ".join(f"contains(lower(coalesce(gene.{f}, '')), 'cas9')" for f in ANNOTATIONS)


@query(f"with {SQL_GENES} select row_id, gene_index, gene.gene_name as gene_name from genes where {ANY9}")
def any_field_ci_filter(spark: SparkSession, d: str) -> DataFrame:
    g = genes(spark, d, *ANNOTATIONS)
    return g.filter(S.has_keyword_any_case("cas9", *[f"gene.{f}" for f in ANNOTATIONS])).select("row_id", "gene_index", F.col("gene.gene_name").alias("gene_name"))


@query(f"""with {SQL_GENES} select row_id, gene_index, summary.subtype as subtype, gene.gene_name as gene_name from genes
 where regexp_matches(upper(coalesce(summary.subtype, '')), '^II($|[-_])') and not ({ANY9}) order by row_id, gene_index limit 20""")
def subtype_without_keyword(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 genes of type II operons that don't name the keyword (a top-k report)."""
    g = genes(spark, d, *ANNOTATIONS).filter(F.upper(S.text("summary.subtype")).rlike("^II($|[-_])"))
    g = g.filter(~S.has_keyword_any_case("cas9", *[f"gene.{f}" for f in ANNOTATIONS]))
    return g.select("row_id", "gene_index", F.col("summary.subtype").alias("subtype"), F.col("gene.gene_name").alias("gene_name")).orderBy("row_id", "gene_index").limit(20)


@query(f"with {SQL_RECORDS} select id, length(s)::int as n from recs where length(s) between 200 and 1500")
def length_range(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("id", F.length("s").alias("n")).filter(F.col("n").between(200, 1500))


@query(f"with {SQL_SPLITS} select split, id, length(t)::int as n from (select split, id, upper(trim(seq, ' ' || chr(9) || chr(10) || chr(13))) as t from splits) where {sql_canonical('t')} and length(t) >= 50")
def canonical_reject(spark: SparkSession, d: str) -> DataFrame:
    """Sequences taken only if every letter is canonical."""
    s = F.upper(S.strip("seq"))
    return splits(spark, d).select("split", "id", s.alias("s")).filter(S.is_canonical("s") & (F.length("s") >= 50)).select("split", "id", F.length("s").alias("n"))


@query(f"""with {SQL_GENES} select row_id, gene_index, case when c1 <> '' then c1 else c2 end as protein from (select row_id, gene_index, {sql_clean("gene.protein", AA + "X")} as c1,
 {sql_clean("gene.sequence", AA + "X")} as c2 from genes)""")
def protein_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The first filled of the protein fields, with X kept; empty if none."""
    return genes(spark, d, "protein", "sequence").select("row_id", "gene_index", S.first_filled(S.clean_with_x("gene.protein"), S.clean_with_x("gene.sequence")).alias("protein"))


@query("""select row_id, try_cast(summary.subtype_score as double) as as_number, coalesce(try_cast(summary.subtype_score as double),
 try_cast(regexp_extract(summary.subtype_score, '[0-9.]+$') as double)) as score from crispr_cas_atlas""")
def number_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The first of several spellings that is a number."""
    t = table(spark, d, "crispr_cas_atlas").select("row_id", F.col("summary.subtype_score").alias("x"))
    return t.select("row_id", F.col("x").try_cast("double").alias("as_number"), S.first_number(F.col("x"), F.regexp_extract("x", r"[0-9.]+$", 0)).alias("score"))


@query(f"with {SQL_SPLITS}, t as (select split, id, upper(seq) as s from splits) select split, id, {SQL_PROBLEM} as reason from t")
def invalid_reason_first(spark: SparkSession, d: str) -> DataFrame:
    return splits(spark, d).select("split", "id", S.first_problem("seq", 200, 1500).alias("reason"))


@query(f"""with {SQL_SPLITS}, t as (select split, id, upper(seq) as s from splits) select split, id, nullif(array_to_string(list_filter([case when s = '' then 'empty sequence' end,
 case when not {sql_canonical('s')} then 'non-canonical amino acid' end, case when not length(s) between 200 and 1500 then 'length ' || length(s) || ' outside [200, 1500]' end], lambda x: x is not null), '; '), '') as reasons from t""")
def invalid_reason_all(spark: SparkSession, d: str) -> DataFrame:
    return splits(spark, d).select("split", "id", S.all_problems("seq", 200, 1500).alias("reasons"))


@query(f"""with {SQL_SPLITS}, t as (select split, id, seq as s, array_to_string(list_sort(list_distinct(string_split(regexp_replace(upper(seq), '[{AA}]', '', 'g'), ''))), '') as bad from splits)
 select split, id, array_to_string(list_filter([case when s = '' then 'empty_sequence' end, case when regexp_matches(s, '\\s') then 'contains_whitespace' end,
 case when bad <> '' then 'invalid_alphabet:' || bad end], lambda x: x is not null), '|') as reasons from t""")
def alphabet_reasons(spark: SparkSession, d: str) -> DataFrame:
    return splits(spark, d).select("split", "id", F.array_join(S.alphabet_problems(F.col("seq")), "|").alias("reasons"))


@query(f"with {SQL_RECORDS} select id, {sql_clean('protein')} <> translate(upper(coalesce(protein, '')), ' ' || chr(10) || chr(13) || chr(9), '') as protein_changed, s <> translate(upper(coalesce(sequence, '')), ' ' || chr(10) || chr(13) || chr(9), '') as changed from recs")
def changed_by_cleaning(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("id", S.changed_by_cleaning("protein").alias("protein_changed"), S.changed_by_cleaning("sequence").alias("changed"))


@query(f"with {SQL_SPLITS}, t as (select split, id, upper(seq) as s from splits) select split, id, round({sql_validity('s')}, 9) as validity from t")
def validity(spark: SparkSession, d: str) -> DataFrame:
    return splits(spark, d).select("split", "id", F.round(S.validity_score("seq"), 9).alias("validity"))


# Deduplication and groups of copies

FIRST = "row_number() over (partition by sha256 order by row_id, gene_index) as k, count(*) over (partition by sha256) as n"


@query(f"""with {SQL_KEYWORD}, r as (select *, {FIRST} from kw where sequence <> ''), one as (select *, row_number() over (order by row_id, gene_index) - 1 as o from r where k = 1),
 ids as (select sha256, list(operon_id order by row_id, gene_index) as ids from r where k <= 10 group by sha256)
 select 'cas13kw_' || lpad(o::varchar, 6, '0') || '_' || left(one.sha256, 12) as id, operon_id, subtype, gene_name, hmm_name, length, one.n as duplicate_count, array_to_string(ids.ids, '|') as duplicate_operon_ids, one.sha256
 from one join ids using (sha256)""")
def keyword_records(spark: SparkSession, d: str) -> DataFrame:
    """The deduplicated corpus with ordinals and samples of the copies' operons."""
    return C.keyword_records(operons(spark, d, *KEYWORD_FIELDS)).select("id", "operon_id", "subtype", "gene_name", "hmm_name", "length", "duplicate_count", F.array_join("duplicate_operon_ids_sample", "|").alias("duplicate_operon_ids"), "sha256")


@query(f"with {SQL_KEYWORD} select n as group_size, count(*) as n_groups from (select count(*) as n from kw where sequence <> '' group by sha256) group by n")
def dup_size_hist(spark: SparkSession, d: str) -> DataFrame:
    n = keyword(spark, d).filter("sequence <> ''").groupBy("sha256").agg(F.count("*").alias("group_size"))
    return n.groupBy("group_size").agg(F.count("*").alias("n_groups"))


@query(f"""with {SQL_KEYWORD}, r as (select *, {FIRST} from kw where sequence <> ''), g as (select sha256, any_value(n) as group_size, min_by(length, k) as length,
 array_to_string(list(coalesce(gene_name, '') order by k) filter (where k <= 10), '|') as gene_names, min(struct_pack(a := row_id, b := gene_index)) as o from r group by sha256)
 select sha256, group_size, length, gene_names from g where group_size > 1 order by o limit 20""")
def dup_examples(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 groups of copies in order of appearance, each with up to 10 gene names (a report)."""
    rows = keyword(spark, d).filter("sequence <> ''").withColumn("g", S.text("gene_name"))
    g = C.duplicate_groups(rows, "sha256", ["row_id", "gene_index"], ["length"], {"names": "g"})
    return g.filter("n > 1").orderBy("first_row_id", "first_gene_index").limit(20).select("sha256", F.col("n").alias("group_size"), "length", F.array_join("names", "|").alias("gene_names"))


@query(f"""with {SQL_KEYWORD} select count(*) as raw_entries, count(*) filter (where coalesce(protein, '') <> '') as nonempty_protein, count(*) filter (where sequence <> '') as post_clean,
 count(distinct sha256) filter (where sequence <> '') as unique_sequences,
 count(*) filter (where sequence <> '' and sequence <> translate(upper(coalesce(protein, '')), ' ' || chr(10) || chr(13) || chr(9), '')) as changed_by_cleaning,
 count(*) filter (where sequence <> '') - count(distinct sha256) filter (where sequence <> '') as duplicates_removed from kw""")
def corpus_counters(spark: SparkSession, d: str) -> DataFrame:
    return A.corpus_counters(keyword(spark, d))


@query(f"""with {SQL_GENES}, c as (select row_id, operon_id, summary.subtype as subtype, gene_index, gene.gene_name as gene_name, gene.hmm_name as hmm_name,
 case when {sql_clean("gene.protein", AA + "X")} <> '' then {sql_clean("gene.protein", AA + "X")} else {sql_clean("gene.sequence", AA + "X")} end as protein
 from (select row_id, operon_id, summary, unnest(range(len(cas)))::int as gene_index, unnest(cas) as gene from crispr_cas_atlas) where gene is not null and ({ANY9})),
 one as (select *, row_number() over (order by row_id, gene_index) as o from (select *, row_number() over (partition by protein order by row_id, gene_index) as k from c where protein <> '') where k = 1)
 select 'cas9_' || lpad(o::varchar, 6, '0') as id, operon_id, subtype, gene_name, hmm_name, length(protein)::int as length, protein from one""")
def any_field_records(spark: SparkSession, d: str) -> DataFrame:
    t = operons(spark, d, *ANNOTATIONS, "protein", "sequence", arrays=("cas",))
    return C.any_field_records(t).select("id", "operon_id", "subtype", "gene_name", "hmm_name", "length", "protein")


@query(f"""select sequence, length(sequence)::int as length, organism, system_type from (select sample_id, upper(trim(coalesce(g.sequence, g.protein, ''), ' ' || chr(9) || chr(10) || chr(13))) as sequence, coalesce(sample_id, '') as organism,
 upper(coalesce(subtype, '')) as system_type from (select sample_id, summary.subtype as subtype, unnest(cas) as g from crispr_cas_atlas) where g is not null)
 where (contains(system_type, 'VI') or contains(system_type, 'CAS13')) and length(sequence) >= 50 and {sql_canonical('sequence')}""")
def raw_typed_records(spark: SparkSession, d: str) -> DataFrame:
    """The no-deduplication builder over organisms, systems and proteins (samples stand for organisms)."""
    t = table(spark, d, "crispr_cas_atlas").filter("cas is not null")
    protein = F.transform(F.filter("cas", lambda g: g.isNotNull()), lambda g: F.struct(F.coalesce(g["sequence"], g["protein"]).alias("sequence")))
    organisms = t.select(F.col("sample_id").alias("name"), F.array(F.struct(F.col("summary.subtype").alias("type"), protein.alias("proteins"))).alias("cas_systems"))
    return C.raw_typed_records(organisms)


@query(f"with {SQL_RECORDS} select id, h from (select id, h, row_number() over (partition by h order by loaded_at, id) as k from recs where s <> '') where k = 1")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    return C.first_wins(records(spark, d).filter("s <> ''").select("id", "h", "loaded_at"), ["h"], ["loaded_at", "id"]).select("id", "h")


@query(f"with {SQL_RECORDS} select id, row_number() over (order by loaded_at, id) - 1 as ord from recs")
def dense_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return C.with_ordinal(records(spark, d).select("id", "loaded_at"), ["loaded_at", "id"]).select("id", "ord")


@query(f"""with {SQL_RECORDS}, u as (select distinct h from recs where s <> ''), r as (select h, row_number() over (order by sha256('1337|' || h), h) - 1 as k, count(*) over () as n from u)
 select h, case when k < floor(n * 0.9::double) then 'train' when k < floor(n * 0.9::double) + floor(n * 0.05::double) then 'valid' else 'test' end as split from r""")
def split_assign(spark: SparkSession, d: str) -> DataFrame:
    u = records(spark, d).filter("s <> ''").select("h").distinct()
    return C.split_by_rank(u, "h", {"train": 0.9, "valid": 0.05, "test": 0.05})


@query(f"with {SQL_RECORDS} select id from (select id, row_number() over (order by sha256('1337|' || id), id) as k from recs) where k <= 200")
def sample_k(spark: SparkSession, d: str) -> DataFrame:
    """200 records without replacement (a sampling operator)."""
    return C.sample_exactly(records(spark, d).select("id"), "id", 200)


@query(f"""with {SQL_SPLITS}, u as (select distinct split, seq from splits where seq <> ''), p(a, b) as (values ('train', 'valid'), ('train', 'test'), ('valid', 'test'))
 select a, b, count(x.seq) as n from p left join (select u.split as sa, v.split as sb, u.seq from u join u v on u.seq = v.seq) x on x.sa = p.a and x.sb = p.b group by a, b""")
def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Equal sequences of each pair of splits."""
    # one aggregation by content: which splits hold a text says in which pairs it counts
    held = splits(spark, d).filter("seq <> ''").groupBy(F.xxhash64("seq").alias("k"), "seq").agg(F.collect_set("split").alias("in"))
    counts = held.agg(*[F.count_if(F.array_contains("in", a) & F.array_contains("in", b)).alias(f"{a}_{b}") for a, b in (("train", "valid"), ("train", "test"), ("valid", "test"))])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("n")) for a, b in (("train", "valid"), ("train", "test"), ("valid", "test"))])).alias("x")).select("x.*")


@query(f"with {SQL_SPLITS} select (select count(*) from splits) as n_rows, (select count(distinct seq) from splits) as n_distinct, (select count(*) from (select seq from splits except select sequence from train_seqs except select sequence from valid_seqs except select sequence from test_seqs) where seq <> '') as n_lost")
def conservation(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct sequences, and sequences of the union that are in no split (none)."""
    u = splits(spark, d)
    lost = u.select("seq")
    for s in ("train", "valid", "test"):
        lost = lost.subtract(table(spark, d, f"{s}_seqs").select("sequence"))
    a = u.agg(F.count("*").alias("n_rows"), F.count_distinct("seq").alias("n_distinct"))
    return a.join(F.broadcast(lost.filter("seq <> ''").agg(F.count("*").alias("n_lost"))))  # one row each


@query("select row_id, operon_id from crispr_cas_atlas order by row_id limit 50")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 operons (a head report)."""
    return table(spark, d, "crispr_cas_atlas").select("row_id", "operon_id").orderBy("row_id").limit(50)
