"""Registration of queries with the SQL that states the same result, and the table views and SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import corpus as C
from ..operators import nested as N
from ..runtime import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# The same views in both languages

AA = S.RESIDUES


def sql_clean(x: str, letters: str = AA) -> str:
    return f"regexp_replace(upper(coalesce({x}, '')), '[^{letters}]', '', 'g')"


def sql_canonical(x: str) -> str:
    return f"regexp_full_match({x}, '[{AA}]*')"


def sql_count(x: str, which: str) -> str:
    return f"(length({x}) - length(translate({x}, '{which}', '')))"


#: Runs of one character, for engines without back-references.
RUNS = "|".join(f"{c}+" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ") + "|[*]+|-+| +|[.]+|[_]+"
SQL_MOTIFS = "len(regexp_extract_all({x}, 'R[A-Z]{{4}}H'))"


def sql_motifs(x: str) -> str:
    return SQL_MOTIFS.format(x=x)


def sql_validity(x: str, lo: int = 200, hi: int = 1500) -> str:
    return (
        f"case when not {sql_canonical(x)} then 0.0 when length({x}) between {lo} and {hi} then 1.0 when length({x}) = 0 then 0.0 "
        f"when length({x}) < {lo} then length({x}) / {lo}.0::double else greatest(0.0, 1 - (length({x}) - {hi}) / {hi}.0::double) end::double"
    )


SQL_FRACTION = "case when s = '' then 0.0 else list_max(list_transform(list_distinct(string_split(s, '')), lambda c: length(s) - length(replace(s, c, '')))) / length(s)::double end"
SQL_RUN = f"coalesce(list_max(list_transform(regexp_extract_all(s, '{RUNS}'), lambda x: length(x))), 0)::int"
SQL_PROBLEM = "case when s = '' then 'empty sequence' when not " + sql_canonical("s") + " then 'non-canonical amino acid' when not length(s) between 200 and 1500 then 'length ' || length(s) || ' outside [200, 1500]' end"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """id, step, prompt, raw, s: the last delivery of each candidate; raw is its text (null as empty), s upper-cased."""
    t = table(spark, d, "candidates").withColumn("raw", S.text("sequence"))
    w = Window.partitionBy("id").orderBy(F.desc("scored_at"), "raw", "step")
    return t.withColumn("n", F.row_number().over(w)).filter("n = 1").select("id", "step", "prompt", "raw", F.upper("raw").alias("s"))


SQL_CANDIDATES = """cand as (select id, step, prompt, raw, upper(raw) as s from (select *, coalesce(sequence, '') as raw,
  row_number() over (partition by id order by scored_at desc, coalesce(sequence, ''), step) as rn from candidates) where rn = 1)"""


def records(spark: SparkSession, d: str) -> DataFrame:
    """The keyword corpus, first delivery of each id, with its cleaned sequence s and hash h."""
    t = table(spark, d, "cas13_sequences").filter("id is not null")
    return C.first_wins(t, ["id"], ["loaded_at"]).withColumn("s", S.clean("sequence")).withColumn("h", S.content_hash("s"))


SQL_RECORDS = f"""recs as (select *, {sql_clean("sequence")} as s, sha256({sql_clean("sequence")}) as h from (select *,
  row_number() over (partition by id order by loaded_at) as rn from cas13_sequences where id is not null) where rn = 1)"""

SPLITS = ("train", "valid", "test")


def splits(spark: SparkSession, d: str) -> DataFrame:
    """split, id, seq of the three split tables, first delivery of each id, null sequences empty."""
    out = None
    for s in SPLITS:
        t = C.first_wins(table(spark, d, f"{s}_seqs").filter("id is not null").select("id", "sequence", "loaded_at", "source"), ["id"], ["loaded_at"])
        t = t.select(F.lit(s).alias("split"), "id", S.text("sequence").alias("seq"), "source")
        out = t if out is None else out.unionByName(t)
    return out


SQL_SPLITS = "splits as (" + " union all ".join(f"select '{s}' as split, id, coalesce(sequence, '') as seq, source from (select *, row_number() over (partition by id order by loaded_at) as rn from {s}_seqs where id is not null) where rn = 1" for s in SPLITS) + ")"


def operons(spark: SparkSession, d: str, *fields: str, arrays: tuple[str, ...] = ("cas", "cas_genes")) -> DataFrame:
    """row_id, operon_id, summary and the gene arrays, of which only the named fields are read."""
    return N.read_levels(spark, f"{d}/crispr_cas_atlas.parquet", ["row_id", "operon_id", "summary"], [N.Level("gene", arrays, fields)])


def genes(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    return C.genes(operons(spark, d, *fields), ["row_id", "operon_id", "summary"])


SQL_GENES = """genes as (select row_id, operon_id, summary, gene_index, gene from (select row_id, operon_id, summary,
  unnest(range(len(g)))::int as gene_index, unnest(g) as gene from (select row_id, operon_id, summary, case when len(cas) > 0 then cas else cas_genes end as g
  from crispr_cas_atlas)) where gene is not null)"""

KEYWORD_FIELDS = ("gene_name", "hmm_name", "protein")
KW = " or ".join(f"contains(coalesce(gene.{f}, ''), '{k}')" for f in ("gene_name", "hmm_name") for k in S.KEYWORDS)
SQL_KEYWORD = f"""{SQL_GENES}, kw as (select row_id, gene_index, coalesce(nullif(operon_id, ''), 'operon_' || row_id) as operon_id, summary.subtype as subtype,
  summary.subtype_score as subtype_score, gene.gene_name as gene_name, gene.hmm_name as hmm_name, gene.protein as protein, {sql_clean("gene.protein")} as sequence,
  length({sql_clean("gene.protein")})::int as length, sha256({sql_clean("gene.protein")}) as sha256 from genes where {KW})"""


def keyword(spark: SparkSession, d: str) -> DataFrame:
    return C.keyword_corpus(operons(spark, d, *KEYWORD_FIELDS))
