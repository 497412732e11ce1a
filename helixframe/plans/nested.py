"""Queries of the nested atlas tables (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested as N
from ..runtime import table

GENE = N.Level("gene", ("cas", "cas_genes"), ("gene_name", "hmm_name", "protein", "sequence", "product", "annotation"))
DOMAIN = N.Level("domain", ("domains",), ("hmm_name", "bit_score", "from_pos", "to_pos"))
MOTIF = N.Level("motif", ("motifs",), ("motif", "pos"))
OPERON = N.Level("operon", N.ROOTS, ("operon_id", "id", "operon", "accession", "contig_id", "summary.subtype", "summary.subtype_score", "summary.n_genes", "summary.contig.contig_id", "summary.contig.length_bp", "summary.contig.strand"))
TYPED, RAW = [GENE, DOMAIN, MOTIF], [OPERON, GENE, DOMAIN, MOTIF]
RAW_TYPES = {"bit_score": "double", "from_pos": "int", "to_pos": "int", "pos": "int", "summary.n_genes": "int", "summary.contig.length_bp": "bigint"}


def bare(levels: list[N.Level]) -> list[N.Level]:
    return [N.Level(x.name, x.keys) for x in levels]


def _typed(spark: SparkSession, d: str, *named: N.Level) -> dict[str, DataFrame]:
    """Flattened typed tables, of which the named ones have their fields."""
    levels = [x if x in named else N.Level(x.name, x.keys) for x in TYPED]
    while levels[-1] not in named:
        levels.pop()
    return N.flatten_levels(N.read_levels(spark, f"{d}/crispr_cas_atlas.parquet", ["row_id"], levels), ["row_id"], levels)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    levels = bare(TYPED)
    flat = N.flatten_levels(N.read_levels(spark, f"{d}/crispr_cas_atlas.parquet", ["row_id"], levels), ["row_id"], levels)
    gene, domain, motif = (flat[x.name].select("row_id", F.lit(x.name).alias("node_level"), "node_path") for x in levels)
    typed = gene.unionByName(domain).unionByName(motif)
    raw = N.json_nodes(table(spark, d, "atlas_raw"), "row_id", "payload", RAW, with_fields=False)
    cols = ["tbl", "row_id", "node_level", "node_path"]
    return typed.withColumn("tbl", F.lit("crispr_cas_atlas")).select(*cols).unionByName(raw.withColumn("tbl", F.lit("atlas_raw")).select(*cols))


def p2_operons(spark: SparkSession, d: str) -> DataFrame:
    """Operons of both tables with their summary; parentless. The id is the first filled one of the alternatives."""
    c = table(spark, d, "crispr_cas_atlas")
    typed = c.select(
        F.lit("crispr_cas_atlas").alias("tbl"), "row_id", F.lit(None).cast("string").alias("node_path"), F.expr("nullif(operon_id, '')").alias("operon_id"), F.col("summary.subtype").alias("subtype"),
        F.col("summary.subtype_score").alias("subtype_score"), F.col("summary.n_genes").alias("n_genes"), F.col("summary.contig.contig_id").alias("contig_id"), F.col("summary.contig.length_bp").alias("length_bp"), F.col("summary.contig.strand").alias("strand"),
    )
    r = N.json_level(N.json_nodes(table(spark, d, "atlas_raw"), "row_id", "payload", RAW), OPERON, RAW_TYPES)
    ids = F.coalesce(*[F.expr(f"nullif({k}, '')") for k in ("operon_id", "id", "operon", "accession", "contig_id")])
    raw = r.select(
        F.lit("atlas_raw").alias("tbl"), "row_id", "node_path", ids.alias("operon_id"), F.col("summary_subtype").alias("subtype"), F.col("summary_subtype_score").alias("subtype_score"), F.col("summary_n_genes").alias("n_genes"),
        F.col("summary_contig_contig_id").alias("contig_id"), F.col("summary_contig_length_bp").alias("length_bp"), F.col("summary_contig_strand").alias("strand"),
    )
    return typed.unionByName(raw)


def _both(spark: SparkSession, d: str, level: N.Level) -> DataFrame:
    cols = ["tbl", "row_id", "node_path", "parent_path", "ordinal", *level.fields]
    typed = _typed(spark, d, level)[level.name].withColumn("tbl", F.lit("crispr_cas_atlas"))
    raw = N.json_level(N.json_nodes(table(spark, d, "atlas_raw"), "row_id", "payload", RAW), level, RAW_TYPES).withColumn("tbl", F.lit("atlas_raw"))
    return typed.select(*cols).unionByName(raw.select(*cols))


def p2_genes(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, GENE)


def p2_domains(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, DOMAIN)


def p2_motifs(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, MOTIF)


def p2_triples(spark: SparkSession, d: str) -> DataFrame:
    """The path-value-ordinal triples of the received payloads."""
    return N.json_triples(table(spark, d, "atlas_raw"), "row_id", "payload", RAW)


def p2_fields(spark: SparkSession, d: str) -> DataFrame:
    """How many objects of the received payloads have each declared field, null or not, counted from the triples."""
    t = p2_triples(spark, d)
    declared = F.lit(False)
    for x in RAW:
        declared = declared | ((F.col("node_level") == x.name) & F.col("field_path").isin(*x.fields))
    return t.filter(declared).groupBy("node_level", "field_path").agg(F.count("*").alias("n"), F.count("value").alias("n_filled"))


def p2_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that have no rows in any table, by reason."""
    return N.rejects(table(spark, d, "atlas_raw"), "row_id", "payload").groupBy("reason").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p2_found, p2_fields, p2_rejects, p2_operons, p2_genes, p2_domains, p2_motifs, p2_triples)}
SQL: dict[str, str] = {}

# The same tables in SQL. In atlas_raw a value counts as filled unless it is absent, null, or an empty array, object or text.

_KIND = "case when json_type({j}, '{p}') = 'ARRAY' then json_extract({j}, '{p}') end"
_FILLED = "json_type({j}, '$.cas') is not null and json_type({j}, '$.cas') <> 'NULL' and json_extract({j}, '$.cas')::varchar not in ('[]', '{{}}', '\"\"')"
_ELEMENTS = "unnest(range(coalesce(json_array_length({a}), 0)::bigint)) as i, unnest(from_json({a}, '[\"json\"]')) as v"


def _sql_raw() -> str:
    roots = "case when json_type(j) = 'ARRAY' then j " + " ".join(f"when json_type(j, '$.{k}') = 'ARRAY' then json_extract(j, '$.{k}')" for k in N.ROOTS) + " when json_type(j) = 'OBJECT' and j::varchar <> '{}' then json_array(j) end"
    step = lambda name, source, array, path: (
        f"{name}_a as (select row_id, path as up, {array} as a from {source}), "
        f"{name} as (select row_id, up, i::int as ordinal, {path} as path, v as j from (select row_id, up, {_ELEMENTS.format(a='a')} from {name}_a where a is not null) where json_type(v) = 'OBJECT')"
    )
    cas = "case when " + _FILLED.format(j="j") + " then " + _KIND.format(j="j", p="$.cas") + " else " + _KIND.format(j="j", p="$.cas_genes") + " end"
    return (
        "raw as (select row_id, null::varchar as path, payload::json as j from atlas_raw where json_valid(payload)), "
        + step("op", "raw", roots, "i::varchar") + ", " + step("ge", "op", cas, "up || '.' || i") + ", "
        + step("dm", "ge", _KIND.format(j="j", p="$.domains"), "up || '.' || i") + ", " + step("mt", "dm", _KIND.format(j="j", p="$.motifs"), "up || '.' || i")
    )


_TYPED = """tg as (select row_id, null::varchar as up, i::int as ordinal, i::varchar as path, v as g from (select row_id, unnest(range(len(a))) as i, unnest(a) as v from
 (select row_id, case when len(cas) > 0 then cas else cas_genes end as a from crispr_cas_atlas)) where v is not null),
 td as (select row_id, up, i::int as ordinal, up || '.' || i as path, v as g from (select row_id, path as up, unnest(range(len(g.domains))) as i, unnest(g.domains) as v from tg) where v is not null),
 tm as (select row_id, up, i::int as ordinal, up || '.' || i as path, v as g from (select row_id, path as up, unnest(range(len(g.motifs))) as i, unnest(g.motifs) as v from td) where v is not null)"""


def _sql_fields(level: N.Level) -> tuple[str, str]:
    kind = {"double": "double", "int": "int", "bigint": "bigint"}
    text = lambda f: f"json_extract_string(j, '$.{f}')"
    raw = ", ".join(f"try_cast({text(f)} as {kind[RAW_TYPES[f]]}) as {f}" if f in RAW_TYPES else f"{text(f)} as {f}" for f in level.fields)
    return ", ".join(f"g.{f} as {f}" for f in level.fields), raw


def _sql_level(level: N.Level, typed: str, raw: str) -> str:
    a, b = _sql_fields(level)
    return (
        f"with {_TYPED}, {_sql_raw()} select 'crispr_cas_atlas' as tbl, row_id, path as node_path, up as parent_path, ordinal, {a} from {typed} "
        f"union all select 'atlas_raw' as tbl, row_id, path as node_path, up as parent_path, ordinal, {b} from {raw}"
    )


SQL |= {
    "p2_found": f"with {_TYPED}, {_sql_raw()} "
    + " union all ".join(f"select '{t}' as tbl, row_id, '{n}' as node_level, path as node_path from {s}" for t, n, s in (("crispr_cas_atlas", "gene", "tg"), ("crispr_cas_atlas", "domain", "td"), ("crispr_cas_atlas", "motif", "tm"), ("atlas_raw", "operon", "op"), ("atlas_raw", "gene", "ge"), ("atlas_raw", "domain", "dm"), ("atlas_raw", "motif", "mt"))),
    "p2_genes": _sql_level(GENE, "tg", "ge"),
    "p2_domains": _sql_level(DOMAIN, "td", "dm"),
    "p2_motifs": _sql_level(MOTIF, "tm", "mt"),
    "p2_operons": f"""with {_sql_raw()} select 'crispr_cas_atlas' as tbl, row_id, null::varchar as node_path, nullif(operon_id, '') as operon_id, summary.subtype as subtype, summary.subtype_score as subtype_score,
 summary.n_genes as n_genes, summary.contig.contig_id as contig_id, summary.contig.length_bp as length_bp, summary.contig.strand as strand from crispr_cas_atlas union all
 select 'atlas_raw', row_id, path, coalesce({", ".join(f"nullif(json_extract_string(j, '$.{k}'), '')" for k in ("operon_id", "id", "operon", "accession", "contig_id"))}), json_extract_string(j, '$.summary.subtype'),
 json_extract_string(j, '$.summary.subtype_score'), try_cast(json_extract_string(j, '$.summary.n_genes') as int), json_extract_string(j, '$.summary.contig.contig_id'),
 try_cast(json_extract_string(j, '$.summary.contig.length_bp') as bigint), json_extract_string(j, '$.summary.contig.strand') from op""",
}


def _sql_counts() -> str:
    of = {"operon": "op", "gene": "ge", "domain": "dm", "motif": "mt"}
    kind = lambda f: f"json_type(j, '$.{f}')"
    rows = [(x.name, f, of[x.name]) for x in RAW for f in x.fields]
    # an object is no leaf, and an array of objects is a group of its own
    each = [
        f"select '{n}' as node_level, '{f}' as field_path, count(*) as n, count(case when {kind(f)} <> 'NULL' then 1 end) as n_filled from {c} where {kind(f)} is not null and {kind(f)} <> 'OBJECT' "
        f"and not ({kind(f)} = 'ARRAY' and len(list_filter(from_json(json_extract(j, '$.{f}'), '[\"json\"]'), lambda x: json_type(x) = 'OBJECT')) > 0)"
        for n, f, c in rows
    ]
    return f"with {_sql_raw()} select * from (" + " union all ".join(each) + ") where n > 0"


SQL |= {
    "p2_fields": _sql_counts(),
    "p2_rejects": "select case when payload is null then 'null' else 'not one complete JSON text' end as reason, count(*) as n from atlas_raw where payload is null or not json_valid(payload) group by 1",
}
