"""Corpus building: genes out of operons, first-wins deduplication, groups of copies, ordinals, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..runtime import stored


def genes(operons: DataFrame, keys: list[str], arrays: tuple[str, ...] = ("cas", "cas_genes")) -> DataFrame:
    """One row per gene object: keys, gene_index (null elements keep their place), gene. Operons without genes have no row."""
    from .nested import first_filled

    return operons.select(*keys, F.posexplode(first_filled(*[F.col(a) for a in arrays])).alias("gene_index", "gene")).filter("gene is not null")


def first_wins(df: DataFrame, key: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given order. Rows that tie in the order must be equal or it must be made total.

    The filter on the rank becomes a group limit that runs before the shuffle too, so a hot key sends one row a task."""
    cols = df.columns
    best = df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return best.filter("__n = 1").select(*cols)


def duplicate_groups(df: DataFrame, key: str, order: list[str], carried: list[str], listed: dict[str, str], sample: int = 10) -> DataFrame:
    """Per key: the first member's carried columns, n (members), the first member's order columns as first_<name>, and for
    each listed column (result name: column) its values in the first `sample` members.

    The samples come from a rank within the key, limited before the shuffle and after it, so no group is ever collected
    beyond them; equal keys meet after a map-side partial count."""
    o = F.struct(*order)
    size = df.groupBy(key).agg(F.count("*").alias("n"), F.min_by(F.struct(*carried), o).alias("__first"), F.min(o).alias("__o"))
    few = df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__r") <= sample)
    lists = few.groupBy(key).agg(*[F.transform(F.array_sort(F.collect_list(F.struct(F.col("__r"), F.col(c).alias("v")))), lambda x: x["v"]).alias(n) for n, c in listed.items()])
    return size.join(lists, key).select(key, *[F.col(f"__first.{c}").alias(c) for c in carried], "n", *[F.col(f"__o.{c}").alias(f"first_{c}") for c in order], *listed)


def with_ordinal(df: DataFrame, order: list[str | Column], name: str = "ord", start: int = 0) -> DataFrame:
    """Dense numbers in a total order, without sending all rows to one task: rows are sorted by range partitions, numbered
    within each, and shifted by the sizes of the partitions before (one small row each)."""
    cols = df.columns
    low = (1 << 33) - 1
    # monotonically_increasing_id is the partition number times 2^33 plus the row's place in it
    one = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    one = one.withColumn("__p", F.shiftright("__id", 33)).withColumn("__i", F.col("__id").bitwiseAND(F.lit(low)))
    sizes = one.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return one.join(F.broadcast(before.select("__p", "__b")), "__p").select(*cols, (F.col("__i") + F.col("__b") + start).alias(name))


def with_running_total(df: DataFrame, order: list[str], weight: str, name: str = "before") -> DataFrame:
    """The sum of weight over the rows before each one in a total order; like with_ordinal, no task gets all rows."""
    cols = df.columns
    one = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    one = one.withColumn("__p", F.shiftright("__id", 33))
    local = F.sum(weight).over(Window.partitionBy("__p").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1))
    sizes = one.groupBy("__p").agg(F.sum(weight).alias("__n"))
    above = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return one.withColumn("__l", F.coalesce(local, F.lit(0))).join(F.broadcast(above), "__p").select(*cols, (F.col("__l") + F.col("__b")).alias(name))  # one row a partition


def hash_rank(key: Column, seed: int) -> Column:
    """A reproducible random order."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), key), 256)


def split_by_rank(df: DataFrame, key: str, fractions: dict[str, float], seed: int = 1337) -> DataFrame:
    """df with its split: a seeded shuffle of the keys, cut at floor(n * fraction); the last split takes the remainder.

    Keys must be unique. Fractions must sum to 1."""
    if abs(sum(fractions.values()) - 1) > 1e-6:
        raise ValueError(f"fractions must sum to 1: {fractions}")
    cols = df.columns
    names = list(fractions)
    ranked = with_ordinal(df.withColumn("__h", hash_rank(F.col(key), seed)), ["__h", key], "__r")
    n = ranked.count()
    out, edge = F.lit(names[-1]), 0
    cuts = []
    for s in names[:-1]:
        edge += int(n * fractions[s])
        cuts.append((s, edge))
    for s, e in reversed(cuts):
        out = F.when(F.col("__r") < e, s).otherwise(out)
    return ranked.select(*cols, out.alias("split"))


def sample_exactly(df: DataFrame, key: str, k: int, seed: int = 1337) -> DataFrame:
    """k rows without replacement (all, if there are fewer), by seeded rank; a distributed top-k."""
    return df.withColumn("__h", hash_rank(F.col(key), seed)).orderBy("__h", key).limit(k).drop("__h")


def keyword_corpus(operons: DataFrame, key: str = "row_id") -> DataFrame:
    """Genes with a keyword and a protein, cleaned and hashed: the rows that groups, counters and records come from."""
    g = genes(operons, [key, "operon_id", "summary"])
    return (
        g.filter(S.has_keyword("gene.gene_name", "gene.hmm_name"))
        .select(key, "gene_index", F.coalesce(F.nullif("operon_id", F.lit("")), F.concat(F.lit("operon_"), F.col(key).cast("string"))).alias("operon_id"), F.col("summary.subtype").alias("subtype"), F.col("summary.subtype_score").alias("subtype_score"), F.col("gene.gene_name").alias("gene_name"), F.col("gene.hmm_name").alias("hmm_name"), F.col("gene.protein").alias("protein"))
        .withColumn("sequence", S.clean("protein")).withColumn("length", F.length("sequence")).withColumn("sha256", S.content_hash("sequence"))
    )


def keyword_records(operons: DataFrame, key: str = "row_id") -> DataFrame:
    """The deduplicated corpus: one record per cleaned sequence, numbered in order of first appearance."""
    rows = keyword_corpus(operons, key).filter("sequence <> ''")
    groups = duplicate_groups(rows, "sha256", [key, "gene_index"], ["operon_id", "subtype", "subtype_score", "gene_name", "hmm_name", "length", "sequence", "protein"], {"duplicate_operon_ids_sample": "operon_id"})
    numbered = with_ordinal(groups, [f"first_{key}", "first_gene_index"], "ord")
    return numbered.select(
        F.format_string("cas13kw_%06d_%s", F.col("ord"), F.substring("sha256", 1, 12)).alias("id"), "operon_id", "subtype", "subtype_score", "gene_name", "hmm_name", "length", "sequence", "protein", F.col("n").alias("duplicate_count"), "duplicate_operon_ids_sample", "sha256"
    )


def any_field_records(operons: DataFrame, word: str = "cas9", key: str = "row_id", prefix: str = "cas9") -> DataFrame:
    """Genes that name the word in any annotation field, first of each protein (letters and X) in order, numbered from 1."""
    g = genes(operons, [key, "operon_id", "summary"], ("cas",))
    fields = [F.col(f"gene.{f}") for f in ("gene_name", "hmm_name", "product", "annotation")]
    protein = S.first_filled(S.clean_with_x("gene.protein"), S.clean_with_x("gene.sequence"))
    rows = g.filter(S.has_keyword_any_case(word, *fields)).select(key, "gene_index", "operon_id", F.col("summary.subtype").alias("subtype"), F.col("gene.gene_name").alias("gene_name"), F.col("gene.hmm_name").alias("hmm_name"), protein.alias("protein"), F.to_json("gene").alias("cas_entry")).filter("protein <> ''")
    unique = first_wins(rows.withColumn("__k", S.content_hash("protein")), ["__k"], [key, "gene_index"]).drop("__k")
    return with_ordinal(unique, [key, "gene_index"], "ord", 1).select(F.format_string(f"{prefix}_%06d", F.col("ord")).alias("id"), "operon_id", "subtype", "gene_name", "hmm_name", F.length("protein").alias("length"), "protein", "cas_entry", key, "gene_index")


def raw_typed_records(organisms: DataFrame, min_length: int = 50) -> DataFrame:
    """sequence, length, organism, system_type out of organisms(name, cas_systems(type, proteins(sequence))): systems whose
    type names VI or CAS13, sequences taken only if all letters are canonical; nothing is deduplicated."""
    s = organisms.select(F.coalesce("name", F.lit("")).alias("organism"), F.explode("cas_systems").alias("s"))
    kind = F.upper(S.text("s.type"))
    p = s.select("organism", kind.alias("system_type"), F.explode("s.proteins").alias("p")).filter(F.col("system_type").contains("VI") | F.col("system_type").contains("CAS13"))
    seq = F.upper(S.strip(S.text("p.sequence")))
    return p.select(seq.alias("sequence"), F.length(seq).alias("length"), "organism", "system_type").filter(S.is_canonical("sequence") & (F.col("length") >= min_length))
