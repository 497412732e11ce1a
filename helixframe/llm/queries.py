"""The queries of the curation problems, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import clean
from ..runtime import table
from . import bpe, groups, leak, oracle, residue, similar, spans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)


# 1: long exact spans shared between records


def _generated_and_train(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("id", "sequence").unionByName(table(spark, d, "train_seqs").select("id", "sequence"))


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(_generated_and_train(spark, d), "id", "sequence", min_len=50)


@query
def p1_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Shared characters of each record that shares any, with the count and the longest of its runs."""
    return p1_found(spark, d).groupBy("rec_id").agg(F.sum("span_len").alias("shared_chars"), F.count("*").alias("n_spans"), F.max("span_len").alias("longest"))


# 3: near-duplicate records with small edits


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return similar.near_duplicates(table(spark, d, "cas13_sequences"), "id", clean("sequence"), t=0.7)


@query
def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return similar.similarity_classes(table(spark, d, "cas13_sequences"), "id", clean("sequence"), t=0.7)


# 4: same or near-same records across splits


def _evaluation(spark: SparkSession, d: str) -> DataFrame:
    cols = ["id", "sequence", "source"]
    both = [table(spark, d, f"{s}_seqs").select(*cols, F.lit(s).alias("split_name")) for s in ("valid", "test")]
    return both[0].unionByName(both[1])


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return similar.cross_split(_evaluation(spark, d), table(spark, d, "train_seqs"), "id", clean("sequence"), t=0.6, split=F.col("split_name"))


@query
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source of the evaluation records: how many there are, how many overlap train, and in how many pairs."""
    ev = _evaluation(spark, d)
    # a record delivered again keeps the source of its rows; several sources of one record would count it under each
    recs = ev.select(F.col("id").alias("eval_id"), "split_name", "source").distinct()
    hits = p4_found(spark, d).groupBy("split_name", "eval_id").agg(F.count("*").alias("n"))
    return (
        recs.join(hits, ["split_name", "eval_id"], "left").groupBy("split_name", "source")
        .agg(F.count("*").alias("n_records"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))
    )


# 5: splits that keep related records together

FRACTIONS = {"train": 0.90, "valid": 0.05, "test": 0.05}


def _record_keys() -> list[Column]:
    return [groups.key("operon_id", named="[0-9]"), groups.key("sha256", trim=False)]


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.related_groups(table(spark, d, "cas13_sequences"), "id", _record_keys())


@query
def p5_split(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its group, its stratification label (subtype) and its split."""
    return groups.grouped_split(table(spark, d, "cas13_sequences"), "id", _record_keys(), F.col("subtype"), FRACTIONS)


@query
def p5_balance(spark: SparkSession, d: str) -> DataFrame:
    """Records and groups per split and label."""
    return p5_split(spark, d).groupBy("split", "label").agg(F.count("*").alias("n_records"), F.count_distinct("group_id").alias("n_groups"))


@query
def p5_checks(spark: SparkSession, d: str) -> DataFrame:
    """What any right assignment has: every record once, no group divided, no share off by more than two hundredths."""
    each = p5_split(spark, d).groupBy("group_id").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("split").alias("splits"), *[F.count_if(F.col("split") == s).alias(s) for s in FRACTIONS]
    )
    share = [F.abs(F.sum(s) / F.sum("n") - f) <= 0.02 for s, f in FRACTIONS.items()]
    return each.agg(
        F.sum("n").alias("n_rows"), F.sum("ids").alias("n_records"), (F.sum("n") - sum(F.sum(s) for s in FRACTIONS)).alias("n_unassigned"),
        (share[0] & share[1] & share[2]).alias("shares_hold"), F.count_if(F.col("splits") > 1).alias("n_divided"),
    )


# 6: encoding with a public tokenizer


@query
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


@query
def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Per document: number of ids, and whether decoding them gives the text again (null counts as empty)."""
    return bpe.roundtrip(table(spark, d, "documents"))


@query
def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts, decoded from their ids."""
    return bpe.decode(bpe.encode(table(spark, d, "documents")))


# 7: evaluation texts leaking into training text


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), n=12)


@query
def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"), n=12)


@query
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Per test item that leaks: in how many documents, and its longest leaked passage in words."""
    return p7_passages(spark, d).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest_words"))


# 8: template residue and error-page text


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents"))


@query
def p8_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """The recurrent short lines of each host."""
    return residue.boilerplate(table(spark, d, "documents"), "text", "source")


@query
def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per host: documents, and how many are excluded."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("host"))
    gone = p8_found(spark, d).withColumn("gone", F.lit(1))
    return docs.join(gone, "doc_id", "left").groupBy("host").agg(F.count("*").alias("n_docs"), F.count("gone").alias("n_excluded"))
