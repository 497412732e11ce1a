"""Writers: JSON lines with explicit nulls, FASTA, CSV with fixed columns, nested JSON, reports, training logs, and the score cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sequence as S

RECORD_FIELDS = ["id", "sequence", "length", "sha256", "subtype", "subtype_score", "gene_name", "hmm_name"]  # fixed value
KEYWORD_FIELDS = ["id", "operon_id", "subtype", "subtype_score", "gene_name", "hmm_name", "length", "sequence", "protein", "duplicate_count", "duplicate_operon_ids_sample", "sha256"]  # fixed value


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_log(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def fasta_entry(header: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), S.wrap(seq))


def write_fasta(df: DataFrame, path: str, subtype: str = "subtype") -> None:
    """Headers '>id len=N subtype=S', a null subtype as None; lines of 80."""
    h = F.concat_ws(" ", "id", F.concat(F.lit("len="), F.length("sequence")), F.concat(F.lit("subtype="), F.coalesce(F.col(subtype), F.lit("None"))))
    df.select(fasta_entry(h, F.col("sequence")).alias("value")).write.mode("overwrite").text(path)


def write_fasta_piped(df: DataFrame, path: str) -> None:
    """Headers '>id|operon_id=..|gene_name=..|hmm_name=..|length=N', nulls empty."""
    parts = [F.concat(F.lit(f"{c}="), S.text(c)) for c in ("operon_id", "gene_name", "hmm_name")]
    h = F.concat_ws("|", "id", *parts, F.concat(F.lit("length="), F.length("protein")))
    df.select(fasta_entry(h, F.col("protein")).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Exactly these columns in this order; missing ones are empty, nested ones JSON text."""
    have = {f.name: f.dataType for f in df.schema.fields}
    nested = (T.ArrayType, T.StructType, T.MapType)
    one = lambda c: F.lit(None).cast("string").alias(c) if c not in have else (F.to_json(c).alias(c) if isinstance(have[c], nested) else F.col(c))
    df.select(*[one(c) for c in fields]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def nested_export(df: DataFrame) -> DataFrame:
    """value: one JSON object a row with sorted keys; the original object is kept as it was."""
    source = F.coalesce(F.col("cas_entry"), F.lit("null"))
    rest = F.to_json(F.struct("id", F.struct("gene_name", "hmm_name", "length").alias("metadata"), "operon_id", "protein", "subtype"), {"ignoreNullFields": "false"})
    return df.select(F.concat(F.lit('{"cas_entry":'), source, F.lit(","), F.substring(rest, 2, 1_000_000_000)).alias("value"))


def write_nested(df: DataFrame, path: str) -> None:
    nested_export(df).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_training_log(df: DataFrame, path: str, step: str, loss: str, most: int = 10_000) -> None:
    """Trainer state files of about `most` entries each, in a folder of their own; rows with a null loss are no entries.

    Entries are dealt to the files by the hash of the whole row, so that no file, and no row of collect_list, grows with the log."""
    t = df.filter(F.col(loss).isNotNull()).select(F.col(step).alias("step"), F.col(loss).alias("loss"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h"))
    files = max(1, -(-t.count() // most))
    h = t.select(F.pmod("h", F.lit(files)).alias("file"), F.struct("step", "loss").alias("entry")).groupBy("file").agg(F.collect_list("entry").alias("log_history"))
    h.write.mode("overwrite").partitionBy("file").json(path)


def append_cache(df: DataFrame, path: str) -> None:
    """New scores for the cache table, with the time of writing; readers take the latest row of a key."""
    df.withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).write.mode("append").parquet(path)
