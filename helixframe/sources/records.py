"""Readers of record files: JSON lines, FASTA, delimited text, prompts, structure files and training logs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship
from .files import first_letter, open_text, write_text

FASTA_ENDS = (".fa", ".faa", ".fasta")  # fixed value


def read_jsonl(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Strict: a malformed line raises; blank lines are skipped."""
    r = spark.read.option("mode", "FAILFAST")
    return (r.schema(schema) if schema else r).json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines): id and sequence of the lines that can be read and have a sequence that isn't blank."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", "id string, sequence string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = F.col("r._bad").isNull() & F.col("r").isNotNull()
    return parsed.filter(good).select("r.id", F.trim("r.sequence").alias("sequence")).filter("sequence <> ''"), parsed.filter(~good).select("value")


def _first_letters(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files below path that begin with a header, and those that don't. The driver lists the files; tasks open them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [st for root in fs.globStatus(p) or [] for st in (fs.listStatus(root.getPath()) if root.isDirectory() else [root])]
    names = [st.getPath().toString() for st in found if not st.isDirectory() and st.getPath().getName()[:1] not in "._"]
    if not names:
        return [], []
    ship(spark)

    def look(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield b.assign(header=[first_letter(x) == ">" for x in b["path"]])

    rows = spark.createDataFrame([(x,) for x in names], "path string").repartition(min(len(names), 1000)).mapInPandas(look, "path string, header boolean").collect()
    return [r.path for r in rows if r.header], [r.path for r in rows if not r.header]


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """header (null for text before the first one) and body of each FASTA entry.

    Files that begin with a header are split at line starts with '>', so large files are read by many tasks; only files
    with text before the first header are read whole."""
    split, whole = _first_letters(spark, path)
    parts = []
    if split:
        parts.append(spark.read.option("lineSep", "\n>").text(split).select(F.regexp_replace("value", r"^\s*>", "").alias("e")).select(F.element_at(F.split("e", "\r?\n", 2), 1).alias("header"), F.coalesce(F.get(F.split("e", "\r?\n", 2), F.lit(1)), F.lit("")).alias("body")))
    if whole:
        t = spark.read.text(whole, wholetext=True).select(F.posexplode(F.split(F.concat(F.lit("\n"), "value"), r"\n[ \t]*>")).alias("n", "e"))
        parts.append(t.select(F.when(F.col("n") > 0, F.element_at(F.split("e", "\r?\n", 2), 1)).alias("header"), F.when(F.col("n") > 0, F.coalesce(F.get(F.split("e", "\r?\n", 2), F.lit(1)), F.lit(""))).otherwise(F.col("e")).alias("body")))
    if not parts:
        return spark.createDataFrame([], "header string, body string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id (the header's first word; a hash name if the header is bare), sequence (lines joined). Text before the first
    header is dropped, and so are entries with neither id nor sequence."""
    e = _entries(spark, path).filter("header is not null and (trim(header) <> '' or trim(body) <> '')")
    seq = F.regexp_replace("body", r"\s+", "")
    word = F.regexp_extract(F.trim("header"), r"^(\S+)", 1)
    return e.select(F.when(word != "", word).otherwise(F.concat(F.lit("seq_"), F.substring(F.sha2("body", 256), 1, 12))).alias("id"), seq.alias("sequence"))


def read_fasta_sequences(spark: SparkSession, path: str) -> DataFrame:
    """sequence only: entries without one vanish; text before the first header is a sequence too."""
    return _entries(spark, path).select(F.regexp_replace("body", r"\s+", "").alias("sequence")).filter("sequence <> ''")


def read_csv(spark: SparkSession, path: str, sequence_column: str, id_column: str | None = None) -> DataFrame:
    """id, sequence; tab-separated if the name ends in .tsv. Without an id column the row number in the file serves."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", "\t" if path.endswith(".tsv") else ",")
    df = r.csv(path)
    if id_column:
        return df.select(F.col(id_column).alias("id"), F.col(sequence_column).alias("sequence"))
    # with multiLine one task reads a file from beginning to end, among other files perhaps
    at = df.select(F.col(sequence_column).alias("sequence"), F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n"))
    return at.select((F.row_number().over(Window.partitionBy("f").orderBy("n")) - 1).cast("string").alias("id"), "sequence")


def read_records(spark: SparkSession, path: str, sequence_column: str = "sequence", id_column: str | None = "id", limit: int | None = None) -> DataFrame:
    """By suffix: .csv and .tsv, FASTA, else JSON lines."""
    end = PurePosixPath(path).suffix.lower()
    if end in (".csv", ".tsv"):
        df = read_csv(spark, path, sequence_column, id_column)
    elif end in FASTA_ENDS:
        df = read_fasta(spark, path)
    else:
        df = read_jsonl(spark, path).select(*[F.col(c).alias(n) for c, n in ((id_column, "id"), (sequence_column, "sequence")) if c])
    return df.limit(limit) if limit else df


def prompts(df: DataFrame, k: int, order: list[str], limit: int | None = None, default: str | None = None) -> DataFrame:
    """prompt: the first k characters of each filled sequence, in order; at least one with a limit below 1. With a default,
    that is the only prompt where no sequence is filled."""
    p = df.filter("sequence is not null and sequence <> ''").select(F.substring("sequence", 1, k).alias("prompt"), *order)
    if default is not None and p.isEmpty():
        return df.sparkSession.createDataFrame([(default,)], "prompt string")
    return p.orderBy(*order).limit(max(1, limit)) if limit is not None else p


def read_structure_scores(spark: SparkSession, path: str) -> DataFrame:
    """file, mean_plddt, atoms: mean of columns 61 to 66 of the ATOM lines of structure files; what is no number is skipped."""
    t = spark.read.text(path).select(F.input_file_name().alias("file"), "value").filter(F.col("value").startswith("ATOM"))
    v = F.trim(F.substring("value", 61, 6)).try_cast("double")
    return t.groupBy("file").agg(F.avg(v).alias("mean_plddt"), F.count(v).alias("atoms"))


def structure_by_id(scores: DataFrame, records: DataFrame, id_col: str, name: str = r"([^/]+?)(?:\.[^./]*)?$") -> DataFrame:
    """Records with the score of the structure file that bears their id; null if there is none. name finds the id in a path."""
    named = scores.select(F.regexp_extract("file", name, 1).alias("__f"), "mean_plddt")
    return records.join(named, records[id_col].cast("string") == named["__f"], "left").drop("__f")


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """step, epoch, loss, eval_loss, learning_rate of a trainer's state, entries with none of the last three dropped."""
    s = "log_history array<struct<step:bigint, epoch:double, loss:double, eval_loss:double, learning_rate:double>>"
    rows = spark.read.schema(s).option("multiLine", True).json(path).select(F.explode("log_history").alias("h")).select("h.*")
    return rows.filter("loss is not null or eval_loss is not null or learning_rate is not null")


def read_config(path: str) -> dict:
    """YAML (if the library is there) or JSON settings; an empty file gives {}."""
    with open_text(path) as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        return json.loads(text) if text.strip() else {}
    return yaml.safe_load(text) or {}


def checked_config(config: dict, known: dict[str, set[str]]) -> dict:
    """The settings, if all sections and their keys are known; a section that nothing reads is an error, not a default."""
    for section, keys in config.items():
        if section not in known:
            raise ValueError(f"unknown section: {section}")
        wrong = set(keys or {}) - known[section]
        if wrong:
            raise ValueError(f"unknown keys in {section}: {sorted(wrong)}")
    return config


def write_config(config: dict, path: str) -> None:
    """Settings with sorted keys, as YAML if the library is there, else as JSON (which YAML readers take too)."""
    try:
        import yaml
    except ImportError:
        text = json.dumps(config, sort_keys=True, indent=2)
    else:
        text = yaml.safe_dump(config, sort_keys=True)
    write_text(path, text)


def write_calibration(quantiles: dict[str, tuple[float, float]], path: str) -> None:
    """Ramps (low, high) by name, in the form that settings give them."""
    write_config({"reward": {"calibration": {k: {"low": lo, "high": hi} for k, (lo, hi) in quantiles.items()}}}, path)
