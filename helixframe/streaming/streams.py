"""Incremental forms: deduplication in arrival order, aggregation of logs, windowed counts with late rows, append sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S


def _run(stream, checkpoint: str):
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_stream(spark: SparkSession, path: str, kind: str = "parquet", schema=None, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream; its schema is the files' unless given (log files need one). path may be a folder, a file or a pattern."""
    schema = schema or spark.read.format(kind).load(path).schema
    r = spark.readStream.schema(schema).format(kind)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path if "*" in path else f"{path.rstrip('/')}*")  # only a pattern may stand for a single file


def _batch(df: DataFrame, out: str, n: int) -> None:
    """A batch in a folder of its own, so that one that is run again after a failure replaces itself."""
    df.write.mode("overwrite").parquet(f"{out}/batch={n}")


def _last(spark: SparkSession, out: str) -> DataFrame:
    every = spark.read.parquet(out)
    return every.filter(F.col("batch") == every.agg(F.max("batch")).first()[0]).drop("batch")


def dedup_stream(spark: SparkSession, path: str, seq_col: str, out: str, checkpoint: str, kind: str = "parquet", at: str | None = None, within: str | None = None) -> DataFrame:
    """The first row to arrive of each cleaned sequence, appended to out. A restart goes on where it stopped. Returns what out
    holds. State is one 32-byte key a sequence, spread over the shuffle partitions; with a time column and a span, keys are
    forgotten once the watermark has passed them by that span, which bounds the state, and a sequence may come again."""
    s = read_stream(spark, path, kind).withColumn("clean", S.clean(seq_col)).filter("clean <> ''").withColumn("sha256", S.content_hash("clean"))
    once = s.withColumn("__t", F.col(at).cast("timestamp")).withWatermark("__t", within).dropDuplicatesWithinWatermark(["sha256"]).drop("__t") if at and within else s.dropDuplicates(["sha256"])
    _run(once.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)
    return spark.read.parquet(out)


def metrics_stream(spark: SparkSession, path: str, key: str, value: str, out: str, checkpoint: str, kind: str = "parquet", schema=None) -> DataFrame:
    """Running count, mean, min and max of value by key over an append-only log, after the last batch; out holds the state
    after each batch in a folder of its own."""

    def save(batch: DataFrame, n: int) -> None:
        _batch(batch, out, n)

    agg = read_stream(spark, path, kind, schema).groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    _run(agg.writeStream.outputMode("complete").foreachBatch(save), checkpoint)
    return _last(spark, out)


def windowed_counts(spark: SparkSession, path: str, at: str, key: str, width: str, late: str, out: str, checkpoint: str) -> DataFrame:
    """Counts by event-time window and key; a window is written once the watermark has passed it, rows later than that are
    left out."""
    s = read_stream(spark, path).withColumn("__t", F.col(at).cast("timestamp")).withWatermark("__t", late)
    agg = s.groupBy(F.window("__t", width).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
    _run(agg.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint)
    return spark.read.parquet(out)


def all_windowed_counts(spark: SparkSession, path: str, at: str, key: str, width: str, out: str, checkpoint: str) -> DataFrame:
    """Counts by event-time window and key of all rows so far, open windows and late rows too; out holds the state after each
    batch, and all windows stay in it."""

    def save(batch: DataFrame, n: int) -> None:
        _batch(batch, out, n)

    s = read_stream(spark, path).withColumn("__t", F.col(at).cast("timestamp"))
    agg = s.groupBy(F.window("__t", width).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
    _run(agg.writeStream.outputMode("complete").foreachBatch(save), checkpoint)
    return _last(spark, out)


def score_stream(spark: SparkSession, path: str, score, out: str, checkpoint: str, kind: str = "parquet") -> DataFrame:
    """Each arriving batch scored and added to out, once, also if it is run again: score takes and gives a DataFrame."""

    def save(batch: DataFrame, n: int) -> None:
        _batch(score(batch), out, n)

    _run(read_stream(spark, path, kind).writeStream.foreachBatch(save), checkpoint)
    return spark.read.parquet(out)
