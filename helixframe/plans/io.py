"""Queries through sources and sinks: what is written is read again and must equal the plain selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import corpus as C
from ..runtime import scratch, table
from ..sources import json_array as J
from ..sources import records as I
from ..sources import sinks as W
from ..streaming import streams as T
from .base import SQL_RECORDS, SQL_SPLITS, query, records, splits


@query(f"with {SQL_RECORDS} select id, s as sequence from recs where s <> ''")
def fasta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    p = scratch(spark)
    W.write_fasta(records(spark, d).filter("s <> ''").select("id", F.col("s").alias("sequence"), "subtype"), p)
    return I.read_fasta(spark, p)


@query(f"with {SQL_RECORDS} select id, s as sequence from recs where s <> ''")
def fasta_piped_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    p = scratch(spark)
    W.write_fasta_piped(records(spark, d).filter("s <> ''").select("id", F.regexp_replace("operon_id", r"\s", "").alias("operon_id"), F.regexp_replace("gene_name", r"\s", "").alias("gene_name"), F.regexp_replace("hmm_name", r"\s", "").alias("hmm_name"), F.col("s").alias("protein")), p)
    return I.read_fasta(spark, p).select(F.element_at(F.split("id", r"\|"), 1).alias("id"), "sequence")


@query(f"with {SQL_RECORDS} select id, s as sequence from recs")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    p = scratch(spark)
    W.write_csv(records(spark, d).withColumn("sequence", F.col("s")), p, W.KEYWORD_FIELDS)
    return I.read_csv(spark, p, "sequence", "id").select("id", S.text("sequence").alias("sequence"))


@query("select id, sequence from train_seqs where id is not null")
def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Nulls are written and come back."""
    p = scratch(spark)
    W.write_jsonl(table(spark, d, "train_seqs").filter("id is not null").select("id", "sequence"), p)
    return I.read_jsonl(spark, p, "id string, sequence string")


@query("select id, trim(sequence) as sequence from candidates where sequence is not null and trim(sequence) <> ''")
def jsonl_tolerant(spark: SparkSession, d: str) -> DataFrame:
    """Broken lines are passed over, blank sequences dropped."""
    p = scratch(spark)
    t = table(spark, d, "candidates")
    W.write_jsonl(t.select("id", "sequence"), p)
    t.limit(5).select(F.lit('{"id": "broken').alias("value")).write.mode("append").text(p)
    return I.read_jsonl_tolerant(spark, p)[0]


@query("""with o as (select row_id, json_extract(payload, '$') as j from atlas_raw where json_valid(payload)), k as (select row_id, case when json_type(j) = 'ARRAY' then j
 when json_type(j, '$.operons') = 'ARRAY' then json_extract(j, '$.operons') when json_type(j, '$.data') = 'ARRAY' then json_extract(j, '$.data') when json_type(j, '$.records') = 'ARRAY' then json_extract(j, '$.records')
 when json_type(j, '$.items') = 'ARRAY' then json_extract(j, '$.items') end as a, j from o), e as (select row_id, unnest(range(json_array_length(a)::bigint))::int as ord, unnest(from_json(a, '["json"]')) as v from k where a is not null)
 select row_id, ord from e where json_type(v) = 'OBJECT' union all
 select row_id, pos::int as ord from (select row_id, unnest(range(len(json_keys(j))))::int as pos, unnest(list_transform(json_keys(j), lambda x: json_type(j, '$."' || x || '"'))) as kind from k where a is null and json_type(j) = 'OBJECT') where kind = 'OBJECT'""")
def root_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Places of the root objects: arrays, wrapped arrays, objects of objects."""
    return J.documents_to_operons(table(spark, d, "atlas_raw"), "row_id", "payload").select("row_id", F.col("ord").cast("int").alias("ord"))


@query("""with o as (select row_id, json_extract(payload, '$') as j from atlas_raw where json_valid(payload)), k as (select row_id, case when json_type(j, '$.items') = 'ARRAY' then json_extract(j, '$.items')
 when json_type(j, '$.records') = 'ARRAY' then json_extract(j, '$.records') when json_type(j, '$.data') = 'ARRAY' then json_extract(j, '$.data') when json_type(j, '$.operons') = 'ARRAY' then json_extract(j, '$.operons') end as a
 from o where json_type(j) = 'OBJECT'), e as (select row_id, unnest(range(json_array_length(a)::bigint))::int as ord, unnest(from_json(a, '["json"]')) as v from k where a is not null)
 select row_id, ord, json_extract_string(v, '$.operon_id') as operon_id from e where json_type(v) = 'OBJECT'""")
def root_shapes_reversed(spark: SparkSession, d: str) -> DataFrame:
    """Objects that wrap an array, with the wrapper keys tried in the reverse order."""
    t = table(spark, d, "atlas_raw").filter(J.root_kinds(F.col("payload")) == "object")
    o = J.documents_to_operons(t, "row_id", "payload", tuple(reversed(J.WRAPPERS)))
    wrapped = [F.expr(f"coalesce(startswith(schema_of_variant(try_variant_get(try_parse_json(payload), '$.{k}', 'variant')), 'ARRAY'), false)") for k in J.WRAPPERS]
    holds = t.select("row_id").filter(wrapped[0] | wrapped[1] | wrapped[2] | wrapped[3])
    return o.join(holds, "row_id", "left_semi").select("row_id", F.col("ord").cast("int").alias("ord"), F.expr("try_variant_get(value, '$.operon_id', 'string')").alias("operon_id"))


@query("""select row_id, case left(trim(payload, ' ' || chr(9) || chr(10) || chr(13)), 1) when '[' then 'array' when '{' then 'object' end as kind from atlas_raw where payload is not null""")
def root_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What each payload's first character says of its root."""
    return table(spark, d, "atlas_raw").filter("payload is not null").select("row_id", J.root_kinds(F.col("payload")).alias("kind"))


def _array_file(rows: DataFrame, path: str) -> str:
    """One file that holds rows (ord, value) as a JSON array, written by one task as such files are; its path."""
    text = F.concat(F.when(F.col("ord") == 0, "[").otherwise(","), F.col("value"))
    last = rows.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("m")).select((F.col("m") + 1).alias("ord"), F.when(F.col("m") < 0, "[]").otherwise("]").alias("line"))
    rows.select("ord", text.alias("line")).unionByName(last).coalesce(1).sortWithinPartitions("ord").select("line").write.text(path)
    return rows.sparkSession.read.text(path).select(F.input_file_name().alias("f")).first().f


@query(f"with {SQL_RECORDS} select row_number() over (order by id) - 1 as ord, id, length(s)::int as n from recs")
def json_array_scan(spark: SparkSession, d: str) -> DataFrame:
    """One large JSON array, read piece by piece."""
    rows = C.with_ordinal(records(spark, d).select("id", F.col("s").alias("sequence")), ["id"]).select("ord", F.to_json(F.struct("id", "sequence")).alias("value"))
    e = J.read_array_incrementally(spark, [_array_file(rows, scratch(spark))], 1 << 16)
    return e.select("ord", F.get_json_object("value", "$.id").alias("id"), F.length(F.get_json_object("value", "$.sequence")).alias("n"))


@query(f"with {SQL_RECORDS} select id, s as sequence from recs")
def json_array_whole(spark: SparkSession, d: str) -> DataFrame:
    """A JSON array of moderate size, read with a schema at once; its root is looked at first."""
    rows = C.with_ordinal(records(spark, d).select("id", F.col("s").alias("sequence")), ["id"]).select("ord", F.to_json(F.struct("id", "sequence")).alias("value"))
    p = scratch(spark)
    _array_file(rows, p)
    if J.sniff(spark, p) != "array":
        raise ValueError("the file's root is no array")
    return J.read_array(spark, p, "id string, sequence string")


@query(f"with {SQL_RECORDS} select s as sequence from recs where s <> ''")
def fasta_sequences(spark: SparkSession, d: str) -> DataFrame:
    """The sequences of a FASTA file without their headers."""
    p = scratch(spark)
    W.write_fasta(records(spark, d).select("id", F.col("s").alias("sequence"), "subtype"), p)
    return I.read_fasta_sequences(spark, p)


@query(f"with {SQL_RECORDS} select kind, id, s as sequence from recs, (values ('csv'), ('fasta'), ('jsonl')) k(kind) where s <> ''")
def by_suffix(spark: SparkSession, d: str) -> DataFrame:
    """The same records in three forms, each read by the suffix of its path."""
    p, r = scratch(spark), records(spark, d).filter("s <> ''").select("id", F.col("s").alias("sequence"), "subtype")
    W.write_csv(r, f"{p}/a.csv", ["id", "sequence"])
    W.write_fasta(r, f"{p}/a.fasta")
    W.write_jsonl(r.select("id", "sequence"), f"{p}/a.jsonl")
    csv, fasta, jsonl = (I.read_records(spark, f"{p}/a.{k}").select(F.lit(k).alias("kind"), "id", "sequence") for k in ("csv", "fasta", "jsonl"))
    return csv.unionByName(fasta).unionByName(jsonl)


@query("""with s as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as k, count(*) over (partition by event_type) as n from events where value is not null)
 select event_type as name, max(case when k = round_even((n - 1) * 0.1::double, 0) then value end) as low, max(case when k = round_even((n - 1) * 0.9::double, 0) then value end) as high from s group by 1""")
def calibration_file(spark: SparkSession, d: str) -> DataFrame:
    """Calibration ramps through their settings file, whose sections are checked."""
    from .stats import calibration_quantiles

    p = f"{scratch(spark)}/calibration.yaml"
    I.write_calibration({r.event_type: (r.low, r.high) for r in calibration_quantiles(spark, d).collect()}, p)  # one row a kind of metric
    ramps = I.checked_config(I.read_config(p), {"reward": {"calibration"}})["reward"]["calibration"]
    return spark.createDataFrame([(k, float(v["low"]), float(v["high"])) for k, v in ramps.items()], "name string, low double, high double")


@query(f"with {SQL_RECORDS} select id, true as utc, true as now from recs")
def cache_times(spark: SparkSession, d: str) -> DataFrame:
    """New cache rows bear the time of writing, in UTC to the microsecond."""
    p = scratch(spark)
    W.append_cache(records(spark, d).select("id", "h"), p)
    t = F.col("created_at")
    return spark.read.parquet(p).select("id", t.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}(Z|\+00:00)$").alias("utc"), (F.abs(F.unix_timestamp() - F.unix_timestamp(F.to_timestamp(t))) < 3600).alias("now"))


@query("with g as (select row_id, case when len(cas) > 0 then cas end as c from crispr_cas_atlas) select row_id, len(c)::int as n_entries from g where c is not null")
def nested_export(spark: SparkSession, d: str) -> DataFrame:
    """Operons written as nested JSON lines and read with a schema."""
    p = scratch(spark)
    t = table(spark, d, "crispr_cas_atlas").filter(F.size("cas") > 0).select("row_id", "cas")
    W.write_jsonl(t, p)
    return spark.read.schema(t.schema).json(p).select("row_id", F.size("cas").alias("n_entries"))


@query("""with c as (select row_id, unnest(range(len(cas)))::int as gene_index, unnest(cas) as g from crispr_cas_atlas) select row_id, gene_index, g.gene_name as gene_name, g.hmm_name as hmm_name from c where g is not null
 and (contains(lower(coalesce(g.gene_name, '')), 'cas9') or contains(lower(coalesce(g.hmm_name, '')), 'cas9') or contains(lower(coalesce(g.product, '')), 'cas9') or contains(lower(coalesce(g.annotation, '')), 'cas9'))
 qualify row_number() over (partition by case when regexp_replace(upper(coalesce(g.protein, '')), '[^ACDEFGHIKLMNPQRSTVWYX]', '', 'g') <> '' then regexp_replace(upper(coalesce(g.protein, '')), '[^ACDEFGHIKLMNPQRSTVWYX]', '', 'g') else regexp_replace(upper(coalesce(g.sequence, '')), '[^ACDEFGHIKLMNPQRSTVWYX]', '', 'g') end order by row_id, gene_index) = 1
 and (regexp_replace(upper(coalesce(g.protein, '')), '[^ACDEFGHIKLMNPQRSTVWYX]', '', 'g') <> '' or regexp_replace(upper(coalesce(g.sequence, '')), '[^ACDEFGHIKLMNPQRSTVWYX]', '', 'g') <> '')""")
def nested_record_export(spark: SparkSession, d: str) -> DataFrame:
    """Records with their source object embedded, keys sorted; the object is read out of the file again."""
    p = scratch(spark)
    t = table(spark, d, "crispr_cas_atlas").select("row_id", "operon_id", "summary", "cas")
    r = C.any_field_records(t)
    W.write_nested(r.withColumn("operon_id", F.concat_ws(":", F.col("row_id").cast("string"), F.col("gene_index").cast("string"))), p)
    v = spark.read.text(p)
    at = F.split(F.get_json_object("value", "$.operon_id"), ":")
    return v.select(at[0].cast("bigint").alias("row_id"), at[1].cast("int").alias("gene_index"), F.get_json_object("value", "$.cas_entry.gene_name").alias("gene_name"), F.get_json_object("value", "$.cas_entry.hmm_name").alias("hmm_name"))


@query("select vec_id, round(avg(v), 3) as mean_plddt, count(*) as atoms from (select vec_id, round(abs(unnest(embedding)::double) * 100, 2) as v from embeddings) group by vec_id")
def structure_files(spark: SparkSession, d: str) -> DataFrame:
    """Fixed-width structure files, one a record, matched by id."""
    p = scratch(spark)
    t = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    line = F.concat(F.lit("ATOM  "), F.lpad(F.col("i").cast("string"), 5, " "), F.lpad(F.lit(""), 49, " "), F.format_string("%6.2f", F.round(F.abs(F.col("x").cast("double")) * 100, 2)))
    text = t.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("l")))).alias("a")).select("vec_id", F.explode(F.concat(F.array(F.lit("HEADER")), F.transform("a", lambda x: x["l"]), F.array(F.lit("ATOM  short line"), F.lit("END")))).alias("value"))
    text.repartition(4, "vec_id").sortWithinPartitions("vec_id").write.partitionBy("vec_id").text(p)
    s = I.read_structure_scores(spark, p).withColumn("vec_id", F.regexp_extract("file", r"vec_id=(\d+)", 1).cast("bigint"))
    return s.groupBy("vec_id").agg(F.round(F.sum(F.col("mean_plddt") * F.col("atoms")) / F.sum("atoms"), 3).alias("mean_plddt"), F.sum("atoms").alias("atoms"))


@query("select vec_id, round(avg(v), 3) as mean_plddt from (select vec_id, round(abs(unnest(embedding)::double) * 100, 2) as v from embeddings) group by vec_id")
def structure_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Records with the score of the structure file that bears their id."""
    p, t = scratch(spark), table(spark, d, "embeddings")
    line = F.concat(F.lit("ATOM  "), F.lit(" " * 54), F.format_string("%6.2f", F.round(F.abs(F.col("x").cast("double")) * 100, 2)))
    t.select("vec_id", F.explode("embedding").alias("x")).select("vec_id", line.alias("value")).repartition(4, "vec_id").sortWithinPartitions("vec_id").write.partitionBy("vec_id").text(p)
    out = I.structure_by_id(I.read_structure_scores(spark, p), t.select("vec_id"), "vec_id", r"vec_id=(\d+)")
    return out.select("vec_id", F.round("mean_plddt", 3).alias("mean_plddt"))


@query("select event_id as step, round(value, 6) as loss from events where value is not null")
def training_log(spark: SparkSession, d: str) -> DataFrame:
    """A trainer's log of all events, in state files of bounded size, all of them read again."""
    p = scratch(spark)
    W.write_training_log(table(spark, d, "events"), p, "event_id", "value")
    return I.read_training_log(spark, p).select("step", F.round("loss", 6).alias("loss"))


@query(f"with {SQL_SPLITS} select count(*) as n, count(distinct seq) as n_unique, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'valid') as valid, count(*) filter (where split = 'test') as test from splits")
def split_report(spark: SparkSession, d: str) -> DataFrame:
    """A one-row report through its JSON file."""
    p = scratch(spark)
    r = splits(spark, d).agg(F.count("*").alias("n"), F.count_distinct("seq").alias("n_unique"), *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "valid", "test")])
    W.write_report(r, p)
    return spark.read.schema(r.schema).json(p)


# Streams


@query("select distinct sha256(regexp_replace(upper(coalesce(sequence, '')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')) as sha256 from cas13_sequences where regexp_replace(upper(coalesce(sequence, '')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') <> ''")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Which row of a key arrives first depends on the files; which keys there are doesn't."""
    p = scratch(spark)
    return T.dedup_stream(spark, f"{d}/cas13_sequences.parquet", "sequence", f"{p}/out", f"{p}/checkpoint").select("sha256")


@query("select event_type, count(*) as n, round(avg(value), 6) as mean, min(value) as min, max(value) as max from events group by 1")
def stream_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = scratch(spark)
    return T.metrics_stream(spark, f"{d}/events.parquet", "event_type", "value", f"{p}/out", f"{p}/checkpoint").withColumn("mean", F.round("mean", 6))


@query("""select date_trunc('day', ts)::timestamp as window_start, event_type, count(*) as n from events where ts is not null group by 1, 2
 having date_trunc('day', ts)::timestamp + interval 1 day <= (select max(ts) from events) - interval 1 hour""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts by type behind a watermark; the last windows stay open."""
    p = scratch(spark)
    return T.windowed_counts(spark, f"{d}/events.parquet", "ts", "event_type", "1 day", "1 hour", f"{p}/out", f"{p}/checkpoint")


@query("select date_trunc('day', ts)::timestamp as window_start, event_type, count(*) as n from events where ts is not null group by 1, 2")
def stream_windows_whole(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts by type of the whole table, with the windows that are still open when the input ends."""
    p = scratch(spark)
    return T.all_windowed_counts(spark, f"{d}/events.parquet", "ts", "event_type", "1 day", f"{p}/out", f"{p}/checkpoint")


@query("select distinct sha256(regexp_replace(upper(coalesce(sequence, '')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')) as sha256 from cas13_sequences where regexp_replace(upper(coalesce(sequence, '')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') <> ''")
def stream_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The same stream in two runs: the second goes on from the first one's checkpoint when the other half has arrived."""
    p, t = scratch(spark), table(spark, d, "cas13_sequences")
    second = F.pmod(F.xxhash64("id", "loaded_at", "sequence"), F.lit(2)) == 1
    for half in (~second, second):
        t.filter(half).write.mode("append").parquet(f"{p}/in")
        out = T.dedup_stream(spark, f"{p}/in", "sequence", f"{p}/out", f"{p}/checkpoint")
    return out.select("sha256")


@query("select id, step, length(coalesce(sequence, ''))::int as n from candidates")
def stream_scores(spark: SparkSession, d: str) -> DataFrame:
    """Arriving rows scored batch by batch, each batch kept once."""
    p = scratch(spark)
    return T.score_stream(spark, f"{d}/candidates.parquet", lambda b: b.select("id", "step", F.length(S.text("sequence")).alias("n")), f"{p}/out", f"{p}/checkpoint").select("id", "step", "n")
