"""Sources, sinks and streams."""

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helixframe.operators import corpus as C
from helixframe.sources import json_array as J
from helixframe.sources import records as I
from helixframe.sources import sinks as W
from helixframe.streaming import streams as T


def test_array_elements_in_any_pieces():
    text = ' [ {"a": "x]},"}, 12, -3.5e2 ,"s\\"", null, [1,[2]], true ] trailing'
    want = [{"a": "x]},"}, 12, -350.0, 's"', None, [1, [2]], True]
    for size in (1, 2, 3, 7, 1000):
        pieces = iter([text[i : i + size] for i in range(0, len(text), size)])
        assert [json.loads(x) for x in J.elements(pieces)] == want
    assert list(J.elements(iter(["[", "]"]))) == []
    for bad in ("", "{}", "[1", '[{"a":', "[1 2]", "["):
        with pytest.raises(ValueError):
            list(J.elements(iter([bad])))


def test_json_documents(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('[{"id": "a", "n": 1}, {"id": "b"}]')
    assert J.sniff(spark, str(p)) == "array"
    assert [r.id for r in J.read_array(spark, str(p), "id string, n int").collect()] == ["a", "b"]
    assert [(r.ord, json.loads(r.value)["id"]) for r in J.read_array_incrementally(spark, [str(p)], 3).collect()] == [(0, "a"), (1, "b")]
    with pytest.raises(ValueError):
        J.root_kind(" x")
    (tmp_path / "cut.json").write_text('[{"id": "a"}, {"id')
    with pytest.raises(PySparkException):
        J.read_array_incrementally(spark, [str(tmp_path / "cut.json")]).collect()
    docs = spark.createDataFrame([(1, '[{"a":1}, 2, {"b":2}]'), (2, '{"data": 1, "records": [{"c":1}]}'), (3, '{"x": {"d":1}, "y": 3, "z": {"e":2}}'), (4, "nope"), (5, None)], "k int, t string")
    assert sorted((r.k, r.ord) for r in J.documents_to_operons(docs, "k", "t").collect()) == [(1, 0), (1, 2), (2, 0), (3, 0), (3, 2)]


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text("\n>one two three\nACD\nEF\n\n>empty\n>\nGGG\n")
    (tmp_path / "b.fa").write_text("before\nthis\n>x\nAC\nD\n")
    got = {r.id: r.sequence for r in I.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got.pop("one") == "ACDEF" and got.pop("empty") == "" and list(got.values()) == ["GGG"]
    assert [tuple(r) for r in I.read_fasta(spark, str(tmp_path / "b.fa")).collect()] == [("x", "ACD")]
    assert sorted(r.sequence for r in I.read_fasta_sequences(spark, str(tmp_path)).collect()) == ["ACD", "ACDEF", "GGG", "beforethis"]
    df = spark.createDataFrame([("a", "ACD" * 60, None), ("b", "A" * 80, "VI-A")], "id string, sequence string, subtype string")
    W.write_fasta(df, str(tmp_path / "out"))
    lines = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert ">a len=180 subtype=None" in lines and max(map(len, lines.split("\n"))) == 80
    assert {tuple(r) for r in I.read_fasta(spark, str(tmp_path / "out")).collect()} == {("a", "ACD" * 60), ("b", "A" * 80)}


def test_csv_and_dispatch(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("id\tsequence\na\tACD\nb\t\n")
    assert [tuple(r) for r in I.read_records(spark, str(tmp_path / "x.tsv")).collect()] == [("a", "ACD"), ("b", None)]
    (tmp_path / "x.csv").write_text('name,seq\nq,"AC\nD"\nr,EF\n')
    assert [tuple(r) for r in I.read_csv(spark, str(tmp_path / "x.csv"), "seq").collect()] == [("0", "AC\nD"), ("1", "EF")]
    (tmp_path / "x.jsonl").write_text('{"id": "a", "sequence": "AC"}\n\n{"id": "b", "sequence": "D"}\n')
    assert [r.id for r in I.read_records(spark, str(tmp_path / "x.jsonl"), limit=1).collect()] == ["a"]
    df = spark.createDataFrame([("a", 'x"y,\nz', ["p", "q"], None)], "id string, protein string, duplicate_operon_ids_sample array<string>, subtype string")
    W.write_csv(df, str(tmp_path / "out"), W.KEYWORD_FIELDS)
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out")).first()
    assert list(r.asDict()) == W.KEYWORD_FIELDS and r.protein == 'x"y,\nz' and json.loads(r.duplicate_operon_ids_sample) == ["p", "q"] and r.subtype is None


def test_jsonl(spark, tmp_path):
    W.write_jsonl(spark.createDataFrame([("a", None), (None, "é")], "id string, sequence string"), str(tmp_path / "o"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert sorted(lines) == ['{"id":"a","sequence":null}', '{"id":null,"sequence":"é"}']
    (tmp_path / "bad.jsonl").write_text('{"id": "a", "sequence": " AC "}\n{"id": \n\n{"id": "b", "sequence": "  "}\n')
    good, bad = I.read_jsonl_tolerant(spark, str(tmp_path / "bad.jsonl"))
    assert [tuple(r) for r in good.collect()] == [("a", "AC")] and bad.count() == 1
    with pytest.raises((PySparkException, Py4JJavaError)):
        I.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id string").collect()


def test_nested_export(spark):
    df = spark.createDataFrame([("i", "o", None, "g", None, 3, "ACD", '{"z":1,"a":{"q":null}}')], "id string, operon_id string, subtype string, gene_name string, hmm_name string, length int, protein string, cas_entry string")
    v = json.loads(W.nested_export(df).first().value)
    assert list(v) == sorted(v) and v["cas_entry"] == {"z": 1, "a": {"q": None}} and v["metadata"] == {"gene_name": "g", "hmm_name": None, "length": 3} and v["subtype"] is None


def test_structure_files_match_by_id(spark, tmp_path):
    line = lambda b: "ATOM  " + " " * 54 + f"{b:6.2f}"
    (tmp_path / "b2.pdb").write_text("\n".join(["HEADER", line(50), line(70), "ATOM short", "END"]))
    (tmp_path / "a1.pdb").write_text("HEADER\nEND\n")
    s = I.read_structure_scores(spark, str(tmp_path))
    rec = spark.createDataFrame([("b2",), ("a1",), ("c3",)], "id string")
    assert {r.id: r.mean_plddt for r in I.structure_by_id(s, rec, "id").collect()} == {"b2": 60.0, "a1": None, "c3": None}


def test_training_log_and_config(spark, tmp_path):
    (tmp_path / "state.json").write_text(json.dumps({"log_history": [{"step": 1, "loss": 2.5}, {"step": 2, "epoch": 1.0}, {"step": 3, "eval_loss": 1.5}], "other": 1}))
    assert [r.step for r in I.read_training_log(spark, str(tmp_path / "state.json")).collect()] == [1, 3]
    (tmp_path / "c.json").write_text('{"a": {"b": 1}}')
    (tmp_path / "e.json").write_text("")
    assert I.read_config(str(tmp_path / "c.json")) == {"a": {"b": 1}} and I.read_config(str(tmp_path / "e.json")) == {}


def test_training_log_is_written_whole_in_bounded_files(spark, tmp_path):
    p = str(tmp_path / "log")
    rows = [(i, None if i == 7 else i / 4) for i in range(1000)]
    W.write_training_log(spark.createDataFrame(rows, "event_id bigint, value double"), p, "event_id", "value", most=100)
    sizes = [len(json.loads(f.read_text())["log_history"]) for f in (tmp_path / "log").rglob("*.json")]
    assert len(sizes) == 10 and sum(sizes) == 999 and max(sizes) < 200
    assert sorted((r.step, r.loss) for r in I.read_training_log(spark, p).collect()) == [r for r in rows if r[0] != 7]


def test_training_log_query_writes_every_event(spark, data, monkeypatch):
    from helixframe.plans import io as P

    read = []
    monkeypatch.setattr(P.I, "read_training_log", lambda s, p, old=I.read_training_log: read.append(old(s, p)) or read[-1])
    n = P.training_log(spark, data).count()
    assert n == read[0].count() == spark.read.parquet(f"{data}/events.parquet").filter("value is not null").count()


def test_settings(tmp_path):
    p = str(tmp_path / "cal.yaml")
    I.write_calibration({"lm": (-5.0, -0.5)}, p)
    assert I.read_config(p) == {"reward": {"calibration": {"lm": {"low": -5.0, "high": -0.5}}}}
    known = {"reward": {"calibration"}}
    assert I.checked_config(I.read_config(p), known)
    for bad in ({"rewards": {}}, {"reward": {"callibration": 1}}):
        with pytest.raises(ValueError, match="unknown"):
            I.checked_config(bad, known)


def test_prompts(spark):
    df = spark.createDataFrame([("b", "ACDEF"), ("a", "GHIKL"), ("c", None), ("d", "")], "id string, sequence string")
    assert [r.prompt for r in I.prompts(df, 3, ["id"], 0).collect()] == ["GHI"]
    assert {r.prompt for r in I.prompts(df, 3, ["id"]).collect()} == {"ACD", "GHI"}
    assert [r.prompt for r in I.prompts(df.limit(0), 3, ["id"], default="M").collect()] == ["M"]


def test_cache_table(spark, tmp_path):
    p = str(tmp_path / "cache")
    W.append_cache(spark.createDataFrame([("k", 1.0)], "key string, score double"), p)
    W.append_cache(spark.createDataFrame([("k", 2.0)], "key string, score double"), p)
    from helixframe.operators.scoring import latest

    assert [(r.key, r.score) for r in latest(spark.read.parquet(p)).collect()] == [("k", 2.0)]


def test_stream_dedup_resumes(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    mk = lambda rows: spark.createDataFrame(rows, "id int, sequence string").coalesce(1).write.mode("append").parquet(src)
    mk([(1, "ACD"), (2, "acd*"), (3, None), (4, "")])
    assert [r.clean for r in T.dedup_stream(spark, src, "sequence", out, ck).collect()] == ["ACD"]
    mk([(5, "ACD"), (6, "EF")])
    assert sorted(r.clean for r in T.dedup_stream(spark, src, "sequence", out, ck).collect()) == ["ACD", "EF"]


def test_stream_metrics_over_a_log(spark, tmp_path):
    src, out, ck = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "step int, reward double"
    W.append_log(spark.createDataFrame([(1, 1.0), (1, 3.0)], schema), src)
    run = lambda: {r.step: (r.n, r.mean, r.min, r.max) for r in T.metrics_stream(spark, src, "step", "reward", out, ck, "json", schema).collect()}
    assert run() == {1: (2, 2.0, 1.0, 3.0)}
    W.append_log(spark.createDataFrame([(2, 5.0), (1, 2.0)], schema), src)
    assert run() == {1: (3, 2.0, 1.0, 3.0), 2: (1, 5.0, 5.0, 5.0)}


def test_open_windows_and_late_rows_are_counted(spark, tmp_path):
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    save = lambda *days: spark.createDataFrame([(f"2024-01-{d:02} 12:00:00", "a") for d in days], "t string, k string").selectExpr("cast(t as timestamp) as ts", "k").coalesce(1).write.mode("append").parquet(src)
    run = lambda: {r.window_start.day: r.n for r in T.all_windowed_counts(spark, f"{src}/*.parquet", "ts", "k", "1 day", out, ck).collect()}
    save(1, 1, 9)
    assert run() == {1: 2, 9: 1}  # the last day is open
    save(2, 9)
    assert run() == {1: 2, 2: 1, 9: 2}  # a row a week late


def test_score_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "ACD")], "id int, sequence string").write.parquet(src)
    out = T.score_stream(spark, src, lambda b: b.withColumn("n", F.length("sequence")), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert [(r.id, r.n, r.batch) for r in out.collect()] == [(1, 3, 0)]


def test_keyword_corpus_writes_all_sinks(spark, data, tmp_path):
    r = C.keyword_records(spark.read.parquet(f"{data}/crispr_cas_atlas.parquet"))
    W.write_jsonl(r, str(tmp_path / "j"))
    W.write_csv(r, str(tmp_path / "c"), W.KEYWORD_FIELDS)
    W.write_fasta(r, str(tmp_path / "f"))
    n = r.count()
    assert n > 0 and spark.read.json(str(tmp_path / "j")).count() == n and I.read_fasta(spark, str(tmp_path / "f")).count() == n


def test_array_elements_are_searched_once_and_checked():
    long = json.dumps([{"k": "\\\" ] } " * 50, "n": list(range(200))}] * 40)
    pieces = lambda text, k: iter([text[i : i + k] for i in range(0, len(text), k)])
    assert [json.loads(x) for x in J.elements(pieces(long, 5))] == json.loads(long)
    (deep,) = J.elements(iter(["[" + "[" * 30_000, "]" * 30_000 + "]"]))
    assert len(deep) == 60_000
    for bad in ('[{"a": }, 1]', "[tru, 1]", '["a\\', "[1,]"):
        with pytest.raises(ValueError):
            list(J.elements(iter([bad])))


def test_order_of_keys_is_kept(spark):
    docs = spark.createDataFrame([(1, '{"z": {"a": 1}, "b": 2, "a": {"a": 3}}')], "k int, t string")
    got = J.documents_to_operons(docs, "k", "t").select("ord", F.expr("try_variant_get(value, '$.a', 'int')").alias("a")).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1), (2, 3)]


def test_rows_of_several_files_are_numbered_by_file(spark, tmp_path):
    for name, n in (("a", 3), ("b", 2)):
        (tmp_path / f"{name}.csv").write_text("seq\n" + "".join(f"{name.upper()}{i}\n" for i in range(n)))
    got = sorted((r.sequence, r.id) for r in I.read_csv(spark, str(tmp_path), "seq").collect())
    assert got == [("A0", "0"), ("A1", "1"), ("A2", "2"), ("B0", "0"), ("B1", "1")]


def test_a_batch_that_is_run_again_is_kept_once(spark, tmp_path):
    out = str(tmp_path / "out")
    for _ in range(2):
        T._batch(spark.createDataFrame([(1,), (2,)], "id int"), out, 0)
    T._batch(spark.createDataFrame([(3,)], "id int"), out, 1)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3] and [r.id for r in T._last(spark, out).collect()] == [3]


def test_dedup_with_bounded_state(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("2024-01-01", "ACD"), ("2024-01-01", "acd"), ("2024-01-02", "EF")], "t string, sequence string").selectExpr("cast(t as timestamp) as t", "sequence").coalesce(1).write.parquet(src)
    out = T.dedup_stream(spark, src, "sequence", str(tmp_path / "out"), str(tmp_path / "ck"), at="t", within="1 hour")
    assert sorted(r.clean for r in out.collect()) == ["ACD", "EF"]


def test_required_sequence(spark):
    from helixframe.functions import sequence as S

    df = spark.createDataFrame([("", "B")], "a string, b string")
    assert df.select(S.required(F.col("a"), F.col("b")).alias("x")).first().x == "B"
    with pytest.raises((PySparkException, Py4JJavaError)):
        df.select(S.required(F.col("a"), F.lit(None)).alias("x")).collect()
