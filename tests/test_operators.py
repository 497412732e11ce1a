"""Operators on small fixtures: nulls, empties, ties, repeats, clashing names."""

import json
import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import rewards as R
from helixframe.operators import corpus as C
from helixframe.operators import nested as N
from helixframe.operators import pairs as P
from helixframe.operators import policy as L
from helixframe.operators import scoring as O
from helixframe.operators import stats as A
from helixframe.plans import nested as NQ

GENE = "struct<gene_name:string,hmm_name:string,protein:string,sequence:string,product:string,annotation:string>"
OPERONS = f"row_id bigint, operon_id string, summary struct<subtype:string,subtype_score:string>, cas array<{GENE}>, cas_genes array<{GENE}>"


def gene(name=None, protein=None, **more):
    return {"gene_name": name, "protein": protein} | more


def operons(spark, rows):
    return spark.createDataFrame([{"row_id": i, "operon_id": o, "summary": {"subtype": t}, "cas": a, "cas_genes": b} for i, (o, t, a, b) in enumerate(rows)], OPERONS)


def test_keyword_records(spark):
    df = operons(spark, [
        ("o1", "VI-A", [gene("Cas13a", "acdefX"), None, gene("Cas9", "AAAA"), gene("cas13b", "")], None),
        ("", "V", [], [gene("x", "ACDEF", hmm_name="c2c2_1")]),
        (None, None, None, [gene("CAS13", "ACD"), gene("Cas13d", "***"), gene("Cas13d", None)]),
        ("o4", None, None, None),
    ])
    out = C.keyword_records(df).collect()
    assert [(r.operon_id, r.sequence, r.duplicate_count, r.duplicate_operon_ids_sample) for r in out] == [("o1", "ACDEF", 2, ["o1", "operon_1"])]
    assert out[0].id == "cas13kw_000000_" + out[0].sha256[:12]
    c = A.corpus_counters(C.keyword_corpus(df)).first()
    assert (c.raw_entries, c.nonempty_protein, c.post_clean, c.unique_sequences, c.duplicates_removed, c.changed_by_cleaning) == (5, 3, 2, 1, 1, 1)
    assert C.keyword_records(df.limit(0)).count() == 0


def test_any_field_records(spark):
    df = operons(spark, [
        ("o1", "II-A", [gene("Cas9", "MKX"), gene("y", None, sequence="mkx", product="CAS9-like")], None),
        ("o2", "II", [gene("z", "MKY", annotation="a cas9 homologue"), gene("Cas1", "MMM")], [gene("Cas9", "QQQ")]),
    ])
    out = C.any_field_records(df).orderBy("id").collect()
    assert [(r.id, r.protein) for r in out] == [("cas9_000001", "MKX"), ("cas9_000002", "MKY")]
    assert json.loads(out[1].cas_entry)["annotation"] == "a cas9 homologue"


def test_raw_typed_records(spark):
    s = "name string, cas_systems array<struct<type:string,proteins:array<struct<sequence:string>>>>"
    rows = [("a", [("type vi", [(" acd ",), ("ACX",), (None,)]), ("II", [("ACD",)])]), (None, [("cas13", [("ACD",), ("ACD",)])]), ("c", None)]
    out = C.raw_typed_records(spark.createDataFrame(rows, s), 2).collect()
    assert sorted((r.sequence, r.organism, r.system_type) for r in out) == [("ACD", "", "CAS13"), ("ACD", "", "CAS13"), ("ACD", "a", "TYPE VI")]


def test_ordinals_are_dense_across_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("c").alias("ord2")).repartition(7)
    got = {r.x: r.ord for r in C.with_ordinal(df, ["x"]).collect()}
    assert got == {i: i for i in range(1000)}
    assert C.with_ordinal(df.limit(0), ["x"]).count() == 0


def test_splits_and_samples(spark):
    df = spark.range(103).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("split2"))
    out = C.split_by_rank(df, "k", {"train": 0.9, "valid": 0.05, "test": 0.05})
    n = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert n == {"train": 92, "valid": 5, "test": 6}
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in C.split_by_rank(df.repartition(5), "k", {"train": 0.9, "valid": 0.05, "test": 0.05}).collect()}
    with pytest.raises(ValueError, match="sum to 1"):
        C.split_by_rank(df, "k", {"train": 0.9, "test": 0.2})
    assert C.sample_exactly(df, "k", 10).count() == 10 and C.sample_exactly(df, "k", 1000).count() == 103


def test_duplicate_groups(spark):
    rows = [("a", 3, "z"), ("a", 1, None), ("a", 2, "y"), ("b", 4, "x")]
    out = {r.k: r for r in C.duplicate_groups(spark.createDataFrame(rows, "k string, o int, v string"), "k", ["o"], ["v"], {"vs": "v"}, 2).collect()}
    assert (out["a"].n, out["a"].v, out["a"].vs, out["a"].first_o) == (3, None, [None, "y"], 1) and out["b"].n == 1


def test_summaries_on_nothing(spark):
    df = spark.createDataFrame([], "n int, g string")
    r = df.agg(F.count("*").alias("n"), *A.length_summary(F.col("n"))).first()
    assert r.n == 0 and set(r[1:]) == {0.0}
    assert [x.n for x in A.length_bins(spark, df, F.col("n")).collect()] == [0] * 7
    assert A.nearest_rank(df, F.col("n"), 0.5).first().value == 0.0
    assert df.agg(A.share(F.col("n") > 1).alias("v")).first().v == 0.0


def test_nearest_rank_rounds_half_to_even(spark):
    for n in range(1, 30):
        df = spark.createDataFrame([(float(i % 11),) for i in range(n)], "x double")
        vals = sorted(i % 11 for i in range(n))
        for q in (0.1, 0.5, 0.9) if n % 7 == 0 else (0.5,):
            assert A.nearest_rank(df, F.col("x"), q).first().value == vals[min(n - 1, max(0, round((n - 1) * q)))]


def test_nearest_rank_of_groups(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), float(r.randrange(40))) for _ in range(500)] + [("c", None), ("d", 7.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = {x.g: x.value for x in A.nearest_rank(df, F.col("x"), 0.25, ["g"]).collect()}
    for g in ("a", "b", None, "d"):
        vals = sorted(v for k, v in rows if k == g and v is not None)
        assert got.pop(g) == vals[round((len(vals) - 1) * 0.25)]
    assert not got


def test_running_totals(spark):
    df = spark.range(200).select((F.col("id") * 37 % 200).alias("x"), (F.col("id") % 5).alias("w")).repartition(9)
    rows = sorted((r.x, r.w, r.before) for r in C.with_running_total(df, ["x"], "w").collect())
    assert [b for _, _, b in rows] == [sum(w for _, w, _ in rows[:i]) for i in range(200)]


def test_first_rows_are_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), F.lit("x").alias("v"))
    out = C.first_wins(df, ["k"], ["o"])
    plan = out._jdf.queryExecution().executedPlan().toString()  # before it runs: afterwards it holds the first plan too
    limits = [line for line in plan.splitlines() if "WindowGroupLimit" in line]
    assert [x.rsplit(", ", 1)[1] for x in limits] == ["Final", "Partial"]
    assert sorted(r.o for r in out.collect()) == [0, 1, 2]


def test_bins_and_top(spark):
    df = spark.createDataFrame([(n,) for n in (0, 199, 200, 499, 850, 999, 1000, 1499, 1500, 9000)], "n int")
    assert [r.n for r in A.length_bins(spark, df, F.col("n")).orderBy("bin_ord").collect()] == [2, 2, 0, 2, 1, 1, 2]
    t = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("a", 4), ("b", 5), (None, 0)], "v string, o int")
    assert [(r.value, r.n) for r in A.top_values(t, F.col("v"), ["o"], 2).collect()] == [(None, 2), ("b", 2)]


def brute_identity(a, b):
    return sum(x == y for x, y in zip(a, b)) / max(len(a), len(b), 1)


def test_diversity_against_all_pairs(spark):
    r = random.Random(1)
    seqs = ["".join(r.choice("ACD") for _ in range(r.randint(0, 12))) for _ in range(40)] + ["ACD"] * 3 + ["", ""]
    df = spark.createDataFrame([(f"i{i:02d}", s, "x") for i, s in enumerate(seqs)], "k string, s string, m string")
    got = {r.id: r.diversity for r in P.diversity_by_index(df, "k", F.col("s")).collect()}
    for i, s in enumerate(seqs):
        o = [1 - brute_identity(s, t) for j, t in enumerate(seqs) if j != i]
        assert got[f"i{i:02d}"] == pytest.approx(sum(o) / len(o))
    got = {r.id: r.diversity for r in P.diversity_by_value(df, "k", F.col("s")).collect()}
    for i, s in enumerate(seqs):
        o = [1 - brute_identity(s, t) for t in seqs if t != s]
        assert got[f"i{i:02d}"] == pytest.approx(1.0 if not s else max(1e-6, sum(o) / len(o)))
    one = df.limit(1)
    assert P.diversity_by_index(one, "k", F.col("s")).first().diversity == 0.0
    assert P.diversity_by_value(one, "k", F.col("s")).first().diversity == 1.0
    assert P.diversity_by_index(df.limit(0), "k", F.col("s")).count() == 0


def test_diversity_of_long_sequences_in_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "TOGETHER", 3)
    r = random.Random(6)
    seqs = ["".join(r.choice("ACDé🙂") for _ in range(r.choice([1, 255, 256, 257, 700]))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(seqs)), "k int, s string")
    got = {x.id: x.diversity for x in P.diversity_by_index(df, "k", F.col("s")).collect()}
    for i, s in enumerate(seqs):
        o = [1 - brute_identity(s, t) for j, t in enumerate(seqs) if j != i]
        assert got[i] == pytest.approx(sum(o) / len(o))


def test_nearest_identity(spark):
    r = random.Random(2)
    mk = lambda n: [(f"q{i}", "".join(r.choice("ACDE") for _ in range(r.randint(1, 30)))) for i in range(n)]
    q, t = mk(25) + [("e", ""), ("n", None)], mk(60)
    qd, td = spark.createDataFrame(q, "id string, s string"), spark.createDataFrame(t + [("x", None)], "id string, s string")
    for block in (7, 512):
        got = {r.id: r.nearest for r in P.nearest_identity(qd, td, "id", "s", block).collect()}
        assert got == {i: pytest.approx(max(brute_identity(s, x) for _, x in t) if s else 0.0) for i, s in q}
    assert {r.nearest for r in P.nearest_identity(qd, td.limit(0), "id", "s").collect()} == {0.0}


def test_round_robin(spark):
    rows = spark.createDataFrame([(i,) for i in range(7)], "ord bigint")
    prompts = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos bigint, prompt string")
    assert {r.ord: r.prompt for r in P.round_robin(rows, "ord", prompts, "pos").collect()} == dict(enumerate("abcabca"))


def test_cache(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b"), (3, "c")], "ord int, k string")
    cache = spark.createDataFrame([("a", 1.0), ("z", 9.0)], "key string, score double")
    calls = []

    def score(m):
        calls.append(1)
        return m.withColumn("score", F.lit(5.0))

    out, fresh = O.cached_scores(df, "k", cache, "key", ["score"], score)
    assert [(r.ord, r.score, r.cache_hit) for r in out.orderBy("ord").collect()] == [(0, 1.0, True), (1, 5.0, False), (2, 5.0, False), (3, 5.0, False)]
    assert sorted(r.key for r in fresh.collect()) == ["b", "c"] and calls == [1]
    log = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 3.0), ("a", 2, 2.0), ("b", 1, 7.0)], "key string, created_at int, score double")
    assert {r.key: r.score for r in O.latest(log).collect()} == {"a": 3.0, "b": 7.0}
    assert O.config_hash({"b": 1, "a": 2}) == O.config_hash({"a": 2, "b": 1}) != O.config_hash({"a": 1, "b": 2})


def test_external_scorer_isolates_failures(spark):
    def model(texts):
        if any("!" in t for t in texts):
            raise ValueError("bad letter")
        return [{"score": float(len(t))} for t in texts if t != "skip"]

    df = spark.createDataFrame([("ab", 1), ("c!", 2), ("", 3), (None, 4)], "s string, n int").coalesce(1)
    got = {r.n: (r.score, r.error) for r in O.external_scores(df, "s", model, "score double").collect()}
    assert got[1] == (2.0, None) and got[2] == (None, "ValueError: bad letter") and got[3] == (0.0, None) and got[4] == (0.0, None)
    late = spark.createDataFrame([("skip", 1)], "s string, n int")
    assert O.external_scores(late, "s", model, "score double").first().error == "no result"


def test_command_scorer_matches_by_sequence(spark):
    code = "import sys,json\nrows=[json.loads(x) for x in sys.stdin]\nfor r in reversed(rows):\n    if r['sequence']: print(json.dumps({'sequence': r['sequence'], 'score': len(r['sequence'])}))"
    score = O.command_scorer(["python", "-c", code])
    assert score(["a", "", "bcd"]) == [{"sequence": "a", "score": 1}, {"error": "no result"}, {"sequence": "bcd", "score": 3}]


def test_scorer_registry(spark):
    assert spark.range(1).select(O.scorer("structure", "disabled")(F.lit("A")).alias("v")).first().v is None
    with pytest.raises(ValueError, match="unsupported"):
        O.scorer("structure", "real")


def test_compose_rewards(spark):
    mid = "struct<mean_plddt:double,ptm:double,mean_pae:double,valid:boolean,error:string>"
    lm = "struct<mean_logprob:double,perplexity:double,valid:boolean,error:string>"
    rows = [
        ("ACD", (70.0, 0.5, 15.0, True, None), (-2.75, 10.0, True, None)),
        ("ACDX", (70.0, 0.5, 15.0, True, None), (-2.75, 10.0, True, None)),
        ("ACD", (None, None, None, False, "fold failed"), (-2.75, 10.0, True, None)),
        ("ACD", (70.0, 0.5, 15.0, True, None), None),
    ]
    df = spark.createDataFrame(rows, f"s string, e {mid}, l {lm}")
    out = O.compose_rewards(df, F.col("s"), F.col("e"), F.col("l"), F.lit(1.0), 1, 10, {"hepn": 0.0, "length": 0.0}, invalid=-3.0).collect()
    assert out[0].r_prop == pytest.approx(0.5) and out[0].reward_for_rl == pytest.approx(0.0, abs=1e-9) and out[0].valid
    assert out[1].reward_for_rl == -3.0 and out[1].error == "non-canonical amino acid" and not out[1].valid
    assert out[2].reward_for_rl == -3.0 and out[2].error == "fold failed"
    assert out[3].r_prop == pytest.approx(0.5) and out[3].valid


def test_gate(spark):
    df = spark.createDataFrame([("A" * 300,), ("AX",), ("",)], "s string")
    out = [r.v for r in df.select(O.gated(F.col("s"), R.mock_likelihood_basic).alias("v")).collect()]
    assert out[0].valid and out[0].error is None and out[1].error == "non-canonical amino acid" and out[1].mean_logprob is None and out[2].error == "empty sequence"


def test_classifier_learns(spark):
    r = random.Random(4)
    rows = [([r.gauss(0, 1), r.gauss(0, 1)],) for _ in range(400)]
    df = spark.createDataFrame([(x[0], int(x[0][0] + 0.3 * x[0][1] > 0)) for x in rows], "f array<double>, y int")
    train, test = df.filter(F.xxhash64("f") % 2 == 0), df.filter(F.xxhash64("f") % 2 != 0)
    w, b = O.fit_logistic(train, "f", "y")
    hit = test.agg(F.avg(((O.linear_classifier(F.col("f"), w, b) > 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
    assert hit > 0.9


def test_policy(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0), (3, 2.0), (3, 2.0), (None, 4.0)], "g int, x double")
    z = sorted((r.g or 0, r.z) for r in L.z_scores(df, "g", "x").collect())
    assert z == [(0, 0.0), (1, -1.0), (1, 1.0), (2, 0.0), (3, 0.0), (3, 0.0)]
    a = sorted((r.g or 0, r.advantage) for r in L.advantages(df, "g", "x").collect())
    assert a == z
    assert L.resume_step(spark.createDataFrame([(3,), (7,)], "step int")) == 7 and L.resume_step(spark.createDataFrame([], "step int")) == 0
    s = spark.range(1).select(L.surrogate(F.lit(100.0), F.lit(0.0), F.lit(1.0)).alias("a"), L.surrogate(F.lit(0.0), F.lit(0.0), F.lit(2.0)).alias("b"), L.token_kl(F.lit(3.0), F.lit(1.0), F.lit(0)).alias("c")).first()
    assert (s.a, s.b, s.c) == (1.2, 2.0, 2.0)


# Nested records

TYPED = "row_id bigint, node_path string, cas array<struct<gene_name:string,ordinal:int,domains:array<struct<bit_score:double,motifs:array<struct<motif:string,pos:int>>>>>>, cas_genes array<struct<gene_name:string,ordinal:int,domains:array<struct<bit_score:double,motifs:array<struct<motif:string,pos:int>>>>>>"


def test_typed_nesting(spark):
    d = lambda *m: {"bit_score": 1.0, "motifs": list(m)}
    rows = [
        {"row_id": 1, "node_path": "x", "cas": [None, {"gene_name": "a", "ordinal": 9, "domains": [d({"motif": "m"}, None, {"pos": 1}), None, d()]}], "cas_genes": [{"gene_name": "no"}]},
        {"row_id": 2, "node_path": "x", "cas": [], "cas_genes": [{"gene_name": None, "domains": None}]},
        {"row_id": 3, "node_path": "x", "cas": None, "cas_genes": None},
        {"row_id": 2, "node_path": "x", "cas": [], "cas_genes": [{"gene_name": None, "domains": None}]},
    ]
    df = spark.createDataFrame(rows, TYPED)
    levels = [N.Level("gene", ("cas", "cas_genes"), ("gene_name", "ordinal")), N.Level("domain", ("domains",), ("bit_score",)), N.Level("motif", ("motifs",), ("motif", "pos"))]
    got = sorted(tuple(r) for r in N.node_paths(df, "row_id", levels).collect())
    assert got == [(1, "domain", "1.0"), (1, "domain", "1.2"), (1, "gene", "1"), (1, "motif", "1.0.0"), (1, "motif", "1.0.2"), (2, "gene", "0"), (2, "gene", "0")]
    t = N.flatten_levels(df, ["row_id"], levels)
    assert t["gene"].columns == ["row_id", "node_path", "parent_path", "ordinal", "gene_name", "gene_ordinal"]
    assert sorted((r.row_id, r.node_path, r.parent_path) for r in t["motif"].collect()) == [(1, "1.0.0", "1.0"), (1, "1.0.2", "1.0")]
    assert [r.gene_ordinal for r in t["gene"].filter("row_id = 1").collect()] == [9]
    assert N.node_paths(df.limit(0), "row_id", levels).count() == 0


def test_json_nesting(spark):
    texts = {
        1: '{"operons": {"n": 1}, "data": [{"id": "", "operon_id": "o", "cas": [{"domains": [{"motifs": [{"pos": "7"}, 3, null]}], "gene_name": "g"}]}, 5, null]}',
        2: '[{"cas": "", "cas_genes": [{}]}, {"cas": {}, "cas_genes": [{}]}, {"cas": 0, "cas_genes": [{}]}, {"cas": null}]',
        3: '{"cas": [{"domains": {"x": [1]}}, "text"]}',
        4: "{}", 5: "[1, 2]", 6: '{"a": 1} x', 7: '{"a": NaN}', 8: None, 9: "", 10: '"text"', 11: '{"a": [' , 12: "[" * 100_000,
    }
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "row_id bigint, payload string, node_path string")
    nodes = N.json_nodes(df, "row_id", "payload", NQ.RAW)
    got = sorted((r.row_id, r.node_level, r.node_path) for r in nodes.collect())
    assert got == sorted([
        (1, "operon", "0"), (1, "gene", "0.0"), (1, "domain", "0.0.0"), (1, "motif", "0.0.0.0"),
        (2, "operon", "0"), (2, "operon", "1"), (2, "operon", "2"), (2, "operon", "3"), (2, "gene", "0.0"), (2, "gene", "1.0"),
        (3, "operon", "0"), (3, "gene", "0.0"),
    ])
    m = N.json_level(nodes, NQ.MOTIF, NQ.RAW_TYPES).collect()
    assert [(r.row_id, r.parent_path, r.ordinal, r.motif, r.pos) for r in m] == [(1, "0.0.0", 0, None, 7)]
    t = N.json_triples(df.filter("row_id = 1"), "row_id", "payload", NQ.RAW).collect()
    assert {(r.node_path, r.field_path, r.value) for r in t} == {("0", "id", ""), ("0", "operon_id", "o"), ("0.0", "gene_name", "g"), ("0.0.0.0", "pos", "7")}
    assert N.json_nodes(df.limit(0), "row_id", "payload", NQ.RAW).count() == 0


def test_p2_found_uses_the_operator_of_the_tables(spark, data, monkeypatch):
    from helixframe.operators import nested as N
    from helixframe.plans import nested as P

    used, old = [], N.flatten_levels
    monkeypatch.setattr(N, "flatten_levels", lambda *a: used.append([x.name for x in a[2]]) or old(*a))
    typed = P.p2_found(spark, data).filter("tbl = 'crispr_cas_atlas'")
    assert used == [["gene", "domain", "motif"]]
    for level, table in (("gene", P.p2_genes), ("domain", P.p2_domains), ("motif", P.p2_motifs)):
        places = table(spark, data).filter("tbl = 'crispr_cas_atlas'").select("row_id", "node_path")
        mine = typed.filter(f"node_level = '{level}'").select("row_id", "node_path")
        assert mine.count() and mine.exceptAll(places).isEmpty() and places.exceptAll(mine).isEmpty()


def test_stream_parser_against_the_library():
    import random

    r = random.Random(4)
    texts = ["", " ", "1", "-0.5e+3", "01", "nul", "true", '"a\\u00e9\\n"', '"a', '"\n"', "[]", "{}", "[1,]", '{"a":1,}', '{"a" 1}', "[1 2]", "1 2", "[[]", "]", '{"a":{"b":[1,{"c":null}]}} ', "NaN", "[\x0b1]", '{1:2}', '{"a":1,"a":[2]}']

    def value(d):
        k = r.randrange(7 if d else 4)
        if k < 4:
            return r.choice([1, -2.5, "x \u20ac \"q\"", True, None, ""])
        return [value(d - 1) for _ in range(r.randrange(4))] if k < 6 else {r.choice("abcde"): value(d - 1) for _ in range(r.randrange(4))}

    for _ in range(300):
        t = json.dumps(value(5), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))
        texts += [t, t[: r.randrange(len(t) + 1)], t.replace(",", "", 1), t + r.choice([" ", "x", "]"])]

    def plain(v, t):
        if not isinstance(v, N.Node):
            return v[0] if isinstance(v, tuple) else json.loads(v)
        assert json.loads(t[v.start : v.end]) is not None
        return [plain(x, t) for x in v.values] if v.keys is None else {k: plain(v.values[i], t) for k, i in v.keys.items()}

    def no_constant(_):
        raise ValueError

    for t in texts:
        try:
            want = (True, json.loads(t, parse_constant=no_constant))
        except ValueError:
            want = (False, None)
        ok, v = N.parse(t)
        assert (ok, plain(v, t) if ok else None) == want, t


def test_deep_payloads_and_undeclared_arrays(spark):
    deep = '[{"operon_id": "a", "deep": ' + "[" * 20_000 + "]" * 20_000 + ', "cas": [{"gene_name": "g", "notes": [{"by": "x"}, 3, {"by": "y"}]}]}]'
    df = spark.createDataFrame([(1, deep), (2, "{"), (3, None), (4, '{"operon_id": "b"} {}')], "row_id bigint, payload string")
    nodes = N.json_nodes(df, "row_id", "payload", NQ.RAW)
    assert {(r.node_level, r.node_path) for r in nodes.collect()} == {("operon", "0"), ("gene", "0.0")}
    every = {(r.node_level, r.node_path): r.fields for r in N.json_nodes(df, "row_id", "payload", NQ.RAW, undeclared=True).collect()}
    assert every[("[].cas[].notes[]", "0.0.2")] == {"by": "y"} and len(every) == 4
    gene = N.json_level(nodes, NQ.GENE, rest="other").first()
    assert gene.gene_name == "g" and gene.other == {}
    assert N.json_level(nodes, NQ.OPERON, rest="other").first().other["deep"].startswith("[[[")
    assert {(r.row_id, r.reason) for r in N.rejects(df, "row_id", "payload").collect()} == {(2, "not one complete JSON text"), (3, "null"), (4, "not one complete JSON text")}
