"""Golden values of the expressions."""

import math

import pytest
from pyspark.sql import functions as F

from helixframe.functions import rewards as R
from helixframe.functions import sequence as S
from helixframe.functions import tokens as T


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def many(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [r.v for r in df.select("i", f(F.col("s")).alias("v")).orderBy("i").collect()]


def test_clean_and_hash(spark):
    assert many(spark, ["acdxBZ*-", None, "", "straße"], S.clean) == ["ACD", "", "", "STRASSE"]
    assert many(spark, ["ac x\n"], S.clean_with_x) == ["ACX"]
    assert many(spark, ["ACDEFGHIK"], S.content_hash) == ["c729ebc224388368ab8c8df88487ef137ad8bd5097651cf67c37bda5622c9f9a"]
    assert many(spark, ["AC D", "ACX", "a\tc"], S.changed_by_cleaning) == [False, True, False]


def test_motifs(spark):
    texts = ["RAAAAH", "RAAAAHRCCCCH", "RAAAAHACDRCCCCH", "ACDEFG", "", "RRAAAAHH", "RAAAAHAAAAH"]
    assert many(spark, texts, S.motif_count) == [1, 2, 2, 0, 0, 1, 1]
    assert many(spark, texts, S.motif_positions) == [[0], [0, 6], [0, 9], [], [], [1], [0]]
    assert many(spark, ["RAAAAHACDRCCCCH", "RAAAAHACD", "ACDEFG"], lambda c: S.motif_score(S.motif_count(c))) == [1.0, 0.5, 0.0]
    assert [one(spark, S.motif_position_score(F.lit(n))) for n in (0, 1, 2, 3)] == [-1.0, -0.5, 1.0, -1.0]


def test_positions_agree_with_a_scan(spark):
    import random
    import re

    r = random.Random(1)
    texts = ["".join(r.choice("RHAC") for _ in range(r.randint(0, 80))) for _ in range(200)]
    want = [[m.start() for m in re.finditer("R[A-Z]{4}H", t)] for t in texts]
    assert many(spark, texts, S.motif_positions) == want


def test_complexity(spark):
    assert many(spark, ["A" * 900, "AABBB", "", "ABC"], S.max_run) == [900, 3, 0, 1]
    assert many(spark, ["AAAB", "", "AB"], S.max_fraction) == [0.75, 0.0, 0.5]


def test_hard_filter(spark):
    core = ("ACDEFGHIKLMNPQRSTVWY" * 50)[:888]
    good = core[:300] + "RAAAAH" + core[300:600] + "RCCCCH" + core[600:]
    rows = many(spark, [good, good.lower(), "ACDX", "A" * 900, None, "A C"], S.hard_filter)
    assert rows[0].passed and rows[1].passed and len(rows[0].motif_positions) == 2 and 300 in rows[0].motif_positions
    assert rows[2].reasons == ["invalid_alphabet:X", "length_out_of_range:4 not in [800,1400]", "hepn_count:0", "low_complexity:max_aa_fraction>0.2"]
    assert rows[3].low_complexity.is_low_complexity and rows[3].low_complexity.max_run == 900
    assert rows[4].reasons[0] == "empty_sequence"
    assert rows[5].reasons[:2] == ["contains_whitespace", "invalid_alphabet: "]
    off = many(spark, ["ACDX"], lambda c: S.hard_filter(c, alphabet=False, two_motifs=False, low_complexity=False))
    assert off[0].reasons == ["length_out_of_range:4 not in [800,1400]"]


def test_problems(spark):
    assert many(spark, ["", "ACDX", "ACD", "acd", None], lambda c: S.first_problem(c, 1, 10)) == ["empty sequence", "non-canonical amino acid", None, None, "empty sequence"]
    assert many(spark, ["ACDX"], lambda c: S.all_problems(c, 5, 20)) == ["non-canonical amino acid; length 4 outside [5, 20]"]


def test_predicates(spark):
    assert many(spark, ["Cas13a", "CAS13", "xc2c2", None], S.has_keyword) == [True, False, True, False]
    assert many(spark, ["CAS9", "casX", None], lambda c: S.has_keyword_any_case("cas9", c)) == [True, False, False]
    assert many(spark, ["\tvi-a", "VII", "V-K", None], S.starts_with_type) == [True, True, False, False]
    assert many(spark, ["", "x", None], lambda c: S.first_filled(c, F.lit("y"))) == ["y", "x", "y"]
    assert many(spark, ["1.5", "VI:2", "x"], lambda c: S.first_number(c, F.regexp_extract(c, r"[0-9.]+$", 0))) == [1.5, 2.0, None]


def test_validity_and_features(spark):
    assert many(spark, ["A" * 100, "A" * 200, "A" * 1500, "A" * 3000, "A" * 2250, "AX", ""], S.validity_score) == [0.5, 1.0, 1.0, 0.0, 0.5, 0.0, 0.0]
    x = many(spark, ["RAAAAHRCCCCH"], S.features)[0]
    assert len(x) == 24 and x[:2] == [12.0, 2.0] and x[2] == pytest.approx(4 / 12) and x[-1] == 4.0
    a = [r.v for r in spark.createDataFrame([("ABC", "ABD"), ("", "A"), ("AB", "ABCD")], "a string, b string").select(S.positional_identity(S.letters(F.col("a")), S.letters(F.col("b"))).alias("v")).collect()]
    assert a == [pytest.approx(2 / 3), 0.0, 0.5]


def test_text_helpers(spark):
    assert one(spark, S.wrap(F.lit("A" * 200), 80)) == "A" * 80 + "\n" + "A" * 80 + "\n" + "A" * 40
    assert one(spark, S.wrap(F.lit("A" * 80), 80)) == "A" * 80
    assert one(spark, S.joined(F.lit("a"), F.lit(None).cast("string"), F.lit(""), F.lit("b"))) == "a; b"
    assert one(spark, S.joined(F.lit(""), F.lit(None).cast("string"))) is None
    assert [one(spark, S.stop_reason(F.lit(e), F.lit(n), 10)) for e, n in ((True, 1), (False, 10), (False, 3))] == ["eos", "max_new_tokens", "other"]


def test_ramps(spark):
    d = F.lit
    assert [one(spark, R.ramp_up(d(float(x)), 0, 10, 0.01)) for x in (-10, 20, 5)] == [0.01, 1.0, 0.5]
    assert [one(spark, R.ramp_down(d(float(x)), 0, 10, 0.01)) for x in (20, -1, 5)] == [0.01, 1.0, 0.5]
    assert [one(spark, R.centered_length(d(n), 900, 100, 0.01)) for n in (900, 950, 1200)] == [1.0, 0.5, 0.01]
    null = d(None).cast("double")
    assert one(spark, R.ramp_up(null, 0, 1)) == 1e-6 and one(spark, R.ramp_down(null, 0, 1)) == 1e-6 and one(spark, R.ramp_up(d(0.5), 1, 1)) == 1e-6
    assert [one(spark, R.centered_length(d(n), 9, 0)) for n in (9, 8)] == [1.0, 1e-6]
    assert [one(spark, R.length_score(d(n), 9, 0)) for n in (9, 8)] == [1.0, 0.0]


def test_z_values(spark):
    d = F.lit
    assert one(spark, R.z_value(d(2.0), 1, 0.5, None)) == 2.0
    assert one(spark, R.z_value(d(10.0), 0, 1)) == 3.0
    assert one(spark, R.z_value(d(None).cast("double"), 0, 1)) == 0.0 and one(spark, R.z_value(d(2.0), 0, 0)) == 0.0
    z, missing = R.structure_z(d(80.0), d(None).cast("double"), d(None).cast("double"))
    assert one(spark, z) == 1.0 and one(spark, missing) is False
    z, missing = R.structure_z(*[d(None).cast("double")] * 3)
    assert one(spark, z) == 0.0 and one(spark, missing) is True


def test_rewards(spark):
    half = {k: F.lit(0.5) for k in ("lm", "plddt", "ptm")}
    assert one(spark, R.geometric_mean(half, {"lm": 1, "plddt": 1, "ptm": 1})) == pytest.approx(0.5, abs=1e-9)
    assert one(spark, R.geometric_mean(half, {"lm": 0, "nothing": 1})) == 1.0
    with pytest.raises(ValueError, match="unknown weights"):
        R.checked_weights({"w_struct": 1.0})
    assert R.from_old_weights({"w_pg3": 2.0, "w_struct": 3.0})["lm"] == 2.0
    assert one(spark, R.weighted_sum(F.lit(False), {"structure": F.lit(None).cast("double")}, F.lit(0.0))) == -10.0
    assert one(spark, R.weighted_sum(F.lit(True), {"structure": F.lit(400.0)}, F.lit(0.25))) == 5.0
    assert one(spark, R.perplexity(F.lit(20.0))) == math.inf and one(spark, R.perplexity(F.lit(1.0))) == pytest.approx(math.e)
    assert one(spark, R.steps(F.lit(5144), 2, 1, 8, 1)) == 1286 and one(spark, R.steps(F.lit(11000), 2, 1, 8, 1)) == 2750


def test_tokens(spark):
    assert many(spark, ["AYX", ""], T.encode) == [[3, 22, 2, 1], [1]]
    assert many(spark, ["AYX", "", "acd"], lambda c: T.decode(T.encode(c))) == ["AY", "", ""]
    e = many(spark, ["ACDEF", "AC", ""], lambda c: T.example(c, 4))
    assert [(x.input_ids, x.truncated, x.raw_tokenized_length, x.has_eos) for x in e] == [([3, 4, 5, 1], True, 6, True), ([3, 4, 1], False, 3, True), ([1], False, 1, True)]
    df = spark.createDataFrame([(1, "AC"), (1, "ACDE"), (2, "")], "b int, s string").withColumn("ids", T.encode(F.col("s")))
    rows = df.select("b", "s", *[c.alias(n) for c, n in zip(T.padded(F.col("ids"), F.col("b")), ("ids", "mask", "labels"))]).orderBy("b", "s").collect()
    assert [len(r.ids) for r in rows] == [5, 5, 1] and rows[0].mask == [1, 1, 1, 0, 0] and rows[0].labels[-2:] == [-100, -100]
    assert one(spark, T.masked_count(F.array(F.lit(False)))) == 1
    assert one(spark, T.masked_sum(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(True), F.lit(False)))) == 1.0
