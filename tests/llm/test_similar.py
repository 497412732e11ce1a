import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions.sequence import clean
from helixframe.llm import similar


def shingles(x):
    return {x[i : i + 5] for i in range(len(x) - 4)}


def family(seed, bases, copies, edits):
    r = random.Random(seed)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    rows = []
    for f in range(bases):
        base = [r.choice(letters) for _ in range(r.randint(60, 400))]
        for c in range(copies):
            x = list(base)
            for _ in range(r.randint(0, edits)):
                p = r.randrange(len(x))
                kind = r.random()
                if kind < 0.4:
                    x[p] = r.choice(letters)
                elif kind < 0.7:
                    del x[p]
                else:
                    x.insert(p, r.choice(letters))
            if r.random() < 0.2:
                m = r.randrange(len(x))
                x = x[m:] + x[:m]
            rows.append((f"{f:03d}-{c:03d}", "".join(x)))
    return rows


def near(a, b):
    u, v = shingles(a), shingles(b)
    return len(u & v) / max(1, len(u | v))


def test_near_duplicates_against_all_pairs(spark):
    rows = family(1, 25, 8, 9)
    got = {tuple(r) for r in similar.near_duplicates(spark.createDataFrame(rows, "id string, s string"), "id", clean("s")).collect()}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and near(x, y) >= 0.7}
    clear = {(a, b) for a, b in want if near(dict(rows)[a], dict(rows)[b]) >= 0.72}
    assert got <= want and clear <= got and len(clear) > 100


def test_heavy_lists_keep_every_link(spark):
    # one conserved third in 300 records: its subsets' lists are heavy, few of the records are similar
    r = random.Random(2)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    text = lambda k: "".join(r.choice(letters) for _ in range(k))
    domain = text(80)
    rows = [(f"h{i:03d}", domain + text(160)) for i in range(300)]
    rows += [(f"k{i:03d}", rows[i][1][:-4]) for i in range(40)]
    got = {tuple(x) for x in similar.near_duplicates(spark.createDataFrame(rows, "id string, s string"), "id", F.col("s"), levels=((3, 24), (6, 20), (12, 300))).collect()}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and near(x, y) >= 0.7}
    assert got == want and len(want) == 40


def test_heavy_blocks_across_splits(spark):
    r = random.Random(9)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    text = lambda k: "".join(r.choice(letters) for _ in range(k))
    domain = text(80)
    tr = [(f"t{i:03d}", domain + text(160)) for i in range(240)]
    ev = [(f"e{i:03d}", domain + text(160)) for i in range(60)] + [(f"f{i:03d}", tr[i][1][:-20]) for i in range(40)]
    mk = lambda x: spark.createDataFrame(x, "id string, s string")
    want = {(a, b) for a, x in ev for b, y in tr if near(x, y) >= 0.6}
    assert len(want) == 40
    for levels in (similar.LEVELS_62, ((3, 40), (6, 10), (9, 500)), ((3, 40), (6, 10), (9, 2))):
        got = {tuple(x) for x in similar.cross_split(mk(ev), mk(tr), "id", F.col("s"), levels=levels).collect()}
        assert got <= want and (got == want or levels[2][1] == 2)


def test_copies_nulls_and_classes(spark, monkeypatch):
    t = family(3, 1, 1, 0)[0][1]
    rows = [("a", t, 1), ("b", t.lower() + "*", 2), ("b", t.lower() + "*", 3), ("c", None, 4), ("d", "", 5), (None, t, 6), ("e", "---", 7), ("f", t[:-2], 8), ("g", "ACD", 9), ("h", "ACD", 10)]
    df = spark.createDataFrame(rows, "id string, s string, band int")
    pairs = {tuple(x) for x in similar.near_duplicates(df, "id", clean("s")).collect()}
    assert pairs == {("a", "b"), ("a", "f"), ("b", "f"), ("g", "h")}
    cls = {r.id: (r.class_id, r.n_copies, r.n_links) for r in similar.similarity_classes(df, "id", clean("s")).collect()}
    assert cls == {"a": ("a", 2, 1), "b": ("a", 2, 1), "f": ("f", 1, 1), "c": ("c", 1, 0), "d": ("d", 1, 0), "e": ("e", 1, 0), "g": ("g", 2, 0), "h": ("g", 2, 0)}
    monkeypatch.setattr(similar, "ALL_PAIRS", 1)
    pairs = {tuple(x) for x in similar.near_duplicates(df, "id", clean("s")).collect()}
    assert {("a", "b"), ("a", "f"), ("g", "h")} <= pairs <= {("a", "b"), ("a", "f"), ("b", "f"), ("g", "h")}


def test_empty(spark):
    df = spark.createDataFrame([], "id string, s string")
    assert similar.near_duplicates(df, "id", F.col("s")).count() == 0
    assert similar.similarity_classes(df, "id", F.col("s")).count() == 0
    assert similar.cross_split(df, df, "id", F.col("s")).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_cross_split_against_all_pairs(spark, seed):
    rows = family(seed, 30, 6, 14)
    ev, tr = [r for i, r in enumerate(rows) if i % 6 == 0], [("t" + a, x) for i, (a, x) in enumerate(rows) if i % 6]
    ev += [("x1", "ACD"), ("x2", None), ("x3", ""), ("x4", tr[0][1])]
    tr += [("ty1", "ACD"), ("ty2", None), ("ty3", "CD"), ("ty4", tr[0][1])]
    mk = lambda x: spark.createDataFrame(x, "id string, s string")
    got = {tuple(r) for r in similar.cross_split(mk(ev), mk(tr), "id", F.col("s")).collect()}
    pairs = {(a, b): near(x, y) for a, x in ev if x for b, y in tr if y}
    want = {p for p, v in pairs.items() if v >= 0.6} | {("x1", "ty1")}
    clear = {p for p, v in pairs.items() if v >= 0.62}
    assert got <= want and clear <= got and ("x1", "ty1") in got and ("x4", "ty4") in got


def test_small_sets_are_exact(spark):
    r = random.Random(11)
    rows = []
    for f in range(120):
        base = [r.choice("ACDE") for _ in range(r.randint(5, 40))]
        for c in range(4):
            x = list(base)
            for _ in range(r.randint(0, 2)):
                x[r.randrange(len(x))] = r.choice("ACDE")
            rows.append((f"{f:03d}-{c}", "".join(x) + r.choice(["", "A"])))
    # with no subsets for large sets to speak of, all pairs come from the enumeration
    got = {tuple(x) for x in similar.near_duplicates(spark.createDataFrame(rows, "id string, s string"), "id", F.col("s"), levels=((3, 400), (6, 2))).collect()}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and near(x, y) >= 0.7}
    assert got == want and len(want) > 100
    base = similar.classes(spark.createDataFrame(rows, "id string, s string"), "id", F.col("s"))
    assert similar.boundary(base, 0.7, 5, 400) >= 40
    assert 1 <= similar.boundary(base, 0.7, 5, 24) <= 40
    assert similar.boundary(base.limit(0), 0.7, 5, 24) >= 1


def test_long_lists_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 7)
    left = [(b, c) for b, n in ((1, 40), (2, 5), (3, 1), (4, 8)) for c in range(n)]
    df = spark.createDataFrame(left, "band long, c long")
    got = [tuple(sorted((r.a.c, r.b.c))) + (0,) for r in similar.paired(df).filter("a.c < 1000").collect()]
    want = {(x, y, 0) for b, n in ((1, 40), (2, 5), (4, 8)) for x in range(n) for y in range(x + 1, n)}
    assert set(got) == want
    right = [(b, c) for b, n in ((1, 30), (2, 3), (5, 9)) for c in range(100, 100 + n)]
    got = [(r.a.c, r.b.c) for r in similar.paired(df, spark.createDataFrame(right, "band long, c long")).collect()]
    want = [(x, y) for x in range(40) for y in range(100, 130)] + [(x, y) for x in range(5) for y in range(100, 103)]
    assert sorted(got) == sorted(want)


def test_a_family_gives_all_its_links(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 20)
    base = family(12, 1, 1, 0)[0][1] * 2
    rows = [(f"{i:04d}", base[:i] + "ACDEFGHIKLMNPQRSTVWY"[i % 20] + base[i + 1 :]) for i in range(120)]
    got = {tuple(x) for x in similar.near_duplicates(spark.createDataFrame(rows, "id string, s string"), "id", F.col("s")).collect()}
    assert got == {(a, b) for a, x in rows for b, y in rows if a < b and near(x, y) >= 0.7}


def test_one_id_in_two_evaluation_splits(spark):
    a, b = family(13, 2, 1, 0)
    ev = spark.createDataFrame([("e", a[1], "valid"), ("e", b[1], "test"), ("e", a[1][:-3], None), (None, a[1], "valid")], "id string, s string, part string")
    tr = spark.createDataFrame([("t", a[1])], "id string, s string")
    got = {tuple(x) for x in similar.cross_split(ev, tr, "id", F.col("s"), split=F.col("part")).collect()}
    assert got == {("valid", "e", "t"), (None, "e", "t")}
