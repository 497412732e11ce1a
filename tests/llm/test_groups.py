import random

import pytest
from pyspark.sql import functions as F

from helixframe.llm import groups


def union(rows):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for i, *keys in rows:
        find(("r", i))
        for n, k in enumerate(keys):
            if k:
                a, b = find(("r", i)), find((f"k{n}", k))
                up[max(a, b)] = min(a, b)
    out = {}
    for i, *_ in rows:
        out.setdefault(find(("r", i)), set()).add(i)
    return [g for g in out.values()]


def test_random_graphs(spark):
    r = random.Random(1)
    for n, ka, kb in ((60, 40, 40), (200, 30, 400), (120, 119, 119)):
        rows = [(f"i{r.randrange(n):04d}", f"a{r.randrange(ka)}9" if r.random() < 0.7 else None, f"b{r.randrange(kb)}" if r.random() < 0.6 else None) for _ in range(n)]
        df = spark.createDataFrame(rows, "id string, a string, b string")
        got = {tuple(x) for x in groups.related_groups(df, "id", [groups.key("a"), groups.key("b")]).collect()}
        assert got == {(i, min(g)) for g in union(rows) if len(g) > 1 for i in g}


def test_long_chain(spark):
    rows = [(f"{i:04d}", f"k{i // 2}", f"m{(i + 1) // 2}") for i in range(300)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "id string, a string, b string")
    got = groups.related_groups(df, "id", [groups.key("a"), groups.key("b")]).collect()
    assert len(got) == 300 and {r.group_id for r in got} == {"0000"}


def test_keys(spark):
    rows = [("1", " OPN1 ", "H"), ("2", "opn1\t", ""), ("3", "NA", "h"), ("4", "n/a", None), ("5", "unassigned", "  "), ("6", None, "x "), ("7", " Opn1", "x"), (None, "OPN1", "H")]
    df = spark.createDataFrame(rows, "id string, operon_id string, sha256 string")
    keys = [groups.key("operon_id", named="[0-9]"), groups.key("sha256", trim=False)]
    assert {tuple(r) for r in groups.related_groups(df, "id", keys).collect()} == {("1", "1"), ("2", "1"), ("3", "1"), ("7", "1")}
    assert groups.related_groups(df.limit(0), "id", keys).count() == 0


def test_split_is_grouped_and_balanced(spark):
    r = random.Random(3)
    rows = [(f"{i:05d}", f"g{r.randrange(900)}" if r.random() < 0.5 else ("big" if r.random() < 0.1 else None), r.choice(["A", "A", "A", "B", "C", None])) for i in range(3000)]
    rows += rows[:100]
    df = spark.createDataFrame(rows, "id string, k string, l string")
    want = {"train": 0.9, "valid": 0.05, "test": 0.05}
    out = groups.grouped_split(df, "id", [groups.key("k")], F.col("l"), want, large=0.005).collect()
    assert len(out) == 3000
    assert all(len({x.split for x in out if x.group_id == g}) == 1 for g in {x.group_id for x in out})
    for lab in ("A", "B", "C", "(null)"):
        mine = [x for x in out if x.label == lab]
        for s, f in want.items():
            assert abs(sum(x.split == s for x in mine) / len(mine) - f) < 0.03
    for s, f in want.items():
        assert abs(sum(x.split == s for x in out) / 3000 - f) < 0.01
    again = groups.grouped_split(df, "id", [groups.key("k")], F.col("l"), want, large=0.005).collect()
    assert {tuple(x) for x in out} == {tuple(x) for x in again}


def test_split_edges(spark):
    df = spark.createDataFrame([], "id string, k string, l string")
    assert groups.grouped_split(df, "id", [groups.key("k")], F.col("l"), {"train": 0.9, "test": 0.1}).count() == 0
    with pytest.raises(ValueError):
        groups.grouped_split(df, "id", [groups.key("k")], F.col("l"), {"train": 0.9, "test": 0.2})
    one = spark.createDataFrame([("a", "x", None), ("b", "x", "L"), (None, "x", "L")], "id string, k string, l string")
    out = groups.grouped_split(one, "id", [groups.key("k")], F.col("l"), {"train": 0.9, "test": 0.1}).collect()
    assert [(x.id, x.split) for x in sorted(out)] == [("a", "train"), ("b", "train")]


def test_rare_labels_and_whole_vectors(spark, monkeypatch):
    r = random.Random(5)
    # 150 labels, each in 40 records of groups of their own: every one of them is balanced
    rows = [(f"{n:03d}-{i:02d}", f"k{n}-{i}", f"label{n}") for n in range(150) for i in range(40)]
    rows += [(f"m{i}", f"big{i % 4}", r.choice(["x", "y"])) for i in range(400)] + [("m0", "big0", "z"), ("m0", "big0", "w")]
    df = spark.createDataFrame(rows, "id string, k string, l string")
    out = groups.grouped_split(df, "id", [groups.key("k")], F.col("l"), {"train": 0.5, "test": 0.5}, large=0.01).collect()
    assert len(out) == 6400 and all(len({x.split for x in out if x.group_id == g}) == 1 for g in {x.group_id for x in out})
    for n in range(150):
        assert sum(x.label == f"label{n}" and x.split == "test" for x in out) == 20
    assert {x.label for x in out if x.id == "m0"} == {min({b[2] for b in rows if b[0] == "m0"})}
    monkeypatch.setattr(groups, "VECTORS", 3)
    with pytest.raises(ValueError):
        groups.grouped_split(df, "id", [groups.key("k")], F.col("l"), {"train": 0.5, "test": 0.5}, large=0.01)


def test_the_rarest_label_is_placed_first():
    vectors = {"a": {"x": 50, "rare": 1}, "b": {"x": 60}, "c": {"x": 40, "rare": 1}, "d": {"x": 50}}
    placed = groups._place(vectors, {"x": 200, "rare": 2}, {"train": 0.5, "test": 0.5})
    assert placed["a"] != placed["c"] and placed["b"] != placed["d"]
