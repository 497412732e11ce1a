import random
import re

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import kernels as K
from helixframe.llm import spans
from helixframe.llm.spans import _anchor_rows, shared_spans


def brute(rows, n):
    own, shared = {}, set()
    for i, t in rows:
        if i is None or t is None:
            continue
        for p in range(len(t) - n + 1):
            w = t[p : p + n]
            if own.setdefault(w, i) != i:
                shared.add(w)
    out = set()
    for i, t in rows:
        if i is None or t is None:
            continue
        cover = bytearray(b"0" * len(t))
        for p in range(len(t) - n + 1):
            if t[p : p + n] in shared:
                cover[p : p + n] = b"1" * n
        out |= {(i, m.start(), m.end() - m.start()) for m in re.finditer(b"1+", bytes(cover))}
    return out


def run(spark, rows, n, extra=""):
    df = spark.createDataFrame(rows, f"id string, text string{extra}")
    return {tuple(r) for r in shared_spans(df, min_len=n).collect()}


def corpus(seed, alphabet, count):
    r = random.Random(seed)
    text = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    pool = [text(r.randint(30, 160)) for _ in range(12)]
    rows = []
    for i in range(count):
        parts = [text(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(pool)
            a = r.randint(0, len(p) - 1)
            parts += [p[a : r.randint(a, len(p))], text(r.randint(0, 30))]
        rows.append((f"r{i}", "".join(parts)))
    return rows


def letters(seed, alphabet, count):
    r = random.Random(seed)
    return "".join(r.choice(alphabet) for _ in range(count))


def test_random_corpora(spark):
    for seed, alphabet in ((1, "ACDEFGHIKLMNPQRSTVWY"), (2, "AB"), (3, "aé🙂ß")):
        rows = corpus(seed, alphabet, 60)
        assert run(spark, rows, 50) == brute(rows, 50)
        assert run(spark, rows, 9) == brute(rows, 9)


def test_hot_passage_copies_and_runs(spark):
    hot = letters(5, "ACDEFGHIKL", 90)
    rows = [(f"c{i}", hot) for i in range(40)] + [(f"e{i}", hot[: i + 20] + "X" + hot[i + 20 :]) for i in range(30)]
    rows += [("g1", "G" * 200), ("g2", "MG" + "G" * 80 + "A"), ("g3", "G" * 49)]
    assert run(spark, rows, 50) == brute(rows, 50)


def test_nulls_empties_repeats_and_ties(spark):
    t = letters(6, "ACDEFG", 120)
    rows = [("a", t), ("a", t), ("b", None), ("c", ""), (None, t), ("d", t[:49]), ("e", "q" * 10 + t[20:70])]
    assert run(spark, rows, 50) == {("a", 20, 50), ("e", 10, 50)}
    assert run(spark, [("a", t), ("a", t)], 50) == set()  # one record delivered twice shares nothing
    assert run(spark, [], 50) == set()


def test_clashing_columns_and_long_texts(spark):
    t = letters(7, "ACDEFG", 200_000)
    df = spark.createDataFrame([("a", t, 1, "x"), ("b", "zz" + t[1000:199_000], 2, "y")], "id string, text string, h int, places string")
    assert {tuple(r) for r in shared_spans(df).collect()} == {("a", 1000, 198_000), ("b", 2, 198_000)}


def test_pieces_of_long_texts():
    r = random.Random(11)
    texts = ["".join(r.choice("ACDE") for _ in range(n)) for n in (0, 5, 99, 100, 101, 1000)]
    whole = _anchor_rows(30, 8, 10**9)
    cut = _anchor_rows(30, 8, 100)
    rows = lambda f: {tuple(x) for b in f(iter([pd.DataFrame({"rec": range(6), "text": texts})])) for x in b.itertuples(index=False)}
    assert rows(whole) == rows(cut)
    assert sum(hi - lo for lo, hi in K.chunks(texts, 100)) == 6 and list(K.chunks([], 5)) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abc", max_size=30), max_size=6), st.integers(1, 9))
def test_kernels(texts, k):
    codes, off = K.concat(texts)
    whole = "".join(texts)
    h = K.rolling(codes, k)
    assert len(h) == max(0, len(whole) - k + 1)
    by = {}
    for i, x in enumerate(h):
        assert by.setdefault(whole[i : i + k], x) == x
    assert len(set(by.values())) == len(by)
    ok = K.inside(off, k)
    edges = set(off.tolist())
    for i in range(len(h)):
        assert ok[i] == (not any(i < e < i + k for e in edges))
    v = np.array([ord(c) for c in whole], dtype=np.uint64)
    assert K.sliding(v, k, np.minimum).tolist() == [min(v[i : i + k]) for i in range(max(0, len(v) - k + 1))]


def test_every_window_has_an_anchor():
    r = random.Random(8)
    texts = ["".join(r.choice("ACDE") for _ in range(r.randint(0, 200))) for _ in range(20)]
    codes, off = K.concat(texts)
    at, _ = K.anchors(codes, off, 30, 8)
    at = set(at.tolist())
    for a, b in zip(off[:-1], off[1:]):
        for s in range(a, b - 30 + 1):
            assert any(p in at for p in range(s, s + 23))


def test_hot_anchors_alike(spark, monkeypatch):
    hot = letters(15, "ACDEFGHIKL", 60)
    rows = [(f"p{i}", letters(100 + i, "ACDEFGHIKL", 40 + i % 7) + hot + letters(300 + i, "ACDEFGHIKL", 50)) for i in range(80)] + corpus(16, "ACDEFGHIKL", 40)
    rows += [("q0", hot[5:] + letters(17, "ACDEFG", 30)), ("x", None), ("y", hot[:49])]
    want = brute(rows, 50)
    for most in (spans.HOT, 30, 0):  # no anchor, some, all
        monkeypatch.setattr(spans, "HOT", most)
        assert run(spark, rows, 50) == want
