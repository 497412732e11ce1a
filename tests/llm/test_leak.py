import random

from helixframe.llm import leak


def brute(docs, items, n):
    w = {i: leak.words(t) for i, t in items if t}
    grams = {}
    for i, x in w.items():
        for k in range(len(x) - n + 1):
            grams.setdefault(tuple(x[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        x = leak.words(t or "")
        for k in range(len(x) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(x[k : k + n]), ())}
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["Alpha", "beta", "Γάμμα", "délta", "e5", "zêta", "ÎŞİ", "ß", "straße", "9"]) + str(r.randrange(30))
    items = [(i, " ".join(word() for _ in range(r.randint(3, 40)))) for i in range(30)]
    items.append((99, items[0][1]))
    docs = []
    for d in range(120):
        x = [word() for _ in range(r.randint(0, 40))]
        if r.random() < 0.6:
            t = r.choice(items)[1].split()
            a = r.randrange(len(t))
            x += t[a : a + r.randint(8, 20)]
        x += [word() for _ in range(r.randint(0, 10))]
        docs.append((d, "".join(w + r.choice([" ", ", ", "\n", "_", " — "]) for w in x).upper() if r.random() < 0.3 else " ".join(x)))
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' as item_id")
    return d, spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'y' as doc_id")


def test_against_brute_force_on_both_paths(spark, monkeypatch):
    docs, items = corpus(1)
    docs += [(500, None), (501, ""), (None, items[0][1]), (502, items[0][1]), (502, items[0][1])]
    items += [(100, None), (101, ""), (102, "too short"), (None, docs[0][1])]
    d, i = frames(spark, docs, items)
    want = {(a, b) for a, b in brute(docs, items, 12) if a is not None and b is not None}
    assert len(want) > 20
    for limit in (leak.ITEM_CHARS, 0):
        monkeypatch.setattr(leak, "ITEM_CHARS", limit)
        rows = leak.leaked_items(d, i).collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert leak.leaked_items(d.limit(0), i).count() == 0 and leak.leaked_items(d, i.limit(0)).count() == 0


def test_passages_lead_back_to_the_text(spark):
    item = "The İstanbul STRASSE of one two three four five six seven eight nine ten eleven"
    doc = "İİ before. The İstanbul, strasse of one two three — four five six\nseven eight nine ten eleven! after"
    d, i = frames(spark, [(1, doc)], [(7, item)])
    (r,) = leak.leaked_passages(d, i).collect()
    assert doc[r.char_start : r.char_end].startswith("The İstanbul") and doc[r.char_start : r.char_end].endswith("eleven")
    assert r.n_words == len(leak.words(item))


def test_passages_alike_in_blocks(spark, monkeypatch):
    docs, items = corpus(4)
    d, i = frames(spark, docs, items)
    whole = {tuple(r) for r in leak.leaked_passages(d, i).collect()}
    monkeypatch.setattr(leak, "ITEM_CHARS", 1500)
    assert whole and {tuple(r) for r in leak.leaked_passages(d, i).collect()} == whole


def test_more_words_than_code_points():
    s = leak.Scanner([], 12)
    n = 1_200_000
    codes = {s._letters(str(k)) for k in range(n)}
    assert len(codes) == n and all(len(x) == 2 and x[0] < "\ud800" <= x[1] for x in codes)
