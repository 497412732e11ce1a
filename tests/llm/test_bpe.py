import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def enc():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.encoder(f.read())


@pytest.fixture(scope="module")
def ref():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(enc, ref, text):
    ids = enc.encode(text)
    assert ids == ref(text)
    assert enc.decode(ids) == text


def test_shapes(enc, ref):
    r = random.Random(1)
    cases = ["<|endoftext|>", "a<|endoftext|>b", " " * 500, "\n\n \t", "'LL 'll can't", "a" * 20_000, "ab" * 5000, "".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(30_000)), "é" * 999, "🙂👍🏽", "\u0000\u0001"]
    cases += ["".join(r.choice("abcdefgh ") for _ in range(200)) for _ in range(200)]
    for x in cases:
        assert enc.encode(x) == ref(x), x[:40]


def test_tokens_encode_to_themselves(enc):
    bad = [w for w in enc.names if (t := w.encode("latin-1").decode("utf-8", "ignore")) and t.encode().decode("latin-1") == w and " " not in w[1:] and len(enc.piece(t)) != 1]
    assert not bad


def test_frames(spark):
    rows = [(1, "hello world"), (2, ""), (3, None), (3, None), (None, " x"), (5, "  \n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as ids")
    out = bpe.encode(df)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = sorted(((r.doc_id or 0, r.ids) for r in out.collect()), key=str)
    assert got[0][0] == 0 and [x for i, x in got if i in (2, 3)] == [[], [], []] and len(got) == 6
    back = {r.doc_id: r.text for r in bpe.decode(out).collect()}
    assert back == {1: "hello world", 2: "", 3: "", None: " x", 5: "  \n"}
    assert bpe.encode(df.limit(0)).count() == 0
