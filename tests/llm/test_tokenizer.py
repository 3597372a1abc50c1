import base64
import os
import random

import pytest

from weftline.llm import tokenizer as t

FILE = os.path.join(t.TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary")


@pytest.fixture(scope="module")
def pair():
    tiktoken = pytest.importorskip("tiktoken")
    with open(FILE, "rb") as f:
        raw = f.read()
    return t.Encoder(t.parse_ranks(raw)), tiktoken.Encoding("own", pat_str=t.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, special_tokens={})


def test_equals_public_encoder(pair):
    ours, theirs = pair
    r = random.Random(1)
    texts = ["", " ", "it's  a\r\n\ttest\u00a0 x", "<|endoftext|>", "日本語テキストです", "a" * 3000, "\x1c \x85 ½²", "".join(r.choice("abcdefghij") for _ in range(4000))]
    texts += ["".join(r.choice("ab c'sreltd \n\t1-<|>éß日本\x1f\x85 ") for _ in range(r.randint(1, 40))) for _ in range(3000)]
    for x in texts:
        assert ours.encode(x) == theirs.encode_ordinary(x)
    assert ours.encode(None) == []


def test_column(spark):
    df = spark.createDataFrame([(1, "Hello world", 9), (2, None, 9), (3, "", 9), (1, "Hello world", 9), (None, "x", 9)], "doc_id bigint, text string, ids int")
    got = sorted(map(tuple, t.encode(df).collect()), key=str)
    assert got == sorted([(1, [15496, 995]), (2, []), (3, []), (1, [15496, 995]), (None, [87])], key=str)
    assert t.encode(df.limit(0)).count() == 0
    assert sorted(r.n_tokens for r in t.count_tokens(df, ["doc_id"]).collect()) == [0, 0, 1, 2, 2]
