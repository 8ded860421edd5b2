import base64
import os
import random

import pytest
import tiktoken

from millrace.llm.bpe import DEFAULT_VOCABULARY, PATTERN, BytePairEncoder, count_tokens, decode_corpus, encode_corpus

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def ours():
    return BytePairEncoder(DEFAULT_VOCABULARY)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(DEFAULT_VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_against_public_encoder(ours, reference):
    rng = random.Random(8)
    alphabets = ["abcde ", "aA1 .,'", "日本語の文章。", "สวัสดี ครับ", "нет да ", "\n\t  x", "🎉👩‍🔧é́", "0123456789.-"]
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(0, 300))) for a in alphabets for _ in range(40)]
    texts += ["<|endoftext|> is text", "a" * 5000, "ab" * 4000, "\u0000", "it's they'll I'D", " " * 1000 + "x", "日" * 3000]
    for t in texts:
        assert ours.encode(t) == reference.encode_ordinary(t), t[:50]


def test_merging_without_whole_tokens(ours, reference):
    for word in (" international", "straightforwardness", "aaaaaaaaab", " Überraschung"):
        assert ours.merge(word.encode()) == reference.encode_ordinary(word)


def test_long_pre_token_is_not_quadratic(ours):
    import time

    t = time.time()
    ids = ours.merge(b"xyzq" * 50_000)
    assert b"".join(ours.tokens[i] for i in ids) == b"xyzq" * 50_000 and time.time() - t < 20


def test_corpus(spark):
    rows = [(1, "Hello world"), (2, ""), (3, None), (4, "héllo"), (4, "héllo"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as ids", "1 as n_tokens")
    got = [(r.doc_id, list(r.ids)) for r in encode_corpus(df).collect()]
    assert len(got) == 6 and dict(got)[2] == [] and dict(got)[3] == [] and dict(got)[1] == [15496, 995]
    assert {r.doc_id: r.n_tokens for r in count_tokens(df).collect()}[1] == 2
    assert encode_corpus(df.limit(0)).count() == 0


def test_decoding_gives_the_texts_back(spark):
    texts = ["", None, "a  b\n\nc", "naïve 中文 🤖", "x" * 5000, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = dict(map(tuple, decode_corpus(encode_corpus(df)).collect()))
    assert got == {i: t or "" for i, t in enumerate(texts)}
