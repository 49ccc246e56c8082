import base64
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")

from vellumflow.llm.encoding import PATTERN, VOCABULARY, Encoder, merge_piece, token_count, token_ids  # noqa: E402


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["a", " ", "\n\n  x", "Hello  world's end", "naïve café – Ångström", "สวัสดี नमस्ते", "🎉🎉 <|endoftext|>", "x" * 3000, "ab" * 2000 + " " * 500, "Ω≈ç√∫˜µ≤≥÷" * 40, "\x00\x01\r\n\t", "0123456789" * 30]


def test_equals_the_public_encoder(reference):
    own = Encoder()
    rnd = random.Random(1)
    texts = TEXTS + ["".join(rnd.choice("abcde éÅ\n.0-") for _ in range(rnd.randint(0, 300))) for _ in range(300)]
    for t in texts:
        assert own.encode(t) == reference.encode_ordinary(t), t[:50]


def test_pieces_of_any_length(reference):
    own, rnd = Encoder(), random.Random(2)
    for n in range(1, 80):
        piece = "".join(rnd.choice("etaoinsh") for _ in range(n))
        assert merge_piece(piece.encode(), own.ranks) == reference.encode_ordinary(piece)


def test_columns(spark, reference):
    rows = [(1, "two words"), (2, ""), (3, None), (4, "long " * 20_000), (1, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = df.select("doc_id", token_ids("text").alias("ids"), token_count("text").alias("n")).collect()
    for (i, text), r in zip(rows, got):
        assert (r.doc_id, r.ids, r.n) == (i, reference.encode_ordinary(text or ""), len(r.ids))
    assert df.limit(0).select(token_ids("text")).collect() == []
