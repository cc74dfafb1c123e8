import base64
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from sparsequery.llm.tokenize import CorpusEncoder, count_tokens, encode_texts

ALPHABET = "aab'sstdmlvre  \n\t\r é1２٣.,'　中!?\U0001f600\\{}$"
PIECES = ["ing", "tion", "'ll", "'s", " the", "  ", "\r\n", "0000", "aaaa", "zzzz", "<|endoftext|>"]


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return CorpusEncoder(P.path("byte_bpe_50k.json"), block=500)


def texts(n, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) if r.random() < 0.7 else r.choice(PIECES) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_same_ids_as_the_public_encoder(encoder, public):
    own = [*texts(3000), "", None, "x" * 5000, " " * 3000]
    got = [ids[a:b].tolist() for _, _, ids, at in encoder.blocks(pa.array(own)) for a, b in zip(at[:-1], at[1:])]
    assert got == [public.encode_ordinary(t or "") for t in own]


def test_pretokens_that_share_a_hash(spark, public):
    """Complementary Thue-Morse words have one polynomial hash modulo 2^64, whatever its base."""
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: "b", 98: "a"})
    other = word.translate({97: "b", 98: "a"})
    for block in (1 << 20, 500):
        enc = CorpusEncoder(P.path("byte_bpe_50k.json"), block=block)
        got = [ids[a:b].tolist() for _, _, ids, at in enc.blocks(pa.array([word, other, word])) for a, b in zip(at[:-1], at[1:])]
        assert got == [public.encode_ordinary(t) for t in (word, other, word)]
    df = spark.createDataFrame([(1, word), (2, other)], "doc_id bigint, text string").coalesce(1)
    assert {r.doc_id: list(r.ids) for r in encode_texts(df).collect()} == {1: public.encode_ordinary(word), 2: public.encode_ordinary(other)}


def test_memory_is_bounded(public):
    enc = CorpusEncoder(P.path("byte_bpe_50k.json"), block=200, remember=50)
    own = texts(400, 7)
    got = [ids[a:b].tolist() for _, _, ids, at in enc.blocks(pa.array(own)) for a, b in zip(at[:-1], at[1:])]
    assert got == [public.encode_ordinary(t) for t in own] and len(enc.slot) < 400


def test_appends_and_edits(encoder, public):
    r, own = random.Random(1), texts(300, 1)
    for _ in range(500):
        x, y = r.choice(own), r.choice(own)
        assert encoder.dp.append(x, public.encode_ordinary(x), y) == public.encode_ordinary(x + y)
        a = r.randint(0, len(x))
        b = r.randint(a, len(x))
        out, ids = encoder.dp.edit(x, public.encode_ordinary(x), a, b, y)
        assert out == x[:a] + y + x[b:] and ids == public.encode_ordinary(out)


def test_prefixes_extend(encoder):
    dp = encoder.dp
    half = dp.last_tokens(b"hallucin")
    assert dp.last_tokens(b"hallucination", half) == dp.last_tokens(b"hallucination")


def test_tables(spark, public):
    df = spark.createDataFrame([(1, "a b", 7), (2, None, 7), (3, "", 8), (3, "a b", 9)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_texts(df).collect())
    one = public.encode_ordinary("a b")
    assert got == sorted([(1, one), (2, []), (3, []), (3, one)])
    assert encode_texts(df.limit(0)).count() == 0
    assert sorted((r.doc_id, r.n_tokens) for r in count_tokens(df, ["doc_id"]).collect()) == sorted([(1, len(one)), (2, 0), (3, 0), (3, len(one))])
