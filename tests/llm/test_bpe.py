import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm.bpe import VOCABULARY, Tokenizer, Utf8Stream, decode_documents, encode_documents, merge_order, op7_byte_bpe, read_ranks

RANKS = read_ranks(open(P.path(VOCABULARY), "rb").read())
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = Tokenizer(RANKS)


def ids(text):
    return ",".join(map(str, LIBRARY.encode_ordinary(text)))


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert OWN.encode(text) == ids(text)
    assert "".join(OWN.decode(OWN.encode(text))) == text


def test_joined_tokens_and_long_runs():
    rng = random.Random(1)
    tokens = list(RANKS)
    for _ in range(3000):
        text = b"".join(rng.choices(tokens, k=rng.randint(1, 6))).decode("utf-8", "ignore")
        assert OWN.encode(text) == ids(text)
    for text in ("a" * 5000, "ab" * 3000, " " * 3000 + "x", "\n" * 999, "é" * 777, "<|endoftext|>", "0123456789" * 50):
        assert OWN.encode(text) == ids(text)


def test_the_transducer_is_the_definition():
    rng = random.Random(2)
    for _ in range(2000):
        piece = bytes(rng.choices(b"theandionsgr \xc3\xa9", k=rng.randint(1, 24)))
        assert OWN.transducer.encode(piece) == ([RANKS[piece]] if piece in RANKS else merge_order(piece, RANKS))


def test_small_memory_gives_the_same(monkeypatch):
    import tallyspark.llm.bpe as B

    monkeypatch.setattr(B, "STATES_KEPT", 50)
    monkeypatch.setattr(B, "PIECES_KEPT", 10)
    small = Tokenizer(RANKS)
    text = "The quick brown foxes jumped over 13 lazy dogs, naïvely; " * 20
    assert small.encode(text) == ids(text)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(0, 40), max_size=6))
def test_streaming_equals_whole_for_valid_text(data, cuts):
    data = data.decode("utf-8", "ignore").encode()
    cuts = sorted({min(c, len(data)) for c in cuts} | {0, len(data)})
    stream = Utf8Stream()
    out = "".join([stream.feed(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]) + stream.close()
    assert out.encode() == data


def test_documents(spark):
    texts = ["", None, "hello  world", "x" * 100_000, "été 东京 🎉 " * 50, "hello  world"]
    df = spark.createDataFrame([(i if i != 1 else None, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in encode_documents(df).collect()}
    for i, t in enumerate(texts):
        r = got[i if i != 1 else None]
        want = ids(t or "")
        assert (r.n_tokens, r.ids_sha256) == (want.count(",") + 1 if want else 0, hashlib.sha256(want.encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert encode_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken"])
def test_another_vocabulary(name):
    ranks = read_ranks(open(P.path(name), "rb").read())
    library = tiktoken.Encoding("other", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = Tokenizer(ranks)
    for text in ("It's a test of naïve words, 1234 ones.", "internationalisation antidisestablishmentarianism", "  \n\t x"):
        assert own.encode(text) == ",".join(map(str, library.encode_ordinary(text)))


def test_ids_are_returned_and_decode(spark, tmp_path):
    texts = ["", None, "hello  world", "x" * 20_000, "été 东京 🎉 " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = encode_documents(df)
    for r in tokens.collect():
        assert r.ids == LIBRARY.encode_ordinary(texts[r.doc_id] or "") and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
    assert {r.doc_id: r.text for r in decode_documents(tokens).collect()} == {i: t or "" for i, t in enumerate(texts)}
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert op7_byte_bpe(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=30), st.lists(st.integers(0, 30), max_size=5))
def test_any_bytes_come_back(data, cuts):
    """Bytes that are no UTF-8 are neither lost nor changed, and only whole characters go before the rest."""
    cuts = sorted({min(c, len(data)) for c in cuts} | {0, len(data)})
    stream = Utf8Stream()
    parts = [stream.take(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert b"".join(parts) + stream.rest() == data
    assert "".join(p.decode("utf-8", "replace") for p in [*parts, data[sum(map(len, parts)) :]]) == data.decode("utf-8", "replace")


def test_tokens_move_the_machine_as_their_bytes_do():
    import numpy as np

    from tallyspark.llm.bpe import UTF8_MOVES, token_moves

    rng = random.Random(4)
    tokens = [bytes(rng.choices(range(256), k=rng.randint(1, 5))) for _ in range(300)] + ["é".encode()[:1], "🎉".encode()[1:]]
    moves = token_moves(tokens)
    for token, row in zip(tokens, moves):
        for state in range(8):
            to = state
            for b in token:
                to = int(UTF8_MOVES[to, b])
            assert row[state] == to
    single = [r for t, r in RANKS.items() if len(t) == 1]
    ids_ = np.array(rng.choices(single, k=9000))
    assert b"".join(OWN.decoded(ids_)) == b"".join(OWN.bytes_of[i] for i in ids_)


def test_long_text_in_portions(monkeypatch):
    import tallyspark.llm.bpe as B

    monkeypatch.setattr(B, "LONG_TEXT", 100)
    monkeypatch.setattr(B, "PIECES_AT_A_TIME", 7)
    text = "The naïve fox, 東京 and 13 lazy dogs " * 30
    assert OWN.encode(text) == ids(text)
