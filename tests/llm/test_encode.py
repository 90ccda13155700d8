import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import encode as E
from paperloom.llm.encode import Encoder, count_tokens, encode, vocabulary_path


@pytest.fixture(scope="module")
def both():
    with open(vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Encoder(vocabulary_path()), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_odd_texts(both):
    own, ref = both
    texts = ["a" * 5000, " " * 3000, "ab" * 700, "é" * 300, "漢字" * 200, "<|endoftext|>", "\x00\n\t", "x" * 257, "aaa" * 90, "I'll don't", "1234567 89"]
    assert own.encode(texts) == [ref(t) for t in texts]
    assert own.encode([None, ""]) == [[], []]


def test_memory_of_pieces_is_bounded(both, monkeypatch):
    import paperloom.llm.encode as e

    own, ref = both
    monkeypatch.setattr(e, "REMEMBERED", 50)
    own.known = {}
    texts = [f"word{i} again{i * 7}" for i in range(60)]
    assert own.encode(texts) == [ref(t) for t in texts] and own.encode(texts[:3]) == [ref(t) for t in texts[:3]]


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
def test_any_text(both, text):
    own, ref = both
    assert own.encode([text]) == [ref(text)]


def test_frames(spark, both):
    _, ref = both
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z"), (None, "a b", "q")], "doc_id long, text string, IDS string")
    got = [(r.doc_id, r.ids) for r in encode(df, "doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted([(1, ref("hello world")), (2, []), (3, []), (3, []), (None, ref("a b"))], key=str)
    assert encode(df.limit(0), "doc_id", "text").count() == 0
    assert sorted(r.n_tokens for r in count_tokens(df, "text").collect()) == sorted([len(ref("hello world")), 0, 0, 0, len(ref("a b"))])


def test_long_pieces_take_the_same_pairs_as_matrices(monkeypatch):
    rnd = random.Random(8)
    pieces = ["".join(rnd.choice("abcetinos") for _ in range(n)) for n in (2, 3, 40, 120, 255)] + ["a" * 200, "ab" * 100, "é" * 99, "-=" * 90]
    short = E.Encoder(E.vocabulary_path())
    short.learn(pieces)
    monkeypatch.setattr(E, "LONG", 0)
    long = E.Encoder(E.vocabulary_path())
    long.learn(pieces)
    assert short.known == long.known
