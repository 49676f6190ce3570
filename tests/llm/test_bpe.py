import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from bandloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return bpe.read_ranks(file.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


BITS = ["the", " quick", "  ", " ", "\n", "\n\n", " \t", "'re", "'", "r", "e's", "12", "³", "é", "ü", "日本", "🙂", "a" * 70, "!?", "_", "\x1c", " ", " ", "ing", "Tion", "<|endoftext|>", "\x00", "abcabc" * 9]


@pytest.mark.parametrize("chars, plain", [(bpe.LEAF_CHARS, bpe.PLAIN), (8, 2), (3, 0)])
def test_same_as_library(ranks, library, monkeypatch, chars, plain):
    monkeypatch.setattr(bpe, "LEAF_CHARS", chars)
    monkeypatch.setattr(bpe, "PLAIN", plain)
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    rng = random.Random(chars)
    for _ in range(1500):
        text = "".join(rng.choice(BITS) for _ in range(rng.randrange(12)))
        ids = codec.encode(text).tolist()
        assert ids == library.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_long_matches(ranks, library):
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    for text in ("a" * 5000, "ab" * 3000 + "b", " " * 40_000, "word " * 20_000, "-=" * 3000):
        assert codec.encode(text).tolist() == library.encode_ordinary(text)


def test_query_form(spark, library):
    rows = [(1, "Hello  world's end", 9), (2, None, 9), (3, "", 9), (None, "x", 9), (1, "Hello  world's end", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(got) == 5
    for r in got:
        text = {1: "Hello  world's end", None: "x"}.get(r.doc_id, "")
        ids = library.encode_ordinary(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_a_full_cache_that_no_longer_serves_is_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "REVIEW", 10)
    calls = []
    ids = bpe.ChunkIds(lambda new: calls.append(sorted(new)) or [c.encode() for c in new], size=3)
    for text in ("a b c", "a b c d", "x y z w", "x y z w", "x y z w", "x y z w"):
        asked = len(calls)
        assert ids.of(bpe.chunks(text)) == [c.encode() for c in bpe.chunks(text)]
    assert len(calls) == asked


def test_ordinary_documents_are_joined_from_halves(ranks, library, monkeypatch):
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    joins, beside, joined = {"texts": 0, "matches": 0}, codec._beside, codec._joined
    monkeypatch.setattr(codec, "_beside", lambda *a: joins.__setitem__("texts", joins["texts"] + 1) or beside(*a))
    monkeypatch.setattr(codec, "_joined", lambda *a: joins.__setitem__("matches", joins["matches"] + 1) or joined(*a))
    text = "An ordinary paragraph, of words like unbelievably or Kaffeemaschinenreiniger. " * 20
    assert codec.encode(text).tolist() == library.encode_ordinary(text)
    assert joins["texts"] == -(-len(text) // bpe.LEAF_CHARS) - 1 and joins["matches"] > 15


def test_only_halves_are_remembered(ranks, library):
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    text = " errehablentqzxv nïxqvëzk ⅷxqzwk ᏸqxzv aͅqxzvw ǅqxzvkw ɐqxzvk"
    assert codec.encode(text).tolist() == library.encode_ordinary(text)
    words = [m.encode() for m in codec.pattern.findall(text)]
    assert not any(w in codec.halves for w in words if len(w) > 1) and b" erreh"[:4] in codec.halves


@pytest.mark.parametrize("unit", ["a", "abc", "qxjzkvwy", " ", "the"])
def test_one_match_of_a_million_characters(ranks, unit):
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    text = (unit * 1_000_000)[:1_000_000]
    ids = codec.encode(text).tolist()
    assert codec.decode(ids) == text.encode()
    assert all(codec._neighbours(a, b) for a, b in set(zip(ids, ids[1:])) if unit != " ")
