import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from bandloom.llm import tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("high", [1, 2, 100, 50_257, 1 << 40, 1 << 63])
def test_pack_and_unpack(high):
    rng = np.random.default_rng(high % 1000)
    for n in (0, 1, 2, 59, 60, 61, 4095, 4096, 4097, 20_000):
        ids = rng.integers(0, high, n, dtype=np.uint64)
        ids[rng.random(n) < 0.3] = 0
        words, offsets = tokenfile.pack(ids)
        assert tokenfile.unpack(words).tolist() == ids.tolist()
        for run, at in enumerate(offsets.tolist()):
            end = offsets[run + 1] if run + 1 < len(offsets) else len(words)
            assert tokenfile.unpack(words[at:end]).tolist() == ids[run * tokenfile.RUN : (run + 1) * tokenfile.RUN].tolist()


def test_words_take_as_many_as_fit():
    assert len(tokenfile.pack(np.full(4096, 1, np.uint64))[0]) == 70  # 68 of 60 ids, then 15 and 1
    assert len(tokenfile.pack(np.full(400, 30_000, np.uint64))[0]) == 100


def test_blocks():
    made = tokenfile.block(3, 0, [None, 5], [2, 1], np.array([7, 0, 0], np.uint64)) + tokenfile.SEPARATOR.encode()
    made += tokenfile.block(3, 1, [6], [1], np.array([0], np.uint64)) + tokenfile.SEPARATOR.encode()
    got = [(b.file, b.number, b.doc_ids, b.counts.tolist(), b.ids(0, b.size).tolist()) for b in tokenfile.blocks(made)]
    assert got == [(3, 0, [None, 5], [2, 1], [7, 0, 0]), (3, 1, [6], [1], [0])]


def test_ranges_are_decoded_from_their_runs(monkeypatch):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 60_000, 30_000, dtype=np.uint64)
    ids[::977] = 1 << 63
    counts = [1, 0, 9000, 20_000, 999]
    made = tokenfile.Block(tokenfile.block(0, 0, [1, 2, 3, 4, 5], counts, ids), 0)
    for start, stop in ((0, 1), (4095, 4097), (9001, 29_001), (29_999, 30_000), (5, 5), (0, 30_000)):
        assert made.ids(start, stop).tolist() == ids[start:stop].tolist()
    monkeypatch.setattr(tokenfile, "PIECE", 2)
    ends = np.cumsum(counts)
    assert made.crcs() == [zlib.crc32(ids[e - c : e].astype("<u4").tobytes()) for e, c in zip(ends, counts)]
    made.offsets = made.offsets + np.arange(len(made.offsets))
    with pytest.raises(ValueError):
        made.ids(5000, 9000)


PARTS = ["the", "a", "Über", "naïve,", "\n", "x.\ny", " ", "  ", "end.", "<|endoftext|>", "don't", "日本語", "\x1e", "\t", "\u00a0", "\u3000", "é", "«", "\u2003", "—", "'s", "\x85", "🙂"]


@pytest.mark.parametrize("size", [3, 100_000])
def test_same_as_library(size, monkeypatch):
    monkeypatch.setattr(tokenfile, "REVIEW", 2000)
    library = Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as file:
        encoder = tokenfile.TextIds(tokenfile._Library(file.read()), size)
    rng = random.Random(size)
    for _ in range(60):
        texts = ["".join(rng.choice(PARTS) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(20))) for _ in range(30)]
        texts[3], texts[9] = None, ""
        ids, counts = encoder.of(pa.array(["cut off", *texts], pa.string()).slice(1))
        want = [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_tokenizers_that_cannot_be_cut(tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        encoder = tokenfile.TextIds(tokenfile._Library(file.read()))
    texts = ["Hello the world\nagain", "", " x"]
    ids, counts = encoder.of(pa.array(texts))
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def _expected(rows):
    library = Tokenizer.from_file(PATH)
    ids = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in rows]
    return [(doc_id, len(i), zlib.crc32(struct.pack(f"<{len(i)}I", *i))) for doc_id, i in ids]


def test_round_trip(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i * 7 % 100, " ".join(rng.choice(PARTS) for _ in range(rng.randrange(30))), 1) for i in range(100)]
    rows += [(3, None, 1), (200, "", 1), (None, "no id", 1), (7, rows[1][1], 1), (300, "long " * 30_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    monkeypatch.setattr(tokenfile, "BLOCK", 300)
    got = sorted(tokenfile.round_trip(docs, PATH, files=5).collect(), key=lambda r: r.start)
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    assert sorted((tuple(r)[:1] + tuple(r)[2:] for r in got), key=key) == sorted(_expected(rows), key=key)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: -1 if d is None else d)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert tokenfile.round_trip(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("doc_id", [5, None])
def test_one_doc_id_on_every_row_is_dealt_over_files(spark, doc_id):
    rows = [(doc_id, f"text {i % 40} of some words") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = tokenfile.new_path(spark, "token-files")
    tokenfile.write(docs, PATH, path, files=8)
    found = tokenfile.read(spark, path).collect()
    assert len({r.file for r in found}) >= 4
    assert sorted((r.n_tokens, r.ids_crc32) for r in found) == sorted(r[1:] for r in _expected(rows))
