import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from bandloom.llm import language

LONG = 40_000


@pytest.fixture
def docs(spark):
    words = {"en": "the and of with that is", "fr": "le été façon où être les", "ru": "привет как дела и не что"}
    rows = []
    for i in range(120):
        lang = ["en", "fr", "ru"][i % 3]
        bag = words[lang].split()
        rows.append((i, " ".join(bag[(i * k + k) % 6] for k in range(1, 30)), lang if i % 10 else None, "src", 1.0))
    rows += [(500, None, "en", None, 0.0), (501, " 12 _ ½² ", "fr", None, 0.0), (502, "", None, None, 0.0), (503, "the " * LONG, None, "x", 0.0), (None, "les", None, "x", 0.0), (7, rows[7][1], "fr", None, 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").repartition(3)


def brute(rows):
    """Plain naive Bayes with the same n-grams and hash."""

    def grams(text):
        out = Counter()
        padded = f" {text} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                h = 0
                for c in padded[i : i + n]:
                    h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                out[h >> 49] += 1
        return out

    counts, docs = {}, Counter()
    for r in rows:
        if r.lang is not None and zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 != 2:
            docs[r.lang] += 1
            clean = language.letters(r.text)
            counts.setdefault(r.lang, Counter()).update(grams(clean) if clean else {})
    langs = sorted(docs)
    size = {k: sum(counts[k].values()) + 0.5 * 2**15 for k in langs}
    out = []
    for r in rows:
        clean = language.letters(r.text)
        if not clean:
            out.append(("und", 0.0))
            continue
        sums = [math.log(docs[k] / sum(docs.values())) + sum(n * math.log((counts[k][g] + 0.5) / size[k]) for g, n in grams(clean).items()) for k in langs]
        best = int(np.argmax(sums))
        out.append((langs[best], 1 / sum(math.exp(s - sums[best]) for s in sums)))
    return out


@pytest.mark.parametrize("block", [language.LANGUAGES, 2, 1])
def test_against_plain_form(docs, block):
    got = language.predict(docs, block).collect()
    assert got[0].row.__fields__ == docs.columns
    for r, (lang, score) in zip(got, brute([r.row for r in got]), strict=True):
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-9)
    assert {r.lang_pred for r in got if r.row.doc_id in (500, 501, 502)} == {"und"}


def test_held_out_accuracy(docs):
    got = [r for r in language.predict(docs).select("row.*", "lang_pred", language.held_out(F.col("row.doc_id")).alias("out")).collect() if r.out and r.lang and r.doc_id < 500]
    assert len(got) > 10 and np.mean([r.lang_pred == r.lang for r in got]) > 0.95


def test_nothing_to_learn_from(docs):
    assert {r.lang_pred for r in language.predict(docs.where("lang is null")).collect()} == {"und"}
    assert language.predict(docs.limit(0)).collect() == []


def test_chunks_count_as_one(monkeypatch):
    text = "abc déf ghi" * 30
    whole = language.ngram_counts(text)
    monkeypatch.setattr(language, "CHUNK", 50)
    parts = language.ngram_counts(text)
    assert [list(p) for p in parts] == [list(w) for w in whole]


def test_any_number_of_languages(spark):
    rows = [(4 * k, chr(0x4E00 + k) * 5, f"l{k:03}") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {d for d, _, _ in rows if zlib.crc32(str(d).encode()) % 4 != 2}
    got = language.predict(docs, 64).collect()
    assert len(got) == 150 and all(r.lang_pred == r.row.lang for r in got if r.row.doc_id in learned)


def test_clashing_names_come_back(spark):
    names = ["row", "LANG_PRED", "top", "every", "_score", "bucket", "n", "held_out"]
    rows = [(k, "the end of it", "en", *([n, str(k)] for n in names)) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{n} array<string>" for n in names))
    assert language.known(docs).columns == docs.columns
    assert sorted(map(tuple, language.known(docs).collect())) == rows
