import hashlib
import json
import random

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from bandloom.llm import bpe
from bandloom.llm.sql import ORACLE_SQL

from . import test_language as language_test
from . import test_simhash as simhash_test

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(12)
    bags = {"en": "the and of with that is for this on at river stone walked".split(), "fr": "le été façon où être les une forêt nous avons".split(), "de": "der und über für straße müssen wäre ein haus".split()}
    rows = []
    for i in range(90):
        lang = rng.choice(list(bags))
        text = " ".join(rng.choice(bags[lang]) + str(rng.choice(["", "n", "e", "r"])) for _ in range(rng.randrange(30, 90)))
        rows.append([i, text, lang if i % 9 else None, rng.choice(["a", "b", "b", None]), len(text)])
    for i in range(90, 105):  # equal but for white space, then near copies
        rows.append([i, rows[i - 90][1].replace(" ", "  ", i % 3), "en", "a", 1])
    for i in range(105, 115):
        rows.append([i, rows[i - 80][1] + " end", None, "b", 1])
    rows += [[200, None, "en", "a", 0], [201, "", None, "a", 0], [202, "12 34 -- 99", "fr", "a", 1], [3, rows[3][1], "en", "a", 1], [203, "the end", None, None, None]]
    return rows


class Row:
    def __init__(self, values):
        self.__dict__.update(zip(COLUMNS, values))


def brute(rows):
    kept = []
    for r, (lang, score) in zip(rows, language_test.brute([Row(r) for r in rows]), strict=True):
        if lang != "und" and score >= 0.5:
            kept.append(r)
    groups = {}
    for r in kept:
        groups.setdefault("".join(c for c in r[1] if c not in " \t\n\v\f\r"), []).append(r)
    whole = lambda r: json.dumps({c: v for c, v in zip(COLUMNS, r) if v is not None}, separators=(",", ":"), ensure_ascii=False)
    kept = [min(g, key=lambda r: (-len(r[1]), r[0], r[1], whole(r))) for g in groups.values()]
    kept.sort(key=lambda r: r[0])
    roots = simhash_test.brute([simhash_test.plain_fingerprint(r[1]) for r in kept])
    kept = [r for k, r in enumerate(kept) if roots[k] == k]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", kept)
    mixed = con.sql(f"SELECT doc_id, size, taken FROM ({ORACLE_SQL['op9_source_mixing']})").fetchall()
    times = {d: taken // size for d, size, taken in mixed if taken}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(file.read()), special_tokens={})
    out = []
    for d, text, *_ in kept:
        ids = library.encode_ordinary(text)
        row = (d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        out += [row] * times.get(d, 0)
    return sorted(out)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_against_brute_force(spark, folder):
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == brute(corpus())


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "source mixing", "byte-level BPE"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_columns_of_any_name_come_through(spark, folder):
    """Names that the stages and their operators use themselves."""
    names = "_id id _n n _stays stays other row norm rank digest salt best source_size target times order size range finish pass cum taken fp node root component_id low key lang_pred score shares end slot before run _hot _cold _lane _found words ids".split()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.select("*", *(F.lit(f"own {c}").alias(c) for c in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert docs.select(*names).distinct().collect() == [tuple(f"own {c}" for c in names)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count() > 0


def test_clean_documents_stay_in_the_filtering_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id BETWEEN 0 AND 89").dropDuplicates(["doc_id"])
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, folder)
    assert docs.count() == 90
