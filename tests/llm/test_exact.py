import pytest
from pyspark.sql import functions as F

from bandloom.llm import exact, shared

from .oracle import query_rows, sql_rows

ROWS = [
    (1, "a b c", "k"), (2, "a  b c", "k"), (3, "abc", None), (4, None, "z"), (5, "", "z"), (6, " \n\t", "z"), (None, "ab c", "q"),
    (7, "x y", "q"), (8, "xy", "q"), (9, "é\x0b", "q"), (10, "é", "q"), (11, "w " * 50_000, "q"), (12, "w" * 50_000, "q"), (3, "abc", None), (13, "x\x1cy", "q"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, kept string").repartition(3)


def test_against_sql(spark, docs, tmp_path):
    assert query_rows("op5_exact_dedup", spark, tmp_path, documents=docs) == sql_rows("op5_exact_dedup", documents=docs)
    assert query_rows("op5_exact_dedup", spark, tmp_path / "e", documents=docs.limit(0)) == []


def test_clashing_digests_are_told_apart(docs):
    weak = exact.exact_duplicates(docs, digest=lambda norm: F.length(norm) % 2)
    strong = exact.exact_duplicates(docs)
    pick = lambda df: sorted(map(str, df.select("row.doc_id", "keep_id", "group_size", "kept").collect()))
    assert pick(weak) == pick(strong)


def test_deduplicated_keeps_one_of_each(docs):
    kept = exact.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 6, 7, 8, 9, 11, 13]
    twice = docs.union(docs.where("doc_id = 2"))
    assert sorted(r.doc_id for r in exact.deduplicated(twice).collect()) == [2, 6, 7, 8, 9, 11, 13]


def test_hot_groups_are_looked_up_where_they_are(spark, docs, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    monkeypatch.setattr(shared, "HOT_KEYS", 5)
    pick = lambda df: sorted(map(str, df.select("row.doc_id", "keep_id", "group_size", "kept").collect()))
    hot = exact.exact_duplicates(docs)
    monkeypatch.undo()
    assert pick(hot) == pick(exact.exact_duplicates(docs))


def test_clashing_names_come_back(spark):
    names = ["row", "Norm", "digest", "RANK", "salt", "best", "n", "hot", "cold", "key", "found", "keep_id", "group_size", "kept", "_digest", "count"]
    rows = [(k, t, *({"a": f"{n}{k}"} for n in names)) for k, t in ((1, "a b"), (2, "ab"), (3, "c"), (3, "c"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` map<string,string>" for n in names))
    got = sorted(map(tuple, exact.deduplicated(docs).collect()), key=str)
    assert exact.deduplicated(docs).columns == docs.columns and got == [rows[0], rows[2]]
    found = exact.exact_duplicates(docs).select("row.*")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str)


def test_twins_are_told_apart_by_text(spark):
    docs = spark.createDataFrame([(1, "b a", "x"), (1, "ba ", "y"), (1, " ba", "z"), (1, " ba", "w")] * 5, "doc_id long, text string, c string")
    assert [tuple(r) for r in exact.deduplicated(docs.repartition(3)).collect()] == [(1, " ba", "w")]
