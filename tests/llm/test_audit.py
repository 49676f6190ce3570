import itertools

import pytest

from bandloom.llm import audit, queries

from .oracle import query_rows, sql_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, bits int, hash string"
LABELS = "doc_id long, quality int, toxic int"
WORDS = " ".join(f"w{i}" for i in range(60))


def documents():
    texts = [
        WORDS,
        WORDS + " ",  # differs in its last character alone
        "w " * 70,
        "WORD " * 60,
        "a\tb\nc\vd\fe\rf",
        " nbsp " + WORDS,  # no white space here
        WORDS + " 100 %",
        "#",
        "",
        None,
        " \n\t ",
        "ÄÖÜ " * 60,
        "x" * 200_000,
        WORDS.upper() + " $",
        "word " * 40_000,
    ]
    rows = [[i, t, "en", ["a", "b", None, ""][i % 4], 1, "p", 7, "h"] for i, t in enumerate(texts)]
    rows += [[100 + i, WORDS, None, "a" if i % 3 else "b", None, None, None, None] for i in range(40)]  # many copies
    rows += [[i, texts[i], "en", "b", 1, "p", 7, "h"] for i in (0, 2, 9)]  # repeated ids with equal and other sources
    rows += [[3, WORDS, "en", "a", 1, "p", 7, "h"], [None, WORDS, "en", "a", 1, "p", 7, "h"], [None, "only here", "en", "c", 1, "p", 7, "h"]]
    return rows


def marks():
    rows = [[i, i % 3, (i + 1) % 2] for i in range(0, 140, 2)] + [[0, 0, 1], [4, None, None], [4, 1, None], [None, 1, 1], [999, 1, 1]]
    return rows


def brute(docs, labels):
    space = " \t\n\v\f\r"
    facts = []
    for d, text, _, source, *_ in docs:
        t = text or ""
        words = "".join(" " if c in space else c for c in t).split(" ")
        words = [w for w in words if w]
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": d is not None and any(e is not None and e < d and (u or "") == t for e, u, *_ in docs),
        }
        good = any(x[0] == d and x[1] == 1 for x in labels) and d is not None
        toxic = any(x[0] == d and x[2] == 1 for x in labels) and d is not None
        facts.append((source or "", {f for f in fails if fails[f]}, good, toxic))
    out = {}
    for part in {f[0] for f in facts}:
        own, shapley = [f for f in facts if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                here = [x for x in own if f in x[1] and not before & x[1]]
                shapley[f] += len(here)
                out[part, "".join(order), step + 1] = [
                    sum(not x[1] & (before | {f}) for x in own), len(here), sum(f in x[1] and bool(before & x[1]) for x in own), sum(x[1] == {f} for x in own), sum(x[2] for x in here), sum(x[3] for x in here),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(3), spark.createDataFrame(marks(), LABELS)


def test_against_brute_force(tables):
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit.audit(*tables).collect()}
    assert got == brute(documents(), marks())


def test_against_sql(spark, tables, tmp_path):
    docs, labels = tables
    assert query_rows("op11_filter_audit", spark, tmp_path, documents=docs, labels=labels) == sql_rows("op11_filter_audit", documents=docs, labels=labels)


def test_hot_hashes_are_salted_and_change_nothing(tables, monkeypatch):
    docs = tables[0]
    plain = sorted(map(tuple, audit.later_copies(docs).select("doc_id", "part").collect()))
    monkeypatch.setattr(audit, "HOT_ROWS", 3)
    assert sorted(map(tuple, audit.later_copies(docs).select("doc_id", "part").collect())) == plain


def test_empty_tables(tables):
    docs, labels = tables
    assert audit.audit(docs.limit(0), labels).count() == 0
    some = audit.audit(docs, labels.limit(0))
    assert some.agg({"good_lost": "max"}).first()[0] == 0 and some.count() == 120 * 5 * 4


def test_registered():
    assert "op11_filter_audit" in queries.QUERIES
