import hashlib
import zlib

import pytest

from bandloom.llm import merkle

from .oracle import query_rows, sql_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, size long, digest string"


def documents():
    more = ["t", 1, 2, "d"]
    rows = [[i, f"text {i}\nwith a line\n", "en" if i % 3 else None, ["a", "a", "b", "é", None, ""][i % 6], i, *more] for i in range(100)]
    rows += [[200, None, None, None, None, None, None, None, None], [201, "", "", "only", 0, *more], [202, "\n" * 50_000, "en", "long", 1, *more]]
    rows += [[7, "other\n", "en", "a", 1, *more], [7, "other\n", "en", "a", 1, *more], [None, "no id\n", "en", "a", 1, *more], [None, None, "en", "b", 1, *more]]
    return rows + [[300 + i, "same", "en", "hot", 1, *more] for i in range(60)]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    fields = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha(*("-" if f is None else f"{len(f.encode())}:{f}" for f in fields))


def climb(nodes):
    """Root, and the siblings of each node as (left, right) by level."""
    paths, owners = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, new = [], []
        for k in range(0, len(nodes), 3):
            run = nodes[k : k + 3]
            for x in range(len(run)):
                for o in owners[k + x]:
                    paths[o].append(("".join(run[:x]), "".join(run[x + 1 :])))
            up.append(sha(*run))
            new.append([o for own in owners[k : k + 3] for o in own])
        nodes, owners = up, new
    return nodes[0], paths


def brute(rows):
    sources = {}
    for d, text, lang, source, n, *_ in rows:
        sources.setdefault(source, []).append((d is not None, d or 0, leaf(d, text, lang, source, n), d, text, lang, source, n))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([r[2] for r in sorted(sources[s], key=lambda r: r[:3])]) for s in order}
    root, tops = climb([trees[s][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for r, path in zip(sorted(sources[s], key=lambda r: r[:3]), trees[s][1], strict=True):
            d, text, *rest = r[3:]
            if d is not None and text is not None and zlib.crc32(str(d).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = leaf(d, text, rest[0], s, rest[2])
            for left, right in path + tops[at]:
                now = sha(left, now, right)
            out.append((d, r[2], trees[s][0], root, sha(*(a + b for a, b in path + tops[at])), now, now == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("deep", [6, 2, 1])
def test_levels_of_superblocks(deep):
    for n in (1, 2, 3, 4, 7, 9, 10, 28, 800):
        size, level = n, [sha(str(k)) for k in range(n)]
        nodes = level
        while True:  # superblock by superblock, until one node is left
            level = [merkle._levels(level[k : k + 3**deep], size, deep)[-1][0] for k in range(0, size, 3**deep)]
            size = len(level)
            if size == 1:
                break
        assert level[0] == climb(nodes)[0]


@pytest.mark.parametrize("deep", [1, 2])
def test_outer_nodes_in_several_rounds(spark, deep):
    """Small superblocks, so that sources and the tree of their roots take several rounds of outer nodes."""
    got = sorted(map(tuple, merkle.manifest(spark.createDataFrame(documents(), DOCS), deep=deep).collect()), key=repr)
    want = sorted([(*r[:5], r[3], True) for r in brute(documents())], key=repr)
    assert got == want


def test_against_brute_force_and_sql(spark, tmp_path):
    docs = spark.createDataFrame(documents(), DOCS).repartition(4)
    got = query_rows("op12_merkle_manifest", spark, tmp_path, documents=docs)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = [tuple(v for _, v in sorted(zip(names, r))) for r in brute(documents())]
    assert got == sorted(want, key=repr) == sql_rows("op12_merkle_manifest", documents=docs)
    assert {r[6] for r in brute(documents())} == {True, False}


def test_outer_trees_of_several_superblocks(spark):
    docs = spark.createDataFrame([[i, "x\n", "en", "a" if i % 4 else "b", 1, None, None, None, None] for i in range(2500)], DOCS)
    got = {r.doc_id: r for r in merkle.manifest(docs).collect()}
    want = {r[0]: r for r in brute([list(r) for r in docs.collect()])}
    for d, r in got.items():
        assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) == (*want[d][1:5], r.root) and r.verified


def test_empty_and_lone(spark):
    docs = spark.createDataFrame(documents(), DOCS)
    assert merkle.manifest(docs.limit(0)).count() == 0
    row = merkle.manifest(docs.where("doc_id = 201")).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == sha("") and row.verified
