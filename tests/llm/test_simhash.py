import random

import pytest
import xxhash

from bandloom.llm import simhash
from bandloom.llm.shared import components


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(fps, budget=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "A b C d", "é x\x1cy Ä b\vc d e f", "w " * 70_000])
def test_fingerprint_matches_plain_form(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("node_rows", [3, 512])
def test_components_match_all_pairs(spark, node_rows):
    rng = random.Random(7)
    fps = [0, 1, 3]
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            fps.append(centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1))
    dense = rng.getrandbits(64)
    fps += [dense ^ (rng.getrandbits(9) << 20) for _ in range(120)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed] + [(None,)], "fp long")
    got = {r.node: r.root for r in components(simhash.links(table, node_rows=node_rows)).collect()}
    roots = brute(fps)
    groups = {}
    for f, r in zip(signed, roots):
        groups.setdefault(r, []).append(f)
    want = {f: min(g) for g in groups.values() for f in g if len(g) > 1}
    assert {f: got.get(f, f) for f in signed} == {f: want.get(f, f) for f in signed}


@pytest.mark.parametrize("count", [2, 10_000, 10**7, 10**9, 10**11])
def test_every_close_pair_shares_a_first_node(count):
    orders = simhash.forests(count)
    rng = random.Random(count)
    lead = min(sum(n for _, n in o[: len(o) - 4]) for o in orders)
    for _ in range(200):
        flips = {rng.randrange(64) for _ in range(4)}
        leads = [[p for off, n in o for p in range(off, off + n)][:lead] for o in orders]
        assert any(not flips & set(x) for x in leads)


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base, "x"), (3, base + " tail", "x"), (9, "quite another text with other words", None), (4, None, None), (8, " \t", None), (None, base, "y"), (9, "quite another text with other words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 3), (3, 3), (4, 4), (5, 3), (8, 4), (9, 9), (9, 9)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
