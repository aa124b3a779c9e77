"""Near-duplicate components against all pairs, and the graph helper."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from jobtide.llm import neardup
from jobtide.llm.components import connected_components
from jobtide.llm.neardup import Signature, near_duplicates
from jobtide.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def wanted(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for i, a in sets:
        for j, b in sets:
            if i <= j and (i == j or a and 100 * len(a & b) >= 75 * len(a | b)):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    out = []
    for i, t in rows:
        c = None if i is None else find(i)
        out.append((i, len(shingles(t)), c, i is None or c == i))
    return Counter(out)


def test_components(spark, make, texts):
    assert Counter(map(tuple, near_duplicates(make(texts)).collect())) == wanted(texts)


def family(n, seed, chance, words=60):
    """Texts around one base; neighbours differ by a few words."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    return [" ".join(w if rng.random() > chance else f"n{rng.randrange(10**6)}" for w in base) for _ in range(n)]


def test_families_at_the_border(spark, make, monkeypatch):
    """Large groups whose similarities lie on both sides of the threshold, with one leader a round."""
    monkeypatch.setattr(neardup, "LEADERS", 1)
    rows = [(1000 * k + i, t) for k, chance in enumerate((0.01, 0.03, 0.05)) for i, t in enumerate(family(40, k, chance))]
    chain = family(1, 9, 0)[0].split()
    for i in range(30):  # each links to the next one only
        rows.append((9000 + i, " ".join(chain)))
        chain = chain[3:] + [f"c{i}{j}" for j in range(3)]
    want = wanted(rows)
    assert Counter(map(tuple, near_duplicates(make(rows)).collect())) == want
    assert len({r[2] for r in want}) > 20


def test_empty_table(spark, make):
    assert near_duplicates(make([(1, "a")]).limit(0)).collect() == []


def test_circulant_coordinates():
    """Coordinate k is the smallest value of one permutation shifted k places, in any batch size."""
    signature = Signature(bands=3, rows=2, bits=10)
    table = neardup._shifts(10, 6)
    assert sorted(table[:, 0].tolist()) == list(range(1024)) and table[5, 2] == table[7, 0] and table[1023, 1] == table[0, 0]
    rng = np.random.default_rng(1)
    docs = np.sort(rng.integers(0, 9, 20_000))
    docs[docs == 4] = 5
    places = rng.integers(0, 1024, 20_000)
    found = signature.of(places, docs, 9)
    for d in set(docs.tolist()):
        assert found[d].tolist() == table[places[docs == d]].min(axis=0).tolist()


def test_estimate_follows_similarity():
    signature = Signature(bands=200, rows=1)
    rng = np.random.default_rng(2)
    for share in (0.3, 0.75, 0.9):
        n = round(800 * share / (1 + share))
        common, a, b = (rng.integers(0, 1 << 22, size) for size in (n, 400 - n, 400 - n))
        x, y = (signature.of(np.concatenate([common, z]), np.zeros(n + len(z), np.int64), 1)[0] for z in (a, b))
        true = n / (n + len(a) + len(b))
        assert abs((x == y).mean() - true) < 0.12


def test_connected_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(7, 7), (9, 8), (8, 9)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    frame = spark.createDataFrame(edges, "a long, b long")
    got = connected_components(frame, Scratch(spark)).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in list(parent)} and len(got) == len(parent)
    assert connected_components(frame.limit(0), Scratch(spark)).collect() == []


def test_pairs_do_not_become_rows(spark, make, monkeypatch):
    """A group of near copies that mostly do not link, in one tile and in many; ids that repeat with different texts."""
    rows = [(i, t) for i, t in enumerate(family(160, 3, 0.04, 90))]
    rows += [(5, rows[9][1]), (5, None), (11, "another text under an id that is taken already")]
    want = wanted(rows)
    assert sum(r[3] for r in want.elements()) > 20
    for members in (1024, 60):
        monkeypatch.setattr(neardup, "CHUNK_MEMBERS", members)
        assert Counter(map(tuple, near_duplicates(make(rows)).collect())) == want
    sets = [np.array(sorted(hash(s) & (2**63 - 1) for s in shingles(t)), np.uint64) for _, t in rows[:160]]
    table = pa.table({
        "doc": list(range(160)), "n": [len(s) for s in sets], "pivot": [1] * 160, "own": [0] * 160,
        "residual": [np.setxor1d(s, sets[7]).tobytes() for s in sets],
    })
    assert len(neardup._linked(table, 75)) < 160 < sum(100 * len(set(x) & set(y)) >= 75 * len(set(x) | set(y)) for i, x in enumerate(sets) for y in sets[:i])
