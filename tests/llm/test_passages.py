"""Operators that cut text held by earlier documents, against brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobtide.llm.arrays import NO_ID, pack_longs, pack_sorted, unpack_longs, unpack_sorted
from jobtide.llm.sketch import Sketch
from jobtide.llm.substrings import remove_repeated_windows
from jobtide.llm.suffixes import BlindTrie, remove_repeated_passages, sort_suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def least_starts(rows, width):
    """Smallest id for each run of items."""
    out = {}
    for i, items in rows:
        for j in range(len(items) - width + 1):
            key = items[j : j + width]
            out[key] = min(out.get(key, NO_ID), NO_ID if i is None else i)
    return out


def cover(i, items, width, least):
    gone = [False] * len(items)
    for j in range(len(items) - width + 1):
        if least[items[j : j + width]] < (NO_ID if i is None else i):
            gone[j : j + width] = [True] * width
    return gone


def key(row):
    return tuple((v is None, v) for v in row)


@pytest.mark.parametrize("block_bytes", [None, 3000])
def test_windows(spark, make, texts, block_bytes):
    rows = [(i, tuple(WORD.findall(t or ""))) for i, t in texts]
    least = least_starts(rows, 13)
    want = []
    for i, words in rows:
        gone = cover(i, words, 13, least)
        want.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    got = remove_repeated_windows(make(texts), block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r[2] for r in want) > 500


@pytest.mark.parametrize("block_bytes", [None, 3000])
def test_passages(spark, make, texts, block_bytes):
    rows = [(i, (t or "").encode()) for i, t in texts]
    least = least_starts(rows, 50)
    want = []
    for i, data in rows:
        gone = cover(i, data, 50, least)
        spans = "".join("x" if g else "." for g in gone)
        runs = tuple((m.start(), m.end()) for m in re.finditer("x+", spans))
        want.append((i, len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g)))
    got = remove_repeated_passages(make(texts), block_bytes=block_bytes).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in got]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[2] for r in want) > 5000


def test_one_line_in_many_documents_is_spread_over_shards(spark, make):
    """A line with other neighbours in every document: its stretches do not meet in one shard."""
    from jobtide.llm import suffixes
    from jobtide.llm.blocks import into_blocks

    rng = random.Random(6)
    line = "this line of seventy bytes or so stands in every document, word by word"

    def prose(n):
        return "".join(rng.choices("abcdefghiklmnorstuw ", k=n))

    rows = [(i, prose(120) + line + prose(120)) for i in range(3000)]
    _, sent, _ = suffixes._passages(into_blocks(make(rows), block_bytes=60_000), 50)
    sizes = sent.groupBy("shard").agg(F.sum(F.aggregate(F.split(F.hex("sizes"), "(?<=\\G..)"), F.lit(0), lambda s, x: s + F.coalesce(F.conv(x, 16, 10).cast("int"), F.lit(0)))).alias("n"))
    sizes = sorted(r.n for r in sizes.collect())
    assert sizes[-1] < 5 * sizes[len(sizes) // 2]
    least = least_starts([(i, t.encode()) for i, t in rows], 50)
    want = {i: sum(cover(i, t.encode(), 50, least)) for i, t in rows}
    got = remove_repeated_passages(make(rows), block_bytes=60_000).collect()
    assert {r.doc_id: r.n_removed for r in got} == want and sum(want.values()) >= 2999 * len(line)


def test_carried_columns_and_whole_characters(spark, make):
    rows = [(1, "a" * 55 + "é" * 30), (2, "b" + "a" * 55 + "é" * 30 + "ü" * 5), (3, None)]
    out = {r.doc_id: r for r in remove_repeated_passages(make(rows), carry=["shard", "rest", "doc_id"]).collect()}
    # the first byte of the first ü is also the first of an é, so it closes a common passage
    assert out[2].kept_text == "b" + "ü" * 4 and bytes(out[2].kept) == "b".encode() + "ü".encode()[1:] + "üüüü".encode()
    assert out[2].rest.shard == "x" and out[2].rest.rest == 2
    assert out[3].kept_text == "" and out[3].n_bytes == 0
    half = [(1, "x" * 49 + "é"), (2, "x" * 49 + "è" + "end")]  # 50 common bytes end inside a character
    out = {r.doc_id: r for r in remove_repeated_passages(make(half), carry=["doc_id"]).collect()}
    assert out[2].n_removed == 50 and out[2].kept_text == "end" and bytes(out[2].kept) == "è".encode()[1:] + b"end"


@pytest.mark.parametrize("run", [remove_repeated_windows, remove_repeated_passages])
def test_empty_table(spark, make, run):
    assert run(make([(1, "a")]).limit(0)).collect() == []


def test_long_documents_do_not_depend_on_their_neighbours(spark, make, monkeypatch):
    """Texts longer than a piece are cut at places counted from their start."""
    from jobtide.llm import suffixes

    rng = random.Random(1)
    long = "".join(rng.choices("abcdefgh ", k=600_000))
    rows = [(1, long), (2, "zz" + long[1000:]), (3, long[:300_000])]
    out = {r.doc_id: r.n_removed for r in suffixes.remove_repeated_passages(make(rows, 1)).collect()}
    assert out == {1: 0, 2: 599_000, 3: 300_000}


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=60, max_size=200).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 60), st.sampled_from([0, 8, 24, 40]))
def test_suffix_order(data, depth, shallow):
    text = np.frombuffer(data + data[:50] + bytes(60), np.uint8)
    starts = np.random.default_rng(depth).permutation(len(data))
    order, number = sort_suffixes(text, starts, depth, shallow)
    keys = [text[s : s + depth].tobytes() for s in starts[order]]
    assert sorted(order.tolist()) == list(range(len(starts))) and keys == sorted(keys)
    assert all((a == b) == (x == y) for a, b, x, y in zip(keys, keys[1:], number, number[1:]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=6).map(lambda b: bytes(x % 2 for x in b)), max_size=40))
def test_blind_trie(strings):
    trie = BlindTrie()
    for i, s in enumerate(strings):
        trie.add(s, i)
    classes = list(trie.classes())
    assert [strings[c[0]] for c in classes] == sorted(set(strings))
    assert all({strings[i] for i in c} == {strings[c[0]]} for c in classes)
    assert sorted(i for c in classes for i in c) == list(range(len(strings)))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=50))
def test_packed_lists(values):
    values = np.array(sorted(values), np.int64)
    assert unpack_sorted(pack_sorted(values)).tolist() == values.tolist()
    assert unpack_longs(pack_longs(values - 7)).tolist() == (values - 7).tolist()


def test_sketch_loses_no_repeated_key():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    shared = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    blocks = [np.concatenate([rng.integers(0, 1 << 63, 300).astype(np.uint64), shared[i % 2 :: 2]]) for i in range(4)]
    for bits, shards in ((12, 3), (9, 1)):
        grid = Sketch(2, bits, shards)
        hashes = [[b, b * np.uint64(0x9E3779B97F4A7C15)] for b in blocks]
        requests = pa.Table.from_batches([grid.requests(i, h) for i, h in enumerate(hashes)]).to_pandas()
        replies = [grid.answers(s, pa.Table.from_pandas(g)).to_pandas() for s, g in requests.groupby("shard")]
        replies = [r for a in replies for r in a.to_dict("records")]
        for i, h in enumerate(hashes):
            own = [r for r in replies if r["block"] == i]
            found = grid.repeated(h, [r["shard"] for r in own], [r["heavy"] for r in own])
            assert found[np.isin(h[0], shared)].all()
            if bits == 12:
                assert found.mean() < 0.5
