"""Token counts and byte-level BPE, against the two libraries."""

import base64
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from jobtide.llm import bytebpe
from jobtide.llm.bytebpe import byte_pairs, decode, encode
from jobtide.llm.token_counts import count_tokens

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
COUNTED = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    signs = "ab cd's'll've're 't'm'd \n\t  \r  é漢字ÄßıŁ1٣½²!?.,'\"-_<|endoftext|>🙂՘ \x1c\x85"
    out = ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(1500)]
    return out + ["<|endoftext|>", "a<|endoftext|>b", "a  <|endoftext|>  b", "<|endof", "text|>", " '", "'s's", "''s", "\n's", "a" * 500, " " * 300]


@pytest.mark.parametrize("block_bytes", [None, 2000])
def test_counts(spark, make, texts, odd, block_bytes):
    rows = texts + [(1000 + i, t) for i, t in enumerate(odd)]
    got = count_tokens(make(rows), COUNTED, block_bytes=block_bytes).collect()
    known = Tokenizer.from_file(COUNTED)
    plain = [t or "" for _, t in rows]
    want = [(i, len(t.encode()), len(e.ids)) for (i, _), t, e in zip(rows, plain, known.encode_batch(plain, add_special_tokens=False))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_round_trip(spark, make, texts, odd, library):
    rows = texts + [(1000 + i, t) for i, t in enumerate(odd)]
    out = decode(encode(make(rows), RANKS), RANKS).collect()
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in out), key=str) == sorted(want, key=str)


def test_plain_merging_agrees(library):
    known, rng = byte_pairs(RANKS), random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choices("theraintio nés", k=rng.randint(1, 14))).encode()
        whole = known.ranks.get(text)
        assert known.encode(text) == ([whole] if whole is not None else known.merge(text))


def test_pairs_are_compatible_if_merging_gives_them_back(library):
    known, rng = byte_pairs(RANKS), random.Random(6)
    tokens = [t for t in range(2000)] + rng.sample(range(2000, 50000), 500)
    for _ in range(4000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert known.compatible(a, b) == (known.merge(known.tokens[a] + known.tokens[b]) == [a, b])


def test_small_stores(monkeypatch, library):
    """A full store is emptied; results stay the same."""
    monkeypatch.setattr(bytebpe, "REMEMBERED_BYTES", 700)
    monkeypatch.setattr(bytebpe, "REMEMBERED_PAIRS", 3)
    known = bytebpe.BytePairs(RANKS)
    text = "some words that repeat and some that do not repeat unhappily"
    assert bytebpe._encoded(pa.array([text, text]), known).to_pylist() == [library.encode_ordinary(text)] * 2


def test_unknown_ids_are_refused(spark):
    with pytest.raises(Exception, match="no token has the id 99999"):
        decode(spark.createDataFrame([(1, [5, 99999])], "doc_id long, ids array<int>"), RANKS).collect()


def test_empty_tables(spark, make):
    empty = make([(1, "a")]).limit(0)
    assert count_tokens(empty, COUNTED).collect() == [] and decode(encode(empty, RANKS), RANKS).collect() == []
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(decode(nulls, RANKS).first().decoded) == b""


def test_decoding_in_pieces(monkeypatch, library):
    """Bytes are read off the joined tokens, few ids at a time; null and empty lists, slices, ids that no token has."""
    monkeypatch.setattr(bytebpe, "DECODED_TOGETHER", 3)
    known, texts = byte_pairs(RANKS), ["", "naïve 漢字 🙂 and some more words", "a", "unhappily so, " * 9]
    ids = [library.encode_ordinary(t) for t in texts]
    for kind in (pa.list_(pa.int32()), pa.large_list(pa.int64())):
        column = pa.array([[1], None, *ids, None], kind)
        got = bytebpe._decoded(column.slice(1), known)
        assert got.to_pylist() == [b"", *(t.encode() for t in texts), b""] and got.type == pa.binary()
        assert bytebpe._decoded(column.slice(0, 0), known).to_pylist() == []
        for wrong, named in (([7, 60000, 99999], "99999"), ([99999, -4, -2], "-4")):
            with pytest.raises(ValueError, match=f"no token has the id {named}"):
                bytebpe._decoded(pa.array([[1, 2], None, wrong, [-9]], kind), known)
