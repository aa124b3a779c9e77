"""Token counts of documents: each distinct pre-token is split once, no ids are kept."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from jobtide.llm.arrays import NO_ID, ids, shard_of, utf8
from jobtide.llm.blocks import into_blocks
from jobtide.llm.pretokens import Pretokens, library_classes

RESULT = "doc_id long, n_bytes long, n_tokens long"


class Vocabulary:
    """A byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        pre = known["pre_tokenizer"]
        if known["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level vocabularies without a normalizer are counted here")
        added = known["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must stand for their plain text")
        longest_first = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, longest_first))) if added else None
        library = Tokenizer.from_file(path)
        self._model = library.model
        self.classes = library_classes(lambda text: len(library.pre_tokenizer.pre_tokenize_str(text)))
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(plain)]
        self._letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}

    def count(self, pretoken: bytes) -> int:
        return len(self._model.tokenize(pretoken.decode("latin-1").translate(self._letters)))

    def special_spans(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the added tokens stand inside the texts."""
        found = []
        raw = data.tobytes()
        if self.special is not None and self.special.search(raw):
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                found += [(a + m.start(), a + m.end()) for m in self.special.finditer(raw[a:b])]
        spans = np.array(found, np.int64).reshape(-1, 2)
        return spans[:, 0], spans[:, 1]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pack(texts: list[bytes]) -> bytes:
    """Texts as one compressed value: their number, their size, their lengths, their bytes."""
    sizes = np.fromiter(map(len, texts), "<u4", len(texts)).tobytes()
    whole = sizes + b"".join(texts)
    return np.array([len(texts), len(whole)], "<i8").tobytes() + pa.compress(whole, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> list[bytes]:
    n, size = np.frombuffer(packed[:16], "<i8").tolist()
    whole = pa.decompress(packed[16:], decompressed_size=size, codec="zstd", asbytes=True)
    ends = np.cumsum(np.frombuffer(whole[: 4 * n], "<u4"), dtype=np.int64) + 4 * n
    return [whole[a:b] for a, b in zip([4 * n, *ends[:-1].tolist()], ends.tolist())]


def _small(numbers: np.ndarray) -> bytes:
    """Whole numbers, compressed, after their count."""
    return np.array([len(numbers)], "<i8").tobytes() + pa.compress(numbers.astype("<i4").tobytes(), codec="zstd", asbytes=True)


def _numbers(packed: bytes) -> np.ndarray:
    size = 4 * int(np.frombuffer(packed[:8], "<i8")[0])
    return np.frombuffer(pa.decompress(packed[8:], decompressed_size=size, codec="zstd", asbytes=True), "<i4")


def count_tokens(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None
) -> DataFrame:
    """Tokens of every whole text, as the tokenizers library gives them without added begin or end.

    Strings of added tokens inside a text count as one token each. Returns doc_id, n_bytes and n_tokens,
    a row for each input row, repeated ids included. A null text is empty (0 bytes, 0 tokens); a null
    id stays null; an empty table gives an empty result; other columns are not read. The vocabulary
    file must exist under ``vocabulary_path`` on every executor.

    Blocks of documents ask the shard that owns a pre-token's hash how many pieces it has. The shard
    splits each distinct pre-token once; the block adds frequency times pieces for each document.
    """
    blocks = into_blocks(docs, id_col, text_col, block_bytes)
    shards = blocks.n

    def read(table):
        known = vocabulary(vocabulary_path)
        data, bounds = utf8(table["text"])
        spans = known.special_spans(data, bounds)
        found = Pretokens(data, bounds, known.classes, cut=spans)
        return found, spans, np.searchsorted(shard_of(found.hashes, shards), np.arange(shards + 1))

    def ask(key, table):
        found, _, cuts = read(table)
        used, texts = np.flatnonzero(np.diff(cuts)), found.distinct()
        return pa.table({
            "shard": pa.array(used, pa.int32()),
            "block": pa.array([key[0].as_py()] * len(used), pa.int32()),
            "pretokens": pa.array([pack(texts[cuts[s] : cuts[s + 1]]) for s in used], pa.binary()),
        })

    def split(key, requests):
        known, pieces, answers = vocabulary(vocabulary_path), {}, []
        for packed in requests["pretokens"]:
            asked = unpack(packed.as_py())
            for text in asked:
                if text not in pieces:
                    pieces[text] = known.count(text)
            answers.append(_small(np.fromiter((pieces[t] for t in asked), np.int64, len(asked))))
        shard = pa.array([key[0].as_py()] * len(answers), pa.int32())
        return pa.table([requests["block"], shard, pa.array(answers, pa.binary())], names=["block", "shard", "pieces"])

    def add(key, table, replies):
        found, spans, cuts = read(table)
        by_shard = dict(zip(replies["shard"].to_pylist(), replies["pieces"].to_pylist()))
        pieces = np.concatenate([np.zeros(0, "<i4"), *(_numbers(by_shard[int(s)]) for s in np.flatnonzero(np.diff(cuts)))])
        n_docs = len(found.bounds) - 1
        pairs, frequency = np.unique(found.docs * max(1, len(pieces)) + found.which, return_counts=True)
        doc, pretoken = np.divmod(pairs, max(1, len(pieces)))
        tokens = np.zeros(n_docs, np.int64)
        np.add.at(tokens, doc, frequency * pieces[pretoken])
        np.add.at(tokens, np.searchsorted(found.bounds, spans[0], "right") - 1, 1)
        doc_ids = ids(table["doc_id"])
        return pa.table({
            "doc_id": pa.array(doc_ids, pa.int64(), mask=doc_ids == NO_ID),
            "n_bytes": pa.array(np.diff(found.bounds), pa.int64()),
            "n_tokens": pa.array(tokens, pa.int64()),
        })

    asked = blocks.grouped.applyInArrow(ask, "shard int, block int, pretokens binary")
    counted = asked.groupBy("shard").applyInArrow(split, "block int, shard int, pieces binary")
    return blocks.grouped.cogroup(counted.groupBy("block")).applyInArrow(add, RESULT)
