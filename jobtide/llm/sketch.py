"""A count-min sketch that is never in one place.

Every block hashes its keys to the cells of a few rows and sends, for each shard of a row, the sorted
list of its cells: its own sketch, in sparse form. The shard adds the sketches of all blocks and tells
each block which of its cells hold two or more. A key whose cells all do may be repeated; a key with
a cell below two is certainly not. Counts only ever overestimate, so no repeated key is lost, and the
number of cells decides how many single keys pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from jobtide.llm.arrays import pack_sorted, unpack_bits, unpack_sorted

REQUEST = "shard int, block int, cells binary"
REPLY = "block int, shard int, heavy binary"


@dataclass(frozen=True)
class Sketch:
    """``rows`` rows of 2**bits counters, each row cut into ``shards`` equal ranges."""

    rows: int
    bits: int
    shards: int

    @classmethod
    def sized(cls, keys: int, rows: int, shards: int, cells_per_key: int = 4) -> Sketch:
        """For about ``keys`` keys; an estimate will do, it only sets the share of false positives."""
        bits = max(12, math.ceil(math.log2(max(1, keys) * cells_per_key)))
        return cls(rows, min(bits, 60), min(shards, 1 << 12) if bits < 20 else shards)

    def cells(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def bases(self) -> np.ndarray:
        return np.array([-((-s << self.bits) // self.shards) for s in range(self.shards + 1)], np.uint64)

    def _own(self, hashes: np.ndarray) -> np.ndarray:
        """The block's cells in order, a cell twice if two or more of its keys share it."""
        cells = np.sort(self.cells(hashes))
        keep = np.ones(len(cells), bool)
        keep[2:] = cells[2:] != cells[:-2]
        return cells[keep]

    def requests(self, block: int, hashes: list[np.ndarray]) -> pa.RecordBatch:
        """``hashes``: an independent hash of every key for each row."""
        shard, packed = [], []
        bases = self.bases()
        for row, own in enumerate(map(self._own, hashes)):
            cuts = np.searchsorted(own, bases)
            for s in np.flatnonzero(np.diff(cuts)):
                shard.append(row * self.shards + int(s))
                packed.append(pack_sorted(own[cuts[s] : cuts[s + 1]] - bases[s]))
        columns = [pa.array(shard, pa.int32()), pa.array([block] * len(shard), pa.int32()), pa.array(packed, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["shard", "block", "cells"])

    def answers(self, shard: int, requests: pa.Table) -> pa.Table:
        """Add the sketches of all blocks, counting to two, and answer each."""
        counts = np.zeros((1 << self.bits) // self.shards + 2, np.uint8)
        asked = []
        for cells in requests["cells"]:
            cells = unpack_sorted(cells.as_py())
            new = np.ones(len(cells), bool)
            new[1:] = cells[1:] != cells[:-1]
            for some in (cells[new], cells[~new]):
                counts[some] = np.minimum(counts[some] + 1, 2)
            asked.append(cells[new])
        heavy = [np.packbits(counts[cells] > 1).tobytes() for cells in asked]
        shards = pa.array([shard] * len(asked), pa.int32())
        return pa.table([requests["block"], shards, pa.array(heavy, pa.binary())], names=["block", "shard", "heavy"])

    def repeated(self, hashes: list[np.ndarray], shards: list[int], heavy: list[bytes]) -> np.ndarray:
        """Which of the keys may be repeated, from all answers to this block."""
        by_shard, bases = dict(zip(shards, heavy)), self.bases()
        found = np.ones(len(hashes[0]), bool)
        for row, values in enumerate(hashes):
            own = np.sort(self.cells(values))
            new = np.ones(len(own), bool)
            new[1:] = own[1:] != own[:-1]
            own = own[new]
            cuts, many = np.searchsorted(own, bases), np.zeros(len(own), bool)
            for s in np.flatnonzero(np.diff(cuts)):
                bits = by_shard[row * self.shards + int(s)]
                many[cuts[s] : cuts[s + 1]] = unpack_bits(bits, int(cuts[s + 1] - cuts[s]))
            many, cells = own[many], self.cells(values)
            if not len(many):
                return np.zeros(len(found), bool)
            at = np.searchsorted(many, cells)
            found &= many[np.minimum(at, len(many) - 1)] == cells
        return found
