"""Conversation structure repair: the cheapest edits that make the turns alternate.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials. Turns are aligned by
Wagner-Fischer to the alternating string of every length that can be cheapest. What is left of such a
string depends on the number of its letters only, so one table over (turns left, letters left) serves
all lengths; a leading ``s``, which no edit can make, has a column of its own. An incumbent alignment
bounds the cost, and by Ukkonen's argument only cells near the diagonal can belong to a cheaper one.
Lengths of equal cost are traced back, and the least audit wins.

Conversations longer than PIECE turns are aligned piece by piece from the right: a piece ends in one of
the four states of the grammar, and the next piece says what each of them costs from there on.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns of a table, and bytes of a conversation's texts that stay in memory while it is read.
PIECE, SPOOL_BYTES = 256, 16 << 20
#: States of the grammar: nothing yet, after s, after u, after a.
EMPTY, SYSTEM, USER, WHOLE = range(4)
_FAR = 1 << 60
_SPACE = " \t\n\v\f\r"
_OTHER, _S, _U, _A = range(4)
_SHORT, _GONE = 4, 8
_INITIALS = {"s": _S, "u": _U, "a": _A}


# -- alignment ----------------------------------------------------------------------------------------


def _first_guess(codes: bytes, after: list[int], state: int) -> int:
    """Cost of one alignment from left to right: the incumbent."""
    cost = 0
    for code in codes:
        if code & _GONE:
            cost += DELETE
            continue
        cost += TRUNCATED if code & _SHORT else 0
        role = code & 3
        if state == EMPTY and role == _S:
            state = SYSTEM
        elif state == USER:
            cost += 0 if role == _A else REROLE if role != _U else INSERT
            state = USER if role == _U else WHOLE
        else:
            cost += 0 if role == _U else REROLE if role != _A else INSERT
            state = WHOLE if role == _A else USER
    return cost + after[state]


class _Table:
    """Costs of aligning one piece. ``after``: what each state costs behind it; None: nothing follows."""

    def __init__(self, codes: bytes, after: list[int] | None):
        self.codes, self.last = codes, after is None
        ends = [0, _FAR, _FAR, 0] if after is None else after
        n = len(codes)
        bounds = [0, 2 * INSERT, INSERT, 0] if after is None else after
        short = sum(1 for c in codes if c & _SHORT and not c & _GONE)
        gone = sum(1 for c in codes if c & _GONE)
        least = short * TRUNCATED + gone * DELETE + min(bounds)
        spare = max(_first_guess(codes, bounds, state) for state in range(4)) - least
        # A letter more costs an insertion; a turn less costs a deletion, of truncated turns instead of their fee.
        over, cheap = spare // INSERT, DELETE - TRUNCATED
        under = spare // cheap if spare <= short * cheap else short + (spare - short * cheap) // DELETE
        self.chain: list[dict[int, int]] = [{} for _ in range(n + 1)]
        self.system: list[dict[int, int]] = [{} for _ in range(n + 1)]  # s is still to come; key -1: only s comes
        if self.last:
            self.chain[n] = {j: INSERT * j for j in range(over + 2)}
        else:
            self.chain[n] = {0: ends[WHOLE], 1: ends[USER]}
        self.none = {EMPTY: ends[EMPTY] + n * DELETE, SYSTEM: ends[SYSTEM] + n * DELETE}
        left = 0
        for i in range(n - 1, -1, -1):
            code, below = codes[i], self.chain[i + 1]
            kept = not code & _GONE
            left += kept
            fee, role, row = TRUNCATED if code & _SHORT else 0, code & 3, self.chain[i]
            for j in range(max(0, left - under), left + over + 2):
                best = below.get(j, _FAR) + DELETE
                if j:
                    best = min(best, row.get(j - 1, _FAR) + INSERT)
                    if kept:
                        best = min(best, below.get(j - 1, _FAR) + fee + (0 if role == (_A if j & 1 else _U) else REROLE))
                if best < _FAR:
                    row[j] = best
            later = {j: c + DELETE for j, c in self.system[i + 1].items()}
            if kept and role == _S:
                starts = {j: c for j, c in below.items() if j and not j & 1}
                starts[-1] = ends[SYSTEM] + (n - 1 - i) * DELETE
                for j, cost in starts.items():
                    later[j] = min(later.get(j, _FAR), cost + fee)
            self.system[i] = later

    def _starts(self, state: int) -> Iterator[tuple[int, str, int]]:
        """Cost, kind and letters of every target that may start in a state."""
        low, odd = {USER: (1, 1), WHOLE: (0, 0)}.get(state, (2, 0))
        for j, cost in self.chain[0].items():
            if j >= low and j & 1 == odd:
                yield cost, "chain", j
        if state in self.none:
            yield self.none[state], "none", 0
        if state == EMPTY:
            for j, cost in self.system[0].items():
                yield cost, "system", j

    def least(self, state: int) -> int:
        return min((cost for cost, _, _ in self._starts(state)), default=_FAR)

    def audit(self, state: int) -> tuple[str, int]:
        """The least of the cheapest audits from a state, and the state behind it."""
        best = self.least(state)
        return min(self._trace(kind, j, state) for cost, kind, j in self._starts(state) if cost == best)

    def _trace(self, kind: str, j: int, state: int) -> tuple[str, int]:
        n, i, out = len(self.codes), 0, []
        while kind == "system":
            if self.system[i + 1].get(j, _FAR) + DELETE == self.system[i][j]:
                out.append("D")
            else:
                out.append("K")
                kind, state = ("none", SYSTEM) if j < 0 else ("chain", state)
            i += 1
        if kind == "none":
            return "".join(out) + "D" * (n - i), state
        while i < n or (self.last and j):
            here = self.chain[i][j]
            if i < n and self.chain[i + 1].get(j, _FAR) + DELETE == here:
                out.append("D")
                i += 1
                continue
            if j and self.chain[i].get(j - 1, _FAR) + INSERT == here:
                out.append("I")
            else:
                out.append("K" if self.codes[i] & 3 == (_A if j & 1 else _U) else "R")
                i += 1
            j -= 1
        return "".join(out), USER if j else WHOLE


def cheapest_audit(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation whose turns are coded: initial (other, s, u, a), + 4 truncated, + 8 to be deleted."""
    pieces = [codes[at : at + PIECE] for at in range(0, len(codes), PIECE)]
    if not pieces:
        return 0, ""
    afters: list[list[int] | None] = [None] * len(pieces)
    for k in range(len(pieces) - 1, 0, -1):
        table = _Table(pieces[k], afters[k])
        afters[k - 1] = [table.least(state) for state in range(4)]
    state, out, cost = EMPTY, [], 0
    for k, piece in enumerate(pieces):
        table = _Table(piece, afters[k])
        cost = table.least(EMPTY) if k == 0 else cost
        audit, state = table.audit(state)
        out.append(audit)
    return cost, "".join(out)


# -- conversations ------------------------------------------------------------------------------------


class _Conversation:
    """Reads the turns of one conversation in order; its texts go to a file beyond SPOOL_BYTES."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.seen = conv_id, bytearray(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.newest = self.before = None
        self.spool = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.newest:
            self.first = turn if self.first is None else self.first
            self.newest = turn
            self.turns += 1
        initial = _INITIALS.get(role[:1], _OTHER)
        if self.codes:
            self.illegal += (self.before, initial) not in ((_S, _U), (_U, _A), (_A, _U))
        self.before = initial
        raw_role, raw_text = role.encode(), text.encode()
        shown = text.strip(_SPACE)
        mark = hashlib.blake2b(struct.pack("<Q", len(raw_role)) + raw_role + raw_text, digest_size=16).digest()
        if not shown:
            self.blank += 1
            initial |= _GONE
        elif mark in self.seen:
            self.duplicate += 1
            initial |= _GONE
        elif shown[-1] not in ".!?":
            self.truncated += 1
            initial |= _SHORT
        self.seen.add(mark)
        self.codes.append(initial)
        self.spool.write(struct.pack("<QQ", len(raw_role), len(raw_text)) + raw_role + raw_text)

    def _repaired(self, audit: str) -> Iterator[bytes]:
        self.spool.seek(0)
        want, seen = b"user", False
        for edit in audit:
            role, text = want, b""
            if edit != "I":
                sizes = struct.unpack("<QQ", self.spool.read(16))
                own, text = self.spool.read(sizes[0]), self.spool.read(sizes[1])
                if edit == "D":
                    continue
                role = own if edit == "K" else want
            if seen or role[:1] != b"s":
                want = b"assistant" if role[:1] == b"u" else b"user"
            yield (b"\n" if seen else b"") + role + b":" + text
            seen = True

    def row(self, keep_text: bool) -> dict:
        cost, audit = cheapest_audit(bytes(self.codes))
        digest, parts = hashlib.sha256(), []
        for part in self._repaired(audit):
            digest.update(part)
            if keep_text:
                parts.append(part)
        self.spool.close()
        gaps = 0 if self.first is None else self.newest - self.first + 1 - self.turns
        return {
            "conv_id": self.conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": self.illegal, "cost": cost, "audit": audit, "repaired": b"".join(parts).decode() if keep_text else None,
            "repaired_sha256": digest.hexdigest(),
        }


def _repair(schema: pa.Schema, keep_text: bool):
    def run(batches):
        current, rows, size = None, [], 0
        for batch in batches:
            for conv, turn, role, text, there in zip(*(column.to_pylist() for column in batch.columns)):
                if current is None or current.conv_id != conv:
                    if current is not None:
                        rows.append(current.row(keep_text))
                        size += len(rows[-1]["audit"]) + len(rows[-1]["repaired"] or "") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                    current = _Conversation(conv)
                if there:
                    current.add(turn, role, text)
        if current is not None:
            rows.append(current.row(keep_text))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    there: Column | None = None, keep_text: bool = True,
) -> DataFrame:
    """One row per conversation: what is wrong with it, the cheapest edits, and the repaired turns.

    A conversation's turns are taken by turn number (nulls first), then by role and text, so rows that tie
    have one order. A turn's first fault counts: blank (nothing but white space), duplicate (role and text
    seen earlier in the conversation), truncated (does not end in ``.!?``). ``gaps`` counts turn numbers that
    are missing between the smallest and the largest; ``illegal`` neighbours whose initials are not su, ua or
    au. Edits: keep (0), rerole to user or assistant (3), delete (4, a must for blanks and duplicates), insert
    an empty user or assistant turn (3); a truncated turn that stays adds 3. ``audit`` holds the initials of
    the cheapest edits, the ASCII-least of equals; ``repaired`` has lines ``role:text``, and its hash is
    given too, so that ``keep_text=False`` never holds a conversation's texts in memory.

    A null role or text counts as one space; a null conversation id is a conversation of its own. Rows
    where ``there`` is not true only make their conversation appear; one without other rows gets zeros, an
    empty audit and the hash of nothing. Repeated rows are duplicates. An empty table gives an empty result;
    other columns are not read. Turns of a conversation are read by one task in order, as the hash of its
    whole text asks for; that task holds a byte and a 16-byte mark for each turn, and spools the texts.
    """
    conv = turns.schema[conv_col].dataType
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"), F.coalesce(F.lit(True) if there is None else there, F.lit(False)).alias("there"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    kind = pa.string() if conv.simpleString() == "string" else pa.int64()
    schema = pa.schema(
        [("conv_id", kind)] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        + [(c, pa.string()) for c in ("audit", "repaired", "repaired_sha256")]
    )
    fields = ", ".join(f"{c} long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    rows = rows if kind == pa.string() else rows.withColumn("conv_id", F.col("conv_id").cast("long"))
    out = "string" if kind == pa.string() else "long"
    return rows.mapInArrow(_repair(schema, keep_text), f"conv_id {out}, {fields}, audit string, repaired string, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``there`` of conversations with planted faults, picked by a checksum of ``conv_id:turn``.

    Of twenty parts one is dropped (``there`` is false), one loses its text, one its ``.!?``, one is repeated
    and one becomes a user turn. Nulls count as one space.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), blank)
    text = F.when(fault.isin(0, 1), "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(fault == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), blank))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fault != 0).alias("there"), F.when(fault == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")
