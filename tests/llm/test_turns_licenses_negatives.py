"""Conversation repair, licence scans and hard negatives against plain versions of their contracts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobtide.llm import licenses, negatives, queries, turns

# -- conversation repair ------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, audit string, cost double, there string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1.5, "no") for r in rows], TURNS).repartition(3)


def cheapest(codes):
    """Least (cost, audit) over the states of the grammar, one turn after the other."""

    def close(states):
        states = dict(states)
        for _ in range(3):
            for s, (c, a) in list(states.items()):
                to = 3 if s == 2 else 2
                states[to] = min(states.get(to, (10**9, "")), (c + 3, a + "I"))
        return states

    states = {0: (0, "")}
    for initial, short, gone in codes:
        new = {}

        def put(state, value):
            new[state] = min(new.get(state, (10**9, "")), value)

        for s, (c, a) in close(states).items():
            put(s, (c + 4, a + "D"))
            if gone:
                continue
            c += 3 if short else 0
            if s == 0 and initial == "s":
                put(1, (c, a + "K"))
            to, want = (3, "a") if s == 2 else (2, "u")
            put(to, (c, a + "K") if initial == want else (c + 3, a + "R"))
        states = new
    ended = close(states)
    return min(ended[s] for s in (0, 3) if s in ended)


def plain_repair(rows):
    """The contract for rows (conv, turn, role, text, there): one dict per conversation."""
    out = []
    for conv in {r[0] for r in rows}:
        mine = [(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows if r[0] == conv and r[4]]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, codes, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            kind = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if kind:
                faults[kind] += 1
            codes.append((role[:1], kind == "truncated", kind in ("blank", "duplicate")))
        cost, audit = cheapest(codes)
        i, lines, expect = 0, [], "user"
        for edit in audit:
            role, text = expect, ""
            if edit != "I":
                own, text = mine[i][1:]
                i += 1
                if edit == "D":
                    continue
                role = own if edit == "K" else expect
            if lines or role[:1] != "s":
                expect = "assistant" if role[:1] == "u" else "user"
            lines.append(f"{role}:{text}")
        numbers = [t for t, _, _ in mine if t is not None]
        initials = [c[0] for c in codes]
        out.append({
            "conv_id": conv, "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, **faults, "cost": cost, "audit": audit,
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "repaired": "\n".join(lines),
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        })
    return sorted(out, key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0))


def odd_conversations():
    rng = random.Random(5)
    rows = [(None, None, None, None), (None, 3, "user", "Null id."), (1, 0, None, "no role"), (2, 0, "user", None), (3, 0, "", "Empty role.")]
    rows += [(4, 0, "system", "Be kind."), (5, 0, "system", "Be kind."), (5, 1, "user", "Hi."), (5, 2, "user", "Hi."), (5, 3, "tool", "No end")]
    rows += [(6, 0, "user", "é" * 200_000 + "."), (6, 1, "assistant", "Long text " * 50_000 + "!"), (7, 1, "assistant", "x."), (7, 1, "user", "y."), (7, None, "user", "z.")]
    rows += [(8, 2, "user", "same.")] * 3 + [(9, -5, "user", "\t\n"), (9, 70, "assistant", " "), (10, 0, "S", "Upper."), (11, 0, "uncle", "By initial.")]
    for conv in range(20, 90):
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "agent"])
            rows.append((conv, turn + rng.choice([0, 0, 1]), role, rng.choice(["a.", "b!", "c", "  ", "d?", "e. ", "f,"]) * rng.randint(1, 2)))
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}" + rng.choice([".", ".", ".", ""])) for t in range(700) if rng.random() < 0.9]  # several pieces
    return rows


@pytest.mark.parametrize("piece", [256, 1, 3])
def test_alignment(monkeypatch, piece):
    monkeypatch.setattr(turns, "PIECE", piece)
    rng, initials = random.Random(piece), "xsua"
    for n in list(range(10)) * 30 + [60, 90]:
        codes = [(rng.choice([0, 1, 2, 3, 2, 3]), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]
        packed = bytes(c + 4 * short + 8 * gone for c, short, gone in codes)
        assert turns.cheapest_audit(packed) == cheapest([(initials[c], short, gone) for c, short, gone in codes])


def test_repair(spark, monkeypatch):
    monkeypatch.setattr(turns, "SPOOL_BYTES", 1000)
    rows = odd_conversations()
    want = plain_repair([(*r, True) for r in rows])
    got = turns.repair(frame(spark, rows)).collect()
    assert sorted((r.asDict() for r in got), key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0)) == want
    short = turns.repair(frame(spark, rows), keep_text=False).collect()
    assert {r.repaired for r in short} == {None} and sorted(r.repaired_sha256 for r in short) == sorted(r["repaired_sha256"] for r in want)
    assert turns.repair(frame(spark, []).limit(0)).collect() == []


def test_damage(spark, tmp_path):
    rows = odd_conversations()
    harmed = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        harmed += [(conv, turn, "user" if fault == 4 else role, text, fault != 0)] * (2 if fault == 3 else 1)
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [r.asDict() for r in queries.op11_turn_repair(spark, str(tmp_path)).collect()]
    want = [{k: v for k, v in r.items() if k != "repaired"} for r in plain_repair(harmed)]
    assert sorted(got, key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0)) == want


# -- licences -----------------------------------------------------------------------------------------


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_scan(texts):
    """Every template tried at every word."""
    frequencies = {w: sum(w in set(words_of(t)) for t in texts) for x in licenses.TEMPLATES for w in x.words}
    out = []
    for text in texts:
        words, found = words_of(text), []
        for template in licenses.TEMPLATES:
            rare, phrases = licenses.rare_words(template, frequencies), [(template.position(p), p.split()) for p in template.phrases]
            for start in range(len(words)):
                at = lambda q: words[start + q] if start + q < len(words) else None  # noqa: E731, B023
                if all(at(q) == w for w, q in rare) and all(words[start + q : start + q + len(p)] == p for q, p in phrases):
                    found.append((template, start, sum(at(q) == w for q, w in enumerate(template.words)) / len(template.words)))
        starts = [s for t, s, _ in found if t.base]
        join = lambda x: ",".join(sorted(set(x)))
        out.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), join(t.label for t, _, _ in found if t.base),
                    join(t.label for t, _, _ in found), max((s for _, _, s in found), default=0.0)))
    return out


def test_licenses(spark, make, texts):
    rng = random.Random(6)
    filler = lambda n: " ".join(rng.choices(["mit", "der", "license", "by", "the", "cc", "word", "été", "general"], k=n))
    more = ["Licensed under the Apache License, Version 2.0.", "(C) MIT\nLicense; mit-license MIT_LICENSE", "cc by cc by cc-by-nc 4.0", "Licensed under CC BY-NC 4.0.",
            "GNU General\x00Public License", "the GNU GeneralÉ Public License", "apachelicense", "Apache License", "license apache", "ＭＩＴ license"]
    more += [" ".join(t.words) for t in licenses.OWN] + [" ".join(w if i % 7 else "changed" for i, w in enumerate(t.words)) for t in licenses.OWN]
    more += [filler(rng.randint(1, 60)) + " " + rng.choice(licenses.TEMPLATES).text.upper() + ". " + filler(5) for _ in range(60)]
    more += [filler(30_000) + " apache license " + filler(20_000) + " mit license"]
    rows = texts + [(1000 + i, t) for i, t in enumerate(more)] + [(1000, more[0]), (None, more[1])]
    got = licenses.summarize(licenses.scan(make(rows))).collect()
    want = [(i, *rest) for (i, _), rest in zip(rows, plain_scan([t for _, t in rows]))]
    order = lambda r: (r[0] is None, r[0] or 0, str(r))
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert {"apache-2.0", "cc-by-nc-4.0", "bsd", "unlicense"} <= {x for r in got for x in r.labels.split(",")}
    assert licenses.scan(make([]).limit(0)).collect() == []


def test_scan_is_native(make):
    plan = licenses.summarize(licenses.scan(make([(1, "mit license")])))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and not re.search("hashpartitioning|SinglePartition", plan)


# -- hard negatives -----------------------------------------------------------------------------------


def plain_negatives(rows, every, least=30, most=90, k=5, n=10):
    usable = [(math.inf if i is None else i, label, [math.floor(x * 256) for x in v]) for i, label, v in rows
              if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (anchor, label, q) in enumerate(usable):
        if anchor == math.inf or anchor % every:
            continue
        met = [(-sum(x * y for x, y in zip(q, c)), i, l) for b, (i, l, c) in enumerate(usable) if b != a and len(c) == len(q)]
        for s, i, _ in sorted(x for x in met if x[2] == label)[:k]:
            fits = sorted(x for x in met if x[2] != label and least * -s <= 100 * -x[0] <= most * -s)[:n]
            known = lambda x: None if x == math.inf else x
            out += [(anchor, known(i), r + 1, known(j), -s, -t) for r, (t, j, _) in enumerate(fits)]
    return out


@pytest.mark.parametrize("blocks", [(4096, 256, 8), (40, 3, 3), (1, 1, 1)])
def test_hard_negatives(spark, monkeypatch, blocks):
    for name, size in zip(("BLOCK_ROWS", "ANCHOR_ROWS", "STEP"), blocks):
        monkeypatch.setattr(negatives, name, size)
    rng = random.Random(8)
    many = 120 if blocks[0] == 1 else 400
    centres = [[rng.gauss(0, 0.4) for _ in range(12)] for _ in range(4)]
    rows = [(i, i % 4 if rng.random() < 0.8 else rng.randrange(5), [c + rng.gauss(0, 0.3) for c in centres[i % 4]]) for i in range(many)]
    rows += [(many + i, i % 3, rows[20][2]) for i in range(25)]  # ties, in several labels
    rows += [(900, None, rows[0][2]), (900, 1, None), (910, 1, [float("nan")] * 12), (920, 1, [None] + [0.1] * 11), (930, 1, [float("-inf")] * 12)]
    rows += [(None, 0, rows[0][2]), (None, 1, rows[0][2]), (940, 0, [0.0] * 12), (950, 2, [0.5, 1.0, 0.25]), (960, 2, [0.5, 0.5, 0.5]), (970, 1, [0.25, 0.5, 0.25])]
    rows += [(40, 1, rows[41][2]), (20, rows[20][1], rows[20][2]), (980, 7, rows[60][2]), (990, 3, [])]
    schema = "vec_id long, label int, embedding array<double>, row string, block int"
    given = spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(4)
    got = negatives.hard_negatives(given, every=20)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert set(got.columns) == set(names)
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.select(*names).collect()), key=order) == sorted(plain_negatives(rows, 20), key=order)
    assert negatives.hard_negatives(given.limit(0)).collect() == []


def test_bitmap_shrinks():
    """Columns read in the order of the anchor's magnitudes close the bounds before the last ones."""
    rng = np.random.default_rng(3)
    columns = rng.integers(-40, 40, (32, 2000))
    anchor = np.where(np.arange(32) < 4, 200, 1) * rng.choice([-1, 1], 32)
    pack = lambda x: np.ascontiguousarray(x, "<i8").tobytes()
    ids = np.arange(2000)
    tile = negatives._Tile({"dim": 32, "id": pack(ids), "row": pack(ids), "label": pack(ids % 2), "v": pack(columns),
                            "a_id": pack([5000]), "a_row": pack([5000]), "a_label": pack([0]), "a_v": pack(anchor)})
    sizes = []

    def still(scores, low, high):
        left = scores + high >= np.sort(scores)[-5] + low
        sizes.append(int(left.sum()))
        return left

    alive, scores = tile.scan(tile.anchors[0], ids, still)
    whole = anchor @ columns
    assert sizes[0] < 100 and (scores == whole[alive]).all() and set(np.argsort(-whole)[:5]) <= set(alive)
