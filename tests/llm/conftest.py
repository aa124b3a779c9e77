import pytest


@pytest.fixture(scope="session")
def make(spark):
    """Documents with further columns whose names the operators use themselves."""

    def frame(rows, parts=3):
        full = [(i, text, 7, "x", 1.5, True, b"k", i) for i, text in rows]
        schema = "doc_id long, text string, block int, shard string, score double, kept boolean, key binary, rest long"
        return spark.createDataFrame(full, schema).repartition(parts)

    return frame


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and very long texts, copies, near copies, shared passages, repeated rows, other scripts."""
    import random

    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdeghiklmnorstuw", k=rng.randint(2, 9))) for _ in range(400)]

    def prose(n):
        out = rng.choices(vocabulary, k=n)
        return "".join(w + rng.choice([" ", " ", " ", ", ", ".\n", "\t"]) for w in out)

    base, passage, long = prose(120), prose(60), prose(9000)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four"), (6, "One TWO three four")]
    rows += [(10 + i, prose(rng.randint(5, 200))) for i in range(20)]
    rows += [(40, base), (41, base), (42, base + " tail word"), (43, base.replace(base.split()[60], "changed")), (44, base.upper())]
    rows += [(50 + i, prose(40) + passage + prose(40)) for i in range(6)]
    rows += [(60, long), (61, "x y z " * 3000), (62, "x y z " * 200), (63, "été ça 漢字 日本 🙂 naïve " * 8), (64, "été ça 漢字 日本 🙂 naïve " * 7 + "fin")]
    rows += [(70, passage[1:]), (71, passage + "é" * 40), (71, passage + "é" * 40), (72, "e" * 60 + "é" * 60), (73, "é" * 70)]
    rows += [(None, base), (None, prose(30)), (80, prose(5) + "<|endoftext|>" + prose(3)), (81, "it's we'll 's ''s \r\n 12 ½ ab12")]
    return rows
