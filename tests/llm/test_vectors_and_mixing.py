"""Exact top-k against brute force; mixing against its targets; the pipeline on a small corpus."""

import math
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jobtide.llm import mixing, topk

SF = "/root/testdata/sf0.001"


def brute(rows, k, every):
    usable = [(i, [math.floor(x * 256) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(usable):
        if i % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, c)), j) for b, (j, c) in enumerate(usable) if b != a and len(c) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 512), (40, 3)])
def test_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(topk, "QUERY_ROWS", blocks[1])
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(16)]) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(12)]  # ties
    rows += [(400, None), (401, [float("nan")] * 16), (402, [None] + [0.1] * 15), (None, [0.1] * 16), (404, [float("inf")] * 16)]
    rows += [(500, [0.5, -0.25, 1.0]), (501, [0.5, 0.5, 0.5]), (502, [0.0, 0.0, 0.0])]  # another length
    rows += [(50, rows[50][1]), (20, rows[21][1])]  # repeated ids
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, block string, rank int").repartition(4)
    got = topk.exact_top_k(frame, k=5, every=10).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, 5, 10)
    assert topk.exact_top_k(frame.limit(0)).collect() == []


@pytest.mark.parametrize("block", [8192, 12])
def test_the_own_row_takes_no_place(spark, monkeypatch, block):
    """With k = 1 the own row, often its own best, must leave the place to another row of its block."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(16)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (1, 2):
        got = topk.exact_top_k(frame, k=k, every=5).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, k, 5)


def test_cutoff_leaves_most_entries(spark, monkeypatch):
    """Phase two keeps less than a quarter of all entries of the given vectors, or the lists would be pointless."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    shares, plain = [], topk._cutoffs

    def counted(gathered, vectors, k):
        cuts = plain(gathered, vectors, k)
        values = {r["row"]: np.array(r["v"]) for r in vectors.collect()}
        parts = np.array_split(np.arange(len(next(iter(values.values())))), topk.LISTS)
        for cut in cuts.collect():
            for part, low in zip(parts, cut["lows"]):
                gains = np.array([int(values[cut["query"]][part] @ v[part]) - low for row, v in values.items() if row != cut["query"]])
                assert (gains >= 0).all()
                shares.append(topk._reached(gains, cut["bound"]).mean())
        return cuts

    monkeypatch.setattr(topk, "_cutoffs", counted)
    topk.exact_top_k(rows).collect()
    assert shares and sum(shares) / len(shares) < 0.25


# -- mixing -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        lang = rng.choice(["en", "en", "de", None])
        rows.append((i, " ".join(["word"] * rng.randint(1, 200)), lang, source, i, 1.0))
    rows += [(3000, None, "en", "a", None, None), (3001, "", None, "zero", 0, 0.0), (None, "one two", "en", "a", 1, 1.0), (5, "again again", "de", "b", 1, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ratio long, tokens double")


def test_raked_weights_meet_the_targets(corpus):
    targets = {"source": {"hot": 0.2, "a": 0.5, "b": 0.3}, "lang": {"en": 0.6, "de": 0.4}}
    out = mixing.calibrate(corpus, targets, keep_share=0.3).collect()
    assert len(out) == corpus.count()
    total = sum(r.n_tokens for r in out)
    for side, wish in targets.items():
        got = defaultdict(float)
        for r in out:
            got[r[side]] += r.n_tokens * r.ratio
        for value, share in wish.items():
            assert got[value] / total == pytest.approx(share, abs=1e-6)
        assert all(got[v] == pytest.approx(0, abs=1e-9) for v in got if v not in wish)
    for r in out:
        assert 0 <= r.probability <= 1 and (r.probability > 0 or not r.sampled)
        assert r.probability * r.sample_weight == pytest.approx(r.ratio, abs=1e-9)
    drawn = [r for r in out if r.sampled]
    weighed = sum(r.n_tokens * r.sample_weight for r in drawn if r.source == "a") / sum(r.n_tokens * r.sample_weight for r in drawn)
    assert weighed == pytest.approx(0.5, abs=0.08)


def test_the_draw_is_stable_and_whole(corpus):
    first = mixing.sample(corpus)
    again = mixing.sample(corpus.repartition(7))
    assert first.columns == corpus.columns and sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    assert 0.3 * corpus.count() < first.count() < 0.7 * corpus.count()
    assert mixing.sample(corpus.limit(0)).collect() == []


def test_many_cells_take_the_other_way(corpus, monkeypatch):
    few = sorted((r.document.doc_id or -1, round(r.ratio, 9)) for r in mixing.calibrate(corpus).collect())
    monkeypatch.setattr(mixing, "FEW_CELLS", 0)
    monkeypatch.setattr(mixing, "ROUNDS", 12)
    assert sorted((r.document.doc_id or -1, round(r.ratio, 9)) for r in mixing.calibrate(corpus).collect()) == few


def drawn_shares(rows, side, weigh):
    got = defaultdict(float)
    for r in rows:
        got[r[side]] += weigh(r)
    return {v: x / sum(got.values()) for v, x in got.items()}


def test_drawn_rows_meet_targets_above_the_bound(spark):
    """Small values that targets want up: no cell is cut, its surplus goes to the cells of its value with room."""
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        source = "small" if i % 10 == 0 else rng.choice(["a", "b"])
        lang = rng.choice(["en", "en", "en", "de"]) if source != "small" else rng.choice(["en"] * 9 + ["de"])
        rows.append((i, " ".join(["word"] * 100), lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"small": 0.18, "a": 0.41, "b": 0.41}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"listing": 0.0, "article": 1.0}}
    out = mixing.calibrate(docs, targets, bounded=True).collect()
    assert max(r.ratio for r in mixing.calibrate(docs, targets).collect()) > 2.2
    drawn = mixing.sample(docs, targets=targets).collect()
    for side in ("source", "lang"):
        expected = drawn_shares(out, side, lambda r: r.n_tokens * r.probability)
        given_ = drawn_shares(drawn, side, lambda r: 100)
        for value, share in targets[side].items():
            assert expected[value] == pytest.approx(share, abs=1e-4) and given_[value] == pytest.approx(share, abs=0.03)
    assert sum(r.probability for r in out) == pytest.approx(3000, rel=1e-4) and max(r.probability for r in out) <= 1
    assert all(r.reached for r in mixing.shares(docs, targets).collect())
    beyond = {**targets, "source": {"small": 0.5, "a": 0.3, "b": 0.2}}  # twice what all of its documents give
    told = {(r.side, r.value): r for r in mixing.shares(docs, beyond).collect()}
    assert [told["source", v].reached for v in ("small", "a", "b")] == [False] * 3 and told["lang", "de"].reached
    assert told["source", "small"].expected == pytest.approx(0.2, abs=1e-4)
    assert told["source", "a"].expected == pytest.approx(0.8 * 0.6, abs=1e-4)


def test_scripts_without_spaces_have_weight(spark):
    rows = [(1, "漢字かな" * 100, "ja", "s"), (2, "ไทย" * 40, "th", "s"), (3, "two words", "en", "s"), (4, None, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weight = mixing.token_weight()
    got = {r.doc_id: (r.n, r.form) for r in docs.select("doc_id", weight.alias("n"), mixing.form("text", weight).alias("form")).collect()}
    assert got == {1: (401, "article"), 2: (121, "article"), 3: (2, "note"), 4: (0, "note")}
    share = {r.value: r.share for r in mixing.shares(docs).collect() if r.side == "lang"}
    assert share["ja"] == pytest.approx(401 / 524) and share["en"] == pytest.approx(2 / 524)


def test_main_path_is_native(corpus):
    plan = mixing.calibrate(corpus)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


# -- pipeline -----------------------------------------------------------------------------------------

given = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are missing")


def test_stages_are_the_five():
    assert [f for _, f in corpus_pipeline.STAGES] == [
        corpus_pipeline.drop_toxic, corpus_pipeline.keep_one_of_near_copies, corpus_pipeline.remove_repeated_passages,
        corpus_pipeline.mix_sources, corpus_pipeline.encode,
    ]


@given
def test_stages_take_effect(spark, tmp_path):
    import base64

    import public_tokenizers
    import tiktoken

    from jobtide.llm.neardup import near_duplicates

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, before, SF).write.parquet(path)
        after = spark.read.parquet(path)
        if name != "byte_bpe":
            assert after.columns == columns and after.dtypes == docs.dtypes
        if name == "near_dedup":
            assert near_duplicates(after).filter("not kept").count() == 0
            groups = near_duplicates(before).select("component_id").distinct().count()
            assert after.count() == groups
        if name == "suffix_dedup":
            assert after.count() == before.count() and after.filter("n_chars <> length(text)").count() == 0
        if name == "mix_sources":
            assert 0 < after.count() < before.count()
            assert after.exceptAll(before).count() == 0
        if name == "byte_bpe":
            texts = {r.doc_id: r.text for r in before.collect()}
            rows = after.collect()
            assert len(rows) == len(texts)
            assert all(list(r.ids) == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows)
        before = after
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, whole.collect())) == sorted(map(str, before.collect()))


def test_one_of_repeated_ids_stays(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words here"), (2, "a b c d e f g"), (None, "a b c d e f g"), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, "").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 3] and sum(r.doc_id is None for r in kept) == 1


def test_passages_of_the_pipeline_take_each_text_along_once(spark, monkeypatch):
    """The text is not among the carried columns too; the other columns, null texts and counts come through."""
    from jobtide.llm import suffixes

    seen, into_blocks = [], suffixes.into_blocks

    def blocks(*args):
        seen.append(into_blocks(*args))
        return seen[-1]

    monkeypatch.setattr(suffixes, "into_blocks", blocks)
    line = "a line of more than fifty bytes that two of the documents hold"
    rows = [(1, line, "en", -1), (2, "x" + line + "é", None, -1), (3, None, "fr", None), (None, "short", "de", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed string, n_chars long")
    out = corpus_pipeline.remove_repeated_passages(spark, docs, "")
    assert "text" not in seen[0].rows.schema["rest"].dataType["others"].dataType.names
    assert out.dtypes == docs.dtypes
    want = [(1, line, "en", -1), (2, "xé", None, 2), (3, None, "fr", None), (None, "short", "de", 9)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_pipeline_on_odd_documents(spark, make, texts, tmp_path):
    labels = spark.createDataFrame([(10 + i, i % 2) for i in range(20)], "doc_id long, toxic int")
    docs = make(texts).withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "none/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
