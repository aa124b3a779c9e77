"""Language, toxicity and line quality: held-out accuracy, exact counts, odd rows."""

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from jobtide.llm import langid, linecrf, toxicity

SF = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are missing")


def remainder(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


# -- language -----------------------------------------------------------------------------------------


def brute_counts(text):
    out = Counter()
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    points = lambda s: sum(ord(c) << (21 * (len(s) - 1 - i)) if c != " " else 0 for i, c in enumerate(s))
    for w in words:
        out.update(points(c) for c in w)
    line = " " + " ".join(words) + " "
    for n in (2, 3):
        grams = (line[i : i + n] for i in range(len(line) - n + 1))
        out.update(points(g) for g in grams if g.strip() and (n < 3 or g[1] != " "))
    return out if words else Counter()


def test_ngram_counts():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices("abcÄé ß.,\n 12", k=rng.randint(0, 40)))
        grams, counts = langid.ngram_counts(text)
        assert dict(zip(grams.tolist(), counts.tolist())) == dict(brute_counts(text)), text


def test_out_of_place_distance():
    a, b = np.array([5, 6, 7]), np.array([7, 9, 5])
    profiles = langid.Profiles(["a", "b"], [a, b], 3)
    known, ranks = profiles.table()
    assert known.tolist() == [5, 6, 7, 9] and ranks.tolist() == [[0, 2], [1, 3], [2, 0], [3, 1], [3, 3]]
    assert langid.ranked(np.array([9, 4, 2]), np.array([1, 3, 3]), 2).tolist() == [2, 4]
    assert profiles.scorer()("12 . !") == ("und", 0.0) and profiles.scorer()(None) == ("und", 0.0)
    assert profiles.scorer()("xyz")[0] == "a"  # no known n-gram: all equal, the first wins


@given
def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.identify(docs, langid.learn(docs)).withColumn("held", langid.held_out()).collect()
    assert len(out) == docs.count()
    assert all(r.held == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in out)
    judged = [r for r in out if r.held and r.lang and len(r.text) > 30]
    assert sum(r.lang == r.lang_pred for r in judged) >= 0.98 * len(judged) > 100


def brute_top(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def test_languages_against_a_plain_version(spark, texts):
    """Profiles, answers and scores anew, over repeated rows, very long texts and every other odd text."""
    size = 40
    rows = [(i, t, ["de", "en", None, "fr"][k % 4], k) for k, (i, t) in enumerate(texts)] + [(5, texts[4][1], "en", 0)] * 3
    profiles = {}
    for i, text, lang, _ in rows:
        if lang and i is not None and remainder(i, 4) != 2:
            profiles.setdefault(lang, Counter()).update(brute_counts(text or ""))
    profiles = {lang: {g: r for r, g in enumerate(brute_top(c, size))} for lang, c in sorted(profiles.items()) if c}

    def wanted(text):
        own = brute_top(brute_counts(text or ""), size)
        if not own:
            return "und", 0.0
        apart = [(sum(abs(p[g] - r) if g in p else size for r, g in enumerate(own)), lang) for lang, p in profiles.items()]
        return min(apart)[1], 1 - min(apart)[0] / (size * len(own))

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long").repartition(3)
    got = langid.identify(docs, langid.learn(docs, size)).collect()
    plain = {text: wanted(text) for _, text, _, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        lang, score = plain[r.text]
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score)), r.text


def test_languages_odd_rows(spark):
    rows = [(1, "der die das und", "de", 0.5), (3, "the and of to", "en", 0.5), (4, None, "de", None), (5, "1 2 3", None, 1.0), (None, "the of", None, None), (5, "und das", "xx", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    out = langid.identify(docs, langid.learn(docs)).collect()
    assert len(out) == 6 and {r.lang_pred for r in out if r.text in (None, "1 2 3")} == {"und"}
    nothing = docs.limit(0)
    assert langid.identify(nothing, langid.learn(nothing)).collect() == []
    assert langid.identify(docs, langid.learn(nothing)).first().lang_pred == "und"


# -- toxicity -----------------------------------------------------------------------------------------


def test_subwords():
    assert toxicity.ngrams("ab", (3, 4)) == ["<ab", "ab>", "<ab>"] and toxicity.ngrams("", (3,)) == ["<>"]
    assert len(toxicity.subwords("word", (3,), 8)) == 4


def test_unseen_misspellings_share_subwords():
    rng = random.Random(2)
    neutral = ["".join(rng.choices("aeioulmnrst", k=5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(400):
        words = rng.choices(neutral, k=40)
        if i % 4 == 0:
            words[rng.randrange(40)] = rng.choice(["grumbkin", "grumbkins", "vilegrumb"])
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts, np.array(labels), toxicity.Training(prior=50))
    score = model.scorer()
    clean = " ".join(rng.choices(neutral, k=40))
    assert score(clean + " grumbkinz") > 0.5 > score(clean) and score(clean + " gruumbkin") > score(clean)


def test_one_label_or_none():
    assert toxicity.fit(["a b"], np.array([1])).scorer()("x") > 0.99
    assert toxicity.fit([], np.array([], int)).scorer()(None) < 1e-6


@given
def test_toxicity_of_held_out_documents(spark):
    sf = SF if not os.path.isdir("/root/testdata/sf0.1") else "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(docs, toxicity.train(docs, labels)).withColumn("held", toxicity.held_out())
    judged = out.join(labels, "doc_id").filter("held and toxic is not null").select("toxic", "predicted").collect()
    right = sum(r.toxic == r.predicted for r in judged)
    assert right >= 0.95 * len(judged)
    caught = [r.predicted for r in judged if r.toxic == 1]
    assert sum(caught) >= 0.8 * len(caught)


def test_toxicity_odd_rows(spark):
    rows = [(1, None, 3.0), (1, "", None), (None, "word " * 50000, 1.0), (2, "a", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").withColumnRenamed("score", "predicted")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0))).collect() == []


# -- lines --------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    mark = [False] * len(words)
    for i in range(len(words) - 7):
        if runs[tuple(words[i : i + 8])] > 1:
            mark[i : i + 8] = [True] * 8
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, sum(mark), n < 20 or 100 * sum(mark) > 30 * n


def test_line_counts(spark, make, texts):
    rows = texts + [(200, "a b\n\na b\n a b\na b \n\n" * 3), (201, "#*$%&|<>\n\x85x\x0by\x0cz\rw"), (202, "w1 w2 w3 w4 w5 w6 w7 w8 " * 2 + "x " * 8)]
    field = linecrf.Field(np.zeros((linecrf.FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
    out = linecrf.judge(make(rows), field).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out), key=str)
    assert got == sorted(((i, *counts(t)) for i, t in rows), key=str)
    assert all(r.kept == (not r.base_failed) for r in out)  # without weights every line is content
    assert linecrf.judge(make(rows).limit(0), field).collect() == []


def test_viterbi_finds_the_best_labels():
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(40):
        field = linecrf.Field(rng.normal(size=(linecrf.FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        lines = linecrf.Lines(np.frombuffer(b"a b\nc d e\nf", np.uint8), np.array([0, 11]))
        lines.features = rng.normal(size=(3, linecrf.FEATURES))
        scores = lines.features @ field.emit

        def total(y):
            return field.begin[y[0]] + sum(scores[i, k] for i, k in enumerate(y)) + sum(field.move[a, b] for a, b in zip(y, y[1:]))

        assert field.decode(lines).tolist() == list(max(product((0, 1), repeat=3), key=total))


def test_slopes_are_those_of_the_likelihood():
    from itertools import product

    rng = np.random.default_rng(4)
    x = rng.normal(size=(2, 3, linecrf.FEATURES))
    on = np.array([[True, True, True], [True, True, False]])
    y = np.array([[1, 0, 1], [0, 0, 0]])
    weights = [rng.normal(size=(linecrf.FEATURES, 2)) * 0.3, rng.normal(size=(2, 2)), rng.normal(size=2)]

    def loss(ws):
        emit, move, begin = ws
        out = 0.0
        for i in range(2):
            n = on[i].sum()
            scores = x[i] @ emit
            path = lambda p: begin[p[0]] + sum(scores[t, k] for t, k in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))
            out += np.log(sum(np.exp(path(p)) for p in product((0, 1), repeat=n))) - path(y[i][:n])
        return out

    slopes = linecrf._slopes(x, on, y, *weights)
    for k, w in enumerate(weights):
        for place in list(np.ndindex(w.shape))[:8]:
            up, down = [v.copy() for v in weights], [v.copy() for v in weights]
            up[k][place] += 1e-5
            down[k][place] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - slopes[k][place]) < 1e-4


def test_kept_against_every_labelling(spark, make):
    """The verdict from the best of all labellings of a document's lines, by a field with lines of both kinds."""
    from itertools import product

    rng = random.Random(9)
    good = ["the small river runs past the old mill and the town below it.", "we walked along the bank until the evening came and went home."]
    junk = ["| MENU | HOME |", "Click here !!!", "CONTACT $$$", "Copyright 2020 # all", "the small river runs past the old mill and the town below it."]
    texts = [" \n".join(rng.choice(good if rng.random() < p else junk) for _ in range(rng.randint(1, 8))) for p in [0.1, 0.5, 0.9] * 40]
    field = linecrf.fit(*zip(*[(ls.features, [1 - int(a) for a in ls.again]) for ls in (linecrf.Lines(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t in texts)]))
    assert np.abs(field.emit).sum() > 0
    shares = set()
    for row in linecrf.judge(make(list(enumerate(texts))), field).collect():
        text = texts[row.doc_id].encode()
        lines = linecrf.Lines(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        scores = lines.features @ field.emit

        def total(y):
            return field.begin[y[0]] + sum(scores[i, k] for i, k in enumerate(y)) + sum(field.move[a, b] for a, b in zip(y, y[1:]))

        best = max(product((0, 1), repeat=len(scores)), key=total)
        share = sum(w for w, k in zip(lines.words.tolist(), best) if k) / lines.words.sum()
        shares.add(share in (0, 1))
        assert row.content_share == pytest.approx(share) and row.kept == (not counts(texts[row.doc_id])[-1] and share >= 0.5)
    assert shares == {True, False}  # some documents have lines of both kinds


@given
def test_some_documents_have_lines_of_both_kinds(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    shares = [r.content_share for r in linecrf.judge(docs, linecrf.train(docs, labels)).collect()]
    assert any(0 < s < 1 for s in shares)


@given
def test_quality_of_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    half = labels.filter("doc_id % 2 = 0")
    out = linecrf.judge(docs, linecrf.train(docs, half)).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = [r for r in out if r.quality == 1 and not r.base_failed]
    bad = [r for r in out if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(r.kept for r in bad) <= 0.2 * len(bad)
