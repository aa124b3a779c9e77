"""Language identification by rank order of character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Answer for texts without letters.
UNKNOWN = "und"
#: More languages than this are refused: their profiles are sent to every executor.
MAX_LANGUAGES = 5_000
_SHIFT = 21
_LETTERS = np.full(0x110000, 2, np.uint8)


def _letters(points: np.ndarray) -> np.ndarray:
    """Which code points are letters; each is asked once."""
    found = _LETTERS[points]
    if (found == 2).any():
        for point in np.unique(points[found == 2]).tolist():
            _LETTERS[point] = chr(point).isalpha()
        found = _LETTERS[points]
    return found == 1


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams (1 to 3 letters, word borders included) of a text and their counts.

    An n-gram is a number of 21 bits for each character, 0 for a border.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.int64)
    letter = _letters(points)
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.where(letter, points, 0)
    points = np.concatenate([[0], points[(points > 0) | np.append(True, points[:-1] > 0)], [0]])
    pairs = points[:-1] << _SHIFT | points[1:]
    triples = pairs[:-1] << _SHIFT | points[2:]
    pairs = pairs[(points[:-1] > 0) | (points[1:] > 0)]
    return np.unique(np.concatenate([points[points > 0], pairs, triples[points[1:-1] > 0]]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties to the smaller number."""
    return grams[np.lexsort((grams, -counts))[:size]]


@dataclass
class Profiles:
    """For each language (in order) its n-grams by rank."""

    languages: list[str]
    grams: list[np.ndarray]
    size: int

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams in order, and the rank each has per language (``size`` if it has none)."""
        known = np.unique(np.concatenate([*self.grams, np.zeros(0, np.int64)]))
        ranks = np.full((len(known) + 1, len(self.languages)), self.size, np.int64)
        for i, grams in enumerate(self.grams):
            ranks[np.searchsorted(known, grams), i] = np.arange(len(grams))
        return known, ranks

    def scorer(self):
        """text -> language, score."""
        known, ranks = self.table()

        def predict(text: str | None) -> tuple[str, float]:
            grams, counts = ngram_counts(text or "")
            if not len(grams) or not self.languages:
                return UNKNOWN, 0.0
            own = ranked(grams, counts, self.size)
            at = np.searchsorted(known, own)
            at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] != own)] = len(known)
            there = ranks[at]
            apart = np.where(there == self.size, self.size, np.abs(there - np.arange(len(own))[:, None])).sum(axis=0)
            best = int(np.argmin(apart))
            return self.languages[best], 1 - float(apart[best]) / (self.size * len(own))

        return predict


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves this remainder. A null id is held out: it was never learnt."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(True))


def learn(docs: DataFrame, size: int = 300, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of all documents that have a language and are not held out.

    Tasks add up the n-grams of their texts for each language before Spark does; of each language the
    ``size`` most frequent come to the driver. Texts without letters teach nothing.
    """
    rows = docs.filter(~held_out(id_col)).filter(F.col(lang_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        for batch in batches:
            waiting: dict[str, list] = {}
            held = 0
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                grams, counts = ngram_counts(text.as_py() or "")
                waiting.setdefault(lang, []).append((grams, counts))
                held += len(grams)
                if held > 1 << 20:
                    yield from _added(waiting)
                    waiting, held = {}, 0
            yield from _added(waiting)

    counted = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).select("lang", "rank", "gram")
    n = rows.select("lang").distinct().count()
    if n > MAX_LANGUAGES:
        raise ValueError(f"{n} languages; profiles are kept for {MAX_LANGUAGES} at most")
    found: dict[str, list] = {}
    for row in sorted(top.collect()):
        found.setdefault(row.lang, []).append(row.gram)
    return Profiles(list(found), [np.array(g, np.int64) for g in found.values()], size)


def _added(waiting: dict[str, list]):
    for lang, parts in waiting.items():
        grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        total = np.bincount(place, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)
        langs = pa.array([lang]).take(pa.array(np.zeros(len(grams), np.int32)))
        yield pa.RecordBatch.from_arrays([langs, pa.array(grams), pa.array(total)], ["lang", "gram", "n"])


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """The documents with lang_pred and score added; no shuffle.

    Every whole text is compared by the distance between its n-gram ranks and each profile's; a missing
    n-gram costs the profile's length. The score is one minus distance over the largest possible one;
    ties go to the language that sorts first. A null text or one without letters, and every text if
    nothing was learnt, is ``und`` with score 0. Columns of the two names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        predict = shared.value.scorer()
        for batch in batches:
            found = [predict(t.as_py()) for t in batch[text_col].cast(pa.string())]
            columns = [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
