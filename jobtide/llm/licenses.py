"""Licence scans by a positional index of rare words. Spark SQL functions only.

A licence is known by templates: passages of its notice or text, with key phrases that must be there.
Of each template the words that fewest documents hold (the highest IDF, counted over all documents) are
indexed with their positions. A file's occurrences of an indexed word, shifted by its position in the
template, say where the template would start; the shifts of all indexed words of a template are
intersected, and what is left is verified by its key phrases and scored by the words in their place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Indexed words of a template.
RARE = 3
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def position(self, phrase: str) -> int:
        want = phrase.split()
        return next(i for i in range(len(self.words)) if self.words[i : i + len(want)] == want)


# Phrases that stand for a licence by themselves.
BASE = (
    Template("gpl", "gnu general public license", ("gnu general public license",), base=True),
    Template("apache", "apache license", ("apache license",), base=True),
    Template("cc-by", "cc by", ("cc by",), base=True),
    Template("mit", "mit license", ("mit license",), base=True),
)
# Notices and opening passages of public licences, as words.
OWN = (
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template(
        "gpl-or-later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
        " as published by the free software foundation",
        ("free software", "gnu general public license"),
    ),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("except in compliance with the license",),
    ),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 international", ("attribution noncommercial 4 0",)),
    Template("cc-by-4.0", "creative commons attribution 4 0 international", ("attribution 4 0",)),
    Template("cc0", "cc0 1 0 universal", ("cc0 1 0",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted", "this software and associated documentation files"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("source and binary forms", "following conditions are met"),
    ),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)
TEMPLATES = (*BASE, *OWN)


def plain_words(text_col: str = "text") -> Column:
    """Lower-cased words with one space between them; null and empty texts give an empty string."""
    lower = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.trim(F.regexp_replace(lower, _BREAKS, " "))


def document_frequencies(docs: DataFrame, words: Sequence[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each of the given words stands. One row for each word reaches the driver."""
    held = F.array_intersect(F.split(plain_words(text_col), " "), F.split(F.lit(" ".join(words)), " "))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").count()
    return {word: 0 for word in words} | {r["word"]: r["count"] for r in counts.collect()}


def rare_words(template: Template, frequencies: dict[str, int], n: int = RARE) -> list[tuple[str, int]]:
    """The template's words of highest IDF, the least held first (ties by word), and where each stands first."""
    words = sorted(set(template.words), key=lambda w: (frequencies[w], w))[:n]
    return [(word, template.words.index(word)) for word in words]


def _same(words: Column, start: Column, at: int, phrase: str) -> Column:
    want = phrase.split()
    return F.slice(words, start + (at + 1), len(want)) == F.split(F.lit(phrase), " ")


def _starts(places: Column, words: Column, template: Template, index: list[tuple[str, int]]) -> Column:
    """Where all indexed words of a template agree on its start, and its key phrases stand in their place."""

    def shifts(word: str, at: int) -> Column:
        return F.transform(F.filter(places, lambda x: x["word"] == word), lambda x: x["at"] - at)

    lists = [shifts(word, at) for word, at in index]
    starts = lists[0]
    for more in lists[1:]:
        starts = F.array_intersect(starts, more)

    def verified(start: Column) -> Column:
        out = start >= 0
        for phrase in template.phrases:
            out = out & _same(words, start, template.position(phrase), phrase)
        return out

    return F.filter(starts, verified)


def _place(number: int, template: Template):
    """From a start to a place with the share of the template's words that stand where they should."""
    own = template.words

    def place(start: Column) -> Column:
        hits = F.zip_with(F.slice("words", start + 1, len(own)), F.split(F.lit(template.text), " "), lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))
        share = F.aggregate(hits, F.lit(0), lambda total, x: total + x) / F.lit(float(len(own)))
        return F.struct(
            F.lit(number).alias("template"), F.lit(template.label).alias("label"), F.lit(template.base).alias("base"),
            start.cast("long").alias("start"), share.alias("share"),
        )

    return place


def scan(
    docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE
) -> DataFrame:
    """Each document's places where a licence template stands.

    Returns doc_id, n_words and ``places``: an array of template (number), label, base, start (word, from 0)
    and share (of the template's words that stand in their place; words may differ outside the indexed
    ones and the key phrases), in order of template and start. Words are lower-cased ASCII letters, digits
    and characters beyond ASCII. Null and empty texts have no words and no places. Texts are read whole, and
    twice: once for the frequencies of template words, once for the scan. Each row is answered for itself, so
    repeated rows and null ids stay as they are; an empty table gives an empty result; other columns are
    not read. Nothing is shuffled but one count for each template word.
    """
    vocabulary = sorted({word for t in templates for word in t.words})
    frequencies = document_frequencies(docs, vocabulary, text_col)
    index = [rare_words(t, frequencies, rare) for t in templates]
    # A document without the rarest word of a template does not hold the template.
    lead = "|".join(sorted({words[0][0] for words in index}))
    indexed = sorted({word for words in index for word, _ in words})
    rows = docs.select(F.col(id_col).alias("doc_id"), plain_words(text_col).alias("plain"))
    rows = rows.select(
        "doc_id", F.when(F.col("plain") == "", 0).otherwise(F.length("plain") - F.length(F.translate("plain", " ", "")) + 1).cast("long").alias("n_words"),
        F.when(F.col("plain").rlike(f"(?:^| )(?:{lead})(?: |$)"), F.split("plain", " ")).otherwise(F.array().cast("array<string>")).alias("words"),
    )
    numbered = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    rows = rows.withColumn("held", F.filter(numbered, lambda x: x["word"].isin(indexed)))
    found = [
        F.transform(F.array_sort(_starts(F.col("held"), F.col("words"), t, words)), _place(number, t))
        for number, (t, words) in enumerate(zip(templates, index))
    ]
    places = F.when(F.size("held") > 0, F.concat(*found))
    empty = F.array().cast("array<struct<template:int,label:string,base:boolean,start:bigint,share:double>>")
    return rows.select("doc_id", "n_words", F.coalesce(places, empty).alias("places"))


def summarize(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, the count, first and last start of base phrases, labels, and the best share as score (0 without a place)."""
    base = F.filter("places", lambda p: p["base"])
    text = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["start"])
    score = F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        text(base).alias("base_labels"), text("places").alias("labels"), score.alias("score"),
    )
