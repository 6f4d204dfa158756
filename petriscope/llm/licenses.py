"""License scans by a positional index of rare words.

Every key phrase of every template is indexed under its two words of highest
IDF, counted over all documents, each with its place in the phrase.  A file
looks up the words it shares with the index; where both postings of a phrase ask
for the same start (their relative position agrees), the phrase is verified word
by word.  A template holds where all its mandatory phrases stand about as far
from each other as in its text.  All of it happens in the row of the file: texts are
never shuffled, and no word that could start a phrase is left out.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.polygons import let, settled

#: Letters A to Z are lower-cased before; a word is of digits, letters and anything beyond ASCII.
WORD, BETWEEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words that may be more or fewer between two mandatory phrases than in the template, at least.
SLACK = 20
#: Phrases and labels that every scan looks for.
BASE = {"mit": "[under the mit license]", "apache-2": "[apache license version 2]", "cc-by-nc": "[cc by nc]"}
#: Notices of public licenses; mandatory phrases in brackets, the words between give their distance.
NOTICES = {
    "apache-2-notice": "[licensed under the apache license version 2 0] the license [you may not use this file except in compliance with the license]",
    "apache-2-named": "[under the apache license version 2 0]",
    "agpl-3": "[gnu affero general public license]",
    "bsd": "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met 1 [redistributions of source code must retain the above copyright notice]",
    "bsd-named": "[under the bsd license]",
    "cc-by": "[creative commons attribution]",
    "cc-by-nc-4": "[cc by nc 4 0]",
    "cc-by-sa": "[cc by sa]",
    "cc0": "[cc0 1 0 universal]",
    "gpl-2": "[gnu general public license version 2]",
    "gpl-3": "[gnu general public license version 3]",
    "gpl-notice": "[you can redistribute it and or modify it under the terms of the gnu general public license] as [published by the free software foundation]",
    "isc": "[permission to use copy modify and or distribute this software for any purpose] with or without fee is hereby granted",
    "lgpl": "[gnu lesser general public license]",
    "mit-released": "[released under the mit license]",
    "mit-text": "[permission is hereby granted free of charge to any person obtaining a copy] of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
    "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software [the software is provided as is without warranty of any kind]",
    "mpl-2": "[subject to the terms of the mozilla public license] v 2 0",
    "unlicense": "[this is free and unencumbered software released into the public domain]",
}


@dataclass(frozen=True)
class Template:
    """(place in the template, words) of each mandatory phrase.

    >>> Template.read("x", "[a b] c d [e]").phrases
    ((0, ('a', 'b')), (4, ('e',)))
    """

    label: str
    phrases: tuple[tuple[int, tuple[str, ...]], ...]

    @staticmethod
    def read(label: str, text: str) -> Template:
        out, at = [], 0
        for phrase, between in re.findall(r"\[([^\]]*)\]([^\[]*)", text):
            words = tuple(phrase.split())
            out.append((at, words))
            at += len(words) + len(between.split())
        return Template(label, tuple(out))


def templates(texts: dict[str, str]) -> list[Template]:
    return [Template.read(label, text) for label, text in texts.items()]


def words_of(text: Column) -> Column:
    """The words of a text as array<string>; null has none.

    Letters beyond ASCII may be lower-cased too, which no phrase has; the only
    two whose small form is or begins with an ASCII letter (the Kelvin sign, I with a dot) are
    put aside first.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    for letter, other in (("\u212a", "\u0138"), ("\u0130", "\u0131")):
        text = F.replace(text, F.lit(letter), F.lit(other))
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def document_frequencies(docs: DataFrame, text_col: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """(documents, documents that hold each word), over all of ``docs``; the vocabulary is that of the templates."""
    own = F.array_distinct(F.filter(words_of(F.col(f"`{text_col}`")), lambda w: w.isin(*vocabulary)))
    counts = docs.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()  # a row for each word of the templates at most
    found = {r["w"]: r["count"] for r in counts}
    return found.pop("", 0), found


def license_scan(docs: DataFrame, sought: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places, labels, score), one row for each row of ``docs``.

    ``places`` are all (label, phrase, start) where a mandatory phrase's words
    stand consecutively, by start; starts count words from 0.  ``labels``, distinct and
    sorted, are those of the templates all of whose phrases are there, each as
    far from the first as in the template, give or take ``SLACK`` words (up to
    twice that where it so falls).  ``score`` is the largest share of a
    template's IDF that its phrases in the text have.  Null and empty texts have
    no words, no labels and score 0; texts of any length are scanned whole;
    repeated rows, ids and null ids each keep their row.  Other columns don't
    matter, whatever their names.  An empty table gives no rows.
    """
    sought = sought or templates(BASE | NOTICES)
    phrases = list(dict.fromkeys(p for t in sought for _, p in t.phrases))
    n, df = document_frequencies(docs, text_col, sorted({w for p in phrases for w in p}))
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for p in phrases for w in p}
    rarest = {p: sorted(set(p), key=lambda w: (-idf[w], w))[:2] for p in phrases}
    rare = sorted({w for r in rarest.values() for w in r})

    rows = settled(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), {"words": words_of(F.col("text"))}).drop("text")
    rows = settled(rows, {"hits": F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda h: h["w"].isin(*rare))})

    def starts(phrase: tuple[str, ...]) -> Column:
        asked = [F.transform(F.filter("hits", lambda h: h["w"] == w), lambda h: h["at"] - phrase.index(w)) for w in rarest[phrase]]  # noqa: B023
        both = reduce(F.array_intersect, asked)
        return F.filter(F.array_distinct(both), lambda s: (s >= 0) & (F.slice("words", s + 1, F.lit(len(phrase))) == F.array(*map(F.lit, phrase))))

    none = F.array().cast("array<struct<phrase:int,start:int>>")
    every = F.concat(*(F.transform(starts(p), lambda s: F.struct(F.lit(k).alias("phrase"), s.alias("start"))) for k, p in enumerate(phrases)))  # noqa: B023
    rows = settled(rows.withColumn("n_words", F.size("words")), {"found": F.when(F.size("hits") > 0, every).otherwise(none)}).drop("words", "hits")

    def near(at: int, phrase: tuple[str, ...], wide: bool) -> Column:
        """Where the template would start, in steps of the slack."""
        of = F.filter("found", lambda f: f["phrase"] == phrases.index(phrase))
        step = F.transform(of, lambda f: F.floor((f["start"] - at) / SLACK))
        return F.flatten(F.transform(step, lambda s: F.array(s - 1, s, s + 1))) if wide else step

    def holds(t: Template) -> Column:
        return F.size(reduce(F.array_intersect, (near(at, p, wide=k == 0 and len(t.phrases) > 1) for k, (at, p) in enumerate(t.phrases)))) > 0

    def share(t: Template) -> Column:
        weight = {p: sum(idf[w] for w in p) for _, p in t.phrases}
        there = [F.when(F.exists("found", lambda f: f["phrase"] == phrases.index(p)), w / sum(weight.values())).otherwise(0.0) for p, w in weight.items()]  # noqa: B023
        return reduce(lambda a, b: a + b, there)

    some = F.size("found") > 0
    labels = F.when(some, F.array_sort(F.array_compact(F.array(*(F.when(holds(t), F.lit(t.label)) for t in sought))))).otherwise(F.array().cast("array<string>"))
    score = F.when(some, F.least(F.array_max(F.array(*map(share, sought))), F.lit(1.0))).otherwise(0.0)
    named = F.array(*(F.array(*(F.struct(F.lit(t.label).alias("label"), F.lit(" ".join(p)).alias("phrase")) for t in sought if p in [q for _, q in t.phrases])) for p in phrases))
    places = let(named, lambda names: F.flatten(F.transform("found", lambda f: F.transform(F.get(names, f["phrase"]), lambda x: F.struct(f["start"].alias("start"), x["label"].alias("label"), x["phrase"].alias("phrase"))))))
    return rows.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.when(some, F.array_sort(places)).otherwise(F.array().cast("array<struct<start:int,label:string,phrase:string>>")).alias("places"), labels.alias("labels"), score.alias("score"))
