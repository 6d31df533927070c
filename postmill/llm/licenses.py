"""Licence scan by a positional rare-token index (operator 3, DataFrame functions only).

Two kinds of templates are looked up. Names are short phrases ("apache license"): the index holds the positions
of their rarest words (highest inverse document frequency over all documents), a hit says where the name would
start, the other indexed words must stand at their distance, and the name is verified word by word. All indexed
words of a name stand in it, so no place is missed.

Whole licence texts are found altered too. The index holds the positions of their rarest words. Of those that a
file has, the ones with the highest inverse document frequency vote, each occurrence for the places where the
licence would start; votes are gathered in two overlapping grids of WINDOW words, and a place is a candidate
where different words with most of the weight agree. A candidate counts if every mandatory phrase of the licence
stands within SLACK words of where it should, word by word. The same rare words scattered elsewhere don't agree, and
a phrase alone is no licence.

Everything happens within a file's own row: no join, no shuffle, and per file n log n in its hits.

Defined cases: a null text is an empty one (no words, score 0); repeated rows are scanned alike; an
empty table gives no rows; columns other than key and text play no part; overlapping places all count;
ties in frequency go to the earlier word; very long texts are scanned whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.expr import let

#: Anything but ASCII letters, digits and characters beyond ASCII parts words.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Template(NamedTuple):
    label: str
    phrase: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.phrase.split()


#: Fixed values of the contract.
BASE_TEMPLATES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
#: Labels of the method's own: variants and versions, and opening words of licence texts.
OWN_TEMPLATES = (
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("apache-2", "apache license version 2 0"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("mpl", "mozilla public license"),
    Template("bsd", "bsd license"),
    Template("isc", "isc license"),
)
TEMPLATES = BASE_TEMPLATES + OWN_TEMPLATES
#: Rare words of a template that the index holds.
INDEXED = 3


class Licence(NamedTuple):
    """A licence text, or its notice, as words, with the phrases that it must hold."""

    label: str
    text: str
    mandatory: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()


#: Wording of public licences and their notices, in words.
LICENCES = (
    Licence(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in"
        " the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the"
        " software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this"
        " permission notice shall be included in all copies or substantial portions of the software",
        ("permission is hereby granted free of charge", "substantial portions of the software"),
    ),
    Licence(
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary"
        " form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided"
        " with the distribution",
        ("redistribution and use in source and binary forms", "materials provided with the distribution"),
    ),
    Licence(
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright"
        " notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software",
        ("with or without fee is hereby granted", "the author disclaims all warranties"),
    ),
    Licence(
        "apache-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the"
        " license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is"
        " distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing"
        " permissions and limitations under the license",
        ("except in compliance with the license", "unless required by applicable law"),
    ),
    Licence(
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software"
        " foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without"
        " any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        ("under the terms of the gnu general public license", "in the hope that it will be useful"),
    ),
    Licence(
        "unlicense-text",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"
        " either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("unencumbered software released into the public domain",),
    ),
    Licence(
        "mpl-notice",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain"
        " one at http mozilla org mpl 2 0",
        ("subject to the terms of the mozilla public license",),
    ),
)
#: Rare words of a licence that the index holds, and those of a file that vote.
RARE, VOTING = 24, 16
#: Words that votes for one place may lie apart, words that a phrase may be off its place, and the share of
#: the voting words' weight that must agree.
WINDOW, SLACK, AGREE = 40, 60, 0.65


def file_words(text: Column) -> Column:
    """Lower-cased words of a file; the ends of the split are empty where the text starts or ends between words."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def licence_idf(docs: DataFrame, templates: Sequence[Template | Licence] = (*TEMPLATES, *LICENCES), text: str = "text") -> dict[str, float]:
    """Inverse document frequency of every licence word over all documents. One row for each licence
    word reaches the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    mine = F.array_intersect(file_words(F.col(text)), F.array(*[F.lit(w) for w in vocabulary]))
    # A row for no word (null) in every file keeps the number of files in the same pass.
    counts = docs.select(F.explode(F.concat(mine, F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    df = {r["w"]: r["n"] for r in counts}
    files = df.get("", 0)
    return {w: math.log((files + 1) / (df.get(w, 0) + 1)) + 1e-9 for w in vocabulary}


class Posting(NamedTuple):
    template: int
    position: int
    word: str


def rare_postings(templates: Sequence[Template], idf: dict[str, float], indexed: int = INDEXED) -> list[Posting]:
    """The index: positions of each template's rarest words; ties go to the earlier word."""
    out = []
    for number, t in enumerate(templates):
        order = sorted(range(len(t.words)), key=lambda i: (-idf[t.words[i]], i))[:indexed]
        out += [Posting(number, i, t.words[i]) for i in sorted(order)]
    return out


def rare_words(licence: Licence, idf: dict[str, float]) -> dict[str, list[int]]:
    """Positions of a licence's rarest words, the rarest word first; ties go to the earlier word."""
    positions: dict[str, list[int]] = {}
    for i, w in enumerate(licence.words):
        positions.setdefault(w, []).append(i)
    order = sorted(positions, key=lambda w: (-idf[w], positions[w][0]))[:RARE]
    return {w: positions[w] for w in order}


def whole_licence(words: Column, hits: Column, licence: Licence, idf: dict[str, float]) -> Column:
    """Array of the places (label, start) of an altered or unaltered licence text in a file."""
    index = rare_words(licence, idf)
    order = F.array(*[F.lit(w) for w in index])
    postings = F.create_map(*[x for w, at in index.items() for x in (F.lit(w), F.array(*[F.lit(p) for p in at]))])
    weight = F.create_map(*[x for w in index for x in (F.lit(w), F.lit(idf[w]))])
    need = AGREE * sum(sorted((idf[w] for w in index), reverse=True)[:VOTING])

    def cells(mine: Column) -> Column:
        present = F.transform(mine, lambda h: h["w"])
        voting = F.slice(F.filter(order, lambda w: F.array_contains(present, w)), 1, VOTING)

        def vote(h: Column, p: Column) -> Column:
            start = h["i"] - p
            return F.array(*[
                F.struct(F.lit(g).alias("g"), F.floor((start + g * (WINDOW // 2)) / WINDOW).cast("int").alias("cell"), h["w"].alias("w")) for g in (0, 1)
            ])

        votes = let(voting, lambda v: F.transform(
            F.filter(mine, lambda h: F.array_contains(v, h["w"])), lambda h: F.flatten(F.transform(F.try_element_at(postings, h["w"]), lambda p: vote(h, p)))
        ))
        return F.array_sort(F.array_distinct(F.flatten(votes)))

    def agreed(sorted_cells: Column) -> Column:
        """Cells whose words have the weight, in one walk over the sorted votes."""
        none = F.array().cast("array<struct<g:int,cell:int>>")
        start = F.struct(F.lit(-1).alias("g"), F.lit(0).alias("cell"), F.lit(0.0).alias("sum"), none.alias("found"))

        def closed(a: Column) -> Column:
            return F.when(a["sum"] >= need, F.concat(a["found"], F.array(F.struct(a["g"].alias("g"), a["cell"].alias("cell"))))).otherwise(a["found"])

        def step(a: Column, c: Column) -> Column:
            gained = F.try_element_at(weight, c["w"])
            same = (a["g"] == c["g"]) & (a["cell"] == c["cell"])
            return F.struct(
                c["g"].alias("g"), c["cell"].alias("cell"), F.when(same, a["sum"] + gained).otherwise(gained).alias("sum"),
                F.when(same, a["found"]).otherwise(closed(a)).alias("found"),
            )

        return F.aggregate(sorted_cells, start, step, closed)

    wanted = [(p.split(), _offset(licence.words, p.split())) for p in licence.mandatory]

    def standing(c: Column) -> Column:
        first = c["cell"] * WINDOW - c["g"] * (WINDOW // 2) - SLACK

        def places(phrase: list[str], offset: int) -> Column:
            near = F.sequence(F.greatest(first + offset, F.lit(0)), F.greatest(first + offset, F.lit(0)) + WINDOW + 2 * SLACK)
            literal = F.array(*[F.lit(w) for w in phrase])
            return F.filter(near, lambda s: F.slice(words, s + 1, F.lit(len(phrase))) == literal)

        found = F.get(places(*wanted[0]), F.lit(0)) - wanted[0][1]
        for phrase, offset in wanted[1:]:
            found = F.when(F.size(places(phrase, offset)) > 0, found)
        return F.when(found.isNotNull(), F.struct(F.lit(licence.label).alias("label"), F.greatest(found, F.lit(0)).cast("long").alias("start")))

    mine = F.filter(hits, lambda h: h["w"].isin(list(index)))
    enough = F.size(F.array_distinct(F.transform(mine, lambda h: h["w"]))) >= 3
    found = F.array_distinct(F.filter(F.transform(agreed(cells(mine)), standing), lambda f: f.isNotNull()))
    return F.when(enough, found).otherwise(_none())


def _offset(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def scan(text: Column, templates: Sequence[Template], idf: dict[str, float], indexed: int = INDEXED, licences: Sequence[Licence] = LICENCES) -> Column:
    """Struct: n_words, places (template, start) of verified templates in template order, licences (label, start)
    of whole licence texts, and evidence: the largest share of a template's indexed weight that the file has."""
    postings = rare_postings(templates, idf, indexed)
    lookup = sorted({p.word for p in postings})
    rare = sorted({w for x in licences for w in rare_words(x, idf)})

    def places(words: Column, hits: Column, number: int) -> Column:
        own = [p for p in postings if p.template == number]
        wanted = templates[number].words
        # intersect postings by relative position: starts of the first word, then each other word must stand at its distance
        rarest = max(own, key=lambda p: (idf[p.word], -p.position))
        starts = F.transform(F.filter(hits, lambda h: h["w"] == rarest.word), lambda h: h["i"] - rarest.position)
        for p in own:
            if p is not rarest:
                starts = F.filter(starts, (lambda p: lambda s: F.coalesce(_at(words, s + p.position) == p.word, F.lit(False)))(p))
        # verify the mandatory phrase word by word
        phrase = F.array(*[F.lit(w) for w in wanted])
        verified = F.filter(starts, lambda s: (s >= 0) & (F.slice(words, F.greatest(s, F.lit(0)) + 1, F.lit(len(wanted))) == phrase))
        return F.transform(verified, lambda s: F.struct(F.lit(number).alias("template"), s.alias("start")))

    def share(hits: Column, number: int) -> Column:
        """Weight of the template's indexed words that the file has at all, of their whole weight, halved: evidence short of a phrase."""
        own = [p for p in postings if p.template == number]
        whole = sum(idf[p.word] for p in own)
        total = F.lit(0.0)
        for p in own:
            total = total + F.when(F.exists(hits, (lambda w: lambda h: h["w"] == w)(p.word)), F.lit(idf[p.word] / whole)).otherwise(0.0)
        return total / 2

    def whole(words: Column, hits: Column) -> Column:
        mine = F.filter(hits, lambda h: h["w"].isin(rare))
        # few files have several rare words of licences
        several = F.size(F.array_distinct(F.transform(mine, lambda h: h["w"]))) >= 3
        texts = F.concat(*[whole_licence(words, mine, x, idf) for x in licences]) if licences else _none()
        return F.when(several, texts).otherwise(_none())

    def found(words: Column) -> Column:
        marked = F.transform(words, lambda w, i: F.when(w.isin(sorted({*lookup, *rare})), F.struct(w.alias("w"), i.alias("i"))))
        return let(
            F.filter(marked, lambda h: h.isNotNull()),
            lambda hits: F.struct(
                whole(words, hits).alias("licences"),
                F.size(words).cast("long").alias("n_words"),
                F.when(F.size(hits) == 0, F.array().cast("array<struct<template:int,start:int>>"))
                .otherwise(F.concat(*[places(words, hits, n) for n in range(len(templates))])).alias("places"),
                F.when(F.size(hits) == 0, 0.0).otherwise(F.greatest(*[share(hits, n) for n in range(len(templates))])).alias("evidence"),
            ),
        )

    return let(file_words(text), found)


def _none() -> Column:
    return F.array().cast("array<struct<label:string,start:bigint>>")


def _at(words: Column, i: Column) -> Column:
    return F.get(words, i)


def scan_licences(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, key: str = "doc_id", text: str = "text", indexed: int = INDEXED) -> DataFrame:
    """One row per file: key, n_words, places (array of label, base, start, words), licences (array of label, start),
    score. Score is 1 for a file with a verified place or licence, else half the best share of a template's
    rare words that the file has."""
    idf = licence_idf(docs, (*templates, *LICENCES), text)
    found = docs.select(F.col(key), scan(F.col(text), templates, idf, indexed).alias("_found"))
    table = F.array(*[F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(len(t.words)).alias("words")) for t in templates])
    return found.select(
        key,
        F.col("_found.n_words").alias("n_words"),
        F.transform(
            "_found.places",
            lambda p: F.struct(
                F.get(table, p["template"])["label"].alias("label"), F.get(table, p["template"])["base"].alias("base"),
                p["start"].cast("long").alias("start"), F.get(table, p["template"])["words"].alias("words"),
            ),
        ).alias("places"),
        F.col("_found.licences").alias("licences"),
        F.when(F.size("_found.places") + F.size("_found.licences") > 0, 1.0).otherwise(F.col("_found.evidence")).alias("score"),
    )


def label_list(*found: Column) -> Column:
    """Distinct labels, sorted, joined by commas."""
    labels = F.concat(*[F.transform(f, lambda p: p["label"]) for f in found])
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
