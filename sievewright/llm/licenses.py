"""License scan by diagonal voting.

One pass over the texts finds the base phrases and the positions of all word
k-grams; Spark joins the k-grams' hashes to the templates' positions, counts
votes by diagonal (document position less template position) and merges
neighbouring diagonals into spans.  A span is verified by aligning the words
around its votes with the template: the best local alignment (a match counts 1,
a word changed, put in or left out -1) must hold ``MIN_COVERAGE`` of the
template's words (more of a short one, and all words that only its label has),
with ``MIN_IDENTITY`` of its places equal.  Templates compete:
of alignments that overlap, the one with the highest sum wins, so that a word
like "Lesser" or "NonCommercial" decides between notices that are alike.

k-grams that no template has are left out before the join by a table of the
templates' hashes; the join would drop them too.

Defined results: a null text counts as empty; texts without words have null
positions, no label and score 0; repeated rows (same id) are scanned each on
its own; of equal sums the better covered, then the smaller label wins; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewright.llm._common import stored
from sievewright.llm._words import Words, shingles, slices, words_of

K = 3
#: Diagonals at most so far apart belong to one span (words inserted or left out).
SLACK = 2
#: Shares of a template's words and of an alignment's places that verify a span; a template of fewer words than ``SHORT`` needs more.
MIN_COVERAGE, MIN_IDENTITY = 0.5, 0.8
SHORT, SHORT_COVERAGE = 20, 0.8
#: Words before and behind a vote that the alignment sees.
REACH = 10
#: A span needs a vote for each so many words of its template.
WORDS_A_VOTE = 8

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening words of public license notices, and their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
)


def template_positions(templates=TEMPLATES, k: int = K) -> list[tuple[int, int, int, int]]:
    """Rows ``template, votes (needed), place, hash`` of all k-grams of all templates."""
    rows = []
    for number, (_, text) in enumerate(templates):
        w = words_of(text)
        at, grams = shingles(w, k)
        rows += [(number, max(1, len(w.hash) // WORDS_A_VOTE), int(p), int(g.astype(np.int64))) for p, g in zip(at, grams, strict=True)]
    return rows


def _scanner(phrases: dict[str, str], known: np.ndarray, k: int):
    needles = [(words_of(phrase).hash, label) for phrase, label in phrases.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << 16, bool)
        bitmap[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                w, n = Words(data, offsets), hi - lo
                count = np.zeros(n, np.int64)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                found: list[set[str]] = [set() for _ in range(n)]
                for needle, label in needles:
                    size = len(w.hash) - len(needle) + 1
                    if size <= 0:
                        continue
                    hit = np.flatnonzero(w.hash[:size] == needle[0])
                    for j in range(1, len(needle)):
                        hit = hit[w.hash[hit + j] == needle[j]]
                    hit = hit[w.doc[hit] == w.doc[hit + len(needle) - 1]]
                    row, place = w.doc[hit], hit - w.first[w.doc[hit]]
                    np.add.at(count, row, 1)
                    np.minimum.at(first, row, place)
                    np.maximum.at(last, row, place)
                    for r in np.unique(row):
                        found[r].add(label)
                at, grams = shingles(w, k)
                maybe = np.flatnonzero(bitmap[(grams & np.uint64(0xFFFF)).astype(np.int64)])
                maybe = maybe[np.isin(grams[maybe], known)]
                row = w.doc[at[maybe]]
                ends = np.searchsorted(row, np.arange(n + 1))
                votes = pa.StructArray.from_arrays([pa.array(at[maybe] - w.first[row]), pa.array(grams[maybe].view(np.int64))], ["place", "hash"])
                edges = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(edges, np.maximum(at[maybe] - REACH, w.first[row]), 1)
                np.add.at(edges, np.minimum(at[maybe] + k + REACH, w.first[row + 1]), -1)
                seen = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
                around = pa.StructArray.from_arrays([pa.array(seen - w.first[w.doc[seen]]), pa.array(w.hash[seen].view(np.int64))], ["place", "hash"])
                none = count == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n),
                        pa.array(np.diff(w.first)),
                        pa.array(count),
                        pa.array(first, mask=none),
                        pa.array(last, mask=none),
                        pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), votes),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(seen, w.first), pa.int32()), around),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "votes", "around"],
                )

    return scan


def align(words: np.ndarray, template: np.ndarray) -> tuple[int, set[int], int, int, int]:
    """The best local alignment (the last of equal ones): its sum, the template's words that are equal, other places, and the words from where to where."""
    steps = np.arange(1, len(template) + 1)
    sums = np.zeros((len(words) + 1, len(template) + 1), np.int64)
    for i, word in enumerate(words):
        here = np.maximum(np.maximum(sums[i, :-1] + np.where(template == word, 1, -1), sums[i, 1:] - 1), 0)
        sums[i + 1, 1:] = np.maximum.accumulate(here + steps) - steps  # words of the template left out
    i, j = map(int, divmod(sums.size - 1 - int(np.argmax(sums.ravel()[::-1])), sums.shape[1]))
    best, end, equal, other = int(sums[i, j]), i, set(), 0
    while sums[i, j] > 0:
        same = words[i - 1] == template[j - 1]
        if sums[i, j] == sums[i - 1, j - 1] + (1 if same else -1):
            i, j = i - 1, j - 1
            if same:
                equal.add(j)
            else:
                other += 1
        elif sums[i, j] == sums[i - 1, j] - 1:
            other, i = other + 1, i - 1
        else:
            other, j = other + 1, j - 1
    return best, equal, other, i, end


class Template:
    """The words of a template; ``own`` are the places of those that a short one must have, as no other label's templates have them."""

    def __init__(self, label: str, text: str, others: list[str]):
        self.label, self.words = label, words_of(text).hash
        self.least = (SHORT_COVERAGE if len(self.words) < SHORT else MIN_COVERAGE) * len(self.words)
        foreign = words_of(" ".join(others)).hash
        self.own = set(np.flatnonzero(~np.isin(self.words, foreign)).tolist()) if len(self.words) < SHORT else set()


def known_templates(templates=TEMPLATES) -> list[Template]:
    return [Template(label, text, [t for x, t in templates if x != label]) for label, text in templates]


def verified(place: np.ndarray, words: np.ndarray, spans: list[tuple[int, int, int]], templates: list[Template]) -> list[tuple[str, int, int, float]]:
    """``label, start, end, coverage`` of the spans ``(template, start, end)`` that alignment verifies and no better one overlaps."""
    found = set()
    for number, start, end in spans:
        template = templates[number]
        lo, hi = np.searchsorted(place, (start - REACH, end + REACH))
        best, equal, other, first, last = align(words[lo:hi], template.words)
        if len(equal) >= max(template.least, MIN_IDENTITY * (len(equal) + other)) and template.own <= equal:
            found.add((-best, -len(equal) / len(template.words), template.label, int(place[lo + first]), int(place[lo + last - 1]) + 1))
    won: list[tuple[str, int, int, float]] = []
    for _, coverage, label, start, end in sorted(found):
        if all(end <= s or e <= start for _, s, e, _ in won):
            won.append((label, start, end, -coverage))
    return sorted(won)


def _verifier(templates):
    known = known_templates(templates)
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans, around in zip(batch.column("candidates").to_pylist(), batch.column("around"), strict=True):
                rows = []
                if spans:
                    near = around.values
                    rows = verified(near.field("place").to_numpy(), near.field("hash").to_numpy().view(np.uint64), [(s["template"], s["start"], s["end"]) for s in spans], known)
                out.append([dict(zip(("label", "start", "end", "coverage"), r, strict=True)) for r in rows])
            names = [n for n in batch.schema.names if n not in ("candidates", "around")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, kind)], [*names, "spans"])

    return verify


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates=TEMPLATES, k: int = K) -> DataFrame:
    """One row per document: base counts, ``base_labels``, ``labels``, ``score`` and the verified ``spans``.

    ``spans`` has ``label, start, end, coverage`` with word positions.  The score
    is 1 where a base phrase stands, else the best coverage of a verified span.
    """
    spark = docs.sparkSession
    places = template_positions(templates, k)
    known = np.unique(np.array([r[3] for r in places], np.int64).view(np.uint64))
    kind = dict(docs.dtypes)[id_col]
    pairs = "array<struct<place: long, hash: long>>"
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scanned = rows.mapInArrow(_scanner(phrases, known, k), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, votes {pairs}, around {pairs}")
    scanned = stored(scanned.withColumn("row", F.monotonically_increasing_id()), "license-scan")

    where = F.broadcast(spark.createDataFrame(places, "template int, needed int, t_place int, hash long"))  # as large as the templates
    votes = scanned.where("size(votes) > 0").select("row", F.inline("votes")).join(where, "hash").withColumn("diagonal", F.col("place") - F.col("t_place"))
    diagonals = votes.groupBy("row", "template", "needed", "diagonal").agg(F.count(F.lit(1)).alias("hits"), F.min("place").alias("start"), F.max("place").alias("end"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    # A new span starts where the next diagonal is further off than SLACK.
    split = diagonals.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > SLACK).cast("int"), F.lit(0)))
    split = split.withColumn("run", F.sum("new").over(along))
    spans = split.groupBy("row", "template", "needed", "run").agg(F.sum("hits").alias("hits"), F.min("start").alias("start"), (F.max("end") + k).alias("end")).where(F.col("hits") >= F.col("needed"))
    spans = spans.groupBy("row").agg(F.collect_list(F.struct("template", "start", "end")).alias("candidates"))  # as many as a text holds

    out = scanned.drop("votes").join(spans, "row", "left").drop("row")
    out = out.mapInArrow(_verifier(templates), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, spans array<struct<label: string, start: long, end: long, coverage: double>>")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("spans", lambda s: s["label"]))))
    coverage = F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(coverage)
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "spans")
