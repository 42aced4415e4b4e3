"""License scans by a positional index of rare words.

Templates are indexed by word and position. Where all mandatory phrases of a template occur
in a file, all of the file's words that the template has are looked up; the template is a
candidate where postings agree on its place in the file; it is accepted when enough of its
words, weighed by rarity (by document frequency over the whole corpus), stand at their
relative position there and all of its mandatory phrases occur in that stretch.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Phrases whose every occurrence is a base label.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label, text, mandatory phrases.
TEMPLATES = (
    ("mit", "released under the MIT License", ("mit license",)),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted", "without restriction"),
    ),
    ("apache-2.0", "licensed under the Apache License, Version 2.0", ("apache license", "2 0")),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        ("in compliance with the license", "apache org licenses"),
    ),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("general public license", "version 3")),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("general public license", "version 2")),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
        ("free software", "general public license", "version 3"),
    ),
    (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version",
        ("free software", "general public license", "version 2"),
    ),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("lesser general public license",)),
    ("agpl-3.0", "licensed under the GNU Affero General Public License", ("affero general public license",)),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice",
        ("redistribution and use in source and binary forms", "copyright notice"),
    ),
    ("bsd", "licensed under the BSD License", ("bsd license",)),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
        ("with or without fee is hereby granted",),
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("mozilla public license", "2 0"),
    ),
    ("cc-by-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    (
        "cc-by-4.0",
        "licensed under a Creative Commons Attribution 4.0 International License",
        ("creative commons attribution 4 0",),
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain",
        ("unencumbered software", "public domain"),
    ),
    ("proprietary", "Copyright. All rights reserved", ("all rights reserved",)),
)
#: Least weight of a template's word, however common it is.
LEAST_IDF = 0.1
#: Words by which a place may differ from its template's.
SLACK = 3
#: Share of a template's weight that must stand in place.
COVERAGE = 0.6


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; runs of digits, a-z and anything beyond ASCII."""
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


@dataclass(frozen=True)
class Index:
    """Postings of template words, weighed by rarity."""

    words: tuple[tuple[bytes, ...], ...]
    idf: dict[bytes, float]
    postings: dict[bytes, tuple[tuple[int, int], ...]]
    weight: tuple[float, ...]
    phrases: tuple[tuple[tuple[bytes, ...], ...], ...]

    @classmethod
    def build(cls, df: dict[bytes, int], docs: int) -> Index:
        words = tuple(tuple(words_of(t)) for _, t, _ in TEMPLATES)
        idf = {w: max(LEAST_IDF, math.log((docs + 2) / (df.get(w, 0) + 1))) for ws in words for w in ws}
        postings: dict[bytes, list] = defaultdict(list)
        for t, ws in enumerate(words):
            for p, w in enumerate(ws):
                postings[w].append((t, p))
        weight = tuple(sum(idf[w] for w in ws) for ws in words)
        phrases = tuple(tuple(tuple(words_of(p)) for p in ps) for *_, ps in TEMPLATES)
        return cls(words, idf, {w: tuple(p) for w, p in postings.items()}, weight, phrases)


def places(words: list[bytes], phrase: tuple[bytes, ...], lo: int = 0, hi: int | None = None) -> list[int]:
    """Where the words of ``phrase`` stand one after another, starting in [lo, hi)."""
    n, hi = len(phrase), len(words) if hi is None else min(hi, len(words))
    out, at = [], lo
    while True:
        try:
            at = words.index(phrase[0], at, hi)
        except ValueError:
            return out
        if tuple(words[at : at + n]) == phrase:
            out.append(at)
        at += 1


def scan(words: list[bytes], index: Index) -> list[tuple[str, int, int, float]]:
    """Accepted ``(label, start, end, coverage)`` of a file, best first."""
    have = set(words)
    live = {
        t
        for t, ps in enumerate(index.phrases)
        if all(have.issuperset(p) for p in ps) and all(places(words, p) for p in ps)
    }
    if not live:
        return []
    at = defaultdict(list)
    for i, w in enumerate(words):
        if w in index.idf:
            at[w].append(i)
    votes: dict[tuple[int, int], set] = defaultdict(set)
    for w, here in at.items():
        for t, p in index.postings[w]:
            if t in live:
                for i in here:
                    votes[t, (i - p) // (SLACK + 1)].add(p)
    found: dict[tuple[str, int], tuple[str, int, int, float]] = {}
    for (t, cell), hits in votes.items():
        both = hits | votes.get((t, cell + 1), set())
        if len(both) < min(2, len(index.words[t])):
            continue
        around = both | votes.get((t, cell - 1), set())
        if sum(index.idf[index.words[t][p]] for p in around) < (COVERAGE - 1e-9) * index.weight[t]:
            continue
        lo = max(0, cell * (SLACK + 1) - SLACK)
        hi = (cell + 2) * (SLACK + 1) + len(index.words[t]) + SLACK
        near = defaultdict(list)
        for i, w in enumerate(words[lo:hi], lo):
            near[w].append(i)
        base = cell * (SLACK + 1)
        got = sum(
            index.idf[w]
            for p, w in enumerate(index.words[t])
            if any(-SLACK <= i - p - base <= 2 * SLACK + 1 for i in near.get(w, ()))
        )
        cover = got / index.weight[t]
        if cover < COVERAGE or not all(places(words, p, lo, hi) for p in index.phrases[t]):
            continue
        label = TEMPLATES[t][0]
        start = min(min(places(words, p, lo, hi)) for p in index.phrases[t])
        row = (label, start, min(len(words), hi), round(cover, 6))
        if (label, start) not in found or found[label, start][3] < row[3]:
            found[label, start] = row
    return sorted(found.values(), key=lambda r: (-r[3], r[0], r[1]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, base array<struct<label, start>>, matches array<struct<label, start, end, coverage>>)``.

    One row per row of ``docs``, over whole texts; starts count words from 0. Null or empty
    text: no words, empty arrays. The corpus is read twice: for document frequencies of the
    templates' words (a list as long as the templates, whatever the corpus) and for the scan.
    Other columns are ignored. No rows: no rows.
    """
    import pyarrow as pa

    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    vocabulary = frozenset(w for _, t, _ in TEMPLATES for w in words_of(t))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[bytes, int] = defaultdict(int)
        for b in batches:
            for x in b.column(0):
                n[b""] += 1
                for w in vocabulary.intersection(words_of(x.as_py())):
                    n[w] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"]
        )

    counts = d.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df = {r[0].encode(): r[1] for r in counts.collect()}
    index = Index.build(df, df.get(b"", 0))
    base = tuple((tuple(words_of(p)), label) for p, label in BASE_PHRASES)
    schema = (
        f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words bigint, "
        "base array<struct<label: string, start: bigint>>, "
        "matches array<struct<label: string, start: bigint, end: bigint, coverage: double>>"
    )
    kinds = [
        pa.int64(),
        pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())])),
        pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, bases, matches = [], [], []
            for x in b.column(1):
                words = words_of(x.as_py())
                n.append(len(words))
                here = [{"label": label, "start": i} for p, label in base for i in places(words, p)]
                bases.append(sorted(here, key=lambda r: (r["start"], r["label"])))
                matches.append([dict(zip(("label", "start", "end", "coverage"), r, strict=True)) for r in scan(words, index)])
            columns = [b.column(0), *(pa.array(c, k) for c, k in zip((n, bases, matches), kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "base", "matches"])

    return d.mapInArrow(run, schema)


def digest(scans: DataFrame) -> DataFrame:
    """The columns of the license query."""
    own = F.transform("base", lambda r: r["label"])
    more = F.transform("matches", lambda r: r["label"])
    start = F.transform("base", lambda r: r["start"])
    line = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda r: r["coverage"])), F.lit(0.0))
    return scans.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        line(own).alias("base_labels"),
        line(F.concat(own, more)).alias("labels"),
        F.least(F.lit(1.0), F.greatest(best, F.when(F.size("base") > 0, 0.5).otherwise(0.0))).alias("score"),
    )
