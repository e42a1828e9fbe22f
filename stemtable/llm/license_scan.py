"""License scans: MinHash bands over overlapping text windows, then exact containment.

Texts and license templates are cut into lower-cased runs of a-z and 0-9 and into
shingles of ``SHINGLE`` words.  A template with n shingles is looked up among
windows of L shingles at steps of L / 2, where L is the power of two with
L / 4 < n <= L / 2: any occurrence lies inside one window.  A window that holds a
share of ``CONTAINMENT`` of the template's shingles has a Jaccard similarity of
at least 0.8 * n / (L + 0.2 * n) > 0.19 with it, and ``BANDS`` bands of one
MinHash each meet with a probability above 1 - 0.81 ** 24 > 0.99 (a whole
template above 0.998).  Candidates are verified by exact containment.

A text is scanned only if it holds a gate word.  The gate words are chosen so
that more than 1 - ``CONTAINMENT`` of each template's shingles hold one: a text
without any of them cannot reach the containment, so nothing is lost.

Notices of different licenses share much of their words.  Of matches that overlap in
a text, the one of the highest containment stays, then that of the longest template;
a match is the span of words from its first to its last verified shingle.

The templates are a fixed list and small, so their bands are broadcast.  Null and
empty texts have no match.  Rows of equal id count as one document; a null id is
kept as null.  Repeated rows give one result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemtable.llm.frames import literal_table

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 24
GATE_LETTERS = 7
# Words of a cell in which matches are compared with those that overlap them.
CELL = 256
WORD = "[^a-z0-9]+"

# The kinds and versions of Creative Commons licenses.
CC_KINDS = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CC_VERSIONS = {"4.0": "International", "3.0": "Unported"}
CREATIVE_COMMONS = tuple(
    (f"CC-{kind}-{version}", notice)
    for kind, name in CC_KINDS.items()
    for version, scope in CC_VERSIONS.items()
    for notice in (
        f"This work is licensed under a Creative Commons {name} {version} {scope} License",
        f"Licensed under CC {kind} {version}",
    )
)

# License identifiers and the notices by which texts declare them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE,"
        " REPRODUCTION, AND DISTRIBUTION",
    ),
    (
        "Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    (
        "MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of"
        " the Software",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction',
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any"
        " later version",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version",
    ),
    (
        "LGPL",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General"
        " Public License as published by the Free Software Foundation",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General"
        " Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    (
        "GFDL",
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free"
        " Documentation License",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "PostgreSQL",
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee,"
        " and without a written agreement is hereby granted",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    ),
    (
        "CDDL",
        "The contents of this file are subject to the terms of the Common Development and Distribution License",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and"
        " accompanying documentation covered by this license",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held"
        " liable for any damages arising from the use of this software",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    (
        "CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this"
        " work",
    ),
    ("CC0-1.0", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("PSF-2.0", "This LICENSE AGREEMENT is between the Python Software Foundation"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission"),
    ("ODbL", "This database is made available under the Open Database License"),
    ("Artistic-2.0", "under the terms of the Artistic License version 2.0"),
    *CREATIVE_COMMONS,
)


def template_words(text: str) -> list[str]:
    return [w for w in re.split(WORD, text.lower()) if w]


def template_shingles(words: list[str]) -> list[list[str]]:
    size = min(SHINGLE, len(words))
    return [words[i : i + size] for i in range(len(words) - size + 1)]


def window_size(n: int) -> int:
    """The power of two with size / 4 < n <= size / 2."""
    size = 2
    while size < 2 * n:
        size *= 2
    return size


def gate_words(templates: Sequence[tuple[str, str]]) -> list[str]:
    """Few words such that more than 1 - CONTAINMENT of each template's shingles hold one of them."""
    open_ = [template_shingles(template_words(t)) for _, t in templates]
    gate: list[str] = []

    def covered(shingles, words):
        return sum(1 for s in shingles if set(s) & set(words))

    def lacking():
        return [s for s in open_ if covered(s, gate) <= (1 - CONTAINMENT) * len(s)]

    while left := lacking():
        # Long words first: short ones are common in any text.
        words = sorted({w for shingles in left for s in shingles for w in s if len(w) >= GATE_LETTERS}) or sorted(
            {w for shingles in left for s in shingles for w in s}
        )
        gate.append(max(words, key=lambda w: (sum(covered(s, [w]) / len(s) for s in left), len(w), w)))
    return gate


def shingle_hashes(words: Column) -> Column:
    """Hashes of all shingles; a shorter text is one shingle, an empty one has none."""
    n = F.size(words)
    many = F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
    few = F.when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n > SHINGLE, many).otherwise(few)


def bands(shingles: Column) -> Column:
    """``(band, value)`` of the BANDS MinHashes of a set of shingles."""

    def band(j: int) -> Column:
        values = F.transform(shingles, lambda h: F.xxhash64(h, F.lit(j)))
        return F.struct(F.lit(j).alias("band"), F.array_min(values).alias("value"))

    return F.array(*[band(j) for j in range(BANDS)])


def windows(hashes: Column, size: int) -> Column:
    """Windows of ``size`` shingles at steps of half a window; the last ones may be shorter."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - 1, F.lit(0)), F.lit(size // 2))
    return F.transform(
        starts,
        lambda at: F.struct(
            F.lit(size).alias("length"), at.alias("first_word"), F.slice(hashes, at + 1, size).alias("part")
        ),
    )


def template_table(docs: DataFrame, templates: Sequence[tuple[str, str]]) -> DataFrame:
    rows = [
        (i, name, template_words(text), window_size(len(template_shingles(template_words(text)))))
        for i, (name, text) in enumerate(templates)
    ]
    schema = "template int, license string, words array<string>, length int"
    table = literal_table(docs.sparkSession, rows, schema)
    return table.select("template", "license", "length", F.array_distinct(shingle_hashes(F.col("words"))).alias("own"))


def license_scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``doc_id, license, containment, first_word``: the best containment of each license found in
    each document, and the first word of the first match that reaches it."""
    table = template_table(docs, templates)
    lengths = sorted({window_size(len(template_shingles(template_words(t)))) for _, t in templates})
    gate = "|".join(re.escape(w) for w in gate_words(templates))
    gated = docs.filter(F.lower("text").rlike(rf"(^|[^a-z0-9])({gate})([^a-z0-9]|$)"))
    words = F.filter(F.split(F.lower("text"), WORD), lambda w: w != "")
    cut = gated.select("doc_id", F.inline(F.array(F.struct(words.alias("words")))))
    hashed = cut.select("doc_id", F.inline(F.array(F.struct(shingle_hashes(F.col("words")).alias("hashes")))))
    found = F.flatten(F.array(*[windows(F.col("hashes"), size) for size in lengths]))
    cut = hashed.filter(F.size("hashes") > 0).select("doc_id", F.inline(found))
    banded = cut.select("doc_id", "length", "first_word", "part", F.inline(bands(F.col("part"))))
    index = table.select("template", "license", "length", "own", F.inline(bands(F.col("own"))))
    # The templates are a fixed list: their bands have BANDS rows each.
    met = banded.join(F.broadcast(index), ["length", "band", "value"])
    share = F.size(F.array_intersect("part", "own")) / F.size("own")
    candidates = met.select("doc_id", "template", "license", "first_word", "part", "own", share.alias("containment"))
    # The places of the template's shingles, of the few windows that hold enough of them.
    held = F.transform("part", lambda h, i: F.when(F.array_contains("own", h), i))
    spans = candidates.filter(F.col("containment") >= CONTAINMENT).select(
        "doc_id",
        "license",
        "containment",
        (F.col("first_word") + F.array_min(held)).alias("first_word"),
        (F.col("first_word") + F.array_max(held) + SHINGLE).alias("upto"),
        F.size("own").alias("size"),
    )
    kept = _undominated(spans.distinct())
    return (
        kept.groupBy("doc_id", "license")
        .agg(F.max(F.struct("containment", (-F.col("first_word")).alias("back"))).alias("best"))
        .select("doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.back")).alias("first_word"))
    )


def _undominated(spans: DataFrame) -> DataFrame:
    """The matches that no overlapping match of another license is better than."""
    fields = ["license", "containment", "first_word", "upto", "size"]
    cell = F.explode(F.sequence(F.floor(F.col("first_word") / CELL), F.floor((F.col("upto") - 1) / CELL))).alias("cell")
    placed = spans.select("doc_id", F.struct(*fields).alias("match"), cell)
    # A cell of some words of one text holds few matches.
    met = placed.groupBy("doc_id", "cell").agg(F.collect_set("match").alias("matches"))

    def better(a: Column, b: Column) -> Column:
        overlap = F.least(a["upto"], b["upto"]) > F.greatest(a["first_word"], b["first_word"])
        higher = F.struct(a["containment"], a["size"]) > F.struct(b["containment"], b["size"])
        return (a["license"] != b["license"]) & overlap & higher

    judged = F.transform(
        "matches", lambda b: F.struct(b.alias("match"), F.exists("matches", lambda a: better(a, b)).alias("beaten"))
    )
    rows = met.select("doc_id", F.inline(judged))
    return rows.groupBy("doc_id", "match").agg(F.bool_or("beaten").alias("beaten")).filter("not beaten").select("doc_id", "match.*")
