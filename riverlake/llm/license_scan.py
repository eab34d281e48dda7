"""License scans in DataFrame operations only: MinHash bands over overlapping windows.

Words are runs of letters and digits, in lower case. Windows are ``WINDOW`` consecutive 5-word
shingles: of a text those at every ``STEP``-th shingle, so that they overlap, of a template those
at every shingle. A window's signature are its least shingle in each of ``2 * BANDS`` orders: by
one of ``BANDS`` separate stretches of the hash's bits, and by the reverse. Both orders of a
stretch are one band, so bands have two rows. A template is retrieved where a band of a window of
the text is the same band of one of its windows. Equal windows share all bands; two windows that
share three of their four shingles share a band with probability ``1 - (1 - 3/10) ** BANDS``,
94 %. A template whose text is there has at least one equal window if five of its shingles stand
together, which ``CONTAINED`` of six or more do unless edits tear them into shorter pieces; of
four, all or three, there are one or two windows that share three. Templates of fewer than
``WINDOW`` shingles must be there whole; their window is their least shingle alone, compared with
the windows of one shingle of the text, so they are always retrieved.

Then the shingles around each retrieving window are compared with the exact ones of the templates
that the text retrieved and that have a shingle in the window: one matches if at least
``CONTAINED`` of them are there. Of templates that say nearly the same, the one with the highest
containment is taken (then the longest, then the first name); another name stays only if
``CONTAINED`` of the shingles that it alone has are there too.

Windows become rows that carry no text, and are filtered where they arise; only the few texts
with a retrieving window are read again. Results are by text, so copies are compared once.

Defined results: a row per row; null and empty texts, and those of fewer than five words, have
no licenses. A very long text is read whole, as windows. Ties of containment go by length, then by
name. Repeated rows give equal rows; extra columns are not read, whatever their names; an empty
table gives no rows. Templates are a list in the driver; those of fewer than five words are
refused. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlake.llm.rows import stored

SHINGLE = 5
WINDOW, STEP = 4, 2
BANDS, BAND_BITS = 8, 8
CONTAINED = 0.75

# Notices of well-known licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this'
        " file except in compliance with the License.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files, to deal in the Software without restriction",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def _gnu(thing: str, license: str, version: str) -> str:
    return (
        f"This {thing} is free software; you can redistribute it and/or modify it under the terms"
        f" of the GNU {license} as published by the Free Software Foundation; either"
        f" version {version} of the License, or (at your option) any later version."
    )


_GNU = [
    ("AGPL-3.0", "Affero General Public License", "3"),
    ("GPL-2.0", "General Public License", "2"),
    ("LGPL-2.0", "Library General Public License", "2"),
    ("LGPL-2.1", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "Lesser General Public License", "3"),
]
_CC = [
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-SA", "Attribution-ShareAlike"),
]

# Notices of relatives of those licenses, and of further ones.
RELATED = [
    *[(name, _gnu(thing, *said)) for name, *said in _GNU for thing in ("program", "library")],
    ("GPL-3.0", _gnu("library", "General Public License", "3")),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ),
    *[(name, f"This work is licensed under the GNU {said}, version {v}.") for name, said, v in _GNU],
    ("GPL", "This work is licensed under the GNU General Public License."),
    ("LGPL", "This work is licensed under the GNU Lesser General Public License."),
    *[
        (f"CC-{name}-4.0", f"This work is licensed under a Creative Commons {said} 4.0 International License.")
        for name, said in _CC
    ],
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    (
        "CC-BY-SA-3.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    ),
    *[(f"CC-{name}-4.0", f"Licensed under CC {name} 4.0.") for name in ("BY", *[n for n, _ in _CC if n != "BY-NC"])],
    ("CC0-1.0", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication"),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights to"),
    (
        "CC0-1.0",
        "have dedicated all copyright and related and neighboring rights to this software to the"
        " public domain worldwide",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    *[
        (
            f"EPL-{v}",
            "This program and the accompanying materials are made available under the terms of the"
            f" Eclipse Public License v{v}",
        )
        for v in ("1.0", "2.0")
    ],
]

def _shingles(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with the hashes of its texts' shingles, in order, as ``shingles``."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return df.withColumn("words", words).withColumn(
        "shingles",
        F.expr(
            f"case when size(words) < {SHINGLE} then cast(array() as array<bigint>) else transform("
            f"sequence(0, size(words) - {SHINGLE}), i -> xxhash64("
            + ", ".join(f"words[i + {k}]" for k in range(SHINGLE))
            + ")) end"
        ),
    )


def _bands(window: list[Column]) -> list[Column]:
    """The bands of the window of some shingles."""
    values = []
    for bits in range(0, BANDS * BAND_BITS, BAND_BITS):
        order = window
        if bits:
            order = [F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits)) for h in window]
        values.append(F.xxhash64(F.least(*order), F.greatest(*order)))
    return values


def template_shingles(spark: SparkSession, templates: list[tuple[str, str]]) -> list[tuple[str, list[int]]]:
    """Name and distinct shingles of each template."""
    return [(name, list(dict.fromkeys(own))) for name, own in _in_order(spark, templates)]


def _in_order(spark: SparkSession, templates: list[tuple[str, str]]) -> list[tuple[str, list[int]]]:
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "i int, name string, text string")
    rows = _shingles(df, F.col("text")).select("i", "name", "shingles")
    found = [(r.name, list(r.shingles)) for r in sorted(rows.collect(), key=lambda r: r.i)]
    for (name, own), (_, text) in zip(found, templates):
        if not own:
            raise ValueError(f"the template {text!r} of {name} has fewer than {SHINGLE} words")
    return found


def template_bands(spark: SparkSession, shingles: list[list[int]]) -> list[tuple[int, int, int]]:
    """(template, band, value) of all windows of templates; band -1 is a window of one shingle."""
    short = [(t, -1, min(own)) for t, own in enumerate(shingles) if len(own) < WINDOW]
    windows = [
        (t, *own[i : i + WINDOW])
        for t, own in enumerate(shingles)
        for i in range(len(own) - WINDOW + 1)
    ]
    names = [f"h{k}" for k in range(WINDOW)]
    rows = spark.createDataFrame(windows, "t int, " + ", ".join(f"{n} long" for n in names))
    values = F.array(*_bands([F.col(n) for n in names]))
    banded = rows.select("t", F.posexplode(values).alias("band", "value"))
    return short + sorted({(r.t, r.band, r.value) for r in banded.collect()})


def scan_licenses(
    docs: DataFrame,
    templates: list[tuple[str, str]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: id, how many windows retrieve a template, and the licenses found, by name."""
    spark = docs.sparkSession
    in_order = _in_order(spark, TEMPLATES + RELATED if templates is None else templates)
    known = [(name, list(dict.fromkeys(own))) for name, own in in_order]
    bands = template_bands(spark, [own for _, own in in_order])
    longest = max((len(own) for _, own in in_order), default=0)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(
        F.col(id_col).alias("doc"),
        text.alias("text"),
        F.xxhash64(text).alias("digest"),
        F.length(text).alias("length"),
    )
    key = ["digest", "length"]
    names = [f"h{k}" for k in range(WINDOW)]
    shingles = [F.col(name) for name in names]
    own_bands = _bands(shingles)

    def in_windows(df: DataFrame, *kept: str) -> DataFrame:
        # A window that the text's end cuts short repeats its first shingle, so its set stays the same.
        rows = (
            f"case when size(shingles) > 0 then transform(sequence(0, size(shingles) - 1, {STEP}),"
            " i -> named_struct('i', i, "
            + ", ".join(f"'h{k}', coalesce(get(shingles, i + {k}), shingles[i])" for k in range(WINDOW))
            + ")) end"
        )
        # Outer: else Spark would filter by the windows ahead of them, and so take shingles in a loop.
        # Not null: so that the code of the bands has no checks, and stays short enough to be compiled.
        return df.select(*key, *kept, F.inline_outer(F.expr(rows))).dropna(subset=names)

    retrieving = F.lit(False)
    for band in sorted({band for _, band, _ in bands}):
        values = sorted({value for _, b, value in bands if b == band})
        for own in shingles[:STEP] if band < 0 else [own_bands[band]]:
            retrieving = retrieving | own.isin(values)
    told = [(F.lit(-1), h) for h in shingles[:STEP]]
    told += [(F.lit(band), value) for band, value in enumerate(own_bands)]
    told = F.array(*[F.struct(band.alias("band"), value.alias("value")) for band, value in told])
    places = in_windows(_shingles(source.select("text", *key), F.col("text"))).where(retrieving)
    templates_told = spark.createDataFrame(bands, "template int, band int, value long")
    pairs = places.select(*key, "i", F.inline_outer(told)).join(templates_told, ["band", "value"])
    retrieved = stored(
        pairs.groupBy(*key).agg(
            F.count_distinct("i").alias("n_retrieved"), F.collect_set("template").alias("templates")
        ),
        "licenses-retrieved",
    )

    # Of the texts with a retrieving window, the shingles around each of them.
    texts = source.join(retrieved, key, "left_semi").groupBy(*key).agg(F.first("text").alias("text"))
    around = (
        in_windows(_shingles(texts, F.col("text")), "shingles")
        .where(retrieving)
        .select(
            *key,
            F.array(*shingles).alias("at"),
            F.array_distinct(
                F.slice("shingles", F.greatest(F.lit(1), F.col("i") + 1 - longest), F.lit(WINDOW + 2 * longest))
            ).alias("around"),
        )
        .join(retrieved.select(*key, "templates"), key)
    )

    def candidate(template: int, name: str, own: list[int]) -> Column:
        all_ = F.array(*map(F.lit, own))
        both = F.array_intersect("around", all_)
        held = (F.size(both) >= len(own) * CONTAINED) & F.arrays_overlap("at", all_)
        held = F.array_contains("templates", template) & held
        return F.when(held, F.struct(F.lit(name).alias("name"), all_.alias("own"), both.alias("both")))

    def beaten(a: Column, b: Column) -> Column:
        ours, theirs = F.size(a["both"]) * F.size(b["own"]), F.size(b["both"]) * F.size(a["own"])
        first = F.size(b["own"]) > F.size(a["own"])
        first = first | ((F.size(b["own"]) == F.size(a["own"])) & (b["name"] < a["name"]))
        alone = F.size(F.array_except(a["own"], b["own"])) * CONTAINED
        said = F.size(F.array_except(a["both"], b["own"]))
        higher = (theirs > ours) | ((theirs == ours) & first)
        return (a["name"] != b["name"]) & higher & (said < F.greatest(F.lit(1.0), alone))

    found = None
    if known:
        matched = around.select(
            *key, F.array_compact(F.array(*[candidate(i, *t) for i, t in enumerate(known)])).alias("matched")
        ).where(F.size("matched") > 0)
        best = F.filter("matched", lambda a: ~F.exists("matched", lambda b: beaten(a, b)))
        found = matched.select(*key, F.explode(best["name"]).alias("name"))
    nothing = F.array().cast("array<string>")
    rows = source.select("doc", *key).join(retrieved, key, "left")
    if found is not None:
        licenses = stored(
            found.groupBy(*key).agg(F.array_sort(F.collect_set("name")).alias("licenses")), "licenses-found"
        )
        rows = rows.join(licenses, key, "left")
    else:
        rows = rows.withColumn("licenses", nothing)
    return rows.select(
        F.col("doc").alias(id_col),
        F.coalesce("n_retrieved", F.lit(0)).alias("n_retrieved"),
        F.coalesce("licenses", nothing).alias("licenses"),
    )
