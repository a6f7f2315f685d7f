"""License scans: MinHash bands over overlapping windows find templates, containment verifies.

Only DataFrame functions.  Words are runs of letters and digits, lower-cased; shingles are five
words, hashed to 64 bits.  A template of up to w shingles (w a power of two, its class) is looked
for in windows of 3w/2 shingles that begin at every w/2, so it lies wholly in one of them, and a
window in which at least four fifths of it occur has a Jaccard similarity of at least a quarter
with it.  With ``BANDS`` = 32 bands of one minimum each, such a pair collides in some band with
probability 1 - 0.75 ** 32 > 0.9998.  Each collision is verified: the share of the template's
shingles that the window holds must reach ``least``.  Where templates of different licenses match
at one place, a match gives way to a better one (higher containment, or equal and longer) whose
span covers at least half of its own.

A band can only collide in a window that holds the shingle whose hash is the template's minimum,
so documents without any such shingle are left out before windows are made, and windows without
one of a template of their class before their minima are; this loses nothing.

Null and empty texts, and texts or templates of under five words, match nothing.  A null id stays
null; repeated rows give their own results once, as the rows of one id are one document.  An
empty table, or no templates, gives no rows.  Other columns are not read.  There may be up to
``MOST_TEMPLATES`` templates; more raise an error, since they are sent to all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltide.llm.shared import cut

SHINGLE, BANDS, LEAST = 5, 32, 0.8
MOST_TEMPLATES = 2000

# Notices by which texts state their license.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
                   "use this file except in compliance with the License. You may obtain a copy of "
                   "the License at"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the "
                "terms of the GNU General Public License as published by the Free Software "
                "Foundation, either version 3 of the License, or (at your option) any later "
                "version."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International "
                  "License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
                     "International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
                "v. 2.0."),
)

_GNU = ("This {0} is free software{1} you can redistribute it and/or modify it under the terms of "
        "the GNU {2} as published by the Free Software Foundation{3} either version {4} of the "
        "License, or (at your option) any later version.")
_DISCLAIMER = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
               "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
               "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: 1. Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. ")
# Further families and versions.
TEMPLATES += tuple((name, _GNU.format(thing, ":", title, ",", version))
                   for thing in ("program", "library")
                   for name, title, version in (
                       ("gpl-2.0", "General Public License", "2"),
                       ("gpl-3.0", "General Public License", "3"),
                       ("lgpl-2.1", "Lesser General Public License", "2.1"),
                       ("lgpl-3.0", "Lesser General Public License", "3"),
                       ("agpl-3.0", "Affero General Public License", "3"))) + (
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with "
            "or without fee is hereby granted, provided that the above copyright notice and this "
            "permission notice appear in all copies."),
    ("bsd-2-clause", _BSD + _DISCLAIMER),
    ("bsd-3-clause", _BSD + "3. Neither the name of the copyright holder nor the names of its "
                     "contributors may be used to endorse or promote products derived from this "
                     "software without specific prior written permission. " + _DISCLAIMER),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone "
                  "is free to copy, modify, publish, use, compile, sell, or distribute this "
                  "software, either in source code form or as a compiled binary, for any purpose, "
                  "commercial or non-commercial, and by any means."),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 "
                     "International License."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                     "International License."),
)


def words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " "))
    return F.split(plain, " ")


def shingles(word: Column) -> Column:
    """Hashes of all shingles in order; none where there are too few words."""
    starts = F.when(F.size(word) >= SHINGLE, F.sequence(F.lit(0), F.size(word) - SHINGLE)) \
        .otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(word, i + k) for k in range(SHINGLE)]))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value made once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def minima(window: Column) -> Column:
    """The least hash of a window's shingles in each band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda band: F.array_min(
        F.transform(window, lambda x: F.xxhash64(x, band))))


def described(spark: SparkSession, templates) -> DataFrame:
    """(template, license, parts, size, minima) of templates (license, text)."""
    listed = [(k, name, text) for k, (name, text) in enumerate(templates)]
    if len(listed) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates")
    rows = spark.createDataFrame(listed, "template int, license string, text string")
    parts = F.array_distinct(shingles(F.col("words")))
    return (rows.withColumn("words", words(F.col("text"))).withColumn("parts", parts)
            .where(F.size("parts") > 0)
            .select("template", "license", "parts",
                    F.pow(2, F.ceil(F.log2(F.size("parts")))).cast("int").alias("size"),
                    minima(F.col("parts")).alias("minima")))


def scan(docs: DataFrame, templates=TEMPLATES, least: float = LEAST, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(id, template, license, containment, first_word, places) of each template in a document:
    the largest share of it found, where the first such window begins, and in how many windows."""
    known = described(docs.sparkSession, templates).collect()
    schema = "template int, license string, parts array<long>, size int, minima array<long>"
    few = docs.sparkSession.createDataFrame(known, schema)
    of_size: dict[int, set[int]] = {}
    for r, bands in zip(known, _hashes(few), strict=True):
        of_size.setdefault(r.size, set()).update(
            min(r.parts, key=dict(zip(r.parts, hashes, strict=True)).get) for hashes in bands)
    telling, sizes = sorted(set().union(*of_size.values())), sorted(of_size)
    rows = docs.select(F.col(id_col).alias("id"),
                       bound(words(F.col(text_col)), shingles).alias("parts"))
    # Cut, so that no filter drawn from what follows is evaluated over all texts.
    open_rows = cut(rows.where(F.arrays_overlap("parts", F.lit(telling).cast("array<long>")))
                    if telling else rows.limit(0))
    windows = F.flatten(F.array(*[_places(size, sorted(of_size[size])) for size in sizes])) \
        if sizes else F.expr("cast(null as array<struct<size int, at int>>)")
    cut_up = open_rows.select("id", "parts", F.explode_outer(windows).alias("w")).select(
        "id", F.xxhash64("parts").alias("doc"), "w.size", "w.at", F.slice(
            "parts", F.col("w.at") + 1, F.ceil(F.col("w.size") * 3 / 2).cast("int")).alias("window"))
    banded = cut_up.select("id", "doc", "size", "at", "window", F.posexplode_outer(
        bound(F.col("window"), minima)).alias("band", "least"))
    asked = few.select("template", "license", "parts", "size",
                       F.posexplode("minima").alias("band", "least"))
    met = banded.join(F.broadcast(asked), ["size", "band", "least"])
    common = F.array_intersect("window", "parts")  # in the window's order
    matches = (met.withColumn("common", common)
               .withColumn("containment", F.size("common") / F.size("parts"))
               .where(F.col("containment") >= least)
               .select("id", "doc", F.struct(
                   "containment", F.size("parts").alias("n"), "template", "license", "at",
                   (F.col("at") + F.array_position("window", F.get("common", F.lit(0)))).alias("a"),
                   (F.col("at") + F.array_position("window", F.element_at("common", -1))).alias("b"),
               ).alias("m")).groupBy("id", "doc").agg(F.collect_set("m").alias("all")))
    stay = matches.select("id", F.explode(F.filter("all", lambda m: ~F.exists(
        "all", lambda o: _gives_way(m, o)))).alias("m")).select("id", "m.*")
    return stay.groupBy("id", "template", "license").agg(
        F.max("containment").alias("containment"), F.min("at").alias("first_word"),
        F.count_distinct("at").alias("places"))


def _gives_way(m: Column, o: Column) -> Column:
    """Match ``m`` is of another license than ``o``, which is better and covers half of it."""
    better = (o["containment"] > m["containment"]) | (
        (o["containment"] == m["containment"]) & (o["n"] > m["n"]))
    both = F.least(m["b"], o["b"]) - F.greatest(m["a"], o["a"]) + 1
    return (m["license"] != o["license"]) & better & (2 * both >= m["b"] - m["a"] + 1)


def _places(size: int, telling: list[int]) -> Column:
    """Class and beginning of each window of a class in an array of shingles that holds one of the
    ``telling`` ones of the class."""
    starts = F.sequence(F.lit(0), F.size("parts") - 1, F.lit(max(1, size // 2)))
    held = bound(F.array_intersect("parts", F.lit(telling).cast("array<long>")), lambda few: F.filter(
        starts, lambda at: F.arrays_overlap(F.slice("parts", at + 1, _window(size)), few)))
    return F.transform(held, lambda at: F.struct(F.lit(size).alias("size"), at.alias("at")))


def _window(size: int) -> int:
    """Shingles in a window of a class."""
    return -(-size * 3 // 2)


def _hashes(few: DataFrame) -> list[list[list[int]]]:
    """For each template and band, the band's hash of each of its shingles."""
    found = few.select("template", F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda band: F.transform(
            "parts", lambda x: F.xxhash64(x, band))).alias("h")).collect()
    return [r.h for r in sorted(found)]
