"""Licence scan: MinHash bands retrieve templates, exact containment verifies.

Templates are grouped by size: m is the least power of two not below a
template's number of five-word shingles. For each m, a document is cut into windows of 2m shingles that
overlap by half, so any stretch of m shingles lies wholly in one. A template
found to 80 % in a window has a Jaccard similarity above 0.18 with it; with
64 bands of one MinHash the chance to miss it is below (1 - 0.18)^64 < 4 in a million, and
below one in ten million for a whole template. Candidates are kept when the window contains at
least 80 % of the template's distinct shingles.

A window that shares no shingle with any template cannot share a MinHash with one (but
for hash collisions), so windows without any are dropped before the bands are computed.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelsieve.llm.common import computed, whole_text
from labelsieve.storage import join_small

SHINGLE = 5
CONTAINED = 0.8
BANDS = 64
#: Up to so many shingles of templates are compared with documents as a literal.
LITERAL_SHINGLES = 5_000

# Notices by which the licences are commonly applied.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in "
        "all copies or substantial portions of the Software."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
        "License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If "
        "a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer."
    ),
}


def notices(spark: SparkSession) -> DataFrame:
    """The built-in templates: ``license`` and ``text``."""
    return spark.createDataFrame([*NOTICES.items()], "license string, text string")


def shingled(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``all``: hashes of all five-word shingles of ``text`` in order.

    Words are runs of letters and digits, lower-cased.
    """
    words = F.regexp_extract_all(F.lower(whole_text("text")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    starts = F.when(
        F.size("words") >= SHINGLE, F.sequence(F.lit(1), F.size("words") - (SHINGLE - 1))
    ).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, SHINGLE)))
    return computed(computed(df, keep, words=words), keep, all=hashes)


def bands(hashes: Column | str) -> Column:
    """One MinHash for each band, with the band's number hashed in."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(BANDS)),
        lambda j: F.xxhash64(j, F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, j)))),
    )


def prepared(templates: DataFrame) -> DataFrame:
    """``license``, distinct ``parts``, window unit ``m``. Templates under five words match nothing."""
    made = shingled(templates, ["license"]).select("license", F.array_distinct("all").alias("parts"))
    exponent = F.ceil(F.log2(F.size("parts").cast("double")))
    return made.where(F.size("parts") > 0).withColumn("m", F.pow(F.lit(2.0), exponent).cast("int"))


def _windows(hashes: Column, m: int) -> Column:
    """Windows of 2m hashes that start at every m-th one, to the last."""
    last = F.greatest(F.lit(0), F.ceil(F.size(hashes) / m).cast("int") - 2)

    def window(j: Column) -> Column:
        return F.struct(
            F.lit(m).alias("m"),
            (j * m).alias("offset"),
            F.slice(hashes, j * m + 1, F.lit(2 * m)).alias("window"),
        )

    return F.transform(F.sequence(F.lit(0), last), window)


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``license``, ``containment``, ``first_word``, ``last_word``.

    One row for each document and template found; containment is the best of its windows, and the words
    are the first and last (0-based) of the shingles found in any window that qualifies. Null texts
    hold nothing. Rows of one doc_id, or of none, count as one document. Other columns are left out;
    no documents or no templates give no rows.
    """
    known = prepared(templates if templates is not None else notices(docs.sparkSession))
    sizes = sorted(
        r.m for r in known.groupBy("m").count().collect()
    )  # powers of two: at most a few dozen
    total = known.agg(F.coalesce(F.sum(F.size("parts")), F.lit(0)).alias("n")).first().n
    if not sizes:
        known = known.withColumn("m", F.lit(1))
        sizes = [1]
    wanted = None
    if 0 < total <= LITERAL_SHINGLES:
        parts = {h for r in known.select("parts").collect() for h in r.parts}
        wanted = F.array(*[F.lit(h) for h in sorted(parts)])
    hashed = shingled(docs, ["doc_id"]).where(F.size("all") > 0)
    if wanted is not None:
        hashed = hashed.where(F.arrays_overlap("all", wanted))
    cut = F.flatten(F.array(*[_windows(F.col("all"), m) for m in sizes]))
    windows = hashed.select("doc_id", F.explode(cut).alias("w")).select("doc_id", "w.*")
    if wanted is not None:
        windows = windows.where(F.arrays_overlap("window", wanted))
    probes = windows.select("*", F.explode(F.array_distinct(bands("window"))).alias("band"))
    index = known.select("license", "parts", "m", F.explode(F.array_distinct(bands("parts"))).alias("band"))
    candidates = join_small(probes, index, ["m", "band"])
    share = F.size(F.array_intersect("window", "parts")) / F.size("parts")
    found = F.filter(
        F.transform(
            "window",
            lambda x, i: F.when(F.array_contains(F.col("parts"), x), i + F.col("offset")),
        ),
        lambda i: i.isNotNull(),
    )
    return (
        candidates.withColumn("containment", share)
        .where(F.col("containment") >= CONTAINED)
        .withColumn("found", found)
        .groupBy("doc_id", "license")
        .agg(
            F.max("containment").alias("containment"),
            F.min(F.array_min("found")).cast("bigint").alias("first_word"),
            (F.max(F.array_max("found")) + SHINGLE - 1).cast("bigint").alias("last_word"),
        )
    )
