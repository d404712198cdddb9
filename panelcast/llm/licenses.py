"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Every line of a whole file that holds a licence cue is a notice; files named like licence files
are also compared as a whole. Term weights use document frequencies over all files; the terms
of the templates are a fixed, small vocabulary, and any other term weighs like one that no
file holds. A file's own licence is the template with the highest cosine, if that is at least
``LEAST``. A licence file also licenses its directory, and files without a licence of their
own take that of the nearest directory above them.

Defined results: null and empty texts have no notices; equal cosines go to the licence that
sorts first; of several licence files in a directory the best match counts, then the name;
rows with equal paths are one file; rows without path are files without directory, one per
text; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save

LEAST = 0.6
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
CUE = r"(?i)licen[cs]e|copyright|spdx|all rights reserved|permission is hereby granted|public domain|creative commons"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|copyright|notice|unlicense)([._-].*)?$"

# Notices by which licences ask to be named.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License, CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License, CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
]


def terms_of(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def vocabulary() -> list[str]:
    return sorted({t for _, text in TEMPLATES for t in terms_of(text)})


def inverse_frequencies(files: DataFrame) -> tuple[dict[str, float], float]:
    """Weights of the templates' terms over the whole texts of all files, and that of unseen terms.

    The result has one row per template term, whatever the corpus holds; files are counted per
    task before the shuffle.
    """
    words = F.array(*map(F.lit, vocabulary()))
    found = F.array_intersect(F.array_distinct(F.split(F.lower("text"), r"[^a-z0-9.]+")), words)
    # A term with a full stop after it (``2.0.``) is cut differently by a split, so it is looked up both ways.
    bare = F.array_intersect(F.array_distinct(F.split(F.lower("text"), r"\.?[^a-z0-9.]+|\.$")), words)
    rows = files.select(F.explode(F.array_union(found, bare)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = files.count()
    counts = {r["term"]: r["n"] for r in rows.collect()}
    weight = lambda n: math.log((1 + total) / (1 + n)) + 1
    return {t: weight(counts.get(t, 0)) for t in vocabulary()}, weight(0)


def template_vectors(idf: dict[str, float]) -> list[tuple[int, str, str, float]]:
    """``template, licence, term, weight`` with unit length per template."""
    out = []
    for number, (name, text) in enumerate(TEMPLATES):
        found = terms_of(text)
        raw = {t: (1 + math.log(found.count(t))) * idf[t] for t in sorted(set(found))}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        out += [(number, name, t, w / norm) for t, w in raw.items()]
    return out


def notices(files: DataFrame) -> DataFrame:
    """``path, part, notice``: lines with a cue, and licence files as a whole (part -1)."""
    lines = files.where(F.col("text").rlike(CUE)).select("path", F.posexplode(F.split("text", "\n")).alias("part", "notice")).where(F.col("notice").rlike(CUE))
    whole = files.where(_is_license_file()).select("path", F.lit(-1).alias("part"), F.col("text").alias("notice"))
    return lines.unionByName(whole)


def _name(path: str = "path") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _folder(path: str = "path") -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _is_license_file() -> Column:
    return F.coalesce(_name().rlike(LICENSE_FILE), F.lit(False))


def own_licenses(files: DataFrame, least: float = LEAST) -> DataFrame:
    """``path, license, score`` of files with a notice that matches."""
    spark: SparkSession = files.sparkSession
    idf, unseen = inverse_frequencies(files)
    vectors = spark.createDataFrame(template_vectors(idf), "template int, license string, term string, share double")
    weights = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    rows = save(notices(files))
    counted = rows.select("path", "part", F.explode(terms(F.col("notice"))).alias("term")).groupBy("path", "part", "term").agg(F.count(F.lit(1)).alias("n"))
    weighed = counted.join(F.broadcast(weights), "term", "left").withColumn("weight", (1 + F.log("n")) * F.coalesce("idf", F.lit(unseen)))
    norms = weighed.groupBy("path", "part").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = weighed.join(F.broadcast(vectors), "term").groupBy("path", "part", "template", "license").agg(F.sum(F.col("weight") * F.col("share")).alias("dot"))
    scored = dots.join(norms, ["path", "part"]).select("path", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("order"), "license")).alias("best"))
    return best.select("path", F.col("best.license").alias("license"), (-F.col("best.order")).alias("score"))


def nearest_licenses(folders: DataFrame, licensed: DataFrame) -> DataFrame:
    """``folder, from_folder, license`` of the nearest licensed directory at or above each folder.

    Each distinct folder is spread over the directories above it, as many as its path is deep,
    and joined by equality.
    """
    steps = F.split("folder", "/")
    above = folders.select("folder", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth"))
    above = above.where((F.col("depth") > 0) | (F.col("folder") != "")).withColumn("at", F.array_join(F.slice(F.split("folder", "/"), 1, F.col("depth")), "/"))
    found = above.join(licensed.withColumnRenamed("folder", "at"), "at")
    best = found.groupBy("folder").agg(F.max(F.struct("depth", "at", "license", "score")).alias("best"))
    return best.select("folder", F.col("best.at").alias("from_folder"), F.col("best.license").alias("near_license"), F.col("best.score").alias("near_score"))


UNNAMED = "\0unnamed:"  # stands for a null path, with the text's hash: such files have no directory


def scan_licenses(files: DataFrame, least: float = LEAST) -> DataFrame:
    """``path, license, score, origin, from_folder`` of every file; origin is own, inherited or none."""
    unnamed = F.concat(F.lit(UNNAMED), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    files = files.select(F.coalesce(F.col("path").cast("string"), unnamed).alias("path"), F.col("text").cast("string").alias("text"))
    own = save(own_licenses(files, least))
    licensed = own.where(_is_license_file()).groupBy(_folder().alias("folder")).agg(F.min(F.struct((-F.col("score")).alias("order"), _name().alias("name"), "license")).alias("best"))
    licensed = licensed.select("folder", F.col("best.license").alias("license"), (-F.col("best.order")).alias("score"))
    paths = files.select("path").distinct().withColumn("folder", F.when(~F.col("path").startswith(UNNAMED), _folder()))
    near = nearest_licenses(paths.where("folder is not null").select("folder").distinct(), licensed)
    both = paths.join(own, "path", "left").join(near, "folder", "left")
    mine = F.col("license").isNotNull()
    return both.select(
        F.when(~F.col("path").startswith(UNNAMED), F.col("path")).alias("path"), F.coalesce("license", "near_license").alias("license"), F.coalesce("score", "near_score").alias("score"),
        F.when(mine, "own").when(F.col("near_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("from_folder")).alias("from_folder"),
    )
