"""License scans: MinHash bands over overlapping windows, then exact containment.

Words are lower-cased (A-Z), without the signs in DROPPED, and split at ASCII white
space.  A template of n words is looked for in windows of twice its stride, the least
power of two that is at least 4/3 n; windows start at every multiple of the stride, so
each stretch of up to stride + 1 words lies whole in one of them.

A match needs a shared shingle, so windows that hold none of any template's are never
built: every shingle of every text is looked up first.  A window has BANDS MinHash
values of one row each.  A template of t shingles in a window of s, contained to at
least 0.75, has Jaccard similarity of at least 0.75 t / (s + 0.25 t), which is at
least 1/12 for the shortest template, so a band agrees with probability
1 - (11/12) ** 128 = 0.99998 or more.  Candidates are verified by exact containment.

Null or short text (under 5 words): no match; templates under 5 words match nothing.
Repeated documents count once (doc_id is a key), a null doc_id not at all.  Empty
tables: no rows.  Other columns are not touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.anchors import LOWER, SHINGLE, UPPER, hits, small, with_shingles

CONTAINMENT = 0.75
BANDS = 128
DROPPED = ".,;:!?\"'()[]{}<>*#$%&|"

# Customary short notices of public licenses.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
                   "in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            'associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def notices(spark: SparkSession) -> DataFrame:
    """The built-in templates: (template_id, license, text)."""
    rows = [(i, name, text) for i, (name, text) in enumerate(NOTICES)]
    return spark.createDataFrame(rows, "template_id long, license string, text string")


def _text() -> Column:
    return F.translate("text", UPPER + DROPPED, LOWER)


def signature(shingles: Column) -> Column:
    """The BANDS minima of a set's hashes as (band, value)."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(
        i.alias("band"), F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, i))).alias("value")))


def scan(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, template_id, license, containment, first_word): for each document and
    template the best window, the first of equals."""
    stride = F.pow(F.lit(2), F.ceil(F.log2(F.col("n_words") * 4 / 3 - 1e-9))).cast("int")
    known = with_shingles(templates.filter("template_id is not null"), _text(), ["template_id", "license"]).filter(
        f"n_words >= {SHINGLE}").withColumn("stride", stride)
    spread = known.select("stride", F.explode_outer("shingles").alias("hash")).distinct()
    met = hits(docs, spread, _text()).select("doc_id", "stride", F.expr("pos div stride").alias("k"))
    met = met.select("doc_id", "stride", F.explode(F.array("k", F.col("k") - 1)).alias("k")).filter("k >= 0").distinct()
    wanted = met.groupBy("doc_id").agg(F.collect_set(F.struct("stride", F.col("k").cast("int").alias("k"))).alias("windows"))
    texts = with_shingles(docs.select("doc_id", "text").join(wanted, "doc_id"), _text(), ["doc_id", "windows"])
    cut = texts.select("doc_id", "shingles", F.explode("windows").alias("w")).select(
        "doc_id", F.col("w.stride").alias("stride"), (F.col("w.k") * F.col("w.stride")).alias("start"), "shingles").select(
        "doc_id", "stride", "start",
        F.array_distinct(F.slice("shingles", F.col("start") + 1, 2 * F.col("stride") - (SHINGLE - 1))).alias("held")
    ).dropDuplicates(["doc_id", "stride", "start"])
    left = cut.select("doc_id", "stride", "start", "held", F.explode_outer(signature(F.col("held"))).alias("s")).select(
        "doc_id", "stride", "start", "held", "s.*")
    sets = known.select("template_id", "license", "stride", F.array_distinct("shingles").alias("whole"))
    right = sets.select("template_id", "license", "stride", "whole", F.explode_outer(signature(F.col("whole"))).alias("s")).select(
        "template_id", "license", "stride", "whole", "s.*")
    share = F.size(F.array_intersect("held", "whole")).cast("double") / F.size("whole").cast("double")
    pairs = left.join(F.broadcast(right) if small(right) else right, ["stride", "band", "value"])
    return (pairs.withColumn("containment", share).filter(F.col("containment") >= containment)
            .groupBy("doc_id", "template_id", "license")
            .agg(F.max(F.struct("containment", (-F.col("start")).alias("back"))).alias("best"))
            .select("doc_id", "template_id", "license", "best.containment", (-F.col("best.back")).cast("long").alias("first_word")))
