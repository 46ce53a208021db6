"""Operator 6, licence scan: sparse TF-IDF cosine to templates, then nearest-ancestor inheritance.

A file's lines, its header (the first HEADER_LINES lines together) and windows of words are compared with
the templates as TF-IDF vectors; a window has a template's length and lies, whatever line breaks and
other words stand around it, where a telling word of the text has its place in the template.
The weights come from the templates, and a word of none of them has the largest.
The best unit from LEAST_COSINE on gives the file its licence. Only units that hold a telling word are
compared: a template's other words together are less than LEAST_COSINE of its length, so by the
Cauchy-Schwarz inequality no other unit can reach it.

A file that is little more than its notice is a licence file of its directory. A file without a
licence of its own inherits that of the nearest directory above it that has one: directories, not
files, are expanded to their ancestors, and files are joined to their directory's answer.

Only DataFrame functions; texts are compared in the row that holds them and never shuffled.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import table
from flowsieve.session import scratch_path

# Short notices by licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Distributed under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "CC0 1.0 Universal Public Domain Dedication.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# Words too frequent in any text to be looked for unless nothing else is left.
COMMON = frozenset("a an and are as for form has have in into is it of or on that the this to under who with without work 2.0 3 4.0 v.".split())
LEAST_COSINE = 0.7
HEADER_LINES = 3
#: A file of at most so many words beside its notice is a licence file.
LICENCE_FILE_WORDS = 40
NONE = "none"
#: Words of a form that windows are laid on.
FORM_WORDS = 3
# Further forms by licence: a text, and the words of the whole licence that it is the telling part of.
FORMS: dict[str, list[tuple[str, int]]] = {
    "Apache-2.0": [
        ("SPDX-License-Identifier: Apache-2.0", 0),
        ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", 85),
        ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", 1700),
    ],
    "BSD-3-Clause": [
        ("SPDX-License-Identifier: BSD-3-Clause", 0),
        ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", 240),
    ],
    "CC-BY-4.0": [("SPDX-License-Identifier: CC-BY-4.0", 0), ("Creative Commons Attribution 4.0 International Public License", 3000)],
    "CC-BY-NC-4.0": [("SPDX-License-Identifier: CC-BY-NC-4.0", 0), ("Creative Commons Attribution-NonCommercial 4.0 International Public License", 3100)],
    "CC0-1.0": [
        ("SPDX-License-Identifier: CC0-1.0", 0),
        ("The person who associated a work with this deed has dedicated the work to the public domain", 120),
        ("Creative Commons Legal Code CC0 1.0 Universal", 1100),
    ],
    "GPL-3.0": [
        ("SPDX-License-Identifier: GPL-3.0-only", 0),
        ("SPDX-License-Identifier: GPL-3.0-or-later", 0),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", 120),
        ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.", 5800),
    ],
    "LGPL-3.0": [
        ("SPDX-License-Identifier: LGPL-3.0-only", 0),
        ("SPDX-License-Identifier: LGPL-3.0-or-later", 0),
        ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", 120),
        ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.", 1300),
    ],
    "MIT": [
        ("SPDX-License-Identifier: MIT", 0),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction,", 180),
    ],
    "MPL-2.0": [("SPDX-License-Identifier: MPL-2.0", 0), ("Mozilla Public License Version 2.0 1. Definitions", 2700)],
    "Unlicense": [
        ("SPDX-License-Identifier: Unlicense", 0),
        ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", 220),
    ],
}

_TOKEN = "[a-z0-9.-]*[a-z0-9]"


def _tokens(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def _vectors(templates: dict[str, str]) -> tuple[dict[str, float], float, dict[str, dict[str, float]], list[str]]:
    """Weights of words, the weight of any other word, unit vectors of the templates, and telling words."""
    df = Counter(w for text in templates.values() for w in set(_tokens(text)))
    n = len(templates)
    idf = {w: math.log((n + 1) / (k + 1)) + 1 for w, k in df.items()}
    units, telling = {}, set()
    for name, text in templates.items():
        raw = {w: k * idf[w] for w, k in Counter(_tokens(text)).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        units[name] = {w: x / norm for w, x in raw.items()}
        rest = 1.0
        for w in sorted(raw, key=lambda w: (w in COMMON, df[w], w)):
            if rest < LEAST_COSINE**2 * 0.99:
                break
            telling.add(w)
            rest -= units[name][w] ** 2
    return idf, math.log(n + 1) + 1, units, sorted(telling)


def _literal(value, kind: str) -> Column:
    """A bounded constant as one expression, which the optimizer folds into a literal."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _windows(templates: dict[str, str], forms: dict[str, list[tuple[str, int]]]) -> tuple[dict[str, float], list[dict], dict[str, list[dict]], list[str]]:
    """Weights, the templates and forms with their vectors, of each telling word its places in them, and these words."""
    texts = {(name, k): (text, whole) for name in sorted(templates) for k, (text, whole) in enumerate([(templates[name], 0), *forms.get(name, ())])}
    idf, _, units, _ = _vectors({key: text for key, (text, _) in texts.items()})
    notices = set(_vectors(templates)[3])
    names, listed, anchors = sorted(templates), [], {}
    for k, (key, (text, whole)) in enumerate(texts.items()):
        words = _tokens(text)
        listed.append({"place": -names.index(key[0]), "whole": max(whole, len(words)), "v": units[key]})
        # Forms are long, and many of their words are frequent: the rarest of them have to do.
        rarest = sorted(set(words) - COMMON, key=lambda w: (-idf[w], -len(w), w))[:FORM_WORDS]
        for w in rarest if key[1] else sorted(set(words) & notices):
            anchors.setdefault(w, []).append({"k": k + 1, "o": words.index(w), "n": len(words)})
    return idf, listed, anchors, sorted(anchors)


def detect(df: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """df without its text, with own_license, cosine and is_license_file.

    No template reaches LEAST_COSINE, a null or an empty text: `none`, 0, false. Equal cosines: the
    first licence by name. Columns of these names, and those that begin with _l_, are replaced.
    """
    idf, other, units, telling = _vectors(TEMPLATES if templates is None else templates)
    new = ("own_license", "cosine", "is_license_file")
    kept = [c for c in df.columns if c.lower() not in (*new, text_col.lower()) and not c.lower().startswith("_l_")]
    names = sorted(units)
    word = "(?i)(?<![a-z0-9.-])(" + "|".join(re.escape(w) for w in telling) + ")(?![a-z0-9])"
    idfs = _literal(idf, "map<string,double>")
    vectors = _literal([{"place": -k, "v": units[n]} for k, n in enumerate(names)], "array<struct<place:int,v:map<string,double>>>")
    w_idf, w_listed, w_anchors, w_telling = _windows(TEMPLATES if templates is None else templates, FORMS if templates is None else {})
    w_word = "(?i)(?<![a-z0-9.-])(" + "|".join(re.escape(w) for w in w_telling) + ")(?![a-z0-9])"
    w_idfs = _literal(w_idf, "map<string,double>")
    w_vectors = _literal(w_listed, "array<struct<place:int,whole:int,v:map<string,double>>>")
    anchors = _literal(w_anchors, "map<string,array<struct<k:int,o:int,n:int>>>")
    d = df.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("_l_text"))
    lines = F.split("_l_text", "\n", -1)
    units_in = F.filter(F.concat(lines, F.array(F.array_join(F.slice(lines, 1, HEADER_LINES), " "))), lambda x: x.rlike(word))
    d = d.withColumn("_l_units", F.when(F.col("_l_text").rlike(word), units_in).otherwise(F.array().cast("array<string>")))
    words_of = lambda u: F.regexp_extract_all(F.lower(u), F.lit(f"({_TOKEN})"), F.lit(1))
    d = d.withColumn("_l_tokens", F.transform("_l_units", words_of))
    d = d.withColumn("_l_all", F.when(F.col("_l_text").rlike(w_word), words_of(F.col("_l_text"))).otherwise(F.array().cast("array<string>")))
    told = F.filter(F.transform("_l_all", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda e: F.map_contains_key(anchors, e["w"]))
    window = lambda e, a: F.struct(a["k"].alias("k"), F.slice("_l_all", F.greatest(F.lit(1), e["i"] - a["o"] + 1), a["n"]).alias("ts"))
    d = d.withColumn("_l_windows", F.array_distinct(F.flatten(F.transform(told, lambda e: F.transform(F.element_at(anchors, e["w"]), lambda a: window(e, a))))))
    weight = lambda ts, w, of: F.size(F.filter(ts, lambda x: x == w)) * F.coalesce(F.element_at(of, w), F.lit(other))
    vector = lambda ts, of: F.transform(F.array_distinct(ts), lambda w: F.struct(w.alias("w"), weight(ts, w, of).alias("x")))
    d = d.withColumn("_l_vectors", F.transform("_l_tokens", lambda ts: F.struct(F.size(ts).alias("n"), vector(ts, idfs).alias("v"))))
    d = d.withColumn("_l_windows", F.transform("_l_windows", lambda x: F.struct(F.element_at(w_vectors, x["k"]).alias("t"), vector(x["ts"], w_idfs).alias("v"))))
    total = lambda v, of: F.aggregate(v, F.lit(0.0), lambda a, e: a + of(e))
    cosine = lambda u, t: total(u["v"], lambda e: e["x"] * F.coalesce(F.element_at(t["v"], e["w"]), F.lit(0.0))) / F.sqrt(total(u["v"], lambda e: e["x"] * e["x"]))
    # Of equal cosines the largest place is the first name.
    best = F.transform("_l_vectors", lambda u: F.array_max(F.transform(vectors, lambda t: F.struct(F.round(cosine(u, t), 9).alias("cosine"), t["place"].alias("place"), u["n"].alias("words")))))
    near = F.transform("_l_windows", lambda u: F.struct(F.round(cosine(u, u["t"]), 9).alias("cosine"), u["t"]["place"].alias("place"), u["t"]["whole"].alias("words")))
    d = d.withColumn("_l_best", F.array_max(F.concat(best, near)))
    enough = F.coalesce(F.col("_l_best.cosine") >= LEAST_COSINE, F.lit(False))
    words = F.size(F.array_remove(F.split("_l_text", "[\\x20\\x09-\\x0D]+"), ""))
    d = d.withColumn("_l_enough", enough)
    return d.select(
        *kept,
        F.when(F.col("_l_enough"), F.element_at(F.array(*map(F.lit, names)), 1 - F.col("_l_best.place"))).otherwise(NONE).alias("own_license"),
        F.when(F.col("_l_enough"), F.col("_l_best.cosine")).otherwise(0.0).alias("cosine"),
        (F.col("_l_enough") & (F.when(F.col("_l_enough"), words).otherwise(0) <= F.col("_l_best.words") + LICENCE_FILE_WORDS)).alias("is_license_file"),
    )


def inherit(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Rows of detect() with license, origin (own, inherited or none) and license_path.

    Paths have `/` between their parts; a file's directories run from its own up to the root, which
    is empty. A directory's licence is that of its licence file with the largest cosine, then the
    smallest path. Files without a path are in no directory and inherit nothing. Rows stay as many.
    """
    directory = F.regexp_replace(F.col(path_col), "/?[^/]*$", "")
    rows = files.withColumn("_l_dir", directory)
    licensed = rows.where(F.col("is_license_file") & F.col(path_col).isNotNull())
    owners = licensed.select("_l_dir", "cosine", "own_license", F.col(path_col).alias("p")).groupBy("_l_dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "p", "own_license")).alias("o")).select(F.col("_l_dir").alias("up"), "o.own_license", "o.p")
    parts = F.split("_l_dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct((F.size(parts) - k).alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("up")))
    places = rows.where(F.col(path_col).isNotNull()).select("_l_dir").distinct().select("_l_dir", F.inline(ups))
    nearest = places.join(owners, "up").groupBy("_l_dir").agg(F.min(F.struct("depth", "p", "own_license")).alias("n")).select(F.col("_l_dir").alias("_l_for"), F.col("n.own_license").alias("_l_license"), F.col("n.p").alias("_l_path"))
    joined = rows.join(nearest, F.col("_l_dir") == F.col("_l_for"), "left")
    own = F.col("own_license") != NONE
    return joined.select(
        *(c for c in files.columns if c.lower() not in ("license", "origin", "license_path")),
        F.when(own, F.col("own_license")).otherwise(F.coalesce("_l_license", F.lit(NONE))).alias("license"),
        F.when(own, "own").when(F.col("_l_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(own, F.col(path_col)).otherwise(F.col("_l_path")).alias("license_path"),
    )


def scan(df: DataFrame, text_col: str = "text", path_col: str = "path", templates: dict[str, str] | None = None) -> DataFrame:
    """detect(), written once without the texts, then inherit(): as many rows as df, which may be empty."""
    where = scratch_path(df.sparkSession, "licences")
    detect(df, text_col, templates).write.parquet(where)
    return inherit(df.sparkSession.read.parquet(where), path_col)


def op6_license_scan(spark, sf_dir) -> DataFrame:
    """Documents as files /source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return scan(docs.select("doc_id", path.alias("path"), "text"))
