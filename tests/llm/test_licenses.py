"""Cosines and inheritance against plain Python."""

import collections
import math

from pyspark.sql import functions as F

from flowsieve.llm import licenses

from .conftest import ODD, SF_DIR

IDF, OTHER, UNITS, TELLING = licenses._vectors(licenses.TEMPLATES)


def best(text):
    """The first licence with the largest cosine over all lines and the header."""
    lines, found = (text or "").split("\n"), []
    for unit in [*lines, " ".join(lines[: licenses.HEADER_LINES])]:
        tf = collections.Counter(licenses._tokens(unit))
        v = {w: n * IDF.get(w, OTHER) for w, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        found += [(-round(sum(x * u.get(w, 0) for w, x in v.items()) / norm, 9), name) for name, u in UNITS.items()]
    cosine, name = min(found)
    return (name, -cosine) if -cosine >= licenses.LEAST_COSINE else (licenses.NONE, 0.0)


def nearest(rows):
    """(license, origin, license_path) of each row, by walking up from its directory."""
    owners = collections.defaultdict(list)
    for r in rows:
        if r.is_license_file and r.path is not None:
            owners[r.path.rpartition("/")[0]].append((-r.cosine, r.path, r.own_license))
    for r in rows:
        if r.own_license != licenses.NONE:
            yield r.own_license, "own", r.path
            continue
        at, found = r.path.rpartition("/")[0] if r.path is not None else None, None
        while at is not None and not found:
            found = min(owners[at]) if owners.get(at) else None
            at = at.rpartition("/")[0] if at else None
        yield (found[2], "inherited", found[1]) if found else (licenses.NONE, "none", None)


def test_templates_find_themselves(spark):
    df = spark.createDataFrame([(n, t) for n, t in licenses.TEMPLATES.items()], "name string, text string")
    assert all(r.own_license == r.name and r.cosine > 0.999 for r in licenses.detect(df).collect())


def test_query(spark, texts):
    rows = licenses.op6_license_scan(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r, want in zip(rows, nearest(rows), strict=True):
        name, cosine = best(texts[r.doc_id])
        assert r.own_license == name and abs(r.cosine - cosine) < 1e-6
        assert (r.license, r.origin, r.license_path) == want


def test_tree(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    long = "\n".join(["word " * 30] * 5)
    files = [("LICENSE", mit), ("a/x.py", long), ("a/b/COPYING", gpl), ("a/b/c/d/y.py", long), ("a/b/z.py", long + "\n" + mit), (None, long), ("top.py", None), ("a/b/COPYING", gpl), ("q/B", gpl), ("q/A", gpl), ("q/f", "")]
    rows = licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()
    assert len(rows) == len(files)
    got = collections.Counter((r.path, r.license, r.origin, r.license_path) for r in rows)
    assert got == collections.Counter((r.path, *w) for r, w in zip(rows, nearest(rows), strict=True))
    assert got["a/b/c/d/y.py", "GPL-3.0", "inherited", "a/b/COPYING"] == got["a/x.py", "MIT", "inherited", "LICENSE"] == 1
    assert got["q/f", "GPL-3.0", "inherited", "q/A"] == got[None, "none", "none", None] == 1


def test_odd_rows(clashing):
    df = clashing.withColumn("path", F.concat(F.lit("p/"), F.col("doc_id").cast("string"))).withColumn("license_path", F.lit(1))
    assert licenses.scan(df).count() == len(ODD) and licenses.scan(df.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    plan = licenses.op6_license_scan(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_notice_among_other_words(spark):
    prose = "Some words that say nothing of this come first. " * 3
    texts = {
        "a": ("Copyright 2024 Example Corp. Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        "b": (prose + "Released under the MIT License.", "MIT"),
        "c": ("#!/bin/sh\n# A tool.\n#\n# This work is licensed\n# under the GNU General\n# Public License,\n# version 3.\n" + prose, "GPL-3.0"),
        "d": (prose + "The licence of this was released.", "none"),
    }
    df = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "name string, text string")
    assert {r.name: r.own_license for r in licenses.detect(df).collect()} == {k: want for k, (_, want) in texts.items()}


def test_forms_and_licence_files(spark):
    forms = [(f"{n}/{k}/LICENSE", f"Some Tool\n\n{text}\n") for n, found in licenses.FORMS.items() for k, (text, _) in enumerate(found)]
    mit = licenses.FORMS["MIT"][1][0] + " and that is followed by the rest of it" * 14
    # The head of the licence file, laid out as published, and as many other words as the rest of it has.
    gpl = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
""" + "\n".join(["these words stand for the rest of its terms and conditions here"] * 460)
    files = [*forms, ("mit/LICENSE", mit), ("mit/src/x.py", "word " * 200), ("gpl/COPYING", gpl), ("gpl/src/y.py", "word " * 200)]
    rows = {r.path: r for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {p: rows[p].own_license for p, _ in forms} == {p: p.split("/")[0] for p, _ in forms}
    assert (rows["mit/src/x.py"].license, rows["mit/src/x.py"].origin) == ("MIT", "inherited")
    assert (rows["gpl/src/y.py"].license, rows["gpl/src/y.py"].origin) == ("GPL-3.0", "inherited")
