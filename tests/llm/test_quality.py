"""Plain rules against Python, the score against counters, on given and odd rows."""

import collections
import math
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from flowsieve.llm import quality
from flowsieve.session import scratch_path

from .conftest import ODD, SF_DIR


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed


def row_of(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def bucket(*words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return (h - (1 << 64) if h >> 63 else h) % quality.BUCKETS


def grams(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    return [bucket(w) for w in words] + [bucket(*words[i : i + 2]) for i in range(len(words))]


def test_query(spark, texts):
    rows = quality.op5_quality_rules(spark, SF_DIR).collect()
    assert len(rows) == len(texts) and all(row_of(r) == brute(texts[r.doc_id]) for r in rows)
    good = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 1").collect()}
    raw, trusted = collections.Counter(), collections.Counter()
    for i, t in texts.items():
        raw.update(grams(t))
        if i in good:
            trusted.update(grams(t))
    all_raw, all_good = sum(raw.values()) + quality.BUCKETS, sum(trusted.values()) + quality.BUCKETS
    ratio = [math.log((trusted[b] + 1) / all_good) - math.log((raw[b] + 1) / all_raw) for b in range(quality.BUCKETS)]
    for r in rows:
        want = sum(ratio[b] for b in grams(texts[r.doc_id])) / max(1, 2 * r.n_words)
        assert abs(r.score - want) < 1e-9 and r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_plan_has_no_python(spark):
    plan = quality.op5_quality_rules(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows(spark, clashing):
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (None, 1, None), (7, None, 1)], "doc_id long, quality int, toxic int")
    more = [("a b c a b c a b",), ("x\n\nx\n \nx",), (("w " * 49) + "w",), ("one two",)]
    extra = spark.createDataFrame(more, "text string").select(F.lit(99).cast("long").alias("doc_id"), "text")
    df = clashing.unionByName(extra, allowMissingColumns=True)
    out = quality.judge(df, labels)
    got = sorted(((str(r.doc_id), row_of(r)) for r in out.collect()))
    assert got == sorted((str(i), brute(t)) for i, t in [*((i, t) for i, t, *_ in ODD), *((99, t) for (t,) in more)])
    assert quality.judge(df.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("sf, most", [("sf0.01", 0.08), ("sf0.1", 0.0)])
def test_threshold_separates_labels(spark, sf, most):
    """The same rule must part labelled documents on a small and a large table."""
    sf_dir = SF_DIR.replace("sf0.001", sf)
    rows = quality.op5_quality_rules(spark, sf_dir).where("NOT base_failed")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    share = dict(rows.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect())
    assert share[1] >= 0.98 and share[0] <= most


def test_held_score_leaves_own_counts_out(spark, texts):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 1").select("doc_id")
    one, *_ = sorted(r.doc_id for r in good.collect() if len((texts[r.doc_id] or "").split()) >= 50)

    def scored(trusted, name):
        sample, where = quality.trusted_sample(trusted), scratch_path(spark, name)
        quality.log_ratios(df, sample).write.parquet(where)
        return quality.rules(df, spark.read.parquet(where), sample).where(F.col("doc_id") == one).first()

    with_it, without = scored(good, "with"), scored(good.where(F.col("doc_id") != one), "without")
    assert with_it.score > without.score == without._q_held and abs(with_it._q_held - without.score) < 1e-9
