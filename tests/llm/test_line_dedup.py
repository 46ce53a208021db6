"""Line dedup against plain Python, and the store of runs against counting."""

import collections
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowsieve.llm import line_dedup
from flowsieve.session import scratch_path

from .conftest import ODD, SF_DIR

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def key(line):
    return line.strip(line_dedup.BLANKS).translate(LOWER)


def expected(rows, least_chars=line_dedup.LEAST_CHARS, least_docs=line_dedup.LEAST_DOCS):
    """(id, text, lines before, dropped) of (id, text) rows; every row is a document."""
    docs, owner = collections.Counter(), {}
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least_chars:
                docs[k] += 1
                owner[k] = max(owner.get(k, float("-inf")), float("-inf") if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        at = float("-inf") if i is None else i
        stay = [x for x in lines if len(key(x)) < least_chars or docs[key(x)] < least_docs or at == owner[key(x)]]
        out.append((i, None if text is None else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def rows_of(df):
    return collections.Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ABab ÄäİK\n\t\r\x0b\x0c\x1c é", max_size=30), min_size=1, max_size=5))
def test_lines_and_keys(texts):
    import pyarrow as pa

    row, lines = line_dedup._split(pa.array([*texts, None]))
    want = [(k, x) for k, t in enumerate([*texts, ""]) for x in t.split("\n")]
    assert list(zip(row.tolist(), lines.to_pylist(), strict=True)) == want
    assert line_dedup._keys(lines).to_pylist() == [key(x) for _, x in want]


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_small_table(spark, batches):
    long = "A line that is long enough to be looked at by all, no {}"
    rows = [(i, "\n".join(["short", long.format(i % 3), f"  {long.format(i % 7).upper()}\t", long.format("x" * (i % 2)), ""])) for i in range(40)]
    rows += [(None, long.format(0)), (None, "no"), (7, rows[7][1]), (7, rows[7][1]), (39, long.format(0)), (50, None), (51, ""), (52, long.format(2) + "\n" + long.format(2))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(line_dedup.clean(df, batches=batches)) == collections.Counter(expected(rows))
    assert rows_of(line_dedup.clean(df, least_chars=5, least_docs=2, batches=batches)) == collections.Counter(expected(rows, 5, 2))


def test_without_ids(spark):
    rows = [(None, "x" * 50)] * 6
    assert rows_of(line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string"))) == collections.Counter(expected(rows))


def test_store_goes_on_after_a_failure(spark, documents):
    lines = line_dedup.long_lines(documents).withColumn("b", F.pmod("doc", F.lit(5))).cache()
    root = scratch_path(spark, "store")
    for k in range(5):
        store = line_dedup.LineStore(spark, root)  # opened anew for every batch
        store.add(lines.where(F.col("b") == k).drop("b"))
        if k == 2:  # a run that no list names
            line_dedup.LineStore(spark, root)._write(lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("owner"), F.lit(False).alias("hot")), "b")
        assert sum(map(bool, store.levels)) == bin(k + 1).count("1")
    want = {(r.h1, r.h2): (min(r.n, 5), r.owner) for r in lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("owner")).collect()}
    got = {(r.h1, r.h2): (min(r.n, 5), r.owner) for r in line_dedup.LineStore(spark, root).counts().collect()}
    assert got == want


def test_settled_lines_are_not_added_again(spark):
    store = line_dedup.LineStore(spark, scratch_path(spark, "store"))
    first = spark.range(10, 20).selectExpr("id AS doc", "id AS t", "1L AS h1", "2L AS h2")
    store.add(first)
    later = spark.createDataFrame([(3, 1, 1, 2, False), (30, 1, 1, 2, False), (3, 1, 1, 2, True), (3, 1, 5, 2, False), (None, 1, 1, 2, False)], "owner long, n long, h1 long, h2 long, hot boolean")
    assert sorted((r.owner, r.h1, r.hot) for r in store.unsettled(later).collect()) == [(3, 1, True), (3, 5, False), (30, 1, False)]


def test_merge_has_no_shuffle(spark):
    store = line_dedup.LineStore(spark, scratch_path(spark, "store"))
    store.add(spark.range(100).selectExpr("id AS doc", "id AS t", "id % 7 AS h1", "2L AS h2"))
    run = store.runs()[0]
    plan = line_dedup._merged(run, store.runs()[0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_query(spark, texts):
    from hashlib import sha256

    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.op11_line_dedup(spark, SF_DIR).collect()}
    assert got == {i: (n, d, sha256((t or "").encode()).hexdigest()) for i, t, n, d in expected(sorted(texts.items()))}


def test_odd_rows(odd, clashing):
    for df in (odd, clashing.withColumn("_lost", F.lit(1)).withColumn("n_lines", F.lit("x"))):
        out = line_dedup.clean(df)
        assert rows_of(out) == collections.Counter(expected([(i, t) for i, t, *_ in ODD]))
        assert set(df.columns) <= set(out.columns)
    assert line_dedup.clean(odd.limit(0)).count() == 0
