"""Suffix sorting and removal of repeats against plain counting of all windows."""

import collections
import random
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowsieve.llm import suffix_dedup as dedup
from flowsieve.llm.suffix_sort import suffix_array

from .conftest import ODD, SF_DIR


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(symbols):
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def windows(texts):
    found = collections.defaultdict(set)
    for k, t in enumerate(texts):
        for i in range(len(t) - dedup.LENGTH + 1):
            found[t[i : i + dedup.LENGTH]].add((k, i))
    return found


def brute(texts):
    """(bytes, removed, spans, kept) of each text."""
    gone = [bytearray(len(t)) for t in texts]
    for places in windows(texts).values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + dedup.LENGTH] = b"\1" * dedup.LENGTH
    return [(len(t), sum(g), len([p for p in bytes(g).split(b"\0") if p]), bytes(b for b, x in zip(t, g, strict=True) if not x)) for t, g in zip(texts, gone, strict=True)]


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcdefgh thein."])
def test_repeats_of_contexts(alphabet):
    draw = random.Random(len(alphabet))
    make = lambda n: bytes(draw.choice(alphabet) for _ in range(n))
    for _ in range(25):
        shared, texts = [make(draw.randrange(380, 700)) for _ in range(3)], []
        for _ in range(draw.randrange(1, 6)):
            t = make(draw.randrange(300))
            for _ in range(draw.randrange(3)):
                t += draw.choice(shared)[draw.randrange(60) :] + make(draw.randrange(50))
            texts.append(t)
        first, last = dedup.repeats(texts, np.arange(len(texts), dtype=np.int64) * 1_000_000)
        found = windows(texts)
        for k in range(len(texts)):
            starts = [i for places in found.values() if len(places) > 1 for x, i in places if x == k]
            assert (first[k], last[k]) == ((min(starts), max(starts)) if starts else (-1, -1))


def rows_of(df, **options):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup.without_repeats(df, **options).collect())


@pytest.mark.parametrize("crowd", [1, dedup.CROWD])
def test_odd_rows_and_overlaps(spark, odd, texts, crowd):
    whole = [t for t in texts.values() if t and len(t) > 900][:2]
    more = [(20, "ab" * 600), (21, "x" * 399), (22, "x" * 400), (23, "é" * 500), (23, "é" * 500), (None, whole[0]), (25, whole[0] + "z"), (26, whole[0][50:] + "q"), (27, "pre" + whole[0][:700] + "post" + whole[1][:500]), (28, whole[1]), (29, "y" * 3000)]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    pairs = [(i, t) for i, t, *_ in ODD] + more
    want = brute([(t or "").encode() for _, t in pairs])
    assert rows_of(df, crowd=crowd) == sorted((str(i), *w) for (i, _), w in zip(pairs, want, strict=True))


def test_long_text_has_the_same_anchors_across_parts(monkeypatch):
    draw = random.Random(5)
    data = bytes(draw.choice(b"abcd ") for _ in range(9000))
    whole = dedup.anchors(data)
    monkeypatch.setattr(dedup, "PART", 1000)
    assert [x.tolist() for x in dedup.anchors(data)] == [x.tolist() for x in whole]


def test_query_and_empty_table(spark, odd, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup.op2_suffix_dedup(spark, SF_DIR).collect()}
    want = brute([(t or "").encode() for t in texts.values()])
    assert got == {i: (*w[:3], sha256(w[3]).hexdigest()) for i, w in zip(texts, want, strict=True)}
    assert dedup.without_repeats(odd.limit(0)).count() == 0
    assert dedup.without_repeats(odd.select("*", F.lit(1).alias("d"), F.lit(2).alias("id"), F.lit(3).alias("spans"))).count() == len(ODD)
