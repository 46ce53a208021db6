"""Matches with edits against the full edit-distance table."""

import random
import re

import pytest

from flowsieve.llm import decontaminate as decon

from .conftest import ODD, SF_DIR


def canon(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower())


def fewest_edits(item, text):
    """Of the item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


PARTS = ["the", "an", "on", "er", "in", "th", "ea", "ou", "st", " ", " ", ". ", "Ti", ", "]


def test_random_texts_with_edits():
    draw, found = random.Random(5), 0
    make = lambda n: "".join(draw.choice(PARTS) for _ in range(n))
    for _ in range(12):
        items = [(k, make(draw.randrange(8, 60))) for k in range(5)]
        texts = [None, ""]
        for _ in range(8):
            part = list(draw.choice(items)[1])
            for _ in range(draw.randrange(7)):
                at = draw.randrange(len(part))
                part[at : at + draw.choice([0, 1])] = draw.choice(["x", "", "ae"])
            texts.append(f"{make(draw.randrange(60))} {''.join(part)} {make(draw.randrange(30))}")
        got = {}
        for t, item, start, end, edits in decon.search(decon.build(items), texts):
            got[t, item] = min(edits, got.get((t, item), 99))
            assert 0 <= start < end <= len(texts[t])
        for t, text in enumerate(texts):
            for k, item in items:
                item = canon(item).strip()
                least = fewest_edits(item, canon(text))
                want = least if len(item) >= decon.LEAST_CHARS and least <= int(decon.RATE * len(item)) else None
                found += want is not None
                assert got.get((t, k)) == want
    assert found > 20


def test_spans_are_the_passage():
    item = "The quick brown fox jumps over the lazy dog, again and again"
    text = "é« Start: " + item.upper().replace(" ", "\n") + " » end"
    assert decon.search(decon.build([(7, item)]), ["none", text]) == [(1, 7, 10, 10 + len(item), 0)]
    twice = decon.search(decon.build([(7, item)]), [text + text])
    assert [(m[2], m[4]) for m in twice] == [(10, 0), (10 + len(text), 0)]


def test_a_rate_beyond_the_bound_is_refused():
    with pytest.raises(ValueError):
        decon.build([(1, "word " * 30)], rate=0.5)


def test_query_and_blocks(spark, documents, texts, monkeypatch):
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    items = {r.item_id: canon(r.text).strip() for r in benchmark.collect()}
    got = {(r.doc_id, r.item_id) for r in decon.op8_decontamination(spark, SF_DIR).collect()}
    verbatim = {(d, i) for d, t in texts.items() for i, x in items.items() if x in canon(t)}
    assert verbatim <= got
    for d, i in got - verbatim:
        assert fewest_edits(items[i], canon(texts[d])) <= decon.RATE * len(items[i])
    monkeypatch.setattr(decon, "BLOCK_CHARS", 2000)  # more blocks than one: the same rows
    assert {(r.doc_id, r.item_id) for r in decon.op8_decontamination(spark, SF_DIR).collect()} == got
    kept = {r.doc_id for r in decon.clean(documents, benchmark).collect()}
    assert kept == set(texts) - {d for d, _ in got}


def test_hits_are_counted_in_parts(monkeypatch):
    item = "the and the and the on the and the in the and the and the on"
    text = "x " + "the and " * 50 + item
    whole = decon.search(decon.build([(1, item)]), [text])
    monkeypatch.setattr(decon, "HITS", 10)
    assert decon.search(decon.build([(1, item)]), [text]) == whole != []


def test_odd_rows(spark, odd, clashing):
    long = ODD[7][1][:60]
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "the"), (None, long), (5, long), (5, long)], "item_id long, text string")
    rows = decon.matches(clashing, benchmark).collect()
    assert {r.doc_id for r in rows} == {7} and {r.item_id for r in rows} == {None, 5}
    assert decon.clean(clashing, benchmark).columns == clashing.columns
    assert decon.clean(odd, benchmark).count() == len(ODD) - 1
    assert decon.clean(odd, benchmark.limit(0)).count() == len(ODD) and decon.matches(odd.limit(0), benchmark).count() == 0
