"""The recursions against all paths; held-out accuracy; odd rows."""

import itertools
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.llm import langid

from .conftest import ODD, SF_DIR


@pytest.mark.parametrize("block", [2, 256])
@pytest.mark.parametrize("n", [1, 2, 5])
def test_posteriors(n, block, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", block)
    draw, k = np.random.default_rng(n), 3
    scores, moves, start = draw.normal(size=(n, k)), draw.normal(size=(k, k)), draw.normal(size=k)
    starts = np.arange(n) % 3 == 0
    want = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        total = sum(scores[t, y] + (start[y] if starts[t] else moves[path[t - 1], y]) for t, y in enumerate(path))
        want[range(n), path] += np.exp(total)
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(langid.posteriors(scores, starts, moves, start)[0], want)


def test_query(spark, documents):
    lang = {r.doc_id: r.lang for r in documents.collect()}
    rows = langid.op10_language_id(spark, SF_DIR).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_held_out_texts_and_labels_teach_nothing(spark, documents):
    held = langid.held_out()
    changed = documents.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("text", F.when(held, "zz yy").otherwise(F.col("text")))
    a, b = (langid.train(d, eligible=~held) for d in (documents, changed))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights) and np.array_equal(a.transitions, b.transitions)


@pytest.fixture(scope="module")
def model(documents):
    return langid.train(documents)


def test_code_switched_text(model):
    labels = [x for _, x, _ in langid.Labeller(model).words("der die und nicht einer ist that the and with from this for los las para que una")]
    assert labels[:5] == ["de"] * 5 and labels[7:12] == ["en"] * 5 and labels[-4:] == ["es"] * 4


def test_scores_are_the_same_after_forgetting(model, texts, monkeypatch):
    some = list(texts.values())[:40]
    whole = langid.Labeller(model).run(some)
    monkeypatch.setattr(langid, "HELD_WORDS", 10)
    tight = langid.Labeller(model)
    for text, (lang, score) in zip(some, whole, strict=True):
        assert tight.run([text])[0] == (lang, pytest.approx(score))


def test_odd_rows(spark, odd, clashing, model):
    rows = langid.predict(clashing, model).collect()
    assert len(rows) == len(ODD)
    assert {r.doc_id for r in rows if r.lang_pred == langid.UNKNOWN} == {1, 2, 5, 8}
    assert all(r.score == 0 for r in rows if r.lang_pred == langid.UNKNOWN)
    kept = langid.accepted(clashing)
    assert kept.columns == clashing.columns and {r.doc_id for r in kept.collect()} <= {3, None, 6, 7}
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {langid.UNKNOWN}
    assert langid.train(odd.limit(0)) is None and langid.accepted(odd.limit(0)).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert langid.accepted(unlabelled).count() == len(ODD)
