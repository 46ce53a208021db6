"""Ranked search against scoring every document in plain Python."""

import collections
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowsieve.llm import search

from .conftest import ODD, SF_DIR

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return WORD.findall((text or "").translate(UPPER))


def expected(docs, items, k=10):
    """(item place, rank, id, score) over (id, text) rows."""
    held = [(i, collections.Counter(t), len(t)) for i, text in docs for t in [terms(text)]]
    n_docs, n_terms = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for place, text in enumerate(items):
        found = []
        for i, c, n in held:
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // n_terms))) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(place, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_terms(text):
    assert [t.decode() for t in search.terms(text)] == terms(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40_000), st.integers(1, 70_000)), min_size=1, max_size=300, unique_by=lambda x: x[0]))
def test_blocks_round_trip(postings):
    places, freqs = np.array(sorted(postings)).T
    got = search._unpacked(search._packed(places, freqs), int(places[0]))
    assert got[0].tolist() == places.tolist() and got[1].tolist() == freqs.tolist()


def answers(df):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize(("shard_docs", "block_chars", "k"), [(search.SHARD_DOCS, search.BLOCK_CHARS, 10), (64, 3000, 10), (256, 10**6, 3), (256, 10**6, 150)])
def test_whole_table(spark, documents, texts, shard_docs, block_chars, k):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    asked = sorted((r.item_id, r.text) for r in items.collect())
    want = expected(sorted(texts.items()), [t for _, t in asked], k)
    got = answers(search.search(documents.repartition(3), items, k=k, shard_docs=shard_docs, block_chars=block_chars))
    assert got == sorted((asked[p][0], r, i, s) for p, r, i, s in want)


def test_random_lists_and_ties():
    """Shards of many equal and unequal documents, answered in this process."""
    draw = np.random.default_rng(5)
    import pyarrow as pa

    for size, vocabulary in ((3000, 60), (700, 8), (5, 3)):
        docs = [(int(i), " ".join(f"w{t}" for t in np.minimum(draw.zipf(1.3, draw.integers(0, 30)), vocabulary))) for i in draw.permutation(size)]
        docs += [(i + size, t) for i, t in docs[: size // 4]]
        words = [f"w{t}".encode() for t in range(1, vocabulary + 1)]
        entries = collections.Counter((p, words.index(w)) for p, (_, t) in enumerate(docs) for w in search.terms(t))
        doc, term, freq = (np.array(x, np.int64) for x in zip(*[(p, w, n) for (p, w), n in entries.items()], strict=True))
        lengths = np.array([len(terms(t)) for _, t in docs])
        n_docs, n_terms = int((lengths > 0).sum()), int(lengths.sum())
        table = pa.Table.from_batches([search._shard_rows(1, [i for i, _ in docs], lengths, doc, term, freq)])
        items = [" ".join(f"w{t}" for t in draw.integers(1, vocabulary + 1, draw.integers(1, 12))) for _ in range(60)]
        df = collections.Counter(term.tolist())
        shard, got = search.Shard(table, n_docs, n_terms), []
        for p, text in enumerate(items):
            asked = collections.Counter(words.index(w) for w in search.terms(text))
            weights = [(t, n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))) for t, n in asked.items()]
            got += [(p, r + 1, shard.ids[q], s) for r, (q, s) in enumerate(shard.search(weights, 10))]
        assert got == expected(docs, items)


def test_few_blocks_are_unpacked():
    """A frequent and a rare term: of the frequent one's blocks only those with a candidate are unpacked."""
    import pyarrow as pa

    size = 20_000
    doc, term = np.concatenate([np.arange(size), np.arange(0, size, 1000)]), np.concatenate([np.zeros(size, np.int64), np.ones(size // 1000, np.int64)])
    shard = search.Shard(pa.Table.from_batches([search._shard_rows(1, list(range(size)), np.full(size, 10), doc, term, np.ones(len(doc), np.int64))]), size, size * 10)
    assert [shard.ids[p] for p, _ in shard.search([(0, 1), (1, 6000)], 10)] == list(range(0, 10_000, 1000))
    assert len(shard.begin[0]) - 1 > 150 and len(shard.seen[0]) <= 20


def test_odd_rows(spark, odd, clashing):
    items = spark.createDataFrame([(1, "the end ÄRGER 日本語", 4), (2, None, 5), (2, "lorem the the", 6), (2, "lorem the the", 6), (3, "", 7), (4, "zzz nothing has", 8)], "item_id long, text string, score long")
    asked = items.collect()
    want = sorted((asked[p].item_id, r, i, s) for p, r, i, s in expected([(i, t) for i, t, *_ in ODD], [a.text for a in asked]))
    by = lambda rows: sorted(rows, key=str)
    for df in (odd, clashing):
        assert by((r.item_id, r["rank"], r.doc_id, r.score) for r in search.search(df, items).collect()) == by(want)
    assert search.search(odd.limit(0), items).count() == 0 and search.search(odd, items.limit(0)).count() == 0
    assert search.search(odd, items.limit(0)).columns == search.search(odd, items).columns
