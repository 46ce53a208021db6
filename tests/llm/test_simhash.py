"""Fingerprints, pairs and components against plain Python."""

import random
import re

import pytest
import xxhash

from flowsieve.llm import simhash

from .conftest import ODD, SF_DIR


def brute(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(prints):
    """Of each node the smallest number linked with it; prints: (number, fingerprint) pairs."""
    left, out = sorted(prints), {}
    while left:
        group, left = [left[0]], left[1:]
        for _, x in group:
            near = [p for p in left if (p[1] ^ x).bit_count() <= simhash.DISTANCE]
            group += near
            left = [p for p in left if p not in near]
        out.update({i: min(g[0] for g in group) for i, _ in group})
    return out


def test_query(spark, texts):
    prints = {i: brute(t) for i, t in texts.items()}
    reach = smallest_reachable(prints.items())
    rows = simhash.op7_simhash(spark, SF_DIR).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{p:016x}", reach[i]) for i, p in prints.items()}


def test_bits_are_counted_in_parts(monkeypatch):
    text = " ".join(str(i * i) for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "COUNTED", 7)
    assert simhash.fingerprint(text) == whole and whole % (1 << 64) == brute(text)


signed = lambda x: x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("crowd", [2, 1000])
def test_pairs_of_crowded_keys(spark, crowd):
    draw, prints = random.Random(3), set()
    for _ in range(3):
        centre = draw.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(draw.randrange(5)):
                x ^= 1 << draw.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 3}
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    assert {(r.a, r.b) for r in simhash.near_pairs(df, crowd).collect()} == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 101), (7, 7)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {100: 99, 101: 99}


def test_odd_rows(spark, odd, clashing):
    # Texts without words are one component; equal texts another; the null id alone has no number.
    rows = simhash.near_duplicates(clashing).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint == "0" * 16, r.component_id))
    assert by[1] == by[2] == by[5] == {(True, 1)} and by[3] == {(False, 3)} and by[None] == {(False, None)}
    kept = simhash.one_of_each(clashing)
    assert kept.columns == clashing.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "None", "6", "7", "8"])
    assert simhash.one_of_each(odd.limit(0)).count() == simhash.near_duplicates(odd.limit(0)).count() == 0


def test_one_id_with_two_texts(spark):
    rows = [(3, "ccc"), (5, "ccc"), (5, "ddd"), (5, "ddd"), (None, "eee"), (None, "eee")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("3", "ccc"), ("5", "ddd"), ("None", "eee")]
