"""Alignment against both libraries on whole texts and counting in plain Python."""

import collections
from hashlib import sha256

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowsieve.llm import alignment
from flowsieve.llm.bpe_codec import byte_symbols
from flowsieve.llm.wordbpe import vocabulary_path

from .conftest import ODD, SF_DIR

A = Tokenizer.from_file(vocabulary_path(alignment.A_VOCABULARY))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(alignment.B_VOCABULARY))
BACK = {s: b for b, s in enumerate(byte_symbols())}


def tokens(text):
    """Ids and bytes of both tokenizers over the whole text."""
    if not text:
        return [], []
    a = [(i, bytes(BACK[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()) for i in B.encode(text) for p in [B.id_to_piece(i)]]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def ranges(found):
    at, out = 0, []
    for i, x in found:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def aligned(text):
    """Tokens, groups as written, and links with their multiplicity."""
    a, b = (ranges(x) for x in tokens(text))
    links = collections.Counter()
    first = 0
    for i, s, e in a:
        while first < len(b) and b[first][2] <= s:
            first += 1
        k = first
        while k < len(b) and b[k][1] < e:
            links[i, b[k][0]] += 1
            k += 1
    cuts = sorted({e for *_, e in a} & {e for *_, e in b})
    groups, start = [], 0
    ends_a, ends_b = collections.defaultdict(list), collections.defaultdict(list)
    import bisect

    for found, out in ((a, ends_a), (b, ends_b)):
        for i, _, e in found:
            out[bisect.bisect_left(cuts, e)].append(str(i))
    groups = ";".join(f"{','.join(ends_a[k])}|{','.join(ends_b[k])}" for k in range(len(cuts)))
    return len(a), len(b), len(cuts), links, groups


def expected(texts):
    all_of = [aligned(t) for t in texts]
    count = collections.Counter(p for x in all_of for p in x[3])
    best = collections.defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    rows = []
    for n_a, n_b, n_g, links, groups in all_of:
        n_best = sum(n for p, n in links.items() if count[p] == best[p[0]])
        rows.append((n_a, n_b, n_g, sum(links.values()), n_best, sum(n * count[p] for p, n in links.items()), groups))
    return rows, count, sum((x[3] for x in all_of), collections.Counter())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet=" \t\n\r\x0b\x1c\xa0　ab'.1é▁<s>", max_size=40)), max_size=4))
def test_any_text(texts):
    totals, written, row, pair = alignment._aligner(vocabulary_path(alignment.A_VOCABULARY), vocabulary_path(alignment.B_VOCABULARY)).read(texts)
    for k, t in enumerate(texts):
        n_a, n_b, n_g, links, groups = aligned(t)
        assert (*totals[k].tolist(), written[k]) == (n_a, n_b, n_g, sum(links.values()), groups)
        assert collections.Counter((p >> 32, p & 0xFFFFFFFF) for p in pair[row == k].tolist()) == links
        assert sum(links.values()) == n_a + n_b - n_g


@pytest.mark.parametrize("share", [alignment.SHARE, 1 / 2000, 1.0, 0.0])
def test_whole_table(documents, texts, share):
    ids = sorted(texts)
    rows, *_ = expected([texts[i] for i in ids])
    got = alignment.align(documents.select("doc_id", "text"), share=share, rows=16).collect()
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got} == dict(zip(ids, rows, strict=True))


def test_query_and_pair_counts(spark, documents, texts):
    ids = sorted(texts)
    rows, count, links = expected([texts[i] for i in ids])
    got = {r.doc_id: r for r in alignment.op12_tokenizer_alignment(spark, SF_DIR).collect()}
    for i, (*_, n_best, total, groups) in zip(ids, rows, strict=True):
        assert (got[i].n_best, got[i].count_sum, got[i].groups_sha256) == (n_best, total, sha256(groups.encode()).hexdigest() if groups else "")
    pairs = {(r.a, r.b): (r.docs, r.links) for r in alignment.link_counts(documents).collect()}
    assert pairs == {p: (count[p], links[p]) for p in count}


def test_blocks_and_evictions(documents, texts, monkeypatch):
    """Blocks that end early and pieces that are forgotten change nothing; the functions run in this process."""
    import pyarrow as pa

    class Here:
        partitionId = staticmethod(lambda: 3)  # noqa: N815

    monkeypatch.setattr(alignment, "BLOCK_ENTRIES", 3000)
    monkeypatch.setattr(alignment, "HELD_PIECES", 500)
    monkeypatch.setattr(alignment.TaskContext, "get", staticmethod(lambda: Here))
    ids = sorted(texts)[:60]
    rows, count, links = expected([texts[i] for i in ids])
    run = alignment._read_blocks(vocabulary_path(alignment.A_VOCABULARY), vocabulary_path(alignment.B_VOCABULARY), 1, False, 7)
    table = pa.Table.from_batches(list(run(iter([pa.RecordBatch.from_pydict({"t": [texts[i] for i in ids], "d": ids})])))).to_pylist()
    assert [(r["c0"], r["n_a"], r["groups"]) for r in table if r["id"] is not None] == [(i, w[0], w[-1]) for i, w in zip(ids, rows, strict=True)]
    docs, times = collections.Counter(), collections.Counter()
    for r in table:
        if r["pair"] is not None:
            p = (r["pair"] >> 32, r["pair"] & 0xFFFFFFFF)
            docs[p] += r["n"] * (r["plane"] < 0)
            times[p] += r["n"] << max(r["plane"], 0)
    assert docs == count and times == links
    assert len({r["block"] for r in table if r["pair"] is not None}) > 3


def test_bitmaps_of_many_documents():
    import numpy as np

    place = np.arange(0, 4096, 3)
    pair, n, docs = alignment._bitmaps(np.concatenate([np.full(len(place), 5), [9, 9]]), np.concatenate([place, [7, 4095]]))
    assert pair.tolist() == [9, 5] and n.tolist() == [2, len(place)]
    assert np.frombuffer(docs[0].as_py(), "<u2").tolist() == [7, 4095]
    assert np.flatnonzero(np.unpackbits(np.frombuffer(docs[1].as_py(), np.uint8))).tolist() == place.tolist()


def test_odd_rows(odd, clashing):
    rows, *_ = expected([t for _, t, *_ in ODD])
    for df in (odd, clashing):
        got = alignment.align(df).collect()
        assert sorted((str(r.doc_id), r.n_a, r.n_links, r.n_best, r.count_sum) for r in got) == sorted((str(i), w[0], w[3], w[4], w[5]) for (i, *_), w in zip(ODD, rows, strict=True))
    assert alignment.align(odd.limit(0)).count() == 0


def test_new_pieces_are_encoded_many_as_one():
    """Pieces go to tokenizer A in long runs, but for those that end with white space; the tokens are those of each piece."""
    aligner = alignment.Aligner(vocabulary_path(alignment.A_VOCABULARY), vocabulary_path(alignment.B_VOCABULARY))
    given = []
    whole = aligner.a

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    aligner.a = Counted()
    text = " ".join(f"word{k} it's 中{k}é <|endoftext|> x{k}\n" for k in range(400))
    texts = [text, "a \n b\t c ", "tail ", " ", None, ""]
    totals, written, _, _ = aligner.read(texts)
    assert len(given) < 20
    for t, (n_a, n_b, *_), groups in zip(texts, totals.tolist(), written, strict=True):
        want = aligned(t)
        assert (n_a, n_b, groups) == (want[0], want[1], want[4])
