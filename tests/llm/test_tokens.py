"""Token counts and the codec against the tokenizers library, on given, odd and random texts."""

import random
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowsieve.llm import bpe_codec, token_counts
from flowsieve.llm.wordbpe import pre_tokens, vocabulary_path

from .conftest import ODD, SF_DIR

LIBRARY = Tokenizer.from_file(vocabulary_path())


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text_is_encoded_as_the_library_does(text):
    ids, said = next(bpe_codec._codec(vocabulary_path()).run([text]))
    assert ids == " ".join(map(str, ids_of(text)))
    assert said == LIBRARY.decode(ids_of(text), skip_special_tokens=False)


def test_every_code_point_alone_and_in_words():
    """Alone, between letters, before a combining mark and doubled; the count of pieces likewise."""
    cut, codec = pre_tokens(vocabulary_path()), bpe_codec._codec(vocabulary_path())
    points = [chr(c) for c in range(0x3400) if not 0xD800 <= c < 0xE000]
    for form in ("{0}", "a{0}b", "{0}\u0317", "E{0} {0}{0}s"):
        texts = [form.format(c) for c in points]
        want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
        for text, ids, (got, _) in zip(texts, want, codec.run(texts), strict=True):
            assert got == " ".join(map(str, ids)), ascii(text)
            assert sum(cut.n_pieces(cut(text))) == len(ids), ascii(text)


def test_capitals_whose_lower_case_is_far_away():
    texts = [w for c in "ƁƆƉƊƏƐƓƔƖƗƜƝƟƦƩƮƱƲƷȺȾɄɅ" for w in (f"{c}srin", f"K{c}ND", f"x{c}{c} a")]
    for text, (got, _) in zip(texts, bpe_codec._codec(vocabulary_path()).run(texts), strict=True):
        assert got == " ".join(map(str, ids_of(text)))


def test_words_that_share_prefixes_and_endings():
    draw = random.Random(4)
    words = {"".join(draw.choice("abehtinrsox") for _ in range(draw.randrange(1, 25))) for _ in range(3000)}
    trie = bpe_codec.TrieEncoder(vocabulary_path())
    got = list(trie.encode(sorted(w.encode() for w in words)))
    assert got == [ids_of(w) for w in sorted(words)]


def test_pre_tokens_of_added_tokens_and_contractions():
    cut = pre_tokens(vocabulary_path())
    assert cut("It's<|endoftext|> 12 a_b") == ["it", "'s", "<|endoftext|>", "1", "2", "a", "_", "b"]
    assert cut(None) == cut("") == []


@pytest.mark.parametrize("share", [token_counts.SHARE, 0.05, 1.0, 0.0])
def test_counts_of_whole_table(documents, texts, share):
    rows = token_counts.count_tokens(documents.select("doc_id", "text"), share=share).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == {i: (len((t or "").encode()), len(ids_of(t))) for i, t in texts.items()}


def test_queries(spark, texts):
    for r in token_counts.op1_token_counts(spark, SF_DIR).collect():
        assert (r.n_tokens, r.over_limit) == (len(ids_of(texts[r.doc_id])), len(ids_of(texts[r.doc_id])) > 2048)
    for r in bpe_codec.op9_bpe_codec(spark, SF_DIR).collect():
        ids = ids_of(texts[r.doc_id])
        assert r.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows_stay_apart(clashing):
    want = sorted((str(i), len((t or "").encode()), len(ids_of(t))) for i, t, *_ in ODD)
    counted = token_counts.count_tokens(clashing)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in counted.collect()) == want
    coded = bpe_codec.digests(clashing)
    assert sorted((str(r.doc_id), r.n_tokens) for r in coded.collect()) == sorted((a, c) for a, _, c in want)
    both = bpe_codec.encode(clashing).collect()
    assert sorted((str(r.doc_id), r.token_ids) for r in both) == sorted((str(i), ids_of(t)) for i, t, *_ in ODD)


def test_empty_tables(odd):
    assert token_counts.count_tokens(odd.limit(0)).count() == 0 and bpe_codec.digests(odd.limit(0)).count() == 0


def test_states_that_no_token_needs_are_not_worked_out(monkeypatch):
    """A long token that begins a word answers for the prefixes inside it; what comes out is the library's."""
    trie = bpe_codec.TrieEncoder(vocabulary_path())
    asked, last = [], trie._last
    monkeypatch.setattr(trie, "_last", lambda *a: asked.append(a[-1]) or last(*a))
    words = sorted([b"international", b"internationally", b"a" * 3000, "déjà".encode(), b"x"])
    plain = pre_tokens(vocabulary_path()).plain
    want = [e.ids for e in plain.encode_batch([w.decode() for w in words], add_special_tokens=False)]
    assert list(trie.encode(words)) == want
    asked.clear()
    next(trie.encode([b"internationally"]))
    assert len(asked) < len("internationally")
