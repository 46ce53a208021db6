"""Operator 9, BPE encoding and decoding by a trie of the distinct words.

The words of a batch that are not known yet are sorted, which is the depth-first order of their
trie. A node's state is the last token of the encoding of its path; it follows from the states of
its ancestors, so a prefix that many words share is worked out once, and one that no token can follow
not at all. The walk keeps the states of one path only.

A token sequence is an encoding exactly if each neighbouring pair is one that the merges leave
apart, so the last token of a path is the one suffix token that fits the state before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowsieve.llm.common import slices, table
from flowsieve.llm.wordbpe import VOCABULARY, pre_tokens, vocabulary_path

#: Runs between white space, and words, in a generation of what a worker keeps, and pairs whose fit it keeps.
HELD_CHUNKS = 150_000
HELD_PAIRS = 1_000_000
#: Last bytes of a path that tell which tokens may end it.
NEAR = 4
_END = "</w>"
#: Bits of a token number in a pair's.
_TOKEN_BITS = 32
#: Depths of a path whose states are worked out in order.
CHAIN = 128


def byte_symbols() -> list[str]:
    """The symbol of each byte in byte-level vocabularies: printable Latin-1 bytes are themselves,
    the others follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class TrieEncoder:
    """Encodes words by a depth-first walk of their trie."""

    def __init__(self, path: str):
        self.cut = pre_tokens(path)
        model = self.cut.spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != _END or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.ids = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.cut.added.items()}
        rank = {}
        #: Of each merged token the pair it is made of; of each pair its token, in merge order.
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for n, (a, b) in enumerate(model["merges"]):
            pair, token = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.merged.setdefault(pair, n)
            if token not in self.parts:
                self.parts[token], rank[token] = pair, n
        self.rank = rank
        # By byte string: tokens inside a word, and tokens that end one. A token that its own text
        # would not be encoded to can't stand in an encoding.
        back = {s: b for b, s in enumerate(byte_symbols())}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for name, token in self.ids.items():
            ends = name.endswith(_END) and name != _END
            text = name[: -len(_END)] if ends else name
            if all(c in back for c in text) and (token not in self.parts or self.stays_apart(*self.parts[token], rank[token])):
                (self.final if ends else self.inner)[bytes(back[c] for c in text)] = token
        #: Of tokens inside and at the end of words: the lengths over NEAR by the last NEAR bytes, and what
        #: may end a path by its last NEAR bytes, as far as it was asked for.
        self.longer = [self._longer(d) for d in (self.inner, self.final)]
        self.endings: list[dict[bytes, list[tuple[int, int | None]]]] = [{}, {}]
        self.size = {t: len(w) for d in (self.inner, self.final) for w, t in d.items()}
        self.fits: dict[int, bool] = {}

    @staticmethod
    def _longer(tokens: dict[bytes, int]) -> dict[bytes, list[int]]:
        lengths: dict[bytes, set[int]] = {}
        for w in tokens:
            if len(w) > NEAR:
                lengths.setdefault(w[-NEAR:], set()).add(len(w))
        return {end: sorted(n, reverse=True) for end, n in lengths.items()}

    def _ending(self, final: int, end: bytes) -> list[tuple[int, int | None]]:
        """The sizes of the tokens that may end a path with these last bytes, longest first, and the tokens that this tells."""
        tokens = (self.inner, self.final)[final]
        found = [(n, None) for n in self.longer[final].get(end, ())]
        found += [(n, tokens[end[-n:]]) for n in range(len(end), 0, -1) if end[-n:] in tokens]
        self.endings[final][end] = found
        return found

    def stays_apart(self, left: int, right: int, limit: int | None = None) -> bool:
        """Whether the merges leave these neighbours apart (before merge number `limit`, if given).

        The merges that made both tokens are undone from the last to the first; at each step the
        pieces at the border must not have been a merge that comes before the one undone.
        """
        end = len(self.merged) + 1
        limit = end if limit is None else limit
        while True:
            if self.merged.get((left, right), end) < limit:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            # Of two pieces made by the same merge the left one was made first.
            if a > b:
                limit, left = a, self.parts[left][1]
            else:
                limit, right = b + 1, self.parts[right][0]

    def _last(self, final: int, path: bytes, states: list[int], depth: int) -> int:
        """The last token of the encoding of path[:depth]; states[d] is that of path[:d], worked out when it is asked for."""
        fits, tokens = self.fits, self.final if final else self.inner
        end = path[depth - NEAR : depth] if depth > NEAR else path[:depth]
        for size, token in self.endings[final].get(end) or self._ending(final, end):
            start = depth - size
            if token is None and (start < 0 or (token := tokens.get(path[start:depth])) is None):
                continue
            if not start:
                break
            state = states[start]
            if state < 0:
                state = states[start] = self._last(0, path, states, start)
            pair = state << _TOKEN_BITS | token
            apart = fits.get(pair)
            if apart is None:
                apart = fits[pair] = self.stays_apart(state, token)
            if apart:
                break
        else:
            raise ValueError("a byte has no token")
        return token

    def encode(self, words: list[bytes]) -> Iterator[list[int]]:
        """Token ids of sorted distinct words, in their order."""
        if len(self.fits) > HELD_PAIRS:
            self.fits.clear()
        if sum(map(len, self.endings)) > HELD_PAIRS:
            self.endings = [{}, {}]
        size, last = self.size, self._last
        before, states = b"", [-1]
        for word in words:
            inside = len(word) - 1
            same, most = 0, min(len(before), inside, len(states) - 1)
            if before[:most] == word[:most]:
                same = most
            else:
                while before[same] == word[same]:
                    same += 1
            del states[same + 1 :]
            states += [-1] * (inside - same)
            # So that no chain of states that are not known yet is longer.
            for depth in range(CHAIN, inside, CHAIN):
                if states[depth] < 0:
                    states[depth] = last(0, word, states, depth)
            token, out, depth = last(1, word, states, inside + 1), [], inside + 1
            while True:
                out.append(token)
                depth -= size[token]
                if not depth:
                    break
                token = states[depth]
            before = word
            out.reverse()
            yield out


class Codec:
    """Encodes and decodes texts. Runs between white space and their words are kept from batch to batch, in two generations."""

    def __init__(self, path: str):
        self.trie = TrieEncoder(path)
        self.cut = self.trie.cut
        self.ids: dict[str, str] = {}
        self.said: dict[str, str] = {}
        #: Of words that stand in runs with others: ids and tokens.
        self.words: dict[str, tuple[str, str]] = {}
        self.old: tuple[dict[str, str], dict[str, str], dict[str, tuple[str, str]]] = {}, {}, {}
        self.written = {i: str(i) for i in self.trie.names}

    def forget(self) -> None:
        """Drops the elder generation."""
        self.old = {}, {}, {}

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.ids) > HELD_CHUNKS or len(self.words) > HELD_CHUNKS:
            self.old = self.ids, self.said, self.words
            self.ids, self.said, self.words = {}, {}, {}
        ids, said, kept, (old_ids, old_said, old_words) = self.ids, self.said, self.words, self.old
        new = {}
        for chunk in set().union(*texts).difference(ids):
            if chunk in old_ids:
                ids[chunk], said[chunk] = old_ids[chunk], old_said[chunk]
            else:
                new[chunk] = self.cut.words(chunk)
        added, names = self.cut.added, self.trie.names.__getitem__
        made = {w: (str(i), names(i)) for w, i in added.items()}
        for w in (every := set().union(*new.values()).difference(made)):
            known = kept.get(w) or old_words.get(w) or (ids.get(w) and (ids[w], said[w]))
            if known:
                made[w] = known
        # The order of code points is that of their UTF-8 bytes.
        words, written = sorted(every.difference(made)), self.written.__getitem__
        for w, tokens in zip(words, self.trie.encode([w.encode() for w in words]), strict=True):
            made[w] = " ".join(map(written, tokens)), " ".join(map(names, tokens))
        for chunk, parts in new.items():
            if len(parts) == 1:
                ids[chunk], said[chunk] = made[parts[0]]
            else:
                found = [made[w] for w in parts]
                ids[chunk], said[chunk] = " ".join([i for i, _ in found]), " ".join([t for _, t in found])
                # A word that ends a sentence here stands alone elsewhere, or in another such run.
                kept.update(zip(parts, found, strict=True))

    def run(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """Of each text the ids, and the decoded text, both joined by spaces (the vocabulary has no decoder)."""
        chunks = [self.cut.chunks(t) for t in texts]
        self.learn(chunks)
        for had in chunks:
            yield " ".join(map(self.ids.__getitem__, had)), " ".join(map(self.said.__getitem__, had))


@lru_cache(maxsize=1)
def _codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """df with token_ids (array of ints) and decoded (string); a null text is an empty one. Columns of these names are replaced."""
    return _mapped(df, text_col, path, lambda ids, said: ([int(x) for x in ids.split()], said), [("token_ids", pa.list_(pa.int32()), T.ArrayType(T.IntegerType())), ("decoded", pa.string(), T.StringType())])


def digests(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """df without its text, with n_tokens, ids_sha256 and decoded_sha256 of every row.

    Null and empty texts have no tokens; very long texts are encoded whole; equal rows stay equal
    rows; an empty table gives an empty one; columns of these names are replaced.
    """
    def made(ids: str, said: str):
        return (ids.count(" ") + 1 if ids else 0, sha256(ids.encode()).hexdigest(), sha256(said.encode()).hexdigest())

    return _mapped(df, text_col, path, made, [("n_tokens", pa.int64(), T.LongType()), ("ids_sha256", pa.string(), T.StringType()), ("decoded_sha256", pa.string(), T.StringType())], keep_text=False)


def _mapped(df: DataFrame, text_col: str, path: str | None, made: Callable, fields: list, keep_text: bool = True) -> DataFrame:
    path = path or vocabulary_path()
    new = [f[0] for f in fields]
    df = df.drop(*[c for c in new if c != text_col])
    kept = [c for c in df.columns if (keep_text or c != text_col) and c not in new]
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in kept), *(T.StructField(n, t) for n, _, t in fields)])
    place = df.columns.index(text_col)
    places = [df.columns.index(c) for c in kept]
    kinds = [k for _, k, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in slices(batches):
            out = [made(*x) for x in codec.run(batch.column(place).to_pylist())]
            arrays = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in places), *arrays], [*kept, *new])
        codec.forget()  # what a worker holds between tasks is one generation

    return df.mapInArrow(run, schema)


def op9_bpe_codec(spark, sf_dir) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), path=vocabulary_path(VOCABULARY)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
