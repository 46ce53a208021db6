"""Word-level BPE vocabularies: a text's pre-tokens as the tokenizers library cuts them.

A pre-token stands for itself: its pieces depend on no neighbour, so both the
token counter and the encoder work on distinct pre-tokens.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

from tokenizers import Tokenizer

#: Name of the default vocabulary among the public tokenizers.
VOCABULARY = "word_bpe_49k.json"
#: Texts of these code points only are already in NFC, and their lower-case forms and classes
#: are the same in every Unicode version. Left out: U+0130, which becomes two code points, and the
#: capitals whose lower case is beyond the limit.
PLAIN_LIMIT = 0x250
_PLAIN = [c for c in map(chr, range(PLAIN_LIMIT)) if not "\x1c" <= c <= "\x1f" and len(c.lower()) == 1 and ord(c.lower()) < PLAIN_LIMIT]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _class(major: str) -> str:
    return "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == major)


class PreTokens:
    """Cuts texts into pre-tokens and added tokens; built once in each Python worker."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Encodes pre-tokens, which are normal already: to normalise one again can change it.
        self.plain = Tokenizer.from_file(path)
        self.plain.no_truncation()
        self.plain.no_padding()
        self.plain.normalizer = None
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        #: Added tokens, found in the raw text before anything else.
        self.added = {x["content"]: x["id"] for x in self.spec["added_tokens"]}
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in self.spec["added_tokens"]):
            raise ValueError("added tokens with matching options are not supported")
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        letters, numbers = _class("L"), _class("N")
        self._odd = re.compile("[^" + "".join(map(re.escape, _PLAIN)) + "]")
        # Only an apostrophe can begin two alternatives of the vocabulary's own pattern.
        self._cut = re.compile(f"[{letters}]+|[{numbers}]|'(?:[stmd]|re|ve|ll)|[^\\s{letters}{numbers}]+").findall

    def _part(self, text: str) -> list[str]:
        if self._odd.search(text) is None:
            return text.lower().split()  # no pre-token has white space
        text = self.tokenizer.normalizer.normalize_str(text)
        return [f" {text[a:b]}" for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def chunks(self, text: str | None) -> list[str]:
        """The text in pieces of whole pre-tokens; a piece that begins with a space is one pre-token or added token."""
        if not text:
            return []
        if self._added is None or self._added.search(text) is None:
            return self._part(text)
        out: list[str] = []
        for k, part in enumerate(self._added.split(text)):
            if k % 2:
                out.append(f" {part}")
            elif part:
                out += self._part(part)
        return out

    def words(self, chunk: str) -> list[str]:
        """The pre-tokens of a piece."""
        if chunk.isalpha():  # a plain piece of letters is one
            return [chunk]
        return [chunk[1:]] if chunk[0] == " " else self._cut(chunk)

    def __call__(self, text: str | None) -> list[str]:
        """The pre-tokens of a text; an added token stands in the list as itself."""
        return [w for c in self.chunks(text) for w in self.words(c)]

    def n_pieces(self, words: list[str]) -> list[int]:
        """Pieces of each distinct pre-token."""
        return [len(e) for e in self.plain.encode_batch_fast(words, add_special_tokens=False)]


@lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)
