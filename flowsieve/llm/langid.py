"""Operator 10, language identification by a linear-chain conditional random field.

Each word of a text gets a label, the languages being the labels; the posterior of every word's
label comes from the forward-backward recursions, and a document's language is the one with the
largest mean posterior. A word's features are its affixes, its character trigrams and the lexicons
it is in; transitions are learned. Training sequences are put together from pieces of documents in
different languages, so that the transitions see text that switches.

Training: a bounded sample (SAMPLE_DOCS documents a language, WINDOWS windows of WINDOW words of
each) is drawn by Spark and fitted on the driver; the bound does not depend on the table's size.
Prediction: row-local, over whole texts, in batches whose words are one chain with a fresh start at
each document. The chain is cut into blocks whose transfer matrices are worked out side by side.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.common import slices, table

#: The training sample: documents of each language, windows of each document, words of a window.
SAMPLE_DOCS = 250
WINDOWS = 3
WINDOW = 48
#: Languages that are learned at most; the most frequent ones are.
MAX_LANGUAGES = 64
BUCKETS = 1 << 16
#: Words of each language's lexicon, and how often one must have been seen.
LEXICON, LEXICON_LEAST = 2000, 2
ROUNDS, RATE, PRIOR = 30, 0.5, 1e-3
UNKNOWN = "und"
#: A document is rejected if the mean posterior of its language is smaller.
LEAST_SCORE = 0.4
#: Words whose scores, and feature names whose buckets, a worker keeps; words side by side in a block.
HELD_WORDS = 300_000
HELD_NAMES = 500_000
BLOCK = 256

_LETTERS = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages
    transitions: np.ndarray  # log scores, from x to
    start: np.ndarray
    lexicon: dict[str, list[int]]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for w in _LETTERS.finditer(text) for c in w[0])


def _word(chunk: str) -> str:
    """The letters of a run between white space; empty if it has none."""
    if chunk.isalpha():
        return chunk
    inner = chunk.strip(".,;:!?\"'()")
    return inner if inner.isalpha() else "".join([c for c in inner if c.isalpha()])


class _Buckets(dict):
    """Bucket of each feature name; the names met are kept, as trigrams and affixes are few."""

    def __missing__(self, name: str) -> int:
        if len(self) > HELD_NAMES:
            self.clear()
        bucket = self[name] = zlib.crc32(name.encode()) % BUCKETS
        return bucket


_BUCKET = _Buckets()


def features(word: str, lexicon: dict[str, list[int]]) -> list[int]:
    """Buckets of the affix, trigram and lexicon features of a lower-case word."""
    marked = f"^{word}$"
    names = dict.fromkeys([marked[k : k + 3] for k in range(len(word))])  # in order, so that sums are the same everywhere
    for n in range(1, min(4, len(word)) + 1):
        names["<" + word[:n]] = names[">" + word[-n:]] = None
    if word in lexicon:
        names.update(dict.fromkeys([f"lexicon {k}" for k in lexicon[word]]))
    return [_BUCKET[n] for n in names]


def _emissions(words: list[str], weights: np.ndarray, lexicon: dict[str, list[int]]) -> np.ndarray:
    """Log scores of words by label: the mean of their features' weights, scaled by the root of their number."""
    found = [features(w, lexicon) for w in words]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((x for f in found for x in f), np.int64, int(sizes.sum()))
    sums = np.add.reduceat(weights[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)
    return sums / np.sqrt(sizes)[:, None]


def posteriors(scores: np.ndarray, starts: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over a chain of words that begins anew wherever starts is true: the
    posteriors of the labels given the chain, and given the chain up to each word.

    scores: words x labels, log. Blocks of the chain are worked out side by side: first their
    transfer matrices, then the messages between blocks, then the messages inside.
    """
    n, k = scores.shape
    move, first = np.exp(transitions), np.exp(start)
    rows = -(-n // BLOCK)
    e = np.ones((rows * BLOCK, k))
    e[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    fresh = np.ones(rows * BLOCK, bool)
    fresh[:n] = starts
    e, fresh = e.reshape(rows, BLOCK, k), fresh.reshape(rows, BLOCK)
    transfer = np.broadcast_to(np.eye(k), (rows, k, k)).copy()
    for t in range(BLOCK):
        new = transfer @ move
        f = fresh[:, t]
        if f.any():
            new[f] = transfer[f].sum(axis=2, keepdims=True) * first
        transfer = new * e[:, t, None, :]
        transfer /= transfer.sum(axis=(1, 2), keepdims=True)
    enter, leave = np.ones((rows, k)), np.ones((rows, k))
    for b in range(1, rows):
        x = enter[b - 1] @ transfer[b - 1]
        enter[b] = x / x.sum()
    for b in range(rows - 2, -1, -1):
        x = transfer[b + 1] @ leave[b + 1]
        leave[b] = x / x.sum()
    forward = np.empty((rows, BLOCK, k))
    a = enter
    for t in range(BLOCK):
        a = np.where(fresh[:, t, None], first, a @ move) * e[:, t]
        a = a / a.sum(axis=1, keepdims=True)
        forward[:, t] = a
    both, b = np.empty_like(forward), leave
    for t in range(BLOCK - 1, -1, -1):
        both[:, t] = forward[:, t] * b
        b = b * e[:, t]
        b = np.where(fresh[:, t, None], 1.0, b @ move.T)
        b = b / b.sum(axis=1, keepdims=True)
    out = both.reshape(-1, k)[:n]
    return out / out.sum(axis=1, keepdims=True), forward.reshape(-1, k)[:n]


def fit(samples: list[tuple[str, list[list[str]]]]) -> Model | None:
    """Fits the field to (language, windows of words) by gradient steps on the conditional likelihood."""
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return None
    place, k = {x: i for i, x in enumerate(languages)}, len(languages)
    seen = [Counter() for _ in languages]
    for lang, windows in samples:
        for words in windows:
            seen[place[lang]].update(words)
    total = sum(seen, Counter())
    lexicon: dict[str, list[int]] = {}
    for i, counts in enumerate(seen):
        common = sorted((w for w, n in counts.items() if n >= LEXICON_LEAST and 2 * n > total[w]), key=lambda w: (-counts[w], w))
        for word in common[:LEXICON]:
            lexicon.setdefault(word, []).append(i)

    # Half of the sequences are one window; the others are windows cut and joined across languages.
    pieces = [(place[lang], words) for lang, windows in samples for words in windows if words]
    if not pieces:
        return None
    draw = np.random.default_rng(0)
    order, sequences = draw.permutation(len(pieces)), []
    for i in order[::2]:
        sequences.append([pieces[i]])
    rest = order[1::2]
    for i in range(0, len(rest) - 1, 2):
        (la, a), (lb, b) = pieces[rest[i]], pieces[rest[i + 1]]
        cut_a, cut_b = int(draw.integers(1, len(a) + 1)), int(draw.integers(0, len(b)))
        sequences.append([(la, a[:cut_a]), (lb, b[cut_b:])])
    sequences += [[pieces[i]] for i in rest[len(rest) // 2 * 2 :]]

    ids: dict[str, int] = {}
    chain, gold, starts = [], [], []
    for parts in sequences:
        for at, (label, words) in enumerate(parts):
            starts += [at == 0] + [False] * (len(words) - 1)
            chain += [ids.setdefault(w, len(ids)) for w in words]
            gold += [label] * len(words)
    chain, gold, starts = np.array(chain), np.array(gold), np.array(starts)
    found = [features(w, lexicon) for w in ids]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((x for f in found for x in f), np.int64, int(sizes.sum()))
    edges, scale = np.concatenate(([0], np.cumsum(sizes)[:-1])), 1 / np.sqrt(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)

    weights, move, start = np.zeros((BUCKETS, k)), np.eye(k), np.zeros(k)
    past = [np.full_like(x, 1e-8) for x in (weights, move, start)]
    one = np.eye(k)[gold]
    inside = ~starts[1:]
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (gold[:-1][inside], gold[1:][inside]), 1)
    n = len(chain)
    for _ in range(ROUNDS):
        by_word = np.add.reduceat(weights[flat], edges, axis=0) * scale[:, None]
        scores = by_word[chain]
        post, so_far = posteriors(scores, starts, move, start)
        left = one - post
        # The posterior of a move is that of its end, dealt over its origins.
        origin, steps = so_far[:-1][inside], np.exp(move)
        expected = steps * (origin.T @ (post[1:][inside] / (origin @ steps)))
        word_left = np.stack([np.bincount(chain, left[:, j], len(sizes)) for j in range(k)], axis=1) * scale[:, None]
        g_weights = np.stack([np.bincount(flat, word_left[owner, j], BUCKETS) for j in range(k)], axis=1) / n - PRIOR * weights / len(sizes)
        g_move = (gold_moves - expected) / n - PRIOR * move
        g_start = left[starts].sum(axis=0) / n - PRIOR * start
        for value, grad, sq in zip((weights, move, start), (g_weights, g_move, g_start), past, strict=True):
            sq += grad * grad
            value += RATE * grad / np.sqrt(sq)
    return Model(languages, weights.astype(np.float32), move, start, lexicon)


def _draws(df: DataFrame, text_col: str, lang_col: str, eligible: Column) -> list[tuple[str, list[list[str]]]]:
    """The bounded training sample: windows at places that a hash of the text fixes."""
    rows = df.where(eligible).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    langs = [r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()]
    # Only hashes are ranked, and each task sends on its first ones; equal texts are one.
    keys = rows.where(F.col("lang").isin(langs)).select("lang", F.xxhash64("text").alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    parts = keys.distinct().withColumn("part", F.pmod("h", F.lit(64)))
    parts = parts.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy("h"))).where(F.col("r") <= SAMPLE_DOCS)
    chosen = parts.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS).select("lang", "h").collect()
    wanted: dict[str, set[int]] = {}
    for r in chosen:
        wanted.setdefault(r.lang, set()).add(r.h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang, text, h = (batch.column(k).to_pylist() for k in range(3))
            out = []
            for x, t, key in zip(lang, text, h, strict=True):
                words = [w for c in t.lower().split() if (w := _word(c))]
                windows = -(-len(words) // WINDOW)
                for k in range(min(WINDOWS, windows)):
                    at = (key + k * max(1, windows // WINDOWS)) % windows * WINDOW
                    out.append((x, key, " ".join(words[at : at + WINDOW])))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([o[0] for o in out], pa.string()), "h": pa.array([o[1] for o in out], pa.int64()), "words": pa.array([o[2] for o in out], pa.string())})

    hashes = sorted({h for found in wanted.values() for h in found})
    picked = rows.withColumn("h", F.xxhash64("text")).where(F.col("h").isin(hashes) & F.col("lang").isin(langs)) if hashes else None
    drawn = picked.mapInArrow(run, "lang string, h long, words string").distinct().collect() if picked is not None else []
    found: dict[tuple[str, int], list[list[str]]] = {}
    for r in sorted(drawn):
        if r.h in wanted.get(r.lang, ()):
            found.setdefault((r.lang, r.h), []).append(r.words.split())
    return [(lang, windows) for (lang, _), windows in sorted(found.items())]


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", eligible: Column | None = None) -> Model | None:
    """A model from the rows with a language and a text; none if there are no such rows."""
    return fit(_draws(df, text_col, lang_col, F.lit(True) if eligible is None else eligible))


class Labeller:
    """Applies a model to batches of texts and keeps the scores of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.scores = np.empty((1024, len(self.model.languages)))
        self.used = 0

    def _learn(self, chunks: list[list[str]]) -> None:
        new = set().union(*chunks).difference(self.places)
        if len(self.places) + len(new) > HELD_WORDS:
            self._forget()
            new = set().union(*chunks)
        words: dict[str, list[str]] = {}
        for chunk in new:
            if word := _word(chunk):
                words.setdefault(word, []).append(chunk)
            else:
                self.places[chunk] = -1
        if words:
            made = _emissions(list(words), self.model.weights, self.model.lexicon)
            while self.used + len(made) > len(self.scores):
                self.scores = np.concatenate((self.scores, np.empty_like(self.scores)))
            self.scores[self.used : self.used + len(made)] = made
            for k, of in enumerate(words.values()):
                self.places.update(dict.fromkeys(of, self.used + k))
            self.used += len(made)

    def run(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        chunks = [t.lower().split() if t else [] for t in texts]
        self._learn(chunks)
        get = self.places.__getitem__
        rows = [np.fromiter(map(get, c), np.int64, len(c)) for c in chunks]
        rows = [r[r >= 0] for r in rows]
        had = [k for k, r in enumerate(rows) if len(r)]
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not had:
            return out
        sizes = np.array([len(rows[k]) for k in had])
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        chain = np.concatenate([rows[k] for k in had])
        starts = np.zeros(len(chain), bool)
        starts[at] = True
        post, _ = posteriors(self.scores[chain], starts, self.model.transitions, self.model.start)
        means = np.add.reduceat(post, at, axis=0) / sizes[:, None]
        best = means.argmax(axis=1)
        for k, i, b in zip(had, range(len(had)), best, strict=True):
            out[k] = (self.model.languages[b], float(min(1.0, means[i, b])))
        return out

    def words(self, text: str) -> list[tuple[str, str, float]]:
        """Each run between white space that has a letter, with its language and the posterior of that."""
        chunks = text.lower().split()
        self._learn([chunks])
        rows = np.array([self.places[c] for c in chunks], int)
        shown = [c for c, r in zip(text.split(), rows, strict=True) if r >= 0]
        if not shown:
            return []
        starts = np.zeros(len(shown), bool)
        starts[0] = True
        post, _ = posteriors(self.scores[rows[rows >= 0]], starts, self.model.transitions, self.model.start)
        return [(c, self.model.languages[p.argmax()], float(p.max())) for c, p in zip(shown, post, strict=True)]


def predict(df: DataFrame, model: Model | None, text_col: str = "text", keep: bool = False) -> DataFrame:
    """df with lang_pred and score (the mean posterior of that language, 0 to 1) of every row's text.

    Null and empty texts, texts without a letter, and all texts if there is no model, get `und` and
    score 0. Equal languages: the first by name. Equal rows stay apart; very long texts are read
    whole. Columns of these two names are replaced. keep: with the text, else without.
    """
    new = ("lang_pred", "score")
    kept = [f for f in df.schema if f.name not in new and (keep or f.name != text_col)]
    places, place = [df.columns.index(f.name) for f in kept], df.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS x MAX_LANGUAGES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value) if shared.value else None
        for batch in slices(batches):
            texts = batch.column(place).to_pylist()
            found = labeller.run(texts) if labeller else [(UNKNOWN, 0.0)] * len(texts)
            made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in places), *made], [*(f.name for f in kept), *new])

    return df.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that training doesn't see: crc32 of the id's decimal digits leaves 2 divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def accepted(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """df without the documents that are rejected: those without a letter, and those in which no
    language has LEAST_SCORE of the words. Without any labelled row nothing can be learned, and nothing is rejected."""
    model = train(df, text_col, lang_col, ~held_out(id_col))
    if model is None:
        return df
    columns = df.columns
    hidden = [c for c in columns if c.lower() in ("lang_pred", "score")]
    inner = df.select(*(F.col(c).alias(f"_own_{c}") if c in hidden else F.col(c) for c in columns))
    found = predict(inner, model, text_col, keep=True).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.select(*(F.col(f"_own_{c}").alias(c) if c in hidden else F.col(c) for c in columns))


def op10_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, eligible=~held_out())
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
