"""Operator 8, benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared by their letters and digits in lower case, with one space for whatever stands
between. A passage of a document matches an item of n such characters if at most `rate` * n edits
turn one into the other.

An alignment with e edits keeps at least n + 1 - q - q * e of the item's q-grams, and those lie on
diagonals (place in the document less place in the item) that differ by at most e. So the diagonals
are cut into cells of e + 1, and two neighbouring cells, an overlapping band, hold all of them:
1. the q-grams of a batch of documents are hashed and looked up among those of the items;
2. hits are counted by item and cell; bands with fewer hits than the bound can't hold a match;
3. the regions that stay are aligned with the item inside their band, many at a time.

The items are a stated query set: they go to every task in blocks of BLOCK_CHARS characters, each
block with a pass of its own, so that what is sent is bounded however many items there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.common import slices, table

#: Edits allowed, as a share of an item's characters.
RATE = 0.05
#: Items with fewer letters, digits and spaces can't tell a leak from chance and are not searched.
LEAST_CHARS = 20
#: Lengths of q-grams: an item takes the first whose bound leaves at least one shared q-gram.
Q = (12, 8, 4)
#: Characters of the items that are sent to the tasks at once.
BLOCK_CHARS = 4_000_000
#: Hits that are counted, and candidates that are aligned, at one time.
HITS = 2_000_000
ALIGNED = 256
_BREAK = 1  # between documents; no letter or digit has this code
_FACTOR = 0x9E3779B97F4A7C15


class Index(NamedTuple):
    """Items of one q-gram length."""

    q: int
    ids: list[int | None]
    codes: list[np.ndarray]
    edits: np.ndarray
    hashes: np.ndarray  # sorted, of all q-grams
    items: np.ndarray  # their item
    places: np.ndarray  # and place in it
    marked: np.ndarray  # by the first bits of a hash: whether any q-gram has them


@lru_cache(maxsize=1)
def _canon() -> np.ndarray:
    """Of each code point the one that it is compared as; 0 for what is no letter or digit."""
    out = np.zeros(0x110000, np.uint32)
    for c in map(chr, range(0x110000)):
        if c.isalnum():
            low = c.lower()
            out[ord(c)] = ord(low) if len(low) == 1 else ord(c)
    return out


def canonical(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes that the texts are compared by, one text after the other with a break behind each;
    where each code stands in the texts put together; and where each text begins there."""
    joined = "\0".join([t or "" for t in texts] + [""])
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _canon()[raw]
    begins = np.concatenate(([0], np.cumsum([len(t or "") + 1 for t in texts]))).astype(np.int64)
    codes[begins[1:] - 1] = _BREAK
    stay = codes > 0
    stay[1:] |= codes[:-1] > _BREAK  # the first of what stands between words
    at = np.flatnonzero(stay)
    return codes[at], at, begins[:-1]


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams, put together from those of halves."""
    def power(n: int) -> np.uint64:
        return np.uint64(pow(_FACTOR, n, 1 << 64))

    made, h, size, out = 0, codes.astype(np.uint64), 1, None
    if len(codes) < q:
        return np.empty(0, np.uint64)
    while size <= q:
        if q & size:
            n = len(codes) - (made + size) + 1
            out = h[:n] if out is None else out[:n] * power(size) + h[made : made + n]
            made += size
        if 2 * size <= q:
            h = h[:-size] * power(size) + h[size:]
        size *= 2
    out = out ^ (out >> np.uint64(32))
    return out * np.uint64(0xD6E8FEB86659FD93)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(42)


def build(items: list[tuple[int | None, str | None]], rate: float = RATE) -> list[Index]:
    """Indexes of the items, one for each q-gram length that is needed."""
    groups: dict[int, list] = {}
    for item, text in items:
        codes = canonical([text])[0][:-1]
        codes = codes[1:] if len(codes) and codes[0] == 0 else codes
        codes = codes[:-1] if len(codes) and codes[-1] == 0 else codes
        n = len(codes)
        e = int(rate * n)
        if n >= LEAST_CHARS:
            q = next((q for q in Q if n + 1 - q - q * e >= 1), 0)
            if not q:
                raise ValueError(f"no q-gram length suits {e} edits in {n} characters; lower the rate")
            groups.setdefault(q, []).append((item, codes, e))
    out = []
    for q, group in groups.items():
        hashes = [gram_hashes(codes, q) for _, codes, _ in group]
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        marked = np.zeros(1 << 22, bool)
        marked[_bucket(flat)] = True
        of = np.repeat(np.arange(len(group)), list(map(len, hashes)))[order]
        places = np.concatenate([np.arange(len(h)) for h in hashes])[order]
        out.append(Index(q, [g[0] for g in group], [g[1] for g in group], np.array([g[2] for g in group]), flat, of, places, marked))
    return out


def _band_rows(items: list[np.ndarray], regions: list[np.ndarray], offsets: np.ndarray, edits: np.ndarray, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits between each whole item and a part of its region, and where the best part ends.

    Column k of the band stands for diagonal offset + k: after i characters of the item,
    i + offset + k of the region. The part may begin anywhere in the band, or, anchored, where the
    region does. All items are worked out side by side, row by row.
    """
    width = int(4 * edits.max() + 3)
    longest, far = max(map(len, items)), np.int32(1 << 20)
    item = np.zeros((len(items), longest), np.int64)
    for k, c in enumerate(items):
        item[k, : len(c)] = c
    pad = longest + width + 1
    text = np.full((len(regions), 2 * pad + max(map(len, regions))), -1, np.int64)
    for k, c in enumerate(regions):
        text[k, pad : pad + len(c)] = c
    sizes, ends = np.array(list(map(len, items))), np.array(list(map(len, regions)))[:, None]
    rows, steps = np.arange(len(items))[:, None], np.arange(width, dtype=np.int32)
    best, where = np.full(len(items), far), np.zeros(len(items), np.int64)
    used = offsets[:, None] + steps
    now = np.where(used == 0 if anchored else (used >= 0) & (used <= ends), np.int32(0), far)
    for i in range(longest):
        said = text[rows, np.clip(used + pad, 0, text.shape[1] - 1)]
        new = now + (said != item[:, i : i + 1])
        new[:, :-1] = np.minimum(new[:, :-1], now[:, 1:] + 1)
        new = np.minimum.accumulate(new - steps, axis=1) + steps
        used = used + 1
        now = np.where((used >= 0) & (used <= ends), new, far).astype(np.int32)
        done = sizes == i + 1
        if done.any():
            low = now.argmin(axis=1)
            best = np.where(done, now[rows[:, 0], low], best)
            where = np.where(done, used[rows[:, 0], low], where)
    return best, where


def _align(index: Index, codes: np.ndarray, ends: np.ndarray, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(document, item, start, end, edits) of the candidates (item, first diagonal, document) that hold a match."""
    items, regions, froms, edits = [], [], [], index.edits[[f[0] for f in found]]
    for (item, diagonal, doc), e in zip(found, edits.tolist(), strict=True):
        begin = int(ends[doc - 1]) + 1 if doc else 0
        lo = min(max(diagonal - e, begin), int(ends[doc]))
        items.append(index.codes[item])
        regions.append(codes[lo : min(diagonal + len(items[-1]) + 4 * e + 4, int(ends[doc]))].astype(np.int64))
        froms.append(lo)
    best, where = _band_rows(items, regions, np.array([f[1] for f in found]) - edits - froms, edits)
    near = np.flatnonzero(best <= edits)
    if not len(near):
        return []
    # Backwards from the end that was found, the same rows give the beginning.
    back = _band_rows([items[k][::-1] for k in near], [regions[k][: where[k]][::-1] for k in near], -edits[near], edits[near], True)[1]
    return [(found[k][2], found[k][0], int(froms[k] + where[k] - b), int(froms[k] + where[k]), int(best[k])) for k, b in zip(near, back, strict=True)]


def _bands(index: Index, codes: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(item, first diagonal, document) of the bands with as many hits as a match needs."""
    hashes = gram_hashes(codes, index.q)
    hit = np.flatnonzero(index.marked[_bucket(hashes)])
    first = np.searchsorted(index.hashes, hashes[hit])
    many = np.searchsorted(index.hashes, hashes[hit], "right") - first
    hit, first, many = hit[many > 0], first[many > 0], many[many > 0]
    lengths = np.array(list(map(len, index.codes)))
    size, longest, n_items = index.edits + 1, int(lengths.max()), len(lengths)
    span = len(codes) + longest + 2
    key, count = np.empty(0, np.int64), np.empty(0, np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(many) // HITS)) + 1 if len(many) else []
    for part in np.split(np.arange(len(hit)), cuts):
        h, f, m = hit[part], first[part], many[part]
        which = np.repeat(f - np.cumsum(m) + m, m) + np.arange(m.sum())
        item, place = index.items[which], np.repeat(h, m)
        doc = np.searchsorted(ends, place)
        cell = (place - index.places[which] + longest) // size[item]
        more, n = np.unique((doc * n_items + item) * span + cell, return_counts=True)
        key, back = np.unique(np.concatenate((key, more)), return_inverse=True)
        count = np.bincount(back, np.concatenate((count, n))).astype(np.int64)
    both = count.copy()
    both[:-1] += np.where(key[1:] == key[:-1] + 1, count[1:], 0)
    item = key // span % n_items
    stay = both >= (lengths + 1 - index.q * (1 + index.edits))[item]
    key, item = key[stay], item[stay]
    return list(zip(item.tolist(), (key % span * size[item] - longest).tolist(), (key // span // n_items).tolist(), strict=True))


def search(indexes: list[Index], texts: list[str | None]) -> list[tuple[int, int | None, int, int, int]]:
    """(text, item id, start, end, edits) of all matches; start and end are code points of the text."""
    codes, at, begins = canonical(texts)
    ends = np.flatnonzero(codes == _BREAK)
    out = []
    for index in indexes:
        matches: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        found = _bands(index, codes, ends)
        for k in range(0, len(found), ALIGNED):
            for doc, item, start, end, edits in _align(index, codes, ends, found[k : k + ALIGNED]):
                matches.setdefault((doc, item), []).append((edits, start, end))
        for (doc, item), spans in matches.items():
            kept: list[tuple[int, int]] = []
            for edits, a, b in sorted(set(spans)):  # neighbouring bands find the same passage
                if all(b <= x or a >= y for x, y in kept):
                    kept.append((a, b))
                    out.append((doc, index.ids[item], int(at[a] - begins[doc]), int(at[b - 1] + 1 - begins[doc]), edits))
    return sorted(out, key=lambda m: (m[0], m[2], m[3], str(m[1])))


def _item_blocks(benchmark: DataFrame, text_col: str, id_col: str) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of about BLOCK_CHARS characters."""
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    for k in range(blocks):
        yield [(r.item, r.text) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).distinct().toLocalIterator()]


def _run(df: DataFrame, text_col: str, schema: T.StructType, indexes: list[Index], made) -> DataFrame:
    place, shared = df.columns.index(text_col), df.sparkSession.sparkContext.broadcast(indexes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield made(batch, search(shared.value, batch.column(place).to_pylist()))

    return df.mapInArrow(run, schema)


def matches(df: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", item_col: str = "item_id", rate: float = RATE) -> DataFrame:
    """(id, item, start, end, edits) of every passage that matches an item, in code points of the text.

    Null and empty texts match nothing, nor do items under LEAST_CHARS; equal rows are found each,
    equal items once; overlapping matches of one item are one, with the fewest edits (if equal, the
    first); very long texts are searched whole. Other columns of both tables are left out.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = (docs.schema["doc_id"].dataType, benchmark.schema[item_col].dataType)
    schema = T.StructType([T.StructField(id_col, kinds[0]), T.StructField(item_col, kinds[1]), *(T.StructField(n, T.LongType()) for n in ("start", "end", "edits"))])
    item_kind = pa.string() if isinstance(kinds[1], T.StringType) else pa.int64()

    def made(batch, found):
        rows = pa.array([m[0] for m in found], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([m[1] for m in found], item_kind), *(pa.array([m[k] for m in found], pa.int64()) for k in (2, 3, 4))], schema.names)

    out = df.sparkSession.createDataFrame([], schema)
    for block in _item_blocks(benchmark, item_text_col, item_col):
        out = out.union(_run(docs, "text", schema, build(block, rate), made))
    return out


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", item_col: str = "item_id", rate: float = RATE) -> DataFrame:
    """df without the rows in which a passage matches an item."""

    def made(batch, found):
        hit = np.ones(batch.num_rows, bool)
        hit[[m[0] for m in found]] = False
        return batch.filter(pa.array(hit))

    for block in _item_blocks(benchmark, item_text_col, item_col):
        df = _run(df, text_col, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]), build(block, rate), made)
    return df


def op8_decontamination(spark, sf_dir) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
