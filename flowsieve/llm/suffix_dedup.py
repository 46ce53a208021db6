"""Operator 2, removal of repeated 400-byte strings by suffix sorting.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else too.

1. Anchors. In every window of LENGTH bytes the K-byte string with the least hash (the leftmost of
   equals) is an anchor. Equal windows have the same anchor at the same place, so two places of a
   repeated string are found among the places of one anchor.
2. Contexts. The part of the text in which a window can hold the anchor is its context. Anchors that
   occur once end here. Equal contexts are counted, not compared: all their windows are repeats.
3. The different contexts of an anchor are brought together, and batches of whole anchors are suffix
   sorted. Only suffixes that begin at content-defined cuts are sorted, over the strings between cuts
   as symbols; any other suffix has a few bytes before its first cut and follows the order of that.
   Neighbours that share LENGTH bytes are repeats.
4. Each context's repeats are one interval around its anchor. Intervals go back to all places of the
   context and are merged document by document.

An anchor with more than CROWD different contexts is not sorted in one task: the hashes of its windows
are counted instead, one row for each window, which combine before they are exchanged.

Equality of strings is that of 64-bit hashes and, for rows, of two of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.common import slices, table
from flowsieve.llm.suffix_sort import suffix_array
from flowsieve.session import scratch_path

LENGTH = 400
K = 64
#: Different contexts of an anchor that are sorted together.
CROWD = 4096
#: Bytes of contexts that are sorted at once, unless one anchor has more.
BATCH_BYTES = 600_000
#: Cuts depend on CUT_BYTES bytes; one place in CUT_RATE is a cut.
CUT_BYTES, CUT_RATE = 8, 16
#: Bytes whose hashes are worked out at once; a part's places need to fit in PLACE_BITS.
PART, PLACE_BITS = 1 << 19, 20
#: Contexts of one place: the bytes before and from the anchor's first byte in which windows hold it.
BEFORE, AFTER = LENGTH - K, LENGTH

_RANDOM = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _power(n: int) -> np.uint64:
    return _U(pow(_BASE, n, 1 << 64))


def _window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of each string of `size` bytes (a power of two), by doubling."""
    h, n = _RANDOM[data], 1
    while n < size:
        h = h[:-n] * _power(n) + h[n:]
        n *= 2
    h ^= h >> _U(31)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    return h


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of a text of LENGTH bytes or more, and their hashes."""
    windows, found, named = LENGTH - K + 1, [], []
    for at in range(0, max(1, len(data) - LENGTH + 1), PART):
        part = np.frombuffer(data, np.uint8, min(PART + LENGTH - 1, len(data) - at), at)
        h = _window_hashes(part, K)
        n, rows = len(h), -(-len(h) // windows)
        key = np.full(rows * windows, (1 << 64) - 1, _U)
        key[:n] = (h & _U((1 << 64) - (1 << PLACE_BITS))) | np.arange(n, dtype=_U)
        grid = key.reshape(rows, windows)
        left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        right = np.minimum.accumulate(grid, axis=1).ravel()
        least = np.minimum(left[: n - windows + 1], right[windows - 1 : n])
        places = (least & _U((1 << PLACE_BITS) - 1)).astype(np.int64)
        places = places[np.concatenate(([True], places[1:] != places[:-1]))]
        found.append(places + at)
        named.append(h[places])
    places, first = np.unique(np.concatenate(found), return_index=True)
    return places, np.concatenate(named)[first]


def _context(data: bytes, place: int) -> tuple[bytes, int]:
    """The context of the anchor at a place, and the anchor's place in it."""
    begin = max(0, place - BEFORE)
    return data[begin : place + AFTER], place - begin


def _context_hash(context: bytes, offset: int) -> int:
    return xxhash.xxh3_64_intdigest(context, offset) - (1 << 63)


def repeats(contexts: list[bytes], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place in each context where a string of LENGTH bytes begins that begins
    elsewhere too; first is -1 if there is none. owners: numbers that tell places in texts apart: a
    context's number plus a place in it is the same only for the same place of the same text."""
    sizes = np.array(list(map(len, contexts)))
    ends = np.cumsum(sizes)
    joined = b"".join(contexts)
    data = np.frombuffer(joined, np.uint8)
    n, begins = len(data), ends - sizes
    which = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    # Hashes of prefixes; a substring's hash is their difference, moved to place 0.
    up = np.full(n + 1, _U(_BASE), _U)
    up[0] = 1
    up = np.cumprod(up, dtype=_U)
    down = np.full(n + 1, _U(pow(_BASE, -1, 1 << 64)), _U)
    down[0] = 1
    down = np.cumprod(down, dtype=_U)
    prefix = np.concatenate((np.zeros(1, _U), np.cumsum(_RANDOM[data] * down[:n], dtype=_U)))
    del down
    hashed = lambda at, size: (prefix[at + size] - prefix[at]) * up[at]

    # Cuts: behind CUT_BYTES bytes whose hash says so, inside one context; and at its end.
    cut = np.zeros(n, bool)
    if n >= CUT_BYTES:
        h = _window_hashes(data, CUT_BYTES)
        at = np.flatnonzero(h < _U((1 << 64) // CUT_RATE)) + CUT_BYTES
        at = at[at < n]
        cut[at[which[at - CUT_BYTES] == which[at]]] = True
    cuts = np.flatnonzero(cut)
    first, last = np.full(len(contexts), -1), np.full(len(contexts), -1)

    # Symbols: the strings between cuts; 0 ends a context. Suffixes at cuts are sorted.
    if len(cuts):
        stops = np.empty(len(cuts), np.int64)
        stops[:-1] = np.minimum(cuts[1:], ends[which[cuts[:-1]]])
        stops[-1] = ends[which[cuts[-1]]]
        closes = np.flatnonzero(stops == ends[which[cuts]])
        names = hashed(cuts, stops - cuts)
        # Symbols are ranked as strings: what stands between two suffixes in their order then shares
        # what those share, the cut-off symbol at a context's end included.
        _, one, symbol = np.unique(names ^ (stops - cuts).astype(_U), return_index=True, return_inverse=True)
        strings = [joined[x:y] for x, y in zip(cuts[one].tolist(), stops[one].tolist(), strict=True)]
        rank = np.empty(len(one), np.int64)
        rank[sorted(range(len(one)), key=strings.__getitem__)] = np.arange(len(one))
        rank = rank[symbol]
        text = np.insert(rank + 1, closes + 1, 0)
        place_of = np.insert(np.arange(len(cuts)), closes + 1, -1)
        order = place_of[np.array(suffix_array(text.tolist()), np.int64)]
        order = order[order >= 0]
        position = np.empty(len(cuts), np.int64)
        position[order] = np.arange(len(order))
        a, b = cuts[order[:-1]], cuts[order[1:]]
        # Bytes that neighbours share, up to LENGTH and the ends of their contexts, by bisection.
        most = np.minimum(LENGTH, np.minimum(ends[which[a]] - a, ends[which[b]] - b))
        low, high = np.zeros(len(a), np.int64), most
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = hashed(a, middle) == hashed(b, middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        shared = low
    else:
        order = position = np.empty(0, np.int64)
        shared = np.empty(0, np.int64)

    # Every string of LENGTH bytes, by its first cut that it alone decides: the cut's rank, and what stands before.
    starts = np.flatnonzero(np.arange(n) + LENGTH <= ends[which])
    if not len(starts):
        return first, last
    next_cut = np.searchsorted(cuts, starts + CUT_BYTES)
    inside = next_cut < len(cuts)
    at_cut = np.where(inside, cuts[np.minimum(next_cut, len(cuts) - 1)] if len(cuts) else 0, 0)
    inside &= at_cut < starts + LENGTH
    lead = np.where(inside, at_cut - starts, LENGTH)
    name = hashed(starts, lead) ^ (lead.astype(_U) * _U(0x2545F4914F6CDD1D))
    rank = np.where(inside, position[np.minimum(next_cut, max(0, len(cuts) - 1))] if len(cuts) else 0, -1)
    by = np.lexsort((rank, name))
    starts, name, lead, rank = starts[by], name[by], lead[by], rank[by]
    together = (name[1:] == name[:-1]) & (lead[1:] == lead[:-1])
    between = np.flatnonzero(together & (rank[1:] > rank[:-1]))
    if len(between):
        least = _least(shared, rank[between], rank[between + 1])
        together[between] &= lead[between] + least >= LENGTH
    # Runs of equal strings; one is a repeat if its places are not all the same place.
    heads = np.concatenate(([0], np.flatnonzero(~together) + 1))
    ids = owners[which[starts]] + (starts - begins[which[starts]])
    repeated = np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads)
    hit = starts[np.repeat(repeated, np.diff(np.append(heads, len(starts))))]
    if len(hit):
        hit.sort()
        owner = which[hit]
        edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        first[owner[edge]] = hit[edge] - begins[owner[edge]]
        ends_at = np.append(edge[1:], len(hit)) - 1
        last[owner[edge]] = hit[ends_at] - begins[owner[edge]]
    return first, last


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of values[a:b], a < b, by a table over powers of two."""
    tables, width = [values], 1
    while 2 * width <= int((b - a).max()):
        tables.append(np.minimum(tables[-1][:-width], tables[-1][width:]))
        width *= 2
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    out = np.empty(len(a), np.int64)
    for k in np.unique(level):
        on = level == k
        out[on] = np.minimum(tables[k][a[on]], tables[k][b[on] - (1 << int(k))])
    return out


#: A row's key: rows with equal ids and texts have equal keys, and equal results.
KEY = ["d", "e"]


def _keys(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(id_col, text_col).alias("d"), F.xxhash64(text_col, id_col).alias("e")]


def _places(docs: DataFrame) -> DataFrame:
    """Every anchor of texts (d, e, text): its place, hash and context's hash, size and bytes before the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, found = [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                data = text.encode() if text else b""
                if len(data) >= LENGTH:
                    at, names = anchors(data)
                    rows += [row] * len(at)
                    for place, name in zip(at.tolist(), names.view(np.int64).tolist(), strict=True):
                        context, before = _context(data, place)
                        found.append((place, name, _context_hash(context, before), len(context), before))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            of = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))], ["d", "e", "place", "a", "c", "size", "before"])

    return docs.mapInArrow(run, "d long, e long, place long, a long, c long, size int, before int")


_CONTEXTS = "a long, c long, m long, owner long, before int, context binary"


def _contexts(texts: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts of texts (d, text, a, c, m, place: arrays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out: list[list] = [[] for _ in range(6)]
            for d, text, a, c, m, place in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                data = text.encode()
                for x in zip(a, c, m, place, strict=True):
                    context, before = _context(data, x[3])
                    owner = (d + (x[3] - before) + (1 << 63)) % (1 << 64) - (1 << 63)
                    for column, value in zip(out, (x[0], x[1], x[2], owner, before, context), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(out, (pa.int64(),) * 4 + (pa.int32(), pa.binary()), strict=True)], ["a", "c", "m", "owner", "before", "context"])

    return texts.select("d", "text", "a", "c", "m", "place").mapInArrow(run, _CONTEXTS)


def _sorted_out(contexts: DataFrame) -> DataFrame:
    """(a, c, lo, hi): the repeats of each context from its anchor, by sorting whole anchors together."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table_ = pa.Table.from_batches(held)
        texts = table_.column("context").to_pylist()
        before = table_.column("before").to_numpy().astype(np.int64)
        first, last = repeats(texts, table_.column("owner").to_numpy())
        hit = np.flatnonzero(first >= 0)
        keys = [table_.column(n).to_numpy()[hit] for n in ("a", "c")]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*keys, first[hit] - before[hit], last[hit] + LENGTH - before[hit])], ["a", "c", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in slices(batches, 1024):
            a = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
            for x, y in zip(edges, edges[1:], strict=False):
                if x == y:
                    continue
                if size >= BATCH_BYTES and a[x] != last:
                    yield flush(held)
                    held, size = [], 0
                held.append(batch.slice(x, y - x))
                size += (y - x) * (BEFORE + AFTER)
                last = a[x]
        if held:
            yield flush(held)

    rows = contexts.repartition("a").sortWithinPartitions("a")
    return rows.mapInArrow(run, "a long, c long, lo long, hi long")


def _counted_out(contexts: DataFrame) -> DataFrame:
    """The same for crowded anchors: equal windows at equal places from the anchor are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows, at, names = [], [], []
            for row, (before, context) in enumerate(zip(batch.column("before").to_pylist(), batch.column("context").to_pylist(), strict=True)):
                for k in range(len(context) - LENGTH + 1):
                    rows.append(row)
                    at.append(k - before)
                    names.append(xxhash.xxh3_64_intdigest(context[k : k + LENGTH]) - (1 << 63))
            of = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(of) for n in ("a", "c", "owner")), pa.array(at, pa.int64()), pa.array(names, pa.int64())], ["a", "c", "owner", "lo", "h"])

    windows = contexts.mapInArrow(run, "a long, c long, owner long, lo long, h long")
    # The context with the least number, and that with the greatest, tell whether there are two.
    often = windows.groupBy("a", "lo", "h").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").drop("x", "y")
    return windows.join(often, ["a", "lo", "h"]).groupBy("a", "c").agg(F.min("lo").alias("lo"), (F.max("lo") + LENGTH).alias("hi"))


def _written(df: DataFrame, name: str) -> DataFrame:
    where = scratch_path(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def changes(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", crowd: int = CROWD) -> DataFrame:
    """(d, e, n_removed, n_spans, kept): what becomes of the texts that hold repeats, one row for each key.

    Whole texts are exchanged once, to those that share an anchor; from there on only these are read.
    """
    docs = df.select(*_keys(id_col, text_col), F.col(text_col).alias("text"))
    places = _written(_places(docs), "anchors")
    # Written before they are joined: Spark splits a frequent key only if nothing stands between
    # an exchange and the join, and one anchor or context may have a third of all places.
    twice = _written(places.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "twice")
    shared = _written(places.join(twice, "a", "left_semi"), "shared-anchors")

    contexts = shared.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "place")).alias("one"), F.first("size").alias("size"), F.first("before").alias("before"))
    kinds = contexts.groupBy("a").agg(F.count("*").alias("m"))
    contexts = _written(contexts.join(kinds, "a").select("a", "c", "n", "m", "size", "before", "one.d", "one.e", "one.place"), "contexts")
    equal = contexts.where(f"n > 1 AND size >= {LENGTH}").select("a", "c", (-F.col("before").cast("long")).alias("lo"), (F.col("size") - F.col("before")).cast("long").alias("hi"))

    # One place of each context stands for all; every text with a shared anchor comes along.
    wanted = contexts.where("m > 1").select(*KEY, F.struct("a", "c", "m", "place").alias("w")).unionByName(shared.select(*KEY).distinct(), allowMissingColumns=True)
    wanted = wanted.groupBy(*KEY).agg(F.collect_list("w").alias("w"))
    texts = docs.join(wanted, KEY).select(*KEY, "text", *(F.col(f"w.{n}").alias(n) for n in ("a", "c", "m", "place")))
    texts = _written(texts, "texts")

    bytes_ = _contexts(texts)
    found = _sorted_out(bytes_.where(F.col("m") <= crowd))
    if (contexts.agg(F.max("m")).first()[0] or 0) > crowd:
        found = found.union(_counted_out(bytes_.where(F.col("m") > crowd)))
    # All intervals of a context hold its anchor, so together they are one.
    cover = _written(equal.union(found).groupBy("a", "c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "cover")
    spans = shared.join(cover, ["a", "c"]).select(*KEY, F.struct((F.col("place") + F.col("lo")).alias("start"), (F.col("place") + F.col("hi")).alias("end")).alias("s"))
    spans = spans.groupBy(*KEY).agg(F.collect_set("s").alias("s")).select(*KEY, F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    rows = texts.select(*KEY, "text").join(spans, KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for text, start, end in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                data, gone = text.encode(), merged(list(zip(start, end, strict=True)))
                kept = b"".join([data[a:b] for a, b in zip([0, *(g[1] for g in gone)], [*(g[0] for g in gone), len(data)], strict=True)])
                out.append((len(data) - len(kept), len(gone), kept))
            made = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names)

    names = [*KEY, "n_removed", "n_spans", "kept"]
    made = rows.mapInArrow(run, "d long, e long, n_removed long, n_spans long, kept binary")
    return made.dropDuplicates(KEY)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching intervals as one, by place."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without_repeats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", crowd: int = CROWD) -> DataFrame:
    """For every row: id, n_bytes, n_removed, n_spans and kept, the bytes that stay.

    A null text is an empty one; texts under LENGTH bytes keep all; repeated rows repeat each other, so
    longer ones lose all, and rows without an id count like any other. What stays of a text may not
    be UTF-8, as cuts fall between any bytes. Other columns of df are left out; an empty table gives
    an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return _merged_rows(df, text_col, id_col, crowd, text.cast("binary").alias("own"), lambda kept: kept, "kept")


def digests(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", crowd: int = CROWD) -> DataFrame:
    """without_repeats() with the SHA-256 of what stays in place of the bytes: unchanged texts are digested where they are."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return _merged_rows(df, text_col, id_col, crowd, F.sha2(text.cast("binary"), 256).alias("own"), lambda kept: F.sha2(kept, 256), "kept_sha256")


def _merged_rows(df: DataFrame, text_col: str, id_col: str, crowd: int, own: Column, of: Callable[[Column], Column], name: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), *_keys(id_col, text_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), own)
    changed = changes(df, text_col, id_col, crowd).select(*KEY, "n_removed", "n_spans", of(F.col("kept")).alias("changed"))
    joined = rows.join(changed, KEY, "left")
    zero = F.lit(0).cast("long")
    return joined.select(F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("changed", "own").alias(name))


def op2_suffix_dedup(spark, sf_dir) -> DataFrame:
    return digests(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
