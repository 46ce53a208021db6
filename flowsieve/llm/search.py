"""Operator 13, ranked lexical search: Block-Max MaxScore over shards.

1. Documents are indexed in shards, runs of at most SHARD_DOCS rows of an input split. In a shard
   they are ordered by their number of terms, and each searched term has a list of (place, frequency) in
   blocks of BLOCK postings: gaps and frequencies in as few bytes as hold them, and beside each block
   its first and last place and its largest frequency. As places are ordered by length, that and the
   first place bound every score of the block closely.
2. The lists' lengths and the shards' totals give the corpus counts, and these the terms' weights.
3. Each shard answers all items. A term's bound over the shard is the largest of its blocks'. The terms
   of smallest bound that together cannot reach the tenth best score so far are non-essential; the
   others' lists make the candidates. For a candidate the bound of the one block of a non-essential list
   that can hold it is looked at first, and only blocks that still have a candidate are unpacked.
4. The shards' heaps, ten rows an item each, are merged.

Items are taken in blocks of BLOCK_CHARS characters; each has a pass over the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import slices, table
from flowsieve.session import scratch_path

TOP = 10
SHARD_DOCS = 32_768
#: A shard ends early with so many postings.
SHARD_POSTINGS = 4_000_000
BLOCK = 128
#: Characters of the items that are searched at one time.
BLOCK_CHARS = 4_000_000
#: Of 100, the share of a document's length in its measure.
LENGTH_SHARE = 75

#: Letters and digits stay, A-Z in lower case; other characters below U+0080 separate terms.
_FOLD = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_INDEX = "shard long, term int, n long, total long, first binary, last binary, most binary, ends binary, body binary, ids array<long>"
_HEADER = -1


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


def _narrow(values: np.ndarray) -> np.ndarray:
    most = int(values.max())
    return values.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")


def _packed(places: np.ndarray, freqs: np.ndarray) -> bytes:
    """A block: the widths of its two halves, the gaps between places from the first on, and the frequencies."""
    gaps, freqs = _narrow(np.diff(places, prepend=places[0])), _narrow(freqs)
    return bytes([gaps.itemsize, freqs.itemsize]) + gaps.tobytes() + freqs.tobytes()


def _unpacked(block: bytes, first: int) -> tuple[np.ndarray, np.ndarray]:
    wide, n = block[0], (len(block) - 2) // (block[0] + block[1])
    gaps = np.frombuffer(block, f"<u{wide}", n, 2)
    return first + np.cumsum(gaps, dtype=np.int64), np.frombuffer(block, f"<u{block[1]}", n, 2 + wide * n).astype(np.int64)


def _shard_rows(shard: int, ids: list[int | None], lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, freq: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(lengths, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = np.lexsort((place[doc], term))
    doc, term, freq = place[doc][at], term[at], freq[at]
    starts = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.empty(0, np.int64)
    rows = [(shard, _HEADER, int((lengths > 0).sum()), int(lengths.sum()), None, None, None, None, lengths[order].astype("<i8").tobytes(), [ids[k] for k in order.tolist()])]
    for start, end in zip(starts.tolist(), np.append(starts, len(term))[1:].tolist(), strict=True):
        cuts = [*range(start, end, BLOCK), end]
        blocks = [_packed(doc[a:b], freq[a:b]) for a, b in zip(cuts, cuts[1:])]  # noqa: B905
        first, last = doc[cuts[:-1]], doc[np.array(cuts[1:]) - 1]
        most = np.maximum.reduceat(freq[start:end], np.array(cuts[:-1]) - start)
        rows.append((shard, int(term[start]), end - start, 0, first.astype("<i8").tobytes(), last.astype("<i8").tobytes(), most.astype("<i8").tobytes(), np.cumsum(list(map(len, blocks))).astype("<i8").tobytes(), b"".join(blocks), None))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "term", "n", "total", "first", "last", "most", "ends", "body", "ids"])


def _indexed(known, shard_docs: int, shard_postings: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look_up, shard = known.value.get, TaskContext.get().partitionId() << 32
        ids, lengths, found = [], [], []

        def out():
            postings = np.concatenate(found) if found else np.empty((0, 3), np.int64)
            return _shard_rows(shard, ids, np.array(lengths, np.int64), *postings.T)

        for batch in slices(batches):
            hits, sizes = [], []
            for text in batch.column(1).to_pylist():
                words = terms(text)
                lengths.append(len(words))
                hits += (had := list(filter(None, map(look_up, words))))
                sizes.append(len(had))
            row = np.repeat(np.arange(len(ids), len(ids) + batch.num_rows), sizes)
            pairs, freq = np.unique(row << 32 | np.array(hits, np.int64), return_counts=True)
            found.append(np.column_stack([pairs >> 32, (pairs & 0xFFFFFFFF) - 1, freq]))
            ids += batch.column(0).to_pylist()
            if len(ids) >= shard_docs or sum(map(len, found)) >= shard_postings:
                yield out()
                ids, lengths, found = [], [], []
                shard += 1
        if ids:
            yield out()

    return run


def index(df: DataFrame, words: list[bytes], text_col: str = "text", id_col: str = "doc_id", shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """Rows of shards: one with the number of documents that have terms, of all terms, lengths and ids in
    the order of places; and one for each term (a place in words) that it holds."""
    known = df.sparkSession.sparkContext.broadcast({w: k + 1 for k, w in enumerate(words)})
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_indexed(known, shard_docs, shard_postings), _INDEX)


class Shard:
    """A shard's lists, unpacked block by block as they are asked for."""

    def __init__(self, rows: pa.Table, n_docs: int, n_terms: int):
        lists = {r["term"]: r for r in rows.to_pylist()}
        head = lists.pop(_HEADER)
        longs = lambda b: np.frombuffer(b, "<i8")
        self.ids = head["ids"]
        self.measure = 100 - LENGTH_SHARE + LENGTH_SHARE * longs(head["body"]) * n_docs // max(n_terms, 1)
        self.rank = np.empty(len(self.ids), np.int64)
        self.rank[np.lexsort(([i or 0 for i in self.ids], [i is None for i in self.ids]))] = np.arange(len(self.ids))
        self.body, self.first, self.last, self.begin, self.bound, self.seen = {}, {}, {}, {}, {}, {}
        for term, r in lists.items():
            self.body[term], self.first[term], self.last[term] = r["body"], longs(r["first"]), longs(r["last"])
            self.begin[term] = [0, *longs(r["ends"]).tolist()]
            # Places are ordered by length, so a block's first document has its smallest measure.
            self.bound[term] = self.worth(longs(r["most"]), self.measure[self.first[term]])
            self.seen[term] = {}
        self.top = {term: int(b.max()) for term, b in self.bound.items()}

    @staticmethod
    def worth(freq: np.ndarray, measure: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * freq // (1000 * freq + 8 * measure)

    def block(self, term: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and worths of a block."""
        if k not in self.seen[term]:
            begin = self.begin[term]
            places, freq = _unpacked(self.body[term][begin[k] : begin[k + 1]], int(self.first[term][k]))
            self.seen[term][k] = places, self.worth(freq, self.measure[places])
        return self.seen[term][k]

    def blocks(self, term: int, which: list[int]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.block(term, k) for k in which]
        return np.concatenate([p for p, _ in got]), np.concatenate([w for _, w in got])

    def search(self, weights: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """(place, score) of the k best documents with a score, best first; weights: (term, weight)."""
        lists = sorted((w * self.top[t], t, w) for t, w in weights if t in self.top and w)
        if not lists:
            return []
        below = np.cumsum([0, *(b for b, _, _ in lists)])  # below[i]: what the i smallest bounds add up to
        least = 1
        # The most telling blocks of the most telling list give the first k scores.
        _, t, _ = lists[-1]
        best = np.argsort(-self.bound[t], kind="stable")[: 1 + k // BLOCK]
        least = max(least, self._kth(self._scored(self.blocks(t, best.tolist())[0], lists, below, least), k))
        cut = int(np.searchsorted(below, least, "left")) - 1  # the first `cut` lists together stay below least
        score = np.zeros(len(self.measure), np.int64)
        for bound, t, w in lists[cut:]:
            rest = int(below[-1]) - bound
            which = np.flatnonzero(w * self.bound[t] + rest >= least)
            if len(which):
                places, worth = self.blocks(t, which.tolist())
                score[places] += w * worth
        places = np.flatnonzero(score)
        places = places[score[places] + below[cut] >= least]
        return self._best(self._scored(places, lists[:cut], below, least, score[places]), k)

    def _scored(self, places: np.ndarray, lists: list[tuple[int, int, int]], below: np.ndarray, least: int, had: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted places and their scores with these lists, from the largest bound down; places that cannot reach least are left out."""
        score = np.zeros(len(places), np.int64) if had is None else had
        for i in range(len(lists) - 1, -1, -1):
            if not len(places):
                break
            _, t, w = lists[i]
            k = np.searchsorted(self.last[t], places)
            inside = k < len(self.last[t])
            inside[inside] = self.first[t][k[inside]] <= places[inside]
            most = np.zeros(len(places), np.int64)
            most[inside] = w * self.bound[t][k[inside]]
            stays = score + most + below[i] >= least  # before anything is unpacked
            places, score, k, inside = places[stays], score[stays], k[stays], inside[stays]
            if inside.any():
                had_places, worth = self.blocks(t, np.unique(k[inside]).tolist())
                at = np.searchsorted(had_places, places)
                at[at == len(had_places)] = 0
                score = score + np.where(had_places[at] == places, w * worth[at], 0)
        return places, score

    @staticmethod
    def _kth(scored: tuple[np.ndarray, np.ndarray], k: int) -> int:
        score = scored[1]
        return int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 0

    def _best(self, scored: tuple[np.ndarray, np.ndarray], k: int) -> list[tuple[int, int]]:
        places, score = scored
        order = np.lexsort((self.rank[places], -score))[:k]
        return [(p, s) for p, s in zip(places[order].tolist(), score[order].tolist(), strict=True) if s > 0]


def _answered(queries, n_docs: int, n_terms: int, k: int) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        shard, out = Shard(rows, n_docs, n_terms), []
        for item, weights in enumerate(queries.value):
            out += [(item, shard.ids[place], score) for place, score in shard.search(weights, k)]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.Table.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["_item", "doc_id", "score"])

    return run


def _in_blocks(items: DataFrame, text_col: str, chars: int) -> Iterator[list]:
    block, held = [], 0
    for row in items.toLocalIterator():
        block.append(row)
        held += len(row[text_col] or "")
        if held >= chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def _search_block(docs: DataFrame, block: list, items: DataFrame, text_col: str, id_col: str, item_text_col: str, k: int, shard_docs: int) -> DataFrame:
    spark = docs.sparkSession
    asked = [Counter(terms(row[item_text_col])) for row in block]
    words = sorted(set().union(*asked))
    where = scratch_path(spark, "shards")
    index(docs, words, text_col, id_col, shard_docs).write.parquet(where)
    shards = spark.read.schema(_INDEX).parquet(where)
    head = shards.where(F.col("term") == _HEADER).agg(F.sum("n").alias("docs"), F.sum("total").alias("terms")).first()
    n_docs, n_terms = int(head.docs or 0), int(head.terms or 0)
    df_of = {r.term: int(r.df) for r in shards.where(F.col("term") != _HEADER).groupBy("term").agg(F.sum("n").alias("df")).toLocalIterator()}
    weight = {words[t]: (t, math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))) for t, df in df_of.items()}
    queries = spark.sparkContext.broadcast([[(weight[w][0], n * weight[w][1]) for w, n in sorted(q.items()) if w in weight] for q in asked])
    found = shards.groupBy("shard").applyInArrow(_answered(queries, n_docs, n_terms, k), "_item int, doc_id long, score long")
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    merged = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    kept = [c for c in items.columns if c != item_text_col]
    # A block of items is bounded by BLOCK_CHARS.
    names = spark.createDataFrame([(i, *(row[c] for c in kept)) for i, row in enumerate(block)], "_item int, " + ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in kept))
    return merged.join(F.broadcast(names), "_item").select(*kept, "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", k: int = TOP, shard_docs: int = SHARD_DOCS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The items' columns without their text, with rank (from 1), doc_id and score: each item's k best documents.

    Terms are runs of letters and digits (every character from U+0080 on is one), A-Z in lower case. A
    null text has none. Only documents with a score above 0 are returned; equal scores are ranked by
    ascending doc_id, null ids last. Whole texts are counted, however long. Every row of docs is a
    document and every row of items an item: repeated rows are ranked and answered each. An empty table
    on either side gives no rows. Other columns of docs are not looked at; item columns named rank,
    doc_id or score are left out.
    """
    items = items.select(*(c for c in items.columns if c.lower() not in {"rank", "doc_id", "score", "_item"} or c == item_text_col))
    out = None
    for block in _in_blocks(items, item_text_col, block_chars):
        found = _search_block(docs, block, items, text_col, id_col, item_text_col, k, shard_docs)
        out = found if out is None else out.unionAll(found)
    if out is None:
        kept = [f"`{c}` {items.schema[c].dataType.simpleString()}" for c in items.columns if c != item_text_col]
        return docs.sparkSession.createDataFrame([], ", ".join([*kept, "rank int", "doc_id long", "score long"]))
    return out


def op13_ranked_search(spark, sf_dir) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return search(docs.select("doc_id", "text"), items.select("item_id", "text"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
sizes AS (SELECT doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
held AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d) GROUP BY doc_id, t),
asked AS (SELECT item_id, t, count(*)::BIGINT AS k FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
weights AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT t, count(*)::BIGINT AS df FROM held GROUP BY t), corpus),
scores AS (
  SELECT item_id, doc_id,
         sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (t) JOIN held USING (t) JOIN sizes USING (doc_id), corpus
  GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""
