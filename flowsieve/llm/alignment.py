"""Operator 12, cross-tokenizer alignment: inverted bitmaps of the token pairs that cover the same bytes.

Tokens of two tokenizers, A and B, over the same bytes are linked where their byte ranges overlap, and
grouped between the places where tokens of both end.

1. A text is cut before each space that follows another character than white space. No token of either
   vocabulary spans such a place, so both tokenizers work on the pieces, each distinct piece once while a
   worker keeps it, and groups and links are those of the pieces.
2. Documents come in blocks. Per pair and block there is a bitmap of the documents that hold the pair
   linked, and one for each binary digit of their further links (the multiplicity planes): sorted places
   of two bytes where few are set, else a plain bitmap. The bitmaps of a block's parts are OR-merged.
3. Popcounts summed over the blocks are the pairs' document counts, and with the planes' weights their
   link counts; the largest count of each A id marks its best pairs.
4. The postings, which are read and never sorted again, return count and mark to their documents. Pairs
   in more than SHARE of all (pair, document) entries (at most 1 / SHARE) are sent to every task; the
   postings of the others are joined to their counts.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.bpe_codec import byte_symbols
from flowsieve.llm.common import slices, table
from flowsieve.llm.wordbpe import vocabulary_path
from flowsieve.session import scratch_path

A_VOCABULARY = "byte_bpe_50k.json"
B_VOCABULARY = "piece_bpe_32k.model"
#: Documents of a block; places have two bytes.
BLOCK_DOCS = 4096
_PLACE_BITS = 12
#: A block ends early with so many (pair, document) entries.
BLOCK_ENTRIES = 1_000_000
#: Distinct pieces, and their bytes, that a worker keeps.
HELD_PIECES = 150_000
HELD_BYTES = 30_000_000
#: New pieces that vocabulary A's tokenizer gets as one text.
JOINED = 256
#: Least share of all (pair, document) entries that makes a pair a heavy hitter.
SHARE = 1 / 500_000
#: Blocks whose documents' sums a task holds.
HELD_BLOCKS = 64
_PLAIN = BLOCK_DOCS // 8
_POSTINGS = "pair long, block long, plane int, n int, docs binary"


class Aligner:
    """Both tokenizers, and what they make of the pieces seen lately."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        back = {s: b for b, s in enumerate(byte_symbols())}
        self.a_bytes = {i: bytes(back[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in back for c in t)}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
        self.lone = names.index("▁")
        if any("▁" in t.lstrip("▁") for t in names):
            raise ValueError("a piece of the B vocabulary has a space inside")
        self.a_sizes, self.b_sizes = np.zeros(max(self.a_bytes) + 1, np.int64), np.array(list(map(len, self.b_bytes)))
        for i, t in self.a_bytes.items():
            self.a_sizes[i] = len(t)
        #: Ids as written inside a group and at the end of their part of it: A's, then B's.
        self.written = [f"{i}{end}" for i in range(len(self.a_sizes)) for end in ",|"] + [f"{i}{end}" for i in range(len(self.b_sizes)) for end in ",;"]
        self.pieces_of = re.compile(r" (?<=\S )").split
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        #: By number of a piece; the first is every piece that the tokenizers don't give back.
        self.said: list[str] = [""]
        self.sizes = array("q", [0] * 4)  # A tokens, B tokens, groups, links
        self.starts, self.links = array("q", [0, 0]), array("q")

    def _joined(self, pieces: list[str], of_a: list[list[int]], of_b: list[list[int]]) -> None:
        """Keeps what pieces come to whose bytes are those of their A tokens and of their B tokens: all together, as one run of bytes."""
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (of_a, of_b))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (of_a, of_b))
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        # Each token is written with what follows it: that depends on its being the last of its group.
        code = np.concatenate([a * 2 + (np.diff(group_a, append=-1) != 0), 2 * len(self.a_sizes) + b * 2 + (np.diff(group_b, append=-1) != 0)])
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        written = list(map(self.written.__getitem__, code[order].tolist()))
        ends = np.cumsum(n_a + n_b)
        self.said += ["".join(written[i:j])[:-1] for i, j in zip((ends - n_a - n_b).tolist(), ends.tolist(), strict=True)]
        # Between two neighbouring ends of either kind lies one link.
        either = np.union1d(ends_a, ends_b)
        links = a[np.searchsorted(ends_a, either)] << 32 | b[np.searchsorted(ends_b, either)]
        n_groups = np.bincount(np.searchsorted(ends_a[np.cumsum(n_a) - 1], cuts), minlength=len(pieces))
        n_links = n_a + n_b - n_groups
        self.known.update(zip(pieces, range(len(self.said) - len(pieces), len(self.said)), strict=True))
        self.sizes.frombytes(np.column_stack([n_a, n_b, n_groups, n_links]).astype(np.int64).tobytes())
        self.starts.frombytes((self.starts[-1] + np.cumsum(n_links)).tobytes())
        self.links.frombytes(links.tobytes())

    def _of_a(self, texts: list[str], alone: int) -> list[list[int]]:
        """A tokens of each text (a space and a piece). All but the last `alone` end with another character than white
        space, so that the next one's space is where no token goes across: they are encoded many as one."""
        encoded = lambda some: [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)]
        many = len(texts) - alone
        runs = [texts[k : min(k + JOINED, many)] for k in range(0, many, JOINED)]
        out = []
        for run, ids in zip(runs, encoded(["".join(run) for run in runs]), strict=True):
            stops, ends = np.cumsum(self.a_sizes[ids]), np.cumsum([len(t.encode()) for t in run])
            at = np.searchsorted(stops, ends)
            if stops[-1] == ends[-1] and (stops[at] == ends).all():
                at = [0, *(at + 1).tolist()]
                out += [ids[i:j] for i, j in zip(at, at[1:], strict=False)]
            else:  # tokens that are not the text's bytes
                out += encoded(run)
        return out + encoded(texts[many:])

    def learn(self, pieces: set[str]) -> None:
        if len(self.said) > HELD_PIECES or self.held > HELD_BYTES:
            self._forget()
        new = list(pieces.difference(self.known))
        alone = [p for p in new if not p or p[-1].isspace()]
        if alone:
            new = [p for p in new if p and not p[-1].isspace()] + alone
        of_a = self._of_a([f" {p}" for p in new], len(alone))
        of_b = [ids or [self.lone] for ids in self.b.encode(new, num_threads=1)]
        texts = [b" " + p.encode() for p in new]
        self.held += sum(map(len, texts))
        spelt = lambda ids, of: b"".join(map(of.__getitem__, ids))
        whole = b"".join(texts)
        if not spelt(chain.from_iterable(of_a), self.a_bytes) == whole == spelt(chain.from_iterable(of_b), self.b_bytes):
            good = [spelt(a, self.a_bytes) == t == spelt(b, self.b_bytes) for t, a, b in zip(texts, of_a, of_b, strict=True)]
            self.known.update((p, 0) for p, ok in zip(new, good, strict=True) if not ok)
            new, of_a, of_b = ([x for x, ok in zip(xs, good, strict=True) if ok] for xs in (new, of_a, of_b))
        if new:
            self._joined(new, of_a, of_b)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of each text the numbers of A tokens, B tokens, groups and links, and its groups as written; and the row and pair of each link."""
        cut = [self.pieces_of(" " + t) if t else [] for t in texts]
        for p in cut:
            if p:
                p[0] = p[0][1:]
        self.learn(set().union(*cut))
        known, said = self.known, self.said
        places = [list(map(known.__getitem__, p)) for p in cut]
        places = [p if p and 0 not in p else [] for p in places]
        written = [";".join(map(said.__getitem__, p)) for p in places]
        lengths = list(map(len, places))
        at = np.fromiter((k for p in places for k in p), np.int64, sum(lengths))
        row = np.repeat(np.arange(len(texts)), lengths)
        sizes = np.frombuffer(self.sizes, np.int64).reshape(-1, 4)
        totals = np.zeros((len(texts), 4), np.int64)
        for k in range(4):
            totals[:, k] = np.bincount(row, sizes[at, k], len(texts))
        starts, n = np.frombuffer(self.starts, np.int64)[at], sizes[at, 3]
        steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        links = np.frombuffer(self.links, np.int64)[np.repeat(starts, n) + steps] if self.links else np.empty(0, np.int64)
        return totals, written, np.repeat(row, n), links


@lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # every core has a task of its own
    return Aligner(a_path, b_path)


def _bitmaps(pair: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Pairs, their numbers of documents and their bitmaps, from entries sorted by pair and place."""
    starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, np.int64)
    n = np.diff(np.append(starts, len(pair)))
    dense = n * 2 > _PLAIN
    # Rows in the order of pairs: those of few places first, then plain bitmaps.
    in_dense = np.repeat(dense, n)
    few = place[~in_dense].astype("<u2").tobytes()
    bits = np.zeros((int(dense.sum()), BLOCK_DOCS), bool)
    bits[np.repeat(np.arange(len(bits)), n[dense]), place[in_dense]] = True
    sizes = np.concatenate([n[~dense] * 2, np.full(len(bits), _PLAIN)])
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    docs = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(few + np.packbits(bits, axis=1).tobytes())])
    return np.concatenate([pair[starts][~dense], pair[starts][dense]]), np.concatenate([n[~dense], n[dense]]), docs


def _postings(block: int, key: np.ndarray, further: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block's rows from its entries (pair and place) and the further links of each: plane -1 has the
    documents of a pair, plane k those with digit k in the number of further links."""
    order = np.argsort(key)
    key, further = key[order], further[order]
    plane, on = -1, np.ones(len(key), bool)
    while True:
        if on.any():
            pair, n, docs = _bitmaps(key[on] >> _PLACE_BITS, key[on] & BLOCK_DOCS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.full(len(n), block)), pa.array(np.full(len(n), plane), pa.int32()), pa.array(n, pa.int32()), docs], ["pair", "block", "plane", "n", "docs"])
        plane += 1
        if not (further >> plane).any():
            return
        on = (further >> plane & 1).astype(bool)


def _filled(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The batch with nulls for the columns it lacks."""
    return pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)


def _read_blocks(a_path: str, b_path: str, kept: int, digest: bool, rows: int) -> Callable:
    """Rows of documents and of postings. The batches have the text and the kept columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block, place, keys, further, held = _aligner(a_path, b_path), TaskContext.get().partitionId() << 32, 0, [], [], 0
        schema = None
        for batch in slices(batches, rows):
            if schema is None:
                fields = [*((f"c{k}", batch.schema.types[1 + k]) for k in range(kept)), *((c, pa.int64()) for c in ("id", "n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string())]
                schema = pa.schema([*fields, ("pair", pa.int64()), ("block", pa.int64()), ("plane", pa.int32()), ("n", pa.int32()), ("docs", pa.binary())])
            if place + batch.num_rows > BLOCK_DOCS or held > BLOCK_ENTRIES:
                if held:
                    yield from (_filled(b, schema) for b in _postings(block, np.concatenate(keys), np.concatenate(further)))
                block, place, keys, further, held = block + 1, 0, [], [], 0
            totals, written, row, pair = aligner.read(batch.column(0).to_pylist())
            if digest:
                written = [sha256(w.encode()).hexdigest() if w else "" for w in written]
            made = {f"c{k}": batch.column(1 + k) for k in range(kept)} | {c: pa.array(totals[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
            made |= {"id": pa.array((block << _PLACE_BITS) + place + np.arange(batch.num_rows)), "groups": pa.array(written, pa.string())}
            yield _filled(pa.RecordBatch.from_pydict(made), schema)
            key, times = np.unique(pair << _PLACE_BITS | row + place, return_counts=True)
            keys.append(key)
            further.append(times - 1)
            held += len(key)
            place += batch.num_rows
        if held:
            yield from (_filled(b, schema) for b in _postings(block, np.concatenate(keys), np.concatenate(further)))

    return run


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, best, total): what postings with their pair's count and mark give their documents."""
    sums: dict[int, np.ndarray] = {}

    def out():
        blocks = list(sums)
        both = np.stack(list(sums.values())) if sums else np.empty((0, BLOCK_DOCS, 2), np.int64)
        sums.clear()
        at, place = np.nonzero(both[:, :, 1])
        ids = (np.array(blocks, np.int64)[at] << _PLACE_BITS) + place
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(both[at, place, 0]), pa.array(both[at, place, 1])], ["id", "best", "total"])

    for batch in batches:
        block, plane, n, count, best = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("block", "plane", "n", "count", "best"))
        times = 1 << np.maximum(plane, 0).astype(np.int64)
        found, of = np.unique(block, return_inverse=True)
        acc = np.zeros((len(found), BLOCK_DOCS, 2), np.int64)
        docs, dense = batch.column(batch.schema.names.index("docs")), n.astype(np.int64) * 2 > _PLAIN
        few = docs.filter(pa.array(~dense))
        row = np.repeat(np.flatnonzero(~dense), n[~dense])
        place = np.frombuffer(b"".join(few.to_pylist()), "<u2").astype(np.int64)
        bits = np.unpackbits(np.frombuffer(b"".join(docs.filter(pa.array(dense)).to_pylist()), np.uint8)).reshape(-1, BLOCK_DOCS)
        which, full = np.nonzero(bits)
        row, place = np.concatenate([row, np.flatnonzero(dense)[which]]), np.concatenate([place, full])
        np.add.at(acc, (of[row], place, 0), (times * best)[row])
        np.add.at(acc, (of[row], place, 1), (times * count)[row])
        for k, b in enumerate(found.tolist()):
            if b in sums:
                sums[b] += acc[k]
            else:
                sums[b] = acc[k]
        if len(sums) > HELD_BLOCKS:
            yield out()
    yield out()


def align(df: DataFrame, text_col: str = "text", a_path: str | None = None, b_path: str | None = None, digest: bool = False, share: float = SHARE, rows: int = 128) -> DataFrame:
    """df without its text, with n_a, n_b, n_groups, n_links, n_best, count_sum (longs) and groups, of every row.

    groups is `a1,a2|b1;a3|b2,b3`, the ids of each group in order, or its SHA-256 if digest. n_best
    counts the links whose pair is in as many documents as any pair of their A id (ties included),
    count_sum adds up these numbers over the links.

    A text that is null or empty, or that either tokenizer doesn't give back byte by byte, has no
    tokens: zeros and an empty string. Long texts are read whole. Every row is a document: repeated rows
    count as many. An empty table gives an empty one. Columns of these names are replaced.
    """
    spark = df.sparkSession
    a_path, b_path = a_path or vocabulary_path(A_VOCABULARY), b_path or vocabulary_path(B_VOCABULARY)
    new = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    kept = [c for c in df.columns if c.lower() not in (*new, text_col.lower())]
    own = ", ".join(["id long", *(f"{c} long" for c in new[:4]), "groups string", _POSTINGS])
    schema = T.StructType([*(T.StructField(f"c{k}", df.schema[c].dataType) for k, c in enumerate(kept)), *T.StructType.fromDDL(own).fields])
    where = scratch_path(spark, "pair-bitmaps")
    df.select(text_col, *kept).mapInArrow(_read_blocks(a_path, b_path, len(kept), digest, rows), schema).write.parquet(where)
    written = spark.read.schema(schema).parquet(where)
    postings = written.where(F.col("pair").isNotNull()).select("pair", "block", "plane", "n", "docs")
    docs = written.where(F.col("id").isNotNull()).select(*(f"c{k}" for k in range(len(kept))), "id", *new[:4], "groups")

    found = scratch_path(spark, "pair-counts")
    counts = postings.where(F.col("plane") < 0).groupBy("pair").agg(F.sum("n").alias("count"))
    counts.write.parquet(found)
    counts = spark.read.schema("pair long, count long").parquet(found)
    # A row for each id of vocabulary A at most.
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"), F.sum("count").alias("all")).collect()
    least = sum(r["all"] for r in most) * share
    most = F.broadcast(spark.createDataFrame([(r["a"], r["most"]) for r in most], "a long, most long"))
    marked = counts.join(most, F.shiftright("pair", 32) == F.col("a")).select(F.col("pair").alias("_pair"), "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    heavy, light = marked.where(F.col("count") > least), marked.where(F.col("count") <= least)
    sent = postings.join(F.broadcast(heavy), F.col("pair") == F.col("_pair"), "left")
    returned = "id long, best long, total long"
    of_heavy = sent.where(F.col("_pair").isNotNull()).drop("pair", "_pair").mapInArrow(_returned, returned)
    of_light = sent.where(F.col("_pair").isNull()).drop("_pair", "count", "best").join(light, F.col("pair") == F.col("_pair")).drop("pair", "_pair").mapInArrow(_returned, returned)
    scores = of_heavy.unionAll(of_light).groupBy("id").agg(F.sum("best").alias("best"), F.sum("total").alias("total")).withColumnRenamed("id", "_id")
    both = docs.join(scores, F.col("id") == F.col("_id"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    values = {c: F.col(c) for c in (*new[:4], "groups")} | {"n_best": zero("best"), "count_sum": zero("total")}
    return both.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(kept)), *(values[c].alias(c) for c in new))


def link_counts(df: DataFrame, text_col: str = "text", a_path: str | None = None, b_path: str | None = None, rows: int = 128) -> DataFrame:
    """(a, b, docs, links): of every linked pair of ids the documents that hold it and its links there."""
    a_path, b_path = a_path or vocabulary_path(A_VOCABULARY), b_path or vocabulary_path(B_VOCABULARY)
    own = T.StructType.fromDDL("id long, n_a long, n_b long, n_groups long, n_links long, groups string, " + _POSTINGS)
    postings = df.select(text_col).mapInArrow(_read_blocks(a_path, b_path, 0, True, rows), own).where(F.col("pair").isNotNull())
    links = F.col("n") * F.when(F.col("plane") > 0, F.expr("shiftleft(1L, plane)")).otherwise(1)
    summed = postings.groupBy("pair").agg(F.sum(F.when(F.col("plane") < 0, F.col("n")).otherwise(0)).alias("docs"), F.sum(links).alias("links"))
    return summed.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "docs", "links")


def op12_tokenizer_alignment(spark, sf_dir) -> DataFrame:
    docs = align(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return docs.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
