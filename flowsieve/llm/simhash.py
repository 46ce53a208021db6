"""Operator 7, SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into two halves of 32 bits. Two fingerprints that differ at three bits or
fewer have a half where they differ at one bit or none, so they share that half, or that half with
one bit left out. Each fingerprint is indexed under its halves and under their 64 variants with one
bit left out; equal keys are joined and the whole fingerprints compared.

Only distinct fingerprints are indexed: copies are one row before any join. Fingerprints of one
large group of near copies share keys, so a key with more than `crowd` fingerprints is cut again:
the other half, where its members may differ, is indexed by the same rule in parts of 16 and then
8 bits, under keys that hold the outer key. A group at the last level has so few free bits that its
size is bounded, whatever the table holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.common import slices, table
from flowsieve.session import pinned

WORDS = 3
DISTANCE = 3
SEED = 42
#: Hashes whose bits are counted at once.
COUNTED = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of a text's word shingles, signed; a bit is set if it is in over half of the hashes."""
    if not text:
        return 0
    parts = text.encode().lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D divide
    if not parts:
        return 0
    joined, sizes = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes).tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)]), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        counts += np.unpackbits(hashes[at : at + COUNTED], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def with_fingerprints(df: DataFrame, text_col: str = "text", name: str = "fingerprint", keep_text: bool = True) -> DataFrame:
    """df with the fingerprint of every row's text as a signed long; a column of that name is replaced."""
    df = df.drop(name)
    kept = [c for c in df.columns if keep_text or c.lower() != text_col.lower()]
    place, places = df.columns.index(text_col), [df.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = pa.array([fingerprint(t) for t in batch.column(place).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in places), made], [*kept, name])

    return df.mapInArrow(run, T.StructType([*(df.schema[k] for k in places), T.StructField(name, T.LongType())]))


def _variants(rows: DataFrame, level: int, bits: int) -> DataFrame:
    """Each row under the two halves of its `bits` free bits, whole and with one bit left out.

    side is the bit left out, or 2; rest holds the bits of the other half."""
    half = bits // 2
    mask = (1 << half) - 1
    part = lambda at: F.shiftright("rest", half * at).bitwiseAND(F.lit(mask))

    def entry(at: int, bit: int) -> Column:
        whole = bit == half
        held = part(at) if whole else part(at).bitwiseAND(F.lit(mask ^ (1 << bit)))
        side = F.lit(2).cast("long") if whole else F.shiftright(part(at), bit).bitwiseAND(F.lit(1))
        return F.struct((held + F.lit((at * (half + 1) + bit) << half)).alias("key"), side.alias("side"), part(1 - at).alias("other"))

    found = F.explode(F.array(*(entry(at, bit) for at in (0, 1) for bit in range(half + 1))))
    before = [c for c in rows.columns if c[:3] in ("key", "sid")]
    return rows.select("fp", *before, found.alias("v")).select("fp", *before, F.col("v.key").alias(f"key{level}"), F.col("v.side").cast("byte").alias(f"side{level}"), F.col("v.other").alias("rest"))


def _joined(rows: DataFrame, levels: int) -> DataFrame:
    """Pairs under one key that are near. A left-out bit must differ: without it, the whole half is shared too."""
    keys = [f"key{k}" for k in range(levels)]
    left, right = rows.drop("rest", "n"), rows.drop("rest", "n")
    for name in ("fp", *(f"side{k}" for k in range(levels))):
        left, right = left.withColumnRenamed(name, f"{name}_a"), right.withColumnRenamed(name, f"{name}_b")
    found = left.join(right, keys).where(F.col("fp_a") < F.col("fp_b")).where(F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= DISTANCE)
    for k in range(levels):
        found = found.where((F.col(f"side{k}_a") == 2) | (F.col(f"side{k}_a") != F.col(f"side{k}_b")))
    return found.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))


def near_pairs(fingerprints: DataFrame, crowd: int = 200) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct longs in column fp that differ at DISTANCE bits or fewer."""
    rows, found = fingerprints.select("fp", F.col("fp").alias("rest")), None
    for level, bits in enumerate((64, 32, 16)):
        keys = [f"key{k}" for k in range(level + 1)]
        variants = _variants(rows, level, bits)
        counts = variants.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        shared = pinned(variants.join(counts, keys))  # most keys hold one fingerprint and end here
        last = bits == 16
        calm = _joined(shared if last else shared.where(F.col("n") <= crowd), level + 1)
        found = calm if found is None else found.union(calm)
        rows = shared.where(F.col("n") > crowd).drop("n")
        if last or rows.isEmpty():
            break
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) is linked with.

    Large and small stars in turn, which shorten every path to its least node in few rounds;
    each round is one checkpoint in the shared folder, and only counts come to the driver.
    """
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())
    edges = pinned(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = print_of(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = pinned(small)
        now = print_of(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def fingerprint_roots(rows: DataFrame, id_col: str) -> DataFrame:
    """(fp, root, first_id) of the distinct fingerprints in rows (id, fp): their component, and the
    smallest id in it (null if it has none)."""
    nodes = pinned(rows.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    links = components(near_pairs(nodes.select("fp")))
    rooted = nodes.join(links, nodes.fp == links.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    first = rooted.groupBy("root").agg(F.min("first_id").alias("first_id"))
    return rooted.drop("first_id").join(first, "root")


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """For every row: id, fingerprint (16 hex digits) and component_id, the smallest id reachable.

    Null texts and texts without words have fingerprint zero and are linked like any other; shorter
    texts than a shingle count as one; equal rows stay apart; ties can't arise, since the smallest id
    is one value; a component without any id has a null component_id. Other columns are left out.
    """
    rows = with_fingerprints(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), name="fp", keep_text=False)
    rows = pinned(rows)
    roots = fingerprint_roots(rows, "doc_id")
    return rows.join(roots, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first_id").alias("component_id"))


def one_of_each(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """df with one row of each component: that of the smallest id (if equal, of the smallest
    fingerprint), or any one of rows that are equal in both; ids may be null."""
    columns, fp = df.columns, "_simhash"
    rows = pinned(with_fingerprints(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), name="fp", keep_text=False).distinct())
    roots = fingerprint_roots(rows, "doc_id")
    stays = rows.join(roots, "fp").where(F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("root").agg(F.min("fp").alias("fp"), F.first("first_id").alias("first_id")).select("fp", "first_id")
    found = with_fingerprints(df, text_col, fp)
    kept = found.join(stays, (found[fp] == stays.fp) & found[id_col].eqNullSafe(stays.first_id), "left_semi")
    return kept.dropDuplicates([fp, id_col]).select(*columns)


def op7_simhash(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
