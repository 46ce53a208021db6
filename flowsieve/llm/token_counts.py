"""Operator 1, token counts: every distinct pre-token is encoded once, its number of pieces is
joined to the documents' pre-token frequencies, and the products are summed. No ids are kept.

Plan:
1. each input split emits its distinct pre-tokens with their frequency; one shuffle makes the corpus
   vocabulary, and a vocabulary row is encoded once;
2. a pre-token that is more than SHARE of all running words is a heavy hitter. There are at
   most 1 / SHARE of those whatever the input, so they are sent to every task and summed where the
   text is read: no frequent word is ever a shuffle key;
3. the other frequencies are shuffled as (row, pre-token, n), joined to the vocabulary and summed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.common import slices, table, with_row_id
from flowsieve.llm.wordbpe import VOCABULARY, pre_tokens, vocabulary_path
from flowsieve.session import scratch_path

#: Least share of all running words that makes a pre-token a heavy hitter.
SHARE = 1 / 300_000
TOKEN_LIMIT = 2048
#: Distinct runs between white space that a task holds.
HELD_CHUNKS = 400_000


def _local_vocabulary(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = pre_tokens(path), Counter()

        def out():
            words = Counter()
            for chunk, n in seen.items():
                for word in cut.words(chunk):
                    words[word] += n
            seen.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(words.keys(), pa.string()), "total": pa.array(words.values(), pa.int64())})

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update(cut.chunks(text))
            if len(seen) > HELD_CHUNKS:
                yield out()
        yield out()

    return run


def _count_pieces(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = pre_tokens(path)
        for batch in batches:
            pieces = pa.array(cut.n_pieces(batch.column("word").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces], ["word", "total", "pieces"])

    return run


def _frequencies(path: str, heavy, kept: list[str]) -> Callable:
    """One row for each text, with its kept columns and the tokens of its heavy hitters, and one for
    each other pre-token. The batches have the row number, the text and the kept columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = pre_tokens(path), heavy.value
        sums: dict[str, int] = {}  # of chunks that are all heavy hitters

        def look_up(chunk: str) -> int | None:
            pieces = [known.get(w) for w in cut.words(chunk)]
            if None in pieces:
                return None
            if len(sums) > HELD_CHUNKS:
                sums.clear()
            sums[chunk] = sum(pieces)
            return sums[chunk]

        for batch in slices(batches):
            rows, words, counts, n_bytes, places = [], [], [], [], []
            for place, (row, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                chunks = cut.chunks(text)
                pieces = list(map(sums.get, chunks))
                total, light = 0, Counter()
                if None in pieces:
                    new = Counter([c for c, n in zip(chunks, pieces, strict=True) if n is None])
                    total = sum(filter(None, pieces))
                    for chunk, n in new.items():
                        if (m := look_up(chunk)) is not None:
                            total += m * n
                        else:
                            for word in cut.words(chunk):
                                if word in known:
                                    total += known[word] * n
                                else:
                                    light[word] += n
                    rows += [row] * len(light)
                    words += light.keys()
                    counts += light.values()
                    n_bytes += [None] * len(light)
                    places += [None] * len(light)
                else:
                    total = sum(pieces)
                rows.append(row)
                words.append(f" {row}")  # no pre-token begins with a space: a key of its own
                counts.append(total)
                n_bytes.append(len(text.encode()) if text else 0)
                places.append(place)
            at = pa.array(places, pa.int32())
            arrays = [pa.array(rows, pa.int64()), pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(n_bytes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, *(batch.column(2 + k).take(at) for k in range(len(kept)))], ["_row", "_word", "_n", "_bytes", *kept])

    return run


def vocabulary(df: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """(word, total, pieces): every distinct pre-token of the column, encoded once."""
    path = path or vocabulary_path()
    local = df.select(F.col(text_col).alias("text")).mapInArrow(_local_vocabulary(path), "word string, total long")
    return local.groupBy("word").agg(F.sum("total").alias("total")).mapInArrow(_count_pieces(path), "word string, total long, pieces long")


def count_tokens(df: DataFrame, text_col: str = "text", path: str | None = None, share: float = SHARE) -> DataFrame:
    """df without its text, with n_bytes and n_tokens (longs), for every row: equal rows and rows without an id stay apart.

    A null text counts as empty: 0 bytes, 0 tokens. An empty table gives an empty table. Columns of
    df named n_bytes or n_tokens, or like the working columns _row, _word, _n and _bytes, are left
    out. Texts of any length are counted whole.
    """
    spark, path = df.sparkSession, path or vocabulary_path()
    df = df.select(F.col(text_col).alias("_text"), *(c for c in df.columns if c.lower() not in {text_col.lower(), "n_bytes", "n_tokens", "_row", "_word", "_n", "_bytes", "_text"}))
    kept = df.columns[1:]
    where = scratch_path(spark, "vocabulary")
    vocabulary(df, "_text", path).write.parquet(where)
    words = spark.read.parquet(where)
    least = (words.agg(F.sum("total")).first()[0] or 0) * share
    known = {r.word: r.pieces for r in words.where(F.col("total") > least).select("word", "pieces").toLocalIterator()}
    heavy = spark.sparkContext.broadcast(known)

    schema = T.StructType([*T.StructType.fromDDL("_row long, _word string, _n long, _bytes long").fields, *(T.StructField(f.name, f.dataType) for f in df.schema.fields[1:])])
    counted = with_row_id(df, "_row").select("_row", "_text", *kept).mapInArrow(_frequencies(path, heavy, kept), schema)
    light = words.where(F.col("total") <= least).select(F.col("word").alias("_word"), "pieces")
    return (
        counted.join(light, "_word", "left")
        .groupBy("_row")
        .agg(*(F.first(c, ignorenulls=True).alias(c) for c in kept), F.max("_bytes").alias("n_bytes"), F.sum(F.col("_n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"))
        .drop("_row")
    )


def op1_token_counts(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, path=vocabulary_path(VOCABULARY)).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))
