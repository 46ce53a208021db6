"""Operator 11, line dedup: levelled sorted runs of line hashes.

A store is a list of runs. A run is a Parquet table of (h1, h2, n, owner, hot), one row for each line
it knows, bucketed and sorted by hash: the 128 hash bits of the line's key, the documents that it was
seen in, the largest of their ids, and whether it was frequent in a batch. A new batch of documents
1. is reduced to its distinct lines with the documents of each and the largest id (combined where
   the texts are read, so a line of a third of all documents is one row a task);
2. is merge-anti-joined with the runs: of a line that a run has in enough documents already, with an
   owner that is not smaller, nothing new can be learned, and it is left out unless it is frequent;
3. is added as a run of level 0. Two runs of a level are merged into one of the next, so that a row is
   written once a level. Buckets are the same in all runs: they are merged without a shuffle.

The whole store's counts say which lines are dropped from which documents. Long texts are shuffled
once, to meet the hashes that they lose; texts are never keys.

Lines are equal if 128 bits of XXH3 of their keys are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.common import slices, table, unused
from flowsieve.session import scratch_path

#: Characters that are stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
LEAST_CHARS = 40
LEAST_DOCS = 5
#: Batches that a given table is cut into.
BATCHES = 6
#: A line in more than this share of a batch's (line, document) rows is frequent: at most 1 / SHARE are.
#: What is frequent in all batches together is so in one of them.
SHARE = 1 / 2000
#: Frequent lines that are looked up where the rows are read; any others meet their rows in the shuffle.
MOST_FREQUENT = 20_000
_RUN = "h1 long, h2 long, n long, owner long, hot boolean"
_COLUMNS = ["h1", "h2", "n", "owner", "hot"]


def _keys(lines: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.ascii_trim(lines, characters=BLANKS))


def _hashes(keys: pa.Array) -> np.ndarray:
    """Two longs of each key."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(map(digest, keys.cast(pa.binary()).to_pylist())), dtype="<i8").reshape(-1, 2)


def _split(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each line and the lines; a null text is an empty line."""
    lines = pc.split_pattern(pc.fill_null(text.cast(pa.large_string()), ""), "\n")
    return np.repeat(np.arange(len(text)), pc.list_value_length(lines).to_numpy()), pc.list_flatten(lines)


def _distinct(least_chars: int) -> Callable:
    """(doc, t, h1, h2): of each text its distinct keys of enough code points; t tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, lines = _split(batch.column(1))
            keys = _keys(lines)
            long = pc.greater_equal(pc.utf8_length(keys), least_chars)
            found = np.column_stack([row[long.to_numpy(zero_copy_only=False)], _hashes(keys.filter(long))])
            if len(found):
                found = found[np.lexsort(found.T)]
                found = found[np.append(True, (found[1:] != found[:-1]).any(axis=1))]
            at = pa.array(found[:, 0])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in (0, 2)), pa.array(found[:, 1]), pa.array(found[:, 2])], ["doc", "t", "h1", "h2"])

    return run


def long_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc, t, h1, h2): the distinct long lines of each row of df."""
    texts = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("t"))
    return texts.mapInArrow(_distinct(least_chars), "doc long, t long, h1 long, h2 long")


def _merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two sorted runs as one: a merge join of equal buckets."""
    a, b = one.alias("a"), other.hint("merge").alias("b")
    both = a.join(b, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full_outer")
    either = lambda c: F.coalesce(f"a.{c}", f"b.{c}").alias(c)
    n = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
    hot = F.coalesce("a.hot", F.lit(False)) | F.coalesce("b.hot", F.lit(False))
    return both.select(either("h1"), either("h2"), n.alias("n"), F.greatest("a.owner", "b.owner").alias("owner"), hot.alias("hot"))


class LineStore:
    """Levelled runs below a folder that all executors reach.

    A run is whole before the list that names it is written, and a list is a new file of its own: after
    a failure the last list holds, and `LineStore(spark, root)` goes on from there. Equal batches are
    counted as often as they are added.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None, least_docs: int = LEAST_DOCS):
        self.spark, self.root, self.least_docs = spark, root, least_docs
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(conf)
        self.version, self.levels, self.buckets = 0, [], buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        lists = self._path(f"{root}/lists")
        found = [int(s.getPath().getName()) for s in self._fs.listStatus(lists) if self._fs.exists(self._path(f"{root}/lists/{s.getPath().getName()}/_SUCCESS"))] if self._fs.exists(lists) else []
        if found:
            self.version = max(found)
            kept = json.loads(spark.read.text(f"{root}/lists/{self.version}").first()[0])
            self.levels, self.buckets = kept["levels"], kept["buckets"]

    def _name(self, run: str) -> str:
        return f"line_run_{xxhash.xxh64_hexdigest(f'{self.root}/{run}')}"

    def _named(self, run: str) -> str:
        """The run as a table of this session."""
        name = self._name(run)
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({_RUN}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.root}/runs/{run}'")
        return name

    def _write(self, rows: DataFrame, kind: str) -> str:
        run = f"{self.version + 1}-{kind}"
        # The rows come grouped by (h1, h2), so that a bucket is in few tasks and so in few files.
        named = rows.select(*_COLUMNS).write.mode("overwrite").format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        named.option("path", f"{self.root}/runs/{run}").saveAsTable(self._name(run))
        return run

    def _read(self, run: str) -> DataFrame:
        return self.spark.table(self._named(run))

    def runs(self) -> list[DataFrame]:
        return [self._read(run) for run in self.levels if run]

    def unsettled(self, lines: DataFrame) -> DataFrame:
        """Rows (h1, h2, n, owner, hot) without those of which a run knows enough already."""
        for run in self.runs():
            known = run.where(F.col("n") >= self.least_docs).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("owner").alias("had"))
            same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
            lines = lines.join(known.hint("merge"), same & ~F.col("hot") & F.coalesce(F.col("had") >= F.col("owner"), F.col("owner").isNull()), "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """A batch of long_lines() becomes a run; of each level two are merged."""
        least = lines.count() * SHARE
        once = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("owner"), (F.count("*") > least).alias("hot"))
        self._place(self._write(self.unsettled(once), "b"), 0)

    def _place(self, run: str, level: int) -> None:
        """The run becomes its level's, or is merged with the one that is there into the next level's."""
        gone = []
        levels = [*self.levels, *[None] * (level + 1 - len(self.levels))]
        while level < len(levels) and levels[level]:
            gone += [levels[level], run]
            run = self._write(_merged(self._read(levels[level]), self._read(run)), f"m{level}")
            levels[level] = None
            level += 1
        levels += [None] * (level + 1 - len(levels))
        levels[level] = run
        self._publish(levels, gone)

    def _publish(self, levels: list[str | None], gone: list[str]) -> None:
        self.version += 1
        self.spark.createDataFrame([(json.dumps({"levels": levels, "buckets": self.buckets}),)], "value string").coalesce(1).write.text(f"{self.root}/lists/{self.version}")
        self.levels = levels
        for run in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._named(run)}")
            self._fs.delete(self._path(f"{self.root}/runs/{run}"), True)

    def counts(self) -> DataFrame:
        """(h1, h2, n, owner, hot) of all batches so far, from one run into which all are merged. Of a line
        in fewer than least_docs documents n is their number, of another at least least_docs; owner is
        the largest id."""
        while len(found := [k for k, run in enumerate(self.levels) if run]) > 1:
            run, self.levels[found[0]] = self.levels[found[0]], None
            small = self._write(_merged(self._read(self.levels[found[1]]), self._read(run)), f"c{found[0]}")
            gone = [run, self.levels[found[1]]]
            self._publish([small if k == found[1] else x for k, x in enumerate(self.levels)], gone)
        return self._read(self.levels[found[0]]) if found else self.spark.createDataFrame([], _RUN)


def losses(lines: DataFrame, counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc, t, lost): of each text the hashes of the lines it loses."""
    spark, where = lines.sparkSession, scratch_path(lines.sparkSession, "repeated-lines")
    counts.where(F.col("n") >= least_docs).write.parquet(where)
    repeated = spark.read.schema(_RUN).parquet(where)
    # A bounded number of rows of a few bytes each.
    frequent = repeated.where("hot").orderBy(F.desc("n")).limit(MOST_FREQUENT).select("h1", "h2", F.col("owner").alias("top"), F.lit(True).alias("met"))
    frequent = F.broadcast(frequent)
    marked = lines.join(frequent, ["h1", "h2"], "left")
    lost = lambda owner: F.coalesce(F.col("doc") < F.col(owner), F.col("doc").isNull() & F.col(owner).isNotNull())
    hot = marked.where(F.col("met") & lost("top"))
    rest = marked.where(F.col("met").isNull()).join(repeated.select("h1", "h2", "owner"), ["h1", "h2"]).where(lost("owner"))
    both = hot.select("doc", "t", "h1", "h2").unionAll(rest.select("doc", "t", "h1", "h2"))
    return both.groupBy("doc", "t").agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))


def _kept(kept: int) -> Callable:
    """The text without the lines of `lost`, the lines before, and the lines dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            given, lost = batch.column(0), batch.column(1).to_pylist()
            text = pc.fill_null(given, "")
            n = pc.add(pc.count_substring(text, "\n"), 1)
            dropped = np.zeros(batch.num_rows, np.int64)
            touched = [k for k, x in enumerate(lost) if x]
            if touched:
                row, lines = _split(text.take(pa.array(touched)))
                digests = _hashes(_keys(lines))
                texts, lines, at = text.to_pylist(), lines.to_pylist(), 0
                ends = np.searchsorted(row, np.arange(len(touched)), "right")
                for k, end in zip(touched, ends.tolist(), strict=True):
                    gone = {(x["h1"], x["h2"]) for x in lost[k]}
                    stay = [line for line, h in zip(lines[at:end], map(tuple, digests[at:end].tolist()), strict=True) if h not in gone]
                    dropped[k] = end - at - len(stay)
                    texts[k], at = "\n".join(stay), end
                text = pa.array(texts, pa.string())
            text = text.cast(pa.string())
            if given.null_count:
                text = pa.array([t if had else None for t, had in zip(text.to_pylist(), given.is_valid().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(2 + k) for k in range(kept)), text, n.cast(pa.int64()), pa.array(dropped)], names=[f"c{k}" for k in range(kept + 3)])

    return run


def without_lines(df: DataFrame, lost: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """df with text_col less the lines of losses(), n_lines (before) and n_dropped."""
    new = ("n_lines", "n_dropped")
    kept = [c for c in df.columns if c.lower() not in (*new, text_col.lower())]
    doc, t, lost_col = unused(df, "_doc"), unused(df, "_t"), unused(df, "_lost")
    rows = df.select(*kept, text_col, F.col(id_col).cast("long").alias(doc), F.xxhash64(F.col(text_col)).alias(t))
    lost = lost.select(F.col("doc").alias("_of"), F.col("t").alias("_of_t"), F.col("lost").alias(lost_col))
    # Texts are unlike, so t spreads them; ids may be missing.
    joined = rows.join(lost, (F.col(t) == F.col("_of_t")) & F.col(doc).eqNullSafe(F.col("_of")), "left").select(text_col, lost_col, *kept)
    kinds = [*(df.schema[c].dataType for c in kept), T.StringType(), T.LongType(), T.LongType()]
    schema = T.StructType([T.StructField(f"c{k}", kind) for k, kind in enumerate(kinds)])
    out = joined.mapInArrow(_kept(len(kept)), schema)
    names = [*kept, text_col, *new]
    return out.toDF(*names).select(*[c for c in df.columns if c in names], *new)


def clean(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, store: LineStore | None = None) -> DataFrame:
    """df less its repeated lines, with n_lines (before) and n_dropped, through the runs of a store.

    A line's key has blanks stripped from both ends and A-Z in lower case. Keys of at least
    least_chars code points in at least least_docs documents stay only in the document of the largest id
    that holds them. df is added batch by batch from the largest id down, so that a line known well
    enough costs no further row in any run.

    Null and empty texts are one empty line, and stay null or empty; a text that loses all its lines is
    empty. Long texts are split whole. Every row is a document: repeated rows count as many, and all
    rows of the largest id keep the line. A null id is smaller than any other; where no document with an
    id has a line, all that have it keep it. An empty table gives an empty one. Columns named n_lines
    or n_dropped are replaced.
    """
    spark = df.sparkSession
    where = scratch_path(spark, "long-lines")
    shares = [k / batches for k in range(1, batches)]
    cuts = sorted(set(df.select(F.col(id_col).cast("long").alias("doc")).approxQuantile("doc", shares, 0.01)), reverse=True) if shares else []
    number = F.lit(len(cuts))
    for k, cut in reversed(list(enumerate(cuts))):
        number = F.when(F.col("doc") > cut, k).otherwise(number)
    long_lines(df, text_col, id_col, least_chars).withColumn("batch", number).write.partitionBy("batch").parquet(where)
    lines = spark.read.schema("doc long, t long, h1 long, h2 long, batch int").parquet(where)
    store = store or LineStore(spark, scratch_path(spark, "line-store"), least_docs=least_docs)
    for k in range(len(cuts) + 1):
        store.add(lines.where(F.col("batch") == k).select("doc", "t", "h1", "h2"))
    return without_lines(df, losses(lines, store.counts(), least_docs), text_col, id_col)


def op11_line_dedup(spark, sf_dir) -> DataFrame:
    docs = clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM split),
repeated AS (
  SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, coalesce(doc_id <> owner, false) AS gone FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
