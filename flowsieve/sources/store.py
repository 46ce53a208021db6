"""Flows and predictions as Parquet folders, one per micro-batch, by day inside.

A batch that is delivered again overwrites its own folders, so nothing doubles. A line of figures per
batch (rows, newest flow) lets retention drop whole folders without reading them. Rows are retired by a
line that a batch leaves behind: the time and id below which rows are gone, and how many are left.
served() shows what is not retired, of batches whose marker, written last, says that their
predictions are there too. Times prune by day.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.operators.lookups import active_blocks
from flowsieve.operators.upkeep import RETENTION_MINUTES, RETENTION_ROWS, cascade, fold_block_events, retained
from flowsieve.operators.sampling import newest
from flowsieve.schema import BLOCK_EVENTS, FLOWS, PREDICTIONS

_BATCH = [T.StructField("batch", T.LongType()), T.StructField("day", T.StringType())]
_SUMMARY = "batch long, rows long, newest timestamp"
_LINE = "batch long, us long, id long, left long"
_REJECTS = T.StructType([T.StructField("id", T.LongType()), T.StructField("reason", T.StringType()), T.StructField("value", T.StringType())])


def day_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


class FlowStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, kind: str, batch: int | None = None) -> str:
        return f"{self.root}/{kind}" + ("" if batch is None else f"/batch={batch}")

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def exists(self, kind: str, batch: int | None = None) -> bool:
        fs, where = self._fs(self._path(kind, batch))
        return fs.exists(where)

    def _read(self, kind: str, fields: list[T.StructField], parts: list[T.StructField]) -> DataFrame:
        schema = T.StructType([*fields, *parts])
        if not self.exists(kind):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(kind))

    def flows(self) -> DataFrame:
        return self._read("flows", FLOWS.fields, _BATCH).drop("day")

    def flows_since(self, since: datetime) -> DataFrame:
        """Flows from a time on; only the folders of those days are read."""
        stored, first = self._read("flows", FLOWS.fields, _BATCH), F.lit(since)
        return stored.where((F.col("day") >= day_of(first)) & (F.col("timestamp") >= first)).drop("day")

    def predictions(self) -> DataFrame:
        return self._read("predictions", PREDICTIONS.fields, _BATCH).drop("day")

    def rejects(self) -> DataFrame:
        """Records that could not be stored, with the reason."""
        return self._read("rejects", _REJECTS.fields, _BATCH[:1])

    def block_list(self) -> DataFrame:
        return active_blocks(fold_block_events(self._read("block_events", BLOCK_EVENTS.fields, _BATCH[:1])))

    def _write(self, kind: str, df: DataFrame, fields: list[T.StructField], batch: int, time: str | None = None) -> None:
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in fields])
        if time is None:
            rows.write.mode("overwrite").parquet(self._path(kind, batch))
        else:
            rows.withColumn("day", day_of(F.col(time))).write.mode("overwrite").partitionBy("day").parquet(self._path(kind, batch))

    def write_flows(self, df: DataFrame, batch: int) -> None:
        self._write("flows", df, FLOWS.fields, batch, "timestamp")
        written = self.flows().where(F.col("batch") == batch)
        figures = written.agg(F.lit(batch).alias("batch"), F.count(F.lit(1)).alias("rows"), F.max("timestamp").alias("newest"))
        figures.coalesce(1).write.mode("overwrite").json(self._path("figures", batch).replace("batch=", "of="))

    def write_predictions(self, df: DataFrame, batch: int) -> None:
        self._write("predictions", df, PREDICTIONS.fields, batch, "created_at")

    def write_block_events(self, df: DataFrame, batch: int) -> None:
        self._write("block_events", df, BLOCK_EVENTS.fields, batch)

    def write_rejects(self, df: DataFrame, batch: int) -> None:
        self._write("rejects", df, _REJECTS.fields, batch)

    def arrival(self, batch: int) -> datetime:
        """When a batch first came, written then: a second delivery gets the same time."""
        where = self._path("arrival", batch)
        if not self.exists("arrival", batch):
            row = [(int(datetime.now(timezone.utc).timestamp() * 1e6),)]
            self.spark.createDataFrame(row, "us long").coalesce(1).write.mode("overwrite").parquet(where)
        return datetime.fromtimestamp(self.spark.read.schema("us long").parquet(where).first()[0] / 1e6, timezone.utc)

    def figures(self) -> DataFrame:
        """(batch, rows, newest) of the stored batches."""
        if not self.exists("figures"):
            return self.spark.createDataFrame([], _SUMMARY)
        return self.spark.read.schema(_SUMMARY).json(self._path("figures"))

    def finish(self, batch: int) -> None:
        """Marks a batch as whole; to be called when its flows and predictions are written."""
        row = self.spark.createDataFrame([(batch,)], "batch long").coalesce(1)
        row.write.mode("overwrite").json(self._path("markers", batch).replace("batch=", "of="))

    def _above(self, flows: DataFrame, line: Row | None) -> DataFrame:
        if line is None or line.us is None:
            return flows
        us = F.unix_micros("timestamp")
        # Days below the line are not read.
        pruned = flows.where(F.col("day") >= day_of(F.timestamp_micros(F.lit(line.us)))) if "day" in flows.columns else flows
        return pruned.where((us > line.us) | ((us == line.us) & (F.col("id") >= line.id)))

    def line(self, before: int | None = None) -> Row | None:
        """The newest line of retired rows, of batches before the given one."""
        if not self.exists("lines"):
            return None
        lines = self.spark.read.schema(_LINE).json(self._path("lines"))
        return (lines if before is None else lines.where(F.col("batch") < before)).orderBy(F.desc("batch")).first()

    def retire(self, batch: int, now: datetime, minutes: int = RETENTION_MINUTES, max_rows: int = RETENTION_ROWS) -> int:
        """Draws the line below which rows are gone after this batch; returns how many went.

        Gone are flows older than the minutes, and all but the newest max_rows of the rest, of which the larger ids
        are the newer ones on equal times; zero or less sets no limit. A flow that arrives below the line
        goes at once and is counted. The same for a second delivery: only batches up to this one count.
        """
        if minutes <= 0 and max_rows <= 0:
            return 0
        before = self.line(batch)
        stored = self._read("flows", FLOWS.fields, _BATCH).where(F.col("batch") <= batch)
        arrived = stored.where(F.col("batch") == batch).count()
        known = before.left if before is not None else stored.where(F.col("batch") < batch).count()
        kept = self._above(stored, before)
        if minutes > 0:
            kept = kept.where((F.col("day") >= day_of(F.lit(now - timedelta(minutes=minutes)))) & (F.col("timestamp") >= F.lit(now - timedelta(minutes=minutes))))
        if max_rows > 0:
            kept = newest(kept.select("timestamp", "id"), max_rows)
        left, lowest = kept.agg(F.count(F.lit(1)), F.min(F.struct(F.unix_micros("timestamp").alias("us"), "id"))).first()
        gone = known + arrived - left
        if gone == 0:  # the line stays where it was: later flows may be older than all that are kept
            at = (before.us, before.id) if before is not None else (None, None)
        elif lowest is None:
            at = int((now - timedelta(minutes=minutes)).timestamp() * 1e6), -(1 << 62)
        else:
            at = lowest.us, lowest.id
        row = self.spark.createDataFrame([(batch, *at, left)], _LINE).coalesce(1)
        row.write.mode("overwrite").json(self._path("lines", batch).replace("batch=", "of="))
        return gone

    def served(self) -> tuple[DataFrame, DataFrame]:
        """(flows, predictions) of whole batches, without retired rows."""
        if not self.exists("markers"):
            return self.flows().where(F.lit(False)), self.predictions().where(F.lit(False))
        whole = self.spark.read.schema("batch long").json(self._path("markers"))
        stored = self._above(self._read("flows", FLOWS.fields, _BATCH), self.line()).drop("day")
        flows = stored.join(whole, "batch", "left_semi")
        return flows, cascade(self.predictions().join(whole, "batch", "left_semi"), flows)

    def retained(
        self, now: datetime, minutes: int = RETENTION_MINUTES, max_rows: int = RETENTION_ROWS
    ) -> tuple[DataFrame, DataFrame]:
        """(flows, predictions) that retention keeps at a time."""
        flows = retained(self.flows(), F.lit(now), minutes, max_rows)
        return flows, cascade(self.predictions(), flows)

    def drop_stale(self, now: datetime, minutes: int = RETENTION_MINUTES, max_rows: int = 0) -> int:
        """Delete the folders of batches that hold nothing retention keeps; returns how many.

        Those whose newest flow is older than the cutoff, and the oldest ones beyond the batches that
        hold the newest max_rows rows. Zero or less sets no limit. Only figures are read.
        """
        return self.purge(now, minutes, max_rows)[0]

    def purge(self, now: datetime, minutes: int = RETENTION_MINUTES, max_rows: int = RETENTION_ROWS) -> tuple[int, int]:
        """drop_stale(), and the number of flows that went."""
        stale, newer = [], 0
        for row in self.figures().orderBy(F.desc_nulls_last("newest"), F.desc("batch")).toLocalIterator():
            newest = row.newest.replace(tzinfo=timezone.utc) if row.newest and row.newest.tzinfo is None else row.newest
            old = minutes > 0 and newest is not None and newest < now - timedelta(minutes=minutes)
            if old or (max_rows > 0 and newer >= max_rows):
                stale.append((row.batch, row.rows))
            newer += row.rows
        for batch, _ in sorted(stale):
            lines = [self._path(kind, batch).replace("batch=", "of=") for kind in ("markers", "figures")]
            for path in (lines[0], self._path("predictions", batch), self._path("flows", batch), lines[1]):
                fs, where = self._fs(path)
                fs.delete(where, True)
        return len(stale), sum(rows for _, rows in stale)
