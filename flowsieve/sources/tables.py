"""CSV, Parquet, JDBC and JSON readers and writers of the library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.operators.sampling import exact_sample
from flowsieve.schema import FLOWS, PREDICTIONS, TRAFFIC_LOG


def read_traffic_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAFFIC_LOG).csv(path)


def _text_schema(spark: SparkSession, path: str) -> T.StructType:
    # Only the header is needed; every column stays text.
    return spark.read.option("header", True).option("inferSchema", False).csv(path).schema


def read_text_csv(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """CSV with all columns text; lines with too many cells dropped, short lines filled with nulls.

    Files have a header line unless the column names are given.
    """
    header = names is None
    names = list(names or [f.name for f in _text_schema(spark, path).fields])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, "_bad")])
    # Cells can only be counted when no column is skipped while parsing.
    raw = (
        spark.read.schema(schema)
        .options(header=header, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", columnPruning=False)
        .csv(path)
    )
    # Spark flags missing and surplus cells alike; count the separators outside quotes.
    separators = F.length(F.regexp_replace(F.regexp_replace("_bad", r'"([^"]|"")*"', ""), "[^,]", ""))
    # Spark refuses a scan of the flag alone, as a bare count would be: name a data column too.
    touched = F.length(F.concat_ws("", F.col(names[0]))) >= 0
    return raw.where(touched & (F.col("_bad").isNull() | (separators < len(names)))).select(*names)


def read_labelled_csv(spark: SparkSession, path: str, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Labelled flows, optionally a repeatable sample of an exact size."""
    df = read_text_csv(spark, path)
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("")) for c in df.columns])
    return exact_sample(df, key, sample, seed)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header in every part file; one part only on request."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_flows(flows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Flow table partitioned by day; the rebalance hint splits heavy days and merges light ones."""
    (
        flows.select(*[F.col(f.name).cast(f.dataType) for f in FLOWS.fields])
        .withColumn("day", F.to_date("timestamp"))
        .hint("rebalance", "day")
        .write.mode(mode)
        .partitionBy("day")
        .parquet(path)
    )


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Flow table; filters on day prune folders, filters on timestamp reach the files."""
    return spark.read.schema(T.StructType(FLOWS.fields + [T.StructField("day", T.DateType())])).parquet(path)


def since(flows: DataFrame, cutoff) -> DataFrame:
    """Stored flows from a time on, pruned by day."""
    return flows.where((F.col("day") >= F.to_date(cutoff)) & (F.col("timestamp") >= cutoff))


def write_predictions(predictions: DataFrame, path: str, mode: str = "append") -> None:
    predictions.select(*[F.col(f.name).cast(f.dataType) for f in PREDICTIONS.fields]).write.mode(mode).parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTIONS).parquet(path)


def read_jdbc(spark: SparkSession, url: str, name: str, split_column: str | None = None, bounds=None, splits: int = 8, **options) -> DataFrame:
    """A table of an outside database; with a split column it is read in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if split_column:
        low, high = bounds
        reader = reader.options(partitionColumn=split_column, lowerBound=low, upperBound=high, numPartitions=splits)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", **options) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", name).options(**options).mode(mode).save()


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
