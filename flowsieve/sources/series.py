"""Time-series CSV files laid out as <base>/<folder>/<granularity>/*.csv.

Folder names may also be written as key=value, as a partitioned write leaves them.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.schema import SERIES_FOLDERS, SERIES_LEVELS

#: Bytes of a file's beginning that its header line has to end in.
HEADER_BYTES = 1 << 20


def _list_csv(spark: SparkSession, directory: str, recursive: bool = False) -> list[str]:
    """CSV paths of a directory in name order; a missing directory has none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found, it = [], fs.listFiles(path, recursive)
    while it.hasNext():
        name = it.next().getPath().toString()
        if name.endswith(".csv"):
            found.append(name)
    return sorted(found)


def series_files(
    spark: SparkSession,
    base: str,
    folders: tuple[str, ...] = SERIES_FOLDERS,
    levels: tuple[str, ...] = SERIES_LEVELS,
    max_files: int | None = None,
) -> list[str]:
    """Files by folder, level and name: all, or the first max_files."""
    paths = [p for folder in folders for level in levels for p in _list_csv(spark, f"{base}/{folder}/{level}")]
    return paths[:max_files]


def tree_files(spark: SparkSession, base: str) -> list[str]:
    """Every CSV file below a directory."""
    return _list_csv(spark, base, recursive=True)


def _first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a file, of at most HEADER_BYTES; none if it is empty or can't be opened."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    try:
        stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    except Py4JJavaError:
        return None
    begin = jvm.org.apache.commons.io.input.BoundedInputStream(stream, HEADER_BYTES)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(begin, "UTF-8"))
    try:
        return reader.readLine()
    finally:
        reader.close()


def _by_header(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files grouped by their header line; files without one are left out.

    The driver reads one line of each file it has listed, many at a time; no file is read whole.
    """
    paths = sorted(paths)
    with ThreadPoolExecutor(32) as pool:
        headers = list(pool.map(lambda p: _first_line(spark, p), paths))
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, header in zip(paths, headers, strict=True):
        if header:
            names = tuple(n.strip().strip('"') for n in header.lstrip("\ufeff").split(","))
            groups.setdefault(names, []).append(path)
    return groups


def _load(spark: SparkSession, names: tuple[str, ...], paths: list[str], wanted: tuple[str, ...]) -> DataFrame:
    schema = ", ".join(f"`{n}` STRING" for n in names)
    raw = spark.read.schema(schema).option("header", True).option("ignoreCorruptFiles", True).csv(paths)
    pieces = F.split(F.col("_metadata.file_path"), "/")
    return raw.select(
        F.regexp_replace(F.element_at(pieces, -3), "^[a-z_]+=", "").alias("folder"),
        F.regexp_replace(F.element_at(pieces, -2), "^[a-z_]+=", "").alias("agg_level"),
        *[F.expr(f"try_cast(`{n}` AS DOUBLE)").alias(n) for n in wanted],
    )


def read_complete(spark: SparkSession, paths: list[str], required: tuple[str, ...]) -> DataFrame:
    """Rows of the files that have all required columns, none of them null."""
    parts = [
        _load(spark, names, files, required)
        for names, files in _by_header(spark, paths).items()
        if set(required) <= set(names)
    ]
    if not parts:
        raise ValueError("no file has all required columns")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.na.drop(subset=list(required))


def read_any(spark: SparkSession, paths: list[str], features: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of all files over the union of their (wanted) columns; absent columns are null."""
    whole = None
    for names, files in _by_header(spark, paths).items():
        common = tuple(f for f in (features or names) if f in names)
        if not common:
            continue
        part = _load(spark, names, files, common)
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    if whole is None:
        raise ValueError("no file has any of the wanted columns")
    return whole
