"""Exact-size samples, fixed and stratified splits, folds; all repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowsieve.operators.ordered import hash_rank, hash_slice, running_totals


def exact_sample(df: DataFrame, key: Column, n: int | None, seed: int = 42) -> DataFrame:
    """Exactly n rows in hash order of the key; all rows when there are no more than n."""
    if n is None or n <= 0:
        return df
    # Only slices up to the one that holds the n-th hash are ranked: the others can't have a rank so low.
    counted = df.select(hash_slice(F.xxhash64(key, F.lit(seed))).alias("_slice")).groupBy("_slice").agg(F.count(F.lit(1)).alias("n"))
    seen, last = 0, None
    for last, count in sorted(counted.collect()):
        seen += count
        if seen >= n:
            break
    low = df if last is None else df.where(hash_slice(F.xxhash64(key, F.lit(seed))) <= last)
    return hash_rank(low, key, seed).where(F.col("rank") <= n).drop("rank")


def fixed_split(df: DataFrame, key: Column, test_size: int, train_size: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) of exactly the given sizes, disjoint."""
    ranked = hash_rank(df, key, seed)
    test = ranked.where(F.col("rank") <= test_size).drop("rank")
    train = ranked.where((F.col("rank") > test_size) & (F.col("rank") <= test_size + train_size)).drop("rank")
    return train, test


def share_split(df: DataFrame, key: Column, share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(train, test): every row in one of them, by four hex digits of the key's digest; row-local."""
    cut = F.conv(F.substring(F.md5(key.cast("string")), 1, 4), 16, 10).cast("int") < round(share * 65536)
    return df.where(~F.coalesce(cut, F.lit(False))), df.where(cut)


def mark_holdout(df: DataFrame, label: str, key: Column, share: float = 0.2, seed: int = 7) -> DataFrame:
    """Adds `holdout`: the first share of each class in hash order (class count rounded up)."""
    ranked = hash_rank(df, key, seed, [label], size_name="_size")
    return ranked.withColumn("holdout", F.col("rank") <= F.ceil(F.col("_size") * F.lit(share))).drop("rank", "_size")


def stratified_split(df: DataFrame, label: str, key: Column, share: float = 0.2, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(train, holdout) with equal class shares."""
    marked = mark_holdout(df, label, key, share, seed)
    return marked.where(~F.col("holdout")).drop("holdout"), marked.where("holdout").drop("holdout")


def stratified_folds(df: DataFrame, label: str, key: Column, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds `fold` in 0..k-1, spread evenly inside each class."""
    ranked = hash_rank(df, key, seed, [label])
    return ranked.withColumn("fold", (F.col("rank") % k).cast("int")).drop("rank")


#: Rows that a sorted limit may bring to one task.
ONE_TASK = 100_000


def _nth_largest(df: DataFrame, value: Column, n: int) -> tuple[int, int] | None:
    """The n-th largest value and the number of rows above it; none if there are fewer rows."""
    counted = df.select(value.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    cum = running_totals(counted, "v", ["n"], descending=True).where(F.col("cum_n") >= n)
    found = cum.agg(F.max(F.struct("v", (F.col("cum_n") - F.col("n")).alias("above"))).alias("m")).first().m
    return None if found is None else (found.v, found.above)


def newest(df: DataFrame, n: int, ts: str = "timestamp", key: str = "id") -> DataFrame:
    """The n newest rows, unordered; of equal times those of the larger numeric key.

    Up to ONE_TASK rows are a sorted limit. More are cut off at the n-th newest time, found by counted
    time ranges, and inside that instant at the key found the same way: no task gets all of them. Only
    copies of one row, equal in time and key, are told apart by a limit.
    """
    if n <= ONE_TASK:
        return df.orderBy(F.desc(ts), F.desc(key)).limit(n)
    least = F.lit(-(1 << 62))
    at, number = F.coalesce(F.unix_micros(ts), least), F.coalesce(F.col(key).cast("long"), least)
    first = _nth_largest(df, at, n)
    if first is None:
        return df
    tied = df.where(at == first[0])
    last, above = _nth_largest(tied, number, n - first[1])
    copies = tied.where(number == last).limit(n - first[1] - above)
    return df.where(at > first[0]).unionAll(tied.where(number > last)).unionAll(copies)


def recent_first_in(df: DataFrame, n: int = 400, ts: str = "timestamp", key: str = "id") -> DataFrame:
    """The n newest rows, oldest of them first."""
    return newest(df, n, ts, key).orderBy(ts, key)


def with_position(df: DataFrame, ts: str = "timestamp", key: str = "id", name: str = "index") -> DataFrame:
    """Adds the 0-based place in newest-first order; meant for an already limited result."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.desc(ts), F.desc(key))) - 1)
