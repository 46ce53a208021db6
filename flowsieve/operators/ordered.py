"""Running totals, exact quantiles and ranks over a global order without a single-task window.

Rows are first counted per distinct value, then cut into value ranges of about
equal size. Each range is ordered on its own and shifted by the total of the
ranges before it; only the per-range totals are ordered in one place.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowsieve.session import kept, pinned

RANGES = 128
#: Slices of a hash that is ranked.
SLICES = 1 << 16
#: Ranks that are ordered on each side of a wanted one, and the error of the marks around them, as shares of the rows.
ASIDE, MARK_ERROR = 1 / 512, 1 / 2048


def _range_index(df: DataFrame, order_col: str, ranges: int) -> DataFrame:
    marks = df.approxQuantile(order_col, [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    inner = sorted(set(m for m in marks if m not in (float("inf"), float("-inf"))))
    if not inner:
        return df.withColumn("_range", F.lit(0.0))
    splits = [float("-inf"), *inner, float("inf")]
    return Bucketizer(splits=splits, inputCol=order_col, outputCol="_range", handleInvalid="keep").transform(df)


def running_totals(
    counted: DataFrame, order_col: str, value_cols: list[str], descending: bool = False, ranges: int = RANGES
) -> DataFrame:
    """Adds cum_<c> (running sum in order) and all_<c> (grand total) for each value column.

    `counted` holds one row per distinct value of the numeric order column. It is written once, as
    the marks, the range totals and the ordered ranges all read it.
    """
    counted = pinned(counted)
    ranged = _range_index(counted, order_col, ranges)
    sign = F.desc if descending else F.asc
    before = Window.orderBy(sign("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_sum_{c}") for c in value_cols])
    # At most `ranges` + 1 rows from here to the broadcast.
    offsets = totals.select(
        "_range",
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in value_cols],
        *[F.sum(f"_sum_{c}").over(Window.partitionBy()).alias(f"all_{c}") for c in value_cols],
    )
    inside = Window.partitionBy("_range").orderBy(sign(order_col)).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select("*", *[F.sum(c).over(inside).alias(f"_in_{c}") for c in value_cols])
    return (
        summed.join(F.broadcast(offsets), "_range")
        .select(
            *counted.columns,
            *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in value_cols],
            *[F.col(f"all_{c}") for c in value_cols],
        )
    )


def _around(df: DataFrame, column: str, ranks) -> tuple[DataFrame, int, tuple[int, int]]:
    """(values with cum_n, number of values, ranks): the distinct values around the wanted ranks, counted from the least.

    ranks(n) gives two ranks from 1 on of n values. Marks on both sides of them, by a sketch of known error, cut off
    all values that can't have these ranks: those are only counted, the others are ordered.
    """
    values = kept(df.select(F.col(column).cast("double").alias("value")).where(F.col("value").isNotNull()))
    nan = F.isnan("value")
    n, numbers = values.agg(F.count(F.lit(1)), F.count_if(~nan)).first()
    low, high = ranks(n)
    # Sketches leave NaN out; in order it is the last value.
    shares = [(low - 2) / max(numbers, 1) - ASIDE, (high + 2) / max(numbers, 1) + ASIDE]
    marks = values.approxQuantile("value", [min(max(q, 0.0), 1.0) for q in shares], MARK_ERROR) if numbers else []
    under = F.col("value") < F.lit(marks[0]) if marks and shares[0] > 0.0 else F.lit(False)
    over = F.col("value") > F.lit(marks[1]) if marks and shares[1] < 1.0 else F.lit(False)
    below, above = values.agg(F.count_if(under), F.count_if(over)).first()
    if below >= low or n - above < high:  # a sketch that missed: all are ordered
        under, over, below = F.lit(False), F.lit(False), 0
    counted = values.where(~under & ~over).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    cum = running_totals(counted, "value", ["n"])
    return cum.select("value", (F.col("cum_n") + F.lit(below)).alias("cum_n")), n, (low, high)


def exact_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row, one column `quantile`: linear interpolation between the two nearest ranks."""
    place = lambda n: max(n - 1, 0) * float(q)
    cum, n, (low, high) = _around(df, column, lambda n: (math.floor(place(n)) + 1, math.ceil(place(n)) + 1))
    at = lambda rank: F.min(F.when(F.col("cum_n") >= rank, F.col("value")))
    part = F.lit(place(n) - math.floor(place(n)))
    return cum.agg(at(low).alias("low"), at(high).alias("high")).select(
        (F.col("low") + (F.col("high") - F.col("low")) * part).alias("quantile")
    )


def nth_smallest(df: DataFrame, column: str, n: int) -> float | None:
    """The n-th smallest value, counted exactly; none if there are fewer."""
    cum, _, _ = _around(df, column, lambda _: (n, n))
    return cum.where(F.col("cum_n") >= n).agg(F.min("value")).first()[0]


def mark_above_quantile(df: DataFrame, column: str, q: float = 0.99, name: str = "anomaly") -> DataFrame:
    """Adds 1 where the column lies strictly above its own quantile, else 0."""
    cut = exact_quantile(df, column, q).first()[0]
    return df.withColumn(name, F.when(F.col(column) > F.lit(cut).cast("double"), F.lit(1)).otherwise(F.lit(0)))


def hash_slice(h: Column, slices: int = SLICES) -> Column:
    """The slice of a 64-bit hash: equal parts of its range, in its order."""
    return F.floor(h / F.lit(2.0**64 / slices)).cast("bigint")


def hash_rank(
    df: DataFrame,
    key: Column,
    seed: int,
    partition: list[str] | None = None,
    size_name: str | None = None,
    slices: int = SLICES,
) -> DataFrame:
    """Adds `rank` (from 1) in a repeatable random order, within each value of the partition columns.

    The hash is cut into equal slices, so ordering happens per slice; the slice
    counts are the only thing ordered per partition value. They also give the row
    count of each partition value, added under `size_name`.
    """
    part = list(partition or [])
    hashed = df.withColumn("_h", F.xxhash64(key, F.lit(seed)))
    sliced = hashed.withColumn("_slice", hash_slice(F.col("_h"), slices))
    totals = sliced.groupBy(*part, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*part).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_p{i}") for i, c in enumerate(part)],
        F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*part)).alias("_size"),
    )
    match = F.col("_slice") == F.col("_s")
    for i, c in enumerate(part):
        match = match & F.col(c).eqNullSafe(F.col(f"_p{i}"))
    inside = Window.partitionBy(*part, "_slice").orderBy("_h", key)
    extra = [F.col("_size").alias(size_name)] if size_name else []
    return (
        sliced.withColumn("_in", F.row_number().over(inside))
        .join(offsets, match)
        .withColumn("rank", (F.col("_in") + F.col("_off")).cast("bigint"))
        .select(*df.columns, "rank", *extra)
    )
