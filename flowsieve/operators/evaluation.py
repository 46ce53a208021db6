"""Classification metrics from counts: everything is an aggregate over a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.ordered import running_totals

MIN_THRESHOLD = 0.05
MAX_THRESHOLD = 0.95


def confusion_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, classes: list[int]) -> DataFrame:
    """One row per true class, one column pred_<class> per predicted class."""
    hits = [F.count_if(F.col(predicted) == c).alias(f"pred_{c}") for c in classes]
    return df.where(F.col(truth).isin(classes)).groupBy(F.col(truth).alias("truth")).agg(*hits)


def _safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))


def classification_report(df: DataFrame, truth: str, predicted: str, classes: list[int]) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages.

    A single aggregate over the rows; the report itself has len(classes) + 3 rows.
    """
    t, p = F.col(truth), F.col(predicted)
    counts = []
    for c in classes:
        counts += [
            F.count_if((t == c) & (p == c)).cast("double").alias(f"tp_{c}"),
            F.count_if(p == c).cast("double").alias(f"pp_{c}"),
            F.count_if(t == c).cast("double").alias(f"ap_{c}"),
        ]
    totals = df.agg(*counts, F.count_if(t == p).cast("double").alias("right"), F.count(F.lit(1)).cast("double").alias("all"))
    rows, per_class = [], {}
    for c in classes:
        precision = _safe_ratio(F.col(f"tp_{c}"), F.col(f"pp_{c}"))
        recall = _safe_ratio(F.col(f"tp_{c}"), F.col(f"ap_{c}"))
        f1 = _safe_ratio(2 * precision * recall, precision + recall)
        per_class[c] = (precision, recall, f1, F.col(f"ap_{c}"))
        rows.append((str(c), *per_class[c]))
    accuracy = _safe_ratio(F.col("right"), F.col("all"))
    support = sum((per_class[c][3] for c in classes), F.lit(0.0))
    macro = [sum((per_class[c][i] for c in classes), F.lit(0.0)) / len(classes) for i in range(3)]
    weighted = [
        _safe_ratio(sum((per_class[c][i] * per_class[c][3] for c in classes), F.lit(0.0)), support) for i in range(3)
    ]
    rows += [
        ("accuracy", accuracy, accuracy, accuracy, F.col("all")),
        ("macro avg", *macro, support),
        ("weighted avg", *weighted, support),
    ]
    names = ("name", "precision", "recall", "f1", "support")
    packed = F.array(*[F.struct(*[(F.lit(v) if i == 0 else v).alias(n) for i, (n, v) in enumerate(zip(names, r))]) for r in rows])
    return totals.select(F.inline(packed))


def threshold_metrics(df: DataFrame, truth: str, prob: str, threshold: float) -> DataFrame:
    """Binary precision, recall, F1 and accuracy of predicting 1 from the threshold on."""
    y, hit = F.col(truth) == 1, F.col(prob) >= threshold
    sums = df.agg(
        F.count_if(y & hit).cast("double").alias("tp"),
        F.count_if(~y & hit).cast("double").alias("fp"),
        F.count_if(y & ~hit).cast("double").alias("fn"),
        F.count(F.lit(1)).cast("double").alias("n"),
    )
    precision = _safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    right = F.col("n") - F.col("fp") - F.col("fn")
    return sums.select(
        precision.alias("precision"),
        recall.alias("recall"),
        _safe_ratio(2 * precision * recall, precision + recall).alias("f1"),
        _safe_ratio(right, F.col("n")).alias("accuracy"),
    )


def threshold_curve(df: DataFrame, truth: str, prob: str) -> DataFrame:
    """One row per distinct score, counting from the highest down.

    threshold, pos and neg at the score, cum_pos, cum_neg, all_pos, all_neg, precision, recall.
    """
    counted = df.groupBy(F.col(prob).alias("threshold")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg")
    )
    cum = running_totals(counted, "threshold", ["pos", "neg"], descending=True)
    return cum.withColumn("precision", F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).withColumn(
        "recall", _safe_ratio(F.col("cum_pos").cast("double"), F.col("all_pos").cast("double"))
    )


def roc_auc(curve: DataFrame) -> DataFrame:
    """Area under the ROC curve, ties shared; exact integer area over the curve's steps."""
    twice = F.sum(F.col("neg") * (2 * F.col("cum_pos") - F.col("pos")))
    pairs = F.max("all_pos").cast("double") * F.max("all_neg")
    return curve.agg((F.try_divide(twice, pairs) / 2).alias("roc_auc"))


def average_precision(curve: DataFrame) -> DataFrame:
    return curve.agg(
        (F.sum(F.col("pos") * F.col("precision")) / F.nullif(F.max("all_pos"), F.lit(0))).alias("average_precision")
    )


def best_f1_threshold(curve: DataFrame) -> DataFrame:
    """The threshold one step below the one with the best F1, kept within bounds.

    Of equal F1 values the lowest threshold counts; no scores give 0.5.
    """
    scored = curve.withColumn(
        "f1",
        2 * (F.col("precision") * F.col("recall")) / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9)),
    )
    top = scored.agg(F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("best"))
    below = scored.where(F.col("threshold") < top.scalar()).agg(F.max("threshold").alias("below"))
    raw = F.coalesce(below.scalar(), F.col("best"))
    clipped = F.least(F.greatest(raw, F.lit(MIN_THRESHOLD)), F.lit(MAX_THRESHOLD))
    return top.select(F.when(F.col("best").isNull(), F.lit(0.5)).otherwise(clipped).alias("threshold"))


def watch_threshold(anomaly: float) -> float:
    return max(0.2, min(anomaly * 0.65, anomaly))


def fold_summary(scores: DataFrame, score: str = "accuracy") -> DataFrame:
    """Mean and population standard deviation over the folds."""
    return scores.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: rows / (classes x class rows)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).alias("w"))
    return sizes.withColumn("_w", whole.scalar()).select(
        label, (F.col("_w.rows") / (F.col("_w.classes") * F.col("n"))).alias("weight")
    )
