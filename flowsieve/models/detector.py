"""The calibrated bytes-and-protocol detector."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.scores import threshold_label
from flowsieve.functions.text import numeric_or_zero
from flowsieve.operators import evaluation, sampling
from flowsieve.plans.features import basic_features, training_features
from flowsieve.session import kept

FOLDS = 3
NUMBERS = ["total_bytes", "log_total_bytes"]


def _pipeline(rows: int) -> Pipeline:
    filled = [f"{c}_filled" for c in NUMBERS]
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=NUMBERS, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="_numbers"),
            StandardScaler(withMean=True, inputCol="_numbers", outputCol="_scaled"),
            # Unknown protocols get the extra index, which the encoder drops: all zeros.
            StringIndexer(inputCol="f_proto", outputCol="_proto_index", handleInvalid="keep"),
            OneHotEncoder(inputCol="_proto_index", outputCol="_proto_hot", dropLast=True),
            VectorAssembler(inputCols=["_scaled", "_proto_hot"], outputCol="features"),
            LogisticRegression(
                labelCol="y", weightCol="weight", regParam=1.0 / max(rows, 1), standardization=False, maxIter=500
            ),
        ]
    )


@dataclass
class Detector:
    """Fold models with their calibrations; the score is the mean calibrated probability."""

    folds: list[tuple[PipelineModel, IsotonicRegressionModel]]
    anomaly: float = 0.6
    watch: float = 0.39
    metrics: dict = field(default_factory=dict)

    def probability(self, featured: DataFrame, name: str = "score") -> DataFrame:
        """Adds the mean calibrated probability to rows with the basic features; one pass, no shuffle."""
        base = featured.columns
        scored = featured
        for i, (model, calibration) in enumerate(self.folds):
            scored = model.transform(scored)
            scored = scored.withColumn("_p", _positive(F.col("probability")))
            scored = calibration.setFeaturesCol("_p").setPredictionCol(f"_c{i}").transform(scored)
            scored = scored.select(*base, *[f"_c{j}" for j in range(i + 1)])
        mean = sum((F.col(f"_c{i}") for i in range(len(self.folds))), F.lit(0.0)) / len(self.folds)
        return scored.select(*base, mean.alias(name))

    def score_flows(self, flows: DataFrame) -> DataFrame:
        """Adds score and label to stored flows."""
        scored = self.probability(basic_features(flows))
        return scored.withColumn("label", threshold_label(F.col("score"), self.anomaly, self.watch)).drop(
            *NUMBERS, "f_proto"
        )

    def save(self, spark: SparkSession, path: str) -> None:
        for i, (model, calibration) in enumerate(self.folds):
            model.write().overwrite().save(f"{path}/fold-{i}/model")
            calibration.write().overwrite().save(f"{path}/fold-{i}/calibration")
        row = [(len(self.folds), float(self.anomaly), float(self.watch), 1)]
        schema = "folds int, threshold_anomaly double, threshold_watch double, feature_version int"
        spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").json(f"{path}/params")


def load_detector(spark: SparkSession, path: str) -> Detector:
    schema = "folds int, threshold_anomaly double, threshold_watch double, feature_version int"
    params = spark.read.schema(schema).json(f"{path}/params").first()
    anomaly = 0.6 if params.threshold_anomaly is None else params.threshold_anomaly
    watch = max(0.2, anomaly * 0.65) if params.threshold_watch is None else params.threshold_watch
    folds = [
        (PipelineModel.load(f"{path}/fold-{i}/model"), IsotonicRegressionModel.load(f"{path}/fold-{i}/calibration"))
        for i in range(params.folds)
    ]
    return Detector(folds, anomaly, watch)


def _positive(vector: Column) -> Column:
    return F.get(vector_to_array(vector), F.lit(1))


def _calibrate(scored: DataFrame) -> IsotonicRegressionModel:
    # Rows with one score count as one weighted point: far less to pool.
    points = scored.groupBy("_p").agg(F.avg("y").alias("_rate"), F.count(F.lit(1)).cast("double").alias("_n"))
    return IsotonicRegression(featuresCol="_p", labelCol="_rate", weightCol="_n", predictionCol="_c").fit(points)


def fit_detector(featured: DataFrame, key: str) -> Detector:
    """Fit the folds on rows with the basic features and an integer label y."""
    folded = kept(sampling.stratified_folds(featured, "y", F.col(key), FOLDS))
    parts = []
    for i in range(FOLDS):
        train, held = folded.where(F.col("fold") != i), folded.where(F.col("fold") == i)
        weights = {r["y"]: r["weight"] for r in evaluation.class_weights(train, "y").collect()}
        weight = F.lit(1.0)
        for y, w in weights.items():
            weight = F.when(F.col("y") == y, F.lit(w)).otherwise(weight)
        model = _pipeline(train.count()).fit(train.withColumn("weight", weight))
        parts.append((model, _calibrate(model.transform(held).select("y", _positive(F.col("probability")).alias("_p")))))
    return Detector(parts)


def _evaluate(detector: Detector, scored: DataFrame, threshold: float) -> dict:
    curve = evaluation.threshold_curve(scored, "y", "score")
    row = evaluation.threshold_metrics(scored, "y", "score", threshold).first().asDict()
    row["roc_auc"] = evaluation.roc_auc(curve).first()[0]
    row["pr_auc"] = evaluation.average_precision(curve).first()[0]
    row["threshold"] = threshold
    return row


def train_detector(
    labelled: DataFrame, key: str, test: DataFrame | None = None, holdout: float = 0.2, seed: int = 7
) -> Detector:
    """Fit on a stratified part, set thresholds on the rest, report metrics on both the rest and a test set."""
    prepared = lambda df: training_features(df).withColumn("y", numeric_or_zero(F.col("label")).cast("int"))
    marked = kept(sampling.mark_holdout(prepared(labelled).select(key, "y", *NUMBERS, "f_proto"), "y", F.col(key), holdout, seed))
    train, held = marked.where(~F.col("holdout")), marked.where("holdout")
    detector = fit_detector(train.select(key, "y", *NUMBERS, "f_proto"), key)
    scored = kept(detector.probability(held.select("y", *NUMBERS, "f_proto")).select("y", "score"))
    detector.anomaly = evaluation.best_f1_threshold(evaluation.threshold_curve(scored, "y", "score")).first()[0]
    detector.watch = evaluation.watch_threshold(detector.anomaly)
    detector.metrics["validation"] = _evaluate(detector, scored, detector.anomaly)
    if test is not None:
        on_test = kept(detector.probability(prepared(test).select("y", *NUMBERS, "f_proto")).select("y", "score"))
        detector.metrics["test"] = {
            **_evaluate(detector, on_test, detector.anomaly),
            "watch_threshold": detector.watch,
        }
    return detector
