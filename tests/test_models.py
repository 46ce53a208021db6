"""Detectors on rows with planted outliers; scores are checked by quality, not by value."""

from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.models import detector, ensemble, linear, outliers, validation
from flowsieve.plans.pipeline import choose_scorer
from flowsieve.session import pinned, scratch_path
from flowsieve.sources.store import FlowStore

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0.2], [0, 0, 1]])
    odd = rng.choice(1500, 15, replace=False)
    x[odd] += rng.choice([-1, 1], size=(15, 3)) * 9
    rows = [(i, int(i in set(odd.tolist())), *map(float, r)) for i, r in enumerate(x)]
    return pinned(spark.createDataFrame(rows, "row_id bigint, odd int, a double, b double, c double"))


def found(predicted):
    r = predicted.agg(F.sum(F.col("predicted") * F.col("odd")), F.sum("predicted")).first()
    return r[0], r[1]


def test_outlier_detectors_find_planted_rows(planted):
    fits = {
        "forest": outliers.fit_isolation_forest(planted, COLUMNS, "row_id"),
        "lof": outliers.fit_local_outlier_factor(planted, COLUMNS, "row_id"),
        "envelope": linear.fit_envelope(planted, COLUMNS),
        "one-class": outliers.fit_one_class(planted, COLUMNS),
    }
    for name, model in fits.items():
        hits, marked = found(model.predict(planted))
        assert marked <= 16 and hits >= 10, (name, hits, marked)


def test_local_outlier_factor_matches_brute_force(planted):
    model = outliers.fit_local_outlier_factor(planted, COLUMNS, "row_id", neighbours=5)
    x = np.array([list(r) for r in planted.orderBy("row_id").select(*COLUMNS).collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :5]
    dist = np.take_along_axis(d, near, 1)
    density = 1 / (np.maximum(dist.max(1)[near], dist).mean(1) + 1e-10)
    assert np.allclose(model.density, density)


def test_moments_match_numpy(planted):
    x = np.array([list(r) for r in planted.select(*COLUMNS).collect()])
    n, mean, cov = linear.moments(planted, COLUMNS)[0]
    assert n == 1500 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))


def test_projection_reconstructs(planted):
    model = linear.fit_projection(planted, COLUMNS, 3)
    assert model.with_error(planted).agg(F.max("error")).first()[0] < 1e-9


def test_contamination_search(planted):
    level, f1, _ = outliers.search_contamination(planted, planted, COLUMNS, "row_id", "odd", trees=50)
    assert level in outliers.CONTAMINATIONS and f1 > 0.6


def test_discriminant_cross_validation(planted):
    rows = planted.withColumn("y", (F.col("a") + F.col("b") > 0).cast("int"))
    fit = lambda part: linear.fit_discriminant(part, COLUMNS, "y").predict
    summary = validation.cross_validation_summary(rows, "y", "row_id", fit).first()
    assert summary["mean"] > 0.9 and summary["std"] < 0.1


def test_detector_learns_saves_and_loads(spark):
    i = F.col("id")
    rows = spark.range(1200).select(
        i.alias("row_id"),
        F.when(i % 4 == 0, 90000 + i).otherwise(500 + i % 97).cast("string").alias("sbytes"),
        F.lit("10").alias("dbytes"),
        F.when(i % 2 == 0, "tcp").otherwise("-").alias("proto"),
        (i % 4 == 0).cast("int").cast("string").alias("label"),
    )
    fitted = detector.train_detector(rows, "row_id", test=rows)
    assert fitted.metrics["validation"]["roc_auc"] > 0.99 and fitted.metrics["test"]["f1"] > 0.95
    assert 0.05 <= fitted.anomaly <= 0.95 and fitted.watch == max(0.2, min(fitted.anomaly * 0.65, fitted.anomaly))
    path = scratch_path(spark, "detector")
    fitted.save(spark, path)
    mode, score = choose_scorer(spark, None, path)
    flows = spark.createDataFrame([(1, 95000, "TCP"), (2, 400, "TCP"), (3, 400, "NEW")], "id bigint, bytes bigint, proto string")
    got = {r["id"]: r for r in score(flows, None).collect()}
    assert mode == "detector" and got[1]["score"] > got[2]["score"] and got[1]["label"] == "anomaly" and got[3]["score"] is not None
    assert choose_scorer(spark, path + "/none", None)[0] == "heuristic"


def test_ensemble_keeps_ids_and_ties(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5, 0.0], [0.5, 0.5]), (2, [0.1, 0.2, 0.9], [0.9, 0.1])], "id int, a array<double>, b array<double>")
    got = {r["id"]: r for r in ensemble.ensemble_score(df, {"a": [0, 1, 2], "b": [0, 1]}).collect()}
    assert (got[1]["label"], got[1]["attack_label"]) == ("normal", "attack")
    assert (got[2]["label"], got[2]["score"]) == ("scanning", pytest.approx(0.9))
    lone = ensemble.ensemble_score(df, {"b": [0]}).first()
    assert lone["label"] == "normal" and lone["attack_label"] is None


def test_store_drops_stale_batches(spark):
    store = FlowStore(spark, scratch_path(spark, "store"))
    flows = spark.range(10).select(
        "id", F.timestamp_seconds(F.col("id") * 600).alias("timestamp"), F.lit("a").alias("src_ip"), F.lit("b").alias("dst_ip"),
        F.lit("TCP").alias("proto"), F.lit(1).alias("bytes"), F.lit(None).cast(store.flows().schema["extra"].dataType).alias("extra"),
    )
    store.write_flows(flows.where("id < 5"), 0)
    store.write_flows(flows.where("id >= 5"), 1)
    store.write_flows(flows.where("id >= 5"), 1)
    assert store.flows().count() == 10
    now = datetime.fromtimestamp(5400, tz=timezone.utc)
    assert store.retained(now)[0].count() == 4
    assert store.drop_stale(now) == 1 and store.flows().count() == 5
