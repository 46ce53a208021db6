"""Trained models over the driver tables.

Random fits have no SQL of their own, so the queries return what has to hold of any fit: which rows
were scored, that labels follow the scores, that a report agrees with its own predictions. The
discriminant and the projection over two columns have closed forms and are compared row by row.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import functions as F

from flowsieve import fixtures
from flowsieve.catalog.base import FLOWS, fixed, q_fixed, register, with_ctes
from flowsieve.catalog.prep import SERIES_SQL
from flowsieve.catalog.serving import stored_flows
from flowsieve.functions.scores import CLASS_LABELS, threshold_label
from flowsieve.models import boosting, ensemble, linear, local_outliers, outliers, robust, trees, validation
from flowsieve.models import detector as det
from flowsieve.operators import evaluation, ordered, rollup, sampling
from flowsieve.plans.features import FEATURE_COLUMNS, feature_vector
from flowsieve.plans.pipeline import choose_scorer
from flowsieve.schema import SERIES_FEATURES
from flowsieve.session import kept, pinned, scratch_path

FEATURES = list(SERIES_FEATURES)
# Fixed value: share of the rows that detectors are tested on; they are fitted on all others.
TEST_SHARE = 0.1

# The split, labels and parts in SQL.
_CUT = round(TEST_SHARE * 65536)
_TESTED = f"CAST(concat('0x', substr(md5(CAST(row_id AS VARCHAR)), 1, 4)) AS INT) < {_CUT}"
_LABELLED = (
    SERIES_SQL
    + f""",
labelled AS (SELECT *, CASE WHEN n_bytes > (SELECT quantile_cont(n_bytes, 0.99) FROM series) THEN 1 ELSE 0 END AS anomaly,
  {_TESTED} AS tested FROM series)"""
)
_SUPPORT = """SELECT name, support, true AS consistent FROM (
  SELECT '0' AS name, count(*) FILTER (anomaly = 0)::DOUBLE AS support FROM labelled WHERE tested
  UNION ALL SELECT '1', count(*) FILTER (anomaly = 1)::DOUBLE FROM labelled WHERE tested
  UNION ALL SELECT n, (SELECT count(*) FROM labelled WHERE tested)::DOUBLE FROM (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) v(n))"""


def _series(spark, sf, scale=False):
    """Labelled series rows; written once, so that every fit reads the same rows and none builds them anew."""
    rows = kept(fixtures.series(spark, sf).select("row_id", *FEATURES))
    s = ordered.mark_above_quantile(rows, "n_bytes").select("row_id", "anomaly", *FEATURES)
    return rollup.scaled_columns(s, FEATURES, ["row_id", "anomaly"]) if scale else s


def _split(spark, sf, scale=False):
    """Labelled series rows in two parts that together hold all, told apart row by row where they are read."""
    return sampling.share_split(_series(spark, sf, scale), F.col("row_id"), TEST_SHARE)


def _report(predicted):
    """The report's supports, and whether its figures are those of the predictions counted anew."""
    predicted = pinned(predicted.select("anomaly", "predicted"))
    n = {(r.anomaly, r.predicted): r.n for r in predicted.groupBy("anomaly", "predicted").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, right = sum(n.values()), n.get((0, 0), 0) + n.get((1, 1), 0)
    ratio = lambda a, b: a / b if b else 0.0
    want = {}
    for c in (0, 1):
        hit, said, true = n.get((c, c), 0), n.get((0, c), 0) + n.get((1, c), 0), n.get((c, 0), 0) + n.get((c, 1), 0)
        p, r = ratio(hit, said), ratio(hit, true)
        want[str(c)] = (p, r, ratio(2 * p * r, p + r), true)
    want["accuracy"] = (ratio(right, total),) * 3 + (total,)
    want["macro avg"] = tuple((want["0"][i] + want["1"][i]) / 2 for i in range(3)) + (total,)
    want["weighted avg"] = tuple(ratio(sum(want[c][i] * want[c][3] for c in "01"), total) for i in range(3)) + (total,)
    rows = []
    for r in evaluation.classification_report(predicted, "anomaly", "predicted", [0, 1]).collect():
        close = all(abs(a - b) < 1e-9 for a, b in zip((r.precision, r.recall, r.f1, r.support), want[r["name"]], strict=True))
        rows.append((r["name"], r.support, close))
    return predicted.sparkSession.createDataFrame(rows, "name string, support double, consistent boolean")


@register(
    "j01_train_detector",
    """SELECT part, metric, true AS in_range FROM (VALUES ('validation'), ('test')) p(part),
       (VALUES ('precision'), ('recall'), ('f1'), ('accuracy'), ('roc_auc'), ('pr_auc'), ('threshold')) m(metric)
       UNION ALL SELECT 'test', 'watch_threshold', true""",
)
def train_detector(spark, sf):
    """Fitted and thresholded on one part of the rows, tested on another that it never saw."""
    labelled, test = sampling.share_split(fixtures.labelled_flows(spark, sf), F.col("row_id"), TEST_SHARE)
    fitted = det.train_detector(labelled, "row_id", test=test)
    rows = [(part, name, 0.0 <= float(value) <= 1.0) for part, m in fitted.metrics.items() for name, value in m.items()]
    return spark.createDataFrame(rows, "part string, metric string, in_range boolean")


@register("j02_a09_score_with_saved_detector", with_ctes(FLOWS, "SELECT id, true AS scored, true AS follows FROM flows"))
def score_with_detector(spark, sf):
    """Saved and loaded, the detector scores as before, and its labels follow the scores."""
    fitted = det.train_detector(fixtures.labelled_flows(spark, sf), "row_id")
    path = scratch_path(spark, "detector")
    fitted.save(spark, path)
    flows = stored_flows(spark, sf)
    again = det.load_detector(spark, path).score_flows(flows).select("id", "score", "label")
    before = fitted.score_flows(flows).select("id", F.col("score").alias("was"))
    rule = threshold_label(F.col("score"), fitted.anomaly, fitted.watch)
    return again.join(before, "id").select("id", (F.abs(F.col("score") - F.col("was")) < 1e-12).alias("scored"), (F.col("label") == rule).alias("follows"))


def _class_rows(spark, sf):
    """Flow features with an attack class taken from the flow itself."""
    f = stored_flows(spark, sf)
    kind = F.when(F.col("extra.service") == "portscan", 2).when(F.col("bytes") > 15000, 3).when(F.col("id") % 40 == 7, 1).otherwise(0)
    return feature_vector(f.withColumn("attack_type", kind.cast("string")), keep=("id", "attack_type"))


def _ensemble(spark, sf):
    """Both members with all their trees and rounds; the booster's one long task runs beside the forest's."""
    rows = pinned(rollup.target_classes(_class_rows(spark, sf).withColumnRenamed("flow_attack_type", "attack_type"), keep=("flow_id",)))
    trainers = {"booster": ensemble.train_attack_booster, "forest": ensemble.train_class_forest}
    with ThreadPoolExecutor(len(trainers)) as pool:
        fits = {name: pool.submit(train, rows, list(FEATURE_COLUMNS)) for name, train in trainers.items()}
        return {name: fits[name].result() for name in ("forest", "booster")}


def _well_formed(scored):
    """Whether each row has a probability and the name of a class."""
    return scored.select("id", F.col("score").between(0.0, 1.0).alias("scored"), F.col("label").isin(*CLASS_LABELS.values()).alias("named"))


@register("j03_j04_train_ensemble", with_ctes(FLOWS, "SELECT id, true AS scored, true AS named FROM flows"))
def train_ensemble(spark, sf):
    return _well_formed(ensemble.score_flows(stored_flows(spark, sf), _ensemble(spark, sf)))


_TREE_COLUMNS = ["bytes", "dst_port", "k", "user_id"]


def _given_trees():
    """Two trees of three classes, and two that add up to log odds."""
    table = lambda rows: [np.array(c) for c in zip(*rows, strict=True)]
    leaf = (trees.LEAF, 0.0, 0)
    f = table([(0, 15000.0, 2), (1, 1024.0, 6), (2, 20.0, 4), leaf, leaf, leaf, leaf, leaf])
    counts = np.array([[0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0, 4], [3, 1, 0], [1, 1, 2], [2, 2, 0], [1, 0, 3]], float)
    b = table([(0, 8000.0, 2), (2, 30.0, 6), leaf, (3, 50.0, 4), leaf, leaf, leaf, leaf])
    weights = np.array([0, 0, -0.4, 0, 0.3, 0.9, 0.2, -0.1])[:, None]
    roots = np.array([0, 1])
    return trees.CutForest(roots, *f, counts, 4), boosting.BoostedCuts(roots, *b, weights, 4)


@register(
    "j03_j04_scores_of_given_trees",
    with_ctes(
        FLOWS,
        f"""SELECT id, {q_fixed('(t[1] + u[1]) / 2')} AS p0_fx, {q_fixed('(t[2] + u[2]) / 2')} AS p1_fx, {q_fixed('(t[3] + u[3]) / 2')} AS p2_fx,
              {q_fixed('1 / (1 + exp(-(a + b)))')} AS attack_fx
            FROM (SELECT id, CASE WHEN bytes > 15000 THEN [0.0, 0.0, 1.0] WHEN k <= 20 THEN [0.75, 0.25, 0.0] ELSE [0.25, 0.25, 0.5] END::DOUBLE[] AS t,
              CASE WHEN dst_port <= 1024 THEN [0.5, 0.5, 0.0] ELSE [0.25, 0.0, 0.75] END::DOUBLE[] AS u,
              CASE WHEN bytes <= 8000 THEN -0.4 WHEN user_id <= 50 THEN 0.3 ELSE 0.9 END::DOUBLE AS a, CASE WHEN k <= 30 THEN 0.2 ELSE -0.1 END::DOUBLE AS b FROM flows)""",
    ),
)
def scores_of_given_trees(spark, sf):
    """Flows scored by stated trees, saved and loaded before."""
    scored, path = fixtures.flow_columns(spark, sf), scratch_path(spark, "given")
    ensemble.save_ensemble(spark, dict(zip(("forest", "booster"), _given_trees(), strict=True)), path)
    for name in ("forest", "booster"):
        scored, _ = ensemble.load_member(spark, path, name).with_probabilities(scored, _TREE_COLUMNS, name)
    return scored.select("id", *(fixed(F.col("forest")[c]).alias(f"p{c}_fx") for c in range(3)), fixed(F.col("booster")[1]).alias("attack_fx"))


_KIND = "CASE WHEN service = 'portscan' THEN 2 WHEN bytes > 15000 THEN 1 ELSE 0 END"


@register(
    "j03_random_cut_roots",
    with_ctes(
        FLOWS
        + f""",
d AS (SELECT {_KIND} AS y, unnest([0, 1, 2, 3]) AS f, unnest([bytes, dst_port, k, user_id])::DOUBLE AS v FROM flows),
bounds AS (SELECT f, min(v) AS lo, max(v) AS hi FROM d GROUP BY 1),
drawn AS (SELECT tree, f, m, row_number() OVER (PARTITION BY tree ORDER BY m) AS place
  FROM (SELECT tree, f, md5(concat('9:', tree, ':1:', f)) AS m FROM range(120) t(tree), range(4) g(f))),
cuts AS (SELECT tree, f, place, lo + (CAST(concat('0x', substr(m, 17, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE) * (hi - lo) AS cut
  FROM drawn JOIN bounds USING (f) WHERE place <= 2 AND hi > lo),
counts AS (SELECT tree, f, place, cut, y, count(*) FILTER (v <= cut)::DOUBLE AS under, count(*) FILTER (v > cut)::DOUBLE AS over
  FROM cuts JOIN d USING (f) GROUP BY ALL),
purity AS (SELECT tree, f, place, cut, sum(under) AS under, sum(under * under) / sum(under) + sum(over * over) / sum(over) AS purity FROM counts GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY purity DESC, place) AS rank FROM purity)""",
        "SELECT tree::INT AS tree, f::INT AS feature, CAST(floor(cut * 1e6 + 0.5) AS BIGINT) AS cut_fx, under::BIGINT AS under FROM best WHERE rank = 1",
    ),
)
def random_cut_roots(spark, sf):
    """The first cut of 120 trees over four columns: the drawn features, the cuts between their bounds, and the purer one."""
    flows = fixtures.flow_columns(spark, sf).select(F.expr(_KIND).alias("y"), *_TREE_COLUMNS)
    forest = trees.fit_random_cuts(flows, _TREE_COLUMNS, "y", depth=1, seed=9)
    rows = [(t, int(forest.feature[t]), int(np.floor(forest.cut[t] * 1e6 + 0.5)), int(forest.value[forest.left[t]].sum())) for t in forest.roots.tolist()]
    return spark.createDataFrame(rows, "tree int, feature int, cut_fx long, under long")


_STUMP_LABEL = "(k % 50 < 20) <> (bytes % 3 = 0)"


@register(
    "j04_first_boosted_tree",
    with_ctes(
        FLOWS
        + f""",
d AS (SELECT CASE WHEN {_STUMP_LABEL} THEN 1 ELSE 0 END AS y, unnest([0, 1]) AS f, unnest([k % 50, user_id % 97])::BIGINT AS v FROM flows),
bins AS (SELECT f, v, sum(0.5::DOUBLE - y) AS g, sum(0.25::DOUBLE) AS h FROM d GROUP BY ALL),
sums AS (SELECT f, v, sum(g) OVER (PARTITION BY f ORDER BY v) AS lg, sum(h) OVER (PARTITION BY f ORDER BY v) AS lh,
  sum(g) OVER (PARTITION BY f) AS tg, sum(h) OVER (PARTITION BY f) AS th FROM bins),
best AS (SELECT *, lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1) AS gain FROM sums WHERE lh >= 1 AND th - lh >= 1)""",
        f"""SELECT f::INT AS feature, v AS cut, {q_fixed('-lg / (lh + 1) * 0.1')} AS left_fx, {q_fixed('-(tg - lg) / (th - lh + 1) * 0.1')} AS right_fx
            FROM best ORDER BY gain DESC, f, v LIMIT 1""",
    ),
)
def first_boosted_tree(spark, sf):
    """A stump over two columns binned at all their values: the cut of largest gain, and the weights of its leaves."""
    flows = fixtures.flow_columns(spark, sf).selectExpr(f"CASE WHEN {_STUMP_LABEL} THEN 1 ELSE 0 END AS y", "k % 50 AS a", "user_id % 97 AS b")
    bins = [np.arange(50.0), np.arange(97.0)]
    model = boosting.fit_boosted(flows, ["a", "b"], "y", rounds=1, depth=1, row_share=1.0, column_share=1.0, bins=bins)
    weight = lambda side: int(np.floor(model.value[model.left[0] + side, 0] * 1e9 + 0.5))
    return spark.createDataFrame([(int(model.feature[0]), int(model.cut[0]), weight(0), weight(1))], "feature int, cut long, left_fx long, right_fx long")


@register(
    "j07_choose_scorer",
    with_ctes(FLOWS, "SELECT mode, count(*) AS scored FROM flows, (VALUES ('ensemble'), ('detector'), ('heuristic')) v(mode) GROUP BY 1"),
)
def choose(spark, sf):
    """A saved ensemble scores, else a saved detector, else the heuristic."""
    path, flows = scratch_path(spark, "models"), stored_flows(spark, sf)
    det.train_detector(fixtures.labelled_flows(spark, sf), "row_id").save(spark, f"{path}/detector")
    ensemble.save_ensemble(spark, dict(zip(("forest", "booster"), _given_trees(), strict=True)), f"{path}/ensemble")
    out = None
    for members, detector in ((f"{path}/ensemble", f"{path}/detector"), (f"{path}/none", f"{path}/detector"), (None, f"{path}/none")):
        mode, score = choose_scorer(spark, members, detector)
        part = score(flows, None).where(F.col("score").between(0.0, 1.0) & F.col("label").isNotNull()).select(F.lit(mode).alias("mode"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("mode").agg(F.count(F.lit(1)).alias("scored"))


@register("j10_isolation_forest", with_ctes(_LABELLED, _SUPPORT))
def isolation_forest(spark, sf):
    train, test = _split(spark, sf)
    return _report(outliers.fit_isolation_forest(train, FEATURES, "row_id").predict(test))


@register("j10_isolation_forest_signed", with_ctes(SERIES_SQL, "SELECT count(*) AS rows, count(*) AS signed, true AS few FROM series"))
def isolation_forest_signed(spark, sf):
    """Every row marked -1 or 1 by a forest over the three scaled counts; at most the contamination, rounded up, is -1."""
    columns = ["n_flows", "n_packets", "n_bytes"]
    s = rollup.scaled_columns(kept(fixtures.series(spark, sf).select("row_id", *columns)), columns, ["row_id"])
    marked = outliers.fit_isolation_forest(s, columns, "row_id").predict_signed(s)
    odd = F.count_if(F.col("predicted") == -1)
    rows = F.count(F.lit(1))
    return marked.agg(rows.alias("rows"), F.count_if(F.col("predicted").isin(-1, 1)).alias("signed"), (odd <= rows * 0.01 + 1).alias("few"))


@register(
    "j11_contamination_search",
    with_ctes(_LABELLED, _SUPPORT.replace("true AS consistent", "true AS consistent, true AS listed")),
)
def contamination_search(spark, sf):
    train, test = _split(spark, sf)
    level, _, forest = outliers.search_contamination(train, test, FEATURES, "row_id", "anomaly")
    return _report(forest.predict(test)).withColumn("listed", F.lit(level in outliers.CONTAMINATIONS))


@register("j12_local_outlier_factor", with_ctes(_LABELLED, _SUPPORT))
def local_outlier_factor(spark, sf):
    train, test = _split(spark, sf, scale=True)
    return _report(local_outliers.fit_full_outlier_factor(train, FEATURES).predict(test))


# Every tenth flow's point; its neighbours are all other rows, equal points each by their own row.
_NEIGHBOURS = """,
p AS (SELECT id, bytes::DOUBLE AS a, (k * 100)::DOUBLE AS b FROM flows WHERE id < 1200),
near AS (SELECT id, o, d FROM (SELECT x.id, y.id AS o, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) AS d,
  row_number() OVER (PARTITION BY x.id ORDER BY (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b), y.a, y.b) AS place
  FROM p x JOIN p y ON x.id <> y.id) WHERE place <= 10),
reach AS (SELECT id, max(d) AS r FROM near GROUP BY 1),
density AS (SELECT near.id, 1 / (avg(greatest(d, r)) + 1e-10) AS l FROM near JOIN reach ON o = reach.id GROUP BY 1)"""


@register(
    "j12_outlier_factors",
    with_ctes(
        FLOWS + _NEIGHBOURS,
        """SELECT near.id, CAST(floor(avg(o.l) / min(x.l) * 1e6 + 0.5) AS BIGINT) AS factor_fx FROM near JOIN density o ON near.o = o.id
           JOIN density x ON near.id = x.id GROUP BY 1""",
    ),
)
def outlier_factors(spark, sf):
    """The factors of flows among the first ones, two measures each, by their exact neighbours."""
    p = fixtures.flow_columns(spark, sf).where("id < 1200").selectExpr("id", "CAST(bytes AS DOUBLE) AS a", "CAST(k * 100 AS DOUBLE) AS b")
    factors = local_outliers.fit_full_outlier_factor(p, ["a", "b"], neighbours=10, ring_points=60).own_factors(p, "factor")
    return factors.select("id", F.floor(F.col("factor") * 1e6 + 0.5).cast("bigint").alias("factor_fx"))


@register("j13_elliptic_envelope", with_ctes(_LABELLED, _SUPPORT))
def elliptic_envelope(spark, sf):
    train, test = _split(spark, sf, scale=True)
    return _report(robust.fit_robust_envelope(train, FEATURES).predict(test))


@register("j14_e12_pca_error", with_ctes(_LABELLED, _SUPPORT))
def pca_error(spark, sf):
    train, test = _split(spark, sf, scale=True)
    return _report(linear.fit_projection(train, FEATURES).predict(test))


# The larger root of the two-column covariance, its direction, and the distance from that line.
_LINE = """,
m AS (SELECT avg(n_flows) AS mx, avg(n_packets) AS my, var_pop(n_flows) AS a, var_pop(n_packets) AS c, covar_pop(n_flows, n_packets) AS b
  FROM labelled WHERE NOT tested),
e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS root FROM m),
d AS (SELECT mx, my, b / sqrt(b * b + (root - a) ** 2) AS vx, (root - a) / sqrt(b * b + (root - a) ** 2) AS vy FROM e),
g AS (SELECT row_id, n_flows - mx AS x, n_packets - my AS y, vx, vy FROM labelled, d WHERE tested),
err AS (SELECT row_id, (abs(x - (x * vx + y * vy) * vx) + abs(y - (x * vx + y * vy) * vy)) / 2 AS error FROM g)"""


@register(
    "j14_e12_projection_of_two",
    with_ctes(
        _LABELLED + _LINE,
        """SELECT row_id, CAST(floor(error * 1e6 + 0.5) AS BIGINT) AS error_fx,
           CASE WHEN error > (SELECT quantile_cont(error, 0.99) FROM err) + 1e-9 THEN 1 ELSE 0 END AS predicted FROM err""",
    ),
)
def projection_of_two(spark, sf):
    """Two columns, one component: the error is the mean distance from the main line, cut at its quantile."""
    train, test = _split(spark, sf)
    columns = ["n_flows", "n_packets"]
    model = linear.fit_projection(train, columns, k=1)
    errors = pinned(model.with_error(test, "error").select("row_id", "error"))
    cut = ordered.exact_quantile(errors, "error", 0.99).first()[0]
    fx = F.floor(F.col("error") * 1e6 + 0.5).cast("bigint")
    return errors.select("row_id", fx.alias("error_fx"), (F.col("error") > F.lit(cut + 1e-9)).cast("int").alias("predicted"))


@register("j15_one_class_boundary", with_ctes(_LABELLED, _SUPPORT))
def one_class(spark, sf):
    train, test = _split(spark, sf, scale=True)
    return _report(outliers.fit_one_class(train, FEATURES).predict(test))


def _fitters():
    def with_prediction(model):
        return lambda df: model.transform(df).withColumn("predicted", F.col("prediction").cast("int"))

    return {
        "discriminant": lambda rows: linear.fit_discriminant(rows, FEATURES, "anomaly").predict,
        "forest": lambda rows: with_prediction(ensemble.train_forest(rows, FEATURES, "anomaly")),
        "tree": lambda rows: with_prediction(ensemble.train_tree(rows, FEATURES, "anomaly")),
    }


@register("j16_forest_and_tree", with_ctes(_LABELLED, f"SELECT model, s.* FROM ({_SUPPORT}) s, (VALUES ('forest'), ('tree')) v(model)"))
def forest_and_tree(spark, sf):
    train, test = _split(spark, sf)
    out = None
    for name in ("forest", "tree"):
        part = _report(_fitters()[name](train)(test)).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@register("j17_discriminant", with_ctes(_LABELLED, _SUPPORT))
def discriminant(spark, sf):
    train, test = _split(spark, sf)
    return _report(_fitters()["discriminant"](train)(test))


# Class means and the pooled covariance of two columns, its inverse, and each class's linear score.
_SCORES = """,
k AS (SELECT anomaly AS y, count(*)::DOUBLE AS n, avg(n_flows) AS mx, avg(n_packets) AS my, var_pop(n_flows) AS a,
  var_pop(n_packets) AS c, covar_pop(n_flows, n_packets) AS b FROM labelled WHERE NOT tested GROUP BY 1),
p AS (SELECT sum(n) AS all_n, sum(n * a) / sum(n) AS a, sum(n * b) / sum(n) AS b, sum(n * c) / sum(n) AS c FROM k),
w AS (SELECT y, (p.c * mx - p.b * my) / (p.a * p.c - p.b * p.b) AS wx, (p.a * my - p.b * mx) / (p.a * p.c - p.b * p.b) AS wy,
  mx, my, ln(n / all_n) AS prior FROM k, p),
s AS (SELECT row_id, y, n_flows * wx + n_packets * wy + prior - 0.5 * (mx * wx + my * wy) AS score FROM labelled, w WHERE tested)"""


@register(
    "j17_discriminant_of_two",
    with_ctes(_LABELLED + _SCORES, "SELECT row_id, CAST(max_by(y, score - y * 1e-9) AS INT) AS predicted FROM s GROUP BY 1"),
)
def discriminant_of_two(spark, sf):
    """Two columns: predictions by the closed form."""
    train, test = _split(spark, sf)
    return linear.fit_discriminant(train, ["n_flows", "n_packets"], "anomaly").predict(test).select("row_id", F.col("predicted").cast("int").alias("predicted"))


@register(
    "j20_e13_cross_validation",
    with_ctes(
        _LABELLED,
        """SELECT model, CAST(fold AS INT) AS fold, CAST(sum((n + CASE fold WHEN 0 THEN 0 ELSE 5 - fold END) // 5) AS BIGINT) AS rows, true AS in_range
           FROM (SELECT anomaly, count(*) AS n FROM labelled WHERE NOT tested GROUP BY 1), (VALUES (0), (1), (2), (3), (4)) v(fold),
             (VALUES ('discriminant'), ('tree')) m(model) GROUP BY 1, 2""",
    ),
)
def cross_validation(spark, sf):
    """Every training row tested once, by a model that was not fitted on it."""
    train, _ = _split(spark, sf)
    out = None
    for name in ("discriminant", "tree"):
        one = validation.cross_validate_discriminant
        folds = one(train, FEATURES, "anomaly", "row_id") if name == "discriminant" else validation.cross_validate(train, "anomaly", "row_id", _fitters()[name])
        part = folds.select(F.lit(name).alias("model"), "fold", "rows", F.col("accuracy").between(0.5, 1.0).alias("in_range"))
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "j20_forest_cross_validation",
    with_ctes(_LABELLED, "SELECT count(*) AS rows, 5::BIGINT AS folds, true AS in_range FROM labelled WHERE NOT tested"),
)
def forest_cross_validation(spark, sf):
    train, _ = _split(spark, sf)
    folds = validation.cross_validate(train, "anomaly", "row_id", _fitters()["forest"])
    return folds.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("folds"), F.min(F.col("accuracy").between(0.5, 1.0)).alias("in_range"))
