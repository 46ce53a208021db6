"""Feature vectors, ensemble scores and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve import fixtures
from flowsieve.catalog.base import ADDRESSED, FLOWS, fixed, q_direction, q_fixed, q_hash, q_ipv4, register, with_ctes
from flowsieve.catalog.prep import SERIES_SQL
from flowsieve.catalog.serving import stored_flows
from flowsieve.models.ensemble import average_class_probabilities, ensemble_score, top_classes
from flowsieve.operators import evaluation
from flowsieve.operators.lookups import with_reverse_dns
from flowsieve.plans.features import FEATURE_COLUMNS, basic_features, feature_vector, fit_width, training_features

_ATTRS = (
    ADDRESSED
    + f""",
attrs AS (SELECT *, CASE WHEN id % 5 = 0 THEN bytes - 50 END AS x_src_bytes, CASE WHEN id % 10 = 0 THEN k * 10 END AS x_dst_bytes,
    CASE WHEN id % 7 = 0 THEN k - 20 END AS x_src_pkts, CASE WHEN id % 9 = 0 THEN k END AS x_dst_pkts,
    CASE WHEN id % 3 = 0 THEN k / 64.0::DOUBLE - 0.25::DOUBLE END AS x_duration,
    {q_direction('sp', 'dp')} AS direction, upper(proto) AS uproto,
    CASE WHEN src_ip <> '' THEN length(src_ip) % 2 = 0 ELSE false END AS rdns FROM addressed),
totals AS (SELECT *, x_src_bytes IS NOT NULL OR x_dst_bytes IS NOT NULL AS given,
    greatest(0, coalesce(x_src_bytes, 0))::DOUBLE AS gsrc, greatest(0, coalesce(x_dst_bytes, 0))::DOUBLE AS gdst FROM attrs),
summed AS (SELECT *, CASE WHEN given THEN gsrc + gdst ELSE greatest(0, bytes)::DOUBLE END AS total FROM totals),
parted AS (SELECT *, CASE WHEN given THEN gsrc WHEN direction = 'outbound' THEN total WHEN direction = 'inbound' THEN 0 ELSE total / 2.0::DOUBLE END AS sb,
    CASE WHEN given THEN gdst WHEN direction = 'outbound' THEN 0 WHEN direction = 'inbound' THEN total ELSE total / 2.0::DOUBLE END AS db FROM summed)"""
)


def _ip(col: str) -> str:
    return f"CASE WHEN {col} = '' THEN 0 ELSE coalesce({q_ipv4(col)}, {q_hash(col, 2**31)}) END"


def _pk(given: str, n: str) -> str:
    return f"CASE WHEN {given} IS NOT NULL THEN greatest(0, {given}) WHEN {n} <= 0 THEN 0 ELSE greatest(1.0::DOUBLE, {n} / 450.0::DOUBLE) END"


_VALUES = {
    "ts": "ts_us / 1e6::DOUBLE",
    "src_ip": _ip("src_ip"),
    "dst_ip": _ip("dst_ip"),
    "src_port": "src_port",
    "dst_port": "dst_port",
    "proto": "CASE uproto WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 ELSE 0 END",
    "service": f"CASE WHEN service IS NOT NULL THEN {q_hash('lower(service)', 4099)} ELSE {q_hash('uproto', 997)} END",
    "duration": "CASE WHEN x_duration IS NOT NULL THEN greatest(0.01::DOUBLE, x_duration) WHEN total <= 0 THEN 0.01::DOUBLE ELSE greatest(0.01::DOUBLE, total / 120000.0::DOUBLE) END",
    "src_bytes": "sb",
    "dst_bytes": "db",
    "src_ip_bytes": "sb",
    "dst_ip_bytes": "db",
    "conn_state": q_hash("concat(uproto, ':', direction)", 509),
    "src_pkts": _pk("x_src_pkts", "sb"),
    "dst_pkts": _pk("x_dst_pkts", "db"),
    "dns_query": f"CASE WHEN id % 6 = 1 THEN {q_hash('''concat('host', CAST(k AS VARCHAR), '.example.com')''', 20011)} ELSE 0 END",
    "dns_qclass": "CASE WHEN id % 6 = 1 THEN 1 ELSE 0 END",
    "dns_qtype": "CASE WHEN id % 6 = 1 THEN 28 ELSE 0 END",
    "dns_rcode": "CASE WHEN id % 12 = 1 THEN 3 ELSE 0 END",
    "ssl_version": "CASE WHEN id % 11 = 4 THEN 771 ELSE 0 END",
    "ssl_cipher": f"CASE WHEN id % 11 = 4 THEN {q_hash(chr(39) + 'TLS_AES_128_GCM_SHA256' + chr(39), 65267)} ELSE 0 END",
    "http_method": f"CASE WHEN id % 8 = 2 THEN {q_hash(chr(39) + 'GET' + chr(39), 4001)} ELSE 0 END",
    "http_uri": f"CASE WHEN id % 8 = 2 THEN {q_hash('''concat('/item/', CAST(k AS VARCHAR))''', 65521)} ELSE 0 END",
    "http_referrer": f"CASE WHEN id % 16 = 2 THEN {q_hash(chr(39) + 'http://example.org/' + chr(39), 49157)} ELSE 0 END",
    "http_version": f"CASE WHEN id % 8 = 2 THEN {q_hash(chr(39) + '1.1' + chr(39), 10139)} ELSE 0 END",
    "http_request_body_len": "CASE WHEN id % 8 = 2 THEN k * 3 ELSE 0 END",
    "http_response_body_len": "CASE WHEN id % 8 = 3 THEN k * 7 ELSE 0 END",
    "http_status_code": "CASE WHEN id % 8 = 3 THEN 200 + k ELSE 0 END",
    "http_user_agent": f"CASE WHEN id % 8 = 2 THEN {q_hash('''concat('agent/', CAST(id % 9 AS VARCHAR))''', 45007)} ELSE 0 END",
    "http_orig_mime_types": f"CASE WHEN id % 24 = 2 THEN {q_hash(chr(39) + 'text/plain' + chr(39), 32749)} ELSE 0 END",
    "http_resp_mime_types": f"CASE WHEN id % 8 = 3 THEN {q_hash(chr(39) + 'text/html' + chr(39), 32749)} ELSE 0 END",
    "weird_name": f"CASE WHEN id % 50 = 0 THEN {q_hash(chr(39) + 'bad_checksum' + chr(39), 50021)} ELSE 0 END",
    "weird_addl": f"CASE WHEN id % 50 = 0 THEN {q_hash(chr(39) + 'len' + chr(39), 50021)} ELSE 0 END",
    "weird_notice": f"CASE WHEN id % 50 = 0 THEN {q_hash(chr(39) + 'F' + chr(39), 50021)} ELSE 0 END",
    "rdns_exists": "CASE WHEN rdns THEN 1 ELSE 0 END",
    "rdns_hash": "CASE WHEN rdns THEN 1 ELSE 0 END",
}
_SELECT = ", ".join(f"CAST(floor(CAST({_VALUES.get(c, '0')} AS FLOAT)::DOUBLE * 1e6 + 0.5) AS BIGINT) AS {c}" for c in FEATURE_COLUMNS)


@register("i01_b16_b21_feature_vector", with_ctes(_ATTRS, f"SELECT id AS flow_id, {_SELECT} FROM parted"))
def features(spark, sf):
    f = with_reverse_dns(stored_flows(spark, sf), fixtures.reverse_dns(spark, sf))
    v = feature_vector(f)
    return v.select("flow_id", *[F.floor(F.col(c).cast("double") * 1e6 + 0.5).cast("bigint").alias(c) for c in FEATURE_COLUMNS])


@register(
    "i02_basic_features",
    with_ctes(FLOWS, f"SELECT id, greatest(0, bytes)::DOUBLE AS total_bytes, {q_fixed('ln(1 + greatest(0, bytes)::DOUBLE)')} AS log_fx, upper(proto) AS f_proto FROM flows"),
)
def serving_features(spark, sf):
    f = basic_features(stored_flows(spark, sf))
    return f.select("id", "total_bytes", fixed(F.col("log_total_bytes")).alias("log_fx"), "f_proto")


@register(
    "i03_training_features",
    f"""WITH t AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, l_quantity * 100 + CASE WHEN l_orderkey % 17 = 0 THEN 0 ELSE l_extendedprice END AS total,
          CASE WHEN l_orderkey % 19 = 0 THEN 'NAN' WHEN l_linenumber % 3 = 0 THEN 'TCP' WHEN l_linenumber % 3 = 1 THEN 'UDP' ELSE 'OTHER' END AS f_proto FROM lineitem)
        SELECT row_id, {q_fixed('total')} AS total_fx, {q_fixed('ln(1 + total)')} AS log_fx, f_proto FROM t""",
)
def labelled_features(spark, sf):
    f = training_features(fixtures.labelled_flows(spark, sf))
    return f.select(
        "row_id", fixed(F.col("total_bytes")).alias("total_fx"), fixed(F.col("log_total_bytes")).alias("log_fx"), "f_proto"
    )


@register(
    "i04_fit_width",
    with_ctes(FLOWS, "SELECT id, 3 AS narrow, 5 AS wide, 0.0::FLOAT AS pad_0, 0.0::FLOAT AS pad_1, bytes FROM flows"),
)
def model_width(spark, sf):
    f = fixtures.flow_columns(spark, sf)
    _, narrow = fit_width(f, ["bytes", "dst_port", "k", "user_id"], 3)
    padded, wide = fit_width(f, ["bytes", "dst_port", "k"], 5)
    return padded.select("id", F.lit(len(narrow)).alias("narrow"), F.lit(len(wide)).alias("wide"), "pad_0", "pad_1", "bytes")


# --- ensemble on fixed probabilities: a three-class and a two-class model ---

_STACKED = FLOWS + """,
probs AS (SELECT id, (id % 7)::DOUBLE / 16 AS a0, (k % 5)::DOUBLE / 16 AS a1, (id % 3)::DOUBLE / 8 AS a2,
    (k % 9)::DOUBLE / 16 AS b0, (id % 5)::DOUBLE / 8 AS b1 FROM flows),
stacked AS (SELECT id, 0 AS class, a0 AS p FROM probs UNION ALL SELECT id, 1, a1 FROM probs UNION ALL SELECT id, 2, a2 FROM probs
  UNION ALL SELECT id, 0, b0 FROM probs UNION ALL SELECT id, 1, b1 FROM probs),
averaged AS (SELECT id, class, avg(p) AS p FROM stacked GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, class) AS rn,
    row_number() OVER (PARTITION BY id, class <> 0 ORDER BY p DESC, class) AS rno FROM averaged),
decided AS (SELECT id, max(p) FILTER (rn = 1) AS score, max(class) FILTER (rn = 1) AS c, max(class) FILTER (class <> 0 AND rno = 1) AS o
  FROM ranked GROUP BY 1)"""
_NAMED = "CASE {} WHEN 0 THEN 'normal' WHEN 1 THEN 'attack' ELSE 'scanning' END"
_DECIDED = f"SELECT id, score, {_NAMED.format('c')} AS label, {_NAMED.format('o')} AS attack_label FROM decided"


def _probabilities(spark, sf):
    f = fixtures.flow_columns(spark, sf)
    part = lambda c, m, d: (F.col(c) % m).cast("double") / d
    return f.select(
        "id",
        F.array(part("id", 7, 16.0), part("k", 5, 16.0), part("id", 3, 8.0)).alias("a"),
        F.array(part("k", 9, 16.0), part("id", 5, 8.0)).alias("b"),
    )


@register("j05_ensemble_score", with_ctes(_STACKED, _DECIDED))
def ensemble(spark, sf):
    return ensemble_score(_probabilities(spark, sf), {"a": [0, 1, 2], "b": [0, 1]}).select("id", "score", "label", "attack_label")


def _long(spark, sf):
    p = _probabilities(spark, sf)
    each = lambda name: p.select(F.col("id").alias("flow_id"), F.posexplode(name).alias("class", "p"))
    return each("a").unionByName(each("b"))


@register("e14_class_averages", with_ctes(_STACKED, 'SELECT id AS flow_id, class AS "class", p FROM averaged'))
def class_averages(spark, sf):
    return average_class_probabilities(_long(spark, sf))


@register("f06_top_classes", with_ctes(_STACKED, _DECIDED.replace("SELECT id,", "SELECT id AS flow_id,")))
def best_classes(spark, sf):
    return top_classes(average_class_probabilities(_long(spark, sf)))


# --- metrics on a scored table ---

_SCORED = """s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
    (l_quantity * 2 + CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END) / 128.0::DOUBLE AS prob,
    CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'N' THEN 2 ELSE 0 END AS cls, (l_linenumber + l_partkey) % 3 AS hat FROM lineitem)"""
_CURVE = _SCORED + """, g AS (SELECT prob AS threshold, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM s GROUP BY 1),
c AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS cum_pos, CAST(sum(neg) OVER w AS BIGINT) AS cum_neg,
    sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg FROM g WINDOW w AS (ORDER BY threshold DESC)),
pr AS (SELECT *, cum_pos::DOUBLE / (cum_pos + cum_neg)::DOUBLE AS prec, cum_pos::DOUBLE / all_pos::DOUBLE AS rec FROM c)"""


def _scored(spark, sf):
    li = fixtures.table(spark, sf, "lineitem")
    hot = F.col("l_returnflag") == "R"
    return li.select(
        hot.cast("int").alias("y"),
        ((F.col("l_quantity") * 2 + F.when(hot, F.col("l_linenumber")).otherwise(0)) / 128.0).alias("prob"),
        F.when(hot, 1).when(F.col("l_returnflag") == "N", 2).otherwise(0).alias("cls"),
        ((F.col("l_linenumber") + F.col("l_partkey")) % 3).cast("int").alias("hat"),
    )


@register(
    "e05_confusion_matrix",
    with_ctes(_SCORED, "SELECT cls AS truth, count(*) FILTER (hat = 0) AS pred_0, count(*) FILTER (hat = 1) AS pred_1, count(*) FILTER (hat = 2) AS pred_2 FROM s GROUP BY 1"),
)
def confusion(spark, sf):
    return evaluation.confusion_matrix(_scored(spark, sf), "cls", "hat", [0, 1, 2])


@register("e05_confusion_counts", with_ctes(_SCORED, "SELECT cls AS truth, hat AS predicted, count(*) AS n FROM s GROUP BY 1, 2"))
def confusion_counts(spark, sf):
    return evaluation.confusion_counts(_scored(spark, sf), "cls", "hat").select("truth", "predicted", "n")


@register(
    "e06_classification_report",
    with_ctes(
        _SCORED
        + """, k AS (SELECT v.c, count(*) FILTER (cls = v.c AND hat = v.c)::DOUBLE AS tp, count(*) FILTER (hat = v.c)::DOUBLE AS pp,
             count(*) FILTER (cls = v.c)::DOUBLE AS ap FROM s, (VALUES (0), (1), (2), (3)) v(c) GROUP BY 1),
        m AS (SELECT CAST(c AS VARCHAR) AS name, CASE WHEN pp = 0 THEN 0 ELSE tp / pp END AS p, CASE WHEN ap = 0 THEN 0 ELSE tp / ap END AS r, ap FROM k),
        f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM m),
        a AS (SELECT count(*) FILTER (cls = hat)::DOUBLE / count(*) AS acc, count(*)::DOUBLE AS n FROM s)""",
        f"""SELECT name, {q_fixed('p')} AS p_fx, {q_fixed('r')} AS r_fx, {q_fixed('f')} AS f_fx, ap::BIGINT AS support FROM f
        UNION ALL SELECT 'accuracy', {q_fixed('acc')}, {q_fixed('acc')}, {q_fixed('acc')}, n::BIGINT FROM a
        UNION ALL SELECT 'macro avg', {q_fixed('avg(p)')}, {q_fixed('avg(r)')}, {q_fixed('avg(f)')}, sum(ap)::BIGINT FROM f
        UNION ALL SELECT 'weighted avg', {q_fixed('sum(p * ap) / sum(ap)')}, {q_fixed('sum(r * ap) / sum(ap)')}, {q_fixed('sum(f * ap) / sum(ap)')}, sum(ap)::BIGINT FROM f""",
    ),
)
def report(spark, sf):
    r = evaluation.classification_report(_scored(spark, sf), "cls", "hat", [0, 1, 2, 3])
    return r.select(
        "name", fixed(F.col("precision")).alias("p_fx"), fixed(F.col("recall")).alias("r_fx"), fixed(F.col("f1")).alias("f_fx"),
        F.col("support").cast("bigint").alias("support"),
    )


@register(
    "e07_threshold_metrics",
    with_ctes(
        _SCORED + """, k AS (SELECT count(*) FILTER (y = 1 AND prob >= 0.4)::DOUBLE AS tp, count(*) FILTER (y = 0 AND prob >= 0.4)::DOUBLE AS fp,
          count(*) FILTER (y = 1 AND prob < 0.4)::DOUBLE AS fn, count(*)::DOUBLE AS n FROM s)""",
        f"""SELECT {q_fixed('tp / (tp + fp)')} AS p_fx, {q_fixed('tp / (tp + fn)')} AS r_fx, {q_fixed('2 * tp / (2 * tp + fp + fn)')} AS f_fx,
            {q_fixed('(n - fp - fn) / n')} AS a_fx FROM k""",
    ),
)
def metrics_at(spark, sf):
    m = evaluation.threshold_metrics(_scored(spark, sf), "y", "prob", 0.4)
    return m.select(*[fixed(F.col(c)).alias(f"{c[0]}_fx") for c in ("precision", "recall", "f1", "accuracy")])


@register(
    "f04_threshold_curve",
    with_ctes(_CURVE, f"SELECT {q_fixed('threshold')} AS t_fx, pos, neg, cum_pos, cum_neg, {q_fixed('prec')} AS p_fx, {q_fixed('rec')} AS r_fx FROM pr"),
)
def curve(spark, sf):
    c = evaluation.threshold_curve(_scored(spark, sf), "y", "prob")
    return c.select(
        fixed(F.col("threshold")).alias("t_fx"), "pos", "neg", "cum_pos", "cum_neg",
        fixed(F.col("precision")).alias("p_fx"), fixed(F.col("recall")).alias("r_fx"),
    )


@register(
    "e08_roc_auc",
    with_ctes(
        _SCORED
        + """, r AS (SELECT y, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0::DOUBLE AS rk FROM s),
        t AS (SELECT sum(rk) FILTER (y = 1) AS rs, count(*) FILTER (y = 1)::DOUBLE AS p, count(*) FILTER (y = 0)::DOUBLE AS n FROM r)""",
        f"SELECT {q_fixed('(rs - p * (p + 1) / 2) / (p * n)')} AS auc_fx FROM t",
    ),
)
def auc(spark, sf):
    return evaluation.roc_auc(evaluation.threshold_curve(_scored(spark, sf), "y", "prob")).select(
        fixed(F.col("roc_auc")).alias("auc_fx")
    )


@register("e09_average_precision", with_ctes(_CURVE, f"SELECT {q_fixed('sum(pos * prec) / max(all_pos)')} AS ap_fx FROM pr"))
def mean_precision(spark, sf):
    return evaluation.average_precision(evaluation.threshold_curve(_scored(spark, sf), "y", "prob")).select(
        fixed(F.col("average_precision")).alias("ap_fx")
    )


@register(
    "e10_best_f1_threshold",
    with_ctes(
        _CURVE + """, f AS (SELECT threshold, 2 * (prec * rec) / greatest(prec + rec, 1e-9::DOUBLE) AS f1 FROM pr),
          b AS (SELECT threshold AS best FROM f ORDER BY f1 DESC, threshold LIMIT 1)""",
        f"""SELECT {q_fixed('least(greatest(coalesce((SELECT max(threshold) FROM f WHERE threshold < best), best), 0.05), 0.95)')} AS t_fx FROM b""",
    ),
)
def best_threshold(spark, sf):
    return evaluation.best_f1_threshold(evaluation.threshold_curve(_scored(spark, sf), "y", "prob")).select(
        fixed(F.col("threshold")).alias("t_fx")
    )


@register(
    "e13_fold_summary",
    with_ctes(
        _SCORED.replace(" FROM lineitem", ", l_suppkey % 5 AS fold FROM lineitem")
        + ", a AS (SELECT fold, avg(CASE WHEN cls = hat THEN 1.0 ELSE 0.0 END) AS acc FROM s GROUP BY 1)",
        f"SELECT {q_fixed('avg(acc)')} AS mean_fx, {q_fixed('stddev_pop(acc)')} AS std_fx FROM a",
    ),
)
def fold_scores(spark, sf):
    li = fixtures.table(spark, sf, "lineitem")
    cls = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "N", 2).otherwise(0)
    right = (cls == (F.col("l_linenumber") + F.col("l_partkey")) % 3).cast("int")
    per_fold = li.groupBy((F.col("l_suppkey") % 5).alias("fold")).agg(F.avg(right).alias("accuracy"))
    s = evaluation.fold_summary(per_fold)
    return s.select(fixed(F.col("mean")).alias("mean_fx"), fixed(F.col("std")).alias("std_fx"))


@register(
    "e17_class_weights",
    with_ctes(
        _SCORED + ", n AS (SELECT cls, count(*)::DOUBLE AS n FROM s GROUP BY 1)",
        f"SELECT cls, {q_fixed('sum(n) OVER () / (count(*) OVER () * n)')} AS w_fx FROM n",
    ),
)
def class_weights(spark, sf):
    return evaluation.class_weights(_scored(spark, sf), "cls").select("cls", fixed(F.col("weight")).alias("w_fx"))


@register(
    "j17_class_moments",
    with_ctes(
        SERIES_SQL,
        f"""SELECT CAST(n_flows > 4 AS INT) AS big, count(*) AS n, {q_fixed('avg(avg_ttl)')} AS mean_fx,
            {q_fixed('covar_pop(avg_ttl, n_dest_ip)')} AS cov_fx FROM series GROUP BY 1""",
    ),
)
def class_moments(spark, sf):
    s = fixtures.series(spark, sf)
    return s.groupBy((F.col("n_flows") > 4).cast("int").alias("big")).agg(
        F.count(F.lit(1)).alias("n"),
        fixed(F.avg("avg_ttl")).alias("mean_fx"),
        fixed(F.covar_pop("avg_ttl", "n_dest_ip")).alias("cov_fx"),
    )
