"""Models, evaluation tables, priorities."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.functions import values as V
from failscope.operators import anomaly as A
from failscope.operators import classify as C
from failscope.operators import cluster as L
from failscope.operators import encode as N
from failscope.operators import evaluate as E
from failscope.operators import scoring as S
from failscope.operators import vectors as X
from failscope.operators.embedding import message_vectors
from failscope.operators.terms import tfidf_unbounded
from failscope.plans.prioritise import test_case_features, unified_training_table
from failscope.storage import materialize
from registry.base import ev_sql, logs_ev, query, r, table

#: Trees of the registered forests, the operator's default.
FOREST = 300

_ENGLISH = ", ".join("'" + w.replace("'", "''") + "'" for w in K.SPARK_STOP_WORDS)


@query("g07_horizontal_blocks", """
SELECT event_id, round(value, 6) AS a, round(event_id % 7, 6) AS b, CAST(2 AS BIGINT) AS width FROM events""")
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value", (F.col("event_id") % 7).alias("k"))
    parts = F.unwrap_udt("features")
    values = F.when(parts["type"] == 1, parts["values"])
    dense = X.assemble(rows, ["value", "k"])
    # A vector with zeros may be stored sparse; spell both forms out.
    at = lambda i: F.coalesce(F.get(values, F.lit(i)), F.get(
        parts["values"], F.array_position(parts["indices"], i).cast("int") - 1), F.lit(0.0))
    return dense.select("event_id", r(at(0)).alias("a"), r(at(1)).alias("b"), F.lit(2).cast("bigint").alias("width"))


@query("h01_tfidf_vectors", rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_\p{{M}}]{{2,}}')) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term NOT IN ({_ENGLISH}) GROUP BY ALL),
v AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
x AS (SELECT doc_id, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM c JOIN v USING (term))
SELECT d.doc_id, count(w) AS terms, round(coalesce(sum(w) / sqrt(sum(w * w)), 0), 5) AS weight_sum FROM documents d LEFT JOIN x USING (doc_id) GROUP BY 1""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    values = F.unwrap_udt("tfidf")["values"]
    return tfidf_unbounded(docs, "text", bigrams=False).select(
        "doc_id", F.size(values).cast("bigint").alias("terms"),
        r(F.aggregate(values, F.lit(0.0), lambda a, b: a + b), 5).alias("weight_sum"))


@query("h01_tfidf_bigrams", ev_sql("""
SELECT d.event_id, count(w) AS terms, round(coalesce(sum(w) / sqrt(sum(w * w)), 0), 5) AS weight_sum FROM ev d LEFT JOIN x USING (event_id) GROUP BY 1""", f"""
l AS (SELECT event_id, list_filter(regexp_extract_all(lower(coalesce(error_msg, '')), '[\\p{{L}}\\p{{N}}_\\p{{M}}]{{2,}}'), lambda t: t NOT IN ({_ENGLISH})) AS ws FROM ev),
t AS (SELECT event_id, unnest(ws) AS term FROM l
  UNION ALL SELECT event_id, unnest(list_transform(list_zip(ws[1:len(ws) - 1], ws[2:]), lambda p: p[1] || ' ' || p[2])) FROM l WHERE len(ws) > 1),
c AS (SELECT event_id, term, count(*) AS tf FROM t GROUP BY ALL),
v AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
x AS (SELECT event_id, tf * (ln((1 + (SELECT count(*) FROM ev)) / (1 + df)) + 1) AS w FROM c JOIN v USING (term))"""))
def _(spark, sf):
    logs = logs_ev(spark, sf).select("event_id", "error_msg")
    model = X.tfidf_model(logs, "error_msg", max_features=5000)
    values = F.unwrap_udt("tfidf")["values"]
    return X.tfidf(logs, model, "error_msg").select(
        "event_id", F.size(values).cast("bigint").alias("terms"), r(F.aggregate(values, F.lit(0.0), lambda a, b: a + b), 5).alias("weight_sum"))


@query("h02_standard_scaling", """
SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS value_scaled,
 0.0::DOUBLE AS same_scaled FROM events""")
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value", F.lit(3).alias("same"))
    out = X.scale(rows, ["value", "same"])
    return out.select("event_id", r("value_scaled").alias("value_scaled"), r("same_scaled").alias("same_scaled"))


@query("h03_kmeans_clusters", """
SELECT vec_id, label, TRUE AS nearest, CAST(10 AS BIGINT) AS clusters, TRUE AS best_of_starts FROM embeddings""")
def _(spark, sf):
    """Every row has the centre nearest to it, ten clusters are used, and the cost is that of the rows and of the best start."""
    array = F.col("embedding").cast("array<double>")
    rows = materialize(table(spark, sf, "embeddings").select("vec_id", "label", array_to_vector(array).alias("v")), "points")
    model = L.best_kmeans(rows, "v", k=10)
    placed = model.transform(rows, "v").withColumn("x", vector_to_array("v"))
    centres = F.array(*[F.array(*[F.lit(float(c)) for c in centre]) for centre in model.clusterCenters()])
    far = F.transform(centres, lambda c: F.aggregate(F.zip_with("x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    checked = placed.withColumn("nearest", F.get(far, F.col("cluster")) <= F.array_min(far) + 1e-9)
    summary = placed.agg(F.count_distinct("cluster").alias("clusters"), F.sum(F.array_min(far)).alias("cost")).first()
    best = len(model.costs) == 10 and model.cost == min(model.costs) and abs(summary.cost - model.cost) < 1e-6 * model.cost
    return checked.select("vec_id", "label", "nearest", F.lit(summary.clusters).cast("bigint").alias("clusters"), F.lit(best).alias("best_of_starts"))


@query("h04_message_embedding", ev_sql("SELECT event_id, CAST(32 AS BIGINT) AS width, TRUE AS equal_for_equal_text, error_msg IS NULL AS is_zero FROM ev"))
def _(spark, sf):
    """Word vectors: of the set width, equal for equal messages, zero only without words."""
    rows = logs_ev(spark, sf).select("event_id", "error_msg")
    out = materialize(message_vectors(rows, "error_msg", width=32, output="e"), "embedded")
    spread = out.groupBy(F.col("error_msg").alias("m")).agg((F.min("e") == F.max("e")).alias("equal_for_equal_text"))
    return out.join(spread, F.col("error_msg").eqNullSafe(F.col("m"))).select(
        "event_id", F.size("e").cast("bigint").alias("width"), "equal_for_equal_text", F.forall("e", lambda x: x == 0).alias("is_zero"))


def _training(spark, sf):
    return logs_ev(spark, sf).select(
        "event_id", "test_case_id", "filename", "dut", "suite", "cluster", "error_msg", F.col("status").alias("label"))


_HELD = """held AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY md5(CAST(event_id AS VARCHAR) || '42'), event_id)
  <= round(0.2 * count(*) OVER (PARTITION BY status)) AS is_test FROM ev)"""


@query("h05_status_classifier", ev_sql("""
SELECT status AS actualstatus, count(*) AS rows, TRUE AS known_right, TRUE AS mostly_right FROM held WHERE is_test GROUP BY 1""", _HELD))
def _(spark, sf):
    """Of the held-out rows, those with a message name their status in it: all right; of all rows 70 % at least."""
    rows = materialize(N.stratified_split(_training(spark, sf), "label", "event_id"), "training")
    model = C.status_classifier(rows.filter("is_test = 0"), trees=FOREST, depth=30, max_features=5000)
    out = materialize(C.classified(rows.filter("is_test = 1"), model), "classified")
    right = (F.col("actualstatus") == F.col("predictedlabel"))
    share = out.agg(F.avg(right.cast("double")).alias("s")).scalar()
    return out.groupBy("actualstatus").agg(
        F.count("*").alias("rows"), F.min(right | (F.col("errormsg") == "")).alias("known_right")).withColumn("mostly_right", share >= 0.7)


@query("h06_confidence_and_output", ev_sql("""
SELECT test_case_id, filename, dut, suite, cluster AS cluster_label, status AS actualstatus, coalesce(error_msg, '') AS errormsg,
 TRUE AS known_label, TRUE AS share, TRUE AS flag_fits FROM ev"""))
def _(spark, sf):
    """Confidence is a share of three classes, and the flag follows from it."""
    rows = _training(spark, sf)
    out = C.classified(rows, C.status_classifier(rows, trees=FOREST, depth=30, max_features=5000))
    c = F.col("confidence")
    return out.select("test_case_id", "filename", "dut", "suite", "cluster_label", "actualstatus", "errormsg",
                      F.col("predictedlabel").isin("PASS", "FAIL", "ABORT").alias("known_label"), ((c > 0.33) & (c <= 1.0 + 1e-9)).alias("share"),
                      (F.col("lowconfidenceflag") == (c < 0.6).cast("int")).alias("flag_fits"))


@query("h07_classified_counts", ev_sql("""
SELECT status AS actualstatus, count(*) AS rows, count(DISTINCT filename || '/' || coalesce(error_msg, '')) AS messages,
 count(*) FILTER (error_msg IS NOT NULL) AS with_message, count(*) FILTER (error_msg IS NOT NULL) AS right_with_message FROM ev GROUP BY 1"""))
def _(spark, sf):
    """The output has train and test rows, and the status of every message that names it."""
    rows = materialize(N.stratified_split(_training(spark, sf), "label", "event_id"), "training")
    model = C.status_classifier(rows.filter("is_test = 0"), trees=FOREST, depth=30, max_features=5000)
    return C.classified(rows, model).groupBy("actualstatus").agg(
        F.count("*").alias("rows"), F.count_distinct(F.concat_ws("/", "filename", "errormsg")).alias("messages"),
        F.count_if(F.col("errormsg") != "").alias("with_message"),
        F.count_if((F.col("errormsg") != "") & (F.col("predictedlabel") == F.col("actualstatus"))).alias("right_with_message"))


def _anomaly_input(spark, sf):
    return logs_ev(spark, sf).select(
        "event_id", "dut", "suite", "error_msg", F.col("value").alias("execution_duration"),
        F.col("pred_prob").alias("time_since_last_failure"))


@query("h08_isolation_forest", ev_sql("""
SELECT event_id, row_number() OVER (ORDER BY event_id) AS "LogID", coalesce(substr(error_msg, 1, 150), '') || '...' AS "MessageSnippet", TRUE AS flag_fits, TRUE AS share_fits FROM ev"""))
def _(spark, sf):
    """Dense row numbers, snippets, the flag below the exact 5 % quantile, and as many flags as that allows."""
    out = materialize(A.detect_anomalies(_anomaly_input(spark, sf), "event_id", [F.col("event_id")]), "anomalies")
    q = out.agg(F.percentile("anomaly_score", F.lit(0.05)).alias("q")).scalar()
    flagged = out.agg((F.sum("is_anomaly") <= F.ceil(F.count("*") * 0.05)).alias("b")).scalar()
    fits = F.col("is_anomaly") == ((F.col("anomaly_score") < q) & (F.col("anomaly_score") < 0)).cast("int")
    return out.select("event_id", "LogID", F.coalesce("MessageSnippet", F.lit("")).alias("MessageSnippet"), fits.alias("flag_fits"),
                      flagged.alias("share_fits"))


@query("h09_anomaly_flag", """
SELECT event_id, CAST(value < (SELECT quantile_cont(value, 0.05) FROM events) AS INTEGER) AS is_anomaly FROM events""")
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("value").alias("anomaly_score"))
    return A.anomaly_flags(rows).select("event_id", "is_anomaly")


_AXES = """SELECT count(*) AS rows, TRUE AS centred, TRUE AS uncorrelated, TRUE AS in_order, TRUE AS beats_columns FROM embeddings"""


@query("h10_principal_axes", _AXES)
def _(spark, sf):
    """Coordinates with zero mean and covariance, variances in falling order and above that of any column."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    out = materialize(X.principal_axes(rows, "v"), "axes")
    widest = rows.select("vec_id", F.posexplode("embedding")).groupBy("pos").agg(F.var_samp("col").alias("s")).agg(F.max("s").alias("s")).scalar()
    first, second = F.var_samp("pca_1"), F.var_samp("pca_2")
    return out.agg(
        F.count("*").alias("rows"), (F.abs(F.avg("pca_1")) + F.abs(F.avg("pca_2")) < 1e-6).alias("centred"),
        (F.abs(F.covar_samp("pca_1", "pca_2")) < 1e-6 * first).alias("uncorrelated"), (first >= second).alias("in_order"),
        (first >= F.first(widest) * (1 - 1e-6)).alias("beats_columns"))


_SPLIT = """SELECT {id}, CAST(row_number() OVER (PARTITION BY {label} ORDER BY md5(CAST({id} AS VARCHAR) || '42'), {id})
  <= round(0.2 * count(*) OVER (PARTITION BY {label})) AS INTEGER) AS is_test FROM {table}"""


@query("h11_stratified_split", _SPLIT.format(id="doc_id", label="quality", table="labels"))
def _(spark, sf):
    return N.stratified_split(table(spark, sf, "labels"), "quality", "doc_id").select("doc_id", "is_test")


@query("h11_stratified_split_orders", _SPLIT.format(id="o_orderkey", label="o_orderstatus", table="orders"))
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return N.stratified_split(rows, "o_orderstatus", "o_orderkey").select("o_orderkey", "is_test")


def _risk_rows(spark, sf):
    rows = logs_ev(spark, sf).select(
        "event_id", "status", "test_case_id", "dut", "suite", F.col("value").alias("execution_duration"),
        F.hour("timestamp").alias("exec_hour"), (F.col("user_id") % 10).cast("int").alias("cluster"))
    rows, features = C.risk_features(C.fail_target(rows))
    return materialize(N.stratified_split(rows, "isFail", "event_id"), "risk"), features


#: By application and tables: the three queries below look at one and the same model.
_RISK: dict[tuple[str, str], tuple] = {}


def _risk_model(spark, sf):
    """Rows with the split, features, and the model of the operator's default (400 rounds, depth 6) on the training rows."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RISK:
        rows, features = _risk_rows(spark, sf)
        _RISK[key] = rows, features, C.risk_model(rows.filter("is_test = 0"), features)
    return _RISK[key]


@query("h12_boosted_risk_model", ev_sql("""SELECT event_id, fail_flag AS "isFail", TRUE AS is_share, TRUE AS ranks_failures FROM ev"""))
def _(spark, sf):
    """A probability for every row, and failures ranked above the others more often than by chance."""
    rows, _, model = _risk_model(spark, sf)
    out = materialize(C.risk_scored(rows, model).select("event_id", "isFail", "pred_prob"), "scored")
    better = E.roc_auc(out, "isFail", "pred_prob").select(F.col("auc") > 0.55).scalar()
    return out.select("event_id", "isFail", F.col("pred_prob").between(0.0, 1.0).alias("is_share"), better.alias("ranks_failures"))


@query("h13_class_weight", ev_sql("""
SELECT greatest(1.0, sum(1 - fail_flag)::DOUBLE / greatest(1, sum(fail_flag))) AS scale_pos_weight FROM ev"""))
def _(spark, sf):
    return N.class_weight(logs_ev(spark, sf).withColumnRenamed("fail_flag", "isFail"))


@query("h14_label_encoding", ev_sql("""
SELECT event_id, CAST(dense_rank() OVER (ORDER BY coalesce(nullif(dut, 'DUT3'), 'Unknown')) - 1 AS INTEGER) AS dut,
 CAST(dense_rank() OVER (ORDER BY suite) - 1 AS INTEGER) AS suite FROM ev"""))
def _(spark, sf):
    rows = logs_ev(spark, sf).select("event_id", F.nullif("dut", F.lit("DUT3")).alias("dut"), "suite")
    return N.label_encode(rows, ["dut", "suite", "absent"])


@query("h15_risk_feature_matrix", ev_sql("""
SELECT event_id, round(value, 6) AS execution_duration__x, CAST(hour("timestamp") AS DOUBLE) AS exec_hour__x,
 round(avg(fail_flag) OVER (PARTITION BY test_case_id), 6) AS test_case_id_te, round(avg(fail_flag) OVER (PARTITION BY dut), 6) AS dut_te,
 round(avg(fail_flag) OVER (PARTITION BY suite), 6) AS suite_te, round(avg(fail_flag) OVER (PARTITION BY user_id % 10), 6) AS cluster_te FROM ev"""))
def _(spark, sf):
    rows, features = _risk_rows(spark, sf)
    return rows.select("event_id", *[r(f).alias(f) for f in features])


@query("h16_binary_metrics", """
WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp,
 count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels)
SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
 round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""")
def _(spark, sf):
    out = E.binary_metrics(table(spark, sf, "labels"), "quality", "toxic")
    return out.select(*[r(c).alias(c) for c in out.columns])


_GUESS = """p AS (SELECT status AS a, CASE WHEN event_id % 5 = 0 THEN 'PASS' WHEN event_id % 7 = 0 THEN 'FAIL' ELSE status END AS b FROM ev)"""


def _guesses(spark, sf):
    guess = F.when(F.col("event_id") % 5 == 0, "PASS").when(F.col("event_id") % 7 == 0, "FAIL").otherwise(F.col("status"))
    return logs_ev(spark, sf).select("status", guess.alias("guess"))


@query("h17_class_report", ev_sql("""
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round("f1-score", 6) AS "f1-score", round(support, 6) AS support FROM (
SELECT class, precision, recall, "f1-score", support FROM s
UNION ALL SELECT 'accuracy', x, x, x, x FROM (SELECT avg(CAST(a = b AS INTEGER)) AS x FROM p)
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg("f1-score"), sum(support) FROM s
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum("f1-score" * support) / sum(support), sum(support) FROM s)""",
_GUESS + """, s AS (SELECT class, hit / guessed AS precision, hit / support AS recall, 2 * hit / (guessed + support) AS "f1-score", support FROM
 (SELECT c AS class, count(*) FILTER (a = c)::DOUBLE AS support, count(*) FILTER (b = c)::DOUBLE AS guessed, count(*) FILTER (a = c AND b = c)::DOUBLE AS hit
  FROM p, (SELECT unnest(['ABORT', 'FAIL', 'PASS']) AS c) GROUP BY c))"""))
def _(spark, sf):
    out = E.class_report(_guesses(spark, sf), "status", "guess")
    return out.select("class", *[r(c).alias(c) for c in ("precision", "recall", "f1-score", "support")])


@query("h18_confusion_matrix", ev_sql("""
SELECT x AS actual, y AS predicted, count(a) AS count FROM (SELECT unnest(['ABORT', 'FAIL', 'PASS']) AS x), (SELECT unnest(['ABORT', 'FAIL', 'PASS']) AS y)
LEFT JOIN p ON a = x AND b = y GROUP BY 1, 2""", _GUESS))
def _(spark, sf):
    return E.confusion_matrix(_guesses(spark, sf), "status", "guess")


@query("h19_roc_points", ev_sql("""
SELECT s AS threshold, tp, fp, round(tp / max(tp) OVER (), 6) AS tpr, round(fp / max(fp) OVER (), 6) AS fpr FROM
(SELECT pred_prob AS s, CAST(sum(sum(fail_flag)) OVER (ORDER BY pred_prob DESC) AS BIGINT) AS tp,
 CAST(sum(sum(1 - fail_flag)) OVER (ORDER BY pred_prob DESC) AS BIGINT) AS fp FROM ev GROUP BY pred_prob)"""))
def _(spark, sf):
    out = E.roc_points(logs_ev(spark, sf), "fail_flag", "pred_prob")
    return out.select("threshold", "tp", "fp", r("tpr").alias("tpr"), r("fpr").alias("fpr"))


@query("h19_roc_auc", ev_sql("""
SELECT round((sum(CASE WHEN fail_flag = 1 THEN rk END) - max(p) * (max(p) + 1) / 2) / (max(p) * max(n)), 6) AS auc FROM
(SELECT fail_flag, rank() OVER (ORDER BY pred_prob) + (count(*) OVER (PARTITION BY pred_prob) - 1) / 2 AS rk,
 sum(fail_flag) OVER () AS p, sum(1 - fail_flag) OVER () AS n FROM ev)"""))
def _(spark, sf):
    return E.roc_auc(logs_ev(spark, sf), "fail_flag", "pred_prob").select(r("auc").alias("auc"))


@query("h20_calibration_curve", ev_sql("""
SELECT CAST(greatest(ceil(s * 10), 1) AS INTEGER) AS bin, round(avg(fail_flag), 6) AS prob_true, round(avg(s), 5) AS prob_pred, count(*) AS count
FROM (SELECT *, pow(pred_prob, 1.7) AS s FROM ev) GROUP BY 1"""))
def _(spark, sf):
    rows = logs_ev(spark, sf).withColumn("s", F.pow("pred_prob", F.lit(1.7)))
    out = E.calibration_curve(rows, "fail_flag", "s")
    return out.select("bin", r("prob_true").alias("prob_true"), r("prob_pred", 5).alias("prob_pred"), "count")


@query("h21_top_k_capture", ev_sql("""
SELECT CAST(pct AS INTEGER) AS pct, k, CAST(count(*) FILTER (fail_flag = 1) AS BIGINT) AS captured,
 round(100.0 * count(*) FILTER (fail_flag = 1) / (SELECT sum(fail_flag) FROM ev), 2) AS captured_pct FROM
 (SELECT unnest(generate_series(1, 20)) AS pct), LATERAL (SELECT greatest(1, ((SELECT count(*) FROM ev) * pct + 99) // 100) AS k) JOIN
 (SELECT fail_flag, row_number() OVER (ORDER BY pred_prob DESC, event_id) AS rk FROM ev) ON rk <= k GROUP BY 1, 2"""))
def _(spark, sf):
    return E.top_k_capture(logs_ev(spark, sf), "fail_flag", "pred_prob", "event_id")


@query("h22_feature_importance", """
SELECT unnest(['execution_duration', 'exec_hour', 'test_case_id_te', 'dut_te', 'suite_te', 'cluster_te']) AS feature, TRUE AS is_share, TRUE AS sums_to_one""")
def _(spark, sf):
    out = C.feature_importance(_risk_model(spark, sf)[2], spark)
    total = out.agg((F.abs(F.sum("importance") - 1) < 1e-6).alias("t")).scalar()
    return out.select("feature", F.col("importance").between(0.0, 1.0).alias("is_share"), total.alias("sums_to_one"))


@query("h23_test_predictions", ev_sql("""
SELECT round(value, 6) AS execution_duration__x, fail_flag AS actual, TRUE AS label_fits FROM
 (SELECT *, row_number() OVER (PARTITION BY fail_flag ORDER BY md5(CAST(event_id AS VARCHAR) || '42'), event_id)
  <= round(0.2 * count(*) OVER (PARTITION BY fail_flag)) AS is_test FROM ev) WHERE is_test"""))
def _(spark, sf):
    rows, features, model = _risk_model(spark, sf)
    out = C.test_predictions(rows.filter("is_test = 1"), model, features)
    return out.select(r("execution_duration__x").alias("execution_duration__x"), "actual",
                      (F.col("pred_label") == (F.col("pred_prob") >= 0.5).cast("int")).alias("label_fits"))


_SCORED = """s AS (SELECT event_id, test_case_id, pred_prob, value, fail_flag, user_id % 10 AS cluster, 1 + 5 * exp(-least(greatest(value * 10, 0), 1000) / 30.0) AS recency_weight,
 1 + 2 * avg(fail_flag) OVER (PARTITION BY user_id % 10) AS cluster_weight FROM ev),
w AS (SELECT *, pred_prob * recency_weight * cluster_weight AS priority_score FROM s),
q AS (SELECT quantile_cont(priority_score, 0.9) AS h, quantile_cont(priority_score, 0.6) AS m FROM w)"""


def _scored(spark, sf):
    return logs_ev(spark, sf).select(
        "event_id", "test_case_id", "pred_prob", "value", F.col("fail_flag").alias("isFail"),
        (F.col("value") * 10).alias("time_since_last_failure"), (F.col("user_id") % 10).alias("cluster"))


@query("h24_prioritised", ev_sql("""
SELECT event_id, round(recency_weight, 6) AS recency_weight, round(cluster_weight, 6) AS cluster_weight, round(priority_score, 6) AS priority_score,
 CASE WHEN priority_score > h THEN 'HIGH RISK' WHEN priority_score > m THEN 'MEDIUM RISK' ELSE 'LOW RISK' END AS priority_group FROM w, q""", _SCORED))
def _(spark, sf):
    out = S.prioritise(_scored(spark, sf))
    return out.select("event_id", *[r(c).alias(c) for c in ("recency_weight", "cluster_weight", "priority_score")], "priority_group")


@query("h25_risk_scores", ev_sql("""
SELECT test_case_id AS test_case, pred_prob AS predicted_probability, round(priority_score, 6) AS priority_score,
 CASE WHEN priority_score > h THEN 'HIGH' WHEN priority_score > m THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 'cluster:' || cluster || ';isFail:' || fail_flag AS top_features FROM w, q""", _SCORED))
def _(spark, sf):
    out = S.risk_scores(S.prioritise(_scored(spark, sf), sort=False), ["cluster", "absent", "isFail"])
    return out.withColumn("priority_score", r("priority_score"))


@query("h26_unified_training_table", ev_sql("""
SELECT filename, line_number, test_case_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') AS executiontime,
 round(coalesce(avg(fail_flag) OVER p, 0), 6) AS past_failure_rate,
 round(CASE WHEN fail_flag = 1 THEN (epoch_us("timestamp") - epoch_us(last_value(CASE WHEN fail_flag = 1 THEN "timestamp" END IGNORE NULLS) OVER a)) / 1e6 ELSE 0 END, 6) AS time_since_last_failure,
 count(*) OVER p AS execution_frequency, 0.0::DOUBLE AS avg_duration,
 CAST(regexp_matches(coalesce(snippet, ''), '(?i)fail|error|exception|abort') AS INTEGER) AS keyword_fail,
 coalesce(clu, -1) AS clusterlabel,
 round(coalesce(avg(coalesce(is_anomaly, 0)) OVER p, 0), 6) AS rolling_anomaly_rate,
 round(avg(coalesce(score, 0)) OVER r, 6) AS mean_anomaly_score,
 CAST(isodow("timestamp") - 1 AS INTEGER) AS exec_day, CAST(hour("timestamp") AS INTEGER) AS exec_hour,
 CAST(dense_rank() OVER (ORDER BY 'v' || (user_id % 4)) - 1 AS INTEGER) AS dut_version,
 CAST(dense_rank() OVER (ORDER BY dut) - 1 AS INTEGER) AS dut, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS config,
 CAST(dense_rank() OVER (ORDER BY suite) - 1 AS INTEGER) AS suite, fail_flag AS target
FROM (SELECT ev.*, c.clu, CASE WHEN event_id % 3 <> 0 THEN sqrt(value) END AS score, CASE WHEN event_id % 3 <> 0 THEN CAST(value < 10 AS INTEGER) END AS is_anomaly,
  CASE WHEN event_id % 3 <> 0 THEN error_msg END AS snippet FROM ev
  LEFT JOIN (SELECT test_case_id AS tc, suite AS su, arg_min(cluster, struct_pack(f := filename, l := line_number)) AS clu FROM ev WHERE user_id % 10 <> 3 GROUP BY 1, 2) c
  ON test_case_id = tc AND suite = su)
WINDOW p AS (PARTITION BY test_case_id ORDER BY filename, line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
 r AS (PARTITION BY test_case_id ORDER BY filename, line_number ROWS UNBOUNDED PRECEDING),
 a AS (PARTITION BY test_case_id ORDER BY filename, line_number ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""))
def _(spark, sf):
    ev = logs_ev(spark, sf)
    logs = ev.select("filename", "line_number", "timestamp", "status", "test_case_id", "suite", "dut",
                     F.concat(F.lit("v"), F.col("user_id") % 4).alias("dut_version"), F.col("event_type").alias("config"))
    classified = ev.select(F.col("test_case_id").alias(" TestCase"), F.col("suite").alias("Suite"),
                           F.col("status").alias("PredictedLabel"), "filename", "line_number")
    clusters = ev.filter(F.col("user_id") % 10 != 3).select("test_case_id", "suite", "cluster", "filename", "line_number")
    anomalies = ev.filter(F.col("event_id") % 3 != 0).select(
        "filename", "test_case_id", "suite", "line_number", F.sqrt("value").alias("anomaly_score"),
        (F.col("value") < 10).cast("int").alias("is_anomaly"), F.col("error_msg").alias("MessageSnippet"))
    out = unified_training_table(logs, classified, clusters, anomalies)
    return out.withColumns({
        "executiontime": F.date_format("executiontime", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        "time_since_last_failure": r("time_since_last_failure"),
        **{c: r(c) for c in ("past_failure_rate", "rolling_anomaly_rate", "mean_anomaly_score")}})


@query("h26_test_case_features", ev_sql("""
SELECT event_id, coalesce(upper(predicted), '') AS predicted_label, upper(coalesce(actual, status)) AS actual_status,
 CAST(upper(coalesce(actual, status)) = 'FAIL' AS INTEGER) AS fail_flag,
 round(avg(CAST(upper(coalesce(actual, status)) = 'FAIL' AS INTEGER)) OVER (PARTITION BY tc), 6) AS failure_rate,
 CAST(sum(CAST(upper(coalesce(actual, status)) = 'FAIL' AS INTEGER)) OVER (PARTITION BY tc) AS BIGINT) AS regression_group,
 row_number() OVER (PARTITION BY dut, suite ORDER BY run_date, "timestamp", event_id) AS schedule_cycle,
 CAST(coalesce(sum(CAST(upper(coalesce(actual, status)) = 'FAIL' AS INTEGER)) OVER (PARTITION BY tc ORDER BY dut, suite, run_date, "timestamp", event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS past_failure_frequency
FROM (SELECT ev.*, ev.test_case_id AS tc, c.predicted, c.actual FROM ev LEFT JOIN c ON ev.filename = c.filename AND ev.dut = c.dut AND ev.suite = c.suite AND ev.test_case_id = c.test_case_id)""", """
c AS (SELECT filename, dut, suite, test_case_id, lower(status) AS predicted, status AS actual FROM
 (SELECT *, row_number() OVER (PARTITION BY filename, dut, suite, test_case_id ORDER BY pred_prob DESC, status) AS i FROM
  (SELECT DISTINCT filename, dut, suite, test_case_id, status, pred_prob FROM ev WHERE event_id % 2 = 0)) WHERE i = 1)"""))
def _(spark, sf):
    ev = logs_ev(spark, sf)
    anomalies = ev.select("event_id", "filename", F.col("dut").alias("DUT"), "suite", "test_case_id", "status", "run_date",
                          "timestamp", "error_msg")
    classified = ev.filter(F.col("event_id") % 2 == 0).select(
        "filename", "dut", "suite", "test_case_id", F.lower("status").alias("PredictedLabel"),
        F.col("status").alias("ActualStatus"), F.col("pred_prob").alias("confidence"), F.lit("m").alias("errormsg"))
    out = test_case_features(anomalies, classified, order=("event_id",))
    return out.select("event_id", F.coalesce(F.upper("predicted_label"), F.lit("")).alias("predicted_label"), "actual_status",
                      "fail_flag", r("failure_rate").alias("failure_rate"), "regression_group", "schedule_cycle", "past_failure_frequency")


@query("h27_anomaly_points", """
SELECT 'DUT' || label || ' | rtp' AS label, count(*) AS points, TRUE AS placed FROM embeddings WHERE embedding[1] < -0.1 GROUP BY 1""")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.concat(F.lit("DUT"), "label").alias("dut"), F.lit("rtp").alias("suite"),
        V.flag(F.col("embedding")[0] < -0.1).alias("is_anomaly"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    points = A.anomaly_points(X.principal_axes(rows, "v"))
    return points.groupBy("label").agg(F.count("*").alias("points"), F.min(F.col("pca_1").isNotNull() & F.col("pca_2").isNotNull()).alias("placed"))
