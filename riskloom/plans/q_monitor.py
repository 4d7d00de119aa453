"""Drift, monitoring and data-quality queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from riskloom.operators import drift as dr
from riskloom.operators import evaluate as ev
from riskloom.operators import quality as dq
from riskloom.plans import base
from riskloom.plans.registry import query
from riskloom.plans.sql_base import CLAIMS, LOG_W, SCORED_W, SPLIT, SPLIT_W, with_

# The log covers January 2024; monitoring queries take an explicit as-of time.
AS_OF = dt.datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
EDGES_SQL = "[" + ", ".join(repr(e) for e in dr.INNER_EDGES) + "]"


def _bin_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 0 AND {x} <= 1 THEN len(list_filter({EDGES_SQL}, lambda e: e <= {x})) END"


HIST_SQL = LOG_W.rstrip("\n") + f""",
w AS (SELECT *, CASE WHEN ts >= {AS_OF_SQL} - INTERVAL 7 DAY THEN 'current' ELSE 'baseline' END AS period
      FROM log WHERE ts >= {AS_OF_SQL} - INTERVAL 14 DAY AND ts < {AS_OF_SQL}),
b AS (SELECT period, {_bin_sql('fraud_score')} AS bin FROM w),
cnt AS (SELECT period, bin, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY period, bin),
spine AS (SELECT period, CAST(i AS INTEGER) AS bin FROM (SELECT DISTINCT period FROM cnt) CROSS JOIN range(10) r(i)),
full_ AS (SELECT period, bin, coalesce(n, 0) AS n FROM spine LEFT JOIN cnt USING (period, bin)),
hist AS (SELECT period, bin, n, CASE WHEN sum(n) OVER (PARTITION BY period) > 0
                                     THEN n / sum(n) OVER (PARTITION BY period) ELSE 0.0 END AS p,
                CAST(sum(n) OVER (PARTITION BY period) AS BIGINT) AS total FROM full_)
"""


@query("score_histogram", HIST_SQL + "SELECT period, bin, n, p, total FROM hist")
def score_histogram(spark, d):
    """DR-1 per period (numpy edges, last bin closed)."""
    log = base.prediction_log(spark, d)
    w = log.where((F.col("ts") >= F.lit(AS_OF - dt.timedelta(days=14))) & (F.col("ts") < F.lit(AS_OF))) \
           .withColumn("period", F.when(F.col("ts") >= F.lit(AS_OF - dt.timedelta(days=7)), F.lit("current"))
                       .otherwise(F.lit("baseline")))
    return dr.score_histogram(w, "fraud_score", "period")


KLJS_SQL = HIST_SQL.rstrip("\n") + """,
pq AS (SELECT bin, max(CASE WHEN period = 'baseline' THEN p END) AS p, max(CASE WHEN period = 'current' THEN p END) AS q
       FROM hist GROUP BY bin),
s1 AS (SELECT bin, (p + 1e-10) / sum(p + 1e-10) OVER () AS p, (q + 1e-10) / sum(q + 1e-10) OVER () AS q FROM pq),
s2 AS (SELECT *, (p + q) * 0.5 AS m FROM s1),
s3 AS (SELECT p, q, (p + 1e-10) / sum(p + 1e-10) OVER () AS p2, (q + 1e-10) / sum(q + 1e-10) OVER () AS q2,
              (m + 1e-10) / sum(m + 1e-10) OVER () AS m2 FROM s2),
dv AS (SELECT sum(p * (ln(p) - ln(q))) AS kl,
              sum(p2 * (ln(p2) - ln(m2))) * 0.5 + sum(q2 * (ln(q2) - ln(m2))) * 0.5 AS js FROM s3),
sz AS (SELECT count(*) FILTER (WHERE period = 'baseline') AS n_baseline,
              count(*) FILTER (WHERE period = 'current') AS n_current FROM w),
r AS (SELECT *, n_baseline >= 10 AND n_current >= 10 AS enough FROM sz CROSS JOIN dv)
"""


@query("kl_js_drift", KLJS_SQL + f"""
SELECT {AS_OF_SQL} AS as_of, n_baseline, n_current,
       CASE WHEN enough THEN kl END AS kl_divergence, CASE WHEN enough THEN js END AS js_divergence,
       coalesce(enough AND (kl > 0.15 OR js > 0.10), false) AS has_drift,
       CASE WHEN NOT enough THEN 'insufficient_data' WHEN kl > 0.15 THEN 'kl_divergence'
            WHEN js > 0.10 THEN 'js_divergence' ELSE 'none' END AS drift_reason
FROM r""")
def kl_js_drift(spark, d):
    """DR-2..DR-4: last 7 days vs the 7 days before (disjoint periods)."""
    return dr.prediction_drift(base.prediction_log(spark, d), AS_OF)


#: Injected drift: scores of the current week are pulled up.
SHIFTED_SQL = KLJS_SQL.replace("b AS (SELECT period,", "w2 AS (SELECT * REPLACE (CASE WHEN period = 'current' THEN least(fraud_score * 0.5 + 0.5, 1.0) ELSE fraud_score END AS fraud_score) FROM w),\nb AS (SELECT period,").replace(
    "AS bin FROM w)", "AS bin FROM w2)")


def shifted_log(spark, d):
    log = base.prediction_log(spark, d)
    late = F.col("ts") >= F.lit(AS_OF - dt.timedelta(days=7))
    return log.withColumn("fraud_score", F.when(late, F.least(F.col("fraud_score") * 0.5 + 0.5, F.lit(1.0))).otherwise(F.col("fraud_score")))


@query("drift_alert_rows", SHIFTED_SQL + f"""
SELECT {AS_OF_SQL} AS ts, 'concept_drift' AS drift_type, 'prediction_distribution' AS drift_metric,
       kl AS drift_score, CAST(0.15 AS DOUBLE) AS threshold, ['fraud_score'] AS affected_features, 'alert_sent' AS action_taken,
       false AS resolved
FROM r WHERE enough AND (kl > 0.15 OR js > 0.10)""")
def drift_alert_rows(spark, d):
    """DR-5 on a log whose last week has drifted."""
    return dr.drift_alerts(dr.prediction_drift(shifted_log(spark, d), AS_OF))


KS_COLS = ["claim_amount", "num_procedures", "days_in_hospital"]


@query("ks_feature_drift", SPLIT_W.rstrip("\n") + """,
lg AS (SELECT f.feature, f.value, CASE WHEN split = 'train' THEN 1 ELSE 2 END AS side
       FROM split CROSS JOIN LATERAL (VALUES ('claim_amount', CAST(claim_amount AS DOUBLE)),
                                             ('num_procedures', CAST(num_procedures AS DOUBLE)),
                                             ('days_in_hospital', CAST(days_in_hospital AS DOUBLE))) f(feature, value)
       WHERE split IN ('train', 'test')),
vc AS (SELECT feature, value, count(*) FILTER (WHERE side = 1) AS c1, count(*) FILTER (WHERE side = 2) AS c2
       FROM lg GROUP BY feature, value),
rt AS (SELECT *, sum(c1) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS k1,
                 sum(c2) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS k2,
                 sum(c1) OVER (PARTITION BY feature) AS n1, sum(c2) OVER (PARTITION BY feature) AS n2 FROM vc),
d AS (SELECT feature, n1, n2, max(abs(k1 / n1 - k2 / n2)) AS ks FROM rt GROUP BY feature, n1, n2)
SELECT feature, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, ks AS ks_statistic,
       CASE WHEN lam <= 0 THEN 1.0
            WHEN lam < 1.18 THEN least(greatest(1.0 - sqrt(2 * pi()) / lam * (
              SELECT sum(exp(-(2 * k - 1) * (2 * k - 1) * pi() * pi() / 8 / (lam * lam))) FROM range(1, 21) r(k)), 0.0), 1.0)
            ELSE least(greatest(2.0 * (SELECT sum(pow(-1.0, k - 1) * exp(-2.0 * k * k * lam * lam)) FROM range(1, 101) r(k)), 0.0), 1.0)
       END AS p_value
FROM (SELECT *, sqrt(n1 * n2 / (n1 + n2)) * ks AS lam FROM d) WHERE n1 > 5 AND n2 > 5""")
def ks_feature_drift(spark, d):
    """DR-6: train vs test claims per feature."""
    s = base.claims_split(spark, d)
    return dr.ks_statistics(s.where("split = 'train'"), s.where("split = 'test'"), KS_COLS)


PERIOD_METRICS_SQL = SCORED_W.rstrip("\n") + """,
st AS (SELECT split, fraud_score AS score, sum(fraud_label) AS pos, count(*) - sum(fraud_label) AS neg
       FROM scored WHERE split IN ('val', 'test') GROUP BY split, fraud_score),
c AS (SELECT *, sum(pos) OVER (PARTITION BY split ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS ctp,
                sum(neg) OVER (PARTITION BY split ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cfp FROM st),
auc AS (SELECT split, CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN NULL
                          ELSE sum(neg * (ctp - pos + pos / 2.0)) / (sum(pos) * sum(neg)) END AS roc_auc
        FROM c GROUP BY split),
cm AS (SELECT split, count(*) FILTER (WHERE fraud_label = 1 AND fraud_prediction) AS tp,
              count(*) FILTER (WHERE fraud_label = 0 AND fraud_prediction) AS fp,
              count(*) FILTER (WHERE fraud_label = 1 AND NOT fraud_prediction) AS fn,
              count(*) FILTER (WHERE fraud_label = 0 AND NOT fraud_prediction) AS tn
       FROM scored WHERE split IN ('val', 'test') GROUP BY split),
pm AS (SELECT split, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
              CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
              (tp + fp) / (tp + fp + fn + tn) AS fraud_rate, roc_auc
       FROM cm JOIN auc USING (split))
"""


def period_metrics(spark, d):
    s = base.scored(spark, d).where(F.col("split").isin("val", "test"))
    m = ev.binary_metrics(s, F.col("fraud_label"), F.col("fraud_prediction"), ["split"])
    a = ev.roc_auc(s, "fraud_label", "fraud_score", ["split"])
    return m.join(a, "split").select("split", "accuracy", "precision", "roc_auc",
                                     ((F.col("tp") + F.col("fp")) / (F.col("tp") + F.col("fp") + F.col("fn") +
                                                                      F.col("tn"))).alias("fraud_rate"))


@query("metric_drift_gate", PERIOD_METRICS_SQL + """
SELECT b.accuracy AS b_accuracy, b.roc_auc AS b_roc_auc, b.fraud_rate AS b_fraud_rate,
       c.accuracy AS c_accuracy, c.roc_auc AS c_roc_auc, c.fraud_rate AS c_fraud_rate,
       b.accuracy - c.accuracy AS accuracy_change, b.roc_auc - c.roc_auc AS auc_change,
       CASE WHEN b.fraud_rate > 0 THEN abs(c.fraud_rate - b.fraud_rate) / b.fraud_rate ELSE 0.0 END * 100
         AS fraud_rate_change_pct,
       CASE WHEN b.accuracy - c.accuracy > 0.02 THEN 'ALERT' ELSE 'OK' END AS accuracy_status,
       CASE WHEN b.roc_auc - c.roc_auc > 0.01 THEN 'ALERT' ELSE 'OK' END AS auc_status,
       CASE WHEN (CASE WHEN b.fraud_rate > 0 THEN abs(c.fraud_rate - b.fraud_rate) / b.fraud_rate ELSE 0.0 END) > 0.30
            THEN 'ALERT' ELSE 'OK' END AS fraud_rate_status,
       (b.accuracy - c.accuracy > 0.02) OR (b.roc_auc - c.roc_auc > 0.01)
         OR ((CASE WHEN b.fraud_rate > 0 THEN abs(c.fraud_rate - b.fraud_rate) / b.fraud_rate ELSE 0.0 END) > 0.30)
         AS overall_drift,
       CASE WHEN (b.accuracy - c.accuracy > 0.02) OR (b.roc_auc - c.roc_auc > 0.01)
         OR ((CASE WHEN b.fraud_rate > 0 THEN abs(c.fraud_rate - b.fraud_rate) / b.fraud_rate ELSE 0.0 END) > 0.30)
         THEN 'trigger_retraining' ELSE 'continue_monitoring' END AS recommendation
FROM (SELECT * FROM pm WHERE split = 'val') b CROSS JOIN (SELECT * FROM pm WHERE split = 'test') c""")
def metric_drift_gate(spark, d):
    """DR-7: validation period as baseline, test period as current."""
    pm = period_metrics(spark, d)
    return dr.metric_drift(pm.where("split = 'val'"), pm.where("split = 'test'"))


@query("validation_gate", PERIOD_METRICS_SQL.rstrip("\n") + """,
lat AS (SELECT avg(value) AS latency_ms FROM events)
SELECT split, accuracy, precision, roc_auc, fraud_rate, latency_ms,
       CASE WHEN coalesce(accuracy >= 0.94, false) THEN 'PASS' ELSE 'FAIL' END AS accuracy_check,
       CASE WHEN coalesce(roc_auc >= 0.99, false) THEN 'PASS' ELSE 'FAIL' END AS auc_check,
       CASE WHEN coalesce(precision >= 0.93, false) THEN 'PASS' ELSE 'FAIL' END AS precision_check,
       CASE WHEN coalesce(latency_ms <= 200.0, true) THEN 'PASS' ELSE 'FAIL' END AS latency_check,
       coalesce(accuracy >= 0.94, false) AND coalesce(roc_auc >= 0.99, false) AND coalesce(precision >= 0.93, false)
         AS passed,
       CASE WHEN NOT (coalesce(accuracy >= 0.94, false) AND coalesce(roc_auc >= 0.99, false)
                      AND coalesce(precision >= 0.93, false)) THEN 'low'
            WHEN NOT coalesce(latency_ms <= 200.0, true) THEN 'medium' ELSE 'high' END AS confidence
FROM pm CROSS JOIN lat""")
def validation_gate(spark, d):
    """DR-8 with the log's mean inference time as latency."""
    lat = base.prediction_log(spark, d).agg(F.avg("inference_time_ms").alias("latency_ms"))
    return dr.validate_metrics(period_metrics(spark, d).crossJoin(lat))


@query("op_counters_hourly", LOG_W + """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, model_version,
       CASE WHEN fraud_prediction THEN 'fraud' ELSE 'legitimate' END AS prediction_class, count(*) AS n
FROM log GROUP BY ALL""")
def op_counters_hourly(spark, d):
    """DR-10."""
    return dr.op_counters(base.prediction_log(spark, d))


def _hist_sql(col: str, bounds) -> str:
    parts = [f"SELECT '{float(b)}' AS le, count(*) FILTER (WHERE {col} <= {float(b)}) AS count FROM log"
             for b in bounds]
    parts.append(f"SELECT '+Inf', count({col}) FROM log")
    return LOG_W + f"SELECT le, count, (SELECT coalesce(sum({col}), 0.0) FROM log) AS sum FROM (" + \
        " UNION ALL ".join(parts) + ")"


@query("op_histogram_latency", _hist_sql("inference_time_ms", dr.LATENCY_BUCKETS))
def op_histogram_latency(spark, d):
    """DR-11 (latency buckets)."""
    return dr.op_histogram(base.prediction_log(spark, d), "inference_time_ms", dr.LATENCY_BUCKETS)


@query("op_histogram_score", _hist_sql("fraud_score", dr.SCORE_BUCKETS))
def op_histogram_score(spark, d):
    """DR-11 (score buckets)."""
    return dr.op_histogram(base.prediction_log(spark, d), "fraud_score", dr.SCORE_BUCKETS)


@query("op_gauges", LOG_W + f"""
SELECT avg(fraud_score) AS fraud_score_mean, stddev_samp(fraud_score) AS fraud_score_std,
       coalesce(avg(CASE WHEN ts >= {AS_OF_SQL} - INTERVAL 1 HOUR THEN CAST(fraud_prediction AS DOUBLE) END), 0.0)
         AS fraud_rate_last_hour,
       count(*) FILTER (WHERE ts >= {AS_OF_SQL} - INTERVAL 1 HOUR) AS predictions_last_hour
FROM log WHERE ts < {AS_OF_SQL}""")
def op_gauges(spark, d):
    """DR-12."""
    return dr.op_gauges(base.prediction_log(spark, d), AS_OF)


# ---------------------------------------------------------------- data quality
QCOLS = ["claim_amount", "num_procedures", "days_in_hospital"]

QPROFILE_SQL = with_(CLAIMS, SPLIT).rstrip("\n") + """,
lg AS (SELECT f.feature, f.value FROM train CROSS JOIN LATERAL (
         VALUES ('claim_amount', CAST(claim_amount AS DOUBLE)), ('num_procedures', CAST(num_procedures AS DOUBLE)),
                ('days_in_hospital', CAST(days_in_hospital AS DOUBLE))) f(feature, value) WHERE value IS NOT NULL),
rk AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS r,
              count(*) OVER (PARTITION BY feature) AS n FROM lg),
qp AS (SELECT feature, n, avg(value) AS mean, stddev_samp(value) AS stdev, min(value) AS min, max(value) AS max,
              max(CASE WHEN r = n // 4 THEN value END) AS q1, max(CASE WHEN r = n // 2 THEN value END) AS median,
              max(CASE WHEN r = (n * 3) // 4 THEN value END) AS q3
       FROM rk GROUP BY feature, n HAVING n >= 2)
"""


@query("quality_profile", QPROFILE_SQL + "SELECT *, q3 - q1 AS iqr FROM qp")
def quality_profile(spark, d):
    """DQ-1 + DQ-4 on training claims (k-th order statistics x[n//4], x[n//2], x[3n//4])."""
    return dq.fit_profile(base.train_rows(base.claims_split(spark, d)), QCOLS)


def _anomaly_sql(c: str) -> str:
    return f"""
    SELECT claim_id, 'zscore' AS method, '{c}' AS field, CAST({c} AS DOUBLE) AS value
    FROM split CROSS JOIN (SELECT * FROM qp WHERE feature = '{c}') p
    WHERE p.stdev > 0 AND abs(({c} - p.mean) / p.stdev) > 3.0
    UNION ALL
    SELECT claim_id, 'iqr', '{c}', CAST({c} AS DOUBLE)
    FROM split CROSS JOIN (SELECT * FROM qp WHERE feature = '{c}') p
    WHERE (p.q3 - p.q1) > 0 AND ({c} < p.q1 - 1.5 * (p.q3 - p.q1) OR {c} > p.q3 + 1.5 * (p.q3 - p.q1))"""


#: Injected dirt: every 23rd claim's amount and every 31st stay are far out.
OUTLIER_SQL = QPROFILE_SQL.rstrip("\n") + """,
odd AS (SELECT claim_id, CASE WHEN claim_id % 23 = 0 THEN claim_amount * 9 ELSE claim_amount END AS claim_amount, num_procedures,
               CASE WHEN claim_id % 31 = 0 THEN days_in_hospital + 40 ELSE days_in_hospital END AS days_in_hospital FROM split)
"""


def with_outliers(df):
    k = F.col("claim_id")
    return df.withColumns({"claim_amount": F.when(F.pmod(k, F.lit(23)) == 0, F.col("claim_amount") * 9).otherwise(F.col("claim_amount")),
                           "days_in_hospital": F.when(F.pmod(k, F.lit(31)) == 0, F.col("days_in_hospital") + 40).otherwise(F.col("days_in_hospital"))})


@query("zscore_iqr_outliers", OUTLIER_SQL + " UNION ALL ".join(_anomaly_sql(c) for c in QCOLS).replace("FROM split CROSS", "FROM odd CROSS"))
def zscore_iqr_outliers(spark, d):
    """DQ-2 + DQ-3: anomaly alerts of every claim (with injected outliers) against the clean training profile."""
    clean = base.claims_split(spark, d)
    prof = dq.fit_profile(base.train_rows(clean), QCOLS)
    s = with_outliers(clean)
    a = dq.attach_profile(s, prof, QCOLS).select("claim_id", F.explode(F.array_compact(
        dq.anomaly_alerts(s, prof, QCOLS))).alias("a"))
    return a.select("claim_id", F.when(F.col("a.message").startswith("Z-score"), F.lit("zscore"))
                    .otherwise(F.lit("iqr")).alias("method"), F.col("a.field").alias("field"),
                    F.col("a.value").alias("value"))


EV_BASE = """
ev AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS stdev FROM events GROUP BY event_type),
rl AS (SELECT event_id, event_type, ts, value,
              count(value) OVER w AS roll_n, avg(value) OVER w AS roll_mean, stddev_samp(value) OVER w AS roll_std
       FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
"""


@query("rolling_drift_alerts", "WITH " + EV_BASE + """
SELECT event_id, event_type, roll_n, roll_mean, roll_std,
       CASE WHEN roll_n >= 20 AND mean <> 0 THEN abs(roll_mean - mean) / abs(mean) END AS mean_shift,
       CASE WHEN roll_n >= 20 AND stdev > 0 AND roll_std > 0 THEN abs(roll_std - stdev) / stdev END AS stdev_shift,
       coalesce(CASE WHEN roll_n >= 20 AND mean <> 0 THEN abs(roll_mean - mean) / abs(mean) END > 0.2, false)
         AS mean_alert,
       coalesce(CASE WHEN roll_n >= 20 AND stdev > 0 AND roll_std > 0 THEN abs(roll_std - stdev) / stdev END > 0.2,
                false) AS stdev_alert
FROM rl JOIN ev USING (event_type)""")
def rolling_drift_alerts(spark, d):
    """DQ-5 + WN-2: last-20 mean/stdev per event stream vs the stream's baseline."""
    e = base.read(spark, d, "events")
    prof = e.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("stdev"))
    r = dq.rolling_drift(e.select("event_id", "event_type", "ts", "value"), prof, "event_type",
                         ["ts", "event_id"], "value")
    return r.select("event_id", "event_type", "roll_n", "roll_mean", "roll_std", "mean_shift", "stdev_shift",
                    "mean_alert", "stdev_alert")


# constraint set of the quality check (amount bounds, required fields, allowed tiers)
CONSTRAINTS = [
    dq.Constraint("claim_amount", min=0.0, max=100000.0, required=True),
    dq.Constraint("num_procedures", min=1.0, max=50.0, required=True),
    dq.Constraint("insurance_type", required=True),
]

QCHECK_SQL = QPROFILE_SQL.rstrip("\n") + """,
cats AS (SELECT list(DISTINCT insurance_type ORDER BY insurance_type) AS allowed FROM train),
dirty AS (SELECT claim_id, claim_date,
                 CASE WHEN claim_id % 29 = 0 THEN NULL WHEN claim_id % 31 = 0 THEN -claim_amount ELSE claim_amount END
                   AS claim_amount,
                 num_procedures, days_in_hospital,
                 CASE WHEN claim_id % 37 = 0 THEN 'X-UNKNOWN' ELSE insurance_type END AS insurance_type
          FROM split),
al0 AS (
  SELECT d.claim_id, d.claim_date,
    (CASE WHEN d.claim_amount IS NULL THEN 1 ELSE 0 END) AS crit,
    (CASE WHEN d.claim_amount < 0.0 THEN 1 ELSE 0 END) + (CASE WHEN d.claim_amount > 100000.0 THEN 1 ELSE 0 END)
    + (CASE WHEN p1.stdev > 0 AND abs((d.claim_amount - p1.mean) / p1.stdev) > 3.0 THEN 1 ELSE 0 END)
    + (CASE WHEN p1.q3 - p1.q1 > 0 AND (d.claim_amount < p1.q1 - 1.5 * (p1.q3 - p1.q1)
                                      OR d.claim_amount > p1.q3 + 1.5 * (p1.q3 - p1.q1)) THEN 1 ELSE 0 END) AS f_claim_amount,
    (CASE WHEN d.num_procedures < 1.0 THEN 1 ELSE 0 END) + (CASE WHEN d.num_procedures > 50.0 THEN 1 ELSE 0 END)
    + (CASE WHEN p2.stdev > 0 AND abs((d.num_procedures - p2.mean) / p2.stdev) > 3.0 THEN 1 ELSE 0 END)
    + (CASE WHEN p2.q3 - p2.q1 > 0 AND (d.num_procedures < p2.q1 - 1.5 * (p2.q3 - p2.q1)
                                      OR d.num_procedures > p2.q3 + 1.5 * (p2.q3 - p2.q1)) THEN 1 ELSE 0 END) AS f_num_procedures,
    (CASE WHEN p3.stdev > 0 AND abs((d.days_in_hospital - p3.mean) / p3.stdev) > 3.0 THEN 1 ELSE 0 END)
    + (CASE WHEN p3.q3 - p3.q1 > 0 AND (d.days_in_hospital < p3.q1 - 1.5 * (p3.q3 - p3.q1)
                                      OR d.days_in_hospital > p3.q3 + 1.5 * (p3.q3 - p3.q1)) THEN 1 ELSE 0 END) AS f_days_in_hospital,
    (CASE WHEN NOT list_contains(cats.allowed, d.insurance_type) THEN 1 ELSE 0 END) AS f_insurance_type
  FROM dirty d CROSS JOIN cats
  CROSS JOIN (SELECT * FROM qp WHERE feature = 'claim_amount') p1
  CROSS JOIN (SELECT * FROM qp WHERE feature = 'num_procedures') p2
  CROSS JOIN (SELECT * FROM qp WHERE feature = 'days_in_hospital') p3),
al AS (SELECT *, f_claim_amount + f_num_procedures + f_days_in_hospital + f_insurance_type AS warn FROM al0),
fields AS (SELECT * FROM (SELECT sum(crit + f_claim_amount) AS claim_amount, sum(f_num_procedures) AS num_procedures,
                                 sum(f_days_in_hospital) AS days_in_hospital, sum(f_insurance_type) AS insurance_type FROM al)
           UNPIVOT (n FOR field IN (claim_amount, num_procedures, days_in_hospital, insurance_type))),
qs AS (SELECT *, least(greatest(100 - 20 * crit - 5 * warn, 0), 100) AS quality_score FROM al)
"""


def quality_checked(spark, d):
    s = base.claims_split(spark, d)
    tr = base.train_rows(s)
    prof = dq.fit_profile(tr, QCOLS)
    cats = dq.learn_categories(tr, "insurance_type")
    cid = F.col("claim_id")
    dirty = s.select(
        F.col("claim_id").alias("record_id"), "claim_id", F.col("claim_date").alias("ts"),
        F.when(F.pmod(cid, F.lit(29)) == 0, F.lit(None)).when(F.pmod(cid, F.lit(31)) == 0, -F.col("claim_amount"))
         .otherwise(F.col("claim_amount")).alias("claim_amount"),
        "num_procedures", "days_in_hospital",
        F.when(F.pmod(cid, F.lit(37)) == 0, F.lit("X-UNKNOWN")).otherwise(F.col("insurance_type"))
         .alias("insurance_type"))
    dirty = dq.mark_allowed(dq.attach_profile(dirty, prof, QCOLS), "insurance_type", cats)
    return dq.with_quality(dirty, dq.constraint_alerts(CONSTRAINTS, {"insurance_type": "insurance_type__allowed"}),
                           dq.anomaly_alerts(dirty, prof, QCOLS))


@query("quality_scores", QCHECK_SQL + """
SELECT claim_id, quality_score, crit AS critical_alerts, warn AS warning_alerts FROM qs""")
def quality_scores(spark, d):
    """DQ-6..DQ-9 per claim (deterministic injected errors)."""
    return quality_checked(spark, d).select("claim_id", "quality_score", "critical_alerts", "warning_alerts")


@query("quality_score_summary", QCHECK_SQL + """
SELECT count(*) AS total_records_checked, coalesce(avg(quality_score), 100.0) AS avg_quality_score,
       CAST(sum(crit) AS BIGINT) AS critical_count, CAST(sum(warn) AS BIGINT) AS warning_count,
       (SELECT avg(quality_score) FROM (SELECT quality_score FROM qs ORDER BY claim_date DESC, claim_id DESC LIMIT 100))
         AS recent_avg_score,
       CASE WHEN (SELECT avg(quality_score) FROM (SELECT quality_score FROM qs ORDER BY claim_date DESC, claim_id DESC
                                                LIMIT 100)) >= 90 THEN 'stable'
            WHEN (SELECT avg(quality_score) FROM (SELECT quality_score FROM qs ORDER BY claim_date DESC, claim_id DESC
                                                LIMIT 100)) >= 70 THEN 'watch' ELSE 'degrading' END AS quality_trend,
       CASE WHEN avg(quality_score) >= 90 THEN 'A' WHEN avg(quality_score) >= 80 THEN 'B'
            WHEN avg(quality_score) >= 70 THEN 'C' ELSE 'D' END AS grade,
       (SELECT list(field ORDER BY n DESC, field) FROM (SELECT * FROM fields WHERE n > 0 ORDER BY n DESC, field LIMIT 5)) AS top_issue_fields
FROM qs""")
def quality_score_summary(spark, d):
    """DQ-10 + DQ-12 (no 100-row cap on the batch; recent = newest 100)."""
    return dq.quality_summary(quality_checked(spark, d))


@query("table_expectations", with_(CLAIMS) + """
SELECT count(*) AS n_rows, count(DISTINCT claim_id) AS n_distinct_ids,
       count(*) FILTER (WHERE claim_id IS NULL) AS null_ids,
       count(*) FILTER (WHERE fraud_label NOT IN (0, 1)) AS bad_labels,
       avg(CAST(fraud_label AS DOUBLE)) AS label_rate,
       (SELECT count(*) FROM claims WHERE patient_id NOT IN (SELECT c_custkey FROM customer)) AS fk_orphans,
       count(*) = count(DISTINCT claim_id) AND count(*) FILTER (WHERE claim_id IS NULL) = 0
         AND (SELECT count(*) FROM claims WHERE patient_id NOT IN (SELECT c_custkey FROM customer)) = 0
         AND count(*) FILTER (WHERE fraud_label NOT IN (0, 1)) = 0
         AND avg(CAST(fraud_label AS DOUBLE)) BETWEEN 0.07 AND 0.40 AS passed
FROM claims""")
def table_expectations(spark, d):
    """DQ-13 (label-rate bound widened to the fixture's ~1/3 fraud rate)."""
    c = base.claims(spark, d)
    p = base.read(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"))
    return dq.check_tables(c, p, rate_bounds=(0.07, 0.40))
