"""Encoding, alerting and prediction-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.tiers import alert_action, alert_level
from riskloom.operators import clean
from riskloom.operators.encode import apply_labels, apply_scaler, fit_labels, fit_scaler
from riskloom.operators.features import CATEGORICALS
from riskloom.operators.scoring import prediction_summary as prediction_summary_op
from riskloom.operators.ttl import mark_scored
from riskloom.plans import base
from riskloom.plans.q_core import FEATURES_SQL
from riskloom.plans.registry import query
from riskloom.plans.sql_base import LOG_W, SCORED_W, CLAIMS_W

CAT_SQL = ", ".join(CATEGORICALS)


@query("label_dictionary_apply", FEATURES_SQL.rstrip("\n") + ",\n" + ",\n".join(
    f"d_{c} AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM "
    f"(SELECT DISTINCT CAST({c} AS VARCHAR) AS value FROM f WHERE split = 'train' AND {c} IS NOT NULL))"
    for c in CATEGORICALS) + "\nSELECT claim_id, " + ", ".join(
    f"CAST(coalesce(d_{c}.code, 0) AS BIGINT) AS {c}" for c in CATEGORICALS) + " FROM f " + " ".join(
    f"LEFT JOIN d_{c} ON d_{c}.value = CAST(f.{c} AS VARCHAR)" for c in CATEGORICALS))
def label_dictionary_apply(spark, d):
    """EN-1 + EN-2 + JN-8: train-fitted dictionaries applied to every split (unseen -> 0)."""
    f = base.features(spark, d)
    dic = fit_labels(f.where("split = 'train'"), CATEGORICALS)
    return apply_labels(f.select("claim_id", *CATEGORICALS), dic, CATEGORICALS)


SCALE_COLS = ["claim_amount", "num_procedures", "days_in_hospital", "patient_avg_amount", "doctor_avg_amount",
              "amount_vs_patient_avg"]


@query("standardised_features", FEATURES_SQL.rstrip("\n") + """,
ff AS (SELECT *, claim_amount / (patient_avg_amount + 1) AS amount_vs_patient_avg FROM f),
sc AS (SELECT """ + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}"
                              for c in SCALE_COLS) + """ FROM ff WHERE split = 'train')
SELECT claim_id, """ + ", ".join(
    f"(CAST({c} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END AS {c}"
    for c in SCALE_COLS) + " FROM ff CROSS JOIN sc")
def standardised_features(spark, d):
    """EN-3: train mean / population std applied to every split."""
    f = base.features(spark, d).select("claim_id", "split", *SCALE_COLS)
    sc = fit_scaler(f.where("split = 'train'"), SCALE_COLS)
    return apply_scaler(f, sc, SCALE_COLS).drop("split")


@query("alert_actions", SCORED_W + """
SELECT claim_id, fraud_score AS fraud_probability,
       CASE WHEN fraud_score >= 0.75 THEN 'HIGH' WHEN fraud_score >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
       CASE WHEN fraud_score >= 0.75 THEN 'BLOCK_AND_REVIEW' WHEN fraud_score >= 0.45 THEN 'MANUAL_REVIEW'
            ELSE 'AUTO_APPROVE' END AS recommended_action
FROM scored WHERE fraud_score >= 0.45""")
def alert_actions(spark, d):
    """FN-7: alert level and action; only HIGH and MEDIUM alerts are logged."""
    s = base.scored(spark, d)
    p = F.col("fraud_score")
    return s.where(alert_level(p) != "LOW").select("claim_id", p.alias("fraud_probability"),
                                                   alert_level(p).alias("risk_level"),
                                                   alert_action(p).alias("recommended_action"))


@query("latest_alerts", SCORED_W + """
SELECT claim_id, claim_date, fraud_score FROM scored WHERE fraud_score >= 0.45
ORDER BY claim_date DESC, claim_id DESC LIMIT 50""")
def latest_alerts(spark, d):
    """SL-2 / SO-13: newest 50 logged alerts (top-k by date, TakeOrderedAndProject)."""
    s = base.scored(spark, d).where(F.col("fraud_score") >= 0.45)
    return s.orderBy(F.col("claim_date").desc(), F.col("claim_id").desc()).limit(50) \
            .select("claim_id", "claim_date", "fraud_score")


@query("prediction_summary", LOG_W + """
SELECT count(*) AS total, count(*) FILTER (WHERE fraud_prediction) AS fraud_count,
       count(*) FILTER (WHERE NOT fraud_prediction) AS legitimate_count,
       coalesce(avg(fraud_score), 0.0) AS avg_fraud_score,
       coalesce(avg(CAST(fraud_prediction AS DOUBLE)), 0.0) AS fraud_rate,
       coalesce(avg(inference_time_ms), 0.0) AS avg_inference_time_ms FROM log""")
def prediction_summary(spark, d):
    """AG-19 over the prediction log."""
    return prediction_summary_op(base.prediction_log(spark, d))


TTL_CTE = LOG_W.rstrip("\n").replace("WITH", "WITH RECURSIVE", 1) + """,
k AS (SELECT prediction_id, ts, md5(concat_ws('|', CAST(user_id AS VARCHAR), model_version)) AS request_key FROM log),
o AS (SELECT *, row_number() OVER (PARTITION BY request_key ORDER BY ts, prediction_id) AS r FROM k),
walk AS (SELECT request_key, r, prediction_id, ts, ts AS scored_at, true AS is_new FROM o WHERE r = 1
  UNION ALL
  SELECT o.request_key, o.r, o.prediction_id, o.ts,
         CASE WHEN o.ts > w.scored_at + INTERVAL 600 SECOND THEN o.ts ELSE w.scored_at END,
         o.ts > w.scored_at + INTERVAL 600 SECOND
  FROM walk w JOIN o ON o.request_key = w.request_key AND o.r = w.r + 1)
"""


def request_log(spark, d):
    log = base.prediction_log(spark, d)
    return log.select("prediction_id", "ts",
                      F.md5(F.concat_ws("|", F.col("user_id").cast("string"), F.col("model_version"))).alias("request_key"))


@query("score_new_only", TTL_CTE + "SELECT prediction_id, request_key, is_new FROM walk")
def score_new_only(spark, d):
    """ML-11 + FN-10: a request is scored unless its key was scored at most 600 s
    ago (the entry's creation counts; a hit does not renew it)."""
    return mark_scored(request_log(spark, d), "request_key", "ts", "prediction_id").select("prediction_id", "request_key", "is_new")


@query("score_new_only_steady", TTL_CTE.replace("concat_ws('|', CAST(user_id AS VARCHAR), model_version)", "model_version")
       + "SELECT prediction_id, request_key, is_new FROM walk")
def score_new_only_steady(spark, d):
    """ML-11 on five keys with steady traffic: long chains in bursts without a pause."""
    log = base.prediction_log(spark, d).select("prediction_id", "ts", F.md5("model_version").alias("request_key"))
    return mark_scored(log, "request_key", "ts", "prediction_id").select("prediction_id", "request_key", "is_new")


# mapping between the claim layout and the request layout (PR-24) and request defaults (PR-22)
SCHEMA_MAP = {"claim_amount": "amount", "num_procedures": "procedures", "days_in_hospital": "stay_days"}
DEFAULTS = {"amount": 0.0, "procedures": 1, "stay_days": 0, "insurance_type": "Unknown"}


@query("schema_map_and_defaults", CLAIMS_W + """
SELECT claim_id, coalesce(CASE WHEN claim_id % 7 = 0 THEN NULL ELSE claim_amount END, 0.0) AS amount,
       coalesce(CASE WHEN claim_id % 11 = 0 THEN NULL ELSE num_procedures END, 1) AS procedures,
       coalesce(days_in_hospital, 0) AS stay_days,
       coalesce(CASE WHEN claim_id % 5 = 0 THEN NULL ELSE insurance_type END, 'Unknown') AS insurance_type,
       CAST(0.0 AS DOUBLE) AS age
FROM claims""")
def schema_map_and_defaults(spark, d):
    """PR-22 + PR-23 + PR-24: rename to the request layout, fill defaults, align
    to a feature list (absent -> 0)."""
    c = base.claims(spark, d)
    dirty = c.select("claim_id", clean.with_nulls("claim_amount", F.col("claim_id"), 7).alias("claim_amount"),
                     clean.with_nulls("num_procedures", F.col("claim_id"), 11).alias("num_procedures"),
                     "days_in_hospital", clean.with_nulls("insurance_type", F.col("claim_id"), 5).alias("insurance_type"))
    m = clean.fill_defaults(clean.map_schema(dirty, SCHEMA_MAP), DEFAULTS)
    a = clean.align_features(m, ["age"], keep=["claim_id", "amount", "procedures", "stay_days", "insurance_type"])
    return a
