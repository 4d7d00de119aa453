"""The batch scoring job over dirty claims, run and run again (ML-10, ML-12, PR-21, AG-18)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from riskloom.operators import batchjob as bj
from riskloom.plans import base
from riskloom.plans.registry import query
from riskloom.plans.sql_base import CLAIMS, PROFILE, SCORED, SPLIT, with_
from riskloom.session import derived_path

_LOGS: dict = {}
BATCHES = 3
DAY = dt.date(2024, 1, 31)


def dirty_claims(spark, d):
    """Claims of which some have no amount, one that is no number, or values out of range."""
    c = base.claims_split(spark, d)
    key = lambda n: F.pmod("claim_id", F.lit(n)) == 0
    amount = F.when(key(19), F.lit(None)).when(key(23), F.lit(float("nan"))).when(key(11), F.col("claim_amount") * 200).otherwise(F.col("claim_amount"))
    return c.withColumns({"claim_amount": amount, "num_procedures": F.when(key(13), F.col("num_procedures") + 100).otherwise(F.col("num_procedures")),
                          "days_in_hospital": F.when(key(17), -F.col("days_in_hospital") - 1).otherwise(F.col("days_in_hospital"))})


def logged(spark, d) -> str:
    """The log after three batches, the second of which is run twice."""
    key = (spark.sparkContext.applicationId, d.rstrip("/"))
    if key not in _LOGS:
        path, claims = derived_path(spark), dirty_claims(spark, d)
        for batch in (0, 1, 2, 1):
            bj.run_batch(claims.where(F.pmod(F.floor(F.col("claim_id") / 8), F.lit(BATCHES)) == batch), base.profile(spark, d), path, DAY + dt.timedelta(days=batch), batch)
        _LOGS[key] = path
    return _LOGS[key]


DIRTY = """
dirty AS (
  SELECT * REPLACE (
    CASE WHEN claim_id % 19 = 0 THEN NULL WHEN claim_id % 23 = 0 THEN 'nan'::DOUBLE WHEN claim_id % 11 = 0 THEN claim_amount * 200 ELSE claim_amount END AS claim_amount,
    CASE WHEN claim_id % 13 = 0 THEN num_procedures + 100 ELSE num_procedures END AS num_procedures,
    CASE WHEN claim_id % 17 = 0 THEN -days_in_hospital - 1 ELSE days_in_hospital END AS days_in_hospital) FROM split)"""
JOB_SQL = with_(CLAIMS, SPLIT, PROFILE, DIRTY, SCORED.replace("FROM split s", "FROM dirty s")).rstrip("\n") + """,
checked AS (SELECT *, claim_amount IS NOT NULL AND NOT isnan(claim_amount) AND claim_amount BETWEEN 0 AND 10000000 AND num_procedures BETWEEN 0 AND 100
    AND days_in_hospital BETWEEN 0 AND 365 AS ok FROM scored),
job AS (SELECT claim_id, CAST(DATE '2024-01-31' + CAST(claim_id // 8 % 3 AS INTEGER) AS DATE) AS day, CAST(claim_id // 8 % 3 AS INTEGER) AS batch_id, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status,
    CASE WHEN ok THEN fraud_score ELSE 0.5 END AS fraud_score, ok AND fraud_prediction AS fraud_prediction,
    CASE WHEN ok THEN risk_level ELSE 'MEDIUM' END AS risk_level, CASE WHEN ok THEN 'hybrid' ELSE 'error' END AS model_used FROM checked)
"""


@query("batch_job_log", JOB_SQL + "SELECT * FROM job")
def batch_job_log(spark, d):
    """ML-10 + ML-12: every claim of the batches once, with score or error."""
    return bj.read_log(spark, logged(spark, d)).select("claim_id", "day", "batch_id", "status", "fraud_score", "fraud_prediction", "risk_level", "model_used")


@query("batch_job_summary", JOB_SQL + """SELECT batch_id, count(*) AS total_processed, count(*) FILTER (WHERE status = 'ok') AS successful, count(*) FILTER (WHERE status <> 'ok') AS failed,
  avg(fraud_score) FILTER (WHERE status = 'ok') AS avg_fraud_score, count(*) FILTER (WHERE status = 'ok' AND fraud_prediction) AS fraud_detected FROM job GROUP BY batch_id""")
def batch_job_summary(spark, d):
    """AG-18: the response of each batch."""
    return bj.batch_summaries(bj.read_log(spark, logged(spark, d)))


@query("batch_job_rejected", JOB_SQL + """SELECT 'rejected' AS status, count(*) AS n, 'batch: too many claims' AS error FROM job""")
def batch_job_rejected(spark, d):
    """PR-21: a batch above its cap is refused as a whole, and every claim of it is accounted for."""
    out = bj.score_batch(dirty_claims(spark, d), base.profile(spark, d), most=1000)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min(F.element_at("errors", 1)).alias("error"))
