"""The batch scoring job (ML-10, ML-12, PR-20, PR-21, AG-18).

A batch of claims is validated, scored and written to the prediction log, one row per
claim: claims that cannot be scored become error rows with the default score, so no
claim is lost.  The log is partitioned by the day of scoring and the batch, and a run replaces
its own partition only: running a batch again leaves the log as it was.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.clean import validate_claims
from riskloom.operators.scoring import score_claims

LOG_COLUMNS = ["claim_id", "claim_amount", "status", "errors", "ml_score", "rule_score", "fraud_score", "fraud_prediction", "risk_level", "model_used"]


def score_batch(claims: DataFrame, profile: DataFrame, ml_col: str | None = None, most: int | None = None) -> DataFrame:
    """Every claim with ``status`` (ok, error, rejected) and its ``errors``.

    An invalid claim (see ``validate_claims``) is an error row: score 0.5, MEDIUM, not flagged, no model or rule score.  If the
    batch has more than ``most`` claims, all of it is rejected, row by row."""
    checked = validate_claims(claims)
    if most is not None:
        size = claims.agg(F.count(F.lit(1)).alias("batch_n"))
        checked = checked.crossJoin(F.broadcast(size)).withColumn("rejected", F.col("batch_n") > most).drop("batch_n")
    else:
        checked = checked.withColumn("rejected", F.lit(False))
    scored = score_claims(checked, profile, ml_col)
    fine = F.col("is_valid") & ~F.col("rejected") & (F.col("status") == "ok")
    status = F.when(F.col("rejected"), "rejected").when(fine, "ok").otherwise("error")
    errors = F.when(F.col("rejected"), F.array(F.lit("batch: too many claims"))).otherwise(F.col("errors"))
    only = lambda c: F.when(fine, F.col(c))
    return scored.withColumns({
        "errors": errors, "ml_score": only("ml_score"), "rule_score": only("rule_score"),
        "fraud_score": F.coalesce(only("fraud_score"), F.lit(0.5)), "fraud_prediction": F.coalesce(only("fraud_prediction"), F.lit(False)),
        "risk_level": F.coalesce(only("risk_level"), F.lit("MEDIUM")), "model_used": F.when(fine, F.lit("hybrid")).otherwise(F.lit("error")), "status": status})


def run_batch(claims: DataFrame, profile: DataFrame, path: str, day: dt.date, batch_id: int, ml_col: str | None = None, most: int | None = None) -> None:
    """Score a batch and write it into the log at ``path`` under ``day=.../batch_id=...``, replacing what an
    earlier run of the batch has written there."""
    rows = score_batch(claims, profile, ml_col, most).withColumns({"day": F.lit(day), "batch_id": F.lit(batch_id)})
    rows.select(*LOG_COLUMNS, "day", "batch_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def batch_summaries(log: DataFrame) -> DataFrame:
    """AG-18 per batch of the log."""
    ok = F.col("status") == "ok"
    return log.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total_processed"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"),
        F.avg(F.when(ok, F.col("fraud_score"))).alias("avg_fraud_score"), F.count_if(ok & F.col("fraud_prediction")).alias("fraud_detected"))
