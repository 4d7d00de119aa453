"""Scoring operators: percentile rules, hybrid blend, heuristic model, summaries (ML-6..12, AG-17..19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.tiers import clip, risk_tier

# Rule weights of the percentile rule score.
#   amount  > 3*p99 +0.60 | > p99 +0.45 | > p95 +0.28 | > p75 +0.10
#   procedures > 1.5*p95 +0.20 | > p95 +0.12
#   days       > 1.5*p95 +0.18 | > p95 +0.10
#   all three above their p95: +0.15 ; total capped at 0.90
# Hybrid blend: clip(0.65*ml + 0.35*rule + 0.15*ml*rule, 0.01, 0.99); flagged when > 0.5.
# Fallback heuristic: min(amount / 50000, 1); upload variant min(amount / 40000, 0.99).
DEFAULT_PROFILE = {"mean_claim": 2800.0, "p50_claim": 1800.0, "p75_claim": 5000.0, "p95_claim": 12000.0,
                   "p99_claim": 28000.0, "p95_procedures": 12.0, "p95_days": 18.0}


def rule_score_expr(amount: Column, procedures: Column, days: Column, p75: Column, p95: Column,
                    p99: Column, p95_proc: Column, p95_days: Column) -> Column:
    amt = (F.when(amount > p99 * 3, 0.60).when(amount > p99, 0.45)
            .when(amount > p95, 0.28).when(amount > p75, 0.10).otherwise(0.0))
    proc = F.when(procedures > p95_proc * 1.5, 0.20).when(procedures > p95_proc, 0.12).otherwise(0.0)
    stay = F.when(days > p95_days * 1.5, 0.18).when(days > p95_days, 0.10).otherwise(0.0)
    combo = F.when((amount > p95) & (procedures > p95_proc) & (days > p95_days), 0.15).otherwise(0.0)
    return F.least(amt + proc + stay + combo, F.lit(0.90))


def rule_score(df: DataFrame, profile: DataFrame) -> DataFrame:
    """ML-7: add ``rule_score`` from a one-row profile (broadcast)."""
    p = profile.select("p75_claim", "p95_claim", "p99_claim", "p95_procedures", "p95_days")
    out = df.crossJoin(F.broadcast(p))
    amount = F.coalesce(F.col("claim_amount").cast("double"), F.lit(0.0))
    procedures = F.coalesce(F.col("num_procedures"), F.lit(1))
    days = F.coalesce(F.col("days_in_hospital"), F.lit(0))
    s = rule_score_expr(amount, procedures, days, F.col("p75_claim"), F.col("p95_claim"), F.col("p99_claim"),
                        F.col("p95_procedures"), F.col("p95_days"))
    return out.withColumn("rule_score", s).drop("p75_claim", "p95_claim", "p99_claim", "p95_procedures",
                                                 "p95_days")


def heuristic_score(amount: Column, scale: float = 50_000.0, cap: float = 1.0) -> Column:
    """ML-9: model-free fallback score."""
    return F.least(amount / F.lit(scale), F.lit(cap))


def hybrid_score(ml: Column, rule: Column) -> Column:
    """ML-6."""
    return clip(ml * 0.65 + rule * 0.35 + ml * rule * 0.15, 0.01, 0.99)


def score_claims(df: DataFrame, profile: DataFrame, ml_col: str | None = None,
                 threshold: float = 0.5) -> DataFrame:
    """ML-10 (table form): rule score, model score (``ml_col`` or the heuristic),
    blended ``fraud_score``, ``fraud_prediction`` and ``risk_level``.
    Rows never raise: an unusable amount gets the ML-12 default row values.
    """
    out = rule_score(df, profile)
    ml = F.col(ml_col) if ml_col else heuristic_score(F.col("claim_amount"))
    fs = hybrid_score(ml, F.col("rule_score"))
    bad = F.col("claim_amount").isNull() | F.isnan(F.col("claim_amount"))
    return out.withColumn("ml_score", ml) \
              .withColumn("fraud_score", F.when(bad, F.lit(0.5)).otherwise(fs)) \
              .withColumn("fraud_prediction", F.col("fraud_score") > F.lit(threshold)) \
              .withColumn("risk_level", F.when(bad, F.lit("MEDIUM")).otherwise(risk_tier(F.col("fraud_score")))) \
              .withColumn("status", F.when(bad, F.lit("error")).otherwise(F.lit("ok")))


def scoring_summary(scored: DataFrame, score_col: str = "fraud_score", threshold: float = 0.5) -> DataFrame:
    """AG-17: bulk-upload summary (flag at ``>= threshold``, as the upload path does)."""
    flagged = F.col(score_col) >= F.lit(threshold)
    return scored.agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.count_if(flagged).alias("fraud_flagged"),
        F.coalesce(F.avg(flagged.cast("double")), F.lit(0.0)).alias("fraud_rate"),
        F.count_if(risk_tier(F.col(score_col)) == "HIGH").alias("high_risk"),
        F.coalesce(F.sum("claim_amount"), F.lit(0.0)).alias("total_amount"),
        F.coalesce(F.sum(F.when(flagged, F.col("claim_amount"))), F.lit(0.0)).alias("flagged_amount"))


def prediction_summary(log: DataFrame) -> DataFrame:
    """AG-19: counts, mean score, rate and mean latency; empty input -> zeros."""
    fraud = F.col("fraud_prediction")
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(fraud).alias("fraud_count"),
        F.count_if(~fraud).alias("legitimate_count"),
        F.coalesce(F.avg("fraud_score"), F.lit(0.0)).alias("avg_fraud_score"),
        F.coalesce(F.avg(fraud.cast("double")), F.lit(0.0)).alias("fraud_rate"),
        F.coalesce(F.avg("inference_time_ms"), F.lit(0.0)).alias("avg_inference_time_ms"))


def feed_summary(batch: DataFrame) -> DataFrame:
    """AG-22: live-feed tiles -- count, flagged, max score."""
    return batch.agg(F.count(F.lit(1)).alias("n"), F.count_if("fraud_prediction").alias("flagged"),
                     F.max("fraud_score").alias("max_score"))
