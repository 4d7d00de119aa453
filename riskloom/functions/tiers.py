"""Column -> Column classification helpers (FN-6 .. FN-9, FN-12, FN-13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (reference thresholds and labels):
#   risk tier      score > 0.7 HIGH, score > 0.4 MEDIUM, else LOW
#   alert action   score >= 0.75 HIGH / BLOCK_AND_REVIEW,
#                  score >= 0.45 MEDIUM / MANUAL_REVIEW, else LOW / AUTO_APPROVE
#   quality grade  >= 90 A, >= 80 B, >= 70 C, else D
#   quality trend  avg >= 90 stable, >= 70 watch, else degrading
RISK_HIGH, RISK_MEDIUM = 0.7, 0.4
ALERT_HIGH, ALERT_MEDIUM = 0.75, 0.45


def risk_tier(score: Column, high: float = RISK_HIGH, medium: float = RISK_MEDIUM) -> Column:
    """FN-6: strict edges."""
    return (F.when(score > F.lit(high), F.lit("HIGH"))
             .when(score > F.lit(medium), F.lit("MEDIUM"))
             .otherwise(F.lit("LOW")))


def risk_tier_inclusive(score: Column, high: float = RISK_HIGH, medium: float = RISK_MEDIUM) -> Column:
    """Explanation-summary variant: HIGH above ``high``, MEDIUM on [medium, high]."""
    return (F.when(score > F.lit(high), F.lit("HIGH"))
             .when(score >= F.lit(medium), F.lit("MEDIUM"))
             .otherwise(F.lit("LOW")))


def alert_level(score: Column, high: float = ALERT_HIGH, medium: float = ALERT_MEDIUM) -> Column:
    """FN-7 level: inclusive edges."""
    return (F.when(score >= F.lit(high), F.lit("HIGH"))
             .when(score >= F.lit(medium), F.lit("MEDIUM"))
             .otherwise(F.lit("LOW")))


def alert_action(score: Column, high: float = ALERT_HIGH, medium: float = ALERT_MEDIUM) -> Column:
    """FN-7 action for the level."""
    return (F.when(score >= F.lit(high), F.lit("BLOCK_AND_REVIEW"))
             .when(score >= F.lit(medium), F.lit("MANUAL_REVIEW"))
             .otherwise(F.lit("AUTO_APPROVE")))


def quality_grade(score: Column) -> Column:
    """FN-8 grade."""
    return (F.when(score >= 90, F.lit("A")).when(score >= 80, F.lit("B"))
             .when(score >= 70, F.lit("C")).otherwise(F.lit("D")))


def quality_trend(avg_score: Column) -> Column:
    """FN-8 trend of the recent average quality score."""
    return (F.when(avg_score >= 90, F.lit("stable")).when(avg_score >= 70, F.lit("watch"))
             .otherwise(F.lit("degrading")))


def clip(x: Column, lo: float, hi: float) -> Column:
    """FN-9."""
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def format_amount(x: Column) -> Column:
    """FN-12: ``$1,234``."""
    return F.concat(F.lit("$"), F.format_number(x, 0))


def score_bin_label(score: Column, size: float = 0.1) -> Column:
    """FN-13: ``"0.3-0.4"`` for the bin of width ``size`` holding ``score``."""
    b = F.floor(score / F.lit(size))
    return F.concat(F.format_string("%.1f", b * F.lit(size)), F.lit("-"),
                    F.format_string("%.1f", (b + 1) * F.lit(size)))
