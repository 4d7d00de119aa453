"""Leakage-safe entity aggregates and the wide feature table (AG-1..8, JN-1, JN-2, JN-4, EN-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.clean import calendar_features, ratio_to_avg
from riskloom.operators.ordering import quantiles


def patient_stats(train: DataFrame) -> DataFrame:
    """AG-1: per patient count / sum / mean / max of the claim amount."""
    return train.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("patient_total_claims"),
        F.sum("claim_amount").alias("patient_total_amount"),
        F.avg("claim_amount").alias("patient_avg_amount"),
        F.max("claim_amount").alias("patient_max_amount"))


def doctor_stats(train: DataFrame) -> DataFrame:
    """AG-2: per doctor count / sum / mean."""
    return train.groupBy("doctor_id").agg(
        F.count(F.lit(1)).alias("doctor_total_claims"),
        F.sum("claim_amount").alias("doctor_total_amount"),
        F.avg("claim_amount").alias("doctor_avg_amount"))


def hospital_stats(train: DataFrame) -> DataFrame:
    """AG-3: per hospital count / mean."""
    return train.groupBy("hospital_id").agg(
        F.count(F.lit(1)).alias("hosp_total_claims"),
        F.avg("claim_amount").alias("hosp_avg_amount"))


def global_stats(train: DataFrame) -> DataFrame:
    """AG-4: one row -- global mean amount and max procedures (unseen-entity defaults)."""
    return train.agg(F.avg("claim_amount").alias("global_avg_claim"),
                     F.max("num_procedures").alias("global_max_procedures"))


def entity_stats(train: DataFrame) -> dict[str, DataFrame]:
    """The train-fitted tables that ``apply_entity_stats`` joins."""
    return {"patient": patient_stats(train), "doctor": doctor_stats(train), "hospital": hospital_stats(train), "all": global_stats(train)}


def apply_entity_stats(df: DataFrame, train: DataFrame, fitted: dict[str, DataFrame] | None = None) -> DataFrame:
    """JN-1 + JN-4: attach train-only entity stats to every split, those of ``train`` unless ``fitted`` has them.

    Unseen entity defaults: count -> 1, sum -> 0, mean/max -> global train mean.
    Patients grow with the claims, so their statistics join with a shuffle on
    the patient (a later join on the patient needs no other).  Doctors and
    hospitals are few beside the claims: their rows are broadcast, as is the global row.
    """
    fitted = fitted or entity_stats(train)
    out = (df.join(fitted["patient"], "patient_id", "left")
             .join(F.broadcast(fitted["doctor"]), "doctor_id", "left")
             .join(F.broadcast(fitted["hospital"]), "hospital_id", "left")
             .crossJoin(F.broadcast(fitted["all"])))
    gavg = F.col("global_avg_claim")
    return out.select(
        *df.columns,
        F.coalesce("patient_total_claims", F.lit(1)).cast("long").alias("patient_total_claims"),
        F.coalesce("patient_total_amount", F.lit(0.0)).alias("patient_total_amount"),
        F.coalesce("patient_avg_amount", gavg).alias("patient_avg_amount"),
        F.coalesce("patient_max_amount", gavg).alias("patient_max_amount"),
        F.coalesce("doctor_total_claims", F.lit(1)).cast("long").alias("doctor_total_claims"),
        F.coalesce("doctor_total_amount", F.lit(0.0)).alias("doctor_total_amount"),
        F.coalesce("doctor_avg_amount", gavg).alias("doctor_avg_amount"),
        F.coalesce("hosp_total_claims", F.lit(1)).cast("long").alias("hosp_total_claims"),
        F.coalesce("hosp_avg_amount", gavg).alias("hosp_avg_amount"),
    )


def enrich_dimensions(df: DataFrame, patients: DataFrame, doctors: DataFrame, hospitals: DataFrame,
                      parts: DataFrame | None = None) -> DataFrame:
    """JN-2: left joins of entity attributes (column-pruned before the join)."""
    out = df.join(patients.select("patient_id", "gender"), "patient_id", "left") \
            .join(F.broadcast(doctors.select("doctor_id", "years_experience")), "doctor_id", "left") \
            .join(F.broadcast(hospitals.select("hospital_id", "state", "num_beds")), "hospital_id", "left")
    if parts is not None:
        out = out.join(parts.select("part_id", "specialty"), "part_id", "left")
    return out


def ratio_and_calendar(df: DataFrame) -> DataFrame:
    """PR-14 + PR-16 on a frame that already has the entity averages."""
    return df.select(
        "*",
        ratio_to_avg(F.col("claim_amount"), F.col("patient_avg_amount")).alias("amount_vs_patient_avg"),
        ratio_to_avg(F.col("claim_amount"), F.col("doctor_avg_amount")).alias("amount_vs_doctor_avg"),
        ratio_to_avg(F.col("claim_amount"), F.col("hosp_avg_amount")).alias("amount_vs_hosp_avg"),
        *calendar_features(F.col("claim_date")))


# Percentile points and names of the claim profile.
PROFILE_PROBS = {"p50_claim": 0.50, "p75_claim": 0.75, "p95_claim": 0.95, "p99_claim": 0.99}


def train_profile(train: DataFrame) -> DataFrame:
    """AG-8: one-row percentile profile of training claims (exact, linear interpolation).

    The three columns are unpivoted so a single distributed quantile pass
    (grouped by feature) serves all of them.
    """
    long = train.select(F.explode(F.array(
        F.struct(F.lit("claim_amount").alias("f"), F.col("claim_amount").cast("double").alias("v")),
        F.struct(F.lit("num_procedures").alias("f"), F.col("num_procedures").cast("double").alias("v")),
        F.struct(F.lit("days_in_hospital").alias("f"), F.col("days_in_hospital").cast("double").alias("v")),
    )).alias("x")).select("x.f", "x.v")
    q = quantiles(long, "v", {**PROFILE_PROBS, "p95": 0.95}, group_cols=["f"])
    pick = q.agg(*[F.max(F.when(F.col("f") == "claim_amount", F.col(k))).alias(k) for k in PROFILE_PROBS],
                 F.max(F.when(F.col("f") == "num_procedures", F.col("p95"))).alias("p95_procedures"),
                 F.max(F.when(F.col("f") == "days_in_hospital", F.col("p95"))).alias("p95_days"))
    means = train.agg(F.avg("claim_amount").alias("mean_claim"), F.count(F.lit(1)).alias("n_train"))
    return means.crossJoin(pick)


# Feature names in trained order.
FEATURE_COLUMNS = [
    "claim_amount", "num_procedures", "days_in_hospital",
    "patient_total_claims", "patient_total_amount", "patient_avg_amount", "patient_max_amount",
    "doctor_total_claims", "doctor_total_amount", "doctor_avg_amount",
    "hosp_total_claims", "hosp_avg_amount",
    "gender", "insurance_type", "specialty", "years_experience", "num_beds", "state",
    "amount_vs_patient_avg", "amount_vs_doctor_avg", "amount_vs_hosp_avg",
    "claim_month", "claim_dayofweek", "claim_day",
]
CATEGORICALS = ["gender", "insurance_type", "specialty", "state"]
