"""Core queries: claims view, cleaning, split, entity stats, profile, features, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import clean
from riskloom.operators.features import (doctor_stats, hospital_stats, patient_stats)
from riskloom.operators.scoring import scoring_summary
from riskloom.operators.split import split_rates
from riskloom.plans import base
from riskloom.plans.registry import query
from riskloom.plans.sql_base import CLAIMS_W, PROFILE_W, SCORED_W, SPLIT_W

CLAIM_COLS = ("claim_id, patient_id, doctor_id, hospital_id, part_id, claim_date, claim_amount, num_procedures, "
              "days_in_hospital, fraud_label, approved, ring_id, insurance_type")


@query("claims_dedup", CLAIMS_W + f"SELECT {CLAIM_COLS} FROM claims")
def claims_dedup(spark, d):
    """PR-1: the de-duplicated claims view."""
    return base.claims(spark, d)


@query("temporal_split_counts", SPLIT_W + """
SELECT split, count(*) AS n_claims, avg(CAST(fraud_label AS DOUBLE)) AS fraud_rate,
       min(claim_date) AS first_date, max(claim_date) AS last_date
FROM split GROUP BY split""")
def temporal_split_counts(spark, d):
    """WN-1 + AG-16."""
    s = base.claims_split(spark, d)
    rates = split_rates(s)
    bounds = s.groupBy("split").agg(F.min("claim_date").alias("first_date"), F.max("claim_date").alias("last_date"))
    return rates.join(bounds, "split")


@query("temporal_split_assignment", SPLIT_W + "SELECT claim_id, claim_date, split FROM split")
def temporal_split_assignment(spark, d):
    """WN-1 per row (exact positions at the boundary dates)."""
    return base.claims_split(spark, d).select("claim_id", "claim_date", "split")


@query("entity_stats_patient", SPLIT_W + """
SELECT patient_id, count(*) AS patient_total_claims, sum(claim_amount) AS patient_total_amount,
       avg(claim_amount) AS patient_avg_amount, max(claim_amount) AS patient_max_amount
FROM train GROUP BY patient_id""")
def entity_stats_patient(spark, d):
    return patient_stats(base.train_rows(base.claims_split(spark, d)))


@query("entity_stats_doctor", SPLIT_W + """
SELECT doctor_id, count(*) AS doctor_total_claims, sum(claim_amount) AS doctor_total_amount,
       avg(claim_amount) AS doctor_avg_amount
FROM train GROUP BY doctor_id""")
def entity_stats_doctor(spark, d):
    return doctor_stats(base.train_rows(base.claims_split(spark, d)))


@query("entity_stats_hospital", SPLIT_W + """
SELECT hospital_id, count(*) AS hosp_total_claims, avg(claim_amount) AS hosp_avg_amount
FROM train GROUP BY hospital_id""")
def entity_stats_hospital(spark, d):
    return hospital_stats(base.train_rows(base.claims_split(spark, d)))


@query("train_profile", PROFILE_W + "SELECT * FROM profile")
def train_profile_q(spark, d):
    """AG-8 (exact distributed quantiles)."""
    return base.profile(spark, d)


FEATURES_SQL = SPLIT_W.rstrip("\n") + """,
ps AS (SELECT patient_id, count(*) AS pc, sum(claim_amount) AS pt, avg(claim_amount) AS pa, max(claim_amount) AS pm
       FROM train GROUP BY patient_id),
ds AS (SELECT doctor_id, count(*) AS dc, sum(claim_amount) AS dt, avg(claim_amount) AS da FROM train GROUP BY doctor_id),
hs AS (SELECT hospital_id, count(*) AS hc, avg(claim_amount) AS ha FROM train GROUP BY hospital_id),
g AS (SELECT avg(claim_amount) AS gavg FROM train),
f AS (
  SELECT s.claim_id, s.split, s.fraud_label, s.claim_amount, s.num_procedures, s.days_in_hospital,
         coalesce(pc, 1) AS patient_total_claims, coalesce(pt, 0.0) AS patient_total_amount,
         coalesce(pa, gavg) AS patient_avg_amount, coalesce(pm, gavg) AS patient_max_amount,
         coalesce(dc, 1) AS doctor_total_claims, coalesce(dt, 0.0) AS doctor_total_amount,
         coalesce(da, gavg) AS doctor_avg_amount,
         coalesce(hc, 1) AS hosp_total_claims, coalesce(ha, gavg) AS hosp_avg_amount,
         c.c_mktsegment AS gender, s.insurance_type, p.p_brand AS specialty, su.s_acctbal AS years_experience,
         n.n_regionkey AS num_beds, n.n_name AS state, s.claim_date
  FROM split s
  LEFT JOIN ps USING (patient_id) LEFT JOIN ds USING (doctor_id) LEFT JOIN hs USING (hospital_id) CROSS JOIN g
  LEFT JOIN customer c ON c.c_custkey = s.patient_id
  LEFT JOIN supplier su ON su.s_suppkey = s.doctor_id
  LEFT JOIN nation n ON n.n_nationkey = s.hospital_id
  LEFT JOIN part p ON p.p_partkey = s.part_id)
"""

FEATURE_SELECT = """
SELECT claim_id, split, fraud_label, claim_amount, num_procedures, days_in_hospital,
       patient_total_claims, patient_total_amount, patient_avg_amount, patient_max_amount,
       doctor_total_claims, doctor_total_amount, doctor_avg_amount, hosp_total_claims, hosp_avg_amount,
       gender, insurance_type, specialty, years_experience, num_beds, state,
       claim_amount / (patient_avg_amount + 1) AS amount_vs_patient_avg,
       claim_amount / (doctor_avg_amount + 1) AS amount_vs_doctor_avg,
       claim_amount / (hosp_avg_amount + 1) AS amount_vs_hosp_avg,
       CAST(month(claim_date) AS INTEGER) AS claim_month, CAST(isodow(claim_date) - 1 AS INTEGER) AS claim_dayofweek,
       CAST(day(claim_date) AS INTEGER) AS claim_day
FROM f"""

FEATURE_OUT = ["claim_id", "split", "fraud_label", "claim_amount", "num_procedures", "days_in_hospital",
               "patient_total_claims", "patient_total_amount", "patient_avg_amount", "patient_max_amount",
               "doctor_total_claims", "doctor_total_amount", "doctor_avg_amount", "hosp_total_claims",
               "hosp_avg_amount", "gender", "insurance_type", "specialty", "years_experience", "num_beds",
               "state", "amount_vs_patient_avg", "amount_vs_doctor_avg", "amount_vs_hosp_avg", "claim_month",
               "claim_dayofweek", "claim_day"]


@query("entity_features_all_splits", FEATURES_SQL + FEATURE_SELECT)
def entity_features_all_splits(spark, d):
    """JN-1, JN-2, JN-4, PR-14, PR-16: the wide feature table (EN-5 before encoding)."""
    return base.features_once(spark, d).select(*FEATURE_OUT)


@query("rule_score_tiers", SCORED_W + """
SELECT claim_id, split, rule_score, ml_score, fraud_score, fraud_prediction, risk_level FROM scored""")
def rule_score_tiers(spark, d):
    """ML-7, ML-9, ML-6, FN-6 per claim."""
    return base.scored(spark, d).select("claim_id", "split", "rule_score", "ml_score", "fraud_score",
                                        "fraud_prediction", "risk_level")


@query("hybrid_score_summary", SCORED_W + """
SELECT count(*) AS total_claims,
       count(*) FILTER (WHERE fraud_score >= 0.5) AS fraud_flagged,
       coalesce(avg(CASE WHEN fraud_score >= 0.5 THEN 1.0 ELSE 0.0 END), 0.0)::DOUBLE AS fraud_rate,
       count(*) FILTER (WHERE fraud_score > 0.7) AS high_risk,
       coalesce(sum(claim_amount), 0.0) AS total_amount,
       coalesce(sum(CASE WHEN fraud_score >= 0.5 THEN claim_amount END), 0.0) AS flagged_amount
FROM scored""")
def hybrid_score_summary(spark, d):
    """AG-17 over every scored claim (flagship)."""
    return scoring_summary(base.scored(spark, d))


@query("impute_median_mode", CLAIMS_W.rstrip("\n") + """,
dirty AS (
  SELECT claim_id,
         CASE WHEN claim_id % 7 = 0 THEN NULL ELSE claim_amount END AS claim_amount,
         CASE WHEN claim_id % 5 = 0 THEN NULL ELSE insurance_type END AS insurance_type
  FROM claims),
m AS (SELECT quantile_cont(claim_amount, 0.5) AS med FROM dirty),
mo AS (SELECT insurance_type AS mode_v FROM dirty WHERE insurance_type IS NOT NULL
       GROUP BY insurance_type ORDER BY count(*) DESC, insurance_type LIMIT 1)
SELECT claim_id, coalesce(claim_amount, med) AS claim_amount, coalesce(insurance_type, mode_v, 'Unknown') AS insurance_type
FROM dirty CROSS JOIN m LEFT JOIN mo ON TRUE""")
def impute_median_mode(spark, d):
    """PR-2 + PR-3 on claims with deterministic injected nulls."""
    c = base.claims(spark, d)
    dirty = c.select("claim_id",
                     clean.with_nulls("claim_amount", F.col("claim_id"), 7).alias("claim_amount"),
                     clean.with_nulls("insurance_type", F.col("claim_id"), 5).alias("insurance_type"))
    return clean.impute_mode(clean.impute_median(dirty, ["claim_amount"]), ["insurance_type"])


@query("calendar_and_ratio_features", FEATURES_SQL + """
SELECT claim_id, CAST(month(claim_date) AS INTEGER) AS claim_month, CAST(isodow(claim_date) - 1 AS INTEGER) AS claim_dayofweek,
       CAST(day(claim_date) AS INTEGER) AS claim_day,
       claim_amount / (patient_avg_amount + 1) AS amount_vs_patient_avg,
       claim_amount / (doctor_avg_amount + 1) AS amount_vs_doctor_avg,
       claim_amount / (hosp_avg_amount + 1) AS amount_vs_hosp_avg
FROM f""")
def calendar_and_ratio_features(spark, d):
    return base.features_once(spark, d).select("claim_id", "claim_month", "claim_dayofweek", "claim_day",
                                               "amount_vs_patient_avg", "amount_vs_doctor_avg", "amount_vs_hosp_avg")


@query("claim_validation_errors", CLAIMS_W.rstrip("\n") + """,
v AS (
  SELECT claim_id,
         CASE WHEN claim_id % 11 = 0 THEN claim_amount * 200 ELSE claim_amount END AS claim_amount,
         CASE WHEN claim_id % 13 = 0 THEN num_procedures + 100 ELSE num_procedures END AS num_procedures,
         CASE WHEN claim_id % 17 = 0 THEN -days_in_hospital - 1 ELSE days_in_hospital END AS days_in_hospital
  FROM claims)
SELECT claim_id,
       list_filter([CASE WHEN claim_amount IS NULL OR claim_amount < 0.0 OR claim_amount > 10000000.0
                         THEN 'claim_amount: must be within [0.0, 10000000.0]' END,
                    CASE WHEN num_procedures IS NULL OR num_procedures < 0 OR num_procedures > 100
                         THEN 'num_procedures: must be within [0, 100]' END,
                    CASE WHEN days_in_hospital IS NULL OR days_in_hospital < 0 OR days_in_hospital > 365
                         THEN 'days_in_hospital: must be within [0, 365]' END], lambda x: x IS NOT NULL) AS errors
FROM v""")
def claim_validation_errors(spark, d):
    """PR-20 with deterministic injected violations; rows with their error list."""
    c = base.claims(spark, d)
    v = c.select("claim_id",
                 F.when(F.pmod("claim_id", F.lit(11)) == 0, F.col("claim_amount") * 200)
                  .otherwise(F.col("claim_amount")).alias("claim_amount"),
                 F.when(F.pmod("claim_id", F.lit(13)) == 0, F.col("num_procedures") + 100)
                  .otherwise(F.col("num_procedures")).alias("num_procedures"),
                 F.when(F.pmod("claim_id", F.lit(17)) == 0, -F.col("days_in_hospital") - 1)
                  .otherwise(F.col("days_in_hospital")).alias("days_in_hospital"))
    return clean.validate_claims(v).select("claim_id", "errors")


@query("split_label_rates", SPLIT_W + """
SELECT split, count(*) AS n_claims, avg(CAST(fraud_label AS DOUBLE)) AS fraud_rate FROM split GROUP BY split""")
def split_label_rates(spark, d):
    """AG-16."""
    return split_rates(base.claims_split(spark, d))
