"""Exploration queries over the claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import clean
from riskloom.operators import explore as ex
from riskloom.plans import base
from riskloom.plans.registry import query
from riskloom.plans.sql_base import CLAIMS_W


@query("top_risk_doctors", CLAIMS_W + """
SELECT doctor_id, avg(CAST(fraud_label AS DOUBLE)) AS fraud_rate, count(*) AS n_claims, sum(claim_amount) AS total_amount
FROM claims GROUP BY doctor_id HAVING count(*) >= 10 ORDER BY fraud_rate DESC, doctor_id LIMIT 15""")
def top_risk_doctors(spark, d):
    """AG-9: rate, count, amount per doctor; HAVING count >= 10; top 15 (a top-k report)."""
    return ex.risk_by(base.claims(spark, d), "doctor_id", 10, 15)


@query("hospital_risk", CLAIMS_W + """
SELECT hospital_id, avg(CAST(fraud_label AS DOUBLE)) AS fraud_rate, count(*) AS n_claims, sum(claim_amount) AS total_amount
FROM claims GROUP BY hospital_id ORDER BY fraud_rate DESC, hospital_id LIMIT 20""")
def hospital_risk(spark, d):
    """AG-10: risk vs volume per hospital, top 20."""
    return ex.risk_by(base.claims(spark, d), "hospital_id", 0, 20)


@query("rate_by_segment", CLAIMS_W + """
SELECT c_mktsegment AS gender, avg(CAST(fraud_label AS DOUBLE)) AS fraud_rate, count(*) AS n_claims,
       sum(claim_amount) AS total_amount
FROM claims JOIN customer ON c_custkey = patient_id GROUP BY c_mktsegment""")
def rate_by_segment(spark, d):
    """AG-11: label rate by a patient attribute after the dimension join."""
    c = base.claims(spark, d).join(base.read(spark, d, "customer").select(
        F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("gender")), "patient_id")
    return ex.risk_by(c, "gender")


@query("label_counts", CLAIMS_W + "SELECT fraud_label, count(*) AS n FROM claims GROUP BY fraud_label")
def label_counts(spark, d):
    """AG-12."""
    return ex.label_counts(base.claims(spark, d))


@query("class_weights", CLAIMS_W + """
SELECT fraud_label, n, sum(n) OVER () / (2.0 * n) AS weight FROM (SELECT fraud_label, count(*) AS n FROM claims GROUP BY 1)""")
def class_weights(spark, d):
    """AG-23."""
    return ex.class_weights(base.claims(spark, d))


@query("class_histogram", CLAIMS_W.rstrip("\n") + """,
st AS (SELECT min(claim_amount) AS lo, max(claim_amount) AS hi FROM claims),
b AS (SELECT fraud_label, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((claim_amount - lo) / ((hi - lo) / 20)), 19) END
                               AS INTEGER) AS bin, lo, hi FROM claims CROSS JOIN st),
nc AS (SELECT fraud_label, count(*) AS n_class FROM claims GROUP BY 1)
SELECT fraud_label, bin, lo + bin * CASE WHEN hi = lo THEN 1.0 ELSE (hi - lo) / 20 END AS bin_start, count(*) AS n,
       count(*) / (n_class * CASE WHEN hi = lo THEN 1.0 ELSE (hi - lo) / 20 END) AS density
FROM b JOIN nc USING (fraud_label) GROUP BY fraud_label, bin, lo, hi, n_class""")
def class_histogram(spark, d):
    """AG-14: per-class density histogram of claim amounts (20 bins)."""
    return ex.class_histogram(base.claims(spark, d), "claim_amount")


@query("class_boxplot", CLAIMS_W + """
SELECT fraud_label, min(claim_amount) AS min, quantile_cont(claim_amount, 0.25) AS q1,
       quantile_cont(claim_amount, 0.5) AS median, quantile_cont(claim_amount, 0.75) AS q3, max(claim_amount) AS max
FROM claims GROUP BY fraud_label""")
def class_boxplot(spark, d):
    """AG-15: five-number summary of claim amounts per class."""
    return ex.class_boxplot(base.claims(spark, d), "claim_amount")


@query("provider_stats_distinct", CLAIMS_W + """
SELECT doctor_id, count(*) AS provider_claims, sum(claim_amount) AS provider_total, avg(claim_amount) AS provider_mean,
       max(claim_amount) AS provider_max, count(DISTINCT patient_id) AS provider_distinct_patient_id,
       avg(CAST(days_in_hospital > 0 AS DOUBLE)) AS provider_is_inpatient_rate
FROM claims GROUP BY doctor_id""")
def provider_stats_distinct(spark, d):
    """AG-5: provider stats with exact distinct patients and the inpatient rate."""
    c = base.claims(spark, d).withColumn("is_inpatient", F.col("days_in_hospital") > 0)
    return ex.entity_stats_with_distinct(c, "doctor_id", "patient_id", "provider", flag="is_inpatient")


@query("beneficiary_stats_distinct", CLAIMS_W + """
SELECT patient_id, count(*) AS bene_claims, sum(claim_amount) AS bene_total, avg(claim_amount) AS bene_mean,
       max(claim_amount) AS bene_max, count(DISTINCT doctor_id) AS bene_distinct_doctor_id
FROM claims GROUP BY patient_id""")
def beneficiary_stats_distinct(spark, d):
    """AG-6: beneficiary stats with exact distinct providers."""
    return ex.entity_stats_with_distinct(base.claims(spark, d), "patient_id", "doctor_id", "bene")


ROLE_SQL = """
r AS (SELECT claim_id, doctor_id AS attending,
             CASE WHEN claim_id % 3 = 0 THEN NULL ELSE part_id % 50 END AS operating,
             CASE WHEN claim_id % 2 = 0 THEN NULL ELSE patient_id % 40 END AS other FROM claims)"""


def roles(spark, d):
    c = base.claims(spark, d)
    return c.select("claim_id", F.col("doctor_id").alias("attending"),
                    F.when(F.pmod("claim_id", F.lit(3)) == 0, F.lit(None)).otherwise(F.pmod("part_id", F.lit(50)))
                     .alias("operating"),
                    F.when(F.pmod("claim_id", F.lit(2)) == 0, F.lit(None)).otherwise(F.pmod("patient_id", F.lit(40)))
                     .alias("other"))


@query("role_counts", CLAIMS_W.rstrip("\n") + "," + ROLE_SQL + """
SELECT claim_id, attending, operating, other,
       CASE WHEN attending IS NULL THEN 0 ELSE count(attending) OVER (PARTITION BY attending) END AS attending_count,
       CASE WHEN operating IS NULL THEN 0 ELSE count(operating) OVER (PARTITION BY operating) END AS operating_count,
       CASE WHEN other IS NULL THEN 0 ELSE count(other) OVER (PARTITION BY other) END AS other_count
FROM r""")
def role_counts(spark, d):
    """AG-7: rows sharing each physician role value (attending / operating / other; null -> 0)."""
    return ex.role_counts(roles(spark, d), ["attending", "operating", "other"])


@query("family_nonnull_counts", CLAIMS_W.rstrip("\n") + """,
fam AS (SELECT claim_id, """ + ", ".join(
    f"CASE WHEN num_procedures >= {i} THEN part_id + {i} END AS ClmProcedureCode_{i}" for i in range(1, 9)) + ", " +
    ", ".join(f"CASE WHEN patient_id % {i + 1} = 0 THEN '1' ELSE '2' END AS ChronicCond_{i}" for i in range(1, 6)) + """
        FROM claims)
SELECT claim_id, """ + " + ".join(f"CAST(ClmProcedureCode_{i} IS NOT NULL AS INTEGER)" for i in range(1, 7)) +
    " AS n_procedure_codes, " + " + ".join(
    f"CAST(coalesce(TRY_CAST(ChronicCond_{i} AS DOUBLE) = 1, false) AS INTEGER)" for i in range(1, 6)) +
    " AS n_chronic FROM fam")
def family_nonnull_counts(spark, d):
    """PR-6 + PR-11 on claims pivoted into numbered code / chronic-flag families."""
    c = base.claims(spark, d)
    fam = c.select("claim_id",
                   *[F.when(F.col("num_procedures") >= i, F.col("part_id") + i).alias(f"ClmProcedureCode_{i}")
                     for i in range(1, 9)],      # two columns beyond the family
                   *[F.when(F.pmod("patient_id", F.lit(i + 1)) == 0, F.lit("1")).otherwise(F.lit("2"))
                      .alias(f"ChronicCond_{i}") for i in range(1, 6)])
    return fam.select("claim_id", clean.nonnull_count(fam, "ClmProcedureCode_", 6).alias("n_procedure_codes"),
                      clean.chronic_count(fam, "ChronicCond_").alias("n_chronic"))


#: Key columns of every input table.
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
        "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"],
        "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"]}


def _fingerprint_sql(table, keys):
    text = "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")"
    return (f"SELECT '{table}' AS \"table\", count(*) AS n_rows, CAST(coalesce(sum(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)), 0) AS BIGINT) AS hash_sum FROM {table}")


@query("table_fingerprints", " UNION ALL ".join(_fingerprint_sql(t, k) for t, k in KEYS.items()))
def table_fingerprints(spark, d):
    """SO-15 re-aimed: order-insensitive fingerprints of all input tables (count, and
    sum of a 32-bit hash of each row's key)."""
    out = None
    for t, keys in KEYS.items():
        f = ex.table_fingerprint(base.read(spark, d, t), t, keys)
        out = f if out is None else out.unionByName(f)
    return out
