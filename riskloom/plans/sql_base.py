"""DuckDB building blocks for the oracle SQL: the same claims/split/profile/score
derivations as ``plans.base``, written as CTEs over the fixture views."""

CLAIMS = """
li AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                 ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn_
    FROM lineitem) WHERE rn_ = 1),
claims AS (
  SELECT l_orderkey * 8 + l_linenumber AS claim_id,
         o_custkey AS patient_id,
         l_suppkey AS doctor_id,
         s_nationkey AS hospital_id,
         l_partkey AS part_id,
         CAST(l_shipdate AS DATE) AS claim_date,
         l_extendedprice AS claim_amount,
         CAST(l_quantity AS INTEGER) AS num_procedures,
         CAST(l_partkey % 15 AS INTEGER) AS days_in_hospital,
         CAST(l_returnflag = 'R' AS INTEGER) AS fraud_label,
         l_linestatus = 'F' AS approved,
         CAST(CASE WHEN l_returnflag = 'R' THEN l_suppkey % 6 ELSE 0 END AS INTEGER) AS ring_id,
         o_orderpriority AS insurance_type
  FROM li JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""

SPLIT = """
ranked_ AS (
  SELECT *, row_number() OVER (ORDER BY claim_date, claim_id) - 1 AS pos_, count(*) OVER () AS n_
  FROM claims),
split AS (
  SELECT * EXCLUDE (pos_, n_),
         CASE WHEN pos_ < floor(CAST(0.6 AS DOUBLE) * n_) THEN 'train'
              WHEN pos_ < floor(CAST(0.8 AS DOUBLE) * n_) THEN 'val' ELSE 'test' END AS split
  FROM ranked_),
train AS (SELECT * FROM split WHERE split = 'train')"""

PROFILE = """
profile AS (
  SELECT avg(claim_amount) AS mean_claim, count(*) AS n_train,
         quantile_cont(claim_amount, 0.5) AS p50_claim,
         quantile_cont(claim_amount, 0.75) AS p75_claim,
         quantile_cont(claim_amount, 0.95) AS p95_claim,
         quantile_cont(claim_amount, 0.99) AS p99_claim,
         quantile_cont(CAST(num_procedures AS DOUBLE), 0.95) AS p95_procedures,
         quantile_cont(CAST(days_in_hospital AS DOUBLE), 0.95) AS p95_days
  FROM train)"""

SCORED = """
rules_ AS (
  SELECT s.*,
    least(
      (CASE WHEN claim_amount > p99_claim * 3 THEN 0.60 WHEN claim_amount > p99_claim THEN 0.45
            WHEN claim_amount > p95_claim THEN 0.28 WHEN claim_amount > p75_claim THEN 0.10 ELSE 0.0 END)::DOUBLE
    + (CASE WHEN num_procedures > p95_procedures * 1.5 THEN 0.20 WHEN num_procedures > p95_procedures THEN 0.12
            ELSE 0.0 END)::DOUBLE
    + (CASE WHEN days_in_hospital > p95_days * 1.5 THEN 0.18 WHEN days_in_hospital > p95_days THEN 0.10
            ELSE 0.0 END)::DOUBLE
    + (CASE WHEN claim_amount > p95_claim AND num_procedures > p95_procedures AND days_in_hospital > p95_days
            THEN 0.15 ELSE 0.0 END)::DOUBLE, 0.90::DOUBLE) AS rule_score,
    least(claim_amount / 50000.0, 1.0) AS ml_score
  FROM split s CROSS JOIN profile),
scored AS (
  SELECT *, fraud_score > 0.5 AS fraud_prediction,
         CASE WHEN fraud_score > 0.7 THEN 'HIGH' WHEN fraud_score > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
  FROM (SELECT *, least(greatest(ml_score * 0.65 + rule_score * 0.35 + ml_score * rule_score * 0.15, 0.01), 0.99)
                  AS fraud_score FROM rules_))"""

LOG = """
log AS (
  SELECT event_id AS prediction_id, ts, user_id, event_type AS model_version, event_type AS endpoint,
         least(value / 500.0, 1.0) AS fraud_score, least(value / 500.0, 1.0) > 0.5 AS fraud_prediction,
         value AS inference_time_ms, props
  FROM events)"""


def with_(*blocks: str) -> str:
    return "WITH " + ",".join(b.strip("\n") for b in blocks) + "\n"


CLAIMS_W = with_(CLAIMS)
SPLIT_W = with_(CLAIMS, SPLIT)
PROFILE_W = with_(CLAIMS, SPLIT, PROFILE)
SCORED_W = with_(CLAIMS, SPLIT, PROFILE, SCORED)
LOG_W = with_(LOG)
