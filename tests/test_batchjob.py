"""The batch job on hand rows: error rows, reruns, the cap."""
import datetime as dt

from pyspark.sql import functions as F

from riskloom.operators import batchjob as bj
from riskloom.operators.scoring import DEFAULT_PROFILE
from riskloom.session import derived_path

SCHEMA = "claim_id long, claim_amount double, num_procedures int, days_in_hospital int"


def test_rerun_leaves_the_log_and_bad_claims_are_error_rows(spark):
    profile = spark.createDataFrame([tuple(DEFAULT_PROFILE.values())], list(DEFAULT_PROFILE))
    rows = [(1, 100.0, 1, 0), (2, None, 1, 0), (3, float("nan"), 1, 0), (4, -5.0, 1, 0), (5, 90000.0, 20, 30), (6, 100.0, None, 0), (7, 1e8, 1, 0)]
    claims, path = spark.createDataFrame(rows, SCHEMA), derived_path(spark)
    day = dt.date(2024, 2, 1)
    read = lambda: sorted(map(tuple, bj.read_log(spark, path).select("claim_id", "day", "batch_id", "status", "fraud_score", "risk_level").collect()))
    bj.run_batch(claims.where("claim_id < 5"), profile, path, day, 0)
    bj.run_batch(claims.where("claim_id >= 5"), profile, path, day, 1)
    once = read()
    bj.run_batch(claims.where("claim_id < 5"), profile, path, day, 0)
    assert read() == once and len(once) == 7
    status = {r[0]: r[3] for r in once}
    assert [i for i, s in status.items() if s == "ok"] == [1, 5]
    assert all(r[4] == 0.5 and r[5] == "MEDIUM" for r in once if r[3] == "error")
    out = {r.batch_id: r for r in bj.batch_summaries(bj.read_log(spark, path)).collect()}
    assert (out[0].total_processed, out[0].successful, out[0].failed, out[1].successful, out[1].fraud_detected) == (4, 1, 3, 1, 1)


def test_cap_and_empty_batch(spark):
    profile = spark.createDataFrame([tuple(DEFAULT_PROFILE.values())], list(DEFAULT_PROFILE))
    claims = spark.createDataFrame([(i, 10.0, 1, 0) for i in range(4)], SCHEMA)
    assert {r.status for r in bj.score_batch(claims, profile, most=3).collect()} == {"rejected"}
    assert {r.status for r in bj.score_batch(claims, profile, most=4).collect()} == {"ok"}
    assert bj.score_batch(claims.limit(0), profile, most=3).collect() == []
