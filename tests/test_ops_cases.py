"""Hand cases for masking, drift, quality, compliance, graph and streaming operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.functions.masking import mask_email, mask_frame, mask_spans, mask_tail, mask_value
from riskloom.operators import compliance as cp
from riskloom.operators import drift as dr
from riskloom.operators import quality as dq
from riskloom.operators.graph import k_hop


def test_mask_email_and_tail(spark):
    df = spark.createDataFrame([("alice@example.com",), ("al@x.io",), ("5551234567",)], "s string")
    got = [tuple(r) for r in df.select(mask_email(F.col("s")), mask_tail(F.col("s"))).collect()]
    assert got[0][0] == "a***e@example.com"
    assert got[1][0] == "**@x.io"
    assert got[2][1] == "******4567"


def test_mask_value_orders_patterns_and_is_idempotent(spark):
    df = spark.createDataFrame([("mail bob@corp.com now",), ("call 15551234567",), ("10.0.0.1",), ("plain",)], "s string")
    once = df.select(mask_value(F.col("s")).alias("s"))
    got = [r[0] for r in once.collect()]
    assert got[1].endswith("4567") and got[1].startswith("*")
    assert got[2] == "********"
    assert got[3] == "plain"
    twice = [r[0] for r in once.select(mask_value(F.col("s"))).collect()]
    assert twice[2:] == got[2:]


def test_sensitive_field_always_masked(spark):
    df = spark.createDataFrame([("hunter2",)], "password string")
    assert df.select(mask_value(F.col("password"), "password")).first()[0] == "*******"


def test_mask_frame_recurses(spark):
    df = spark.createDataFrame([(1, {"email": "joe@ex.com"}, ["10.1.2.3"])],
                               "id int, m map<string,string>, a array<string>")
    r = mask_frame(df).first()
    assert r["id"] == 1 and r["m"]["email"] == "j*e@ex.com" and r["a"] == ["********"]


def test_mask_spans(spark):
    df = spark.createDataFrame([("write to a@b.org or 192.168.1.10",)], "t string")
    assert df.select(mask_spans(F.col("t"))).first()[0] == "write to [EMAIL] or [IP]"


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.95,), (1.0,)], "s double")
    h = {r["bin"]: r["n"] for r in dr.score_histogram(df, "s").collect()}
    assert h[0] == 2 and h[9] == 2 and sum(h.values()) == 4


def test_kl_js_zero_for_equal(spark):
    df = spark.createDataFrame([(x / 20,) for x in range(20)], "s double")
    h = dr.score_histogram(df, "s")
    r = dr.divergences(h, h).first()
    assert abs(r["kl_divergence"]) < 1e-12 and abs(r["js_divergence"]) < 1e-12


def test_prediction_drift_insufficient(spark):
    t = dt.datetime(2024, 1, 20)
    df = spark.createDataFrame([(t, 0.5)], "ts timestamp, fraud_score double")
    r = dr.prediction_drift(df, dt.datetime(2024, 1, 21)).first()
    assert (r["has_drift"], r["drift_reason"]) == (False, "insufficient_data")


@pytest.mark.parametrize("b,c,col", [((0.9935, 0.999, 0.05), (0.92, 0.999, 0.05), "accuracy_status"),
                                     ((0.99, 0.9987, 0.05), (0.99, 0.985, 0.05), "auc_status"),
                                     ((0.99, 0.999, 0.05), (0.99, 0.999, 0.15), "fraud_rate_status")])
def test_metric_drift_alerts(spark, b, c, col):
    sch = "accuracy double, roc_auc double, fraud_rate double"
    r = dr.metric_drift(spark.createDataFrame([b], sch), spark.createDataFrame([c], sch)).first()
    assert r[col] == "ALERT" and r["overall_drift"]


def test_validation_gate(spark):
    sch = "accuracy double, roc_auc double, precision double, latency_ms double"
    rows = [(0.92, 0.995, 0.95, 50.0), (0.95, 0.985, 0.95, 50.0), (0.95, 0.995, 0.92, 50.0), (0.95, 0.995, 0.95, 250.0)]
    got = [(r["passed"], r["confidence"]) for r in dr.validate_metrics(spark.createDataFrame(rows, sch)).collect()]
    assert got == [(False, "low"), (False, "low"), (False, "low"), (True, "medium")]


def test_quality_score_penalties(spark):
    a = "array<struct<severity:string,check_type:string,field:string,message:string,value:double,threshold:string>>"
    df = spark.createDataFrame([([("critical", "missing", "f", "", None, None), ("warning", "invalid", "f", "", None, None),
                                  ("warning", "invalid", "g", "", None, None), ("info", "drift", "h", "", None, None)],)],
                               f"alerts {a}")
    assert df.select(dq.quality_score(F.col("alerts"))).first()[0] == 69


def test_order_stats_profile(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 21)], "x double")
    r = dq.fit_profile(df, ["x"]).first()
    assert (r["q1"], r["q3"], r["median"], r["mean"]) == (6.0, 16.0, 11.0, 10.5)
    assert r["stdev"] == pytest.approx(5.91608, abs=1e-5)


def test_compliance_score(spark):
    consent = spark.createDataFrame([], "user_id long, consent_type string, granted boolean, ts timestamp")
    pol = spark.createDataFrame([], "data_type string, retention_days int")
    dsr = spark.createDataFrame([("r1", "pending")], "request_id string, status string")
    r = cp.gdpr_recommendations(cp.gdpr_status(consent, pol, dsr)).first()
    assert r["compliance_score"] == 40.0 and len(r["recommendations"]) == 4      # the low score is named too


def test_retention_days(spark):
    recs = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("z", dt.datetime(2024, 1, 1))],
                                 "data_type string, created_at timestamp")
    pol = spark.createDataFrame([("a", 40)], "data_type string, retention_days int")
    got = {r["data_type"]: (r["days_until_expiry"], r["should_retain"])
           for r in cp.retention(recs, pol, dt.datetime(2024, 1, 31)).collect()}
    assert got == {"a": (10, True), "z": (-1, True)}


def test_k_hop_two_rounds(spark):
    e = spark.createDataFrame([("claim", 1, "treated_by", "doctor", 10), ("claim", 2, "treated_by", "doctor", 10),
                               ("claim", 3, "treated_by", "doctor", 11)],
                              "src_type string, src long, relation string, dst_type string, dst long")
    seeds = spark.createDataFrame([(1, "claim", 1)], "seed long, node_type string, node long")
    got = sorted((r["node_type"], r["node"], r["hop"]) for r in k_hop(e, seeds, ["treated_by"], 2).collect())
    assert got == [("claim", 1, 0), ("claim", 2, 2), ("doctor", 10, 1)]


def test_stream_equals_batch_rolling(spark, tmp_path):
    """SM-3 keyed ring buffer over several micro-batches equals the batch window."""
    from riskloom.operators.ordering import rolling_rows
    from riskloom.streaming import ops as sm
    t = dt.datetime(2024, 1, 1)
    rows = [(i, "a" if i % 3 else "b", t + dt.timedelta(minutes=i), float((i * 37) % 50)) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp, value double")
    src = str(tmp_path / "src")
    for part in range(4):   # four files -> four micro-batches in time order
        df.where((F.col("event_id") >= part * 30) & (F.col("event_id") < part * 30 + 30)).coalesce(1) \
          .write.mode("append").parquet(src)
    stream = sm.file_stream(spark, src, df.schema, max_files=1)
    got = {r["event_id"]: (r["roll_n"], r["roll_mean"]) for r in
           sm.run_to_table(sm.stream_rolling(stream), "t").collect()}
    ref = rolling_rows(df, ["event_type"], ["ts", "event_id"], "value", 20).collect()
    for r in ref:
        assert got[r["event_id"]][0] == r["roll_n"]
        assert got[r["event_id"]][1] == pytest.approx(r["roll_mean"], rel=1e-12)


@pytest.mark.parametrize("t,nu", [(12.706, 1), (4.303, 2), (3.182, 3), (2.776, 4), (2.571, 5)])
def test_t_p_value_at_critical_values(spark, t, nu):
    from riskloom.operators.evaluate import t_two_sided_p
    df = spark.createDataFrame([(t, nu)], "t double, nu int")
    assert df.select(t_two_sided_p(F.col("t"), F.col("nu"))).first()[0] == pytest.approx(0.05, abs=2e-4)


def test_entity_csv_reader_keeps_none_string(spark, tmp_path):
    from riskloom.sources.sinks import ENTITY_SCHEMAS, load_entities
    rows = {
        "hospitals": "hospital_id,hospital_name,specialty,state,num_beds,is_accredited,fraud_prone\nH0001,A,Cardio,CA,120,True,False\n",
        "doctors": "doctor_id,doctor_name,specialty,hospital_id,years_experience,avg_claims_per_month,license_valid,"
                   "fraud_prone,ring_id\nD0001,B,Cardio,H0001,10,40,True,False,0\n",
        "patients": "patient_id,age,gender,chronic_condition,insurance_type,state,member_since_years,fraud_prone,ring_id\n"
                    "P00001,50,M,None,HMO,CA,3,False,0\nP00002,61,F,,PPO,NY,,False,0\n",
        "claims": "claim_id,patient_id,doctor_id,hospital_id,claim_date,claim_amount,num_procedures,procedure_code,"
                  "diagnosis_code,days_in_hospital,approved,fraud_label,ring_id\n"
                  "C000001,P00001,D0001,H0001,2023-05-01,1200.5,2,PC1,DX1,0,True,0,0\n",
    }
    for name, text in rows.items():
        (tmp_path / f"{name}.csv").write_text(text)
    t = load_entities(spark, str(tmp_path))
    assert set(t) == set(ENTITY_SCHEMAS)
    pats = sorted((r["patient_id"], r["chronic_condition"]) for r in t["patients"].collect())
    assert pats == [("P00001", "None"), ("P00002", None)]
    c = t["claims"].first()
    assert c["claim_date"] == dt.date(2023, 5, 1) and c["claim_amount"] == 1200.5


def test_provider_reader_missing_family_is_an_error(spark, tmp_path):
    from riskloom.sources.sinks import load_provider_tables
    (tmp_path / "Train_Inpatientdata-1.csv").write_text("ClaimID,Provider\nCLM1,PRV1\n")
    t = load_provider_tables(spark, str(tmp_path), {"inpatient": "Train_Inpatientdata-*.csv"})
    assert t["inpatient"].count() == 1
    with pytest.raises(FileNotFoundError):
        load_provider_tables(spark, str(tmp_path), {"outpatient": "Train_Outpatientdata-*.csv"})


def test_train_stats_do_not_see_val_test(spark):
    """Leak test: changing amounts of val/test claims leaves every train-fitted feature of train rows unchanged."""
    from riskloom.operators.features import apply_entity_stats
    from riskloom.operators.split import temporal_split
    base = dt.date(2024, 1, 1)
    rows = [(i, i % 4, i % 3, i % 2, base + dt.timedelta(days=i), float(100 + i), i % 5) for i in range(40)]
    sch = ("claim_id long, patient_id long, doctor_id long, hospital_id long, claim_date date, claim_amount double, "
           "num_procedures int")
    a = temporal_split(spark.createDataFrame(rows, sch), "claim_date", "claim_id")
    # rows >= 24 are val/test: change their amounts and procedures
    changed = [(*r[:5], r[5] * (1 if r[0] < 24 else 50), r[6] * (1 if r[0] < 24 else 9)) for r in rows]
    b = temporal_split(spark.createDataFrame(changed, sch), "claim_date", "claim_id")

    def feats(s):
        f = apply_entity_stats(s, s.where("split = 'train'")).where("split = 'train'")
        return sorted(tuple(r) for r in f.drop("split").collect())
    assert feats(a) == feats(b)


def test_js_is_symmetric(spark):
    p = spark.createDataFrame([(x / 10,) for x in range(10)] * 3 + [(0.95,)] * 7, "s double")
    q = spark.createDataFrame([(x / 20,) for x in range(20)], "s double")
    hp, hq = dr.score_histogram(p, "s"), dr.score_histogram(q, "s")
    a, b = dr.divergences(hp, hq).first(), dr.divergences(hq, hp).first()
    assert a["js_divergence"] == pytest.approx(b["js_divergence"], rel=1e-12)
    assert a["kl_divergence"] != pytest.approx(b["kl_divergence"], rel=1e-6)   # KL is not symmetric
