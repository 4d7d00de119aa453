"""Appending to the audit chain equals sealing the whole log; reruns change nothing."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators import auditstore as st
from riskloom.operators import compliance as cp
from riskloom.session import derived_path

BLOCK, LEVELS = 3, 3


def log(spark, sizes):
    rows = [(c, i, f"{c}-{i}") for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "chain_key string, at int, what string")


def store(spark, df, batches):
    folder = derived_path(spark)
    for k in range(batches):
        st.append_batch(df.where(F.col("batch") == k).drop("batch"), folder, k, "chain_key", ["at"], F.concat_ws("|", "seq", "what"), BLOCK, LEVELS)
    return folder


def whole(spark, df):
    entries = cp.sequence_entries(df.drop("batch"), ["chain_key"], ["at"]).withColumn("entry", F.concat_ws("|", "seq", "what"))
    sealed, heads = cp.seal(entries, "chain_key", block=BLOCK, levels=LEVELS)
    return {(r.chain_key, r.seq): r.hash for r in sealed.collect()}, {r.chain_key: (r.n_entries, r.head) for r in heads.collect()}


def state(spark, folder, batch):
    edge = st.read_edge(spark, folder, batch + 1)
    return ({(r.chain_key, r.seq): r.hash for r in spark.read.parquet(f"{folder}/log").collect()},
            {r.chain_key: (r.n_entries, r.head) for r in st.edge_heads(edge, "chain_key", BLOCK, LEVELS).collect()})


@pytest.mark.parametrize("cuts", [(1, 2, 3), (0, 9, 9), (5, 5, 20), (3, 6, 27)])
def test_head_after_appends_is_the_head_of_a_full_build(spark, cuts):
    sizes = {"a": 27, "b": 1, "c": 9, "d": 10, "e": 3, "f": 18, "late": 7}
    late = F.when(F.col("chain_key") == "late", 2)
    df = log(spark, sizes).withColumn("batch", F.coalesce(late, F.when(F.col("at") < cuts[0], 0).when(F.col("at") < cuts[1], 1).when(F.col("at") < cuts[2], 2).otherwise(3)))
    folder = store(spark, df, 4)
    assert state(spark, folder, 3) == whole(spark, df)


def test_a_batch_run_again_leaves_the_same_log(spark):
    df = log(spark, {"a": 11, "b": 4}).withColumn("batch", F.floor(F.col("at") / 4))
    folder = store(spark, df, 3)
    before = state(spark, folder, 2)
    st.append_batch(df.where("batch = 2").drop("batch"), folder, 2, "chain_key", ["at"], F.concat_ws("|", "seq", "what"), BLOCK, LEVELS)
    assert state(spark, folder, 2) == before == whole(spark, df)


def test_tampering_is_found(spark):
    df = log(spark, {"a": 11, "b": 4}).withColumn("batch", F.floor(F.col("at") / 4))
    folder = store(spark, df, 3)
    heads = st.edge_heads(st.read_edge(spark, folder, 3), "chain_key", BLOCK, LEVELS)
    sealed = spark.read.parquet(f"{folder}/log")
    ok = {r.chain_key: r.intact for r in cp.verify_chain(sealed, heads, "chain_key", block=BLOCK).collect()}
    assert ok == {"a": True, "b": True}
    changed = sealed.withColumn("entry", F.when((F.col("chain_key") == "a") & (F.col("seq") == 5), "forged").otherwise(F.col("entry")))
    for bad in (changed, sealed.where("NOT (chain_key = 'a' AND seq >= 9)"), sealed.where("NOT (chain_key = 'a' AND seq BETWEEN 3 AND 5)")):
        out = {r.chain_key: r.intact for r in cp.verify_chain(bad, heads, "chain_key", block=BLOCK).collect()}
        assert out == {"a": False, "b": True}


def test_empty_batch_and_full_chain(spark):
    df = log(spark, {"a": 5}).withColumn("batch", F.lit(0))
    folder = store(spark, df, 2)                     # the second batch has no rows
    assert state(spark, folder, 1)[1] == whole(spark, df)[1]
    with pytest.raises(ValueError):
        store(spark, log(spark, {"a": 28}).withColumn("batch", F.lit(0)), 1)


def test_predictions_are_logged_masked_and_checked(spark):
    rows = [(1, 7, dt.datetime(2024, 1, 1), 0.9, "alice@example.com"), (2, 8, dt.datetime(2024, 1, 1, 1), 0.1, "plain"), (3, 9, dt.datetime(2024, 1, 2), 0.2, None)]
    p = spark.createDataFrame(rows, "prediction_id long, user_id long, ts timestamp, fraud_score double, contact string")
    consent = spark.createDataFrame([(7, "data_processing", True), (8, "data_processing", False)], "user_id long, consent_type string, granted boolean")
    folder = derived_path(spark)
    entries = st.prediction_entries(p.where("prediction_id < 3"), F.col("ts"), F.col("user_id"), F.col("prediction_id"), F.col("fraud_score"), F.lit("v1"), F.col("prediction_id"))
    st.append_batch(entries.withColumn("chain_key", F.lit("log")), folder, 0, "chain_key", ["ts", "prediction_id"], st.log_entry(F.col("chain_key")))
    out = {r.prediction_id: r for r in st.comply(p, spark.read.parquet(f"{folder}/log"), consent).collect()}
    assert [out[i].gdpr_compliant for i in (1, 2, 3)] == [True, False, False]
    assert [out[i].audit_logged for i in (1, 2, 3)] == [True, True, False] and out[1].audit_hash and out[3].audit_hash is None
    assert out[1].contact == "a***e@example.com" and out[2].contact == "plain" and out[3].contact is None and out[1].fraud_score == 0.9
