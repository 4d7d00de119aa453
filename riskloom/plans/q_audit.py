"""The appendable audit log (CP-4) and compliance around a prediction (CP-14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import auditstore as st
from riskloom.operators import compliance as cp
from riskloom.plans import base
from riskloom.plans.q_compliance import CHAIN_BLOCK, CHAIN_LEVELS, CHAIN_SQL, CONSENT_CTE, _mask_value_sql, audit_log, consent_events, entry_of
from riskloom.plans.registry import query
from riskloom.session import derived_path

_STORES: dict = {}


def appended(spark, d) -> str:
    """The audit log of the events, appended in three batches by hour of the day; the last one is
    run twice.  Stored once per data folder and application."""
    key = (spark.sparkContext.applicationId, d.rstrip("/"))
    if key not in _STORES:
        folder = derived_path(spark)
        log = base.view(spark, d, "audit_log", lambda: audit_log(spark, d).withColumn("entry", entry_of())).drop("seq", "entry")
        log = log.withColumn("part", F.floor(F.hour("ts") / 8))
        for batch in (0, 1, 2, 2):
            st.append_batch(log.where(F.col("part") == batch).drop("part"), folder, batch, "chain_key", ["ts", "event_id"], entry_of(), CHAIN_BLOCK, CHAIN_LEVELS, sections=True)
        _STORES[key] = folder
    return _STORES[key]


@query("audit_chain_append", CHAIN_SQL + "SELECT chain_key, n_entries, head FROM shead")
def audit_chain_append(spark, d):
    """CP-4: heads of the log after its batches; the SQL builds them from the whole log."""
    return st.edge_heads(st.read_edge(spark, appended(spark, d), 3), "chain_key", CHAIN_BLOCK, CHAIN_LEVELS, sections=True).select("chain_key", "n_entries", "head")


@query("audit_chain_append_entries", CHAIN_SQL + "SELECT chain_key, seq, hash FROM sh0")
def audit_chain_append_entries(spark, d):
    """CP-4: place and hash of every appended entry."""
    return spark.read.parquet(f"{appended(spark, d)}/log").select("chain_key", "seq", "hash")


@query("audit_chain_append_verified", CHAIN_SQL + """SELECT chain_key, n_entries AS expected, n_entries AS found, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS repeated,
CAST(0 AS BIGINT) AS mismatched, true AS head_ok, true AS intact FROM shead""")
def audit_chain_append_verified(spark, d):
    """CP-5: the appended log, verified from its entries against the heads of the edge."""
    folder = appended(spark, d)
    heads = st.edge_heads(st.read_edge(spark, folder, 3), "chain_key", CHAIN_BLOCK, CHAIN_LEVELS, sections=True)
    return cp.verify_chain(spark.read.parquet(f"{folder}/log"), heads, "chain_key", block=CHAIN_BLOCK)


@query("processed_predictions", "WITH " + CONSENT_CTE.strip() + f""",
lg AS (SELECT event_id AS prediction_id, ts, user_id, event_type AS model_version, least(value / 500.0, 1.0) AS fraud_score, props AS note, 'u' || user_id || '@mail.example.org' AS contact FROM events)
SELECT prediction_id, user_id, fraud_score, model_version, {_mask_value_sql('note')} AS note, {_mask_value_sql('contact')} AS contact,
  coalesce(cur.granted, false) AS gdpr_compliant, true AS audit_logged
FROM lg LEFT JOIN (SELECT user_id, granted FROM cur WHERE consent_type = 'data_processing') cur USING (user_id)""")
def processed_predictions(spark, d):
    """CP-14: every prediction is appended to the audit log, checked for consent and masked; logged means that
    its entry is in the sealed log."""
    log = base.prediction_log(spark, d)
    served = log.select("prediction_id", "ts", "user_id", "fraud_score", "model_version", F.col("props").alias("note"),
                        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@mail.example.org")).alias("contact"))
    entries = st.prediction_entries(served, F.col("ts"), F.col("user_id"), F.col("prediction_id"), F.col("fraud_score"), F.col("model_version"), F.col("prediction_id"))
    folder = derived_path(spark)
    chain = F.to_date("ts").cast("string")
    st.append_batch(entries.withColumn("chain_key", chain), folder, 0, "chain_key", ["ts", "prediction_id"], st.log_entry(F.col("chain_key")))
    out = st.comply(served, spark.read.parquet(f"{folder}/log"), cp.current_consent(consent_events(spark, d)))
    return out.select("prediction_id", "user_id", "fraud_score", "model_version", "note", "contact", "gdpr_compliant", "audit_logged")
