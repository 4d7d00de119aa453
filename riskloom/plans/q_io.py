"""Sink round trips: write through each writer, read back, compare with the oracle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from riskloom.operators import graph as gr
from riskloom.plans import base
from riskloom.plans.q_eval import METRICS_LONG_SQL, metrics_long
from riskloom.plans.q_graph import edges_view, node_id_map
from riskloom.plans.registry import query
from riskloom.plans.sql_base import LOG_W, SCORED_W, SPLIT_W
from riskloom.sources import sinks
from riskloom.streaming.ops import _scratch

AS_OF = dt.datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


@query("prediction_log_recent", LOG_W + f"""
SELECT prediction_id, ts, model_version, fraud_score, inference_time_ms FROM log
WHERE ts >= {AS_OF_SQL} - INTERVAL 7 DAY AND ts < {AS_OF_SQL}""")
def prediction_log_recent(spark, d):
    """SO-10 + SO-9: the log appended partitioned by date, then the last 7 days
    read back (date partitions pruned before the timestamp filter)."""
    path = _scratch(spark, "predlog")
    sinks.append_predictions(base.prediction_log(spark, d), path)
    r = sinks.recent_predictions(spark, path, AS_OF, 7)
    return r.select("prediction_id", "ts", "model_version", "fraud_score", "inference_time_ms")


@query("export_csv_roundtrip", LOG_W + """
SELECT prediction_id, ts, NULL::BIGINT AS claim_id, fraud_score, fraud_prediction, model_version, inference_time_ms
FROM log""")
def export_csv_roundtrip(spark, d):
    """SO-11: the 7-column CSV export (missing -> empty) read back with types."""
    path = _scratch(spark, "export")
    sinks.export_csv(base.prediction_log(spark, d), path)
    schema = ("prediction_id long, ts timestamp, claim_id long, fraud_score double, fraud_prediction boolean, "
              "model_version string, inference_time_ms double")
    return spark.read.schema(schema).option("header", True).csv(path)


@query("export_json_manifest", LOG_W + f"SELECT count(*) AS count, {AS_OF_SQL} AS exported_at FROM log")
def export_json_manifest(spark, d):
    """SO-12: JSON export with its manifest, read back."""
    path = _scratch(spark, "jsonexport")
    sinks.export_json(base.prediction_log(spark, d), path, AS_OF)
    return spark.read.schema("count long, exported_at timestamp").json(f"{path}/manifest")


@query("alerts_jsonl_latest", SCORED_W + """
SELECT claim_id, fraud_score AS fraud_probability,
       CASE WHEN fraud_score >= 0.75 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level,
       CASE WHEN fraud_score >= 0.75 THEN 'BLOCK_AND_REVIEW' ELSE 'MANUAL_REVIEW' END AS recommended_action
FROM scored WHERE fraud_score >= 0.45 ORDER BY claim_date DESC, claim_id DESC LIMIT 50""")
def alerts_jsonl_latest(spark, d):
    """SO-4 + SO-3: alerts appended as JSON lines (one append per day of
    claims, the claim date as alert time), the newest 50 read back."""
    path = _scratch(spark, "alerts")
    sc = base.scored(spark, d).withColumn("ts", F.col("claim_date").cast("timestamp"))
    from riskloom.functions.tiers import alert_action, alert_level
    s = F.col("fraud_score")
    sc.where(alert_level(s) != "LOW").select(
        "claim_id", s.alias("fraud_probability"), alert_level(s).alias("risk_level"),
        alert_action(s).alias("recommended_action"), "ts").write.mode("append").json(path)
    return sinks.read_alerts(spark, path, 50).drop("ts")


@query("features_partitioned", SPLIT_W + "SELECT split, count(*) AS n FROM split GROUP BY split")
def features_partitioned(spark, d):
    """SO-5 + SO-6: the feature table written partitioned by split with a vector
    column; counts read back per partition."""
    path = _scratch(spark, "features")
    f = base.features(spark, d)
    sinks.write_features(f.select("claim_id", "split", "claim_amount", "num_procedures", "days_in_hospital"),
                         path, ["claim_amount", "num_procedures", "days_in_hospital"])
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("metrics_json_roundtrip", METRICS_LONG_SQL + "SELECT model, seed, metric, value FROM mlong")
def metrics_json_roundtrip(spark, d):
    """SO-7 + SO-8: the seed metric table as JSON (non-finite -> null) and CSV, read back."""
    path = _scratch(spark, "metrics")
    long = metrics_long(spark, d)
    sinks.write_metrics(long, path + "/m.json")
    sinks.write_results(long, path + "/m.csv")
    return sinks.read_metrics(spark, path + "/m.json", "model string, seed int, metric string, value double")


@query("graph_files_verified", """
SELECT * FROM (VALUES ('edges', true, true, CAST([] AS VARCHAR[])), ('id_maps', true, true, []), ('rings', true, true, []),
  ('missing', false, false, ['x'])) t(output, "exists", has_rows, missing)""")
def graph_files_verified(spark, d):
    """SO-14 + SO-18: graph written (edges by relation, id maps, rings), then
    checked for existence, rows and required columns."""
    path = _scratch(spark, "graph")
    e = edges_view(spark, d)
    ids = node_id_map(spark, d)
    rings = gr.ring_members(base.claims(spark, d))
    sinks.write_graph(e, ids, rings, path)
    return sinks.verify_outputs(spark, {
        "edges": (f"{path}/edges", ["src", "dst", "relation"]),
        "id_maps": (f"{path}/id_maps", ["id", "idx", "node_type"]),
        "rings": (f"{path}/rings", ["ring_id", "claim_id"]),
        "missing": (f"{path}/does_not_exist", ["x"])})
