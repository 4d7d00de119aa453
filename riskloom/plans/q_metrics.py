"""Monitoring queries: counters, histograms and gauges of a stream, quality alerts of the last hour."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators.drift import LATENCY_BUCKETS, SCORE_BUCKETS
from riskloom.operators.ordering import materialize
from riskloom.plans import base
from riskloom.plans.q_monitor import EV_BASE
from riskloom.plans.q_stream import events_stream
from riskloom.plans.registry import query
from riskloom.session import derived_path
from riskloom.streaming import metrics as mt
from riskloom.streaming import ops as sm

FILES = 4
_RUNS: dict = {}


def requests(events):
    """The events as served requests."""
    code = F.when(F.col("event_type") == "error", 500).when(F.pmod("event_id", F.lit(50)) == 0, 404).otherwise(200)
    score = F.least(F.col("value") / 500.0, F.lit(1.0))
    return events.select("event_id", "ts", F.col("event_type").alias("model_version"), (score > 0.5).alias("fraud_prediction"), score.alias("fraud_score"), F.col("value").alias("inference_time_ms"),
                         F.concat(F.lit("/"), "event_type").alias("endpoint"), F.when(F.pmod("event_id", F.lit(3)) == 0, "POST").otherwise("GET").alias("method"), code.alias("status_code"),
                         F.when(code >= 500, "server").when(code >= 400, "client").alias("error_type"))


REQUESTS = """
rq AS (SELECT *, CASE WHEN status_code >= 500 THEN 'server' WHEN status_code >= 400 THEN 'client' END AS error_type FROM (
  SELECT event_id, ts, event_type AS model_version, least(value / 500.0, 1.0) > 0.5 AS fraud_prediction, least(value / 500.0, 1.0) AS fraud_score, value AS inference_time_ms,
    '/' || event_type AS endpoint, CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
    CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 50 = 0 THEN 404 ELSE 200 END AS status_code FROM events))"""


def streamed(spark, d) -> str:
    """The requests, replayed in four files one after the other; the metrics they leave."""
    key = (spark.sparkContext.applicationId, d.rstrip("/"))
    if key not in _RUNS:
        own, files, folder = requests(base.read(spark, d, "events")), derived_path(spark), derived_path(spark)
        for i in range(FILES):
            own.where(F.pmod("event_id", F.lit(FILES)) == i).coalesce(1).write.mode("append").parquet(files)
        source = sm.file_stream(spark, files, own.schema)
        mt.stream_metrics(source, folder, derived_path(spark)).awaitTermination()
        _RUNS[key] = folder
    return _RUNS[key]


def _histogram_sql(metric: str, col: str, bounds, labels: str) -> str:
    own = [f"SELECT '{metric}_bucket' AS metric, {labels} || ',le={float(b)}' AS labels, CAST(count(*) FILTER (WHERE {col} <= {float(b)}) AS DOUBLE) AS value FROM rq GROUP BY {labels}" for b in bounds]
    own += [f"SELECT '{metric}_bucket', {labels} || ',le=+Inf', CAST(count(*) AS DOUBLE) FROM rq GROUP BY {labels}", f"SELECT '{metric}_count', {labels}, CAST(count(*) AS DOUBLE) FROM rq GROUP BY {labels}",
            f"SELECT '{metric}_sum', {labels}, sum({col}) FROM rq GROUP BY {labels}"]
    return " UNION ALL ".join(own)


MODEL, ROUTE = "'model=' || model_version", "'endpoint=' || endpoint || ',method=' || method"


@query("stream_metric_values", "WITH " + REQUESTS.strip() + " " + " UNION ALL ".join([
    f"SELECT 'fraud_predictions_total' AS metric, {MODEL} || ',prediction=' || CASE WHEN fraud_prediction THEN 'fraud' ELSE 'legit' END AS labels, CAST(count(*) AS DOUBLE) AS value FROM rq GROUP BY 1, 2",
    f"SELECT 'api_requests_total', {ROUTE} || ',status_code=' || status_code, CAST(count(*) AS DOUBLE) FROM rq GROUP BY 1, 2",
    f"SELECT 'fraud_prediction_errors_total', {MODEL} || ',error_type=' || error_type, CAST(count(*) AS DOUBLE) FROM rq WHERE error_type IS NOT NULL GROUP BY 1, 2",
    "SELECT 'api_errors_total', 'endpoint=' || endpoint || ',error_type=' || error_type, CAST(count(*) AS DOUBLE) FROM rq WHERE error_type IS NOT NULL GROUP BY 1, 2",
    _histogram_sql("fraud_prediction_latency_ms", "inference_time_ms", LATENCY_BUCKETS, MODEL), _histogram_sql("fraud_prediction_scores", "fraud_score", SCORE_BUCKETS, MODEL),
    _histogram_sql("api_request_latency_ms", "inference_time_ms", mt.API_BUCKETS, ROUTE)]))
def stream_metric_values(spark, d):
    """DR-10 + SM-4: every counter and histogram series after the stream; the SQL counts the whole table."""
    return mt.values(spark, streamed(spark, d))


@query("stream_metric_gauges", "WITH " + REQUESTS.strip() + f""" SELECT {MODEL} AS labels, avg(fraud_score) AS fraud_score_mean, stddev_samp(fraud_score) AS fraud_score_std,
  avg(CAST(fraud_prediction AS DOUBLE)) AS fraud_rate, count(*) AS n FROM rq WHERE event_id % {FILES} = {FILES - 1} GROUP BY 1""")
def stream_metric_gauges(spark, d):
    """DR-12: gauges of the last micro-batch, which holds the last file."""
    return mt.last_gauges(spark, streamed(spark, d))


@query("request_totals", "WITH " + REQUESTS.strip() + """ SELECT endpoint, method, status_code, count(*) AS requests, count(error_type) AS errors FROM rq
  GROUP BY GROUPING SETS ((endpoint, method, status_code), (endpoint), (status_code), ())""")
def request_totals(spark, d):
    """DR-10: requests and errors over the monitor's groupings."""
    return mt.request_totals(requests(base.read(spark, d, "events")))


@query("stream_rolling_alerts", "WITH " + EV_BASE + """
SELECT event_id, event_type, roll_n, roll_mean, roll_std,
       coalesce(CASE WHEN roll_n >= 20 AND mean <> 0 THEN abs(roll_mean - mean) / abs(mean) END > 0.2, false) AS mean_alert,
       coalesce(CASE WHEN roll_n >= 20 AND stdev > 0 AND roll_std > 0 THEN abs(roll_std - stdev) / stdev END > 0.2, false) AS stdev_alert
FROM rl JOIN ev USING (event_type)""")
def stream_rolling_alerts(spark, d):
    """SM-3: mean and stdev alerts of the last 20 values per stream, from four files in time order with 19 rows of state."""
    e = base.read(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    profile = materialize(e.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("stdev")))
    files, folder = derived_path(spark), derived_path(spark)
    for part in range(FILES):
        e.where(F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(FILES - 1)) == part).coalesce(1).write.mode("append").parquet(files)
    sm.stream_rolling_drift(sm.file_stream(spark, files, e.schema), profile, folder, derived_path(spark)).awaitTermination()
    out = spark.read.parquet(f"{folder}/rolled")
    return out.select("event_id", "event_type", "roll_n", "roll_mean", "roll_std", "mean_alert", "stdev_alert")


ALERTS = """
al AS (SELECT ts, 'value' AS field, CASE WHEN value > 400 THEN 'critical' ELSE 'warning' END AS severity FROM events WHERE value > 100
  UNION ALL SELECT ts, 'user_id', 'warning' FROM events WHERE user_id % 7 = 0
  UNION ALL SELECT ts, 'props', 'info' FROM events WHERE event_id % 5 = 0
  UNION ALL SELECT ts, 'type_' || event_type, 'critical' FROM events WHERE event_type IN ('error', 'signup'))"""


@query("stream_quality_alerts", "WITH " + ALERTS.strip() + """,
w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE + INTERVAL 60 MINUTE AS window_end, field, severity FROM al CROSS JOIN range(12) r(k)),
f AS (SELECT window_end, field, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning FROM w GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY window_end ORDER BY n DESC, field) AS r FROM f)
SELECT window_end, CAST(sum(n) AS BIGINT) AS alerts, CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(warning) AS BIGINT) AS warning,
  string_agg(field || ':' || n, ',' ORDER BY r) FILTER (WHERE r <= 5) AS top_fields
FROM r WHERE window_end <= (SELECT max(ts) FROM al) - INTERVAL 10 MINUTE GROUP BY 1""")
def stream_quality_alerts(spark, d):
    """SM-2: quality alerts of the last 60 minutes, every 5 minutes, with the most frequent fields."""
    e = events_stream(spark, d)
    one = lambda hit, field, severity: F.when(hit, F.struct(field.alias("field"), severity.alias("severity")))
    found = F.array_compact(F.array(
        one(F.col("value") > 100, F.lit("value"), F.when(F.col("value") > 400, "critical").otherwise("warning")), one(F.pmod("user_id", F.lit(7)) == 0, F.lit("user_id"), F.lit("warning")),
        one(F.pmod("event_id", F.lit(5)) == 0, F.lit("props"), F.lit("info")), one(F.col("event_type").isin("error", "signup"), F.concat(F.lit("type_"), "event_type"), F.lit("critical"))))
    return sm.run_to_table(mt.quality_windows(e.select("ts", F.inline(found))), "quality-alerts")
