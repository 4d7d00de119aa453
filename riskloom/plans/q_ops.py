"""Telemetry and model-registry queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from riskloom.operators import registry as rg
from riskloom.operators import telemetry as pf
from riskloom.plans import base
from riskloom.plans.q_eval import METRICS_LONG_SQL, metrics_long
from riskloom.plans.q_scoring import TTL_CTE, score_new_only
from riskloom.plans.registry import query
from riskloom.plans.sql_base import LOG_W

NEWEST_SQL = "(SELECT * FROM log ORDER BY ts DESC, prediction_id DESC LIMIT 1000)"
LAT_SQL = LOG_W.rstrip("\n") + f""",
lat AS (SELECT avg(inference_time_ms) AS avg_ms, max(inference_time_ms) AS max_ms, count(inference_time_ms) AS count,
               list_sort(list(inference_time_ms))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95_ms,
               list_sort(list(inference_time_ms))[CAST(floor(count(*) * 0.99) AS BIGINT) + 1] AS p99_ms
        FROM {NEWEST_SQL})
"""


@query("latency_percentiles", LAT_SQL + "SELECT * FROM lat")
def latency_percentiles(spark, d):
    """PF-1 + WN-8: newest 1000 requests -- mean, index p95/p99, max, count."""
    return pf.latency_summary(base.prediction_log(spark, d))


HIT_SQL = TTL_CTE.rstrip("\n") + """,
hr AS (SELECT count(*) AS requests, count(*) FILTER (WHERE NOT is_new) AS hits FROM walk),
hit AS (SELECT *, CASE WHEN requests > 0 THEN hits / requests ELSE 0.0 END AS hit_rate FROM hr)
"""


@query("cache_hit_rate", HIT_SQL + "SELECT requests, hits, hit_rate FROM hit")
def cache_hit_rate(spark, d):
    """PF-5: requests answered from the 600 s key cache (ML-11 flags)."""
    return pf.hit_rate(score_new_only(spark, d))


@query("bottleneck_rules", HIT_SQL.rstrip("\n") + ",\n" + LAT_SQL[len(LOG_W.rstrip("\n")) + 2:].strip("\n") + """,
inf AS (SELECT avg(inference_time_ms) AS avg_inference_ms FROM log)
SELECT * FROM (
  SELECT 'high_latency' AS type, 'warning' AS severity, avg_ms AS value, CAST(200.0 AS DOUBLE) AS threshold FROM lat WHERE avg_ms > 200.0
  UNION ALL SELECT 'slow_inference', 'warning', avg_inference_ms, 150.0 FROM inf WHERE avg_inference_ms > 150.0
  UNION ALL SELECT 'low_cache_hits', 'info', hit_rate, 0.30 FROM hit WHERE hit_rate < 0.30
  UNION ALL SELECT 'outlier_latency', 'warning', p99_ms, 500.0 FROM lat WHERE p99_ms > 500.0)""")
def bottleneck_rules(spark, d):
    """PF-2: all four rules."""
    log = base.prediction_log(spark, d)
    return pf.bottlenecks(pf.latency_summary(log), log.agg(F.avg("inference_time_ms").alias("avg_inference_ms")),
                          pf.hit_rate(score_new_only(spark, d)).select("hit_rate"))


@query("query_stats", LOG_W + """
SELECT endpoint, count(*) AS count, sum(inference_time_ms) AS total_ms, avg(inference_time_ms) AS avg_ms,
       max(inference_time_ms) AS max_ms
FROM log GROUP BY endpoint ORDER BY avg_ms DESC, endpoint LIMIT 10""")
def query_stats(spark, d):
    """PF-3: per endpoint stats, top 10 by average latency."""
    return pf.query_stats(base.prediction_log(spark, d))


@query("slow_queries", LOG_W + """
SELECT prediction_id, ts, endpoint, inference_time_ms FROM log WHERE inference_time_ms > 100
ORDER BY ts DESC, prediction_id DESC LIMIT 100""")
def slow_queries(spark, d):
    """PF-4: newest 100 requests slower than 100 ms."""
    return pf.slow_queries(base.prediction_log(spark, d)).select("prediction_id", "ts", "endpoint", "inference_time_ms")


@query("batch_numbers", LOG_W + """
SELECT prediction_id, (row_number() OVER (ORDER BY ts, prediction_id) - 1) // 32 AS batch FROM log""")
def batch_numbers(spark, d):
    """PF-6: batches of 32 in arrival order (exact positions, no global window)."""
    log = base.prediction_log(spark, d).select("prediction_id", "ts")
    return pf.batch_number(log, ["ts", "prediction_id"]).select("prediction_id", F.col("batch").cast("long"))


# ------------------------------------------------------------------ registry
MODEL_IDX = {"heuristic": 0, "hybrid": 1, "rule": 2}
T0 = dt.datetime(2024, 1, 1)
PROMOTE_AT = dt.datetime(2024, 2, 1)
ROLLBACK_AT = dt.datetime(2024, 3, 1)
ROLLBACK_TO = "hybrid_v0"
UNKNOWN = "hybrid_v99"          # asked for, never registered


def model_events(spark, d):
    """RG-1 + RG-2 + RG-5 events derived from the seed metric table: every
    (model, seed) registers a version; each model's best-F1 version is promoted;
    finally a rollback promotes ``hybrid_v0`` again."""
    long = metrics_long(spark, d)
    wide = long.groupBy("model", "seed").pivot("metric", ["f1", "precision", "recall", "accuracy"]).agg(F.first("value"))
    idx = F.create_map(*[x for k, v in MODEL_IDX.items() for x in (F.lit(k), F.lit(v))])
    versions = wide.select(F.concat("model", F.lit("_v"), F.col("seed").cast("string")).alias("version"),
                           F.col("model").alias("model_type"), "f1", "precision", "recall", "accuracy",
                           F.lit(None).cast("double").alias("roc_auc"),
                           (F.lit(T0) + F.make_dt_interval(F.col("seed"), idx[F.col("model")])).alias("ts"))
    regs = rg.register(versions)
    best = wide.groupBy("model").agg(F.max_by("seed", F.struct("f1", -F.col("seed"))).alias("seed")) \
               .select(F.concat("model", F.lit("_v"), F.col("seed").cast("string")).alias("version"),
                       (F.lit(PROMOTE_AT) + F.make_dt_interval(F.lit(0), idx[F.col("model")])).alias("ts"))
    back = spark.createDataFrame([(ROLLBACK_TO, ROLLBACK_AT), (UNKNOWN, ROLLBACK_AT)], "version string, ts timestamp")
    return regs.unionByName(rg.promote(regs, best.unionByName(back)))


EVENTS_SQL = METRICS_LONG_SQL.rstrip("\n") + """,
wide AS (SELECT model, seed, max(value) FILTER (WHERE metric = 'f1') AS f1,
                max(value) FILTER (WHERE metric = 'precision') AS precision,
                max(value) FILTER (WHERE metric = 'recall') AS recall,
                max(value) FILTER (WHERE metric = 'accuracy') AS accuracy FROM mlong GROUP BY model, seed),
regs AS (SELECT model || '_v' || CAST(seed AS VARCHAR) AS version, 'register' AS event, model AS model_type,
                coalesce(f1, 0.0) AS f1, coalesce(precision, 0.0) AS precision, coalesce(recall, 0.0) AS recall,
                CAST(0.0 AS DOUBLE) AS roc_auc, coalesce(accuracy, 0.0) AS accuracy,
                TIMESTAMP '2024-01-01' + to_days(CAST(seed AS INTEGER))
                  + to_hours(CASE model WHEN 'heuristic' THEN 0 WHEN 'hybrid' THEN 1 ELSE 2 END) AS ts FROM wide),
best AS (SELECT model || '_v' || CAST(arg_max(seed, (f1, -seed)) AS VARCHAR) AS version,
                TIMESTAMP '2024-02-01' + to_hours(CASE model WHEN 'heuristic' THEN 0 WHEN 'hybrid' THEN 1 ELSE 2 END) AS ts
         FROM wide GROUP BY model
         UNION ALL SELECT 'hybrid_v0', TIMESTAMP '2024-03-01'),
promos AS (SELECT best.version, best.ts FROM best JOIN regs USING (version)),
act AS (SELECT arg_max(version, (ts, version)) AS active_version FROM promos),
lp AS (SELECT version, max(ts) AS last_promoted FROM promos GROUP BY version),
de AS (SELECT lp.version, min(p.ts) AS deactivated_at FROM lp LEFT JOIN promos p ON p.ts > lp.last_promoted
       GROUP BY lp.version),
state AS (SELECT regs.version, model_type, f1, precision, recall, roc_auc, accuracy, regs.ts AS registered_at,
                 lp.last_promoted, regs.version = act.active_version AS is_active,
                 CASE WHEN regs.version <> act.active_version THEN de.deactivated_at END AS deactivated_at
          FROM regs LEFT JOIN lp USING (version) CROSS JOIN act LEFT JOIN de USING (version))
"""


def state(spark, d):
    return rg.registry_state(model_events(spark, d))


@query("model_registry_state", EVENTS_SQL + "SELECT * FROM state")
def model_registry_state(spark, d):
    """RG-1, RG-2, RG-5: versions with exactly one active (the rolled-back one)."""
    return state(spark, d)


@query("model_compare_versions", EVENTS_SQL + """
SELECT 'hybrid_v0' AS version_a, 'heuristic_v0' AS version_b, a.f1 AS f1_a, b.f1 AS f1_b, b.f1 - a.f1 AS f1_difference,
       CASE WHEN b.f1 > a.f1 THEN 'heuristic_v0' ELSE 'hybrid_v0' END AS better
FROM (SELECT f1 FROM state WHERE version = 'hybrid_v0') a CROSS JOIN (SELECT f1 FROM state WHERE version = 'heuristic_v0') b""")
def model_compare_versions(spark, d):
    """RG-4 / JN-9."""
    return rg.compare_versions(state(spark, d), "hybrid_v0", "heuristic_v0")


@query("newest_versions", EVENTS_SQL + """
SELECT version, model_type, registered_at FROM state ORDER BY registered_at DESC, version DESC LIMIT 3""")
def newest_versions(spark, d):
    """RG-3 / SL-2: newest three registered versions."""
    return state(spark, d).orderBy(F.col("registered_at").desc(), F.col("version").desc()).limit(3) \
                          .select("version", "model_type", "registered_at")


@query("rejected_promotions", EVENTS_SQL + """
SELECT version, 'rejected' AS event, ts FROM (SELECT version, ts FROM best UNION ALL SELECT 'hybrid_v99', TIMESTAMP '2024-03-01')
WHERE version NOT IN (SELECT version FROM regs)""")
def rejected_promotions(spark, d):
    """RG-2: a promotion of an unknown version is an error row, not a lost request."""
    return model_events(spark, d).where("event = 'rejected'").select("version", "event", "ts")
