"""Operational metrics from a stream (DR-10 .. DR-12, SM-2, SM-4).

Counters and histograms are deltas: a micro-batch is reduced to one row per series (metric and
labels) and written into its own folder, which a retried batch replaces.  A series' value is the sum
of its deltas, so it survives restarts, never falls and never counts a row twice.  Gauges are what the
last micro-batch says.  Histogram buckets are cumulative, as monitoring systems expect them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.drift import LATENCY_BUCKETS, SCORE_BUCKETS

# Bucket bounds of the request latency in milliseconds.
API_BUCKETS = (10, 50, 100, 250, 500, 1000, 2500)


def series(*pairs: tuple[str, Column | str]) -> Column:
    """Labels of a series as text: ``name=value`` joined by commas, in the order given."""
    return F.concat_ws(",", *[F.concat(F.lit(f"{k}="), v if isinstance(v, Column) else F.col(v)) for k, v in pairs])


def _histogram(metric: str, name: str, bounds: Sequence[float], labels: Sequence[tuple[str, str]]) -> list[Column]:
    """Rows of one histogram from grouped columns ``{name}_0 ...``, ``{name}_sum`` and ``n``."""
    out = [F.struct(F.lit(f"{metric}_bucket").alias("metric"), series(*labels, ("le", F.lit(str(float(b))))).alias("labels"), F.col(f"{name}_{i}").cast("double").alias("value")) for i, b in enumerate(bounds)]
    out.append(F.struct(F.lit(f"{metric}_bucket").alias("metric"), series(*labels, ("le", F.lit("+Inf"))).alias("labels"), F.col("n").cast("double").alias("value")))
    out.append(F.struct(F.lit(f"{metric}_count").alias("metric"), series(*labels).alias("labels"), F.col("n").cast("double").alias("value")))
    out.append(F.struct(F.lit(f"{metric}_sum").alias("metric"), series(*labels).alias("labels"), F.col(f"{name}_sum").alias("value")))
    return out


def deltas(batch: DataFrame) -> DataFrame:
    """``metric, labels, value`` of a batch of requests (model_version, fraud_prediction, fraud_score, inference_time_ms, endpoint,
    method, status_code, error_type; a null error_type is no error): predictions by model and class, requests by endpoint, method and status, errors by type, and
    histograms of prediction latency, score and request latency.  One pass; null values are in no bucket."""
    label = F.when(F.col("fraud_prediction"), "fraud").otherwise("legit")
    keys = ["model_version", label.alias("prediction"), "endpoint", "method", F.col("status_code").cast("string").alias("status_code"), "error_type"]
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, col, bounds in (("latency", "inference_time_ms", LATENCY_BUCKETS), ("score", "fraud_score", SCORE_BUCKETS), ("api", "inference_time_ms", API_BUCKETS)):
        aggs += [F.count_if(F.col(col) <= float(b)).alias(f"{name}_{i}") for i, b in enumerate(bounds)]
        aggs.append(F.coalesce(F.sum(F.col(col).cast("double")), F.lit(0.0)).alias(f"{name}_sum"))
    g = batch.groupBy(*keys).agg(*aggs)                # as many rows as there are label combinations
    count = lambda metric, labels: F.struct(F.lit(metric).alias("metric"), labels.alias("labels"), F.col("n").cast("double").alias("value"))
    model, route = [("model", "model_version")], [("endpoint", "endpoint"), ("method", "method")]
    rows = [count("fraud_predictions_total", series(*model, ("prediction", "prediction"))), count("api_requests_total", series(*route, ("status_code", "status_code")))]
    rows += _histogram("fraud_prediction_latency_ms", "latency", LATENCY_BUCKETS, model) + _histogram("fraud_prediction_scores", "score", SCORE_BUCKETS, model) + _histogram("api_request_latency_ms", "api", API_BUCKETS, route)
    failed = F.col("error_type").isNotNull()
    errors = [count("fraud_prediction_errors_total", series(*model, ("error_type", "error_type"))), count("api_errors_total", series(("endpoint", "endpoint"), ("error_type", "error_type")))]
    both = g.select(F.inline(F.array(*rows))).unionByName(g.where(failed).select(F.inline(F.array(*errors))))
    return both.groupBy("metric", "labels").agg(F.sum("value").alias("value"))


def gauges(batch: DataFrame) -> DataFrame:
    """DR-12 gauges of a batch: mean and standard deviation of the score and the flagged share, per model."""
    return batch.groupBy(series(("model", "model_version")).alias("labels")).agg(
        F.avg("fraud_score").alias("fraud_score_mean"), F.stddev_samp("fraud_score").alias("fraud_score_std"),
        F.avg(F.col("fraud_prediction").cast("double")).alias("fraud_rate"), F.count(F.lit(1)).alias("n"))


def stream_metrics(requests: DataFrame, folder: str, ckpt: str):
    """SM-4: run the stream to its end; every micro-batch leaves its deltas and gauges in ``folder``."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        own = batch.persist()
        deltas(own).write.mode("overwrite").parquet(f"{folder}/deltas/batch_id={batch_id}")
        gauges(own).write.mode("overwrite").parquet(f"{folder}/gauges/batch_id={batch_id}")
        own.unpersist()

    return requests.writeStream.option("checkpointLocation", ckpt).foreachBatch(sink).trigger(availableNow=True).start()


def values(spark: SparkSession, folder: str) -> DataFrame:
    """``metric, labels, value``: every counter and histogram series so far."""
    return spark.read.parquet(f"{folder}/deltas").groupBy("metric", "labels").agg(F.sum("value").alias("value"))


def last_gauges(spark: SparkSession, folder: str) -> DataFrame:
    """``labels, fraud_score_mean, fraud_score_std, fraud_rate, n``: each model's gauges in the last batch that had it."""
    g = spark.read.parquet(f"{folder}/gauges")
    last = F.max_by(F.struct("fraud_score_mean", "fraud_score_std", "fraud_rate", "n"), "batch_id").alias("g")
    return g.groupBy("labels").agg(last).select("labels", "g.*")


def request_totals(log: DataFrame) -> DataFrame:
    """DR-10 in batch form: requests and errors over every grouping a monitor asks for: by endpoint, method and
    status, by endpoint, and in all; null marks a label that is summed over."""
    return log.groupingSets([["endpoint", "method", "status_code"], ["endpoint"], ["status_code"], []], "endpoint", "method", "status_code").agg(
        F.count(F.lit(1)).alias("requests"), F.count("error_type").alias("errors"))


def quality_windows(alerts: DataFrame, delay: str = "10 minutes", minutes: int = 60, every: int = 5, top: int = 5) -> DataFrame:
    """SM-2: from alerts (ts, field, severity), for the last ``minutes`` and every ``every`` minutes: alerts, critical
    and warning ones, and the ``top`` fields with their counts (ties by name).

    Two stateful steps in a row: alerts per window and field, then fields per window; a window is given
    once, when the watermark has passed it."""
    per_field = (alerts.withWatermark("ts", delay).groupBy(F.window("ts", f"{minutes} minutes", f"{every} minutes").alias("w"), "field")
                 .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning")))
    # the end of a sliding window lies in one tumbling one
    again = F.window(F.window_time("w"), f"{every} minutes").alias("v")
    fields = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "field"))), 1, top)
    out = per_field.groupBy(again).agg(F.sum("n").alias("alerts"), F.sum("critical").alias("critical"), F.sum("warning").alias("warning"), fields.alias("fields"))
    return out.select(F.col("v.end").alias("window_end"), "alerts", "critical", "warning",
                      F.array_join(F.transform("fields", lambda x: F.concat(x["field"], F.lit(":"), (-x["neg"]).cast("string"))), ",").alias("top_fields"))
