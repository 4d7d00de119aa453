"""Latency telemetry over request logs (PF-1 .. PF-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ordering import global_index, kth_values

# Average request > 200 ms, average inference > 150 ms, p99 > 500 ms, cache hit rate < 30 %,
# slow query threshold 100 ms, summary over the newest 1000 requests, batches of 32.
AVG_LIMIT, INFERENCE_LIMIT, P99_LIMIT, HIT_RATE_MIN, SLOW_MS, WINDOW_N, BATCH = 200.0, 150.0, 500.0, 0.30, 100.0, 1000, 32


def latest(log: DataFrame, n: int, ts: str = "ts", key: str = "prediction_id") -> DataFrame:
    """SL-2: newest n rows (top-k, TakeOrderedAndProject; the key breaks ties)."""
    return log.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


def latency_summary(log: DataFrame, col: str = "inference_time_ms", n: int = WINDOW_N) -> DataFrame:
    """PF-1 + WN-8: over the newest ``n`` requests -- mean, p95 = x[int(0.95 k)],
    p99 = x[int(0.99 k)], max and count (index percentiles, not interpolated)."""
    w = latest(log, n).select(col)
    ks = kth_values(w, col, {"p95": F.floor(F.col("n") * 0.95), "p99": F.floor(F.col("n") * 0.99)})
    agg = w.agg(F.avg(col).alias("avg_ms"), F.max(col).alias("max_ms"), F.count(col).alias("count"))
    return agg.crossJoin(ks.select(F.col("p95").alias("p95_ms"), F.col("p99").alias("p99_ms")))


# Rule name, severity and threshold of each bottleneck rule, in checking order.
BOTTLENECK_RULES = (
    ("high_latency", "warning", "avg_ms", AVG_LIMIT),
    ("slow_inference", "warning", "avg_inference_ms", INFERENCE_LIMIT),
    ("low_cache_hits", "info", "hit_rate", HIT_RATE_MIN),
    ("outlier_latency", "warning", "p99_ms", P99_LIMIT),
)


def bottlenecks(summary: DataFrame, inference: DataFrame, hit_rate: DataFrame) -> DataFrame:
    """PF-2: one row per triggered rule (type, severity, value, threshold).  Average
    and p99 request time, average inference time, cache hit rate (0..1)."""
    x = summary.crossJoin(inference).crossJoin(hit_rate)
    rules = [F.when(F.col(c) < limit if c == "hit_rate" else F.col(c) > limit,
                    F.struct(F.lit(name).alias("type"), F.lit(severity).alias("severity"), F.col(c).alias("value"), F.lit(limit).alias("threshold")))
             for name, severity, c, limit in BOTTLENECK_RULES]
    return x.select(F.explode(F.array_compact(F.array(*rules))).alias("b")).select("b.*")


def query_stats(log: DataFrame, key: str = "endpoint", col: str = "inference_time_ms", top: int = 10) -> DataFrame:
    """PF-3: per query count / total / avg / max; top by average."""
    g = log.groupBy(key).agg(F.count(F.lit(1)).alias("count"), F.sum(col).alias("total_ms"),
                             F.avg(col).alias("avg_ms"), F.max(col).alias("max_ms"))
    return g.orderBy(F.col("avg_ms").desc(), F.col(key)).limit(top)


def slow_queries(log: DataFrame, col: str = "inference_time_ms", n: int = 100) -> DataFrame:
    """PF-4: newest ``n`` requests slower than 100 ms."""
    return latest(log.where(F.col(col) > SLOW_MS), n)


def hit_rate(flags: DataFrame, new_col: str = "is_new") -> DataFrame:
    """PF-5: share of requests answered without re-scoring."""
    return flags.agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col(new_col)).alias("hits")) \
                .withColumn("hit_rate", F.when(F.col("requests") > 0, F.col("hits") / F.col("requests"))
                            .otherwise(F.lit(0.0)))


def batch_number(df: DataFrame, order_cols, size: int = BATCH) -> DataFrame:
    """PF-6: fixed-size batch numbers from the exact row position."""
    return global_index(df, order_cols, "_pos").withColumn("batch", F.floor(F.col("_pos") / size)).drop("_pos")
