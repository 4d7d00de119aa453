"""Stream metrics: retried batches count once, values never fall, gauges are the last batch's."""
import datetime as dt

from pyspark.sql import functions as F

from riskloom.session import derived_path
from riskloom.streaming import metrics as mt
from riskloom.streaming import ops as sm

SCHEMA = "model_version string, fraud_prediction boolean, fraud_score double, inference_time_ms double, endpoint string, method string, status_code int, error_type string"


def batch(spark, n, model="m", score=0.5, ms=30.0, status=200, error=None):
    return spark.createDataFrame([(model, score > 0.5, score, ms, "/p", "GET", status, error)] * n, SCHEMA)


def run(spark, files, folder, ckpt):
    mt.stream_metrics(sm.file_stream(spark, files, batch(spark, 1).schema), folder, ckpt).awaitTermination()
    return {(r.metric, r.labels): r.value for r in mt.values(spark, folder).collect()}


def test_restarts_and_retries(spark):
    files, folder, ckpt = derived_path(spark), derived_path(spark), derived_path(spark)
    batch(spark, 3).coalesce(1).write.mode("append").parquet(files)
    one = run(spark, files, folder, ckpt)
    assert run(spark, files, folder, ckpt) == one                          # a restart without new rows
    batch(spark, 2, score=0.9, ms=2000.0, status=500, error="server").coalesce(1).write.mode("append").parquet(files)
    two = run(spark, files, folder, ckpt)
    assert all(two[k] >= v for k, v in one.items())
    assert one["fraud_predictions_total", "model=m,prediction=legit"] == 3 == two["fraud_predictions_total", "model=m,prediction=legit"]
    assert two["api_requests_total", "endpoint=/p,method=GET,status_code=500"] == 2 == two["fraud_prediction_errors_total", "model=m,error_type=server"] == two["api_errors_total", "endpoint=/p,error_type=server"]
    assert two["fraud_prediction_latency_ms_bucket", "model=m,le=50.0"] == 3 and two["fraud_prediction_latency_ms_bucket", "model=m,le=+Inf"] == 5
    assert two["api_request_latency_ms_sum", "endpoint=/p,method=GET"] == 3 * 30 + 2 * 2000
    # the same micro-batch written again replaces its deltas
    mt.deltas(batch(spark, 2, score=0.9, ms=2000.0, status=500, error="server")).write.mode("overwrite").parquet(f"{folder}/deltas/batch_id=1")
    assert {(r.metric, r.labels): r.value for r in mt.values(spark, folder).collect()} == two
    g = mt.last_gauges(spark, folder).collect()
    assert len(g) == 1 and abs(g[0].fraud_score_mean - 0.9) < 1e-12 and g[0].fraud_rate == 1.0 and g[0].n == 2


def test_totals_over_groupings_and_empty(spark):
    both = batch(spark, 3).unionByName(batch(spark, 2, status=500, error="server"))
    got = {(r.endpoint, r.method, r.status_code): (r.requests, r.errors) for r in mt.request_totals(both).collect()}
    assert got[None, None, None] == (5, 2) and got["/p", None, None] == (5, 2) and got["/p", "GET", 500] == (2, 2) and got[None, None, 200] == (3, 0)
    assert mt.deltas(batch(spark, 0)).collect() == []


def test_quality_windows_equal_counting(spark):
    """Chained stateful steps against plain Python."""
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=7 * i), f"f{i % 7}", ["critical", "warning", "info"][i % 3]) for i in range(120)]
    files = derived_path(spark)
    for part in range(3):
        spark.createDataFrame(rows[40 * part:40 * part + 40], "ts timestamp, field string, severity string").coalesce(1).write.mode("append").parquet(files)
    stream = sm.file_stream(spark, files, spark.read.parquet(files).schema)
    out = {r.window_end: r for r in sm.run_to_table(mt.quality_windows(stream), "quality-test").collect()}
    last = rows[-1][0] - dt.timedelta(minutes=10)
    ends = [e for e in (start + dt.timedelta(minutes=5 * k) for k in range(1, 300)) if e <= last]
    for end in ends:
        own = [r for r in rows if end - dt.timedelta(minutes=60) <= r[0] < end]
        assert out[end].alerts == len(own) and out[end].critical == sum(r[2] == "critical" for r in own)
        count = {f: sum(r[1] == f for r in own) for _, f, _ in own}
        assert out[end].top_fields == ",".join(f"{f}:{n}" for f, n in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:5])
    assert set(out) == set(ends)


def test_rolling_stream_keeps_tails_only_and_forgets_silent_streams(spark):
    import random
    from riskloom.operators.quality import rolling_drift
    rng, start = random.Random(2), dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 4 else f"k{i % 3}", start + dt.timedelta(minutes=i), rng.random() * 100) for i in range(400)]
    rows += [(1000 + i, "hot", start + dt.timedelta(days=90, minutes=i), 1.0) for i in range(3)]
    schema, files, folder = "event_id long, event_type string, ts timestamp, value double", derived_path(spark), derived_path(spark)
    whole = spark.createDataFrame(rows, schema)
    profile = whole.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("stdev"))
    for a, b in ((0, 150), (150, 155), (155, 400), (400, 403)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(files)
    sm.stream_rolling_drift(sm.file_stream(spark, files, whole.schema), profile, folder, derived_path(spark)).awaitTermination()
    key = lambda r: (r.event_id, r.roll_n, round(r.roll_mean, 9), r.mean_alert, r.stdev_alert)
    got = sorted(map(key, spark.read.parquet(f"{folder}/rolled").collect()))
    assert got == sorted(map(key, rolling_drift(whole, profile, "event_type", ["ts", "event_id"], "value").collect()))
    tails = {r.batch_id: r.n for r in spark.read.parquet(f"{folder}/tail").groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    assert tails[2] == 4 * 19 and tails[3] == 19            # silent streams are gone
