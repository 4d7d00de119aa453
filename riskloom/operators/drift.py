"""Drift and operational monitoring (DR-1 .. DR-12).

Distribution checks reduce each period to a 10-row histogram in one
aggregation; divergences and decisions are computed on that tiny table.
The KS statistic uses the compressed per-value counts with exact running
totals (``ordering.running_totals``), never a global sort.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ordering import materialize, running_totals

# Score histogram edges are numpy's linspace(0, 1, 11) -- i * 0.1
# for the inner edges, last bin closed; divergence smoothing 1e-10; drift when
# KL > 0.15 or JS > 0.10 with at least 10 predictions per period.
BINS = 10
INNER_EDGES = [i * (1.0 / BINS) for i in range(1, BINS)]
EPS = 1e-10
KL_THRESHOLD, JS_THRESHOLD, MIN_ROWS = 0.15, 0.10, 10
SMALL_LAMBDA = 1.18
LATENCY_BUCKETS = (10, 25, 50, 100, 250, 500, 1000)
SCORE_BUCKETS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


def score_bin(x: Column) -> Column:
    """0-based bin of x in [0, 1] with numpy's edges (null outside the range)."""
    edges = F.array(*[F.lit(e) for e in INNER_EDGES])
    b = F.size(F.filter(edges, lambda e: e <= x))
    return F.when((x >= 0) & (x <= 1), b)


def score_histogram(df: DataFrame, score: str, period_col: str | None = None) -> DataFrame:
    """DR-1: normalised 10-bin histogram per period: (period, bin, n, p).
    Empty bins appear with n = 0 (bin spine)."""
    spark = df.sparkSession
    keys = [period_col] if period_col else []
    b = df.select(*keys, score_bin(F.col(score)).alias("bin")).where(F.col("bin").isNotNull())
    counts = b.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    spine = spark.range(BINS).select(F.col("id").cast("int").alias("bin"))
    if period_col:
        spine = counts.select(period_col).distinct().crossJoin(spine)   # periods x 10: tiny
    full = spine.join(counts, [*keys, "bin"], "left").fillna(0, ["n"])
    tot = full.groupBy(*keys).agg(F.sum("n").alias("total"))
    out = full.join(tot, keys) if keys else full.crossJoin(tot)
    return out.select(*keys, "bin", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total"))
                      .otherwise(F.lit(0.0)).alias("p"), "total")


def _smooth(p: Column, s: Column) -> Column:
    return (p + EPS) / s


def divergences(base_hist: DataFrame, cur_hist: DataFrame) -> DataFrame:
    """DR-2 + DR-3 on two histograms (bin, p): KL(P||Q) and JS with the
    reference's smoothing (epsilon added, renormalised; again inside JS's KL)."""
    j = base_hist.select("bin", F.col("p").alias("p")).join(cur_hist.select("bin", F.col("p").alias("q")), "bin")
    sums = j.agg(F.sum(F.col("p") + EPS).alias("sp"), F.sum(F.col("q") + EPS).alias("sq"))
    j = j.crossJoin(sums).select("bin", _smooth(F.col("p"), F.col("sp")).alias("p"),
                                 _smooth(F.col("q"), F.col("sq")).alias("q"))
    j = j.withColumn("m", (F.col("p") + F.col("q")) * 0.5)
    s2 = j.agg(F.sum(F.col("p") + EPS).alias("sp2"), F.sum(F.col("q") + EPS).alias("sq2"),
               F.sum(F.col("m") + EPS).alias("sm2"))
    j = j.crossJoin(s2)
    p2, q2, m2 = (_smooth(F.col("p"), F.col("sp2")), _smooth(F.col("q"), F.col("sq2")),
                  _smooth(F.col("m"), F.col("sm2")))
    return j.agg(
        F.sum(F.col("p") * (F.log(F.col("p")) - F.log(F.col("q")))).alias("kl_divergence"),
        (F.sum(p2 * (F.log(p2) - F.log(m2))) * 0.5 + F.sum(q2 * (F.log(q2) - F.log(m2))) * 0.5)
        .alias("js_divergence"))


def prediction_drift(log: DataFrame, as_of: dt.datetime, days: int = 7, ts: str = "ts",
                     score: str = "fraud_score") -> DataFrame:
    """DR-4: current = [as_of - days, as_of), baseline = the ``days`` before it
    (disjoint).  One row: counts, KL, JS, has_drift, drift_reason."""
    cur_lo = as_of - dt.timedelta(days=days)
    base_lo = as_of - dt.timedelta(days=2 * days)
    w = log.where((F.col(ts) >= F.lit(base_lo)) & (F.col(ts) < F.lit(as_of)))   # pushed to the scan
    w = w.withColumn("period", F.when(F.col(ts) >= F.lit(cur_lo), F.lit("current")).otherwise(F.lit("baseline")))
    # the 20-row histogram feeds several consumers: materialise it once so the
    # divergence arithmetic does not re-plan the log scan for every reference
    h = materialize(score_histogram(w, score, "period"))
    sizes = w.agg(F.count_if(F.col("period") == "baseline").alias("n_baseline"),
                  F.count_if(F.col("period") == "current").alias("n_current"))
    dv = divergences(h.where(F.col("period") == "baseline"), h.where(F.col("period") == "current"))
    r = sizes.crossJoin(dv)
    enough = (F.col("n_baseline") >= MIN_ROWS) & (F.col("n_current") >= MIN_ROWS)
    kl_d = F.col("kl_divergence") > KL_THRESHOLD
    js_d = F.col("js_divergence") > JS_THRESHOLD
    return r.select(
        F.lit(as_of).alias("as_of"), "n_baseline", "n_current",
        F.when(enough, F.col("kl_divergence")).alias("kl_divergence"),
        F.when(enough, F.col("js_divergence")).alias("js_divergence"),
        F.coalesce(enough & (kl_d | js_d), F.lit(False)).alias("has_drift"),
        F.when(~enough, F.lit("insufficient_data")).when(kl_d, F.lit("kl_divergence"))
         .when(js_d, F.lit("js_divergence")).otherwise(F.lit("none")).alias("drift_reason"))


def drift_alerts(drift: DataFrame) -> DataFrame:
    """DR-5: an alert row per drifting check."""
    return drift.where("has_drift").select(
        F.col("as_of").alias("ts"), F.lit("concept_drift").alias("drift_type"),
        F.lit("prediction_distribution").alias("drift_metric"), F.col("kl_divergence").alias("drift_score"),
        F.lit(KL_THRESHOLD).alias("threshold"), F.array(F.lit("fraud_score")).alias("affected_features"),
        F.lit("alert_sent").alias("action_taken"), F.lit(False).alias("resolved"))


def kolmogorov_p(lam: Column) -> Column:
    """Tail of the Kolmogorov distribution.  Its alternating series does not
    converge for small arguments, where the theta-function form is used."""
    def series(term, n):
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0.0), lambda acc, k: acc + term(k.cast("double")))
    tail = F.lit(2.0) * series(lambda k: F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam), 100)
    low = F.lit(1.0) - F.lit(math.sqrt(2 * math.pi)) / lam * series(
        lambda k: F.exp(-F.pow(2 * k - 1, F.lit(2.0)) * (math.pi ** 2 / 8) / (lam * lam)), 20)
    p = F.when(lam < SMALL_LAMBDA, low).otherwise(tail)
    return F.when(lam <= 0, F.lit(1.0)).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def ks_statistics(base: DataFrame, cur: DataFrame, cols: Sequence[str], min_rows: int = 5) -> DataFrame:
    """DR-6: two-sample KS statistic per feature (both samples > ``min_rows``),
    with the asymptotic Kolmogorov p-value.  Unpivot -> per (feature, value)
    counts of each side -> exact running totals per feature -> max |F1 - F2|."""
    def long(df, side):
        return df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols]))
            .alias("x")).select("x.feature", "x.value", F.lit(side).alias("side")).where("value IS NOT NULL")
    both = long(base, 1).unionByName(long(cur, 2))
    vc = both.groupBy("feature", "value").agg(F.count_if(F.col("side") == 1).alias("c1"),
                                              F.count_if(F.col("side") == 2).alias("c2"))
    rt = running_totals(vc, ["feature"], ["value"], ["c1", "c2"], totals="all_")
    d = rt.select("feature", "cum_c1", "cum_c2", F.col("all_c1").alias("n1"), F.col("all_c2").alias("n2")) \
          .groupBy("feature", "n1", "n2") \
          .agg(F.max(F.abs(F.col("cum_c1") / F.col("n1") - F.col("cum_c2") / F.col("n2"))).alias("ks_statistic"))
    en = F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))
    lam = F.sqrt(en) * F.col("ks_statistic")
    p = kolmogorov_p(lam)
    return d.where((F.col("n1") > min_rows) & (F.col("n2") > min_rows)) \
            .select("feature", F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"),
                    "ks_statistic", p.alias("p_value"))


# Retraining gates.
ACC_DROP, AUC_DROP, RATE_CHANGE = 0.02, 0.01, 0.30
MIN_ACCURACY, MIN_AUC, MIN_PRECISION, MAX_LATENCY_MS = 0.94, 0.99, 0.93, 200.0


def metric_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """DR-7: one-row frames (accuracy, roc_auc, fraud_rate) -> checks + overall."""
    b = baseline.select(*[F.col(c).alias(f"b_{c}") for c in ("accuracy", "roc_auc", "fraud_rate")])
    c = current.select(*[F.col(c).alias(f"c_{c}") for c in ("accuracy", "roc_auc", "fraud_rate")])
    j = b.crossJoin(c)
    acc_drop = F.col("b_accuracy") - F.col("c_accuracy")
    auc_drop = F.col("b_roc_auc") - F.col("c_roc_auc")
    rate_chg = F.when(F.col("b_fraud_rate") > 0,
                      F.abs(F.col("c_fraud_rate") - F.col("b_fraud_rate")) / F.col("b_fraud_rate")).otherwise(0.0)
    st = {"accuracy": acc_drop > ACC_DROP, "auc": auc_drop > AUC_DROP, "fraud_rate": rate_chg > RATE_CHANGE}
    out = j.select("*", acc_drop.alias("accuracy_change"), auc_drop.alias("auc_change"),
                   (rate_chg * 100).alias("fraud_rate_change_pct"),
                   *[F.when(v, F.lit("ALERT")).otherwise(F.lit("OK")).alias(f"{k}_status") for k, v in st.items()])
    overall = F.col("accuracy_status") == "ALERT"
    for k in ("auc_status", "fraud_rate_status"):
        overall = overall | (F.col(k) == "ALERT")
    return out.withColumn("overall_drift", overall) \
              .withColumn("recommendation", F.when(overall, F.lit("trigger_retraining"))
                          .otherwise(F.lit("continue_monitoring")))


def validate_metrics(metrics: DataFrame) -> DataFrame:
    """DR-8: accuracy / AUC / precision gates fail the model; latency above
    200 ms only lowers confidence to medium."""
    checks = {"accuracy": F.col("accuracy") >= MIN_ACCURACY, "auc": F.col("roc_auc") >= MIN_AUC,
              "precision": F.col("precision") >= MIN_PRECISION}
    passed = F.lit(True)
    for v in checks.values():
        passed = passed & F.coalesce(v, F.lit(False))
    lat_ok = F.coalesce(F.col("latency_ms") <= MAX_LATENCY_MS, F.lit(True))
    return metrics.select(
        "*", *[F.when(F.coalesce(v, F.lit(False)), F.lit("PASS")).otherwise(F.lit("FAIL")).alias(f"{k}_check")
               for k, v in checks.items()],
        F.when(lat_ok, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("latency_check"),
        passed.alias("passed"),
        F.when(~passed, F.lit("low")).when(~lat_ok, F.lit("medium")).otherwise(F.lit("high")).alias("confidence"))


def op_counters(log: DataFrame, window: str = "1 hour") -> DataFrame:
    """DR-10: prediction counts per (time window, model, predicted class)."""
    return log.groupBy(F.window("ts", window).alias("w"), "model_version",
                       F.when(F.col("fraud_prediction"), F.lit("fraud")).otherwise(F.lit("legitimate"))
                       .alias("prediction_class")) \
              .agg(F.count(F.lit(1)).alias("n")) \
              .select(F.col("w.start").alias("window_start"), "model_version", "prediction_class", "n")


def op_histogram(log: DataFrame, col: str, bounds: Sequence[float]) -> DataFrame:
    """DR-11: cumulative ``le`` buckets (+Inf), count and sum -- one aggregation."""
    aggs = [F.count_if(F.col(col) <= F.lit(float(b))).alias(f"le_{i}") for i, b in enumerate(bounds)]
    one = log.agg(*aggs, F.count(col).alias("le_inf"), F.coalesce(F.sum(col), F.lit(0.0)).alias("sum"))
    labels = [(f"le_{i}", str(float(b))) for i, b in enumerate(bounds)] + [("le_inf", "+Inf")]
    rows = F.array(*[F.struct(F.lit(lbl).alias("le"), F.col(c).alias("count")) for c, lbl in labels])
    return one.select(F.explode(rows).alias("b"), "sum").select("b.le", "b.count", "sum")


def op_gauges(log: DataFrame, as_of: dt.datetime) -> DataFrame:
    """DR-12: score mean / sample std over the log, positive rate in the last hour."""
    last_hour = (F.col("ts") >= F.lit(as_of - dt.timedelta(hours=1))) & (F.col("ts") < F.lit(as_of))
    return log.where(F.col("ts") < F.lit(as_of)).agg(
        F.avg("fraud_score").alias("fraud_score_mean"), F.stddev_samp("fraud_score").alias("fraud_score_std"),
        F.coalesce(F.avg(F.when(last_hour, F.col("fraud_prediction").cast("double"))), F.lit(0.0))
         .alias("fraud_rate_last_hour"),
        F.count_if(last_hour).alias("predictions_last_hour"))
