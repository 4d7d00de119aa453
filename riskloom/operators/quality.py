"""Data-quality checks as columns and aggregations (DQ-1 .. DQ-13).

Per-record alerts are ``array<struct<severity, check_type, field, message, value, threshold>>``
built with ``array_compact(array(when ...))``; summaries explode or size them.
Baselines are fitted once (one aggregation per feature, unpivoted) and
broadcast as a small table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.tiers import quality_grade, quality_trend
from riskloom.operators.ordering import kth_values, rolling_rows

# Z-score limit 3, IQR multiplier 1.5, drift threshold 20 % over the
# last 20 values; score penalties critical 20, warning 5, info 1 (clamped 0..100).
Z_LIMIT, IQR_MULT, DRIFT_THRESHOLD, DRIFT_WINDOW = 3.0, 1.5, 0.2, 20
PENALTY = {"critical": 20, "warning": 5, "info": 1}

ALERT_TYPE = ("struct<severity:string,check_type:string,field:string,message:string,"
              "value:double,threshold:string>")


def _long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])).alias("x")) \
        .select(*keep, "x.feature", "x.value")


def fit_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """DQ-1 + DQ-4: per feature mean, sample stdev, q1 = x[n//4], median = x[n//2],
    q3 = x[3n//4], iqr, min, max over non-null values; features with < 2 values skipped."""
    lg = _long(df, cols).where(F.col("value").isNotNull())
    basic = lg.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"),
                                      F.stddev_samp("value").alias("stdev"), F.min("value").alias("min"),
                                      F.max("value").alias("max"))
    ks = kth_values(lg, "value", {"q1": F.floor(F.col("n") / 4), "median": F.floor(F.col("n") / 2),
                                  "q3": F.floor(F.col("n") * 3 / 4)}, ["feature"]).drop("n")
    return basic.join(ks, "feature").where(F.col("n") >= 2) \
                .withColumn("iqr", F.col("q3") - F.col("q1"))


def _alert(severity: str, check: str, field: str, message: Column, value: Column, threshold: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check_type"), F.lit(field).alias("field"),
                    message.alias("message"), value.cast("double").alias("value"),
                    threshold.cast("string").alias("threshold"))


def anomaly_alerts(df: DataFrame, profile: DataFrame, cols: Sequence[str]) -> Column:
    """DQ-2 + DQ-3 as an alert-array column.  ``profile`` must already be
    joined (columns ``{feature}__mean`` etc., see ``attach_profile``)."""
    out = []
    for c in cols:
        v = F.col(c).cast("double")
        mean, sd = F.col(f"{c}__mean"), F.col(f"{c}__stdev")
        q1, q3, iqr = F.col(f"{c}__q1"), F.col(f"{c}__q3"), F.col(f"{c}__iqr")
        z = F.abs((v - mean) / sd)
        out.append(F.when(v.isNotNull() & (sd > 0) & (z > Z_LIMIT),
                          _alert("warning", "anomaly", c, F.format_string("Z-score anomaly detected: %.2f", z),
                                 v, F.lit(Z_LIMIT))))
        lo, hi = q1 - F.lit(IQR_MULT) * iqr, q3 + F.lit(IQR_MULT) * iqr
        out.append(F.when(v.isNotNull() & (iqr > 0) & ((v < lo) | (v > hi)),
                          _alert("warning", "anomaly", c, F.lit("IQR anomaly"), v,
                                 F.format_string("[%.2f, %.2f]", lo, hi))))
    return F.array(*out)


def attach_profile(df: DataFrame, profile: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Widen the per-feature profile to one row and broadcast it (size = #features)."""
    stats = ["mean", "stdev", "q1", "q3", "iqr", "median"]
    wide = profile.agg(*[F.max(F.when(F.col("feature") == c, F.col(s))).alias(f"{c}__{s}")
                         for c in cols for s in stats])
    return df.crossJoin(F.broadcast(wide))


@dataclass(frozen=True)
class Constraint:
    """DQ-6: plan-time constraint on one field."""
    field: str
    min: float | None = None
    max: float | None = None
    required: bool = False
    allowed: tuple | None = None


def constraint_alerts(spec: Sequence[Constraint], allowed_flags: Mapping[str, str] | None = None) -> Column:
    """DQ-8: required missing -> critical (no further checks on that field);
    below min / above max / not allowed -> warning.  ``allowed_flags`` maps a
    field to a boolean column telling whether its value is a learned category
    (see ``mark_allowed``)."""
    out = []
    for c in spec:
        v = F.col(c.field)
        present = v.isNotNull()
        if c.required:
            out.append(F.when(~present, _alert("critical", "missing", c.field, F.lit(f"Required field {c.field} missing"),
                                               F.lit(None), F.lit(None))))
        if c.min is not None:
            out.append(F.when(present & (v.cast("double") < c.min),
                              _alert("warning", "invalid", c.field, F.lit(f"{c.field} below minimum"),
                                     v, F.lit(c.min))))
        if c.max is not None:
            out.append(F.when(present & (v.cast("double") > c.max),
                              _alert("warning", "invalid", c.field, F.lit(f"{c.field} above maximum"),
                                     v, F.lit(c.max))))
        ok = None
        if c.allowed is not None:
            ok = v.cast("string").isin(*c.allowed)
        elif allowed_flags and c.field in allowed_flags:
            ok = F.coalesce(F.col(allowed_flags[c.field]), F.lit(False))
        if ok is not None:
            out.append(F.when(present & ~ok,
                              _alert("warning", "invalid", c.field, F.lit(f"{c.field} not in allowed values"),
                                     F.lit(None), F.lit(None))))
    return F.array(*out)


def learn_categories(df: DataFrame, col: str) -> DataFrame:
    """DQ-7: the distinct categories of a field (a table, never a collected list)."""
    return df.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias(f"{col}__category")).distinct()


def mark_allowed(df: DataFrame, col: str, categories: DataFrame) -> DataFrame:
    """Flag ``{col}__allowed``: the value is among the learned categories.  A
    left join on the category (AQE broadcasts it only when measured small)."""
    cats = categories.withColumn(f"{col}__allowed", F.lit(True))
    return df.join(cats, F.col(col).cast("string") == F.col(f"{col}__category"), "left").drop(f"{col}__category")


def quality_score(alerts: Column) -> Column:
    """DQ-9: 100 - 20/critical - 5/warning - 1/info, clamped to 0..100."""
    def cnt(sev):
        return F.size(F.filter(alerts, lambda a: a["severity"] == sev))
    s = F.lit(100) - F.lit(PENALTY["critical"]) * cnt("critical") - F.lit(PENALTY["warning"]) * cnt("warning") \
        - F.lit(PENALTY["info"]) * cnt("info")
    return F.least(F.greatest(s, F.lit(0)), F.lit(100))


def with_quality(df: DataFrame, *alert_arrays: Column) -> DataFrame:
    """Combine alert arrays (ST-3), drop empty slots, add score and severity counts."""
    alerts = F.array_compact(F.concat(*alert_arrays)) if alert_arrays else F.array().cast(f"array<{ALERT_TYPE}>")
    out = df.withColumn("alerts", alerts)
    return out.withColumn("quality_score", quality_score(F.col("alerts"))) \
              .withColumn("critical_alerts", F.size(F.filter("alerts", lambda a: a["severity"] == "critical"))) \
              .withColumn("warning_alerts", F.size(F.filter("alerts", lambda a: a["severity"] == "warning")))


def quality_summary(checked: DataFrame, recent_n: int = 100, order_col: str = "ts", top_k: int = 5) -> DataFrame:
    """DQ-10 + DQ-12: totals, average score overall and over the newest
    ``recent_n`` records (top-k by order, TakeOrderedAndProject), trend, grade,
    severity counts, most frequent alert fields."""
    tot = checked.agg(F.count(F.lit(1)).alias("total_records_checked"),
                      F.coalesce(F.avg("quality_score"), F.lit(100.0)).alias("avg_quality_score"),
                      F.coalesce(F.sum("critical_alerts"), F.lit(0)).cast("long").alias("critical_count"),
                      F.coalesce(F.sum("warning_alerts"), F.lit(0)).cast("long").alias("warning_count"))
    recent = checked.orderBy(F.col(order_col).desc(), F.col("record_id").desc()).limit(recent_n) \
                    .agg(F.coalesce(F.avg("quality_score"), F.lit(100.0)).alias("recent_avg_score"))
    fields = checked.select(F.explode("alerts").alias("a")).groupBy(F.col("a.field").alias("field")) \
                    .agg(F.count(F.lit(1)).alias("n")) \
                    .orderBy(F.col("n").desc(), F.col("field")).limit(top_k) \
                    .agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg_n"), "field"))).alias("t")) \
                    .select(F.transform("t", lambda x: x["field"]).alias("top_issue_fields"))
    return tot.crossJoin(recent).crossJoin(fields) \
              .withColumn("quality_trend", quality_trend(F.col("recent_avg_score"))) \
              .withColumn("grade", quality_grade(F.col("avg_quality_score")))


def rolling_drift(df: DataFrame, profile: DataFrame, stream_col: str, order_cols: Sequence[str], value_col: str,
                  k: int = DRIFT_WINDOW, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """DQ-5 + WN-2: with at least ``k`` values, the last-``k`` mean moving more
    than ``threshold`` (relative) from the baseline mean is a warning, and the
    sample stdev moving more than ``threshold`` is info.  ``profile`` has
    (stream_col, mean, stdev)."""
    r = rolling_rows(df, [stream_col], order_cols, value_col, k)
    r = r.join(F.broadcast(profile.select(stream_col, F.col("mean").alias("b_mean"),
                                          F.col("stdev").alias("b_stdev"))), stream_col)
    full = F.col("roll_n") >= k
    mean_shift = F.abs(F.col("roll_mean") - F.col("b_mean")) / F.abs(F.col("b_mean"))
    sd_shift = F.abs(F.col("roll_std") - F.col("b_stdev")) / F.col("b_stdev")
    return r.select(
        "*", F.when(full & (F.col("b_mean") != 0), mean_shift).alias("mean_shift"),
        F.when(full & (F.col("b_stdev") > 0) & (F.col("roll_std") > 0), sd_shift).alias("stdev_shift")) \
        .withColumn("mean_alert", F.coalesce(F.col("mean_shift") > threshold, F.lit(False))) \
        .withColumn("stdev_alert", F.coalesce(F.col("stdev_shift") > threshold, F.lit(False)))


def check_tables(claims: DataFrame, patients: DataFrame, key: str = "claim_id", fk: str = "patient_id",
                 label: str = "fraud_label", rate_bounds: tuple = (0.07, 0.20)) -> DataFrame:
    """DQ-13: expectation checks -- counts, unique ids, FK containment (anti
    join), null ids, label set and label-rate bounds.  One row of results."""
    base = claims.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_distinct_ids"),
                      F.count_if(F.col(key).isNull()).alias("null_ids"),
                      F.count_if(~F.col(label).isin(0, 1)).alias("bad_labels"),
                      F.avg(F.col(label).cast("double")).alias("label_rate"))
    orphans = claims.select(fk).join(patients.select(fk), fk, "left_anti").agg(F.count(F.lit(1)).alias("fk_orphans"))
    return base.crossJoin(orphans).withColumn(
        "passed", (F.col("n_rows") == F.col("n_distinct_ids")) & (F.col("null_ids") == 0) &
        (F.col("fk_orphans") == 0) & (F.col("bad_labels") == 0) &
        F.col("label_rate").between(rate_bounds[0], rate_bounds[1]))
