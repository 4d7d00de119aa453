"""Exact model evaluation as aggregations (EV-1 .. EV-18).

Curve metrics (ROC-AUC, average precision, ROC points) are computed on the
*compressed* score table -- one row per distinct score with positive and
negative counts -- whose cumulative counts come from the range-partitioned
running totals in ``ordering``.  No global sort, no approximation (Spark ML's
evaluator bins scores; sklearn's exact definitions are used here).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators.ordering import running_totals


def _div(a: Column, b: Column) -> Column:
    """Guarded division: 0 when the denominator is 0 (sklearn ``zero_division=0``)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def confusion_counts(df: DataFrame, label: Column, pred: Column, group_cols: Sequence[str] = ()) -> DataFrame:
    y, p = label.cast("boolean"), pred.cast("boolean")
    aggs = [F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
            F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")]
    return df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision = _div(tp, tp + fp)
    recall = _div(tp, tp + fn)
    return counts.select(
        "*",
        _div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"),
        F.when(precision + recall == 0, F.lit(0.0))
         .otherwise(F.lit(2.0) * precision * recall / (precision + recall)).alias("f1"))


def binary_metrics(df: DataFrame, label: Column, pred: Column, group_cols: Sequence[str] = ()) -> DataFrame:
    """EV-1: confusion counts, accuracy, precision, recall, F1 (0 on empty denominators)."""
    return with_rates(confusion_counts(df, label, pred, group_cols))


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """EV-5: long confusion matrix (label, prediction, count)."""
    return df.groupBy(F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("prediction")) \
             .agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, label: Column, pred: Column) -> DataFrame:
    """EV-5: precision, recall, F1 (0 on empty denominators) and support per class."""
    x = df.select(label.cast("int").alias("y"), pred.cast("int").alias("p"))
    one = x.agg(*[F.count_if(cond).alias(f"{n}{k}") for k in (0, 1) for n, cond in (
        ("tp", (F.col("y") == k) & (F.col("p") == k)), ("fp", (F.col("y") != k) & (F.col("p") == k)), ("fn", (F.col("y") == k) & (F.col("p") != k)))])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"tp{k}").alias("tp"), F.col(f"fp{k}").alias("fp"), F.col(f"fn{k}").alias("fn")) for k in (0, 1)])))
    r = rows.select("class", (F.col("tp") + F.col("fn")).alias("support"), _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    return r.withColumn("f1", _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def score_table(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with positive/negative counts and inclusive cumulative
    counts in *descending* score order (``ctp``, ``cfp``)."""
    group_cols = list(group_cols)
    y = F.col(label).cast("int")
    s = df.where(F.col(score).isNotNull()) \
          .groupBy(*group_cols, F.col(score).alias("score")) \
          .agg(F.sum(y).cast("long").alias("pos"), F.sum(1 - y).cast("long").alias("neg"))
    rt = running_totals(s, group_cols, [F.col("score").desc()], ["pos", "neg"])
    return rt.withColumnRenamed("cum_pos", "ctp").withColumnRenamed("cum_neg", "cfp")


def roc_auc(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """EV-2 + EV-3: exact ROC-AUC (trapezoid over distinct thresholds, ties
    counted half) and average precision (sum of recall steps times precision).
    Both null when only one class is present."""
    group_cols = list(group_cols)
    t = score_table(df, label, score, group_cols)
    aggs = [F.sum("pos").alias("P"), F.sum("neg").alias("N"),
            F.sum(F.col("neg") * (F.col("ctp") - F.col("pos") + F.col("pos") / 2.0)).alias("_area"),
            F.sum(F.col("pos") * (F.col("ctp") / (F.col("ctp") + F.col("cfp")))).alias("_ap")]
    g = t.groupBy(*group_cols).agg(*aggs) if group_cols else t.agg(*aggs)
    one_class = (F.col("P") == 0) | (F.col("N") == 0) | F.col("P").isNull()
    return g.select(*group_cols,
                    F.when(one_class, F.lit(None)).otherwise(F.col("_area") / (F.col("P") * F.col("N")))
                     .cast("double").alias("roc_auc"),
                    F.when(one_class, F.lit(None)).otherwise(F.col("_ap") / F.col("P"))
                     .cast("double").alias("average_precision"),
                    F.coalesce(F.col("P"), F.lit(0)).alias("n_pos"), F.coalesce(F.col("N"), F.lit(0)).alias("n_neg"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """EV-4: one ROC point per distinct threshold (no intermediate-point dropping)."""
    t = score_table(df, label, score)
    tot = t.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return t.crossJoin(F.broadcast(tot)).select(
        F.col("score").alias("threshold"),
        _div(F.col("cfp"), F.col("N")).alias("fpr"), _div(F.col("ctp"), F.col("P")).alias("tpr"))


# Sweep thresholds 0.00, 0.05, ..., 1.00 and routing thresholds 0.2 .. 0.7,
# stage latencies 30 ms (first model) and 50 ms (second model).
SWEEP_THRESHOLDS = [i / 100 for i in range(0, 101, 5)]
ROUTING_THRESHOLDS = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7]
STAGE1_MS, STAGE2_MS = 30.0, 50.0


def _bucket_at_or_below(score: Column, thresholds: Sequence[float]) -> Column:
    """Number of thresholds <= score (exact double comparisons)."""
    arr = F.array(*[F.lit(float(t)) for t in thresholds])
    return F.size(F.filter(arr, lambda t: t <= score))


def _bucket_below(score: Column, thresholds: Sequence[float]) -> Column:
    arr = F.array(*[F.lit(float(t)) for t in thresholds])
    return F.size(F.filter(arr, lambda t: t < score))


def _thresholds_df(spark, thresholds: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(t)) for i, t in enumerate(thresholds)], "i int, threshold double")


def threshold_sweep(df: DataFrame, score: str, label: str | None = "fraud_label",
                    thresholds: Sequence[float] = SWEEP_THRESHOLDS) -> DataFrame:
    """EV-15: per threshold t (score >= t is positive): positive rate and, with
    labels, tp/fp/fn/tn, precision, recall, F1, accuracy.

    Each row is counted once into the bucket of thresholds it clears; the
    per-threshold counts are suffix sums over at most ``len(thresholds)+1``
    buckets -- the data is never crossed with the threshold list.
    """
    spark = df.sparkSession
    k = _bucket_at_or_below(F.col(score), thresholds)
    y = F.col(label).cast("int") if label else F.lit(0)
    b = df.where(F.col(score).isNotNull()).groupBy(k.alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).cast("long").alias("pos"))
    th = _thresholds_df(spark, thresholds)
    # threshold i is cleared by rows with k >= i + 1: join the tiny bucket table to the tiny threshold table
    j = th.join(F.broadcast(b), F.col("k") >= F.col("i") + 1, "left")
    tot = b.agg(F.sum("n").alias("N_all"), F.sum("pos").alias("P_all"))
    g = j.groupBy("i", "threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("flagged"),
                                        F.coalesce(F.sum("pos"), F.lit(0)).alias("tp")) \
         .crossJoin(F.broadcast(tot))
    out = g.select("threshold",
                   _div(F.col("flagged"), F.col("N_all")).alias("positive_rate"),
                   F.col("tp").cast("long").alias("tp"),
                   (F.col("flagged") - F.col("tp")).cast("long").alias("fp"),
                   (F.col("P_all") - F.col("tp")).cast("long").alias("fn"),
                   (F.col("N_all") - F.col("P_all") - (F.col("flagged") - F.col("tp"))).cast("long").alias("tn"))
    if not label:
        return out.select("threshold", "positive_rate")
    return with_rates(out)


def pick_threshold(sweep: DataFrame, use_case: str = "balanced") -> DataFrame:
    """EV-16: conservative -> max precision, aggressive -> max recall, balanced -> max F1;
    the lowest threshold wins ties (first maximum)."""
    metric = {"conservative": "precision", "aggressive": "recall"}.get(use_case, "f1")
    best = sweep.agg(F.min_by(F.struct("threshold", metric), F.struct(-F.col(metric), F.col("threshold"))).alias("b"))
    return best.select(F.lit(use_case).alias("use_case"), F.col("b.threshold").alias("recommended_threshold"),
                       F.col(f"b.{metric}").alias("metric_value"))


def routing_sweep(df: DataFrame, stage1: str, stage2: str, label: str = "fraud_label", ring: str = "ring_id",
                  thresholds: Sequence[float] = ROUTING_THRESHOLDS, stage2_cut: float = 0.5) -> DataFrame:
    """EV-17: two-stage routing -- rows with stage-1 score > t escalate to stage 2.

    escalation_rate, ring recall of stage 2 (score >= cut) on escalated ring
    fraud, and blended latency (1-r)*30 + r*50 ms per threshold.
    """
    spark = df.sparkSession
    k = _bucket_below(F.col(stage1), thresholds)
    ringpos = (F.col(ring) > 0) & (F.col(label) == 1)
    b = df.groupBy(k.alias("k")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ringpos).alias("rp"),
        F.count_if(ringpos & (F.col(stage2) >= F.lit(stage2_cut))).alias("rp_hit"))
    th = _thresholds_df(spark, thresholds)
    tot = b.agg(F.sum("n").alias("N_all"))
    g = th.join(F.broadcast(b), F.col("k") >= F.col("i") + 1, "left") \
          .groupBy("i", "threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("esc"),
                                         F.coalesce(F.sum("rp"), F.lit(0)).alias("rp"),
                                         F.coalesce(F.sum("rp_hit"), F.lit(0)).alias("rp_hit")) \
          .crossJoin(F.broadcast(tot))
    rate = _div(F.col("esc"), F.col("N_all"))
    return g.select("threshold", rate.alias("escalation_rate"),
                    _div(F.col("rp_hit"), F.col("rp")).alias("system_ring_recall"),
                    ((F.lit(1.0) - rate) * STAGE1_MS + rate * STAGE2_MS).alias("system_mean_latency_ms"))


def ring_recall(df: DataFrame, pred: str, label: str = "fraud_label", ring: str = "ring_id") -> DataFrame:
    """EV-13 per ring: recall over the ring's fraudulent claims (null when none)."""
    y = F.col(label) == 1
    return df.where(F.col(ring) > 0).groupBy(ring).agg(
        F.count_if(y).alias("n_ring_fraud_claims"),
        F.avg(F.when(y, F.col(pred).cast("int").cast("double"))).alias("recall"))


def ring_recall_summary(per_ring: DataFrame) -> DataFrame:
    """EV-13 consistency: min, max, sample std, mean, dominance warning
    (max >= 0.9 and min < 0.5), consistent (min > 0)."""
    r = per_ring.where(F.col("recall").isNotNull())
    g = r.agg(F.count("recall").alias("n_rings"), F.min("recall").alias("min_recall"),
              F.max("recall").alias("max_recall"), F.avg("recall").alias("mean_recall"),
              F.stddev_samp("recall").alias("_sd"))
    return g.select("n_rings", "min_recall", "max_recall", F.coalesce("mean_recall", F.lit(0.0)).alias("mean_recall"),
                    F.when(F.col("n_rings") > 1, F.col("_sd")).otherwise(F.lit(0.0)).alias("std_recall"),
                    F.coalesce((F.col("max_recall") >= 0.9) & (F.col("min_recall") < 0.5), F.lit(False))
                     .alias("dominance_warning"),
                    F.coalesce(F.col("min_recall") > 0, F.lit(False)).alias("consistent_across_rings"))


def ring_unit_recall(df: DataFrame, pred: str, doctor: str = "doctor_id", label: str = "fraud_label",
                     ring: str = "ring_id", doctor_cut: float = 0.5) -> DataFrame:
    """EV-14: ring claim recall and ring doctor recall (a doctor counts when at
    least half of its ring fraud claims are flagged).  Two-level aggregation:
    per doctor partial results, then one row."""
    rp = df.where((F.col(ring) > 0) & (F.col(label) == 1))
    per_doc = rp.groupBy(doctor).agg(F.count(F.lit(1)).alias("n"),
                                     F.count_if(F.col(pred).cast("boolean")).alias("hit"))
    return per_doc.agg(
        F.coalesce(F.sum("hit") / F.sum("n"), F.lit(0.0)).alias("ring_claim_recall"),
        F.coalesce(F.avg(((F.col("hit") / F.col("n")) >= F.lit(doctor_cut)).cast("double")), F.lit(0.0))
         .alias("ring_doctor_recall"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_ring_claims"),
        F.count(F.lit(1)).alias("n_ring_doctors"))


def seed_summary(long: DataFrame) -> DataFrame:
    """EV-6 + EV-10: per (model, metric) over seeds -- mean, sample std, n and
    the 95% interval mean +- 1.96 s / sqrt(n) on finite values (n = 1 -> (m, m))."""
    v = long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    g = v.groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                         F.count("value").alias("n"))
    margin = F.when(F.col("n") > 1, F.lit(1.96) * F.col("std") / F.sqrt(F.col("n"))).otherwise(F.lit(0.0))
    return g.select("model", "metric", "mean", F.when(F.col("n") > 1, F.col("std")).alias("std"), "n",
                    (F.col("mean") - margin).alias("ci_low"), (F.col("mean") + margin).alias("ci_high"))


def paired_effect(long: DataFrame, model_a: str, model_b: str, metric: str) -> DataFrame:
    """EV-7 (paired Cohen's d), EV-8 (pooled-sd d), EV-9 (paired t statistic)
    between two models over shared seeds."""
    a = long.where((F.col("model") == model_a) & (F.col("metric") == metric)).select("seed", F.col("value").alias("a"))
    b = long.where((F.col("model") == model_b) & (F.col("metric") == metric)).select("seed", F.col("value").alias("b"))
    j = a.join(b, "seed").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    g = j.agg(F.count(F.lit(1)).alias("n_seeds"), F.avg(F.col("a") - F.col("b")).alias("mean_difference"),
              F.stddev_samp(F.col("a") - F.col("b")).alias("sd_diff"),
              F.stddev_samp("a").alias("sd_a"), F.stddev_samp("b").alias("sd_b"))
    enough = F.col("n_seeds") >= 2
    pooled = F.sqrt((F.col("sd_a") * F.col("sd_a") + F.col("sd_b") * F.col("sd_b")) / 2.0)
    return g.select(
        F.lit(model_a).alias("model_a"), F.lit(model_b).alias("model_b"), F.lit(metric).alias("metric"),
        "n_seeds", "mean_difference",
        F.when(~enough, F.lit(None)).when(F.col("sd_diff") == 0, F.lit(0.0))
         .otherwise(F.col("mean_difference") / F.col("sd_diff")).alias("cohens_d_paired"),
        F.when(~enough, F.lit(None)).when(pooled == 0, F.lit(0.0))
         .otherwise(F.col("mean_difference") / pooled).alias("cohens_d_pooled"),
        F.when(~enough | (F.col("sd_diff") == 0), F.lit(None))
         .otherwise(F.col("mean_difference") / (F.col("sd_diff") / F.sqrt(F.col("n_seeds")))).alias("t_statistic")) \
        .withColumn("p_value", F.when(F.col("t_statistic").isNull(), F.lit(None))
                    .otherwise(t_two_sided_p(F.col("t_statistic"), F.col("n_seeds") - 1))) \
        .withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def t_two_sided_p(t: Column, nu: Column) -> Column:
    """Two-sided p-value of Student's t with integer degrees of freedom ``nu``:
    1 - A(|t|, nu) with theta = atan(|t| / sqrt(nu)) and the finite series
      nu even: A = sin(theta) * sum_{k=0}^{(nu-2)/2} a_k cos^{2k}(theta),   a_k = a_{k-1} (2k-1)/(2k)
      nu odd:  A = 2/pi (theta + sin(theta) * sum_{k=0}^{(nu-3)/2} b_k cos^{2k+1}(theta)), b_k = b_{k-1} 2k/(2k+1)
    (nu = 1: A = 2 theta / pi)."""
    th = F.atan(F.abs(t) / F.sqrt(nu.cast("double")))
    c, sn = F.cos(th), F.sin(th)

    def series(last, ratio, power):
        init = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("s"))
        return F.aggregate(
            F.sequence(F.lit(0), last), init,
            lambda acc, k: F.struct(
                F.when(k == 0, F.lit(1.0)).otherwise(acc["a"] * ratio(k)).alias("a"),
                (acc["s"] + F.when(k == 0, F.lit(1.0)).otherwise(acc["a"] * ratio(k)) * F.pow(c, power(k))).alias("s")))["s"]

    even = sn * series(((nu - 2) / 2).cast("int"), lambda k: (2 * k - 1) / (2.0 * k), lambda k: 2 * k)
    odd = F.lit(2 / 3.141592653589793) * (th + sn * series(((nu - 3) / 2).cast("int"),
                                                          lambda k: (2.0 * k) / (2 * k + 1), lambda k: 2 * k + 1))
    a = F.when(nu % 2 == 0, even).when(nu == 1, th * F.lit(2 / 3.141592653589793)).otherwise(odd)
    return F.lit(1.0) - a


def rank_models(long: DataFrame) -> DataFrame:
    """WN-3 + EV-12: 1-based rank per metric by value (desc; model name breaks ties),
    mean score per model, best per metric and best overall."""
    per = long.groupBy("model", "metric").agg(F.avg("value").alias("value"))
    w = Window.partitionBy("metric").orderBy(F.col("value").desc(), F.col("model"))
    ranked = per.withColumn("rank", F.row_number().over(w))
    mean_score = per.groupBy("model").agg(F.avg("value").alias("mean_score"))
    best = mean_score.agg(F.min_by("model", F.struct(-F.col("mean_score"), F.col("model"))).alias("best_overall"))
    return ranked.join(mean_score, "model") \
                 .withColumn("is_best_for_metric", F.col("rank") == 1) \
                 .crossJoin(F.broadcast(best))


def best_model(long: DataFrame, metric: str) -> DataFrame:
    """SL-7 / EV-18: argmax model for a metric (name breaks ties)."""
    return long.where(F.col("metric") == metric).groupBy("model").agg(F.avg("value").alias("v")) \
               .agg(F.min_by(F.struct("model", "v"), F.struct(-F.col("v"), F.col("model"))).alias("b")) \
               .select(F.lit(metric).alias("metric"), F.col("b.model").alias("model"), F.col("b.v").alias("value"))
