"""Evaluation queries over the scored claims (test split unless stated)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import evaluate as ev
from riskloom.plans import base
from riskloom.plans.registry import query
from riskloom.plans.sql_base import SCORED_W

TEST_W = SCORED_W.rstrip("\n") + """,
test AS (SELECT * FROM scored WHERE split = 'test')
"""


def test_scored(spark, d) -> DataFrame:
    return base.scored(spark, d).where(F.col("split") == "test")


# --- seed-varied metric table ------------------------------------------------
# Three score columns act as models; each seed shifts scores by a deterministic
# per-claim offset in [-0.1, 0.1) before the 0.5 cut.
MODELS = {"hybrid": "fraud_score", "heuristic": "ml_score", "rule": "rule_score"}
SEEDS = range(5)


def seed_noise(claim_id, seed: int):
    return (F.pmod(claim_id * F.lit(7919) + F.lit(seed * 104729), F.lit(1000)) / F.lit(1000.0) - 0.5) * 0.2


def metrics_long(spark, d) -> DataFrame:
    """(model, seed, metric, value): one aggregation over the scored test claims
    (4 confusion counts per model x seed), then an unpivot of that one row."""
    t = test_scored(spark, d)
    y = F.col("fraud_label") == 1
    aggs = []
    for m, col in MODELS.items():
        for s in SEEDS:
            p = (F.col(col) + seed_noise(F.col("claim_id"), s)) > 0.5
            aggs += [F.count_if(y & p).alias(f"{m}|{s}|tp"), F.count_if(~y & p).alias(f"{m}|{s}|fp"),
                     F.count_if(y & ~p).alias(f"{m}|{s}|fn"), F.count_if(~y & ~p).alias(f"{m}|{s}|tn")]
    wide = t.agg(*aggs)
    long = wide.unpivot([], [c for c in wide.columns], "k", "v") \
        .select(F.split("k", r"\|").alias("p"), "v") \
        .select(F.col("p")[0].alias("model"), F.col("p")[1].cast("int").alias("seed"), F.col("p")[2].alias("c"), "v")
    counts = long.groupBy("model", "seed").pivot("c", ["tp", "fp", "fn", "tn"]).agg(F.first("v"))
    rates = ev.with_rates(counts)
    return rates.unpivot(["model", "seed"], ["accuracy", "precision", "recall", "f1"], "metric", "value")


METRICS_LONG_SQL = TEST_W.rstrip("\n") + """,
ms AS (SELECT model, CAST(seed AS INTEGER) AS seed FROM (VALUES ('hybrid'), ('heuristic'), ('rule')) m(model)
       CROSS JOIN range(5) s(seed)),
v AS (
  SELECT model, seed, fraud_label,
         (CASE model WHEN 'hybrid' THEN fraud_score WHEN 'heuristic' THEN ml_score ELSE rule_score END
          + ((((claim_id * 7919 + seed * 104729) % 1000) / 1000.0) - 0.5) * 0.2) > 0.5 AS p
  FROM test CROSS JOIN ms),
cnt AS (
  SELECT model, seed, count(*) FILTER (WHERE fraud_label = 1 AND p) AS tp,
         count(*) FILTER (WHERE fraud_label = 0 AND p) AS fp,
         count(*) FILTER (WHERE fraud_label = 1 AND NOT p) AS fn,
         count(*) FILTER (WHERE fraud_label = 0 AND NOT p) AS tn
  FROM v GROUP BY model, seed),
rt AS (
  SELECT model, seed,
         CASE WHEN tp + fp + fn + tn = 0 THEN 0.0 ELSE (tp + tn) / (tp + fp + fn + tn) END AS accuracy,
         CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall
  FROM cnt),
mlong AS (
  SELECT model, seed, metric, value FROM (
    SELECT model, seed, accuracy, precision, recall,
           CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END AS f1
    FROM rt) UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1)))
"""


@query("binary_metrics", TEST_W + """
SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END AS f1
FROM (
  SELECT tp, fp, fn, tn,
         CASE WHEN tp + fp + fn + tn = 0 THEN 0.0 ELSE (tp + tn) / (tp + fp + fn + tn) END AS accuracy,
         CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall
  FROM (SELECT count(*) FILTER (WHERE fraud_label = 1 AND fraud_prediction) AS tp,
               count(*) FILTER (WHERE fraud_label = 0 AND fraud_prediction) AS fp,
               count(*) FILTER (WHERE fraud_label = 1 AND NOT fraud_prediction) AS fn,
               count(*) FILTER (WHERE fraud_label = 0 AND NOT fraud_prediction) AS tn FROM test))""")
def binary_metrics(spark, d):
    """EV-1 on the test split."""
    return ev.binary_metrics(test_scored(spark, d), F.col("fraud_label"), F.col("fraud_prediction"))


@query("confusion_matrix", TEST_W + """
SELECT fraud_label AS label, CAST(fraud_prediction AS INTEGER) AS prediction, count(*) AS n
FROM test GROUP BY 1, 2""")
def confusion_matrix(spark, d):
    """EV-5."""
    return ev.confusion(test_scored(spark, d), "fraud_label", "fraud_prediction")


ROC_SQL = TEST_W.rstrip("\n") + """,
st AS (SELECT fraud_score AS score, sum(fraud_label) AS pos, count(*) - sum(fraud_label) AS neg
       FROM test GROUP BY fraud_score),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS ctp,
                sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cfp FROM st)
"""


@query("roc_auc_exact", ROC_SQL + """
SELECT CASE WHEN P = 0 OR N = 0 THEN NULL ELSE area / (P * N) END AS roc_auc,
       CASE WHEN P = 0 OR N = 0 THEN NULL ELSE ap / P END AS average_precision,
       CAST(P AS BIGINT) AS n_pos, CAST(N AS BIGINT) AS n_neg
FROM (SELECT sum(pos) AS P, sum(neg) AS N, sum(neg * (ctp - pos + pos / 2.0)) AS area,
             sum(pos * (ctp / (ctp + cfp))) AS ap FROM c)""")
def roc_auc_exact(spark, d):
    """EV-2 + EV-3 (exact, sklearn definitions) on the hybrid score."""
    return ev.roc_auc(test_scored(spark, d), "fraud_label", "fraud_score")


@query("average_precision_by_model", TEST_W.rstrip("\n") + """,
lng AS (SELECT 'hybrid' AS model, fraud_score AS score, fraud_label FROM test
        UNION ALL SELECT 'heuristic', ml_score, fraud_label FROM test
        UNION ALL SELECT 'rule', rule_score, fraud_label FROM test),
st AS (SELECT model, score, sum(fraud_label) AS pos, count(*) - sum(fraud_label) AS neg FROM lng GROUP BY model, score),
c AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS ctp,
                sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cfp FROM st)
SELECT model, CASE WHEN P = 0 OR N = 0 THEN NULL ELSE area / (P * N) END AS roc_auc,
       CASE WHEN P = 0 OR N = 0 THEN NULL ELSE ap / P END AS average_precision,
       CAST(P AS BIGINT) AS n_pos, CAST(N AS BIGINT) AS n_neg
FROM (SELECT model, sum(pos) AS P, sum(neg) AS N, sum(neg * (ctp - pos + pos / 2.0)) AS area,
             sum(pos * (ctp / (ctp + cfp))) AS ap FROM c GROUP BY model)""")
def average_precision_by_model(spark, d):
    """EV-2/EV-3 grouped by model (three score columns unpivoted)."""
    t = test_scored(spark, d)
    lng = t.select("fraud_label", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(c).alias("score")) for m, c in MODELS.items()])).alias("x")) \
        .select("x.model", "x.score", "fraud_label")
    return ev.roc_auc(lng, "fraud_label", "score", ["model"])


@query("roc_curve_points", ROC_SQL + """
SELECT score AS threshold, CASE WHEN N = 0 THEN 0.0 ELSE cfp / N END AS fpr,
       CASE WHEN P = 0 THEN 0.0 ELSE ctp / P END AS tpr
FROM c CROSS JOIN (SELECT sum(pos) AS P, sum(neg) AS N FROM st)""")
def roc_curve_points(spark, d):
    """EV-4."""
    return ev.roc_curve(test_scored(spark, d), "fraud_label", "fraud_score")


SWEEP_SQL = TEST_W.rstrip("\n") + """,
th AS (SELECT i, CAST(i * 5 AS DOUBLE) / 100.0 AS threshold FROM range(21) r(i)),
sw AS (
  SELECT threshold,
         (SELECT count(*) FROM test WHERE fraud_score >= threshold) AS flagged,
         (SELECT count(*) FROM test WHERE fraud_score >= threshold AND fraud_label = 1) AS tp,
         (SELECT count(*) FROM test) AS n_all,
         (SELECT count(*) FROM test WHERE fraud_label = 1) AS p_all
  FROM th),
cm AS (SELECT threshold, CASE WHEN n_all = 0 THEN 0.0 ELSE flagged / n_all END AS positive_rate,
              tp, flagged - tp AS fp, p_all - tp AS fn, n_all - p_all - (flagged - tp) AS tn FROM sw),
rt AS (SELECT *, CASE WHEN tp + fp + fn + tn = 0 THEN 0.0 ELSE (tp + tn) / (tp + fp + fn + tn) END AS accuracy,
              CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
              CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall FROM cm),
sweep AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END
                    AS f1 FROM rt)
"""


@query("threshold_sweep", SWEEP_SQL + "SELECT threshold, positive_rate, tp, fp, fn, tn, accuracy, precision, recall, f1 FROM sweep")
def threshold_sweep(spark, d):
    """EV-15 (21 thresholds, score >= t)."""
    return ev.threshold_sweep(test_scored(spark, d), "fraud_score", "fraud_label")


@query("threshold_pick", SWEEP_SQL + """
SELECT * FROM (
  SELECT 'balanced' AS use_case, arg_min(threshold, (-f1, threshold)) AS recommended_threshold,
         max(f1) AS metric_value FROM sweep
  UNION ALL SELECT 'conservative', arg_min(threshold, (-precision, threshold)), max(precision) FROM sweep
  UNION ALL SELECT 'aggressive', arg_min(threshold, (-recall, threshold)), max(recall) FROM sweep)""")
def threshold_pick(spark, d):
    """EV-16 for the three use cases (first maximum wins)."""
    sw = ev.threshold_sweep(test_scored(spark, d), "fraud_score", "fraud_label")
    return ev.pick_threshold(sw, "balanced").unionByName(ev.pick_threshold(sw, "conservative")) \
             .unionByName(ev.pick_threshold(sw, "aggressive"))


@query("routing_sweep", TEST_W.rstrip("\n") + """,
th AS (SELECT * FROM (VALUES (0.2), (0.3), (0.4), (0.5), (0.6), (0.7)) t(threshold))
SELECT CAST(threshold AS DOUBLE) AS threshold,
       CASE WHEN n = 0 THEN 0.0 ELSE esc / n END AS escalation_rate,
       CASE WHEN rp = 0 THEN 0.0 ELSE hit / rp END AS system_ring_recall,
       (1 - CASE WHEN n = 0 THEN 0.0 ELSE esc / n END) * 30.0 + CASE WHEN n = 0 THEN 0.0 ELSE esc / n END * 50.0
         AS system_mean_latency_ms
FROM (SELECT threshold, (SELECT count(*) FROM test) AS n,
             (SELECT count(*) FROM test WHERE ml_score > threshold) AS esc,
             (SELECT count(*) FROM test WHERE ml_score > threshold AND ring_id > 0 AND fraud_label = 1) AS rp,
             (SELECT count(*) FROM test WHERE ml_score > threshold AND ring_id > 0 AND fraud_label = 1
                AND fraud_score >= 0.5) AS hit
      FROM th)""")
def routing_sweep(spark, d):
    """EV-17: heuristic score routes, hybrid score decides on escalated claims."""
    return ev.routing_sweep(test_scored(spark, d), "ml_score", "fraud_score")


@query("ring_recall", TEST_W + """
SELECT ring_id, count(*) FILTER (WHERE fraud_label = 1) AS n_ring_fraud_claims,
       avg(CASE WHEN fraud_label = 1 THEN CAST(fraud_prediction AS INTEGER) END)::DOUBLE AS recall
FROM test WHERE ring_id > 0 GROUP BY ring_id""")
def ring_recall(spark, d):
    """EV-13 per ring."""
    return ev.ring_recall(test_scored(spark, d), "fraud_prediction")


@query("ring_recall_summary", TEST_W.rstrip("\n") + """,
r AS (SELECT ring_id, avg(CASE WHEN fraud_label = 1 THEN CAST(fraud_prediction AS INTEGER) END)::DOUBLE AS recall
      FROM test WHERE ring_id > 0 GROUP BY ring_id)
SELECT count(recall) AS n_rings, min(recall) AS min_recall, max(recall) AS max_recall,
       coalesce(avg(recall), 0.0) AS mean_recall,
       CASE WHEN count(recall) > 1 THEN stddev_samp(recall) ELSE 0.0 END AS std_recall,
       coalesce(max(recall) >= 0.9 AND min(recall) < 0.5, false) AS dominance_warning,
       coalesce(min(recall) > 0, false) AS consistent_across_rings
FROM r WHERE recall IS NOT NULL""")
def ring_recall_summary(spark, d):
    """EV-13 consistency summary."""
    return ev.ring_recall_summary(ev.ring_recall(test_scored(spark, d), "fraud_prediction"))


@query("ring_unit_recall", TEST_W.rstrip("\n") + """,
pd AS (SELECT doctor_id, count(*) AS n, count(*) FILTER (WHERE fraud_prediction) AS hit
       FROM test WHERE ring_id > 0 AND fraud_label = 1 GROUP BY doctor_id)
SELECT coalesce(sum(hit) / sum(n), 0.0) AS ring_claim_recall,
       coalesce(avg(CASE WHEN hit / n >= 0.5 THEN 1.0 ELSE 0.0 END), 0.0)::DOUBLE AS ring_doctor_recall,
       CAST(coalesce(sum(n), 0) AS BIGINT) AS n_ring_claims, count(*) AS n_ring_doctors FROM pd""")
def ring_unit_recall(spark, d):
    """EV-14."""
    return ev.ring_unit_recall(test_scored(spark, d), "fraud_prediction")


@query("seed_metrics_long", METRICS_LONG_SQL + "SELECT model, seed, metric, value FROM mlong")
def seed_metrics_long(spark, d):
    """ML-5 table form: per (model, seed) metrics of seed-shifted scores."""
    return metrics_long(spark, d)


@query("seed_summary_ci", METRICS_LONG_SQL + """
SELECT model, metric, mean, CASE WHEN n > 1 THEN std END AS std, n,
       mean - CASE WHEN n > 1 THEN 1.96 * std / sqrt(n) ELSE 0.0 END AS ci_low,
       mean + CASE WHEN n > 1 THEN 1.96 * std / sqrt(n) ELSE 0.0 END AS ci_high
FROM (SELECT model, metric, avg(value) AS mean, stddev_samp(value) AS std, count(value) AS n
      FROM mlong WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY model, metric)""")
def seed_summary_ci(spark, d):
    """EV-6 + EV-10."""
    return ev.seed_summary(metrics_long(spark, d))


@query("paired_effect_size", METRICS_LONG_SQL + """
SELECT 'hybrid' AS model_a, 'heuristic' AS model_b, 'f1' AS metric, n_seeds, mean_difference,
       CASE WHEN n_seeds < 2 THEN NULL WHEN sd_diff = 0 THEN 0.0 ELSE mean_difference / sd_diff END AS cohens_d_paired,
       CASE WHEN n_seeds < 2 THEN NULL WHEN sqrt((sd_a * sd_a + sd_b * sd_b) / 2.0) = 0 THEN 0.0
            ELSE mean_difference / sqrt((sd_a * sd_a + sd_b * sd_b) / 2.0) END AS cohens_d_pooled,
       CASE WHEN n_seeds < 2 OR sd_diff = 0 THEN NULL ELSE mean_difference / (sd_diff / sqrt(n_seeds)) END AS t_statistic,
       CASE WHEN n_seeds < 2 OR sd_diff = 0 THEN NULL ELSE 1.0 - (
         CASE WHEN (n_seeds - 1) % 2 = 0
              THEN sin(th) * (SELECT sum(exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4)) * pow(cos(th), 2 * k))
                              FROM range(0, (n_seeds - 1) // 2) r(k))
              WHEN n_seeds - 1 = 1 THEN 2 * th / pi()
              ELSE 2 / pi() * (th + sin(th) * (SELECT sum(1.0 / ((2 * k + 1) * exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1)
                                                                                   - k * ln(4))) * pow(cos(th), 2 * k + 1))
                                               FROM range(0, (n_seeds - 2) // 2 + 1) r(k))) END) END AS p_value,
       coalesce(CASE WHEN n_seeds < 2 OR sd_diff = 0 THEN NULL ELSE 1.0 - (
         CASE WHEN (n_seeds - 1) % 2 = 0
              THEN sin(th) * (SELECT sum(exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4)) * pow(cos(th), 2 * k))
                              FROM range(0, (n_seeds - 1) // 2) r(k))
              WHEN n_seeds - 1 = 1 THEN 2 * th / pi()
              ELSE 2 / pi() * (th + sin(th) * (SELECT sum(1.0 / ((2 * k + 1) * exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1)
                                                                                   - k * ln(4))) * pow(cos(th), 2 * k + 1))
                                               FROM range(0, (n_seeds - 2) // 2 + 1) r(k))) END) END < 0.05, false)
         AS significant
FROM (SELECT *, CASE WHEN n_seeds >= 2 AND sd_diff > 0
                     THEN atan(abs(mean_difference / (sd_diff / sqrt(n_seeds))) / sqrt(n_seeds - 1)) END AS th FROM (SELECT count(*) AS n_seeds, avg(a - b) AS mean_difference, stddev_samp(a - b) AS sd_diff,
             stddev_samp(a) AS sd_a, stddev_samp(b) AS sd_b
      FROM (SELECT seed, value AS a FROM mlong WHERE model = 'hybrid' AND metric = 'f1')
      JOIN (SELECT seed, value AS b FROM mlong WHERE model = 'heuristic' AND metric = 'f1') USING (seed)
      WHERE a IS NOT NULL AND b IS NOT NULL))""")
def paired_effect_size(spark, d):
    """EV-7, EV-8, EV-9 (t statistic) hybrid vs heuristic F1 over seeds."""
    return ev.paired_effect(metrics_long(spark, d), "hybrid", "heuristic", "f1")


@query("model_ranking", METRICS_LONG_SQL.rstrip("\n") + """,
per AS (SELECT model, metric, avg(value) AS value FROM mlong GROUP BY model, metric),
msc AS (SELECT model, avg(value) AS mean_score FROM per GROUP BY model)
SELECT per.model, metric, value,
       CAST(row_number() OVER (PARTITION BY metric ORDER BY value DESC, per.model) AS INTEGER) AS rank,
       mean_score, row_number() OVER (PARTITION BY metric ORDER BY value DESC, per.model) = 1 AS is_best_for_metric,
       (SELECT arg_min(model, (-mean_score, model)) FROM msc) AS best_overall
FROM per JOIN msc USING (model)""")
def model_ranking(spark, d):
    """EV-12 + WN-3."""
    return ev.rank_models(metrics_long(spark, d))


@query("best_model_by_metric", METRICS_LONG_SQL.rstrip("\n") + """,
per AS (SELECT model, avg(value) AS v FROM mlong WHERE metric = 'f1' GROUP BY model)
SELECT 'f1' AS metric, arg_min(model, (-v, model)) AS model, max(v) AS value FROM per""")
def best_model_by_metric(spark, d):
    """SL-7 / EV-18."""
    return ev.best_model(metrics_long(spark, d), "f1")
