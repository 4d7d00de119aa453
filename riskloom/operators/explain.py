"""Explanations as tables (IX-1 .. IX-12, WN-4 .. WN-6, WN-10, AG-13).

Attributions are a long table ``(prediction_id, feature, value, importance)``.
Per-prediction work is windowed by prediction id (bounded by the feature
count); dataset-wide statistics are aggregates broadcast as one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators.ordering import running_totals


def label_correlation(df: DataFrame, cols: Sequence[str], label: str = "fraud_label") -> DataFrame:
    """AG-13: Pearson correlation of each column with the label, in one aggregation
    -> long (feature, corr)."""
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in cols])
    return one.unpivot([], list(cols), "feature", "corr")


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AG-13: Pearson correlation of every two columns, in one aggregation -> (feature1, feature2, corr)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    cell = lambda a, b, c: F.struct(F.lit(a).alias("feature1"), F.lit(b).alias("feature2"), F.col(f"`{c}`").alias("corr"))
    rows = [cell(a, b, f"{a}|{b}") for a, b in pairs] + [cell(b, a, f"{a}|{b}") for a, b in pairs if a != b]
    return one.select(F.inline(F.array(*rows)))


def attribution_stats(train: DataFrame, cols: Sequence[str], weights: DataFrame) -> DataFrame:
    """One row: training mean ``m_``, population std ``s_`` (zero or null: 1) and
    weight ``w_`` (missing: 0) of each feature.  ``weights`` is (feature, w)."""
    stats = train.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in cols],
                      *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in cols])
    stats = stats.withColumns({f"s_{c}": F.when(F.coalesce(F.col(f"s_{c}"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(f"s_{c}")) for c in cols})
    return stats.crossJoin(weights.agg(*[F.coalesce(F.max(F.when(F.col("feature") == c, F.col("w"))), F.lit(0.0)).alias(f"w_{c}") for c in cols]))


def linear_attributions(df: DataFrame, key: str, cols: Sequence[str], stats: DataFrame) -> DataFrame:
    """IX-14 re-aimed: exact linear attribution ``w_f * (x_f - mean_f) / std_f`` with the
    training statistics (one row of ``attribution_stats``).  One row per
    prediction: ``prediction_id, parts array<struct<feature,value,importance>>``;
    everything below works inside this row, so no explanation needs a shuffle."""
    x = df.crossJoin(F.broadcast(stats))
    parts = []
    for c in cols:
        v = F.col(c).cast("double")
        parts.append(F.struct(F.lit(c).alias("feature"), v.alias("value"), (F.col(f"w_{c}") * (v - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias("importance")))
    return x.select(F.col(key).alias("prediction_id"), F.array(*parts).alias("parts"))


def attribution_rows(wide: DataFrame) -> DataFrame:
    """(prediction_id, feature, value, importance)."""
    return wide.select("prediction_id", F.inline("parts"))


def _ranked(parts: Column, field: str) -> Column:
    """Parts by decreasing absolute ``field``, then feature name; nulls last."""
    size = lambda t: F.coalesce(F.abs(t[field]), F.lit(-1.0))
    return F.array_sort(parts, lambda x, y: F.when(size(x) > size(y), -1).when(size(x) < size(y), 1)
                        .when(x["feature"] < y["feature"], -1).when(x["feature"] > y["feature"], 1).otherwise(0))


def scaled_attribution(wide: DataFrame, baseline: DataFrame) -> DataFrame:
    """IX-1: importance / sum |importance| (0 -> 1) times the span of the
    baseline score (1 - b when b < 0.5, else b).  ``baseline``: (prediction_id, baseline)."""
    b = F.col("baseline")
    span = F.when(b < 0.5, F.lit(1.0) - b).otherwise(b)
    total = F.aggregate("parts", F.lit(0.0), lambda acc, t: acc + F.coalesce(F.abs(t["importance"]), F.lit(0.0)))
    x = wide.join(baseline, "prediction_id").withColumn("_scale", span / F.when(total == 0, F.lit(1.0)).otherwise(total))
    return x.select("prediction_id", F.transform("parts", lambda t: F.struct(
        t["feature"], t["value"], (t["importance"] * F.col("_scale")).alias("shap_value"))).alias("parts"))


def contribution_breakdown(scaled: DataFrame) -> DataFrame:
    """IX-2 + WN-4: rank by |shap| (desc, feature name breaks ties), running
    sum of |shap|, direction."""
    x = scaled.withColumn("parts", _ranked(F.col("parts"), "shap_value"))
    rows = F.transform("parts", lambda t, i: F.struct(
        t["feature"], t["value"], t["shap_value"], (i + 1).cast("int").alias("rank"),
        F.aggregate(F.slice("parts", 1, i + 1), F.lit(0.0), lambda acc, u: acc + F.abs(u["shap_value"])).alias("cumulative_contribution"),
        F.when(t["shap_value"] > 0, F.lit("increases fraud")).otherwise(F.lit("decreases fraud")).alias("direction")))
    return x.select("prediction_id", F.inline(rows))


def top_parts(wide: DataFrame, k: int = 5) -> DataFrame:
    """WN-5: the ``k`` parts of largest |importance| (name breaks ties), in order."""
    return wide.withColumn("parts", F.slice(_ranked(F.col("parts"), "importance"), 1, k))


def top_contributions(wide: DataFrame, k: int = 5) -> DataFrame:
    """WN-5 as rows: (prediction_id, feature, value, importance, rank)."""
    ranked = F.transform("parts", lambda t, i: F.struct(t["feature"], t["value"], t["importance"], (i + 1).cast("int").alias("rank")))
    return top_parts(wide, k).select("prediction_id", F.inline(ranked))


def partial_dependence(df: DataFrame, feature: str, pred: str, max_bins: int = 10) -> DataFrame:
    """IX-3: up to 10 equal-width bins over [min, max]; bin mid-point, mean
    prediction, count; a constant feature gives a single point."""
    # only whether there are max_bins distinct values matters: a distinct limit, not a full count
    few = df.where(F.col(feature).isNotNull()).select(feature).distinct().limit(max_bins).agg(F.count(F.lit(1)).alias("nd"))
    st = df.agg(F.min(feature).alias("lo"), F.max(feature).alias("hi"), F.avg(pred).alias("all_avg"), F.count(pred).alias("all_n")).crossJoin(few)
    nb = F.least(F.lit(max_bins), F.col("nd"))
    width = (F.col("hi") - F.col("lo")) / nb
    x = df.where(F.col(feature).isNotNull()).crossJoin(F.broadcast(st))
    b = F.least(F.floor((F.col(feature) - F.col("lo")) / width), nb - 1)
    g = x.where(F.col("hi") > F.col("lo")).groupBy(b.alias("bin"), "lo", "hi", "nd") \
         .agg(F.avg(pred).alias("avg_prediction"), F.count(F.lit(1)).alias("sample_count"))
    wd = (F.col("hi") - F.col("lo")) / F.least(F.lit(max_bins), F.col("nd"))
    start = F.col("lo") + F.col("bin") * wd
    binned = g.select(F.col("bin").cast("int").alias("bin"), ((start + (start + wd)) / 2).alias("feature_value"),
                      "avg_prediction", "sample_count")
    const = st.where(F.col("hi") == F.col("lo")).select(F.lit(0).alias("bin"), F.col("lo").alias("feature_value"),
                                                         F.col("all_avg").alias("avg_prediction"),
                                                         F.col("all_n").alias("sample_count"))
    return binned.unionByName(const)


def range_impact(df: DataFrame, feature: str, pred: str) -> DataFrame:
    """IX-4 / WN-10: mean prediction of the lowest quarter vs the highest quarter
    of rows sorted by (feature, prediction) -- exact, via running counts over
    the compressed (feature, prediction) pairs."""
    pairs = df.where(F.col(feature).isNotNull() & F.col(pred).isNotNull()) \
              .groupBy(F.col(feature).alias("f"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    rt = running_totals(pairs, [], ["f", "p"], ["c"], totals="all_").withColumnRenamed("all_c", "n")
    x = rt.withColumn("q1", F.floor(F.col("n") / 4)).withColumn("q3", F.floor(F.col("n") * 3 / 4))
    before = F.col("cum_c") - F.col("c")
    low_k = F.greatest(F.least(F.col("c"), F.col("q1") - before), F.lit(0))
    high_k = F.greatest(F.least(F.col("c"), F.col("cum_c") - F.col("q3")), F.lit(0))
    g = x.agg(F.sum(F.col("p") * low_k).alias("ls"), F.sum(low_k).alias("ln"),
              F.sum(F.col("p") * high_k).alias("hs"), F.sum(high_k).alias("hn"))
    low = F.when(F.col("ln") > 0, F.col("ls") / F.col("ln"))
    high = F.when(F.col("hn") > 0, F.col("hs") / F.col("hn"))
    return g.select(F.lit(feature).alias("feature"), F.coalesce(low, F.lit(0.0)).alias("low_range_avg_prediction"),
                    F.coalesce(high, F.lit(0.0)).alias("high_range_avg_prediction"),
                    F.when(low.isNotNull() & high.isNotNull(), high - low).otherwise(F.lit(0.0)).alias("impact"))


def interactions(wide: DataFrame, k: int = 5, min_strength: float = 0.01) -> DataFrame:
    """IX-5: pairs among each prediction's top-k features (by |importance|):
    strength = i1*i2 / (max(|i1|, |i2|) + 1e-4), kept when |strength| > 0.01.
    At most k(k-1)/2 pairs per prediction, made inside its row."""
    pairs = F.flatten(F.transform("parts", lambda x, i: F.transform(F.slice("parts", i + 2, k), lambda y: F.struct(
        x["feature"].alias("feature1"), y["feature"].alias("feature2"),
        (x["importance"] * y["importance"] / (F.greatest(F.abs(x["importance"]), F.abs(y["importance"])) + F.lit(1e-4))).alias("interaction_strength")))))
    strong = F.filter(pairs, lambda p: F.abs(p["interaction_strength"]) > min_strength)
    return top_parts(wide, k).select("prediction_id", F.inline(strong))


def cooccurrence(df: DataFrame, pairs: Sequence[tuple[str, str]], medians: DataFrame) -> DataFrame:
    """IX-6: share of rows with both values above their medians among rows where
    both are present.  ``medians``: one row with ``med_{col}`` (computed once)."""
    x = df.crossJoin(F.broadcast(medians))
    aggs = []
    for f1, f2 in pairs:
        both = F.col(f1).isNotNull() & F.col(f2).isNotNull()
        hi = both & (F.col(f1) > F.col(f"med_{f1}")) & (F.col(f2) > F.col(f"med_{f2}"))
        aggs += [F.count_if(both).alias(f"n|{f1}|{f2}"), F.count_if(hi).alias(f"h|{f1}|{f2}")]
    one = x.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f1).alias("feature1"), F.lit(f2).alias("feature2"),
                              F.col(f"`n|{f1}|{f2}`").alias("n"), F.col(f"`h|{f1}|{f2}`").alias("h"))
                     for f1, f2 in pairs])
    return one.select(F.explode(rows).alias("r")).select(
        "r.feature1", "r.feature2", F.when(F.col("r.n") > 0, F.col("r.h") / F.col("r.n")).alias("cooccurrence_rate"))


def importance_rank(long: DataFrame, n: int = 15) -> DataFrame:
    """IX-11: per feature mean importance, occurrences, total; top n by mean."""
    g = long.groupBy("feature").agg(F.avg("importance").alias("avg_importance"),
                                    F.count(F.lit(1)).alias("occurrences"), F.sum("importance").alias("total_impact"))
    return g.orderBy(F.col("avg_importance").desc(), F.col("feature")).limit(n)


def global_importance(long: DataFrame, groups: Mapping[str, Sequence[str]], top: int = 10) -> tuple[DataFrame, DataFrame]:
    """IX-12: mean |attribution| per feature (top n) and the share of each
    named feature group in % (groups by name, not column position)."""
    per = long.groupBy("feature").agg(F.avg(F.abs("importance")).alias("mean_abs"))
    top_df = per.orderBy(F.col("mean_abs").desc(), F.col("feature")).limit(top)
    gm = F.create_map(*[x for g, fs in groups.items() for f in fs for x in (F.lit(f), F.lit(g))])
    tot = per.agg(F.sum("mean_abs").alias("t"))
    shares = per.withColumn("group", F.coalesce(gm[F.col("feature")], F.lit("other"))) \
                .groupBy("group").agg(F.sum("mean_abs").alias("s")).crossJoin(F.broadcast(tot)) \
                .select("group", F.when(F.col("t") > 0, F.col("s") * 100.0 / F.col("t")).otherwise(F.lit(0.0))
                        .alias("share_pct"))
    return top_df, shares


def features_by_score_bin(top_long: DataFrame, scores: DataFrame, size: float = 0.1, k: int = 5) -> DataFrame:
    """WN-6: most frequent top features inside each score bin (label "0.3-0.4")."""
    b = F.floor(F.col("fraud_score") / F.lit(size))
    x = top_long.join(scores.select("prediction_id", "fraud_score"), "prediction_id") \
                .withColumn("bin", b)
    c = x.groupBy("bin", "feature").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("bin").orderBy(F.col("count").desc(), F.col("feature"))
    lab = F.concat(F.format_string("%.1f", F.col("bin") * F.lit(size)), F.lit("-"),
                   F.format_string("%.1f", (F.col("bin") + 1) * F.lit(size)))
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
            .select(lab.alias("score_bin"), "feature", "count", "rank")


def explanation_rows(scored: DataFrame, top: DataFrame, key: str = "prediction_id") -> DataFrame:
    """IX-7: label, confidence = 2|s - 0.5| and a sentence from the top factors
    (``top``: rows of ``top_parts``)."""
    tops = top.select(key, F.transform("parts", lambda t: t["feature"]).alias("top_factors"))
    s = F.col("fraud_score")
    label = F.when(s > 0.5, F.lit("FRAUD")).otherwise(F.lit("LEGITIMATE"))
    return scored.join(tops, key, "left").select(
        key, "fraud_score", label.alias("label"), (F.lit(2.0) * F.abs(s - 0.5)).alias("confidence"), "top_factors",
        F.concat(F.lit("Claim assessed as "), label, F.lit(" (score "), F.format_number(s, 2),
                 F.lit("); main factors: "), F.concat_ws(", ", "top_factors"), F.lit(".")).alias("explanation"))


# Fixed values of the rule-based explainers: counterfactual target 0.2, 50 steps,
# score x 0.7 per change; what-if weights 0.4 (mean change) and 0.1 (risky
# increase), direction band 0.05, advice band 0.1, feasibility 0.7 / 0.4;
# sensitivity factor 0.3 (x 1.5 for frequency features); anchor shifts
# -30 %, -10 %, 0, +10 %, +30 %, variance cut 0.01, precision cut 0.15.
RISKY = ("doctor_frequency", "claim_frequency", "claim_amount")
FREQUENCY = ("doctor_frequency", "claim_frequency")


def counterfactual(df: DataFrame, key: str, score: str, cols: Sequence[str], ranges: DataFrame,
                   target: float = 0.2, max_steps: int = 50) -> DataFrame:
    """IX-16 in closed form.  Per feature the best candidate target is the
    range minimum or min + 25 % of the range (largest move, first wins ties;
    moves <= 0.01 are not candidates).  The greedy loop takes features by
    decreasing move (first feature wins ties) and multiplies the score by 0.7
    per step while it is above ``target`` -- so, inside one row, the changed set is the top-k
    features by move, k = min(eligible, steps needed, 50).  ``ranges``: one
    row with ``{c}__min`` / ``{c}__max``."""
    x = df.crossJoin(F.broadcast(ranges))
    items = []
    for i, c in enumerate(cols):
        v, lo, hi = F.col(c).cast("double"), F.col(f"{c}__min"), F.col(f"{c}__max")
        t1, t2 = lo, lo + (hi - lo) * 0.25
        d1, d2 = F.abs(t1 - v), F.abs(t2 - v)
        g1 = F.when(d1 > 0.01, d1).otherwise(F.lit(0.0))
        g2 = F.when(d2 > 0.01, d2).otherwise(F.lit(0.0))
        best_t = F.when(g2 > g1, t2).otherwise(t1)
        items.append(F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"), v.alias("old"),
                              best_t.alias("new"), F.greatest(g1, g2).alias("gain")))
    moves = F.array_sort(F.array(*items), lambda x, y: F.when(x["gain"] > y["gain"], -1).when(x["gain"] < y["gain"], 1).otherwise(x["pos"] - y["pos"]))
    n_steps = F.aggregate(F.sequence(F.lit(0), F.lit(max_steps - 1)), F.lit(0),
                          lambda acc, j: acc + F.when(F.col("_s") * F.pow(F.lit(0.7), j) > F.lit(target), 1)
                          .otherwise(0))
    x = x.select(key, F.col(score).alias("_s"), moves.alias("_m"))
    x = x.withColumn("k", F.least(F.size(F.filter("_m", lambda t: t["gain"] > 0)), n_steps))
    x = x.withColumn("_c", F.slice("_m", 1, F.col("k")))
    distance = F.aggregate("_c", F.lit(0.0), lambda acc, t: acc + F.abs(t["new"] - t["old"]))
    return x.select(key, F.col("_s").alias("original_score"), F.col("k").alias("num_changes"),
                    F.transform("_c", lambda t: t["feature"]).alias("changed_features"),
                    (distance / len(cols)).alias("change_distance"),
                    F.greatest(F.lit(0.5), F.lit(1.0) - F.col("k") * 0.15).alias("confidence"))


def what_if(df: DataFrame, key: str, score: str, factors: dict[str, float]) -> DataFrame:
    """IX-17: every row modified by ``factors`` (new = old * factor)."""
    mags = [F.abs(F.col(c) * f - F.col(c)) for c, f in factors.items()]
    avg = sum(mags, F.lit(0.0)) / len(factors)
    risky = sum((F.when((F.lit(c in RISKY)) & (F.col(c) * f > F.col(c)), 1).otherwise(0) for c, f in factors.items()),
                F.lit(0))
    extreme = None
    for c in factors:
        e = (F.col(c) > 1.5) | (F.col(c) < 0)
        extreme = e if extreme is None else (extreme | e)
    base = F.col(score)
    mod = F.least(F.greatest(base + avg * 0.4 + risky * 0.1, F.lit(0.0)), F.lit(1.0))
    ch = mod - base
    return df.select(key, base.alias("original_prediction"), mod.alias("modified_prediction"), ch.alias("change"),
                     F.when(ch > 0.05, F.lit("Increases risk")).when(ch < -0.05, F.lit("Decreases risk"))
                      .otherwise(F.lit("No significant change")).alias("change_direction"),
                     F.when(extreme, F.lit(0.4)).otherwise(F.lit(0.7)).alias("feasibility"),
                     F.when(ch > 0.1, F.lit("increases fraud risk")).when(ch < -0.1, F.lit("reduces fraud risk"))
                      .otherwise(F.lit("minimal impact")).alias("recommendation"))


def sensitivity(df: DataFrame, key: str, score: str, feature: str, steps: int = 5) -> DataFrame:
    """IX-18: value * (0.5 + i/steps) for i < steps; prediction = clamp(score + 0.3 |change|)."""
    mult = 1.5 if feature in FREQUENCY else 1.0
    x = df.select(key, F.col(score).alias("_s"), F.col(feature).cast("double").alias("_v"),
                  F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    val = F.col("_v") * (F.lit(0.5) + F.col("step") / F.lit(float(steps)))
    pred = F.least(F.greatest(F.col("_s") + F.abs(val - F.col("_v")) * 0.3 * mult, F.lit(0.0)), F.lit(1.0))
    return x.select(key, "step", val.alias("value"), pred.alias("prediction"), (pred - F.col("_s")).alias("change"))


def decision_regions(ranges: DataFrame, feature: str) -> DataFrame:
    """IX-19: five points across the feature's range; likelihood = min(v / max, 1)."""
    lo, hi = F.col(f"{feature}__min"), F.col(f"{feature}__max")
    x = ranges.select(lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    v = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("i") / 4.0)
    lk = F.least(v / F.col("hi"), F.lit(1.0))
    return x.select(F.lit(feature).alias("feature"), "i", v.alias("value"), lk.alias("fraud_likelihood"),
                    F.when(lk < 0.33, F.lit("Low Risk")).when(lk < 0.67, F.lit("Medium Risk"))
                     .otherwise(F.lit("High Risk")).alias("region"))


def anchor_noise(sample: int, feature_pos: int) -> float:
    """Deterministic perturbation in [-0.2, 0.2) for (sample, feature position)."""
    return -0.2 + 0.4 * ((sample * 31 + feature_pos * 17) % 100) / 100.0


def anchors(df: DataFrame, key: str, score: str, cols: Sequence[str], threshold: float = 0.5,
            samples: int = 100) -> DataFrame:
    """IX-15: spread of each feature over the +-10/30 % shifts is 0.6 |v|;
    features with spread > 0.01, top 5 by spread (first wins ties) form the
    anchor; the rule uses the top 3; precision = share of perturbed samples
    whose mean absolute change stays < 0.15; coverage = min(0.4 + 0.3 p, 1).

    The samples of a row are written out as arithmetic on its features with the noise as
    constants, which Spark compiles; a lambda over the samples would be interpreted for each."""
    items = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"),
                      (F.abs(F.col(c).cast("double")) * 0.6).alias("spread")) for i, c in enumerate(cols)]
    arr = F.array(*items)
    imp = F.filter(arr, lambda t: t["spread"] > 0.01)
    top = F.slice(F.array_sort(imp, lambda a, b: F.when(a["spread"] > b["spread"], -1)
                                 .when(a["spread"] < b["spread"], 1)
                                 .otherwise(a["pos"] - b["pos"])), 1, 5)
    fraud = F.col("_s") > threshold
    x = df.select(F.col(key).alias("_k"), F.col(score).alias("_s"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)],
                  top.alias("_top"))
    rule = F.array_join(F.transform(F.slice("_top", 1, 3), lambda t: F.when(
        fraud, F.concat(t["feature"], F.lit(" > "), F.format_string("%.2f", t["v"] * 0.8)))
        .otherwise(F.concat(t["feature"], F.lit(" <= "), F.format_string("%.2f", t["v"] * 1.2)))), " AND ")
    x = x.select("*", F.transform("_top", lambda t: t["feature"]).alias("_names"))
    # what a sample moves: the features that are not held by the anchor
    free = [F.when(F.array_contains("_names", F.lit(c)), F.lit(0.0)).otherwise(F.abs(f"_v{i}")).alias(f"_f{i}") for i, c in enumerate(cols)]
    x = x.select("_k", "_s", "_top", "_names", *free)

    def dev(s: int) -> Column:
        return sum((F.col(f"_f{i}") * abs(anchor_noise(s, i)) for i in range(len(cols))), F.lit(0.0)) / len(cols)

    hits = sum((F.when(dev(s) < 0.15, 1).otherwise(0) for s in range(samples)), F.lit(0))
    # beside the rule's lambda Spark compiles ``hits`` in many small methods; alone it would be one too large to compile
    x = x.select("_k", "_names", F.when(F.size("_top") > 0, rule).otherwise(F.lit("Default rule")).alias("_rule"), hits.alias("_hits"))
    precision = F.col("_hits") / float(samples)
    return x.select(F.col("_k").alias(key), F.col("_names").alias("anchor_features"), F.col("_rule").alias("rule"),
                    precision.alias("precision"), F.least(F.lit(0.4) + precision * 0.3, F.lit(1.0)).alias("coverage"))


def factor_overlap(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """ST-4 / IX-9 / JN-9: common and differing top factors of two explanations."""
    x = a.select(F.col("top_factors").alias("fa")).where(F.col(key_a)).crossJoin(
        b.select(F.col("top_factors").alias("fb")).where(F.col(key_b)))
    return x.select(F.array_sort(F.array_intersect("fa", "fb")).alias("common_factors"),
                    F.array_sort(F.array_except("fa", "fb")).alias("only_first"),
                    F.array_sort(F.array_except("fb", "fa")).alias("only_second"))
