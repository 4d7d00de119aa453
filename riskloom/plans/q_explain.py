"""Interpretability queries: attributions, breakdowns, partial dependence, interactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import explain as ix
from riskloom.operators.ordering import materialize, quantiles
from riskloom.plans import base
from riskloom.plans.q_core import FEATURES_SQL
from riskloom.plans.registry import query
from riskloom.plans.sql_base import SCORED_W, SPLIT_W

#: The numeric features of the model.
XCOLS = ["claim_amount", "num_procedures", "days_in_hospital", "patient_total_claims", "patient_total_amount",
         "patient_avg_amount", "patient_max_amount", "doctor_total_claims", "doctor_total_amount", "doctor_avg_amount",
         "hosp_total_claims", "hosp_avg_amount", "years_experience", "num_beds",
         "amount_vs_patient_avg", "amount_vs_doctor_avg", "amount_vs_hosp_avg", "claim_month", "claim_dayofweek", "claim_day"]
GROUPS = {"claim": XCOLS[:3], "patient": XCOLS[3:7], "provider": XCOLS[7:14], "ratio": XCOLS[14:17]}

_FEAT_CTES = FEATURES_SQL[len(SPLIT_W.rstrip("\n")) + 1:].strip("\n") + """,
ff AS (SELECT *, claim_amount / (patient_avg_amount + 1) AS amount_vs_patient_avg, claim_amount / (doctor_avg_amount + 1) AS amount_vs_doctor_avg,
              claim_amount / (hosp_avg_amount + 1) AS amount_vs_hosp_avg, month(claim_date) AS claim_month,
              isodow(claim_date) - 1 AS claim_dayofweek, day(claim_date) AS claim_day FROM f)"""
ATTR_SQL = SCORED_W.rstrip("\n") + ",\n" + _FEAT_CTES + """,
tf AS (SELECT f.claim_id AS prediction_id, """ + ", ".join(f"f.{c}" for c in XCOLS) + """, s.fraud_score
       FROM ff f JOIN scored s USING (claim_id) WHERE f.split = 'test'),
wts AS (SELECT """ + ", ".join(f"corr(CAST({c} AS DOUBLE), CAST(fraud_label AS DOUBLE)) AS w_{c}" for c in XCOLS) + """
        FROM ff WHERE split = 'train'),
stt AS (SELECT """ + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}"
                               for c in XCOLS) + """ FROM ff WHERE split = 'train'),
al AS (SELECT prediction_id, v.feature, v.value, v.importance FROM tf CROSS JOIN stt CROSS JOIN wts
       CROSS JOIN LATERAL (VALUES """ + ", ".join(
    f"('{c}', CAST({c} AS DOUBLE), coalesce(w_{c}, 0.0) * (CAST({c} AS DOUBLE) - m_{c}) / "
    f"CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END)" for c in XCOLS) + """) v(feature, value, importance)),
top5 AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY prediction_id ORDER BY abs(importance) DESC,
                        feature) AS INTEGER) AS rank FROM al) WHERE rank <= 5)
"""


def test_features(spark, d):
    f = base.features(spark, d)
    s = base.scores(spark, d)
    return f.where("split = 'test'").join(s, "claim_id")


def _attributed(spark, d, only=None):
    """One row of attributions for every test claim, or for those of ``only`` (claim_id), with training statistics."""
    f = base.features(spark, d)
    tr = f.where("split = 'train'")
    w = ix.label_correlation(tr, XCOLS).withColumnRenamed("corr", "w")
    # every claim has a score, and an attribution needs none: only the claims themselves are joined
    test, claims = f.where("split = 'test'"), base.claims_split(spark, d).select("claim_id")
    if only is not None:
        test, claims = (x.join(F.broadcast(only), "claim_id", "left_semi") for x in (test, claims))
    return ix.linear_attributions(test.join(claims, "claim_id"), "claim_id", XCOLS, ix.attribution_stats(tr, XCOLS, w))


def attributions(spark, d):
    """The attributions of every test claim, stored."""
    return base.view(spark, d, "attributions", lambda: _attributed(spark, d))


@query("label_correlation", SPLIT_W.rstrip("\n") + ",\n" + _FEAT_CTES + "\nSELECT * FROM (SELECT " + ", ".join(
    f"corr(CAST({c} AS DOUBLE), CAST(fraud_label AS DOUBLE)) AS {c}" for c in XCOLS) +
    " FROM ff WHERE split = 'train') UNPIVOT (corr FOR feature IN (" + ", ".join(XCOLS) + "))")
def label_correlation(spark, d):
    """AG-13 on the training rows."""
    return ix.label_correlation(base.features(spark, d).where("split = 'train'"), XCOLS)


@query("attributions_long", ATTR_SQL + "SELECT prediction_id, feature, value, importance FROM al")
def attributions_long(spark, d):
    """IX-14 re-aimed: exact linear (correlation-weighted, standardised) attributions."""
    return ix.attribution_rows(attributions(spark, d))


@query("contribution_breakdown", ATTR_SQL + """,
sc AS (SELECT al.*, importance / CASE WHEN sum(abs(importance)) OVER (PARTITION BY prediction_id) = 0 THEN 1.0
                                      ELSE sum(abs(importance)) OVER (PARTITION BY prediction_id) END
                    * CASE WHEN tf.fraud_score < 0.5 THEN 1.0 - tf.fraud_score ELSE tf.fraud_score END AS shap_value
       FROM al JOIN tf USING (prediction_id))
SELECT prediction_id, feature, value, shap_value,
       CAST(row_number() OVER w AS INTEGER) AS rank, sum(abs(shap_value)) OVER (w ROWS UNBOUNDED PRECEDING) AS cumulative_contribution,
       CASE WHEN shap_value > 0 THEN 'increases fraud' ELSE 'decreases fraud' END AS direction
FROM sc WINDOW w AS (PARTITION BY prediction_id ORDER BY abs(shap_value) DESC, feature)""")
def contribution_breakdown(spark, d):
    """IX-1 + IX-2 + WN-4 with the prediction's score as baseline."""
    base_df = test_features(spark, d).select(F.col("claim_id").alias("prediction_id"),
                                             F.col("fraud_score").alias("baseline"))
    return ix.contribution_breakdown(ix.scaled_attribution(attributions(spark, d), base_df))


@query("top_contributions", ATTR_SQL + "SELECT prediction_id, feature, value, importance, rank FROM top5")
def top_contributions(spark, d):
    """WN-5: top-5 features per prediction."""
    return ix.top_contributions(attributions(spark, d), 5)


PD_SQL = SCORED_W.rstrip("\n") + """,
st AS (SELECT min(claim_amount) AS lo, max(claim_amount) AS hi, count(DISTINCT claim_amount) AS nd,
              avg(fraud_score) AS all_avg, count(fraud_score) AS all_n FROM scored),
bn AS (SELECT least(floor((claim_amount - lo) / ((hi - lo) / least(10, nd))), least(10, nd) - 1) AS bin, fraud_score,
              lo, hi, nd FROM scored CROSS JOIN st WHERE hi > lo)
SELECT CAST(bin AS INTEGER) AS bin,
       ((lo + bin * ((hi - lo) / least(10, nd))) + (lo + bin * ((hi - lo) / least(10, nd)) + (hi - lo) / least(10, nd))) / 2
         AS feature_value, avg(fraud_score) AS avg_prediction, count(*) AS sample_count
FROM bn GROUP BY bin, lo, hi, nd
UNION ALL SELECT 0, lo, all_avg, all_n FROM st WHERE hi = lo"""


@query("partial_dependence", PD_SQL)
def partial_dependence(spark, d):
    """IX-3: claim amount vs hybrid score over every scored claim."""
    return ix.partial_dependence(base.scored(spark, d), "claim_amount", "fraud_score")


@query("range_impact", SCORED_W.rstrip("\n") + """,
ps AS (SELECT claim_amount AS f, fraud_score AS p, row_number() OVER (ORDER BY claim_amount, fraud_score) - 1 AS r,
              count(*) OVER () AS n FROM scored)
SELECT 'claim_amount' AS feature,
       coalesce(avg(p) FILTER (WHERE r < n // 4), 0.0) AS low_range_avg_prediction,
       coalesce(avg(p) FILTER (WHERE r >= (3 * n) // 4), 0.0) AS high_range_avg_prediction,
       coalesce(avg(p) FILTER (WHERE r >= (3 * n) // 4) - avg(p) FILTER (WHERE r < n // 4), 0.0) AS impact
FROM ps""")
def range_impact(spark, d):
    """IX-4 / WN-10: lowest vs highest quarter of claims by amount."""
    return ix.range_impact(base.scored(spark, d), "claim_amount", "fraud_score")


@query("feature_interactions", ATTR_SQL + """,
ls AS (SELECT prediction_id, list(struct_pack(f := feature, v := importance) ORDER BY rank) AS xs FROM top5 GROUP BY prediction_id),
pr AS (SELECT prediction_id, xs[i] AS a, xs[j] AS b FROM ls CROSS JOIN (SELECT i, j FROM range(1, 6) x(i) CROSS JOIN range(1, 6) y(j) WHERE i < j) WHERE j <= len(xs))
SELECT prediction_id, a.f AS feature1, b.f AS feature2, (a.v * b.v) / (greatest(abs(a.v), abs(b.v)) + 1e-4) AS interaction_strength
FROM pr WHERE abs((a.v * b.v) / (greatest(abs(a.v), abs(b.v)) + 1e-4)) > 0.01""")
def feature_interactions(spark, d):
    """IX-5: pairs among each prediction's top-5 features (at most 10 per prediction)."""
    return ix.interactions(attributions(spark, d))


CO_PAIRS = [("claim_amount", "num_procedures"), ("claim_amount", "days_in_hospital"),
            ("num_procedures", "days_in_hospital")]


@query("feature_cooccurrence", SCORED_W.rstrip("\n") + """,
md AS (SELECT quantile_cont(claim_amount, 0.5) AS med_claim_amount, quantile_cont(num_procedures, 0.5) AS med_num_procedures,
              quantile_cont(days_in_hospital, 0.5) AS med_days_in_hospital FROM scored)
""" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature1, '{b}' AS feature2, "
    f"(count(*) FILTER (WHERE {a} > med_{a} AND {b} > med_{b}))::DOUBLE / count(*) AS cooccurrence_rate "
    f"FROM scored CROSS JOIN md WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in CO_PAIRS))
def feature_cooccurrence(spark, d):
    """IX-6: medians computed once (exact distributed quantiles), one conditional aggregation."""
    s = base.scored(spark, d)
    meds = None
    for c in ["claim_amount", "num_procedures", "days_in_hospital"]:
        m = quantiles(s.select(F.col(c).cast("double").alias(c)), c, {f"med_{c}": 0.5})
        meds = m if meds is None else meds.crossJoin(m)
    return ix.cooccurrence(s, CO_PAIRS, meds)


@query("importance_rank", ATTR_SQL + """
SELECT feature, avg(importance) AS avg_importance, count(*) AS occurrences, sum(importance) AS total_impact
FROM top5 WHERE rank <= 3 GROUP BY feature ORDER BY avg_importance DESC, feature LIMIT 15""")
def importance_rank(spark, d):
    """IX-11 over the top-3 factors recorded per prediction."""
    return ix.importance_rank(ix.top_contributions(attributions(spark, d), 3).drop("rank"), 15)


@query("global_importance", ATTR_SQL + """
SELECT feature, avg(abs(importance)) AS mean_abs FROM al GROUP BY feature ORDER BY mean_abs DESC, feature LIMIT 10""")
def global_importance(spark, d):
    """IX-12: mean |attribution| per feature, top 10."""
    top, _ = ix.global_importance(ix.attribution_rows(attributions(spark, d)), GROUPS)
    return top


@query("importance_group_shares", ATTR_SQL + """,
per AS (SELECT feature, avg(abs(importance)) AS mean_abs FROM al GROUP BY feature),
grp AS (SELECT CASE """ + " ".join(f"WHEN feature IN ({', '.join(repr(x) for x in fs)}) THEN '{g}'" for g, fs in GROUPS.items()) + """ ELSE 'other' END AS "group",
             mean_abs FROM per)
SELECT "group", CASE WHEN (SELECT sum(mean_abs) FROM per) > 0
                     THEN sum(mean_abs) * 100.0 / (SELECT sum(mean_abs) FROM per) ELSE 0.0 END AS share_pct
FROM grp GROUP BY "group\"""")
def importance_group_shares(spark, d):
    """IX-12: share of each named feature group (by name, not column position)."""
    _, shares = ix.global_importance(ix.attribution_rows(attributions(spark, d)), GROUPS)
    return shares


@query("score_bins", ATTR_SQL + """,
x AS (SELECT floor(tf.fraud_score / 0.1) AS bin, top5.feature FROM top5 JOIN tf USING (prediction_id)),
c AS (SELECT bin, feature, count(*) AS count FROM x GROUP BY bin, feature)
SELECT printf('%.1f', bin * 0.1) || '-' || printf('%.1f', (bin + 1) * 0.1) AS score_bin, feature, count, rank
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY bin ORDER BY count DESC, feature) AS INTEGER) AS rank FROM c)
WHERE rank <= 5""")
def score_bins(spark, d):
    """WN-6: top-5 features inside each 0.1 score bin."""
    t = ix.top_contributions(attributions(spark, d), 5)
    sc = test_features(spark, d).select(F.col("claim_id").alias("prediction_id"), "fraud_score")
    return ix.features_by_score_bin(t, sc)


@query("explanations", ATTR_SQL + """,
tops AS (SELECT prediction_id, list(feature ORDER BY rank) AS top_factors FROM top5 GROUP BY prediction_id)
SELECT prediction_id, fraud_score, CASE WHEN fraud_score > 0.5 THEN 'FRAUD' ELSE 'LEGITIMATE' END AS label,
       2.0 * abs(fraud_score - 0.5) AS confidence, top_factors,
       'Claim assessed as ' || CASE WHEN fraud_score > 0.5 THEN 'FRAUD' ELSE 'LEGITIMATE' END || ' (score '
         || printf('%.2f', fraud_score) || '); main factors: ' || array_to_string(top_factors, ', ') || '.' AS explanation
FROM tf LEFT JOIN tops USING (prediction_id)""")
def explanations(spark, d):
    """IX-7: explanation rows for every test claim."""
    sc = test_features(spark, d).select(F.col("claim_id").alias("prediction_id"), "fraud_score")
    return ix.explanation_rows(sc, ix.top_parts(attributions(spark, d), 5))


# ---------------------------------------------------------------- rule-based explainers (IX-15 .. IX-19)
from riskloom.operators.encode import apply_scaler, fit_scaler  # noqa: E402

XF = XCOLS   # standardised with train mean / population std, as the model sees them
WHATIF = {"claim_amount": 1.5, "num_procedures": 0.5}


def scaled(spark, d):
    def build():
        f = base.features(spark, d).select("claim_id", "split", *XF)
        sc = fit_scaler(f.where("split = 'train'"), XF)
        return apply_scaler(f, sc, XF)
    return base.view(spark, d, "scaled_features", build)


def scaled_test(spark, d):
    s = base.scores(spark, d)
    return scaled(spark, d).where("split = 'test'").join(s, "claim_id")


def ranges(spark, d):
    tr = scaled(spark, d).where("split = 'train'")
    return tr.agg(*[F.min(c).alias(f"{c}__min") for c in XF], *[F.max(c).alias(f"{c}__max") for c in XF])


SCALED_SQL = SCORED_W.rstrip("\n") + ",\n" + _FEAT_CTES + """,
scs AS (SELECT """ + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}"
                               for c in XF) + """ FROM ff WHERE split = 'train'),
xs AS (SELECT claim_id, split, """ + ", ".join(
    f"(CAST({c} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END AS {c}"
    for c in XF) + """ FROM ff CROSS JOIN scs),
rng AS (SELECT """ + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in XF) + """ FROM xs WHERE split = 'train'),
tst AS (SELECT xs.*, s.fraud_score FROM xs JOIN scored s USING (claim_id) WHERE xs.split = 'test')
"""

_CF_VALUES = ", ".join(f"({i}, '{c}', {c}, lo_{c}, lo_{c} + (hi_{c} - lo_{c}) * 0.25)" for i, c in enumerate(XF))


@query("counterfactual_steps", SCALED_SQL + f""",
fl0 AS (SELECT claim_id, fraud_score AS s, x.pos, x.feature, x.v, x.t1, x.t2,
               CASE WHEN abs(x.t1 - x.v) > 0.01 THEN abs(x.t1 - x.v) ELSE 0.0 END AS g1,
               CASE WHEN abs(x.t2 - x.v) > 0.01 THEN abs(x.t2 - x.v) ELSE 0.0 END AS g2
        FROM tst CROSS JOIN rng CROSS JOIN LATERAL (VALUES {_CF_VALUES}) x(pos, feature, v, t1, t2)),
fl AS (SELECT claim_id, s, pos, feature, v, CASE WHEN g2 > g1 THEN t2 ELSE t1 END AS new, greatest(g1, g2) AS gain
       FROM fl0),
rk AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY gain DESC, pos) AS rank FROM fl),
per AS (SELECT claim_id, s, count(*) FILTER (WHERE gain > 0) AS eligible FROM fl GROUP BY claim_id, s),
per2 AS (SELECT *, least(eligible, (SELECT count(*) FROM range(50) r(j) WHERE s * pow(0.7, j) > 0.2)) AS k FROM per)
SELECT p.claim_id, p.s AS original_score, CAST(p.k AS BIGINT) AS num_changes,
       coalesce(list(r.feature ORDER BY r.rank) FILTER (WHERE r.rank <= p.k), []) AS changed_features,
       coalesce(sum(abs(r.new - r.v)) FILTER (WHERE r.rank <= p.k), 0.0) / {len(XF)} AS change_distance,
       CAST(greatest(0.5, 1.0 - p.k * 0.15) AS DOUBLE) AS confidence
FROM per2 p JOIN rk r USING (claim_id) GROUP BY p.claim_id, p.s, p.k""")
def counterfactual_steps(spark, d):
    """IX-16: greedy counterfactual in closed form for every test claim."""
    return ix.counterfactual(scaled_test(spark, d), "claim_id", "fraud_score", XF, ranges(spark, d)) \
             .withColumn("num_changes", F.col("num_changes").cast("long"))


@query("what_if", SCALED_SQL + """,
w AS (SELECT claim_id, fraud_score AS b,
             (abs(claim_amount * 1.5 - claim_amount) + abs(num_procedures * 0.5 - num_procedures)) / 2 AS avg_change,
             CASE WHEN claim_amount * 1.5 > claim_amount THEN 1 ELSE 0 END AS risky,
             claim_amount > 1.5 OR claim_amount < 0 OR num_procedures > 1.5 OR num_procedures < 0 AS extreme FROM tst),
m AS (SELECT *, least(greatest(b + avg_change * 0.4 + risky * 0.1, 0.0), 1.0) AS modp FROM w)
SELECT claim_id, b AS original_prediction, modp AS modified_prediction, modp - b AS change,
       CASE WHEN modp - b > 0.05 THEN 'Increases risk' WHEN modp - b < -0.05 THEN 'Decreases risk'
            ELSE 'No significant change' END AS change_direction,
       CAST(CASE WHEN extreme THEN 0.4 ELSE 0.7 END AS DOUBLE) AS feasibility,
       CASE WHEN modp - b > 0.1 THEN 'increases fraud risk' WHEN modp - b < -0.1 THEN 'reduces fraud risk'
            ELSE 'minimal impact' END AS recommendation
FROM m""")
def what_if(spark, d):
    """IX-17: every test claim with amount x1.5 and procedures x0.5."""
    return ix.what_if(scaled_test(spark, d), "claim_id", "fraud_score", WHATIF)


@query("sensitivity_sweep", SCALED_SQL + """
SELECT claim_id, CAST(i AS INTEGER) AS step, claim_amount * (0.5 + i / 5.0) AS value,
       least(greatest(fraud_score + abs(claim_amount * (0.5 + i / 5.0) - claim_amount) * 0.3, 0.0), 1.0) AS prediction,
       least(greatest(fraud_score + abs(claim_amount * (0.5 + i / 5.0) - claim_amount) * 0.3, 0.0), 1.0) - fraud_score
         AS change
FROM tst CROSS JOIN range(5) r(i)""")
def sensitivity_sweep(spark, d):
    """IX-18: five scalings of the claim amount per test claim."""
    return ix.sensitivity(scaled_test(spark, d), "claim_id", "fraud_score", "claim_amount")


@query("decision_regions", SCALED_SQL + """
SELECT 'claim_amount' AS feature, CAST(i AS INTEGER) AS i, lo_claim_amount + (hi_claim_amount - lo_claim_amount) * (i / 4.0) AS value,
       least((lo_claim_amount + (hi_claim_amount - lo_claim_amount) * (i / 4.0)) / hi_claim_amount, 1.0) AS fraud_likelihood,
       CASE WHEN least((lo_claim_amount + (hi_claim_amount - lo_claim_amount) * (i / 4.0)) / hi_claim_amount, 1.0) < 0.33
            THEN 'Low Risk'
            WHEN least((lo_claim_amount + (hi_claim_amount - lo_claim_amount) * (i / 4.0)) / hi_claim_amount, 1.0) < 0.67
            THEN 'Medium Risk' ELSE 'High Risk' END AS region
FROM rng CROSS JOIN range(5) r(i)""")
def decision_regions(spark, d):
    """IX-19: five points across the training range of the claim amount."""
    return ix.decision_regions(ranges(spark, d), "claim_amount")


_AN_VALUES = ", ".join(f"({i}, '{c}', {c})" for i, c in enumerate(XF))


@query("anchor_rules", SCALED_SQL + f""",
fv AS (SELECT claim_id, fraud_score AS s, x.pos, x.feature, x.v, abs(x.v) * 0.6 AS spread
       FROM tst CROSS JOIN LATERAL (VALUES {_AN_VALUES}) x(pos, feature, v)),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY spread DESC, pos) AS rank
                      FROM fv WHERE spread > 0.01) WHERE rank <= 5),
nm AS (SELECT claim_id, list(feature ORDER BY rank) AS anchor_features,
              string_agg(CASE WHEN s > 0.5 THEN feature || ' > ' || printf('%.2f', v * 0.8)
                              ELSE feature || ' <= ' || printf('%.2f', v * 1.2) END, ' AND ' ORDER BY rank)
                FILTER (WHERE rank <= 3) AS rule FROM tp GROUP BY claim_id),
dv AS (SELECT fv.claim_id, r.smp, sum(CASE WHEN tp.feature IS NULL
                                           THEN abs(fv.v * (-0.2 + 0.4 * ((r.smp * 31 + fv.pos * 17) % 100) / 100.0))
                                           ELSE 0.0 END) / {len(XF)} AS dev
       FROM fv CROSS JOIN range({100}) r(smp) LEFT JOIN tp ON tp.claim_id = fv.claim_id AND tp.feature = fv.feature
       GROUP BY fv.claim_id, r.smp),
pr AS (SELECT claim_id, count(*) FILTER (WHERE dev < 0.15) / 100.0 AS precision FROM dv GROUP BY claim_id)
SELECT t.claim_id, coalesce(nm.anchor_features, []) AS anchor_features, coalesce(nm.rule, 'Default rule') AS rule,
       pr.precision, least(0.4 + pr.precision * 0.3, 1.0) AS coverage
FROM tst t LEFT JOIN nm USING (claim_id) JOIN pr USING (claim_id)""")
def anchor_rules(spark, d):
    """IX-15: anchor features, rule, perturbation precision and coverage per test claim."""
    return ix.anchors(scaled_test(spark, d), "claim_id", "fraud_score", XF)


@query("explanation_compare", ATTR_SQL + """,
tops AS (SELECT prediction_id, list(feature ORDER BY rank) AS f FROM top5 WHERE rank <= 3 GROUP BY prediction_id),
a AS (SELECT f FROM tops WHERE prediction_id = (SELECT min(prediction_id) FROM tops)),
b AS (SELECT f FROM tops WHERE prediction_id = (SELECT max(prediction_id) FROM tops))
SELECT list_sort(list_intersect(a.f, b.f)) AS common_factors,
       list_sort(list_filter(a.f, lambda x: NOT list_contains(b.f, x))) AS only_first,
       list_sort(list_filter(b.f, lambda x: NOT list_contains(a.f, x))) AS only_second
FROM a CROSS JOIN b""")
def explanation_compare(spark, d):
    """IX-9 / IX-20 / ST-4: top-3 factors of the first and last test claims compared."""
    ends = materialize(base.claims_split(spark, d).where("split = 'test'").agg(F.min("claim_id").alias("lo"), F.max("claim_id").alias("hi")))
    ids = ends.select(F.explode(F.array("lo", "hi")).alias("claim_id")).distinct()
    # only the two claims that are compared are explained, under the statistics of all training claims
    two = base.once(spark, d, "attributions", lambda s, at: _attributed(s, at, ids)) \
        .join(F.broadcast(ids), F.col("prediction_id") == F.col("claim_id"), "left_semi")
    tops = materialize(ix.top_parts(two, 3).select("prediction_id", F.transform("parts", lambda t: t["feature"]).alias("top_factors")))
    x = tops.crossJoin(F.broadcast(ends))
    return ix.factor_overlap(x.withColumn("is_a", F.col("prediction_id") == F.col("lo")),
                             x.withColumn("is_b", F.col("prediction_id") == F.col("hi")), "is_a", "is_b")
