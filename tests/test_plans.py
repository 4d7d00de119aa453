"""Plan checks (physical plans of representative registered queries)."""

import pytest

from tests.conftest import SF001

BATCH_QUERIES = ["hybrid_score_summary", "entity_features_all_splits", "roc_auc_exact", "threshold_sweep",
                 "kl_js_drift", "ks_feature_drift", "zscore_iqr_outliers", "pii_counts_documents",
                 "audit_chain_verify", "khop_claims", "counterfactual_steps", "provider_features",
                 "rolling_drift_alerts", "score_new_only", "anchor_rules"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH_QUERIES)
def test_no_python_rows_and_no_cartesian(spark, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF001)
    df.count()
    plan = _plan(df)
    for node in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct"):
        assert node not in plan, f"{name} has {node}"


def test_drift_filter_reaches_scan(spark):
    import __spark_entry__ as E
    df = E.queries()["kl_js_drift"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    df.count()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_claims_scan_is_pruned(spark):
    """Only the needed lineitem columns are read by the claims view."""
    from riskloom.sources.tables import claims_view
    plan = claims_view(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "l_discount" not in plan and "l_tax" not in plan
