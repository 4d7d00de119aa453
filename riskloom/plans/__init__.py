"""Registered query catalogue (Spark plans + DuckDB oracle SQL)."""

from riskloom.plans import q_audit, q_batch, q_compliance, q_core, q_eval, q_explain, q_explore, q_extra, q_graph, q_graphview, q_io, q_metrics, q_ml, q_monitor, q_ops, q_provider, q_scoring, q_stream, q_trees  # noqa: F401  (registration side effects)
from riskloom.plans.registry import ORACLE, QUERIES  # noqa: F401
