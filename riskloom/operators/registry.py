"""Model registry as an append-only event table (RG-1 .. RG-5, DR-14).

Events: (version, event: register|promote|drift, model_type, f1, precision,
recall, roc_auc, accuracy, ts, drift_kl, drift_js).  State is derived, never
updated in place: the active version is the newest promote event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ["f1", "precision", "recall", "roc_auc", "accuracy"]


def register(versions: DataFrame) -> DataFrame:
    """RG-1: register events; missing metrics -> 0."""
    return versions.select("version", F.lit("register").alias("event"), "model_type",
                           *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in METRICS], "ts")


def promote(events: DataFrame, requests: DataFrame) -> DataFrame:
    """RG-2 / RG-5: promote (or roll back to) registered versions.  A request for
    a version that is not registered becomes a ``rejected`` event; it changes no state."""
    known = events.where(F.col("event") == "register").select("version", "model_type", *METRICS, F.lit(True).alias("_known"))
    asked = requests.join(known, "version", "left")
    return asked.select("version", F.when(F.col("_known"), F.lit("promote")).otherwise(F.lit("rejected")).alias("event"),
                        "model_type", *METRICS, "ts")


def registry_state(events: DataFrame) -> DataFrame:
    """RG-2: per version -- registered metrics, is_active (exactly the newest
    promote), deactivated_at (the next promote after it was active)."""
    regs = events.where(F.col("event") == "register")
    promos = events.where(F.col("event") == "promote").select("version", "ts")
    active = promos.agg(F.max_by("version", F.struct("ts", "version")).alias("active_version"))
    last_p = promos.groupBy("version").agg(F.max("ts").alias("last_promoted"))
    nxt = promos.select(F.col("ts").alias("p_ts"))
    st = regs.join(last_p, "version", "left").crossJoin(F.broadcast(active))
    # deactivation = first promote of any version after this one's last promotion (small event table)
    de = st.where(F.col("last_promoted").isNotNull()).join(nxt, F.col("p_ts") > F.col("last_promoted"), "left") \
           .groupBy("version").agg(F.min("p_ts").alias("deactivated_at"))
    return st.join(de, "version", "left").select(
        "version", "model_type", *METRICS, F.col("ts").alias("registered_at"), "last_promoted",
        (F.col("version") == F.col("active_version")).alias("is_active"),
        F.when(F.col("version") != F.col("active_version"), F.col("deactivated_at")).alias("deactivated_at"))


def compare_versions(state: DataFrame, a: str, b: str) -> DataFrame:
    """RG-4 / JN-9: f1 difference and the better version (first wins ties)."""
    x = state.where(F.col("version") == a).select(F.col("f1").alias("f1_a"))
    y = state.where(F.col("version") == b).select(F.col("f1").alias("f1_b"))
    return x.crossJoin(y).select(F.lit(a).alias("version_a"), F.lit(b).alias("version_b"), "f1_a", "f1_b",
                                 (F.col("f1_b") - F.col("f1_a")).alias("f1_difference"),
                                 F.when(F.col("f1_b") > F.col("f1_a"), F.lit(b)).otherwise(F.lit(a)).alias("better"))


def task_log(tasks: DataFrame) -> DataFrame:
    """RG-6: task results (task_id, task, ts, ok) as log rows, appended like model events."""
    return tasks.select("task_id", "task", "ts", F.when(F.col("ok"), F.lit("completed")).otherwise(F.lit("failed")).alias("status"))


def newest_tasks(log: DataFrame, n: int) -> DataFrame:
    """RG-6: the newest ``n`` task results (the id breaks ties)."""
    return log.orderBy(F.col("ts").desc(), F.col("task_id").desc()).limit(n)


def record_drift(events: DataFrame, drift: DataFrame, version_col: str = "active_version") -> DataFrame:
    """DR-14: append a drift event for the active version (latest wins when read)."""
    return drift.select(F.col(version_col).alias("version"), F.lit("drift").alias("event"),
                        F.lit(None).cast("string").alias("model_type"), *[F.lit(None).cast("double").alias(m) for m in METRICS],
                        F.col("as_of").alias("ts"), F.col("kl_divergence").alias("drift_kl"),
                        F.col("js_divergence").alias("drift_js"))
