"""Readers for the fixture tables and the two derived views the library works on.

* ``claims`` -- one row per claim, built from lineitem/orders/supplier (see
  ``claims_view``).
* ``prediction_log`` -- the scored-claims audit log, built from ``events``.

Everything is lazy: a view is a logical plan, so Catalyst prunes columns and
pushes filters into the Parquet scans of whichever query uses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.clean import dedup_first

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Order that makes (l_orderkey, l_linenumber) duplicates deterministic: the
# first row by these columns is kept (measured total at every fixture size).
CLAIM_TIE_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")

#: Rows that a task sorts at once: lines and claims then need about 100 MB of its memory.
TASK_ROWS = 400_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def claim_id_expr(orderkey: Column, linenumber: Column) -> Column:
    """Compact long claim key: line numbers are 1..7, so 3 bits suffice."""
    return orderkey * F.lit(8) + linenumber


def claims_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims table of the reference, derived from the fixture tables.

    claim        = one lineitem, de-duplicated on (l_orderkey, l_linenumber)
    patient_id   = o_custkey          doctor_id  = l_suppkey
    hospital_id  = s_nationkey        part_id    = l_partkey (specialty lookup)
    claim_date   = l_shipdate         claim_amount = l_extendedprice
    num_procedures = l_quantity       days_in_hospital = pmod(l_partkey, 15)
    fraud_label  = l_returnflag='R'   approved   = l_linestatus='F'
    ring_id      = pmod(l_suppkey, 6) for fraudulent claims, else 0
    insurance_type = o_orderpriority

    Plan: lines and orders are dealt by the order key once, which serves the
    de-duplication and the join (both sides grow with the data), over enough
    tasks for none to sort more lines than its memory holds; the two
    columns of supplier, one row to about 600 lines, are broadcast.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", *CLAIM_TIE_ORDER, "l_returnflag", "l_linestatus")
    li = deal(li.where(F.col("l_orderkey").isNotNull()).repartition("l_orderkey"), "l_orderkey", li.count())
    li = dedup_first(li, ["l_orderkey", "l_linenumber"], list(CLAIM_TIE_ORDER))
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = (li.join(orders, li.l_orderkey == orders.o_orderkey)
           .join(F.broadcast(supplier), li.l_suppkey == supplier.s_suppkey))
    label = (F.col("l_returnflag") == "R").cast("int")
    return j.select(
        claim_id_expr(F.col("l_orderkey"), F.col("l_linenumber")).alias("claim_id"),
        F.col("o_custkey").alias("patient_id"),
        F.col("l_suppkey").alias("doctor_id"),
        F.col("s_nationkey").alias("hospital_id"),
        F.col("l_partkey").alias("part_id"),
        F.to_date("l_shipdate").alias("claim_date"),
        F.col("l_extendedprice").alias("claim_amount"),
        F.col("l_quantity").cast("int").alias("num_procedures"),
        F.pmod("l_partkey", F.lit(15)).cast("int").alias("days_in_hospital"),
        label.alias("fraud_label"),
        (F.col("l_linestatus") == "F").alias("approved"),
        F.when(label == 1, F.pmod("l_suppkey", F.lit(6))).otherwise(F.lit(0)).cast("int").alias("ring_id"),
        F.col("o_orderpriority").alias("insurance_type"),
    )


def patients_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient dimension: customer -> (patient_id, gender, state_key, acctbal)."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("patient_id"),
                    F.col("c_mktsegment").alias("gender"),
                    F.col("c_nationkey").alias("patient_nation"),
                    F.col("c_acctbal").alias("acctbal"))


def doctors_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("doctor_id"),
                    F.col("s_nationkey").alias("hospital_id"),
                    F.col("s_acctbal").alias("years_experience"))


def hospitals_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("hospital_id"),
                    F.col("n_name").alias("state"),
                    F.col("n_regionkey").alias("num_beds"))


def parts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("specialty"))


SCORE_VALUE_SCALE = 500.0


def prediction_log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction/audit log over ``events``.

    prediction_id = event_id, model_version/endpoint = event_type,
    fraud_score = least(value/500, 1), inference_time_ms = value.
    """
    e = read_table(spark, sf_dir, "events")
    score = F.least(F.col("value") / F.lit(SCORE_VALUE_SCALE), F.lit(1.0))
    return e.select(
        F.col("event_id").alias("prediction_id"),
        "ts",
        "user_id",
        F.col("event_type").alias("model_version"),
        F.col("event_type").alias("endpoint"),
        score.alias("fraud_score"),
        (score > F.lit(0.5)).alias("fraud_prediction"),
        F.col("value").alias("inference_time_ms"),
        "props",
    )


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Round-robin a scan over ``parts`` partitions before CPU-heavy per-row work.
    ``None`` leaves the scan's own splits, which is right for inputs of many files or row
    groups; a table in one row group needs a number."""
    return df.repartition(parts) if parts else df


def deal(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` dealt by ``key`` for a step that sorts its ``rows``: ``TASK_ROWS`` to a task.  A number of
    partitions that is asked for is not merged by adaptive execution, which looks at the compressed
    size (64 MB are 1.4 million lines, 250 MB when sorted).  Few rows are left as they are."""
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, key) if parts > df.sparkSession.sparkContext.defaultParallelism else df
