"""Readers and writers of the reference's files and logs (SO-1 .. SO-14, SO-18).

Every writer is a Spark write (partitioned where readers filter on the
column); every reader takes an explicit schema.  The synthetic-data
generator (SO-16/17) is not rebuilt: the driver's fixture tables are the input.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

# Raw entity tables of the claims model (fixed schemas).
ENTITY_SCHEMAS = {
    "hospitals": "hospital_id string, hospital_name string, specialty string, state string, num_beds int, "
                 "is_accredited boolean, fraud_prone boolean",
    "doctors": "doctor_id string, doctor_name string, specialty string, hospital_id string, years_experience int, "
               "avg_claims_per_month int, license_valid boolean, fraud_prone boolean, ring_id int",
    "patients": "patient_id string, age int, gender string, chronic_condition string, insurance_type string, "
                "state string, member_since_years int, fraud_prone boolean, ring_id int",
    "claims": "claim_id string, patient_id string, doctor_id string, hospital_id string, claim_date date, "
              "claim_amount double, num_procedures int, procedure_code string, diagnosis_code string, "
              "days_in_hospital int, approved boolean, fraud_label int, ring_id int",
}
ALERT_SCHEMA = "claim_id long, fraud_probability double, risk_level string, recommended_action string, ts timestamp"
EXPORT_COLUMNS = ["prediction_id", "ts", "claim_id", "fraud_score", "fraud_prediction", "model_version",
                  "inference_time_ms"]


def load_entities(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """SO-1: the four entity CSVs with header and fixed schemas.  Only empty
    fields are null, so the literal ``None`` (no condition) stays a string."""
    return {name: spark.read.schema(schema).option("header", True).option("nullValue", "")
            .option("dateFormat", "yyyy-MM-dd").csv(f"{folder.rstrip('/')}/{name}.csv")
            for name, schema in ENTITY_SCHEMAS.items()}


def load_provider_tables(spark: SparkSession, folder: str, patterns: Mapping[str, str]) -> dict[str, DataFrame]:
    """SO-2: one CSV family per glob (e.g. ``*Inpatient*.csv``); a missing family is an error."""
    out = {}
    for name, pat in patterns.items():
        try:
            out[name] = spark.read.option("header", True).csv(f"{folder.rstrip('/')}/{pat}")
        except AnalysisException as e:
            raise FileNotFoundError(f"no file matches {pat} in {folder}") from e
    return out


def alert_rows(scored: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    """The HIGH and MEDIUM alerts of scored claims, with their action."""
    from riskloom.functions.tiers import alert_action, alert_level
    s = F.col("fraud_score")
    return scored.where(alert_level(s) != "LOW").select(
        "claim_id", s.alias("fraud_probability"), alert_level(s).alias("risk_level"),
        alert_action(s).alias("recommended_action"),
        (F.lit(as_of) if as_of else F.current_timestamp()).cast("timestamp").alias("ts"))


def write_alerts(scored: DataFrame, path: str, as_of: dt.datetime | None = None) -> None:
    """SO-4: append HIGH and MEDIUM alerts as JSON lines."""
    alert_rows(scored, as_of).write.mode("append").json(path)


def read_alerts(spark: SparkSession, path: str, n: int = 50) -> DataFrame:
    """SO-3: JSON lines with a schema, malformed lines skipped, newest n."""
    a = spark.read.schema(ALERT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return a.orderBy(F.col("ts").desc(), F.col("claim_id").desc()).limit(n)


def write_features(df: DataFrame, path: str, feature_cols: Sequence[str] | None = None) -> None:
    """SO-5 / SO-6: the wide feature table partitioned by split (readers prune
    partitions); optionally with an assembled vector column."""
    out = df
    if feature_cols:
        from pyspark.ml.feature import VectorAssembler
        out = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="keep").transform(df)
    out.write.mode("overwrite").partitionBy("split").parquet(path)


def finite_or_null(df: DataFrame) -> DataFrame:
    """SO-7 helper: NaN / +-inf doubles become null before writing JSON."""
    fixes = {f.name: F.when(F.isnan(f.name) | (F.abs(F.col(f.name)) == F.lit(float("inf"))), F.lit(None))
             .otherwise(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.withColumns(fixes) if fixes else df


def write_metrics(df: DataFrame, path: str) -> None:
    """SO-7: metric documents as JSON (non-finite -> null), one folder per write."""
    finite_or_null(df).coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_results(df: DataFrame, path: str) -> None:
    """SO-8: CSV or JSON chosen by the path's extension."""
    if path.endswith(".json"):
        df.write.mode("overwrite").json(path)
    else:
        df.write.mode("overwrite").option("header", True).csv(path)


def append_predictions(log: DataFrame, path: str) -> None:
    """SO-10: append scored rows to the prediction log, partitioned by date."""
    log.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").parquet(path)


def recent_predictions(spark: SparkSession, path: str, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """SO-9: rows of the last ``days`` before ``as_of`` -- the date filter prunes partitions."""
    lo = as_of - dt.timedelta(days=days)
    log = spark.read.parquet(path)
    return log.where((F.col("date") >= F.lit(lo.date())) & (F.col("date") <= F.lit(as_of.date()))
                     & (F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(as_of)))


def export_csv(log: DataFrame, path: str) -> None:
    """SO-11: fixed 7-column projection; missing values written as empty strings."""
    log.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in log.columns else F.lit("").alias(c)
                 for c in EXPORT_COLUMNS]).write.mode("overwrite").option("header", True).csv(path)


def export_json(log: DataFrame, path: str, as_of: dt.datetime) -> DataFrame:
    """SO-12: predictions as JSON plus a one-row manifest (count, export time)."""
    log.write.mode("overwrite").json(f"{path}/predictions")
    manifest = log.agg(F.count(F.lit(1)).alias("count")).withColumn("exported_at", F.lit(as_of))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def export_latest(log: DataFrame, n: int, ts: str = "ts", key: str = "prediction_id") -> DataFrame:
    """SO-13: newest n rows (top-k)."""
    return log.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


def write_graph(edges: DataFrame, id_maps: DataFrame, rings: DataFrame, path: str) -> None:
    """SO-14: edges partitioned by relation, id maps by node type, ring membership."""
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")
    id_maps.write.mode("overwrite").partitionBy("node_type").parquet(f"{path}/id_maps")
    rings.write.mode("overwrite").parquet(f"{path}/rings")


def verify_outputs(spark: SparkSession, spec: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """SO-18: for each named output (path, required columns): exists, has rows,
    required columns present.  Reads schemas and one row only."""
    rows = []
    for name, (path, required) in spec.items():
        try:
            df = spark.read.parquet(path)
            missing = sorted(set(required) - set(df.columns))
            rows.append((name, True, len(df.limit(1).collect()) > 0, missing))
        except AnalysisException:
            rows.append((name, False, False, sorted(required)))
    return spark.createDataFrame(rows, "output string, exists boolean, has_rows boolean, missing array<string>")
