"""SparkSession construction and session-level helpers."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Conservative defaults that still hold on a large cluster: AQE re-plans joins
# from runtime sizes (broadcast only what actually measured small), coalesces
# small shuffle partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Runtime (post-stage) broadcast threshold: AQE converts a sort-merge join
    # into a broadcast join only when the materialised side measured below it.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Settings for a large cluster (~100 TB input, ~1000 executors), passed to
# spark-submit or SparkSession.builder by the deployment:
#   * start from many shuffle partitions and let AQE coalesce to ~256 MB each,
#     so a 100 TB shuffle gets ~400k tasks and small stages shrink on their own;
#   * 256 MB input splits keep scan tasks well inside executor memory;
#   * skewed partitions (5x the median and over 512 MB) are split by AQE;
#   * the runtime broadcast threshold stays at 64 MB -- anything larger is
#     sort-merge joined; explicit broadcasts in the library are only used for
#     tables bounded by construction (one-row profiles, bucket tables, ...).
CLUSTER_CONF = {
    **DEFAULT_CONF,
    "spark.sql.shuffle.partitions": "400000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64MB",
    "spark.sql.files.maxPartitionBytes": "256MB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512MB",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(app: str = "riskloom", cpus: int | str = "*", shuffle_partitions: int = 8,
                extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks (cluster jobs get theirs from spark-submit)."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("RISKLOOM_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must come from the session configuration (a path
    that driver and executors share); without one this raises, because a
    folder of the driver's own machine would lose what executors write.  Only a
    local master, as in tests, gets a scratch folder.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="riskloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def _derived_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskloom-tables/{spark.sparkContext.applicationId}"


_CLEANED: set = set()


def derived_path(spark: SparkSession) -> str:
    """A new path for a derived table of this application, in the shared folder."""
    app = spark.sparkContext.applicationId
    if app not in _CLEANED:
        _CLEANED.add(app)
        atexit.register(drop_derived_tables, spark)
    return f"{_derived_root(spark)}/{uuid.uuid4().hex}"


def drop_derived_tables(spark: SparkSession) -> None:
    """Delete the derived tables that this application has written (nothing else)."""
    sc = spark.sparkContext
    if sc._jsc is None:           # already stopped
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(_derived_root(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Make ``riskloom`` importable in Python workers (needed where a Python
    function runs on executors).  The package is zipped once per SparkContext;
    Spark's own file server gives it to the executors, wherever the shared folder is."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="riskloom-zip-"), "riskloom.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(d, f)
                    z.write(p, os.path.relpath(p, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


_SHIPPED: set = set()
