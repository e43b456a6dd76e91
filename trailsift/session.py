"""Session construction and lineage checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

# Settings every job relies on: UTC wall clock for minute buckets, AQE for
# runtime coalescing / skew splitting / broadcast conversion.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Lets AQE coalesce the small shuffle partitions of persisted intermediates too.
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The driver keeps the text of every plan; those of iterative jobs are megabytes long.
    "spark.sql.maxPlanStringLength": "20000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "trailsift") -> SparkSession:
    """Build or fetch a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    for key in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.maxPlanStringLength"):
        spark.conf.set(key, _DEFAULTS[key])
    ensure_checkpoint_dir(spark)
    return spark


def _find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it.

    Workers start with the driver's environment, not with its ``sys.path``. On a cluster whose
    machines don't share that folder the package is installed or passed with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure reliable checkpoints have a directory, and that workers find the package.

    The cluster names its shared folder in ``spark.checkpoint.dir``; it is used as
    is. Only a local-mode session without that setting (tests) gets a private
    temporary folder; a cluster session without it is a configuration error,
    because a machine-local folder would not survive the loss of an executor.
    """
    _find_package(spark)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="trailsift-ckpt-"))
    else:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/...)")
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage: write ``df`` as a Parquet table under the session's checkpoint folder
    and read it back.

    One job, no recomputation (an eager RDD checkpoint computes the plan twice),
    and later reads get column pruning. The folder is the shared one the cluster
    names in ``spark.checkpoint.dir``, so the table survives executor loss.
    """
    spark = df.sparkSession
    path = table_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _sql_literal(value, type_name: str) -> str:
    if value is None:
        text = "NULL"
    elif isinstance(value, bool):
        text = "TRUE" if value else "FALSE"
    elif isinstance(value, int):
        text = str(value)
    else:
        text = "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"CAST({text} AS {type_name})"


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table (``schema`` as DDL) from a SQL ``VALUES`` list: a local relation.

    ``createDataFrame`` on a Python list goes through a Python RDD, so every
    task of the stage that reads it starts a Python worker; a literal array
    would be compiled into generated code. A ``VALUES`` list needs neither.
    Only for tables whose size is fixed or bounded (a lookup list, a file
    index), never for data.
    """
    fields = _parse_datatype_string(schema).fields
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    types = [f.dataType.simpleString() for f in fields]
    values = ", ".join("(" + ", ".join(_sql_literal(v, t) for v, t in zip(row, types)) + ")"
                       for row in rows)
    names = ", ".join(f"`{f.name}`" for f in fields)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def table_path(spark: SparkSession, name: str) -> str:
    """A path under the checkpoint folder for intermediate tables written as Parquet."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/trailsift-tables/" + name
