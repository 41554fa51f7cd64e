"""Session settings that the library expects, and tables on the cluster's shared storage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "ratingloom", **conf: object) -> SparkSession:
    """A session with the library's defaults; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one is set where it is unset and the master is local, elsewhere that is an error."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if where is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="ratingloom-")
        context.setCheckpointDir(where)
    return where


def new_folder(spark: SparkSession, kind: str) -> str:
    """The URI of a folder on shared storage that no other call uses."""
    return f"{_shared(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def collected(spark: SparkSession) -> None:
    """Have the driver's JVM collect what earlier jobs have left; Spark's cleaner drops their shuffles and broadcasts, and the disk these take, only then."""
    gc.collect()
    spark._jvm.System.gc()


def saved(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut, on shared storage."""
    _shared(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """df computed once and read back from Parquet on shared storage, and the folder it is in; for what is large, or soon to be deleted."""
    folder = new_folder(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder
