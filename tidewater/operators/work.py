"""Work tables in the cluster's shared folder, and Arrow batches of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on one machine without that setting, as in tests, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tidewater-"))
    return "file://" + _LOCAL[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/work/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, task: Callable, schema: str) -> DataFrame:
    """df.mapInArrow in batches of at most BATCH_BYTES, or of what the session sets itself."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING).rstrip("b") == str(64 << 20):  # Spark's own
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(task, schema)
