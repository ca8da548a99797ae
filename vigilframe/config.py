"""Column roles and session-level settings."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Sides below this size may be handed to every executor.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
# Target size of one ordered bucket (see operators/ordering.py).
BUCKET_TARGET_BYTES = 32 * 1024 * 1024
# Below this size a whole table may be ordered by one task.
SINGLE_TASK_BYTES = 4 * 1024 * 1024
# Whether Spark removes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Bytes of an Arrow batch; Spark's own bound, 64 MB, is much for whole texts.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT_BATCH_BYTES = 4 * 1024 * 1024


@dataclass(frozen=True)
class RecordSchema:
    """Names of the role columns of a record table."""

    record_id: str = "record_id"
    timestamp: str = "timestamp"
    label: str = "label"
    group: str = "uav_id"


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a plan, or None where it cannot be asked."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:
        return None


def input_bytes(df: DataFrame) -> int | None:
    """Total estimated size of the tables a plan reads."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
        total = 0
        while leaves.hasNext():
            total += int(str(leaves.next().stats().sizeInBytes()))
        return total
    except Exception:
        return None


def is_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    """True only when the optimizer's estimate proves the side fits the limit."""
    size = plan_bytes(df)
    return size is not None and size <= limit


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the session's checkpoint folder.

    A cluster names its shared folder in ``spark.checkpoint.dir``. Only a local
    session without that setting falls back to a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = _local_root()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_LOCAL_ROOT: str | None = None


def _local_root() -> str:
    global _LOCAL_ROOT
    if _LOCAL_ROOT is None:
        _LOCAL_ROOT = tempfile.mkdtemp(prefix="spark-vigilframe-")
    return _LOCAL_ROOT


def materialize(df: DataFrame, purpose: str = "stage", batch_bytes: int | None = None) -> DataFrame:
    """Cut lineage by writing to the shared folder and reading back.

    Shuffle files of the write go with it: nothing reads them once the table stands. ``batch_bytes`` bounds the Arrow
    batches that the write hands to Python: a worker holds two of them, whatever its task's rows.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    settings = {SHUFFLE_CLEANUP: "true", **({ARROW_BYTES: str(batch_bytes)} if batch_bytes else {})}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)
