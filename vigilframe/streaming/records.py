"""Stream sources and incoming-record normalisation."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.functions.fixed import GLOBAL_STREAM_KEY
from vigilframe.functions.text import group_id, synthesize_record_id


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def normalize_records(
    df: DataFrame, group: str, timestamp: str, record_id: str, counter: str, label: str = "label"
) -> DataFrame:
    """Record id and label filled in; rows without group or timestamp carry a reject reason.

    Works on batch and streaming frames alike.
    """
    reason = F.when(group_id(F.col(group)).isNull(), "missing_group").when(F.col(timestamp).isNull(), "missing_timestamp")
    rid = F.col(record_id).cast("string")
    made = synthesize_record_id(group_id(F.col(group)), F.coalesce(F.col(timestamp).cast("double"), F.lit(0.0)), F.col(counter))
    cols = {
        "reject_reason": reason,
        record_id: F.when(rid.isNull() | (rid == ""), made).otherwise(rid),
        group: group_id(F.col(group)),
    }
    if label not in df.columns and "attack_active" in df.columns:
        kind = F.coalesce(F.nullif(F.col("attack_type"), F.lit("")), F.lit("benign"))
        cols[label] = F.when(F.coalesce("attack_active", F.lit(False)), kind).otherwise("benign")
    return df.withColumns(cols)


def stream_key(group: str):
    """Missing groups share one stream key."""
    return F.coalesce(group_id(F.col(group)), F.lit(GLOBAL_STREAM_KEY))


@contextmanager
def state_partitions(spark: SparkSession, n: int | None) -> Iterator[None]:
    """Number of state partitions for streams started inside; the session setting is put back."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    if n:
        spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_to_table(
    stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", partitions: int | None = None
) -> DataFrame:
    """Process everything available into a Parquet table and return it.

    A stream keeps the state partition count it starts with, so it is an argument here.
    """
    spark = stream.sparkSession
    writer = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", sink)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )
    with state_partitions(spark, partitions):
        query = writer.start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)
