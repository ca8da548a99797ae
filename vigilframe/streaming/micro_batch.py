"""Count and adaptive windows per micro-batch with plain batch operators.

The open tail of every group is a table in the shared folder, written once per epoch.
Positions come from the bucketed ordering helper, so a key that holds a third of the
stream is split over many tasks. A replayed epoch reads the tail of the epoch before it
and rewrites its own output, so results stay exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vigilframe.config import materialize
from vigilframe.operators.ordering import match_keys, match_small, position


class CountWindowBatches:
    """``foreachBatch`` sink: emits full count windows of the records seen so far.

    ``adaptive`` (least, most) cuts each window to the length that its own rate of records asks for, as far as the live
    buffer holds it; the first order column is then the time in microseconds. Starts lie ``stride`` apart whatever the
    lengths are, so what a range of a key's records does to the next start is to add its count: ranges are cut side by
    side by the positions of their first records, and no key is walked row by row.
    """

    def __init__(
        self, root: str, group: str, order: list[str], size: int, stride: int, buckets: int | None = None,
        adaptive: tuple[int, int] | None = None,
    ):
        self.root, self.group, self.order, self.adaptive = root, group, order, adaptive
        self.size, self.stride, self.buckets = size, stride, buckets

    def schema(self, batch: DataFrame) -> StructType:
        """Columns of the windows that are written."""
        return StructType([*batch.schema.fields, StructField("window_idx", LongType()), StructField("window_pos", LongType())])

    def _cut(self, out: DataFrame) -> DataFrame:
        if self.adaptive is None or self.size < 2:
            return out
        inside = Window.partitionBy(self.group, "window_idx")
        ts = self.order[0]
        rate = self.size / F.greatest((F.max(ts).over(inside) - F.min(ts).over(inside)) / F.lit(1e6), F.lit(1e-6))
        wanted = self.size * (1 + 0.5 / F.greatest(rate, F.lit(1e-6)))
        least, most = (F.lit(float(x)) for x in self.adaptive)
        length = F.floor(F.least(F.greatest(wanted, least), most))
        return out.withColumn("__length", length).where(F.col("window_pos") < F.col("__length")).drop("__length")

    def _tail_path(self, epoch: int) -> str:
        return f"{self.root}/tail/epoch={epoch}"

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # absolute position of the first buffered record is part of the tail
        if epoch > 0:
            tail = spark.read.parquet(self._tail_path(epoch - 1))
            base = tail.groupBy(self.group).agg(F.min("__abs").alias("__base"))
            rows = tail.drop("__abs").where(F.col(self.order[0]).isNotNull()).unionByName(batch)
        else:
            base, rows = None, batch
        placed = position(rows, [self.group], self.order, "__rel", size_name="__cnt", buckets=self.buckets)
        if base is not None:
            placed = match_small(placed, base, [self.group]).withColumn("__base", F.coalesce("__base", F.lit(0)))
        else:
            placed = placed.withColumn("__base", F.lit(0).cast("long"))
        placed = placed.withColumns(
            {"__abs": F.col("__base") + F.col("__rel"), "__end": F.col("__base") + F.col("__cnt")}
        )
        done = F.floor((F.col("__end") - self.size) / F.lit(self.stride))  # last full window
        low = F.greatest(
            F.ceil((F.col("__abs") - self.size + 1) / F.lit(self.stride)), F.ceil(F.col("__base") / F.lit(self.stride))
        ).cast("long")
        high = F.least(F.floor(F.col("__abs") / F.lit(self.stride)), done).cast("long")
        # written once: windows, tail and markers all read it
        placed = materialize(placed.withColumns({"__low": low, "__high": high, "__next": (F.greatest(done, F.lit(-1)) + 1) * self.stride}))
        out = (
            placed.where(F.col("__low") <= F.col("__high"))
            .withColumn("window_idx", F.explode(F.sequence("__low", "__high")))
            .withColumn("window_pos", F.col("__abs") - F.col("window_idx") * self.stride)
        )
        hidden = [c for c in out.columns if c.startswith("__")]
        self._cut(out.drop(*hidden)).write.mode("overwrite").parquet(f"{self.root}/out/epoch={epoch}")
        keep = F.greatest(F.col("__next"), F.col("__base"))
        tail_cols = [c for c in batch.columns]
        new_tail = placed.where(F.col("__abs") >= keep).select(*tail_cols, "__abs")
        # groups whose buffer ran empty keep their position in a marker row
        empty = placed.groupBy(self.group).agg(
            F.max("__end").alias("__end"), F.max(keep).alias("__keep")
        ).where(F.col("__keep") >= F.col("__end"))
        marker = empty.select(
            *[F.col(c) if c == self.group else F.lit(None).cast(batch.schema[c].dataType).alias(c) for c in tail_cols],
            F.col("__end").alias("__abs"),
        )
        carried = new_tail.unionByName(marker)
        if base is not None:
            idle = spark.read.parquet(self._tail_path(epoch - 1)).where(F.col(self.order[0]).isNull())
            seen = batch.select(self.group).distinct()
            carried = carried.unionByName(match_keys(idle, seen, [self.group], "left_anti").select(*tail_cols, "__abs"))
        carried.write.mode("overwrite").parquet(self._tail_path(epoch))
