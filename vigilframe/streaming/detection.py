"""Fused online detection rows, a micro-batch at a time, from a versioned model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.functions import scores as S
from vigilframe.operators import scoring as G
from vigilframe.operators.calibrate import Calibration, apply_calibration
from vigilframe.sources import model_store as store
from vigilframe.streaming.micro_batch import CountWindowBatches
from vigilframe.streaming.state_tables import WarmupBatches


def save_snapshot(spark: SparkSession, root: str, version: int, model: G.PrototypeModel, cal: Calibration, bank: DataFrame) -> None:
    """Store prototypes, calibration and bank (column ``vec``) as a version; the calibration is written last and makes it valid."""
    path = f"{root}/version={version}"
    store.save_prototypes(spark, model, f"{path}/prototypes")
    store.save_table(bank.select("vec"), f"{path}/bank")
    store.save_calibration(spark, cal, f"{path}/calibration")


def latest_version(spark: SparkSession, root: str) -> int:
    """The newest complete version."""
    found = spark.read.option("basePath", root).parquet(f"{root}/version=*/calibration").agg(F.max("version")).first()
    return int(found[0])


class FusedDetectionBatches:
    """``foreachBatch`` sink: records with a vector in, finished detection rows out.

    An epoch takes the newest model version when it begins. All windows that it completes are scored together by the batch
    operators: four raw scores, normalised and fused, the dominant source, then the warm-up threshold of the key and the
    alert. A window without any vector is an error row and never an alert, and takes no part in the warm-up.
    """

    def __init__(
        self, root: str, models: str, group: str, order: list[str], size: int, stride: int, vector: str, record_id: str,
        benign: Column, ood: Column, known: Column | None = None, mode: str = "normalized", static: float = 1.5, k: int = 5,
    ):
        self.root, self.models, self.group, self.vector, self.record_id, self.k = root, models, group, vector, record_id, k
        self.benign, self.ood, self.known = benign, ood, F.lit(False) if known is None else known
        self.windows = CountWindowBatches(f"{root}/windows", group, order, size, stride)
        self.warmup = WarmupBatches(f"{root}/warmup", mode, static=static)

    def step(self, batch: DataFrame, epoch: int) -> DataFrame:
        spark = batch.sparkSession
        self.windows(batch, epoch)
        version = latest_version(spark, self.models)
        path = f"{self.models}/version={version}"
        model, cal = store.load_prototypes(spark, f"{path}/prototypes"), store.load_calibration(spark, f"{path}/calibration")
        bank = spark.read.parquet(f"{path}/bank")

        rows = spark.read.schema(self.windows.schema(batch)).parquet(f"{self.windows.root}/out/epoch={epoch}")
        item = F.struct("window_pos", F.col(self.record_id).alias("id"), F.col(self.vector).cast("array<double>").alias("v"))
        packed = rows.groupBy(F.col(self.group).cast("string").alias("key"), "window_idx").agg(
            F.sort_array(F.collect_list(item)).alias("r"),
            F.count_if(~self.benign).alias("attack_records"), F.coalesce(F.bool_or(self.ood), F.lit(False)).alias("truth_ood"),
        )
        held = F.filter(F.transform("r", lambda r: r["v"]), lambda v: v.isNotNull())
        total = F.aggregate(F.slice(F.col("h"), 2, F.greatest(F.size("h"), F.lit(1))), F.col("h")[0], lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
        packed = packed.withColumn("h", held).select(
            "key", "window_idx", F.transform("r", lambda r: r["id"]).alias("record_ids"), "attack_records", "truth_ood",
            F.when(F.size("h") > 0, F.transform(total, lambda x: x / F.size("h"))).alias("vec"),
        )
        whole = packed.where("vec is not null")
        raw = G.raw_scores(whole, ["key", "window_idx"], "vec", model, bank, "vec", k=self.k)
        fused = apply_calibration(raw, cal).withColumn("raw_score", S.fuse({n: F.col(n) for n in cal.names}, cal.weights))
        scored = whole.drop("vec").join(fused, ["key", "window_idx"]).withColumns(
            {"calibrated": F.col("fused"), "benign": (F.col("attack_records") == 0) & ~F.col("truth_ood")}
        )
        judged = self.warmup.step(scored, epoch)
        known = F.coalesce(self.known, F.lit(False))
        margin = F.col("score") - F.col("threshold")
        level = F.when(F.col("is_ood"), S.alert_level(margin)).when(known, "warning").otherwise("normal")
        done = judged.select(
            *judged.columns, (known | F.col("is_ood")).alias("has_alert"), ((known | F.col("is_ood")) & (F.col("attack_records") == 0)).alias("false_alert"),
            level.alias("alert_level"), S.alert_reason(known, F.col("is_ood")).alias("alert_reason"), F.lit(False).alias("degenerate"),
        )
        empty = packed.where("vec is null").drop("vec").select(
            "*", *[F.lit(False).alias(c) for c in ("is_ood", "has_alert", "false_alert")], F.lit("degenerate_model_input").alias("threshold_source"),
            F.lit("normal").alias("alert_level"), F.lit("none").alias("alert_reason"), F.lit(True).alias("degenerate"),
        )
        out = done.unionByName(empty, allowMissingColumns=True)
        return out.withColumns(
            {"window_partition": S.window_partition(F.col("truth_ood"), F.col("attack_records") > 0), "model_version": F.lit(version)}
        )

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        self.step(batch, epoch).write.mode("overwrite").parquet(f"{self.root}/out/epoch={epoch}")
