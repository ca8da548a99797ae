"""Drawing records of a source for every entity and step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.operators.ordering import order_hash, position


def replay_pool(
    pool: DataFrame,
    steps: DataFrame,
    key: str,
    label: str,
    wanted: Sequence[str],
    order: Sequence[str],
    step: str,
    per_step: int,
    mode: str = "loop",
    seed: int = 0,
    buckets: int | None = None,
) -> DataFrame:
    """``per_step`` records of the bound source for every (entity, step).

    ``sequential`` stops at the end of the pool, ``loop`` wraps around, ``random`` draws a
    seeded index. The join is an equi-join on (entity, index), so a large pool is spread
    over its indexes.
    """
    placed = position(
        pool.where(F.col(label).isin(list(wanted))), [key], order, "__rn", size_name="__size", buckets=buckets
    )
    sizes = placed.groupBy(key).agg(F.max("__size").alias("__size"))
    draws = (
        steps.join(sizes, key)
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(per_step - 1)).cast("array<long>")))
        .withColumn("__slot", F.col(step) * per_step + F.col("draw"))
    )
    if mode == "sequential":
        draws = draws.where(F.col("__slot") < F.col("__size")).withColumn("__rn", F.col("__slot"))
    elif mode == "loop":
        draws = draws.withColumn("__rn", F.col("__slot") % F.col("__size"))
    elif mode == "random":
        digest = order_hash(seed, key, "__slot")
        draws = draws.withColumn("__rn", F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.col("__size"))
    else:
        raise ValueError(f"unknown replay mode: {mode}")
    return draws.drop("__size").join(placed.drop("__size"), [key, "__rn"]).drop("__rn", "__slot")
