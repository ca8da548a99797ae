"""Helpers shared by the training-data operators: words, checked broadcasts, running totals, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.config import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"
# A side of a join is handed to every executor only if it was counted and has no more rows than this.
BROADCAST_ROWS = 20_000
# Places of a filter of keys, and of one of its rows (the size of Spark's bitmaps).
FILTER_BITS = 1 << 26
CELL_BITS = 1 << 15


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str = SPACES) -> Column:
    """Words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a (materialised) side whose counted rows fit the limit, else leave the join to a shuffle."""
    return F.broadcast(df) if df.count() <= limit else df


def may_match(df: DataFrame, key: Column, others: DataFrame, other_key: Column) -> DataFrame:
    """Add ``__may``: false only for rows whose key none of the ``others`` has; such rows need not go to a join.

    A table of ``FILTER_BITS`` bits, in cells of 4 KB, holds a place for every key of the others: some 8 MB for any size.
    Keys that share a place by chance are left to the join. A null key is a key like any other.
    """
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(FILTER_BITS))
    held = others.select(place(other_key).alias("__p")).select(F.expr(f"__p div {CELL_BITS}").alias("__cell"), "__p").repartition("__cell")
    cells = held.groupBy("__cell").agg(F.bitmap_construct_agg(F.col("__p") % CELL_BITS).alias("__bits"))
    cells = F.broadcast(materialize(cells, "filter"))
    byte = F.conv(F.hex(F.substring("__bits", F.expr(f"__p % {CELL_BITS} div 8 + 1").cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.getbit(byte, (F.col("__p") % 8).cast("int")) == 1
    dealt = df.withColumn("__p", place(key)).withColumn("__cell", F.expr(f"__p div {CELL_BITS}")).join(cells, "__cell", "left")
    return dealt.select(*df.columns, F.coalesce(found, F.lit(False)).alias("__may"))


def running_totals(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Add for each name in ``values`` the sum over all rows that come before a row in ``order``.

    Rows are dealt out by ranges of the order; each range is summed by itself and the sums of the ranges before it
    (one row per range) are added.
    """
    part, named = "__part", {f"__v_{k}": v for k, v in values.items()}
    keys = {f"__o{i}": c for i, c in enumerate(order)}
    dealt = df.select("*", *[c.alias(k) for k, c in keys.items()], *[v.alias(k) for k, v in named.items()])
    dealt = dealt.repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys])
    dealt = materialize(dealt.withColumn(part, F.spark_partition_id()), "ranges")
    ends = dealt.groupBy(part).agg(*[F.sum(k).alias(f"{k}_sum") for k in named])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = ends.select(part, *[F.coalesce(F.sum(f"{k}_sum").over(before), F.lit(0)).alias(f"{k}_base") for k in named])
    inside = (
        Window.partitionBy(part)
        .orderBy(*[F.col(k).asc_nulls_last() for k in keys])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = dealt.join(F.broadcast(base), part)
    for name in values:
        k = f"__v_{name}"
        out = out.withColumn(name, F.coalesce(F.sum(k).over(inside), F.lit(0)) + F.col(f"{k}_base"))
    return out.select(*df.columns, *values)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge table (a, b); the component is its smallest node.

    Each round takes the smallest label around a node and then the label of that label, so long chains halve. Labels
    are joined by shuffle, but for a number that is no burden to anybody.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other")))
    both = materialize(both, "edges")
    labels = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component"))
    labels = materialize(labels, "labels")
    while True:
        known = small_side(labels)
        around = both.join(known.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = around.join(known, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        far = known.select(F.col("node").alias("component"), F.col("component").alias("far"))
        step = step.join(far, "component").select("node", "was", F.least("component", "far").alias("component"))
        step = materialize(step, "labels")
        moved = step.where("was <> component").limit(1).count()
        labels = step.select("node", "component")
        if not moved:
            return labels
